import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from savora.operators import category as K

SIMPLE = {
    "한식": {"덮밥류": ["덮밥", "덮밥90도씨"], "탕/순대/국밥": ["곰탕", "국밥"], "면/국류": ["국수"]},
    "양식": {"수제버거": ["햄버거"]},
    "카페": {"커피": ["아임일리터", "커피전문점"]},
    "치킨": {"치킨전문점": ["BBQ", "프라이드"]},
    "분식": {"떡볶이/순대/튀김": ["떡볶이"]},
}
CASES = [
    ("한식", "덮밥90도씨", "덮밥류"), ("한식", "곰탕", "탕/순대/국밥"), ("양식", "햄버거", "수제버거"), ("카페", "아임일리터", "커피"),
    ("치킨", "BBQ", "치킨전문점"), ("한식", "국수", "면/국류"), ("분식", "떡볶이", "떡볶이/순대/튀김"),
]


def test_simplify_cases(spark):
    rows = [(i, a, b) for i, (a, b, _) in enumerate(CASES)]
    rows += [(100, "양식", "bbq치킨"), (101, "샐러드", "수제 햄버거"), (102, "한식", "없는것"), (103, "한식", None), (104, None, "국수")]
    df = spark.createDataFrame(rows, "i int, large string, middle string")
    got = {r["i"]: (r["large"], r["simplified"]) for r in K.simplify(df, K.rule_table(spark, SIMPLE)).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == (a, c) for i, (a, _, c) in enumerate(CASES))
    assert got[100][1] == "치킨전문점" and got[101][1] == "수제버거" and got[102][1] == "없는것"
    assert got[103][1] is None and got[104][1] == "국수"


def test_simplify_process_moves(spark):
    rows = [
        (1, "간식", "닭강정", None, None), (2, "한식", "분식", "떡볶이", None), (3, "한식", "분식", None, None), (4, "샐러드", "기타", None, None),
        (5, "일식", "전통일식집", None, None), (6, "분식", "분식", "모름", "떡볶이집"), (7, "술집", "이탈리안", None, None),
    ]
    df = spark.createDataFrame(rows, "i int, large string, middle string, small string, detail string")
    got = {r["i"]: (r["large"], r["middle"]) for r in K.simplify_process(df, K.rule_table(spark, SIMPLE)).collect()}
    assert got == {
        1: ("치킨", "닭강정"), 2: ("분식", "떡볶이/순대/튀김"), 3: ("분식", "분식"), 4: ("양식", "기타"), 5: ("기타", "전통일식집"),
        6: ("분식", "떡볶이/순대/튀김"), 7: ("양식", "이탈리안"),
    }


def test_rule_chain_keeps_rows(spark):
    rules = {
        "chicken_category": {"구이": ["굽네치킨"]},
        "lowering_large_categories": {"기타": ["뷔페"], "양식": ["치킨"]},
        "lowering_middle_categories": {"도시락": ["덮덮밥"]},
        "partly_lowering_large_categories": {"양식": {
            "lowering_large_categories": ["패스트푸드"], "partly_lowering_large_category": "패스트푸드",
            "partly_lowering_middle_categories": ["샌드위치"], "changing_middle_category": "햄버거"}},
        "integrate_diner_category_middle": {"한식": {"국밥": ["순대", "곰탕"]}},
        "rename_diner_category_middle": {"한식": {"두부전문점": "순두부,두부전문점"}},
    }
    rows = [
        (1, "치킨", "굽네치킨", None, None), (2, "치킨", None, None, None), (3, "뷔페", "고기", "소", None), (4, "한식", "덮덮밥", "x", None),
        (5, "패스트푸드", "샌드위치", None, None), (6, "패스트푸드", "버거", None, None), (7, "한식", "순대", None, None), (8, "한식", "두부전문점", None, None),
    ]
    df = spark.createDataFrame(rows, "i int, large string, middle string, small string, detail string")
    got = {r["i"]: tuple(r)[1:] for r in K.process_all(df, rules).collect()}
    assert got == {
        1: ("양식", "치킨", "숯불치킨", "굽네치킨"), 2: ("양식", "치킨", "치킨전문점", None), 3: ("기타", "뷔페", "고기", "소"), 4: ("한식", "도시락", "덮덮밥", "x"),
        5: ("양식", "샌드위치", None, None), 6: ("양식", "햄버거", "버거", None), 7: ("한식", "국밥", None, None), 8: ("한식", "순두부,두부전문점", None, None),
    }


def test_knn_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("AB"), rng.choice(["m1", "m2", "m3", None]), rng.choice(["s1", "s2", "s3", "s4", None]), rng.choice(["d1", "d2", "d3"])) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, large string, middle string, small string, detail string")
    held = {r["id"] for r in df.where(K.holdout(F.col("id"))).select("id").collect()}
    got = {r["id"]: r["predicted"] for r in K.knn_impute(df, "id").collect()}
    codes = defaultdict(dict)
    for g in "AB":
        for pos, name in ((3, "small"), (4, "detail")):
            vals = sorted({r[pos] for r in rows if r[1] == g and r[2] and r[pos]})
            codes[g, name] = {v: c for c, v in enumerate(vals)}
    code = lambda r: (codes[r[1], "small"].get(r[3], -1), codes[r[1], "detail"].get(r[4], -1))
    for r in (r for r in rows if r[2] is None):
        s0, d0 = code(r)
        near = sorted(((a - s0) ** 2 + (b - d0) ** 2, a, b, o[2]) for o in rows if o[1] == r[1] and o[2] and o[0] not in held for a, b in [code(o)])[:5]
        zero = Counter(m for dist, _, _, m in near if dist == 0)
        votes = zero or Counter()
        if not zero:
            for dist, _, _, m in near:
                votes[m] += 1 / dist**0.5
        best = min(votes, key=lambda m: (-round(votes[m], 9), m))
        assert got[r[0]] == best


def test_change_patterns(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z"), (5, "w")], "i long, middle string")
    b = spark.createDataFrame([(1, "x1"), (2, "x2"), (3, "y"), (4, "q"), (5, "q")], "i long, middle string")
    got = {(r["before"], r["after"]): (r["pattern"], r["merged"]) for r in K.change_patterns(a, b, "i").collect()}
    assert got == {("x", "x1"): ("split", 0), ("x", "x2"): ("split", 0), ("y", "y"): ("kept", 0), ("z", "q"): ("renamed", 1), ("w", "q"): ("renamed", 1)}


def test_nearest_coded_equals_all_pairs(spark):
    """Cells of several widths, equal distances, copies that fill the k, codes of -1 and categories on one side only."""
    r = random.Random(4)
    points = {}
    for large, span, n in [("a", 70, 60), ("b", 3, 40), ("c", 400, 5), ("d", 0, 1)]:
        for _ in range(n):
            points[(large, r.randint(-1, span), r.randint(-1, span), r.choice("xyz"))] = r.choice([1, 1, 2, 9])
    spots = {(large, r.randint(-1, 70), r.randint(-1, 70)) for large in "abcdq" for _ in range(12)}
    want = {}
    for large, s0, d0 in spots:
        left = 4
        for d2, s, d, m in sorted(((s - s0) ** 2 + (d - d0) ** 2, s, d, m) for g, s, d, m in points if g == large):
            if left > 0:
                use = min(left, points[(large, s, d, m)])
                left -= use
                want.setdefault((large, s0, d0), []).append((float(d2), m, use))
    sp = spark.createDataFrame(sorted(spots), "large string, s0 int, d0 int")
    pt = spark.createDataFrame([(*k, v) for k, v in points.items()], "large string, small_code int, detail_code int, middle string, cnt long")
    for width in (1, 4, 1024):
        got = {}
        for x in K.nearest_coded(sp, pt, 4, width).collect():
            got.setdefault((x["large"], x["s0"], x["d0"]), []).append((x["d2"], x["middle"], x["use"]))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert K.nearest_coded(sp, pt.limit(0), 4).count() == 0 and K.nearest_coded(sp.limit(0), pt, 4).count() == 0
