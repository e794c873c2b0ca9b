from pyspark.sql import functions as F

from savora.operators import cleaning as C
from savora.operators import features as E

RULES = dict(stopwords=E.MENU_STOPWORDS, units=E.MENU_UNITS, keep=E.MENU_KEEP, min_length=1)


def test_clean_menu_cases(spark):
    cases = [("김치찌개(1인분)", "김치찌개"), ("불고기 세트", "불고기"), ("짜장면123", "짜장면"), ("가격표", None), ("추가메뉴", "메뉴"), ("", None), ("a", None), (None, None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, m string")
    got = {r["i"]: r["c"] for r in df.select("i", E.clean_menu(F.col("m"), **RULES).alias("c")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1] for c in cases]


def test_clean_menu_lists(spark):
    df = spark.createDataFrame([(1, "['김치찌개(1인분)', '가격표', '짜장면123']"), (2, "[]"), (3, "broken"), (4, None)], "i int, m string")
    got = {r["i"]: r["c"] for r in df.select("i", E.clean_menu_list(C.parse_string_list("m"), **RULES).alias("c")).collect()}
    assert got == {1: ["김치찌개", "짜장면"], 2: [], 3: [], 4: []}


def _menus(spark):
    return spark.createDataFrame(
        [(1, "한식", ["김치찌개", "불고기"]), (2, "한식", ["김치찌개", "된장찌개"]), (3, "중식", ["짜장면"]), (4, None, ["물"])],
        "diner_idx long, large string, menus array<string>",
    )


def test_frequency_and_selection(spark):
    freq = E.menu_frequency(_menus(spark), "large", "menus")
    assert {(r["large"], r["menu"]): r["n"] for r in freq.collect()} == {("한식", "김치찌개"): 2, ("한식", "불고기"): 1, ("한식", "된장찌개"): 1, ("중식", "짜장면"): 1}
    assert [r["menu"] for r in E.frequent_menus(freq, "large", 2).collect()] == ["김치찌개"]
    assert {r["large"]: r["menu"] for r in E.frequent_menus(freq, "large", 1, 1).collect()} == {"한식": "김치찌개", "중식": "짜장면"}


def test_valid_menus_and_multi_hot(spark):
    freq = E.frequent_menus(E.menu_frequency(_menus(spark), "large", "menus"), "large", 2)
    valid = E.valid_menus(_menus(spark), "diner_idx", "large", "menus", freq)
    assert {r["diner_idx"]: r["valid_menus"] for r in valid.collect()} == {1: ["김치찌개"], 2: ["김치찌개"], 3: [], 4: []}
    hot = E.multi_hot(_menus(spark), "large", "menus", {"한식": ["김치찌개", "불고기"], "중식": ["짜장면"]}).orderBy("diner_idx").collect()
    assert [tuple(r)[3:] for r in hot] == [(1, 1, 0), (1, 0, 0), (0, 0, 1), (0, 0, 0)]


def test_price_statistics_fill_with_the_median(spark):
    rows = [(1, ["1000", "변동가격", "3000"]), (2, ["변동가격"]), (3, None), (4, ["5000"])]
    df = spark.createDataFrame(rows, "diner_idx long, p array<string>")
    got = {r["diner_idx"]: tuple(r)[1:] for r in E.price_stats(df, "diner_idx", F.col("p"), "변동가격").collect()}
    assert got[1] == (1000.0, 3000.0, 2000.0, 2000.0, 2.0)
    assert got[2] == (3000.0, 4000.0, 3500.0, 3500.0, 0.0)
    assert got[3] == (3000.0, 4000.0, 3500.0, 3500.0, 1.0)


def test_unknown_feature_is_refused(spark):
    store = E.FeatureStore("id")
    try:
        store.build(spark.range(1), {"nope": {}})
    except ValueError as err:
        assert "nope" in str(err)
    else:
        raise AssertionError("unknown feature accepted")


def test_count_bucket_borders(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 10, 11, 50, 51, 200, 201)], "n long")
    assert [r["b"] for r in df.select(E.count_bucket("n").alias("b")).collect()] == [0, 1, 1, 2, 2, 3, 3, 4]
