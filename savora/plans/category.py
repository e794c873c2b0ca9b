"""C: category hierarchy, with rule tables over the test tables' part types and brands."""

from __future__ import annotations

from pyspark.sql import functions as F

from savora.operators import category as K
from savora.plans.registry import query
from savora.plans.splits import HASH_SQL

LISTED = ["Brand#1", "Brand#5", "Brand#9"]
KEPT = ["Brand#2", "Brand#3"]
LOWER_LARGE = {"MEDIUM": ["SMALL"], "LARGE": ["PROMO", "STANDARD"]}
LOWER_MIDDLE = {"house": ["Brand#4", "Brand#6"], "import": ["Brand#7", "SMALL"]}
PART = [K.PartMove("LARGE", "ECONOMY", ["Brand#8"], "cheap", ["ECONOMY"])]
INTEGRATE = {"LARGE": {"top": ["Brand#10", "Brand#11"], "rest": ["Brand#12"]}, "MEDIUM": {"top": ["Brand#13"]}}
RENAME = {"LARGE": {"cheap": "budget"}, "MEDIUM": {"Brand#20": "twenty"}}
COLS = ["diner_idx", "large", "middle", "small", "detail"]


def _cats(t):
    return t.diner.select(*COLS)


def _in(col, values):
    return f"coalesce({col} IN ({', '.join(repr(v) for v in values)}), false)"


def _upd(src, cond, **new):
    cols = ", ".join(f"CASE WHEN {cond} THEN {new[c]} ELSE {c} END AS {c}" if c in new else c for c in COLS)
    return f"SELECT {cols} FROM ({src})"


BASE = f"SELECT {', '.join(COLS)} FROM diner"


def split_sql(src):
    return _upd(src, f"{_in('large', ['PROMO'])} AND NOT {_in('middle', KEPT)}", small="middle",
                middle=f"CASE WHEN {_in('middle', LISTED)} THEN 'grilled' ELSE 'fried' END")


def lower_sql(src, level, mapping):
    for after, before in mapping.items():
        new = dict(detail="small", small="middle", middle="large", large=f"'{after}'") if level == "large" else dict(detail="small", small="middle", middle=f"'{after}'")
        src = _upd(src, _in(level, before), **new)
    return src


def part_sql(src):
    for m in PART:
        src = _upd(src, f"{_in('large', [m.part_large])} AND {_in('middle', m.part_middles)}", large=f"'{m.after}'")
        src = _upd(src, _in("large", m.before), detail="small", small="middle", middle=f"'{m.new_middle}'", large=f"'{m.after}'")
    return src


def integrate_sql(src):
    for large, news in INTEGRATE.items():
        for new, old in news.items():
            src = _upd(src, f"{_in('large', [large])} AND {_in('middle', old)}", middle=f"'{new}'")
    return src


def rename_sql(src):
    whens = " ".join(f"WHEN large = '{lg}' AND middle = '{o}' THEN '{n}'" for lg, names in RENAME.items() for o, n in names.items())
    return f"SELECT diner_idx, large, CASE {whens} ELSE middle END AS middle, small, detail FROM ({src})"


@query("c1_split_brand", split_sql(BASE))
def c1(t):
    return K.split_brand(_cats(t), "PROMO", KEPT, LISTED, "grilled", "fried")


@query("c2_lower_large", lower_sql(BASE, "large", LOWER_LARGE))
def c2(t):
    return K.lower_level(_cats(t), "large", LOWER_LARGE)


@query("c3_lower_middle", lower_sql(BASE, "middle", LOWER_MIDDLE))
def c3(t):
    return K.lower_level(_cats(t), "middle", LOWER_MIDDLE)


@query("c4_partly_lower", part_sql(BASE))
def c4(t):
    return K.partly_lower(_cats(t), PART)


@query("c5_integrate_middles", integrate_sql(BASE))
def c5(t):
    return K.integrate_middles(_cats(t), INTEGRATE)


@query("c6_rule_chain", rename_sql(integrate_sql(part_sql(lower_sql(lower_sql(split_sql(BASE), "large", LOWER_LARGE), "middle", LOWER_MIDDLE)))))
def c6(t):
    df = K.split_brand(_cats(t), "PROMO", KEPT, LISTED, "grilled", "fried")
    df = K.lower_level(K.lower_level(df, "large", LOWER_LARGE), "middle", LOWER_MIDDLE)
    return K.rename_middles(K.integrate_middles(K.partly_lower(df, PART), INTEGRATE), RENAME)


SIMPLE = {
    "PROMO": {"low": ["Brand#1", "Brand#25"], "mid": ["#15", "BRAND#16"], "hot": ["hot", "11"]},
    "LARGE": {"two": ["Brand#2"], "any": ["d#1"]},
    "SMALL": {"s": ["Brand#22", "brand#23 deluxe"], "old": ["old"]},
}
ALIAS, EXTRA = {"MEDIUM": "LARGE"}, {"LARGE": "SMALL"}
_RULES = [(s, n, o) for s, ns in SIMPLE.items() for n, os in ns.items() for o in os]
RULES_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{n}', '{o}', {i})" for i, (s, n, o) in enumerate(_RULES)) + ") v(section, simplified, original, prio))"


def _simple_sql(large, middle):
    """Scalar expression with the simplified name; relies on the `rules` CTE."""
    own = f"CASE WHEN {large} = 'MEDIUM' THEN 'LARGE' ELSE {large} END"
    extra = f"CASE WHEN {own} = 'LARGE' THEN 'SMALL' END"
    stage = f"""CASE WHEN original = {middle} THEN 0 WHEN contains(lower({middle}), lower(original)) OR contains(lower(original), lower({middle})) THEN 2 END + CASE WHEN section = {own} THEN 0 ELSE 1 END"""
    return f"""coalesce((SELECT arg_min(simplified, ({stage}, prio)) FROM rules WHERE (section = {own} OR section = {extra}) AND ({stage}) IS NOT NULL AND {middle} <> ''), {middle})"""


def _rules(t):
    return K.rule_table(t.spark, SIMPLE)


@query("c7_simplify_middle", f"WITH {RULES_SQL} SELECT diner_idx, large, middle, {_simple_sql('d.large', 'd.middle')} AS simplified FROM diner d")
def c7(t):
    return K.simplify(_cats(t).select("diner_idx", "large", "middle"), _rules(t), alias=ALIAS, extra=EXTRA)


PLAN = K.SimplifyPlan(
    before=(("ECONOMY", "Brand#5", "PROMO", False), ("STANDARD", "Brand#6", "SMALL", True)),
    generic=("PROMO",),
    after=(("LARGE", ("two",), "SMALL"), ("MEDIUM", None, "LARGE"), (None, ("low", "mid"), "ECONOMY")),
    sections={"alias": ALIAS, "extra": EXTRA},
)


def _process_sql():
    src = _upd(BASE, "coalesce(large = 'PROMO' AND diner_idx % 2 = 0, false)", middle="'PROMO'")
    src = _upd(src, "coalesce(large = 'ECONOMY' AND middle = 'Brand#5', false)", large="'PROMO'")
    src = _upd(src, "coalesce(large = 'STANDARD' AND middle = 'Brand#6', false)", large="'SMALL'", middle="coalesce(nullif(small, ''), nullif(detail, ''), middle)")
    s1 = f"SELECT diner_idx, large, {_simple_sql('x.large', 'x.middle')} AS middle, small, detail FROM ({src}) x"
    prom = "'PROMO'"
    s2 = f"SELECT *, {_simple_sql(prom, 'y.small')} AS a, {_simple_sql(prom, 'y.detail')} AS b FROM ({s1}) y"
    s3 = "SELECT diner_idx, large, CASE WHEN large = 'PROMO' AND middle = 'PROMO' THEN CASE WHEN a <> small THEN a WHEN b <> detail THEN b ELSE middle END ELSE middle END AS middle, small, detail FROM (" + s2 + ")"
    s4 = _upd(s3, "coalesce(large = 'LARGE' AND middle = 'two', false)", large="'SMALL'")
    s5 = _upd(s4, "coalesce(large = 'MEDIUM', false)", large="'LARGE'")
    return f"WITH {RULES_SQL} " + _upd(s5, "coalesce(middle IN ('low', 'mid'), false)", large="'ECONOMY'")


@query("c8_simplify_process", _process_sql())
def c8(t):
    # Half of the rows of one category come unresolved: its own name is their middle.
    named = (F.col("large") == "PROMO") & (F.col("diner_idx") % 2 == 0)
    df = _cats(t).withColumn("middle", F.when(F.coalesce(named, F.lit(False)), "PROMO").otherwise(F.col("middle")))
    return K.simplify_process(df, _rules(t), PLAN).select(*COLS)


def _knn_sql(wanted):
    hold = f"{HASH_SQL.format(repr('knn|') + ' || diner_idx')} % 10 < 2"
    return f"""known AS (SELECT * FROM diner WHERE middle IS NOT NULL),
 sc AS (SELECT large, small, dense_rank() OVER (PARTITION BY large ORDER BY small) - 1 AS c FROM (SELECT DISTINCT large, small FROM known)),
 dc AS (SELECT large, detail, dense_rank() OVER (PARTITION BY large ORDER BY detail) - 1 AS c FROM (SELECT DISTINCT large, detail FROM known)),
 enc AS (SELECT d.diner_idx, d.large, d.middle, coalesce(sc.c, -1) AS s, coalesce(dc.c, -1) AS e, {hold.replace('diner_idx', 'd.diner_idx')} AS held FROM diner d
   LEFT JOIN sc ON sc.large = d.large AND sc.small = d.small LEFT JOIN dc ON dc.large = d.large AND dc.detail = d.detail),
 pts AS (SELECT large, s, e, middle, count(*) AS cnt FROM enc WHERE middle IS NOT NULL AND NOT held GROUP BY 1, 2, 3, 4),
 ask AS (SELECT DISTINCT large, s, e FROM enc WHERE {wanted}),
 near AS (SELECT a.large, a.s AS s0, a.e AS e0, p.middle, p.s, p.e, cnt, CAST((p.s - a.s) * (p.s - a.s) + (p.e - a.e) * (p.e - a.e) AS DOUBLE) AS d2 FROM ask a JOIN pts p ON p.large = a.large),
 run AS (SELECT *, coalesce(sum(cnt) OVER (PARTITION BY large, s0, e0 ORDER BY d2, s, e, middle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM near),
 votes AS (SELECT large, s0, e0, middle, sum(CASE WHEN d2 = 0 THEN least(cnt, 5 - bef) ELSE 0 END) AS same, round(sum(CASE WHEN d2 > 0 THEN least(cnt, 5 - bef) / sqrt(d2) ELSE 0 END), 9) AS other
   FROM run WHERE bef < 5 GROUP BY 1, 2, 3, 4),
 best AS (SELECT large, s0, e0, CASE WHEN max(same) > 0 THEN arg_min(middle, (-same, middle)) ELSE arg_min(middle, (-other, middle)) END AS predicted FROM votes GROUP BY 1, 2, 3),
 pred AS (SELECT enc.diner_idx, enc.large, enc.middle, predicted FROM enc LEFT JOIN best ON best.large = enc.large AND s0 = s AND e0 = e WHERE {wanted})"""


@query("c9_knn_impute", f"WITH {_knn_sql('middle IS NULL')} SELECT diner_idx, large, predicted FROM pred")
def c9(t):
    return K.knn_impute(_cats(t), "diner_idx")


KNN_TEXT_SQL = f"""{_knn_sql('middle IS NULL')}, wd AS (SELECT large, diner_idx, middle IS NOT NULL AS known, unnest([x for x in string_split_regex(lower(name), '[^a-z0-9]+') if length(x) >= 2]) AS word FROM diner),
 tf AS (SELECT large, diner_idx, known, word, count(*) AS tf FROM wd GROUP BY 1, 2, 3, 4),
 vo AS (SELECT large, word, ln((1.0::DOUBLE + (SELECT count(*) FROM known z WHERE z.large = t.large)) / (1 + count(*))) + 1 AS idf FROM tf t WHERE known GROUP BY 1, 2),
 wt AS (SELECT diner_idx, word, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY diner_idx)) AS w FROM tf JOIN vo USING (large, word)),
 tr AS (SELECT * FROM enc WHERE middle IS NOT NULL AND NOT held), aq AS (SELECT * FROM enc WHERE middle IS NULL),
 dots AS (SELECT a.diner_idx AS u, t.diner_idx AS i, sum(x.w * y.w) AS dot FROM aq a JOIN tr t ON t.large = a.large JOIN wt x ON x.diner_idx = a.diner_idx JOIN wt y ON y.diner_idx = t.diner_idx AND y.word = x.word GROUP BY 1, 2),
 n2 AS (SELECT diner_idx, sum(w * w) AS n FROM wt GROUP BY 1),
 ds AS (SELECT a.diner_idx AS u, t.diner_idx AS i, t.middle, round((t.s - a.s) * (t.s - a.s) + (t.e - a.e) * (t.e - a.e) + p.n + q.n - 2 * coalesce(dot, 0), 6) AS d2
   FROM aq a JOIN tr t ON t.large = a.large JOIN n2 p ON p.diner_idx = a.diner_idx JOIN n2 q ON q.diner_idx = t.diner_idx LEFT JOIN dots ON dots.u = a.diner_idx AND dots.i = t.diner_idx),
 nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY d2, i) AS rn FROM ds) WHERE rn <= 5),
 vt AS (SELECT u, middle, count(*) FILTER (d2 <= 0) AS same, round(sum(CASE WHEN d2 > 0 THEN 1 / sqrt(d2) ELSE 0 END), 6) AS other FROM nn GROUP BY 1, 2)
SELECT aq.diner_idx, aq.large, predicted FROM aq LEFT JOIN (SELECT u, CASE WHEN max(same) > 0 THEN arg_min(middle, (-same, middle)) ELSE arg_min(middle, (-other, middle)) END AS predicted FROM vt GROUP BY 1) b ON b.u = aq.diner_idx"""


@query("c9_knn_impute_with_text", f"WITH {KNN_TEXT_SQL}")
def c9b(t):
    return K.knn_impute_with_text(t.diner.select(*COLS, "name"), "diner_idx", {"name": 100})


@query("c10_imputer_quality", f"""
WITH {_knn_sql('middle IS NOT NULL AND held')}, lab AS (SELECT large, middle AS label FROM pred UNION SELECT large, predicted FROM pred),
 per AS (SELECT l.large, l.label, count(*) FILTER (p.middle = l.label AND p.predicted = l.label) AS tp, count(*) FILTER (p.middle = l.label) AS sup, count(*) FILTER (p.predicted = l.label) AS cl
   FROM lab l JOIN pred p ON p.large = l.large GROUP BY 1, 2),
 q AS (SELECT *, CASE WHEN cl > 0 THEN tp / cl::DOUBLE ELSE 0 END AS p, CASE WHEN sup > 0 THEN tp / sup::DOUBLE ELSE 0 END AS r FROM per),
 z AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM q)
SELECT large, round(CAST(sum(tp) AS DOUBLE) / sum(sup), 6) AS accuracy, round(avg(p), 6) AS precision_macro, round(avg(r), 6) AS recall_macro, round(avg(f), 6) AS f1_macro,
 round(sum(p * sup) / sum(sup), 6) AS precision_weighted, round(sum(r * sup) / sum(sup), 6) AS recall_weighted, round(sum(f * sup) / sum(sup), 6) AS f1_weighted FROM z GROUP BY 1""")
def c10(t):
    cats = _cats(t)
    held = F.col("middle").isNotNull() & K.holdout(F.col("diner_idx"))
    pred = K.knn_impute(cats, "diner_idx", predict=held)
    scored = pred.join(cats.select("diner_idx", F.col("middle").alias("actual")), "diner_idx")
    out = K.imputer_quality(scored)
    return out.select("large", *[F.round(c, 6).alias(c) for c in out.columns if c != "large"])


@query("c11_category_path_counts", " UNION ALL ".join(
    f"SELECT {', '.join((K.LEVELS[i] if i < d else 'NULL') + ' AS ' + K.LEVELS[i] for i in range(4))}, count(DISTINCT diner_idx) AS diner_count, {d} AS depth FROM diner WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in K.LEVELS[:d]) + " GROUP BY " + ", ".join(K.LEVELS[:d]) for d in range(1, 5)))
def c11(t):
    return K.path_counts(_cats(t), "diner_idx")


@query("c12_change_patterns", f"""
WITH m AS (SELECT b.middle AS before, a.middle AS after, count(*) AS n FROM ({BASE}) b JOIN ({integrate_sql(lower_sql(BASE, 'middle', LOWER_MIDDLE))}) a USING (diner_idx)
  WHERE b.middle IS NOT NULL AND a.middle IS NOT NULL GROUP BY 1, 2)
SELECT before, after, n, CASE WHEN count(*) OVER (PARTITION BY before) > 1 THEN 'split' WHEN before = after THEN 'kept' ELSE 'renamed' END AS pattern,
 CAST(count(*) OVER (PARTITION BY after) > 1 AS INTEGER) AS merged FROM m""")
def c12(t):
    after = K.integrate_middles(K.lower_level(_cats(t), "middle", LOWER_MIDDLE), INTEGRATE)
    return K.change_patterns(_cats(t), after, "diner_idx")


@query("c13_children", "SELECT middle, string_agg(small, ',' ORDER BY small) AS children FROM (SELECT DISTINCT middle, small FROM diner WHERE middle IS NOT NULL) GROUP BY 1")
def c13(t):
    return K.children(t.diner, "middle", "small").withColumn("children", F.array_join("children", ","))


@query("c14_coalesced_category", "SELECT diner_idx, coalesce(CASE WHEN diner_idx % 4 = 0 THEN NULL ELSE small END, middle) AS category FROM diner")
def c14(t):
    small = F.when(F.col("diner_idx") % 4 != 0, F.col("small"))
    return t.diner.select("diner_idx", F.coalesce(small, F.col("middle")).alias("category"))
