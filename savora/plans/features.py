"""E: feature engineering."""

from __future__ import annotations

from pyspark.sql import functions as F

from savora.functions import geo
from savora.operators import cleaning as C
from savora.operators import features as E
from savora.operators import places as P
from savora.plans.registry import query
from savora.sources.tables import AS_OF

LARGE = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
BUCKET_SQL = "CASE WHEN {0} <= 0 THEN 0 WHEN {0} <= 10 THEN 1 WHEN {0} <= 50 THEN 2 WHEN {0} <= 200 THEN 3 ELSE 4 END"


@query("e0_feature_store", """
SELECT d.diner_idx, coalesce(n, 0) AS all_review_cnt, round(coalesce(m, 0), 6) AS mean_review_score
FROM diner d LEFT JOIN (SELECT diner_idx, count(*) AS n, avg(score) AS m FROM train GROUP BY 1) s ON d.diner_idx = s.diner_idx""")
def e0(t):
    store = E.FeatureStore("diner_idx")
    store.register("review_count", lambda out="all_review_cnt": E.review_counts(t.train, t.diner, "diner_idx", out))
    store.register("mean_score", lambda: E.item_mean_score(t.train, t.diner, "diner_idx", "score"))
    return store.build(t.diner, {"review_count": {"out": "all_review_cnt"}, "mean_score": {}}).withColumn(
        "mean_review_score", F.round("mean_review_score", 6)
    )


@query("e1_item_review_count", """
SELECT d.diner_idx, coalesce(n, 0) AS all_review_cnt FROM diner d LEFT JOIN (SELECT diner_idx, count(*) AS n FROM train GROUP BY 1) s ON d.diner_idx = s.diner_idx""")
def e1(t):
    return E.review_counts(t.train, t.diner, "diner_idx", "all_review_cnt")


@query("e2_count_bucket", f"""
SELECT d.diner_idx, CAST({BUCKET_SQL.format('coalesce(n, 0)')} AS INTEGER) AS bucket
FROM diner d LEFT JOIN (SELECT diner_idx, count(*) AS n FROM review GROUP BY 1) s ON d.diner_idx = s.diner_idx""")
def e2(t):
    return E.review_counts(t.review, t.diner, "diner_idx", "n").select("diner_idx", E.count_bucket("n").alias("bucket"))


def _tag_sql(tag):
    return f"coalesce(TRY_CAST(list_extract(regexp_extract_all(tag_txt, '\\({tag}, ([0-9]+)\\)', 1), -1) AS INTEGER), 0)"


@query("e3_tag_scores", f"SELECT diner_idx, {_tag_sql('taste')} AS taste, {_tag_sql('mood')} AS mood, {_tag_sql('parking')} AS parking FROM diner_raw")
def e3(t):
    tags = C.parse_string_list("tag_txt")
    cols = E.tag_scores(tags, {"taste": "taste", "mood": "mood", "parking": "parking"})
    return t.diner_raw.select("diner_idx", *[c.alias(n) for n, c in cols.items()])


@query("e4_price_statistics", """
WITH p AS (SELECT diner_idx, price_txt <> 'broken' AS readable, [CAST(x AS DOUBLE) for x in regexp_extract_all(price_txt, '''([0-9]+)''', 1)] AS pr FROM diner_raw),
 s AS (SELECT diner_idx, list_min(pr) AS a, list_max(pr) AS b, list_avg(pr) AS c, list_median(pr) AS d, CASE WHEN readable THEN CAST(len(pr) AS DOUBLE) END AS e FROM p)
SELECT diner_idx, round(coalesce(a, (SELECT median(a) FROM s)), 6) AS min_price, round(coalesce(b, (SELECT median(b) FROM s)), 6) AS max_price,
 round(coalesce(c, (SELECT median(c) FROM s)), 6) AS mean_price, round(coalesce(d, (SELECT median(d) FROM s)), 6) AS median_price,
 coalesce(e, (SELECT median(e) FROM s)) AS menu_count FROM s""")
def e4(t):
    out = E.price_stats(t.diner_raw, "diner_idx", C.parse_string_list("price_txt"), "market")
    return out.select("diner_idx", *[F.round(c, 6).alias(c) for c in E.PRICE_COLUMNS])


@query("e5_item_mean_score", """
SELECT d.diner_idx, round(coalesce(m, 0), 6) AS mean_review_score FROM diner d LEFT JOIN (SELECT diner_idx, avg(score) AS m FROM train GROUP BY 1) s ON d.diner_idx = s.diner_idx""")
def e5(t):
    return E.item_mean_score(t.train, t.diner, "diner_idx", "score").withColumn("mean_review_score", F.round("mean_review_score", 6))


@query("e6_one_hot", "SELECT diner_idx, " + ", ".join(f"CAST(large = '{v}' AS INTEGER) AS large_{v}" for v in LARGE[1:]) + " FROM diner")
def e6(t):
    values = E.small_domain(t.diner, "large")
    return E.one_hot(t.diner.select("diner_idx", "large"), "large", values, drop_first=True).drop("large")


def hex_sql(lat, lon, res, src):
    """Cell (q, r) per row of `src`, written out step by step."""
    s, mx = geo.side(res), geo.metres_per_lon()
    return f"""
 SELECT * EXCLUDE (fq, fr, fz, rq, rr, rz),
  CAST(CASE WHEN abs(rq - fq) > abs(rr - fr) AND abs(rq - fq) > abs(rz - fz) THEN -rr - rz ELSE rq END AS BIGINT) AS q,
  CAST(CASE WHEN abs(rq - fq) > abs(rr - fr) AND abs(rq - fq) > abs(rz - fz) THEN rr WHEN abs(rr - fr) > abs(rz - fz) THEN -rq - rz ELSE rr END AS BIGINT) AS r
 FROM (SELECT *, floor(fq + 0.5) AS rq, floor(fr + 0.5) AS rr, floor(fz + 0.5) AS rz FROM (
  SELECT *, -fq - fr AS fz FROM (
   SELECT *, (CAST({geo.math.sqrt(3.0) / 3.0!r} AS DOUBLE) * ({lon} * CAST({mx!r} AS DOUBLE)) - {lat} * CAST({geo.METRES_PER_DEGREE_LAT!r} AS DOUBLE) / 3.0) / CAST({s!r} AS DOUBLE) AS fq,
    (2.0 * ({lat} * CAST({geo.METRES_PER_DEGREE_LAT!r} AS DOUBLE)) / 3.0) / CAST({s!r} AS DOUBLE) AS fr FROM {src})))"""


@query("e7_category_cell_metadata", f"""
WITH c AS ({hex_sql('lat', 'lon', 9, 'diner')})
SELECT diner_idx, middle || '_9_' || q || '_' || r AS metadata_id,
 (SELECT string_agg(middle || '_9_' || (q + dq) || '_' || (r + dr), ',' ORDER BY dq, dr) FROM (SELECT a.x AS dq, b.y AS dr FROM (SELECT unnest([-1, 0, 1]) AS x) a, (SELECT unnest([-1, 0, 1]) AS y) b)
  WHERE greatest(abs(dq), abs(dr), abs(dq + dr)) = 1) AS neighbors
FROM c""")
def e7(t):
    return P.category_cell_metadata(t.diner, "middle", "lat", "lon", 9).select(
        "diner_idx", "metadata_id", F.when(F.col("metadata_id").isNotNull(), F.array_join("metadata_id_neighbors", ",")).alias("neighbors")
    )


MENU_RULES = dict(stopwords=["1p", "set", "extra", "price", "old"], units=r"\d+(?:g|kg|ml)\s*", keep=r"[^a-z\s]", min_length=1)
RAW_MENU_SQL = """CASE diner_idx % 8 WHEN 0 THEN name || '(2p) 1p' WHEN 1 THEN name || ' set' WHEN 2 THEN 'set ' || name WHEN 3 THEN name || ' 300g '
 WHEN 4 THEN 'set' WHEN 5 THEN name || 'extra' WHEN 6 THEN 'big set ' || name ELSE 'price' || name || '!' END"""


def _raw_menu():
    n, k = F.col("name"), F.col("diner_idx") % 8
    return (
        F.when(k == 0, F.concat(n, F.lit("(2p) 1p"))).when(k == 1, F.concat(n, F.lit(" set"))).when(k == 2, F.concat(F.lit("set "), n))
        .when(k == 3, F.concat(n, F.lit(" 300g "))).when(k == 4, F.lit("set")).when(k == 5, F.concat(n, F.lit("extra")))
        .when(k == 6, F.concat(F.lit("big set "), n)).otherwise(F.concat(F.lit("price"), n, F.lit("!")))
    )


def clean_menu_sql(src, col):
    sql = f"SELECT *, regexp_replace(regexp_replace({col}, '\\([^)]*\\)', '', 'g'), '\\d+(?:g|kg|ml)\\s*', '', 'g') AS m FROM {src}"
    for w in MENU_RULES["stopwords"]:
        sql = f"""SELECT * EXCLUDE (m), CASE WHEN m = '{w}' THEN NULL
 WHEN starts_with(m, '{w} ') OR ends_with(m, ' {w}') THEN trim(replace(m, '{w}', ''))
 WHEN contains(m, ' {w} ') THEN trim(replace(m, ' {w} ', ' '))
 WHEN starts_with(m, '{w}') THEN trim(substr(m, {len(w) + 1}))
 WHEN ends_with(m, '{w}') THEN trim(substr(m, 1, length(m) - {len(w)})) ELSE m END AS m FROM ({sql})"""
    return f"SELECT * EXCLUDE (m), nullif(trim(regexp_replace(regexp_replace(m, '[^a-z\\s]', '', 'g'), '\\s+', ' ', 'g')), '') AS clean FROM ({sql})"


@query("e8_clean_menu_name", f"SELECT diner_idx, clean FROM ({clean_menu_sql(f'(SELECT diner_idx, {RAW_MENU_SQL} AS raw FROM diner)', 'raw')})")
def e8(t):
    return t.diner.select("diner_idx", E.clean_menu(_raw_menu(), **MENU_RULES).alias("clean"))


LIST_SQL = clean_menu_sql("(SELECT diner_idx, generate_subscripts(l, 1) AS p, unnest(l) AS raw FROM (SELECT diner_idx, regexp_extract_all(menu_txt, '''([^'']*)''', 1) AS l FROM diner_raw))", "raw")


@query("e9_clean_menu_list", f"""
SELECT d.diner_idx, coalesce(string_agg(clean, '|' ORDER BY p), '') AS menus FROM diner_raw d LEFT JOIN ({LIST_SQL}) c ON c.diner_idx = d.diner_idx GROUP BY 1""")
def e9(t):
    menus = E.clean_menu_list(C.parse_string_list("menu_txt"), **MENU_RULES)
    return t.diner_raw.select("diner_idx", F.array_join(menus, "|").alias("menus"))


FREQ_SQL = "SELECT large, menu, count(*) AS n FROM (SELECT large, unnest(menus) AS menu FROM diner) WHERE menu <> '' GROUP BY 1, 2"


@query("e10_menu_frequency", FREQ_SQL)
def e10(t):
    return E.menu_frequency(t.diner, "large", "menus")


@query("e11_frequent_menus", f"""
SELECT large, menu, n FROM (SELECT *, row_number() OVER (PARTITION BY large ORDER BY n DESC, menu) AS rn FROM ({FREQ_SQL}) WHERE n >= 5) WHERE rn <= 6""")
def e11(t):
    return E.frequent_menus(E.menu_frequency(t.diner, "large", "menus"), "large", 5, 6)


@query("e12_valid_menus", f"""
WITH f AS (SELECT large, menu FROM (SELECT *, row_number() OVER (PARTITION BY large ORDER BY n DESC, menu) AS rn FROM ({FREQ_SQL}) WHERE n >= 5) WHERE rn <= 6),
 e AS (SELECT diner_idx, large, generate_subscripts(menus, 1) AS p, unnest(menus) AS menu FROM diner)
SELECT d.diner_idx, coalesce(string_agg(e.menu, '|' ORDER BY p) FILTER (f.menu IS NOT NULL), '') AS valid
FROM diner d LEFT JOIN e ON d.diner_idx = e.diner_idx LEFT JOIN f ON e.large = f.large AND e.menu = f.menu GROUP BY 1""")
def e12(t):
    d = t.diner.select("diner_idx", "large", "menus")
    freq = E.frequent_menus(E.menu_frequency(d, "large", "menus"), "large", 5, 6)
    return E.valid_menus(d, "diner_idx", "large", "menus", freq).select("diner_idx", F.array_join("valid_menus", "|").alias("valid"))


HOT = {"PROMO": ["ring", "gear"], "LARGE": ["bolt"]}


@query("e13_multi_hot_menus", "SELECT diner_idx, " + ", ".join(
    f"CAST(large = '{c}' AND list_contains(menus, '{m}') AS INTEGER) AS menu_{c}_{m}" for c, ms in HOT.items() for m in ms) + " FROM diner")
def e13(t):
    return E.multi_hot(t.diner.select("diner_idx", "large", "menus"), "large", "menus", HOT).drop("large", "menus")


@query("e14_bayesian_average", """
WITH s AS (SELECT diner_idx, count(*) AS n, avg(score) AS m FROM train GROUP BY 1)
SELECT d.diner_idx, round(coalesce((m * n + (SELECT avg(m) FROM s) * 5) / (n + 5), 0), 6) AS bayesian_score FROM diner d LEFT JOIN s ON d.diner_idx = s.diner_idx""")
def e14(t):
    return E.bayesian_average(t.train, t.diner, "diner_idx", "score").withColumn("bayesian_score", F.round("bayesian_score", 6))


@query("e15_user_category_counts", "SELECT reviewer_id, " + ", ".join(
    f"count(*) FILTER (large = '{v}') AS cat_{v.lower()}" for v in LARGE) + " FROM review JOIN diner USING (diner_idx) GROUP BY 1")
def e15(t):
    rows = t.review.select("reviewer_id", "diner_idx").join(t.diner.select("diner_idx", "large"), "diner_idx")
    return E.category_counts(rows, "reviewer_id", "large", LARGE, {v: f"cat_{v.lower()}" for v in LARGE})


@query("e16_user_mean_score", "SELECT reviewer_id, round(avg(score), 6) AS user_mean_score FROM review GROUP BY 1")
def e16(t):
    return E.user_mean_score(t.review, "reviewer_id", "score").withColumn("user_mean_score", F.round("user_mean_score", 6))


@query("e17_activity_pattern", "SELECT reviewer_id, " + ", ".join(
    f"count(*) FILTER (isodow(review_date) - 1 = {i}) AS day_{i}" for i in range(7))
    + f", CAST(date_diff('day', CAST(max(review_date) AS DATE), DATE '{AS_OF}') AS INTEGER) AS days_since_last_review FROM review GROUP BY 1")
def e17(t):
    return E.activity_pattern(t.review, "reviewer_id", "review_date", AS_OF)


WEIGHT_SQL = f"""SELECT r.review_id, r.reviewer_id, r.diner_idx, u.badge_level,
 greatest(1 - greatest(0, date_diff('day', CAST(review_date AS DATE), DATE '{AS_OF}') - 90) / 1095.0::DOUBLE, 0.01) AS date_weight,
 r.score - u.reviewer_avg AS score_diff FROM review r JOIN reviewer u ON r.reviewer_id = u.reviewer_id"""


def _weighted(t):
    rows = t.review.join(t.reviewer.select("reviewer_id", "badge_level", "reviewer_avg"), "reviewer_id")
    return E.review_weights(rows, "score", "reviewer_avg", "review_date", AS_OF)


@query("e18_review_weights", f"SELECT review_id, round(date_weight, 6) AS date_weight, round(score_diff, 6) AS score_diff FROM ({WEIGHT_SQL})")
def e18(t):
    return _weighted(t).select("review_id", F.round("date_weight", 6).alias("date_weight"), F.round("score_diff", 6).alias("score_diff"))


SCALED_SQL = f"""SELECT *, 0.3::DOUBLE * badge_scaled + 0.2::DOUBLE * date_scaled + 0.5::DOUBLE * score_scaled AS combined_score FROM (
 SELECT *, (CAST(badge_level AS DOUBLE) - min(badge_level) OVER ()) / (max(badge_level) OVER () - min(badge_level) OVER ()) * 0.9 + 0.1 AS badge_scaled,
  (date_weight - min(date_weight) OVER ()) / (max(date_weight) OVER () - min(date_weight) OVER ()) * 0.9 + 0.1 AS date_scaled,
  (score_diff - min(score_diff) OVER ()) / (max(score_diff) OVER () - min(score_diff) OVER ()) * 1.5 - 0.5 AS score_scaled FROM ({WEIGHT_SQL}))"""


@query("e19_min_max_scale", f"SELECT review_id, round(badge_scaled, 6) AS badge_scaled, round(date_scaled, 6) AS date_scaled, round(score_scaled, 6) AS score_scaled FROM ({SCALED_SQL})")
def e19(t):
    return E.combined_score(_weighted(t)).select("review_id", *[F.round(c, 6).alias(c) for c in ("badge_scaled", "date_scaled", "score_scaled")])


@query("e20_user_combined_score", f"""
SELECT reviewer_id, round(avg(date_scaled), 6) AS date_scaled, round(avg(score_scaled), 6) AS score_scaled, round(avg(combined_score), 6) AS combined_score
FROM ({SCALED_SQL}) GROUP BY 1""")
def e20(t):
    out = E.user_scaled_scores(E.combined_score(_weighted(t)), "reviewer_id")
    return out.select("reviewer_id", *[F.round(c, 6).alias(c) for c in ("date_scaled", "score_scaled", "combined_score")])


@query("e21_merge_features", """
SELECT v.review_id, coalesce(u.m, 0) AS user_mean_score, coalesce(i.n, 0) AS all_review_cnt FROM val v
LEFT JOIN (SELECT reviewer_id, round(avg(score), 6) AS m FROM train GROUP BY 1) u ON v.reviewer_id = u.reviewer_id
LEFT JOIN (SELECT diner_idx, count(*) AS n FROM train GROUP BY 1) i ON v.diner_idx = i.diner_idx""")
def e21(t):
    users = E.user_mean_score(t.train, "reviewer_id", "score").withColumn("user_mean_score", F.round("user_mean_score", 6))
    items = t.train.groupBy("diner_idx").agg(F.count("*").alias("all_review_cnt"))
    return E.merge_features(t.val, users, items, "reviewer_id", "diner_idx").select("review_id", "user_mean_score", "all_review_cnt")


@query("e22_first_attributes", """
SELECT c_custkey AS reviewer_id, coalesce(score, 0) AS score, coalesce(diner_idx, 0) AS diner_idx FROM customer LEFT JOIN (
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY reviewer_id ORDER BY review_date, review_id) AS rn FROM review) WHERE rn = 1) r ON c_custkey = reviewer_id""")
def e22(t):
    spine = t.raw("customer").select(F.col("c_custkey").alias("reviewer_id"))
    return E.first_attributes(t.review, spine, "reviewer_id", ["score", "diner_idx"], ["review_date", "review_id"])


HALVES = {"first_half": ("2024-01-01", "2024-07-01"), "second_half": ("2024-07-01", "2025-01-01")}


@query("e23_review_profile", """
WITH p AS (SELECT reviewer_id, count(*) AS n_reviews, count(text) AS n_texts, avg(length(text)) AS mean_length,
  count(*) FILTER (review_date < TIMESTAMP '2024-07-01') AS first_half, count(*) FILTER (review_date >= TIMESTAMP '2024-07-01') AS second_half FROM docreview GROUP BY 1)
SELECT reviewer_id, n_reviews, n_texts, round(mean_length, 6) AS mean_length, first_half, second_half FROM p
WHERE first_half > 0 AND second_half > 0 AND mean_length >= (SELECT avg(mean_length) FROM p)""")
def e23(t):
    profile = E.review_profile(t.docreview, "reviewer_id", "text", "review_date", HALVES)
    return E.steady_writers(profile, list(HALVES)).withColumn("mean_length", F.round("mean_length", 6))
