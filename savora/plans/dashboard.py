"""M: dashboard analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from savora.operators import analytics as A
from savora.operators import cleaning as C
from savora.operators import features as E
from savora.plans.registry import query


@query("m1_count_status", """
SELECT count(*) FILTER (n IS NULL) AS null_count, count(*) FILTER (n IS NULL OR n <= 0) AS zero_count, count(*) FILTER (n > 0) AS valid_count
FROM (SELECT TRY_CAST(review_count_txt AS DOUBLE) AS n FROM diner_raw)""")
def m1(t):
    return A.count_status(t.diner_raw, "review_count_txt")


@query("m1_top_category_quartiles", """
WITH d AS (SELECT middle, TRY_CAST(review_count_txt AS DOUBLE) AS v FROM diner JOIN diner_raw USING (diner_idx) WHERE middle IS NOT NULL),
 top AS (SELECT middle, count(*) AS rows FROM d GROUP BY 1 ORDER BY rows DESC, middle LIMIT 10)
SELECT middle, any_value(rows) AS rows, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3 FROM d JOIN top USING (middle) GROUP BY 1""")
def m1b(t):
    rows = t.diner.select("diner_idx", "middle").join(t.diner_raw.select("diner_idx", "review_count_txt"), "diner_idx")
    out = A.top_category_quartiles(rows, "middle", F.col("review_count_txt").try_cast("double"))
    return out.select("middle", "rows", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")])


@query("m2_activity_histogram", """
SELECT reviews, count(*) AS users FROM (SELECT reviewer_id, count(*) AS reviews FROM review GROUP BY 1) WHERE reviews <= 10 GROUP BY 1""")
def m2(t):
    return A.activity_histogram(t.review, "reviewer_id", 10)


BIN_SQL = "CASE " + " ".join(f"WHEN reviews >= {lo} THEN '{name}'" for lo, name in reversed(A.ACTIVITY_BINS)) + " END"


@query("m3_activity_bins", f"SELECT {BIN_SQL} AS bin, count(*) AS users FROM (SELECT reviewer_id, count(*) AS reviews FROM review GROUP BY 1) GROUP BY 1")
def m3(t):
    return A.activity_bins(t.review, "reviewer_id")


@query("m4_at_least_shares", """
WITH h AS (SELECT reviews, count(*) AS users FROM (SELECT reviewer_id, count(*) AS reviews FROM review GROUP BY 1) GROUP BY 1)
SELECT reviews, CAST(sum(users) OVER (ORDER BY reviews DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS users,
 round(100.0::DOUBLE * sum(users) OVER (ORDER BY reviews DESC ROWS UNBOUNDED PRECEDING) / (SELECT sum(users) FROM h), 6) AS pct FROM h""")
def m4(t):
    return A.at_least_shares(t.review, "reviewer_id")


@query("m5_rating_distribution", "SELECT score, large, count(*) AS n FROM review JOIN diner USING (diner_idx) GROUP BY 1, 2")
def m5(t):
    return A.value_counts(t.review.join(t.diner.select("diner_idx", "large"), "diner_idx"), "score", "large")


@query("m6_category_tree", "SELECT large, middle, small, count(*) AS n FROM diner WHERE large IS NOT NULL AND middle IS NOT NULL AND small IS NOT NULL GROUP BY 1, 2, 3")
def m6(t):
    return A.value_counts(t.diner, "large", "middle", "small", drop_null=True)


METRIC_SQL = """dm AS (SELECT d.*, s.n AS n_reviews, s.m AS rating, round((m * n + (SELECT avg(m) FROM (SELECT avg(score) AS m FROM review GROUP BY diner_idx)) * 5) / (n + 5), 9) AS bayesian_score
 FROM diner d LEFT JOIN (SELECT diner_idx, count(*) AS n, avg(score) AS m FROM review GROUP BY 1) s ON s.diner_idx = d.diner_idx)"""


def _metrics(t):
    stats = t.review.groupBy("diner_idx").agg(F.count("*").alias("n_reviews"), F.avg("score").alias("rating"))
    bay = E.bayesian_average(t.review, t.diner, "diner_idx", "score").withColumn("bayesian_score", F.round("bayesian_score", 9))
    return t.diner.join(stats, "diner_idx", "left").join(bay, "diner_idx", "left")


AGG_SQL = "count(*) AS diners, round(avg(rating), 6) AS mean_rating, round(avg(coalesce(bayesian_score, 0)), 6) AS mean_bayesian, round(avg(n_reviews), 6) AS mean_reviews"


@query("m7_category_metrics", f"WITH {METRIC_SQL} SELECT large, middle, {AGG_SQL} FROM dm GROUP BY 1, 2")
def m7(t):
    return A.category_metrics(_metrics(t), ["large", "middle"])


@query("m8_missing_shares", " UNION ALL ".join(
    f"SELECT '{c}' AS level, count(*) FILTER ({c} IS NULL) AS missing, round(100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*), 6) AS pct FROM diner" for c in ("large", "middle", "small", "detail")))
def m8(t):
    return A.missing_shares(t.diner, ["large", "middle", "small", "detail"])


KW_SQL = """kw AS (SELECT k.keyword_id, r.review_id, r.reviewer_id, r.diner_idx, r.review_date, k.term, k.category, k.sentiment, d.large, split_part(d.address, ' ', 1) AS region, split_part(d.address, ' ', 2) AS district
 FROM docreview r JOIN keyword k ON r.review_id = k.review_id LEFT JOIN diner d ON d.diner_idx = r.diner_idx WHERE k.category IS NOT NULL)"""


def _kw(t):
    region, district = A.address_parts("address")
    diner = t.diner.select("diner_idx", "large", region.alias("region"), district.alias("district"))
    review = t.docreview.select("review_id", "reviewer_id", "diner_idx", "review_date")
    return A.keyword_rows(review, t.keyword.select("keyword_id", "review_id", "term", "category", "sentiment"), diner)


@query("m9_keyword_rows", f"WITH {KW_SQL} SELECT keyword_id, review_id, diner_idx, term, sentiment, large FROM kw")
def m9(t):
    return _kw(t).select("keyword_id", "review_id", "diner_idx", "term", "sentiment", "large")


@query("m10_address_parts", """
SELECT diner_idx, coalesce(nullif(split_part(a, ' ', 1), ''), 'etc') AS region, coalesce(nullif(split_part(a, ' ', 2), ''), 'etc') AS district
FROM (SELECT diner_idx, CASE WHEN diner_idx % 6 = 0 THEN NULL WHEN diner_idx % 6 = 1 THEN split_part(address, ' ', 1) ELSE address END AS a FROM diner)""")
def m10(t):
    a = F.when(F.col("diner_idx") % 6 == 0, F.lit(None).cast("string")).when(
        F.col("diner_idx") % 6 == 1, F.split_part("address", F.lit(" "), F.lit(1))).otherwise(F.col("address"))
    region, district = A.address_parts("address")
    return t.diner.withColumn("address", a).select("diner_idx", region.alias("region"), district.alias("district"))


@query("m11_keywords_by_region", f"""
WITH {KW_SQL}, c AS (SELECT region, category, CASE WHEN sentiment > 0.5 THEN 'positive' ELSE 'negative' END AS polarity, count(*) AS n FROM kw GROUP BY 1, 2, 3)
SELECT region, category, polarity, n, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY region), 6) AS pct FROM c""")
def m11(t):
    return A.shares(_kw(t).withColumn("polarity", A.polarity("sentiment")), ["region"], ["category", "polarity"])


@query("m12_category_sentiment", f"""
WITH {KW_SQL} SELECT coalesce(large, 'etc') AS large, category, CASE WHEN sentiment > 0.5 THEN 'positive' ELSE 'negative' END AS polarity, count(*) AS n FROM kw GROUP BY 1, 2, 3""")
def m12(t):
    rows = _kw(t).withColumn("large", F.coalesce("large", F.lit("etc"))).withColumn("polarity", A.polarity("sentiment"))
    return A.value_counts(rows, "large", "category", "polarity")


@query("m13_keyword_summary", f"""
WITH {KW_SQL} SELECT count(*) AS keywords, round(100.0::DOUBLE * count(*) FILTER (sentiment > 0.5) / count(*), 6) AS positive_pct, count(DISTINCT diner_idx) AS diners, count(DISTINCT large) AS categories FROM kw""")
def m13(t):
    return A.keyword_summary(_kw(t))


@query("m14_region_drill_down", f"WITH {KW_SQL} SELECT DISTINCT region, district, category FROM kw WHERE region = 'ASIA'")
def m14(t):
    return A.options(A.drill_down(_kw(t), {"region": "ASIA"}), "region", "district", "category")


@query("m15_term_frequency", "SELECT category, term, CASE WHEN sentiment >= 0.4 THEN 'positive' ELSE 'negative' END AS side, count(*) AS n FROM keyword WHERE category IS NOT NULL GROUP BY 1, 2, 3")
def m15(t):
    return A.term_frequency(t.keyword)


@query("m16_monthly_mean", """
WITH g AS (SELECT diner_idx, CAST(date_trunc('month', review_date) AS DATE) AS month, avg(score) AS mean FROM review GROUP BY 1, 2),
 s AS (SELECT diner_idx, CAST(unnest(generate_series(min(month)::TIMESTAMP, max(month)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS month FROM g GROUP BY 1)
SELECT s.diner_idx, s.month, round(g.mean, 6) AS mean FROM s LEFT JOIN g ON g.diner_idx = s.diner_idx AND g.month = s.month""")
def m16(t):
    return A.monthly_mean(t.review, "diner_idx", "score", "review_date").withColumn("mean", F.round("mean", 6))


@query("m17_monthly_sentiment", f"""
WITH {KW_SQL}, p AS (SELECT reviewer_id, review_id, CAST(date_trunc('month', review_date) AS DATE) AS month, avg(sentiment) AS s FROM kw GROUP BY 1, 2, 3)
SELECT reviewer_id, month, round(avg(s), 6) AS sentiment, count(*) AS n_reviews FROM p GROUP BY 1, 2""")
def m17(t):
    return A.monthly_sentiment(_kw(t), "reviewer_id", "review_date").withColumn("sentiment", F.round("sentiment", 6))


@query("m18_satisfaction", """
SELECT middle, count(*) AS visits, count(*) FILTER (score > reviewer_avg) AS satisfied, floor(CAST(count(*) FILTER (score > reviewer_avg) AS DOUBLE) / count(*) * 1000 + 0.5) / 10 AS pct
FROM review r JOIN reviewer u ON u.reviewer_id = r.reviewer_id JOIN diner d ON d.diner_idx = r.diner_idx WHERE middle IS NOT NULL GROUP BY 1 ORDER BY visits DESC, middle LIMIT 10""")
def m18(t):
    rows = t.review.join(t.reviewer.select("reviewer_id", "reviewer_avg"), "reviewer_id").join(t.diner.select("diner_idx", "middle"), "diner_idx")
    return A.satisfaction(rows.withColumn("score_diff", F.col("score") - F.col("reviewer_avg")), "middle")


@query("m19_menu_price_mean", """
SELECT round(coalesce(avg(CAST(p AS DOUBLE)), 0), 6) AS mean_price, count(*) AS n FROM (SELECT unnest(regexp_extract_all(price_txt, '''([^'']*)''', 1)) AS p FROM diner_raw) WHERE regexp_matches(p, '^[0-9]+\\.?[0-9]*$')""")
def m19(t):
    return A.menu_price_mean(t.diner_raw, C.parse_string_list("price_txt")).withColumn("mean_price", F.round("mean_price", 6))


@query("m19_menu_frequency", "SELECT menu, count(*) AS n FROM (SELECT unnest(regexp_extract_all(menu_txt, '''([^'']*)''', 1)) AS menu FROM diner_raw) GROUP BY 1")
def m19b(t):
    return A.value_counts(t.diner_raw.select(F.explode(C.parse_string_list("menu_txt")).alias("menu")), "menu")


@query("m20_average_scores", f"""
WITH {METRIC_SQL} SELECT round(avg(rating), 2) AS diner_avg, round(avg(coalesce(bayesian_score, 0)), 2) AS bayesian_avg, (SELECT round(avg(reviewer_avg), 1) FROM reviewer) AS reviewer_avg FROM dm""")
def m20(t):
    who = t.reviewer.agg(F.round(F.avg("reviewer_avg"), 1)).scalar()
    return _metrics(t).agg(F.round(F.avg("rating"), 2).alias("diner_avg"), F.round(F.avg("bayesian_score"), 2).alias("bayesian_avg")).withColumn("reviewer_avg", who)


@query("m21_daily_visits", "SELECT reviewer_id, CAST(review_date AS DATE) AS day, count(*) AS n FROM review GROUP BY 1, 2")
def m21(t):
    return A.value_counts(t.review.select("reviewer_id", F.to_date("review_date").alias("day")), "reviewer_id", "day")


@query("m22_name_search", "SELECT diner_idx, name FROM diner WHERE contains(name, 'gizmo')")
def m22(t):
    return t.diner.where(F.col("name").contains("gizmo")).select("diner_idx", "name")


@query("m23_paired_menus", """
WITH l AS (SELECT diner_idx, regexp_extract_all(menu_txt, '''([^'']*)''', 1) AS a, regexp_extract_all(price_txt, '''([0-9]+)''', 1) AS b FROM diner_raw WHERE menu_txt IS NOT NULL)
SELECT diner_idx, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS place, unnest(a) AS menu, CAST(unnest(b) AS BIGINT) AS price FROM l WHERE len(a) = len(b)""")
def m23(t):
    raw = t.diner_raw.where("menu_txt is not null")
    return A.paired_menus(raw, "diner_idx", C.parse_string_list("menu_txt"), C.parse_int_list("price_txt"))


@query("m24_overview", "SELECT (SELECT count(DISTINCT diner_idx) FROM diner) AS diners, count(*) AS reviews, count(DISTINCT reviewer_id) AS reviewers, (SELECT count(DISTINCT large) FROM diner) AS categories FROM review")
def m24(t):
    d = t.diner.agg(F.struct(F.count_distinct("diner_idx").alias("a"), F.count_distinct("large").alias("b"))).scalar()
    return t.review.agg(F.count("*").alias("reviews"), F.count_distinct("reviewer_id").alias("reviewers")).select(
        d["a"].alias("diners"), "reviews", "reviewers", d["b"].alias("categories")
    )


@query("m25_drill_down_metrics", f"WITH {METRIC_SQL} SELECT large, middle, small, {AGG_SQL} FROM dm WHERE large = 'PROMO' AND middle = 'Brand#7' GROUP BY 1, 2, 3")
def m25(t):
    return A.category_metrics(A.drill_down(_metrics(t), {"large": "PROMO", "middle": "Brand#7"}), ["large", "middle", "small"])


@query("m25_drill_down_reviews", "SELECT review_id, diner_idx, score FROM review WHERE diner_idx IN (SELECT diner_idx FROM diner WHERE large = 'PROMO' AND middle = 'Brand#7')")
def m25b(t):
    picked = A.drill_down(t.diner, {"large": "PROMO", "middle": "Brand#7"}).select("diner_idx")
    return t.review.join(picked, "diner_idx", "left_semi").select("review_id", "diner_idx", "score")


