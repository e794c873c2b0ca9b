"""N: notebook statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from savora.functions.ordering import quantiles
from savora.operators import analytics as A
from savora.operators import statistics as N
from savora.plans.features import LARGE
from savora.plans.registry import query

NAMES = {v: v.lower() for v in LARGE}


def _cat_rows(t):
    return t.review.join(t.diner.select("diner_idx", "large", "address"), "diner_idx")


RD = "rd AS (SELECT r.*, d.large, d.address, split_part(d.address, ' ', 2) AS district FROM review r JOIN diner d ON d.diner_idx = r.diner_idx)"


@query("n1_burst_reviews", """
WITH s AS (SELECT reviewer_id FROM review GROUP BY 1 HAVING count(*) >= 3 AND date_diff('day', CAST(min(review_date) AS DATE), CAST(max(review_date) AS DATE)) <= 2250),
 h AS (SELECT * FROM review WHERE score >= 4 AND reviewer_id IN (SELECT reviewer_id FROM s)),
 i AS (SELECT diner_idx, CAST(sum(c) AS BIGINT) AS hits, max(c) AS max_same_day FROM (SELECT diner_idx, CAST(review_date AS DATE) AS d, count(*) AS c FROM h GROUP BY 1, 2) GROUP BY 1 HAVING sum(c) >= 5)
SELECT review_id, h.diner_idx, hits, max_same_day FROM h JOIN i ON i.diner_idx = h.diner_idx""")
def n1(t):
    return N.burst_reviews(t.review, 3, 2250, 4, 5).select("review_id", "diner_idx", "hits", "max_same_day")


PIV_SQL = f"WITH {RD} SELECT isodow(review_date) - 1 AS weekday, " + ", ".join(f"count(*) FILTER (large = '{v}') AS {v.lower()}" for v in LARGE) + " FROM rd GROUP BY 1"


def _pivot(t):
    return N.pivot_counts(_cat_rows(t), F.weekday("review_date").cast("long"), "weekday", "large", LARGE, NAMES)


@query("n2_weekday_category_counts", PIV_SQL)
def n2(t):
    return _pivot(t)


@query("n3_scaled_pivot", f"WITH p AS ({PIV_SQL}) SELECT weekday, " + ", ".join(
    f"round(CAST({c} - min({c}) OVER () AS DOUBLE) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 6) AS {c}" for c in NAMES.values()) + " FROM p")
def n3(t):
    cols = list(NAMES.values())
    out = N.min_max_columns(_pivot(t), cols)
    return out.select("weekday", *[F.round(c, 6).alias(c) for c in cols])


@query("n4_weekday_score_stats", f"""
WITH {RD}, s AS (SELECT isodow(review_date) - 1 AS weekday, CAST(quarter(review_date) AS BIGINT) AS quarter, large, avg(score) AS mean, stddev_samp(score) AS std, median(score) AS median, CAST(count(*) AS DOUBLE) AS n FROM rd GROUP BY 1, 2, 3)
{' UNION ALL '.join(f"SELECT weekday, quarter, large, '{c}' AS measure, round({c}, 6) AS value FROM s" for c in ('mean', 'std', 'median', 'n'))}""")
def n4(t):
    rows = _cat_rows(t).select(F.weekday("review_date").cast("long").alias("weekday"), F.quarter("review_date").cast("long").alias("quarter"), "large", "score")
    stats = N.score_stats(rows, ["weekday", "quarter", "large"], "score")
    return N.unpivot_stats(stats, ["weekday", "quarter", "large"], ["mean", "std", "median", "n"]).withColumn("value", F.round("value", 6))


@query("n5_district_stats", f"WITH {RD} SELECT district, large, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, median(score) AS median, count(*) AS n FROM rd GROUP BY 1, 2")
def n5(t):
    rows = _cat_rows(t).withColumn("district", A.address_parts("address")[1])
    return N.score_stats(rows, ["district", "large"], "score").select("district", "large", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "median", "n")


WX = f"{RD}, wx AS (SELECT rd.*, w.temp, w.rain FROM rd JOIN weather w ON w.day = CAST(rd.review_date AS DATE))"


def _wx(t):
    return N.join_weather(_cat_rows(t), t.weather)


@query("n6_reviews_with_weather", f"WITH {WX} SELECT review_id, temp, rain FROM wx")
def n6(t):
    return _wx(t).select("review_id", "temp", "rain")


@query("n7_rain_level_shares", f"""
WITH {WX}, c AS (SELECT CASE WHEN rain = 0 THEN 0 WHEN rain <= 5 THEN 1 WHEN rain <= 20 THEN 2 WHEN rain <= 50 THEN 3 ELSE 4 END AS level, large, count(*) AS n FROM wx GROUP BY 1, 2)
SELECT CAST(level AS INTEGER) AS level, large, n, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY level), 6) AS pct FROM c""")
def n7(t):
    return A.shares(_wx(t).withColumn("level", N.rain_level("rain")), ["level"], ["large"])


@query("n8_temperature_moving_mean", f"""
WITH {WX}, s AS (SELECT large, temp, avg(score) AS mean, count(*) AS n FROM wx GROUP BY 1, 2)
SELECT large, temp, round(mean, 6) AS mean, n, round(CASE WHEN count(*) OVER w = 5 THEN avg(mean) OVER w END, 6) AS smooth FROM s WINDOW w AS (PARTITION BY large ORDER BY temp ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def n8(t):
    stats = _wx(t).groupBy("large", "temp").agg(F.avg("score").alias("mean"), F.count("*").alias("n"))
    return N.moving_mean(stats, ["large"], "temp", "mean").select("large", "temp", F.round("mean", 6).alias("mean"), "n", F.round("smooth", 6).alias("smooth"))


MONTHLY = f"{RD}, mo AS (SELECT large, CAST(date_trunc('month', review_date) AS DATE) AS month, count(*) AS n, avg(score) AS mean FROM rd GROUP BY 1, 2)"


def _monthly(t):
    return _cat_rows(t).groupBy("large", F.trunc("review_date", "month").alias("month")).agg(F.count("*").alias("n"), F.avg("score").alias("mean"))


@query("n9_monthly_counts", f"WITH {MONTHLY} SELECT large, month, n, round(mean, 6) AS mean FROM mo")
def n9(t):
    return _monthly(t).withColumn("mean", F.round("mean", 6))


def decompose_sql(src, value, name):
    return f"""{name}_i AS (SELECT *, row_number() OVER (PARTITION BY large ORDER BY month) - 1 AS i, count(*) OVER (PARTITION BY large) AS cnt FROM {src}),
 {name}_t AS (SELECT *, CASE WHEN i >= 6 AND i < cnt - 6 THEN (sum({value}) OVER (PARTITION BY large ORDER BY month ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)
   - 0.5::DOUBLE * (lag({value}, 6) OVER (PARTITION BY large ORDER BY month) + lead({value}, 6) OVER (PARTITION BY large ORDER BY month))) / 12 END AS trend FROM {name}_i WHERE cnt >= 24),
 {name}_p AS (SELECT large, i % 12 AS p, avg({value} - trend) AS m FROM {name}_t GROUP BY 1, 2),
 {name} AS (SELECT t.large, t.month, t.{value}, trend, q.m - (SELECT avg(m) FROM {name}_p z WHERE z.large = t.large) AS seasonal FROM {name}_t t JOIN {name}_p q ON q.large = t.large AND q.p = t.i % 12)"""


@query("n10_seasonal_decomposition", f"""
WITH {MONTHLY}, {decompose_sql('mo', 'n', 'dec')} SELECT large, month, n, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(n - trend - seasonal, 6) AS residual FROM dec""")
def n10(t):
    out = N.decompose(_monthly(t), ["large"], "month", "n")
    return out.select("large", "month", "n", *[F.round(c, 6).alias(c) for c in ("trend", "seasonal", "residual")])


@query("n11_linear_interpolation", f"""
WITH {MONTHLY}, g AS (SELECT large, month, CASE WHEN month(month) IN (3, 4, 9) OR month < DATE '1995-03-01' THEN NULL ELSE mean END AS v FROM mo),
 i AS (SELECT *, row_number() OVER (PARTITION BY large ORDER BY month) AS i FROM g),
 k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY large ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ia,
  first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY large ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ib FROM i)
SELECT k.large, k.month, round(CASE WHEN k.v IS NOT NULL THEN k.v WHEN ia IS NULL THEN NULL WHEN ib IS NULL THEN a.v ELSE a.v + (b.v - a.v) * (k.i - ia) / (ib - ia) END, 6) AS filled
FROM k LEFT JOIN i a ON a.large = k.large AND a.i = ia LEFT JOIN i b ON b.large = k.large AND b.i = ib""")
def n11(t):
    gap = F.month("month").isin(3, 4, 9) | (F.col("month") < F.lit("1995-03-01").cast("date"))
    rows = _monthly(t).withColumn("v", F.when(~gap, F.col("mean")))
    return N.interpolate(rows, ["large"], "month", "v").select("large", "month", F.round("filled", 6).alias("filled"))


WEATHER_MONTH = "wm AS (SELECT 'w' AS large, CAST(date_trunc('month', day) AS DATE) AS month, avg(temp) AS temp, avg(rain) AS rain FROM weather GROUP BY 2)"


@query("n12_seasonal_spearman", f"""
WITH {MONTHLY}, {WEATHER_MONTH}, {decompose_sql('mo', 'mean', 'ds')}, {decompose_sql('wm', 'temp', 'dt')}, {decompose_sql('wm', 'rain', 'dr')},
 j AS (SELECT 'temp' AS variable, ds.large, round(ds.seasonal, 9) AS x, round(dt.seasonal, 9) AS y FROM ds JOIN dt ON ds.month = dt.month UNION ALL SELECT 'rain', ds.large, round(ds.seasonal, 9), round(dr.seasonal, 9) FROM ds JOIN dr ON ds.month = dr.month),
 r AS (SELECT variable, large, rank() OVER (PARTITION BY variable, large ORDER BY x) + (count(*) OVER (PARTITION BY variable, large, x) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY variable, large ORDER BY y) + (count(*) OVER (PARTITION BY variable, large, y) - 1) / 2.0::DOUBLE AS ry FROM j)
SELECT variable, large, round(corr(rx, ry), 4) AS correlation FROM r GROUP BY 1, 2""")
def n12(t):
    score = N.decompose(_monthly(t).select("large", "month", "mean"), ["large"], "month", "mean").select("large", "month", F.round("seasonal", 9).alias("x"))
    wm = t.weather.groupBy(F.trunc("day", "month").alias("month")).agg(F.avg("temp").alias("temp"), F.avg("rain").alias("rain"))
    long = wm.unpivot(["month"], ["temp", "rain"], "variable", "value")
    season = N.decompose(long, ["variable"], "month", "value").select("variable", "month", F.round("seasonal", 9).alias("y"))
    return N.spearman(score.join(season, "month"), ["variable", "large"], "x", "y")


@query("n13_comfort_scores", """
SELECT day, round(exp(-pow(temp - 20, 2) / (2 * 10.0::DOUBLE * 10.0)), 6) AS temp_score, round(1 / (1 + rain), 6) AS rain_score FROM weather""")
def n13(t):
    return t.weather.select("day", F.round(N.comfort("temp", 20.0, 10.0), 6).alias("temp_score"), F.round(N.inverse_score("rain"), 6).alias("rain_score"))


@query("n14_length_quartiles", """
SELECT lang, count(*) AS n, round(quantile_cont(length(text), 0.25), 6) AS q1, round(quantile_cont(length(text), 0.5), 6) AS median, round(quantile_cont(length(text), 0.75), 6) AS q3 FROM documents GROUP BY 1""")
def n14(t):
    d = t.raw("documents").select("lang", F.length("text").alias("len"))
    return quantiles(d, ["lang"], "len", {"q1": 0.25, "median": 0.5, "q3": 0.75}).select("lang", "n", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")])


@query("n15_score_ratio", "SELECT score, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM review GROUP BY 1")
def n15(t):
    return A.shares(t.review, [], ["score"])


@query("n16_reviewed_items", """
SELECT split_part(address, ' ', 2) AS district, count(*) AS items, count(*) FILTER (diner_idx IN (SELECT diner_idx FROM review)) AS reviewed FROM diner GROUP BY 1""")
def n16(t):
    return N.reviewed_share(t.diner.withColumn("district", A.address_parts("address")[1]), t.review, "district")


@query("n17_pearson", f"""
WITH {WX} SELECT 'score' AS a, 'temp' AS b, round(corr(score, temp), 6) AS correlation FROM wx UNION ALL SELECT 'score', 'rain', round(corr(score, rain), 6) FROM wx UNION ALL SELECT 'temp', 'rain', round(corr(temp, rain), 6) FROM wx""")
def n17(t):
    return N.correlations(_wx(t), ["score", "temp", "rain"])


@query("n18_monthly_review_counts", "SELECT CAST(date_trunc('month', review_date) AS DATE) AS month, count(*) AS n FROM review WHERE review_date >= TIMESTAMP '1999-01-01' GROUP BY 1")
def n18(t):
    recent = t.review.where(F.col("review_date") >= F.lit("1999-01-01").cast("timestamp_ntz"))
    return N.monthly(recent, [], "review_date", F.count("*"), "n")


_SHARE = """SELECT '{0}' AS side, reviews, ids, round(100.0::DOUBLE * ids / (SELECT count(DISTINCT {1}) FROM review), 6) AS pct FROM (
 SELECT reviews, count(*) AS ids FROM (SELECT {1}, count(*) AS reviews FROM review GROUP BY 1) GROUP BY 1 ORDER BY ids DESC, reviews LIMIT 20)"""


@query("n18_exact_count_shares", f"{_SHARE.format('user', 'reviewer_id')} UNION ALL {_SHARE.format('item', 'diner_idx')}")
def n18b(t):
    a = N.exact_count_shares(t.review, "reviewer_id").select(F.lit("user").alias("side"), "reviews", "ids", "pct")
    b = N.exact_count_shares(t.review, "diner_idx").select(F.lit("item").alias("side"), "reviews", "ids", "pct")
    return a.unionByName(b)
