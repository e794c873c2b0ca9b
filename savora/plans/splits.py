"""D: splits, targets, warm and cold users."""

from __future__ import annotations

from pyspark.sql import functions as F

from savora.operators import splits as S
from savora.plans.registry import query
from savora.sources.tables import SPLIT_DATES

HASH_SQL = "CAST(('0x' || substr(md5({0}), 1, 8)) AS BIGINT)"


@query("d1_time_point_split", """
SELECT review_id, 'train' AS part FROM train UNION ALL SELECT review_id, 'val' FROM val UNION ALL SELECT review_id, 'test' FROM test""")
def d1(t):
    S.check_split_arguments("time_point", SPLIT_DATES)
    return S.time_point_split(t.review, *SPLIT_DATES).select("review_id", "part")


TIMELINE_SQL = """SELECT *, CASE WHEN rn <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'val' END AS part FROM (
 SELECT *, row_number() OVER (PARTITION BY reviewer_id ORDER BY review_date, review_id) AS rn, count(*) OVER (PARTITION BY reviewer_id) AS n FROM {0})"""


@query("d2_timeline_split", f"""
WITH outer_split AS ({TIMELINE_SQL.format('review')}),
 rest AS (SELECT reviewer_id, review_id, review_date FROM outer_split WHERE part = 'train'),
 inner_split AS ({TIMELINE_SQL.format('rest')})
SELECT review_id, 'test' AS part FROM outer_split WHERE part = 'val' UNION ALL SELECT review_id, part FROM inner_split""")
def d2(t):
    return S.timeline_split(t.review, 0.2).select("review_id", "part")


@query("d3_stratified_split", f"""
SELECT review_id, CASE WHEN rn <= cut THEN 'train' ELSE 'val' END AS part FROM (
 SELECT *, floor(n * CAST(0.8 AS DOUBLE) + 0.5) AS cut FROM (
  SELECT review_id, row_number() OVER (PARTITION BY reviewer_id ORDER BY {HASH_SQL.format("'42|' || review_id")}, review_id) AS rn,
         count(*) OVER (PARTITION BY reviewer_id) AS n FROM review)) WHERE cut >= 1 AND cut < n""")
def d3(t):
    return S.stratified_split(t.review, 0.2, "42").select("review_id", "part")


AS_OF_SQL = """SELECT *, coalesce(avg(score) OVER (PARTITION BY reviewer_id ORDER BY review_date, review_id
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), score) AS review_avg FROM {0}"""


@query("d5_as_of_mean", f"SELECT review_id, round(review_avg, 6) AS review_avg FROM ({AS_OF_SQL.format('review')})")
def d5(t):
    return S.as_of_mean(t.review).select("review_id", F.round("review_avg", 6).alias("review_avg"))


@query("d6_as_of_target", f"""
SELECT review_id, CAST(score >= review_avg AS INTEGER) AS target, round(review_avg, 6) AS review_avg FROM ({AS_OF_SQL.format('train')})""")
def d6(t):
    return S.as_of_target(t.train).select("review_id", "target", F.round("review_avg", 6).alias("review_avg"))


@query("d7_target_comparison", f"""
WITH a AS (SELECT review_id, CAST(score >= avg(score) OVER (PARTITION BY diner_idx) AS INTEGER) AS target FROM review),
 b AS (SELECT review_id, CAST(score >= review_avg AS INTEGER) AS target FROM ({AS_OF_SQL.format('review')}))
SELECT count(*) AS n, count(*) FILTER (a.target <> b.target) AS changed, count(*) FILTER (a.target = 0 AND b.target = 1) AS zero_to_one,
 count(*) FILTER (a.target = 1 AND b.target = 0) AS one_to_zero FROM a JOIN b USING (review_id)""")
def d7(t):
    return S.compare_targets(S.item_mean_target(t.review), S.as_of_target(t.review))


@query("d8_warm_cold_users", """
SELECT DISTINCT reviewer_id, CASE WHEN reviewer_id IN (SELECT reviewer_id FROM train) THEN 'warm' ELSE 'cold' END AS user_type FROM val""")
def d8(t):
    return S.warm_cold_users(t.train, t.val)


@query("d9_warm_cold_reviews", """
SELECT 'val' AS part, review_id, CASE WHEN reviewer_id IN (SELECT reviewer_id FROM train) THEN 'warm' ELSE 'cold' END AS user_type FROM val
UNION ALL SELECT 'test', review_id, CASE WHEN reviewer_id IN (SELECT reviewer_id FROM train) THEN 'warm' ELSE 'cold' END FROM test""")
def d9(t):
    out = None
    for part, later in (("val", t.val), ("test", t.test)):
        for kind, pick in (("warm", S.warm_reviews), ("cold", S.cold_reviews)):
            one = pick(t.train, later).select(F.lit(part).alias("part"), "review_id", F.lit(kind).alias("user_type"))
            out = one if out is None else out.unionByName(one)
    return out


_STAT = """SELECT '{0}' AS part, count(DISTINCT reviewer_id) AS users, count(DISTINCT diner_idx) AS items, count(*) AS feedbacks,
 round(100.0::DOUBLE * count(*) / (count(DISTINCT reviewer_id) * count(DISTINCT diner_idx)), 6) AS density_pct,
 count(DISTINCT reviewer_id) FILTER (reviewer_id IN (SELECT reviewer_id FROM train)) AS warm_users,
 count(DISTINCT reviewer_id) FILTER (reviewer_id NOT IN (SELECT reviewer_id FROM train)) AS cold_users FROM {0}"""


@query("d10_split_statistics", f"""
SELECT *, round(100.0::DOUBLE * warm_users / (warm_users + cold_users), 6) AS warm_pct FROM (
{' UNION ALL '.join(_STAT.format(p) for p in ('train', 'val', 'test'))})""")
def d10(t):
    return S.split_stats(S.time_point_split(t.review, *SPLIT_DATES))


@query("d11_edge_split", f"""
SELECT reviewer_id, diner_idx, CASE WHEN h < 8 THEN 'train' WHEN h = 8 THEN 'val' ELSE 'test' END AS part FROM (
 SELECT DISTINCT reviewer_id, diner_idx, {HASH_SQL.format("'links|' || reviewer_id || '|' || diner_idx")} % 10 AS h FROM review)""")
def d11(t):
    return S.edge_split(t.review.select("reviewer_id", "diner_idx").distinct(), "links", "reviewer_id", "diner_idx")
