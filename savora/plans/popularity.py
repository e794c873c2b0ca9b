"""F: popularity and ranked lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from savora.functions import geo
from savora.operators import evaluation as V
from savora.operators import popularity as P
from savora.operators import splits as S
from savora.plans.metric_sql import LIKED_SQL, TYPES_SQL, per_user_sql, roll_up_sql
from savora.plans.registry import query

KS = [3, 7, 10, 20]
POP_SQL = """SELECT diner_idx AS item, n, pos FROM (SELECT diner_idx, n, row_number() OVER (ORDER BY n DESC, diner_idx) AS pos
 FROM (SELECT diner_idx, count(*) AS n FROM train GROUP BY 1)) WHERE pos <= 2000"""


def liked(t):
    return t.hold("val").val.select(F.col("reviewer_id").alias("user"), F.col("diner_idx").alias("item"))


def user_types(t):
    t.hold("train", "val")
    return S.warm_cold_users(t.train, t.val).withColumnRenamed("reviewer_id", "user")


@query("f1_most_popular", f"SELECT item AS diner_idx, n, CAST(pos AS INTEGER) AS pos FROM ({POP_SQL})")
def f1(t):
    return P.most_popular(t.train, 2000)


@query("f2_popular_recommender", f"""
WITH pop AS ({POP_SQL}), liked AS ({LIKED_SQL}), types AS ({TYPES_SQL}),
 hits AS (SELECT DISTINCT l.user_id, l.item, p.pos FROM liked l JOIN pop p ON l.item = p.item WHERE p.pos <= 20),
 pu AS ({per_user_sql('hits', 'liked', KS)})
{roll_up_sql('pu', 'types')}""")
def f2(t):
    t.hold("train", "val")
    top = P.most_popular(t.train, 2000).withColumnRenamed("diner_idx", "item")
    hits = V.list_hits(top, liked(t))
    return V.roll_up(V.per_user(hits, V.liked_counts(liked(t)), KS), user_types(t))


_STATS = """SELECT d.diner_idx, s.n_reviews, round(s.rating, 6) AS rating{extra} FROM diner d JOIN (
 SELECT diner_idx, count(*) AS n_reviews, avg(score) AS rating FROM review {where} GROUP BY 1 HAVING count(*) >= {least}) s
 ON d.diner_idx = s.diner_idx WHERE {places}"""


@query("f3_ranked_by_reviews", f"""
SELECT *, CAST(row_number() OVER (ORDER BY n_reviews DESC, diner_idx) AS INTEGER) AS pos FROM (
{_STATS.format(extra='', where="WHERE review_date > (SELECT max(review_date) - INTERVAL 6 MONTH FROM review)", least=2, places="large = 'PROMO'")}) QUALIFY pos <= 50""")
def f3a(t):
    out = P.ranked_list(t.review, t.diner, 50, "review_count", period_months=6, large="PROMO", min_reviews=2)
    return out.select("diner_idx", "n_reviews", F.round("rating", 6).alias("rating"), "pos")


@query("f3_ranked_by_rating", f"""
SELECT *, CAST(row_number() OVER (ORDER BY rating DESC, n_reviews DESC, diner_idx) AS INTEGER) AS pos FROM (
{_STATS.format(extra='', where="", least=10, places="middle = 'Brand#7'")}) QUALIFY pos <= 30""")
def f3b(t):
    out = P.ranked_list(t.review, t.diner, 30, "rating", middle="Brand#7", min_reviews=10)
    return out.select("diner_idx", "n_reviews", F.round("rating", 6).alias("rating"), "pos")


HAVERSINE_SQL = ("2 * 6371 * asin(least(1, sqrt(pow(sin(radians({la2} - {la1}) / 2), 2) + cos(radians({la1})) * cos(radians({la2}))"
                 " * pow(sin(radians({lo2} - {lo1}) / 2), 2))))")


@query("f3_ranked_by_distance", f"""
SELECT *, CAST(row_number() OVER (ORDER BY distance, diner_idx) AS INTEGER) AS pos FROM (
{_STATS.format(extra=', round(' + HAVERSINE_SQL.format(la1='37.5', lo1='127.0', la2='lat', lo2='lon') + ', 6) AS distance', where="", least=1, places="1 = 1")}) QUALIFY pos <= 100""")
def f3c(t):
    far = F.round(geo.haversine_km(37.5, 127.0, "lat", "lon"), 6)
    out = P.ranked_list(t.review, t.diner, 100, "distance", distance=far)
    return out.select("diner_idx", "n_reviews", F.round("rating", 6).alias("rating"), "distance", "pos")


@query("f4_top_per_group", """
SELECT large, middle, diner_idx, n FROM (SELECT *, row_number() OVER (PARTITION BY large, middle ORDER BY n DESC, diner_idx) AS rn
 FROM (SELECT large, middle, diner_idx, count(*) AS n FROM review JOIN diner USING (diner_idx) GROUP BY 1, 2, 3)) WHERE rn <= 3""")
def f4(t):
    counts = t.review.groupBy("diner_idx").agg(F.count("*").alias("n")).join(t.diner.select("diner_idx", "large", "middle"), "diner_idx")
    return P.top_per_group(counts, ["large", "middle"], [F.desc("n"), F.asc("diner_idx")], 3)


@query("f5_cumulative_share", """
SELECT diner_idx, n, row_number() OVER (ORDER BY n DESC, diner_idx) AS rn,
 round(CAST(sum(n) OVER (ORDER BY n DESC, diner_idx ROWS UNBOUNDED PRECEDING) AS DOUBLE) / sum(n) OVER (), 6) AS share
FROM (SELECT diner_idx, count(*) AS n FROM review GROUP BY 1)""")
def f5(t):
    return P.cumulative_share(t.review).withColumn("share", F.round("share", 6))


@query("f6_rating_volume_score", """
SELECT diner_idx, round(0.7 * avg(score) + 0.3 * ln(1 + count(*)), 6) AS rank_score FROM review GROUP BY 1""")
def f6(t):
    stats = t.review.groupBy("diner_idx").agg(F.avg("score").alias("rating"), F.count("*").alias("n"))
    return P.rating_volume_score(stats, "rating", "n", 0.7).select("diner_idx", F.round("rank_score", 6).alias("rank_score"))
