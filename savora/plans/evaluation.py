"""K: ranking evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from savora.functions import geo
from savora.functions.hashing import hash_int
from savora.operators import evaluation as V
from savora.operators import ids as I
from savora.operators import neighbors as N
from savora.operators import popularity as P
from savora.operators import splits as S
from savora.plans.metric_sql import LIKED_SQL, TYPES_SQL, per_user_sql, roll_up_sql
from savora.plans.neighbors import SIMS
from savora.plans.popularity import HAVERSINE_SQL, KS, POP_SQL, liked, user_types
from savora.plans.registry import query
from savora.plans.splits import HASH_SQL

POP_HITS = f"""pop AS ({POP_SQL}), liked AS ({LIKED_SQL}), types AS ({TYPES_SQL}),
 hits AS (SELECT DISTINCT l.user_id, l.item, p.pos FROM liked l JOIN pop p ON l.item = p.item WHERE p.pos <= {{0}})"""


def _top(t):
    return P.most_popular(t.hold("train", "val").train, 2000).withColumnRenamed("diner_idx", "item")


def _metrics(t, ks):
    return V.per_user(V.list_hits(_top(t), liked(t)), V.liked_counts(liked(t)), ks)


def _one(metric):
    sql = f"WITH {POP_HITS.format(2000)}, pu AS ({per_user_sql('hits', 'liked', [10, 100, 500])}) SELECT user_id, CAST(k AS INTEGER) AS k, round({metric}, 6) AS {metric} FROM pu"

    def run(t):
        return _metrics(t, [10, 100, 500]).select(F.col("user").alias("user_id"), "k", F.round(metric, 6).alias(metric))

    return sql, run


for _name, _metric in (("k1_recall", "recall"), ("k2_average_precision", "map"), ("k3_ndcg", "ndcg")):
    _sql, _run = _one(_metric)
    query(_name, _sql)(_run)


@query("k4_liked_lists", """
SELECT reviewer_id AS user_id, diner_idx AS item, review_id, row_number() OVER (PARTITION BY reviewer_id ORDER BY diner_idx, review_id) AS place,
 count(*) OVER (PARTITION BY reviewer_id) AS m FROM val""")
def k4(t):
    rows = t.val.select(F.col("reviewer_id").alias("user"), F.col("diner_idx").alias("item"), "review_id")
    return V.liked_places(rows, ["item", "review_id"]).select(F.col("user").alias("user_id"), "item", "review_id", "place", "m")


CF_RECS = f"""{SIMS}, votes AS (SELECT u, s.item, round(sum(r * sim) / greatest(sum(abs(sim)), 1e-12), 6) AS pred
  FROM inter JOIN sims s ON s.target = inter.i AND sim > 0 GROUP BY 1, 2),
 cf AS (SELECT u AS user_id, item, pos FROM (SELECT u, v.item, row_number() OVER (PARTITION BY u ORDER BY pred DESC, v.item) AS pos
   FROM votes v ANTI JOIN inter ON inter.u = v.u AND inter.i = v.item) WHERE pos <= 20)"""


def _cf_recs(t):
    inter = N.interactions(t.hold("train", "val").train)
    sims = N.both_directions(N.item_pairs(inter))
    warm = S.warm_cold_users(t.train, t.val).where("user_type = 'warm'").select(F.col("reviewer_id").alias("user"))
    return N.recommend_for_users(inter, sims, 20, pad=False, users=warm).select("user", "item", "pos")


@query("k5_warm_cold_rollup", f"""
WITH {CF_RECS}, pop AS ({POP_SQL}), liked AS ({LIKED_SQL}), types AS ({TYPES_SQL}),
 recs AS (SELECT user_id, item, pos FROM cf WHERE user_id IN (SELECT user_id FROM types WHERE user_type = 'warm')
          UNION ALL SELECT user_id, item, pos FROM types, pop WHERE user_type = 'cold' AND pos <= 20),
 hits AS (SELECT user_id, item, pos FROM recs SEMI JOIN liked ON liked.user_id = recs.user_id AND liked.item = recs.item),
 pu AS ({per_user_sql('hits', 'liked', KS)})
{roll_up_sql('pu', 'types')}""")
def k5(t):
    """Item CF for warm users, the popular list for cold ones."""
    types = user_types(t)
    cold_liked = liked(t).join(types.where("user_type = 'cold'"), "user", "left_semi")
    hits = V.find_hits(_cf_recs(t), liked(t)).unionByName(V.list_hits(_top(t).where("pos <= 20"), cold_liked))
    return V.roll_up(V.per_user(hits, V.liked_counts(liked(t)), KS), types)


@query("k6_cold_popular_lists", f"""
WITH pop AS ({POP_SQL}), types AS ({TYPES_SQL}) SELECT user_id, item, CAST(pos AS INTEGER) AS pos FROM types, pop WHERE user_type = 'cold' AND pos <= 20""")
def k6(t):
    cold = user_types(t).where("user_type = 'cold'").select("user")
    return V.spread_list(_top(t), cold, 20).select(F.col("user").alias("user_id"), "item", "pos")


@query("k7_rank_precision", f"""
WITH pop AS ({POP_SQL}), liked AS ({LIKED_SQL})
SELECT l.user_id, l.item, round(CASE WHEN pos <= 50 THEN (50 - (pos - 1)) / 50.0::DOUBLE ELSE 0 END, 6) AS rank_precision FROM (SELECT DISTINCT * FROM liked) l LEFT JOIN pop p ON l.item = p.item""")
def k7(t):
    return liked(t).distinct().join(_top(t).select("item", "pos"), "item", "left").select(
        F.col("user").alias("user_id"), "item", F.round(V.rank_precision(F.col("pos"), 50), 6).alias("rank_precision")
    )


@query("k8_drop_seen_and_pad", f"""
WITH pop AS ({POP_SQL}), u AS (SELECT DISTINCT reviewer_id AS user_id FROM val),
 r AS (SELECT u.user_id, pop.item, row_number() OVER (PARTITION BY u.user_id ORDER BY pos) AS pos FROM u, pop
       ANTI JOIN train ON train.reviewer_id = u.user_id AND train.diner_idx = pop.item WHERE pop.pos <= 30)
SELECT u.user_id, CAST(g.p AS INTEGER) AS pos, coalesce(r.item, -1) AS item FROM u CROSS JOIN (SELECT unnest(range(1, 31)) AS p) g
LEFT JOIN r ON r.user_id = u.user_id AND r.pos = g.p""")
def k8(t):
    users = t.val.select(F.col("reviewer_id").alias("user")).distinct()
    seen = t.train.select(F.col("reviewer_id").alias("user"), F.col("diner_idx").alias("item"))
    recs = V.drop_seen(V.spread_list(_top(t), users, 30), seen)
    return V.pad_lists(recs, users, 30).select(F.col("user").alias("user_id"), "pos", "item")


@query("k9_metric_history", f"""
WITH {POP_HITS.format(500)}, pu AS ({per_user_sql('hits', 'liked', [10, 20, 100, 500])}), ru AS ({roll_up_sql('pu', 'types')}),
 h AS (SELECT e.epoch, ru.* FROM ru, (SELECT unnest([0, 1]) AS epoch) e)
SELECT CAST(epoch AS INTEGER) AS epoch, user_type, CAST(k AS INTEGER) AS k, 'map' AS metric, map AS value FROM h WHERE k <= 20
UNION ALL SELECT epoch, user_type, k, 'ndcg', ndcg FROM h WHERE k <= 20 UNION ALL SELECT epoch, user_type, k, 'recall', recall FROM h WHERE k >= 100""")
def k9(t):
    rolled = V.roll_up(_metrics(t, [10, 20, 100, 500]), user_types(t))
    return V.metric_report(V.metric_history(V.metric_history(None, 0, rolled), 1, rolled))


@query("k10_qualitative_table", f"""
WITH pop AS ({POP_SQL}), u AS (SELECT DISTINCT reviewer_id AS user_id FROM val)
SELECT u.user_id, CAST(pop.pos AS INTEGER) AS pos, pop.item, d.name, d.large, d.middle, pop.n AS score,
 CAST((u.user_id, pop.item) IN (SELECT (reviewer_id, diner_idx) FROM val) AS INTEGER) AS hit
FROM u, pop JOIN diner d ON d.diner_idx = pop.item
WHERE pop.pos <= 50 AND {HAVERSINE_SQL.format(la1='37.55', lo1='126.95', la2='d.lat', lo2='d.lon')} <= 12""")
def k10(t):
    users = t.val.select(F.col("reviewer_id").alias("user")).distinct()
    near = t.diner.where(geo.haversine_km(37.55, 126.95, "lat", "lon") <= 12).select(F.col("diner_idx").alias("item"), "name", "large", "middle")
    recs = V.spread_list(_top(t), users, 50).join(_top(t).select("item", F.col("n").alias("score")), "item")
    return V.qualitative(recs, near, liked(t)).select(F.col("user").alias("user_id"), "pos", "item", "name", "large", "middle", "score", "hit")


@query("k11_random_baseline", f"""
WITH liked AS ({LIKED_SQL}), items AS (SELECT diner_idx AS item, row_number() OVER (ORDER BY diner_idx) - 1 AS idx FROM (SELECT DISTINCT diner_idx FROM train)),
 c AS (SELECT user_id, count(*) AS m FROM liked GROUP BY 1),
 p AS (SELECT user_id, m, pos, {HASH_SQL.format("'rnd|' || user_id || '|' || pos")} % (SELECT count(*) FROM items) AS idx FROM c, (SELECT unnest(range(1, 94)) AS pos) WHERE pos <= m),
 recs AS (SELECT user_id, item, min(pos) AS pos FROM p JOIN items USING (idx) GROUP BY 1, 2),
 hits AS (SELECT recs.* FROM recs SEMI JOIN liked ON liked.user_id = recs.user_id AND liked.item = recs.item)
SELECT c.user_id, round(coalesce(sum(1 / log2(pos + 1)), 0) / list_sum([1 / log2(i + 1) for i in range(1, m + 1)]), 6) AS ndcg
FROM c LEFT JOIN hits USING (user_id) GROUP BY c.user_id, m""")
def k11(t):
    """Random lists as long as the user's liked list; NDCG at that length."""
    counts = V.liked_counts(liked(t))
    items = I.id_mapping(t.train, "diner_idx", "idx").withColumnRenamed("diner_idx", "item")
    n = I.distinct_count(t.train, "diner_idx")
    draws = counts.select("user", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("pos"))
    recs = (
        draws.withColumn("idx", hash_int("rnd", F.col("user"), F.col("pos")) % n).join(items, "idx")
        .groupBy("user", "item").agg(F.min("pos").alias("pos"))
    )
    return V.ndcg_at_own_length(V.find_hits(recs, liked(t)), counts).select(F.col("user").alias("user_id"), F.round("ndcg", 6).alias("ndcg"))


@query("k12_rating_error", """
WITH p AS (SELECT v.score, coalesce(m.a, (SELECT avg(score) FROM train)) AS pred FROM val v LEFT JOIN (SELECT diner_idx, avg(score) AS a FROM train GROUP BY 1) m ON m.diner_idx = v.diner_idx)
SELECT count(*) AS n, round(avg((score - pred) * (score - pred)), 6) AS mse, round(sqrt(avg((score - pred) * (score - pred))), 6) AS rmse FROM p""")
def k12(t):
    means = t.train.groupBy("diner_idx").agg(F.avg("score").alias("a"))
    overall = t.train.agg(F.avg("score")).scalar()
    pairs = t.val.join(means, "diner_idx", "left").withColumn("pred", F.coalesce("a", overall))
    return V.squared_error(pairs, "score", "pred").select("n", F.round("mse", 6).alias("mse"), F.round("rmse", 6).alias("rmse"))
