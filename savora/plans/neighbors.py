"""G: neighbourhood collaborative filtering, fitted on the train split."""

from __future__ import annotations

from pyspark.sql import functions as F

from savora.operators import neighbors as N
from savora.plans.registry import query
from savora.sources import files

INTER = "inter AS (SELECT reviewer_id AS u, diner_idx AS i, CAST(sum(score) AS DOUBLE) AS r FROM train GROUP BY 1, 2)"
PAIRS = f"""{INTER}, st AS (SELECT i, sqrt(sum(r * r)) AS norm, count(*) AS deg FROM inter GROUP BY 1),
 pairs AS (SELECT a, b, co, dot / (x.norm * y.norm) AS cosine, CAST(co AS DOUBLE) / (x.deg + y.deg - co) AS jaccard FROM (
  SELECT p.i AS a, q.i AS b, count(*) AS co, sum(p.r * q.r) AS dot FROM inter p JOIN inter q ON p.u = q.u AND p.i < q.i GROUP BY 1, 2) c
  JOIN st x ON x.i = a JOIN st y ON y.i = b)"""
SIMS = f"""{PAIRS}, sims AS (SELECT a AS target, b AS item, round(cosine, 9) AS sim, round(jaccard, 9) AS jac FROM pairs
 UNION ALL SELECT b, a, round(cosine, 9), round(jaccard, 9) FROM pairs)"""


def _inter(t):
    return N.interactions(t.hold("train").train)


def _sims(t, method="cosine"):
    return N.both_directions(N.item_pairs(_inter(t)), method)


def _hybrid_sql(k):
    return f"""near AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY sim DESC, item) AS rn FROM sims),
 mixed AS (SELECT target, item, sim, coalesce(CAST(x.large = y.large AS DOUBLE), 0) AS content,
   round(sim * 0.8::DOUBLE + coalesce(CAST(x.large = y.large AS DOUBLE), 0) * 0.2::DOUBLE, 9) AS hybrid
   FROM near JOIN diner x ON x.diner_idx = target JOIN diner y ON y.diner_idx = item WHERE rn <= {3 * k}),
 hyb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY hybrid DESC, item) AS pos FROM mixed) WHERE pos <= {k})"""


@query("g1_item_cosine", f"WITH {PAIRS} SELECT a, b, co, round(cosine, 6) AS cosine FROM pairs")
def g1(t):
    return N.item_pairs(_inter(t)).select("a", "b", "co", F.round("cosine", 6).alias("cosine"))


@query("g2_item_jaccard", f"WITH {PAIRS} SELECT a, b, co, round(jaccard, 6) AS jaccard FROM pairs")
def g2(t):
    return N.item_pairs(_inter(t)).select("a", "b", "co", F.round("jaccard", 6).alias("jaccard"))


@query("g3_similar_items", f"""
WITH {SIMS} SELECT target, item, round(jac, 6) AS sim, CAST(pos AS INTEGER) AS pos FROM (
 SELECT *, row_number() OVER (PARTITION BY target ORDER BY jac DESC, item) AS pos FROM sims) WHERE pos <= 10""")
def g3(t):
    return N.similar_items(_sims(t, "jaccard"), 10).select("target", "item", F.round("sim", 6).alias("sim"), "pos")


@query("g4_content_similarity", f"""
WITH {PAIRS} SELECT a AS target, b AS item, coalesce(CAST(x.large = y.large AS DOUBLE), 0) AS content
FROM pairs LEFT JOIN diner x ON x.diner_idx = a LEFT JOIN diner y ON y.diner_idx = b""")
def g4(t):
    pairs = N.item_pairs(_inter(t)).select(F.col("a").alias("target"), F.col("b").alias("item"))
    return N.content_similarity(pairs, t.diner).select("target", "item", "content")


@query("g5_hybrid_similar", f"WITH {SIMS}, {_hybrid_sql(5)} SELECT target, item, round(hybrid, 6) AS hybrid, CAST(pos AS INTEGER) AS pos FROM hyb")
def g5(t):
    return N.hybrid_similar(_sims(t), t.diner, 5).select("target", "item", F.round("hybrid", 6).alias("hybrid"), "pos")


@query("g6_user_recommendation", f"""
WITH {SIMS}, items AS (SELECT DISTINCT i FROM inter), users AS (SELECT DISTINCT u FROM inter),
 votes AS (SELECT u, s.item, round(sum(r * sim) / greatest(sum(abs(sim)), 1e-12), 6) AS pred FROM inter JOIN sims s ON s.target = inter.i AND sim > 0 GROUP BY 1, 2),
 allp AS (SELECT users.u, items.i AS item, coalesce(v.pred, 0) AS pred FROM users CROSS JOIN items LEFT JOIN votes v ON v.u = users.u AND v.item = items.i
          ANTI JOIN inter ON inter.u = users.u AND inter.i = items.i)
SELECT u AS user_id, item, pred, CAST(pos AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY pred DESC, item) AS pos FROM allp) WHERE pos <= 10""")
def g6(t):
    inter = _inter(t)
    sims = N.both_directions(N.item_pairs(inter))
    return N.recommend_for_users(inter, sims, 10).select(F.col("user").alias("user_id"), "item", "pred", "pos")


SAVE = f"""{SIMS}, sums AS (SELECT i, sum(r) AS s FROM inter GROUP BY 1), {_hybrid_sql(25)},
 kept AS (SELECT target, item, hybrid FROM hyb WHERE hybrid > 0 AND target IN (SELECT i FROM sums WHERE s > 1) AND item IN (SELECT i FROM sums WHERE s >= 10)),
 saved AS (SELECT target, item, floor(hybrid * 100 + 0.5) / 100 AS score, pos FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY hybrid DESC, item) AS pos FROM kept) WHERE pos <= 5)"""


def _saved(t):
    inter = _inter(t)
    return inter, N.save_all_similar(inter, N.both_directions(N.item_pairs(inter)), t.diner, 5, 10)


@query("g7_save_all_similar", f"WITH {SAVE} SELECT target, item, score, CAST(pos AS INTEGER) AS pos FROM saved")
def g7(t):
    return _saved(t)[1].select("target", "item", "score", "pos")


@query("g7_save_all_similar_json", f"""
WITH {SAVE} SELECT target, '[' || string_agg('[' || item || ',' || printf('%.2f', score) || ']', ',' ORDER BY score DESC, item) || ']' AS similar FROM saved GROUP BY 1""")
def g7_json(t):
    return files.similar_items_json(_saved(t)[1], "target", "item", "score")


@query("g8_lookup_similar", f"""
WITH {SIMS}, sums AS (SELECT i, CAST(sum(r) >= 30 AS INTEGER) AS good FROM inter GROUP BY 1),
 near AS (SELECT * FROM (SELECT target, item, sim, row_number() OVER (PARTITION BY target ORDER BY sim DESC, item) AS rn FROM sims) WHERE rn <= 25 AND sim > 0.0001),
 f AS (SELECT target, item, sim, good, max(good) OVER (PARTITION BY target) AS best FROM near JOIN sums ON i = item)
SELECT target, item, round(sim, 6) AS sim, good, CAST(pos AS INTEGER) AS pos FROM (
 SELECT *, row_number() OVER (PARTITION BY target ORDER BY sim DESC, item) AS pos FROM f WHERE good = best) WHERE pos <= 5""")
def g8(t):
    inter = _inter(t)
    targets = inter.select(F.col("item").alias("target")).distinct()
    out = N.lookup_similar(inter, N.both_directions(N.item_pairs(inter)), targets, 5, 30)
    return out.select("target", "item", F.round("sim", 6).alias("sim"), "good", "pos")


COLD = """cold AS (SELECT reviewer_id AS cold, diner_idx AS i, CAST(sum(score) AS DOUBLE) AS cr FROM val
 WHERE reviewer_id NOT IN (SELECT reviewer_id FROM train) GROUP BY 1, 2),
 meet AS (SELECT cold, inter.u, sum(cr * r) AS dot, count(*) AS co FROM cold JOIN inter ON cold.i = inter.i GROUP BY 1, 2),
 wn AS (SELECT u, sqrt(sum(r * r)) AS n, count(*) AS c FROM inter GROUP BY 1), cn AS (SELECT cold, sqrt(sum(cr * cr)) AS n, count(*) AS c FROM cold GROUP BY 1)"""


def _cold(t):
    from savora.operators.splits import cold_reviews

    return N.interactions(cold_reviews(t.train, t.val)).withColumnRenamed("user", "cold")


@query("g9_nearest_user_cosine", f"""
WITH {INTER}, {COLD}, s AS (SELECT meet.cold, meet.u, co, wn.c, round(dot / (wn.n * cn.n), 6) AS sim FROM meet JOIN wn ON wn.u = meet.u JOIN cn ON cn.cold = meet.cold)
SELECT cold, u AS user_id, sim, co FROM (SELECT *, row_number() OVER (PARTITION BY cold ORDER BY sim DESC, c, u) AS rn FROM s) WHERE rn = 1""")
def g9(t):
    return N.nearest_warm_user(_inter(t), _cold(t), "cosine").withColumnRenamed("user", "user_id")


@query("g10_nearest_user_jaccard", f"""
WITH {INTER}, {COLD}, s AS (SELECT meet.cold, meet.u, co, round(CAST(co AS DOUBLE) / (wn.c + cn.c - co), 6) AS sim FROM meet JOIN wn ON wn.u = meet.u JOIN cn ON cn.cold = meet.cold)
SELECT cold, u AS user_id, sim, co FROM (SELECT *, row_number() OVER (PARTITION BY cold ORDER BY sim DESC, co DESC, u) AS rn FROM s) WHERE rn = 1""")
def g10(t):
    return N.nearest_warm_user(_inter(t), _cold(t), "jaccard").withColumnRenamed("user", "user_id")


@query("g11_similar_statistics", f"""
WITH {SAVE} SELECT count(*) AS pairs, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM sums WHERE s > 1), 6) AS mean_per_target, round(avg(score), 6) AS mean_score FROM saved""")
def g11(t):
    inter, saved = _saved(t)
    targets = inter.groupBy("item").agg(F.sum("r").alias("s")).where("s > 1").select(F.col("item").alias("target"))
    return N.similar_statistics(saved, targets)
