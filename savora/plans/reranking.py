"""J: ranking set, negatives, re-ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from savora.functions import geo
from savora.functions.hashing import hash_int
from savora.operators import features as E
from savora.operators import ids as I
from savora.operators import listwise as L
from savora.operators import negatives as NG
from savora.operators import popularity as P
from savora.operators import reranking as R
from savora.operators import splits as S
from savora.plans.popularity import HAVERSINE_SQL
from savora.plans.registry import query
from savora.plans.splits import AS_OF_SQL, HASH_SQL
from savora.session import materialise, shuffled, spread
from savora.sources.tables import AS_OF

ITEMS_SQL = "it AS (SELECT diner_idx AS item, row_number() OVER (ORDER BY diner_idx) - 1 AS idx FROM (SELECT DISTINCT diner_idx FROM train)), us AS (SELECT DISTINCT reviewer_id AS u FROM train)"


def _inter(t):
    return t.hold("train").train.select(F.col("reviewer_id").alias("user"), F.col("diner_idx").alias("item"))


def _draw_sql(seed, limit, n, source="us", pool="it"):
    return f"""d AS (SELECT u, j, {HASH_SQL.format(f"'{seed}|' || u || '|' || j")} % {limit} AS idx FROM {source}, (SELECT unnest(range({4 * n})) AS j)),
 c AS (SELECT u, item, min(j) AS j FROM d JOIN {pool} USING (idx) ANTI JOIN train ON train.reviewer_id = u AND train.diner_idx = item GROUP BY 1, 2),
 neg AS (SELECT * FROM (SELECT u, item, row_number() OVER (PARTITION BY u ORDER BY j) AS rn FROM c) WHERE rn <= {n})"""


@query("j2_random_negatives", f"WITH {ITEMS_SQL}, {_draw_sql('neg', '(SELECT count(*) FROM it)', 20)} SELECT u AS user_id, item, CAST(rn AS INTEGER) AS draw FROM neg")
def j2(t):
    return NG.random_negatives(_inter(t), 20, "neg").withColumnRenamed("user", "user_id")


POP_POOL = "pl AS (SELECT diner_idx AS item, row_number() OVER (ORDER BY count(*) DESC, diner_idx) - 1 AS idx FROM train GROUP BY 1)"


@query("j3_popular_negatives", f"""
WITH {ITEMS_SQL}, {POP_POOL}, un AS (SELECT u, idx, row_number() OVER (PARTITION BY u ORDER BY idx) AS p, count(*) OVER (PARTITION BY u) AS cnt
  FROM us CROSS JOIN pl ANTI JOIN train ON train.reviewer_id = u AND train.diner_idx = pl.item),
 lim AS (SELECT u, max(idx) + 1 AS lm FROM un WHERE p <= floor(cnt * 0.5) GROUP BY 1), {_draw_sql('pop', 'lm', 10, 'lim', 'pl')}
SELECT u AS user_id, item, CAST(rn AS INTEGER) AS draw FROM neg""")
def j3(t):
    return NG.popular_negatives(_inter(t), 10, "pop").withColumnRenamed("user", "user_id")


CATS = ["ECONOMY", "LARGE", "PROMO"]


@query("j4_diverse_negatives", f"""
WITH {ITEMS_SQL}, cp AS (SELECT large, item, row_number() OVER (PARTITION BY large ORDER BY item) - 1 AS idx, count(*) OVER (PARTITION BY large) AS lm
  FROM it JOIN diner ON diner_idx = item WHERE large IN ('ECONOMY', 'LARGE', 'PROMO')),
 q AS (SELECT u, c.large, lm, CASE WHEN c.k < 1 THEN 4 ELSE 3 END AS want FROM us, (SELECT large, lm, row_number() OVER (ORDER BY large) - 1 AS k FROM (SELECT DISTINCT large, lm FROM cp)) c),
 d AS (SELECT u, large, want, j, {HASH_SQL.format("'div|' || u || '|' || large || '|' || j")} % lm AS idx FROM q, (SELECT unnest(range(16)) AS j) WHERE j < want * 4),
 c AS (SELECT u, d.large, want, item, min(j) AS j FROM d JOIN cp ON cp.large = d.large AND cp.idx = d.idx ANTI JOIN train ON train.reviewer_id = u AND train.diner_idx = item GROUP BY 1, 2, 3, 4)
SELECT u AS user_id, item, 'category' AS source FROM (SELECT *, row_number() OVER (PARTITION BY u, large ORDER BY j) AS rn FROM c) WHERE rn <= want""")
def j4(t):
    cats = t.diner.select(F.col("diner_idx").alias("item"), F.col("large").alias("label"))
    return NG.diverse_negatives(_inter(t), cats, CATS, 10, "div").withColumnRenamed("user", "user_id")


# Features of longer logs must not be broadcast; for shorter ones Spark may choose, and bins of the ranker are
# approximate quantiles that depend on how the join left the rows.
SHORT_LOG = 100_000
RANK_FEATURES = ["user_mean_score", "all_review_cnt", "mean_review_score"]


def _with_features(t, pairs):
    users = E.user_mean_score(t.train, "reviewer_id", "score").withColumnRenamed("reviewer_id", "user")
    items = t.train.groupBy(F.col("diner_idx").alias("item")).agg(F.count("*").alias("all_review_cnt"), F.avg("score").alias("mean_review_score"))
    if t.hold("train").train.count() > SHORT_LOG:
        users, items = shuffled(users), shuffled(items)
    return E.merge_features(pairs, users, items, "user", "item")


def _ranking_set(t):
    liked = S.as_of_target(t.hold("train").train).where("target = 1").select(F.col("reviewer_id").alias("user"), F.col("diner_idx").alias("item"))
    liked = materialise(liked)
    return materialise(_with_features(t, R.labelled_pairs(liked, NG.random_negatives(liked, 5, "rank"))))


RANKING_SQL = f"""
WITH liked AS (SELECT reviewer_id AS u, diner_idx AS item FROM ({AS_OF_SQL.format('train')}) WHERE score >= review_avg),
 it AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS idx FROM (SELECT DISTINCT item FROM liked)), us AS (SELECT DISTINCT u FROM liked),
 d AS (SELECT u, j, {HASH_SQL.format("'rank|' || u || '|' || j")} % (SELECT count(*) FROM it) AS idx FROM us, (SELECT unnest(range(20)) AS j)),
 c AS (SELECT u, item, min(j) AS j FROM d JOIN it USING (idx) ANTI JOIN liked ON liked.u = d.u AND liked.item = it.item GROUP BY 1, 2),
 p AS (SELECT u, item, 1 AS target FROM liked UNION ALL SELECT u, item, 0 FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY j) AS rn FROM c) WHERE rn <= 5)
SELECT p.u AS user_id, p.item, target, round(coalesce(um, 0), 6) AS user_mean_score, coalesce(n, 0) AS all_review_cnt, round(coalesce(im, 0), 6) AS mean_review_score
FROM p LEFT JOIN (SELECT reviewer_id AS u, avg(score) AS um FROM train GROUP BY 1) a ON a.u = p.u
LEFT JOIN (SELECT diner_idx AS item, count(*) AS n, avg(score) AS im FROM train GROUP BY 1) b ON b.item = p.item"""


@query("j1_ranking_set", RANKING_SQL)
def j1(t):
    return _ranking_set(t).select(
        F.col("user").alias("user_id"), "item", "target", F.round("user_mean_score", 6).alias("user_mean_score"), "all_review_cnt",
        F.round("mean_review_score", 6).alias("mean_review_score"),
    )


@query("j5_candidate_check", """
WITH i AS (SELECT diner_idx, row_number() OVER (ORDER BY diner_idx) - 1 AS item_idx FROM (SELECT DISTINCT diner_idx FROM train)),
 u AS (SELECT reviewer_id, row_number() OVER (ORDER BY reviewer_id) - 1 AS user_idx FROM (SELECT DISTINCT reviewer_id FROM train)),
 v AS (SELECT DISTINCT reviewer_id, diner_idx FROM train)
SELECT user_idx AS "user", item_idx AS diner_id, 1 AS known, 0::BIGINT AS mismatches FROM v JOIN i USING (diner_idx) JOIN u USING (reviewer_id)""")
def j5(t):
    """Candidates numbered in the shared id space of the generator, checked against the ranker's."""
    items, shared = I.pair_mapping(t.hold("train").train)
    n = I.distinct_count(t.train, "diner_idx")
    cand = I.map_column(I.map_column(t.train, items, "diner_idx", "diner_idx", "item_idx"), shared, "reviewer_id", "reviewer_id", "user_idx")
    cand = cand.select(F.col("user_idx").alias("user_id"), F.col("item_idx").alias("diner_id")).distinct()
    own = I.id_mapping(t.train, "reviewer_id", "user_idx")
    bad = I.mapping_mismatches(own, shared.withColumn("user_idx", F.col("user_idx") - n), "reviewer_id", "user_idx").agg(F.count("*")).scalar()
    return R.check_candidates(cand, own, items, n).select("user", "diner_id", "known", bad.alias("mismatches"))


HELD_OUT = 5  # one list in five is for validation


def _parts(t):
    """Training and validation lists of the ranking set; a user's list is never divided."""
    pairs = _ranking_set(t)
    part = hash_int("lists", F.col("user")) % HELD_OUT
    return pairs.where(part != 0), pairs.where(part == 0)


def _candidates(t):
    """The checked candidates of the generator under the ranker's own ids, turned back into raw ids."""
    known = j5(t).where("known = 1").select("user", "diner_id")
    items, users = I.id_mapping(t.train, "diner_idx", "diner_id"), I.id_mapping(t.train, "reviewer_id", "user")
    return known.join(shuffled(items), "diner_id").join(shuffled(users), "user").select(F.col("reviewer_id").alias("user"), F.col("diner_idx").alias("item"))


def _ranked(t, k):
    train, valid = _parts(t)
    model = L.fit_listwise(train, RANK_FEATURES, valid, rounds=5, rate=0.3)
    scored = spread(model.score(_with_features(t, _candidates(t))), t.train.count(), "user")
    return P.top_per_group(scored, ["user"], [F.desc("pred"), F.asc("item")], k, rank="pos")


@query("j6_rank_candidates")
def j6(t):
    """The generator's candidates, ranked list by list."""
    return _ranked(t, 20).select("user", "item", "pred", "pos")


@query("j6_list_sizes", """
SELECT reviewer_id AS "user", least(20, count(DISTINCT diner_idx)) AS n, 1 AS first, least(20, count(DISTINCT diner_idx))::INTEGER AS last FROM train GROUP BY 1""")
def j6_sizes(t):
    """Every user's list holds all candidates, 20 at most, at places without a gap."""
    return _ranked(t, 20).groupBy("user").agg(F.count_distinct("item").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


@query("j7_ranker_scores")
def j7(t):
    train, valid = _parts(t)
    model = L.fit_listwise(train, RANK_FEATURES, valid, rounds=10, rate=0.3, patience=5)
    return model.score(train.unionByName(valid)).select("user", "item", "target", "pred")


@query("j7_listwise_check", f"""
SELECT count(*) AS n_pairs, count(DISTINCT user_id) AS n_lists, 1 AS learned, 1 AS not_below_pointwise FROM ({RANKING_SQL})""")
def j7_check(t):
    """On validation lists: NDCG@20 above that of unranked lists, and not below that of pointwise trees."""
    train, valid = _parts(t)
    model = L.fit_listwise(train, RANK_FEATURES, valid, rounds=10, rate=0.3, patience=5)
    plain = R.score_pairs(R.fit_ranker(train, RANK_FEATURES, iterations=5, depth=3), valid)
    ndcg = [L.mean_ndcg(df.select("user", "item", "target", F.col(c).alias("score")), 20) for df, c in ((model.score(valid), "pred"), (plain, "pred"), (valid.withColumn("none", F.lit(0.0)), "none"))]
    return train.unionByName(valid).agg(
        F.count("*").alias("n_pairs"), F.count_distinct("user").alias("n_lists"), F.lit(int(ndcg[0] > ndcg[2])).alias("learned"), F.lit(int(ndcg[0] >= ndcg[1] - 1e-9)).alias("not_below_pointwise")
    )


@query("j8_out_of_fold")
def j8(t):
    return L.out_of_fold_lists(_ranking_set(t), RANK_FEATURES, 3, "fold", rounds=3, rate=0.3).select("user", "item", "target", "fold", "pred")


@query("j8_fold_rows", f"""
SELECT user_id AS "user", item, target, CAST({HASH_SQL.format("'fold|' || user_id")} % 3 AS INTEGER) AS fold, 1 AS scored FROM ({RANKING_SQL})""")
def j8_rows(t):
    """Every pair is scored once, in the fold of its user."""
    return j8(t).select("user", "item", "target", "fold", F.col("pred").isNotNull().cast("int").alias("scored"))


@query("j9_serving_set")
def j9(t):
    """Recommendations for the busiest reviewer: unseen diners near a point in two categories."""
    model = R.fit_ranker(_ranking_set(t), RANK_FEATURES, iterations=5, depth=3)
    who = P.most_popular(t.train, 1, item="reviewer_id").select(F.col("reviewer_id").alias("user"))
    items = t.diner.withColumnRenamed("diner_idx", "item")
    pool = R.serving_set(who, items, _inter(t), geo.haversine_km(37.55, 126.95, "lat", "lon") <= 15, ["PROMO", "SMALL"])
    return R.rank_candidates(model, _with_features(t, pool.select("user", "item", "name", "large")), 20).select("user", "item", "name", "large", "pred", "pos")


STAT_SQL = "st AS (SELECT diner_idx, count(*) AS n, avg(score) AS m FROM review GROUP BY 1)"


def _stats(t):
    return t.review.groupBy("diner_idx").agg(F.count("*").alias("n"), F.avg("score").alias("m"))


MM = "CASE WHEN max({0}) OVER ({1}) > min({0}) OVER ({1}) THEN ({0} - min({0}) OVER ({1})) / (max({0}) OVER ({1}) - min({0}) OVER ({1}) + 1e-8) ELSE 0 END"


@query("j10_popularity_blend", f"""
WITH {STAT_SQL}, a AS (SELECT d.large, d.diner_idx, m, CAST(n AS DOUBLE) AS n FROM st JOIN diner d USING (diner_idx)),
 b AS (SELECT *, 0.7::DOUBLE * ({MM.format('m', 'PARTITION BY large')}) + 0.3::DOUBLE * ({MM.format('n', 'PARTITION BY large')}) AS mixed FROM a)
SELECT large, diner_idx, round({MM.format('mixed', 'PARTITION BY large')}, 6) AS blend FROM b""")
def j10(t):
    df = _stats(t).join(t.diner.select("diner_idx", "large"), "diner_idx")
    return R.popularity_blend(df, "m", "n", 0.3, ["large"]).select("large", "diner_idx", F.round("blend", 6).alias("blend"))


@query("j11_candidate_cut", """
SELECT "user" AS user_id, item, rel FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY rel DESC, item) AS rn FROM (
 SELECT reviewer_id AS "user", diner_idx AS item, CAST(sum(score) AS BIGINT) AS rel FROM review WHERE diner_idx IN (SELECT diner_idx FROM diner WHERE middle IS NOT NULL) GROUP BY 1, 2)) WHERE rn <= 10""")
def j11(t):
    cand = t.review.groupBy(F.col("reviewer_id").alias("user"), F.col("diner_idx").alias("item")).agg(F.sum("score").alias("rel"))
    meta = t.diner.where("middle is not null").select(F.col("diner_idx").alias("item"))
    return R.candidate_cut(cand, meta, 10, ["user"], "item", "rel").withColumnRenamed("user", "user_id")


GEM_SQL = f"""gem AS (SELECT d.diner_idx, d.name, d.large, d.lat, d.lon, d.address, split_part(d.address, ' ', 1) AS region, m AS avg_rating, recent
 FROM diner d LEFT JOIN (SELECT diner_idx, avg(score) AS m, count(*) FILTER (date_diff('day', CAST(review_date AS DATE), DATE '{AS_OF}') <= 30) AS recent FROM review GROUP BY 1) s ON s.diner_idx = d.diner_idx)"""


def _gems(t):
    return R.hidden_input(t.diner, t.review, AS_OF).withColumn("region", F.split_part("address", F.lit(" "), F.lit(1)))


def _mmr_sql(k, lam=0.55, frozen=0, most=(), least=()):
    """Places unrolled one by one. most and least: (category, number)."""
    counts = [c for c, _ in (*most, *least)]
    taken = lambda c: f"coalesce(n_{c}, 0)"
    bonus = "".join(f" + CASE WHEN s.cat = '{c}' THEN greatest({n} - {taken(c)}, 0) * 0.05::DOUBLE ELSE 0 END" for c, n in least)
    steps = ["s0 AS MATERIALIZED (SELECT region, item, rel, cat, lat, lon, 0::DOUBLE AS sim FROM cand)"]
    for i in range(k):
        earlier = " UNION ALL ".join(f"SELECT region, cat FROM b{j}" for j in range(i)) or "SELECT region, cat FROM s0 WHERE false"
        numbers = "".join(f", count(*) FILTER (cat = '{c}') AS n_{c}" for c in counts)
        quota = "".join(f" AND (s.cat IS DISTINCT FROM '{c}' OR {taken(c)} < {n})" for c, n in most) if i >= frozen else ""
        gain = f"round({lam}::DOUBLE * rel - {1 - lam}::DOUBLE * CASE WHEN hi > lo THEN (sim - lo) / (hi - lo + 1e-8) ELSE 0 END{bonus}, 9)" if i >= frozen else "rel"
        steps.append(f"c{i} AS MATERIALIZED (SELECT region{numbers} FROM ({earlier}) GROUP BY 1)")
        steps.append(f"o{i} AS MATERIALIZED (SELECT s.*{''.join(f', n_{c}' for c in counts)} FROM s{i} s LEFT JOIN c{i} c ON c.region = s.region WHERE true{quota})")
        steps.append(f"e{i} AS (SELECT region, min(sim) AS lo, max(sim) AS hi FROM o{i} GROUP BY 1)")
        steps.append(f"""b{i} AS MATERIALIZED (SELECT region, item, cat, lat, lon FROM (SELECT s.*, row_number() OVER (PARTITION BY region ORDER BY
  {gain} DESC NULLS LAST, item) AS rn FROM o{i} s JOIN e{i} USING (region)) WHERE rn = 1)""")
        steps.append(f"""s{i + 1} AS MATERIALIZED (SELECT s.region, s.item, s.rel, s.cat, s.lat, s.lon, CASE WHEN b.item IS NULL THEN sim ELSE greatest(sim, 0.5 * coalesce(CAST(s.cat = b.cat AS DOUBLE), 0)
  + 0.5 * coalesce(exp(-({HAVERSINE_SQL.format(la1='b.lat', lo1='b.lon', la2='s.lat', lo2='s.lon')}) / 2.0), 0)) END AS sim
  FROM s{i} s LEFT JOIN b{i} b ON s.region = b.region WHERE s.item IS DISTINCT FROM b.item)""")
    return ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT region, item, {i + 1} AS pos FROM b{i}" for i in range(k))


CAND_SQL = f"{GEM_SQL}, cand AS (SELECT region, diner_idx AS item, large AS cat, lat, lon, {MM.format('avg_rating', 'PARTITION BY region')} AS rel FROM gem)"


def _cands(t):
    rel = R.minmax(F.col("avg_rating"), ["region"], _gems(t), "rel")
    return rel.select("region", F.col("diner_idx").alias("item"), "rel", F.col("large").alias("cat"), "lat", "lon",
                      R.coverage_labels("large", F.col("region")).alias("labels"))


@query("j12_diversity_rerank", f"WITH {CAND_SQL}, {_mmr_sql(5)}")
def j12(t):
    return R.mmr_stepwise(_cands(t), "region", 5)


@query("j12_diversity_rerank_coverage", f"WITH {CAND_SQL}, {_mmr_sql(20, frozen=3, most=[('PROMO', 3)], least=[('SMALL', 5)])}")
def j12b(t):
    return R.mmr_rerank(_cands(t), "region", 20, frozen=3, coverage_max={"category:PROMO": 3}, coverage_min={"category:SMALL": 5})


@query("j13_coverage_quota", """
SELECT region, diner_idx, large FROM (SELECT split_part(address, ' ', 1) AS region, diner_idx, large, m, row_number() OVER (PARTITION BY split_part(address, ' ', 1), large ORDER BY m DESC, diner_idx) AS rn
 FROM diner JOIN (SELECT diner_idx, avg(score) AS m FROM review GROUP BY 1) USING (diner_idx)) WHERE rn <= 4""")
def j13(t):
    df = _gems(t).where("avg_rating is not null")
    return R.within_quota(df, ["region"], "large", [F.desc("avg_rating"), F.asc("diner_idx")], 4).select("region", "diner_idx", "large")


@query("j14_coverage_bonus", f"""
WITH {CAND_SQL}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY rel DESC, item) AS rn FROM cand) WHERE rn <= 10),
 c AS (SELECT region, count(*) FILTER (cat = 'SMALL') AS small_n, count(*) FILTER (cat = 'PROMO') AS promo_n FROM top GROUP BY 1)
SELECT cand.region, item, round(CASE WHEN cat = 'SMALL' THEN greatest(4 - small_n, 0) * 0.05::DOUBLE WHEN cat = 'PROMO' THEN greatest(2 - promo_n, 0) * 0.05::DOUBLE ELSE 0 END, 6) AS bonus FROM cand JOIN c USING (region)""")
def j14(t):
    """Bonus of every candidate after the ten best of its region are chosen."""
    cands = _cands(t)
    chosen = P.top_per_group(cands, ["region"], [F.desc("rel"), F.asc("item")], 10)
    return R.coverage_bonus(cands, chosen, "region", {"category:SMALL": 4, "category:PROMO": 2}, 0.05).select("region", "item", F.round("bonus", 6).alias("bonus"))


LABEL_SQL = """CASE WHEN address IS NULL OR address = '' THEN 'unknown' WHEN ends_with(split_part(address, ' ', 2), 'A') THEN split_part(address, ' ', 1) || ' ' || split_part(address, ' ', 2)
 WHEN regexp_extract(address, '^(\\S+)\\s+(\\S+A|\\S+N|\\S+T)') <> '' THEN regexp_extract(address, '^(\\S+)\\s+(\\S+A|\\S+N|\\S+T)') ELSE split_part(address, ' ', 1) END"""


@query("j15_coverage_labels", f"SELECT diner_idx, 'category:' || coalesce(middle, 'nan') || '|region:' || {LABEL_SQL} AS labels FROM diner")
def j15(t):
    labels = R.coverage_labels("middle", R.region_label("address", ("A", "N", "T")))
    return t.diner.select("diner_idx", F.array_join(labels, "|").alias("labels"))


@query("j16_region_label", f"SELECT diner_idx, {LABEL_SQL} AS region FROM diner")
def j16(t):
    return t.diner.select("diner_idx", R.region_label("address", ("A", "N", "T")).alias("region"))


def _spot_sql(n, rounds):
    """Lloyd's rounds unrolled: k0 the start centres, one table of centres a round, `spots` the last."""
    steps = [f"""pt AS (SELECT region, lat, lon FROM gem WHERE lat IS NOT NULL AND lon IS NOT NULL),
 k0 AS MATERIALIZED (SELECT region, lat, lon FROM (SELECT DISTINCT region, lat, lon FROM pt WHERE region IN (SELECT region FROM pt GROUP BY 1 HAVING count(*) >= 2))
  QUALIFY row_number() OVER (PARTITION BY region ORDER BY {HASH_SQL.format("'hot|' || lat || '|' || lon")}, lat, lon) <= {n})"""]
    for i in range(rounds):
        steps.append(f"""k{i + 1} AS MATERIALIZED (SELECT region, avg(lat) AS lat, avg(lon) AS lon FROM (SELECT pt.*, c.lat AS cl, c.lon AS co FROM pt JOIN k{i} c USING (region)
  QUALIFY row_number() OVER (PARTITION BY region, pid ORDER BY (c.lat - pt.lat) ** 2 + (c.lon - pt.lon) ** 2, c.lat, c.lon) = 1) GROUP BY region, cl, co)""")
    steps[0] = steps[0].replace("pt AS (SELECT region, lat, lon FROM gem", "pt AS MATERIALIZED (SELECT diner_idx AS pid, region, lat, lon FROM gem")
    return ",\n ".join(steps) + f",\n spots AS (SELECT * FROM k{rounds})"


@query("j17_hotspots", f"""
WITH {GEM_SQL}, {_spot_sql(5, 5)} SELECT region, CAST(row_number() OVER (PARTITION BY region ORDER BY lat, lon) - 1 AS INTEGER) AS place, round(lat, 6) AS lat, round(lon, 6) AS lon FROM spots""")
def j17(t):
    spots = R.hotspots(_gems(t), "region", "lat", "lon", n=5, rounds=5)
    return spots.select("region", F.posexplode("centres").alias("place", "c")).select("region", "place", F.round("c.lat", 6).alias("lat"), F.round("c.lon", 6).alias("lon"))


CENTRES = [(37.5, 126.95), (37.6, 127.02), (37.45, 126.85)]
DMIN_SQL = "least(" + ", ".join(HAVERSINE_SQL.format(la1=a, lo1=b, la2="lat", lo2="lon") for a, b in CENTRES) + ")"


def _bonus_sql(strength, cap):
    return f"""bon AS (SELECT *, greatest(0, least({strength}::DOUBLE * coalesce({MM.format('dm', 'PARTITION BY region')}, 0), {cap}::DOUBLE)) AS pb FROM (SELECT *, {DMIN_SQL} AS dm FROM gem)),
 sc AS (SELECT *, 0.2::DOUBLE * coalesce({MM.format('avg_rating', '')}, 0) AS rb, 0.3::DOUBLE * coalesce({MM.format('recent', '')}, 0) AS qb FROM bon)"""


@query("j18_periphery_bonus", f"WITH {GEM_SQL}, {_bonus_sql(0.5, 0.3)} SELECT diner_idx, region, round(pb, 6) AS periphery_bonus FROM sc")
def j18(t):
    return R.periphery_bonus(_gems(t), "region", "lat", "lon", CENTRES, 0.5, 0.3).select("diner_idx", "region", F.round("periphery_bonus", 6).alias("periphery_bonus"))


@query("j19_rating_recency_bonus", f"WITH {GEM_SQL}, {_bonus_sql(0.5, 0.3)} SELECT diner_idx, round(rb, 6) AS rating_bonus, round(qb, 6) AS recent_bonus FROM sc")
def j19(t):
    return R.rating_and_recency(_gems(t), "avg_rating", "recent_review_count").select(
        "diner_idx", F.round("rating_bonus", 6).alias("rating_bonus"), F.round("recent_bonus", 6).alias("recent_bonus")
    )


def _scored(t, strength=0.5, cap=0.5, centres=None):
    gems = E.bayesian_average(t.review, t.diner, "diner_idx", "score").join(_gems(t), "diner_idx")
    return R.hidden_scores(gems, "bayesian_score", CENTRES if centres is None else centres, strength, cap)


BAYES_SQL = "coalesce((m * n + (SELECT avg(m) FROM st) * 5) / (n + 5), 0)"


@query("j20_hidden_gems", f"""
WITH {GEM_SQL}, {STAT_SQL}, {_spot_sql(5, 5)},
 dd AS (SELECT diner_idx, min({HAVERSINE_SQL.format(la1='s.lat', lo1='s.lon', la2='gem.lat', lo2='gem.lon')}) AS dm FROM gem JOIN spots s ON s.region = gem.region GROUP BY 1),
 one AS (SELECT gem.*, dm, {BAYES_SQL} AS ba FROM gem LEFT JOIN st USING (diner_idx) LEFT JOIN dd USING (diner_idx)),
 bon AS (SELECT *, greatest(0, least(0.5::DOUBLE * coalesce({MM.format('dm', 'PARTITION BY region')}, 0), 0.5::DOUBLE)) AS pb,
  0.2::DOUBLE * coalesce({MM.format('avg_rating', '')}, 0) AS rb, 0.3::DOUBLE * coalesce({MM.format('recent', '')}, 0) AS qb FROM one),
 hs AS (SELECT *, ba + pb + rb + qb AS hidden FROM bon),
 cand AS (SELECT region, diner_idx AS item, large AS cat, lat, lon, {MM.format('hidden', 'PARTITION BY region')} AS rel FROM hs),
 picked AS (WITH {_mmr_sql(15)})
SELECT p.region, CAST(p.pos AS INTEGER) AS pos, p.item, round(hidden, 6) AS hidden_score, round(pb, 6) AS periphery_bonus, round(rb, 6) AS rating_bonus, round(qb, 6) AS recent_bonus
FROM picked p JOIN hs ON hs.diner_idx = p.item""")
def j20(t):
    spots = R.hotspots(_gems(t), "region", "lat", "lon", n=5, rounds=5)
    out = R.hidden_rerank(_scored(t, centres=spots), 15)
    return out.select("region", "pos", "item", *[F.round(c, 6).alias(c) for c in ("hidden_score", "periphery_bonus", "rating_bonus", "recent_bonus")])


RECENT_SQL = f"""SELECT 'recent_3m' AS dataset, d.diner_idx, round(m, 6) AS avg_rating, recent FROM diner d LEFT JOIN (
 SELECT diner_idx, avg(score) AS m, count(*) FILTER (date_diff('day', CAST(review_date AS DATE), DATE '{AS_OF}') <= 30) AS recent FROM review
 WHERE review_date >= (SELECT max(review_date) - INTERVAL 3 MONTH FROM review) GROUP BY 1) s ON s.diner_idx = d.diner_idx"""


def _datasets(t):
    last = t.review.agg(F.max("review_date")).scalar()
    recent = t.review.where(F.col("review_date") >= F.add_months(last, -3))
    return {"full": _gems(t), "recent_3m": R.hidden_input(t.diner, recent, AS_OF)}


@query("j21_hidden_input", f"WITH {GEM_SQL} SELECT 'full' AS dataset, diner_idx, round(avg_rating, 6) AS avg_rating, recent AS recent_review_count FROM gem UNION ALL {RECENT_SQL}")
def j21(t):
    out = None
    for name, df in _datasets(t).items():
        one = df.select(F.lit(name).alias("dataset"), "diner_idx", F.round("avg_rating", 6).alias("avg_rating"), "recent_review_count")
        out = one if out is None else out.unionByName(one)
    return out


GRID = R.grid({"strength": [0.3, 0.6], "cap": [0.2, 0.5]})


def _exp_sql():
    parts = []
    for i, g in enumerate(GRID):
        parts.append(f"""SELECT {i} AS exp, {g['strength']}::DOUBLE AS strength, {g['cap']}::DOUBLE AS cap, region, avg_rating, row_number() OVER (PARTITION BY region ORDER BY hs DESC, diner_idx) AS pos FROM (
 SELECT *, round(ba + greatest(0, least({g['strength']}::DOUBLE * ({MM.format('dm', 'PARTITION BY region')}), {g['cap']}::DOUBLE)) + 0.2::DOUBLE * coalesce({MM.format('avg_rating', '')}, 0) + 0.3::DOUBLE * coalesce({MM.format('recent', '')}, 0), 9) AS hs
 FROM (SELECT gem.*, {DMIN_SQL} AS dm, coalesce((m * n + (SELECT avg(m) FROM st) * 5) / (n + 5), 0) AS ba FROM gem LEFT JOIN st USING (diner_idx)))""")
    return f"""WITH {GEM_SQL}, {STAT_SQL}, ranked AS ({' UNION ALL '.join(parts)}), sc AS (
 SELECT exp, count(*) FILTER (avg_rating >= 3.2) AS high, count(DISTINCT region) AS regions, strength + cap AS ps FROM ranked WHERE pos <= 10 GROUP BY exp, strength, cap)
SELECT 'full' AS dataset, CAST(exp AS INTEGER) AS exp, round(CAST(high AS DOUBLE) / (regions * 10), 6) AS high_share, round(CAST(high AS DOUBLE) / (regions * 10) * 0.6::DOUBLE + ps * 0.4::DOUBLE, 6) AS combined
FROM sc ORDER BY round(CAST(high AS DOUBLE) / (regions * 10) * 0.6::DOUBLE + ps * 0.4::DOUBLE, 9) DESC, exp LIMIT 1"""


@query("j22_experiment_grid", _exp_sql())
def j22(t):
    ranked = None
    for i, g in enumerate(GRID):
        df = _scored(t, g["strength"], g["cap"]).withColumn("hs", F.round("hidden_score", 9))
        one = P.top_per_group(df, ["region"], [F.desc("hs"), F.asc("diner_idx")], 10, rank="pos").select(
            F.lit("full").alias("dataset"), F.lit(i).alias("exp"), F.lit(g["strength"]).alias("strength"), F.lit(g["cap"]).alias("cap"), "region", "pos", "avg_rating"
        )
        ranked = one if ranked is None else ranked.unionByName(one)
    return R.best_experiment(R.experiment_scores(ranked, 10, 3.2)).select("dataset", "exp", F.round("high_share", 6).alias("high_share"), F.round("combined", 6).alias("combined"))


@query("j23_region_variant", f"""
WITH {GEM_SQL}, {STAT_SQL}, one AS (SELECT gem.*, {DMIN_SQL} AS dm, {BAYES_SQL} AS ba FROM gem LEFT JOIN st USING (diner_idx)
  WHERE region = 'ASIA' OR (SELECT count(*) FROM gem WHERE region = 'ASIA') = 0),
 hs AS (SELECT *, ba + greatest(0, least(0.5::DOUBLE * ({MM.format('dm', 'PARTITION BY region')}), 0.15::DOUBLE)) AS hidden FROM one),
 cand AS (SELECT region, diner_idx AS item, large AS cat, lat, lon, {MM.format('hidden', 'PARTITION BY region')} AS rel FROM hs),
 picked AS (WITH {_mmr_sql(20)})
SELECT p.region, CAST(p.pos AS INTEGER) AS pos, p.item, round(hidden, 6) AS hidden_score FROM picked p JOIN hs ON hs.diner_idx = p.item""")
def j23(t):
    one = R.target_region(_gems(t), "ASIA")
    scored = R.hidden_scores(E.bayesian_average(t.review, t.diner, "diner_idx", "score").join(one, "diner_idx"), "bayesian_score", CENTRES, 0.5, 0.15, 0.0, 0.0)
    return R.hidden_rerank(scored, 20).select("region", "pos", "item", F.round("hidden_score", 6).alias("hidden_score"))


@query("j24_list_comparison", f"""
WITH {STAT_SQL}, a AS (SELECT large, diner_idx, row_number() OVER (PARTITION BY large ORDER BY n DESC, diner_idx) AS pa FROM st JOIN diner USING (diner_idx) QUALIFY pa <= 50),
 b AS (SELECT large, diner_idx, row_number() OVER (PARTITION BY large ORDER BY m DESC, diner_idx) AS pb FROM st JOIN diner USING (diner_idx) QUALIFY pb <= 50)
SELECT coalesce(a.large, b.large) AS large, count(*) FILTER (pa IS NOT NULL AND pb IS NOT NULL) AS overlap,
 CAST(min(CASE WHEN pa IS DISTINCT FROM pb THEN least(pa, pb) END) AS INTEGER) AS first_diff
FROM a FULL JOIN b ON a.large = b.large AND a.diner_idx = b.diner_idx GROUP BY 1""")
def j24(t):
    df = _stats(t).join(t.diner.select("diner_idx", "large"), "diner_idx").withColumnRenamed("diner_idx", "item")
    a = P.top_per_group(df, ["large"], [F.desc("n"), F.asc("item")], 50, rank="pos")
    b = P.top_per_group(df, ["large"], [F.desc("m"), F.asc("item")], 50, rank="pos")
    return R.compare_lists(a, b, ["large"], 50)
