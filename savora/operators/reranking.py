"""Ranking set, ranker, diversity and hidden-gem re-ranking."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from savora.functions import geo
from savora.functions.hashing import hash_int
from savora.operators.popularity import top_per_group
from savora.session import cut_lineage, materialise, release, shared_dir, shuffled

# --- ranking set and ranker -----------------------------------------------------------------


def labelled_pairs(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """(user, item, target): liked pairs with 1, sampled ones with 0."""
    return positives.select("user", "item", F.lit(1).alias("target")).unionByName(
        negatives.select("user", "item", F.lit(0).alias("target"))
    )


def fit_ranker(pairs: DataFrame, features: Sequence[str], iterations: int = 20, depth: int = 4, seed: int = 42):
    """Pointwise gradient-boosted trees; lists are ranked by the predicted probability."""
    shared_dir(pairs.sparkSession)
    pairs = materialise(pairs)
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="keep"),
        GBTClassifier(featuresCol="__x", labelCol="target", maxIter=iterations, maxDepth=depth, seed=seed, checkpointInterval=10),
    ]
    return Pipeline(stages=stages).fit(pairs)


def score_pairs(model, pairs: DataFrame) -> DataFrame:
    out = model.transform(pairs).withColumn("pred", F.round(F.get(vector_to_array("probability"), F.lit(1)), 6))
    return out.drop("__x", "rawPrediction", "probability", "prediction")


def rank_candidates(model, candidates: DataFrame, k: int) -> DataFrame:
    return top_per_group(score_pairs(model, candidates), ["user"], [F.desc("pred"), F.asc("item")], k, rank="pos")


def out_of_fold(pairs: DataFrame, features: Sequence[str], folds: int, seed: str, **params: int) -> DataFrame:
    """Every pair scored by a model that has not seen its fold."""
    work = materialise(pairs.withColumn("fold", (hash_int(seed, F.col("user"), F.col("item")) % folds).cast("int")))
    out = None
    for k in range(folds):
        model = fit_ranker(work.where(F.col("fold") != k), features, **params)
        one = score_pairs(model, work.where(F.col("fold") == k))
        out = one if out is None else out.unionByName(one)
    return out


def check_candidates(candidates: DataFrame, users: DataFrame, items: DataFrame, n_items: Column) -> DataFrame:
    """Candidates with user ids shifted back behind the items; ids without a mapping are flagged."""
    shifted = candidates.withColumn("user", F.col("user_id") - n_items)
    u = users.select(F.col("user_idx").alias("user"), F.lit(1).alias("__u"))
    i = items.select(F.col("item_idx").alias("diner_id"), F.lit(1).alias("__i"))
    known = F.col("__u").isNotNull() & F.col("__i").isNotNull()
    return shifted.join(shuffled(u), "user", "left").join(shuffled(i), "diner_id", "left").withColumn("known", known.cast("int")).drop("__u", "__i")


USERS_PER_BLOCK = 1000


def serving_set(users: DataFrame, items: DataFrame, seen: DataFrame, near: Column | None = None, labels: Sequence[str] | None = None) -> DataFrame:
    """All unseen items for each named user; filters on items come first. Users travel as packed
    blocks of bounded length, and an item meets each block once."""
    pool = items
    if near is not None:
        pool = pool.where(near)
    if labels is not None:
        pool = pool.where(F.col("large").isin(list(labels)))
    asked = materialise(users.select("user").distinct())
    n = asked.agg(F.greatest(F.ceil(F.count("*") / USERS_PER_BLOCK), F.lit(1)).cast("int")).scalar()
    packed = asked.withColumn("__blk", F.pmod(F.xxhash64("user"), n).cast("int")).groupBy("__blk").agg(F.collect_list("user").alias("__users"))
    pairs = pool.withColumn("__blk", F.explode(F.sequence(F.lit(0), n - 1))).join(packed, "__blk")
    pairs = pairs.withColumn("user", F.explode("__users")).drop("__blk", "__users")
    return pairs.join(seen.select("user", "item").distinct(), ["user", "item"], "left_anti")


# --- score shaping --------------------------------------------------------------------------

def minmax(value: Column, group: Sequence[str], df: DataFrame, out: str) -> DataFrame:
    """(x - min)/(max - min + 1e-8) per group, 0 where the group is constant; null keys are a group. Borders come
    from a partial aggregate joined back, not from a window over the whole group."""
    work = df.withColumn("__x", value)
    if group:
        ends = work.groupBy(*group).agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
        same = F.lit(True)
        for i, g in enumerate(group):
            ends = ends.withColumnRenamed(g, f"__k{i}")
            same = same & F.col(g).eqNullSafe(F.col(f"__k{i}"))
        work = work.join(ends, same).drop(*[f"__k{i}" for i in range(len(group))])
        lo, hi = F.col("__lo"), F.col("__hi")
    else:
        e = work.agg(F.struct(F.min("__x").alias("lo"), F.max("__x").alias("hi"))).scalar()
        lo, hi = e["lo"], e["hi"]
    scaled = F.when(hi > lo, (F.col("__x") - lo) / (hi - lo + 1e-8)).otherwise(0.0)
    return work.withColumn(out, scaled).drop("__x", "__lo", "__hi")


def popularity_blend(df: DataFrame, rel: str, pop: str, w: float, group: Sequence[str] = (), out: str = "blend") -> DataFrame:
    a = minmax(F.col(rel).cast("double"), group, materialise(df), "__r")
    b = minmax(F.col(pop).cast("double"), group, a, "__p")
    mixed = b.withColumn("__m", F.col("__r") * (1.0 - w) + F.col("__p") * w)
    return minmax(F.col("__m"), group, mixed, out).drop("__r", "__p", "__m")


def candidate_cut(candidates: DataFrame, meta: DataFrame, m: int | None, group: Sequence[str], item: str, rel: str) -> DataFrame:
    """Candidates with metadata, the best m per group."""
    known = candidates.join(meta.select(item).distinct(), item, "left_semi")
    if m is None:
        return known
    return top_per_group(known, group, [F.desc(rel), F.asc(item)], m)


# Address suffixes that end a district name.
DISTRICT_SUFFIXES = ("구", "군", "시")


def region_label(address: str | Column, suffixes: Sequence[str] = DISTRICT_SUFFIXES) -> Column:
    """First two address words if the second ends in the district suffix, else the part up to a
    word stem with any of the suffixes, else the first word; "unknown" without address."""
    a = F.col(address) if isinstance(address, str) else address
    words = F.split(F.trim(a), r"\s+")
    second = F.get(words, F.lit(1))
    stems = "|".join(rf"\S+{s}" for s in suffixes)
    match = F.regexp_extract(a, rf"^(\S+)\s+({stems})", 0)
    return (
        F.when(a.isNull() | (a == ""), "unknown")
        .when(second.endswith(suffixes[0]), F.concat_ws(" ", F.get(words, F.lit(0)), second))
        .when(match != "", match)
        .otherwise(F.get(words, F.lit(0)))
    )


def coverage_labels(category: str, region: Column) -> Column:
    return F.array(F.concat(F.lit("category:"), F.coalesce(category, F.lit("nan"))), F.concat(F.lit("region:"), region))


def within_quota(df: DataFrame, group: Sequence[str], label: str, order: Sequence[Column], quota: int) -> DataFrame:
    """Greedy quota: only the best `quota` rows of every label stay."""
    return top_per_group(df, [*group, label], order, quota)


# --- maximal marginal relevance -------------------------------------------------------------

MMR = dict(lambda_div=0.55, w_cat=0.5, w_geo=0.5, tau_km=2.0, step=0.05)
SCORE_DIGITS = 9


def _relevance() -> Column:
    return F.when(~F.isnan("rel"), F.col("rel")).alias("rel")


def mmr_bounded(
    df: DataFrame, group: str, k: int, top_m: int, frozen: int = 0, penalty: bool = True,
    coverage_max: dict[str, int] | None = None, coverage_min: dict[str, int] | None = None,
    lambda_div: float = 0.55, w_cat: float = 0.5, w_geo: float = 0.5, tau_km: float = 2.0, step: float = 0.05,
) -> DataFrame:
    """Greedy diversity re-ranking of the top_m candidates per group.

    df: (group, item, rel in [0,1], cat, lat, lon, labels). The cut to top_m happens before the
    groups are formed, so a Python group holds at most top_m rows. Returns (group, item, pos).

    A missing category is like no other, a missing coordinate is near nothing, missing labels count
    for no quota, a missing relevance ranks last, and rows without a group are one group.
    """
    labs = sorted({*(coverage_max or {}), *(coverage_min or {})})
    most = np.array([(coverage_max or {}).get(lab, np.inf) for lab in labs])
    least = np.array([(coverage_min or {}).get(lab, 0) for lab in labs])
    cands = df.select(group, "item", _relevance(), "cat", "lat", "lon", "labels")
    cut = top_per_group(cands, [group], [F.desc("rel"), F.asc("item")], top_m).select(group, "item", "rel", "cat", "lat", "lon", "labels")

    # Task functions carry all they need: executors have NumPy and pandas, not this package.
    radius = geo.EARTH_RADIUS_KM

    def one_group(pdf: pd.DataFrame) -> pd.DataFrame:
        """The places of `mmr_stepwise`, on arrays: rows in item order, so that the first best wins ties."""
        pdf = pdf.sort_values("item")
        ids, rel, kind = pdf["item"].to_numpy(np.int64), pdf["rel"].to_numpy(float), pd.factorize(pdf["cat"])[0]
        la, lo = np.radians(pdf["lat"].to_numpy(float)), np.radians(pdf["lon"].to_numpy(float))
        has = np.array([[lab in set(() if ls is None else ls) for lab in labs] for ls in pdf["labels"]], bool).reshape(ids.size, len(labs))
        sim, rest, picks = np.zeros(ids.size), np.arange(ids.size), []
        for place in range(k):
            have = has[picks].sum(axis=0)
            open_rows = rest if place < frozen else rest[~(has[rest] & (have >= most)).any(axis=1)]
            if not open_rows.size:
                break
            gain = rel[open_rows]
            if place >= frozen:
                s = sim[open_rows]
                bonus = has[open_rows] @ (np.maximum(least - have, 0) * step)
                gain = np.round(lambda_div * gain - (1.0 - lambda_div) * (s - s.min()) / (np.ptp(s) + 1e-8) + bonus, SCORE_DIGITS)
            best = open_rows[np.argmax(np.where(np.isnan(gain), -np.inf, gain))]
            picks.append(best)
            rest = rest[rest != best]
            if penalty:
                h = np.sin((la - la[best]) / 2) ** 2 + np.cos(la) * np.cos(la[best]) * np.sin((lo - lo[best]) / 2) ** 2
                near = np.nan_to_num(np.exp(-2 * radius * np.arcsin(np.minimum(1.0, np.sqrt(h))) / tau_km), nan=0.0)
                sim = np.maximum(sim, w_cat * ((kind == kind[best]) & (kind >= 0)) + w_geo * near)
        return pd.DataFrame({group: pdf[group].iloc[0], "item": ids[picks], "pos": np.arange(1, len(picks) + 1)})

    kind_of = df.schema[group].dataType.simpleString()
    return cut.groupBy(group).applyInPandas(one_group, f"{group} {kind_of}, item long, pos int")


# Groups up to this size are re-ranked inside one Python group each; larger ones stepwise, with equal lists.
SMALL_GROUP = 5000


def mmr_rerank(df: DataFrame, group: str, k: int, top_m: int | None = None, **params) -> DataFrame:
    """Greedy diversity re-ranking. `top_m` cuts the candidates as part of the method; without it
    all candidates compete, whatever the group size."""
    if top_m is not None:
        return mmr_bounded(df, group, k, top_m, **params)
    df = materialise(df)
    largest = df.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= SMALL_GROUP:
        return mmr_bounded(df, group, k, SMALL_GROUP, **params)
    return mmr_stepwise(df, group, k, **params)


def mmr_stepwise(
    df: DataFrame, group: str, k: int, frozen: int = 0, penalty: bool = True,
    coverage_max: dict[str, int] | None = None, coverage_min: dict[str, int] | None = None,
    lambda_div: float = 0.55, w_cat: float = 0.5, w_geo: float = 0.5, tau_km: float = 2.0, step: float = 0.05,
) -> DataFrame:
    """The same re-ranking over all candidates of groups of any size, with the same rules for
    missing values.

    Each of the k places is one distributed aggregate over the remaining candidates and an update
    of their similarity to the new pick; no task ever holds a group.
    """
    cmax, cmin = coverage_max or {}, coverage_min or {}
    labs = sorted({*cmax, *cmin})
    marks = [F.coalesce(F.array_contains("labels", lab).cast("int"), F.lit(0)).alias(f"__l{i}") for i, lab in enumerate(labs)]
    # Inside a struct a null group equals itself, so plain joins keep it.
    state = df.select(F.struct(group).alias("__g"), "item", _relevance(), "cat", "lat", "lon", *marks)
    # Written tables, no checkpoints: those hand on size estimates that joins multiply, longer with every place.
    state = materialise(state.withColumn("sim", F.lit(0.0)))
    counts = materialise(state.select("__g").distinct().select("__g", *[F.lit(0).alias(f"__c{i}") for i in range(len(labs))])) if labs else None
    result = None
    for pos in range(1, k + 1):
        open_rows = state.join(counts, "__g") if labs else state
        for lab, most in cmax.items() if pos > frozen else ():
            i = labs.index(lab)
            open_rows = open_rows.where((F.col(f"__c{i}") < most) | (F.col(f"__l{i}") == 0))
        ends = open_rows.groupBy("__g").agg(F.min("sim").alias("__lo"), F.max("sim").alias("__hi"))
        far = F.when(F.col("__hi") > F.col("__lo"), (F.col("sim") - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + 1e-8)).otherwise(0.0)
        bonus = F.lit(0.0)
        for lab, least in cmin.items():
            i = labs.index(lab)
            bonus = bonus + F.col(f"__l{i}") * F.greatest(F.lit(least) - F.col(f"__c{i}"), F.lit(0)) * F.lit(step)
        gain = F.round(F.lit(lambda_div) * F.col("rel") - F.lit(1.0 - lambda_div) * far + bonus, SCORE_DIGITS)
        if pos <= frozen:
            gain = F.col("rel")
        best = open_rows.join(ends, "__g").groupBy("__g").agg(
            F.max_by(
                F.struct("item", "cat", "lat", "lon", *[f"__l{i}" for i in range(len(labs))]),
                F.struct(gain.alias("g"), (-F.col("item")).alias("i")),
            ).alias("b")
        )
        best = materialise(best)
        if best.isEmpty():
            break
        picked = best.select("__g", F.col("b.item").alias("item"), F.lit(pos).alias("pos"))
        result = picked if result is None else result.unionByName(picked)
        if pos == k:
            break
        joined = state.join(best, "__g", "left")
        near = F.exp(-geo.haversine_km(F.col("b.lat"), F.col("b.lon"), F.col("lat"), F.col("lon")) / F.lit(tau_km))
        near = F.coalesce(F.nanvl(near, F.lit(0.0)), F.lit(0.0))
        like = F.lit(w_cat) * F.coalesce((F.col("cat") == F.col("b.cat")).cast("double"), F.lit(0.0)) + F.lit(w_geo) * near
        new_sim = F.when(F.col("b").isNull() | F.lit(not penalty), F.col("sim")).otherwise(F.greatest("sim", like))
        kept = joined.where(F.col("b").isNull() | (F.col("item") != F.col("b.item")))
        before, state = state, materialise(kept.withColumn("sim", new_sim).drop("b"))
        release(before)
        if not labs:
            continue
        before, counts = counts, materialise(counts.join(best, "__g", "left").select(
            "__g", *[(F.col(f"__c{i}") + F.coalesce(F.col(f"b.__l{i}"), F.lit(0))).alias(f"__c{i}") for i in range(len(labs))]
        ))
        release(before)
    if result is None:
        result = state.select("__g", "item", F.lit(0).alias("pos")).where("false")
    return result.select(F.col("__g").getField(group).alias(group), "item", "pos")


# --- hidden gems ----------------------------------------------------------------------------

def hotspots(df: DataFrame, region: str, lat: str, lon: str, n: int = 10, rounds: int = 10, seed: str = "hot") -> DataFrame:
    """n centres per region by Lloyd's rounds, all regions at once: (region, centres).

    Centres travel as one short array per region; points look up the nearest one in it and are
    averaged with partial sums, so a region may hold any number of points.
    """
    pts = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(region, F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    pts = cut_lineage(pts)
    big = pts.groupBy(region).agg(F.count("*").alias("__n")).where("__n >= 2").select(region)
    start = top_per_group(
        pts.join(big, region, "left_semi").distinct().withColumn("__h", hash_int(seed, F.col("lat"), F.col("lon"))),
        [region], [F.asc("__h"), F.asc("lat"), F.asc("lon")], n,
    )
    pack = F.array_sort(F.collect_list(F.struct("lat", "lon"))).alias("centres")
    centres = cut_lineage(start.groupBy(region).agg(pack))
    for _ in range(rounds):
        dist = F.transform("centres", lambda c: (c["lat"] - F.col("lat")) ** 2 + (c["lon"] - F.col("lon")) ** 2)
        own = pts.join(centres, region).withColumn("__c", F.array_position(dist, F.array_min(dist)))
        means = own.groupBy(region, "__c").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
        moved = cut_lineage(means.groupBy(region).agg(pack))
        shift = moved.join(centres.withColumnRenamed("centres", "__old"), region).where(F.col("centres") != F.col("__old"))
        centres = moved
        if shift.isEmpty():
            break
    return centres


def periphery_bonus(df: DataFrame, region: str, lat: str, lon: str, centres: DataFrame | Sequence[tuple[float, float]], strength: float, cap: float) -> DataFrame:
    """Distance to the nearest centre, scaled per region, times strength, clipped to [0, cap]; 0 for places without
    coordinates and in regions without a centre."""
    if isinstance(centres, DataFrame):
        work = df.join(centres, region, "left")
        dmin = F.array_min(F.transform("centres", lambda c: geo.haversine_km(c["lat"], c["lon"], F.col(lat), F.col(lon))))
        work = work.withColumn("__d", dmin).drop("centres")
    else:
        dists = [geo.haversine_km(a, b, lat, lon) for a, b in centres]
        work = df.withColumn("__d", F.least(*dists) if len(dists) > 1 else dists[0])
    out = minmax(F.col("__d"), [region], work, "__n")
    near = F.coalesce("__n", F.lit(0.0))  # least() would pass over a null and give the cap
    bonus = F.greatest(F.lit(0.0), F.least(near * strength, F.lit(cap)))
    return out.withColumn("periphery_bonus", bonus).drop("__d", "__n")


def rating_and_recency(df: DataFrame, rating: str, recent: str, rating_weight: float = 0.2, recent_weight: float = 0.3) -> DataFrame:
    x, y = F.col(rating).cast("double"), F.col(recent).cast("double")
    ends = df.agg(F.struct(F.min(x).alias("xl"), F.max(x).alias("xh"), F.min(y).alias("yl"), F.max(y).alias("yh"))).scalar()

    def bonus(value: Column, lo: Column, hi: Column, weight: float) -> Column:
        return F.coalesce(F.when(hi > lo, (value - lo) / (hi - lo + 1e-8)), F.lit(0.0)) * weight

    return df.withColumn("rating_bonus", bonus(x, ends["xl"], ends["xh"], rating_weight)).withColumn(
        "recent_bonus", bonus(y, ends["yl"], ends["yh"], recent_weight)
    )


def hidden_input(diner: DataFrame, review: DataFrame, as_of: str, item: str = "diner_idx") -> DataFrame:
    """Items with their mean rating and number of reviews in the 30 days before `as_of`."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("review_date"))
    stats = review.groupBy(item).agg(F.avg("score").alias("avg_rating"), F.count_if(age <= 30).alias("recent_review_count"))
    return diner.join(stats, item, "left")


def hidden_scores(
    df: DataFrame, base: str, centres: DataFrame | Sequence[tuple[float, float]], strength: float = 0.5, cap: float = 0.5,
    rating_weight: float = 0.2, recent_weight: float = 0.3, region: str = "region",
) -> DataFrame:
    out = periphery_bonus(materialise(df), region, "lat", "lon", centres, strength, cap)
    out = rating_and_recency(out, "avg_rating", "recent_review_count", rating_weight, recent_weight)
    return out.withColumn(
        "hidden_score", F.col(base) + F.col("periphery_bonus") + F.col("rating_bonus") + F.col("recent_bonus")
    )


def hidden_rerank(scored: DataFrame, k: int, group: str = "region", top_m: int | None = None, **mmr) -> DataFrame:
    """Diversity re-ranking by hidden score per group, with all bonus columns."""
    scored = materialise(scored)
    rel = minmax(F.col("hidden_score"), [group], scored, "rel")
    cands = rel.select(
        group, F.col("diner_idx").alias("item"), "rel", F.col("large").alias("cat"), "lat", "lon",
        coverage_labels("large", F.col("region")).alias("labels"),
    )
    picked = mmr_rerank(cands, group, k, top_m, **mmr)
    picked = picked.select(F.col(group).alias("__g"), F.col("item").alias("__i"), "pos")
    scored = scored.withColumnRenamed("diner_idx", "item")
    return picked.join(scored, F.col("__g").eqNullSafe(F.col(group)) & (F.col("__i") == F.col("item"))).drop("__g", "__i")


def target_region(df: DataFrame, wanted: str, region: str = "region") -> DataFrame:
    """Rows of one region, or all rows when that region has none."""
    n = df.where(F.col(region) == wanted).agg(F.count("*")).scalar()
    return df.where((F.col(region) == wanted) | (n == 0))


def experiment_scores(ranked: DataFrame, top_n: int, threshold: float) -> DataFrame:
    """Per (dataset, experiment): share of high ratings in each region's first n, combined with
    the periphery parameters. ranked: (dataset, exp, strength, cap, region, pos, avg_rating)."""
    first = ranked.where(F.col("pos") <= top_n)
    return first.groupBy("dataset", "exp", "strength", "cap").agg(
        F.count_if(F.col("avg_rating") >= threshold).alias("high"), F.count_distinct("region").alias("regions")
    ).select(
        "dataset", "exp", "high", "regions",
        (F.col("high") / (F.col("regions") * top_n)).alias("high_share"),
        (F.col("high") / (F.col("regions") * top_n) * 0.6 + (F.col("strength") + F.col("cap")) * 0.4).alias("combined"),
    )


def best_experiment(scores: DataFrame) -> DataFrame:
    key = F.struct(F.round("combined", 9).alias("c"), (-F.col("exp")).alias("e"))
    return scores.groupBy("dataset").agg(F.max_by(F.struct("exp", "high_share", "combined"), key).alias("b")).select("dataset", "b.*")


def compare_lists(a: DataFrame, b: DataFrame, group: Sequence[str], k: int) -> DataFrame:
    """Overlap of the first k items and the first place where the lists differ."""
    x = a.where(F.col("pos") <= k).select(*group, F.col("pos").alias("pa"), "item")
    y = b.where(F.col("pos") <= k).select(*group, F.col("pos").alias("pb"), "item")
    both = x.join(y, [*group, "item"], "full_outer")
    # An item alone on one side, or at different places, marks a difference at its lower place.
    differ = F.when(~F.col("pa").eqNullSafe(F.col("pb")), F.least("pa", "pb"))
    return both.groupBy(*group).agg(
        F.count_if(F.col("pa").isNotNull() & F.col("pb").isNotNull()).alias("overlap"), F.min(differ).alias("first_diff")
    )


def grid(params: dict[str, Iterable]) -> list[dict]:
    """Every combination of the listed parameter values."""
    combos: list[dict] = [{}]
    for name, values in params.items():
        combos = [{**c, name: v} for c in combos for v in values]
    return combos


def coverage_bonus(cands: DataFrame, chosen: DataFrame, group: str, minimum: dict[str, int], step: float = 0.05) -> DataFrame:
    """Sum over labels of (missing places x step), given what is already chosen per group."""
    labs = list(minimum)
    have = chosen.groupBy(group).agg(*[F.count_if(F.array_contains("labels", lab)).alias(f"__c{i}") for i, lab in enumerate(labs)])
    bonus = F.lit(0.0)
    for i, lab in enumerate(labs):
        missing = F.greatest(F.lit(minimum[lab]) - F.coalesce(F.col(f"__c{i}"), F.lit(0)), F.lit(0))
        bonus = bonus + F.array_contains("labels", lab).cast("int") * missing * F.lit(step)
    return cands.join(have, group, "left").withColumn("bonus", bonus).drop(*[f"__c{i}" for i in range(len(labs))])
