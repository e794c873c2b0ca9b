"""Item-item and user-user neighbourhood recommendation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from savora.operators.blocks import SLICE, heavy_pair_sums, sliced_join
from savora.operators.ids import id_mapping
from savora.operators.popularity import top_per_group
from savora.session import materialise

HEAVY_USER = 500


def interactions(review: DataFrame, user: str = "reviewer_id", item: str = "diner_idx", score: str = "score") -> DataFrame:
    """Rating matrix in long form; repeated ratings of a pair are summed."""
    return review.groupBy(F.col(user).alias("user"), F.col(item).alias("item")).agg(F.sum(score).cast("double").alias("r"))


def item_pairs(inter: DataFrame, heavy_user: int = HEAVY_USER, **block_sizes: int) -> DataFrame:
    """Item pairs rated by a common user: (a, b, co, cosine, jaccard) with a < b.

    Users with at most `heavy_user` items are joined with themselves, which turns a rating into
    at most that many rows. Longer lists would grow quadratically in one join key; their pair
    sums come from bounded block products instead. Both parts are exact and add up.
    """
    inter = materialise(inter)
    norms = inter.groupBy("item").agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("norm"), F.count("*").alias("deg"))
    unit = inter.join(norms, "item").select("user", "item", (F.col("r") / F.col("norm")).alias("value"), "deg")
    sizes = inter.groupBy("user").agg(F.count("*").alias("__n"))
    sized = materialise(unit.join(sizes, "user"))
    light = sized.where(F.col("__n") <= heavy_user)
    x = light.select("user", F.col("item").alias("a"), F.col("value").alias("va"))
    y = light.select(F.col("user").alias("u2"), F.col("item").alias("b"), F.col("value").alias("vb"))
    pairs = (
        x.join(y, (F.col("user") == F.col("u2")) & (F.col("a") < F.col("b"))).groupBy("a", "b")
        .agg(F.count("*").alias("co"), F.sum(F.col("va") * F.col("vb")).alias("dot"))
    )
    long_lists = sized.where(F.col("__n") > heavy_user).select("user", "item", "value")
    if not long_lists.isEmpty():
        pairs = pairs.unionByName(heavy_pair_sums(long_lists, **block_sizes)).groupBy("a", "b").agg(
            F.sum("co").alias("co"), F.sum("dot").alias("dot")
        )
    both = pairs.withColumnRenamed("dot", "cosine")
    da = norms.select(F.col("item").alias("a"), F.col("deg").alias("da"))
    db = norms.select(F.col("item").alias("b"), F.col("deg").alias("db"))
    return both.join(da, "a").join(db, "b").select(
        "a", "b", "co", "cosine", (F.col("co") / (F.col("da") + F.col("db") - F.col("co"))).alias("jaccard")
    )


def both_directions(pairs: DataFrame, method: str = "cosine") -> DataFrame:
    """(target, item, sim) for either order of each pair; an unknown method means cosine."""
    col = "jaccard" if method == "jaccard" else "cosine"
    sim = F.round(F.col(col), 9)
    return pairs.select(
        F.inline(F.array(F.struct(F.col("a").alias("target"), F.col("b").alias("item"), sim.alias("sim")),
                         F.struct(F.col("b").alias("target"), F.col("a").alias("item"), sim.alias("sim"))))
    )


def similar_items(sims: DataFrame, k: int, targets: DataFrame | None = None) -> DataFrame:
    """Top-k neighbours per target; unknown targets have none."""
    if targets is not None:
        sims = sims.join(targets.select("target").distinct(), "target", "left_semi")
    return top_per_group(sims, ["target"], [F.desc("sim"), F.asc("item")], k, rank="pos")


def content_similarity(pairs: DataFrame, category: DataFrame | None, item: str = "diner_idx", label: str = "large") -> DataFrame:
    """1 for the same category, 0 for another or an unknown one."""
    if category is None:
        return pairs.withColumn("content", F.lit(0.0))
    t = category.select(F.col(item).alias("target"), F.col(label).alias("__lt"))
    i = category.select(F.col(item).alias("item"), F.col(label).alias("__li"))
    same = F.coalesce((F.col("__lt") == F.col("__li")).cast("double"), F.lit(0.0))
    return pairs.join(t, "target", "left").join(i, "item", "left").withColumn("content", same).drop("__lt", "__li")


def hybrid_similar(
    sims: DataFrame, category: DataFrame | None, k: int, cf_weight: float = 0.8, content_weight: float = 0.2
) -> DataFrame:
    """Mix of rating and content similarity over the 3k nearest by rating, cut to k."""
    total = cf_weight + content_weight
    if total > 0:
        cf_weight, content_weight = cf_weight / total, content_weight / total
    near = similar_items(sims, 3 * k).drop("pos")
    mixed = content_similarity(near, category if content_weight > 0 else None).withColumn(
        "hybrid", F.round(F.col("sim") * cf_weight + F.col("content") * content_weight, 9)
    )
    return top_per_group(mixed, ["target"], [F.desc("hybrid"), F.asc("item")], k, rank="pos")


def recommend_for_users(inter: DataFrame, sims: DataFrame, k: int, pad: bool = True, users: DataFrame | None = None, slice_size: int = SLICE) -> DataFrame:
    """Similarity-weighted mean of the user's ratings for every unseen item. With `users` only
    theirs are read. Ratings of popular items are joined in slices.

    Items without any similar rated one predict 0; they fill lists that would stay short, by
    lowest id, as in a dense score vector.
    """
    near = sims.select(F.col("target").alias("item"), F.col("item").alias("cand"), "sim").where(F.col("sim") > 0)
    known = inter
    if users is not None:
        inter = materialise(inter.join(users.select("user").distinct(), "user", "left_semi"))
    votes = sliced_join(inter, near, "item", slice_size).groupBy("user", "cand").agg(
        F.sum(F.col("r") * F.col("sim")).alias("num"), F.sum(F.abs("sim")).alias("den")
    )
    seen = inter.select("user", F.col("item").alias("cand"))
    pred = F.round(F.col("num") / F.greatest(F.col("den"), F.lit(1e-12)), 6)
    reached = votes.join(seen, ["user", "cand"], "left_anti").select("user", F.col("cand").alias("item"), pred.alias("pred"))
    top = top_per_group(reached, ["user"], [F.desc("pred"), F.asc("item")], k)
    if pad:
        top = top.unionByName(_padding(inter, known, top, k))
    return top_per_group(top, ["user"], [F.desc("pred"), F.asc("item")], k, rank="pos")


def _padding(inter: DataFrame, known: DataFrame, top: DataFrame, k: int) -> DataFrame:
    """Enough lowest-id items for short lists: at most k + #seen of the first ids can be taken or
    seen, so that many always contain the missing ones."""
    have = top.groupBy("user").agg(F.count("*").alias("__have"))
    seen_n = inter.groupBy("user").agg(F.count("*").alias("__seen"))
    short = seen_n.join(have, "user", "left").fillna(0, subset=["__have"]).where(F.col("__have") < k)
    items = id_mapping(known, "item", "__idx")
    pool = short.select("user", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__seen") + F.lit(k - 1))).alias("__idx"))
    taken = inter.select("user", "item").unionByName(top.select("user", "item"))
    return pool.join(items, "__idx").join(taken, ["user", "item"], "left_anti").select("user", "item", F.lit(0.0).alias("pred"))


def save_all_similar(inter: DataFrame, sims: DataFrame, category: DataFrame | None, k: int, min_interactions: float) -> DataFrame:
    """Top-k similar items for every item with interaction sum above 1, among items with enough
    interactions and positive score; 5k are asked for before the cut."""
    sums = inter.groupBy("item").agg(F.sum("r").alias("__s"))
    targets = sums.where(F.col("__s") > 1).select(F.col("item").alias("target"))
    good = sums.where(F.col("__s") >= min_interactions).select("item")
    asked = hybrid_similar(sims.join(targets, "target", "left_semi"), category, 5 * k).drop("pos")
    kept = asked.where(F.col("hybrid") > 0).join(good, "item", "left_semi")
    return top_per_group(kept, ["target"], [F.desc("hybrid"), F.asc("item")], k, rank="pos").withColumn(
        "score", F.floor(F.col("hybrid") * 100 + 0.5) / 100
    )


def lookup_similar(inter: DataFrame, sims: DataFrame, targets: DataFrame, k: int, min_interactions: float) -> DataFrame:
    """Neighbours with similarity above 1e-4 among the nearest 5k; those with enough
    interactions if there are any, else all."""
    sums = inter.groupBy("item").agg((F.sum("r") >= min_interactions).cast("int").alias("good"))
    near = similar_items(sims, 5 * k, targets).drop("pos").where(F.col("sim") > 0.0001).join(sums, "item")
    best = near.groupBy("target").agg(F.max("good").alias("__best"))
    kept = near.join(best, "target").where(F.col("good") == F.col("__best")).drop("__best")
    return top_per_group(kept, ["target"], [F.desc("sim"), F.asc("item")], k, rank="pos")


def similar_statistics(result: DataFrame, targets: DataFrame) -> DataFrame:
    n = targets.select("target").distinct().agg(F.count("*")).scalar()
    return result.agg(F.count("*").alias("pairs"), F.avg("score").alias("mean_score")).select(
        "pairs", F.round(F.try_divide(F.col("pairs"), n), 6).alias("mean_per_target"), F.round("mean_score", 6).alias("mean_score")
    )


def nearest_warm_user(inter: DataFrame, liked: DataFrame, method: str = "cosine", slice_size: int = SLICE) -> DataFrame:
    """Most similar warm user for each cold user's liked list (cold, item, r).

    Cosine ties go to the user with fewer items, Jaccard ties to the larger overlap, then to the
    lower id. A list that meets no warm user has no row. Lists meet in slices of a popular item.
    """
    warm = inter.groupBy("user").agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("wn"), F.count("*").alias("wc"))
    cold = liked.groupBy("cold").agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("cn"), F.count("*").alias("cc"))
    meet = (
        sliced_join(inter.select("user", "item", "r"), liked.select("cold", "item", F.col("r").alias("cr")), "item", slice_size).groupBy("cold", "user")
        .agg(F.sum(F.col("cr") * F.col("r")).alias("dot"), F.count("*").alias("co"))
        .join(warm, "user").join(cold, "cold")
    )
    if method == "jaccard":
        sim = F.col("co") / (F.col("wc") + F.col("cc") - F.col("co"))
        order: Sequence[Column] = [F.desc("sim"), F.desc("co"), F.asc("user")]
    elif method == "cosine":
        sim = F.col("dot") / (F.col("wn") * F.col("cn"))
        order = [F.desc("sim"), F.asc("wc"), F.asc("user")]
    else:
        raise ValueError(f"unknown method {method}")
    return top_per_group(meet.withColumn("sim", F.round(sim, 6)), ["cold"], order, 1).select("cold", "user", "sim", "co")
