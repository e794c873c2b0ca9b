"""Ranking metrics per user and rolled up by user type."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from savora.functions.ordering import bucket_of, prefix_sums, splitters
from savora.session import shuffled


def liked_counts(liked: DataFrame, user: str = "user") -> DataFrame:
    """#liked per user; a pair liked twice counts twice."""
    return liked.groupBy(user).agg(F.count("*").alias("m"))


def liked_places(liked: DataFrame, order: Sequence[str], user: str = "user") -> DataFrame:
    """Liked rows with their place in the user's list and its length, in long form: no list is
    collected, so a user may like any number of items."""
    cuts = splitters(liked, F.col(order[0]))
    ranked = prefix_sums(
        liked, [user], bucket_of(F.col(order[0]), cuts), [F.col(c) for c in order], {"place": F.lit(1).cast("long")}, totals=True
    )
    return ranked.withColumn("place", F.col("place") + 1).withColumnRenamed("place_total", "m")


def find_hits(recs: DataFrame, liked: DataFrame, user: str = "user", item: str = "item") -> DataFrame:
    """Recommended pairs that are liked, with their position. Only hits travel further."""
    return recs.select(user, item, "pos").join(liked.select(user, item).distinct(), [user, item], "left_semi")


def list_hits(top: DataFrame, liked: DataFrame, user: str = "user", item: str = "item") -> DataFrame:
    """Hits when every user gets the same list: one join on the item, no user x list product."""
    return liked.select(user, item).distinct().join(top.select(item, "pos"), item).select(user, item, "pos")


def ideal_gain(m: Column, k: int) -> Column:
    """Best reachable gain for m liked items in k places."""
    sums, total = [], 0.0
    for i in range(1, k + 1):
        total += 1.0 / math.log2(i + 1)
        sums.append(total)
    return F.element_at(F.array(*[F.lit(s) for s in sums]), F.least(m, F.lit(k)).cast("int"))


def per_user(hits: DataFrame, counts: DataFrame, ks: Sequence[int], user: str = "user") -> DataFrame:
    """recall, AP and NDCG for every user and k in long form; users without a hit score 0."""
    ranked = hits.where(F.col("pos") <= max(ks)).withColumn(
        "hit_no", F.row_number().over(W.partitionBy(user).orderBy("pos"))
    )
    inside = {k: F.col("pos") <= k for k in ks}
    sums = ranked.groupBy(user).agg(
        *[F.sum(F.when(inside[k], 1.0).otherwise(0.0)).alias(f"h{k}") for k in ks],
        *[F.sum(F.when(inside[k], F.col("hit_no") / F.col("pos")).otherwise(0.0)).alias(f"a{k}") for k in ks],
        *[F.sum(F.when(inside[k], 1.0 / F.log2(F.col("pos") + 1.0)).otherwise(0.0)).alias(f"d{k}") for k in ks],
    )
    full = counts.join(sums, user, "left").fillna(0.0, subset=[f"{c}{k}" for c in "had" for k in ks])
    entries = F.array(
        *[
            F.struct(
                F.lit(k).alias("k"),
                (F.col(f"h{k}") / F.col("m")).alias("recall"),
                (F.col(f"a{k}") / F.col("m")).alias("map"),
                (F.col(f"d{k}") / ideal_gain(F.col("m"), k)).alias("ndcg"),
            )
            for k in ks
        ]
    )
    return full.select(user, "m", F.inline(entries))


def roll_up(metrics: DataFrame, user_types: DataFrame, user: str = "user") -> DataFrame:
    """Mean metrics per user type and over all users."""
    typed = metrics.join(user_types.select(user, "user_type"), user)
    out = typed.groupingSets([["user_type", "k"], ["k"]], "user_type", "k").agg(
        F.avg("map").alias("map"), F.avg("ndcg").alias("ndcg"), F.avg("recall").alias("recall"), F.count("*").alias("count")
    )
    return out.select(
        F.coalesce("user_type", F.lit("all")).alias("user_type"), "k",
        *[F.round(c, 6).alias(c) for c in ("map", "ndcg", "recall")], "count",
    )


def spread_list(top: DataFrame, users: DataFrame, k: int, user: str = "user", item: str = "item") -> DataFrame:
    """The same k items for every user, from a list of k entries carried as one value."""
    packed = top.where(F.col("pos") <= k).agg(
        F.sort_array(F.collect_list(F.struct("pos", item)))
    ).scalar()
    return users.select(user, F.inline(packed))


def rank_precision(pos: Column, k: int) -> Column:
    """(k - i)/k for the item found at 0-based place i of the first k, else 0."""
    return F.when((pos >= 1) & (pos <= k), (F.lit(k) - (pos - 1)) / F.lit(float(k))).otherwise(0.0)


def drop_seen(recs: DataFrame, seen: DataFrame, user: str = "user", item: str = "item") -> DataFrame:
    """Lists without already seen items, places closed up."""
    left = recs.join(shuffled(seen.select(user, item).distinct()), [user, item], "left_anti")
    return left.withColumn("pos", F.row_number().over(W.partitionBy(user).orderBy("pos")))


def metric_history(history: DataFrame | None, epoch: int, rolled: DataFrame) -> DataFrame:
    row = rolled.select(F.lit(epoch).alias("epoch"), "*")
    return row if history is None else history.unionByName(row)


def metric_report(history: DataFrame, max_short: int = 20, min_long: int = 100) -> DataFrame:
    """map and ndcg for short lists, recall for long candidate lists."""
    short = history.where(F.col("k") <= max_short).select(
        "epoch", "user_type", "k", F.inline(F.array(
            F.struct(F.lit("map").alias("metric"), F.col("map").alias("value")),
            F.struct(F.lit("ndcg").alias("metric"), F.col("ndcg").alias("value")))))
    long = history.where(F.col("k") >= min_long).select("epoch", "user_type", "k", F.lit("recall").alias("metric"), F.col("recall").alias("value"))
    return short.unionByName(long)


def squared_error(pairs: DataFrame, actual: str, predicted: str) -> DataFrame:
    e = F.col(actual) - F.col(predicted)
    return pairs.agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"))


def pad_lists(recs: DataFrame, users: DataFrame, k: int, user: str = "user", item: str = "item") -> DataFrame:
    """Exactly k places per user, item -1 where the list is too short."""
    places = users.select(user, F.explode(F.sequence(F.lit(1), F.lit(k))).alias("pos"))
    return places.join(shuffled(recs.select(user, "pos", item)), [user, "pos"], "left").fillna(-1, subset=[item])


def qualitative(recs: DataFrame, items: DataFrame, liked: DataFrame, user: str = "user", item: str = "item") -> DataFrame:
    """Recommended items with their attributes and whether the user likes them; items outside
    the given (e.g. nearby) table drop out."""
    hits = liked.select(user, item).distinct().withColumn("__h", F.lit(1))
    return recs.join(items, item).join(hits, [user, item], "left").withColumn("hit", F.coalesce("__h", F.lit(0))).drop("__h")


def ndcg_at_own_length(hits: DataFrame, counts: DataFrame, user: str = "user") -> DataFrame:
    """NDCG of lists as long as the liked list, so the ideal sum runs over m places."""
    gain = hits.groupBy(user).agg(F.sum(1.0 / F.log2(F.col("pos") + 1.0)).alias("dcg"))
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.col("m").cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i.cast("double") + 1.0)
    )
    return counts.join(gain, user, "left").select(user, (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))
