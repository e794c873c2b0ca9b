"""Negative sampling without a user x item product.

Negatives are drawn by hash as dense places in the item list, several per wanted one; seen and
repeated draws fall out. Only users for whom that leaves too few, those who know most of the
list, look at the whole list, so results are complete and the work stays linear in the ratings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from savora.functions.hashing import hash_int
from savora.functions.ordering import bucket_of, global_order, prefix_sums, splitters
from savora.operators.ids import id_mapping
from savora.operators.popularity import top_per_group
from savora.session import materialise, shuffled, spread

OVERDRAW = 4


def draw_unseen(wanted: DataFrame, pool: DataFrame, seen: DataFrame, seed: str, most: int, group: Sequence[str] = ()) -> DataFrame:
    """`want` (at most `most`) different unseen items per row of `wanted` (user, [group], want, limit), drawn from
    pool places below `limit`. pool: ([group], idx, item). Returns (user, [group], item, draw). Draws are a multiple of
    the rows that they come from, so each of their shuffles is dealt by their number."""
    group = list(group)
    keys = ["user", *group]
    n_draws = (wanted.where("want > 0 and limit > 0").agg(F.sum("want")).first()[0] or 0) * OVERDRAW
    h = hash_int(seed, *[F.col(k) for k in keys], F.col("j"))
    draws = wanted.where("want > 0 and limit > 0").select(
        *keys, "limit", "want", F.explode(F.sequence(F.lit(0).cast("long"), F.col("want") * OVERDRAW - 1)).alias("j")
    ).withColumn("idx", h % F.col("limit"))
    fresh = (
        spread(shuffled(spread(draws, n_draws, *group, "idx")).join(pool, [*group, "idx"]), n_draws, "user", "item")
        .groupBy(*keys, "want", "item").agg(F.min("j").alias("j"))
        .join(shuffled(seen.select("user", "item")), ["user", "item"], "left_anti")
    )
    got = materialise(
        top_per_group(spread(fresh, n_draws, *keys), keys, [F.asc("j")], most, rank="draw").where("draw <= want").select(*keys, "item", "draw")
    )
    counts = got.groupBy(*keys).agg(F.count("*").alias("n_got"))
    short = wanted.join(shuffled(counts), keys, "left").fillna(0, subset=["n_got"]).where("n_got < want and limit > 0")
    if short.isEmpty():
        return got
    short = materialise(short)
    places = short.select(*keys, "want", "n_got", F.explode(F.sequence(F.lit(0).cast("long"), F.col("limit") - 1)).alias("idx"))
    rest = (
        shuffled(places).join(pool, [*group, "idx"])
        .join(shuffled(seen.select("user", "item")), ["user", "item"], "left_anti")
        .join(shuffled(got.select(*keys, "item")), [*keys, "item"], "left_anti")
        .withColumn("__h", hash_int(seed, F.lit("rest"), F.col("user"), F.col("item")))
    )
    filled = top_per_group(rest, keys, [F.asc("__h"), F.asc("item")], most, rank="__r").where("__r <= want - n_got")
    return got.unionByName(filled.select(*keys, "item", (F.col("n_got") + F.col("__r")).cast("int").alias("draw")))


def fill_with_copies(picked: DataFrame, wanted: DataFrame, seed: str) -> DataFrame:
    """Users with fewer unseen items than wanted repeat some of theirs."""
    counts = picked.groupBy("user").agg(F.count("*").alias("n_got"))
    gaps = wanted.join(shuffled(counts), "user").where("n_got < want")
    if gaps.isEmpty():
        return picked.select("user", "item", "draw")
    gaps = gaps.select(
        "user", "n_got", F.explode(F.sequence(F.col("n_got") + 1, F.col("want").cast("long"))).alias("place")
    )
    again = gaps.withColumn("draw", (hash_int(seed, F.lit("copy"), F.col("user"), F.col("place")) % F.col("n_got") + 1).cast("int"))
    copies = shuffled(again).join(picked, ["user", "draw"]).select("user", "item", F.col("place").cast("int").alias("draw"))
    return picked.select("user", "item", "draw").unionByName(copies)


def _seen(inter: DataFrame) -> DataFrame:
    """Distinct pairs, written once: every step below reads them."""
    return materialise(inter.select("user", "item").distinct())


def random_negatives(inter: DataFrame, n: int, seed: str) -> DataFrame:
    """n unseen items per user, every item of the log equally likely."""
    seen = _seen(inter)
    pool = materialise(id_mapping(seen, "item", "idx"))
    size = pool.agg(F.count("*")).scalar()
    wanted = materialise(seen.select("user").distinct().select("user", F.lit(n).cast("long").alias("want"), size.alias("limit")))
    return fill_with_copies(draw_unseen(wanted, pool, seen, seed, n), wanted, seed)


def popular_limits(inter: DataFrame, seen: DataFrame, share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Per user the popularity place up to which the most popular `share` of the unseen items
    lies, and the item list in popularity order.

    With T places to go and seen items at places r_1 < r_2 < ..., a seen item lies inside as long
    as fewer than T unseen ones come before it, that is r_j - j < T.
    """
    counts = inter.groupBy("item").agg(F.count("*").alias("n"))
    ranked = global_order(counts, F.struct((-F.col("n")).alias("a"), F.col("item").alias("b")))
    ranked = materialise(ranked.select("item", (F.col("rn") - 1).alias("idx")))
    size = ranked.agg(F.count("*")).scalar()
    totals = seen.groupBy("user").agg(F.count("*").alias("m")).select("user", F.floor((size - F.col("m")) * F.lit(share)).alias("t"))
    places = materialise(shuffled(seen).join(ranked, "item").select("user", (F.col("idx") + 1).alias("r")))
    cuts = splitters(places, F.col("r"))
    numbered = prefix_sums(places, ["user"], bucket_of(F.col("r"), cuts), [F.col("r")], {"before": F.lit(1).cast("long")})
    inside = shuffled(numbered).join(totals, "user").groupBy("user", "t").agg(F.count_if(F.col("r") - (F.col("before") + 1) < F.col("t")).alias("s"))
    return inside.select("user", (F.col("t") + F.col("s")).alias("limit"), "t"), ranked


def popular_negatives(inter: DataFrame, n: int, seed: str, share: float = 0.5) -> DataFrame:
    """n unseen items per user out of the most popular half of what the user has not seen."""
    seen = _seen(inter)
    limits, ranked = popular_limits(inter, seen, share)
    wanted = materialise(limits.select("user", F.lit(n).cast("long").alias("want"), "limit"))
    return fill_with_copies(draw_unseen(wanted, ranked, seen, seed, n), wanted, seed)


def diverse_negatives(inter: DataFrame, category: DataFrame, names: Sequence[str], n: int, seed: str) -> DataFrame:
    """n unseen items per user, spread evenly over the listed categories the user still has
    unseen items in; missing ones are drawn from all items. category: (item, label)."""
    seen = _seen(inter)
    items = seen.select("item").distinct()
    listed = materialise(items.join(category.where(F.col("label").isin(list(names))), "item"))
    cuts = splitters(listed, F.col("item"))
    pool = materialise(
        prefix_sums(listed, ["label"], bucket_of(F.col("item"), cuts), [F.col("item")], {"idx": F.lit(1).cast("long")})
    )
    sizes = listed.groupBy("label").agg(F.count("*").alias("limit"))
    users = seen.select("user").distinct()
    known = shuffled(seen).join(listed, "item").groupBy("user", "label").agg(F.count("*").alias("k"))
    # The category list is a short parameter, so a user has at most that many rows here.
    per = users.select("user", F.explode(F.array(*[F.lit(c) for c in sorted(names)])).alias("label")).join(sizes, "label").join(
        shuffled(known), ["user", "label"], "left"
    ).select("user", "label", "limit", (F.col("limit") - F.coalesce("k", F.lit(0))).alias("free")).where("free > 0")
    packed = per.groupBy("user").agg(F.array_sort(F.collect_list(F.struct("label", "limit", "free"))).alias("l"))
    quota = materialise(packed.select("user", F.size("l").alias("c"), F.posexplode("l").alias("p", "s")).select(
        "user", F.col("s.label").alias("label"), F.col("s.limit").alias("limit"),
        F.least(F.floor(F.lit(n) / F.col("c")) + F.when(F.col("p") < F.lit(n) % F.col("c"), 1).otherwise(0), F.col("s.free")).cast("long").alias("want"),
    ))
    spread = draw_unseen(quota, pool, seen, seed, n, ["label"]).select("user", "item")
    have = spread.groupBy("user").agg(F.count("*").alias("h"))
    total = items.agg(F.count("*")).scalar()
    missing = users.join(shuffled(have), "user", "left").select(
        "user", (F.lit(n) - F.coalesce("h", F.lit(0))).cast("long").alias("want"), total.alias("limit")
    ).where("want > 0")
    spread = spread.withColumn("source", F.lit("category"))
    if missing.isEmpty():
        return spread
    missing = materialise(missing)
    taken = seen.unionByName(spread.select("user", "item"))
    extra = draw_unseen(missing, id_mapping(seen, "item", "idx"), taken, seed + "-extra", n)
    extra = fill_with_copies(extra, missing, seed + "-extra")
    return spread.unionByName(extra.select("user", "item", F.lit("extra").alias("source")))
