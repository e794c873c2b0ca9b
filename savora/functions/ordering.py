"""Ordered computations that never put a whole group, or the whole table, into one task.

A plain window over `partitionBy(user)` sends all rows of a user to one task, and a window
without partition sends everything to one task. The helpers here cut the order into buckets:
rows are ranked inside (group, bucket), and the totals of earlier buckets, a small table, are
added as offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from savora.session import materialise, shuffled

# One bucket per this many rows; small tables get a single bucket and need no cut points.
ROWS_PER_BUCKET = 1_000_000
MAX_CUTS = 512


def splitters(df: DataFrame, key: Column, max_cuts: int = MAX_CUTS) -> list:
    """Cut points of `key`, drawn by hash so that every run draws the same ones.

    Only these few values come to the driver; the draw is a distributed top-n. Callers hand in
    written tables, so the row count is read from file footers.
    """
    n = min(df.count() // ROWS_PER_BUCKET, max_cuts)
    if n == 0:
        return []
    rows = (
        df.select(key.alias("k"))
        .where(F.col("k").isNotNull())
        .distinct()
        .orderBy(F.md5(F.to_json(F.struct("k"))), "k")
        .limit(n)
        .collect()
    )
    return sorted(r["k"] for r in rows)


def bucket_of(key: Column, cuts: list) -> Column:
    """Number of cut points not above `key`: a monotone bucket number."""
    if not cuts:
        return F.lit(0)

    def descend(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(cuts[mid]), descend(lo, mid)).otherwise(descend(mid + 1, hi))

    return descend(0, len(cuts))


def prefix_sums(
    df: DataFrame,
    group: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    values: dict[str, Column],
    totals: bool = False,
) -> DataFrame:
    """Add, for every entry of `values`, its sum over the earlier rows of the same group; with
    `totals` also the sum over the whole group as `<name>_total`.

    `bucket` must be monotone in `order`. Sums exclude the row itself; a first row gets 0. Group
    columns must not be null: plain equality keeps the rows where the window put them, so the
    offsets are the only side that moves for the join.
    """
    group = list(group)
    b = "__bucket"
    work = df.withColumn(b, F.coalesce(bucket, F.lit(-1)))
    for name, value in values.items():
        work = work.withColumn(f"__v_{name}", value)
    inner = W.partitionBy(*group, b).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sums = work.groupBy(*group, b).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in values])
    earlier = W.partitionBy(*group).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    whole = [F.sum(f"__t_{n}").over(W.partitionBy(*group)).alias(f"__w_{n}") for n in values] if totals else []
    offsets = sums.select(
        *group, b, *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}") for n in values], *whole
    )
    ranked = work.select(
        "*", *[F.coalesce(F.sum(f"__v_{n}").over(inner), F.lit(0)).alias(f"__i_{n}") for n in values]
    )
    offs = offsets.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate([*group, b])], *[f"__o_{n}" for n in values], *([f"__w_{n}" for n in values] if totals else []))
    cond = None
    for i, c in enumerate([*group, b]):
        e = F.col(c) == F.col(f"__g{i}")
        cond = e if cond is None else cond & e
    joined = ranked.join(shuffled(offs), cond, "left")
    return joined.select(
        *df.columns,
        *[(F.coalesce(F.col(f"__i_{n}"), F.lit(0)) + F.coalesce(F.col(f"__o_{n}"), F.lit(0))).alias(n) for n in values],
        *([F.col(f"__w_{n}").alias(f"{n}_total") for n in values] if totals else []),
    )


def global_order(df: DataFrame, key: Column, values: dict[str, Column] | None = None, rank: str = "rn") -> DataFrame:
    """1-based rank over the whole table by `key` (unique, may be a struct), plus running sums
    that include the row, without a single-task window."""
    values = values or {}
    work = materialise(df.withColumn("__key", key))
    cuts = splitters(work, F.col("__key"))
    if cuts and hasattr(cuts[0], "asDict"):
        lits = [F.struct(*[F.lit(v).alias(k) for k, v in c.asDict().items()]) for c in cuts]
        bucket = _bucket_of_lits(F.col("__key"), lits)
    else:
        bucket = bucket_of(F.col("__key"), cuts)
    work = work.withColumn("__all", F.lit(0))
    out = prefix_sums(
        work, ["__all"], bucket, [F.col("__key")], {rank: F.lit(1).cast("long"), **values}
    )
    out = out.withColumn(rank, F.col(rank) + 1)
    for name, value in values.items():
        out = out.withColumn(name, F.col(name) + value)
    return out.drop("__key", "__all")


def _bucket_of_lits(key: Column, lits: list) -> Column:
    def descend(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < lits[mid], descend(lo, mid)).otherwise(descend(mid + 1, hi))

    return descend(0, len(lits))


def dense_index(ids: DataFrame, col: str, out: str = "idx", start: int | Column = 0) -> DataFrame:
    """Sorted distinct non-null values of `col` numbered from `start`."""
    base = ids.select(col).where(F.col(col).isNotNull()).distinct()
    offset = F.lit(start) if isinstance(start, int) else start
    return global_order(base, F.col(col), rank="__rn").select(
        col, (F.col("__rn") - 1 + offset).cast("long").alias(out)
    )


def quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles per group from a value histogram.

    The histogram is combined map-side; no task holds all values of a group.
    """
    groups = list(groups)
    src = df.where(F.col(value).isNotNull())
    if not groups:
        src = src.withColumn("__all", F.lit(0))
    keys = groups or ["__all"]
    hist = materialise(src.groupBy(*keys, value).agg(F.count("*").alias("__c")))
    cuts = splitters(hist, F.col(value))
    run = prefix_sums(hist, keys, bucket_of(F.col(value), cuts), [F.col(value)], {"__before": F.col("__c")})
    sizes = hist.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    run = run.join(sizes, keys)
    aggs = []
    for name, p in probs.items():
        pos = (F.col("__n") - 1) * F.lit(float(p))
        for tag, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            inside = (F.col("__before") <= at) & (at < F.col("__before") + F.col("__c"))
            aggs.append(F.max(F.when(inside, F.col(value).cast("double"))).alias(f"__{name}_{tag}"))
    picked = run.groupBy(*keys, "__n").agg(*aggs)
    cols = []
    for name, p in probs.items():
        pos = (F.col("__n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return picked.select(*groups, F.col("__n").alias("n"), *cols)
