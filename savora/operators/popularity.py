"""Popularity lists and top-k selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from savora.functions.ordering import global_order


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """First k rows per group. The rank filter becomes a window group limit, which cuts every
    partition to k rows per group before the shuffle, so hot groups stay small."""
    name = rank or "__rank"
    w = W.partitionBy(*group).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def with_position(df: DataFrame, order: Sequence[Column], k: int, rank: str = "pos") -> DataFrame:
    """Global top-k with its position; only the k rows left by the distributed top-k are numbered."""
    return df.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(W.orderBy(*order)))


def most_popular(review: DataFrame, k: int, item: str = "diner_idx") -> DataFrame:
    """Items by number of reviews, ties by id."""
    counts = review.groupBy(item).agg(F.count("*").alias("n"))
    return with_position(counts, [F.desc("n"), F.asc(item)], k)


def ranked_list(
    review: DataFrame, diner: DataFrame, k: int, method: str = "review_count", period_months: int | None = None,
    until: str | None = None, large: str | None = None, middle: str | None = None, min_reviews: int = 1,
    distance: Column | None = None, item: str = "diner_idx", date: str = "review_date",
) -> DataFrame:
    """Top list filtered by category and period, ordered by review count, rating or distance."""
    places = diner
    if large is not None:
        places = places.where(F.col("large") == large)
    if middle is not None:
        places = places.where(F.col("middle") == middle)
    rows = review
    if period_months is not None:
        end = F.lit(until).cast("timestamp_ntz") if until else review.agg(F.max(date)).scalar()
        rows = rows.where((F.col(date) > F.add_months(end, -period_months)) & (F.col(date) <= end))
    stats = rows.groupBy(item).agg(F.count("*").alias("n_reviews"), F.avg("score").alias("rating")).where(
        F.col("n_reviews") >= min_reviews
    )
    out = places.join(stats, item)
    if method == "distance":
        if distance is None:
            raise ValueError("method distance needs a distance column")
        out = out.withColumn("distance", distance)
        order = [F.asc_nulls_last("distance"), F.asc(item)]
    elif method == "rating":
        order = [F.desc("rating"), F.desc("n_reviews"), F.asc(item)]
    elif method == "review_count":
        order = [F.desc("n_reviews"), F.asc(item)]
    else:
        raise ValueError(f"unknown method {method}")
    return with_position(out, order, k)


def cumulative_share(review: DataFrame, item: str = "diner_idx") -> DataFrame:
    """Items from most to least reviewed with the running share of all reviews."""
    counts = review.groupBy(item).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    run = global_order(counts, F.struct((-F.col("n")).alias("a"), F.col(item).alias("b")), {"running": F.col("n")})
    return run.select(item, "n", "rn", (F.col("running") / total).alias("share"))


def rating_volume_score(stats: DataFrame, rating: str, count: str, w: float = 0.7) -> DataFrame:
    return stats.withColumn("rank_score", F.lit(w) * F.col(rating) + F.lit(1.0 - w) * F.log1p(F.col(count).cast("double")))
