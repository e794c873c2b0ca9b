"""Descriptive statistics, time series and correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def burst_reviews(
    review: DataFrame, min_reviews: int = 3, max_days: int = 3, min_score: float = 4, min_hits: int = 20,
    user: str = "reviewer_id", item: str = "diner_idx", date: str = "review_date",
) -> DataFrame:
    """Good reviews by users active only within a few days, on items that gather many of them,
    with the item's largest number of such reviews on one day."""
    users = review.groupBy(user).agg(F.count("*").alias("n"), F.datediff(F.max(date), F.min(date)).alias("span")).where(
        (F.col("n") >= min_reviews) & (F.col("span") <= max_days)
    )
    high = review.where(F.col("score") >= min_score).join(users.select(user), user, "left_semi")
    per_day = high.groupBy(item, F.to_date(date).alias("__d")).agg(F.count("*").alias("c"))
    items = per_day.groupBy(item).agg(F.sum("c").alias("hits"), F.max("c").alias("max_same_day")).where(F.col("hits") >= min_hits)
    return high.join(items, item)


def pivot_counts(df: DataFrame, row: Column, row_name: str, col: str, values: Sequence[str], names: dict[str, str]) -> DataFrame:
    """Counts per row key with one column per listed value."""
    return df.groupBy(row.alias(row_name)).agg(*[F.count_if(F.col(col) == v).alias(names[v]) for v in values])


def min_max_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    ends = df.agg(F.struct(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols])).scalar()
    keep = [c for c in df.columns if c not in cols]
    unit = lambda c: F.coalesce(F.try_divide((F.col(c) - ends[f"lo_{c}"]).cast("double"), (ends[f"hi_{c}"] - ends[f"lo_{c}"]).cast("double")), F.lit(0.0))
    return df.select(*keep, *[unit(c).alias(c) for c in cols])


def score_stats(df: DataFrame, group: Sequence[str], score: str) -> DataFrame:
    """Mean, standard deviation, median and count. Scores have few distinct values, which is all
    the exact median keeps per group."""
    return df.groupBy(*group).agg(
        F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"), F.median(score).alias("median"), F.count(score).alias("n")
    )


def unpivot_stats(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.unpivot(list(keys), [F.col(c).cast("double").alias(c) for c in cols], "measure", "value")


def join_weather(review: DataFrame, weather: DataFrame, date: str = "review_date") -> DataFrame:
    return review.withColumn("day", F.to_date(date)).join(weather, "day")


def rain_level(col: str) -> Column:
    """0 for none, then up to 5, 20, 50 and above."""
    c = F.coalesce(F.col(col), F.lit(0.0))
    return F.when(c == 0, 0).when(c <= 5, 1).when(c <= 20, 2).when(c <= 50, 3).otherwise(4)


def moving_mean(df: DataFrame, group: Sequence[str], order: str, value: str, width: int = 5, out: str = "smooth") -> DataFrame:
    """Centred moving mean over an odd number of points, null where the window is not full."""
    half = width // 2
    w = W.partitionBy(*group).orderBy(order).rowsBetween(-half, half)
    return df.withColumn(out, F.when(F.count(value).over(w) == width, F.avg(value).over(w)))


def monthly(df: DataFrame, group: Sequence[str], date: str, value: Column, out: str = "value") -> DataFrame:
    return df.groupBy(*group, F.trunc(F.col(date), "month").alias("month")).agg(value.alias(out))


def decompose(series: DataFrame, group: Sequence[str], order: str, value: str, period: int = 12) -> DataFrame:
    """Additive decomposition into trend, seasonal and residual part.

    Trend is the centred moving mean over one period (half weights at both ends of an even one),
    seasonal the mean detrended value per phase, centred to 0. Series shorter than two periods
    are left out. Windows run over one series of months per group.
    """
    g = W.partitionBy(*group)
    s = series.withColumn("__i", F.row_number().over(g.orderBy(order)) - 1).withColumn("__n", F.count("*").over(g)).where(F.col("__n") >= 2 * period)
    half = period // 2
    inner = g.orderBy(order).rowsBetween(-half, half)
    if period % 2 == 0:
        total = F.sum(value).over(inner) - (F.lag(value, half).over(g.orderBy(order)) + F.lead(value, half).over(g.orderBy(order))) * 0.5
    else:
        total = F.sum(value).over(inner)
    full = (F.col("__i") >= half) & (F.col("__i") < F.col("__n") - half)
    s = s.withColumn("trend", F.when(full, total / float(period))).withColumn("__p", F.col("__i") % period)
    phase = s.groupBy(*group, "__p").agg(F.avg(F.col(value) - F.col("trend")).alias("__m"))
    centre = phase.groupBy(*group).agg(F.avg("__m").alias("__c"))
    phase = phase.join(centre, list(group)).select(*group, "__p", (F.col("__m") - F.col("__c")).alias("seasonal"))
    return s.join(phase, [*group, "__p"]).withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal")).drop("__i", "__n", "__p")


def interpolate(series: DataFrame, group: Sequence[str], order: str, value: str, out: str = "filled") -> DataFrame:
    """Gaps on a straight line between their neighbours by position; leading gaps stay, trailing
    ones repeat the last value."""
    w = W.partitionBy(*group).orderBy(order)
    s = series.withColumn("__i", F.row_number().over(w))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("__i").alias("i"), F.col(value).cast("double").alias("v")))
    s = s.withColumn("__a", F.last(known, True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn(
        "__b", F.first(known, True).over(w.rowsBetween(0, W.unboundedFollowing))
    )
    a, b = F.col("__a"), F.col("__b")
    line = a["v"] + (b["v"] - a["v"]) * (F.col("__i") - a["i"]) / (b["i"] - a["i"])
    filled = F.when(F.col(value).isNotNull(), F.col(value).cast("double")).when(a.isNull(), F.lit(None).cast("double")).when(b.isNull(), a["v"]).otherwise(line)
    return s.withColumn(out, filled).drop("__i", "__a", "__b")


def spearman(df: DataFrame, group: Sequence[str], x: str, y: str, digits: int = 4) -> DataFrame:
    """Correlation of average ranks per group; pairs with a missing side are left out."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = W.partitionBy(*group)

    def mean_rank(c: str) -> Column:
        return F.rank().over(g.orderBy(c)) + (F.count("*").over(W.partitionBy(*group, c)) - 1) / 2.0

    r = d.withColumn("__x", mean_rank(x)).withColumn("__y", mean_rank(y))
    return r.groupBy(*group).agg(F.round(F.corr("__x", "__y"), digits).alias("correlation"))


def comfort(col: str, centre: float, width: float) -> Column:
    return F.exp(-((F.col(col) - centre) ** 2) / (2.0 * width * width))


def inverse_score(col: str) -> Column:
    return 1.0 / (1.0 + F.col(col))


def reviewed_share(diner: DataFrame, review: DataFrame, group: str, item: str = "diner_idx") -> DataFrame:
    """Items and reviewed items per group."""
    all_items = diner.groupBy(group).agg(F.count("*").alias("items"))
    seen = diner.join(review.select(item).distinct(), item, "left_semi").groupBy(group).agg(F.count("*").alias("reviewed"))
    return all_items.join(seen, group, "full_outer").fillna(0, subset=["items", "reviewed"])


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, one pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    flat = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return flat.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"c{i}", 6).alias("correlation")) for i, (a, b) in enumerate(pairs)])))


def exact_count_shares(review: DataFrame, key: str, top: int = 20) -> DataFrame:
    """Share of ids with exactly n reviews, most frequent n first."""
    hist = review.groupBy(key).agg(F.count("*").alias("reviews")).groupBy("reviews").agg(F.count("*").alias("ids"))
    total = hist.agg(F.sum("ids")).scalar()
    return hist.withColumn("pct", F.round(100.0 * F.col("ids") / total, 6)).orderBy(F.desc("ids"), F.asc("reviews")).limit(top)
