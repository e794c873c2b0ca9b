"""Aggregates behind the dashboards: counts, shares, category and keyword views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from savora.functions.ordering import quantiles


def count_status(df: DataFrame, col: str) -> DataFrame:
    """Rows whose count is unreadable, not positive (including unreadable) or positive."""
    n = F.col(col).try_cast("double")
    return df.agg(
        F.count_if(n.isNull()).alias("null_count"), F.count_if(n.isNull() | (n <= 0)).alias("zero_count"), F.count_if(n > 0).alias("valid_count")
    )


def top_category_quartiles(df: DataFrame, category: str, value: Column, k: int = 10) -> DataFrame:
    """Quartiles of a value in the k most frequent categories."""
    work = df.select(F.col(category), value.cast("double").alias("__v"))
    top = work.where(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.asc(category)).limit(k)
    q = quantiles(work.join(top.select(category), category, "left_semi"), [category], "__v", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return top.join(q.drop("n"), category, "left")


def activity_histogram(review: DataFrame, user: str, max_count: int | None = None) -> DataFrame:
    """Number of users per review count."""
    hist = review.groupBy(user).agg(F.count("*").alias("reviews")).groupBy("reviews").agg(F.count("*").alias("users"))
    return hist if max_count is None else hist.where(F.col("reviews") <= max_count)


# Lower borders and labels of the reviewer activity bins.
ACTIVITY_BINS = ((1, "1"), (2, "2"), (3, "3-4"), (5, "5-9"), (10, "10-19"), (20, "20-49"), (50, "50-99"), (100, "100+"))


def activity_bins(review: DataFrame, user: str) -> DataFrame:
    hist = activity_histogram(review, user)
    label = F.lit(None).cast("string")
    for lo, name in ACTIVITY_BINS:
        label = F.when(F.col("reviews") >= lo, name).otherwise(label)
    return hist.groupBy(label.alias("bin")).agg(F.sum("users").alias("users"))


def at_least_shares(review: DataFrame, user: str) -> DataFrame:
    """Users with at least n reviews and their share in %, for every n that occurs. The window
    runs over the histogram, one row per distinct count."""
    hist = activity_histogram(review, user)
    w = W.orderBy(F.desc("reviews")).rowsBetween(W.unboundedPreceding, 0)
    total = hist.agg(F.sum("users")).scalar()
    return hist.select("reviews", F.sum("users").over(w).alias("users")).withColumn("pct", F.round(100.0 * F.col("users") / total, 6))


def value_counts(df: DataFrame, *cols: str, drop_null: bool = False) -> DataFrame:
    if drop_null:
        df = df.dropna(subset=list(cols))
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def shares(df: DataFrame, group: Sequence[str], cols: Sequence[str], out: str = "pct", scale: float = 100.0) -> DataFrame:
    """Counts per (group, cols) with their share of the group."""
    counts = df.groupBy(*group, *cols).agg(F.count("*").alias("n"))
    if group:
        totals = counts.groupBy(*group).agg(F.sum("n").alias("__t"))
        return counts.join(totals, list(group)).withColumn(out, F.round(scale * F.col("n") / F.col("__t"), 6)).drop("__t")
    return counts.withColumn(out, F.round(scale * F.col("n") / counts.agg(F.sum("n")).scalar(), 6))


def category_metrics(df: DataFrame, group: Sequence[str]) -> DataFrame:
    return df.groupBy(*group).agg(
        F.count("*").alias("diners"), F.round(F.avg("rating"), 6).alias("mean_rating"),
        F.round(F.avg("bayesian_score"), 6).alias("mean_bayesian"), F.round(F.avg("n_reviews"), 6).alias("mean_reviews"),
    )


def missing_shares(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    flat = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols], F.count("*").alias("__n"))
    rows = F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).alias("missing"), F.round(100.0 * F.col(c) / F.col("__n"), 6).alias("pct")) for c in cols])
    return flat.select(F.inline(rows))


def keyword_rows(review: DataFrame, keyword: DataFrame, diner: DataFrame) -> DataFrame:
    """Keywords with their review's diner; rows without a keyword category fall out."""
    return review.join(keyword, "review_id").where(F.col("category").isNotNull()).join(diner, "diner_idx", "left")


def address_parts(address: str, etc: str = "etc") -> tuple[Column, Column]:
    """(region, district): first two address words, `etc` where missing."""
    words = F.split(F.trim(F.col(address)), r"\s+")
    return F.coalesce(F.get(words, F.lit(0)), F.lit(etc)), F.coalesce(F.get(words, F.lit(1)), F.lit(etc))


def polarity(sentiment: str, border: float = 0.5) -> Column:
    return F.when(F.col(sentiment) > border, "positive").otherwise("negative")


def keyword_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("keywords"), F.round(100.0 * F.count_if(F.col("sentiment") > 0.5) / F.count("*"), 6).alias("positive_pct"),
        F.count_distinct("diner_idx").alias("diners"), F.count_distinct("large").alias("categories"),
    )


def term_frequency(keyword: DataFrame, border: float = 0.4) -> DataFrame:
    """Term counts per category and polarity at the border."""
    side = F.when(F.col("sentiment") >= border, "positive").otherwise("negative")
    return keyword.where(F.col("category").isNotNull()).groupBy("category", "term", side.alias("side")).agg(F.count("*").alias("n"))


def monthly_mean(review: DataFrame, key: str, value: str, date: str) -> DataFrame:
    """Mean per month from the first to the last month of each key; empty months stay as null."""
    month = F.trunc(F.col(date), "month")
    got = review.groupBy(key, month.alias("month")).agg(F.avg(value).alias("mean"))
    spine = got.groupBy(key).agg(F.min("month").alias("a"), F.max("month").alias("b")).select(
        key, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month")
    )
    return spine.join(got, [key, "month"], "left")


def monthly_sentiment(rows: DataFrame, key: str, date: str) -> DataFrame:
    """Mean over a key's reviews of the mean sentiment of their keywords, per month."""
    per = rows.groupBy(key, "review_id", F.trunc(F.col(date), "month").alias("month")).agg(F.avg("sentiment").alias("s"))
    return per.groupBy(key, "month").agg(F.avg("s").alias("sentiment"), F.count("*").alias("n_reviews"))


def satisfaction(rows: DataFrame, category: str, top: int = 10) -> DataFrame:
    """Visits, visits scored above the reviewer's own mean, and their share, busiest first."""
    return (
        rows.where(F.col(category).isNotNull()).groupBy(category)
        .agg(F.count("*").alias("visits"), F.count_if(F.col("score_diff") > 0).alias("satisfied"))
        .withColumn("pct", F.floor(F.col("satisfied") / F.col("visits") * 1000 + 0.5) / 10)
        .orderBy(F.desc("visits"), F.asc(category)).limit(top)
    )


def menu_price_mean(df: DataFrame, prices: Column) -> DataFrame:
    """Mean over all readable prices of all lists; 0 without any."""
    p = df.select(F.explode(prices).alias("p"))
    return p.where(F.col("p").rlike(r"^[0-9]+\.?[0-9]*$")).agg(F.coalesce(F.avg(F.col("p").cast("double")), F.lit(0.0)).alias("mean_price"), F.count("*").alias("n"))


def paired_menus(df: DataFrame, key: str, names: Column, prices: Column) -> DataFrame:
    """(key, place, menu, price) for rows whose two lists have the same length."""
    return df.select(key, names.alias("__n"), prices.alias("__p")).where(F.size("__n") == F.size("__p")).select(
        key, F.posexplode(F.arrays_zip("__n", "__p")).alias("place", "z")
    ).select(key, "place", F.col("z.__n").alias("menu"), F.col("z.__p").alias("price"))


def drill_down(df: DataFrame, path: dict[str, str]) -> DataFrame:
    """Rows below a category selection, given level by level."""
    for level, value in path.items():
        df = df.where(F.col(level) == value)
    return df


def options(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()
