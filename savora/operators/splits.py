"""Train/validation/test splits, as-of targets, warm and cold users."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from savora.functions.hashing import hash_int
from savora.functions.ordering import prefix_sums
from savora.session import materialise


def date_range(df: DataFrame, lo: str, hi: str, date: str = "review_date") -> DataFrame:
    """Half-open [lo, hi)."""
    c = F.col(date)
    return df.where((c >= F.lit(lo).cast("timestamp_ntz")) & (c < F.lit(hi).cast("timestamp_ntz")))


def time_point_split(df: DataFrame, train: str, val: str, test: str, end: str, date: str = "review_date") -> DataFrame:
    """Rows between `train` and `end` labelled by the period they fall in; one pass, no shuffle."""
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    c = F.col(date)
    return date_range(df, train, end, date).withColumn(
        "part", F.when(c < at(val), "train").when(c < at(test), "val").otherwise("test")
    )


def _month(date: str) -> Column:
    return F.year(date) * 12 + F.month(date)


def timeline_split(df: DataFrame, test_size: float, user: str = "reviewer_id", date: str = "review_date", tie: str = "review_id") -> DataFrame:
    """Per user in time order: the last part is test; of the rest the last part is validation.

    Splitting off test and splitting the rest again only needs each row's place and the user's
    count, so both cuts come from one ranking.
    """
    ranked = prefix_sums(df, [user], _month(date), [F.col(date), F.col(tie)], {"__n": F.lit(1).cast("long")}, totals=True)
    keep = F.lit(1.0 - test_size)
    outer = F.floor(F.col("__n_total") * keep)
    inner = F.floor(outer * keep)
    part = F.when(F.col("__n") < inner, "train").when(F.col("__n") < outer, "val").otherwise("test")
    return ranked.withColumn("part", part).drop("__n", "__n_total")


def stratified_split(df: DataFrame, test_size: float, seed: str, user: str = "reviewer_id", tie: str = "review_id") -> DataFrame:
    """Random split inside each user by hash order; users that would miss one side are reported
    in neither, so both sides hold the same users."""
    h = hash_int(seed, F.col(tie))
    work = df.withColumn("__h", h)
    ranked = prefix_sums(work, [user], F.floor(F.col("__h") / F.lit(1 << 26)), [F.col("__h"), F.col(tie)], {"__n": F.lit(1).cast("long")}, totals=True)
    cut = F.floor(F.col("__n_total") * F.lit(1.0 - test_size) + 0.5)
    return (
        ranked.where((cut >= 1) & (cut < F.col("__n_total")))
        .withColumn("part", F.when(F.col("__n") < cut, "train").otherwise("val"))
        .drop("__n", "__n_total", "__h")
    )


_DATE = re.compile(r"^\d{4}-\d{2}-\d{2}$")


def check_split_arguments(by: str, dates: tuple[str, str, str, str] | None = None, test_size: float | None = None) -> None:
    """Split parameters must be complete, well formed and in order."""
    if by == "time_point":
        if test_size is not None:
            raise ValueError("a time-point split takes no test_size")
        if not dates or any(d is None or not _DATE.match(d) for d in dates):
            raise ValueError("four dates of the form yyyy-mm-dd are needed")
        if not all(a < b for a, b in zip(dates, dates[1:])):
            raise ValueError("split dates must increase")
    elif by in ("user_timeline", "stratified"):
        if dates is not None:
            raise ValueError(f"a {by} split takes no dates")
        if test_size is None or not 0 < test_size < 1:
            raise ValueError("test_size must lie between 0 and 1")
    else:
        raise ValueError(f"unknown split {by}")


def as_of_mean(df: DataFrame, user: str = "reviewer_id", score: str = "score", date: str = "review_date", tie: str = "review_id", out: str = "review_avg") -> DataFrame:
    """Mean of the user's earlier scores at the time of each review; the first uses its own."""
    run = prefix_sums(
        df, [user], _month(date), [F.col(date), F.col(tie)],
        {"__n": F.lit(1).cast("long"), "__s": F.col(score).cast("double")},
    )
    return run.withColumn(
        out, F.when(F.col("__n") > 0, F.col("__s") / F.col("__n")).otherwise(F.col(score).cast("double"))
    ).drop("__n", "__s")


def as_of_target(df: DataFrame, **cols: str) -> DataFrame:
    score = cols.get("score", "score")
    out = as_of_mean(df, **cols)
    return out.withColumn("target", (F.col(score) >= F.col("review_avg")).cast("int"))


def item_mean_target(df: DataFrame, item: str = "diner_idx", score: str = "score") -> DataFrame:
    """1 where the score reaches the item's overall mean."""
    means = df.groupBy(item).agg(F.avg(score).alias("item_avg"))
    return df.join(means, item).withColumn("target", (F.col(score) >= F.col("item_avg")).cast("int"))


def compare_targets(a: DataFrame, b: DataFrame, key: str = "review_id") -> DataFrame:
    x = a.select(key, F.col("target").alias("a"))
    y = b.select(key, F.col("target").alias("b"))
    return x.join(y, key).agg(
        F.count("*").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("changed"),
        F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("zero_to_one"),
        F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("one_to_zero"),
    )


def users_of(df: DataFrame, user: str = "reviewer_id") -> DataFrame:
    return df.select(user).distinct()


def warm_cold_users(train: DataFrame, later: DataFrame, user: str = "reviewer_id") -> DataFrame:
    """Users of the later period, warm when the train period knows them."""
    known = users_of(train, user).withColumn("__w", F.lit(1))
    return users_of(later, user).join(known, user, "left").select(
        user, F.when(F.col("__w") == 1, "warm").otherwise("cold").alias("user_type")
    )


def warm_reviews(train: DataFrame, later: DataFrame, user: str = "reviewer_id") -> DataFrame:
    return later.join(users_of(train, user), user, "left_semi")


def cold_reviews(train: DataFrame, later: DataFrame, user: str = "reviewer_id") -> DataFrame:
    return later.join(users_of(train, user), user, "left_anti")


def label_warm_cold(train: DataFrame, later: DataFrame, user: str = "reviewer_id") -> DataFrame:
    return later.join(warm_cold_users(train, later, user), user)


def split_stats(parts: DataFrame, first: str = "train", user: str = "reviewer_id", item: str = "diner_idx") -> DataFrame:
    """Per value of `part`: users, items, feedbacks, density % and the share of users the first
    part knows. Everything but the item count comes from one pass over (part, user) counts."""
    per_user = materialise(parts.groupBy("part", user).agg(F.count("*").alias("__n")))
    known = per_user.where(F.col("part") == first).select(user, F.lit(1).alias("__w"))
    users = per_user.join(known, user, "left").groupBy("part").agg(
        F.count("*").alias("users"), F.sum("__n").alias("feedbacks"),
        F.count_if(F.col("__w") == 1).alias("warm_users"), F.count_if(F.col("__w").isNull()).alias("cold_users"),
    )
    items = parts.select("part", item).distinct().groupBy("part").agg(F.count("*").alias("items"))
    pct = lambda a, b: F.round(F.try_divide(100.0 * a, b), 6)
    return users.join(items, "part").select(
        "part", "users", "items", "feedbacks", pct(F.col("feedbacks"), F.col("users") * F.col("items")).alias("density_pct"),
        "warm_users", "cold_users", pct(F.col("warm_users"), F.col("warm_users") + F.col("cold_users")).alias("warm_pct"),
    )


def edge_split(edges: DataFrame, seed: str, *keys: str) -> DataFrame:
    """80/10/10 assignment of each edge by its own hash; needs no shuffle and never moves an
    edge between runs."""
    h = hash_int(seed, *[F.col(k) for k in keys]) % 10
    return edges.withColumn("part", F.when(h < 8, "train").when(h == 8, "val").otherwise("test"))
