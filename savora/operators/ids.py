"""Dense id mappings and their application."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from savora.functions.ordering import dense_index
from savora.session import shuffled


def id_mapping(df: DataFrame, col: str, out: str, start: int | Column = 0) -> DataFrame:
    return dense_index(df, col, out, start)


def distinct_count(df: DataFrame, col: str) -> Column:
    """Number of distinct non-null values, as a scalar subquery."""
    return df.where(F.col(col).isNotNull()).select(col).distinct().agg(F.count("*")).scalar()


def pair_mapping(review: DataFrame, user: str = "reviewer_id", item: str = "diner_idx", shared: bool = True):
    """(item mapping, user mapping); with a shared id space users follow the items."""
    items = id_mapping(review, item, "item_idx")
    start = distinct_count(review, item) if shared else F.lit(0)
    return items, id_mapping(review, user, "user_idx", start)


def metadata_mapping(df: DataFrame, scalar: str, array: str, start: Column | int, out: str = "meta_idx") -> DataFrame:
    """Ids for every metadata value met as the row's own or as a neighbour."""
    values = df.select(F.col(scalar).alias("meta")).unionByName(df.select(F.explode(array).alias("meta")))
    return id_mapping(values, "meta", out, start)


def map_column(df: DataFrame, mapping: DataFrame, col: str, key: str, idx: str, how: str = "left") -> DataFrame:
    """Add `idx` for `col`; rows with unknown ids keep null (or fall out with an inner join)."""
    m = mapping.select(F.col(key).alias("__k"), F.col(idx))
    return df.join(shuffled(m), F.col(col) == F.col("__k"), how).drop("__k")


def map_array(df: DataFrame, row_key: str, array: str, mapping: DataFrame, key: str, idx: str, out: str) -> DataFrame:
    """Replace every element of an array column by its id, keeping the order."""
    e = df.select(row_key, F.posexplode(array).alias("__p", "__v"))
    m = mapping.select(F.col(key).alias("__v"), F.col(idx).alias("__i"))
    back = (
        e.join(m, "__v", "left").groupBy(row_key)
        .agg(F.sort_array(F.collect_list(F.struct("__p", "__i"))).alias("__l"))
        .select(row_key, F.transform("__l", lambda s: s["__i"]).alias(out))
    )
    return df.join(back, row_key, "left")


def mapping_mismatches(a: DataFrame, b: DataFrame, key: str, idx: str) -> DataFrame:
    """Ids that one mapping lacks or numbers differently."""
    x = a.select(F.col(key).alias("k"), F.col(idx).alias("a_idx"))
    y = b.select(F.col(key).alias("k"), F.col(idx).alias("b_idx"))
    return x.join(shuffled(y), "k", "full_outer").where(~F.col("a_idx").eqNullSafe(F.col("b_idx")))


def append_users(mapping: DataFrame, names: DataFrame, user: str, idx: str) -> DataFrame:
    """New users numbered after the largest id in use, in name order; known users are refused."""
    clash = names.join(mapping, user, "left_semi")
    top = mapping.agg(F.max(idx)).scalar()
    fresh = names.join(mapping.select(user), user, "left_anti")
    numbered = id_mapping(fresh, user, idx, top + 1)
    return mapping.select(user, idx).unionByName(numbered.select(user, idx)), clash


def pseudo_reviews(picks: DataFrame, day: str) -> DataFrame:
    """Ratings of pinned users as reviews with id -1 on a fixed day."""
    return picks.withColumn("review_id", F.lit(-1).cast("long")).withColumn(
        "review_date", F.lit(day).cast("timestamp_ntz")
    )


def check_known(picks: DataFrame, known: DataFrame, col: str) -> DataFrame:
    """Picked ids that the table does not hold."""
    return picks.select(col).distinct().join(known.select(col).distinct(), col, "left_anti")


def select_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns wanted that exist, in the order asked."""
    return df.select(*[c for c in cols if c in df.columns])
