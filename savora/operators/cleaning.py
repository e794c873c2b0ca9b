"""Filters, hygiene and literal parsing of the raw tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


# --- validation -----------------------------------------------------------------------------

def violations(
    df: DataFrame,
    name: str,
    not_null: Sequence[str] = (),
    unique: Sequence[str] = (),
    ranges: dict[str, tuple[float, float]] | None = None,
    list_ranges: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """One row per declared rule with the number of rows breaking it."""
    rules: list[tuple[str, str, Column]] = []
    for c in not_null:
        rules.append((c, "not_null", F.count_if(F.col(c).isNull())))
    for c, (lo, hi) in (ranges or {}).items():
        rules.append((c, "range", F.count_if(~F.col(c).between(lo, hi))))
    for c, (lo, hi) in (list_ranges or {}).items():
        rules.append((c, "list_range", F.count_if(F.exists(c, lambda x: ~x.between(lo, hi)))))
    if rules:
        flat = df.agg(*[r[2].alias(f"r{i}") for i, r in enumerate(rules)])
        entries = F.array(
            *[F.struct(F.lit(c).alias("column"), F.lit(k).alias("rule"), F.col(f"r{i}").alias("violations"))
              for i, (c, k, _) in enumerate(rules)]
        )
        out = flat.select(F.inline(entries))
    else:
        out = None
    for c in unique:
        # Copies per key first: the count of surplus rows then needs no distinct set per task.
        dup = (
            df.where(F.col(c).isNotNull()).groupBy(c).agg((F.count("*") - 1).alias("extra"))
            .agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("violations"))
            .select(F.lit(c).alias("column"), F.lit("unique").alias("rule"), "violations")
        )
        out = dup if out is None else out.unionByName(dup)
    if out is None:
        raise ValueError("no rules given")
    return out.select(F.lit(name).alias("table_name"), "column", "rule", "violations")


def parse_string_list(col: str | Column, drop_empty: bool = False) -> Column:
    """Python-literal list of strings -> array; anything unreadable or null becomes []."""
    c = F.col(col) if isinstance(col, str) else col
    text = F.regexp_replace(c, r"\bNone\b", "null")
    arr = F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    arr = F.filter(arr, lambda x: x.isNotNull())
    return F.filter(arr, lambda x: x != "") if drop_empty else arr


def parse_int_list(col: str | Column) -> Column:
    """Like `parse_string_list`, keeping the entries that are whole numbers."""
    ints = F.transform(parse_string_list(col), lambda x: x.try_cast("long"))
    return F.filter(ints, lambda x: x.isNotNull())


def coerce_count(df: DataFrame, col: str, out: str) -> DataFrame:
    """Whole-number column from text; rows that do not parse are dropped."""
    return df.withColumn(out, F.col(col).try_cast("long")).where(F.col(out).isNotNull())


def null_profile(df: DataFrame, name: str, key: str) -> DataFrame:
    """Null count per column, surplus copies of whole rows, and distinct keys."""
    cols = df.columns
    flat = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols], F.count("*").alias("__rows"))
    nulls = flat.select(
        F.inline(
            F.array(*[F.struct(F.concat(F.lit("null:"), F.lit(c)).alias("measure"), F.col(c).alias("n")) for c in cols],
                    F.struct(F.lit("rows").alias("measure"), F.col("__rows").alias("n")))
        )
    )
    dup = (
        df.groupBy(*cols).agg((F.count("*") - 1).alias("e"))
        .agg(F.coalesce(F.sum("e"), F.lit(0)).alias("n")).select(F.lit("duplicate_rows").alias("measure"), "n")
    )
    keys = df.where(F.col(key).isNotNull()).select(key).distinct().agg(F.count("*").alias("n")).select(
        F.lit("distinct_keys").alias("measure"), "n"
    )
    return nulls.unionByName(dup).unionByName(keys).select(F.lit(name).alias("table_name"), "measure", "n")


# --- row filters ----------------------------------------------------------------------------

def min_activity(review: DataFrame, min_reviews: int, user: str = "reviewer_id") -> DataFrame:
    """Reviews of users with at least `min_reviews`; counted with map-side combine."""
    active = review.groupBy(user).agg(F.count("*").alias("__n")).where(F.col("__n") >= min_reviews)
    return review.join(active.select(user), user, "left_semi")


def keep_common(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of both sides whose key occurs on the other side."""
    return (
        left.join(right.select(key).distinct(), key, "left_semi"),
        right.join(left.select(key).distinct(), key, "left_semi"),
    )


def replace_categories(diner: DataFrame, category: DataFrame, key: str, stale: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """Swap stale category columns for the processed ones, unknown levels becoming "NA"."""
    return diner.drop(*stale).join(category, key, "left").fillna("NA", subset=list(fill))


def fill_date(col: str | Column, default: str = "2015-01-01") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.try_cast("timestamp_ntz"), F.lit(default).cast("timestamp_ntz"))


def in_months(col: str | Column, months: Sequence[str]) -> Column:
    """Date falls in one of the `yyyy-MM` months."""
    return F.date_format(col, "yyyy-MM").isin(list(months))


def abusive_items(
    review: DataFrame, tokens: Column, months: Sequence[str], words: Sequence[str],
    min_words: int, min_reviews: int, item: str = "diner_idx", date: str = "review_date",
) -> DataFrame:
    """Items hit by an off-topic wave in the target months: enough different abusive words and
    enough reviews that use one."""
    # Only distinct abusive words survive in a row, so what follows is small per review.
    hit = F.array_intersect(tokens, F.array(*[F.lit(w) for w in words]))
    flagged = (
        review.where(in_months(date, months)).select(item, hit.alias("__hit")).where(F.size("__hit") > 0)
    )
    reviews = flagged.groupBy(item).agg(F.count("*").alias("n_reviews"))
    # The word list is a parameter: one 0/1 maximum per word replaces an exploded distinct count.
    distinct_words = flagged.groupBy(item).agg(
        sum((F.max(F.array_contains("__hit", w).cast("int")) for w in words), F.lit(0)).alias("n_words")
    )
    return reviews.join(distinct_words, item).where((F.col("n_words") >= min_words) & (F.col("n_reviews") >= min_reviews))


def drop_abused(
    review: DataFrame, abused: DataFrame, months: Sequence[str], item: str = "diner_idx", date: str = "review_date"
) -> DataFrame:
    """Remove the abused items' reviews inside the target months; other months stay."""
    ids = abused.select(F.col(item).alias("__a")).distinct()
    cond = (F.col(item) == F.col("__a")) & in_months(date, months)
    return review.join(ids, cond, "left_anti")


def coordinate_hygiene(df: DataFrame, lat: str, lon: str, box: tuple[float, float, float, float], numeric: Sequence[str] = ()) -> DataFrame:
    """Numeric coercion, 0 for missing measures, rows without coordinates or outside the box dropped."""
    for c in numeric:
        df = df.withColumn(c, F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)))
    df = df.withColumn(lat, F.col(lat).try_cast("double")).withColumn(lon, F.col(lon).try_cast("double"))
    lo_lat, hi_lat, lo_lon, hi_lon = box
    return df.where(F.col(lat).between(lo_lat, hi_lat) & F.col(lon).between(lo_lon, hi_lon))


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in a total order. `min` of a struct combines map-side, so a key with
    very many copies costs no more than others."""
    rest = [c for c in df.columns if c not in key and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("__f")
    return df.groupBy(*key).agg(first).select(*key, *[F.col(f"__f.{c}").alias(c) for c in [*order, *rest]]).select(*df.columns)


def address_contains(text: str, *cols: str) -> Column:
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(F.col(c).contains(text), F.lit(False))
    return cond


def mean_per_pair(review: DataFrame, user: str, item: str, score: str) -> DataFrame:
    return review.groupBy(user, item).agg(F.avg(score).alias("mean_score"))


# --- subset scan ----------------------------------------------------------------------------

def subset_scan(review: DataFrame, diner: DataFrame, prefix: str, limit: int, pinned: Sequence[int],
                item: str = "diner_idx", address: str = "address") -> DataFrame:
    """Small development set: reviews of the first `limit` diners under an address prefix and of
    pinned diners."""
    near = diner.where(F.col(address).startswith(prefix)).select(item).orderBy(item).limit(limit)
    fixed = diner.where(F.col(item).isin(list(pinned))).select(item)
    return review.join(near.unionByName(fixed).distinct(), item, "left_semi")
