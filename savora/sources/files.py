"""File sources and sinks of the review log, candidates, regions and similar items."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

REVIEW_SCHEMA = T.StructType([
    T.StructField("diner_idx", T.LongType()),
    T.StructField("review_id", T.LongType()),
    T.StructField("reviewer_id", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("text", T.StringType()),
    T.StructField("review_date", T.TimestampNTZType()),
])
REVIEWER_SCHEMA = T.StructType([
    T.StructField("reviewer_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("reviewer_avg", T.DoubleType()),
    T.StructField("badge_grade", T.StringType()),
    T.StructField("badge_level", T.IntegerType()),
])


@dataclass(frozen=True)
class Dataset:
    """The four frames every job starts from; all are required."""

    review: DataFrame
    reviewer: DataFrame
    diner: DataFrame
    category: DataFrame

    def __post_init__(self):
        missing = [n for n in ("review", "reviewer", "diner", "category") if getattr(self, n) is None]
        if missing:
            raise ValueError(f"missing frames: {', '.join(missing)}")

    def sizes(self) -> DataFrame:
        out = None
        for n in ("review", "reviewer", "diner", "category"):
            one = getattr(self, n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("frame"), "n_rows")
            out = one if out is None else out.unionByName(one)
        return out


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV (header row, multi-line quoted text) or parquet by file extension."""
    if ".csv" in path:
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        return (reader.schema(schema) if schema else reader).csv(path)
    return spark.read.parquet(path)


def review_log(review: DataFrame, reviewer: DataFrame) -> DataFrame:
    """Reviews with their reviewer's attributes; reviews of unknown reviewers stay."""
    return review.join(reviewer, "reviewer_id", "left")


def write_candidates(df: DataFrame, path: str) -> None:
    df.select(
        F.col("user_id").cast("long"), F.col("diner_id").cast("long"), F.col("score").cast("double")
    ).write.mode("overwrite").parquet(path)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("user_id long, diner_id long, score double").parquet(path)


def write_regions_csv(cells: DataFrame, path: str, region_col: str = "region_name") -> None:
    """One folder of CSV files per region, the region in the folder name only."""
    cells.write.mode("overwrite").option("header", True).partitionBy(region_col).csv(path)


def read_regions_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Union of region files; the region name comes from the file path, and a cell listed by
    several regions is kept once, for the first name in order."""
    raw = (
        spark.read.option("header", True).schema(schema).csv(f"{path}/*")
        .withColumn("region_name", F.regexp_extract(F.input_file_name(), r"region_name=([^/]+)", 1))
    )
    w = W.partitionBy("cell_id").orderBy("region_name")
    return raw.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def geojson_features(cells: DataFrame, corners: str, properties: list[str]) -> DataFrame:
    """One GeoJSON polygon feature per cell; `corners` is an array of (lon, lat) structs."""
    ring = F.transform(corners, lambda p: F.array(p["lon"], p["lat"]))
    closed = F.concat(ring, F.slice(ring, 1, 1))
    return cells.select(
        F.to_json(
            F.struct(
                F.lit("Feature").alias("type"),
                F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates")).alias("geometry"),
                F.struct(*properties).alias("properties"),
            )
        ).alias("value")
    )


def write_geojson(features: DataFrame, path: str) -> None:
    """Newline-delimited features, one file per partition."""
    features.write.mode("overwrite").text(path)


def similar_items_json(sims: DataFrame, target: str, item: str, score: str) -> DataFrame:
    """target -> [[item, score rounded to 2], ...], best first. Lists are top-k, so bounded."""
    pairs = F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(item).alias("i"))))
    entry = lambda p: F.concat(F.lit("["), p["i"].cast("string"), F.lit(","), F.format_string("%.2f", F.floor(-p["s"] * 100 + 0.5) / 100), F.lit("]"))
    return sims.groupBy(target).agg(
        F.concat(F.lit("["), F.array_join(F.transform(pairs, entry), ","), F.lit("]")).alias("similar")
    )
