"""Corpus pipeline: quality rules, near-duplicate removal, secret redaction, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's documents. All but the last return the columns of `documents`.

Rows with nulls in any column pass through: a null text has no words, so the quality rules reject it; a null
language or source is a group of its own. Equal rows are judged alike; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from savora.llm import adaptive_rules, entropy_mix, fast_sketch, residual_pack, secret_scan
from savora.llm.queries import TOKENIZER
from savora.session import materialise, scratch_path

# The near-duplicate stage uses the standing contract: five words, 0.8 or more.
SHINGLE_WORDS, SIMILAR = 5, (80, 100)
BANDS, ROWS = 48, 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the thresholds learned from this input."""
    return adaptive_rules.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate group. Rows that repeat an id are one
    document, of which the row with the largest text stays; rows without an id stay unless they equal another."""
    judged = fast_sketch.near_duplicates(docs, width=SHINGLE_WORDS, numerator=SIMILAR[0], denominator=SIMILAR[1], bands=BANDS, rows=ROWS)
    kept = judged.where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(*docs.columns)
    twice = materialise(named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    rest = [c for c in docs.columns if c != "doc_id"]
    one = named.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct("text", *[c for c in rest if c != "text"])).alias("r")).select("doc_id", "r.*").select(*docs.columns)
    nameless = docs.where("doc_id is null").dropDuplicates()
    return named.join(twice, "doc_id", "left_anti").unionByName(one).unionByName(nameless)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts and n_chars brought up to date."""
    return secret_scan.redact(docs, length="n_chars")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their copies in the mix; those with none go. Only keys pass through the mix;
    equal rows share a key and together get the copies that they were given one by one."""
    row = F.xxhash64(*docs.columns).alias("__row")
    mixed = entropy_mix.mix(docs.select("doc_id", row, "text", "source"), carry=("doc_id", "__row"))
    copies = materialise(mixed.groupBy(F.col("doc_id").alias("__id"), "__row").agg(F.sum("copies").cast("int").alias("__copies"), F.count("*").alias("__equal")).where("__copies > 0"))

    def taken(part: DataFrame) -> DataFrame:
        return part.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")).select(*docs.columns)

    joined = docs.select("*", row).join(copies.withColumnRenamed("__row", "__r"), (F.col("__row") == F.col("__r")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    return taken(joined.where("__equal = 1")).unionByName(taken(joined.where("__equal > 1").dropDuplicates(["doc_id", "__row"])))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens; a repeated document has repeated pieces."""
    return residual_pack.pack(residual_pack.pieces(docs, TOKENIZER))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_dedup),
    ("secret scan", secrets),
    ("source mix", source_mix),
    ("packing", packing),
]

# SQL expresses neither the sketches' confirmed components over whole texts at speed nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; what lies between them is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch_path(spark, f"stage{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
