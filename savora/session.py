"""Session helpers: a local session for tests and lineage cutting for iterative jobs."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = 8, partitions: int = 8, app: str = "savora") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: `spark.checkpoint.dir`. Only a local master may fall back to
    a temporary folder, since there every task runs on this machine."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="savora-checkpoint-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so that long iterations neither grow the plan nor
    depend on executors staying alive."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialise(df: DataFrame) -> DataFrame:
    """Write a frame that several branches read to the shared folder and read it back, so that
    its sources are scanned once. The file sizes also let Spark choose broadcast joins."""
    path = scratch_path(df.sparkSession, "table")
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of what is written inside go when it is written: nothing else reads them, and they would stay on the
    executors' disks until the driver happens to collect its garbage, round after round of a loop."""
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO, before)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that must not be broadcast. Spark takes an exploded frame for as large as it was before the
    explode, and a compressed file for the rows in it, so it may send to the driver what grows with the input."""
    return df.hint("merge")


# A stage of a join and aggregates keeps some hundred bytes a row in each task.
ROWS_PER_TASK = 1_000_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df`, of about `rows` rows, dealt by `keys` so that a task gets about ROWS_PER_TASK of them. Adaptive execution
    merges partitions by their compressed bytes, down to one per core, whatever a row then needs in memory."""
    n = -(-rows // ROWS_PER_TASK)
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df


def release(df: DataFrame) -> None:
    """Delete the files of a materialised frame that no later job reads."""
    delete_path(df.sparkSession, df.written_path)


_RUN_FOLDERS: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table, in this run's own folder of the shared folder. The run's
    folder is deleted when the process ends."""
    base = shared_dir(spark)
    run = _RUN_FOLDERS.get(base)
    if run is None:
        run = _RUN_FOLDERS[base] = f"{base}/savora-run-{uuid.uuid4().hex[:12]}"
        atexit.register(delete_path, spark, run)
    return f"{run}/{name}-{uuid.uuid4().hex[:12]}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete files that this run wrote in the shared folder."""
    sc = spark.sparkContext
    if sc._jsc is None:  # already stopped
        return
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
