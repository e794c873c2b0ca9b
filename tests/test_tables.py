from datetime import datetime

from pyspark.sql import functions as F

from savora import session
from savora.sources.tables import Tables


def _tables(spark, path):
    orders = [(o, o % 7 if o % 11 else None, datetime(1998, 6, 1 + o % 28)) for o in range(40)] + [(3, 3, datetime(1999, 1, 1)), (None, 1, datetime(1998, 6, 1))]
    lines = [(o if o % 13 else None, p, float(o + k)) for o in range(45) for k, p in enumerate((1, 2, 2, None))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{path}/lineitem.parquet")
    return lambda: Tables(spark, str(path)).review


def test_review_log_deals_its_rows_to_tasks_by_number(spark, tmp_path, monkeypatch):
    """Adaptive execution merged the join's partitions by bytes, so a task's sorts and hash tables grew with the table."""
    review = _tables(spark, tmp_path)
    before = review()
    rows, parts = sorted(map(str, before.collect())), before.rdd.getNumPartitions()
    monkeypatch.setattr(session, "ROWS_PER_TASK", 7, raising=False)
    for limit in ("-1", "10m"):  # merge join, broadcast join
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            after = review()
            assert sorted(map(str, after.collect())) == rows
            if limit == "-1":
                assert after.rdd.getNumPartitions() == 26 > parts  # 180 lines
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_written_frames_leave_no_shuffle_behind(spark):
    """A loop that writes its state each round kept every round's shuffle on disk until the driver collected its garbage."""
    import time

    from savora.session import SHUFFLES_GO, materialise

    held = lambda: spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    before, setting = held(), spark.conf.get(SHUFFLES_GO, "false")
    for _ in range(3):
        out = materialise(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 10
    while held() > before and time.time() < until:
        time.sleep(0.1)
    assert held() <= before and spark.conf.get(SHUFFLES_GO, "false") == setting and out.count() == 7
