import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from savora.functions import ordering as O


def test_dense_index_over_buckets(spark, tiny_buckets):
    vals = random.Random(1).sample(range(10_000), 300)
    df = spark.createDataFrame([(v,) for v in vals + vals[:50]] + [(None,)], "x long")
    got = {r["x"]: r["i"] for r in O.dense_index(df, "x", "i", 100).collect()}
    assert got == {v: i + 100 for i, v in enumerate(sorted(vals))}


def test_dense_index_of_strings(spark, tiny_buckets):
    vals = [f"k{i:03d}" for i in range(100)]
    df = spark.createDataFrame([(v,) for v in vals], "x string")
    got = {r["x"]: r["i"] for r in O.dense_index(df, "x", "i").collect()}
    assert got == {v: i for i, v in enumerate(vals)}


def test_global_order_with_running_sum(spark, tiny_buckets):
    rng = random.Random(2)
    rows = [(i, rng.randint(1, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, n long")
    out = O.global_order(df, F.struct((-F.col("n")).alias("a"), F.col("id").alias("b")), {"run": F.col("n")}).collect()
    want, total = {}, 0
    for rank, (i, n) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), start=1):
        total += n
        want[i] = (rank, total)
    assert {r["id"]: (r["rn"], r["run"]) for r in out} == want


def test_prefix_sums_with_one_hot_group(spark, tiny_buckets):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randint(0, 5)}", i, rng.randint(0, 100)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, t long, v long")
    cuts = O.splitters(df, F.col("t"))
    assert len(cuts) > 10
    out = O.prefix_sums(df, ["g"], O.bucket_of(F.col("t"), cuts), [F.col("t")], {"s": F.col("v")}).toPandas()
    want = pd.DataFrame(rows, columns=["g", "t", "v"]).sort_values("t")
    want["s"] = want.groupby("g")["v"].cumsum() - want["v"]
    merged = out.merge(want, on=["g", "t"])
    assert len(merged) == 300 and (merged["s_x"] == merged["s_y"]).all()


def test_quantiles_match_numpy(spark, tiny_buckets):
    rng = np.random.default_rng(4)
    rows = [(str(i % 3), float(round(x, 2))) for i, x in enumerate(rng.normal(size=240))]
    df = spark.createDataFrame(rows, "g string, x double")
    out = O.quantiles(df, ["g"], "x", {"a": 0.25, "b": 0.5, "c": 0.9}).toPandas().set_index("g")
    for g in "012":
        want = np.quantile([x for k, x in rows if k == g], [0.25, 0.5, 0.9])
        assert np.allclose(out.loc[g, ["a", "b", "c"]].astype(float), want)
