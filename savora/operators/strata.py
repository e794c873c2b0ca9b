"""Jointly trained biased factors: r = mean + b_u + b_i + u.v, by SGD on strata.

Users and items fall into P buckets each by hash. A round trains the P blocks (i, i + r), which share neither a user nor an
item bucket, each in one task; P rounds are an epoch and see every rating once. Ratings of a pair are averaged first and
weigh by their number, so a block holds two buckets of vectors and the distinct pairs between them. P grows with
the vectors, the pairs and the longest list of one user or item, which is spread over P blocks. A vector is only read
and written again in rounds that hold a rating of it, so what an epoch moves grows with the ratings, not with P.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from savora.functions.hashing import hash_uniform
from savora.operators.factors import Biases, Factors
from savora.session import delete_path, materialise, scratch_path

ROWS_PER_BUCKET = 200_000
PAIRS_PER_BLOCK = 4_000_000
BATCH = 256
STEPS = 4  # the most that the ratings of one batch move a row, in single steps
SLOTS = 16  # folders of a round's vectors, by the round that reads them next


def move(target: np.ndarray, at: np.ndarray, step: np.ndarray, n: np.ndarray) -> None:
    """Add to each row of `target` its steps, n times each. A row that a batch meets more than `STEPS` times moves by the
    mean of its steps times `STEPS`, so that a hot row cannot overshoot."""
    rows, place = np.unique(at, return_inverse=True)
    total = np.zeros((len(rows), target.shape[1]))
    np.add.at(total, place, n[:, None] * step)
    times = np.bincount(place, n, len(rows))
    target[rows] += total * np.minimum(1.0, STEPS / times)[:, None]


def descend(u: np.ndarray, v: np.ndarray, ui: np.ndarray, vi: np.ndarray, r: np.ndarray, n: np.ndarray, rate: float, reg: float) -> float:
    """One step over a batch, in place. Rows are vectors with their bias in the last column; `r` is what the
    mean leaves over. Returns the weighted squared error before the step."""
    a, b = u[ui], v[vi]
    error = r - (a[:, :-1] * b[:, :-1]).sum(axis=1) - a[:, -1] - b[:, -1]
    ones = np.ones((len(r), 1))
    pull = error[:, None]
    move(u, ui, rate * (pull * np.hstack([b[:, :-1], ones]) - reg * a), n)
    move(v, vi, rate * (pull * np.hstack([a[:, :-1], ones]) - reg * b), n)
    return float((n * error * error).sum())


def _trainer(width: int, mean: float, rate: float, reg: float, seed: int, schema: pa.Schema):
    """Training of one block as a function of its Arrow table."""
    batch = BATCH

    def train(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()

        def vectors(kind: int, name: str) -> tuple[pa.Array, np.ndarray, pa.Array]:
            part = group.filter(pc.equal(group["kind"], kind))
            part = part.take(pc.sort_indices(part[name]))
            flat = part["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return part[name].combine_chunks(), np.array(flat, np.float64).reshape(-1, width), part["shifts"].combine_chunks()

        users, u, met_u = vectors(0, "user")
        items, v, met_v = vectors(1, "item")
        pairs = group.filter(pc.equal(group["kind"], 2))
        ui = pc.index_in(pairs["user"], value_set=users).to_numpy()
        vi = pc.index_in(pairs["item"], value_set=items).to_numpy()
        order = np.lexsort((vi, ui))
        order = order[np.random.default_rng([seed, group["block"][0].as_py()]).permutation(len(order))]
        ui, vi = ui[order], vi[order]
        r, n = pairs["r"].to_numpy()[order] - mean, pairs["n"].to_numpy()[order].astype(float)
        error = sum(descend(u, v, ui[at : at + batch], vi[at : at + batch], r[at : at + batch], n[at : at + batch], rate, reg) for at in range(0, len(r), batch))
        rows = len(users) + len(items)
        return pa.Table.from_arrays([
            pa.array([0] * len(users) + [1] * len(items) + [2], pa.int32()),
            pa.concat_arrays([users, pa.nulls(len(items) + 1, users.type)]).cast(schema.field("user").type),
            pa.concat_arrays([pa.nulls(len(users), items.type), items, pa.nulls(1, items.type)]).cast(schema.field("item").type),
            pa.array([None] * rows + [float(error)], pa.float64()),
            pa.array([None] * rows + [float(n.sum())], pa.float64()),
            pa.array([*u.tolist(), *v.tolist(), None], schema.field("vec").type),
            pa.array([*met_u.to_pylist(), *met_v.to_pylist(), None], schema.field("shifts").type),
        ], schema=schema)

    return train


def fit_joint(ratings: DataFrame, rank: int = 16, reg: float = 0.02, rate: float = 0.1, epochs: int = 10, seed: int = 42, parts: int | None = None) -> tuple[Biases, Factors, DataFrame]:
    """Biases, factors and the training error (epoch, ratings, mse) of the joint model over (user, item, r).

    Rows with a null are left out. A rating that occurs n times weighs n. An empty table gives
    empty tables and the mean 0. Results repeat for the same rows, seed and `parts`.
    """
    spark = ratings.sparkSession
    pairs = materialise(
        ratings.where("user is not null and item is not null and r is not null").groupBy("user", "item").agg(F.avg(F.col("r").cast("double")).alias("r"), F.count("*").cast("double").alias("n"))
    )
    whole = pairs.agg((F.sum(F.col("r") * F.col("n")) / F.sum("n")).alias("mean"), F.count("*").alias("n")).first()
    mean = float(whole["mean"] or 0.0)
    if parts is None:
        by_user, by_item = (pairs.groupBy(c).agg(F.count("*").alias("n")) for c in ("user", "item"))
        rows, longest = zip(*(x.agg(F.count("*"), F.max("n")).first() for x in (by_user, by_item)))
        parts = max(1, math.ceil(max(rows) / ROWS_PER_BUCKET), math.ceil(math.sqrt(whole["n"] / PAIRS_PER_BLOCK)), math.ceil(max(x or 0 for x in longest) / PAIRS_PER_BLOCK))
    bucket = {c: F.pmod(F.xxhash64(F.col(c), F.lit(c)), F.lit(parts)).cast("int") for c in ("user", "item")}
    path = scratch_path(spark, "strata")
    cut = pairs.withColumn("shift", F.pmod(bucket["item"] - bucket["user"], F.lit(parts)).cast("int"))
    cut.write.partitionBy("shift").parquet(path)
    work = spark.read.schema(cut.schema).parquet(path)
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("user", "item")}
    schema = f"kind int, user {kinds['user']}, item {kinds['item']}, r double, n double, vec array<double>, shifts array<int>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    null = {c: F.lit(None).cast(k).alias(c) for c, k in {**kinds, "r": "double", "n": "double", "vec": "array<double>", "shifts": "array<int>"}.items()}

    def start(name: str, kind: int) -> DataFrame:
        vec = F.array(*[(hash_uniform(f"{name}{seed}", F.col(name), F.lit(i)) - 0.5) / math.sqrt(rank) for i in range(rank)], F.lit(0.0)).alias("vec")
        met = work.groupBy(name).agg(F.array_sort(F.collect_set("shift")).alias("shifts"))
        own = {**null, name: F.col(name)}
        return met.select(F.lit(kind).alias("kind"), own["user"], own["item"], null["r"], null["n"], vec, "shifts")

    # Each round's vectors in a folder of their own, with `at`: the shift that reads a vector next, maybe in the next epoch.
    rounds, slots = scratch_path(spark, "strata-rounds"), min(parts, SLOTS)

    def put(df: DataFrame, number: int, shift: int) -> None:
        later = F.get(F.filter("shifts", lambda x: x > shift), F.lit(0))
        at = df.withColumn("at", F.when(F.col("kind") == 2, -1).otherwise(F.coalesce(later, F.get("shifts", F.lit(0)))))
        at.withColumn("slot", F.floor(F.col("at") * slots / parts).cast("int")).write.partitionBy("slot").parquet(f"{rounds}/round={number}")

    def written() -> DataFrame:
        return spark.read.schema(f"{schema}, at int, round int, slot int").parquet(rounds)

    put(start("user", 0).unionByName(start("item", 1)), 0, -1)
    history, number = [], 0
    for epoch in range(epochs):
        error = seen = 0.0
        for shift in range(parts):
            number += 1
            block = F.when(F.col("kind") == 0, bucket["user"]).otherwise(F.pmod(bucket["item"] - shift, F.lit(parts))).cast("int").alias("block")
            # A vector meant for this shift was written since the shift's last round, or in it.
            held = written().where((F.col("slot") == shift * slots // parts) & (F.col("at") == shift) & (F.col("round") >= number - parts) & (F.col("kind") < 2))
            held = held.select(block, *arrow.names)
            met = work.where(F.col("shift") == shift).select(bucket["user"].alias("block"), F.lit(2).alias("kind"), "user", "item", "r", "n", null["vec"], null["shifts"])
            train = _trainer(rank + 1, mean, rate / (1 + 0.1 * epoch), reg, seed * 1_000_003 + epoch * 1009 + shift, arrow)
            put(held.unionByName(met).groupBy("block").applyInArrow(train, schema), number, shift)
            told = written().where((F.col("round") == number) & (F.col("slot") == -1)).agg(F.sum("r").alias("e"), F.sum("n").alias("n")).first()
            error, seen = error + (told["e"] or 0.0), seen + (told["n"] or 0.0)
            if number >= parts:
                delete_path(spark, f"{rounds}/round={number - parts}")
        history.append((epoch, int(seen), error / seen if seen else 0.0))
    # A vector's last round of an epoch hands it on to a shift that is not later.
    last = (F.col("kind") < 2) & ((F.col("at") <= F.pmod(F.col("round") - 1, F.lit(parts))) if epochs else F.lit(True))
    state = materialise(written().where(last & (F.col("round") > number - parts)).select(*arrow.names).drop("shifts"))
    delete_path(spark, rounds)
    vec, bias = F.slice("vec", 1, rank).alias("vec"), F.element_at("vec", rank + 1)
    users, items = state.where("kind = 0"), state.where("kind = 1")
    biases = Biases(F.lit(mean), users.select("user", bias.alias("bu")), items.select("item", bias.alias("bi")))
    factors = Factors(users.select("user", vec), items.select("item", vec))
    return biases, factors, spark.createDataFrame(history, "epoch int, ratings long, mse double")


def predict_joint(biases: Biases, factors: Factors, pairs: DataFrame) -> DataFrame:
    """`pairs` with pred = mean + b_u + b_i + u.v; an unknown user or item adds nothing."""
    u = factors.users.join(biases.users, "user").select("user", F.col("vec").alias("__u"), F.col("bu").alias("__bu"))
    i = factors.items.join(biases.items, "item").select("item", F.col("vec").alias("__i"), F.col("bi").alias("__bi"))
    product = F.aggregate(F.zip_with("__u", "__i", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    zero = F.lit(0.0)
    pred = biases.mean + F.coalesce("__bu", zero) + F.coalesce("__bi", zero) + F.coalesce(product, zero)
    return pairs.join(u, "user", "left").join(i, "item", "left").withColumn("pred", pred).drop("__u", "__i", "__bu", "__bi")
