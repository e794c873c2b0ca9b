"""Neighbour aggregation with learned weights.

Layer k maps the vector of a node and the mean (or maximum) of its sampled neighbours' vectors to
relu([own, neighbours, 1] W_k), scaled to length 1. Only nodes that a mini-batch of pairs reaches are
computed, layer by layer with joins and map-side aggregates, and gradients go back over the same sampled
edges. What a task adds to the gradient of a weight matrix is one row; Spark sums them. The weight
matrices, whose size does not depend on the graph, are all that the driver holds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from savora.functions.hashing import hash_uniform
from savora.operators.graph import aggregate_vectors, sample_neighbors, uniform_negatives
from savora.session import materialise


@dataclass
class Layer:
    """What one layer read and gave: sampled edges (src, dst), rows (id, z, vec), for the maximum also (src, winners)."""

    near: DataFrame
    rows: DataFrame
    winners: DataFrame | None = None


def start_weights(sizes: Sequence[int], seed: int = 42) -> list[np.ndarray]:
    """One (2 * size + 1) x next size matrix per layer, with a last row of zeros as bias."""
    rng = np.random.default_rng(seed)
    out = []
    for a, b in zip(sizes, sizes[1:]):
        bound = (6.0 / (2 * a + b)) ** 0.5
        out.append(np.vstack([rng.uniform(-bound, bound, (2 * a, b)), np.zeros((1, b))]))
    return out


def _zeros(n: int) -> Column:
    return F.array(*[F.lit(0.0)] * n)


def _largest(msg: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(src, nvec) element-wise maxima and (src, winners): the neighbour each came from, the smallest id of equals."""
    best = [F.max(F.struct(F.get("vec", F.lit(i)).alias("v"), (-F.col("dst")).alias("d"))).alias(f"__m{i}") for i in range(dim)]
    top = msg.groupBy("src").agg(*best)
    return (
        top.select("src", F.array(*[F.col(f"__m{i}.v") for i in range(dim)]).alias("nvec")),
        top.select("src", F.array(*[-F.col(f"__m{i}.d") for i in range(dim)]).alias("winners")),
    )


def forward(edges: DataFrame, features: DataFrame, weights: Sequence[np.ndarray], seeds: DataFrame, sample: int, seed: str, how: str = "mean") -> list[Layer]:
    """Layers 1..L for the seeds (id) and whatever nodes their sampled neighbourhoods need; the last holds the seeds.

    features: (id, vec) for every node. Nodes without neighbours see zeros. Only edges of needed nodes are ranked
    and sampled; a hub's candidates are cut to `sample` before the shuffle.
    """
    if how not in ("mean", "max"):
        raise ValueError(f"unknown aggregate {how}")
    need = [materialise(seeds.select("id").distinct())]
    near: list[DataFrame] = []
    for k in range(len(weights), 0, -1):
        hit = edges.select("src", "dst").join(need[0].select(F.col("id").alias("src")), "src", "left_semi")
        near.insert(0, materialise(sample_neighbors(hit, sample, f"{seed}-{k - 1}")))
        need.insert(0, materialise(need[0].unionByName(near[0].select(F.col("dst").alias("id"))).distinct()))
    h = features.select("id", F.transform("vec", lambda x: x.cast("double")).alias("vec")).join(need[0], "id", "left_semi")
    layers = []
    for w, edge, ids in zip(weights, near, need[1:]):
        dim = (w.shape[0] - 1) // 2
        msg = edge.join(h.withColumnRenamed("id", "dst"), "dst")
        won = None
        if how == "max":
            nbr, won = _largest(msg, dim)
            won = materialise(won)
        else:
            nbr = aggregate_vectors(msg, "src", "vec", dim).withColumnRenamed("vec", "nvec")
        z = F.concat("vec", F.coalesce("nvec", _zeros(dim)), F.array(F.lit(1.0)))
        blocks = ids.join(h, "id").join(nbr.withColumnRenamed("src", "id"), "id", "left").select("id", z.alias("z"))
        rows = materialise(blocks.mapInPandas(_layer(w), "id long, z array<double>, vec array<double>"))
        layers.append(Layer(edge, rows, won))
        h = rows.select("id", "vec")
    return layers


# Task functions carry all they need: executors have NumPy and pandas, not this package.
def _layer(w: np.ndarray):
    def run(batches):
        for pdf in batches:
            if len(pdf):
                a = np.maximum(np.stack(pdf["z"].to_numpy()) @ w, 0.0)
                size = np.linalg.norm(a, axis=1, keepdims=True)
                pdf["vec"] = list(np.divide(a, size, out=np.zeros_like(a), where=size > 0))
                yield pdf

    return run


def _layer_back(w: np.ndarray):
    """Gradients by the layer's input, and the task's share of the gradient by the weights in one row without id."""

    def run(batches):
        total = None
        for pdf in batches:
            if not len(pdf):
                continue
            z, g = np.stack(pdf["z"].to_numpy()), np.stack(pdf["g"].to_numpy())
            a = np.maximum(z @ w, 0.0)
            size = np.linalg.norm(a, axis=1, keepdims=True)
            size[size == 0] = np.inf
            h = a / size
            down = (g - h * (h * g).sum(axis=1, keepdims=True)) / size * (a > 0)
            total = z.T @ down if total is None else total + z.T @ down
            yield pd.DataFrame({"id": pdf["id"].astype("Int64"), "dz": list(down @ w.T), "dw": None})
        if total is not None:
            yield pd.DataFrame({"id": pd.array([None], "Int64"), "dz": [None], "dw": [total.ravel()]})

    return run


def backward(layers: Sequence[Layer], weights: Sequence[np.ndarray], grad: DataFrame) -> list[np.ndarray]:
    """Gradients of all weight matrices from the gradient (id, vec) by the vectors of the last layer."""
    out: list[np.ndarray] = []
    for k in range(len(weights) - 1, -1, -1):
        w, layer = weights[k], layers[k]
        dim = (w.shape[0] - 1) // 2
        rows = layer.rows.select("id", "z").join(grad.select("id", F.col("vec").alias("g")), "id")
        back = materialise(rows.mapInPandas(_layer_back(w), "id long, dz array<double>, dw array<double>"))
        flat = back.where("dw is not null").select(F.posexplode("dw").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
        total = np.zeros(w.size)
        for r in flat:
            total[r["at"]] = r["x"]
        out.insert(0, total.reshape(w.shape))
        if k == 0:
            break
        back = back.where("dz is not null")
        own = back.select("id", F.slice("dz", 1, dim).alias("vec"), F.lit(1.0).alias("w"))
        theirs = back.select(F.col("id").alias("src"), F.slice("dz", dim + 1, dim).alias("vec"))
        if layer.winners is None:
            degree = layer.near.groupBy("src").agg(F.count("*").alias("n"))
            sent = layer.near.join(degree, "src").join(theirs, "src").select(F.col("dst").alias("id"), "vec", (1.0 / F.col("n")).alias("w"))
        else:
            at = theirs.join(layer.winners, "src").select(F.posexplode(F.arrays_zip("winners", "vec")).alias("at", "b"))
            placed = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(i == F.col("at"), F.col("b.vec")).otherwise(0.0))
            sent = at.select(F.col("b.winners").alias("id"), placed.alias("vec"), F.lit(1.0).alias("w"))
        grad = aggregate_vectors(own.unionByName(sent), "id", "vec", dim, "sum", F.col("w"))
    return out


def pair_gradients(vectors: DataFrame, pairs: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Gradient (id, vec) and losses (label, loss) of -ln sigmoid(u.v) over pairs (src, dst, label) with label 1
    and -ln sigmoid(-u.v) over those with label 0, both as means over their label. Repeated pairs count again."""
    side = lambda name: vectors.select(F.col("id").alias(name), F.col("vec").alias(f"v_{name}"))
    sizes = pairs.groupBy("label").agg(F.count("*").alias("n"))
    sign = F.when(F.col("label") == 1, 1.0).otherwise(-1.0)
    dot = F.aggregate(F.zip_with("v_src", "v_dst", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    rows = pairs.join(sizes, "label").join(side("src"), "src").join(side("dst"), "dst").withColumn("m", sign * dot)
    rows = materialise(rows.withColumn("w", -sign / (1 + F.exp("m")) / F.col("n")))
    parts = rows.select(F.col("src").alias("id"), F.col("v_dst").alias("vec"), "w").unionByName(rows.select(F.col("dst").alias("id"), F.col("v_src").alias("vec"), "w"))
    return aggregate_vectors(parts, "id", "vec", dim, "sum", F.col("w")), rows.select("label", F.log1p(F.exp(-F.col("m"))).alias("loss"))


def mean_loss(losses: DataFrame) -> float:
    """Mean loss of the linked pairs plus that of the others; 0 without pairs."""
    return losses.groupBy("label").agg(F.avg("loss").alias("x")).agg(F.sum("x")).first()[0] or 0.0


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("src", "dst")).alias("id"))


def link_pairs(edges: DataFrame, nodes: DataFrame, share: float, seed: str) -> DataFrame:
    """A mini-batch (src, dst, label): a share of the edges by hash, and as label 0 one node drawn uniformly for every end."""
    linked = edges.select("src", "dst").where(hash_uniform(seed, F.col("src"), F.col("dst")) < share)
    drawn = uniform_negatives(nodes, 1, seed).select(F.col("start").alias("src"), F.col("node").alias("far"))
    other = linked.join(drawn, "src").where("far <> src").select("src", F.col("far").alias("dst"))
    return linked.withColumn("label", F.lit(1)).unionByName(other.withColumn("label", F.lit(0)))


def fit_sage(edges: DataFrame, features: DataFrame, pairs: Callable[[int], DataFrame], sizes: Sequence[int], sample: int, steps: int = 10, rate: float = 0.02, how: str = "mean", seed: str = "sage", start: Sequence[np.ndarray] | None = None) -> tuple[list[np.ndarray], list[float]]:
    """Weights learned on mini-batches and the loss before every step.

    `pairs(step)` gives (src, dst, label); `sizes` are the widths of the features and of every layer. Neighbours are
    drawn anew at each step. Steps are scaled per weight by running means of gradients and squares (Adam).
    """
    features = materialise(features.select("id", "vec"))
    edges = materialise(edges.select("src", "dst"))
    weights = [w.copy() for w in (start or start_weights(sizes))]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    history = []
    for step in range(steps):
        batch = materialise(pairs(step).select("src", "dst", "label"))
        layers = forward(edges, features, weights, _ends(batch), sample, f"{seed}-{step}", how)
        grad, losses = pair_gradients(layers[-1].rows, batch, sizes[-1])
        history.append(mean_loss(losses))
        for i, g in enumerate(backward(layers, weights, materialise(grad))):
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.999 * square[i] + 0.001 * g * g
            ahead = mean[i] / (1 - 0.9 ** (step + 1))
            weights[i] = weights[i] - rate * ahead / (np.sqrt(square[i] / (1 - 0.999 ** (step + 1))) + 1e-8)
    return weights, history


def sage_vectors(edges: DataFrame, features: DataFrame, weights: Sequence[np.ndarray], sample: int, seed: str = "sage", how: str = "mean", nodes: DataFrame | None = None) -> DataFrame:
    """(id, vec) of the given nodes, by default of all that have features; new nodes need features and edges, no training."""
    return forward(edges, features, weights, features if nodes is None else nodes, sample, seed, how)[-1].rows.select("id", "vec")


def link_loss(edges: DataFrame, features: DataFrame, weights: Sequence[np.ndarray], pairs: DataFrame, sample: int, seed: str = "sage", how: str = "mean") -> float:
    """The loss of given pairs, for instance of links kept out of training."""
    pairs = materialise(pairs)
    vec = sage_vectors(edges, features, weights, sample, seed, how, _ends(pairs))
    return mean_loss(pair_gradients(vec, pairs, weights[-1].shape[1])[1])


def save_weights(spark, weights: Sequence[np.ndarray], path: str) -> None:
    """One row (layer, width, values) per matrix, as Parquet."""
    rows = [(i, int(w.shape[1]), [float(x) for x in w.ravel()]) for i, w in enumerate(weights)]
    spark.createDataFrame(rows, "layer int, width int, values array<double>").write.mode("overwrite").parquet(path)


def load_weights(spark, path: str) -> list[np.ndarray]:
    return [np.array(r["values"]).reshape(-1, r["width"]) for r in spark.read.parquet(path).orderBy("layer").collect()]
