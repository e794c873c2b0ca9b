"""Gradients through the propagation against finite differences, and learning."""

import random

import numpy as np
import pytest

from savora.operators import graph as G


def toy(spark, seed=3, users=6, items=7):
    r = random.Random(seed)
    pairs = sorted({(100 + u, i) for u in range(users) for i in r.sample(range(items), 3)})
    df = spark.createDataFrame([(a, b, 1.0 + (a + b) % 3) for a, b in pairs], "src long, dst long, weight double")
    return pairs, G.both_ways(df)


def test_gradient_equals_finite_differences(spark):
    dim, layers = 3, 2
    pairs, edges = toy(spark)
    ids = sorted({x for p in pairs for x in p})
    at = {v: i for i, v in enumerate(ids)}
    rng = np.random.default_rng(1)
    start = rng.normal(size=(len(ids), dim))
    triples = [(u, p, n) for u, p in pairs[::2] for n in range(7) if (u, n) not in pairs and n in at][:14]
    a = np.zeros((len(ids), len(ids)))
    for x, y, w in edges.select("src", "dst", "weight").collect():
        a[at[x], at[y]] = w
    d = a.sum(axis=1)
    a = a / np.sqrt(d[:, None] * d[None, :])
    whole = sum(np.linalg.matrix_power(a, k) for k in range(layers + 1)) / (layers + 1)

    def loss(e):
        v = whole @ e
        return sum(np.log1p(np.exp(-v[at[u]] @ (v[at[p]] - v[at[n]]))) for u, p, n in triples)

    frame = spark.createDataFrame([(i, start[at[i]].tolist()) for i in ids], "id long, vec array<double>")
    norm = G.normalised_edges(edges)
    out = G.propagate(norm, frame, dim, layers)
    grad, losses = G.pairwise_gradients(out, spark.createDataFrame(triples, "user long, positive long, negative long"), dim)
    assert losses.agg({"loss": "sum"}).first()[0] == pytest.approx(loss(start))
    full = frame.select("id").join(grad, "id", "left").selectExpr("id", "coalesce(vec, array(0D, 0D, 0D)) as vec")
    back = {x["id"]: x["vec"] for x in G.propagate(norm, full, dim, layers).collect()}
    for i in ids[::3]:
        for k in range(dim):
            e = start.copy()
            e[at[i], k] += 1e-6
            f = start.copy()
            f[at[i], k] -= 1e-6
            assert back[i][k] == pytest.approx((loss(e) - loss(f)) / 2e-6, abs=1e-5)


def test_training_lowers_the_loss(spark):
    pairs, edges = toy(spark, 4)
    ids = spark.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p})], "id long")
    triples = spark.createDataFrame([(u, p, n) for u, p in pairs for n in range(7) if (u, n) not in pairs], "user long, positive long, negative long")
    learned, history = G.fit_light(edges, lambda epoch: triples, G.hash_vectors(ids, 4, "s"), 4, 1, epochs=4, rate=0.3)
    assert history[-1] < history[0] and learned.count() == ids.count()
