"""Learned neighbour aggregation against a NumPy version: layers, gradients, training, saved weights."""

import random

import numpy as np
import pytest

from savora.operators import sage as S


def toy(spark, seed=5, users=6, items=7, dim=3):
    r = random.Random(seed)
    pairs = sorted({(100 + u, i) for u in range(users) for i in r.sample(range(items), 3)})
    both = pairs + [(b, a) for a, b in pairs]
    ids = sorted({x for p in pairs for x in p}) + [900]  # 900 has no neighbours
    x = np.random.default_rng(seed).normal(size=(len(ids), dim))
    features = spark.createDataFrame([(i, x[k].tolist()) for k, i in enumerate(ids)], "id long, vec array<double>")
    return pairs, both, ids, x, spark.createDataFrame(both, "src long, dst long"), features


def plain(both, ids, x, weights, how):
    """All layers over all neighbours."""
    near = {v: [b for a, b in both if a == v] for v in ids}
    at = {v: k for k, v in enumerate(ids)}
    h = x
    for w in weights:
        z = []
        for v in ids:
            block = h[[at[b] for b in near[v]]]
            part = np.zeros(h.shape[1]) if not len(block) else block.mean(axis=0) if how == "mean" else block.max(axis=0)
            z.append(np.concatenate([h[at[v]], part, [1.0]]))
        a = np.maximum(np.array(z) @ w, 0)
        n = np.linalg.norm(a, axis=1, keepdims=True)
        h = np.where(n > 0, a / np.where(n > 0, n, 1), 0)
    return h


def plain_loss(h, at, pairs):
    out = 0.0
    for label, sign in ((1, 1), (0, -1)):
        rows = [np.log1p(np.exp(-sign * h[at[a]] @ h[at[b]])) for a, b, y in pairs if y == label]
        out += sum(rows) / max(len(rows), 1)
    return out


@pytest.mark.parametrize("how", ["mean", "max"])
def test_layers_and_gradients(spark, how):
    pairs, both, ids, x, edges, features = toy(spark)
    weights = S.start_weights([3, 4, 2], seed=3)
    weights = [w + 0.2 for w in weights]  # no dead units
    at = {v: k for k, v in enumerate(ids)}
    batch = [(a, b, 1) for a, b in pairs[::3]] + [(a, 900, 0) for a, _ in pairs[::4]] + [(pairs[0][0], pairs[0][1], 1)]
    layers = S.forward(edges, features, weights, features, 50, "t", how)
    for k in (1, 2):
        want = plain(both, ids, x, weights[:k], how)
        got = {r["id"]: r["vec"] for r in layers[k - 1].rows.collect()}
        assert len(got) == len(ids)
        for v in ids:
            assert got[v] == pytest.approx(want[at[v]], abs=1e-9)
    frame = spark.createDataFrame(batch, "src long, dst long, label int")
    grad, losses = S.pair_gradients(layers[-1].rows, frame, 2)
    assert S.mean_loss(losses) == pytest.approx(plain_loss(plain(both, ids, x, weights, how), at, batch))
    got = S.backward(layers, weights, grad)
    for k, w in enumerate(weights):
        assert got[k].shape == w.shape
        for i, j in [(0, 0), (2, 1), (w.shape[0] - 2, 1), (w.shape[0] - 1, 0)]:
            moved = []
            for step in (1e-6, -1e-6):
                other = [m.copy() for m in weights]
                other[k][i, j] += step
                moved.append(plain_loss(plain(both, ids, x, other, how), at, batch))
            assert got[k][i, j] == pytest.approx((moved[0] - moved[1]) / 2e-6, abs=1e-6)


def test_only_needed_nodes_are_computed_and_neighbours_sampled(spark):
    pairs, both, ids, x, edges, features = toy(spark)
    weights = S.start_weights([3, 3, 3])
    seeds = spark.createDataFrame([(pairs[0][0],), (pairs[0][0],)], "id long")
    layers = S.forward(edges, features, weights, seeds, 2, "t")
    assert [r["id"] for r in layers[1].rows.collect()] == [pairs[0][0]]
    assert layers[1].near.count() == 2 and layers[0].rows.count() == 3
    assert layers[0].near.groupBy("src").count().where("count > 2").isEmpty()
    empty = S.sage_vectors(edges, features.limit(0), weights, 2)
    assert empty.count() == 0
    with pytest.raises(ValueError):
        S.forward(edges, features, weights, seeds, 2, "t", "median")


def test_training_lowers_the_loss_of_links_kept_out(spark, tmp_path):
    # Two groups of users and items with links inside a group; features tell the group only noisily.
    r = random.Random(1)
    rng = np.random.default_rng(1)
    users, items = range(100, 124), range(24)
    links = sorted({(u, i) for u in users for i in items if u % 2 == i % 2 and r.random() < 0.6})
    out, train = links[::6], [p for k, p in enumerate(links) if k % 6]
    edges = spark.createDataFrame(train + [(b, a) for a, b in train], "src long, dst long")
    ids = [*users, *items]
    features = spark.createDataFrame([(v, (rng.normal(size=4) + [1.0 - 2 * (v % 2), 0, 0, 0]).tolist()) for v in ids], "id long, vec array<double>")
    fit = spark.createDataFrame([(a, b, 1) for a, b in train] + [(a, b, 0) for a in users for b in items if a % 2 != b % 2 and (a + b) % 3 == 0], "src long, dst long, label int")
    kept = spark.createDataFrame([(a, b, 1) for a, b in out] + [(a, b, 0) for a in users for b in items if a % 2 != b % 2 and (a + b) % 3 == 1], "src long, dst long, label int")
    first = S.start_weights([4, 4, 4])
    weights, history = S.fit_sage(edges, features, lambda step: fit, [4, 4, 4], 5, steps=8, rate=0.1)
    assert history[-1] < history[0]
    assert S.link_loss(edges, features, weights, kept, 5) < S.link_loss(edges, features, first, kept, 5)
    S.save_weights(spark, weights, str(tmp_path / "w"))
    again = S.load_weights(spark, str(tmp_path / "w"))
    assert all(np.array_equal(a, b) for a, b in zip(weights, again))


def test_link_pairs(spark):
    pairs, both, ids, x, edges, features = toy(spark)
    got = S.link_pairs(edges, features.select("id"), 1.0, "b").collect()
    assert sorted((r["src"], r["dst"]) for r in got if r["label"] == 1) == sorted(both)
    assert all(r["src"] != r["dst"] and r["dst"] in ids for r in got if r["label"] == 0)
