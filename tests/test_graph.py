import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from savora.operators import graph as G


def _edges(spark, pairs, weights=None):
    rows = [(a, b, float((weights or {}).get((a, b), 1.0))) for a, b in pairs]
    return G.both_ways(spark.createDataFrame(rows, "src long, dst long, weight double"))


PAIRS = [(0, 1), (0, 2), (2, 3), (2, 5), (4, 5)]
META = {0: "user", 3: "user", 1: "diner", 2: "diner", 4: "diner", 5: "category"}


def test_typed_neighbors(spark):
    nodes = spark.createDataFrame(list(META.items()), "id long, meta string")
    got = {(r["src"], r["meta"], r["dst"]): r["prob"] for r in G.typed_neighbors(_edges(spark, PAIRS), nodes).collect()}
    assert got[0, "diner", 1] == got[0, "diner", 2] == 0.5
    assert got[2, "user", 0] == got[2, "user", 3] == 0.5 and got[2, "category", 5] == 1.0
    assert got[5, "diner", 2] == got[5, "diner", 4] == 0.5


def test_metapath_walks_are_complete(spark):
    nodes = spark.createDataFrame(list(META.items()), "id long, meta string")
    path = ["user", "diner", "category", "diner"]
    rows = G.metapath_walks(_edges(spark, PAIRS), nodes, path, 5, "s").collect()
    walks = defaultdict(dict)
    for r in rows:
        walks[r["start"], r["walk"]][r["step"]] = r["node"]
    both = {(a, b) for a, b in PAIRS} | {(b, a) for a, b in PAIRS}
    assert walks
    for nodes_at in walks.values():
        assert [META[nodes_at[i]] for i in range(4)] == path
        assert all((nodes_at[i], nodes_at[i + 1]) in both for i in range(3))


@pytest.fixture(scope="module")
def dense_graph():
    rng = random.Random(9)
    pairs = sorted({tuple(sorted(rng.sample(range(14), 2))) for _ in range(45)})
    return pairs, {p: rng.randint(1, 4) for p in pairs}


def test_second_order_with_triangles(spark, dense_graph):
    pairs, w = dense_graph
    e = _edges(spark, pairs, w)
    weight = {**w, **{(b, a): v for (a, b), v in w.items()}}
    nbrs = defaultdict(set)
    for a, b in weight:
        nbrs[a].add(b)
    p, q = 0.5, 2.0
    for r in G.second_order(e, p, q).collect():
        prev, cur = r["prev"], r["cur"]
        total = sum(weight[cur, x] * (1 / p if x == prev else 1 if x in nbrs[prev] else 1 / q) for x in nbrs[cur])
        assert r["norm"] == pytest.approx(total)
        mass = sum(weight[cur, x] * (r["back"] if x == prev else r["near"] if x in nbrs[prev] else r["far"]) for x in nbrs[cur])
        assert mass == pytest.approx(1.0)


def test_biased_walks_follow_edges_and_bias(spark, dense_graph):
    pairs, w = dense_graph
    rows = G.biased_walks(_edges(spark, pairs, w), 60, 3, 0.05, 1.0, "b").collect()
    walks = defaultdict(dict)
    for r in rows:
        walks[r["start"], r["walk"]][r["step"]] = r["node"]
    both = set(pairs) | {(b, a) for a, b in pairs}
    assert all(len(x) == 3 for x in walks.values())
    assert all((x[0], x[1]) in both and (x[1], x[2]) in both for x in walks.values())
    back = Counter(x[0] == x[2] for x in walks.values())
    assert back[True] > 0.7 * sum(back.values())


def _walks(df):
    out = defaultdict(dict)
    for r in df.collect():
        out[r["start"], r["walk"]][r["step"]] = r["node"]
    return out


def test_heavy_edges_are_walked(spark):
    e = _edges(spark, [(0, 1), (0, 2)], {(0, 1): 1000.0, (0, 2): 1.0})
    for walks in (G.weighted_walks(e, 400, 2, "h"), G.biased_walks(e, 400, 2, 1.0, 1.0, "h"), G.biased_walks(e, 400, 2, 20.0, 0.01, "h")):
        first = Counter(w[1] for (start, _), w in _walks(walks).items() if start == 0)
        assert first[1] >= 390 and sum(first.values()) == 400


def test_weighted_draws_match_the_weights(spark, monkeypatch):
    monkeypatch.setattr(G, "CELLS_PER_ROW", 3)
    weight = {(0, i): w for i, w in enumerate([1e-7, 0.5, 1.0, 2.5, 40.0, 6.0, 0.003, 50.0, 3e-5], start=1)}
    e = _edges(spark, list(weight), weight)
    cells = G.weighted_neighbors(e).where("src = 0").collect()
    assert len(cells) <= 3 * len(weight) and {c["cell"] for c in cells} == set(range(len(weight)))
    spans = sorted({(c["lo"], c["hi"]) for c in cells})
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    got = _walks(G.weighted_walks(e, 3000, 3, "m"))
    assert all(len(w) == 3 for w in got.values())
    first = Counter(w[1] for (start, _), w in got.items() if start == 0)
    for (_, i), w in weight.items():
        assert abs(first[i] / 3000 - w / sum(weight.values())) < 0.04


def test_biased_walks_stop_at_dead_ends(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "src long, dst long, weight double")
    for walks in (G.weighted_walks(e, 1, 5, "d"), G.biased_walks(e, 1, 5, 0.5, 2.0, "d")):
        assert {k[0]: [w[i] for i in sorted(w)] for k, w in _walks(walks).items()} == {0: [0, 1, 2], 1: [1, 2]}


def test_uniform_walks_repeat(spark):
    e = _edges(spark, PAIRS)
    a = sorted(map(tuple, G.uniform_walks(e, 3, 6, "x").collect()))
    assert a == sorted(map(tuple, G.uniform_walks(e, 3, 6, "x").collect())) and len(a) == 6 * 3 * 6


def test_walks_with_many_buckets(spark, tiny_buckets):
    e = _edges(spark, [(0, i) for i in range(1, 60)])
    places = sorted(r["place"] for r in G.numbered_neighbors(e).where("src = 0").collect())
    assert places == list(range(59))


def test_typed_negatives_keep_the_type(spark):
    nodes = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(30)], "id long, meta string")
    rows = G.typed_negatives(nodes, 4, "n").collect()
    assert len(rows) == 120 and all((r["start"] % 3 == 0) == (r["node"] % 3 == 0) for r in rows)


def test_propagation_by_hand(spark):
    e = _edges(spark, [(0, 1)], {(0, 1): 4.0})
    x = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0])], "id long, vec array<double>")
    got = {r["id"]: r["vec"] for r in G.light_propagation(e, x, 2, 1).collect()}
    assert got == {0: [0.5, 1.0], 1: [0.5, 1.0]}


def test_edge_weight_of_last_review_wins(spark):
    df = spark.createDataFrame([(1, 2, 3, "2020-01-01"), (1, 2, 5, "2020-02-01")], "u long, i long, s int, d string")
    assert G.user_item_edges(df, F.col("u"), F.col("i"), F.col("s"), ["d"]).collect()[0]["weight"] == 5.0


def test_small_weights_keep_their_ratio(spark):
    rows = [(0, 1, 0.0), (0, 2, 1e-8), (0, 3, 1e-9), (1, 0, 1.0), (2, 0, 5e9), (3, 0, 1.0)]
    e = spark.createDataFrame(rows, "src long, dst long, weight double")
    first = G.weighted_walks(e, 2200, 2, "w").where("start = 0 and step = 1").groupBy("node").count().collect()
    n = {x["node"]: x["count"] for x in first}
    assert n.get(1, 0) == 0 and sum(n.values()) == 2200 and 150 < n[3] < 255
    both = G.biased_walks(e, 300, 2, 1.0, 1.0, "b").where("start = 0 and step = 1").groupBy("node").count().collect()
    assert {x["node"] for x in both} == {2, 3}


def test_biased_walks_make_no_draw_after_a_sure_one(spark, dense_graph, monkeypatch):
    pairs, w = dense_graph
    made, draw = [], G._draw
    monkeypatch.setattr(G, "_draw", lambda walkers, *a: made.append(walkers.count()) or draw(walkers, *a))
    walks = G.biased_walks(_edges(spark, pairs, w), 5, 3, 0.5, 2.0, "c")
    n = walks.where("step = 0").count()
    # The first step keeps any draw; of later draws one in four is sure, and all rounds share a join.
    assert made[0] == n and len(made) == 2 and made[1] < 6 * n
