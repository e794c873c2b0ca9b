"""List-wise ranker: gradients against all pairs, learning, early stop, saving."""

import math
import random

import pytest
from pyspark.sql import functions as F

from savora.operators import listwise as L
from savora.operators import reranking as R


def rows_of(spark, lists):
    data = [(u, i, t, [i % 3, i % 2], float(s)) for u, rows in lists.items() for i, (t, s) in enumerate(rows)]
    return spark.createDataFrame(data, "user long, item long, target int, bins array<int>, score double")


def brute_gradients(rows, k):
    """Every pair of a list, by the change of NDCG@k when the two swap places."""
    order = sorted(range(len(rows)), key=lambda i: (-rows[i][1], i))
    place = {i: p for p, i in enumerate(order)}
    disc = lambda p: 1 / math.log2(p + 2) if p < k else 0.0
    ideal = sum(disc(p) for p in range(min(k, sum(t > 0 for t, _ in rows))))
    g, h = [0.0] * len(rows), [0.0] * len(rows)
    for i, (ti, si) in enumerate(rows):
        for j, (tj, sj) in enumerate(rows):
            if ti > tj and ideal:
                swing = abs(disc(place[i]) - disc(place[j])) * abs(2**ti - 2**tj) / ideal
                rho = 1 / (1 + math.exp(si - sj))
                g[i] += rho * swing
                g[j] -= rho * swing
                h[i] += rho * (1 - rho) * swing
                h[j] += rho * (1 - rho) * swing
    return g, h


@pytest.mark.parametrize("k", [1, 3, 20])
def test_gradients_against_all_pairs(spark, k):
    r = random.Random(k)
    lists = {u: [(int(r.random() < 0.3), r.choice([0.0, 0.5, r.random()])) for _ in range(n)] for u, n in enumerate([1, 2, 5, 30, 400])}
    lists[9] = [(0, 0.1), (0, 0.3)]  # no positive row
    got = L.swap_gradients(rows_of(spark, lists).repartition(5), k).groupBy("user", "item").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum(F.col("own").cast("int")).alias("n")).collect()
    assert len(got) == sum(map(len, lists.values())) and all(x["n"] == 1 for x in got)
    for u, rows in lists.items():
        g, h = brute_gradients(rows, k)
        for x in (x for x in got if x["user"] == u):
            assert x["g"] == pytest.approx(g[x["item"]], abs=1e-9) and x["h"] == pytest.approx(h[x["item"]], abs=1e-9)


def pairs_of(spark, seed, users=60):
    """Items liked by how they compare inside a list: a user's offset hides it from a pointwise view."""
    r = random.Random(seed)
    data = []
    for u in range(users):
        shift = r.uniform(-5, 5)
        made = [(r.random(), r.random()) for _ in range(30)]
        top = sorted(made, reverse=True)[: 5 if u % 2 else 2]
        data += [(u, i, int((a, b) in top and r.random() < 0.9), a, b, shift + a, None if i % 7 == 0 else b) for i, (a, b) in enumerate(made)]
    return spark.createDataFrame(data, "user long, item long, target int, a double, b double, c double, d double")


def ndcg(df, k=20):
    return L.mean_ndcg(df.withColumnRenamed("pred", "score"), k)


def test_learns_better_lists_than_pointwise_trees(spark, tmp_path):
    train, valid = pairs_of(spark, 1), pairs_of(spark, 2)
    features = ["a", "b", "c", "d"]
    model = L.fit_listwise(train, features, valid, rounds=8, rate=0.3, patience=3)
    mine = ndcg(model.score(valid))
    assert mine > ndcg(valid.withColumn("pred", F.lit(0.0))) + 0.2 and mine >= ndcg(R.score_pairs(R.fit_ranker(train.fillna(-1.0), features, iterations=5, depth=3), valid.fillna(-1.0))) - 1e-9
    assert mine == pytest.approx(max(model.history)) and len(model.trees) == model.history.index(max(model.history)) + 1
    model.save(spark, str(tmp_path / "m"))
    again = L.ListwiseRanker.load(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, again.score(valid).select("user", "item", "pred").collect())) == sorted(map(tuple, model.score(valid).select("user", "item", "pred").collect()))


def test_edges(spark):
    empty = pairs_of(spark, 1).limit(0)
    assert L.fit_listwise(empty, ["a"], rounds=1).score(empty).count() == 0
    odd = spark.createDataFrame([(1, 1, 1, 0.5), (1, 1, 0, 0.1), (1, 2, 0, None), (None, 3, 1, 0.2), (2, 4, None, 0.1), (3, 5, 0, 0.3)], "user long, item long, target int, a double")
    assert L.fit_listwise(odd, ["a"], rounds=2).score(odd).where("pred is null").count() == 0


def test_folds_keep_lists_whole(spark):
    pairs = pairs_of(spark, 3, 12).select("user", "item", "target", "a")
    got = L.out_of_fold_lists(pairs, ["a"], 2, "f", rounds=1, depth=2)
    assert got.count() == pairs.count() and got.groupBy("user").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
