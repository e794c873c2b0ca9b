import random

import numpy as np
from pyspark.sql import functions as F

from savora.operators import blocks
from savora.operators import neighbors as N
from savora.operators.blocks import block_topk, pruned_topk, sliced_join


def test_block_topk_matches_numpy(spark):
    rng = np.random.default_rng(7)
    u, v = rng.integers(-2, 3, (40, 4)).astype(float), rng.integers(-2, 3, (55, 4)).astype(float)
    seen = {(i, j) for i in range(40) for j in range(55) if (i * 31 + j * 17) % 5 == 0}
    q = spark.createDataFrame([(i, u[i].tolist()) for i in range(40)], "user long, vec array<double>")
    it = spark.createDataFrame([(j + 1000, v[j].tolist()) for j in range(55)], "item long, vec array<double>")
    sn = spark.createDataFrame([(i, j + 1000) for i, j in seen], "user long, item long")
    got = block_topk(q, it, 6, seen=sn, query_block=7, item_block=9).collect()
    for i in range(40):
        want = sorted(((-(u[i] @ v[j]), j + 1000) for j in range(55) if (i, j) not in seen))[:6]
        mine = sorted((r["pos"], r["item"], r["score"]) for r in got if r["user"] == i)
        assert [(m[1], m[2]) for m in mine] == [(j, -s) for s, j in want]


def test_blocks_are_skipped_and_rows_stay(spark):
    """Lengths fall fast, one user has seen the longest items, ties lie across blocks, one vector is zero."""
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(60, 3)), 1) * np.where(np.arange(60) < 12, 8.0, 0.25)[:, None]
    v[20:24] = v[3]
    u = np.round(rng.normal(size=(12, 3)), 1)
    u[5] = 0
    seen = {(0, j) for j in range(40)} | {(1, j) for j in range(60)} | {(2, 3), (2, 3000)}
    q = spark.createDataFrame([(i, u[i].tolist()) for i in range(12)], "user long, vec array<double>")
    it = spark.createDataFrame([(j, v[j].tolist()) for j in range(60)], "item long, vec array<double>")
    sn = spark.createDataFrame([*seen, (2, 3)], "user long, item long")
    top, met = pruned_topk(q, it, 4, sn, query_block=5, item_block=6)
    got, blocks = top.collect(), {r["user"]: r["blocks"] for r in met.collect()}
    for i in range(12):
        want = sorted((-round(float(u[i] @ v[j]), 6) + 0.0, j) for j in range(60) if (i, j) not in seen)[:4]
        assert [(r["item"], r["score"]) for r in sorted((r for r in got if r["user"] == i), key=lambda r: r["pos"])] == [(j, -x + 0.0) for x, j in want]
    assert blocks[1] == 10 and min(blocks.values()) < 10 and sum(blocks.values()) < 100
    none, met = pruned_topk(q.limit(0), it, 4, sn, item_block=6)
    assert none.count() == 0 and met.count() == 0
    assert block_topk(q, it.limit(0), 4).count() == 0


def test_heavy_users_add_up(spark):
    rng = random.Random(8)
    rows = [(0, i, float(rng.randint(1, 5))) for i in range(60)] + [(u, i, float(rng.randint(1, 5))) for u in range(1, 30) for i in rng.sample(range(60), 6)]
    inter = spark.createDataFrame(rows, "user long, item long, r double")
    key = lambda r: (r["a"], r["b"], r["co"], round(r["cosine"], 9), round(r["jaccard"], 9))
    plain = sorted(map(key, N.item_pairs(inter, heavy_user=1000).collect()))
    split = sorted(map(key, N.item_pairs(inter, heavy_user=10, users_per_slice=3, item_block=16).collect()))
    every = sorted(map(key, N.item_pairs(inter, heavy_user=0, users_per_slice=3, item_block=16).collect()))
    assert plain == split == every and len(plain) == 60 * 59 // 2


def test_short_lists_are_padded_by_lowest_id(spark):
    inter = spark.createDataFrame([(1, 10, 5.0), (2, 10, 4.0), (2, 11, 3.0), (3, 12, 1.0), (3, 13, 1.0)], "user long, item long, r double")
    recs = N.recommend_for_users(inter, N.both_directions(N.item_pairs(inter)), 3).collect()
    lists = {u: [r["item"] for r in sorted((r for r in recs if r["user"] == u), key=lambda r: r["pos"])] for u in (1, 2, 3)}
    assert lists == {1: [11, 12, 13], 2: [12, 13], 3: [10, 11]}


def test_unknown_method_means_cosine(spark):
    inter = spark.createDataFrame([(1, 1, 5.0), (1, 2, 4.0), (2, 1, 3.0)], "user long, item long, r double")
    pairs = N.item_pairs(inter)
    assert N.both_directions(pairs, "what").collect() == N.both_directions(pairs, "cosine").collect()


def test_nearest_user_ties(spark):
    inter = spark.createDataFrame([(1, 1, 2.0), (2, 1, 2.0), (2, 2, 0.0), (3, 3, 1.0)], "user long, item long, r double")
    liked = spark.createDataFrame([(9, 1, 5.0), (8, 7, 1.0)], "cold long, item long, r double")
    got = N.nearest_warm_user(inter, liked, "cosine").collect()
    assert [(r["cold"], r["user"], r["sim"]) for r in got] == [(9, 1, 1.0)]


def test_save_all_needs_enough_interactions(spark):
    rows = [(u, i, 5.0) for u in range(6) for i in (1, 2)] + [(0, 3, 1.0), (1, 3, 0.5)]
    inter = spark.createDataFrame(rows, "user long, item long, r double")
    out = N.save_all_similar(inter, N.both_directions(N.item_pairs(inter)), None, 2, 10).collect()
    assert {(r["target"], r["item"]) for r in out} == {(1, 2), (2, 1), (3, 1), (3, 2)}
    assert all(r["content"] == 0 for r in out)


def test_round_trip_of_scores(spark):
    df = spark.createDataFrame([(1, 2, 0.5)], "target long, item long, sim double")
    assert N.content_similarity(df, None).select(F.sum("content")).collect()[0][0] == 0.0


def test_popular_items_are_joined_in_slices(spark):
    """An item rated by a third of the users, repeated rows, null keys and keys of one side only: equal rows for any slice."""
    r = random.Random(6)
    left = [(u, 1 if u % 3 == 0 else r.randint(2, 9), float(u % 5)) for u in range(60)] + [(0, 1, 0.0)] * 3 + [(99, None, 1.0)]
    right = [(1, c, c / 10) for c in range(25)] + [(k, 1, 0.5) for k in range(3, 12)] + [(None, 1, 1.0)]
    a = spark.createDataFrame(left, "user long, item long, r double")
    b = spark.createDataFrame(right, "item long, cand long, sim double")
    want = sorted((u, i, x, c, s) for u, i, x in left for j, c, s in right if i is not None and i == j)
    for size in (1, 4, 1000):
        got = sliced_join(a, b, "item", size).select("user", "item", "r", "cand", "sim").collect()
        assert sorted(map(tuple, got)) == want
    inter = spark.createDataFrame([(u, i, float(1 + (u * i) % 5)) for u in range(24) for i in range(9) if i == 0 and u % 3 == 0 or r.random() < 0.4], "user long, item long, r double")
    sims = N.both_directions(N.item_pairs(inter))
    lists = [sorted(map(tuple, N.recommend_for_users(inter, sims, 4, slice_size=n).collect())) for n in (2, 1000)]
    assert lists[0] == lists[1]
    liked = inter.where("user < 6").select((inter["user"] + 500).alias("cold"), "item", "r")
    for method in ("cosine", "jaccard"):
        near = [sorted(map(tuple, N.nearest_warm_user(inter, liked, method, n).collect())) for n in (2, 1000)]
        assert near[0] == near[1] and len(near[0]) == 6


def test_blocks_hand_on_only_what_can_still_win(spark, monkeypatch):
    rng = np.random.default_rng(5)
    u, v = rng.normal(size=(12, 6)), rng.normal(size=(80, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    handed, best = [], blocks._best_in_blocks
    monkeypatch.setattr(blocks, "_best_in_blocks", lambda *a: handed.append(best(*a)) or handed[-1])
    q = spark.createDataFrame([(i, u[i].tolist()) for i in range(12)], "user long, vec array<double>")
    it = spark.createDataFrame([(j, v[j].tolist()) for j in range(80)], "item long, vec array<double>")
    top, met = pruned_topk(q, it, 4, query_block=5, item_block=8)
    got = {(r["user"], r["pos"]): r["item"] for r in top.collect()}
    for i in range(12):
        want = sorted((-round(float(u[i] @ v[j]), 6), j) for j in range(80))[:4]
        assert [got[i, p] for p in range(1, 5)] == [j for _, j in want]
    assert sum(x.count() for x in handed) < 0.75 * 4 * met.agg(F.sum("blocks")).first()[0]


def test_larger_sides_fall_into_few_blocks():
    """Every vector is sent once per block of the other side; 1 650 000 vectors fell into 101 blocks."""
    assert blocks.block_size(1000) == blocks.FEWEST and -(-1_650_000 // blocks.block_size(1_650_000)) == 12
    assert blocks.block_size(10_000_000) == blocks.MOST


def test_shared_numbers_close_the_bound(spark):
    """Items differ most in a number that all queries share: with the bound by whole lengths every block was met."""
    rng = np.random.default_rng(9)
    u = np.c_[rng.normal(size=(20, 5)), np.ones(20)]
    v = np.c_[rng.normal(size=(90, 5)) * 0.1, rng.permutation(np.linspace(-5, 5, 90))]
    q = spark.createDataFrame([(i, u[i].tolist()) for i in range(20)], "user long, vec array<double>")
    it = spark.createDataFrame([(j, v[j].tolist()) for j in range(90)], "item long, vec array<double>")
    lists = {}
    for shared in (0, 1):
        top, met = pruned_topk(q, it, 3, query_block=8, item_block=9, shared=shared)
        lists[shared] = sorted(map(tuple, top.collect())), met.agg(F.sum("blocks")).first()[0]
    want = [(i, j, p + 1) for i in range(20) for p, j in enumerate(sorted(range(90), key=lambda j: (-round(float(u[i] @ v[j]), 6), j))[:3])]
    assert sorted((x[0], x[1], x[3]) for x in lists[1][0]) == sorted(want) and lists[0][0] == lists[1][0]
    assert lists[1][1] < 0.6 * lists[0][1]


def test_blocks_give_the_lists_of_all_scores(monkeypatch):
    """Ties, floors, long lists, vectors of any length, zeros and numbers that are none, over many chunks."""
    import pyarrow as pa

    monkeypatch.setattr(blocks, "QUERY_CHUNK", 8)
    monkeypatch.setattr(blocks, "ITEM_CHUNK", 32)
    r = np.random.default_rng(11)
    for trial in range(48):
        d, ni, nq, normalise, same = int(r.integers(1, 7)), int(r.integers(1, 300)), int(r.integers(1, 30)), trial % 2 == 1, trial % 3 == 0
        make = lambda m: (r.normal(size=(m, d)), r.integers(-2, 3, (m, d)).astype(float), r.normal(size=(m, d)) * 10.0 ** r.integers(-8, 3, (m, 1)), np.zeros((m, d)))[trial % 4]  # noqa: B023, E731
        u, v = make(nq), make(ni)
        if trial % 5 == 0:
            u[:, -1] = 1.0
        if trial % 7 == 0:
            v[0], u[0, 0] = np.inf, np.nan
        ids, own = r.permutation(500)[:ni], r.permutation(500)[:nq]
        ask, floor = r.integers(1, 8 if trial % 2 else 400, nq), np.where(r.random(nq) < 0.4, np.round(r.normal(size=nq), 6), np.nan)
        rows = pa.table({
            "kind": [0] * nq + [1] * ni, "id": np.concatenate([own, ids]).astype(np.int64), "ask": pa.array(ask.tolist() + [None] * ni, pa.int64()),
            "floor": pa.array([None if f != f else f for f in floor] + [None] * ni, pa.float64()), "vec": pa.array([*u.tolist(), *v.tolist()], pa.list_(pa.float64())),
        })
        got = {(x["user"], x["item"]): x["score"] for x in blocks._scorer(normalise, same, 6)(rows).to_pylist()}
        with np.errstate(all="ignore"):
            a, b = ((x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if normalise else x) for x in (u, v))
            scores = np.round(a @ b.T, 6) + 0.0
        want = {}
        for i in range(nq):
            ok = [j for j in range(ni) if scores[i, j] > -np.inf and not scores[i, j] < floor[i] and not (same and ids[j] == own[i])]
            want |= {(own[i], ids[j]): scores[i, j] for j in sorted(ok, key=lambda j: (-scores[i, j], ids[j]))[: ask[i]]}
        assert got.keys() == want.keys() and all(got[x] == want[x] or abs(got[x] - want[x]) < 2e-6 for x in want)
