import random

import pytest
from pyspark.sql import functions as F

from savora import session
from savora.operators import evaluation as V
from savora.operators import features as E
from savora.operators import graph as G
from savora.operators import ids as I
from savora.operators import listwise as L
from savora.operators import negatives as NG
from savora.operators import reranking as R
from savora.plans import reranking as RP
from savora.sources.tables import Tables


@pytest.fixture(scope="module")
def log():
    rng = random.Random(10)
    rows = [(0, i) for i in range(37)] + [(1, i) for i in range(40)]
    rows += [(u, i) for u in range(2, 25) for i in rng.sample(range(40), 5)]
    return rows


def _by_user(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["user"], []).append(r["item"])
    return out


def test_random_negatives(spark, log):
    inter = spark.createDataFrame(log, "user long, item long")
    got = _by_user(NG.random_negatives(inter, 8, "s"))
    seen = {u: {i for v, i in log if v == u} for u in range(25)}
    assert 1 not in got  # knows every item
    assert set(got[0]) == {37, 38, 39} and len(got[0]) == 8  # too few unseen: repeated
    for u in range(2, 25):
        assert len(got[u]) == len(set(got[u])) == 8 and not set(got[u]) & seen[u]


def test_popular_limits_match_brute_force(spark, log):
    inter = spark.createDataFrame(log, "user long, item long")
    limits, ranked = NG.popular_limits(inter, NG._seen(inter))
    order = [r["item"] for r in sorted(ranked.collect(), key=lambda r: r["idx"])]
    for r in limits.collect():
        unseen = [i for i in order if (r["user"], i) not in set(log)]
        t = len(unseen) // 2
        assert r["t"] == t
        if t:
            allowed = {i for i in order[: r["limit"]] if (r["user"], i) not in set(log)}
            assert allowed == set(unseen[:t])


def test_popular_negatives_stay_popular(spark, log):
    inter = spark.createDataFrame(log, "user long, item long")
    got = _by_user(NG.popular_negatives(inter, 6, "p"))
    counts = {i: sum(1 for _, j in log if j == i) for i in range(40)}
    order = sorted(counts, key=lambda i: (-counts[i], i))
    for u, items in got.items():
        unseen = [i for i in order if (u, i) not in set(log)]
        assert set(items) <= set(unseen[: len(unseen) // 2]) and len(items) == 6


def test_diverse_negatives_spread(spark, log):
    inter = spark.createDataFrame(log, "user long, item long")
    cats = spark.createDataFrame([(i, "abcd"[i % 4]) for i in range(40)], "item long, label string")
    rows = NG.diverse_negatives(inter, cats, ["a", "b", "c"], 7, "d").collect()
    for u in range(2, 25):
        mine = [r for r in rows if r["user"] == u]
        per = [sum(1 for r in mine if r["source"] == "category" and r["item"] % 4 == k) for k in range(4)]
        assert per == [3, 2, 2, 0] and len(mine) == 7
    short = [r for r in rows if r["user"] == 0]
    assert len(short) == 7 and {r["item"] for r in short} == {37, 38, 39}


def _joined_plans(monkeypatch, module, run):
    """Physical plans, before they run, of what `run` writes and returns."""
    plans, write = [], module.materialise

    def keep(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(module, "materialise", keep)
    out = run()
    return [*plans, out._jdf.queryExecution().executedPlan().toString()]


def test_exploded_draws_are_not_broadcast(spark, monkeypatch):
    """An exploded frame has the estimated size of its source, so Spark would send all draws to the driver."""
    inter = spark.range(400).selectExpr("id % 40 AS user", "id * 7 % 60 AS item")
    plans = _joined_plans(monkeypatch, NG, lambda: NG.random_negatives(inter, 5, "s"))
    drawn = [p for p in plans if "Generate explode" in p and "Join" in p]
    assert drawn and not any("BroadcastExchange" in p for p in drawn)


def test_padded_lists_are_not_broadcast(spark):
    users = spark.range(30).select(F.col("id").alias("user"))
    top = spark.range(50).selectExpr("CAST(id + 1 AS INT) AS pos", "id AS item")
    seen = spark.range(60).selectExpr("id % 30 AS user", "id % 50 AS item")
    padded = V.pad_lists(V.drop_seen(V.spread_list(top, users, 10), seen), users, 10)
    assert "BroadcastExchange" not in padded._jdf.queryExecution().executedPlan().toString()
    assert padded.count() == 300


def test_draws_are_dealt_to_tasks_by_number(spark, monkeypatch):
    """Adaptive execution merged the shuffles of the draws by bytes, so a task's sorts grew with the users."""
    inter = spark.range(400).selectExpr("id % 40 AS user", "id * 7 % 60 AS item")
    before = sorted(map(tuple, NG.random_negatives(inter, 5, "s").select("user", "item", "draw").collect()))
    monkeypatch.setattr(session, "ROWS_PER_TASK", 7)
    plans = _joined_plans(monkeypatch, NG, lambda: NG.random_negatives(inter, 5, "s"))
    drawn = [p for p in plans if "Generate explode" in p and "WindowGroupLimit" in p]
    dealt = -(-40 * 5 * NG.OVERDRAW // 7)  # 40 users
    assert drawn and drawn[0].count(f", {dealt}), REPARTITION_BY_NUM") == 3
    assert sorted(map(tuple, NG.random_negatives(inter, 5, "s").select("user", "item", "draw").collect())) == before


def test_tables_of_users_and_items_are_not_broadcast(spark, monkeypatch):
    """A compressed file, or a sum over it, has the estimated size of its bytes; Spark sent such tables to the driver."""
    ids = spark.range(30)
    pairs = spark.range(60).selectExpr("id % 30 AS user", "id % 20 AS item", "CAST(id % 2 AS INT) AS target", "array(1) AS bins", "id * 1.0D AS score")
    items = ids.selectExpr("id AS item", "id * 3 AS b")
    cand = spark.range(60).selectExpr("id % 30 + 30 AS user_id", "id % 20 AS diner_id")
    known = R.check_candidates(cand, ids.selectExpr("id AS user_idx"), ids.selectExpr("id AS item_idx"), F.lit(30))
    edges = spark.range(60).selectExpr("id % 30 AS src", "id % 20 + 30 AS dst", "1.0D AS weight")
    vectors = spark.range(50).select("id", F.array(F.lit(0.5), F.lit(-0.5)).alias("vec"))
    triples = spark.range(30).selectExpr("id AS user", "id % 20 + 30 AS positive", "id % 7 + 30 AS negative")
    log = Tables(spark, "")
    log.train, log._held = pairs.selectExpr("user AS reviewer_id", "item AS diner_idx", "score"), {"train"}
    monkeypatch.setattr(RP, "SHORT_LOG", 10)
    plans = []
    for module, run in [
        (L, lambda: L.swap_gradients(pairs, 5)),
        (E, lambda: RP._with_features(log, pairs)),
        (I, lambda: I.map_column(pairs, items, "item", "item", "b")),
        (R, lambda: known),
        (G, lambda: G.propagate(G.normalised_edges(edges), vectors, 2, 2)),
        (G, lambda: G.pairwise_gradients(vectors, triples, 2)[0]),
    ]:
        with monkeypatch.context() as patch:
            made = [p for p in _joined_plans(patch, module, run) if "Join" in p] if hasattr(module, "materialise") else [run()._jdf.queryExecution().executedPlan().toString()]
        assert made
        plans += made
    assert not any("BroadcastExchange" in p for p in plans)
