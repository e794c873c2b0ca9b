import numpy as np
from pyspark.sql import functions as F

from savora.operators import factors, strata


def test_step_equals_finite_differences():
    r = np.random.default_rng(1)
    u, v = r.normal(size=(3, 4)), r.normal(size=(3, 4))
    ui, vi, target, n = np.array([0, 1, 2]), np.array([2, 0, 1]), r.normal(size=3), np.array([1.0, 2.0, 1.0])

    def loss(u, v):
        error = target - (u[ui, :-1] * v[vi, :-1]).sum(axis=1) - u[ui, -1] - v[vi, -1]
        return 0.5 * (n * error**2).sum() + 0.05 * ((n * (u[ui] ** 2).sum(axis=1)).sum() + (n * (v[vi] ** 2).sum(axis=1)).sum())

    new_u, new_v = u.copy(), v.copy()
    strata.descend(new_u, new_v, ui, vi, target, n, 1e-3, 0.1)
    for old, new, at in ((u, new_u, 0), (v, new_v, 1)):
        for i in np.ndindex(old.shape):
            up, down = old.copy(), old.copy()
            up[i] += 1e-6
            down[i] -= 1e-6
            slope = (loss(up, v) - loss(down, v) if at == 0 else loss(u, up) - loss(u, down)) / 2e-6
            assert abs((new - old)[i] + 1e-3 * slope) < 1e-8


def test_hot_row_moves_by_bounded_steps():
    target = np.zeros((2, 1))
    strata.move(target, np.array([0, 0, 1]), np.array([[1.0], [3.0], [5.0]]), np.array([4.0, 4.0, 2.0]))
    assert target.tolist() == [[2.0 * strata.STEPS], [10.0]]


def planted(spark, parts):
    """Low-rank ratings; user 0 has rated every item, which is a third of the rows of a small user base."""
    r = np.random.default_rng(7)
    a, b = r.normal(size=(60, 2)), r.normal(size=(40, 2))
    rows = [(i, j, float(3 + a[i] @ b[j] + 0.1 * r.normal())) for i in range(60) for j in range(40) if i == 0 or r.random() < 0.6]
    held = [x for k, x in enumerate(rows) if k % 6 == 0]
    frame = spark.createDataFrame([x for k, x in enumerate(rows) if k % 6], "user long, item long, r double")
    return frame, spark.createDataFrame(held, "user long, item long, r double"), strata.fit_joint(frame, rank=4, rate=0.2, reg=0.01, epochs=8, parts=parts)


def rmse(df):
    return df.agg(F.sqrt(F.avg((F.col("r") - F.col("pred")) ** 2))).first()[0]


def test_joint_model_beats_biases(spark):
    frame, held, (b, f, history) = planted(spark, 2)
    told = [x["mse"] for x in history.orderBy("epoch").collect()]
    assert told[-1] < told[0] / 2 and {x["ratings"] for x in history.collect()} == {frame.count()}
    plain = rmse(factors.biased_baseline(factors.fit_biases(frame), held))
    assert rmse(strata.predict_joint(b, f, held)) < 0.75 * plain
    # The seen filter leaves unrated items only, and scores equal the model's.
    top = factors.biased_topk(b, f, 3, seen=frame.select("user", "item"))
    assert top.join(frame, ["user", "item"], "left_semi").isEmpty()
    same = strata.predict_joint(b, f, top.select("user", "item", F.col("score").alias("r")))
    assert rmse(same) < 1e-4


def test_nulls_repeats_unknown_and_empty(spark):
    rows = [("a", 1, 4.0), ("a", 1, 4.0), ("a", 2, 2.0), ("b", 1, 5.0), (None, 1, 1.0), ("a", None, 1.0), ("c", 3, None)]
    frame = spark.createDataFrame(rows, "user string, item int, r double")
    b, f, history = strata.fit_joint(frame, rank=2, epochs=2, parts=3)
    assert {x["user"] for x in f.users.collect()} == {"a", "b"} and {x["item"] for x in f.items.collect()} == {1, 2}
    assert [x["ratings"] for x in history.collect()] == [4, 4]
    again = strata.fit_joint(frame, rank=2, epochs=2, parts=3)[1]
    assert sorted(map(str, f.users.collect())) == sorted(map(str, again.users.collect()))
    unknown = strata.predict_joint(b, f, spark.createDataFrame([("x", 9)], "user string, item int")).first()
    assert abs(unknown["pred"] - 3.75) < 1e-9
    b, f, history = strata.fit_joint(frame.limit(0), rank=2, epochs=1)
    assert f.users.count() == f.items.count() == 0 and history.first()["mse"] == 0.0


def test_vectors_move_only_in_rounds_with_their_ratings(spark, monkeypatch):
    paths, path_of = [], strata.scratch_path
    monkeypatch.setattr(strata, "scratch_path", lambda *a: paths.append(path_of(*a)) or paths[-1])
    monkeypatch.setattr(strata, "delete_path", lambda *a: None, raising=False)
    frame = spark.createDataFrame([(i, j, 1.0) for i in range(40) for j in range(40) if (i * 7 + j) % 20 == 0], "user long, item long, r double")
    strata.fit_joint(frame, rank=2, epochs=2, parts=6)
    moved = spark.read.parquet(next(p for p in paths if "strata-rounds" in p)).where("round > 0 and kind < 2").count()
    # Two ratings a user and item: at most two of the six rounds of an epoch.
    assert 0 < moved <= 2 * 2 * 80
