import random

import pytest
from pyspark.sql import functions as F

from savora.operators import reranking as R


@pytest.fixture(scope="module")
def cands():
    rng = random.Random(11)
    rows = []
    for g in ("x", "y"):
        for i in range(30):
            cat = rng.choice("abc")
            rows.append((g, i, rng.randint(0, 20) / 20, cat, 37.5 + rng.random() / 20, 127 + rng.random() / 20, [f"category:{cat}", f"region:{g}"]))
    return rows


SCHEMA = "g string, item long, rel double, cat string, lat double, lon double, labels array<string>"


def _lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["pos"]):
        out.setdefault(r["g"], []).append(r["item"])
    return out


@pytest.mark.parametrize("cover", [{}, {"coverage_max": {"category:a": 1}, "coverage_min": {"category:b": 3}, "frozen": 2}])
def test_both_forms_agree(spark, cands, cover, monkeypatch):
    df = spark.createDataFrame(cands, SCHEMA)
    auto = _lists(R.mmr_rerank(df, "g", 7, **cover))
    monkeypatch.setattr(R, "SMALL_GROUP", 3)
    assert _lists(R.mmr_rerank(df, "g", 7, **cover)) == auto
    assert _lists(R.mmr_bounded(df, "g", 7, 100, **cover)) == _lists(R.mmr_stepwise(df, "g", 7, **cover))


@pytest.mark.parametrize("cover", [{}, {"coverage_max": {"category:a": 1, "region:x": 4}, "coverage_min": {"category:b": 3}, "frozen": 2}, {"penalty": False}])
def test_both_forms_agree_on_missing_values_and_ties(spark, cover):
    rng = random.Random(5)
    rows = []
    for g in ("x", None, "z"):
        for i in range(12):
            cat = rng.choice(["a", "b", None])
            lat, lon = rng.choice([(37.5, 127.0), (37.51, 127.0), (None, 127.0), (float("nan"), 127.0)])
            labels = rng.choice([None, [f"category:{cat}", f"region:{g}"]])
            rows.append((g, i, rng.choice([None, float("nan"), 0.5, 0.5, 1.0]), cat, lat, lon, labels))
    df = spark.createDataFrame(rows, SCHEMA)
    bounded = _lists(R.mmr_bounded(df, "g", 8, 100, **cover))
    assert bounded == _lists(R.mmr_stepwise(df, "g", 8, **cover)) and set(bounded) == {"x", None, "z"}
    none = df.where("false")
    assert R.mmr_stepwise(none, "g", 3).collect() == R.mmr_bounded(none, "g", 3, 9).collect() == []
    assert R.mmr_stepwise(none, "g", 3).columns == R.mmr_bounded(none, "g", 3, 9).columns


def test_serving_set_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "USERS_PER_BLOCK", 2)
    users = spark.range(7).withColumnRenamed("id", "user")
    items = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(5)], "item long, large string")
    seen = spark.createDataFrame([(0, 1), (3, 3)], "user long, item long")
    got = sorted((r["user"], r["item"]) for r in R.serving_set(users, items, seen, labels=["a"]).collect())
    assert got == [(u, i) for u in range(7) for i in (1, 3) if (u, i) not in {(0, 1), (3, 3)}]
    assert R.serving_set(users.where("false"), items, seen).count() == 0


def test_quota_frozen_and_penalty(spark, cands):
    df = spark.createDataFrame(cands, SCHEMA)
    cat = {(r[0], r[1]): r[3] for r in cands}
    by_rel = {g: [r[1] for r in sorted((r for r in cands if r[0] == g), key=lambda r: (-r[2], r[1]))] for g in "xy"}
    capped = _lists(R.mmr_bounded(df, "g", 12, 100, coverage_max={"category:a": 2}))
    assert all(sum(cat[g, i] == "a" for i in items) <= 2 for g, items in capped.items())
    frozen = _lists(R.mmr_bounded(df, "g", 8, 100, frozen=4))
    assert all(items[:4] == by_rel[g][:4] for g, items in frozen.items())
    plain = _lists(R.mmr_bounded(df, "g", 10, 100, penalty=False))
    assert all(items == by_rel[g][:10] for g, items in plain.items())


def test_region_labels(spark):
    df = spark.createDataFrame([(0, "서울 강남구 역삼동"), (1, "경기 성남시 분당구"), (2, "제주"), (3, ""), (4, None), (5, "서울 강남구청 앞")], "i int, a string")
    got = {r["i"]: r["l"] for r in df.select("i", R.region_label("a").alias("l")).collect()}
    assert got == {0: "서울 강남구", 1: "경기 성남시", 2: "제주", 3: "unknown", 4: "unknown", 5: "서울 강남구"}


def test_hotspots_find_clusters(spark):
    rng = random.Random(12)
    centres = [(37.5, 127.0), (37.6, 127.1), (37.4, 126.9)]
    rows = [("r", a + rng.uniform(-0.002, 0.002), b + rng.uniform(-0.002, 0.002)) for a, b in centres for _ in range(30)] + [("one", 37.0, 127.0)]
    df = spark.createDataFrame(rows, "region string, lat double, lon double")
    got = R.hotspots(df, "region", "lat", "lon", n=30, rounds=20).collect()
    assert [r["region"] for r in got] == ["r"]
    for a, b in centres:
        assert any(abs(c["lat"] - a) < 0.003 and abs(c["lon"] - b) < 0.003 for c in got[0]["centres"])


def test_constant_group_scales_to_zero(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 3.0)], "g string, x double")
    got = sorted((r["g"], round(r["s"], 6)) for r in R.minmax(F.col("x"), ["g"], df, "s").collect())
    assert got == [("a", 0.0), ("a", 0.0), ("b", 0.0), ("b", 1.0)]


def test_missing_region_falls_back_to_all(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i long, region string")
    assert R.target_region(df, "zzz").count() == 2 and R.target_region(df, "a").count() == 1


def test_grid_is_the_full_product():
    assert R.grid({"a": [1, 2], "b": [3, 4]}) == [{"a": 1, "b": 3}, {"a": 1, "b": 4}, {"a": 2, "b": 3}, {"a": 2, "b": 4}]


def test_places_without_coordinates_get_no_periphery_bonus(spark):
    rows = [(1, "a", 37.5, 127.0), (2, "a", 37.6, 127.0), (3, "a", None, None), (4, "b", 37.0, 127.0), (5, "b", 36.0, 127.0)]
    df = spark.createDataFrame(rows, "id long, region string, lat double, lon double")
    centres = spark.createDataFrame([("a", [(37.5, 127.0)])], "region string, centres array<struct<lat:double,lon:double>>")
    for spots in (centres, [(37.5, 127.0)]):
        got = {r["id"]: r["periphery_bonus"] for r in R.periphery_bonus(df, "region", "lat", "lon", spots, 0.5, 0.3).collect()}
        assert got[1] == 0 and got[2] == 0.3 and got[3] == 0
        assert got[4] == 0 and got[5] == (0 if spots is centres else 0.3)


def test_places_do_not_pile_up_estimates(spark, monkeypatch):
    """Spark's size estimate of a place's frames does not grow with the places already filled."""
    sizes = []

    def noting(write):
        def run(df):
            sizes.append(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
            return write(df)

        return run

    for name in ("materialise", "cut_lineage"):
        monkeypatch.setattr(R, name, noting(getattr(R, name)))
    df = spark.range(60).selectExpr("CAST(id % 2 AS STRING) AS region", "id AS item", "id / 60 AS rel", "CAST(id % 3 AS STRING) AS cat",
                                    "37.4 + id / 1000 AS lat", "126.8 + id / 500 AS lon", "array(concat('c:', id % 3)) AS labels")
    out = R.mmr_stepwise(df, "region", 6, frozen=1, coverage_max={"c:0": 2}, coverage_min={"c:1": 2})
    assert out.count() == 12
    assert max(sizes) < 256  # bits; an estimate that multiplies earlier ones gets longer with every place
