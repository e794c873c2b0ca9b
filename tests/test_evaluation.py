import math

import pytest
from pyspark.sql import functions as F

from savora.operators import evaluation as V


def scores(spark, liked, recs, k):
    li = spark.createDataFrame([(1, i) for i in liked], "user long, item long")
    re = spark.createDataFrame([(1, p, i) for p, i in enumerate(recs, start=1)], "user long, pos int, item long")
    return V.per_user(V.find_hits(re, li), V.liked_counts(li), [k]).collect()[0]


LIKED = [100, 10, 50, 20, 30, 40, 60, 70, 80, 90]


def d(i):
    return 1 / math.log2(i + 1)


def test_hits_at_the_end(spark):
    r = scores(spark, LIKED, [2, 3, 4, 100, 10], 5)
    assert r["map"] == pytest.approx((1 / 4 + 2 / 5) / 10)
    assert r["ndcg"] == pytest.approx((d(4) + d(5)) / sum(d(i) for i in range(1, 6)))
    assert r["recall"] == pytest.approx(0.2)


def test_hits_at_the_front(spark):
    r = scores(spark, LIKED, [100, 10, 50, 2, 3], 5)
    assert r["map"] == pytest.approx(3 / 10)
    assert r["ndcg"] == pytest.approx(sum(d(i) for i in range(1, 4)) / sum(d(i) for i in range(1, 6)))


def test_repeated_likes_count_in_the_length(spark):
    r = scores(spark, [7, 7, 8], [7, 1], 2)
    assert r["m"] == 3 and r["recall"] == pytest.approx(1 / 3)


def test_rank_precision(spark):
    row = spark.range(1).select(
        V.rank_precision(F.lit(4), 4).alias("a"), V.rank_precision(F.lit(None).cast("int"), 4).alias("b"), V.rank_precision(F.lit(1), 4).alias("c")
    ).collect()[0]
    assert (row["a"], row["b"], row["c"]) == (0.25, 0.0, 1.0)


def test_shared_list_equals_spread_list(spark):
    liked = spark.createDataFrame([(u, i) for u in range(5) for i in range(u, u + 3)], "user long, item long")
    top = spark.createDataFrame([(i, p) for p, i in enumerate([3, 9, 1, 4], start=1)], "item long, pos int")
    a = V.list_hits(top, liked)
    b = V.find_hits(V.spread_list(top, liked.select("user").distinct(), 4), liked)
    assert sorted(map(tuple, a.collect())) == sorted((r["user"], r["item"], r["pos"]) for r in b.collect())
