import collections
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from savora.operators import splits as S
from savora.operators import statistics as N
from savora.operators import texts as O


def test_mentions_long_and_short_lists_agree(spark, monkeypatch):
    sents = spark.createDataFrame([(1, "the ring and a boltless thing"), (2, "r"), (3, "")], "id long, sentence string")
    menus = spark.createDataFrame([("ring",), ("bolt",), ("r",), ("xyz",)], "menu string")
    short = sorted(map(tuple, O.mentions(sents, ["id"], menus).collect()))
    monkeypatch.setattr(O, "SHORT_LIST", 0)
    assert short == sorted(map(tuple, O.mentions(sents, ["id"], menus).collect())) == [(1, "bolt"), (1, "r"), (1, "ring"), (2, "r")]


def test_mentions_of_many_names(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdé ") for _ in range(r.randrange(1, 9)))
    names = sorted({word() for _ in range(5000)})
    texts = ["".join(r.choice("abcdé ") for _ in range(r.randrange(0, 60))) for _ in range(80)] + [None, "", "a", "aa"]
    sents = spark.createDataFrame([(i // 2, i, t) for i, t in enumerate(texts)], "id long, place int, sentence string")
    for some in (names[::17], names):
        assert len(some) > O.SHORT_LIST or some is not names
        got = O.mentions(sents, ["id", "place"], spark.createDataFrame([(n,) for n in some] + [("",), (None,)], "menu string")).collect()
        want = sorted((i // 2, i, n) for i, t in enumerate(texts) for n in some if n and t and n in t)
        assert sorted(map(tuple, got)) == want


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, "a"), (3, None)], "id long, text string")
    w, _ = O.tfidf(df, "id", "text")
    got = {(r["id"], r["word"]): r["weight"] for r in w.collect()}
    ia, ib = math.log(4 / 3) + 1, math.log(4 / 2) + 1
    n = math.hypot(ia, 2 * ib)
    assert got[1, "a"] == pytest.approx(ia / n) and got[1, "b"] == pytest.approx(2 * ib / n) and got[2, "a"] == pytest.approx(1.0)


def test_decompose_matches_definition(spark):
    n = 40
    x = [10 + 0.3 * i + 5 * math.sin(2 * math.pi * i / 12) + (i * 7 % 5) for i in range(n)]
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "g string, t int, v double")
    got = {r["t"]: r for r in N.decompose(df, ["g"], "t", "v").collect()}
    s = pd.Series(x)
    kernel = np.array([0.5] + [1] * 11 + [0.5]) / 12
    trend = pd.Series(np.nan, index=s.index)
    trend[6 : n - 6] = np.convolve(s, kernel, "valid")
    means = (s - trend).groupby(np.arange(n) % 12).mean()
    seasonal = means - means.mean()
    for i in range(n):
        assert got[i]["seasonal"] == pytest.approx(seasonal[i % 12])
        assert (got[i]["trend"] is None) == math.isnan(trend[i])
        if got[i]["trend"] is not None:
            assert got[i]["trend"] == pytest.approx(trend[i])


def test_short_series_is_left_out(spark):
    df = spark.createDataFrame([("s", i, 1.0) for i in range(23)], "g string, t int, v double")
    assert N.decompose(df, ["g"], "t", "v").count() == 0


def test_interpolation_matches_pandas(spark):
    vals = [None, 1.0, None, None, 4.0, None]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(vals)], "g string, t int, v double")
    got = [r["filled"] for r in N.interpolate(df, ["g"], "t", "v").orderBy("t").collect()]
    assert got == [None, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_spearman_with_ties(spark):
    a, b = [1, 2, 2, 3, 5], [2, 2, 4, 9, 1]
    df = spark.createDataFrame([("g", float(x), float(y)) for x, y in zip(a, b)], "g string, x double, y double")
    want = np.corrcoef(pd.Series(a).rank(), pd.Series(b).rank())[0, 1]
    assert N.spearman(df, ["g"], "x", "y").collect()[0]["correlation"] == round(want, 4)


def test_as_of_mean_ignores_the_future(spark):
    rows = [(1, 10, 5, "2020-01-01"), (1, 11, 1, "2020-02-01"), (1, 12, 3, "2020-02-01"), (2, 13, 2, "2020-01-05")]
    df = spark.createDataFrame(rows, "reviewer_id long, review_id long, score int, d string").select("*", F.col("d").cast("timestamp_ntz").alias("review_date"))
    got = {r["review_id"]: (r["review_avg"], r["target"]) for r in S.as_of_target(df).collect()}
    assert got == {10: (5.0, 1), 11: (5.0, 0), 12: (3.0, 1), 13: (2.0, 1)}


@pytest.mark.parametrize("args", [
    ("time_point", ("2020-01-01", "2020-01-01", "2021-01-01", "2022-01-01"), None), ("time_point", ("x", "2020-01-01", "2021-01-01", "2022-01-01"), None),
    ("time_point", None, None), ("user_timeline", None, 0.0), ("stratified", ("a", "b", "c", "d"), 0.2), ("other", None, None),
])
def test_bad_split_arguments(args):
    with pytest.raises(ValueError):
        S.check_split_arguments(*args)


def test_texts_of_every_script_keep_their_words(spark):
    from savora.functions import text as X
    from savora.operators import texts as O

    rows = [(1, 7, "김치찌개가 정말 맛있어요!"), (2, 7, "für Müller's café"), (3, 7, "für Müller's café!"), (4, 8, "für Müller's café"), (5, 8, "?!"), (6, 8, None)]
    df = spark.createDataFrame(rows, "review_id long, diner_idx long, text string")
    got = {r["review_id"]: r["clean"] for r in O.normalised_texts(df, "review_id", "text", ["diner_idx"]).collect()}
    assert got == {1: "김치찌개가 정말 맛있어요", 2: "für Müllers café", 4: "für Müllers café"}
    assert df.where("review_id = 2").select(X.tokens("text", min_length=2)).first()[0] == ["für", "müller", "café"]


def test_keyword_cosine_shuffles_weights_once(spark):
    """Texts and their keywords, also words that no text has, texts without words in common and rows without a key."""
    r = random.Random(4)
    texts = [(i, " ".join(f"w{chr(97 + r.randrange(12))}" for _ in range(r.randint(1, 30)))) for i in range(40)] + [(7, "wa wz"), (None, "wa wb")]
    df = spark.createDataFrame(texts, "id long, text string")
    weights, idf = O.tfidf(df, "id", "text")
    tags = O.top_tags(weights, "id", 3).select("id", "word")
    out = O.keyword_cosine(weights, tags, idf, "id")
    got = {x["id"]: x["cosine"] for x in out.collect()}
    by_text, value = collections.defaultdict(dict), {x["word"]: x["idf"] for x in idf.collect()}
    for x in weights.collect():
        by_text[x["id"]][x["word"]] = x["weight"]
    own = collections.defaultdict(list)
    for x in tags.collect():
        own[x["id"]].append(x["word"])
    for i, words in own.items():
        norm = sum(value[w] ** 2 for w in words) ** 0.5
        want = 0.0 if i is None else sum(by_text[i][w] * value[w] / norm for w in words)
        assert abs(got.pop(i) - want) < 1e-9
    assert not got
    # At size, where nothing is broadcast, weights are not dealt by word a second time.
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = O.keyword_cosine(weights, tags, idf, "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin [id#" in plan and not re.search(r"SortMergeJoin \[id#\d+L?, word", plan)
    other = spark.createDataFrame([(1, "nowhere"), (2, "wa"), (None, "wa"), (99, "wa"), (3, "wa"), (3, "wa"), (3, "wb")], "id long, word string")
    loose = {x["id"]: x["cosine"] for x in O.keyword_cosine(weights, other, idf, "id").collect()}
    assert set(loose) == {1, 2, None, 99, 3} and loose[1] == loose[99] == loose[None] == 0.0
    norm = (4 * value["wa"] ** 2 + value["wb"] ** 2) ** 0.5
    assert abs(loose[3] - (by_text[3].get("wa", 0) * 2 * value["wa"] + by_text[3].get("wb", 0) * value["wb"]) / norm) < 1e-9
