"""Collocations against plain counting, and the sort against a dictionary."""

import collections
import random
import re

import numpy as np
import pytest

from savora.llm import collocations

SCHEMA = "doc_id long, text string, lang string, rank long, phrase string"


def plain(rows, least, top, nested=(80, 100)):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = set()
    for lang, counts in f.items():
        often = {g: c for g, c in counts.items() if c >= least}
        rows = []
        for g, a in often.items():
            if len(g) == 1:
                continue
            if any(nested[1] * c >= nested[0] * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, c in often.items() if len(h) > len(g)):
                continue
            score, k = min((2000000 * a // (counts[g[:k]] + counts[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return out


def rows_of(seed, many):
    r = random.Random(seed)
    words = ["The", "of", "new", "york", "City", "é", "über", "\x1c", "x\xa0y", "_"] + [f"w{i}" for i in range(60)]
    rows = []
    for i in range(many):
        text = "".join(r.choices(words, [30, 20, 9, 9, 9, 5, 5, 2, 2, 2] + [1] * 60)[0] + r.choices([" ", "  ", "\t", ". ", ",", "\n", " new york city ", "\r"], [60, 3, 3, 3, 3, 2, 8, 1])[0] for _ in range(r.choice([0, 1, 3, 40, 200])))
        rows.append((r.choice([text, text.upper()]), r.choice(["en", "de", None, "und", ""])))
    return rows + [(None, "en"), ("", "en"), ("alone", "fr"), (" . , ", "xx"), ("the of " * 3000, "en")] + [("same row here", "de")] * 9


@pytest.mark.parametrize("how", [{}, {"route_keys": 200}])
def test_phrases_against_plain_counting(spark, monkeypatch, how):
    rows = rows_of(3, 300)
    df = spark.createDataFrame([(i, t, l, i, "x") for i, (t, l) in enumerate(rows)], SCHEMA).repartition(3)
    got = collocations.mine(df, least=5, top=40, **how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and set(got.dtypes[1::1]) >= {("score", "bigint"), ("rank", "bigint")}
    assert {tuple(x) for x in got.collect()} == plain(rows, 5, 40)


def test_small_blocks_cut_long_texts(spark, monkeypatch):
    r = random.Random(6)
    ids = [f"t{r.randrange(300)}" for _ in range(3000)]
    text = " ".join(ids)
    whole = collocations._Block()
    whole.add(text.encode().split(), 3000)
    cut = collocations._Block()
    for at in range(0, 3000, 70):
        cut.add(text.encode().split()[at : at + 73], min(70, 3000 - at))
    for a, b in zip(whole.sort_keys(), cut.sort_keys()):
        assert (a == b).all()


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert collocations.mine(empty).count() == 0
    assert collocations.mine(spark.createDataFrame([(None, None, None, None, None), (1, "a b", "en", 1, "")], SCHEMA)).count() == 0


def test_multikey_sort_counts_prefixes():
    rng = np.random.default_rng(2)
    for n, words, least in ((1, 1, 1), (50, 3, 1), (4000, 9, 30), (4000, 200, 5), (3000, 2, 30)):
        keys = rng.integers(0, words + 1, (4, n)).astype(np.int32)
        for d in range(1, 4):
            keys[d][keys[d - 1] == 0] = 0
        keys = keys[:, keys[0] > 0]
        weights = rng.integers(1, 4, keys.shape[1])
        want = collections.Counter()
        for key, w in zip(keys.T.tolist(), weights.tolist()):
            for m in range(1, 5):
                if key[m - 1]:
                    want[tuple(key[:m])] += w
        got = {}
        for length, rows, counts in collocations.multikey_counts(keys, weights, least):
            for row, count in zip(rows, counts.tolist()):
                assert got.setdefault(tuple(keys[:length, row].tolist()), count) == count
        assert got == {g: c for g, c in want.items() if c >= least}


def test_scores_beyond_64_bits(spark):
    # floor(2000000 * a / (l + r)) at counts whose product passes 2^63
    row = spark.sql("select (cast(9000000000000000 as decimal(20, 0)) * 2000000L) div (cast(9000000000000001 as decimal(20, 0)) + 9000000000000003) as x").first()
    assert row["x"] == 2000000 * 9000000000000000 // (9000000000000001 + 9000000000000003)
