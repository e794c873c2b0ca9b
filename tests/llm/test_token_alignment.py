"""Token alignment against whole texts encoded at once."""

import collections
import hashlib
import random

import pytest

from savora.llm import token_alignment as ta
from savora.llm.queries import ALIGNED, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n_a long, block string, key string"


@pytest.fixture(scope="module")
def aligner():
    return ta.Aligner(*ALIGNED)


def plain(rows, al):
    """Contract columns from whole texts, by byte offsets."""
    out, held, docs = [], collections.Counter(), []
    for key, text in rows:
        a, b = (al.a.encode(" " + text, add_special_tokens=False).ids, al.b.encode(text)) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if not text or b"".join(al.a_bytes[i] for i in a) != raw or b"".join(al.b_bytes[i] for i in b) != raw:
            docs.append((key, [], [], [], [], 0))
            continue
        spans = []
        for ids, size in ((a, al.a_bytes), (b, al.b_bytes)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(size[i]), i))
                at += len(size[i])
            spans.append(own)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, links, at = [], [], [0, 0]
        for end in ends:
            part = []
            for side in (0, 1):
                start = at[side]
                while at[side] < len(spans[side]) and spans[side][at[side]][1] <= end:
                    at[side] += 1
                part.append(spans[side][start : at[side]])
            groups.append(f"{','.join(str(x[2]) for x in part[0])}|{','.join(str(x[2]) for x in part[1])}")
            links += [(x[2], y[2]) for x in part[0] for y in part[1] if x[0] < y[1] and y[0] < x[1]]
        held.update(set(links))
        docs.append((key, a, b, groups, links, 1))
    top = collections.Counter()
    for (x, _), c in held.items():
        top[x] = max(top[x], c)
    for key, a, b, groups, links, good in docs:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if good else ""
        out.append((key, len(a), len(b), len(groups), len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), sha))
    return sorted(out, key=repr)


def odd_texts(seed):
    r = random.Random(seed)
    parts = ["the", " ", "  ", "\n", "\n\n", "\t", "\r\n", "don't", "it's", "Straße", "naïve", "中文字符", "🎉", "👩‍👩‍👧", "▁", "\xa0", "\x00", "\x1c", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "ﬁ", "é", "é", "1234567", "x" * 40, "....", "'ll", "　", "​", "def f(x):\n    return x", "\u0085", "A", "ion"]
    texts = ["".join(r.choice(parts) + r.choice(["", " ", " "]) for _ in range(r.choice([1, 2, 5, 30]))) for _ in range(150)]
    clean = [p for p in parts if p not in ("▁",)]
    texts += ["".join(r.choice(clean) + r.choice(["", " ", " ", "\n"]) for _ in range(400)) for _ in range(12)]
    return texts + parts + [" lead", "\nlead", "trail ", "trail\n", " ", "\n", "a" * 5000, "ab " * 2000, " ".join("word" + str(i % 50) for i in range(1500))]


@pytest.mark.parametrize("how", [{}, {"size": 64}, {"size": 700, "block": 900}])
def test_alignment_against_whole_texts(spark, aligner, how):
    rows = [(i, t) for i, t in enumerate(odd_texts(4))] + [(None, "no key"), (7, "same key"), (7, "same key"), (8, None), (9, "")]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA).repartition(3)
    got = ta.align(df, *ALIGNED, **how)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(x) for x in got.collect()), key=repr) == plain(rows, aligner)


def test_query_and_empty_table(spark, aligner):
    rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(x) for x in QUERIES["op13_token_alignment"](spark, SF).collect()), key=repr) == plain(rows, aligner)
    assert ta.align(spark.createDataFrame([], SCHEMA), *ALIGNED).count() == 0


def test_joining_fragments_is_associative(aligner):
    al, r = aligner, random.Random(2)
    text = " " + "international understanding of uncharacteristically long words 中文字符串 " * 3 + "end"
    a, b = al.a.encode(text, add_special_tokens=False).ids, al.b.encode(text[1:])
    import numpy as np

    ends = [np.cumsum(s).tolist() for s in al.sizes(a, b)]
    n = len(text.encode())
    state = lambda f: (f.good, f.cut, f.head, f.tail, f.n, f.text, sorted(f.pairs.items()))
    for _ in range(60):
        marks = [0, *sorted(r.sample(range(1, n), r.choice([2, 5, 20]))), n]
        parts = []
        for lo, hi in zip(marks, marks[1:]):
            mine = [[i for i, e in enumerate(x) if lo < e <= hi] for x in ends]
            parts.append(ta.of_tokens([a[i] for i in mine[0]], [ends[0][i] for i in mine[0]], [b[i] for i in mine[1]], [ends[1][i] for i in mine[1]], al))
        left = parts[0]
        for p in parts[1:]:
            left = ta.join(al, left, p)
        while len(parts) > 1:
            at = r.randrange(len(parts) - 1)
            parts[at : at + 2] = [ta.join(al, parts[at], parts[at + 1])]
        assert state(left) == state(parts[0]) == state(ta.of_tokens(a, ends[0], b, ends[1], al))


def test_ranges_cover_texts(aligner):
    for text in odd_texts(8)[-20:]:
        for size in (16, 100):
            cut = ta.ranges(" " + text, True, size)
            assert [c[1] for c in cut[1:]] == [c[2] for c in cut[:-1]] and cut[0][1] == 0 and cut[-1][2] == len((" " + text).encode())
