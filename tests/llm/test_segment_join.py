"""The segment join against comparison of all pairs."""

import itertools
import random

import numpy as np
import pytest

from savora.llm import segment_join
from savora.llm.fast_sketch import shingles
from savora.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, node long, n long, comp string"


def links_of(rows, num=90, den=100, width=3):
    sets = [frozenset(shingles(t, width).tolist()) for _, t in rows]
    distinct = sorted(set(sets) - {frozenset()}, key=len)
    out = set()
    for i, a in enumerate(distinct):
        for b in itertools.islice(distinct, i + 1, None):
            if den * len(a) < num * len(b):
                break
            if den * len(a & b) >= num * len(a | b):
                out.add(frozenset((a, b)))
    return sets, out


def components_of(rows, **how):
    sets, links = links_of(rows, **how)
    up = {s: s for s in sets}

    def find(s):
        while up[s] is not s:
            s = up[s]
        return s

    for a, b in (tuple(x) for x in links):
        up[find(a)] = find(b)
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            least[find(s)] = min(i, least.get(find(s), i))
    return sorted(((i, len(s), least.get(find(s)) if s else i) for (i, _), s in zip(rows, sets)), key=repr)


def families(seed, template_similarity=0.8):
    """Templates whose members share most shingles without linking, near copies, and texts of all sizes."""
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    rows = []
    for n in [1, 2, 3, 4, 7, 9, 10, 11, 19, 20, 21, 28, 40, 60, 90, 150, 400]:
        base = text(n)
        for edits in (0, 0, 1, 2, n // 60, n // 40, n // 20):
            new = list(base)
            for _ in range(edits):
                new[r.randrange(len(new))] = r.choice(vocabulary)
            rows.append(new)
            rows.append(new[: max(1, len(new) - edits)])
    for n, many in ((120, 60), (60, 40)):
        base = text(n)
        for _ in range(many):
            at = r.randrange(n - int(n * (1 - template_similarity)))
            own = int(n * (1 - template_similarity))
            rows.append(base[:at] + text(own) + base[at + own :])
    chain = text(200)
    for _ in range(40):
        chain = list(chain)
        chain[r.randrange(200)] = r.choice(vocabulary)
        rows.append(chain)
    rows = [" ".join(x) for x in rows]
    r.shuffle(rows)
    return [(i * 3 % 1009, t) for i, t in enumerate(rows)] + [(5000, None), (5001, ""), (5002, " \n"), (None, rows[0]), (None, "only here"), (4, rows[1]), (4, "another text here now")]


@pytest.mark.parametrize("how", [{}, {"direct": 0, "hub_rounds": 0}, {"direct": 1, "hub_rounds": 1}])
def test_components_against_all_pairs(spark, how):
    rows = families(1 + len(how))
    df = spark.createDataFrame([(i, t, 0, None, "x") for i, t in rows], SCHEMA).repartition(3)
    got = segment_join.components(df, **how)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(x) for x in got.collect()), key=repr) == components_of(rows)


@pytest.mark.parametrize("similar", [(90, 100), (80, 100), (1, 1)])
def test_pairs_are_the_whole_join(spark, similar):
    rows = families(9, 0.85)
    df = spark.createDataFrame([(i, t, 0, None, "x") for i, t in rows], SCHEMA)
    links, member = segment_join.pairs(df, similar=similar, direct=1)
    sets, want = links_of(rows, *similar)
    got = links.collect()
    assert len(got) == len(want) and {(x["shared"], x["united"]) for x in got} == {(len(frozenset.intersection(*p)), len(frozenset.union(*p))) for p in want}
    assert member.count() == len(rows)


def test_query_equals_all_pairs(spark):
    rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(x) for x in QUERIES["op12_segment_join"](spark, SF).collect()), key=repr) == components_of(rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert segment_join.components(empty).count() == 0 and segment_join.pairs(empty)[0].count() == 0


def test_pigeonhole_of_segments():
    rng = np.random.default_rng(3)
    for n in (1, 9, 10, 25, 100, 700):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        for _ in range(20):
            apart = segment_join.most_apart(n, (90, 100))
            out = int(rng.integers(0, apart + 1))
            b = np.unique(np.r_[rng.permutation(a)[: n - out], rng.integers(0, 2**63, apart - out, dtype=np.uint64)])
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= 90 * (len(a) + len(b) - shared):
                assert set(segment_join.signatures(a, (90, 100)).tolist()) & set(segment_join.signatures(b, (90, 100)).tolist())
        band, segments = segment_join.bands_signed(n, (90, 100))[0]
        seg, whole, of, less = segment_join.neighbourhood(a, band, segments)
        assert len(less) == n and (whole == segment_join.signatures(a, (90, 100))[:segments]).all()
        gone = segment_join.neighbourhood(np.delete(a, 0), band, segments)
        assert gone[1][of[0]] == less[0]
