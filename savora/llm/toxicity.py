"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

The labelled sample (at most `SAMPLE` rows, the ones with the smallest hashes, and of them at most `SAMPLE_TERMS` term
counts) is split: three quarters become the example index, the others calibrate. It is coded in tasks and reaches the driver
as flat integer arrays only, so both bounds together bound the driver's memory whatever the length of the texts. Texts and examples count with all their terms; idf comes from all
documents, and terms that no sampled row has still lengthen the texts that hold them. A query walks a
block-max index: only blocks whose upper bound reaches the k best found so far are multiplied out, so the
neighbours are exact. They are the evidence, and their labels vote by distance. A second vote comes from the
neighbours over all telling terms alone (document frequency differs between the classes).
Isotonic calibration turns the mean of both votes into a probability.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from savora.llm.common import map_batches, slices
from savora.session import materialise

SAMPLE = 20_000
SAMPLE_TERMS = 8_000_000
MIN_CLASS_ROWS = 3
MIN_G2 = 10.8
NEIGHBOURS = 15
BLOCK = 64
COMMON = 16
TEXT_SLICE = 4_000_000
EVIDENCE = "array<struct<id: string, label: int, similarity: double>>"
NEAR = 0.05
REMEMBERED = 50_000
TOKEN = re.compile(r"[^\W\d_]+")


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def training_rows(labels: DataFrame, key: str, label: str, sample: int = SAMPLE) -> DataFrame:
    """(id, y, fit) of the sampled labelled rows outside the held-out part; `sample` bounds them. Rows
    without a key or label teach nothing; repeated keys count once, with their largest label."""
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    rows = rows.groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("y"))
    order = F.xxhash64("id")
    return rows.orderBy(order, "id").limit(sample).select("id", "y", (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(4)) > 0).alias("fit"))


def telling_terms(docs: DataFrame, train: DataFrame, text: str) -> list[str]:
    """The terms whose likelihood ratio between the classes is at least `MIN_G2`. Counts are added up per batch and
    then by Spark; they are terms of the sample, which bounds what reaches the driver."""
    joined = docs.join(F.broadcast(train.where("fit")), "id")

    def fn(cols):
        pos, neg = Counter(), Counter()
        for t, y in zip(*cols):
            (pos if y else neg).update({None, *TOKEN.findall((t or "").lower())})
        names = list(pos.keys() | neg.keys())
        return {"term": names, "pos": [pos[w] for w in names], "neg": [neg[w] for w in names]}

    counts = materialise(map_batches(joined, [text, "y"], fn, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("a"), F.sum("neg").alias("b")))
    whole = counts.where("term is null").first()
    if not whole or not whole["a"] or not whole["b"]:
        return []
    n1, n0 = float(whole["a"]), float(whole["b"])
    a, b = F.col("a").cast("double"), F.col("b").cast("double")

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    share = (a + b) / (n1 + n0)
    g2 = 2 * (part(a, share * n1) + part(b, share * n0) + part(n1 - a, (1 - share) * n1) + part(n0 - b, (1 - share) * n0))
    best = counts.where(F.col("term").isNotNull() & (F.greatest("a", "b") >= MIN_CLASS_ROWS)).select("term", g2.alias("g2")).where(F.col("g2") >= MIN_G2)
    return sorted(best.toArrow()["term"].to_pylist())


def sample_counts(docs: DataFrame, train: DataFrame, text: str) -> DataFrame:
    """(id, y, fit, words, tf) of the sampled rows, over all terms of the whole texts; repeated keys teach once."""

    def fn(cols):
        found = [sorted(Counter(TOKEN.findall((t or "").lower())).items()) for t in cols[3]]
        return {"id": cols[0], "y": cols[1], "fit": cols[2], "words": [[w for w, _ in f] for f in found], "tf": [[n for _, n in f] for f in found]}

    kind = docs.schema["id"].dataType.simpleString()
    rows = map_batches(docs.join(F.broadcast(train), "id"), ["id", "y", "fit", text], fn, f"id {kind}, y int, fit boolean, words array<string>, tf array<int>")
    return rows.groupBy("id", "y", "fit").agg(F.min(F.struct("words", "tf")).alias("v")).select("id", "y", "fit", "v.words", "v.tf")


def within_terms(sampled: DataFrame, limit: int) -> DataFrame:
    """The sampled rows, in the order of the sample, up to `limit` term counts. The running sum is over the ids of
    a bounded sample."""
    upto = F.sum(F.size("words")).over(Window.orderBy(F.xxhash64("id"), "id"))
    return sampled.join(sampled.select("id", upto.alias("upto")).where(F.col("upto") <= limit).select("id"), "id")


def coded_sample(sampled: DataFrame, place: Broadcast) -> DataFrame:
    """(id, y, fit, idx, tf): the sampled rows with places in the vocabulary instead of words."""

    def fn(cols):
        known = place.value.get()
        return {"id": cols[0], "y": cols[1], "fit": cols[2], "idx": [[known[w] for w in words] for words in cols[3]], "tf": cols[4]}

    kind = sampled.schema["id"].dataType.simpleString()
    return map_batches(sampled, ["id", "y", "fit", "words", "tf"], fn, f"id {kind}, y int, fit boolean, idx array<int>, tf array<int>")


def term_counts(docs: DataFrame, text: str, place: Broadcast) -> DataFrame:
    """(id, idx, tf, rest, rest_tf) per row, over all terms of the whole texts: places in the vocabulary of the
    sample and counts, and the terms that no sampled row has with theirs."""

    def fn(cols):
        known = place.value.get()
        for part in slices(len(cols[1]), [len(t or "") for t in cols[1]], TEXT_SLICE):
            out = {"id": [cols[0][i] for i in part], "idx": [], "tf": [], "rest": [], "rest_tf": []}
            for i in part:
                idx, tf, rest, rest_tf = [], [], [], []
                for w, n in Counter(TOKEN.findall((cols[1][i] or "").lower())).items():
                    at = known.get(w)
                    if at is None:
                        rest.append(w)
                        rest_tf.append(n)
                    else:
                        idx.append(at)
                        tf.append(n)
                for c, v in zip(("idx", "tf", "rest", "rest_tf"), (idx, tf, rest, rest_tf)):
                    out[c].append(v)
            yield out

    kind = docs.schema["id"].dataType.simpleString()
    return map_batches(docs, ["id", text], fn, f"id {kind}, idx array<int>, tf array<int>, rest array<string>, rest_tf array<int>")


def rest_norms(counted: DataFrame, n: int) -> DataFrame:
    """(row, rest): the squared weight of each row's terms that no sampled row has. They match no example, but
    belong to the row's length. Their document frequencies stay distributed."""
    pairs = counted.select("row", F.explode(F.arrays_zip("rest", "rest_tf")).alias("p")).select("row", F.col("p.rest").alias("term"), F.col("p.rest_tf").alias("tf"))
    frequencies = pairs.groupBy("term").agg(F.count("*").alias("df"))
    weight = (1 + F.log(F.col("tf").cast("double"))) * (F.log((1.0 + F.lit(n)) / (1 + F.col("df"))) + 1)
    return pairs.join(frequencies, "term").groupBy("row").agg(F.sum(weight * weight).alias("rest"))


def raw_weights(idx, tf, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(np.asarray(tf, float))) * idf[idx]


def weights(idx, tf, idf: np.ndarray) -> np.ndarray:
    w = raw_weights(idx, tf, idf)
    return w / math.sqrt(float(w @ w))


class BlockMaxIndex:
    """Inverted lists over labelled examples in blocks. The `COMMON` terms with the longest lists lie in a dense
    matrix instead, and each block knows their largest weights; rare lists are added up at once. The most promising
    rows set a floor for the k best; only blocks, and rows in them, whose upper bounds reach it are multiplied out."""

    def __init__(self, examples: list[tuple[int, int, list[int], np.ndarray]], terms: int, block: int = BLOCK):
        # Neighbouring examples share their heaviest term, which makes the bounds tight.
        examples = sorted(examples, key=lambda e: (e[2][int(np.argmax(e[3]))], e[0]))
        self.ids = [e[0] for e in examples]
        self.labels = np.array([e[1] for e in examples], float)
        self.block = block
        n_blocks = -(-len(examples) // block)
        self.rows = n_blocks * block
        t = np.concatenate([np.asarray(e[2], np.int32) for e in examples] or [np.zeros(0, np.int32)])
        at = np.repeat(np.arange(len(examples), dtype=np.int32), [len(e[2]) for e in examples])
        ws = np.concatenate([e[3] for e in examples] or [np.zeros(0)])
        sizes = np.bincount(t, minlength=terms)
        often = np.argsort(-sizes, kind="stable")[:COMMON]
        often = often[sizes[often] > 0]
        self.column = np.full(terms, -1, np.int32)
        self.column[often] = np.arange(len(often))
        dense = self.column[t] >= 0
        self.dense = np.zeros((self.rows, len(often)))
        self.dense[at[dense], self.column[t[dense]]] = ws[dense]
        self.most = self.dense.reshape(n_blocks, block, len(often)).max(axis=1) if n_blocks else np.zeros((0, len(often)))
        self.dense_norm = np.sqrt(np.einsum("ij,ij->i", self.dense, self.dense))
        order = np.argsort(t[~dense], kind="stable")
        self.at, self.ws = at[~dense][order], ws[~dense][order]
        self.start = np.r_[0, np.cumsum(np.bincount(t[~dense], minlength=terms))]

    def search(self, idx: list[int], w: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k best (similarity, place), exactly; ties by place."""
        idx = np.asarray(idx, np.int64)
        column = self.column[idx]
        common = column >= 0
        asked = np.zeros(self.dense.shape[1])
        asked[column[common]] = w[common]
        idx, w = idx[~common], w[~common]
        start, end = self.start[idx], self.start[idx + 1]
        lists = [slice(a, b) for a, b in zip(start.tolist(), end.tolist()) if b > a]
        sums = np.zeros(self.rows)
        if lists:
            pull = np.concatenate([self.ws[x] for x in lists])
            pull *= np.repeat(w, end - start)
            sums = np.bincount(np.concatenate([self.at[x] for x in lists]), pull, minlength=self.rows)
        # No row can pass the sum of its rare lists by more than the common parts allow, and no block its own largest weights.
        near = sums + math.sqrt(float(asked @ asked)) * self.dense_norm
        bounds = np.minimum(near.reshape(-1, self.block).max(axis=1), sums.reshape(-1, self.block).max(axis=1) + self.most @ asked)
        first = np.argpartition(-near, 2 * k)[: 2 * k] if len(near) > 2 * k else np.arange(len(near))
        sims = sums[first] + self.dense[first] @ asked
        floor = float(np.partition(sims, -k)[-k]) if len(sims) >= k else 0.0
        blocks = np.flatnonzero((bounds > 0) & (bounds >= floor - 1e-12))
        rows = (blocks[:, None] * self.block + np.arange(self.block)).ravel()
        rows = rows[near[rows] >= floor - 1e-12]
        sims = sums[rows] + self.dense[rows] @ asked
        hit = sims > 0
        if hit.sum() > k:
            hit &= sims >= np.partition(sims, -k)[-k]
        rows, sims = rows[hit], sims[hit]
        best = np.lexsort((rows, -sims))[:k]
        return list(zip(sims[best].tolist(), rows[best].tolist()))

    def vote(self, found: list[tuple[float, int]], prior: float) -> float:
        pull = np.array([1 / (1 - min(s, 1.0) + NEAR) for s, _ in found])
        y = np.array([self.labels[p] for _, p in found])
        return float((pull @ y + prior) / (pull.sum() + 1)) if found else prior


class Shipped:
    """Parts packed for a broadcast; each worker makes the whole of them once."""

    def __init__(self, make: Callable, *parts):
        self.packed = zlib.compress(pickle.dumps((make, parts)), 1)
        self.made = None

    def get(self):
        if self.made is None:
            make, parts = pickle.loads(zlib.decompress(self.packed))
            self.made = make(*parts)
        return self.made


def numbered(terms: str) -> dict[str, int]:
    """Places of newline-separated terms; a term has letters only."""
    return {t: i for i, t in enumerate(terms.split("\n"))}


class Judge:
    """Neighbours over all terms and the vote of the neighbours over the telling terms, for counted texts."""

    def __init__(self, ids: list, marks: np.ndarray, starts: np.ndarray, idx: np.ndarray, tf: np.ndarray, idf: np.ndarray, telling: np.ndarray, prior: float):
        self.idf, self.telling, self.prior = idf, telling, prior
        fit = [(i, int(y), idx[a:b], tf[a:b]) for i, y, a, b in zip(ids, marks, starts, starts[1:])]
        self.whole = BlockMaxIndex([(i, y, idx, weights(idx, tf, idf)) for i, y, idx, tf in fit], max(1, len(idf)))
        parts = [(i, y, *self.told(idx, tf)) for i, y, idx, tf in fit]
        self.few = BlockMaxIndex([(i, y, idx, weights(idx, tf, idf)) for i, y, idx, tf in parts if len(idx)], max(1, len(idf)))

    def told(self, idx: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        use = self.telling[idx]
        return idx[use], tf[use]

    def look(self, idx: np.ndarray, tf: np.ndarray) -> tuple[list[tuple[float, int]], float, float]:
        """(neighbours over the known terms, squared length of those terms, vote over the telling terms)."""
        if not len(idx) or not self.whole.ids:
            return [], 0.0, 0.0
        w = raw_weights(idx, tf, self.idf)
        length = float(w @ w)
        few, few_tf = self.told(idx, tf)
        vote = self.few.vote(self.few.search(few, weights(few, few_tf, self.idf), NEIGHBOURS), self.prior) if len(few) and self.few.ids else 0.0
        return self.whole.search(idx, w / math.sqrt(length), NEIGHBOURS), length, vote


def blended(sims: list[float], marks: list[int], vote: float, prior: float) -> float:
    """Mean of the votes over all terms and over the telling terms; a side without neighbours counts 0."""
    if not sims:
        return vote / 2
    pull = 1 / (1 - np.minimum(sims, 1.0) + NEAR)
    return (float((pull @ np.asarray(marks, float) + prior) / (pull.sum() + 1)) + vote) / 2


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps (score, probability) fitted to labelled scores; every step is smoothed by one
    pseudo-row of the overall rate."""
    order = np.argsort(raw, kind="stable")
    raw, y = raw[order], y[order]
    rate = y.mean()
    values, start = np.unique(raw, return_index=True)
    ends = np.r_[start[1:], len(raw)]
    steps = [[float(v), float(y[a:b].sum()), b - a] for v, a, b in zip(values, start, ends)]
    pool: list[list[float]] = []
    for step in steps:
        pool.append(step)
        while len(pool) > 1 and pool[-2][1] / pool[-2][2] >= pool[-1][1] / pool[-1][2]:
            last = pool.pop()
            pool[-1] = [last[0], pool[-1][1] + last[1], pool[-1][2] + last[2]]
    return np.array([p[0] for p in pool]), np.array([(p[1] + rate) / (p[2] + 1) for p in pool])


def flat_rows(rows: pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, starts, idx, tf) of coded rows by id, each list column as one flat array."""
    rows = rows.combine_chunks()
    rows = rows.take(pc.sort_indices(rows["id"]))
    lists = [rows[c].combine_chunks() for c in ("idx", "tf")]
    starts = np.r_[0, np.cumsum(pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False))].astype(np.int64)
    idx, tf = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int32) for x in lists)
    return rows["id"].to_pylist(), rows["y"].to_numpy(), starts, idx, tf


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, sample_terms: int = SAMPLE_TERMS, threshold: float = 0.3) -> DataFrame:
    """One row per document: key, held_out, score in [0, 1], predicted, evidence (neighbours as label, id
    and similarity). Null and empty texts, and texts that share no term with an example, get the calibrated rate of such
    texts. Without labels of both classes every score is the share of label 1, or 0 without any label."""
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    sc = docs.sparkSession.sparkContext
    train = materialise(training_rows(labels, key, label, sample))
    chosen = telling_terms(docs, train, "text")
    sampled = materialise(within_terms(materialise(sample_counts(docs, train, "text")), sample_terms))
    marks = sampled.select("fit", "y", (F.size("words") > 0).alias("some")).toArrow().to_pandas()  # at most `sample` rows
    prior = float(marks["y"].mean()) if len(marks) else 0.0
    # Without an example there is nothing to be near to, and no term needs a count.
    if not (marks["fit"] & marks["some"]).any():
        aside = marks.loc[~marks["fit"].astype(bool), "y"]
        rate = float(isotonic(np.zeros(len(marks)), marks["y"].to_numpy(float))[1][0]) if len(aside) else prior
        out = docs.select("id", F.lit(min(1.0, max(0.0, rate))).alias("score"), F.lit(None).cast(EVIDENCE).alias("e"))
        out = out.withColumn("evidence", F.coalesce("e", F.array().cast(EVIDENCE)))
        return out.select(F.col("id").alias(key), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")

    # Places go by term, whatever order the terms arrive in.
    terms = sampled.select(F.explode("words").alias("w")).distinct().toArrow()["w"].combine_chunks()
    terms = terms.take(pc.sort_indices(terms))
    telling = pc.is_in(terms, value_set=pa.array(chosen, terms.type)).to_numpy(zero_copy_only=False)
    size = len(terms)
    place = sc.broadcast(Shipped(numbered, "\n".join(terms.to_pylist())))
    del terms
    coded = materialise(coded_sample(sampled, place))
    counted = materialise(term_counts(docs, "text", place).withColumn("row", F.monotonically_increasing_id()))
    n = counted.count()

    def batch_frequencies(cols):
        found = np.bincount(np.concatenate([np.asarray(x, np.int64) for x in cols[0]])) if cols[0] else np.zeros(0, np.int64)
        seen = np.flatnonzero(found)
        return {"t": seen.tolist(), "df": found[seen].tolist()}

    seen = map_batches(counted, ["idx"], batch_frequencies, "t int, df long").groupBy("t").agg(F.sum("df").alias("df")).toArrow()
    frequency = np.zeros(size)  # at most the terms of the sample
    frequency[seen["t"].to_numpy()] = seen["df"].to_numpy()
    idf = np.log((1 + n) / (1 + frequency)) + 1
    fit = flat_rows(coded.where(F.col("fit") & (F.size("idx") > 0)).toArrow())
    shared = sc.broadcast(Shipped(Judge, *fit, idf, telling, prior))
    del fit
    memo: dict = {}

    def look(cols):
        """Of each text: similarities and labels of its neighbours, the ids of the nearest three, and the rest of `Judge.look`."""
        judge = shared.value.get()
        out = {"id": cols[0], "row": cols[1], "sims": [], "marks": [], "names": [], "length": [], "vote": []}
        for idx, tf in zip(cols[2], cols[3]):
            idx, tf = np.array(idx, np.int64), np.array(tf, np.int64)
            same = hashlib.blake2b(idx.tobytes() + tf.tobytes(), digest_size=16).digest()
            if (made := memo.get(same)) is None:
                found, length, vote = judge.look(idx, tf)
                if len(memo) >= REMEMBERED:
                    memo.clear()
                made = memo[same] = ([s for s, _ in found], [int(judge.whole.labels[p]) for _, p in found], [str(judge.whole.ids[p]) for _, p in found[:3]], length, vote)
            for c, v in zip(("sims", "marks", "names", "length", "vote"), made):
                out[c].append(v)
        return out

    looked = "sims array<double>, marks array<int>, names array<string>, length double, vote double"
    aside = coded.where(~F.col("fit")).select(F.col("id"), F.col("y").cast("long").alias("row"), "idx", "tf")
    tried = map_batches(aside, ["id", "row", "idx", "tf"], look, f"id {kind}, row long, {looked}").select("row", "sims", "marks", "vote").toArrow()
    raw = [blended(s, m, v, prior) for s, m, v in zip(*(tried[c].to_pylist() for c in ("sims", "marks", "vote")))]
    steps, rates = isotonic(np.array(raw), tried["row"].to_numpy().astype(float)) if raw else (np.array([0.0]), np.array([prior]))
    found = map_batches(counted, ["id", "row", "idx", "tf"], look, f"id {kind}, row long, {looked}")
    # The terms outside the sample lengthen a text; they change no order among its neighbours.
    share = F.when(F.col("length") > 0, F.sqrt(F.col("length") / (F.col("length") + F.coalesce("rest", F.lit(0.0))))).otherwise(0.0)
    found = found.join(rest_norms(counted, n), "row", "left").withColumn("share", share)

    def fn(cols):
        out = {"id": cols[0], "score": [], "evidence": []}
        for sims, marks, names, share, vote in zip(*cols[1:]):
            sims = [s * share for s in sims]
            value = float(np.interp(blended(sims, marks, vote, prior), steps, rates)) if sims else float(rates[0])
            out["score"].append(min(1.0, max(0.0, value)))
            out["evidence"].append([{"id": i, "label": m, "similarity": s} for i, m, s in zip(names, marks, sims)])
        return out

    out = map_batches(found, ["id", "sims", "marks", "names", "share", "vote"], fn, f"id {kind}, score double, evidence {EVIDENCE}")
    return out.select(F.col("id").alias(key), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
