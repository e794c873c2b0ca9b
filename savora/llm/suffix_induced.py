"""Removal of byte strings of a given length that start more than once anywhere in the corpus.

No suffix is put in order: hash fingerprints of sampled positions, with names that grow level by level, replace
induced suffix sorting. A full suffix array would need tuples of 16 and more bytes per text byte on disk.

* Sampling. A position is sampled if its `k`-byte name has the smallest hash among the names of some
  window of `length` bytes. Equal windows sample the same places, about two in `length - k` positions.
* Tuples. A sampled position stands for the run of windows that chose it. Its tuple holds the document,
  the run, the name (positions of equal names share a prefix of at least `k` bytes) and a hash of all bytes
  that the run's windows cover.
* Meeting. Tuples with equal 64-bit name hashes are counted and joined by Spark (`groupBy` and equi-joins); there is
  no order-inducing step, no queue of our own, and no common-prefix value beyond the name's length. Counts
  are combined before the shuffle, so copies of a passage are no hot key.
* Settling. If all bytes of a run occur again, so does each of its windows, without looking at them. If its
  name is unique, none does. What is left are runs at the edges of repeats: they go to the next level,
  which samples them with longer names (`k` grows towards `length`). At the last level the names are the
  windows themselves, so the result is exact up to 64-bit hash collisions between unequal strings.

Only edge runs carry bytes from level to level, and each level leaves fewer windows open.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from savora.llm.common import map_batches
from savora.session import materialise, release

LENGTH = 400
BLOCK = 1 << 19  # windows hashed at once; a run cut at a block's end is settled at a later level
PLACE = np.uint64((1 << 20) - 1)
RUN = "id {0}, rid long, p0 int, p1 int, h long, g long"


def levels(length: int) -> list[int]:
    """Name lengths, from a quarter of the length up to the length."""
    out, left = [], length * 3 // 4
    while left > 4:
        out.append(length - left)
        left //= 6
    return [*out, length]


@lru_cache(1)
def _tables() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Two polynomial hashes modulo 2^64: random byte values, powers of an odd base and of its inverse."""
    made = []
    for seed in (11, 23):
        rng = np.random.default_rng(seed)
        values = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = (int(rng.integers(0, 1 << 62)) << 3 | 5) % (1 << 64)
        made.append((values, base, pow(base, -1, 1 << 64)))
    return made


@lru_cache(4)
def _powers(seed_at: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    _, base, inverse = _tables()[seed_at]
    out = []
    for b in (base, inverse):
        p = np.full(1 << bits, np.uint64(b))
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _prefix(data: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _powers(which, max(12, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_tables()[which][0][data] * inverse[: len(data)], out=sums[1:])
    return sums, power


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def runs(data: bytes, k: int, length: int) -> tuple[np.ndarray, ...]:
    """(p0, p1, h, g): runs of window starts with a common sampled suffix, its name, and the hash of the
    covered bytes data[p0 : p1 + length]."""
    whole = np.frombuffer(data, np.uint8)
    windows = len(whole) - length + 1
    parts = []
    for at in range(0, max(0, windows), BLOCK):
        seg = whole[at : min(at + BLOCK, windows) + length - 1]
        sums, power = _prefix(seg, 0)
        names = _mix((sums[k:] - sums[:-k]) * power[: len(seg) - k + 1])
        chosen = (_sliding_min((names & ~PLACE) | np.arange(len(names), dtype=np.uint64), length - k + 1) & PLACE).astype(np.int64)
        p0 = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
        p1 = np.r_[p0[1:], len(chosen)] - 1
        sums, power = _prefix(seg, 1)
        place = chosen[p0]
        g = _mix((sums[p1 + length] - sums[p0]) * power[p0] + _mix((p1 - p0).astype(np.uint64) << np.uint64(32) | (place - p0).astype(np.uint64)))
        parts.append((p0 + at, p1 + at, names[place].view(np.int64), g.view(np.int64)))
    if not parts:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(c) for c in zip(*parts))


def _expand(keys: list[list], datas: list[bytes], starts: list[int], k: int, length: int, names: list[str], extra: list[list] | None = None, with_bytes: bool = False):
    """Batches of runs of several byte strings, with their keys repeated."""
    out = {n: [] for n in names}
    held = 0
    for row, data in enumerate(datas):
        p0, p1, h, g = runs(data, k, length)
        if not len(p0):
            continue
        for n, column in zip(names, [*keys, *(extra or [])]):
            out[n] += [column[row]] * len(p0)
        out["p0"].append(p0 + starts[row])
        out["p1"].append(p1 + starts[row])
        out["h"].append(h)
        out["g"].append(g)
        if with_bytes:
            out["data"] += [data[a : b + length] for a, b in zip(p0.tolist(), p1.tolist())]
            held += len(data) + sum(len(x) for x in out["data"][-len(p0) :])
        held += 64 * len(p0)
        if held > 8 << 20:
            yield {n: np.concatenate(v) if n in ("p0", "p1", "h", "g") else v for n, v in out.items()}
            out, held = {n: [] for n in names}, 0
    if out["h"]:
        yield {n: np.concatenate(v) if n in ("p0", "p1", "h", "g") else v for n, v in out.items()}


def repeated_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, rid, p0, p1): runs of window starts whose windows start somewhere else as well. `docs` has id, rid, text."""
    kind = docs.schema["id"].dataType.simpleString()
    ks = levels(length)
    schema = RUN.format(kind)
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def first(cols):
        datas = [(t or "").encode() for t in cols[2]]
        yield from _expand(cols[:2], datas, [0] * len(datas), ks[0], length, names)

    every = materialise(map_batches(docs, ["id", "rid", "text"], first, schema))
    # Written, so that the join has exchanges of its own on both sides and Spark can split hot names.
    twice = materialise(every.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"))
    tuples = materialise(every.join(twice, "h"))
    release(every)
    classes = materialise(tuples.groupBy("h", "g").agg(F.count("*").alias("c"), F.min(F.struct("id", "rid", "p0", "p1")).alias("first")))
    again = materialise(classes.where("c > 1").select("h", "g"))
    found = materialise(tuples.join(again, ["h", "g"]).select("id", "rid", "p0", "p1"))
    release(tuples)
    # Edge names: at least one run occurs once. One run per class goes on; `ask` says that its answer counts.
    open_ = materialise(classes.where("c = 1").select("h").distinct())
    edges = classes.join(open_, "h").select("first.*", (F.col("c") == 1).alias("ask"))
    per_doc = edges.groupBy("id", "rid").agg(F.collect_list(F.struct("p0", "p1", "ask")).alias("runs"))
    cut = docs.join(per_doc, docs["id"].eqNullSafe(per_doc["id"]) & (docs["rid"] == per_doc["rid"])).select(docs["id"], docs["rid"], "text", "runs").dropDuplicates(["id", "rid"])

    def fetch(cols):
        out, held = {n: [] for n in ("id", "rid", "p0", "ask", "data")}, 0
        for i, r, t, edge in zip(*cols):
            data = (t or "").encode()
            for e in edge:
                for n, v in zip(out, (i, r, e["p0"], e["ask"], data[e["p0"] : e["p1"] + length])):
                    out[n].append(v)
                held += e["p1"] - e["p0"] + length
            if held > 8 << 20:
                yield out
                out, held = {n: [] for n in out}, 0
        yield out

    edge_schema = f"id {kind}, rid long, p0 int, ask boolean, data binary"
    work = materialise(map_batches(cut, ["id", "rid", "text", "runs"], fetch, edge_schema))
    for k in ks[1:]:
        last = k == length
        finer = ["id", "rid", "ask", "p0", "p1", "h", "g", *([] if last else ["data"])]
        kinds = {"id": kind, "rid": "long", "ask": "boolean", "p0": "int", "p1": "int", "h": "long", "g": "long", "data": "binary"}

        def split(cols, k=k, last=last, finer=finer):
            ids, rids, p0, ask, data = cols
            yield from _expand([ids, rids, ask], data, p0, k, length, finer, with_bytes=not last)

        made = materialise(map_batches(work, ["id", "rid", "p0", "ask", "data"], split, ", ".join(f"{n} {kinds[n]}" for n in finer)))
        release(work)
        # Every run of `work` stands for all runs of equal bytes, so one that does not ask is repeated already.
        by_class = materialise(made.groupBy("h", "g").agg(F.count("*").alias("c"), F.max("ask").alias("ask"), F.min("ask").alias("all_ask"), F.min(F.struct("id", "rid", "p0")).alias("first")))
        good = materialise(by_class.where("ask and (c > 1 or not all_ask)").select("h", "g"))
        more = materialise(made.where("ask").join(good, ["h", "g"]).select("id", "rid", "p0", "p1"))
        found = found.unionByName(more)
        if not last:
            alone = (F.col("c") == 1) & F.col("all_ask")
            by_name = materialise(by_class.groupBy("h").agg(F.count("*").alias("n"), F.max(F.when(alone, 1).otherwise(0)).alias("open")).where("n > 1 and open = 1").select("h"))
            keep = materialise(by_class.join(by_name, "h").select("h", "g", "first.*", alone.alias("asks")))
            one = made.drop("ask").join(keep.select("h", "g", F.col("id").alias("i"), "rid", "p0", "asks"), ["h", "g", "rid", "p0"]).where(F.col("id").eqNullSafe(F.col("i")))
            work = materialise(one.select("id", "rid", "p0", F.col("asks").alias("ask"), "data").dropDuplicates(["id", "rid", "p0"]))
        release(made)
        if last or work.isEmpty():
            break
    return found


def removed_spans(p0: np.ndarray, p1: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal byte spans covered by windows that start in the runs."""
    order = np.argsort(p0, kind="stable")
    start, end = p0[order], np.maximum.accumulate(p1[order] + length)
    new = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    return list(zip(start[new].tolist(), end[np.r_[new[1:], len(end)] - 1].tolist()))


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row: key, n_bytes, n_removed, n_spans, spans (byte start and end), kept_sha256.

    Null and empty texts have no bytes. Equal rows, repeated keys with other texts, and rows without a key are
    documents of their own: rows are told apart by key and text together.
    """
    docs = df.select(F.col(key).alias("id"), F.xxhash64(F.col(key), F.col(text)).alias("rid"), F.col(text).alias("text"))
    found = repeated_runs(docs, length)
    per_doc = found.groupBy(F.col("id").alias("i"), F.col("rid").alias("r")).agg(F.collect_set(F.struct("p0", "p1")).alias("runs"))
    joined = docs.join(per_doc, docs["id"].eqNullSafe(per_doc["i"]) & (docs["rid"] == per_doc["r"]), "left")

    def fn(cols):
        out = {c: [] for c in ("key", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256")}
        for k, t, r in zip(*cols):
            data = (t or "").encode()
            spans = removed_spans(np.array([x["p0"] for x in r]), np.array([x["p1"] for x in r]), length) if r else []
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            for c, v in zip(out, (k, len(data), sum(b - a for a, b in spans), len(spans), [list(s) for s in spans], kept.hexdigest())):
                out[c].append(v)
        return out

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept_sha256 string"
    return map_batches(joined, ["id", "text", "runs"], fn, schema).withColumnRenamed("key", key)
