"""Near-duplicate detection with fast similarity sketching.

A document's set is its distinct word shingles. A sketch has `bins` coordinates: round i throws every
element into a hashed bin with the value i + hash, a bin keeps its minimum, and rounds go on until every
bin is filled; a last family of rounds fills bin j from all elements, so no coordinate stays empty. Each
coordinate matches with probability equal to the Jaccard similarity, with concentration like independent
samples. Bands of coordinates give candidates, which full sets confirm.

Equal sets become one class before banding. Inside a band bucket, classes are compared with one hub at a
time, not with each other: only pairs still in different components after the hub rounds are compared
directly, and of these only the ones that their similarities to the hub leave possible (a metric bound), so a bucket of n similar texts costs about n comparisons, and no link that could join two
components goes unchecked.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from savora.llm.common import map_batches
from savora.session import materialise

BANDS, ROWS = 40, 6  # a pair at similarity 0.85 shares no band with probability 6e-9
HUB_ROUNDS = 2
DIRECT_PER_MEMBER = 4
PARITY_WORDS = 16
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; A-Z count as a-z, fewer words than `width` are one shingle."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and the six ASCII blanks only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(width, len(words))
    out = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        out = _mix((out ^ h[i : len(h) - k + 1 + i]) * MIX + np.uint64(i + 1))
    return np.unique(out)


def sketch(items: np.ndarray, bins: int) -> np.ndarray:
    """One 64-bit coordinate per bin of a non-empty set."""
    out = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    n, i = len(items), 0
    aim = math.ceil(bins * (math.log(bins) + 2) / n)
    while i < bins and (out == np.iinfo(np.uint64).max).any():
        step = max(1, min(aim if i == 0 else 4, bins - i, 65536 // n + 1))
        rounds = np.arange(i, i + step, dtype=np.uint64)
        h = _mix((items[None, :] ^ _mix((rounds + np.uint64(1)) * MIX)[:, None]) * MIX)
        to = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(bins)) >> np.uint64(32)
        np.minimum.at(out, to.astype(np.int64).ravel(), (rounds[:, None] << np.uint64(32) | h >> np.uint64(32)).ravel())
        i += step
    for j in np.flatnonzero(out == np.iinfo(np.uint64).max):
        h = _mix((items ^ _mix(np.uint64([bins + j + 1]) * MIX)) * MIX)
        out[j] = np.uint64(bins + j) << np.uint64(32) | h.min() >> np.uint64(32)
    return out


def parity_words(items: np.ndarray) -> np.ndarray:
    """Words of bits in which every element toggles the one that its leading hash bits name."""
    bits = 64 * PARITY_WORDS
    odd = np.bincount((items >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def band_keys(coords: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.arange(1, bands + 1, dtype=np.uint64) * MIX
    for r in range(rows):
        keys = _mix((keys ^ coords.reshape(bands, rows)[:, r]) * MIX)
    return keys.view(np.int64)


def _sets(df: DataFrame, key: str, text: str, width: int, bands: int, rows: int) -> DataFrame:
    def fn(cols):
        out = {"id": cols[0], "n": [], "set": [], "bands": []}
        for t in cols[1]:
            items = shingles(t, width)
            out["n"].append(len(items))
            out["set"].append(hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None)
            out["bands"].append(band_keys(sketch(items, bands * rows), bands, rows) if len(items) else [])
        return out

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df, [key, text], fn, f"id {kind}, n long, set binary, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest node reachable from every node of `edges` (a, b). Alternating stars;
    hub nodes are aggregated map-side and joined, never gathered."""
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.unionByName(low.select(F.col("k").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(low, F.col("a") == F.col("k")).select("b", "k", "m")
        edges = materialise(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("k").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
    return edges.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has just that one, and it has none itself."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per = ends.groupBy("id").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return per.where("up > 1 or (up = 1 and down > 0)").isEmpty()


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the sizes of the intersection and union of their full sets."""
    one = sets.select(F.col("id").alias("b"), F.col("items").alias("items_b"))
    two = sets.select(F.col("id").alias("a"), F.col("items").alias("items_a"))
    joined = pairs.join(one, "b").join(two, "a")

    def fn(cols):
        out = {"a": cols[0], "b": cols[1], "both": [], "either": []}
        for x, y in zip(cols[2], cols[3]):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out["both"].append(both)
            out["either"].append(len(x) + len(y) - both)
        return out

    kind = pairs.schema["a"].dataType.simpleString()
    return map_batches(joined, ["a", "b", "items_a", "items_b"], fn, f"a {kind}, b {kind}, both long, either long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, numerator: int = 85, denominator: int = 100, bands: int = BANDS, rows: int = ROWS, hub_rounds: int = HUB_ROUNDS, direct_per_member: int = DIRECT_PER_MEMBER) -> DataFrame:
    """One row per row of `df`: key, n_shingles, component_id (smallest key reachable over links with
    denominator * shared >= numerator * union), kept.

    Texts without words link with nothing. Rows that repeat a key share its component. Rows without a key
    take the component of the texts they equal, else null, and are kept only then.
    """
    base = materialise(_sets(df, key, text, width, bands, rows))
    classes = base.where("set is not null").groupBy("set").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = materialise(classes.where("rep is not null"))
    banded = classes.select(F.col("rep").alias("id"), "n", F.explode("bands").alias("band"))
    # Written, so that the join has exchanges of its own on both sides and Spark can split hot bands.
    shared = materialise(banded.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band"))
    members = materialise(banded.join(shared, "band"))
    central = members.join(members.groupBy("band").agg(F.count("*").alias("c")), "band").groupBy("id").agg(F.sum("c").alias("central"))
    members = materialise(members.join(central, "id"))
    wanted = members.select("id").distinct()

    def items(cols):
        found = [shingles(t, width) for t in cols[1]]
        return {"id": cols[0], "items": [f.tobytes() for f in found], "parity": [parity_words(f) for f in found]}

    kind = base.schema["id"].dataType.simpleString()
    texts = df.select(F.col(key).alias("id"), F.col(text).alias("t")).join(wanted, "id").groupBy("id").agg(F.max("t").alias("t"))
    sets = materialise(map_batches(texts, ["id", "t"], items, f"id {kind}, items binary, parity array<long>"))
    near = F.least("n", "n2") * denominator >= F.greatest("n", "n2") * numerator
    linked = denominator * F.col("both") >= numerator * F.col("either")
    seen = labels = None
    for step in range(hub_rounds + 1):
        now = members.withColumn("comp", F.col("id")) if labels is None else materialise(members.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id")))
        # Per band with more than one component: how many pairs of its members are in different ones, and its
        # hub, the most central member, which shares the most bands; after the first step one by hash.
        own = lambda order: F.max(F.struct(order.alias("by"), F.col("id").alias("hub"), F.col("n").alias("n2"), F.col("comp").alias("comp2")))
        per = now.groupBy("band", "comp").agg(F.count("*").alias("c"), own(F.col("central")).alias("middle"), own(F.xxhash64("id", F.lit(step))).alias("drawn"))
        per = per.groupBy("band").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("own"), F.count("*").alias("comps"), F.max("middle").alias("middle"), F.max("drawn").alias("drawn"))
        bands_open = materialise(per.where("comps > 1"))
        cost = bands_open.agg(F.sum(F.col("c") * F.col("c") - F.col("own")).alias("pairs"), F.sum("c").alias("members")).first()
        if not cost["members"]:
            break
        last = step == hub_rounds or (step > 0 and cost["pairs"] <= 2 * direct_per_member * cost["members"])
        hubs = bands_open.select("band", F.col("middle" if step == 0 or last else "drawn").alias("h")).select("band", "h.hub", "h.n2", "h.comp2")
        if last:
            # 1 - similarity is a metric, so two members whose similarities to the hub differ by more
            # than 1 - threshold are no link. Members that were not compared with the hub stay in.
            known = seen.unionByName(seen.select(F.col("b").alias("a"), F.col("a").alias("b"), "both", "either")).select(F.col("a").alias("id"), F.col("b").alias("hub"), (F.col("both") / F.col("either")).alias("s"))
            open_ = now.join(hubs.select("band", "hub"), "band").join(known, ["id", "hub"], "left")
            words = [F.get("parity", F.lit(i)).alias(f"w{i}") for i in range(PARITY_WORDS)]
            open_ = open_.join(sets.select("id", *words), "id")
            open_ = materialise(open_.select("band", "id", "n", "comp", F.when(F.col("id") == F.col("hub"), 1.0).otherwise(F.col("s")).alias("s"), *[f"w{i}" for i in range(PARITY_WORDS)]))
            other = open_.select("band", F.col("id").alias("hub"), F.col("n").alias("n2"), F.col("comp").alias("comp2"), F.col("s").alias("s2"), *[F.col(f"w{i}").alias(f"v{i}") for i in range(PARITY_WORDS)])
            odd = sum(F.bit_count(F.col(f"w{i}").bitwiseXOR(F.col(f"v{i}"))) for i in range(PARITY_WORDS))
            close = odd * (denominator + numerator) <= (F.col("n") + F.col("n2")) * (denominator - numerator)
            far = F.coalesce(F.abs(F.col("s") - F.col("s2")) > 1 - numerator / denominator + 1e-9, F.lit(False))
            pairs = open_.join(other, "band").where((F.col("id") > F.col("hub")) & (F.col("comp") != F.col("comp2")) & near & ~far & close)
        else:
            pairs = now.join(hubs, "band").where((F.col("id") != F.col("hub")) & (F.col("comp") != F.col("comp2")) & near)
        pairs = pairs.select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b")).distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        fresh = materialise(_compared(materialise(pairs), sets))
        seen = fresh if seen is None else seen.unionByName(fresh)
        if step == 0 or not fresh.where(linked).isEmpty():
            labels = components(seen.where(linked).select("a", "b"))
        if last:
            break
    out = base.select("id", F.col("n").alias("n_shingles"), "set").join(classes.select("set", "rep"), "set", "left")
    if labels is not None:
        out = out.join(labels.select(F.col("id").alias("rep"), "comp"), "rep", "left")
    else:
        out = out.withColumn("comp", F.lit(None).cast(kind))
    comp = F.coalesce("comp", "rep", "id")
    kept = F.coalesce(F.col("id") == comp, comp.isNull())
    return out.select(F.col("id").alias(key), "n_shingles", comp.alias("component_id"), kept.alias("kept"))
