"""Exact Jaccard join of word n-gram sets by universe partition and pigeonhole.

* Segments. Sizes fall into bands that grow by half. Two sets of a band at the threshold differ in at most H elements, so
  the elements are hashed into H + 1 segments: one segment at least is equal. A set signs the segments of its own band,
  and those of the next band if a set there may still link with it.
* Index. Signatures that two different sets share make buckets. A bucket first compares its sets with one hub at a time;
  sets that are in one component already need no comparison (`components`), or all are compared (`pairs`).
* Comparison. Sets of one bucket are held against each other by the parity bits of their elements, which bound the number of
  elements in which two sets differ from below; only pairs that pass leave the join.
* Allocation. `DIRECT` comparisons of bits cost about as much as the one-deletion neighbourhood of a set. A bucket that would
  need more a member is costly. A set with costly segments
  skips them and pays by allowing one deletion in as many other segments: if no other segment is equal, one of those
  differs by a single element. One-deletion neighbourhoods are indexed for the members of costly buckets alone;
  how often each neighbour meets is counted first, and the cheapest segments are taken. Costly segments are probed
  only where the others do not suffice.
* Every candidate is confirmed on the full sets of 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from savora.llm.common import map_batches
from savora.llm.fast_sketch import components as connected
from savora.llm.fast_sketch import PARITY_WORDS, parity_words, shingles
from savora.session import materialise

WIDTH = 3
SIMILAR = (90, 100)
HUB_ROUNDS = 2
DIRECT = 512
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def most_apart(n: int, similar: tuple[int, int]) -> int:
    """The most elements in which a set of n elements and one that is not larger differ if they link."""
    num, den = similar
    return 2 * n * (den - num) // (den + num)


def band_of(n: int) -> tuple[int, int, int]:
    """Number, smallest and largest size of the band of a size."""
    b, low = 0, 1
    while True:
        high = low + low // 2
        if n <= high:
            return b, low, high
        b, low = b + 1, high + 1


def bands_signed(n: int, similar: tuple[int, int]) -> list[tuple[int, int]]:
    """(band, segments) that a set of n elements signs: its own, and the next if a link there is possible."""
    b, _, high = band_of(n)
    out = [(b, most_apart(high, similar) + 1)]
    if n * similar[1] >= similar[0] * (high + 1):
        out.append((b + 1, most_apart(band_of(high + 1)[2], similar) + 1))
    return out


def segment_sums(items: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Borders of the segments in the sorted items, the sum of mixed items of each, and the mixed items."""
    starts = (np.arange(segments + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(segments)
    starts[1:] += (np.arange(1, segments + 1, dtype=np.uint64) << np.uint64(32)) % np.uint64(segments) != 0
    borders = np.searchsorted(items >> np.uint64(32), starts)
    mixed = _mix(items)
    upto = np.zeros(len(items) + 1, np.uint64)
    np.cumsum(mixed, out=upto[1:])
    return borders, upto[borders[1:]] - upto[borders[:-1]], mixed


def _signed(band: int, segment: np.ndarray, sums: np.ndarray) -> np.ndarray:
    place = _mix((np.uint64(band + 1) << np.uint64(40)) + segment.astype(np.uint64))
    return _mix((sums + place) * MIX).view(np.int64)


def signatures(items: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
    """One signature per segment of every band that the set signs."""
    out = []
    for band, segments in bands_signed(len(items), similar):
        _, sums, _ = segment_sums(items, segments)
        out.append(_signed(band, np.arange(segments), sums))
    return np.concatenate(out)


def neighbourhood(items: np.ndarray, band: int, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the segments, and for every element its segment and the signature without it."""
    borders, sums, mixed = segment_sums(items, segments)
    of = np.repeat(np.arange(segments), np.diff(borders))
    return np.arange(segments), _signed(band, np.arange(segments), sums), of, _signed(band, of, sums[of] - mixed)


def _sets(df: DataFrame, key: str, text: str, width: int, similar: tuple[int, int]) -> DataFrame:
    """id, n, node (hash of the set), print (of the text), sigs (at the first of equal sets of a batch)."""
    def fn(cols):
        out, known = {"id": cols[0], "n": [], "node": [], "print": cols[2], "sigs": []}, set()
        for t in cols[1]:
            items = shingles(t, width)
            node = xxhash.xxh3_64_intdigest(items.tobytes()) - (1 << 63) if len(items) else None
            out["n"].append(len(items))
            out["node"].append(node)
            out["sigs"].append([] if node is None or node in known else signatures(items, similar))
            known.add(node)
        return out

    kind = df.schema[key].dataType.simpleString()
    source = df.select(F.col(key).alias("id"), F.col(text).alias("text"), F.md5(F.col(text)).alias("print"))
    return map_batches(source, ["id", "text", "print"], fn, f"id {kind}, n long, node long, print string, sigs array<long>")


def _items(df: DataFrame, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """(node, n, items, parity) of the wanted nodes; one text of each is read again."""
    texts = df.select(F.md5(F.col(text)).alias("print"), F.col(text).alias("t")).join(wanted.select("print"), "print").groupBy("print").agg(F.max("t").alias("t"))

    def fn(cols):
        found = [shingles(t, width) for t in cols[0]]
        return {"node": [xxhash.xxh3_64_intdigest(f.tobytes()) - (1 << 63) for f in found], "n": [len(f) for f in found], "items": [f.tobytes() for f in found], "parity": [parity_words(f) for f in found]}

    return map_batches(texts, ["t"], fn, "node long, n long, items binary, parity array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) with shared and united elements, and whether they link."""
    one = sets.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
    two = sets.select(F.col("node").alias("a"), F.col("items").alias("items_a"))

    def fn(cols):
        out = {"a": cols[0], "b": cols[1], "shared": [], "united": []}
        for x, y in zip(cols[2], cols[3]):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            out["shared"].append(shared)
            out["united"].append(len(x) + len(y) - shared)
        return out

    joined = pairs.join(one, "b").join(two, "a")
    found = map_batches(joined, ["a", "b", "items_a", "items_b"], fn, "a long, b long, shared long, united long")
    return found.withColumn("linked", F.col("shared") * similar[1] >= F.col("united") * similar[0])


def _bits(sets: DataFrame, prefix: str) -> DataFrame:
    return sets.select("node", *[F.get("parity", F.lit(i)).alias(f"{prefix}{i}") for i in range(PARITY_WORDS)])


def _close(similar: tuple[int, int], n: str, other: str):
    """Whether the parity bits v* and w* leave a link between sets of these sizes possible."""
    odd = sum(F.bit_count(F.col(f"v{i}").bitwiseXOR(F.col(f"w{i}"))) for i in range(PARITY_WORDS))
    return odd * (similar[0] + similar[1]) <= (F.col(n) + F.col(other)) * (similar[1] - similar[0])


def _costly_pairs(now: DataFrame, costly: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Candidates (x, y) that the members of costly buckets may have missed elsewhere, by allocation."""
    marked = now.join(costly.select("sig", "cost"), "sig")
    hot = marked.groupBy("node").agg(F.collect_set(F.struct("sig", "cost")).alias("hot"), F.first("comp").alias("comp"))
    members = materialise(hot.join(sets.drop("parity"), "node"))

    def fn(cols):
        """Index rows: role 0 a segment, 1 a segment without an element. Probe rows: role 2 a segment without an
        element (meets 0), 3 a segment (meets 1). Role 4: a costly segment of the set itself."""
        out = {n: [] for n in ("node", "n", "comp", "role", "seg", "key", "need", "cost")}
        rows = 0

        def put(node, n, comp, role, seg, key, need, cost):
            m = len(key)
            for c, v in zip(out, (np.full(m, node), np.full(m, n), np.full(m, comp), np.full(m, role), seg, key, np.full(m, need), cost)):
                out[c].append(np.asarray(v, np.int64))
            return m

        for node, n, comp, data, hot in zip(*cols):
            items = np.frombuffer(data, np.uint64)
            cost = {h["sig"]: h["cost"] for h in hot}
            for step, (band, segments) in enumerate(bands_signed(n, similar)):
                seg, whole, of, less = neighbourhood(items, band, segments)
                rows += put(node, n, comp, 0, seg, whole, 0, np.zeros(len(seg))) + put(node, n, comp, 1, of, less, 0, np.zeros(len(of)))
                if step:
                    continue
                dear = np.array([s in cost for s in whole.tolist()])
                need = most_apart(n, similar) + 1 - int((~dear).sum())
                if need > 0:
                    free = ~dear[of]
                    rows += put(node, n, comp, 2, of[free], less[free], need, np.zeros(int(free.sum())))
                    rows += put(node, n, comp, 3, seg[~dear], whole[~dear], need, np.zeros(int((~dear).sum())))
                    rows += put(node, n, comp, 4, seg[dear], whole[dear], need, [cost[s] for s in whole[dear].tolist()])
            if rows > 200_000:
                yield {c: np.concatenate(v) for c, v in out.items()}
                out, rows = {c: [] for c in out}, 0
        if rows:
            yield {c: np.concatenate(v) for c, v in out.items()}

    schema = "node long, n long, comp long, role int, seg int, key long, need int, cost long"
    signed = map_batches(members, ["node", "n", "comp", "items", "hot"], _as_int(fn), schema)
    signed = materialise(signed)
    index = signed.where("role < 2").select("key", "role", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("comp").alias("cy"))
    often = materialise(index.groupBy("key", "role").agg(F.count("*").alias("c")))
    probe = signed.where("role in (2, 3)").withColumn("meets", F.col("role") - 2)
    met = probe.join(often.select("key", F.col("role").alias("meets"), "c"), ["key", "meets"], "left")
    # What a segment with one deletion costs; then as many of the cheapest as are needed, a costly one after all others.
    per = met.groupBy("node", "seg", "need").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("cost"), F.lit(0).alias("dear"))
    per = per.unionByName(signed.where("role = 4").select("node", "seg", "need", "cost", F.lit(1).alias("dear")))
    chosen = per.withColumn("at", F.row_number().over(W.partitionBy("node").orderBy("dear", "cost", "seg"))).where("at <= need")
    chosen = materialise(chosen.select("node", "seg", "dear"))
    near = (F.col("node") != F.col("y")) & (F.col("n") >= F.col("ny")) & (F.col("ny") * similar[1] >= F.col("n") * similar[0]) & (F.col("comp") != F.col("cy"))
    taken = materialise(probe.join(chosen.where("dear = 0").select("node", "seg"), ["node", "seg"]).select("node", "n", "comp", "key", "meets"))
    free = taken.join(index.withColumnRenamed("role", "meets"), ["key", "meets"]).where(near).select("node", "y")
    forced = signed.where("role = 4").join(chosen.where("dear = 1").select("node", "seg"), ["node", "seg"]).select("node", "n", "comp", "key")
    forced = materialise(forced.join(_bits(sets, "v"), "node"))
    whole = materialise(index.where("role = 0").drop("role").join(_bits(sets, "w").withColumnRenamed("node", "y"), "y"))
    return free.unionByName(forced.join(whole, "key").where(near & _close(similar, "n", "ny")).select("node", "y"))


def _as_int(fn):
    """Arrow columns of 32 bits where the schema says int."""
    def run(cols):
        for part in fn(cols):
            yield part | {c: part[c].astype(np.int32) for c in ("role", "seg", "need")}

    return run


def _links(df: DataFrame, text: str, base: DataFrame, width: int, similar: tuple[int, int], hub_rounds: int, direct: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Compared pairs of nodes, and labels (id, comp) from the hub rounds and all that follow them."""
    signed = base.select(F.explode("sigs").alias("sig"), "node")
    # Written, so that the join has exchanges of its own on both sides and Spark can split hot signatures.
    shared = materialise(signed.groupBy("sig").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("sig"))
    members = materialise(signed.join(shared, "sig").distinct())
    if members.isEmpty():
        return None, None
    nodes = base.where("node is not null").groupBy("node").agg(F.min("print").alias("print"))
    sets = materialise(_items(df, text, width, materialise(nodes.join(members.select("node").distinct(), "node").select("print"))))
    counts = members.groupBy("sig").agg(F.count("*").alias("c"))
    central = members.join(counts, "sig").groupBy("node").agg(F.sum("c").alias("central"))
    members = materialise(members.join(central.join(sets.select("node", "n"), "node"), "node"))
    seen = labels = None
    near = F.least("n", "n2") * similar[1] >= F.greatest("n", "n2") * similar[0]

    def compare(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        return materialise(_confirmed(materialise(pairs), sets, similar))

    for step in range(hub_rounds + 1):
        now = members.withColumn("comp", F.col("node")) if labels is None else members.join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        now = materialise(now)
        own = lambda by: F.max(F.struct(by.alias("by"), F.col("node").alias("y"), F.col("n").alias("n2"), F.col("comp").alias("comp2")))
        per = now.groupBy("sig", "comp").agg(F.count("*").alias("c"), own(F.col("central") if step == 0 else F.xxhash64("node", F.lit(step))).alias("hub"))
        per = per.groupBy("sig").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("inside"), F.count("*").alias("comps"), F.max("hub").alias("hub"))
        open_ = materialise(per.where("comps > 1").withColumn("cost", F.expr("(c * c - inside) div 2")))
        if step < hub_rounds:
            met = now.join(open_.select("sig", "hub.y", "hub.n2", "hub.comp2"), "sig")
            fresh = compare(met.where((F.col("node") != F.col("y")) & (F.col("comp") != F.col("comp2")) & near).select(F.col("node").alias("x"), "y"))
        else:
            cheap = materialise(open_.where(F.col("cost") <= direct * F.col("c")).select("sig"))
            part = materialise(now.select("sig", "node", "n", "comp").join(cheap, "sig").join(_bits(sets, "v"), "node"))
            other = part.select("sig", F.col("node").alias("y"), F.col("n").alias("n2"), F.col("comp").alias("comp2"), *[F.col(f"v{i}").alias(f"w{i}") for i in range(PARITY_WORDS)])
            apart = (F.col("node") > F.col("y")) & (F.col("comp") != F.col("comp2")) & near & _close(similar, "n", "n2")
            pairs = part.join(other, "sig").where(apart).select(F.col("node").alias("x"), "y")
            costly = materialise(open_.where(F.col("cost") > direct * F.col("c")).select("sig", "cost"))
            if not costly.isEmpty():
                pairs = pairs.unionByName(_costly_pairs(now, costly, sets, similar).select(F.col("node").alias("x"), "y"))
            fresh = compare(pairs)
        seen = fresh if seen is None else seen.unionByName(fresh)
        if not fresh.where("linked").isEmpty():
            labels = connected(seen.where("linked").select("a", "b"))
    return seen, labels


def components(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, similar: tuple[int, int] = SIMILAR, hub_rounds: int = HUB_ROUNDS, direct: int = DIRECT) -> DataFrame:
    """One row per row of `df`: key, n_shingles, component_id (smallest key reachable over links).

    Texts without words link with nothing: their component is their own key. Every row is a document of its own, also
    one that repeats a key with another text, and links by its own text; equal texts share a component, whose
    id is the smallest key that is not null (null if there is none). An empty table gives an empty one.
    """
    base = materialise(_sets(df, key, text, width, similar))
    _, labels = _links(df, text, base, width, similar, hub_rounds, direct)
    kind = base.schema["id"].dataType.simpleString()
    smallest = base.where("node is not null").groupBy("node").agg(F.min("id").alias("least"))
    if labels is not None:
        smallest = smallest.join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        whole = smallest.groupBy("comp").agg(F.min("least").alias("least"))
        smallest = materialise(smallest.select("node", "comp")).join(materialise(whole), "comp").select("node", "least")
    out = base.select("id", "n", "node").join(smallest, "node", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("least")).cast(kind).alias("component_id"))


def pairs(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, similar: tuple[int, int] = SIMILAR, direct: int = DIRECT) -> tuple[DataFrame, DataFrame]:
    """The whole join: all links (node_a, node_b, shared, united) between different sets, and the membership (key, node);
    rows of equal sets share a node. As large as the links are many."""
    base = materialise(_sets(df, key, text, width, similar))
    seen, _ = _links(df, text, base, width, similar, 0, direct)
    links = df.sparkSession.createDataFrame([], "a long, b long, shared long, united long, linked boolean") if seen is None else seen.where("linked")
    return links.select(F.col("a").alias("node_a"), F.col("b").alias("node_b"), "shared", "united"), base.select(F.col("id").alias(key), "node")
