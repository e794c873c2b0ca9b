"""Phrase collocations by multikey three-way quicksort of suffix pointers.

A suffix pointer is a word position; its key is the words from there to the end of the piece, four at most.

* Blocks. Tasks number the words of up to 60 000 distinct ones per block and language and pack the keys of a
  block, with equal keys combined into one with a weight: four numbers of 16 bits, sorted and compressed.
* Routing. Keys go to a route by a hash of their two leading words, so that all keys of a phrase meet. A pair with
  more than a quarter of a route's keys is routed by three leading words instead, a triple by all four; the
  counts of such a prefix are the sum of what the blocks say. The list of those holds at most 8 prefixes a route.
* Sorting. A route sorts its keys by multikey three-way quicksort, all open segments at once: each is split by a
  pivot word into smaller, equal and larger; the equal part goes on with the next word, and its weight is the
  count of that prefix. Segments whose weight is below the least count are abandoned, at any depth.
* Scores, nesting and the lists are joins of the frequent phrases, which are few next to the positions.

Words are told apart by 64-bit hashes; a frequent word that shares its hash with another raises.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from savora.llm.common import map_batches
from savora.session import materialise, release

DEPTH = 4
LEAST = 30
TOP = 2000
SCALE = 2_000_000
NESTED = (80, 100)
BLOCK_WORDS = 60_000  # distinct words of a block; numbers have 16 bits
BLOCK_TOKENS = 2_000_000
ROUTE_KEYS = 2_000_000
LOCAL_PREFIX = 4  # a block names the prefixes of at least so many of its keys
END = b"\xff"  # never a byte of UTF-8
# Pieces end at . , ; : ! ? and at line ends; tab and space part words.
TO_TOKENS = bytes(0xFF if chr(i) in ".,;:!?\n\x0b\x0c\r" else i for i in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (b + MIX + (a << np.uint64(6)) + (a >> np.uint64(2)))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased words in order, with `END` where a piece ends."""
    return (text or b"").lower().translate(TO_TOKENS).replace(END, b" \xff ").split()


def _packed(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


class _Block(dict):
    """Numbers of the words of one language by first use, from 1; 0 ends a piece."""

    def __init__(self):
        super().__init__({END: 0})
        self.parts, self.ahead, self.size = [], [], 0

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number

    def add(self, words: list[bytes], leads: int) -> None:
        """Words of which the first `leads` start keys; the others only end them."""
        ids = np.zeros(len(words) + DEPTH - 1, np.uint16)
        ids[: len(words)] = np.fromiter(map(self.__getitem__, words), np.uint16, len(words))
        self.ahead.append((self.size + leads, self.size + len(words)))
        self.parts.append(ids)
        self.size += len(ids)

    def sort_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of every word, and the sorted distinct keys of two or more words with their weights."""
        ids = np.concatenate([*self.parts, np.zeros(DEPTH, np.uint16)])
        n = self.size
        leads = ids[:n] != 0
        for a, b in self.ahead:
            if a < b:
                leads[a:b] = False
        counts = np.bincount(ids[:n][leads], minlength=len(self))
        at = np.flatnonzero(leads & (ids[1 : n + 1] != 0))
        key = ids[at].astype(np.uint64)
        open_ = np.ones(len(at), bool)
        for d in range(1, DEPTH):
            word = ids[at + d]
            open_ &= word != 0
            key = key << np.uint64(16) | np.where(open_, word, 0).astype(np.uint64)
        distinct, weights = np.unique(key, return_counts=True)
        return counts, distinct, weights


def _word(key: np.ndarray, place: int) -> np.ndarray:
    return (key >> np.uint64(16 * (DEPTH - 1 - place)) & np.uint64(0xFFFF)).astype(np.int64)


def _runs(prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of equal neighbours."""
    starts = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]]) if len(prefix) else np.empty(0, np.int64)
    return starts, np.diff(np.r_[starts, len(prefix)])


BLOCK = "kind int, lang string, word string, hash long, n long, words binary, keys binary, weights binary"


def blocks(df: DataFrame, text: str = "text", lang: str = "lang", seed: int = 0) -> DataFrame:
    """Rows of three kinds: 0 the packed keys of a block, 1 a word with its count, 2 a prefix with its number of keys."""
    names = [c.split(" ")[0] for c in BLOCK.split(", ")]

    def finish(lang: str, block: _Block):
        counts, key, weights = block.sort_keys()
        salt = xxhash.xxh3_64_intdigest(lang.encode(), seed)
        words = list(block)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, salt) for w in words), np.uint64, len(words))
        used = np.flatnonzero(counts)
        m = len(used)
        yield dict(zip(names, ([1] * m, [lang] * m, [words[i].decode() for i in used], hashes[used].view(np.int64), counts[used], [None] * m, [None] * m, [None] * m)))
        if not len(key):
            return
        pair = _mix(hashes[_word(key, 0)], hashes[_word(key, 1)])
        for depth, name in ((2, pair), (3, _mix(pair, hashes[_word(key, 2)]))):
            starts, sizes = _runs(key >> np.uint64(16 * (DEPTH - depth)))
            often = (sizes >= LOCAL_PREFIX) & (_word(key[starts], depth - 1) != 0)
            m = int(often.sum())
            yield dict(zip(names, ([2] * m, [lang] * m, [None] * m, name[starts[often]].view(np.int64), sizes[often], [None] * m, [None] * m, [None] * m)))
        yield dict(zip(names, ([0], [lang], [None], [None], [len(key)], [hashes.tobytes()], [_packed(key)], [_packed(weights.astype(np.uint32))])))

    def fn(cols):
        open_: dict[str, _Block] = {}
        for l, t in zip(*cols):
            words = tokens(t)
            l = "und" if l is None else l
            for at in range(0, len(words), BLOCK_WORDS):
                part = words[at : at + BLOCK_WORDS + DEPTH - 1]
                block = open_.get(l)
                if block is None or block.size and (len(block) + len(part) > 65_000 or block.size + len(part) > BLOCK_TOKENS):
                    # The words of a text are mostly known already, so look before starting anew.
                    if block is not None and (block.size + len(part) > BLOCK_TOKENS or len(block) + len(set(part) - block.keys()) > 65_000):
                        yield from finish(l, open_.pop(l))
                        block = None
                    if block is None:
                        block = open_[l] = _Block()
                block.add(part, min(BLOCK_WORDS, len(words) - at))
        for l, block in open_.items():
            yield from finish(l, block)

    source = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("binary").alias("text"))
    return map_batches(source, ["lang", "text"], fn, BLOCK)


def multikey_counts(keys: np.ndarray, weights: np.ndarray, least: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, a row of each, count) of the prefixes with a weight of at least `least`. `keys` has one row per
    depth, 0 ends a key. Three-way partitions of all open segments at once; light segments are abandoned."""
    rows = np.arange(len(weights))
    seg, depth = np.zeros(len(rows), np.int64), np.zeros(1, np.int64)
    found = []
    while len(rows):
        sizes = np.bincount(seg, minlength=len(depth))
        starts = np.cumsum(sizes) - sizes
        key = keys[depth[seg], rows]
        a, b, c = key[starts], key[starts + sizes // 2], key[starts + sizes - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))
        by = pivot[seg]
        part = 3 * seg + (key >= by) + (key > by)
        total = np.bincount(part, weights[rows], minlength=3 * len(depth)).astype(np.int64)
        keep = total >= least
        good = np.flatnonzero(keep[1::3] & (pivot != 0))
        size = np.bincount(part, minlength=3 * len(depth))
        keep[1::3] &= (pivot != 0) & (depth + 1 < len(keys))
        first = np.full(3 * len(depth), -1)
        first[part[::-1]] = rows[::-1]
        for d in np.unique(depth[good]):
            these = good[depth[good] == d]
            found.append((int(d) + 1, first[3 * these + 1], total[3 * these + 1]))
        size[~keep] = 0
        offset = np.cumsum(size) - size
        sorted_ = np.empty(int(size.sum()), np.int64)
        for side in range(3):
            mine = np.flatnonzero((part % 3 == side) & keep[part])
            own = size[side::3]
            before = np.cumsum(own) - own
            at = seg[mine]
            sorted_[offset[3 * at + side] + np.arange(len(mine)) - before[at]] = rows[mine]
        alive = np.flatnonzero(keep)
        rows, seg = sorted_, np.repeat(np.arange(len(alive)), size[alive])
        depth = (np.repeat(depth, 3) + np.tile([0, 1, 0], len(depth)))[alive]
    return found


ROUTED = "route int, level int, words binary, keys binary, weights binary, n long"


def _routed(packed: DataFrame, heavy: np.ndarray, routes: int) -> DataFrame:
    """Blocks cut into routes. Level 0 is routed by two words, 1 and 2 lie under heavy pairs and triples;
    10 and 11 are a block's count of a heavy pair or triple."""
    names = [c.split(" ")[0] for c in ROUTED.split(", ")]

    def is_heavy(prefix: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(heavy, prefix), max(0, len(heavy) - 1))
        return heavy[at] == prefix if len(heavy) else np.zeros(len(prefix), bool)

    def fn(cols):
        for words, keys, weights in zip(*cols):
            hashes, key, weight = np.frombuffer(words, np.uint64), _unpacked(keys, np.uint64), _unpacked(weights, np.uint32)
            part = [hashes[_word(key, d)] for d in range(DEPTH)]
            pair = _mix(part[0], part[1])
            triple = _mix(pair, part[2])
            under = is_heavy(pair)
            level = under.astype(np.int64) + (under & is_heavy(triple) & (_word(key, 2) != 0))
            out = {n: [] for n in names}
            for depth, name, mine in ((2, pair, level >= 1), (3, triple, level == 2)):
                at = np.flatnonzero(mine)
                starts, sizes = _runs(key[at] >> np.uint64(16 * (DEPTH - depth)))
                sums = np.add.reduceat(weight[at].astype(np.int64), starts) if len(at) else []
                for i, total in zip(at[starts] if len(at) else [], sums):
                    ids = np.array([part[d][i] for d in range(depth)], np.uint64)
                    for n, v in zip(names, (int(name[i] % np.uint64(routes)), 8 + depth, ids.tobytes(), None, None, int(total))):
                        out[n].append(v)
            by = np.where(level == 0, pair, np.where(level == 1, triple, _mix(triple, part[3])))
            # A key that ends where its heavy prefix does has been counted.
            live = np.flatnonzero((level == 0) | (level == 1) & (_word(key, 2) != 0) | (level == 2) & (_word(key, 3) != 0))
            to = (by[live] % np.uint64(routes)).astype(np.int64) * 3 + level[live]
            order = live[np.argsort(to, kind="stable")]
            code = np.sort(to, kind="stable")
            starts, sizes = _runs(code)
            used = np.zeros(len(hashes), bool)
            for start, size in zip(starts, sizes):
                rows = order[start : start + size]
                own = [_word(key[rows], d) for d in range(DEPTH)]
                used[:] = False
                for ids in own:
                    used[ids] = True
                used[0] = True
                number = np.cumsum(used) - 1
                packed = np.zeros(size, np.uint64)
                for ids in own:
                    packed = packed << np.uint64(16) | number[ids].astype(np.uint64)
                for n, v in zip(names, (int(code[start]) // 3, int(code[start]) % 3, hashes[used].tobytes(), _packed(packed), _packed(weight[rows]), int(size))):
                    out[n].append(v)
            yield out

    return map_batches(packed, ["words", "keys", "weights"], fn, ROUTED)


def _sorted_routes(routed: DataFrame, least: int) -> DataFrame:
    """(w, f): hashes of the words and count of every frequent phrase of two or more words."""
    import pyarrow as pa

    kind = pa.schema([("w", pa.list_(pa.int64())), ("f", pa.int64())])

    def fn(group):
        level = group["level"].to_numpy()
        phrases, counts = [], []
        partial: dict[bytes, int] = {}
        for i in np.flatnonzero(level >= 10):
            ids = group["words"][int(i)].as_py()
            partial[ids] = partial.get(ids, 0) + group["n"][int(i)].as_py()
        for ids, n in partial.items():
            if n >= least:
                phrases.append(np.frombuffer(ids, np.int64))
                counts.append(n)
        for now in range(3):
            mine = np.flatnonzero(level == now).tolist()
            if not mine:
                continue
            lists = [np.frombuffer(group["words"][i].as_py(), np.uint64) for i in mine]
            distinct, inverse = np.unique(np.concatenate([x[1:] for x in lists]), return_inverse=True)
            keys, at = [], 0
            for i, own in zip(mine, lists):
                number = np.r_[0, inverse[at : at + len(own) - 1] + 1].astype(np.int32)
                at += len(own) - 1
                key = _unpacked(group["keys"][i].as_py(), np.uint64)
                keys.append(np.stack([number[_word(key, d)] for d in range(DEPTH)]))
            keys = np.concatenate(keys, axis=1)
            weights = np.concatenate([_unpacked(group["weights"][i].as_py(), np.uint32) for i in mine])
            for length, row, total in multikey_counts(keys, weights, least):
                if length >= now + 2:
                    phrases += list(distinct.view(np.int64)[keys[:length, row].T - 1])
                    counts += total.tolist()
        return pa.Table.from_arrays([pa.array(phrases, kind.field("w").type), pa.array(counts, pa.int64())], schema=kind)

    return routed.select("route", "level", "words", "keys", "weights", "n").groupBy("route").applyInArrow(fn, "w array<long>, f long")


def frequent_phrases(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, route_keys: int = ROUTE_KEYS, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases (w, f), frequent words (lang, word, hash, f) and words per language (lang, n)."""
    table = materialise(blocks(df, text, lang, seed))
    counted = materialise(table.where("kind = 1").groupBy("lang", "word", "hash").agg(F.sum("n").alias("f")))
    sizes = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = materialise(counted.where(F.col("f") >= least))
    clash = counted.join(frequent.select("hash"), "hash", "left_semi").groupBy("hash").agg(F.count("*").alias("c")).where("c > 1")
    if not clash.isEmpty():
        raise ValueError("two words share a hash; choose another seed")
    packed = table.where("kind = 0")
    keys = packed.agg(F.sum("n")).first()[0] or 0
    routes = max(1, math.ceil(keys / route_keys))
    # At most 4 pairs and 4 triples a route exceed this.
    limit = max(least, keys // (4 * routes))
    heavy = table.where("kind = 2").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") > limit).select("hash").collect()
    marks = np.sort(np.array([r["hash"] for r in heavy], np.int64).view(np.uint64))
    phrases = materialise(_sorted_routes(_routed(packed, marks, routes), least))
    release(table)
    return phrases, frequent, sizes


def mine(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, scale: int = SCALE, nested: tuple[int, int] = NESTED, **how: int) -> DataFrame:
    """The best collocations of every language: lang, rank, phrase, a, l, r, n, score.

    A phrase has 2 to 4 words of one piece and at least `least` occurrences. It is cut where
    floor(scale * a / (l + r)) is lowest, at the first such place. It goes if a longer phrase that holds it has at least
    nested[0] / nested[1] of its occurrences. Null and empty texts hold no words, a null language is `und`,
    equal rows count each, an empty table gives none; columns other than the two named are ignored.
    """
    phrases, frequent, sizes = frequent_phrases(df, text, lang, least, **how)
    counts = phrases.unionByName(frequent.select(F.array("hash").alias("w"), "f"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.select("w", F.col("f").alias("a"), "k", F.slice("w", F.lit(1), F.col("k")).alias("first"), F.expr("slice(w, k + 1, size(w) - k)").alias("rest"))
    one = counts.select(F.col("w").alias("first"), F.col("f").alias("l"))
    two = counts.select(F.col("w").alias("rest"), F.col("f").alias("r"))
    score = F.expr(f"(cast(a as decimal(20, 0)) * {scale}L) div (cast(l as decimal(20, 0)) + r)")
    best = cuts.join(one, "first").join(two, "rest").groupBy("w", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = phrases.where(F.size("w") > 2).withColumn("len", F.explode(F.expr("sequence(2, size(w) - 1)")))
    inner = inner.withColumn("at", F.explode(F.expr("sequence(1, size(w) - len + 1)")))
    longer = inner.groupBy(F.expr("slice(w, at, len)").alias("w")).agg(F.max("f").alias("longer"))
    covered = F.coalesce(F.col("longer").cast("decimal(20, 0)") * nested[1] >= F.col("a").cast("decimal(20, 0)") * nested[0], F.lit(False))
    left = best.join(longer, "w", "left").where(~covered)
    spelled = left.select("w", "a", "cut", F.posexplode("w").alias("at", "hash")).join(frequent.select("hash", "lang", "word"), "hash")
    spelled = spelled.groupBy("w", "a", "cut").agg(F.min("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
    named = spelled.select("lang", F.array_join(F.col("words")["word"], " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = named.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
