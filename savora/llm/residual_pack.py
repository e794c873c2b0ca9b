"""Hierarchical residual packing of token sequences.

Partitions pack their pieces by best fit, largest first, and emit nearly full bins. Underfull bins then
become items of a tree merge: `FAN_IN` partitions at a time run another best-fit round. Two bins over half
full never fit together and best fit leaves at most one bin at or under half, so a partition carries up
only `CARRY` of its underfull bins and closes the others: the root's input stays small at every size.
"""

from __future__ import annotations

import math
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from savora.llm.common import map_batches
from savora.session import materialise

CAPACITY = 4096
ROWS_PER_PART = 65_536
FAN_IN = 8
CARRY = 256
NEARLY_FULL = 0.998
CACHED_WORDS = 250_000  # per generation
LONG_WORD = 64  # longer ones are not kept, so a generation's bytes are bounded as well
CLOSING = ".,;:!?"
# Byte-level vocabularies show bytes that are no visible Latin-1 characters as the characters from 256 on.
SHOWN = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
SEPARATORS = "\x1c\x1d\x1e\x1f"


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _WordIds(dict):
    """Ids of white-space separated words as little-endian bytes. The tokenizer drops white space and
    never joins across it, so a word's ids do not depend on its neighbours. When a generation is full the
    next one starts, and takes over the words that it meets again. Closing marks after an ASCII letter or
    digit are tokens of their own, so only the word before them is kept."""

    def __init__(self, path: str):
        super().__init__()
        self.tok = _tokenizer(path)
        self.model = self.tok.model
        self.before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if word[-1] in CLOSING:
            stem = word.rstrip(CLOSING)
            if stem and stem[-1].isascii() and stem[-1].isalnum():
                return self[stem] + self[word[len(stem) :]]
        if len(word) > LONG_WORD:
            return self.encode(word)
        if len(self) >= CACHED_WORDS:
            self.before = dict(self)
            self.clear()
        ids = self.before.get(word)
        if ids is None:
            ids = self.letters(word) if word.isalpha() and max(word) <= "\xff" else self.encode(word)
        self[word] = ids
        return ids

    def letters(self, word: str) -> bytes:
        """Latin-1 letters are one pre-token, which normalising only lower-cases: straight to the merges."""
        shown = word.lower().encode().decode("latin-1").translate(SHOWN)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def encode(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def text(self, text: str) -> bytes:
        if any(c in text for c in SEPARATORS):  # white space to Python only
            return self.encode(text)
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(2)
def _word_ids(path: str) -> _WordIds:
    return _WordIds(path)


def pieces(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Pieces of at most `capacity` ids: key, piece, start, length, ids_crc32. Only longer documents are
    cut. Null and empty texts are one piece that holds the end id."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def fn(cols):
        ids_of = _word_ids(tokenizer)
        out = {c: [] for c in ("key", "piece", "start", "length", "ids_crc32")}
        for k, t in zip(*cols):
            data = memoryview(ids_of.text(t or "") + end)
            for i, at in enumerate(range(0, len(data), 4 * capacity)):
                part = data[at : at + 4 * capacity]
                for c, v in zip(out, (k, i, at // 4, len(part) // 4, zlib.crc32(part))):
                    out[c].append(v)
        return out

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df, [key, text], fn, f"key {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("key", key)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in it for every item, taken in the given order: the fullest bin that has room."""
    bins, places = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    open_bins: dict[int, list[int]] = {}
    mask, made = 0, 0  # bit r of the mask: some bin has r places left
    for i, size in enumerate(sizes.tolist()):
        above = mask >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            stack = open_bins[room]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << room)
        else:
            b, room, made = made, capacity, made + 1
        bins[i], places[i] = b, capacity - room
        left = room - size
        if left:
            open_bins.setdefault(left, []).append(b)
            mask |= 1 << left
    return bins, places


def _round(names: list[str], schema: str, capacity: int, root: bool, level: int, fan_in: int, carry: int):
    """One partition's best-fit round as a function of its Arrow table."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    full = math.ceil(capacity * NEARLY_FULL)

    def fit(group):
        group = group.combine_chunks()
        total, tie = group["total"].to_numpy(), group["tie"].to_numpy()
        if len(total) and (np.isnan(total.astype(float)).any() or total.min() < 1 or total.max() > capacity):
            raise ValueError(f"lengths must be 1 to {capacity}")
        order_ = np.lexsort((tie, -total))
        bins, places = best_fit(total[order_], capacity)
        by_bin = np.lexsort((places, bins))
        order_, bins, places = order_[by_bin], bins[by_bin], places[by_bin]
        lists = group["members"].combine_chunks()
        lists = (lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists).take(pa.array(order_))
        counts = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        at = flat.field("__at").to_numpy() + np.repeat(places, counts)
        flat = pa.StructArray.from_arrays([*[flat.field(n) for n in names], pa.array(at)], names=[*names, "__at"])
        starts = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        ends = np.r_[starts[1:], len(bins)]
        upto = np.r_[0, np.cumsum(counts)]
        members = pa.ListArray.from_arrays(pa.array(np.r_[upto[starts], upto[-1]].astype(np.int32)), flat)
        sums = np.add.reduceat(total[order_], starts)
        closed = np.ones(len(starts), bool)
        if not root:
            low = np.flatnonzero(sums < full)
            low = low[np.argsort(sums[low], kind="stable")]
            half = int((sums[low] * 2 <= capacity).sum())
            closed[low[: half + carry]] = False
        part = group["part"][0].as_py()
        number = (level << 56) + (part << 32) + np.arange(len(starts))
        cols = [np.full(len(starts), part // fan_in, np.int32), sums, tie[order_][starts], number, closed]
        return pa.Table.from_arrays([*map(pa.array, cols), members.cast(arrow.field("members").type)], schema=arrow)

    return fit


def pack(items: DataFrame, key: str = "doc_id", length: str = "length", order: tuple[str, ...] = ("piece",), capacity: int = CAPACITY, rows_per_part: int = ROWS_PER_PART, fan_in: int = FAN_IN, carry: int = CARRY) -> DataFrame:
    """Add sequence_id and offset to every row of `items` (lengths 1 to `capacity`; longer ones raise).
    Equal rows are packed one by one; a null length raises; an empty table gives an empty one."""
    names = [c for c in items.columns if c not in ("sequence_id", "offset")]
    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    member = "struct<" + ", ".join(f"`{n}`: {kinds[n]}" for n in names) + ", __at: bigint>"
    # Hash keys depend on the rows alone, so a recomputed task packs the same rows.
    items = materialise(items.select(*names))
    parts = max(1, math.ceil(items.count() / rows_per_part))
    # Pieces that fill a sequence alone need no search.
    alone = F.col(length) == capacity
    salt = F.pmod(F.xxhash64(*names), F.lit(parts)).cast("int")
    queue = items.where(~alone | F.col(length).isNull()).select(
        salt.alias("part"), F.col(length).cast("long").alias("total"), F.xxhash64(*[F.col(c) for c in (key, *order)]).alias("tie"),
        F.array(F.struct(*names, F.lit(0).cast("long").alias("__at"))).alias("members"),
    )
    schema = f"part int, total long, tie long, bin long, done boolean, members array<{member}>"
    done, level = [], 0
    while True:
        root = parts == 1
        made = materialise(queue.groupBy("part").applyInArrow(_round(names, schema, capacity, root, level, fan_in, carry), schema))
        done.append(made.where("done").select("bin", "members"))
        if root:
            break
        queue = made.where("not done").select("part", "total", "tie", "members")
        parts, level = math.ceil(parts / fan_in), level + 1
    packed = done[0]
    for more in done[1:]:
        packed = packed.unionByName(more)
    packed = packed.select("bin", F.inline("members")).select(*names, F.col("bin").alias("sequence_id"), F.col("__at").alias("offset"))
    single = items.where(alone).select(*names, (F.lit(127 << 56) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(single)
