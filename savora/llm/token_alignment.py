"""Alignment of two tokenizations of the same texts by a fragment monoid.

A byte range of a text yields a fragment: the tokens up to its first common token end (open prefix), the groups
between common ends (closed), and the tokens after the last one (open suffix). Joining two fragments closes the
group of the left suffix and the right prefix, and is associative, so ranges of a very long text are worked on by
different tasks and their fragments composed by a tree of shuffles, `FAN_IN` at a time.

* Units. Between two characters that are not white space, neither tokenizer joins a token across a single space or line end:
  the pre-tokenizer of A ends there and no piece of B holds a space or line end behind another character (checked when the files
  are loaded; otherwise a text is one unit). Tokens of a unit do not depend on its neighbours, so each task keeps
  the aligned units that it has met. A range that cuts a unit keeps the tokens that end in it.
* Blocks. How many documents hold a pair of linked ids is counted over blocks: a block sends its distinct pairs
  once, with the number of its documents that hold them, and gets the counts of the whole corpus back by a join.
  Nothing is broadcast, and the links of a document stay packed in its block.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from savora.llm.common import map_batches
from savora.session import materialise

RANGE = 1 << 15  # bytes; longer texts are cut into ranges
BLOCK = 4 << 20  # characters
KEPT_UNITS = 250_000
OFTEN = 4  # units met so often outlive a full table
FAN_IN = 8
ODD = re.compile(r"\s\s|\s\Z")
SAFE = re.compile(r"(?<=\S)(?=[ \n]\S)")
SPACE = "▁"
CLOSING = ".,;:!?"


def _byte_chars() -> dict[str, int]:
    """The characters that byte-level vocabularies show bytes as: visible Latin-1 ones as they are, others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}


def units_of(full: str) -> list[str]:
    """Keys of the units of a text that starts with its added space: a key without a leading space or line end has lost
    a space in front."""
    if not ODD.search(full):
        return full.replace("\n", " \n").split(" ")[1:]
    return [u[1:] if u[0] == " " and u[1:2] not in ("", " ", "\n") else u for u in SAFE.split(full)]


def unit_text(key: str) -> str:
    return key if key[:1] in (" ", "\n") else " " + key


def two_pointers(a: list[int], b: list[int], a_size: list[int], b_size: list[int]) -> tuple[list[tuple[list[int], list[int]]], list[int]]:
    """Groups between common ends, and all pairs of tokens whose bytes overlap, as a << 32 | b. Both spell the same bytes."""
    groups, links = [], []
    if not a:
        return groups, links
    a_end, b_end = list(accumulate(a_size)), list(accumulate(b_size))
    i = j = at_i = at_j = 0
    x, y, last = a_end[0], b_end[0], a_end[-1]
    while True:
        links.append(a[i] << 32 | b[j])
        if x < y:
            i += 1
            x = a_end[i]
        elif y < x:
            j += 1
            y = b_end[j]
        else:
            i, j = i + 1, j + 1
            groups.append((a[at_i:i], b[at_j:j]))
            if x == last:
                return groups, links
            at_i, at_j, x, y = i, j, a_end[i], b_end[j]


def spelled(groups: list[tuple[list[int], list[int]]]) -> bytes:
    return ";".join([f"{a[0] if len(a) == 1 else ','.join(map(str, a))}|{b[0] if len(b) == 1 else ','.join(map(str, b))}" for a, b in groups]).encode()


class Aligner(dict):
    """Units by key, numbered, with what their closed groups hold in flat arrays."""

    def __init__(self, a_path: str, b_path: str):
        super().__init__()
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        said = json.loads(self.a.to_str())
        pre = said.get("pre_tokenizer") or {}
        chars = _byte_chars()
        self.shown = {b: c for c, b in chars.items()}
        self.a_bytes = {}
        for token, i in self.a.get_vocab().items():
            # A byte-level vocabulary; added tokens are their own text.
            self.a_bytes[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_size = [len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)]
        self.b_size = [len(x) for x in self.b_bytes]
        self.mark = self.b.piece_to_id(SPACE)
        self.cuts = pre.get("type") == "ByteLevel" and bool(pre.get("use_regex", True)) and not pre.get("add_prefix_space") and said.get("normalizer") is None
        self.spells = self.cuts and all(c in self.a.get_vocab() for c in chars)  # then A spells every text
        # Marks that no piece of B joins to a letter before them: with one token each, known at once.
        single = {c: (self.a.token_to_id(c), self.b.piece_to_id(c)) for c in CLOSING}
        self.closing = {c: x for c, x in single.items() if self.spells and x[0] is not None and x[1] != self.b.unk_id() and not any(p[i] == c and p[i - 1].isalpha() for p in pieces for i in range(1, len(p)))}
        self.cuts = self.cuts and not any("\n" in p or SPACE in p.lstrip(SPACE) for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.waiting: list[str] = []
        self.pairs: dict[int, int] = {}
        self.text: list[bytes] = []
        self.counts = np.zeros((6, 0), np.int64)  # rows: good, A tokens, B tokens, groups, links, times met
        self.start = np.zeros(1, np.int64)
        self.links = np.zeros(0, np.int64)

    def shrink(self) -> None:
        """Forget all but the units that are met often, if the table is full."""
        if len(self) <= KEPT_UNITS:
            return
        keep = np.flatnonzero(self.counts[5][: len(self)] >= OFTEN)
        if len(keep) > KEPT_UNITS // 2 or len(self.pairs) > 8 * KEPT_UNITS:
            self.forget()
            return
        keys, pairs, text = list(self.keys()), self.pairs, [self.text[i] for i in keep.tolist()]
        counts, links = self.counts[:, keep], self.gathered(keep)
        self.forget()
        self.update((keys[i], n) for n, i in enumerate(keep.tolist()))
        counts[5] = 0
        self.pairs, self.text, self.counts, self.links = pairs, text, counts, links
        self.start = np.r_[0, np.cumsum(counts[4])]

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.waiting.append(key)
        return number

    def split(self, full: str) -> list[str]:
        return units_of(full) if self.cuts else [full]

    def encode(self, keys: list[str]) -> list[tuple[list[int], list[int], bool]]:
        """Ids of A and of B for every unit, and whether both spell it."""
        texts = [unit_text(k) for k in keys]
        # Letters behind a space are one pre-token and go straight to the merges, written as the vocabulary shows their bytes.
        letters = [self.spells and k.isalpha() for k in keys]
        others = iter(self.a.encode_batch_fast([t for t, l in zip(texts, letters) if not l], add_special_tokens=False))
        merges, shown = self.a.model.tokenize, self.shown
        of_a = [[t.id for t in merges(("Ġ" + k) if k.isascii() else "Ġ" + k.encode().decode("latin-1").translate(shown))] if l else next(others).ids for k, l in zip(keys, letters)]
        of_b = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        out = []
        for text, a, b in zip(texts, of_a, of_b):
            good = True
            if text[0] != " ":  # the mark that B adds in front is not in the text
                good, b = b[:1] == [self.mark], b[1:]
            raw = text.encode()
            good = good and b"".join(map(self.b_bytes.__getitem__, b)) == raw and (self.spells or b"".join(map(self.a_bytes.__getitem__, a)) == raw)
            out.append((a, b, good))
        return out

    def sizes(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
        return list(map(self.a_size.__getitem__, a)), list(map(self.b_size.__getitem__, b))

    def settle(self) -> None:
        """Align the units that are new. A word before a closing mark is a unit of its own with the mark's tokens behind it."""
        base = len(self.text)
        plain, marked = [], []
        for key in self.waiting:  # grows by the words of marked units
            stem = key[:-1]
            if key[-1:] in self.closing and stem[-1:].isalpha():
                marked.append((self[key], self[stem], self.closing[key[-1]]))
            else:
                plain.append(key)
        fresh: list = [None] * (len(self) - base)
        for at in range(0, len(plain), 4096):
            keys = plain[at : at + 4096]
            for key, (a, b, good) in zip(keys, self.encode(keys)):
                fresh[self[key] - base] = self.unit(a, b) if good else (0, len(a), len(b), 0, [], b"")
        for number, stem, (a, b) in marked:
            if stem < base:
                good, n_a, n_b, n = self.counts[:4, stem].tolist()
                links, said = self.links[self.start[stem] : self.start[stem + 1]].tolist(), self.text[stem]
            else:
                good, n_a, n_b, n, links, said = fresh[stem - base]
            link = self.pairs.setdefault(a << 32 | b, len(self.pairs))
            fresh[number - base] = (good, n_a + 1, n_b + 1, n + 1, [*links, link], b"%b;%d|%d" % (said, a, b)) if good else (0, n_a + 1, n_b + 1, 0, [], b"")
        many = [len(f[4]) for f in fresh]
        new = np.array([(*f[:4], m, 0) for f, m in zip(fresh, many)], np.int64).reshape(-1, 6).T
        self.counts = np.concatenate([self.counts, new], axis=1)
        self.links = np.concatenate([self.links, np.fromiter(chain.from_iterable(f[4] for f in fresh), np.int64, sum(many))])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(many, dtype=np.int64)])
        self.text += [f[5] for f in fresh]
        self.waiting = []

    def unit(self, a: list[int], b: list[int]) -> tuple:
        """Good, tokens of A and B, groups, numbers of the linked pairs, groups as text."""
        groups, links = two_pointers(a, b, *self.sizes(a, b))
        pairs = self.pairs
        return 1, len(a), len(b), len(groups), [pairs.setdefault(x, len(pairs)) for x in links], spelled(groups)

    def gathered(self, units: np.ndarray) -> np.ndarray:
        """Numbers of the linked pairs of all units, in order."""
        many = self.counts[4][units]
        upto = np.cumsum(many)
        return self.links[np.repeat(self.start[units] - upto + many, many) + np.arange(int(upto[-1]) if len(upto) else 0)]


@lru_cache(1)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _zipped(values: np.ndarray) -> bytes:
    """32-bit numbers, compressed byte by byte of their width."""
    planes = np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unzipped(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


DOC = "struct<key: {0}, n_a: long, n_b: long, n_groups: long, n_links: long, sha: string>"
ALIGNED = "block long, docs array<{0}>, pairs binary, held binary, many binary, place binary, count binary, row long, k int, last boolean, base long, lo long, hi long, text string"


def _new_id() -> int:
    return uuid.uuid4().int >> 65


def _block_row(docs: list[tuple], doc: np.ndarray, pair: np.ndarray, count: np.ndarray, names: np.ndarray) -> dict:
    """A packed block. (doc, pair) are sorted and distinct, `names` the ids behind the pair numbers."""
    distinct, place = np.unique(pair, return_inverse=True)
    many = np.bincount(doc, minlength=len(docs))
    step = np.diff(place, prepend=0)
    begin = np.cumsum(many) - many
    step[begin[many > 0]] = place[begin[many > 0]]
    return {
        "block": _new_id(), "docs": [dict(zip(("key", "n_a", "n_b", "n_groups", "n_links", "sha"), d)) for d in docs], "pairs": names[distinct].astype(np.int64).tobytes(),
        "held": _zipped(np.bincount(place, minlength=len(distinct))), "many": _zipped(many), "place": _zipped(step), "count": _zipped(count),
    }


def ranges(full: str, cuts: bool, size: int) -> list[tuple[int, int, int, str]]:
    """(base, lo, hi, text): byte ranges of about `size` with the units that they touch. Units over `size` are not cut."""
    points = np.frombuffer(full.encode("utf-32-le"), np.uint32)
    width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    upto = np.r_[0, np.cumsum(width)]
    starts = np.array([0, *([m.start() for m in SAFE.finditer(full)] if cuts else [])])
    begin, end = upto[starts], np.r_[upto[starts[1:]], upto[-1]]
    marks = [0]
    for at in range(size, int(upto[-1]), size):
        u = int(np.searchsorted(begin, at, "right")) - 1
        mark = int(end[u]) if end[u] - begin[u] > size else at
        if marks[-1] < mark < upto[-1]:
            marks.append(mark)
    out = []
    for lo, hi in zip(marks, [*marks[1:], int(upto[-1])]):
        first = int(np.searchsorted(begin, lo, "right")) - 1
        after = int(np.searchsorted(begin, hi, "left"))
        out.append((int(begin[first]), lo, hi, full[starts[first] : starts[after] if after < len(starts) else len(full)]))
    return out


def _aligned(df: DataFrame, key: str, text: str, paths: tuple[str, str], size: int, block: int) -> DataFrame:
    """Packed blocks of the texts of one range, and the ranges of longer ones."""
    kind = df.schema[key].dataType.simpleString()
    schema = ALIGNED.format(DOC.format(kind))
    names = [f.name for f in StructType.fromDDL(schema)]
    blank = dict.fromkeys(names)

    def fn(cols):
        al = _aligner(*paths)

        def finish(keys, found):
            al.settle()
            docs, used = [], []
            if any(len(u) for u in found):
                units = np.concatenate(found).astype(np.int64)
                lens = np.array([len(u) for u in found])
                of = np.repeat(np.arange(len(found)), lens)
                al.counts[5] += np.bincount(units, minlength=al.counts.shape[1])
                good = np.bincount(of, al.counts[0][units] == 0, minlength=len(found)) == 0
                sums = [np.bincount(of, al.counts[i][units], minlength=len(found)).astype(np.int64) for i in range(1, 5)]
                kept = good[of]
                units, of = units[kept], of[kept]
                owner = np.repeat(of, al.counts[4][units])
                both, count = np.unique(owner << 32 | al.gathered(units), return_counts=True)
                used = (both >> 32, both & 0xFFFFFFFF, count)
            else:
                good, sums, used = np.zeros(len(found), bool), [np.zeros(len(found), np.int64)] * 4, (np.zeros(0, np.int64),) * 3
            for i, (k, u) in enumerate(zip(keys, found)):
                if len(u) and good[i]:
                    said = b";".join(map(al.text.__getitem__, u.tolist()))
                    docs.append((k, *(int(s[i]) for s in sums), hashlib.sha256(said).hexdigest()))
                else:
                    docs.append((k, 0, 0, 0, 0, ""))
            ids = np.fromiter(al.pairs, np.int64, len(al.pairs))
            row = _block_row(docs, *used, ids)
            al.shrink()
            return {n: [v] for n, v in (blank | row).items()}

        keys, found, held = [], [], 0
        for k, t in zip(*cols):
            full = " " + (t or "")
            if t and len(full) > size // 4 and len(full.encode()) > size:
                row, cut = _new_id(), ranges(full, al.cuts, size)
                made = [blank | {"docs": [dict.fromkeys(("key", "n_a", "n_b", "n_groups", "n_links", "sha")) | {"key": k}], "row": row, "k": i, "last": i + 1 == len(cut), "base": b, "lo": lo, "hi": hi, "text": s} for i, (b, lo, hi, s) in enumerate(cut)]
                yield {n: [m[n] for m in made] for n in names}
                continue
            units = al.split(full) if t else []
            keys.append(k)
            found.append(np.fromiter(map(al.__getitem__, units), np.int64, len(units)))
            held += len(full)
            if held > block:
                yield finish(keys, found)
                keys, found, held = [], [], 0
        if keys:
            yield finish(keys, found)

    return map_batches(df.select(F.col(key).alias("key"), F.col(text).alias("text")), ["key", "text"], fn, schema)


class Fragment:
    """Open prefix, closed groups and open suffix of a byte range. Without a common end all tokens are the prefix."""

    def __init__(self, good=True, cut=False, head=((), ()), tail=((), ()), n=(0, 0, 0, 0), text=b"", pairs=None):
        self.good, self.cut, self.head, self.tail, self.n, self.text = good, cut, (list(head[0]), list(head[1])), (list(tail[0]), list(tail[1])), list(n), text
        self.pairs: dict[int, int] = pairs or {}

    def close(self, al: Aligner, a: list[int], b: list[int]) -> "Fragment":
        """The fragment followed by one group of these tokens; a text that is not spelled has no groups."""
        if self.good and (a or b):
            groups, links = two_pointers(a, b, *al.sizes(a, b))
            said = spelled(groups)
            self.text = self.text + b";" + said if self.text else said
            self.n = [x + y for x, y in zip(self.n, (len(a), len(b), len(groups), len(links)))]
            for x in links:
                self.pairs[x] = self.pairs.get(x, 0) + 1
        return self


def closed(good: bool, n: tuple[int, ...], text: bytes, pairs: dict[int, int]) -> Fragment:
    """Whole groups that begin and end at common ends."""
    return Fragment(good, True, n=n, text=text, pairs=pairs)


def of_tokens(a: list[int], a_ends: list[int], b: list[int], b_ends: list[int], al: Aligner) -> Fragment:
    """Fragment of the tokens that end in a range, by the byte at which each ends."""
    common = sorted(set(a_ends) & set(b_ends))
    if not common:
        return Fragment(head=(a, b))
    ia, ib = a_ends.index(common[0]) + 1, b_ends.index(common[0]) + 1
    ja, jb = a_ends.index(common[-1]) + 1, b_ends.index(common[-1]) + 1
    out = Fragment(cut=True, head=(a[:ia], b[:ib]), tail=(a[ja:], b[jb:]))
    return out.close(al, a[ia:ja], b[ib:jb])


def join(al: Aligner, f: Fragment, g: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges. Associative."""
    if not f.cut:
        head = (f.head[0] + g.head[0], f.head[1] + g.head[1])
        return Fragment(f.good and g.good, g.cut, head, g.tail, g.n, g.text, dict(g.pairs))
    if not g.cut:
        return Fragment(f.good and g.good, True, f.head, (f.tail[0] + g.head[0], f.tail[1] + g.head[1]), f.n, f.text, dict(f.pairs))
    out = Fragment(f.good and g.good, True, f.head, g.tail, f.n, f.text, dict(f.pairs))
    out.close(al, f.tail[0] + g.head[0], f.tail[1] + g.head[1])
    out.text = b";".join(x for x in (out.text, g.text) if x)
    out.n = [x + y for x, y in zip(out.n, g.n)]
    for p, c in g.pairs.items():
        out.pairs[p] = out.pairs.get(p, 0) + c
    return out


def range_fragment(al: Aligner, base: int, lo: int, hi: int, text: str) -> Fragment:
    """Fragment of the tokens that end in (lo, hi], from the units that the range touches."""
    keys = al.split(text) if al.cuts else [text]
    size = np.array([len(unit_text(k).encode()) for k in keys])
    end = base + np.cumsum(size)
    inside = np.flatnonzero((end - size >= lo) & (end <= hi))
    out = None
    before, after = (int(inside[0]), int(inside[-1]) + 1) if len(inside) else (len(keys), len(keys))

    def partial(part: range) -> None:
        nonlocal out
        for i, (a, b, good) in zip(part, al.encode([keys[i] for i in part])):
            at = int(end[i] - size[i])
            ends = [at + np.cumsum(s).astype(np.int64) for s in al.sizes(a, b)]
            take = [(e > lo) & (e <= hi) for e in ends]
            one = of_tokens([t for t, y in zip(a, take[0]) if y], ends[0][take[0]].tolist(), [t for t, y in zip(b, take[1]) if y], ends[1][take[1]].tolist(), al) if good else Fragment(False)
            out = one if out is None else join(al, out, one)

    if before:
        partial(range(before))
    if len(inside):
        units = np.fromiter((al[keys[i]] for i in inside), np.int64, len(inside))
        al.settle()
        numbers, count = np.unique(al.gathered(units), return_counts=True)
        names = np.fromiter(al.pairs, np.int64, len(al.pairs))
        whole = closed(bool(al.counts[0][units].all()), al.counts[1:, units].sum(axis=1).tolist(), b";".join(al.text[u] for u in units.tolist()), dict(zip(names[numbers].tolist(), count.tolist())))
        out = whole if out is None else join(al, out, whole)
    if after < len(keys):
        partial(range(after, len(keys)))
    return out


FRAGMENT = "row long, k int, key {0}, good boolean, cut boolean, head_a array<int>, head_b array<int>, tail_a array<int>, tail_b array<int>, n array<long>, said binary, pairs binary, counts binary"


def _as_row(row: int, k: int, key, f: Fragment) -> dict:
    pairs = np.fromiter(f.pairs, np.int64, len(f.pairs))
    counts = np.fromiter(f.pairs.values(), np.int64, len(f.pairs))
    return {"row": row, "k": k, "key": key, "good": f.good, "cut": f.cut, "head_a": f.head[0], "head_b": f.head[1], "tail_a": f.tail[0], "tail_b": f.tail[1], "n": f.n, "said": f.text, "pairs": pairs.tobytes(), "counts": counts.tobytes()}


def _of_row(r: dict) -> Fragment:
    pairs = dict(zip(np.frombuffer(r["pairs"], np.int64).tolist(), np.frombuffer(r["counts"], np.int64).tolist()))
    return Fragment(r["good"], r["cut"], (r["head_a"], r["head_b"]), (r["tail_a"], r["tail_b"]), r["n"], r["said"], pairs)


def _long_texts(parts: DataFrame, kind: str, paths: tuple[str, str]) -> DataFrame:
    """Blocks, one a text, of the texts that were cut into ranges."""
    schema = FRAGMENT.format(kind)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def first(cols):
        al = _aligner(*paths)
        for docs, row, k, base, lo, hi, text in zip(*cols):
            made = _as_row(row, k, docs[0]["key"], range_fragment(al, base, lo, hi, text))
            al.shrink()
            yield {n: [v] for n, v in made.items()}

    spread = parts.select("docs", "row", "k", "base", "lo", "hi", "text").repartition("row", "k")
    level = materialise(map_batches(spread, ["docs", "row", "k", "base", "lo", "hi", "text"], first, schema))

    def compose(group):
        al = _aligner(*paths)
        rows = sorted(group.to_pylist(), key=lambda r: r["k"])
        out = _of_row(rows[0])
        for r in rows[1:]:
            out = join(al, out, _of_row(r))
        return pa.Table.from_pylist([_as_row(rows[0]["row"], rows[0]["k"] // FAN_IN, rows[0]["key"], out)], schema=arrow)

    while (level.agg(F.max("k")).first()[0] or 0) > 0:
        level = materialise(level.groupBy("row", F.floor(F.col("k") / FAN_IN).alias("__up")).applyInArrow(compose, schema))

    out_schema = ALIGNED.format(DOC.format(kind)).split(", row long")[0]
    names = [f.name for f in StructType.fromDDL(out_schema)]
    fields = level.columns

    def finish(cols):
        al = _aligner(*paths)
        for values in zip(*cols):
            r = dict(zip(fields, values))
            f = join(al, closed(True, (0, 0, 0, 0), b"", {}), _of_row(r))
            if f.good and not f.tail[0] and not f.tail[1]:
                doc = (r["key"], *f.n, hashlib.sha256(f.text).hexdigest())
                pairs, count = np.array(sorted(f.pairs), np.int64), np.array([f.pairs[p] for p in sorted(f.pairs)], np.int64)
            else:
                doc, pairs, count = (r["key"], 0, 0, 0, 0, ""), np.zeros(0, np.int64), np.zeros(0, np.int64)
            row = _block_row([doc], np.zeros(len(pairs), np.int64), np.arange(len(pairs)), count, pairs)
            yield {n: [row[n]] for n in names}

    return map_batches(level, fields, finish, out_schema)


def align(df: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", size: int = RANGE, block: int = BLOCK) -> DataFrame:
    """One row per row of `df`: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A reads a space and the text, B the text, to which it adds the space. Null and empty texts, and texts that one of the
    tokenizers does not spell byte by byte, have no tokens: zeros and an empty string. Every row is a document, also one
    that equals another or repeats its key; an empty table gives an empty one.
    """
    kind = df.schema[key].dataType.simpleString()
    paths = (a_path, b_path)
    made = materialise(_aligned(df, key, text, paths, size, block))
    packed = ["block", "docs", "pairs", "held", "many", "place", "count"]
    blocks = made.where("row is null").select(*packed)
    parts = made.where("row is not null")
    if not parts.isEmpty():
        blocks = blocks.unionByName(materialise(_long_texts(parts, kind, paths)))

    def spread(cols):
        for b, pairs, held in zip(*cols):
            pairs = np.frombuffer(pairs, np.int64)
            yield {"block": np.full(len(pairs), b), "at": np.arange(len(pairs), dtype=np.int32), "pair": pairs, "held": _unzipped(held)}

    named = materialise(map_batches(blocks, ["block", "pairs", "held"], spread, "block long, at int, pair long, held long"))
    totals = materialise(named.groupBy("pair").agg(F.sum("held").alias("total")))
    top = totals.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("total").alias("top"))
    ranked = totals.withColumn("a", F.shiftright("pair", 32)).join(top, "a").select("pair", "total", (F.col("total") == F.col("top")).alias("best"))
    answers = named.select("block", "at", "pair").join(materialise(ranked), "pair").select("block", "at", "total", "best")
    schema = f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def read(known: pa.Table, rows: pa.Table) -> pa.Table:
        total, best = np.zeros(len(known) + 1, np.int64), np.zeros(len(known) + 1, np.int64)
        at = known["at"].to_numpy()
        total[at], best[at] = known["total"].to_numpy(), known["best"].to_numpy(zero_copy_only=False)
        out = []
        for r in rows.to_pylist():
            many, count = _unzipped(r["many"]), _unzipped(r["count"])
            of = np.repeat(np.arange(len(many)), many)
            # Places are steps within each document.
            run = np.cumsum(_unzipped(r["place"]))
            begin = np.cumsum(many) - many
            earlier = np.where(begin > 0, run[np.maximum(begin - 1, 0)] if len(run) else 0, 0)
            place = run - np.repeat(earlier, many)
            n_best = _summed(of, count * best[place], len(many))
            sums = _summed(of, count * total[place], len(many))
            for d, x, y in zip(r["docs"], n_best.tolist(), sums.tolist()):
                out.append({"key": d["key"], "n_a": d["n_a"], "n_b": d["n_b"], "n_groups": d["n_groups"], "n_links": d["n_links"], "n_best": x, "count_sum": y, "groups_sha256": d["sha"]})
        return pa.Table.from_pylist(out, schema=arrow)

    packed_rows = blocks.select("block", "docs", "many", "place", "count")
    return answers.groupBy("block").cogroup(packed_rows.groupBy("block")).applyInArrow(read, schema).withColumnRenamed("key", key)


def _summed(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by owner; owners are sorted."""
    upto = np.r_[0, np.cumsum(values)]
    return upto[np.searchsorted(of, np.arange(n), "right")] - upto[np.searchsorted(of, np.arange(n), "left")]
