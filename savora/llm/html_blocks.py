"""Main text of web pages from flat text blocks.

A page becomes a flat list of blocks. Each block has a few shallow features: its word count and link
density, those of its neighbours, and what encloses it. A decision tree, trained here on a small labelled
table, keeps or drops each block.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from savora.llm.common import map_batches

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
BLOCK = set("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Left out with all they hold; without an end tag they are ordinary tags around framed text.
LEFT_OUT = set("noscript template svg select button iframe object".split())
FRAME = set("nav header footer aside form menu dialog head".split()) | LEFT_OUT
BODY = set("article main".split())
HINT = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menu|nav\w*|newsletter|notice|popup|promo\w*|related|replies|respond|share|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])", re.IGNORECASE)
KEEP_HINT = re.compile(r"(?:^|[\s_-])(?:article|content|entry|main|post|story)(?:$|[\s_-])", re.IGNORECASE)
ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)

FEATURES = ["words", "density", "words_before", "density_before", "words_after", "density_after", "framed", "in_body", "heading"]
# Labelled blocks: the features in this order, then 1 for main text.
LABELLED = [
    (45, 0.0, 0, 0.0, 60, 0.0, 0, 1, 0, 1), (60, 0.0, 45, 0.0, 1, 0.0, 0, 1, 0, 1), (1, 0.0, 60, 0.0, 70, 0.0, 0, 1, 0, 1),
    (8, 0.0, 12, 0.0, 40, 0.0, 0, 1, 1, 1), (2, 0.0, 30, 0.0, 0, 0.0, 0, 1, 1, 1), (30, 0.1, 40, 0.0, 25, 0.0, 0, 1, 0, 1),
    (120, 0.02, 8, 0.0, 90, 0.05, 0, 1, 0, 1), (15, 0.2, 90, 0.0, 14, 0.1, 0, 1, 0, 1), (1, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1),
    (3, 0.3, 20, 0.0, 50, 0.0, 0, 1, 0, 1), (5, 0.0, 10, 0.0, 5, 0.0, 0, 1, 0, 1), (25, 0.4, 60, 0.0, 60, 0.0, 0, 1, 0, 1),
    (50, 0.0, 6, 0.0, 70, 0.0, 0, 0, 0, 1), (35, 0.05, 40, 0.0, 30, 0.0, 0, 0, 0, 1), (9, 0.0, 2, 1.0, 55, 0.0, 0, 0, 1, 1),
    (14, 0.0, 50, 0.0, 45, 0.0, 0, 0, 0, 1), (18, 0.1, 35, 0.0, 5, 0.0, 0, 0, 0, 1), (80, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1),
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 0), (2, 1.0, 1, 1.0, 10, 0.0, 1, 0, 0, 0),
    (8, 0.0, 1, 1.0, 9, 0.0, 1, 0, 0, 0), (11, 0.0, 60, 0.0, 0, 0.0, 1, 0, 0, 0), (40, 0.0, 1, 1.0, 8, 0.0, 1, 0, 0, 0),
    (60, 0.0, 50, 0.0, 40, 0.0, 1, 0, 0, 0), (12, 0.0, 80, 0.0, 3, 1.0, 1, 1, 0, 0), (35, 0.0, 50, 0.0, 50, 0.0, 1, 1, 0, 0),
    (3, 0.0, 4, 0.5, 30, 0.0, 1, 1, 1, 0), (6, 0.5, 9, 0.4, 2, 0.9, 1, 0, 1, 0), (20, 0.1, 15, 0.1, 15, 0.1, 1, 0, 0, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0), (2, 0.9, 3, 0.9, 1, 1.0, 0, 0, 0, 0), (12, 0.8, 14, 0.9, 8, 1.0, 0, 0, 0, 0),
    (40, 0.7, 3, 1.0, 2, 1.0, 0, 0, 0, 0), (3, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0), (2, 0.0, 3, 0.0, 0, 0.0, 0, 0, 0, 0),
    (4, 0.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0), (7, 0.5, 5, 0.6, 4, 0.8, 0, 0, 0, 0), (5, 0.9, 60, 0.0, 6, 0.9, 0, 1, 0, 0),
    (10, 0.95, 40, 0.0, 9, 0.9, 0, 1, 0, 0), (9, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0), (20, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0),
    (16, 0.0, 3, 0.9, 1, 1.0, 0, 0, 0, 0), (13, 0.1, 2, 0.8, 4, 0.9, 0, 0, 0, 0), (22, 0.0, 40, 0.0, 30, 0.0, 0, 0, 0, 1),
]


def train_tree(rows: list[tuple], depth: int = 6) -> tuple:
    """A binary tree by Gini impurity: (feature, cut, left, right), leaves are labels. Ties go to the
    earlier feature and the lower cut."""
    data = np.array(rows, dtype=float)

    def grow(part: np.ndarray, left: int):
        label = int(part[:, -1].mean() >= 0.5)
        if left == 0 or part[:, -1].min() == part[:, -1].max():
            return label
        best = None
        for f in range(part.shape[1] - 1):
            values = np.unique(part[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                side = part[:, f] <= cut
                cost = sum(len(p) * p[:, -1].mean() * (1 - p[:, -1].mean()) for p in (part[side], part[~side]))
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, cut, side)
        if best is None:
            return label
        _, f, cut, side = best
        return f, float(cut), grow(part[side], left - 1), grow(part[~side], left - 1)

    return grow(data, depth)


def classify(tree, row) -> int:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@lru_cache(1)
def default_tree() -> tuple:
    return train_tree(LABELLED)


def _left_out(tokens: list[re.Match]) -> dict[int, int]:
    """Places of the start tags whose elements are left out -> place of their end tags. A self-closing svg
    ends at once."""
    ends: dict[int, int] = {}
    starts: dict[str, list[int]] = {}
    for i, m in enumerate(tokens):
        tag = (m["tag"] or "").lower()
        if tag not in LEFT_OUT:
            continue
        if m["close"]:
            if starts.get(tag):
                ends[starts[tag].pop()] = i
        elif tag == "svg" and m["attrs"].endswith("/"):
            ends[i] = i
        else:
            starts.setdefault(tag, []).append(i)
    return ends


@lru_cache(65536)
def _marks(tag: str, attrs: str) -> int:
    """1: frame around the text, 2: body of the article, 4: heading, 8: link."""
    marks = (1 if tag in FRAME else 0) | (2 if tag in BODY else 0) | (4 if re.fullmatch("h[1-6]", tag) else 0) | (8 if tag == "a" else 0)
    if tag in BLOCK and tag not in ("body", "html", *BODY):
        for m in ATTR.finditer(attrs):
            name = m[1].strip("\"'")
            if HINT.search(name):
                marks |= 1
            elif KEEP_HINT.search(name):
                marks |= 2
    return marks


def blocks(page: str | None) -> list[dict]:
    """Flat text blocks of a page in order, white space folded, references decoded. Ends of tags that
    were never opened are ignored; tags that are never closed end with what encloses them."""
    out: list[dict] = []
    if not page:
        return out
    stack: list[tuple[str, int]] = []
    open_tags: dict[str, int] = {}
    depth = {1: 0, 2: 0, 4: 0, 8: 0}
    parts: list[tuple[str, bool]] = []

    def flush() -> None:
        if parts:
            whole = " ".join("".join(p for p, _ in parts).split())
            if whole:
                linked = sum(len(p.split()) for p, link in parts if link)
                out.append({"text": whole, "words": whole.count(" ") + 1, "linked": linked, "framed": depth[1] > 0, "in_body": depth[2] > 0, "heading": depth[4] > 0})
            parts.clear()

    def pop() -> None:
        tag, marks = stack.pop()
        open_tags[tag] -= 1
        for bit in depth:
            depth[bit] -= bool(marks & bit)

    def add(raw: str) -> None:
        if raw:
            parts.append((html.unescape(raw), depth[8] > 0))

    at = 0
    tokens = list(TOKEN.finditer(page))
    ends = _left_out(tokens)
    resume = 0
    for i, m in enumerate(tokens):
        if i < resume:
            continue
        add(page[at : m.start()])
        if i in ends:
            at = tokens[ends[i]].end()
            resume = ends[i] + 1
            continue
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append((" ", False))
        if tag in BLOCK or (tag in LEFT_OUT and not m["close"]):
            flush()
        if m["close"]:
            if open_tags.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
        elif tag not in VOID:
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                pop()
            marks = _marks(tag, m["attrs"])
            stack.append((tag, marks))
            open_tags[tag] = open_tags.get(tag, 0) + 1
            for bit in depth:
                depth[bit] += bool(marks & bit)
    add(page[at:])
    flush()
    return out


def main_text(page: str | None, tree: tuple | None = None) -> str:
    """Kept blocks joined by line feeds; empty for null, empty and pure frame pages."""
    tree = tree or default_tree()
    found = blocks(page)
    ends = [(0, 0.0)]
    size = ends + [(b["words"], min(1.0, b["linked"] / b["words"])) for b in found] + ends
    keep = []
    for i, b in enumerate(found):
        row = (*size[i + 1], *size[i], *size[i + 2], b["framed"], b["in_body"], b["heading"])
        if classify(tree, row):
            keep.append(b["text"])
    return "\n".join(keep)


def extract(pages: DataFrame, key: str = "page_id", page: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """Key, the carried columns, text and n_chars of every row; null pages give an empty text."""
    kinds = [f"{'key' if c == key else f'c{i}'} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate([key, *carry])]
    names = [k.split(" ")[0] for k in kinds]

    def fn(cols):
        texts = [main_text(p) for p in cols[-1]]
        return dict(zip(names, cols)) | {"text": texts, "n_chars": [len(t) for t in texts]}

    out = map_batches(pages, [key, *carry, page], fn, ", ".join(kinds) + ", text string, n_chars long")
    for name, column in zip(names, [key, *carry]):
        out = out.withColumnRenamed(name, column)
    return out
