"""Secret scan: patterns plus structural confirmation of encoded keys and signed tokens.

Pattern spans are always reported. Base64 and hex runs, PEM blocks and dotted tokens are only candidates:
each is decoded, and reported if the bytes parse as a key encoding (nested DER lengths that add up, or an
SSH key's length-prefixed fields) or as a signed token whose header names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

from pyspark.sql import DataFrame

from savora.llm.common import map_batches

# Kinds in the order in which equal starts are listed, and the patterns of the base kinds.
KINDS = ["assign", "access", "hex", "pem_key", "der_key", "ssh_key", "signed_token"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# Candidates of the structural kinds.
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*(?:KEY|CERTIFICATE)[A-Z ]*)-----((?:[A-Za-z0-9+/=\s]|\\+[nrt/]){16,})-----END \1-----")
ESCAPED = re.compile(r"\\+[nrt]|\\+(?=/)|\s")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
BREAK = r"(?:\r?\n|(?:\\+r)?\\+n)[\x20\t]*"
WRAPPED = re.compile(rf"[A-Za-z0-9+/_-]{{40,}}={{0,2}}(?:{BREAK}[A-Za-z0-9+/_-]+={{0,2}})+")
BREAKS = re.compile(BREAK)
LONG_HEX = re.compile(r"[0-9A-Fa-f]{48,}")
HEX_STARTS = re.compile(r"(?=(30)|6f70656e737368|000000[0-9a-f]{2}(?:7373682d|65636473612d|736b2d))", re.IGNORECASE)
TOKEN = re.compile(r"[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{16,}")
SSH_MAGIC = b"openssh-key-v1\0"
DER_TAGS = {0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x0C, 0x13, 0x17, 0x18, 0x30, 0x31, *range(0x80, 0xA4)}


def _der_items(data: bytes, depth: int = 0) -> list[int] | None:
    """Tags of the items in `data` if the lengths add up exactly, at every level; else None."""
    tags, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or data[at] not in DER_TAGS:
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            wide = n & 0x7F
            if not 1 <= wide <= 4 or at + wide > len(data):
                return None
            n, at = int.from_bytes(data[at : at + wide], "big"), at + wide
        if at + n > len(data):
            return None
        if tag & 0x20 and depth < 12 and _der_items(data[at : at + n], depth + 1) is None:
            return None
        tags.append(tag)
        at += n
    return tags


def _der_size(data: bytes) -> tuple[int, int]:
    """(start of the content, whole size) that the head of a SEQUENCE states; zeros if it is none."""
    if len(data) < 6 or data[0] != 0x30:
        return 0, 0
    n, at = data[1], 2
    if n & 0x80:
        wide = n & 0x7F
        if not 1 <= wide <= 4:
            return 0, 0
        n, at = int.from_bytes(data[2 : 2 + wide], "big"), 2 + wide
    return at, at + n


def der_key(data: bytes) -> bool:
    """A SEQUENCE that fills the data and holds what keys hold: integers, an octet or bit string, or an algorithm."""
    at, size = _der_size(data)
    if len(data) < 16 or size != len(data):
        return False
    tags = _der_items(data[at:])
    if not tags:
        return False
    return tags.count(0x02) >= 2 or (tags[0] == 0x02 and (0x04 in tags or 0x30 in tags)) or tags[:2] == [0x30, 0x03] or tags[:3] == [0x30, 0x30, 0x03]


def ssh_key(data: bytes) -> bool:
    """Length-prefixed fields from the start to the end: the private container, or a public `ssh-…` blob."""
    private = data.startswith(SSH_MAGIC)
    at, fields = (len(SSH_MAGIC) if private else 0), []
    for _ in range(3 if private else 16):
        if at + 4 > len(data):
            break
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    if private:
        return len(fields) == 3 and at + 4 <= len(data) and 0 < int.from_bytes(data[at : at + 4], "big") <= 16
    return len(fields) >= 2 and at == len(data) and fields[0].startswith((b"ssh-", b"ecdsa-", b"sk-"))


def signed_token(text: str) -> bool:
    """Header and body are JSON objects in base64url, and the header names an algorithm."""
    try:
        head, body, _ = [base64.urlsafe_b64decode(p + "=" * (-len(p) % 4)) for p in text.split(".")]
        head, body = json.loads(head), json.loads(body)
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str)


def _decoded(run: str) -> bytes:
    plain = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _key_kind(data: bytes) -> str | None:
    return "der_key" if der_key(data) else "ssh_key" if ssh_key(data) else None


def _wrapped_keys(text: str, begin: int, end: int) -> list[tuple[str, int, int]]:
    """Keys over several lines of a wrapped base64 run: the head of a DER key says where it ends; SSH keys
    end with the last line of equal width or the shorter one after it."""
    lines, at = [], begin
    for m in BREAKS.finditer(text, begin, end):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, end))
    size = [b - a for a, b in lines]
    out, i = [], 0
    while i + 1 < len(lines):
        first = text[lines[i][0] : lines[i][1]]
        stops = []
        if first.startswith("M") and size[i] >= 16:
            need, j = -(-_der_size(_decoded(first[:16]))[1] * 4 // 3), i
            while j < len(lines) and need > 0:
                need -= len(text[lines[j][0] : lines[j][1]].rstrip("="))
                j += 1
            stops = [j] if need == 0 and j > i + 1 else []
        elif first.startswith(("AAAA", "b3BlbnNzaC1rZXktdjE")):
            j = i + 1
            while j < len(lines) and size[j] == size[i]:
                j += 1
            stops = [k for k in (j + 1, j) if i + 1 < k <= len(lines) and (k == j or size[j] < size[i])]
        for j in stops:
            if kind := _key_kind(_decoded("".join(text[a:b] for a, b in lines[i:j]))):
                out.append((kind, lines[i][0], lines[j - 1][1]))
                i = j - 1
                break
        i += 1
    return out


def _hex_keys(run: str, begin: int) -> list[tuple[str, int, int]]:
    """Keys in a run of hex digits, from any digit on: DER keys as long as their head says, SSH keys to the run's end."""
    out, at = [], 0
    for m in HEX_STARTS.finditer(run):
        a = m.start()
        if a < at:
            continue
        b = len(run) - (len(run) - a) % 2
        if m[1]:
            b = a + 2 * _der_size(bytes.fromhex(run[a : min(b, a + 12)]))[1]
        if 48 <= b - a <= len(run) - a and (kind := _key_kind(bytes.fromhex(run[a:b]))):
            out.append((kind, begin + a, begin + b))
            at = b
    return out


def find_spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(pattern spans, confirmed spans) of a text as (kind, start, end) in code points, sorted by start
    and then by kind. Null and empty texts have none."""
    if not text:
        return [], []
    base, more = [], []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        base += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [("hex", *m.span()) for m in HEX.finditer(text)]
    taken = []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            data = _decoded(ESCAPED.sub("", m[2]))
            if "ENCRYPTED" in m[1] and _der_items(data) or _key_kind(data) or "CERTIFICATE" in m[1] and _der_items(data):
                more.append(("pem_key", *m.span()))
                taken.append(m.span())
    inside = lambda m: any(a <= m.start() < b for a, b in taken)
    for m in WRAPPED.finditer(text):
        if not inside(m):
            found = _wrapped_keys(text, *m.span())
            more += found
            taken += [f[1:] for f in found]
    for m in BASE64.finditer(text):
        # The letter of an escaped line end is no part of the run after it.
        cut = m.start() > 0 and text[m.start() - 1] == "\\" and m[0][0] in "nrt"
        for skip in (0, 1) if cut else (0,):
            if not inside(m) and (kind := _key_kind(_decoded(m[0][skip:]))):
                more.append((kind, m.start() + skip, m.end()))
                break
    for m in LONG_HEX.finditer(text):
        if not inside(m):
            more += _hex_keys(m[0], m.start())
    if "." in text and "eyJ" in text:
        more += [("signed_token", *m.span()) for m in TOKEN.finditer(text) if signed_token(m[0])]
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return sorted(base, key=order), sorted(more, key=order)


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `df`: key, spans (array of kind, start, end), counts of the base kinds and
    the digest of the pattern spans. A null text counts as empty; a null key stays null; repeated rows repeat."""

    def fn(cols):
        out = {c: [] for c in ("key", "n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for k, t in zip(*cols):
            base, more = find_spans(t)
            kinds = [s[0] for s in base]
            every = sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
            for c, v in zip(out, (k, *map(kinds.count, KINDS[:3]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every))):
                out[c].append(v)
        return out

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df, [key, text], fn, f"key {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("key", key)


def redact_text(text: str | None) -> str | None:
    """The text with every reported span replaced by `[SECRET]`; overlapping spans become one."""
    if not text:
        return text
    base, more = find_spans(text)
    out, at = [], 0
    for _, a, b in sorted(base + more, key=lambda s: s[1:]):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def redact(df: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """`df` with secrets replaced in `text` and, if named, the length column brought up to date. Other
    columns, nulls and repeated rows stay as they are."""
    schema = df.schema
    names = df.columns
    at, n_at = names.index(text), names.index(length) if length else None

    def fn(cols):
        before = cols[at]
        cols[at] = [redact_text(t) for t in before]
        if n_at is not None:
            cols[n_at] = [n if a is b or a == b else len(b) for n, a, b in zip(cols[n_at], before, cols[at])]
        return dict(zip(names, cols))

    return map_batches(df, names, fn, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema))
