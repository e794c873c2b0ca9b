"""WARC archives: a deduplicating writer through Spark's text sink and a salvage reader.

Spark writes the archives itself (one record per line, with the record's closing blank lines as line
separator), so they can go to any store that Spark reaches. The reader checks every record; after a
failed check it searches for the next valid gzip member or version line, goes on there, and logs the
bytes in between as a quarantined gap. Of a damaged or cut member, the records decoded before the damage are
kept (after a decoding error only those with a matching block digest; digests do not cover record headers).
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from savora.llm.common import map_batches
from savora.session import materialise

END = "\r\n\r\n"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"
RECORDS_PER_FILE = 1000
STEP = 1 << 14
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PREFIX = "urn:page:"


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def duplicates(pages: DataFrame, key: str, payload: Column, least: int = 0) -> DataFrame:
    """Digest -> smallest key, for payloads of at least `least` bytes that occur more than once. Counts
    are combined before the shuffle, so a payload that fills a third of the table is no hot key."""
    digest = F.sha2(payload, 256)
    return (
        pages.where(F.octet_length(payload) >= least).groupBy(digest.alias("__digest"))
        .agg(F.min(key).alias("__first"), F.count("*").alias("__n")).where((F.col("__n") > 1) & F.col("__first").isNotNull()).drop("__n")
    )


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record per row. Of equal payloads the smallest key is the response and the others are
    revisits of it; rows that share that key are all responses, and so are rows without a key when no row of
    the payload has one. Null payloads are empty, null addresses are left out."""
    payload = F.coalesce(F.col(html), F.lit(""))
    firsts = materialise(duplicates(pages, key, payload, least))
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), payload.alias("p"), F.sha2(payload, 256).alias("__digest"))
    # Most payloads occur once: those rows find no partner, so the row's own key keeps the join even.
    rows = rows.join(firsts, "__digest", "left")
    first = F.when(F.col("__first").isNotNull() & ~F.col("k").eqNullSafe(F.col("__first")), F.col("__first"))

    def fn(cols):
        out = []
        for k, u, p, to in zip(*cols):
            raw = p.encode()
            block = HTTP.encode() + (raw if to is None else b"")
            head = ["WARC/1.1", f"WARC-Type: {'response' if to is None else 'revisit'}", f"WARC-Record-ID: <{PREFIX}{'' if k is None else k}>", f"WARC-Date: {date}"]
            if u is not None:
                head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", u))
            if to is not None:
                head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{PREFIX}{to}>"]
            head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{_digest(raw)}", f"WARC-Block-Digest: sha1:{_digest(block)}", f"Content-Length: {len(block)}"]
            out.append("\r\n".join(head) + END + HTTP + (p if to is None else ""))
        return {"value": out}

    kind = pages.schema[key].dataType.simpleString()
    values = map_batches(rows.select("k", "u", "p", first.cast(kind).alias("to")), ["k", "u", "p", "to"], fn, "value string")
    values.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _record(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """(record, end, why not) at a version line."""
    if not VERSION.match(data, at):
        return None, at, "no version line"
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return None, at, "header without end"
    fields = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None, at, "malformed header"
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None, at, "no length"
    end = stop + 4 + int(length)
    if end > len(data):
        return None, at, "block cut short"
    if end < len(data) and not data.startswith(b"\r\n\r\n", end):
        return None, at, "no record end"
    block = data[stop + 4 : end]
    want = fields.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != _digest(block):
        return None, at, "block digest differs"
    cut = block.find(b"\r\n\r\n")
    payload = block[cut + 4 :] if fields.get("content-type", "").startswith("application/http") and cut >= 0 else block
    want = fields.get("warc-payload-digest", "")
    if fields.get("warc-type") == "response" and want.startswith("sha1:") and want[5:] != _digest(payload):
        return None, at, "payload digest differs"
    return {"fields": fields, "payload": payload, "at": at, "end": min(len(data), end + 4)}, min(len(data), end + 4), ""


def _plain(data: bytes, base: int, records: list, gaps: list) -> None:
    at = 0
    while at < len(data):
        record, end, why = _record(data, at)
        if record:
            records.append(record | {"at": base + at, "end": base + end})
            at = end
            continue
        found = VERSION.search(data, at + 1)
        to = found.start() if found else len(data)
        gaps.append((base + at, base + to, why))
        at = to


def _member(data: bytes, at: int) -> tuple[bytes, int, str, list[tuple[int, int]]]:
    """(decoded bytes, end, why not, steps as (offset, decoded bytes so far)) of the gzip member at `at`; what
    a broken member yields before its error is decoded too."""
    if not data.startswith(MEMBER, at):
        return b"", at, "no member", [(at, 0)]
    unzip, out, pos, made = zlib.decompressobj(31), [], at, 0
    steps = [(at, 0)]
    while pos < len(data) and not unzip.eof:
        piece, before = data[pos : pos + STEP], unzip.copy()
        try:
            out.append(unzip.decompress(piece))
        except zlib.error:
            for i in range(len(piece)):
                try:
                    out.append(before.decompress(piece[i : i + 1]))
                except zlib.error:
                    break
            return b"".join(out), pos, "member damaged", steps
        pos += len(piece)
        made += len(out[-1])
        steps.append((pos, made))
    return b"".join(out), pos - len(unzip.unused_data), "" if unzip.eof else "member cut short", steps


def salvage(data: bytes | None) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """(records, quarantined gaps as (start, end, reason)) of an archive, plain or in gzip members.
    Offsets are of the archive; inside a member that holds several records they count from its start.
    Null and empty archives have neither."""
    records: list[dict] = []
    gaps: list[tuple[int, int, str]] = []
    data = data or b""
    if not data.startswith(MEMBER) and not (MEMBER in data and not VERSION.search(data)):
        _plain(data, 0, records, gaps)
        return records, gaps
    at = 0
    while at < len(data):
        body, end, why, steps = _member(data, at)
        found: list[dict] = []
        holes: list[tuple[int, int, str]] = []
        _plain(body, at, found, holes)
        if not why:
            records += found
            gaps += holes
            at = end
            continue
        if why == "member damaged":
            holes += [(r["at"], r["end"], "no digest in a damaged member") for r in found if "warc-block-digest" not in r["fields"]]
            found = [r for r in found if "warc-block-digest" in r["fields"]]
        to = data.find(MEMBER, at + 1)
        to = len(data) if to < 0 else to
        if found:
            records += found
            whole = found[-1]["end"] - at
            gaps += sorted(h for h in holes if h[1] - at <= whole)
            gaps.append((min(to, max(pos for pos, made in steps if made <= whole)), to, why))
        elif gaps and gaps[-1][1] == at:
            gaps[-1] = (gaps[-1][0], to, gaps[-1][2])
        else:
            gaps.append((at, to, why))
        at = to
    return records, gaps


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records and gaps of the archives under `path`: kind ('record' or 'gap'), file, start, end,
    record_id, record_type, refers_to, url, payload_bytes, payload_digest, payload (null for revisits and gaps), reason."""
    names = "kind file start end record_id record_type refers_to url payload_bytes payload_digest payload reason".split()

    def fn(cols):
        for file, data in zip(*cols):
            out = {n: [] for n in names}
            records, gaps = salvage(data)
            for r in records:
                f = r["fields"]
                own = f.get("warc-type") != "revisit"
                ids = [f[n][1:-1].removeprefix(PREFIX) or None if n in f else None for n in ("warc-record-id", "warc-refers-to")]
                digest = _digest(r["payload"]) if own else f.get("warc-payload-digest", "").removeprefix("sha1:")
                row = ("record", file, r["at"], r["end"], ids[0], f.get("warc-type"), ids[1], f.get("warc-target-uri"), len(r["payload"]) if own else None, digest, r["payload"] if own else None, None)
                for n, v in zip(names, row):
                    out[n].append(v)
            for a, b, why in gaps:
                for n, v in zip(names, ("gap", file, a, b, None, None, None, None, None, None, None, why)):
                    out[n].append(v)
            yield out

    files = spark.read.format("binaryFile").load(path)
    return map_batches(files, ["path", "content"], fn, "kind string, file string, start long, end long, record_id string, record_type string, refers_to string, url string, payload_bytes long, payload_digest string, payload binary, reason string")


def resolved(records: DataFrame, key_type: str = "long") -> DataFrame:
    """One row per record with the full payload's size, looked up for revisits at their response."""
    own = records.where("kind = 'record'").select(
        F.col("record_id").cast(key_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(key_type).alias("refers_to")
    )
    held = materialise(own)
    sizes = held.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("__size"))
    again = held.where("record_type = 'revisit'").join(sizes, "payload_digest", "left")
    cols = ["page_id", "payload_digest", "record_type", "refers_to"]
    return held.where("record_type <> 'revisit'").select(*cols, "payload_bytes").unionByName(again.select(*cols, F.col("__size").alias("payload_bytes")))
