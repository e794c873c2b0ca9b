"""MPEG audio columns: write byte payloads into valid frames and index audio streams frame by frame.

`encode` makes a variable-bitrate MPEG-1 Layer III mono stream with a tag in front and a seek-table frame.
Every audio frame has a checksum and declares no main data, so players hear silence, and the payload
travels in the ancillary bytes. `parse` reads any stream: it skips tags, resynchronises on damaged bytes
(a sync word counts only if another header, or the end, follows at the computed length), reads the
variable-bitrate table, verifies frame checksums, and gives exact durations and seek offsets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

from pyspark.sql import DataFrame

from savora.llm.common import map_batches

# Fixed values of the format: kbit/s by (version is 1, layer) and index; sample rates by version bits and index.
BITRATES = {
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
CRC_POLY = 0x8005
UNIT = 64
RATE = 32000
SIDE = 17
BODY_AT = 4 + 2 + SIDE
OWNER = b"savora.payload\0"


@lru_cache(4096)
def crc16(data: bytes) -> int:
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ CRC_POLY) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


@lru_cache(4096)
def header(word: bytes) -> dict | None:
    """Fields of a 4-byte frame header, or None. Free-format frames have no computable length: None."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate_at, kbps_at = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3), word[2] >> 2 & 3, word[2] >> 4
    if version == 1 or layer == 4 or rate_at == 3 or kbps_at in (0, 15):
        return None
    first = version == 3
    kbps, rate, pad = BITRATES[first, layer][kbps_at], RATES[version][rate_at], word[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    size = (12000 * kbps // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // rate + pad
    mono = word[3] >> 6 == 3
    side = (17 if mono else 32) if first else (9 if mono else 17)
    return {"version": version, "layer": layer, "kbps": kbps, "rate": rate, "size": size, "samples": samples, "mono": mono, "crc": not word[1] & 1, "side": side}


def _word(kbps: int, protect: bool = True) -> bytes:
    return bytes([0xFF, 0xFA if protect else 0xFB, BITRATES[True, 3].index(kbps) << 4 | 2 << 2, 0xC0])


@lru_cache(1)
def _forms() -> list[tuple[int, int, bytes]]:
    """(payload room, frame size, head with checksum and side information) per bitrate, smallest first."""
    out = []
    for kbps in BITRATES[True, 3][1:]:
        word = _word(kbps)
        size = header(word)["size"]
        room = (size - BODY_AT) // UNIT * UNIT
        if room:
            out.append((room, size, word + struct.pack(">H", crc16(word[2:] + bytes(SIDE))) + bytes(SIDE)))
    return out


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the unit."""
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def encode(payload: bytes) -> bytes:
    """The stream that carries `payload` (a positive multiple of the unit)."""
    forms = _forms()
    room = forms[-1][0]
    parts, offsets, at = [], [], header(_word(32, False))["size"]
    first = at
    for i in range(0, len(payload), room):
        chunk = payload[i : i + room]
        _, size, head = next(f for f in forms if f[0] >= len(chunk))
        parts += [head, chunk, bytes(size - len(head) - len(chunk))]
        offsets.append(at)
        at += size
    toc = bytes(min(255, offsets[len(offsets) * k // 100] * 256 // at) for k in range(100))
    info = _word(32, False) + bytes(SIDE) + b"Xing" + struct.pack(">III", 0x0F, len(offsets), at) + toc + struct.pack(">I", 100)
    private = OWNER + struct.pack(">QI", len(payload), zlib.crc32(payload))
    frame = b"PRIV" + _safe(len(private)) + b"\0\0" + private
    return b"".join([b"ID3\x04\0\0", _safe(len(frame)), frame, info, bytes(first - len(info)), *parts])


def _safe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _unsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def tags(data: bytes) -> tuple[dict[str, bytes], int, int]:
    """(tag frames, start of audio, end of audio). A tag that claims more bytes than there are ends at the data's end."""
    found, at, end = {}, 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        version, flags, size = data[at + 3], data[at + 5], _unsafe(data[at + 6 : at + 10])
        pos, stop = at + 10, min(end, at + 10 + size)
        wide = 6 if version == 2 else 10
        while pos + wide <= stop and data[pos]:
            name = data[pos : pos + (3 if version == 2 else 4)].decode("latin-1")
            raw = data[pos + 3 : pos + 6] if version == 2 else data[pos + 4 : pos + 8]
            n = _unsafe(raw) if version == 4 else int.from_bytes(raw, "big")
            found.setdefault(name, data[pos + wide : min(stop, pos + wide + n)])
            pos += wide + n
        at = stop + (10 if flags & 0x10 else 0)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        found.setdefault("TAGV1", data[end - 125 : end])
        end -= 128
    return found, min(at, end), end


def vbr_table(frame: bytes, h: dict) -> dict | None:
    """Frame count, byte count and seek table of a Xing, Info or VBRI frame."""
    at = 4 + h["side"]
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, at = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        out = {"kind": frame[at - 8 : at - 4].decode(), "frames": None, "bytes": None, "toc": []}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], at = int.from_bytes(frame[at : at + 4], "big"), at + 4
        if flags & 4:
            out["toc"] = list(frame[at : at + 100])
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        n, scale, width = struct.unpack(">HHH", frame[54:60])
        toc = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(n)]
        return {"kind": "VBRI", "frames": int.from_bytes(frame[50:54], "big"), "bytes": int.from_bytes(frame[46:50], "big"), "toc": toc}
    return None


def parse(data: bytes | None) -> dict:
    """Index of a stream: tags, table, frames as (offset, size, kbps, first sample, checksum ok or
    None), gaps as (start, end), rate, samples, payload bytes per frame start. Null and empty data have no frames."""
    data = data or b""
    found, at, end = tags(data)
    out = {"tags": found, "table": None, "frames": [], "gaps": [], "rate": None, "samples": 0}
    synced = False
    while at < end:
        h = header(data[at : at + 4])
        good = h and at + h["size"] <= end
        if good and not synced:
            after = at + h["size"]
            nxt = header(data[after : after + 4])
            good = after == end or (nxt and (nxt["version"], nxt["layer"], nxt["rate"]) == (h["version"], h["layer"], h["rate"]))
        if not good:
            start, synced = at, False
            at = data.find(b"\xff", at + 1, end)
            at = end if at < 0 else at
            if out["gaps"] and out["gaps"][-1][1] == start:
                out["gaps"][-1] = (out["gaps"][-1][0], at)
            else:
                out["gaps"].append((start, at))
            continue
        synced = True
        if not out["frames"] and not out["table"] and (table := vbr_table(data[at : at + h["size"]], h)):
            out["table"] = table
            at += h["size"]
            continue
        ok = None
        if h["crc"] and h["layer"] == 3:
            ok = int.from_bytes(data[at + 4 : at + 6], "big") == crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h["side"]])
        out["frames"].append((at, h["size"], h["kbps"], out["samples"], ok))
        out["samples"] += h["samples"]
        out["rate"] = out["rate"] or h["rate"]
        at += h["size"]
    return out


def payload_of(data: bytes, index: dict | None = None) -> bytes | None:
    """The payload that `encode` stored, or None if frames are missing or its checksum fails."""
    index = index or parse(data)
    private = index["tags"].get("PRIV", b"")
    if not private.startswith(OWNER) or any(f[4] is False for f in index["frames"]):
        return None
    n, crc = struct.unpack(">QI", private[len(OWNER) :])
    rooms = {f[1]: f[0] for f in _forms()}
    got = b"".join(data[a + BODY_AT : a + BODY_AT + rooms.get(size, 0)] for a, size, *_ in index["frames"])[:n]
    return got if len(got) == n and zlib.crc32(got) == crc else None


def feature(index: dict) -> str:
    """Exact duration in samples, frame statistics, and a digest of the seek offsets."""
    frames = index["frames"]
    seek = hashlib.sha1(b"".join(struct.pack(">Q", f[0]) for f in frames)).hexdigest()[:16]
    bad = sum(f[4] is False for f in frames)
    return f"rate={index['rate']};samples={index['samples']};frames={len(frames)};bits={sum(f[1] for f in frames) * 8};bad={bad};gaps={len(index['gaps'])};table={(index['table'] or {}).get('frames')};seek={seek}"


def index_streams(df: DataFrame, key: str, data: str) -> DataFrame:
    """One row per row: key, duration in seconds, frames, checksum failures, gaps and seek offsets (byte
    offset of each frame; its first sample is its place times the samples per frame)."""

    def fn(cols):
        out = {c: [] for c in ("key", "seconds", "n_frames", "n_bad", "gaps", "offsets")}
        for k, d in zip(*cols):
            x = parse(d)
            for c, v in zip(out, (k, x["samples"] / x["rate"] if x["rate"] else 0.0, len(x["frames"]), sum(f[4] is False for f in x["frames"]), [list(g) for g in x["gaps"]], [f[0] for f in x["frames"]])):
                out[c].append(v)
        return out

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df, [key, data], fn, f"key {kind}, seconds double, n_frames long, n_bad long, gaps array<array<long>>, offsets array<long>").withColumnRenamed("key", key)


def store_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Media column: key, n_bytes (unpadded) and the stream that carries each text. Null counts as empty."""

    def fn(cols):
        raw = [(t or "").encode() for t in cols[1]]
        return {"key": cols[0], "n_bytes": [len(r) for r in raw], "media": [encode(pad(r)) for r in raw]}

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df, [key, text], fn, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", key)


def read_back(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Payload and stream digests and the feature of each stored stream; a damaged payload raises."""

    def fn(cols):
        out = {c: [] for c in ("key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for k, n, data in zip(*cols):
            index = parse(data)
            got = payload_of(data, index)
            if got is None:
                raise ValueError(f"stream {k} does not carry its payload")
            row = (k, n, len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(index))
            for c, v in zip(out, row):
                out[c].append(v)
        return out

    kind = media.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(media, [key, "n_bytes", "media"], fn, schema).withColumnRenamed("key", key)
