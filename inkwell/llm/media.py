"""Media columns: signature sniffing, structural validation, type correction and carving.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over a value. A hit is
only believed if the format's validator confirms its structure there; validators return the length
they confirmed, which bounds the carved span.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.scratch import small_batches

UNIT = 192
RATE = 8000


def _png(b: bytes, at: int) -> int:
    p, seen = at + 8, False
    while p + 12 <= len(b):
        (n,), kind = struct.unpack_from(">I", b, p), b[p + 4 : p + 8]
        if p + 12 + n > len(b) or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0] or (not seen and kind != b"IHDR"):
            return 0
        seen, p = True, p + 12 + n
        if kind == b"IEND":
            return p - at
    return 0


def _gif(b: bytes, at: int) -> int:
    if at + 13 > len(b):
        return 0
    p = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += b[p] + 1
        return p + 1

    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 <= len(b):
            p = blocks(p + 11 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0))
        else:
            return 0
    return 0


def _jpeg(b: bytes, at: int) -> int:
    p, scan = at + 2, False
    while p + 4 <= len(b) and b[p] == 0xFF:
        if b[p + 1] == 0xD9:
            return p + 2 - at if scan else 0
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2:
            return 0
        scan, started = scan or b[p + 1] == 0xDA, b[p + 1] == 0xDA
        p += 2 + n
        while started and p + 1 < len(b) and not (b[p] == 0xFF and b[p + 1] not in (0, *range(0xD0, 0xD8))):
            p += 1
    return p + 2 - at if scan and b[p : p + 2] == b"\xff\xd9" else 0


def riff_chunks(b: bytes, at: int) -> dict[bytes, tuple[int, int]] | None:
    """Chunk name to (start, length) of a RIFF form whose lengths agree, else None."""
    if at + 12 > len(b):
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    p, out = at + 12, {}
    if end > len(b):
        return None
    while p + 8 <= end:
        n = struct.unpack_from("<I", b, p + 4)[0]
        if p + 8 + n > end:
            return None
        out.setdefault(b[p : p + 4], (p + 8, n))
        p += 8 + n + (n & 1)
    return out if p >= end else None


def _riff(kind: bytes, needs: tuple[bytes, ...]) -> Callable[[bytes, int], int]:
    def check(b: bytes, at: int) -> int:
        if b[at + 8 : at + 12] != kind:
            return 0
        chunks = riff_chunks(b, at)
        return 8 + struct.unpack_from("<I", b, at + 4)[0] if chunks is not None and all(n in chunks for n in needs) else 0

    return check


def _bmp(b: bytes, at: int) -> int:
    if at + 26 > len(b):
        return 0
    size, zero, start, header = struct.unpack_from("<IIII", b, at + 2)
    return size if zero == 0 and header in (12, 40, 52, 56, 108, 124) and 14 + header <= start <= size <= len(b) - at else 0


def _pdf(b: bytes, at: int) -> int:
    after = b.find(b"%PDF-", at + 5)  # each saved revision ends with a mark of its own: the last one counts
    end = b.rfind(b"%%EOF", at, after if after >= 0 else len(b))
    return end + 5 - at if end >= 0 and b.find(b"startxref", at, end) >= 0 else 0


def _zip(b: bytes, at: int) -> int:
    """An archive from a local header on: its entries up to one of unknown size, and the next end record.

    The walk from one entry passes all later ones, so the end of each entry is kept while a value is read.
    """
    p, passed = at, []
    while p not in _ends and b[p : p + 4] == b"PK\x03\x04" and p + 30 <= len(b):
        flags, packed, name, extra = struct.unpack_from("<H", b, p + 6)[0], *struct.unpack_from("<I", b, p + 18), *struct.unpack_from("<HH", b, p + 26)
        if flags & 8:
            break
        passed.append(p)
        p += 30 + name + extra + packed
    if p in _ends:
        stop = _ends[p]
    else:
        end = _next(b, b"PK\x05\x06", p)
        stop = end + 22 + struct.unpack_from("<H", b, end + 20)[0] if 0 <= end <= len(b) - 22 else -1
    _ends.update((q, stop) for q in (*passed, p))
    return stop - at if at < stop <= len(b) else 0


_ends: dict[int, int] = {}
_places: dict[bytes, list[int]] = {}


def _next(b: bytes, what: bytes, at: int) -> int:
    """``b.find(what, at)``, by one search of the value."""
    if what not in _places:
        _places[what] = [m.start() for m in re.finditer(re.escape(what), b)]
    i = bisect_left(_places[what], at)
    return _places[what][i] if i < len(_places[what]) else -1


def _gzip(b: bytes, at: int) -> int:
    d, p = zlib.decompressobj(31), at
    try:
        while not d.eof:
            part = d.unconsumed_tail
            if not part:
                part = b[p : p + (1 << 16)]
                p += len(part)
            if not part:
                return 0
            d.decompress(part, 1 << 20)
    except zlib.error:
        return 0
    return p - at - len(d.unused_data)


#: Magic bytes, type, validator.
FORMATS: tuple[tuple[bytes, str, Callable[[bytes, int], int]], ...] = (
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"RIFF", "audio/wav", _riff(b"WAVE", (b"fmt ", b"data"))),
    (b"RIFF", "image/webp", _riff(b"WEBP", ())),
    (b"RIFF", "video/avi", _riff(b"AVI ", ())),
    (b"BM", "image/bmp", _bmp),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
)


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    out, at = ahocorasick.Automaton(), {}
    for i, (magic, _, _) in enumerate(FORMATS):
        at.setdefault(magic, []).append(i)
    for magic, which in at.items():
        out.add_word(magic.decode("latin-1"), (len(magic), which))
    out.make_automaton()
    return out


def sniff(value: bytes | None) -> list[tuple[int, int, str]]:
    """(start, length, type) of every validated medium in a value; one inside another is listed too."""
    found = []
    _ends.clear()
    _places.clear()
    for end, (n, which) in _automaton().iter((value or b"").decode("latin-1")):
        for i in which:
            if length := FORMATS[i][2](value, end - n + 1):
                found.append((end - n + 1, length, FORMATS[i][1]))
                break
    return found


def correct_type(value: bytes | None, declared: str | None) -> tuple[str, list[tuple[int, int, str]]]:
    """The type of the medium at the start, or the declared one, and the other media to carve."""
    found = sniff(value)
    whole = next((f for f in found if f[0] == 0), None)
    return whole[2] if whole else declared or "application/octet-stream", [f for f in found if f is not whole]


def inspect_media(rows: DataFrame, id_col: str, media_col: str, declared_col: str | None = None) -> DataFrame:
    """``(<id_col>, media_type, corrected, carved)`` of every row of a binary column.

    ``media_type`` is the validated type of the value's first bytes, else the declared type, else
    ``application/octet-stream``; ``corrected`` says that it differs from the declared one; ``carved`` is an
    array of (start, length, media_type, bytes) of media found elsewhere in the value. Null or empty
    values have no medium. Repeated rows stay; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, declared = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            kinds = [correct_type(v, d) for v, d in zip(values, declared)]
            carved = [[{"start": a, "length": n, "media_type": k, "bytes": v[a : a + n]} for a, n, k in more] for v, (_, more) in zip(values, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k for k, _ in kinds], pa.string()), pa.array([k != d for (k, _), d in zip(kinds, declared)], pa.bool_()), pa.array(carved, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("media_type", pa.string()), ("bytes", pa.binary())])))], names=["id", "media_type", "corrected", "carved"])

    small_batches(rows.sparkSession)
    kind = rows.schema[id_col].dataType.simpleString()
    declared = F.col(declared_col).cast("string") if declared_col else F.lit(None).cast("string")
    out = rows.select(F.col(id_col), F.col(media_col).cast("binary"), declared).mapInArrow(run, f"id {kind}, media_type string, corrected boolean, carved array<struct<start:long,length:long,media_type:string,bytes:binary>>")
    return out.withColumnRenamed("id", id_col)


def wave(payload: bytes, rate: int = RATE) -> bytes:
    """Payload as 8-bit mono PCM samples in a WAV file."""
    pad = b"\0" * (len(payload) & 1)
    size = 36 + len(payload) + len(pad)
    return b"RIFF" + struct.pack("<I", size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + pad


def read_wave(stored: bytes) -> bytes:
    """The samples of a validated WAV file."""
    chunks = riff_chunks(stored, 0)
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE" or chunks is None or b"data" not in chunks:
        raise ValueError("not a WAV file")
    start, n = chunks[b"data"]
    return stored[start : start + n]


def pad_payload(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length, and the bytes padded with spaces to a positive multiple of ``UNIT``."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT)


def _describe(media_type: str, samples: bytes, carved: list[tuple[int, int, str]]) -> str:
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    return f"{media_type};rate={RATE};samples={len(x)};sum={int((counts * np.arange(256)).sum())};min={int(x.min())};max={int(x.max())};entropy={-(p * np.log2(p)).sum():.4f};carved=" + "+".join(f"{k}@{a}:{n}" for a, n, k in carved)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, n_bytes, payload_bytes, media, declared)``: each text as the samples of a WAV file.

    Null text counts as empty; every row has a medium, equal texts the same one. A text of any length is one medium;
    repeated rows and null ids stay, other columns are ignored, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                padded = [pad_payload(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in padded], pa.int64()), pa.array([len(p) for _, p in padded], pa.int64()), pa.array([wave(p) for _, p in padded], pa.binary())], names=["id", "n_bytes", "payload_bytes", "media"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, media binary")
    return out.withColumnRenamed("id", id_col)


def media_features(stored: DataFrame, id_col: str = "doc_id", declared: str = "application/octet-stream") -> DataFrame:
    """Reads the stored bytes back: ``(<id_col>, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, media_type)``.

    The stored form's type is sniffed and its structure validated before the samples are read; a
    value that fails, null included, has null payload columns. Repeated rows and null ids stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type")}
            for value in batch.column(3).to_pylist():
                media_type, carved = correct_type(value, declared)
                samples = read_wave(value) if media_type == "audio/wav" else None
                out["payload_sha256"].append(samples and hashlib.sha256(samples).hexdigest())
                out["tail_crc32"].append(samples and zlib.crc32(samples[-16:]))
                out["media_bytes"].append(len(value or b""))
                out["media_sha256"].append(hashlib.sha256(value or b"").hexdigest())
                out["feature"].append(_describe(media_type, samples, carved) if samples else media_type)
                out["media_type"].append(media_type)
            types = {"payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "media_type": pa.string()}
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(v, types[k]) for k, v in out.items())], names=["id", "n_bytes", "payload_bytes", *out])

    small_batches(stored.sparkSession)
    kind = stored.schema[id_col].dataType.simpleString()
    out = stored.select(id_col, "n_bytes", "payload_bytes", "media").mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string")
    return out.withColumnRenamed("id", id_col)
