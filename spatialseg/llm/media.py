"""Media columns: signature sniffing and carving.

An Aho-Corasick automaton locates magic bytes; a validator for each format walks
the structure from there and gives the exact length, or rejects the hit. The
type found at the start of a value corrects its declared type; valid media
further inside are carved.

Edge cases: null bytes give null type and no embedded media; bytes that match no
format get ``application/octet-stream``; hits inside carved media are not carved
again; equal bytes give equal results; repeated rows each get their row; very long
values are read whole; a kept column with the name of a result is replaced by it,
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatialseg.llm.columns import declared, fresh, without

#: The formats' magic bytes.
MAGIC = {
    b"RIFF": "audio/wav",
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"BM": "image/bmp",
    b"P5": "image/x-portable-graymap",
    b"\xff\xd8\xff": "image/jpeg",
}
PGM = re.compile(rb"P5(?:[ \t-\r]|#[^\r\n]*[\r\n])++([0-9]++)(?:[ \t-\r]|#[^\r\n]*[\r\n])++([0-9]++)(?:[ \t-\r]|#[^\r\n]*[\r\n])++([0-9]++)[ \t-\r]")
UNKNOWN = "application/octet-stream"
SAMPLE_RATE = 8000


def wav_length(b: bytes, at: int) -> int:
    """Length of a RIFF/WAVE file whose chunks tile it and which has fmt before data; 0 if it is none."""
    if len(b) < at + 44 or b[at + 8 : at + 12] != b"WAVE":
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return 0
    p, form, data = at + 12, 0, 0
    while p + 8 <= end:
        size = struct.unpack_from("<I", b, p + 4)[0]
        form = form or p * (b[p : p + 4] == b"fmt ")
        data = data or p * (b[p : p + 4] == b"data")
        p += 8 + size + (size & 1)
    return end - at if p == end and 0 < form < data else 0


def png_length(b: bytes, at: int) -> int:
    p, first = at + 8, True
    while p + 12 <= len(b):
        size = struct.unpack_from(">I", b, p)[0]
        kind, end = b[p + 4 : p + 8], p + 12 + size
        if end > len(b) or first and (kind != b"IHDR" or size != 13) or zlib.crc32(memoryview(b)[p + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return 0
        if kind == b"IEND":
            return end - at
        p, first = end, False
    return 0


def gif_length(b: bytes, at: int) -> int:
    if len(b) < at + 14:
        return 0
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    while p < len(b):
        mark = b[p]
        if mark == 0x3B:
            return p + 1 - at
        if mark == 0x21:
            p += 2
        elif mark == 0x2C and p + 10 < len(b):
            local = b[p + 9]
            p += 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0)
        else:
            return 0
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return 0


def bmp_length(b: bytes, at: int) -> int:
    if len(b) < at + 54:
        return 0
    size, r1, start, header, w, h, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    row = (abs(w) * bits + 31) // 32 * 4
    ok = r1 == 0 and header in (40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and start >= 14 + header and size == start + row * abs(h) and at + size <= len(b)
    return size if ok and size > start else 0


def pgm_length(b: bytes, at: int) -> int:
    """Blanks and comments may stand between the numbers of the header; samples above 255 take two bytes."""
    m = PGM.match(b, at)
    if not m or any(len(x.lstrip(b"0")) > 18 for x in m.groups()):
        return 0
    w, h, top = map(int, m.groups())
    end = m.end() + w * h * (1 + (top > 255))
    return end - at if w and h and 0 < top < 65536 and end <= len(b) else 0


def jpeg_length(b: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF and 0xC0 <= b[p + 1] <= 0xFE:
        if b[p + 1] == 0xDA:
            end = b.find(b"\xff\xd9", p + 2)
            return end + 2 - at if end > 0 else 0
        p += 2 + struct.unpack_from(">H", b, p + 2)[0]
    return 0


VALIDATORS = {"audio/wav": wav_length, "image/png": png_length, "image/gif": gif_length, "image/bmp": bmp_length, "image/x-portable-graymap": pgm_length, "image/jpeg": jpeg_length}
_AUTOMATON: list = []


def automaton():
    if not _AUTOMATON:
        import ahocorasick

        a = ahocorasick.Automaton()
        for magic, kind in MAGIC.items():
            a.add_word(magic.decode("latin-1"), (len(magic), kind))
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def sniff(b: bytes) -> list[tuple[str, int, int]]:
    """(type, start, length) of the outer medium, if the bytes start with one, then of the media inside it, none within another embedded one."""
    found: list[tuple[str, int, int]] = []
    free = 0
    for last, (n, kind) in automaton().iter(b.decode("latin-1")):
        at = last - n + 1
        if at and at < free:
            continue
        if size := VALIDATORS[kind](b, at):
            found.append((kind, at, size))
            free = at + size if at else 1
    return found


def pcm_of(b: bytes) -> memoryview:
    """The samples of a valid 8-bit WAV file."""
    p, view = 12, memoryview(b)
    while b[p : p + 4] != b"data":
        size = struct.unpack_from("<I", b, p + 4)[0]
        p += 8 + size + (size & 1)
    return view[p + 8 : p + 8 + struct.unpack_from("<I", b, p + 4)[0]]


def to_wav(payload: bytes) -> bytes:
    """8-bit mono PCM, one sample a byte."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", n) + payload


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 and zeros up to a positive multiple of 64; and the bytes before the zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 if raw else 64), len(raw)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, declared, media): each text stored losslessly as samples, its declared type left general."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                pairs = [padded(t) for t in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("id"), pa.array([n for _, n in pairs], pa.int64()), pa.array([UNKNOWN] * len(pairs)), pa.array([to_wav(p) for p, _ in pairs], pa.binary())], names=["id", "n_bytes", "declared", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, declared string, media binary").withColumnRenamed("id", id_col)


def media_features(df: DataFrame, keep: list[str], media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """``keep`` columns and what the bytes show: media_type, corrected, payload digest and length where the medium holds samples, features, and the embedded media (type, start, length, bytes)."""
    results = ("media_type", "corrected", "media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "feature", "embedded")
    keep = without(keep, results)
    media_in, declared_in = fresh("media", keep), fresh("declared", keep)
    out = f"{declared(df, keep)}media_type string, corrected boolean, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, embedded array<struct<type:string,start:long,length:long,bytes:binary>>"

    def one(b: bytes | None, said: str | None) -> dict:
        if b is None:
            return {"media_type": None, "corrected": False, "embedded": []}
        found = sniff(b)
        kind = found[0][0] if found and found[0][1] == 0 else UNKNOWN
        inner = [x for x in found if x[1]]
        row = {"media_type": kind, "corrected": kind != (said or UNKNOWN), "media_bytes": len(b), "media_sha256": hashlib.sha256(b).hexdigest()}
        row["embedded"] = [{"type": k, "start": s, "length": n, "bytes": b[s : s + n]} for k, s, n in inner]
        if kind == "audio/wav":
            pcm = pcm_of(b)
            x = np.frombuffer(pcm, np.uint8)
            up = x >= 128
            row |= {"payload_bytes": len(pcm), "payload_sha256": hashlib.sha256(pcm).hexdigest(), "tail_crc32": zlib.crc32(pcm[-64:])}
            row["feature"] = f"{kind};n={len(x)};sum={int(x.sum(dtype=np.int64))};energy={int(np.square(x.astype(np.int64) - 128).sum())};crossings={int((up[1:] != up[:-1]).sum())};embedded={len(inner)}"
        else:
            row["feature"] = f"{kind};n={len(b)};embedded={len(inner)}"
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                rows = [one(m, d) for m, d in zip(part.column(media_in).to_pylist(), part.column(declared_in).to_pylist(), strict=True)]
                if schema is None:
                    item = pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("bytes", pa.binary())])
                    schema = [("media_type", pa.string()), ("corrected", pa.bool_()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string()), ("embedded", pa.list_(item))]
                yield pa.record_batch([part.column(k) for k in keep] + [pa.array([r.get(k) for r in rows], t) for k, t in schema], names=[*keep, *[k for k, _ in schema]])

    return df.select(*keep, F.col(media_col).alias(media_in), F.col(declared_col).alias(declared_in)).mapInArrow(run, out)
