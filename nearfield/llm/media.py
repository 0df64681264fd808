"""Media columns by signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass over a blob. At each hit the
format's validator walks its structure and gives the length, or nothing where the structure does not hold. The
object that starts at byte 0 corrects the declared type; further ones are embedded media that can be carved.

Defined results: null blobs count as empty; an empty blob and one without any valid object have the type
``application/octet-stream`` and no objects; objects inside an accepted object are not reported again (its bytes are
that object's content), and objects are taken from the left. Rows are independent, so that ties, repeated rows, extra columns of
any name and empty tables need no care; a very long blob is one pass over its bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, to_batch

UNKNOWN = "application/octet-stream"
SAMPLE_RATE = 8000
BLOCK = 64


class Found(NamedTuple):
    start: int
    length: int
    kind: str
    payload: tuple[int, int]  # start and length of the samples or pixels, where the format stores them as they are


def _riff(b: memoryview, at: int) -> Found | None:
    if len(b) - at < 12 or bytes(b[at + 8 : at + 12]) != b"WAVE":
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if end > len(b):
        return None
    here, rate, data = at + 12, 0, None
    while here + 8 <= end:
        name, size = bytes(b[here : here + 4]), int.from_bytes(b[here + 4 : here + 8], "little")
        if here + 8 + size > end:
            return None
        if name == b"fmt " and size >= 16:
            code, channels, rate, per_second, align, bits = struct.unpack_from("<HHIIHH", b, here + 8)
            if not channels or align != channels * ((bits + 7) // 8) or per_second != rate * align or code not in (1, 3, 6, 7, 65534):
                return None
        elif name == b"data":
            data = (here + 8, size)
        here += 8 + size + (size & 1)
    return Found(at, end - at, "audio/wav", data) if rate and data else None


def _au(b: memoryview, at: int) -> Found | None:
    if len(b) - at < 24:
        return None
    start, size, code, rate, channels = struct.unpack_from(">5I", b, at + 4)
    if start < 24 or size == 0xFFFFFFFF or not 1 <= code <= 27 or not rate or not 1 <= channels <= 64 or at + start + size > len(b):
        return None
    return Found(at, start + size, "audio/basic", (at + start, size))


def _png(b: memoryview, at: int) -> Found | None:
    here, first = at + 8, True
    while here + 12 <= len(b):
        size, name = int.from_bytes(b[here : here + 4], "big"), bytes(b[here + 4 : here + 8])
        end = here + 12 + size
        if end > len(b) or first and (name != b"IHDR" or size != 13) or zlib.crc32(b[here + 4 : end - 4]) != int.from_bytes(b[end - 4 : end], "big"):
            return None
        if name == b"IEND":
            return Found(at, end - at, "image/png", (at, 0))
        here, first = end, False
    return None


def _gif(b: memoryview, at: int) -> Found | None:
    if len(b) - at < 14:
        return None
    flags, here = b[at + 10], at + 13
    here += 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    images = 0
    while here < len(b):
        mark = b[here]
        if mark == 0x3B:
            return Found(at, here + 1 - at, "image/gif", (at, 0)) if images else None
        if mark == 0x21:
            here += 2
        elif mark == 0x2C and here + 10 < len(b):
            flags, images = b[here + 9], images + 1
            here += 11 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
        else:
            return None
        while here < len(b) and b[here]:
            here += b[here] + 1
        here += 1
    return None


def _bmp(b: memoryview, at: int) -> Found | None:
    if len(b) - at < 54:
        return None
    size, _, start, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    packing = int.from_bytes(b[at + 30 : at + 34], "little")
    if planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or not 40 <= header <= 124 or width <= 0 or height == 0 or packing > 6:
        return None
    pixels = (width * bits + 31) // 32 * 4 * abs(height)
    if not 14 + header <= start <= size or at + size > len(b) or packing == 0 and start + pixels > size:
        return None
    return Found(at, size, "image/bmp", (at + start, pixels if packing == 0 else 0))


def _jpeg(b: memoryview, at: int) -> Found | None:
    here, scans = at + 2, 0
    while here + 4 <= len(b):
        if b[here] != 0xFF:
            return None
        mark = b[here + 1]
        if mark == 0xD9:
            return Found(at, here + 2 - at, "image/jpeg", (at, 0)) if scans else None
        if mark in (0x00, 0xFF) or 0xD0 <= mark <= 0xD8:
            return None
        here += 2 + int.from_bytes(b[here + 2 : here + 4], "big")
        if mark == 0xDA:
            scans += 1
            while here + 1 < len(b) and (b[here] != 0xFF or b[here + 1] == 0 or 0xD0 <= b[here + 1] <= 0xD7):
                here += 1
    end = here + 2
    return Found(at, end - at, "image/jpeg", (at, 0)) if scans and end <= len(b) and bytes(b[here:end]) == b"\xff\xd9" else None


def _gzip(b: memoryview, at: int) -> Found | None:
    stream = zlib.decompressobj(wbits=31)
    here = at
    try:
        while here < len(b) and not stream.eof:
            stream.decompress(b[here : here + 65536])
            here += 65536
    except zlib.error:
        return None
    return Found(at, min(here, len(b)) - len(stream.unused_data) - at, "application/gzip", (at, 0)) if stream.eof else None


#: Magic bytes of the formats, their validators.
MAGIC = {
    b"RIFF": _riff,
    b".snd": _au,
    b"\x89PNG\r\n\x1a\n": _png,
    b"GIF87a": _gif,
    b"GIF89a": _gif,
    b"BM": _bmp,
    b"\xff\xd8\xff": _jpeg,
    b"\x1f\x8b\x08": _gzip,
}


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    made = ahocorasick.Automaton()
    for magic, valid in MAGIC.items():
        made.add_word(magic.decode("latin-1"), (len(magic), valid))
    made.make_automaton()
    return made


def sniff(blob: bytes) -> list[Found]:
    """The valid objects of a blob from left to right, none inside another."""
    view, found, free = memoryview(blob), [], 0
    for last, (size, valid) in automaton().iter(blob.decode("latin-1")):
        at = last - size + 1
        if at >= free and (got := valid(view, at)):
            found.append(got)
            free = at + got.length
    return found


def wav(samples: bytes, rate: int = SAMPLE_RATE) -> bytes:
    """A mono WAV file of 8-bit samples."""
    pad = len(samples) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * pad


RESULT = pa.schema([("declared", pa.string()), ("detected", pa.string()), ("corrected", pa.bool_()), ("objects", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("kind", pa.string())]))), ("carved", pa.list_(pa.binary()))])
RESULT_DDL = "declared string, detected string, corrected boolean, objects array<struct<start: long, length: long, kind: string>>, carved array<binary>"


def sniff_media(df: DataFrame, key: str, blob: str, declared: str | None = None, carve: bool = False) -> DataFrame:
    """key, declared, detected, corrected, objects (start, length, kind) and, on demand, the carved bytes of embedded media."""
    said = F.col(declared).cast("string") if declared else F.lit(None).cast("string")
    rows = df.select(F.col(key).alias("_key"), F.col(blob).alias("_blob"), said.alias("_said"))
    kind = rows.schema["_key"].dataType.simpleString()

    def work(batches):
        for part in chunks(batches):
            out = []
            for raw, was in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                raw = bytes(raw or b"")
                found = sniff(raw)
                kind = found[0].kind if found and found[0].start == 0 else UNKNOWN
                inner = [f for f in found if f.start]
                out.append((was, kind, was is not None and was != kind, [{"start": f.start, "length": f.length, "kind": f.kind} for f in found], [raw[f.start : f.start + f.length] for f in inner] if carve else []))
            columns = list(zip(*out))
            schema = pa.schema([pa.field("_key", part.schema.field(0).type), *RESULT])
            yield to_batch(schema, part.column(0), *[list(c) for c in columns])

    return rows.mapInArrow(work, f"_key {kind}, {RESULT_DDL}").withColumnRenamed("_key", key)


STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def store_and_sniff(text: str) -> tuple:
    """Stores a text as a WAV file, takes it back out by sniffing and computes features from what was read.

    The blob handed on is the file in an envelope of 4 + 4 bytes, declared as unknown: the sniffer has to find, validate
    and carve it. The text's own bytes may hold magic bytes; as content of the file they are not taken for files.
    """
    raw = text.encode("utf-8")
    payload = raw + b"\0" * (BLOCK - len(raw) % BLOCK if len(raw) % BLOCK or not raw else 0)
    blob = b"\0\1\2\3" + wav(payload) + b"\4\5\6\7"
    found = [f for f in sniff(blob) if f.kind == "audio/wav"]
    media = blob[found[0].start : found[0].start + found[0].length]
    at, size = found[0].payload
    back = blob[at : at + size]
    inner = sniff(back)
    quiet = back.count(0)
    feature = f"{found[0].kind};at={found[0].start};rate={SAMPLE_RATE};samples={size};zeros={quiet};crc={zlib.crc32(back)};inner={','.join(f'{f.kind}@{f.start}+{f.length}' for f in inner) or '-'}"
    return len(raw), size, hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature


def media_digests(docs: DataFrame) -> DataFrame:
    def work(batches):
        for part in chunks(batches):
            rows = [store_and_sniff(t or "") for t in part.column(1).to_pylist()]
            yield to_batch(STORED, part.column(0), *map(list, zip(*rows)))

    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, ddl)
