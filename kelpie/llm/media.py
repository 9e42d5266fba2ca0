"""Media columns: signature sniffing, structure checks, type correction and carving.

An Aho-Corasick automaton over the magic bytes of ``FORMATS`` finds every place where a format
may begin; a validator for each format follows its structure and lengths from there. The type
of a value is the valid format at its start, whatever was declared; valid formats inside
another's data are carved out as embedded media.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm import kernels as K

RATE = 8000
#: Bytes that an output batch of whole media holds at most, one row at least.
BATCH_BYTES = 16 << 20


def _wav(b: bytes, at: int) -> int:
    """Each validator returns the length of the medium that begins at ``at``, 0 if none does."""
    if len(b) < at + 44 or b[at + 8 : at + 12] != b"WAVE":
        return 0
    total = struct.unpack_from("<I", b, at + 4)[0] + 8
    place, end, data = at + 12, at + total, False
    if end > len(b):
        return 0
    while place + 8 <= end:
        name, size = b[place : place + 4], struct.unpack_from("<I", b, place + 4)[0]
        if place + 8 + size > end:
            return 0
        if name == b"fmt " and (size < 16 or struct.unpack_from("<H", b, place + 10)[0] == 0):
            return 0
        data |= name == b"data"
        place += 8 + size + size % 2
    return total if data and place >= end else 0


def _png(b: bytes, at: int) -> int:
    place, first = at + 8, True
    while place + 12 <= len(b):
        size, name = struct.unpack_from(">I", b, place)[0], b[place + 4 : place + 8]
        if first and (name != b"IHDR" or size != 13) or place + 12 + size > len(b):
            return 0
        if zlib.crc32(b[place + 4 : place + 8 + size]) != struct.unpack_from(">I", b, place + 8 + size)[0]:
            return 0
        place, first = place + 12 + size, False
        if name == b"IEND":
            return place - at
    return 0


def _gif(b: bytes, at: int) -> int:
    if len(b) < at + 13:
        return 0
    flags = b[at + 10]
    place = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += b[p] + 1
        return p + 1

    images = 0
    while place < len(b):
        if b[place] == 0x3B:
            return place + 1 - at if images else 0
        if b[place] == 0x21:
            place = blocks(place + 2)
        elif b[place] == 0x2C and place + 10 <= len(b):
            local = b[place + 9]
            place = blocks(place + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0))
            images += 1
        else:
            return 0
    return 0


def _bmp(b: bytes, at: int) -> int:
    if len(b) < at + 54:
        return 0
    size, zero, offset, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    row = (abs(width) * bits + 31) // 32 * 4
    ok = zero == 0 and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and header >= 40 and width > 0
    return size if ok and offset + row * abs(height) <= size <= len(b) - at else 0


def _jpeg(b: bytes, at: int) -> int:
    place = at + 2
    while place + 4 <= len(b) and b[place] == 0xFF:
        mark, size = b[place + 1], struct.unpack_from(">H", b, place + 2)[0]
        if size < 2 or place + 2 + size > len(b):
            return 0
        place += 2 + size
        if mark == 0xDA:
            end = place
            while (end := b.find(b"\xff", end)) >= 0 and end + 1 < len(b):
                if b[end + 1] == 0xD9:
                    return end + 2 - at
                if b[end + 1] and not 0xD0 <= b[end + 1] <= 0xD7:
                    break
                end += 2
            if end < 0 or end + 1 >= len(b):
                return 0
            place = end
    return 0


def _gzip(b: bytes, at: int) -> int:
    if len(b) < at + 18 or b[at + 3] & 0xE0:
        return 0
    packed = zlib.decompressobj(31)
    place, view = at, memoryview(b)
    try:
        while not packed.eof and (place < len(b) or packed.unconsumed_tail):
            if packed.unconsumed_tail:  # at most so much output at a time, however well it was packed
                packed.decompress(packed.unconsumed_tail, 1 << 20)
            else:
                packed.decompress(view[place : place + 65536], 1 << 20)
                place += 65536
    except zlib.error:
        return 0
    return min(place, len(b)) - len(packed.unused_data) - at if packed.eof else 0


def _zip(b: bytes, at: int) -> int:
    """Local files in a row, the central directory, then the end record that counts both."""
    place, files = at, 0
    while b[place : place + 4] == b"PK\x03\x04" and place + 30 <= len(b):
        flags, size, name, extra = struct.unpack_from("<H", b, place + 6)[0], *struct.unpack_from("<I", b, place + 18), *struct.unpack_from("<HH", b, place + 26)
        if flags & 8:
            return 0
        place, files = place + 30 + name + extra + size, files + 1
    start, entries = place, 0
    while b[place : place + 4] == b"PK\x01\x02" and place + 46 <= len(b):
        place, entries = place + 46 + sum(struct.unpack_from("<HHH", b, place + 28)), entries + 1
    if b[place : place + 4] != b"PK\x05\x06" or place + 22 > len(b):
        return 0
    n, size, offset, note = struct.unpack_from("<HIIH", b, place + 10)
    return place + 22 + note - at if n == files == entries and size == place - start and offset == start - at and place + 22 + note <= len(b) else 0


@functools.lru_cache(maxsize=1)
def _marks(b: bytes) -> tuple[list[int], list[int]]:
    """Where the value has ``startxref`` and ``%%EOF``, searched once for all that may begin in it."""
    return [m.start() for m in re.finditer(b"startxref", b)], [m.start() for m in re.finditer(b"%%EOF", b)]


def _pdf(b: bytes, at: int) -> int:
    """To the first end mark after the first cross reference."""
    starts, ends = _marks(b)
    i, j = bisect.bisect_left(starts, at), bisect.bisect_left(ends, at)
    ok = i < len(starts) and j < len(ends) and starts[i] < ends[j] and b[at + 5 : at + 6].isdigit()
    return ends[j] + 5 - at if ok else 0


def _flac(b: bytes, at: int) -> int:
    """To the end of the value: frames carry no length."""
    ok = len(b) >= at + 42 and b[at + 4] & 0x7F == 0 and int.from_bytes(b[at + 5 : at + 8], "big") == 34
    return len(b) - at if ok else 0


def _ogg(b: bytes, at: int) -> int:
    place = at
    while b[place : place + 4] == b"OggS" and place + 27 <= len(b) and b[place + 4] == 0:
        n = b[place + 26]
        end = place + 27 + n + sum(b[place + 27 : place + 27 + n])
        if place + 27 + n > len(b) or end > len(b):
            return 0
        last, place = b[place + 5] & 4, end
        if last:
            return place - at
    return 0


FORMATS = (
    ("audio/wav", b"RIFF", _wav), ("image/png", b"\x89PNG\r\n\x1a\n", _png), ("image/gif", b"GIF87a", _gif), ("image/gif", b"GIF89a", _gif),
    ("image/bmp", b"BM", _bmp), ("image/jpeg", b"\xff\xd8\xff", _jpeg), ("application/gzip", b"\x1f\x8b\x08", _gzip), ("application/zip", b"PK\x03\x04", _zip),
    ("application/pdf", b"%PDF-", _pdf), ("audio/flac", b"fLaC", _flac), ("audio/ogg", b"OggS", _ogg),
)
UNKNOWN = "application/octet-stream"
_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        _automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, (_, magic, _) in enumerate(FORMATS):
            _automaton.add_word(magic.decode("latin-1"), i)
        _automaton.make_automaton()
    return _automaton


def sniff(value: bytes | None) -> tuple[str, int, list[tuple[str, int, int]]]:
    """Type and length of the medium that a value begins with, and (type, offset, length) of others in it.

    Null and empty values, and values that begin with no valid format, are of ``UNKNOWN`` type with
    length 0. A medium found inside a carved one is reported too; a compressed one hides its content.
    """
    if not value:
        return UNKNOWN, 0, []
    kind, length, inner = UNKNOWN, 0, []
    for end, i in automaton().iter(value.decode("latin-1")):
        name, magic, check = FORMATS[i]
        at = end + 1 - len(magic)
        if n := check(value, at):
            if at == 0:
                kind, length = name, n
            else:
                inner.append((name, at, n))
    return kind, length, inner


SNIFFED = "id long, declared string, type string, length long, corrected boolean, embedded array<struct<type:string,at:long,length:long>>"


def sniff_media(df: DataFrame, id_col: str, bytes_col: str, declared_col: str | None = None) -> DataFrame:
    """id, declared, type, length, corrected (a valid type other than declared), embedded; a row for each row of ``df``.

    Null, empty and invalid values are of ``UNKNOWN`` type and correct nothing; a null declared type
    is corrected by any valid one. Repeated rows are sniffed each, an empty table gives no rows,
    other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.struct([("type", pa.string()), ("at", pa.int64()), ("length", pa.int64())])
        for batch in batches:
            declared = K.column(batch, "declared").to_pylist()
            found = [sniff(v.as_py()) for v in K.column(batch, "value")]
            yield pa.RecordBatch.from_arrays(
                [
                    K.column(batch, "id"),
                    pa.array(declared, pa.string()),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.int64()),
                    pa.array([f[1] > 0 and f[0] != d for f, d in zip(found, declared, strict=True)], pa.bool_()),
                    pa.array([[{"type": t, "at": a, "length": n} for t, a, n in f[2]] for f in found], pa.list_(schema)),
                ],
                names=["id", "declared", "type", "length", "corrected", "embedded"],
            )

    declared = F.col(declared_col).cast("string") if declared_col else F.lit(None).cast("string")
    return df.select(F.col(id_col).cast("long").alias("id"), declared.alias("declared"), F.col(bytes_col).alias("value")).mapInArrow(run, SNIFFED)


def padded(text: str | bytes | None) -> tuple[int, bytes]:
    """The bytes of a text, then zeros up to a positive multiple of 64, and the number before them."""
    raw = text.encode() if isinstance(text, str) else bytes(text or b"")
    return len(raw), raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def store_wav(payload: bytes) -> bytes:
    """``payload`` as the unsigned 8-bit samples of a mono WAV file."""
    header = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return header + payload


def read_wav(stored: bytes) -> bytes:
    """The samples of a WAV file's first data chunk; the file must be valid."""
    if not _wav(stored, 0):
        raise ValueError("not a valid WAV file")
    place = 12
    while stored[place : place + 4] != b"data":
        size = struct.unpack_from("<I", stored, place + 4)[0]
        place += 8 + size + size % 2
    size = struct.unpack_from("<I", stored, place + 4)[0]
    return stored[place + 8 : place + 8 + size]


def features(samples: bytes, kind: str, embedded: list) -> str:
    """Type, seconds, mean, deviation, entropy in bits, crossings of the middle, embedded media."""
    count = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    share = count / max(1, len(samples))
    value = np.arange(256)
    mean = float((share * value).sum())
    deviation = float(np.sqrt((share * (value - mean) ** 2).sum()))
    some = share[share > 0]
    high = np.frombuffer(samples, np.uint8) >= 128
    crossings = int((high[1:] != high[:-1]).sum())
    inner = ",".join(f"{t}@{a}+{n}" for t, a, n in embedded)
    return f"{kind};s={len(samples) / RATE:.3f};mean={mean:.4f};dev={deviation:.4f};bits={-(some * np.log2(some)).sum() + 0.0:.4f};cross={crossings};in={inner}"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared string, type string, corrected boolean"
#: The type that the documents table gives its values.
DECLARED = "text/plain"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media: each whole text (null: empty) stored as a WAV file.

    Repeated rows are stored each, an empty table gives no rows, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.buffers(K.column(batch, "text"))
            ids, view = K.column(batch, "id"), data.tobytes()
            for i, j in K.runs(offsets, BATCH_BYTES):
                made = [padded(view[offsets[k] : offsets[k + 1]]) for k in range(i, j)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array([n for n, _ in made], pa.int64()), pa.array([store_wav(p) for _, p in made], pa.binary())],
                    names=["id", "n_bytes", "media"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_bytes long, media binary")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for media in K.column(batch, "media"):
            stored = media.as_py()
            kind, _, inner = sniff(stored)
            payload = read_wav(stored)
            rows.append(
                (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), features(payload, kind, inner), DECLARED, kind, kind != DECLARED)
            )
        columns = list(zip(*rows, strict=True)) or [()] * 9
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [K.column(batch, "id"), K.column(batch, "n_bytes"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
            names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "declared", "type", "corrected"],
        )


def op6_media_sniff(spark, sf_dir: str) -> DataFrame:
    """Every text stored as a WAV file, its declared type corrected, its samples read back and digested."""
    return store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")).mapInArrow(_digests, DIGEST)
