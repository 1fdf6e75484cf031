"""Media columns: finding out what stored bytes are by their signatures.

An Aho-Corasick automaton finds all magic bytes in one pass over a value. At each hit the format's validator follows
the structure (chunks, blocks, lengths, checksums) and either gives the length of a whole file or rejects the hit. A
file at the start of the value is the value's type, which corrects the declared one; files elsewhere are embedded and
can be carved, those within another file's data too; only a signature that is part of an accepted file's own header is not a file.

``store`` puts bytes into a container without loss, as 8-bit mono samples of a WAV file; ``samples`` reads them back.

Defined results: a null text is an empty payload, padded with zeros to 64 bytes; a null value has type null and nothing
found; a value that no validator accepts keeps its declared type; equal values give equal results; an empty table
gives an empty result; further columns are kept by ``sniff``, which replaces columns named media_type or media_found, and by ``carve``,
where those named part, part_type or part_offset get the prefix docs_, once more while that name is taken.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, in_slices, stored

# Magic bytes and the types they stand for.
MAGIC = (
    (b"RIFF", "riff"),
    (b"\x89PNG\r\n\x1a\n", "image/png"),
    (b"GIF87a", "image/gif"),
    (b"GIF89a", "image/gif"),
    (b"\xff\xd8\xff", "image/jpeg"),
    (b"BM", "image/bmp"),
    (b"%PDF-", "application/pdf"),
    (b"\x1f\x8b\x08", "application/gzip"),
    (b"OggS", "audio/ogg"),
    (b"PK\x03\x04", "application/zip"),
    (b"ftyp", "video/mp4"),
)
ALIGN, RATE = 64, 8000


@lru_cache(1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, kind in MAGIC:
        found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


# --- validators: bytes, offset -> (type, length) of a whole file, or None --------------------


def _riff(b: bytes, at: int):
    if len(b) - at < 12:
        return None
    size, form = struct.unpack_from("<I4s", b, at + 4)
    end = at + 8 + size
    if end > len(b) or form not in (b"WAVE", b"WEBP"):
        return None
    p, seen = at + 12, set()
    while p + 8 <= end:
        name, n = struct.unpack_from("<4sI", b, p)
        seen.add(name)
        p += 8 + n + (n & 1)
    if p not in (end, end + 1):
        return None
    if form == b"WAVE":
        return ("audio/wav", end - at) if {b"fmt ", b"data"} <= seen else None
    return ("image/webp", end - at) if seen & {b"VP8 ", b"VP8L", b"VP8X"} else None


def _png(b: bytes, at: int):
    p = at + 8
    while p + 12 <= len(b):
        n, name = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        if p == at + 8 and name != b"IHDR":
            return None
        p += 12 + n
        if name == b"IEND":
            return "image/png", p - at
    return None


def _gif(b: bytes, at: int):
    if len(b) - at < 14:
        return None
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    while p < len(b):
        mark = b[p]
        if mark == 0x3B:
            return "image/gif", p + 1 - at
        if mark == 0x21:
            p += 2
        elif mark == 0x2C and p + 10 <= len(b):
            flags = b[p + 9]
            p += 11 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
        else:
            return None
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return None


def _jpeg(b: bytes, at: int):
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        while p + 4 < len(b) and b[p + 1] == 0xFF:  # fill bytes
            p += 1
        mark = b[p + 1]
        if mark == 0xD9:
            return "image/jpeg", p + 2 - at
        p += 2 + struct.unpack_from(">H", b, p + 2)[0]
        if mark == 0xDA:  # entropy-coded data up to the next true marker
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b) and (b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7):
                p += 2
            if p < 0:
                return None
    return ("image/jpeg", p + 2 - at) if b[p : p + 2] == b"\xff\xd9" else None


def _bmp(b: bytes, at: int):
    if len(b) - at < 54:
        return None
    size, reserved, start, header = struct.unpack_from("<IIII", b, at + 2)
    planes, depth = struct.unpack_from("<HH", b, at + 26)
    ok = size >= 54 and at + size <= len(b) and reserved == 0 and 26 <= start <= size and header in (40, 52, 56, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32)
    return ("image/bmp", size) if ok else None


def _pdf(b: bytes, at: int):
    """Up to the last end mark before another header: a file with updates has several. Searches are between headers, so that
    many headers cost no more than one."""
    stop = b.find(b"%PDF-", at + 5)
    stop = len(b) if stop < 0 else stop
    end = b.rfind(b"%%EOF", at, stop)
    return ("application/pdf", end + 5 - at) if end > 0 and b.find(b"startxref", at, end) > 0 else None


def _zip(b: bytes, at: int):
    """Local entries, each with its lengths, then the central directory and its end, which must point back to it."""
    p, entries = at, 0
    while b[p : p + 4] == b"PK\x03\x04" and p + 30 <= len(b):
        flags, n, name, extra = struct.unpack_from("<H", b, p + 6)[0], struct.unpack_from("<I", b, p + 18)[0], *struct.unpack_from("<HH", b, p + 26)
        if flags & 8:
            return None  # lengths follow the data: not carved
        p, entries = p + 30 + name + extra + n, entries + 1
    start = p
    while b[p : p + 4] == b"PK\x01\x02" and p + 46 <= len(b):
        p += 46 + sum(struct.unpack_from("<HHH", b, p + 28))
    if b[p : p + 4] != b"PK\x05\x06" or p + 22 > len(b):
        return None
    count, size, offset, note = struct.unpack_from("<HIIH", b, p + 10)
    ok = count == entries and size == p - start and offset == start - at and p + 22 + note <= len(b)
    return ("application/zip", p + 22 + note - at) if ok else None


def _mp4(b: bytes, at: int):
    """Boxes from the one that holds the brand on; there must be a movie and its data."""
    start = at - 4
    p, seen = start, set()
    while 0 <= p and p + 8 <= len(b):
        n, name = struct.unpack_from(">I4s", b, p)
        if n < 8 or p + n > len(b) or not all(32 <= c < 127 for c in name):
            break
        seen.add(name)
        p += n
    return ("video/mp4", p - start, start) if {b"moov", b"mdat"} <= seen else None


def _gzip(b: bytes, at: int):
    if len(b) - at < 18 or b[at + 3] & 0xE0:
        return None
    part = zlib.decompressobj(31)
    try:
        rest = memoryview(b)[at:]
        while len(rest) and not part.eof:
            part.decompress(rest, 1 << 20)  # in bounded pieces; only the check at the end matters
            rest = part.unconsumed_tail
    except zlib.error:
        return None
    return ("application/gzip", len(b) - at - len(part.unused_data)) if part.eof else None


def _ogg(b: bytes, at: int):
    p = at
    while p + 27 <= len(b) and b[p : p + 4] == b"OggS" and b[p + 4] == 0:
        n = b[p + 26]
        if p + 27 + n > len(b):
            return None
        last, p = b[p + 5] & 4, p + 27 + n + sum(b[p + 27 : p + 27 + n])
        if p > len(b):
            return None
        if last:
            return "audio/ogg", p - at
    return None


VALIDATORS = {"riff": _riff, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "application/pdf": _pdf, "application/gzip": _gzip, "audio/ogg": _ogg, "application/zip": _zip, "video/mp4": _mp4}


def find_media(value: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of all files in value, by offset; a file within another's data counts too, but not one
    whose signature is part of the other's own header."""
    found, taken = [], -1
    for end, (n, kind) in _automaton().iter(value.decode("latin-1")):
        at = end + 1 - n
        if at < taken:
            continue
        hit = VALIDATORS[kind](value, at)
        if hit:  # a brand stands behind its box's length
            kind, length, at = hit if len(hit) == 3 else (*hit, at)
            found.append((kind, at, length))
            taken = at + (length if kind == "application/zip" else 12)  # a zip's entries are its own
    return found


# --- columns -----------------------------------------------------------------------------


def to_wav(payload: bytes) -> bytes:
    """payload as the 8-bit samples of a mono WAV file."""
    pad = b"\0" * (len(payload) & 1)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload + pad


def samples(wav: bytes) -> bytes:
    """The samples of a WAV file, found by its chunks."""
    p = 12
    while p + 8 <= len(wav):
        name, n = struct.unpack_from("<4sI", wav, p)
        if name == b"data":
            return wav[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, declared, media): each text in UTF-8, padded with zeros to a positive multiple of ALIGN, as a WAV file.
    Written to the shared folder as a table, and read from there by whoever uses the result."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", 8 << 20):
            raw = [t.as_buffer().to_pybytes() for t in batch.column("text")]
            media = [to_wav(b + b"\0" * (-len(b) % ALIGN or (0 if b else ALIGN))) for b in raw]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(b) for b in raw], pa.int64()), pa.array(["application/octet-stream"] * len(raw)), pa.array(media, pa.binary())], ["id", "n_bytes", "declared", "media"])

    schema = T.StructType([rows.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("declared", T.StringType()), T.StructField("media", T.BinaryType())])
    return stored(rows.mapInArrow(run, schema), "media").withColumnRenamed("id", id_col)


FOUND = "array<struct<type:string,offset:long,length:long>>"


def sniff(df: DataFrame, media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """df with media_type (what the bytes are; the declared type if nothing fits) and media_found (all files in the value)."""
    kind = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, media_col, 8 << 20):
            found = [None if v.as_py() is None else find_media(v.as_py()) for v in batch.column(media_col)]
            declared = batch.column(declared_col).to_pylist()
            types = [None if f is None else next((t for t, at, _ in f if at == 0), d) for f, d in zip(found, declared)]
            lists = pa.array([None if f is None else [dict(zip(("type", "offset", "length"), x)) for x in f] for f in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(types, pa.string()), lists], [*batch.schema.names, "media_type", "media_found"])

    df = df.drop("media_type", "media_found")
    extra = T.StructType().add("media_type", "string").add("media_found", T._parse_datatype_string(FOUND))
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *extra.fields]))


def carve(sniffed: DataFrame, media_col: str = "media") -> DataFrame:
    """A row for each embedded file of a sniffed table: its columns, and part_type, part_offset and part (bytes)."""
    for c in ("part_type", "part_offset", "part"):
        other = free_name(sniffed, c, "docs_")
        sniffed, media_col = sniffed.withColumnRenamed(c, other), other if media_col == c else media_col
    inside = sniffed.withColumn("__f", F.explode(F.filter("media_found", lambda f: f.offset > 0)))
    part = F.substring(F.col(media_col), F.col("__f.offset").cast("int") + 1, F.col("__f.length").cast("int"))
    return inside.withColumn("part_type", F.col("__f.type")).withColumn("part_offset", F.col("__f.offset")).withColumn("part", part).drop("__f")


def read_back(sniffed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of stored texts."""
    rows = sniffed.select(F.col(id_col).alias("id"), "n_bytes", "media", "media_type", F.size("media_found").alias("files"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "media", 8 << 20):
            out = []
            for media, kind, files in zip(batch.column("media"), batch.column("media_type").to_pylist(), batch.column("files").to_pylist()):
                media = media.as_py()
                payload = samples(media)
                x = np.frombuffer(payload, np.uint8).astype(np.int64)
                level = int(x.sum()) // len(x)
                turns = int(((x[1:] > level) != (x[:-1] > level)).sum())
                feature = f"{kind};mono;8bit;{RATE}Hz;files={files};mean={level};power={int((x * x).sum()) // len(x)};crossings={turns}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            cols = list(zip(*out))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    fields = [("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")]
    extra = T.StructType()
    for name, k in fields:
        extra = extra.add(name, k)
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], *extra.fields])).withColumnRenamed("id", id_col)
