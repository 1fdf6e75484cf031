import gzip
import hashlib
import io
import random
import struct
import time
import zipfile
import zlib
from collections import defaultdict

import pytest

from tidewell.llm import media, warc


def test_media_round_trip(docs, empty):
    out = media.read_back(media.sniff(media.store(docs))).collect()
    assert len(out) == docs.count()
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in out:
        b = text[r.doc_id]
        p = b + b"\0" * (-len(b) % 64 or (0 if b else 64))
        w = media.to_wav(p)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(w), hashlib.sha256(w).hexdigest()) and r.feature.startswith("audio/wav")
    assert media.read_back(media.sniff(media.store(empty))).count() == 0


def png():
    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00" + b"\x3b"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4
PDF = b"%PDF-1.4\nx\nstartxref\n0\n%%EOF"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd12\xff\x00\x34\xff\xd9"
OGG = b"OggS\0\x04" + b"\0" * 20 + b"\x01\x03abc"
def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "some text " * 20)
        z.writestr("b", b"")
    return out.getvalue()


MP4 = b"\0\0\0\x10ftypisom\0\0\0\1" + b"\0\0\0\x0cmoovabcd" + b"\0\0\0\x0amdatxy"
FILES = {"application/zip": zipped(), "video/mp4": MP4, "image/png": png(), "image/gif": GIF, "image/bmp": BMP, "application/pdf": PDF, "image/jpeg": JPEG, "audio/ogg": OGG, "application/gzip": gzip.compress(b"hello"), "audio/wav": media.to_wav(b"12345")}


@pytest.mark.parametrize("kind", sorted(FILES))
def test_signatures(kind):
    f = FILES[kind]
    assert media.find_media(f) == [(kind, 0, len(f))]
    assert (kind, 7, len(f)) in media.find_media(b"garbage" + f + b"tail")
    assert not any(k == kind for k, _, _ in media.find_media(f[: len(f) - 3]))


def test_updated_pdf_and_fill_bytes():
    twice = PDF + b"\nmore\nstartxref\n9\n%%EOF"
    assert media.find_media(twice) == [("application/pdf", 0, len(twice))]
    assert media.find_media(JPEG.replace(b"\xff\xda", b"\xff\xff\xff\xda"))[0][0] == "image/jpeg"


def test_many_signatures_take_linear_time():
    for part in (b"%PDF-", b"BM", b"PK\x03\x04", b"ftyp", b"OggS", b"RIFF", b"GIF89a"):
        began = time.process_time()
        media.find_media(part * (3_000_000 // len(part)) + b"%%EOF")
        assert time.process_time() - began < 20, part


def test_sniff_replaces_its_own_names(spark):
    df = spark.createDataFrame([(1, "a/b", bytearray(FILES["image/png"]), "old", 3)], "doc_id long, declared string, media binary, media_type string, media_found int")
    out = media.sniff(df)
    assert out.columns == ["doc_id", "declared", "media", "media_type", "media_found"] and out.first().media_type == "image/png"


def test_sniff_corrects_and_carves(spark):
    inside = media.to_wav(b"abcd" + FILES["image/png"])
    rows = [(1, "image/gif", bytearray(FILES["image/png"])), (2, "text/plain", bytearray(b"BM RIFF plain")), (3, "x/y", None), (4, "audio/wav", bytearray(inside)), (5, "a/b", bytearray(b""))]
    out = media.sniff(spark.createDataFrame(rows, "doc_id long, declared string, media binary"))
    assert {r.doc_id: r.media_type for r in out.collect()} == {1: "image/png", 2: "text/plain", 3: None, 4: "audio/wav", 5: "a/b"}
    (part,) = media.carve(out).collect()
    assert part.doc_id == 4 and part.part_type == "image/png" and bytes(part.part) == FILES["image/png"]
    named = media.carve(out.withColumnsRenamed({"declared": "part_type", "doc_id": "part"})).first()
    assert named.docs_part == 4 and named.docs_part_type == "audio/wav" and named.part_type == "image/png" and bytes(named.part) == FILES["image/png"]


def test_captures(spark):
    big, same = "<p>" + "x" * 1000, "é" * 600
    pages = [(1, "http://a.example/x", big), (2, "http://b.example/", big), (3, "https://a.example:8443/x?q", same), (9, None, same), (4, "not a url [", "small"), (5, "http://a.example/x", "small"), (6, "http://a.example/x", None), (7, "http://[bad", ""), (2, "http://b.example/", big)]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, archive string").repartition(3)
    got = warc.capture_index(df).collect()
    assert len(got) == len(pages)
    first = {big: 2, same: 9}
    want = defaultdict(set)
    for i, _, h in pages:
        b = (h or "").encode()
        to = first.get(h) if first.get(h) != i else None
        want[i].add((len(b), hashlib.sha1(b).hexdigest(), "revisit" if to else "response", to))
    for r in got:
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) in want[r.page_id]
    keys = [(r.url_key, r.captured, r.page_id) for r in got]
    assert keys == sorted(keys)
    assert warc.capture_index(df.limit(0)).count() == 0


def test_captures_without_an_id(spark):
    """Of equal pages one without an id refers to the largest id; if none has one, all are responses."""
    big, other = "<p>" + "x" * 1000, "é" * 600
    df = spark.createDataFrame([(None, "http://a/", big), (4, "http://b/", big), (3, "http://c/", big), (None, "http://d/", big), (None, None, other), (None, "http://e/", other)], "page_id long, url string, html string")
    got = sorted((r.payload_bytes, r.page_id or 0, r.record_type, r.refers_to or 0) for r in warc.capture_index(df).collect())
    assert got == [(1003, 0, "revisit", 4), (1003, 0, "revisit", 4), (1003, 3, "revisit", 4), (1003, 4, "response", 0), (1200, 0, "response", 0), (1200, 0, "response", 0)]


def test_long_pages_and_many_runs(spark, monkeypatch):
    """Archives of a few records and several ranges: the index is one sorted history, and a page of megabytes comes back whole."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    monkeypatch.setattr(warc, "RANGE_ROWS", 50)
    pages = [(i, f"http://h{i % 7}.example/{i % 11}", "y" * (i % 900)) for i in range(300)] + [(1000, "http://h1.example/", "long " * 600_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = warc.capture_index(df)
    assert out.rdd.getNumPartitions() == 7
    got = out.collect()
    keys = [(r.url_key, r.captured, r.page_id) for r in got]
    assert keys == sorted(keys) and len({r.archive for r in got}) > 20
    assert {r.page_id: r.payload_bytes for r in got} == {i: len(h) for i, _, h in pages}


def test_loser_tree_merges():
    rng = random.Random(0)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_damaged_archives_are_noticed():
    r = warc.record(1, "http://a.example/", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    assert len(list(warc.records(r + r))) == 2
    with pytest.raises(ValueError):
        list(warc.records(r[:-4]))
