"""WARC archives and their capture index.

Pages are written as WARC/1.1 records, each a gzip member of its own, packed into archives of bounded size. Of pages with
equal payloads of MIN_REVISIT bytes or more the one with the largest id is a response and the others are revisit records that refer
to it. Reading an archive back gives a run: its captures in the order of URL key, time and id. The runs are merged into
the global index: the captures are range-partitioned by that order, and in each range a loser tree merges the pieces of
all runs, so that the ranges one after another are the sorted capture histories. A range has about RANGE_ROWS captures,
whatever the input, and no payloads.

Archives are rows (name, bytes) of a table in the shared folder, which any task can read again if an executor is lost.
Pages with equal payloads are never gathered: their largest id is a grouped aggregate that is joined back.

Defined results: a null html is an empty payload; a null url has the key ''; rows alike in id and payload are the same
capture, all of one type; a null id is less than any other, so such a page refers to an equal one that has an id,
and is a response if none has; an empty table gives an empty result; further columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, stored

MIN_REVISIT, ARCHIVE_BYTES, PIECE = 1000, 8 << 20, 1 << 14
#: Captures in a range of the index, which a task merges.
RANGE_ROWS = 100_000
_EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: the host's labels reversed, then path and query."""
    try:
        parts = urlsplit(url or "")
        host, port = ",".join(reversed((parts.hostname or "").split("."))), parts.port
    except ValueError:  # not a URL: it stands for itself
        return _line(url)
    if not host:
        return _line(url or "")
    port = f":{port}" if port and port not in (80, 443) else ""
    return f"{host}{port}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _line(text: object) -> str:
    """A header's value: without line breaks."""
    return " ".join(str(text).split())


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """One record, as a gzip member."""
    date = (_EPOCH + timedelta(seconds=(page_id or 0) % 315_360_000)).strftime("%Y-%m-%dT%H:%M:%SZ")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_line(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def records(archive: bytes) -> Iterator[tuple[int, int, dict, bytes]]:
    """(offset, length, headers, block) of each record of an archive."""
    view, at = memoryview(archive), 0
    while at < len(archive):
        part, raw, p = zlib.decompressobj(31), [], at
        while not part.eof:
            if p >= len(archive):
                raise ValueError(f"the archive ends within the record at {at}")
            raw.append(part.decompress(view[p : p + PIECE]))
            p += PIECE
        end = min(p, len(archive)) - len(part.unused_data)
        head, _, rest = b"".join(raw).partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
        yield at, end - at, headers, rest[: int(headers["Content-Length"])]
        at = end


class LoserTree:
    """Merges sorted iterators: each inner node holds the loser of its match, so that the next item takes one path up."""

    def __init__(self, runs: list):
        self.iters = [iter(r) for r in runs]
        self.heads = [next(i, None) for i in self.iters]
        self.k = len(runs)
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._climb(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None if x is None and y is None else x is not None and (y is None or x < y or x == y and a < b)

    def _climb(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other == -1:  # first visit while building: wait here for an opponent
                self.tree[node] = winner
                return
            if self._less(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.k:
            winner = self.tree[0]
            if self.heads[winner] is None:
                return
            yield self.heads[winner]
            self.heads[winner] = next(self.iters[winner], None)
            node = (winner + self.k) // 2
            while node > 0:
                other = self.tree[node]
                if self._less(other, winner):
                    self.tree[node], winner = winner, other
                node //= 2
            self.tree[0] = winner


INDEX = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, at long, length long"


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The archives: a stored table (archive, records, data)."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    keyed = rows.withColumn("sha1", F.sha1(F.encode("html", "utf-8"))).withColumn("bytes", F.octet_length("html"))
    slim = stored(keyed.select("page_id", "sha1", "bytes").where(F.col("bytes") >= MIN_REVISIT), "warc-digests")
    copies = slim.groupBy(F.col("sha1").alias("of")).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    revisits = slim.join(copies, slim["sha1"] == copies["of"]).where("first IS NOT NULL AND NOT page_id <=> first").select(F.col("page_id").alias("rid"), F.col("sha1").alias("rsha"), F.col("first").alias("refers_to")).distinct()
    marked = keyed.join(stored(revisits, "warc-revisits"), F.col("page_id").eqNullSafe(F.col("rid")) & (F.col("sha1") == F.col("rsha")), "left").select("page_id", "url", "html", "sha1", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "html", ARCHIVE_BYTES):
            made = []
            for page, url, html, sha1, to in zip(*(batch.column(c) for c in ("page_id", "url", "html", "sha1", "refers_to"))):
                made.append(record(page.as_py(), url.as_py(), html.as_buffer().to_pybytes(), sha1.as_py(), to.as_py()))
            data = b"".join(made)
            name = f"{hashlib.sha1(data).hexdigest()}.warc.gz"
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(made)], pa.int64()), pa.array([data], pa.binary())], ["archive", "records", "data"])

    return stored(marked.mapInArrow(run, "archive string, records long, data binary"), "warc-archives")


def runs(archives: DataFrame) -> DataFrame:
    """The captures of all archives, read back; those of one archive are a sorted run, numbered by seq. Stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("archive").to_pylist(), batch.column("data")):
                found = []
                for at, length, h, block in records(data.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
                    stated = base64.b32decode(h["WARC-Payload-Digest"][5:]).hex()
                    if h["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != stated or len(payload) != size):
                        raise ValueError(f"record at {at} of {name} is damaged")
                    ident = h["WARC-Record-ID"][10:-1]
                    to = h.get("WARC-Refers-To")
                    found.append((url_key(h["WARC-Target-URI"]), h["WARC-Date"], int(ident) if ident else None, size, stated, h["WARC-Type"], int(to[10:-1]) if to else None, name, at, length))
                found.sort(key=lambda r: (r[0], r[1], -1 if r[2] is None else r[2], r[8]))
                cols = [pa.array(c, k) for c, k in zip(zip(*found), _KINDS)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(range(len(found)), pa.int64())], [*_NAMES, "seq"])

    return stored(archives.mapInArrow(run, INDEX + ", seq long"), "warc-runs")


_NAMES = [x.split()[0] for x in INDEX.split(", ")]
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def merged_index(captures: DataFrame) -> DataFrame:
    """All runs merged: captures in the order of URL key, time and id, range by range."""
    parts = max(1, -(-captures.count() // RANGE_ROWS))
    ranged = captures.repartitionByRange(parts, "url_key", "captured", "page_id", "archive", "at").sortWithinPartitions("archive", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
        if whole is None:
            return
        whole = whole.combine_chunks()
        key, captured, page, archive, at = (whole.column(c).to_pylist() for c in ("url_key", "captured", "page_id", "archive", "at"))
        cuts = [0, *(i for i in range(1, len(archive)) if archive[i] != archive[i - 1]), len(archive)]

        def piece(a: int, b: int) -> Iterator[tuple]:
            for i in range(a, b):
                yield key[i], captured[i], -1 if page[i] is None else page[i], archive[i], at[i], i

        order: list[int] = []
        for item in LoserTree([piece(a, b) for a, b in zip(cuts[:-1], cuts[1:])]):
            order.append(item[5])
            if len(order) == 10_000:
                yield from whole.take(pa.array(order)).to_batches()
                order = []
        if order:
            yield from whole.take(pa.array(order)).to_batches()

    return ranged.select(*_NAMES).mapInArrow(run, INDEX)


def capture_index(pages: DataFrame, **columns: str) -> DataFrame:
    """Write pages as archives, read them back, and merge the runs into the global index."""
    return merged_index(runs(write(pages, **columns)))
