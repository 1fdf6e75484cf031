"""What the text operators share: the shared folder, and hashing of words in numpy arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# --- the shared folder -------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a local session, if unset, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidewell-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_SCRATCH: list[str] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables that are stored inside are deleted at the end: for whoever has written the result elsewhere by then."""
    _SCRATCH.append(f"{shared_dir(spark)}/tidewell/scratch-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage and survives lost executors. With keep
    the table outlives ``scratch``."""
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/tidewell" if keep or not _SCRATCH else _SCRATCH[-1]
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# --- columns -----------------------------------------------------------------------------


def free_name(df: DataFrame, name: str, prefix: str = "_") -> str:
    """name, with as many prefixes as it takes for no column of df to have it (letter case plays no part)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = prefix + name
    return name


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body).getItem(0)


def uniform(*cols) -> Column:
    """A number in [0, 1) that depends on the given values only."""
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / float(1 << 53)


def text_key(text: Column) -> Column:
    """16 bytes that name a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def chunk_count(docs: DataFrame, text: str = "text", target_bytes: int = 24 << 20, least: int = 8) -> int:
    """Number of chunks that hold about target_bytes of text each; grows with the input."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(least, int(total // target_bytes) + 1)


# --- numpy helpers -----------------------------------------------------------------------

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15 | 1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (wraps around)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_CODES = mix64(np.arange(1, 257, dtype=U64) * _MULT)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """mult**i and mult**-i for i below n, modulo 2**64."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        inverse = pow(int(_MULT), -1, 1 << 64)
        for key, base in (("up", int(_MULT)), ("down", inverse)):
            steps = np.full(size, U64(base))
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in data, and where each text's words begin (len(offsets) entries).

    Words are runs without ASCII white space; texts lie one after the other at offsets.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    end = word.copy()
    end[:-1] &= ~word[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    start[cut] = word[cut]
    end[cut - 1] = word[cut - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal spans get equal hashes, wherever they stand."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_CODES[data] * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix64(h + (ends - starts).astype(U64) * _MULT)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def in_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.diff(text_buffers(batch.column(column))[1])
        group = (np.cumsum(lengths) - lengths) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)
