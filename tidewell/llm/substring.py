"""Removal of repeated passages by recompression.

Words are named by hashes of their bytes. Round by round, maximal runs of one symbol are replaced by a symbol named by
(symbol, length), and then each pair of a left symbol and a right symbol by a symbol named by both; the side of a
symbol follows from its name and the round. Names depend on content only, so every task gives the same name to the same
substring: equal passages get the same interior symbols, whatever surrounds them. With each symbol goes the span of
words that determined it. A passage that repeats holds, at both places, the same symbols among those determined
by its own words alone; so a window of words can only repeat if every such symbol of it occurs twice at least. Spark
counts the symbols of the top level over all documents. Windows that the shared symbols leave (and those
too short-ranged to hold any symbol, as inside long runs) are verified: Spark counts their two
hashes, of 64 and 31 bits; two windows with equal hashes of both are taken as equal.

The texts are dealt to chunks of bounded size once. A group in any shuffle holds a row for a chunk at most, however
often a passage repeats.

Defined results: a null text is an empty one, with no words; rows alike count as two documents, so both lose all windows;
a window that repeats within one document, overlapping itself too, is removed at all its places; texts shorter than a
window lose nothing; an empty table gives an empty result; further columns are kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, chunk_count, mix64, powers, span_hashes, text_buffers, word_spans

WINDOW, ROUNDS, RUN_ROUNDS = 35, 6, 2
#: Text of a chunk, which a task holds as a whole.
CHUNK_BYTES = 16 << 20
_RUN, _PAIR = U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)


def recompress(names: np.ndarray, first: np.ndarray, rounds: int = ROUNDS, run_rounds: int = RUN_ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top-level symbols of all texts: name, and the span [left, right) of words that determined it.

    names: a hash for each word; first: where each text's words begin, and the end. Spans that reach beyond their text
    (its first and last symbols depend on where it ends) are marked by left = -1.
    """
    n = len(names)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    left, right = np.arange(n), np.arange(1, n + 1)
    edge = np.zeros(n, bool)  # determined by an end of the text too
    for k in range(rounds):
        if not len(names):
            break
        # runs: a run is known once the symbols beside it are known to differ
        if k < run_rounds:
            fresh = np.ones(len(names), bool)
            fresh[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(fresh)
            end = np.append(at[1:], len(names))
            length = end - at
            run_doc = doc[at]
            has_prev = np.zeros(len(at), bool)
            has_prev[1:] = run_doc[1:] == run_doc[:-1]
            has_next = np.zeros(len(at), bool)
            has_next[:-1] = has_prev[1:]
            run_left = np.where(has_prev, left[np.maximum(at - 1, 0)], left[at])
            run_right = np.where(has_next, right[np.minimum(end, len(names) - 1)], right[end - 1])
            beside = np.minimum(end, len(names) - 1)
            known = ~has_prev | ~has_next | np.logical_or.reduceat(edge, at) | edge[np.maximum(at - 1, 0)] & has_prev | edge[beside] & has_next
            names = np.where(length > 1, mix64(names[at] * _RUN + length.astype(U64)), names[at])
            left, right, doc, edge = np.minimum(run_left, left[at]), np.maximum(run_right, right[end - 1]), run_doc, known
        # pairs: left symbols with right symbols
        side = (mix64(names + mix64(np.array([k + 1], U64))) & U64(1)).astype(bool)  # True: right
        pair = np.zeros(len(names), bool)
        pair[:-1] = ~side[:-1] & side[1:] & (doc[1:] == doc[:-1])
        second = np.zeros(len(names), bool)
        second[1:] = pair[:-1]
        prev, nxt = np.maximum(np.arange(len(names)) - 1, 0), np.minimum(np.arange(len(names)) + 1, len(names) - 1)
        in_prev, in_next = doc[prev] == doc, doc[nxt] == doc
        in_prev[:1], in_next[-1:] = False, False
        new_left, new_right, new_edge = left.copy(), right.copy(), edge.copy()
        lone_l, lone_r = ~pair & ~second & ~side, ~pair & ~second & side
        # a lone left symbol depends on what follows, a lone right symbol on what comes before
        new_right[lone_l] = np.where(in_next, np.maximum(right, right[nxt]), right)[lone_l]
        new_left[lone_l] = np.where(in_next, np.minimum(left, left[nxt]), left)[lone_l]
        new_edge[lone_l] = (edge | ~in_next | edge[nxt])[lone_l]
        new_left[lone_r] = np.where(in_prev, np.minimum(left, left[prev]), left)[lone_r]
        new_right[lone_r] = np.where(in_prev, np.maximum(right, right[prev]), right)[lone_r]
        new_edge[lone_r] = (edge | ~in_prev | edge[prev])[lone_r]
        new_left[pair] = np.minimum(left, left[nxt])[pair]
        new_right[pair] = np.maximum(right, right[nxt])[pair]
        new_edge[pair] = (edge | edge[nxt])[pair]
        merged = np.where(pair, mix64(names * _PAIR + names[nxt]), names)
        keep = ~second
        names, left, right, edge, doc = merged[keep], new_left[keep], new_right[keep], new_edge[keep], doc[keep]
    return names, np.where(edge, -1, left), right


def open_windows(first: np.ndarray, left: np.ndarray, right: np.ndarray, shared: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Starts of the windows all of whose own symbols are shared (or that have none)."""
    n = int(first[-1])
    ok = np.zeros(n + 1, np.int64)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= window:
            ok[a] += 1
            ok[b - window + 1] -= 1
    inside = (left >= 0) & (right - left <= window) & ~shared
    lo, hi = np.maximum(right[inside] - window, 0), left[inside] + 1  # starts of the windows that hold the span
    shut = np.zeros(n + 1, np.int64)
    np.add.at(shut, lo, 1)
    np.add.at(shut, hi, -1)
    return np.flatnonzero((np.cumsum(ok)[:n] > 0) & (np.cumsum(shut)[:n] == 0))


def window_hashes(names: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes, of 64 and 31 bits, of the windows at starts."""
    up, down = powers(len(names) + 1)
    out = []
    for salt in (U64(0x9FB21C651E98DF25), U64(0xC2B2AE3D27D4EB4F)):
        sums = np.zeros(len(names) + 1, U64)
        np.cumsum(mix64(names ^ salt) * up[: len(names)], out=sums[1:])
        out.append(mix64((sums[starts + window] - sums[starts]) * down[starts]))
    return out[0].view(np.int64), (out[1] & U64(0x7FFFFFFF)).astype(np.int32)


def _slices(table: pa.Table, limit: int = 2 << 20):
    """The rows of a chunk in slices of about limit bytes of text."""
    column = table.column("text").combine_chunks() if table.num_rows else None
    if column is None:
        return
    lengths = np.diff(text_buffers(column)[1])
    group = (np.cumsum(lengths) - lengths) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), table.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        data, offsets = text_buffers(column.slice(a, b - a))
        starts, ends, first = word_spans(data, offsets)
        yield a, b, data, starts, ends, first, span_hashes(data, starts, ends)


def _counted(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct rows and how often each occurs."""
    if not len(columns[0]):
        return (*columns, np.zeros(0, np.int64))
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0])
    columns = tuple(c[order] for c in columns)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    return (*(c[at] for c in columns), np.diff(np.append(at, len(order))))


def _symbols(table: pa.Table) -> pa.Table:
    found = [recompress(h, first) for _, _, _, _, _, first, h in _slices(table)]
    names = np.concatenate([s[(left >= 0) & (right - left <= WINDOW)] for s, left, right in found] or [np.zeros(0, U64)])
    names, n = _counted(names)
    return pa.table({"symbol": names.view(np.int64), "chunk": np.full(len(names), table.column("__chunk")[0].as_py(), np.int32), "n": n.astype(np.int32)})


def _windows(key: tuple, table: pa.Table, shared: pa.Table) -> pa.Table:
    known = np.sort(shared.column("symbol").to_numpy().view(U64)) if shared.num_rows else np.zeros(0, U64)
    h1, h2 = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for _, _, _, _, _, first, h in _slices(table):
        s, left, right = recompress(h, first)
        at = open_windows(first, left, right, _among(s, known))
        a, b = window_hashes(h, at)
        h1.append(a)
        h2.append(b)
    a, b, n = _counted(np.concatenate(h1), np.concatenate(h2))
    return pa.table({"h1": a, "h2": b, "chunk": np.full(len(a), key[0].as_py(), np.int32), "n": n.astype(np.int32)})


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _both_among(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs (x, y) are among the sorted distinct pairs (a, b); a value of a stands with two of b at most, in effect."""
    at = np.searchsorted(a, x)
    hit = np.zeros(len(x), bool)
    for step in (0, 1):
        k = np.minimum(at + step, len(a) - 1)
        hit |= (a[k] == x) & (b[k] == y)
    return hit


def _kept(table: pa.Table, repeated: pa.Table):
    """For each row of a chunk: (row, data, word starts, word ends, covered flags)."""
    a = repeated.column("h1").to_numpy() if repeated.num_rows else np.zeros(0, np.int64)
    b = repeated.column("h2").to_numpy() if repeated.num_rows else np.zeros(0, np.int32)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    for lo, hi, data, starts, ends, first, h in _slices(table):
        covered = np.zeros(len(h) + 1, np.int64)
        if len(a) and len(h) >= WINDOW:
            valid = np.zeros(len(h) + 1, np.int64)
            for x, y in zip(first[:-1], first[1:]):
                if y - x >= WINDOW:
                    valid[x] += 1
                    valid[y - WINDOW + 1] -= 1
            at = np.flatnonzero(np.cumsum(valid)[: len(h)] > 0)
            w1, w2 = window_hashes(h, at)
            at = at[_both_among(w1, w2, a, b)]
            np.add.at(covered, at, 1)
            np.add.at(covered, at + WINDOW, -1)
        covered = np.cumsum(covered)[: len(h)] > 0
        for row in range(lo, hi):
            x, y = first[row - lo], first[row - lo + 1]
            yield row, data, starts[x:y], ends[x:y], covered[x:y]


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, covered: np.ndarray) -> bytes:
    raw = data[starts[0] : ends[-1]].tobytes().split() if len(starts) else []
    return b" ".join([w for w, c in zip(raw, covered) if not c] if covered.any() else raw)


def _digests(key: tuple, table: pa.Table, repeated: pa.Table) -> pa.Table:
    out = {"n_words": [], "n_removed": [], "kept_sha256": []}
    for _, data, starts, ends, covered in _kept(table, repeated):
        out["n_words"].append(len(starts))
        out["n_removed"].append(int(covered.sum()))
        out["kept_sha256"].append(hashlib.sha256(_joined(data, starts, ends, covered)).hexdigest())
    return table.drop_columns(["text", "__chunk"]).append_column("n_words", pa.array(out["n_words"], pa.int64())).append_column("n_removed", pa.array(out["n_removed"], pa.int64())).append_column("kept_sha256", pa.array(out["kept_sha256"], pa.string()))


def _texts(key: tuple, table: pa.Table, repeated: pa.Table) -> pa.Table:
    texts = [t.as_py() for t in table.column("text")]
    for row, data, starts, ends, covered in _kept(table, repeated):
        if covered.any():
            texts[row] = _joined(data, starts, ends, covered).decode("utf-8", "replace")
    at = table.schema.get_field_index("text")
    return table.set_column(at, "text", pa.array(texts, pa.string())).drop_columns(["__chunk"])


def _repeats(docs: DataFrame, finish, schema: T.StructType) -> DataFrame:
    """docs: (text and further columns). Applies finish(key, chunk's rows, its repeated windows). All three passes take the same
    columns, so that Spark deals the texts to chunks once and reuses that exchange."""
    chunks = chunk_count(docs, target_bytes=CHUNK_BYTES)
    dealt = docs.withColumn("__chunk", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(chunks)).cast("int")).repartition(chunks, "__chunk")
    symbols = dealt.groupBy("__chunk").applyInArrow(_symbols, "symbol long, chunk int, n int")
    total = F.sum("n").over(Window.partitionBy("symbol"))  # a row for each chunk at most
    shared = symbols.withColumn("total", total).where("total > 1").select("chunk", "symbol")
    windows = dealt.groupBy("__chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_windows, "h1 long, h2 int, chunk int, n int")
    total = F.sum("n").over(Window.partitionBy("h1", "h2"))
    repeated = windows.withColumn("total", total).where("total > 1").select("chunk", "h1", "h2")
    return dealt.groupBy("__chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(finish, schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row of docs."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    return _repeats(rows, _digests, schema).withColumnRenamed("id", id_col)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with the words of repeated windows taken out of ``text`` (the others joined by one space); texts without any
    keep their exact form. Needs a string column ``text``; other columns may have any name but ``__chunk``."""
    return _repeats(docs, _texts, docs.schema)
