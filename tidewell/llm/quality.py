"""Quality classifier: support vectors on Naive Bayes features.

Features are n-gram indicators, hashed into 2**FEATURE_BITS slots: byte n-grams of 1 to 4 bytes and runs of one to three
"this word repeats the one before" marks. Each is scaled by its log-count ratio, log((p + 1) / |p + 1|) -
log((q + 1) / |q + 1|), where p and q count the labelled texts of either class that hold it. A linear hinge-loss
model on these features is fitted by dual coordinate descent, and its margin is mapped to 0..1 by a logistic curve.

The class counts cover all labelled training rows. The dual descent runs in one task over at most SAMPLE_ROWS of them and
about SAMPLE_BYTES of their text, chosen by the hash of their ids (documented bounds); the curve is fitted to margins of
further rows of that sample that the descent did not see. Only the weights come to the driver.

Defined results: a null or empty text has no features and scores by the bias alone; equal texts score alike; without
labels, or with labels of one class only, every score is the share of good labels (0.5 without any); a label of a null
id belongs to no text; of several labels of one id the greatest counts; rows alike stay; an empty table gives an empty
result; only id and text are read, further columns are kept and may have any name but that of the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, U64, free_name, in_slices, mix64, span_hashes, stored, text_buffers, word_spans

FEATURE_BITS, SAMPLE_ROWS, SAMPLE_BYTES, EPOCHS, COST = 17, 6_000, 32 << 20, 8, 1.0
SIZE = 1 << FEATURE_BITS
#: Bytes of a text whose features are found at once.
LONG = 1 << 20
THRESHOLD = 0.7
#: Labels that are broadcast at most (an id and a label each); beyond that labels and texts are shuffled.
BROADCAST_LABELS = 2_000_000


def _slots(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of texts of LONG bytes at most: text * SIZE + slot of all features, sorted and distinct."""
    n, lengths = len(offsets) - 1, np.diff(offsets)
    kind = np.int32 if n <= 1 << (31 - FEATURE_BITS) else np.int64
    doc = np.repeat(np.arange(n, dtype=kind) * kind(SIZE), lengths)
    found = []
    gram = data.astype(np.uint32)
    for k in range(1, 5):
        h = (gram * np.uint32(0x9E3779B1) + np.uint32(k * 0x05EBCA6B)) >> np.uint32(32 - FEATURE_BITS)
        inside = np.ones(len(data), bool)
        for j in range(1, k):  # no n-gram crosses the end of its text
            ends = offsets[1:] - j
            inside[ends[(ends >= 0) & (lengths >= j)]] = False
        found.append((doc + h.astype(kind))[inside])
        if k < 4:
            following = np.zeros(len(data), np.uint32)
            following[: max(0, len(data) - k)] = data[k:]
            gram = gram * np.uint32(257) + following + np.uint32(1)
    starts, ends, first = word_spans(data, offsets)
    if len(starts) > 1:
        h = span_hashes(data, starts, ends)
        owner = np.repeat(np.arange(n, dtype=kind) * kind(SIZE), np.diff(first))
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        run = same.copy()
        for k in range(1, 4):
            slot = int(mix64(np.array([k + 7_000_000], U64))[0] >> U64(64 - FEATURE_BITS))
            found.append(owner[run] + kind(slot))
            run[1:] = run[1:] & run[:-1]
            run[:1] = False
    flat = np.concatenate(found)
    if n * SIZE <= 16 * len(flat):  # marks in a table of one text after another; else sorting takes less
        marks = np.zeros(n * SIZE, bool)
        marks[flat] = True
        return np.flatnonzero(marks)
    flat.sort()
    return flat[np.diff(flat, prepend=kind(-1)) != 0]


def _long_slots(data: np.ndarray) -> np.ndarray:
    """The same of one longer text, by parts that overlap by four words and three bytes; LONG / 4 bytes of overlap at most."""
    marks, low = np.zeros(SIZE, bool), 0
    while low < len(data):
        high = min(low + LONG, len(data))
        marks[_slots(data[low:high], np.array([0, high - low]))] = True
        if high == len(data):
            break
        behind = np.flatnonzero(SPACE[data[high - LONG // 4 : high - 3]][1:] < SPACE[data[high - LONG // 4 : high - 3]][:-1]) + 1  # where words begin
        low = high - LONG // 4 + int(behind[-4]) if len(behind) >= 4 else high - LONG // 4
    return np.flatnonzero(marks)


def features(batch_text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of all texts of a batch, sorted and distinct within a text, and where each text's begin."""
    data, offsets = text_buffers(batch_text)
    n, parts, low = len(offsets) - 1, [np.zeros(0, np.int64)], 0
    for i in [*np.flatnonzero(np.diff(offsets) > LONG), n]:
        if i > low:
            parts.append(_slots(data[offsets[low] : offsets[i]], offsets[low : i + 1] - offsets[low]).astype(np.int64) + low * SIZE)
        if i < n:
            parts.append(_long_slots(data[offsets[i] : offsets[i + 1]]) + i * SIZE)
        low = i + 1
    flat = np.concatenate(parts)
    return flat % SIZE, np.searchsorted(flat, np.arange(n + 1) * SIZE)


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, SIZE), np.int64)
    rows = np.zeros(2, np.int64)
    for batch in in_slices(batches, "text", 1 << 20):
        label = np.asarray(batch.column("label"))
        slots, first = features(batch.column("text"))
        of = np.repeat(label, np.diff(first))
        for c in (0, 1):
            counts[c] += np.bincount(slots[of == c], minlength=SIZE)
            rows[c] += int((label == c).sum())
    for c in (0, 1):
        used = np.flatnonzero(counts[c])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), c, np.int32)), pa.array(used.astype(np.int32)), pa.array(counts[c][used])], ["label", "slot", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([-1], pa.int32()), pa.array([int(rows[c])])], ["label", "slot", "n"])


def _sampled_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, "text", 1 << 20):
        slots, first = features(batch.column("text"))
        slots = slots.astype(np.int32)
        packed = pa.array([slots[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("order"), packed], ["label", "order", "slots"])


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model on indicator rows times scale, by coordinate descent on the dual.

    rows: the slots of each text; y: -1 or 1; cost: the bound of each row's multiplier."""
    w, bias = np.zeros(len(scale)), 0.0
    alpha, order = np.zeros(len(rows)), np.random.default_rng(seed)
    norms = np.array([float((scale[r] ** 2).sum()) + 1.0 for r in rows])
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            r = rows[i]
            x = scale[r]
            g = y[i] * (float(w[r] @ x) + bias) - 1.0
            new = min(max(alpha[i] - g / norms[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[r] += step * x
                bias += step
    return w, bias


def logistic_curve(margin: np.ndarray, good: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a * margin + b))) by Newton steps on the smoothed labels."""
    hi, lo = (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2)
    target = np.where(good, hi, lo)
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, v = p - target, p * (1 - p) + 1e-9
        grad = np.array([(d * margin).sum(), d.sum()])
        hess = np.array([[(v * margin**2).sum() + 1e-6, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-6), float(b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> dict:
    """The model: weights (float32, a slot each), bias, a and b of the curve."""
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("label"))
    marks = stored(marks, "quality-marks")
    if marks.count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    rows = docs.select(F.col(id_col).alias("__doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(marks, F.col("__doc") == F.col("__id"))
    rows = stored(rows.select("__doc", "label", "text"), "quality-labelled")
    counts = rows.select("label", "text").mapInArrow(_class_counts, "label int, slot int, n long").groupBy("label", "slot").agg(F.sum("n").alias("n"))  # at most 2 * SIZE + 2 rows
    counts = stored(counts, "quality-counts")
    n = {r["label"]: r["n"] for r in counts.where("slot < 0").select("label", "n").collect()}
    if not n.get(0) or not n.get(1):
        share = n.get(1, 0) / sum(n.values()) if sum(n.values()) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return {"weights": np.zeros(SIZE, np.float32), "bias": 0.0, "a": 1.0, "b": float(np.log(share / (1 - share)))}

    order = F.xxhash64(F.lit(seed), "__doc")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    share = min(1.0, 1.1 * sample_rows / sum(n.values()), SAMPLE_BYTES / max(1, size))
    picked = rows.where(F.pmod(order, F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("label", order.alias("order"), "text")
    sample = stored(picked.mapInArrow(_sampled_features, "label int, order long, slots binary"), "quality-sample").withColumn("one", F.lit(0))
    fitted = sample.groupBy("one").cogroup(counts.withColumn("one", F.lit(0)).groupBy("one")).applyInArrow(_fitted(sample_rows), "weights binary, bias double, a double, b double").first()
    return {"weights": np.frombuffer(fitted["weights"], np.float32), "bias": fitted["bias"], "a": fitted["a"], "b": fitted["b"]}


def _fitted(sample_rows: int):
    def run(key: tuple, sample: pa.Table, counts: pa.Table) -> pa.Table:
        """The model of the sampled rows (label, order, slots) and the counts (label, slot, n) of all rows."""
        table = np.ones((2, SIZE))
        label, slot = np.asarray(counts.column("label")), np.asarray(counts.column("slot"))
        table[label[slot >= 0], slot[slot >= 0]] += np.asarray(counts.column("n"))[slot >= 0]
        q, p = table
        ratio = np.log(p / p.sum()) - np.log(q / q.sum())
        ratio[table.sum(0) < 4] = 0.0
        sample = sample.sort_by([("order", "ascending"), ("label", "ascending"), ("slots", "ascending")]).slice(0, sample_rows)
        texts = [np.frombuffer(x.as_py(), np.int32) for x in sample.column("slots")]
        y = np.where(np.asarray(sample.column("label")) == 1, 1.0, -1.0)
        held = np.arange(len(y)) % 5 == 4
        scale = ratio / np.sqrt(np.mean([float((ratio[t] ** 2).sum()) for t in texts]) + 1e-12)
        train = np.flatnonzero(~held)
        balance = {c: len(train) / (2 * max(1, (y[train] == c).sum())) for c in (-1.0, 1.0)}
        w, bias = dual_descent([texts[i] for i in train], y[train], scale, np.array([COST * balance[y[i]] for i in train]))
        weights = w * scale
        unseen = np.flatnonzero(held) if held.any() else train
        margin = np.array([float(weights[texts[i]].sum()) + bias for i in unseen])
        a, b = logistic_curve(margin, y[unseen] > 0)
        return pa.table({"weights": [weights.astype(np.float32).tobytes()], "bias": [float(bias)], "a": [a], "b": [b]})

    return run


def score(docs: DataFrame, model: dict, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with a column out_col, 0 to 1; all other columns are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**FEATURE_BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in in_slices(batches, text_col, 1 << 20):
            slots, first = features(batch.column(text_col))
            sums = np.concatenate([[0.0], np.cumsum(m["weights"][slots], dtype=np.float64)])
            margin = sums[first[1:]] - sums[first[:-1]] + m["bias"]
            p = 1 / (1 + np.exp(-np.clip(np.round(m["a"] * margin + m["b"], 6), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, out_col])

    if out_col in docs.columns:
        raise ValueError(f"docs has a column {out_col} already; choose another out_col")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, train: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs that the model accepts (score at or above threshold), with their own columns."""
    model = fit(docs if train is None else train, labels)
    out = free_name(docs, "quality_score")
    return score(docs, model, out_col=out).where(F.col(out) >= threshold).drop(out)
