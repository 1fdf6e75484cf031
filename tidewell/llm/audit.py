"""Interaction audit of a chain of filters: what each filter removes in every order of the filters.

A document's failures are a mask, one bit a filter; everything the audit needs is the number of documents of each part with
each mask (2**filters cells), which Spark counts in one pass. The orders are then visited by adjacent transpositions
(Steinhaus, Johnson and Trotter): each order comes from the one before by one swap of neighbours, so only those two steps
change and only they are computed anew from the cells. Shapley totals accumulate along the walk: what a filter removes is
added, times the orders it has held for, when a swap changes it.

The filter that asks for an equal text with a smaller id (E) needs no group in one task: (id, text) rows are counted, each
text's least id is an aggregate, and the rows that are not their text's least are found by a join on id and text, which
no group of copies makes uneven.

Defined results: a null text is an empty one; a null source is the part '', as an empty one; a null id is neither smaller
nor larger than another, so its rows never fail E and have no label; rows alike, or with one id and one text, fail E only
for a smaller id; of several labels of an id any that is 1 counts; an empty table has no parts; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_key

MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, MARKS = 200, 50, 2, "#$%&*|"


def words(text: Column) -> Column:
    """Maximal runs without ASCII white space."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def text_failures(text: Column, split: Column) -> dict[str, Column]:
    """The conditions that a text alone decides, by the filter's letter; split holds its words."""
    n = F.size(split)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n < MIN_WORDS, "B": 100 * F.size(F.array_distinct(split)) < MIN_DISTINCT * n, "C": 100 * capitals > MAX_CAPITALS * F.length(text), "D": text.rlike(f"[{MARKS}]")}


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", failures: Callable = text_failures, duplicates: str = "E") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail (bit i: the i-th letter), and how many of
    them are labelled good and toxic. duplicates names the filter of equal texts, the last bit."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("split", words(F.col("text")))
    fails = failures(F.col("text"), F.col("split"))
    if duplicates in fails:
        raise ValueError(f"filter {duplicates} is there twice")
    own = sum((c.cast("int") * (1 << i) for i, c in enumerate(fails.values())), F.lit(0))
    rows = rows.select("id", "part", text_key(F.col("text")).alias("key"), own.alias("own"))
    rows = rows.groupBy("id", "key", "part", "own").agg(F.count("*").alias("n"))
    least = rows.where("id IS NOT NULL").groupBy("key").agg(F.min("id").alias("id")).withColumn("least", F.lit(True))
    rows = rows.join(least, ["id", "key"], "left").withColumn("copy", F.col("id").isNotNull() & F.col("least").isNull())
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(marks, "id", "left")
    mask = F.col("own") + F.col("copy").cast("int") * (1 << len(fails))
    some = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0))
    return rows.groupBy("part", mask.alias("mask")).agg(F.sum("n").alias("n"), some("good").alias("good"), some("toxic").alias("toxic"))


def walk(k: int) -> Iterator[tuple[list[int], int | None]]:
    """All orders of k filters, each but the first with the place of the swap that made it: places at and at + 1."""
    order, ways = list(range(k)), [-1] * k
    yield list(order), None
    while True:
        for x in range(k - 1, -1, -1):  # the largest that can move, over a smaller one
            i = order.index(x)
            j = i + ways[x]
            if 0 <= j < k and order[j] < x:
                break
        else:
            return
        order[i], order[j] = order[j], order[i]
        for y in range(x + 1, k):
            ways[y] = -ways[y]
        yield list(order), min(i, j)


def interactions(counts: np.ndarray, letters: str) -> list[tuple[str, int, np.ndarray]]:
    """(order, step, values [parts, 7]) along the walk, from counts [3 (all, good, toxic), parts, 2**filters]; values are kept,
    removed, redundant, unique_fails, good_lost, toxic_lost and the filter's Shapley total."""
    k, masks = len(letters), np.arange(1 << len(letters))
    parts = counts.shape[1]
    shapley, held_from, seen = np.zeros((k, parts), np.int64), np.zeros(k, np.int64), 0
    removed, rows, steps = np.zeros((k, parts), np.int64), [], [None] * k

    def step(order: list[int], i: int) -> np.ndarray:
        before, f = sum(1 << g for g in order[:i]), order[i]
        fails, earlier = masks >> f & 1 == 1, masks & before != 0
        lost, alone = fails & ~earlier, masks == 1 << f
        total = counts[0]
        return np.stack([total[:, ~earlier & ~fails].sum(1), total[:, lost].sum(1), total[:, fails & earlier].sum(1), total[:, alone].sum(1), counts[1][:, lost].sum(1), counts[2][:, lost].sum(1)], 1)

    for order, swap in walk(k):
        for i in range(k) if swap is None else (swap, swap + 1):
            f = order[i]
            shapley[f] += removed[f] * (seen - held_from[f])
            steps[i] = step(order, i)
            removed[f], held_from[f] = steps[i][:, 1], seen
        seen += 1
        rows += [("".join(letters[g] for g in order), i + 1, order[i], steps[i]) for i in range(k)]
    for f in range(k):
        shapley[f] += removed[f] * (seen - held_from[f])
    return [(name, i, np.concatenate([values, shapley[f][:, None]], 1)) for name, i, f, values in rows]


COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, letters: str = "ABCDE", **columns) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part, each
    order of the filters and each step."""
    k = len(letters)
    cell = lambda c, m: F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0))
    wide = cells(docs, labels, **columns).groupBy("part").agg(*[F.array(*[cell(c, m) for m in range(1 << k)]).alias(c) for c in ("n", "good", "toxic")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                some = batch.iloc[at : at + 64]
                counts = np.stack([np.stack(some[c].to_list()) for c in ("n", "good", "toxic")]).astype(np.int64)
                out = []
                for name, i, values in interactions(counts, letters):
                    out.append(pd.DataFrame({"part": some["part"].to_numpy(), "filter_order": name, "step": i} | dict(zip(COLUMNS, values.T))))
                yield pd.concat(out, ignore_index=True)

    return wide.mapInPandas(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COLUMNS))
