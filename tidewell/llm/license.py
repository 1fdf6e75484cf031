"""License scans with a positional index of rare words.

The words of the licence texts, but for those in many places of them, form a positional index: word -> (template,
position). All of a file's words of that index are looked up; each hit votes for the place where its template would begin.
Intersecting postings by relative position is then finding places, equal but for SLACK words that were put in or left
out, whose votes reach MIN_SCORE of the template's weight; words weigh by their inverse document frequency, and each
word of a template counts once. A template counts when all its mandatory phrases stand where that place puts them, within
SLACK. Votes are counted within the row, so that no text is shuffled. Phrases of the caller (``PHRASES``) count wherever
their words stand consecutively.

Only the fixed templates and phrases, and the document frequencies of their words, are held by every task.
Defined results: a null or empty text has no words, no labels and score 0; equal texts have equal results; repeated
rows stay repeated; words of equal frequency are all looked up, so that ties play no part; an empty table gives an empty
result; further columns play no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored
from .license_texts import TEXTS

#: Between words: ASCII but for digits and letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases with their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: (text in lower-case words, label, mandatory phrases)
TEMPLATES = tuple((" ".join(w for w in re.split(NOT_WORD, text.lower()) if w), label, phrases) for label, phrases, text in TEXTS)
#: Of the words of a template those that stand in the fewest places of all of them are indexed: every word with MOST_PLACES
#: at most, and at least LEAST_WORDS of its words.
MOST_PLACES, LEAST_WORDS = 12, 4
MIN_SCORE, SLACK = 0.5, 12


def indexed_words(templates=TEMPLATES) -> list[tuple[str, int, int]]:
    """(word, template, position) of the index."""
    places = Counter(w for t, _, _ in templates for w in t.split())
    found = []
    for t, (text, _, _) in enumerate(templates):
        words = text.split()
        most = max(MOST_PLACES, sorted(places[w] for w in words)[min(LEAST_WORDS, len(words)) - 1])
        found += [(w, t, i) for i, w in enumerate(words) if places[w] <= most]
    return found


def _ascii_lower(word: Column) -> Column:
    return F.translate(word, UPPER, LOWER)


def _anchor(words: list[str]) -> int:
    """Where the longest word of a phrase stands: the one that is looked up."""
    return max(range(len(words)), key=lambda i: (len(words[i]), -i))


def _places(phrase: list[str]) -> Column:
    """Where the words of phrase stand one after the other; looked for at the hits of its anchor."""
    a, whole = _anchor(phrase), F.array(*[F.lit(w) for w in phrase])

    def stands(h):
        here = F.slice("words", F.greatest(h.p - a + 1, F.lit(1)), len(phrase))
        return (h.w == phrase[a]) & (h.p >= a) & (F.transform(here, _ascii_lower) == whole)

    return F.transform(F.filter("hits", stands), lambda h: h.p - a)


def hits(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, text_col: str = "text") -> DataFrame:
    """Adds n_words, hits (array of position and indexed word), phrase_i, arrays of the places where the i-th phrase stands,
    and mandatory, an array of those arrays for all mandatory phrases. One pass over the texts, no shuffle."""
    keys = mandatory(templates)
    listed = [p.split() for p, _ in phrases] + [m.split() for m in keys]
    indexed = sorted({w for w, _, _ in indexed_words(templates)} | {w[_anchor(w)] for w in listed})
    words = F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), NOT_WORD), "")
    df = docs.withColumn("words", words)
    found = F.transform("words", lambda w, i: F.when(F.lower(w).isin(indexed), F.struct(i.alias("p"), _ascii_lower(w).alias("w"))))
    df = df.withColumn("n_words", F.size("words").cast("long")).withColumn("hits", F.array_compact(found))
    df = df.withColumn("hits", F.filter("hits", lambda h: h.w.isin(indexed)))
    for i in range(len(phrases)):
        df = df.withColumn(f"phrase_{i}", _places(listed[i]))
    none = F.array().cast("array<array<int>>")
    standing = F.array(*[_places(m) for m in listed[len(phrases) :]]) if keys else none
    return df.withColumn("mandatory", F.when(F.size("hits") > 0, standing).otherwise(none)).drop("words")


def mandatory(templates=TEMPLATES) -> list[str]:
    """All mandatory phrases, each once."""
    return sorted({m for _, _, phrases in templates for m in phrases})


def _matches(index: list[tuple], weight: list[float], templates) -> Column:
    """Array of (template, score) of the templates that the columns hits and mandatory hold."""
    by_word: dict[str, list[Column]] = {}
    for w, t, i, idf in index:
        by_word.setdefault(w, []).append(F.struct(F.lit(t).alias("t"), F.lit(i).alias("at"), F.lit(idf).alias("idf")))
    postings = F.create_map(*[x for w, found in by_word.items() for x in (F.lit(w), F.array(*found))])
    votes = F.flatten(F.array_compact(F.transform("hits", lambda h: F.transform(F.try_element_at(postings, h.w), lambda e: F.struct(e.t.alias("t"), (h.p - e.at).alias("begins"), e.at.alias("at"), e.idf.alias("idf"))))))
    need = F.array(*[F.lit(MIN_SCORE * w) for w in weight])
    key_at = F.array(*[F.array(*[F.struct(F.lit(mandatory(templates).index(m)).alias("m"), F.lit(_offset(text, m)).alias("o")) for m in phrases]) for text, _, phrases in templates])

    def run(s, v):
        """Votes of one template that begin within SLACK words of the first of them make a run: one stretch of the sorted votes. A run is
        noted, with where it stands among the votes, once its votes suffice, and its length once it is over."""
        goes_on = (s.t == v.t) & (v.begins - s.begins <= SLACK)
        total = F.when(goes_on, s.total).otherwise(F.lit(0.0)) + v.idf
        begins, first = F.when(goes_on, s.begins).otherwise(v.begins), F.when(goes_on, s.first).otherwise(s.n)
        over = F.when(goes_on, s.found).otherwise(closed(s))
        return F.struct(v.t.alias("t"), begins.alias("begins"), total.alias("total"), first.alias("first"), (s.n + 1).alias("n"), over.alias("found"))

    def closed(s):
        """The runs found, and the last one if its votes suffice."""
        enough = (s.t >= 0) & (s.total >= F.get(need, F.greatest(s.t, F.lit(0))) - 1e-9)
        return F.when(enough, F.concat(s.found, F.array(F.struct(s.t.alias("t"), s.begins.alias("begins"), s.first.alias("first"), (s.n - s.first).alias("n"))))).otherwise(s.found)

    none = F.array().cast("array<struct<t:int,begins:int,first:int,n:int>>")
    start = F.struct(F.lit(-1).alias("t"), F.lit(0).alias("begins"), F.lit(0.0).alias("total"), F.lit(0).alias("first"), F.lit(0).alias("n"), none.alias("found"))

    def verified(all_votes):
        runs = F.aggregate(all_votes, start, run, closed)

        def score(r):
            mine = F.slice(all_votes, r.first + 1, r.n)
            once = F.array_distinct(F.transform(mine, lambda v: F.struct(v.at.alias("at"), v.idf.alias("idf"))))
            total = F.aggregate(once, F.lit(0.0), lambda s, v: s + v.idf)
            stands = F.forall(F.get(key_at, r.t), lambda k: F.exists(F.get("mandatory", k.m), lambda p: F.abs(p - k.o - r.begins) <= SLACK))
            return F.struct(r.t.alias("t"), F.when(stands, F.least(F.lit(1.0), total * MIN_SCORE / F.get(need, r.t))).otherwise(F.lit(0.0)).alias("score"))

        return F.filter(F.transform(runs, score), lambda m: m.score >= MIN_SCORE - 1e-9)

    return let(F.array_sort(votes), verified)


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of docs."""
    found = hits(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), phrases, templates, "__text")
    found = stored(found.drop("__text"), "license-hits")

    # document frequencies: a row for each indexed word at most
    seen = found.where(F.size("hits") > 0).select(F.explode(F.array_distinct(F.transform("hits", lambda h: h.w))).alias("w")).groupBy("w").count().collect()
    total, df = found.count(), {r["w"]: r["count"] for r in seen}
    index = [(w, t, i, math.log((total + 1) / (df.get(w, 0) + 0.5))) for w, t, i in indexed_words(templates)]
    weight = [sum(idf for _, of, _, idf in index if of == t) for t in range(len(templates))]
    index = [x for x in index if x[0] in df]

    none = F.array().cast("array<struct<t:int,score:double>>")
    more = F.when(F.size("hits") > 0, _matches(index, weight, templates)).otherwise(none) if index else none
    out = found.withColumn("more", more)
    label = F.array(*[F.lit(name) for _, name, _ in templates])
    starts = F.concat(*[F.col(f"phrase_{i}") for i in range(len(phrases))])
    base = F.array_compact(F.array(*[F.when(F.size(f"phrase_{i}") > 0, name) for i, (_, name) in enumerate(phrases)]))
    labels = F.array_union(base, F.transform("more", lambda m: F.get(label, m.t)))
    return out.select(
        F.col("__id").alias(id_col), "n_words", F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"), F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("more", lambda m: m.score)), F.lit(0.0))).alias("score"),
    )


def _offset(text: str, phrase: str) -> int:
    words, part = text.split(), phrase.split()
    return next(i for i in range(len(words)) if words[i : i + len(part)] == part)
