"""Each stage of the pipeline against what its operator's brute-force version keeps."""

import random

from collections import Counter, defaultdict

import corpus_pipeline

from .conftest import corpus, words
from .test_sources_and_shards import check_shards, count, targets
from .test_text_operators import classes_of, similarity, split


def test_pipeline(spark, tmp_path):
    rng = random.Random(2)
    texts = corpus(5, 80)
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    n = len(rows)
    rows += [(n + i, words(rng, 40).replace("x", "$$$"), "en", "src1", 1) for i in range(60)]
    item = words(rng, 30, 5000)
    rows += [(500, f"{words(rng, 50, 5000)} {item} {words(rng, 50, 5000)}", "en", "src2", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < n), 0) for i in range(n + 60) if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        kept[name] = docs.collect()
        if name != "sharding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {k: [r.doc_id for r in v] for k, v in kept.items()}
    # each stage against a plain version of it, on its own input
    classes = classes_of([(r.doc_id, r.text) for r in kept["quality classifier"]])
    assert sorted(ids["near duplicates"]) == sorted(set(classes.values()))
    v = item.split()
    like = lambda w: any(similarity(w[s : s + len(v)], v) >= 0.8 for s in range(max(1, len(w) - len(v) + 1)) if w)
    assert sorted(ids["decontamination"]) == sorted(r.doc_id for r in kept["near duplicates"] if not like([x.lower() for x in split(r.text)]))
    sizes, taken, most, times = defaultdict(int), defaultdict(int), defaultdict(int), Counter(ids["mixing"])
    for r in kept["decontamination"]:
        sizes[r.source] += count(r.text)
        taken[r.source] += count(r.text) * times[r.doc_id]
        most[r.source] = max(most[r.source], count(r.text))
    assert all(abs(taken[s] - t) <= most[s] for s, t in targets(sizes).items()) and max(times.values()) <= 3
    check_shards(kept["sharding"], len(kept["mixing"]), 24)
    assert not [i for i in ids["quality classifier"] if n <= i < n + 60] and len(set(range(n)) - set(ids["quality classifier"])) <= 12
    assert len(ids["near duplicates"]) == len(set(ids["near duplicates"])) < len(ids["quality classifier"])
    assert set(ids["near duplicates"]) - set(ids["decontamination"]) == {500} & set(ids["near duplicates"])
    assert set(ids["mixing"]) <= set(ids["decontamination"]) and sorted(ids["mixing"]) == sorted(ids["sharding"])
    assert {r.shard for r in kept["sharding"]} <= set(range(24))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids["sharding"])


def test_pipeline_of_empty_tables_and_of_nulls(spark, tmp_path):
    """Empty tables give empty results; nulls in any column, rows alike and very long words go through every stage."""
    docs, labels, benchmark = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int", "item_id long, text string"

    def put(name, documents, marks, items):
        spark.createDataFrame(documents, docs).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(marks, labels).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame(items, benchmark).write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        return corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()

    assert put("empty", [], [], []) == []
    rng = random.Random(3)
    rows = [(None, None, None, None, None), (1, words(rng, 30), None, None, None), (None, words(rng, 30), "en", "a", 1), (2, "", "en", "a", 0), (3, "x" * 60_000, "en", "a", 1), (4, words(rng, 30), "en", "b", 1)]
    rows += [rows[1], rows[5], rows[0]]
    out = put("nulls", rows, [(None, 1, None), (1, None, 0)], [(None, None), (7, "")])
    kept = Counter((r.doc_id, r.text) for r in out)
    assert set(kept) <= {(r[0], r[1]) for r in rows} and (4, rows[5][1]) in kept and max(kept.values()) <= 3
