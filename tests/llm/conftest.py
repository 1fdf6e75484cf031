import random

import pytest


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def corpus(seed=0, n=60):
    """Texts with exact copies, near copies, a shared passage, empty, null, very long and odd ones."""
    rng = random.Random(seed)
    texts = [words(rng, rng.randrange(20, 200), 5000) for _ in range(n)]
    texts += [texts[0], texts[0], texts[1]]
    near = texts[2].split()
    for i in range(6):
        t = list(near)
        t[(i * 7) % len(t)] = f"edit{i}"
        texts.append(" ".join(t))
    passage = words(rng, 60, 5000)
    texts += [f"{words(rng, 30, 5000)}\n{passage}  {words(rng, 30, 5000)}" for _ in range(3)]
    texts += ["", None, None, "   \t\n ", "one", "a a a a " * 30, words(rng, 9000, 9000), "ÀÉ ß  x \U0001f600 text", "z" * 100_000]
    return texts


@pytest.fixture(scope="session")
def docs(spark):
    texts = corpus()
    rows = [(i, t, ["src0", "src1", "src2", None][i % 4] if i % 3 else "src0", "clash", i) for i, t in enumerate(texts)]
    rows.append(rows[5])  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key string, size int").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
