"""Keyphrases against every phrase of every document counted."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph


@pytest.fixture(scope="module")
def corpus():
    random.seed(5)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    docs = [(i, random.choices(words, [1 / (j + 1) for j in range(60)], k=random.randrange(0, 30))) for i in range(200)]
    return docs + [(300 + i, words[50:58]) for i in range(70)] + [(400, None), (401, [])]


def by_all_phrases(docs, most, k):
    df = Counter()
    for _, w in docs:
        w = w or []
        df.update({tuple(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)})
    rows = [(" ".join(p), n, (1 + 0.25 * (len(p) - 1)) * n) for p, n in df.items() if n >= 2]
    return sorted(rows, key=lambda r: (-r[2], -len(r[0]), r[0]))[:k]


@pytest.mark.parametrize("frequent", [500_000, 0, 12])
@pytest.mark.parametrize("k", [1, 20, 100_000])
def test_keyphrases_are_exact(spark, corpus, monkeypatch, frequent, k):
    monkeypatch.setattr(graph, "MOST_FREQUENT", frequent)
    docs = spark.createDataFrame(corpus, "id long, words array<string>")
    assert list(map(tuple, graph.keyphrases(docs, "id", F.col("words"), 5, k).collect())) == by_all_phrases(corpus, 5, k)


def test_only_runs_of_frequent_ones_are_counted(spark):
    """Every run of up to five words was shuffled."""
    docs = spark.createDataFrame([(1, ["a", "b", "c", "a", "b"]), (2, ["a", "b", "d"])], "id long, words array<string>")
    hashed = docs.select("id", graph.word_numbers(F.col("words")).alias("words"))
    known = spark.createDataFrame([("a",), ("b",)], "w string").select(graph.gram_number([F.xxhash64("w")]).alias("number"))
    assert [r.df for r in graph.counted_grams(hashed, "id", 2, known).collect()] == [2]
    assert graph.counted_grams(hashed, "id", 2, None).count() == 4
