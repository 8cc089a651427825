"""Search over blocks of postings against every document scored."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import postings, ranking


@pytest.fixture(scope="module")
def corpus():
    random.seed(11)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, random.choices(words, weights, k=random.randrange(1, 60))) for i in range(1500)]
    docs += [(2000 + i, ["w5", "w7", "w7"]) for i in range(400)] + [(3000, []), (3001, None), (None, ["w1", "w250"])]
    asked = [(i, random.choices(words, weights, k=random.randrange(1, 15))) for i in range(40)] + [(90, ["unknown"]), (91, []), (92, None), (93, ["w7", "w7", "w5"])]
    return docs, asked


def by_all_documents(docs, asked, k, only=None):
    n, mean = len(docs), sum(len(w or []) for _, w in docs) / len(docs)
    df = Counter(t for i, w in docs if i is not None for t in set(w or []))
    out = []
    for q, terms in asked:
        scores = {}
        for i, w in docs:
            if i is None or (only is not None and i not in only):
                continue
            tf = Counter(w or [])
            s = sum(max(math.log((n - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in set(terms or []) if tf[t])
            if s:
                scores[i] = round(s, 9)
        out += [(q, i, r + 1) for r, (i, _) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return sorted(out)


@pytest.mark.parametrize("block,probes", [(128, 8), (7, 2)])
def test_search_is_exact(spark, corpus, monkeypatch, block, probes):
    monkeypatch.setattr(postings, "BLOCK", block)
    monkeypatch.setattr(postings, "PROBES", probes)
    docs, asked = corpus
    index = postings.indexed(spark.createDataFrame(docs, "id long, words array<string>"), "id", F.col("words"))
    queries = spark.createDataFrame(asked, "q long, words array<string>")
    for k in (1, 10, 5000):
        got = postings.search(index, queries, "q", F.col("words"), k).select("q", "doc", "rank").collect()
        assert sorted(map(tuple, got)) == by_all_documents(docs, asked, k)
    only = set(range(0, 1500, 13)) | {2003}
    allowed = spark.createDataFrame([(i,) for i in only], "doc long")
    got = postings.search(index, queries, "q", F.col("words"), 5, allowed).select("q", "doc", "rank").collect()
    assert sorted(map(tuple, got)) == by_all_documents(docs, asked, 5, only)
    read = postings.reading(index, queries, "q", F.col("words"), 3).agg(F.sum("n_read"), F.sum("n_all")).first()
    assert 0 < read[0] < 0.5 * read[1]


def test_empty_corpus(spark):
    index = postings.indexed(spark.createDataFrame([], "id long, words array<string>"), "id", F.col("words"))
    assert postings.search(index, spark.createDataFrame([(1, ["a"])], "q long, words array<string>"), "q", F.col("words"), 3).count() == 0


def test_blocks_of_data_spread_over_parts(spark):
    rows = spark.range(60_000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    seen = {}

    def join(self, other, *a, f=type(rows).join, **b):
        if "salt" in self.columns and not seen:
            seen.update(self.groupBy("salt").count().collect())
        return f(self, other, *a, **b)

    kind, old = type(rows), type(rows).join
    kind.join = join
    try:
        top = ranking.dense_top_k(rows, rows.where("vec_id = 500"), "vec_id", "embedding", 2).collect()
    finally:
        kind.join = old
    assert len(seen) > 5 and len(top) == 2


def test_auc_by_parts_equals_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(float(x), int(y)) for x, y in zip(rng.integers(0, 40, 500), rng.integers(0, 2, 500), strict=True)]
    got = ranking.rank_auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert math.isclose(got["auc"], sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)), abs_tol=1e-8)


def test_words_are_counted_in_slices(spark, monkeypatch):
    """A batch of 10,000 texts was counted at once, which took a Python worker's memory."""
    assert list(postings.slices_of(np.array([3, 0, 4, 9, 2, 2, 0]), 5)) == [(0, 2), (2, 3), (3, 4), (4, 7)]
    assert list(postings.slices_of(np.array([], np.int64), 5)) == []
    monkeypatch.setattr(postings, "WORDS", 4)
    docs = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (None, ["c"]), (4, ["d"] * 20000 + ["", "ß"]), (5, ["a"])], "doc long, words array<string>").coalesce(1)
    counts = list(map(tuple, postings.counts_of(docs).collect()))
    assert set(counts) == {(1, "a", 1, 3), (1, "b", 2, 3), (None, "c", 1, 1), (4, "d", 20000, 20002), (4, "", 1, 20002), (4, "ß", 1, 20002), (5, "a", 1, 1)} and len(counts) == 7
