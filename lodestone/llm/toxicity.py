"""Toxicity by multiple-instance learning (operator 3).

A document is a bag of sentences. Each sentence has a logistic score of its distinct words and their beginnings; a document's score is the
noisy-or of its sentences' scores, 1 - prod(1 - p). Weights are learned from document labels alone, and a sentence's own
score then tells which sentences offend.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Labelled rows that training takes at most (by order of a hash of the id), and features it weighs at most.
SAMPLE_ROWS, FEATURES = 8_000, 6_000
MIN_DOCUMENTS = 5
#: Among very many features some differ by chance; this many standard errors are beyond it.
LEAST_Z = 5
#: Beginnings of a word that are features besides the word: inflected languages share stems, not words.
STEMS = (3, 4, 5, 6)
#: Words whose weights a worker remembers.
REMEMBERED = 500_000
THRESHOLD = 0.7
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W_]+")
SPANS = "array<struct<start:int,end:int,score:double>>"
SCHEMA = f"doc_id long, score double, n_sentences long, offending {SPANS}"


def features(word: str) -> list[str]:
    return [word] + [f"{word[:n]}-" for n in STEMS if len(word) > n]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def __post_init__(self):
        self.of_word: dict[str, float] = {}

    def weight(self, word: str) -> float:
        if len(self.of_word) > REMEMBERED:
            self.of_word.clear()
        found = self.of_word[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return found

    def sentences(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Spans of the sentences with a word, and their logits."""
        spans, logits = [], []
        known = self.of_word
        for m in SENTENCE.finditer(text):
            if words := WORD.findall(m[0].lower()):
                spans.append(m.span())
                logits.append(sum([known[w] if w in known else self.weight(w) for w in set(words)]))
        return spans, np.asarray(logits, float) + self.bias

    def score(self, text: str) -> tuple[float, int, list[tuple[int, int, float]]]:
        spans, z = self.sentences(text)
        if not spans:
            return 0.0, 0, []
        p = 1 / (1 + np.exp(-z))
        doc = float(-np.expm1(-np.logaddexp(0, z).sum()))
        return doc, len(spans), [(*spans[i], float(p[i])) for i in np.flatnonzero(p >= 0.5)]


def bag(text: str) -> list[set[str]]:
    return [set(w) for m in SENTENCE.finditer(text) if (w := WORD.findall(m[0].lower()))]


def feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents, and toxic ones, that have each feature, of a task's share of the sample."""
    for b in batches:
        seen, toxic = Counter(), Counter()
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = {f for w in set().union(*bag(text)) for f in features(w)}
            seen.update(found)
            if label:
                toxic.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.array([toxic[f] for f in seen], pa.int64())], ["feature", "n", "toxic"])


def encoded(vocabulary: dict[str, int]):
    """Documents as features of their sentences: flat feature numbers, and how many each sentence has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, sizes = [], []
            for text in b.column(0).to_pylist():
                ids = [[vocabulary[f] for w in s for f in features(w) if f in vocabulary] for s in bag(text)]
                flat.append([f for x in ids for f in x])
                sizes.append([len(x) for x in ids])
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(flat, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32()))], ["label", "flat", "sizes"])

    return run


def descend(y: np.ndarray, flat: np.ndarray, sizes: np.ndarray, doc: np.ndarray, k: int, rounds: int = 250, rate: float = 0.1, decay: float = 6e-5) -> np.ndarray:
    """Weights and bias (last) by Adam on the noisy-or likelihood. sizes, doc: features and document of each sentence."""
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    n = len(sizes)
    w, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    w[k] = np.log(y.mean() * len(y) / max(n, 1))
    for t in range(1, rounds + 1):
        z = np.bincount(sentence, w[flat], n) + w[k]
        total = np.bincount(doc, np.logaddexp(0, z), len(y))
        slope = np.where(y > 0, -1 / np.expm1(np.maximum(total, 1e-9)), 1.0)
        g = slope[doc] / (1 + np.exp(-z))
        grad = np.r_[np.bincount(flat, g[sentence], k), g.sum()] / len(y)
        grad[:k] += decay * w[:k]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def held_out(id_col: str = "doc_id"):
    """crc32 of the id's text leaves 1 when divided by 3; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from labelled rows outside the held-out fold.

    sample_rows bounds what is learned from: the rows first by a hash of the id. Rows with a null id, label or text
    teach nothing; an id with several labels or texts counts each of them, rows alike in id, label and text once.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("key"), (F.col(label_col) > 0).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("key"), "key", "label").limit(sample_rows)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    # Ids and hashes are put in order and cut, then the texts of these rows are fetched.
    slim = texts.join(F.broadcast(chosen), "key").select("key", "label", F.xxhash64("text").alias("hash")).distinct()
    picked = staged(slim.orderBy(F.xxhash64("key"), "key", "label", "hash").limit(sample_rows), "picked")
    rows = texts.withColumn("hash", F.xxhash64("text")).join(F.broadcast(picked), ["key", "hash"])
    sample = staged(rows.dropDuplicates(["key", "hash", "label"]).select("text", "label").repartition(16), "sample")
    n, n1 = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if n1 in (0, n):  # rows of both labels are needed to learn; without them every score is near 0
        return Model({}, -20.0)
    # The features that tell the labels apart best, by the z value of the difference of their shares.
    counts = sample.mapInArrow(feature_counts, "feature string, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where(F.col("n") >= MIN_DOCUMENTS)
    share = F.col("n") / n
    z = F.abs(F.col("toxic") / n1 - (F.col("n") - F.col("toxic")) / (n - n1)) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / n1 + 1 / (n - n1)))
    best = [r[0] for r in counts.where(z >= LEAST_Z).orderBy(F.round(z, 9).desc(), "feature").limit(FEATURES).select("feature").collect()]
    bags = sample.mapInArrow(encoded({f: i for i, f in enumerate(best)}), "label int, flat array<int>, sizes array<int>").toArrow()
    flat, sizes = (bags.column(c).combine_chunks() for c in ("flat", "sizes"))
    doc = np.repeat(np.arange(len(bags)), sizes.value_lengths().to_numpy())
    w = descend(bags.column("label").to_numpy().astype(float), flat.flatten().to_numpy(), sizes.flatten().to_numpy(), doc, len(best))
    return Model({f: float(x) for f, x in zip(best, w, strict=False)}, float(w[-1]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_sentences, offending) of every row; only the text is looked at; no shuffle.

    offending: character spans of the sentences that score 0.5 or more themselves. Null and empty texts, and texts
    without a word, score 0. Repeated rows are scored each, null ids stay null, other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES of them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for b in batches:
            found = [model.score(t) for t in b.column(1).to_pylist()]
            spans = [[{"start": a, "end": e, "score": p} for a, e, p in x[2]] for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.int64()), pa.array(spans, kind)], ["doc_id", "score", "n_sentences", "offending"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs whose text scores under the threshold, with their own columns; null texts score 0 and stay. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score_of(texts):
        import pandas as pd

        return pd.Series([shared.value.score(t)[0] if isinstance(t, str) else 0.0 for t in texts], dtype="float64")

    return docs.where(F.coalesce(score_of(F.col("text")), F.lit(0.0)) < threshold)
