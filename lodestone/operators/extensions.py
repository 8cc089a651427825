"""Where a user puts own models: search providers, rerankers, verifiers, heading patches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import bm25, dense_top_k, top_by


class Provider(Protocol):
    """A channel of retrieval: queries in, (query, item, rank, score) out, for all queries at once."""

    def search(self, queries: DataFrame, k: int) -> DataFrame: ...


class FullText:
    """BM25 over tokens, as a channel."""

    def __init__(self, docs: DataFrame, doc: str, query: str, tokens: Callable[[str], Column], text: str = "text", only: DataFrame | None = None):
        self.docs, self.doc, self.query, self.tokens, self.text, self.only = docs, doc, query, tokens, text, only

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        found = bm25(queries, self.docs, self.query, self.tokens(self.text), self.doc, self.tokens(self.text), k, self.only)
        return found.select(F.col(self.query).alias("query"), F.col(self.doc).alias("item"), "rank", "score")


class Dense:
    """Exact cosine similarity, as a channel."""

    def __init__(self, rows: DataFrame, id_col: str, vector: str):
        self.rows, self.id_col, self.vector = rows, id_col, vector

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        found = dense_top_k(self.rows, queries, self.id_col, self.vector, k)
        return found.select(F.col("query_id").alias("query"), "item", "rank", F.col("similarity").alias("score"))


class Scorer(Protocol):
    """Scores pairs of texts. It is sent to the executors, so it holds a path or small weights; load() runs once a task."""

    def load(self) -> None: ...

    def score(self, questions: list[str], passages: list[str]) -> np.ndarray: ...


class SharedWords:
    """The share of a question's words that a passage has: a scorer that needs no model."""

    def load(self) -> None:
        pass

    def score(self, questions: list[str], passages: list[str]) -> np.ndarray:
        def share(a: set[str], b: set[str]) -> float:
            return len(a & b) / len(a) if a else 0.0

        return np.array([share(set(q.lower().split()), set(p.lower().split())) for q, p in zip(questions, passages, strict=True)], dtype=float)


#: Pairs that a scorer gets at once.
PAIRS = 512


def scored_in_slices(scorer: Scorer, questions: pd.Series, passages: pd.Series) -> pd.Series:
    """Scores of a batch, PAIRS at a time: what a scorer makes of its texts doesn't grow with Spark's batches."""
    cuts = range(0, len(questions), PAIRS)
    scores = [scorer.score(questions[i : i + PAIRS].fillna("").tolist(), passages[i : i + PAIRS].fillna("").tolist()) for i in cuts]
    return pd.Series(np.concatenate(scores) if scores else [], dtype="float64")


def reranked(candidates: DataFrame, query: str, item: str, question: str, passage: str, scorer: Scorer, k: int, heading: str | None = None) -> DataFrame:
    """The k best candidates of each query by a scorer of question and passage, ties to the smaller item. A heading goes
    before its passage. Candidates stay where they are; only scores are shuffled."""

    @F.pandas_udf("double")
    def scores(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer.load()
        for q, p in parts:
            yield scored_in_slices(scorer, q, p)

    text = F.col(passage) if heading is None else F.concat_ws("\n", heading, passage)
    scored = candidates.select(query, item, scores(F.col(question), text).alias("score"))
    return top_by(scored, [query], [F.col("score").desc(), F.col(item)], k)


def verified(claims: DataFrame, claim: str, evidence: str, verifier: Scorer | None, threshold: float = 0.5) -> DataFrame:
    """Adds verdict: supported or refuted by a scorer; unknown where there is none, so nothing passes unchecked."""
    if verifier is None:
        return claims.withColumn("verdict", F.lit("unknown"))

    @F.pandas_udf("double")
    def support(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        verifier.load()
        for c, e in parts:
            yield scored_in_slices(verifier, c, e)

    value = support(F.col(claim), F.col(evidence))
    return claims.withColumn("verdict", F.when(value >= threshold, "supported").otherwise("refuted"))


def patched(chunks: DataFrame, patch: Callable[[DataFrame], DataFrame], id_col: str, fixed: list[str]) -> DataFrame:
    """patch(chunks), which may change all but the fixed columns of a chunk. A chunk that is changed there, dropped, doubled
    or added is an error at run time: both sides are counted by id and met in a full join."""
    mark = F.xxhash64(*fixed)
    before = chunks.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_n"), F.sum(mark.cast("decimal(38,0)")).alias("_sum"))
    after = patch(chunks)
    rows = after.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_m"), F.sum(mark.cast("decimal(38,0)")).alias("_total"), F.collect_list(F.struct(*after.columns)).alias("_rows"))
    met = before.join(rows, "_id", "full")
    fault = F.when(F.col("_m").isNull(), "dropped").when(F.col("_n").isNull(), "added").when(F.col("_m") > F.col("_n"), "doubled").when(F.col("_m") < F.col("_n"), "dropped").when(F.col("_sum") != F.col("_total"), "changed")
    whole = F.when(fault.isNull(), F.col("_rows")).otherwise(F.raise_error(F.concat(F.lit("patch "), fault, F.lit(" "), F.col("_id").cast("string"))))
    return met.select(F.explode(whole).alias("_r")).select("_r.*")
