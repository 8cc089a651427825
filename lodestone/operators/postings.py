"""Postings in blocks of falling impact with the block's greatest, and exact top-k search that reads only what can matter."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import fingerprint, staged
from .ranking import K1, B, top_by

#: Postings of a block. Terms of a query whose first blocks give the first bound.
BLOCK, PROBES = 128, 8
#: Words that are counted at once.
WORDS = 100_000
#: Scores are rounded to 9 places, so a bound is kept so far below the score it stands for.
SLACK = 1e-8


@dataclass
class Index:
    """Staged tables of one corpus: parts (doc, term, part), blocks (term, top, docs, parts) and terms (term, df, top, head).

    part is what a term gives a document's score before the term's weight; top is the greatest part of a block or a term;
    head is a term's first block.
    """

    parts: DataFrame
    blocks: DataFrame
    terms: DataFrame
    n_docs: int


def blocks_of(parts: DataFrame) -> DataFrame:
    """Blocks of at most BLOCK postings of one term, greatest parts first. Rows are sorted by range of term and part, so a
    term of any length is spread over tasks; a block ends where a task's batch ends."""
    kind = parts.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            term = b.column(0).dictionary_encode().indices.to_numpy()
            new = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
            place = np.arange(len(b)) - np.repeat(new, np.diff(np.r_[new, len(b)]))
            first = np.flatnonzero(place % BLOCK == 0)
            ends = pa.array(np.r_[first, len(b)], pa.int32())
            at = pa.array(first)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.ListArray.from_arrays(ends, b.column(2)), pa.ListArray.from_arrays(ends, b.column(1))], ["term", "top", "docs", "parts"])

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("term"), F.col("part").desc(), F.col("doc")]
    rows = parts.select("term", "part", "doc").repartitionByRange(n, *order).sortWithinPartitions(*order)
    return rows.mapInArrow(run, f"term string, top double, docs array<{kind}>, parts array<double>")


def counts_of(split: DataFrame) -> DataFrame:
    """(doc, term, tf, length) of each row's words, counted where the row is: no shuffle. A batch is counted in slices of
    WORDS words, or of one row that has more, so memory beyond Spark's batch doesn't grow with the texts."""
    kind = split.schema["doc"].dataType.simpleString()

    def counted(b: pa.RecordBatch) -> pa.RecordBatch:
        words = b.column(1)
        flat = words.flatten().dictionary_encode()
        codes = flat.indices.to_numpy()
        length = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        n = max(len(flat.dictionary), 1)
        key, tf = np.unique(np.repeat(np.arange(len(b)), length) * n + codes, return_counts=True)
        row = pa.array(key // n)
        return pa.RecordBatch.from_arrays([b.column(0).take(row), flat.dictionary.take(pa.array(key % n)), pa.array(tf), pa.array(length[key // n])], ["doc", "term", "tf", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, stop in slices_of(pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False), WORDS):
                yield counted(b.slice(at, stop - at))

    return split.mapInArrow(run, f"doc {kind}, term string, tf long, length long")


def slices_of(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows whose sizes add up to `most` at most; a row of more is alone."""
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        stop = max(int(np.searchsorted(ends, before + most, "right")), at + 1)
        yield at, stop
        at = stop


def indexed(docs: DataFrame, doc: str, words: Column) -> Index:
    """The index of documents by BM25; words: an array of a document's index words, repeats and all.

    Words are split and counted in one pass, and sorted once. A document whose id repeats scores the sum of its rows; a
    null id or text has no postings, but counts in the statistics.
    """
    split = docs.select(F.col(doc).alias("doc"), words.alias("words"))
    tf = staged(counts_of(split), "tf")
    n_docs, n_words = docs.count(), tf.agg(F.sum("tf")).first()[0]
    mean = (n_words or 0) / max(n_docs, 1) or 1.0
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
    parts = tf.where("doc IS NOT NULL").select("doc", "term", part.alias("part"))
    blocks = staged(blocks_of(parts), "blocks")
    terms = staged(blocks.groupBy("term").agg(F.sum(F.size("docs")).alias("df"), F.max("top").alias("top"), F.max(F.struct("top", "docs", "parts")).alias("head")), "terms")
    return Index(parts, blocks, terms, n_docs)


def idf(df: Column, n_docs: int) -> Column:
    return F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5)), F.lit(1e-6))


def bounded(index: Index, wanted: DataFrame, query: str, k: int, only: DataFrame | None = None) -> DataFrame:
    """(query, term, idf, most, tau, rest, theta): what of each query term's list has to be read.

    The first blocks of a query's rarest terms give k documents a score each, and so a bound theta that the k-th best
    surely reaches. Of the terms, the commonest first, as many are left out as can together not lift a document to
    theta; the term that crosses it is read down to tau. `rest` is the most that terms not read in full can add.
    """
    own = Window.partitionBy(query)
    known = index.terms.select("term", "df", "top")
    terms = wanted.join(known, "term").withColumn("idf", idf(F.col("df"), index.n_docs)).withColumn("most", F.col("idf") * F.col("top"))
    probes = top_by(terms, [query], [F.col("idf").desc(), F.col("term")], PROBES, "_probe").select(query, "term", "idf")
    heads = probes.join(index.terms.select("term", F.arrays_zip("head.docs", "head.parts").alias("head")), "term")
    seen = heads.select(query, "idf", F.explode("head").alias("p")).select(query, F.col("p.docs").alias("doc"), (F.col("idf") * F.col("p.parts")).alias("s"))
    seen = seen if only is None else seen.join(only, "doc", "left_semi")
    sums = seen.groupBy(query, "doc").agg(F.sum("s").alias("s"))
    theta = top_by(sums, [query], [F.col("s").desc(), F.col("doc")], k).groupBy(query).agg(F.when(F.count(F.lit(1)) == k, F.min("s") - SLACK).alias("theta"))
    terms = terms.join(theta, query, "left").withColumn("theta", F.greatest(F.coalesce("theta", F.lit(0.0)), F.lit(0.0)))
    before = F.coalesce(F.sum("most").over(own.orderBy(F.col("df").desc(), "term").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    terms = terms.withColumn("before", before)
    tau = F.when(F.col("before") + F.col("most") <= F.col("theta"), F.col("most")).when(F.col("before") < F.col("theta"), F.col("theta") - F.col("before")).otherwise(0.0)
    terms = terms.withColumn("tau", tau)
    rest = F.coalesce(F.sum(F.when(F.col("tau") > 0, F.col("most"))).over(own), F.lit(0.0))
    return terms.withColumn("rest", rest).select(query, "term", "idf", "most", "tau", "rest", "theta")


def read_blocks(index: Index, plan: DataFrame) -> DataFrame:
    """The blocks that a plan reads, one row for each query and block."""
    return plan.where("tau < most").join(index.blocks, "term").where(F.col("idf") * F.col("top") > F.col("tau"))


def search(index: Index, queries: DataFrame, query: str, query_words: Column, k: int, only: DataFrame | None = None) -> DataFrame:
    """(query, doc, score, rank): the k documents of highest BM25 score of each query, ties to the smaller document.

    Exact: a document that no block read holds scores at most theta. `only` (doc) is applied before the k best are
    taken. Documents found are scored by the lists read in full, dropped where even all the rest can't lift them to the
    k-th best such sum, and completed from the parts of the few that are left. Repeated words of a query count once; a query
    that repeats its id counts as one of all their words; a query without known words has no rows.
    """
    wanted = queries.select(query, F.explode(F.array_distinct(query_words)).alias("term")).distinct()
    plan = staged(bounded(index, wanted, query, k, only), "reading")
    hits = read_blocks(index, plan).select(query, "idf", "tau", F.explode(F.arrays_zip("docs", "parts")).alias("p"))
    hits = hits.select(query, F.col("p.docs").alias("doc"), F.when(F.col("tau") == 0, F.col("idf") * F.col("p.parts")).otherwise(0.0).alias("s"))
    hits = hits if only is None else hits.join(only, "doc", "left_semi")
    found = staged(hits.groupBy(query, "doc").agg(F.sum("s").alias("s")), "found")
    # The k-th best of these sums, each at most the document's score, is a second and mostly higher bound.
    kth = top_by(found, [query], [F.col("s").desc(), F.col("doc")], k, "_place").groupBy(query).agg(F.when(F.count(F.lit(1)) == k, F.min("s") - SLACK).alias("kth"))
    limits = plan.groupBy(query).agg(F.max("rest").alias("rest"), F.max("theta").alias("theta")).join(kth, query, "left")
    limits = limits.select(query, (F.greatest("theta", F.coalesce("kth", F.lit(0.0))) - F.col("rest") - SLACK).alias("least"))
    found = staged(found.join(limits, query).where("s >= least").select(query, "doc", "s"), "left")
    left = found.select(query, "doc").join(plan.where("tau > 0").select(query, "term", "idf"), query)
    more = left.join(index.parts, ["doc", "term"]).select(query, "doc", (F.col("idf") * F.col("part")).alias("s"))
    scores = found.unionByName(more).groupBy(query, "doc").agg(F.round(F.sum("s"), 9).alias("score"))
    return top_by(scores, [query], [F.col("score").desc(), F.col("doc")], k)


def reading(index: Index, queries: DataFrame, query: str, query_words: Column, k: int) -> DataFrame:
    """(query, n_read, n_all): postings that search() reads for each query, and those of all its terms."""
    wanted = queries.select(query, F.explode(F.array_distinct(query_words)).alias("term")).distinct()
    plan = staged(bounded(index, wanted, query, k), "reading")
    whole = wanted.join(index.terms, "term").groupBy(query).agg(F.sum("df").alias("n_all"))
    some = read_blocks(index, plan).groupBy(query).agg(F.sum(F.size("docs")).alias("n_read"))
    return whole.join(some, query, "left").select(query, F.coalesce("n_read", F.lit(0)).alias("n_read"), "n_all")


_BUILT: dict[tuple, Index] = {}


def shared(docs: DataFrame, doc: str, words: Column, name: str) -> Index:
    """The index of a table of files, built once a session for each state of its files; name: of the rule for words."""
    key = docs.sparkSession.sparkContext.applicationId, name, fingerprint(docs)
    if key not in _BUILT:
        for old in [k for k in _BUILT if k[0] != key[0]]:  # of sessions that have ended
            del _BUILT[old]
        _BUILT[key] = indexed(docs, doc, words)
    return _BUILT[key]
