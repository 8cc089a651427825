"""Phrases, co-occurrence and neighbours of terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources.tables import spread, staged
from .ranking import top_by


def ngrams(tokens: Column, most: int) -> Column:
    """All runs of 1 to `most` tokens, joined by spaces."""
    def runs(words: Column, width: int) -> Column:
        last = F.size(words) - (width - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, width), " "))).otherwise(F.array().cast("array<string>"))

    return let(tokens, lambda words: F.concat(*[runs(words, w) for w in range(1, most + 1)]))


def word_numbers(tokens: Column) -> Column:
    """The hash of each token, in their order."""
    return F.transform(tokens, lambda w: F.xxhash64(w))


def gram_number(parts: list[Column]) -> Column:
    """The number of a run of tokens by their hashes: 61 bits of a hash, and the width in the lowest 3."""
    return F.shiftleft(F.xxhash64(*parts), 3).bitwiseOR(F.lit(len(parts)).cast("long"))


def grams_of(words: Column, width: int) -> Column:
    """Distinct (number, head, tail) of all runs of `width` words: their number and those of the runs one shorter that they
    begin and end with."""
    def gram(i: Column) -> Column:
        parts = [F.get(words, i + j) for j in range(width)]
        shorter = [gram_number(parts[:-1]).alias("head"), gram_number(parts[1:]).alias("tail")] if width > 1 else []
        return F.struct(gram_number(parts).alias("number"), *shorter)

    kind = "array<struct<number:bigint,head:bigint,tail:bigint>>" if width > 1 else "array<struct<number:bigint>>"
    runs = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - width), gram))
    # Equal ones are neighbours once sorted; array_distinct would compare all with all.
    new = let(runs, lambda r: F.filter(r, lambda x, i: (i == 0) | (x["number"] != F.get(r, i - 1)["number"])))
    return F.when(F.size(words) >= width, new).otherwise(F.array().cast(kind))


def counted_grams(hashed: DataFrame, doc: str, width: int, frequent: DataFrame | None) -> DataFrame:
    """(number, df, in): documents of each run of `width` words, and one of them; with `frequent` (number), a bounded table,
    only of runs that begin and end with one of it. What is left is summed up before the shuffle."""
    grams = hashed.select(doc, F.explode(grams_of(F.col("words"), width)).alias("g")).select(doc, "g.*")
    if frequent is not None:
        for side in ("head", "tail"):
            grams = grams.join(F.broadcast(frequent.select(F.col("number").alias(side))), side, "left_semi")
    return grams.groupBy("number").agg(F.count(F.lit(1)).alias("df"), F.min(doc).alias("in"))


def weight(number: Column) -> Column:
    return 1.0 + 0.25 * (number.bitwiseAND(7) - 1)


#: Numbers of phrases that a task holds, to look up whether a longer one can matter.
MOST_FREQUENT = 500_000


def keyphrases(docs: DataFrame, doc: str, tokens: Column, most: int, k: int) -> DataFrame:
    """(phrase, df, score): the k phrases of 1 to `most` words in two documents or more of highest
    (1 + (words - 1) / 4) * df, ties to the longer, then the smaller phrase.

    Phrases are counted by number, the shorter first. A phrase is in no more documents than the runs it begins and ends
    with; so, once k phrases reach a score, of a longer one only those are counted whose shorter runs are in as many
    documents as the longest phrase would need for it: none that could be among the k is left out. Where over
    MOST_FREQUENT are, all are counted. Only of phrases that reach the k-th score the words are looked up, in one document
    of each.
    """
    hashed = staged(docs.select(doc, word_numbers(tokens).alias("words")), "words")
    scored, least, frequent = None, 0.0, None
    for width in range(1, most + 1):
        counts = counted_grams(hashed, doc, width, frequent).where("df >= 2")
        # Of this width what counts for the best, or for longer phrases.
        counts = staged(counts.withColumn("score", weight(F.col("number")) * F.col("df")).where(F.col("df") * (1.0 + 0.25 * (most - 1)) >= least), "phrases")
        scored = counts if scored is None else scored.unionByName(counts)
        best = scored.select("score").orderBy(F.col("score").desc()).limit(k).agg(F.count(F.lit(1)), F.min("score")).first()
        least = best[1] if best[0] == k else 0.0
        longer = counts.where(F.col("df") * (1.0 + 0.25 * (most - 1)) >= least).select("number")
        frequent = longer if width < most and longer.limit(MOST_FREQUENT + 1).count() <= MOST_FREQUENT else None
    scored = scored.where(F.col("score") >= least)
    words = docs.join(scored.select(F.col("in").alias(doc)).distinct(), doc, "left_semi").select(F.col(doc).alias("in"), F.explode(ngrams(tokens, most)).alias("phrase"))
    split = F.split("phrase", " ")
    number = F.coalesce(*[F.when(F.size(split) == w, gram_number([F.xxhash64(F.get(split, j)) for j in range(w)])) for w in range(1, most + 1)])
    spelled = words.where("phrase <> ''").withColumn("number", number).distinct()
    found = spelled.join(scored, ["in", "number"])
    return found.orderBy(F.col("score").desc(), F.length("phrase").desc(), "phrase").limit(k).select("phrase", "df", "score")


def cooccurrence(terms: DataFrame, unit: str, term: str, least: int = 2) -> DataFrame:
    """(a, b, n): unordered pairs of terms in `least` units or more. A unit brings its distinct terms of a bounded
    vocabulary, so its pairs are bounded too."""
    each = terms.groupBy(unit).agg(F.array_sort(F.collect_set(term)).alias("t"))
    pairs = F.flatten(F.transform("t", lambda x, i: F.transform(F.slice("t", i + 2, F.greatest(F.size("t") - i - 1, F.lit(0))), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return each.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def neighbours(edges: DataFrame, src: str, dst: str, weight: str, k: int, rows: int | None = None) -> DataFrame:
    """(node, neighbour, weight, rank): the k heaviest one-hop neighbours of each node over undirected edges; rows: how
    many edges there are at most, where that is known, so that parts follow it."""
    both = edges.select(F.col(src).alias("node"), F.col(dst).alias("neighbour"), weight).union(edges.select(F.col(dst), F.col(src), weight))
    both = both if rows is None else spread(both, 2 * rows, "node", "neighbour")
    best = both.groupBy("node", "neighbour").agg(F.max(weight).alias(weight))
    return top_by(best, ["node"], [F.col(weight).desc(), F.col("neighbour")], k)


def capped(edges: DataFrame, a: str, b: str, weight: str, most: int = 5) -> DataFrame:
    """(a, b, weight): the edges that a walk from the heaviest takes when no node of either side may have over `most`
    (ties: smaller a, then b).

    By rounds: an edge that is among the open ones that both its ends have room for is taken, since neither can fill up
    before the walk comes to it; then full nodes leave with their edges. The heaviest open edge is always such a one, so
    every round takes some; most take very many. Edges with a null end or weight are left out; equal edges count once.
    """
    left = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(weight).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.max(weight).alias("w"))
    left, taken = staged(left, "edges"), None
    order = [F.col("w").desc(), F.col("a"), F.col("b")]
    while not left.isEmpty():
        room = None
        for side in ("a", "b"):
            best = top_by(left, [side], order, most, f"_{side}")
            if taken is not None:
                used = taken.groupBy(side).agg(F.count(F.lit(1)).alias("used"))
                best = best.join(used, side, "left").where(F.col(f"_{side}") <= most - F.coalesce("used", F.lit(0))).drop("used")
            best = best.select("a", "b", "w")
            room = best if room is None else room.join(best.select("a", "b"), ["a", "b"], "left_semi")
        new = staged(room, "taken")
        taken = new if taken is None else staged(taken.unionByName(new), "taken")
        rest = left.join(new.select("a", "b"), ["a", "b"], "left_anti")
        for side in ("a", "b"):
            full = taken.groupBy(side).agg(F.count(F.lit(1)).alias("used")).where(F.col("used") >= most).select(side)
            rest = rest.join(full, side, "left_anti")
        left = staged(rest.select("a", "b", "w"), "edges")
    out = left if taken is None else taken
    return out.select(F.col("a").alias(a), F.col("b").alias(b), F.col("w").alias(weight))
