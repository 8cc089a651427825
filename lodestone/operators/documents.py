"""Operators on single documents and nested records: windows of evidence, claims, JSON payloads, aliases, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, search_terms, sentences


def overlap(terms: Column, wanted: Column) -> Column:
    """Share of wanted terms among `terms`."""
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(terms, wanted)) / F.size(wanted)).otherwise(0.0)


def best_sentence(text: Column, wanted: Column) -> Column:
    """Struct of at (from 0), score and text of the sentence with most wanted terms, the first of equals."""
    scored = let(sentences(text), lambda s: F.transform(s, lambda x, i: F.struct(overlap(search_terms(x), wanted).alias("score"), (-i).alias("place"), x.alias("text"))))
    return let(F.array_max(scored), lambda b: F.struct((-b["place"]).alias("at"), b["score"].alias("score"), b["text"].alias("text")))


def claim_errors(claim_terms: Column, evidence_terms: Column, claim_negated: Column, evidence_negated: Column, claim_literals: Column, evidence_literals: Column) -> Column:
    """Codes of what speaks against a claim: literals the evidence lacks, opposite polarity, fewer than two shared terms,
    more than 45 % unsupported terms."""
    shared = F.size(F.array_intersect(claim_terms, evidence_terms))
    unsupported = F.when(F.size(claim_terms) > 0, 1 - shared / F.size(claim_terms)).otherwise(0.0)
    return F.array_compact(F.array(
        F.when(F.size(F.array_except(claim_literals, evidence_literals)) > 0, "literal_missing"),
        F.when((claim_negated != evidence_negated) & (shared > 0), "polarity"),
        F.when(shared < F.least(F.lit(2), F.size(claim_terms)), "overlap"),
        F.when(unsupported > 0.45, "unsupported")))


def within_budget(items: Column, size, budget: int, least_left: int = 0) -> Column:
    """Items of an array in order that fit a budget: one that doesn't fit is skipped, and nothing follows once less than
    least_left remains. size: a function of an item."""
    kind = items

    def step(s: Column, x: Column) -> Column:
        fits = (s["left"] >= size(x)) & (s["left"] >= least_left)
        return F.struct(F.when(fits, s["left"] - size(x)).otherwise(s["left"]).alias("left"), F.when(fits, F.concat(s["out"], F.array(x))).otherwise(s["out"]).alias("out"))

    return F.aggregate(items, F.struct(F.lit(budget).cast("long").alias("left"), F.slice(kind, 1, 0).alias("out")), step, lambda s: s["out"])


def bounded_aliases(aliases: Column, most: int = 24, tokens: int = 96) -> Column:
    """A prefix of distinct aliases, `most` of them and `tokens` words at most."""
    first = F.slice(F.array_distinct(aliases), 1, most)
    count = lambda a: F.size(F.split(a, " "))
    running = F.aggregate(first, F.struct(F.lit(0).alias("n"), F.slice(first, 1, 0).alias("out"), F.lit(False).alias("stop")), lambda s, a: F.struct(
        (s["n"] + count(a)).alias("n"), F.when(~s["stop"] & (s["n"] + count(a) <= tokens), F.concat(s["out"], F.array(a))).otherwise(s["out"]).alias("out"), (s["stop"] | (s["n"] + count(a) > tokens)).alias("stop")), lambda s: s["out"])
    return running


def covered_at(hits: DataFrame, case: str, rank: str, item: str, groups: str) -> DataFrame:
    """(case, rank): the first rank at which one of a case's sets of items is covered by all hits so far; null if none.

    A set is covered at the greatest of its items' first ranks, so no prefix is ever collected.
    """
    first = hits.groupBy(case, item).agg(F.min(rank).alias("first"))
    wanted = hits.select(case, groups).distinct().select(case, F.posexplode(groups).alias("g", "members")).select(case, "g", F.size("members").alias("n"), F.explode(F.array_distinct("members")).alias(item))
    sets = wanted.join(first, [case, item], "left").groupBy(case, "g").agg(F.max("first").alias("at"), F.count("first").alias("found"), F.count(F.lit(1)).alias("n"))
    return sets.groupBy(case).agg(F.min(F.when(F.col("found") == F.col("n"), F.col("at"))).alias(rank))


def scrubbed(payload: Column, secret: Column, by: str = "[removed]") -> Column:
    """JSON text with every exact string value equal to secret replaced."""
    quoted = F.regexp_extract(F.to_json(F.struct(secret.alias("v"))), r'^\{"v":(.*)\}$', 1)
    return F.replace(payload, quoted, F.lit(f'"{by}"'))
