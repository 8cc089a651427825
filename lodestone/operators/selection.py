"""Adaptive choice of evidence: thresholds, required facets, the cut at a gap, diversity, and packing under a budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import jaccard, let
from .ranking import FLOOR, RELEVANCE_SHARE, SCORE_GAP, THRESHOLDS, TOP_DELTA, calibrated, keep_best

#: What a new facet adds; the least similarity within a section and within a document; how much longer a window of a
#: table or a formula may be; the least budget that a window is tried with (fixed values).
FACET_BONUS, SAME_SECTION, SAME_DOCUMENT = 0.05, 0.35, 0.12
WIDER, LEAST_TOKENS = {"table": 1.5, "formula": 1.25}, 8
NO_EVIDENCE = ["navigation"], ["synthetic"]


@dataclass(frozen=True)
class Budget:
    least: int = 2
    most: int = 8


def evidence(kind: Column, provenance: Column) -> Column:
    """Whether a chunk may be evidence: navigation and what was made up never are; unknown kinds are."""
    return ~(F.coalesce(kind.isin(*NO_EVIDENCE[0]), F.lit(False)) | F.coalesce(provenance.isin(*NO_EVIDENCE[1]), F.lit(False)))


def similarity(a: Column, b: Column) -> Column:
    """Of two candidates: 1 for the same content of a document, else shared words, and no less than for their section or
    document."""
    words = jaccard(a["terms"], b["terms"])
    floor = F.when(a["section"] == b["section"], F.lit(SAME_SECTION)).when(a["document"] == b["document"], F.lit(SAME_DOCUMENT)).otherwise(0.0)
    return F.when((a["document"] == b["document"]) & (a["content"] == b["content"]), 1.0).otherwise(F.greatest(words, F.coalesce(floor, F.lit(0.0))))


def in_window(rows: DataFrame, query: str, required: str, most: int) -> DataFrame:
    """The `most` best of each query, those first that are the best for a required facet."""
    place = Window.partitionBy(query).orderBy(F.col("relevance").desc(), "item")
    facets = rows.select(query, "item", "relevance", F.explode(F.array_intersect(required, "facets")).alias("facet"), F.col(required).alias("_all"))
    best = facets.withColumn("_r", F.row_number().over(Window.partitionBy(query, "facet").orderBy(F.col("relevance").desc(), "item"))).where("_r = 1")
    reserved = best.groupBy(query, "item").agg(F.min(F.array_position("_all", F.col("facet"))).alias("reserved"))
    known = rows.join(reserved, [query, "item"], "left").withColumn("_place", F.row_number().over(place))
    order = Window.partitionBy(query).orderBy(F.col("reserved").asc_nulls_last(), "_place")
    return known.withColumn("_kept", F.row_number().over(order)).where(F.col("_kept") <= most).drop("_kept", "_place", "reserved")


def target_of(window: Column, budget: Budget) -> Column:
    """(n, reason) of a window sorted by relevance: up to its largest gap after the least number, else what is near the best."""
    n = F.size(window)
    gaps = F.transform(F.sequence(F.lit(budget.least), n - 1), lambda i: F.struct((F.get(window, i - 1)["relevance"] - F.get(window, i)["relevance"]).alias("gap"), (-i).alias("at")))
    largest = let(F.filter(gaps, lambda g: g["gap"] >= SCORE_GAP), lambda g: F.array_max(g))
    near = F.size(F.filter(window, lambda x: x["relevance"] >= F.get(window, F.lit(0))["relevance"] - TOP_DELTA))
    by_gap = let(largest, lambda g: F.when(g.isNotNull(), F.struct((-g["at"]).alias("n"), F.lit("score_gap").alias("reason"))).otherwise(F.struct(F.greatest(F.lit(budget.least), near).alias("n"), F.lit("top_delta").alias("reason"))))
    return F.when(n <= budget.least, F.struct(n.alias("n"), F.lit("available").alias("reason"))).otherwise(by_gap)


def chosen_of(window: Column, required: Column, target: Column, most: int) -> Column:
    """The choice among a window of at most `most` candidates as one fold: for each required facet its best that isn't
    chosen yet, then, up to the target, the one of greatest worth: relevance, distance from those chosen, a new facet."""
    none = F.slice(window, 1, 0)

    def without(chosen: Column) -> Column:
        return F.filter(window, lambda x: ~F.exists(chosen, lambda c: c["item"] == x["item"]))

    def by_facet(chosen: Column, facet: Column) -> Column:
        return F.concat(chosen, F.slice(F.filter(without(chosen), lambda x: F.array_contains(x["facets"], facet)), 1, 1))

    def worth(x: Column, chosen: Column) -> Column:
        near = F.coalesce(F.array_max(F.transform(chosen, lambda c: similarity(x, c))), F.lit(0.0))
        covered = F.flatten(F.transform(chosen, lambda c: c["facets"]))
        new = F.size(F.array_except(x["facets"], covered)) > 0
        return RELEVANCE_SHARE * x["relevance"] + (1 - RELEVANCE_SHARE) * (1 - near) + F.when(new, FACET_BONUS).otherwise(0.0)

    def by_worth(chosen: Column, step: Column) -> Column:
        best = F.array_max(F.transform(without(chosen), lambda x: F.struct(worth(x, chosen).alias("worth"), x["relevance"].alias("relevance"), x["item"].alias("item"), x.alias("x"))))
        more = let(best, lambda b: F.when(b.isNotNull(), F.array(b["x"])).otherwise(none))
        return F.when(F.size(chosen) < target, F.concat(chosen, more)).otherwise(chosen)

    first = F.aggregate(F.array_distinct(required), none, by_facet)
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), first, by_worth)


def selected(candidates: DataFrame, query: str, mode: str = "strict", budget: Budget = Budget(), reranked: bool = True) -> DataFrame:
    """(query, item, relevance, place, reason, missing): the evidence of each query.

    candidates: query, item, score (a reranker's, by the calibration's scale; a channel's own score is not one),
    document, content, section, terms, facets, and required: the facets a query asks for, alike in all its rows. Scores become
    probabilities; those under the mode's threshold are out, and of one content of a document only the best stays. Of
    these the window is taken, required facets first; its gap sets how many are chosen, and the choice is one projection
    over at most budget.most structs. missing: required facets that nothing chosen has. reranked=False is an error.
    Null facets are none; null terms count as no words; a null section or document is like no other.
    """
    if not reranked:
        raise ValueError("calibration holds for a reranker's scores, not for a channel's")
    none = F.array().cast("array<string>")
    rows = candidates.select(query, "item", calibrated(F.col("score")).alias("relevance"), "document", "content", "section", *[F.coalesce(c, none).alias(c) for c in ("terms", "facets", "required")])
    rows = rows.where(F.col("relevance") >= max(FLOOR, THRESHOLDS[mode]))
    rows = keep_best(rows, [query, "document", "content"], "relevance", "item")
    window = in_window(rows, query, "required", budget.most)
    one = F.struct((-F.col("relevance")).alias("order"), "item", "relevance", "document", "content", "section", "terms", "facets")
    whole = window.groupBy(query).agg(F.array_sort(F.collect_list(one)).alias("window"), F.first("required").alias("required"))
    whole = whole.withColumn("target", target_of(F.col("window"), budget))
    whole = whole.withColumn("chosen", F.array_sort(chosen_of(F.col("window"), F.col("required"), F.col("target.n"), budget.most)))
    missing = F.array_except("required", F.flatten(F.transform("chosen", lambda c: c["facets"])))
    flat = whole.select(query, F.posexplode("chosen").alias("place", "c"), F.col("target.reason").alias("reason"), missing.alias("missing"))
    return flat.select(query, F.col("c.item").alias("item"), F.col("c.relevance").alias("relevance"), (F.col("place") + 1).alias("place"), "reason", "missing")


def packed(windows: Column, budget: int, per_window: int = 160) -> Column:
    """Of an array of structs (id, kind, provenance, tokens) in order those that fit a budget of tokens. A window may have
    `per_window` tokens, a table 1.5 and a formula 1.25 times that, or what is left, if that is less; it is cut to that, and
    what is no evidence is passed over. Nothing follows once fewer than 8 tokens are left."""
    if budget < LEAST_TOKENS or per_window < LEAST_TOKENS:
        raise ValueError(f"budgets are {LEAST_TOKENS} tokens at least")
    kinds = F.create_map(*[F.lit(x) for k, m in WIDER.items() for x in (k, max(LEAST_TOKENS, round(per_window * m)))])
    start = F.struct(F.lit(budget).alias("left"), F.slice(F.transform(windows, lambda x: F.struct(x["id"].alias("id"), F.lit(0).alias("tokens"))), 1, 0).alias("out"))

    def step(s: Column, x: Column) -> Column:
        most = F.least(F.coalesce(F.try_element_at(kinds, x["kind"]), F.lit(max(LEAST_TOKENS, per_window))), s["left"])
        tokens = F.least(x["tokens"].cast("int"), most)
        fits = evidence(x["kind"], x["provenance"]) & (s["left"] >= LEAST_TOKENS)
        return F.when(fits, F.struct((s["left"] - tokens).alias("left"), F.concat(s["out"], F.array(F.struct(x["id"].alias("id"), tokens.alias("tokens")))).alias("out"))).otherwise(s)

    return F.aggregate(windows, start, step, lambda s: s["out"])
