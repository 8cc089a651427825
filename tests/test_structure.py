"""Outlines, regions, alignments and further text functions on small fixtures."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators import structure


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_outline_parents_and_ends(spark):
    rows = [("b", i, d, p) for i, (d, p) in enumerate([(1, 1), (2, 3), (3, 5), (2, 9), (1, 12)])]
    out = structure.outline(spark.createDataFrame(rows, "book string, o int, depth int, page int"), "book", "o", "depth", "page", 3).orderBy("o").collect()
    assert [r.parent for r in out] == [None, 0, 1, 0, None]
    assert [r.end for r in out] == [11, 8, 8, 11, None]


def test_ancestors_tell_cycles(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (8, 9), (9, 8)], "node int, parent int")
    out = {r.node: (r.path, r.cyclic) for r in structure.ancestors(nodes, "node", "parent", 4).collect()}
    assert out[3] == ([1, 2, 3], False) and out[1] == ([1], False)
    assert out[8][1] and out[9][1] and len(out) == 5


def test_regions_forgive_one_page(spark):
    rows = [("b", i, f) for i, f in enumerate([True, False, True, True, False, False, True])]
    out = structure.regions(spark.createDataFrame(rows, "book string, p int, f boolean"), "book", "p", "f", 2).orderBy("first").collect()
    assert [(r.first, r.last, r.n) for r in out] == [(1, 4, 3), (7, 7, 1)]


def test_alignment_has_the_greatest_sum(spark):
    pairs = [("b", 1, 2, 0.9), ("b", 2, 1, 0.8), ("b", 2, 3, 0.7), ("b", 3, 2, 0.95), ("b", 4, 4, 0.3), ("b", 4, 5, 0.69)]
    got = structure.aligned(spark.createDataFrame(pairs, "book string, l int, r int, s double"), "book", "l", "r", "s", 0.68).orderBy("l").collect()
    good = [p for p in pairs if p[3] >= 0.68]
    chains = [c for k in range(1, len(good) + 1) for c in combinations(sorted(good), k) if all(a[1] < b[1] and a[2] < b[2] for a, b in zip(c, c[1:], strict=False))]
    best = max(chains, key=lambda c: sum(p[3] for p in c))
    assert [(r.l, r.r) for r in got] == [(p[1], p[2]) for p in best]


def test_alignment_equals_all_pairs_of_pairs(spark):
    random.seed(8)
    pairs = [(f"b{random.randrange(3)}", random.randrange(25), random.randrange(25), random.random()) for _ in range(400)]
    got = structure.aligned(spark.createDataFrame(pairs, "book string, l int, r int, s double"), "book", "l", "r", "s", 0.3).collect()
    for book in {p[0] for p in pairs}:
        rows = sorted(p[1:] for p in pairs if p[0] == book and p[3] >= 0.3)
        best = []
        for a, b, s in rows:
            best.append(s + max((x for x, (c, d, _) in zip(best, rows, strict=False) if c < a and d < b), default=0.0))
        chain = sorted((r.l, r.r) for r in got if r.book == book)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(chain, chain[1:], strict=False))
        assert abs(sum(max(s for a, b, s in rows if (a, b) == c) for c in chain) - max(best)) < 1e-9


def test_interval_join_is_closed(spark):
    nodes = spark.createDataFrame([("n", 3, 70)], "node string, lo int, hi int")
    points = spark.createDataFrame([(i,) for i in (2, 3, 64, 70, 71)], "p int")
    assert sorted(r.p for r in structure.interval_join(points, "p", nodes, "lo", "hi", 16).collect()) == [3, 64, 70]


@pytest.mark.parametrize("width", [1, 8, 24])
def test_points_meet_few_rows_of_the_intervals_that_hold_them(spark, width):
    """Every pair of a point and its interval was made, in the one task of a dense cell, and sorted."""
    rng = random.Random(width)
    nodes = [(i % 350, lo, lo + rng.randrange(-2, 60)) for i, lo in enumerate(rng.randrange(-40, 90) for _ in range(400))] + [(900, None, 5), (901, 5, None), (902, -500, 500)]
    points = [(rng.randrange(-60, 140),) for _ in range(300)] + [(7,)] * 9 + [(None,)]
    n, p = spark.createDataFrame(nodes, "node int, lo int, hi int"), spark.createDataFrame(points, "p long")
    met = [(x, node, lo, hi) for (x,) in points if x is not None for node, lo, hi in nodes if lo is not None and hi is not None and lo <= x <= hi]
    best = {}
    for x, node, lo, hi in met:
        best[x] = min(best.get(x, (99999,)), (lo - hi, -lo, node))
    found = structure.deepest_holding(p, "p", n, "lo", "hi", [F.col("lo") - F.col("hi"), -F.col("lo"), F.col("node")], width)
    assert {r.p: tuple(r.best) for r in found.collect()} == best and found.count() == len(best)
    first = {}
    for x, node, *_ in met:
        first.setdefault(node, []).append(x)
    got = sorted(map(tuple, structure.first_inside(p, "p", n, "node", "lo", "hi", 4, width).collect()))
    assert got == sorted((node, i + 1, x) for node, xs in first.items() for i, x in enumerate(sorted(xs)[:4]))


def test_question_frames_and_lines(spark):
    cases = {"Was ist das Ausbreitmaß?": "Ausbreitmaß", "Welche Betonarten gibt es?": "Betonarten", "Was?": "Was?", "What is the slump\nmore": "slump\nmore"}
    for question, want in cases.items():
        assert one(spark, t.retrieval_query(F.lit(question))) == want
    toc = one(spark, t.toc_entry(F.lit("Kapitel. . . . . 93")))
    assert (toc.title, toc.label) == ("Kapitel", "93")
    assert one(spark, t.toc_entry(F.lit("Ein Satz mit 93"))) is None
    assert one(spark, t.numbering_depth(F.lit("1.2.3 Beton"))) == 2 and one(spark, t.numbering_depth(F.lit("Beton"))) is None
    assert one(spark, t.heading_role(F.lit("Abkürzungsverzeichnis"))) == "abbreviations" and one(spark, t.heading_role(F.lit("Beton"))) is None
    assert [one(spark, t.line_kind(F.lit(x))) for x in ("| a | b |", "a = b", "- item", "plain")] == ["table", "formula", "list", "prose"]
    assert one(spark, t.facets(F.lit("Was ist Kriechen und wie wird Kriechen berücksichtigt?"), 2)) == ["Was ist Kriechen", "wie wird Kriechen berücksichtigt"]
    assert one(spark, t.verdict(F.lit("Urteil: widerlegt."))) == "refuted" and one(spark, t.verdict(F.lit("?"))) is None
    assert one(spark, t.slug(F.lit(" Größe & Maß "))) == "grosse-mass"
