"""What must not grow with the tables: work done once that was done again for each use, memory and data of one task."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators import duplicates, extensions, ranking, reconcile, validation
from lodestone.plans import catalogue
from lodestone.sources import tables

DATA = Path("/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@needs_tables
def test_a_locator_is_matched_once(spark):
    assert plan_of(catalogue.QUERIES["page_locators"](spark, str(DATA))).count("regexp_") == 1


def test_locators_with_marks_and_line_ends(spark):
    rows = [("12 ff.\n", (12, 14, "ff")), ("12ff\x85", (12, 14, "ff")), ("3\x014\x01", None), ("\x015\x01", None), ("99999999999", None), ("5-99999999999", None), (None, None)]
    got = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, s string").select("i", t.page_locator(F.col("s")).alias("x")).orderBy("i").collect()
    assert [None if r.x is None else tuple(r.x) for r in got] == [w for _, w in rows]


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_shared_terms_are_counted_where_documents_are(spark, monkeypatch):
    docs = spark.createDataFrame([(i, [f"w{j}" for j in range(30) if (i * 7 + j * j) % (3 + j % 5) == 0] or None) for i in range(900)], "doc long, terms array<string>")
    asked = spark.createDataFrame([(i, [f"w{j}" for j in range(i, i + 9)]) for i in range(25)] + [(None, ["w1", "w2"]), (26, []), (27, ["none"])], "item long, terms array<string>")
    top = lambda: ranking.overlap_top_k(docs, "doc", F.col("terms"), asked, "item", F.col("terms"), 7)
    monkeypatch.setattr(ranking, "CELLS", 2_000)
    got = top()
    assert shuffles(got) == 1  # of the best, not of all pairs
    rows = sorted(map(tuple, got.collect()), key=repr)
    monkeypatch.setattr(ranking, "MOST_QUERIES", 1)
    assert rows == sorted(map(tuple, top().collect()), key=repr)
    assert len(rows) == 26 * 7
    kinds = {r.doc: set(r.terms or []) for r in docs.collect()}
    for item in (0, 20, None):
        words = set(next(r.terms for r in asked.collect() if r.item == item))
        want = sorted(((-round(len(words & w) / len(w) ** 0.5, 9), d) for d, w in kinds.items() if words & w))[:7]
        assert [(-s, d) for s, d in want] == [(r[2], r[1]) for r in sorted((r for r in rows if r[0] == item), key=lambda r: r[3])]


@needs_tables
def test_rules_of_an_index_read_staged_lines(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(validation, "index_faults", lambda tables, *_: seen.update(tables) or tables["books"])
    catalogue.QUERIES["generation_faults"](spark, str(DATA))
    assert {name: shuffles(seen[name]) for name in ("books", "structures", "snapshots", "segments", "chunks")} == dict.fromkeys(("books", "structures", "snapshots", "segments", "chunks"), 0)
    assert not any("Window" in plan_of(seen[name]) for name in ("books", "snapshots", "chunks"))


def test_scorers_get_few_pairs_at_once():
    class Longest:
        most = 0

        def load(self):
            pass

        def score(self, questions, passages):
            self.most = max(self.most, len(questions))
            return np.array([len(q) - len(p) for q, p in zip(questions, passages, strict=True)], float)

    scorer, n = Longest(), 3 * extensions.PAIRS + 5
    q, p = pd.Series(["x" * (i % 7) for i in range(n)]), pd.Series([None if i % 3 == 0 else "y" for i in range(n)])
    got = extensions.scored_in_slices(scorer, q, p)
    assert scorer.most <= extensions.PAIRS
    assert got.tolist() == [i % 7 - (i % 3 > 0) for i in range(n)]
    assert extensions.scored_in_slices(scorer, q[:0], p[:0]).tolist() == []


@needs_tables
@pytest.mark.parametrize("name", ["graph_neighbours", "capped_neighbours", "recall_of_stages"])
def test_parts_follow_the_lines(spark, monkeypatch, name):
    monkeypatch.setattr(tables, "PART_ROWS", 300)
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    asked = []
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda self, n, *by, _real=type(spark.range(1)).repartition: asked.append(n) or _real(self, n, *by))
    rows = catalogue.QUERIES[name](spark, str(DATA)).count()
    assert rows > 0
    assert max(asked) >= lines / 300


def test_python_gets_no_plain_texts(spark, monkeypatch):
    given = []
    monkeypatch.setattr(t, "nfkc", lambda c: given.append(c) or c)
    texts = spark.createDataFrame([(1, "DIN 4108"), (2, "5 µm"), (3, None)], "i int, s string")
    literals = t.technical_literals(F.col("s"))
    rows = texts.select("i", given[0].alias("sent"), literals.alias("found")).orderBy("i").collect()
    assert [r.sent for r in rows] == [None, "5 µm", None]
    assert [r.found for r in rows] == [["din4108"], ["5µm"], None]


@needs_tables
@pytest.mark.parametrize("name", ["outline_modes", "reconciled_outlines"])
def test_outlines_pass_no_table_through_the_driver(spark, monkeypatch, name):
    plans = []
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    for module in (reconcile, duplicates):
        monkeypatch.setattr(module, "staged", lambda df, step, _real=module.staged: _real(seen(df), step))
    seen(catalogue.QUERIES[name](spark, str(DATA)))
    assert sum(p.count("SortMergeJoin") for p in plans) > 20
    assert not [p for p in plans if "Broadcast" in p]
