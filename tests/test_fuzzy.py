"""Fuzzy scores against a plain dynamic program, capped neighbours against a walk over all edges."""

import random
from functools import cache

import pandas as pd
import pytest

from lodestone.functions import fuzzy
from lodestone.operators import graph


def plain_score(title, query):
    text = fuzzy.bare(title)
    low, gain = text.lower(), fuzzy.gains(text)

    def atom(q):
        @cache
        def best(i, j):
            """Of alignments of q[: i + 1] whose last letter is at j."""
            if low[j] != q[i]:
                return None
            if i == 0:
                return 16 + 2 * gain[j]
            found = []
            for k in range(j):
                s = best(i - 1, k)
                if s is not None:
                    found.append(s + 16 + max(gain[j], 4) if k == j - 1 else s + 16 + gain[j] - 3 - (j - k - 2))
            return max(found, default=None)

        ends = [s for j in range(len(low)) if (s := best(len(q) - 1, j)) is not None]
        return max(ends, default=None)

    parts = [atom(q) for q in fuzzy.bare(query).lower().split()]
    return None if None in parts else sum(parts)


@pytest.mark.parametrize("query", ["ab", "a b", "Bä ca", "abcabc", "7", "x y z"])
def test_scores_equal_a_plain_program(query):
    random.seed(len(query))
    titles = ["".join(random.choice("abcABC 7-ä") for _ in range(random.randrange(0, 18))) for _ in range(300)]
    got = [None if x is pd.NA else int(x) for x in fuzzy.scores(pd.Series(titles), query)]
    assert got == [plain_score(t, query) for t in titles]


def test_column_keeps_rows_and_nulls(spark):
    rows = [(i, t) for i, t in enumerate([None, "", "Green Leaf", "grand large", "gr", "regal"])]
    df = spark.createDataFrame(rows, "id int, title string")
    got = {r.id: r.s for r in df.select("id", fuzzy.fuzzy_score(df.title, "gr le").alias("s")).collect()}
    assert got[0] is None and got[4] is None and got[2] == plain_score("Green Leaf", "gr le") > got[3]
    assert {r.s for r in df.select(fuzzy.fuzzy_score(df.title, " ").alias("s")).collect()} == {0}


@pytest.mark.parametrize("most", [1, 3])
def test_capped_equals_a_walk(spark, most):
    random.seed(most)
    edges = list({(f"a{random.randrange(25)}", f"b{random.randrange(12)}"): random.randrange(6) for _ in range(260)}.items())
    rows = [(a, b, w) for (a, b), w in edges] + [("hub", f"b{i}", 9) for i in range(12)] + [(None, "b1", 9), ("a1", "b1", None)]
    got = {tuple(r) for r in graph.capped(spark.createDataFrame(rows, "a string, b string, w int"), "a", "b", "w", most).collect()}
    left, right, want = {}, {}, set()
    for a, b, w in sorted((r for r in rows if None not in r), key=lambda r: (-r[2], r[0], r[1])):
        if left.get(a, 0) < most and right.get(b, 0) < most:
            want.add((a, b, w))
            left[a], right[b] = left.get(a, 0) + 1, right.get(b, 0) + 1
    assert got == want


def test_capped_without_edges(spark):
    assert graph.capped(spark.createDataFrame([], "a string, b string, w int"), "a", "b", "w").count() == 0
