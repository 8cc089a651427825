"""Ranking and text operators on small fixtures with known results."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators import catalog, graph, ranking, structure
from lodestone.sources import tables
from lodestone.streaming import events as log


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_fusion_matches_brute_force(spark):
    random.seed(41)
    rows = [(q, path, pos, random.randrange(12)) for q in range(6) for path in ("fts", "tree", "kg", "own") for pos in range(random.randrange(1, 25))]
    weights = {"fts": 1.5, "tree": 0.5, "kg": 0.25}
    out = ranking.fused(spark.createDataFrame(rows, "q int, path string, pos int, item int"), "q", "item", weights).collect()
    want = {}
    for q in range(6):
        for path in ("fts", "tree", "kg", "own"):
            mine = list(dict.fromkeys(item for _, _, _, item in sorted(r for r in rows if r[:2] == (q, path))))
            for place, item in enumerate(mine, 1):
                score, paths = want.get((q, item), (0.0, set()))
                want[q, item] = score + weights.get(path, 1.0) / (60 + place), paths | {path}
    assert len(out) == len(want)
    for r in out:
        score, paths = want[r.q, r.item]
        assert r.score == pytest.approx(score) and r.paths == ",".join(sorted(paths))
    for q in range(6):
        mine = [(-r.score, r.item) for r in sorted(out, key=lambda r: r.rank) if r.q == q]
        assert mine == sorted(mine)


def test_media_fusion_counts_every_place(spark):
    rows = [("q", "caption", 1, 5), ("q", "caption", 2, 5), ("q", "link", 3, 7)]
    out = ranking.fused_places(spark.createDataFrame(rows, "q string, path string, pos int, item int"), "q", "item", {"link": 2.0}).orderBy("rank").collect()
    assert [(r.item, pytest.approx(r.score)) for r in out] == [(5, 1 / 61 + 1 / 62), (7, 2 / 63)]


def test_gap_cut_takes_the_largest_drop(spark):
    rows = [("q", "a", 0.95), ("q", "b", 0.88), ("q", "c", 0.65), ("q", "d", 0.64), ("p", "a", 0.9), ("r", "a", 0.9), ("r", "b", 0.88), ("r", "c", 0.86), ("r", "d", 0.80), ("r", "e", 0.74)]
    out = ranking.gap_cut(spark.createDataFrame(rows, "q string, item string, s double"), "q", "s", "item", 2, 8).orderBy("q", "rank").collect()
    assert [(r.q, r.item, r.reason) for r in out] == [("p", "a", "available"), ("q", "a", "score_gap"), ("q", "b", "score_gap"), ("r", "a", "top_delta"), ("r", "b", "top_delta"), ("r", "c", "top_delta"), ("r", "d", "top_delta")]


def test_calibration_rises_and_matches_the_descent(spark):
    pairs = [(-3.0, 0), (-1.0, 0), (0.0, 0), (1.0, 1), (3.0, 1), (4.0, 1)]
    scale, bias = ranking.platt(spark.createDataFrame(pairs, "s double, y int"), "s", "y")
    a, b, rate = 1.0, 0.0, 0.08 / math.sqrt(len(pairs))
    for _ in range(250):
        error = [1 / (1 + math.exp(-(a * s + b))) - y for s, y in pairs]
        ga = sum(e * s for e, (s, _) in zip(error, pairs, strict=True)) / len(pairs) + 0.01 * a
        gb = sum(error) / len(pairs)
        a, b = a - rate * ga, b - rate * gb
    assert (scale, bias) == (pytest.approx(a), pytest.approx(b)) and scale > 0
    with pytest.raises(ValueError):
        ranking.platt(spark.createDataFrame([(1.0, 1)] * 5, "s double, y int"), "s", "y")


def test_diversified_choice_matches_brute_force(spark):
    rows = [("q", i, 0.9 - 0.02 * i, [f"t{j}" for j in range(i % 3 * 2, i % 3 * 2 + 3)]) for i in range(9)]
    df = spark.createDataFrame(rows, "q string, item int, p double, terms array<string>")
    got = [r.item for r in ranking.diversified(df, "q", "item", "p", "terms", 4).orderBy("place").collect()]
    left, chosen = list(rows), []
    while len(chosen) < 4:
        def value(x):
            near = max((len(set(x[3]) & set(y[3])) / len(set(x[3]) | set(y[3])) for y in chosen), default=0.0)
            return 0.8 * x[2] + 0.2 * (1 - near), x[2], x[1]
        best = max(left, key=value)
        left.remove(best)
        chosen.append(best)
    assert got == [x[1] for x in chosen]


def test_metrics_count_missing_queries(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1)], "q int, item string, rank int")
    gold = spark.createDataFrame([(1, "b"), (2, "y")], "q int, item string")
    m = ranking.metrics(ranked, gold, "q", "item").first()
    assert (m.n_queries, m.recall_5, m.mrr) == (2, 0.5, 0.25) and m.ndcg_10 == pytest.approx(0.5 / math.log2(3))


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, 1)], "s int, y int")
    assert ranking.rank_auc(df, "s", "y").first().auc == pytest.approx(3.5 / 4)


def test_range_plan(spark):
    rows = [("b", i, s) for i, s in enumerate([False, False, False, True, True, False], 1)]
    plan = structure.page_ranges(spark.createDataFrame(rows, "book string, p int, scanned boolean"), "book", "p", "scanned", 2, 1).orderBy("core_start").collect()
    assert [(r.core_start, r.core_end) for r in plan] == [(1, 2), (3, 3), (4, 4), (5, 5), (6, 6)]
    assert [(r.conversion_start, r.conversion_end) for r in plan] == [(1, 3), (2, 4), (3, 5), (4, 6), (5, 6)]


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, t.book_text(lit("Fuß & Straße: Çé  2"))) == "fuss strasse ce 2"
    assert set(one(spark, t.search_terms(lit("What about the X-ray of Y 9 b?")))) == {"about", "x-ray", "of", "y", "9"}
    assert one(spark, t.isbn(lit("978-0-306-40615-7"))) == "9780306406157" and one(spark, t.isbn(lit("978-0-306-40615-8"))) is None
    assert one(spark, t.isbn(lit("0-306-40615-2"))) == "0306406152" and one(spark, t.isbn(lit("12345"))) is None
    assert one(spark, t.roman(lit("xliv"))) == 44 and one(spark, t.roman(lit("MDCLXVI"))) == 1666
    locators = {"7": (7, 7, ""), "31-40": (31, 40, ""), "9f": (9, 10, "f"), "80 ff.": (80, 82, "ff")}
    for raw, want in locators.items():
        assert tuple(one(spark, t.page_locator(lit(raw)))) == want
    for raw in ("9-3", "1-700", "x", "", "0", "3-"):
        assert one(spark, t.page_locator(lit(raw))) is None
    for raw, term, pages in [("Granite 77", "Granite", ["77"]), ("Slate roof tiles 5, 61, 90f", "Slate roof tiles", ["5", "61", "90f"]), ("Model 0, 12", "Model 0", ["12"])]:
        x = one(spark, t.index_entry(lit(raw)))
        assert (x.term, x.locators) == (term, pages)
    assert one(spark, t.index_entry(lit("Granite, see stones"))) is None
    policies = {"https://b.example/y?z": "allow", "http://127.0.0.1/": "loopback", "https://172.20.0.9/": "private", "https://172.40.0.9/": "allow", "file://x/": "scheme", "https://me@b/": "credentials", "": "invalid"}
    for url, want in policies.items():
        assert one(spark, t.host_policy(lit(url))) == want


def test_question_complexity(spark):
    signals = {"compare": 2, "overall": 2, "calculate": 1}
    for n in range(4):
        for chosen in combinations(signals, n):
            for clauses in (1, 2, 3):
                question = "; ".join(["how is it done", "why so", "where then"][:clauses]) + " " + " ".join(chosen)
                points = sum(signals[c] for c in chosen) + (clauses >= 2)
                score, name = t.complexity(F.lit(question))
                assert (one(spark, score), one(spark, name)) == (points, "simple" if points <= 0 else "standard" if points <= 2 else "complex")
    score, name = t.complexity(F.lit("where is it"), F.lit(True), F.lit(3), F.lit(1))
    assert (one(spark, score), one(spark, name)) == (1, "standard")


def test_filters_tell_none_from_nothing(spark):
    docs = spark.createDataFrame([(1, "en", "a"), (2, "de", "b")], "doc_id long, lang string, source string")
    assert catalog.document_filter({}) is None
    assert docs.where(catalog.document_filter({"language": "EN"})).count() == 1
    with pytest.raises(ValueError):
        catalog.document_filter({"colour": 1})
    assert docs.where(catalog.allow_list(None, "doc_id")).count() == 2 and docs.where(catalog.allow_list([], "doc_id")).count() == 0


def test_pairs_of_a_unit_are_unordered(spark):
    rows = [(1, "b"), (1, "a"), (1, "c"), (2, "a"), (2, "b"), (3, "a")]
    out = graph.cooccurrence(spark.createDataFrame(rows, "unit int, term string"), "unit", "term").collect()
    assert [(r.a, r.b, r.n) for r in out] == [("a", "b", 2)]


def test_streams_resume_where_they_stopped(spark, tmp_path):
    rows = [(i, i % 3, "t") for i in range(20)]
    spark.createDataFrame(rows[:10], "event_id long, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("event_id long, user_id long, event_type string").parquet(f"{tmp_path}/in")
    assert log.drained(stream(), f"{tmp_path}/s").count() == 10
    spark.createDataFrame(rows[10:], "event_id long, user_id long, event_type string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert sorted(r.event_id for r in log.drained(stream(), f"{tmp_path}/s").collect()) == list(range(20))


def test_snapshots_are_checked_on_restore(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id long, name string")
    tables.publish(df, f"{tmp_path}/t", ["id"])
    tables.publish(spark.createDataFrame([(2, "b")], "id long, name string"), f"{tmp_path}/t", ["id"])
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    df.write.parquet(f"{tmp_path}/u")
    assert tables.restored(spark, f"{tmp_path}/u", df.schema).count() == 1
    with pytest.raises(ValueError):
        tables.restored(spark, f"{tmp_path}/u", spark.createDataFrame([], "id long, other string").schema)
    wide = tables.with_schema(df, spark.createDataFrame([], "id long, name string, extra int").schema, {"extra": 7}).first()
    assert wide.extra == 7
    assert tables.inspected_files(spark, f"{tmp_path}/u/*.parquet").first().fingerprint




def test_budget_skips_what_does_not_fit(spark):
    from lodestone.operators import documents as d

    items = F.array(*[F.lit("x" * n) for n in (200, 1000, 80, 40, 4)])
    # 320 characters are 80 tokens: 50, then 250 don't fit, 20, 10 of what is left would leave 0.
    assert [len(x) for x in one(spark, d.within_budget(items, t.estimated_tokens, 80, 8))] == [200, 80, 40]


def test_claims_and_support(spark):
    from lodestone.operators import documents as d

    terms = lambda s: t.search_terms(F.lit(s))
    none = F.array().cast("array<string>")
    errors = lambda a, b, x=none, y=none: one(spark, d.claim_errors(terms(a), terms(b), t.negated(terms(a)), t.negated(terms(b)), x, y))
    assert errors("Grenzwert beträgt hier viel", "Grenzwert beträgt hier viel mehr") == []
    assert errors("Grenzwert gilt nicht", "Grenzwert gilt") == ["polarity"]
    assert errors("Grenzwert gilt", "Grenzwert gilt", F.array(F.lit("42")), none) == ["literal_missing"]
    assert "overlap" in errors("alpha beta gamma", "delta alpha")
    best = one(spark, d.best_sentence(F.lit("Erster Satz. Der Beton kriecht stark. Ende."), terms("Beton kriecht")))
    assert (best.at, best.score) == (1, 1.0)
    aliases = F.array(*[F.lit(x) for x in ("a b", "c", "a b", "d e f")])
    assert one(spark, d.bounded_aliases(aliases, 24, 4)) == ["a b", "c"]
    assert one(spark, d.scrubbed(F.lit('{"k":"s","l":["s","st"]}'), F.lit("s"))) == '{"k":"[removed]","l":["[removed]","st"]}'


def test_passages_are_found_over_lines_inside_words_and_when_short(spark):
    from lodestone.plans.retrieval_queries import holding

    items = [(1, "One two.\nThree four five six seven."), (2, "rt two. three"), (3, ""), (4, None), (5, "ne two.\nThree four five six sev"), (6, "a b  c\nd e f g"), (6, "a b  c\nd e f g"), (7, "six seven")]
    docs = [(1, "Start\nOne two.\nThree four five six seven. End"), (2, "short two. threesome"), (3, None), (4, "xa b  c\nd e f gh"), (4, "a b c d e f g"), (5, "")]
    got = holding(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"))
    assert sorted(map(tuple, got.collect())) == sorted((i, d) for i, p in items for d, x in docs if p is not None and x is not None and p in x)
