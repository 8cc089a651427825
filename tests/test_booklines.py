"""Indexes and contents lists over chunks against one pass over all lines of a book."""

import random

import pytest

from lodestone.operators import booklines as b

SCHEMA = "book string, at long, text string, indent double"
INDEX = ["Beton concrete 38, 40", "Baustoff building material 120", "–, Klassifizierung building material,", "classification 127", "Böden soils, subsoils", "", None, "Sachregister", "Kriechen siehe Beton", "creep see also shrinkage", "lange offene zeile,", "weiter 12-14, 20ff", "klein ohne", "klein weiter", "klein ende 7", "Beton C30, 42", "nur Text", "Anhang A-3, iv"]
CONTENTS = ["Inhalt", "1 Anfang . . . . 3", "1.2 Mitte..... 12", "Ein langer Titel der", "umbricht      14", "Ohne Seite", "Weiter\t19", "", None, "Anhang  iv"]


def lines(kind, seed, n):
    random.seed(seed)
    return [(f"b{seed}", i, random.choice(kind), random.choice([0.0, 4.0, 10.0, 12.0, 25.0, 40.0])) for i in range(n)]


def alone(rows, *machines):
    out = {}
    for book in {r[0] for r in rows}:
        now = [b.Line(at, (text or "").strip(" "), x) for bk, at, text, x in sorted(rows, key=lambda r: r[1]) if bk == book]
        for m in machines:
            now = m.run(now, m.start)[0]
        out[book] = now
    return out


@pytest.mark.parametrize("parts", ["4", "61"])
def test_index_over_chunks_equals_one_pass(spark, parts):
    rows = [x for seed, n in ((1, 400), (2, 3), (3, 90), (4, 1)) for x in lines(INDEX, seed, n)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = b.subject_index(spark.createDataFrame(rows, SCHEMA), "book", "at", "text", "indent").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = [(book, *e[:5], tuple(e[5])) for book, entries in alone(rows, b.Wraps(), b.Parents()).items() for e in entries]
    assert sorted(map(repr, want)) == sorted(repr((r.book, r.at, r.term, r.subterm, r.relation, r.related, tuple(r.pages))) for r in got)


@pytest.mark.parametrize("parts", ["4", "61"])
def test_contents_over_chunks_equal_one_pass(spark, parts):
    rows = [x for seed, n in ((1, 300), (2, 2), (3, 50)) for x in lines(CONTENTS, seed, n)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = b.contents_list(spark.createDataFrame(rows, SCHEMA), "book", "at", "text", "indent").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = []
    for book, entries in alone(rows, b.Contents()).items():
        least = min((e[4] for e in entries), default=0)
        want += [(book, at, title, label, depth if depth is not None else max(0, min(6, round((x - least) / 15)))) for at, title, label, depth, x in entries]
    assert sorted(want) == sorted(tuple(r) for r in got)


def test_wraps_subentries_and_codes():
    read = lambda *texts: b.Parents().run(b.Wraps().run([b.Line(i, t, x) for i, (t, x) in enumerate(texts)], None)[0], None)[0]
    found = read(("Baustoff building material 120", 40.0), ("–, Klassifizierung building material,", 50.0), ("classification 127", 50.0))
    assert [(e[1], e[2], e[5]) for e in found] == [("Baustoff building material", None, ["120"]), ("Baustoff building material", "–, Klassifizierung building material, classification", ["127"])]
    assert [e[1] for e in read(("Böden soils", 1.0), ("Beton concrete 38, 40", 1.0))] == ["Beton concrete"]
    assert read(("Beton C30, 42", 0.0))[0][1::4] == ("Beton C30", ["42"])
    assert read(("creep see also shrinkage", 0.0))[0][1:5] == ("creep", None, "see_also", "shrinkage")
    assert b.index_entry("Begriff 0, 20") == ("Begriff 0", "20") and b.index_entry("12, 13") is None and b.index_entry(" ".join(["w"] * 13) + " 4") is None


def test_no_lines(spark):
    assert b.subject_index(spark.createDataFrame([], SCHEMA), "book", "at", "text", "indent").count() == 0
    assert b.contents_list(spark.createDataFrame([(None, 1, "T .... 3", None)], SCHEMA), "book", "at", "text", "indent").first()["title"] == "T"
