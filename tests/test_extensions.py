"""Literals, normal forms, extension points, resumed writes and near hashes on small fixtures."""

import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators import extensions as ext
from lodestone.plans import catalogue
from lodestone.sources import tables


def test_literals_match_pythons(spark):
    random.seed(51)
    parts = ["DIN EN 1992-1-1", "ISO 9001:2015", "3,5 mm", "+4e-3", "10 – 20 kN", "5 bis 7 %", "C30/37", "A-B", "x_1", "σ_max", "ä5", "5ä", "[E12]", "12.", "word", "300 MPa", "7 tons", "\n", "Größe 4 m²", "v2.0", "_9", "A_b"]
    texts = [" ".join(random.choice(parts) for _ in range(random.randrange(1, 9))) for _ in range(400)] + ["", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", t.technical_literals(F.col("s")).alias("x"), t.strictly_supported(F.col("s"), F.concat("s", F.lit("\n42"))).alias("ok")).collect()
    pattern = re.compile(t.LITERAL.replace("(?iU)", "(?i)"))
    for r in rows:
        if texts[r.i] is None:
            assert r.x is None
        else:
            clean = re.sub(t.EVIDENCE_MARK, "", unicodedata.normalize("NFKC", texts[r.i]))
            assert set(r.x) == {re.sub(r"\s+", "", m[0]).lower() for m in pattern.finditer(clean)}, texts[r.i]
            assert r.ok


def test_sentence_offsets_point_into_the_text(spark):
    random.seed(52)
    texts = ["".join(random.choice(["ab", "c.", " ", "\n", "! ", "? ", "d", "1.5"]) for _ in range(random.randrange(30))) for _ in range(200)]
    for r in spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", t.sentence_offsets(F.col("s")).alias("x")).collect():
        want = [x.strip() for x in re.split(r"(?<=[.!?])\s+", texts[r.i]) if x.strip()]
        assert [texts[r.i][a.start : a.stop] for a in r.x] == want


def test_normal_forms_match_unicodedata(spark):
    texts = ["ﬁne Ⅷ ½", "Ａ１ é", "Straße ÀÉ Łódź", "Ελλάδα ά", "плохо й", "日本", "", None, "plain"]
    for r in spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", t.nfkc(F.col("s")).alias("c"), t.any_book_text(F.col("s")).alias("b")).collect():
        s = texts[r.i]
        assert r.c == (None if s is None else unicodedata.normalize("NFKC", s))
        if s is not None:
            plain = "".join(c for c in unicodedata.normalize("NFKD", s.replace("ß", "ss")) if not unicodedata.combining(c)).lower()
            assert r.b == re.sub(r"[\W_]+", " ", plain).strip()


def test_a_patch_may_not_touch_content(spark):
    df = spark.createDataFrame([(1, "text", "old")], "id int, text string, heading string")
    assert ext.patched(df, lambda x: x.withColumn("heading", F.lit("new")), "id", ["text"]).first().heading == "new"
    with pytest.raises(Exception, match="patch changed 1"):
        ext.patched(df, lambda x: x.withColumn("text", F.lit("other")), "id", ["text"]).collect()


def test_providers_rerankers_and_verifiers(spark):
    docs = spark.createDataFrame([(1, "red stone wall", [1.0, 0.0]), (2, "blue water", [0.0, 1.0]), (3, "red water", [1.0, 1.0])], "doc_id int, text string, v array<double>")
    queries = spark.createDataFrame([(7, "red wall")], "q int, text string")
    found = ext.FullText(docs, "doc_id", "q", lambda c: F.split(c, " ")).search(queries, 2).orderBy("rank").collect()
    assert [r.item for r in found] == [1, 3] and found[0].query == 7
    near = ext.Dense(docs, "doc_id", "v").search(docs.where("doc_id = 3"), 2)
    assert sorted(r.item for r in near.collect()) == [1, 2]
    pairs = docs.select(F.lit(7).alias("q"), "doc_id", F.lit("red wall").alias("question"), "text")
    assert [r.doc_id for r in ext.reranked(pairs, "q", "doc_id", "question", "text", ext.SharedWords(), 2).orderBy("rank").collect()] == [1, 3]
    claims = ext.verified(pairs, "question", "text", ext.SharedWords()).collect()
    assert {r.doc_id: r.verdict for r in claims} == {1: "supported", 2: "refuted", 3: "supported"}
    assert ext.verified(pairs, "question", "text", None).first().verdict == "unknown"


def test_an_import_goes_on_where_it_stopped(spark, tmp_path):
    df = spark.createDataFrame([(f"r{i % 4}", i) for i in range(20)], "part string, n int")
    tables.resume(df.where("part IN ('r0', 'r1')"), str(tmp_path), "part")
    tables.resume(df, str(tmp_path), "part")
    assert sorted(r.n for r in tables.resume(df, str(tmp_path), "part").collect()) == list(range(20))
    tables.export_tables({"a": df, "b": df.where("n > 5")}, f"{tmp_path}/all", "part")
    assert spark.read.parquet(f"{tmp_path}/all/b").count() == 14
    for at, n in (("2024-01-01", 1), ("2024-02-01", 2)):
        tables.save_report(spark.createDataFrame([(n,)], "n int"), f"{tmp_path}/reports", at)
    assert [r.n for r in tables.latest_report(spark, f"{tmp_path}/reports").collect()] == [2]


def test_a_patch_keeps_every_chunk(spark):
    chunks = spark.createDataFrame([(i, f"text {i}", "h") for i in range(6)], "id long, text string, heading string")
    good = ext.patched(chunks, lambda c: c.withColumn("heading", F.lit("new")), "id", ["text"])
    assert sorted((r.id, r.heading) for r in good.collect()) == [(i, "new") for i in range(6)]
    wrong = {
        "changed": lambda c: c.withColumn("text", F.concat("text", F.lit("!"))),
        "dropped": lambda c: c.where("id <> 3"),
        "doubled": lambda c: c.unionByName(c.where("id = 2")),
        "added": lambda c: c.withColumn("id", F.when(F.col("id") == 1, 99).otherwise(F.col("id"))),
    }
    for what, patch in wrong.items():
        with pytest.raises(Exception, match="patch (changed|dropped|doubled|added)"):
            ext.patched(chunks, patch, "id", ["text"]).collect()
            raise AssertionError(what)


def test_near_hashes_find_planted_neighbours(spark, tmp_path):
    rng = np.random.default_rng(53)
    base = rng.normal(size=(40, 64))
    rows = [v for v in base]
    for i in range(40):
        v = base[i].copy()
        v[rng.choice(64, i % 9, replace=False)] *= -1
        rows.append(v)
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.a, r.b): r.distance for r in catalogue.QUERIES["near_perceptual_hashes"](spark, str(tmp_path)).collect()}
    bits = np.array(rows) > 0
    first = {i: min(j for j in range(80) if (bits[i] == bits[j]).all()) for i in range(80)}
    want = {(a, b): int((bits[a] != bits[b]).sum()) for a in set(first.values()) for b in set(first.values()) if a < b and (bits[a] != bits[b]).sum() <= 6}
    assert got == want and len(want) > 15
    assert {r.vec_id: r.rep for r in catalogue.QUERIES["equal_perceptual_hashes"](spark, str(tmp_path)).collect()} == first
