"""The pipeline's stages, each on its predecessor's rows, and the queries' registration."""

import random

import corpus_pipeline
from lodestone.llm import queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    random.seed(11)
    words = ["".join(random.choice("bcdfgklmnprst") + random.choice("aeiou") for _ in range(random.randrange(1, 4))) for _ in range(500)]
    sentence = lambda: " ".join(random.choice(words) for _ in range(9)) + "."
    rows, labels = [], []
    boiler = [sentence() for _ in range(4)]
    for i in range(240):
        body = [sentence() for _ in range(random.randrange(4, 12))]
        if i % 8 == 0:
            body[0] += " grobian vileness"
        if i % 5 == 1:
            body += boiler
        rows.append((i, "\n".join(body), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(i % 8 == 0)))
    base = rows[9][1].replace("\n", " ")
    rows += [(300 + k, base.replace("grobian", "") + f" tail{k}", "en", "s1", 0) for k in range(3)]
    rows += [(400, None, None, None, None), (401, "", "en", "s1", 0), (402, rows[3][1], "en", "s0", 0)]
    return rows, labels


def test_stages_follow_each_other(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == COLUMNS
    tox = {r.doc_id for r in seen["toxicity"].collect()}
    assert sum(i in tox for i in range(0, 240, 8)) <= 3 and all(i in tox for i in range(240) if i % 8)
    lines = {r.doc_id: r.text for r in seen["line dedup"].collect()}
    assert 400 in lines and lines[400] is None and 402 not in lines
    assert lines[2] == dict((r[0], r[1]) for r in rows)[2]
    near = {r.doc_id for r in seen["minhash"].collect()}
    assert near & {9, 300, 301, 302} == {9}
    mixed = [r.doc_id for r in seen["mixing"].collect()]
    assert len(mixed) == len(set(mixed)) and set(mixed) <= near
    assert {r.doc_id for r in seen["packing"].collect()} == set(mixed)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["packing"].count()


def test_an_empty_table_passes_every_stage(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    none = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == COLUMNS), name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_line_dedup_takes_two_lines_of_fifty_words(spark):
    two = "\n".join(" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(0, f"first\n{two}", "en", "s0", 0), (1, f"second\n{two}\nend", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {0: rows[0][1], 1: "second\nend"}


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.ORACLE) <= set(queries.QUERIES)
