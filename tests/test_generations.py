"""Commits of generations and imports that are broken off between their steps."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.sources.generations import Conflict, Import, Store


def two(spark, n):
    return {"books": spark.range(n), "terms": spark.range(2 * n).select(F.col("id").alias("term"))}


def test_readers_see_one_generation(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    assert s.manifest() is None and s.commit(two(spark, 3)) == 1
    old = s.read("books")
    assert s.commit(two(spark, 5), request="r") == 2 and s.commit(two(spark, 9), request="r") == 2
    assert (old.count(), s.read("books").count(), s.read("terms").count(), s.read("terms", 1).count()) == (3, 5, 10, 6)
    assert s.restore(1) == 3 and s.read("books").count() == 3 and s.manifest()["restored"] == 1
    with pytest.raises(ValueError):
        s.read("books", schema=spark.createDataFrame([], "other long").schema)


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    s.commit(two(spark, 3))
    bad = two(spark, 4) | {"late": spark.range(9).select(F.raise_error(F.lit("broken")).alias("x"))}
    with pytest.raises(Exception, match="broken"):
        s.commit(bad)
    with pytest.raises(ValueError, match="terms: too many"):
        s.commit(two(spark, 4), check=lambda name, df: "too many" if df.count() > 7 else None)
    assert s.versions() == [1] and len(s.names("generations")) == 1 and s.read("books").count() == 3


def test_two_writers_of_one_parent(spark, tmp_path, monkeypatch):
    s = Store(spark, f"file://{tmp_path}")
    s.commit(two(spark, 1))
    s.commit(two(spark, 2), parent=1)
    with pytest.raises(Conflict):
        s.commit(two(spark, 3), parent=1)
    (tmp_path / "manifests" / f"{3:012d}.claim").touch()  # a writer that has claimed the next number
    with pytest.raises(Conflict):
        s.commit(two(spark, 4))
    monkeypatch.setattr("lodestone.sources.generations.STALE", -1)  # and never finished
    assert s.commit(two(spark, 4)) == 4 and s.read("books").count() == 4
    assert len(s.names("generations")) == 3 and len(s.vacuum(keep=1, age=0)) == 2 and s.read("books").count() == 4


def test_import_stopped_between_data_and_manifest(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(f"r{i % 4}", i) for i in range(20)], "part string, n int")
    imp = Import(spark, f"file://{tmp_path}", "part")
    assert imp.run(df.where("part = 'r0'")) == 1
    with monkeypatch.context() as m:
        m.setattr(Store, "put", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            imp.run(df)
    with monkeypatch.context() as m:  # a driver that dies can't clean up
        m.setattr(Store, "put", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
        m.setattr(imp.store, "fs", type("Deaf", (), {"delete": lambda *a: None, "__getattr__": lambda self, k, f=imp.store.fs: getattr(f, k)})())
        with pytest.raises(RuntimeError):
            imp.run(df)
    assert len(list(Path(tmp_path, "generations").iterdir())) == 2
    assert sorted(r.n for r in imp.data().collect()) == [0, 4, 8, 12, 16]
    assert imp.run(df) == 3 and imp.run(df) == 0
    assert sorted(r.n for r in imp.data().collect()) == list(range(20))
    changed = df.where("part = 'r1'").withColumn("n", F.col("n") + 100)
    assert imp.run(changed) == 1 and imp.run(changed) == 0
    assert sorted(r.n for r in imp.data().collect()) == sorted([i for i in range(20) if i % 4 != 1] + [101, 105, 109, 113, 117])
