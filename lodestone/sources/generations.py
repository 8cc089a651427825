"""Whole generations of several tables, committed by one manifest; imports that go on after a crash."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Seconds after which a commit that claimed its number and never finished no longer stands in the way.
STALE = 3600


class Conflict(RuntimeError):
    """Another commit came first."""


class Store:
    """A folder with generations/ID/TABLE and manifests/NUMBER.json, in any file system that Spark reads.

    Tables are written by Spark to a generation's own folder. Only then the next number is claimed, by a file that one
    writer can create, and the manifest gets its name. Readers take the highest manifest, so they see all tables of one
    generation or those of the one before; a write that fails is deleted, and one whose driver dies is never named.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.Path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, *parts: str):
        return self.Path("/".join([self.path, *parts]))

    def names(self, folder: str) -> list[str]:
        there = self.at(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(there)] if self.fs.exists(there) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.names("manifests") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """The given or latest manifest; None before the first commit."""
        known = self.versions()
        if not known:
            return None
        number = known[-1] if version is None else version
        text = "\n".join(r[0] for r in self.spark.read.text(f"{self.path}/manifests/{number:012d}.json", wholetext=True).collect())
        return json.loads(text)

    def put(self, manifest: dict, parent: int) -> int:
        """Claims a number after `parent` and writes the manifest under it."""
        if (self.versions() or [0])[-1] != parent:
            raise Conflict(f"version {parent} is no longer the latest")
        number = parent
        while True:
            number += 1
            claim = self.at("manifests", f"{number:012d}.claim")
            if self.fs.createNewFile(claim):
                break
            if time.time() - self.fs.getFileStatus(claim).getModificationTime() / 1000 < STALE:
                raise Conflict(f"version {number} is being written")
        own = self.at("manifests", f".{uuid.uuid4().hex}")
        out = self.fs.create(own, True)
        out.write(bytearray(json.dumps(manifest | {"version": number}, sort_keys=True).encode()))
        out.close()
        if (self.versions() or [0])[-1] != parent or not self.fs.rename(own, self.at("manifests", f"{number:012d}.json")):
            self.fs.delete(own, False)
            raise Conflict(f"version {parent} is no longer the latest")
        return number

    def commit(self, tables: dict[str, DataFrame], request: str | None = None, parent: int | None = None, check: Callable[[str, DataFrame], str | None] | None = None, extra: dict | None = None) -> int:
        """Writes a generation of all tables and makes it the latest; its version. A request id that has been committed
        gives that version and writes nothing. parent: the version it is based on (by default the latest); Conflict if
        another came first. check(name, written table) may name a fault: then nothing is committed."""
        before = self.manifest()
        base = (before["version"] if before else 0) if parent is None else parent
        if request is not None:
            for v in reversed(self.versions()):
                if self.manifest(v)["request"] == request:
                    return v
        generation = uuid.uuid4().hex
        folder = f"{self.path}/generations/{generation}"
        try:
            told = {}
            for name, df in tables.items():
                df.write.parquet(f"{folder}/{name}")
                written = self.spark.read.schema(df.schema).parquet(f"{folder}/{name}")
                fault = check and check(name, written)
                if fault:
                    raise ValueError(f"{name}: {fault}")
                told[name] = {"rows": written.count(), "schema": json.loads(df.schema.json())}
            return self.put({"generation": generation, "request": request, "parent": base, "tables": told} | (extra or {}), base)
        except BaseException:
            self.fs.delete(self.at("generations", generation), True)
            raise

    def read(self, name: str, version: int | None = None, schema: StructType | None = None) -> DataFrame:
        """A table of the given or latest version; an error if it has other columns or rows than its manifest says."""
        m = self.manifest(version)
        if m is None or name not in m["tables"]:
            raise KeyError(f"no table {name}")
        kept = StructType.fromJson(m["tables"][name]["schema"])
        if schema is not None and {(f.name, f.dataType) for f in schema} != {(f.name, f.dataType) for f in kept}:
            raise ValueError(f"{name} has other columns than asked for")
        return self.spark.read.schema(kept).parquet(f"{self.path}/generations/{m['generation']}/{name}")

    def restore(self, version: int) -> int:
        """Makes an earlier version's generation the latest again, all tables or none."""
        m = self.manifest(version)
        for name, told in m["tables"].items():
            if self.read(name, version).count() != told["rows"]:
                raise ValueError(f"{name} of version {version} is not whole")
        last = self.versions()[-1]
        return self.put(m | {"parent": last, "request": None, "restored": version}, last)

    def vacuum(self, keep: int = 2, age: float = STALE) -> list[str]:
        """Deletes generations that none of the last `keep` versions names and that are older than `age` seconds."""
        live = {self.manifest(v)["generation"] for v in self.versions()[-keep:]}
        old = [n for n in self.names("generations") if n not in live and time.time() - self.fs.getFileStatus(self.at("generations", n)).getModificationTime() / 1000 >= age]
        for n in old:
            self.fs.delete(self.at("generations", n), True)
        for v in self.versions()[:-keep]:
            self.fs.delete(self.at("manifests", f"{v:012d}.json"), False)
        return old


def content(df: DataFrame, by: str) -> DataFrame:
    """(range, hash): a digest of each range's rows that doesn't hang on their order."""
    h = F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")
    return df.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("")).alias("range")).agg(F.concat_ws("/", F.count(F.lit(1)), F.sum(h)).alias("hash"))


class Import:
    """An import by ranges that may stop anywhere. Each run commits the ranges that are new or changed, data and ledger
    in one generation; what a broken run has written counts for nothing, and the next run writes it again. A null range is
    one with the empty one."""

    def __init__(self, spark: SparkSession, path: str, by: str):
        self.store, self.by = Store(spark, path), by

    def parts(self) -> list[int]:
        return self.store.versions()

    def ledger(self) -> DataFrame:
        """(range, hash, version): the version that holds each range's rows, the last that wrote it."""
        spark = self.store.spark
        all_parts = [self.store.read("ledger", v).withColumn("version", F.lit(v).cast("long")) for v in self.parts()]
        empty = spark.createDataFrame([], "range string, hash string, version long")
        for p in all_parts:
            empty = empty.unionByName(p)
        return empty.groupBy("range").agg(F.max_by("hash", "version").alias("hash"), F.max("version").alias("version"))

    def run(self, df: DataFrame) -> int:
        """Ranges of df that are written now; those with the content that the ledger has are left out."""
        new = content(df, self.by).join(self.ledger().drop("version"), ["range", "hash"], "left_anti")
        left = df.withColumn("_range", F.coalesce(F.col(self.by).cast("string"), F.lit("")))
        left = left.join(new.select(F.col("range").alias("_range")), "_range", "left_semi")
        n = new.count()
        if n:
            self.store.commit({"data": left, "ledger": new.select("range", "hash")})
        return n

    def data(self) -> DataFrame:
        """All rows imported, each range as its last version has it."""
        live = self.ledger().select(F.col("range").alias("_range"), "version")
        out = None
        for v in self.parts():
            rows = self.store.read("data", v).join(live.where(F.col("version") == v).select("_range"), "_range", "left_semi").drop("_range")
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            raise KeyError("nothing imported")
        return out
