"""Readers and writers of the engine's tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .generations import Import


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one on a single machine, and an error on a
    cluster, whose executors don't share folders."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return base or "file://" + tempfile.mkdtemp(prefix="lodestone-")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder once, to be read several times; the folder goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a part that a task sorts or groups, about.
PART_ROWS = 500_000


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df, of about so many rows, dealt by `by` into parts of PART_ROWS: groups and windows of these keys need no other
    shuffle, and what a task holds stays as it is while the table grows. Spark does not merge parts of a number asked for."""
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(least, -(-rows // PART_ROWS)), *by)


def fingerprint(df: DataFrame) -> str:
    """Of the files that df reads: their paths, sizes and times, by file metadata alone."""
    of = F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    files = df.select(of.alias("h")).distinct()
    return str(files.agg(F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)"))).first())


def with_schema(df: DataFrame, schema: StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """df in the columns of schema: missing ones are filled, others dropped, types cast. An additive migration."""
    defaults = defaults or {}
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(f.name) if f.name.lower() in have else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema])


def inspected_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified, fingerprint) of files, by their content's sha-256."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("fingerprint"))


def publish(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Write a whole generation; dynamic partition overwrite keeps the others."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def restored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A snapshot read back; fails if a column is missing or of another type."""
    df = spark.read.parquet(path)
    found = {f.name: f.dataType for f in df.schema}
    wrong = [f.name for f in schema if found.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"snapshot lacks or retypes columns {wrong}")
    return df.select(*[f.name for f in schema])


def export_tables(tables: dict[str, DataFrame], path: str, by: str) -> None:
    """All tables of a workspace under one folder, each in partitions of `by`."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy(by).parquet(f"{path}/{name}")


def resume(df: DataFrame, path: str, by: str) -> DataFrame:
    """Import the ranges of `by` that are new or have changed, and give all that has been imported. Data and ledger are
    one commit, so a run that breaks off anywhere leaves no rows behind, and a second run none twice."""
    job = Import(df.sparkSession, path, by)
    job.run(df)
    return job.data()


def save_report(report: DataFrame, path: str, at: str) -> None:
    """Append a report under its time; the history stays."""
    report.withColumn("reported_at", F.lit(at)).write.mode("append").json(path)


def latest_report(spark: SparkSession, path: str) -> DataFrame:
    reports = spark.read.json(path)
    last = reports.agg(F.max("reported_at").alias("reported_at"))
    return reports.join(F.broadcast(last), "reported_at", "left_semi")
