"""From documents to packed sequences: the stages in order, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import toxicity as tox
from lodestone.llm.common import documents, shared_dir
from lodestone.llm.lines import remove_repeated_runs
from lodestone.llm.mixing import MIX, Mix, mixture
from lodestone.llm.near import keep_first
from lodestone.llm.packing import pack
from lodestone.llm.queries import vocabulary

#: Documents come once at most, in nine tenths of all tokens.
PIPELINE_MIX = Mix(MIX.weights, share=(9, 10), epochs=1)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold, by a model of the labelled ones among them; null texts stay."""
    return tox.keep_clean(docs, tox.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of runs of lines, of three lines or 50 words; n_chars follows the text. A document of which nothing is left goes;
    one that was null or blank before stays."""
    left = remove_repeated_runs(docs, by_words=True)
    n_removed = left.columns[-2]
    rest = left.where((F.col(n_removed) == 0) | (F.col("text") != "")).select(docs.columns)
    return rest.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return keep_first(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the budgets of PIPELINE_MIX."""
    return mixture(docs, PIPELINE_MIX).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens from what is left."""
    return pack(docs, vocabulary())


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("minhash", minhash), ("mixing", mixing), ("packing", packing)]

#: Learned scores, hashed signatures and a tokenizer's ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    base = f"{shared_dir(spark)}/lodestone-pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
