"""The event log as a stream and as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import shared_dir


def sequenced(events: DataFrame, entity: str, order: str) -> DataFrame:
    """Adds sequence, each entity's own count from 1 in the order of the log."""
    return events.withColumn("sequence", F.row_number().over(Window.partitionBy(entity).orderBy(order)))


def tail(events: DataFrame, cursor: int, most: int, id_col: str = "event_id") -> DataFrame:
    """The next events after a cursor. A replay from the same cursor gives the same rows."""
    return events.where(F.col(id_col) > cursor).orderBy(id_col).limit(most)


def compacted(events: DataFrame, expired, active: DataFrame, entity: str, payload: str) -> DataFrame:
    """Expired payloads emptied, envelopes kept; entities in `active` are exempt."""
    marked = events.join(active.select(entity).distinct().withColumn("_live", F.lit(True)), entity, "left")
    return marked.withColumn(payload, F.when(expired & F.col("_live").isNull(), F.lit("{}")).otherwise(F.col(payload))).drop("_live")


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a streaming plan over what its source holds now and read its output.

    The output and the checkpoint lie in `folder`, so an interrupted run goes on where it stopped.
    """
    spark = stream.sparkSession
    out, state = f"{folder}/out", f"{folder}/checkpoint"
    if mode == "append":
        stream.writeStream.format("parquet").option("checkpointLocation", state).option("path", out).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def put(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/{epoch}")
        df.sparkSession.createDataFrame([(epoch,)], "epoch long").write.mode("overwrite").parquet(f"{folder}/last")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.schema("epoch long").parquet(f"{folder}/last").first()[0]
    return spark.read.schema(stream.schema).parquet(f"{out}/{last}")


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir."""
    return f"{shared_dir(spark)}/lodestone-stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
