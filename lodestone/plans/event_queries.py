"""Event log queries, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import catalog
from ..operators.ranking import top_by
from ..sources.tables import table
from ..streaming import claims
from ..streaming import events as log
from .registry import query


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INTEGER AS sequence FROM events")
def event_sequences(spark, sf_dir):
    return log.sequenced(table(spark, sf_dir, "events"), "user_id", "event_id").select("event_id", "user_id", "sequence")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 1000 ORDER BY event_id LIMIT 500")
def event_tail(spark, sf_dir):
    """The 500 events after a cursor."""
    return log.tail(table(spark, sf_dir, "events"), 1000, 500).select("event_id", "user_id", "event_type")


@query("""SELECT event_id, user_id, CASE WHEN ts < TIMESTAMP '2024-01-15' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90) THEN '{}' ELSE props END AS props FROM events""")
def event_compaction(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    active = e.where("event_type = 'purchase' AND value > 90").select("user_id")
    return log.compacted(e, F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"), active, "user_id", "props").select("event_id", "user_id", "props")


@query("""SELECT user_id, max_by(event_type, event_id) AS state, max(event_id) AS event_id, max_by(value, event_id) FILTER (event_type = 'purchase') AS last_purchase, count(*) AS n FROM events GROUP BY user_id""")
def entity_states(spark, sf_dir):
    """The state of each user as a fold of the log."""
    e = table(spark, sf_dir, "events")
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("state"), F.max("event_id").alias("event_id"), F.max_by("value", bought).alias("last_purchase"), F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)::INTEGER AS place FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-10'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3""")
def recent_events(spark, sf_dir):
    """A user's last three views within an age."""
    e = table(spark, sf_dir, "events").where((F.col("event_type") == "view") & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")))
    return top_by(e, ["user_id"], [F.col("event_id").desc()], 3, "place").select("user_id", "event_id", "place")


@query("""WITH f AS (SELECT user_id, event_type, event_id, sha256(props) AS h, first_value(sha256(props)) OVER w AS fh, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id))
SELECT event_id, CASE WHEN r = 1 THEN 'new' WHEN h = fh THEN 'reused' ELSE 'conflict' END AS outcome FROM f""")
def idempotent_requests(spark, sf_dir):
    return catalog.idempotent(table(spark, sf_dir, "events"), ["user_id", "event_type"], "props", "event_id").select("event_id", "outcome")


@query("""SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) FILTER (value IS NOT NULL) AS value, max_by(props, event_id) FILTER (props IS NOT NULL) AS props FROM events GROUP BY user_id""")
def latest_columns(spark, sf_dir):
    """Updates folded column by column."""
    return catalog.latest(table(spark, sf_dir, "events"), ["user_id"], "event_id", ["event_type", "value", "props"])


@query("""SELECT user_id, event_id, round(epoch(ts - first_value(ts) OVER w) / greatest(count(*) OVER w - 1, 1), 3)::DOUBLE AS seconds_each FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""")
def progress_rate(spark, sf_dir):
    """Seconds an event took over the last eight of its user."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-7, 0)
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return e.select("user_id", "event_id", F.round((F.col("at") - F.first("at").over(w)) / F.greatest(F.count(F.lit(1)).over(w) - 1, F.lit(1)), 3).alias("seconds_each"))


@query("""SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_daily_counts(spark, sf_dir):
    """Tumbling windows over the event stream with a watermark."""
    e = log.event_stream(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "2 hours")
    counted = e.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    out = log.drained(counted, log.scratch(spark), "complete")
    return out.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("day"), "n", F.round("total", 4).alias("total"))


@query("SELECT DISTINCT event_id, event_type, user_id FROM events")
def stream_deduplicated(spark, sf_dir):
    """Replayed events dropped by their id: the stream reads every event twice."""
    e = log.event_stream(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    twice = e.union(e).withWatermark("at", "60 days").dropDuplicates(["event_id"])
    return log.drained(twice.select("event_id", "event_type", "user_id"), log.scratch(spark))


@query(r"""WITH c AS (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM conversations WHERE role = 'assistant'),
x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS n FROM c)
SELECT conv_id, n, 'C' || (turn + 1) AS claim_id, md5(text) AS digest FROM x""")
def claim_stream(spark, sf_dir):
    """Claims of each conversation out of a stream of deltas, each of which ends one claim's block and begins the next."""
    schema = table(spark, sf_dir, "conversations").schema
    turns = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/conversations.parquet*")
    block = F.concat(F.lit(claims.OPEN), F.to_json(F.struct(F.concat(F.lit("C"), F.col("turn") + 1).alias("id"), "text")), F.lit(claims.CLOSE))
    half = F.floor(F.length("block") / 2).cast("int")
    said = turns.select("conv_id", "turn", F.when(F.col("role") == "assistant", block).otherwise("...").alias("block"))
    parts = F.array(F.struct((2 * F.col("turn")).alias("seq"), F.substring("block", 1, half).alias("delta")), F.struct((2 * F.col("turn") + 1).alias("seq"), F.substr("block", half + 1).alias("delta")))
    deltas = said.select("conv_id", F.explode(parts).alias("p")).select("conv_id", "p.*")
    found = log.drained(claims.claims_of(deltas, "conv_id", "seq", "delta", most_buffer=10_000_000, most_block=10_000_000, most_text=10_000_000), log.scratch(spark))
    return found.where("error IS NULL").select(F.col("stream").cast("long").alias("conv_id"), "n", "claim_id", F.md5("text").alias("digest"))
