"""Purge of parts out of JSON: orders as jobs whose sources are their lines; a part had other ids in former generations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import purge
from ..sources.tables import staged, table
from .registry import query

PAIRS = """src AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, CASE WHEN l_linenumber % 2 = 1 THEN '' ELSE 'old-' END || 'part-' || lpad(l_partkey::VARCHAR, 6, '0') || CASE WHEN l_linenumber % 2 = 1 THEN '' ELSE '-' || (l_suppkey % 4) END AS a,
  'file-' || lpad(l_partkey::VARCHAR, 6, '0') || '-' || (l_suppkey % 3) AS b, 'after part-' || lpad((l_partkey + l_suppkey % 5)::VARCHAR, 6, '0') AS c FROM lineitem),
pairs AS (SELECT DISTINCT a, b FROM src),
refs AS (SELECT p_partkey AS target, 'part-' || lpad(p_partkey::VARCHAR, 6, '0') AS reference FROM part WHERE p_size = 1 UNION SELECT target, unnest([a, b]) FROM refs JOIN pairs ON reference IN (a, b))"""


def sources(spark, sf_dir):
    """(record, l): orders with their lines' numbers, which are all that is shuffled of them; an order's lines are bounded."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), "l_linenumber", "l_partkey", "l_suppkey").repartition("record")
    return l.groupBy("record").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("l"))


def jobs(of):
    """Orders as jobs with their lines as a list of sources in JSON, written where the order is."""
    s = lambda c: c.cast("string")

    def source(x):
        part = F.lpad(s(x["l_partkey"]), 6, "0")
        name = F.when(x["l_linenumber"] % 2 == 1, F.concat(F.lit("part-"), part)).otherwise(F.concat(F.lit("old-part-"), part, F.lit("-"), s(x["l_suppkey"] % 4)))
        file = F.concat(F.lit("file-"), part, F.lit("-"), s(x["l_suppkey"] % 3))
        note = F.concat(F.lit("after part-"), F.lpad(s(x["l_partkey"] + x["l_suppkey"] % 5), 6, "0"))
        return F.struct(name.alias("document_id"), file.alias("source"), note.alias("note"))

    return of.select(F.lit("w").alias("scope"), "record", F.to_json(F.struct(F.transform("l", source).alias("sources"))).alias("text"))


def references(spark, sf_dir, records):
    target = F.concat(F.lit("part-"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"))
    seeds = table(spark, sf_dir, "part").where("p_size = 1").select(F.lit("w").alias("scope"), F.col("p_partkey").alias("target"), target.alias("reference"))
    return purge.followed(purge.leads(records), seeds)


@query(f"WITH RECURSIVE {PAIRS} SELECT target, reference FROM refs")
def learned_references(spark, sf_dir):
    """All names of the smallest parts: ids of former generations and files, learnt from records of theirs to a fixpoint."""
    return references(spark, sf_dir, jobs(sources(spark, sf_dir))).select("target", "reference")


@query(f"""WITH RECURSIVE {PAIRS}, names AS (SELECT list(reference ORDER BY length(reference) DESC, reference) AS r FROM (SELECT DISTINCT reference FROM refs)),
x AS (SELECT o, n, p, s, a, b, c, list_contains(r, a) OR list_contains(r, b) AS own, list_reduce(list_prepend(a, r), lambda t, y: replace(t, y, '[purged-document]')) AS a2, list_reduce(list_prepend(b, r), lambda t, y: replace(t, y, '[purged-document]')) AS b2,
  list_reduce(list_prepend(c, r), lambda t, y: replace(t, y, '[purged-document]')) AS c2 FROM src, names),
w AS (SELECT o, bool_or(own OR a <> a2 OR b <> b2 OR c <> c2) AS hit,
  '{{"sources":[' || string_agg('{{"document_id":"' || a || '","source":"' || b || '","note":"' || c || '"}}', ',' ORDER BY n, p, s, a, b, c) || ']}}' AS before,
  '{{"sources": [' || coalesce(string_agg('{{"document_id": "' || a2 || '", "source": "' || b2 || '", "note": "' || c2 || '"}}', ', ' ORDER BY n, p, s, a, b, c) FILTER (NOT own), '') || ']}}' AS after FROM x GROUP BY o)
SELECT o AS record, CASE WHEN hit THEN 'changed' ELSE 'kept' END AS state, sha256(CASE WHEN hit THEN after ELSE before END) AS digest FROM w""")
def purged_payloads(spark, sf_dir):
    """Each job's payload without the smallest parts: their sources are gone, their names struck out of other notes."""
    j = jobs(staged(sources(spark, sf_dir), "sources"))
    return purge.scrubbed(j, references(spark, sf_dir, j)).select("record", "state", F.sha2("text", 256).alias("digest"))


@query(f"""WITH RECURSIVE {PAIRS} SELECT DISTINCT target, o AS record FROM refs JOIN (SELECT * FROM src JOIN orders ON o_orderkey = o WHERE o_orderpriority = '1-URGENT')
  ON contains(a, reference) OR contains(b, reference) OR contains(c, reference)""")
def pinned_mentions(spark, sf_dir):
    """Urgent jobs that hold up the purge of a part, as they tell of it under any name it ever had."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("record"), F.lit(True).alias("urgent")).distinct()
    of = staged(sources(spark, sf_dir).join(urgent, "record", "left"), "sources")
    return purge.blockers(jobs(of.where("urgent")), references(spark, sf_dir, jobs(of)))


@query(f"""WITH RECURSIVE {PAIRS}, placed AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY n, p, s) - 1 AS entry FROM src)
SELECT DISTINCT o AS record, entry::INTEGER AS entry FROM placed JOIN (SELECT DISTINCT reference FROM refs) ON contains(a, reference) OR contains(b, reference) OR contains(c, reference)""")
def struck_sources(spark, sf_dir):
    """Places of jobs' sources that go with a purge, for all that hangs on a place to go too."""
    j = jobs(staged(sources(spark, sf_dir), "sources"))
    refs = references(spark, sf_dir, j)
    return purge.struck_entries(j.select("scope", "record", F.col("text").alias("payload"), F.lit(None).cast("string").alias("result")), refs).select("record", "entry")
