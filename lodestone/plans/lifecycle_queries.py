"""Libraries, purges, resumed imports, registries and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import catalog, validation
from ..operators.ranking import top_by
from ..sources.tables import staged, table
from .registry import query

LIBRARY = """lib AS (SELECT doc_id, lang, source || '/' || lang AS work_id, substr(text, 1, 30) AS title, (doc_id % 4)::INTEGER AS edition_number, (doc_id % 4)::VARCHAR || 'e' AS edition_label,
  (1990 + doc_id % 30)::INTEGER AS publication_year, CASE WHEN doc_id % 7 = 0 THEN 'superseded' ELSE 'active' END AS document_status,
  [source, 'A' || (doc_id % 5)] AS authors, ['i' || (doc_id % 11)] AS isbn, CASE WHEN n_chars > 500 THEN ['long', lang] ELSE [lang] END AS tags FROM documents)"""


def library(spark, sf_dir):
    """documents with the metadata of a library made from their ids."""
    i = F.col("doc_id")
    number = (i % 4).cast("int")
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.concat_ws("/", "source", "lang").alias("work_id"), F.substring("text", 1, 30).alias("title"), number.alias("edition_number"), F.concat(number.cast("string"), F.lit("e")).alias("edition_label"),
        (1990 + i % 30).cast("int").alias("publication_year"), F.when(i % 7 == 0, "superseded").otherwise("active").alias("document_status"),
        F.array("source", F.concat(F.lit("A"), (i % 5).cast("string"))).alias("authors"), F.array(F.concat(F.lit("i"), (i % 11).cast("string"))).alias("isbn"),
        F.when(F.col("n_chars") > 500, F.array(F.lit("long"), F.col("lang"))).otherwise(F.array("lang")).alias("tags"))


@query(f"""WITH {LIBRARY} SELECT doc_id, work_id FROM lib WHERE lower(lang) IN ('en', 'de', 'fr') AND list_has_any(list_transform(authors, lambda x: lower(x)), ['a1', 'a2', 'src3'])
  AND list_has_any(tags, ['long']) AND edition_label IN ('1e', '2e') AND publication_year IN (1991, 1992, 2001, 2002, 2005, 2006, 2010, 2013) AND list_has_any(isbn, ['i0', 'i1', 'i2', 'i3', 'i5', 'i7'])
  AND document_status = 'active'""")
def library_filter(spark, sf_dir):
    """Keys with one value or several, on columns and on lists, without regard to case."""
    filters = {"language": ["EN", "de", "Fr"], "author": ["a1", "A2", "SRC3"], "tags": "Long", "edition": ["1E", "2e"], "publication_year": [1991, 1992, 2001, 2002, 2005, 2006, 2010, 2013], "isbn": ["I0", "i1", "i2", "i3", "i5", "i7"], "document_status": "Active", "title": []}
    return catalog.library(library(spark, sf_dir), filters, "current-only").select("doc_id", "work_id")


@query(f"""WITH {LIBRARY}, f AS (SELECT * FROM lib WHERE list_has_any(tags, ['long']) AND document_status <> 'superseded'),
r AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY edition_number DESC, publication_year DESC, doc_id DESC) AS r FROM f) SELECT work_id, doc_id, edition_number FROM r WHERE r = 1""")
def library_current_only(spark, sf_dir):
    """Without a key that names a version only the latest edition of a work is left."""
    return catalog.library(library(spark, sf_dir), {"tags": ["long"]}, "current-only").select("work_id", "doc_id", "edition_number")


@query("""WITH a AS (SELECT unnest([NULL, [], ['s1', 'it''s']]) AS ids, unnest(['none', 'empty', 'some']) AS policy),
d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'it''s' ELSE 's' || (doc_id % 5) END AS segment FROM documents)
SELECT policy, doc_id FROM a JOIN d ON ids IS NULL OR list_contains(ids, segment)""")
def allowed_segments(spark, sf_dir):
    """No list lets everything through, an empty one nothing; quotes in ids are no matter of text."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "it's").otherwise(F.concat(F.lit("s"), (F.col("doc_id") % 5).cast("string"))).alias("segment"))
    parts = [d.where(catalog.allow_list(ids, "segment")).select(F.lit(name).alias("policy"), "doc_id") for name, ids in (("none", None), ("empty", []), ("some", ["s1", "it's"]))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""WITH p AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING sum((o_orderpriority = '1-URGENT')::INTEGER) > 0),
b AS (SELECT c_custkey, coalesce(string_agg(DISTINCT o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR) FILTER (o_orderpriority = '1-URGENT'), '') AS pinned FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)
SELECT c_custkey, pinned <> '' AS blocked, sha256(pinned) AS blockers FROM b""")
def purge_blockers(spark, sf_dir):
    """Customers whose purge is held up by pinned orders, with a digest of these."""
    pinned = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.array_sort(F.collect_set(F.col("o_orderkey").cast("string"))), ",").alias("pinned"))
    c = table(spark, sf_dir, "customer").select("c_custkey").join(pinned, "c_custkey", "left").withColumn("pinned", F.coalesce("pinned", F.lit("")))
    return c.select("c_custkey", (F.col("pinned") != "").alias("blocked"), F.sha2("pinned", 256).alias("blockers"))


@query("""WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')),
o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone))
SELECT 'customer' AS tbl, count(*)::BIGINT AS n FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM gone) UNION ALL SELECT 'orders', count(*) FROM o
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone))""")
def purged_customers(spark, sf_dir):
    """Rows left of three tables after customers in debt without open orders go with all that hangs on them."""
    c, o, l = (table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem"))
    held = o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    gone = c.where("c_acctbal < 0").select("c_custkey").join(held, "c_custkey", "left_anti")
    orders_gone = o.join(gone.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    left = [("customer", catalog.without_keys(c, gone, ["c_custkey"])), ("orders", catalog.without_keys(o, gone.withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"])), ("lineitem", catalog.without_keys(l, orders_gone, ["l_orderkey"]))]
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n") for name, df in left]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH e AS (SELECT user_id, event_id AS k, event_id::VARCHAR AS d FROM events WHERE event_type = 'error'), {catalog.tree_digest_sql("e", "user_id")},
l AS (SELECT max(ts) AS now FROM events), t AS (SELECT user_id, max(ts) AS latest FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT user_id, n, 'plan-' || substr(digest, 1, 24) AS plan_id, latest + INTERVAL 15 DAY >= now AS valid, latest > now AS skewed FROM tree JOIN t USING (user_id), l""")
def purge_plans(spark, sf_dir):
    """Each user's errors as a purge plan: its id is the digest of what it takes, so a changed plan has another id; it
    expires, and one from the future is a clock's fault."""
    e = table(spark, sf_dir, "events")
    errors = e.where("event_type = 'error'")
    digests = catalog.tree_digest(errors, ["user_id"], F.col("event_id"), F.col("event_id").cast("string")).withColumnRenamed("digest", "plan")
    plan = digests.join(errors.groupBy("user_id").agg(F.max("ts").alias("latest")), "user_id")
    now = F.broadcast(e.agg(F.max("ts").alias("now")))
    return plan.join(now).select("user_id", "n", F.concat(F.lit("plan-"), F.substring("plan", 1, 24)).alias("plan_id"), (F.col("latest") + F.expr("INTERVAL 15 DAYS") >= F.col("now")).alias("valid"), (F.col("latest") > F.col("now")).alias("skewed"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber AS a, l_linenumber + CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE 0 END AS b FROM lineitem WHERE l_suppkey % 40 <> 0),
x AS (SELECT *, a - coalesce(lag(b) OVER (PARTITION BY l_orderkey ORDER BY a, b), 0) AS step FROM s), t AS (SELECT l_orderkey, max(l_linenumber) AS total FROM lineitem GROUP BY 1),
u AS (SELECT l_orderkey, max(step) AS most, min(step) AS least, max(b) AS e, any_value(total) AS total FROM x JOIN t USING (l_orderkey) GROUP BY 1)
SELECT l_orderkey, CASE WHEN least < 1 THEN 'overlap' WHEN most > 1 THEN 'gap' WHEN e <> total THEN 'short' END AS code FROM u WHERE least < 1 OR most > 1 OR e <> total""")
def page_coverage(spark, sf_dir):
    """An order's lines as ranges of pages, some lost and some too long: those that don't cover it exactly once."""
    l = table(spark, sf_dir, "lineitem")
    total = l.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("total"))
    s = l.where("l_suppkey % 40 <> 0").select("l_orderkey", F.col("l_linenumber").alias("a"), (F.col("l_linenumber") + (F.col("l_partkey") % 50 == 0).cast("int")).alias("b"))
    return catalog.contiguous(s.join(total, "l_orderkey"), "l_orderkey", "a", "b", F.col("total"))


@query("""WITH o AS (SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey % 5 AS owner, l_linenumber % 5 AS seen_in FROM lineitem)
SELECT l_partkey, count(*)::BIGINT AS n_owned, count(DISTINCT l_orderkey)::BIGINT AS n_evidence FROM o WHERE owner = seen_in GROUP BY 1""")
def owned_evidence(spark, sf_dir):
    """Evidence that a range sees in its halo counts only where its own page lies."""
    l = table(spark, sf_dir, "lineitem").where(F.col("l_suppkey") % 5 == F.col("l_linenumber") % 5)
    return l.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n_owned"), F.countDistinct("l_orderkey").alias("n_evidence"))


@query("""WITH saved AS (SELECT doc_id, source, sha256(text) AS h FROM documents WHERE doc_id % 17 <> 3), cur AS (SELECT doc_id, source, sha256(text || CASE WHEN doc_id % 91 = 5 THEN '.' ELSE '' END) AS h FROM documents),
j AS (SELECT coalesce(s.source, c.source) AS source, s.h AS a, c.h AS b FROM saved s FULL JOIN cur c ON s.doc_id = c.doc_id)
SELECT source, bool_and(coalesce(a = b, false)) AS resumable, sum((a IS NULL)::INTEGER)::BIGINT AS missing, sum((a <> b)::INTEGER)::BIGINT AS changed FROM j GROUP BY 1""")
def resumable_sources(spark, sf_dir):
    """A source's import goes on only if every saved chunk is there with the hash it had."""
    d = table(spark, sf_dir, "documents")
    saved = d.where("doc_id % 17 <> 3").select("doc_id", F.col("source").alias("s1"), F.sha2("text", 256).alias("a"))
    now = d.select("doc_id", F.col("source").alias("s2"), F.sha2(F.concat("text", F.when(F.col("doc_id") % 91 == 5, ".").otherwise("")), 256).alias("b"))
    j = saved.join(now, "doc_id", "full").select(F.coalesce("s1", "s2").alias("source"), "a", "b")
    return j.groupBy("source").agg(F.bool_and(F.coalesce(F.col("a") == F.col("b"), F.lit(False))).alias("resumable"), F.sum(F.col("a").isNull().cast("long")).alias("missing"), F.sum((F.col("a") != F.col("b")).cast("long")).alias("changed"))


@query("""WITH h AS (SELECT doc_id, max(quality) AS q FROM labels WHERE toxic = 1 GROUP BY 1)
SELECT doc_id, n_chars % 2 = 0 AND n_chars > 300 AS rebuilt FROM documents JOIN h USING (doc_id) WHERE lang = 'en'""")
def rebuilt_after_hiding(spark, sf_dir):
    """Hidden documents with a later generation: a join with a constant second key."""
    hidden = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    d = table(spark, sf_dir, "documents").where("lang = 'en'")
    return d.join(hidden, "doc_id").select("doc_id", ((F.col("n_chars") % 2 == 0) & (F.col("n_chars") > 300)).alias("rebuilt"))


@query("""WITH k AS (SELECT user_id, event_type, event_id, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, event_type, sum((before IS NOT NULL AND ts - before <= INTERVAL 1 DAY)::INTEGER)::BIGINT AS hits, sum((before IS NULL OR ts - before > INTERVAL 1 DAY)::INTEGER)::BIGINT AS misses, max(ts) AS last_used FROM k GROUP BY 1, 2""")
def answer_cache_hits(spark, sf_dir):
    """Requests answered from a cache whose entries live for a day after their last use."""
    place = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("hit", F.coalesce(F.col("ts") - F.lag("ts").over(place) <= F.expr("INTERVAL 1 DAY"), F.lit(False)))
    return e.groupBy("user_id", "event_type").agg(F.sum(F.col("hit").cast("long")).alias("hits"), F.sum((~F.col("hit")).cast("long")).alias("misses"), F.max("ts").alias("last_used"))


@query("""WITH l AS (SELECT user_id, event_type, value, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT user_id, event_type, event_id FROM l WHERE r = 1 AND event_type <> 'error'""")
def cache_registry(spark, sf_dir):
    """The last touch of each cache entry; entries whose last touch removed them are out."""
    last = top_by(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()], 1)
    return last.where("event_type <> 'error'").select("user_id", "event_type", "event_id")


@query("""WITH g AS (SELECT source, lang, max(doc_id) AS active FROM documents WHERE n_chars > 400 GROUP BY 1, 2) SELECT doc_id, d.source FROM documents d JOIN g USING (source, lang) WHERE doc_id < active AND n_chars <= 400""")
def retired_segments(spark, sf_dir):
    """Segments that a later generation replaced."""
    d = table(spark, sf_dir, "documents")
    active = d.where("n_chars > 400").groupBy("source", "lang").agg(F.max("doc_id").alias("active"))
    return d.where("n_chars <= 400").join(active, ["source", "lang"]).where("doc_id < active").select("doc_id", "source")


@query("""SELECT source, count(*)::BIGINT AS n, sum(strlen(text))::BIGINT AS bytes, sum((n_chars < 100)::INTEGER)::BIGINT AS issues, sum((n_chars < 100)::INTEGER) * 10 <= count(*) AS ready FROM documents GROUP BY 1""")
def reindex_preflight(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    few = F.sum((F.col("n_chars") < 100).cast("long"))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"), few.alias("issues"), (few * 10 <= F.count(F.lit(1))).alias("ready"))


@query("""SELECT source, bool_or(n_chars > 5000) OR bool_or(lang = 'fr') AS has_corpus FROM documents GROUP BY 1""")
def corpus_exists(spark, sf_dir):
    """Published, staged or active: any of them."""
    return table(spark, sf_dir, "documents").groupBy("source").agg((F.bool_or(F.col("n_chars") > 5000) | F.bool_or(F.col("lang") == "fr")).alias("has_corpus"))


@query(f"""WITH s AS (SELECT source, doc_id AS k, lang || ':' || doc_id AS d FROM documents), {catalog.tree_digest_sql("s", "source")} SELECT source, digest AS epoch FROM tree""")
def catalogue_epochs(spark, sf_dir):
    """A digest of each library that changes with any of its books or their segments, by a tree of digests."""
    d = table(spark, sf_dir, "documents")
    tree = catalog.tree_digest(d, ["source"], F.col("doc_id"), F.concat("lang", F.lit(":"), F.col("doc_id").cast("string")))
    return tree.select("source", F.col("digest").alias("epoch"))


@query("""WITH b AS (SELECT DISTINCT user_id AS blob, max(ts) OVER (PARTITION BY user_id) AS changed FROM events), m AS (SELECT user_id FROM events WHERE event_type = 'purchase' AND event_id % 13 = 0 UNION SELECT user_id FROM events WHERE event_type = 'signup' AND event_id % 11 = 0)
SELECT blob FROM b WHERE blob NOT IN (SELECT user_id FROM m) AND changed < TIMESTAMP '2024-01-31 00:00:00'""")
def swept_blobs(spark, sf_dir):
    """Mark what is referenced, sweep the rest that is old enough."""
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "blob")
    blobs = e.groupBy("blob").agg(F.max("ts").alias("changed"))
    marks = [e.where("event_type = 'purchase' AND event_id % 13 = 0"), e.where("event_type = 'signup' AND event_id % 11 = 0")]
    return catalog.live_blobs(blobs, marks, "blob", F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'"), "changed").select("blob")


@query("""WITH p AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'P')
SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'unknown' WHEN c_acctbal < 0 THEN 'not_ready' WHEN o_totalprice > 400000 THEN 'too_large' ELSE 'ok' END AS verdict FROM p LEFT JOIN customer ON o_custkey = c_custkey""")
def import_preflight(spark, sf_dir):
    """Pending orders as candidates that are held against their preflight before they are committed."""
    p = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey")
    j = p.join(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.lit(True).alias("known")), "c_custkey", "left")
    return j.select("o_orderkey", F.when(F.col("known").isNull(), "unknown").when(F.col("c_acctbal") < 0, "not_ready").when(F.col("o_totalprice") > 400000, "too_large").otherwise("ok").alias("verdict"))


@query("""SELECT c_custkey, c_name, c_mktsegment, concat_ws('|', CASE WHEN c_acctbal < -900 THEN 'limit' END, CASE WHEN length(c_name) < 5 THEN 'name' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE', 'HOUSEHOLD') THEN 'segment' END) AS errors FROM customer""")
def validated_requests(spark, sf_dir):
    """Codes of the limits and enumerations that a request breaks."""
    codes = [F.when(F.col("c_acctbal") < -900, "limit"), F.when(F.length("c_name") < 5, "name"), F.when(~F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "AUTOMOBILE", "HOUSEHOLD"), "segment")]
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.concat_ws("|", *codes).alias("errors"))


@query("""WITH l AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS place FROM lineitem)
SELECT 'mixed_generation' AS code, o_orderkey::VARCHAR AS id FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'structure_missing', o_orderkey::VARCHAR FROM orders WHERE o_orderkey % 11 = 0
UNION ALL SELECT 'segments_missing', o_orderkey::VARCHAR FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'chunks_missing', o_orderkey::VARCHAR FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'refs_missing', l_orderkey || '/' || place FROM l WHERE l_partkey % 97 = 0
UNION ALL SELECT 'chunk_page_invalid', l_orderkey || '/' || place FROM l WHERE l_orderkey % 11 = 0""")
def generation_faults(spark, sf_dir):
    """Orders as books of one page a line, some of an old generation, some without structure or references, held against
    all rules for an index."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "P", "old").otherwise("g").alias("generation")).groupBy("l_orderkey").agg(F.collect_list("generation").alias("generations"))
    # Lines are gathered by order once; their places follow from that, and every rule reads its few columns of what is staged.
    of = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").repartition("l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"))
    g, none = F.lit("g"), F.array().cast("array<string>")
    named = F.transform("lines", lambda x, i: F.struct(F.concat_ws("/", "l_orderkey", i).alias("evidence_id")))
    payload = F.to_json(F.struct(F.lit("3").alias("schema_version"), F.lit("h").alias("content_hash"), F.coalesce(named, F.array().cast("array<struct<evidence_id:string>>")).alias("evidence"), F.struct(F.array().cast("array<struct<media_id:string>>").alias("assets")).alias("media")))
    whole = staged(o.join(of, "l_orderkey", "full").select("l_orderkey", "generations", F.transform("lines", lambda x: x["l_partkey"]).alias("parts"), F.size("lines").alias("n"), F.when(F.col("generations").isNotNull(), payload).alias("payload")), "books")
    books = whole.select(F.col("l_orderkey").cast("string").alias("book"), "l_orderkey", F.explode("generations").alias("generation"), F.when(F.col("n") > 0, F.col("n")).alias("n"), "payload")
    at = lambda i: F.concat_ws("/", "l_orderkey", i)
    l = whole.select("l_orderkey", "n", F.posexplode("parts").alias("place", "l_partkey"))
    l = l.select("l_orderkey", "place", "l_partkey", at("place").alias("evidence"), F.when(F.col("place") > 0, at(F.col("place") - 1)).alias("previous"), F.when(F.col("place") < F.col("n") - 1, at(F.col("place") + 1)).alias("next"))
    one = F.lit(1)
    tables = {name: spark.createDataFrame([], kind) for name, kind in validation.TABLES.items()} | {
        "books": books.select("book", "generation", F.lit("p").alias("pipeline")),
        "structures": books.where("l_orderkey % 11 <> 0").select("book", g.alias("generation"), F.coalesce("n", F.lit(0)).alias("total_pages")),
        "snapshots": books.select("book", g.alias("generation"), F.lit("h").alias("content_hash"), "payload"),
        "nodes": books.select("book", F.lit("n").alias("node"), F.lit(None).cast("string").alias("parent")),
        "segments": books.where("n IS NOT NULL").select("book", F.lit("s").alias("segment"), g.alias("generation"), F.lit("absolute").alias("page_mode"), one.alias("conversion_start"), one.alias("core_start"), F.col("n").alias("core_end"), F.col("n").alias("conversion_end")),
        "chunks": l.select(F.col("l_orderkey").cast("string").alias("book"), F.col("evidence").alias("chunk"), g.alias("generation"), F.when(F.col("l_partkey") % 97 == 0, none).otherwise(F.array(F.col("l_partkey").cast("string"))).alias("refs"), F.array(F.col("place") + 1).alias("pages"), F.lit("n").alias("section"), F.lit("s").alias("segment"), "place", F.col("l_partkey").cast("string").alias("content_hash"), "evidence", "previous", "next"),
    }
    return validation.index_faults(tables, "g", "p")
