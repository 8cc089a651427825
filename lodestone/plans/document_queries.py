"""Evidence, claims, nested records and small decision tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from ..operators import catalog, selection
from ..operators import documents as d
from ..operators.ranking import top_by
from ..sources.tables import table
from .registry import query
from .text_queries import terms_sql

SENTENCES = r"list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
NEGATIVE = ", ".join(f"'{w}'" for w in t.NEGATIONS)
PAIRS = f"""u AS (SELECT conv_id, turn, text AS claim, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS evidence FROM conversations),
p AS (SELECT conv_id, turn, {terms_sql("claim")} AS c, {terms_sql("evidence")} AS e, regexp_extract_all(claim, '[0-9]+') AS cl, regexp_extract_all(evidence, '[0-9]+') AS el FROM u WHERE evidence IS NOT NULL)"""


def turn_pairs(spark, sf_dir):
    """Each turn as a claim, with the turn after it as evidence."""
    c = table(spark, sf_dir, "conversations").withColumn("evidence", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("evidence IS NOT NULL")
    literals = lambda x: F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0))
    return c.select("conv_id", "turn", t.search_terms(F.col("text")).alias("c"), t.search_terms(F.col("evidence")).alias("e"), literals("text").alias("cl"), literals("evidence").alias("el"), "evidence")


@query(f"""WITH {PAIRS}, x AS (SELECT *, len(list_intersect(c, e)) AS s, len(list_intersect(c, [{NEGATIVE}])) > 0 AS cn, len(list_intersect(e, [{NEGATIVE}])) > 0 AS en FROM p)
SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN len(list_filter(cl, lambda v: NOT list_contains(el, v))) > 0 THEN 'literal_missing' END, CASE WHEN cn <> en AND s > 0 THEN 'polarity' END,
  CASE WHEN s < least(2, len(c)) THEN 'overlap' END, CASE WHEN len(c) > 0 AND 1 - s / len(c) > 0.45 THEN 'unsupported' END], lambda v: v IS NOT NULL), ',') AS errors FROM x""")
def claim_validation(spark, sf_dir):
    p = turn_pairs(spark, sf_dir)
    errors = d.claim_errors(F.col("c"), F.col("e"), t.negated(F.col("c")), t.negated(F.col("e")), F.col("cl"), F.col("el"))
    return p.select("conv_id", "turn", F.array_join(errors, ",").alias("errors"))


@query(f"""WITH q AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
s AS (SELECT conv_id, turn, {terms_sql("nxt")} AS wanted, unnest({SENTENCES}) AS s, unnest(range(len({SENTENCES}))) AS i FROM q WHERE nxt IS NOT NULL),
w AS (SELECT conv_id, turn, i, s, CASE WHEN len(wanted) > 0 THEN len(list_intersect({terms_sql("s")}, wanted)) / len(wanted) ELSE 0 END AS score FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, i) AS r FROM w)
SELECT conv_id, turn, i::INTEGER AS sentence, round(score, 9)::DOUBLE AS score FROM r WHERE r = 1""")
def best_support_sentence(spark, sf_dir):
    """The sentence of a turn that supports the next turn best."""
    c = table(spark, sf_dir, "conversations").withColumn("nxt", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("nxt IS NOT NULL")
    found = c.select("conv_id", "turn", t.let(t.search_terms(F.col("nxt")), lambda w: d.best_sentence(F.col("text"), w)).alias("b"))
    return found.where("b IS NOT NULL").select("conv_id", "turn", F.col("b.at").alias("sentence"), F.round("b.score", 9).alias("score"))


@query()
def evidence_packing(spark, sf_dir):
    """Lines of a document in order within 320 estimated tokens, one that is too long being skipped; a sequential
    budget, held against brute force in the tests."""
    items = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    chosen = d.within_budget(items, t.estimated_tokens, 320, 8)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(chosen).alias("n_lines"), F.aggregate(chosen, F.lit(0).cast("long"), lambda a, x: a + t.estimated_tokens(x)).alias("n_tokens"))


@query()
def packed_evidence(spark, sf_dir):
    """Lines of a document in order as windows of 1,200 tokens at most in all; tables and formulas may be longer than
    prose, lists stand for navigation and are passed over. A sequential budget, held against cases in the tests."""
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), lambda x, i: F.struct(i.alias("id"), F.when(t.line_kind(x) == "list", "navigation").otherwise(t.line_kind(x)).alias("kind"), F.lit(None).cast("string").alias("provenance"), t.estimated_tokens(x).alias("tokens")))
    packed = table(spark, sf_dir, "documents").select("doc_id", selection.packed(lines, 1200).alias("w"))
    return packed.select("doc_id", F.size("w").alias("n_windows"), F.aggregate("w", F.lit(0), lambda a, x: a + x["tokens"]).alias("n_tokens"))


@query("""WITH h AS (SELECT l_orderkey, l_partkey, l_linenumber AS rank FROM lineitem),
f AS (SELECT l_orderkey, l_partkey, min(rank) AS first FROM h GROUP BY 1, 2),
g AS (SELECT o_orderkey, s, unnest(CASE s WHEN 0 THEN [p, q] ELSE [z] END) AS l_partkey FROM (
  SELECT l_orderkey AS o_orderkey, min(l_linenumber * 1000000 + l_partkey) % 1000000 AS p, max(l_linenumber * 1000000 + l_partkey) % 1000000 AS q, 7777777 AS z FROM lineitem GROUP BY 1), unnest([0, 1]) AS x(s)),
m AS (SELECT o_orderkey, s, max(first) AS reached, count(first) AS found, count(*) AS n FROM (SELECT DISTINCT * FROM g) g LEFT JOIN f ON f.l_orderkey = g.o_orderkey AND f.l_partkey = g.l_partkey GROUP BY 1, 2)
SELECT o_orderkey, coalesce(min(CASE WHEN found = n THEN reached END), -1)::INTEGER AS rank FROM m GROUP BY 1""")
def evidence_set_rank(spark, sf_dir):
    """The rank at which an order's lines cover its first and last part, or an alternative that never occurs."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", F.col("l_linenumber").alias("rank"))
    place = F.col("rank") * 1_000_000 + F.col("l_partkey")
    ends = l.groupBy("o_orderkey").agg(F.array(F.array(F.min(place) % 1_000_000, F.max(place) % 1_000_000), F.array(F.lit(7777777).cast("long"))).alias("groups"))
    hits = l.join(ends, "o_orderkey")
    return d.covered_at(hits, "o_orderkey", "rank", "l_partkey", "groups").select("o_orderkey", F.coalesce(F.col("rank"), F.lit(-1)).cast("int").alias("rank"))


@query("""WITH e AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey ORDER BY l_linenumber) AS r FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INTEGER AS citation FROM e WHERE r = 1""")
def citation_numbers(spark, sf_dir):
    """Citations without repeats of one source, numbered anew in their order."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.min("l_linenumber").alias("at"))
    return l.select("l_orderkey", "l_partkey", "l_suppkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("at", "l_partkey", "l_suppkey")).alias("citation"))


@query("""SELECT event_id, coalesce((props::JSON ->> 'k')::BIGINT, -1) AS k, event_type = 'click' AND coalesce((props::JSON ->> 'k')::BIGINT, -1) >= 50 AS heavy FROM events""")
def json_payloads(spark, sf_dir):
    """Typed fields of JSON payloads; a malformed one has none."""
    k = F.coalesce(F.from_json("props", "k bigint")["k"], F.lit(-1).cast("long"))
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), ((F.col("event_type") == "click") & (k >= 50)).alias("heavy"))


@query(f"""WITH e AS (SELECT user_id, event_id AS k, CASE WHEN event_type = 'purchase' THEN '{{"type":"[removed]"}}' ELSE '{{"type":"' || event_type || '"}}' END AS d FROM events), {catalog.tree_digest_sql("e", "user_id")},
c AS (SELECT user_id, sum((event_type = 'purchase')::INTEGER)::BIGINT AS scrubbed FROM events GROUP BY 1) SELECT user_id, scrubbed, digest FROM tree JOIN c USING (user_id)""")
def scrubbed_payloads(spark, sf_dir):
    """A value removed from JSON payloads, and a digest of each user's payloads in order, by a tree of digests."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.to_json(F.struct(F.col("event_type").alias("type"))).alias("p"))
    e = e.withColumn("q", d.scrubbed(F.col("p"), F.lit("purchase")))
    counts = e.groupBy("user_id").agg(F.count_if(F.col("p") != F.col("q")).alias("scrubbed"))
    return catalog.tree_digest(e, ["user_id"], F.col("event_id"), F.col("q")).join(counts, "user_id").select("user_id", "scrubbed", "digest")


@query("""SELECT o_orderkey, count(l_linenumber) AS n, coalesce(string_agg(l_linenumber || '=' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS lines, coalesce(sum(l_quantity), 0)::DOUBLE AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def nested_records(spark, sf_dir):
    """Orders with their lines as a sorted array, by one aggregate and a left join."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"), F.sum("l_quantity").alias("s"))
    text = F.array_join(F.transform("x", lambda y: F.concat(y["l_linenumber"].cast("string"), F.lit("="), y["l_partkey"].cast("string"))), ",")
    return table(spark, sf_dir, "orders").select("o_orderkey").join(l, "o_orderkey", "left").select("o_orderkey", F.coalesce(F.size("x"), F.lit(0)).cast("long").alias("n"), F.coalesce(text, F.lit("")).alias("lines"), F.coalesce("s", F.lit(0.0)).alias("quantity"))


@query("""WITH a AS (SELECT l_suppkey, l_partkey % 40 AS alias, min(l_orderkey * 10 + l_linenumber) AS place FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY place, alias) AS r FROM a)
SELECT l_suppkey, count(*) AS n, string_agg('a' || alias, ' ' ORDER BY place, alias) AS aliases FROM r WHERE r <= 24 GROUP BY 1""")
def bounded_alias_lists(spark, sf_dir):
    """At most 24 distinct aliases of a supplier in order of appearance; distinct ones are found before any list."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", (F.col("l_partkey") % 40).alias("alias")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    top = top_by(l, ["l_suppkey"], [F.col("at"), F.col("alias")], 24).groupBy("l_suppkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "alias"))), lambda x: F.concat(F.lit("a"), x["alias"].cast("string"))).alias("x"))
    return top.select("l_suppkey", F.size(d.bounded_aliases(F.col("x"))).cast("long").alias("n"), F.array_join(d.bounded_aliases(F.col("x")), " ").alias("aliases"))


@query("""SELECT p_partkey, CASE WHEN p_size <= 8 THEN 'tight' WHEN p_size <= 16 THEN 'low' WHEN p_size <= 24 THEN 'mid' WHEN p_size <= 32 THEN 'high' ELSE 'max' END AS tier,
  round(0.35 + 0.25 * least(1, p_size / 50) + 0.20 * least(1, p_retailprice / 1000 / 0.7) + 0.10 * ((p_size % 2) = 0)::INTEGER, 9)::DOUBLE AS region_score,
  least(900, 30 * power(2, least(p_size % 7, 4)))::INTEGER AS residency FROM part""")
def decision_tables(spark, sf_dir):
    """Tiers, a weighted score and a bounded ramp, each one expression."""
    size = F.col("p_size")
    tier = F.when(size <= 8, "tight").when(size <= 16, "low").when(size <= 24, "mid").when(size <= 32, "high").otherwise("max")
    one = F.lit(1.0)
    score = 0.35 + 0.25 * F.least(one, size / 50) + 0.20 * F.least(one, F.col("p_retailprice") / 1000 / 0.7) + 0.10 * (size % 2 == 0).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", tier.alias("tier"), F.round(score, 9).alias("region_score"), F.least(F.lit(900), 30 * F.pow(F.lit(2), F.least(size % 7, F.lit(4)))).cast("int").alias("residency"))


@query("""SELECT d.doc_id, d.source, q.n AS asked FROM documents d JOIN (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1) q USING (doc_id)""")
def hydrated_documents(spark, sf_dir):
    """Requested ids, distinct first, joined to their documents; missing ids drop out. asked: how often each was wanted."""
    l = table(spark, sf_dir, "labels")
    ids = l.select("doc_id").union(l.where("quality = 1").select("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("asked"))
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(ids, "doc_id")


@query("""SELECT c_custkey, CASE WHEN o IS NULL THEN 'orphan' WHEN c_custkey IS NULL THEN 'dangling' ELSE 'matched' END AS state FROM (
  SELECT coalesce(c.c_custkey, o.o_custkey) AS c_custkey, o.o_custkey AS o FROM customer c FULL JOIN (SELECT DISTINCT o_custkey FROM orders) o ON o.o_custkey = c.c_custkey)""")
def manifest_difference(spark, sf_dir):
    """Keys of two sides that match, or that only one has."""
    o = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    j = table(spark, sf_dir, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "full")
    return j.select(F.coalesce("c_custkey", "o_custkey").alias("c_custkey"), F.when(F.col("o_custkey").isNull(), "orphan").otherwise("matched").alias("state"))


@query("""WITH r AS (SELECT doc_id, source, 'head' AS path, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents UNION ALL SELECT doc_id, source, 'long', row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) FROM documents),
f AS (SELECT source, doc_id, min(CASE WHEN path = 'head' THEN pos * 2 ELSE pos * 2 + 1 END) AS turn FROM r WHERE pos <= 8 GROUP BY 1, 2)
SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY turn)::INTEGER AS place FROM f""")
def interleaved_queues(spark, sf_dir):
    """Two queues of eight for each source, taken in turn; a document counts where it comes first."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    head = top_by(docs, ["source"], [F.col("doc_id")], 8, "pos").select("source", "doc_id", (F.col("pos") * 2).alias("at"))
    long = top_by(docs, ["source"], [F.col("n_chars").desc(), F.col("doc_id")], 8, "pos").select("source", "doc_id", (F.col("pos") * 2 + 1).alias("at"))
    first = head.union(long).groupBy("source", "doc_id").agg(F.min("at").alias("at"))
    return first.select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy("at")).alias("place"))


@query(r"""WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<(?:p|li|h1)[^>]*>(.*?)</(?:p|li|h1)>', 1)) AS raw, unnest(regexp_extract_all(html, '(?s)<(p|li|h1)[^>]*>.*?</(?:p|li|h1)>', 1)) AS tag,
  unnest(range(len(regexp_extract_all(html, '(?s)<(?:p|li|h1)[^>]*>.*?</(?:p|li|h1)>')))) AS no FROM pages)
SELECT page_id, no::INTEGER AS no, tag, md5(trim(regexp_replace(regexp_replace(raw, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM b""")
def page_blocks(spark, sf_dir):
    """Paragraphs, list items and headings of pages in reading order."""
    block = r"(?s)<(p|li|h1)[^>]*>(.*?)</(?:p|li|h1)>"
    pages = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(block), F.lit(0))).alias("no", "b"))
    inner = F.regexp_extract("b", block, 2)
    return pages.select("page_id", "no", F.regexp_extract("b", block, 1).alias("tag"), F.md5(t.one_space(F.regexp_replace(inner, "<[^>]+>", " "))).alias("digest"))
