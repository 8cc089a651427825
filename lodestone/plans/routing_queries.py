"""Routed retrieval over brands as books: parts are their terms, sizes their sections, lines of orders their chunks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import graph, routing
from ..operators.ranking import top_by
from ..sources.tables import staged, table
from .registry import query

SEGMENTS = ["s0", "s1", "s2"]
LIMIT, SEEDS = 12, 6

BOOK = """l AS (SELECT p_brand AS doc, l_orderkey AS o, l_linenumber AS n, 't' || l_partkey AS term, l_partkey AS p, l_suppkey AS s, l_quantity AS q, l_discount AS d FROM lineitem JOIN part ON p_partkey = l_partkey),
targets AS (SELECT doc, term, o || '-' || n || '-' || s AS key, 'n' || lpad((s % 50)::VARCHAR, 2, '0') AS node, CASE WHEN s % 3 <> 0 THEN 'e' || o END AS evidence, n AS page, d AS confidence, CASE WHEN q > 25 THEN 'defined' ELSE 'mentioned' END AS relation FROM l),
chunks AS (SELECT doc, 'c' || o || '-' || n || '-' || p AS chunk, 'e' || o AS evidence, 'n' || lpad((q::INTEGER)::VARCHAR, 2, '0') AS node, 's' || (s % 5) AS segment, o * 10 + n AS place FROM l WHERE s % 4 <> 1),
nodes AS (SELECT DISTINCT p_brand AS doc, 'n' || lpad(p_size::VARCHAR, 2, '0') AS node, p_size AS page, p_size / 100.0 AS confidence FROM part),
co AS (SELECT a.doc, a.term AS x, b.term AS y, count(DISTINCT a.o) AS n FROM l a JOIN l b ON a.doc = b.doc AND a.o = b.o AND a.term < b.term GROUP BY ALL),
nx AS (SELECT p_brand AS doc, p_partkey AS a, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b, lead(p_partkey) OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS c FROM part),
edges AS (SELECT doc, 'co' || x || y AS edge, x AS source, y AS target, 'co_occurs' AS relation, n / 2.0 AS weight FROM co
  UNION ALL SELECT doc, 'see' || a, 't' || a, 't' || b, 'see_also', 0.6 FROM nx WHERE b IS NOT NULL UNION ALL SELECT doc, 'ali' || a, 't' || a, 't' || c, 'alias_of', 1.0 FROM nx WHERE c IS NOT NULL
  UNION ALL SELECT doc, 'up' || node, 'n' || lpad((page // 4)::VARCHAR, 2, '0'), node, 'parent_of', 1.0 FROM nodes WHERE page >= 4 UNION ALL SELECT doc, 'nx' || node, node, 'n' || lpad((page + 1)::VARCHAR, 2, '0'), 'next_section', 1.0 FROM nodes),
bought AS (SELECT o_custkey AS query, p_brand AS doc, l_partkey AS p, p_size, sum(l_quantity) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL),
seeds AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY q DESC, p) AS seed, doc, CASE WHEN p % 5 = 0 THEN 'n' || lpad(p_size::VARCHAR, 2, '0') ELSE 't' || p END AS term FROM bought QUALIFY seed <= 6)"""

QUEUES = f"""WITH {BOOK},
ok AS (SELECT * FROM chunks WHERE segment IN ('s0', 's1', 's2')),
rep AS (SELECT doc, node, arg_min(chunk, (place, chunk, evidence)) AS chunk, arg_min(evidence, (place, chunk, evidence)) AS evidence FROM ok GROUP BY 1, 2),
ex AS (SELECT doc, evidence, min((place, chunk)) AS m FROM ok GROUP BY 1, 2), kn AS (SELECT DISTINCT doc, evidence FROM chunks),
t0 AS (SELECT t.*, CASE WHEN kn.doc IS NULL THEN rep.chunk ELSE ok1.chunk END AS ch, CASE WHEN kn.doc IS NULL THEN rep.evidence ELSE t.evidence END AS ev FROM targets t
  LEFT JOIN (SELECT doc, evidence, m[2] AS chunk FROM (SELECT doc, evidence, [m[1]::VARCHAR, m[2]] AS m FROM ex)) ok1 ON ok1.doc = t.doc AND ok1.evidence = t.evidence
  LEFT JOIN kn ON kn.doc = t.doc AND kn.evidence = t.evidence LEFT JOIN rep ON rep.doc = t.doc AND rep.node = t.node),
hits AS (SELECT doc, term, node, page, ev AS evidence, ch AS chunk, confidence, relation, row_number() OVER (PARTITION BY doc, term ORDER BY confidence DESC, page, key) AS nth FROM t0 WHERE ch IS NOT NULL QUALIFY nth <= 4),
sec AS (SELECT n.*, chunk, evidence FROM nodes n JOIN rep USING (doc, node)),
direct AS (SELECT query, seed, doc, h.term, node, chunk, confidence, 'book-' || relation AS path, '' AS edge, nth FROM seeds JOIN hits h USING (doc, term)
  UNION ALL SELECT query, seed, doc, term, node, chunk, confidence, 'book-section', '', 0 FROM seeds JOIN sec USING (doc) WHERE term = node AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.doc = seeds.doc AND h.term = seeds.term)),
tm AS (SELECT p_brand AS doc, 't' || p_partkey AS term FROM part),
near AS (SELECT query, seed, h.doc, h.term, h.node, h.chunk, h.confidence, 'book-graph-' || e.relation AS path, e.edge, e.weight, h.nth, e.relation FROM seeds s SEMI JOIN tm ON tm.doc = s.doc AND tm.term = s.term
  JOIN edges e ON e.doc = s.doc AND s.term IN (e.source, e.target) AND e.relation IN ('alias_of', 'see_also', 'co_occurs') JOIN hits h ON h.doc = s.doc AND h.term = CASE WHEN e.source = s.term THEN e.target ELSE e.source END),
near4 AS (SELECT *, row_number() OVER (PARTITION BY query, seed, relation ORDER BY weight DESC, edge, nth) AS r FROM near QUALIFY relation <> 'co_occurs' OR r <= 4),
home AS (SELECT DISTINCT query, seed, doc, node AS here FROM direct),
fam AS (SELECT query, seed, h.doc, s.term, sec.node, sec.chunk, sec.confidence, CASE WHEN e.source = here THEN 'book-graph-child' ELSE 'book-graph-parent' END AS path, e.edge, e.weight, here FROM home h JOIN seeds s USING (query, seed)
  JOIN edges e ON e.doc = h.doc AND here IN (e.source, e.target) AND e.relation = 'parent_of' JOIN sec ON sec.doc = h.doc AND sec.node = CASE WHEN e.source = here THEN e.target ELSE e.source END),
adj AS (SELECT query, seed, h.doc, s.term, sec.node, sec.chunk, sec.confidence, CASE WHEN e.source = here THEN 'book-graph-next' ELSE 'book-graph-previous' END AS path, e.edge, here, (e.target = here)::INTEGER AS way FROM home h JOIN seeds s USING (query, seed)
  JOIN edges e ON e.doc = h.doc AND here IN (e.source, e.target) AND e.relation = 'next_section' JOIN sec ON sec.doc = h.doc AND sec.node = CASE WHEN e.source = here THEN e.target ELSE e.source END
  QUALIFY row_number() OVER (PARTITION BY query, seed, way ORDER BY here) = 1),
q AS (SELECT query, seed, doc, term, node, chunk, confidence, path, edge, 0 AS part, '' AS k1, 0 AS k2, 0.0 AS k3, '' AS k4, nth AS k5 FROM direct
  UNION ALL SELECT query, seed, doc, term, node, chunk, confidence, path, edge, 1, '', 0, -weight, edge, nth FROM near4
  UNION ALL SELECT query, seed, doc, term, node, chunk, confidence, path, edge, 2, here, 0, -weight, edge, 0 FROM fam
  UNION ALL SELECT query, seed, doc, term, node, chunk, confidence, path, edge, 3, here, way, 0, '', 0 FROM adj),
u AS (SELECT *, row_number() OVER (PARTITION BY query, seed, doc, chunk ORDER BY part, k1, k2, k3, k4, k5) AS again FROM q QUALIFY again = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY query, seed ORDER BY part, k1, k2, k3, k4, k5)::INTEGER AS nth FROM u QUALIFY nth <= 12)"""


def book(spark, sf_dir):
    """Targets, chunks, nodes, edges and terms of each brand, and seeds of each customer."""
    part, orders = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    s = lambda c: F.col(c).cast("string")
    section = lambda c: F.concat(F.lit("n"), F.lpad(c.cast("int").cast("string"), 2, "0"))
    of = lambda prefix, c: F.concat(F.lit(prefix), s(c))
    brands = part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("doc"), "p_size")
    l = table(spark, sf_dir, "lineitem").join(brands, "l_partkey").select("doc", "p_size", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    l = staged(l, "lines").withColumn("term", of("t", "l_partkey"))
    relation = F.when(F.col("l_quantity") > 25, "defined").otherwise("mentioned")
    targets = l.select("doc", "term", F.concat_ws("-", s("l_orderkey"), s("l_linenumber"), s("l_suppkey")).alias("key"), section(F.col("l_suppkey") % 50).alias("node"), F.when(F.col("l_suppkey") % 3 != 0, of("e", "l_orderkey")).alias("evidence"), F.col("l_linenumber").alias("page"), F.col("l_discount").alias("confidence"), relation.alias("relation"))
    chunks = l.where("l_suppkey % 4 <> 1").select("doc", F.concat(F.lit("c"), F.concat_ws("-", s("l_orderkey"), s("l_linenumber"), s("l_partkey"))).alias("chunk"), of("e", "l_orderkey").alias("evidence"), section(F.col("l_quantity")).alias("node"), F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("segment"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    size = F.col("p_size")
    nodes = part.select(F.col("p_brand").alias("doc"), section(size).alias("node"), size.alias("page"), (size / 100).alias("confidence")).distinct()
    # An order's terms of one brand are the unit; its lines are bounded, so its pairs are.
    pairs = graph.cooccurrence(l.select(F.struct("doc", "l_orderkey").alias("unit"), F.struct("doc", "term").alias("t")), "unit", "t", 1)
    together = pairs.select("a.doc", F.concat(F.lit("co"), "a.term", "b.term").alias("edge"), F.col("a.term").alias("source"), F.col("b.term").alias("target"), F.lit("co_occurs").alias("relation"), (F.col("n") / 2).alias("weight"))

    def following(keys, name, relation, weight):
        after = F.lead("p_partkey").over(Window.partitionBy(*keys).orderBy("p_partkey"))
        return part.select("p_brand", "p_partkey", "p_name").withColumn("after", after).where("after IS NOT NULL").select(F.col("p_brand").alias("doc"), of(name, "p_partkey").alias("edge"), of("t", "p_partkey").alias("source"), of("t", "after").alias("target"), F.lit(relation).alias("relation"), F.lit(weight).alias("weight"))

    up = nodes.where("page >= 4").select("doc", of("up", "node").alias("edge"), section(F.floor(F.col("page") / 4)).alias("source"), F.col("node").alias("target"), F.lit("parent_of").alias("relation"), F.lit(1.0).alias("weight"))
    on = nodes.select("doc", of("nx", "node").alias("edge"), F.col("node").alias("source"), section(F.col("page") + 1).alias("target"), F.lit("next_section").alias("relation"), F.lit(1.0).alias("weight"))
    edges = together
    for more in (following(["p_brand"], "see", "see_also", 0.6), following(["p_brand", "p_name"], "ali", "alias_of", 1.0), up, on):
        edges = edges.unionByName(more)
    # What a customer bought is summed and ranked where it is gathered.
    bought = l.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("query"), "doc", "l_partkey", "p_size", "l_quantity").repartition("query").groupBy("query", "doc", "l_partkey", "p_size").agg(F.sum("l_quantity").alias("q"))
    top = top_by(bought, ["query"], [F.col("q").desc(), F.col("l_partkey")], SEEDS, "seed")
    seeds = top.select("query", "seed", "doc", F.when(F.col("l_partkey") % 5 == 0, section(F.col("p_size"))).otherwise(of("t", "l_partkey")).alias("term"))
    terms = part.select(F.col("p_brand").alias("doc"), of("t", "p_partkey").alias("term"))
    return seeds, targets, chunks, nodes, staged(edges, "edges"), terms


HOW = {"expand": True, "everywhere": True, "adjacent": True}


@query(f"{QUEUES} SELECT query, seed::INTEGER AS seed, nth AS \"at\", doc, term, node, chunk, path, nullif(edge, '') AS edge, round(confidence, 6)::DOUBLE AS confidence FROM f")
def routed_queues(spark, sf_dir):
    """What each seed of a customer offers, in order: its targets, what is joined to it, sections above, below, beside."""
    return routing.queues(*book(spark, sf_dir), LIMIT, SEGMENTS, **HOW).select("query", "seed", "at", "doc", "term", "node", "chunk", "path", "edge", F.round("confidence", 6).alias("confidence"))


@query()
def routed_retrieval(spark, sf_dir):
    """The twelve results of each customer, queues taken in turn; held against a walk in the tests, as turns depend on
    all that came before."""
    return routing.retrieved(*book(spark, sf_dir), LIMIT, SEGMENTS, **HOW, most_seeds=SEEDS)


@query(f"""WITH {BOOK}, ok AS (SELECT * FROM chunks WHERE segment = 's4')
SELECT DISTINCT doc, term FROM targets t WHERE EXISTS (SELECT 1 FROM ok c WHERE c.doc = t.doc AND c.evidence = t.evidence)
  OR (EXISTS (SELECT 1 FROM ok c WHERE c.doc = t.doc AND c.node = t.node) AND (t.evidence IS NULL OR NOT EXISTS (SELECT 1 FROM chunks c WHERE c.doc = t.doc AND c.evidence = t.evidence)))
UNION SELECT doc, node FROM ok""")
def routable_terms(spark, sf_dir):
    """Terms and sections that one segment leaves something of, by the fallback that only missing evidence opens."""
    _, targets, chunks, *_ = book(spark, sf_dir)
    return routing.eligible(targets, chunks, ["s4"])
