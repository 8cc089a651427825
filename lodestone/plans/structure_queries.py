"""Outlines, regions, routes, states and other ordered queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from ..operators import documents as d
from ..operators import booklines, graph, structure
from ..operators.ranking import top_by
from ..sources.tables import table
from .registry import query
from .text_queries import BOOK, STOP, terms_sql

OUTLINE = "(SELECT conv_id, turn, length(text) % 4 + 1 AS depth, turn * 3 + 1 AS page FROM conversations)"


@query(f"""SELECT a.conv_id, a.turn, coalesce((SELECT max(b.turn) FROM {OUTLINE} b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND b.depth < a.depth), -1)::BIGINT AS parent,
  coalesce((SELECT min_by(b.page, b.turn) FROM {OUTLINE} b WHERE b.conv_id = a.conv_id AND b.turn > a.turn AND b.depth <= a.depth) - 1, -1)::BIGINT AS page_end FROM {OUTLINE} a""")
def outline_tree(spark, sf_dir):
    """Parents and page ends of an outline of four levels."""
    nodes = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") % 4 + 1).alias("depth"), (F.col("turn") * 3 + 1).alias("page"))
    o = structure.outline(nodes, "conv_id", "turn", "depth", "page", 4)
    return o.select("conv_id", "turn", F.coalesce("parent", F.lit(-1)).cast("long").alias("parent"), F.coalesce("end", F.lit(-1)).cast("long").alias("page_end"))


@query("""WITH RECURSIVE w AS (SELECT p_partkey AS node, p_partkey // 4 AS above, p_partkey::VARCHAR AS path FROM part WHERE p_partkey > 0
  UNION ALL SELECT node, above // 4, above || '/' || path FROM w WHERE above > 0)
SELECT node, path FROM w WHERE above = 0""")
def heading_paths(spark, sf_dir):
    """Paths from the root in a tree of parts, whose depth is the logarithm of their number."""
    n = F.col("p_partkey")
    nodes = table(spark, sf_dir, "part").where("p_partkey > 0").select(n.alias("node"), F.when(n >= 4, F.floor(n / 4)).alias("parent"))
    found = structure.ancestors(nodes, "node", "parent", 12).where("NOT cyclic")
    return found.select("node", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


@query("""WITH p AS (SELECT source, n_chars < 800 AS f, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents),
g AS (SELECT *, place - lag(place) OVER (PARTITION BY source ORDER BY place) > 2 AS new FROM p WHERE f),
r AS (SELECT *, sum(coalesce(new, false)::INTEGER) OVER (PARTITION BY source ORDER BY place) AS run FROM g)
SELECT source, min(place)::INTEGER AS first, max(place)::INTEGER AS last, count(*) AS n, round(0.35 + 0.20 * least(1, count(*) / (max(place) - min(place) + 1) / 0.7), 9)::DOUBLE AS score FROM r GROUP BY source, run""")
def navigation_regions(spark, sf_dir):
    """Runs of short documents of a source that forgive a gap of one, with a score."""
    r = structure.regions(table(spark, sf_dir, "documents").select("source", "doc_id", (F.col("n_chars") < 800).alias("f")), "source", "doc_id", "f", 2)
    dense = F.col("n") / (F.col("last") - F.col("first") + 1)
    return r.select("source", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"), "n", F.round(0.35 + 0.20 * F.least(F.lit(1.0), dense / 0.7), 9).alias("score"))


@query("SELECT p_partkey, p_name AS title, p_size::VARCHAR AS label, (p_size % 3)::INTEGER AS depth FROM part")
def contents_lines(spark, sf_dir):
    """Contents lines with dotted leaders and section numbers, written and parsed back."""
    n = F.col("p_size").cast("string")
    line = F.concat("p_name", F.lit(". . . . . "), n)
    number = F.concat_ws(".", n, F.when(F.col("p_size") % 3 >= 1, n), F.when(F.col("p_size") % 3 == 2, n))
    x = table(spark, sf_dir, "part").select("p_partkey", t.toc_entry(line).alias("e"), t.numbering_depth(F.concat(number, F.lit(" "), "p_name")).alias("depth"))
    return x.select("p_partkey", F.col("e.title").alias("title"), F.col("e.label").alias("label"), "depth")


def lines_of_parts(spark, sf_dir, texts):
    """Lines of books, one for each part of a maker: texts by the part's key, indents 0, 12 or 24."""
    kind = F.col("p_partkey") % len(texts)
    text = F.lit(None).cast("string")
    for i, x in enumerate(texts):
        text = F.when(kind == i, x).otherwise(text)
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", text.alias("line"), (F.col("p_size") % 3 * 12).alias("indent"))


@query()
def subject_index(spark, sf_dir):
    """Index lines of each maker's parts, with wrapped entries, sub-entries and references; held against a parser of one
    line after the other in the tests, as it is a scan."""
    name, size, key = F.col("p_name"), F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    texts = [F.concat_ws(" ", F.initcap(name), size), F.concat(F.initcap(name), F.lit(", ")), F.concat(F.lower(name), F.lit(" "), size, F.lit("-"), key), F.concat(name, F.lit(", "), size, F.lit("f, "), key), F.concat(name, F.lit(" see also "), F.col("p_type")), F.lit("Index"), F.lower(name)]
    e = booklines.subject_index(lines_of_parts(spark, sf_dir, texts), "p_brand", "p_partkey", "line", "indent")
    return e.select("p_brand", F.col("at").alias("p_partkey"), "term", "subterm", "relation", "related", F.array_join("pages", ",").alias("pages"))


@query()
def wrapped_contents(spark, sf_dir):
    """Contents lines of each maker's parts, wrapped titles whole, depth by number or indent; tested like subject_index."""
    name, size, key = F.col("p_name"), F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    texts = [F.concat(name, F.lit(" . . . . "), size), F.concat(F.lit("Chapter "), name), F.concat(size, F.lit(".2 "), name, F.lit("    "), key), F.lit("Contents"), F.concat(name, F.lit("..... "), key)]
    c = booklines.contents_list(lines_of_parts(spark, sf_dir, texts), "p_brand", "p_partkey", "line", "indent")
    return c.select("p_brand", F.col("at").alias("p_partkey"), "title", "label", "depth")


@query(rf"""SELECT conv_id, turn, CASE WHEN length(s) < 3 OR NOT regexp_matches(s, '[\p{{L}}\p{{N}}]') THEN md5(text) ELSE md5(s || substr(text, length(first) + 1)) END AS digest FROM (
  SELECT *, trim(regexp_replace(regexp_replace(first, '{t.FRAME}', ''), '{t.FRAME_TAIL.replace("'", "''")}', ''), ' ' || chr(9) || '?!.,;:') AS s FROM (
    SELECT conv_id, turn, text, regexp_extract(text, '^([^\n]*)', 1) AS first FROM conversations WHERE role = 'user'))""")
def retrieval_queries(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", F.md5(t.retrieval_query(F.col("text"))).alias("digest"))


@query(r"""WITH l AS (SELECT doc_id, line, CASE WHEN length(line) - length(replace(line, '|', '')) >= 2 THEN 'table' WHEN regexp_matches(line, '[=≤≥≈∑√]') THEN 'formula' WHEN regexp_matches(line, '^\s*(?:[-*•]|\d+[.)])\s') THEN 'list' ELSE 'prose' END AS kind
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '')
SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS n_documents FROM l GROUP BY kind""")
def evidence_kinds(spark, sf_dir):
    """Lines by kind; a document's lines are counted before the shuffle."""
    kinds = F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), t.line_kind)
    l = table(spark, sf_dir, "documents").select("doc_id", F.explode(kinds).alias("kind")).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("c"))
    return l.groupBy("kind").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_documents"))


@query(f"""WITH n AS (SELECT doc_id, ' ' || array_to_string(list_filter(string_split({BOOK.format("text")}, ' '), lambda w: length(w) >= 3 AND NOT regexp_matches(w, '[0-9]') AND w NOT IN ({STOP})), ' ') || ' ' AS t FROM documents),
g AS (SELECT doc_id, list_distinct(string_split(trim(t), ' ')) AS w FROM n),
v AS (SELECT term FROM (SELECT doc_id, unnest(w) AS term FROM g) WHERE term <> '' GROUP BY term HAVING count(*) >= 2 ORDER BY count(*) DESC, length(term) DESC, term LIMIT 40)
SELECT term, doc_id FROM v JOIN n ON contains(t, ' ' || term || ' ')""")
def terms_in_documents(spark, sf_dir):
    """Documents that mention each of the 40 leading terms: an equi-join on the documents' words, no scan of every term."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(t.term_tokens(F.col("text")))).alias("term")).where("term <> ''")
    lead = words.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df >= 2").orderBy(F.col("df").desc(), F.length("term").desc(), "term").limit(40)
    return words.join(F.broadcast(lead.select("term")), "term").select("term", "doc_id")


@query("""WITH b AS (SELECT *, o_orderpriority = '1-URGENT' AS pinned FROM orders),
r AS (SELECT *, CASE WHEN NOT pinned THEN row_number() OVER (PARTITION BY o_custkey, pinned ORDER BY o_orderdate DESC, o_orderkey DESC) END AS r FROM b)
SELECT o_custkey, o_orderkey, pinned FROM r WHERE pinned OR r <= 3""")
def kept_backups(spark, sf_dir):
    """Pinned backups and the three newest others of each owner."""
    b = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", (F.col("o_orderpriority") == "1-URGENT").alias("pinned"))
    new = top_by(b.where("NOT pinned"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 3, "r").drop("r")
    return b.where("pinned").unionByName(new).select("o_custkey", "o_orderkey", "pinned")


@query("""WITH s AS (SELECT user_id, event_type AS state, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT coalesce(before, 'start') AS from_state, state AS to_state, count(*) AS n, coalesce(before, 'start') = 'error' AND state = 'purchase' AS forbidden FROM s GROUP BY 1, 2""")
def state_transitions(spark, sf_dir):
    """Transitions of the users' states, and whether a rule forbids them."""
    s = table(spark, sf_dir, "events").withColumn("before", F.coalesce(F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id")), F.lit("start")))
    return s.groupBy(F.col("before").alias("from_state"), F.col("event_type").alias("to_state")).agg(F.count(F.lit(1)).alias("n")).withColumn("forbidden", (F.col("from_state") == "error") & (F.col("to_state") == "purchase"))


@query("""WITH s AS (SELECT o_custkey, l_partkey, sum(l_quantity) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
seed AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY q DESC, l_partkey) AS seed FROM s QUALIFY seed <= 4),
co AS (SELECT a.l_partkey AS a, b.l_partkey AS b, count(DISTINCT a.l_orderkey) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY 1, 2 HAVING n >= 2),
nb AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM co QUALIFY r <= 4),
c AS (SELECT o_custkey, l_partkey AS node, seed AS place FROM seed UNION ALL SELECT o_custkey, b, 10 * r + seed FROM seed JOIN nb ON a = l_partkey),
f AS (SELECT o_custkey, node, min(place) AS place FROM c GROUP BY 1, 2)
SELECT o_custkey, node, row_number() OVER (PARTITION BY o_custkey ORDER BY place, node)::INTEGER AS rank FROM f QUALIFY rank <= 12""")
def graph_route(spark, sf_dir):
    """Four seeds of each customer, then their neighbours by co-occurrence in turn, each node where it comes first."""
    l = table(spark, sf_dir, "lineitem")
    own = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey")).join(l, "l_orderkey").groupBy("o_custkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    seed = top_by(own, ["o_custkey"], [F.col("q").desc(), F.col("l_partkey")], 4, "seed")
    near = graph.neighbours(graph.cooccurrence(l, "l_orderkey", "l_partkey"), "a", "b", "n", 4)
    hop = seed.join(near.select(F.col("node").alias("l_partkey"), "neighbour", "rank"), "l_partkey").select("o_custkey", F.col("neighbour").alias("node"), (10 * F.col("rank") + F.col("seed")).alias("place"))
    first = seed.select("o_custkey", F.col("l_partkey").alias("node"), F.col("seed").alias("place")).unionByName(hop).groupBy("o_custkey", "node").agg(F.min("place").alias("place"))
    return top_by(first, ["o_custkey"], [F.col("place"), F.col("node")], 12).select("o_custkey", "node", "rank")


@query("""WITH n AS (SELECT p_partkey AS node, p_partkey * 7 % 5000 AS lo, p_partkey * 7 % 5000 + p_size AS hi FROM part)
SELECT node, c_custkey, r::INTEGER AS place FROM (SELECT node, c_custkey, row_number() OVER (PARTITION BY node ORDER BY c_custkey) AS r FROM n JOIN customer ON c_custkey BETWEEN lo AND hi) WHERE r <= 4""")
def section_postings(spark, sf_dir):
    """The first four records inside each interval."""
    n = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") * 7 % 5000).alias("lo"), (F.col("p_partkey") * 7 % 5000 + F.col("p_size")).alias("hi"))
    return structure.first_inside(table(spark, sf_dir, "customer"), "c_custkey", n, "node", "lo", "hi", 4, 64).select("node", "c_custkey", "place")


@query("""WITH m AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS strong, count(*) FILTER (event_type = 'view' AND value > 50) AS caption, count(DISTINCT event_type) FILTER (event_type IN ('click', 'view', 'error')) AS paths FROM events GROUP BY 1)
SELECT user_id, strong > 0 AS strong, (strong > 0 OR (caption > 0 AND paths >= 2)) AS eligible FROM m""")
def media_eligibility(spark, sf_dir):
    """A strong link, or a caption hit with two weak paths."""
    kind = F.col("event_type")
    m = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(kind == "purchase").alias("s"), F.count_if((kind == "view") & (F.col("value") > 50)).alias("c"), F.count_distinct(F.when(kind.isin("click", "view", "error"), kind)).alias("p"))
    return m.select("user_id", (F.col("s") > 0).alias("strong"), ((F.col("s") > 0) | ((F.col("c") > 0) & (F.col("p") >= 2))).alias("eligible"))


@query("""SELECT p_partkey, coalesce(list_sum(list_filter([p_size + o, p_size + o + 1, p_size * 2 + o], lambda x: x BETWEEN 1 AND 60)), 0)::BIGINT AS page_sum, len(list_filter([p_size + o, p_size + o + 1, p_size * 2 + o], lambda x: x BETWEEN 1 AND 60))::INTEGER AS n
FROM (SELECT *, p_partkey % 7 - 3 AS o FROM part)""")
def shifted_pages(spark, sf_dir):
    """Page lists moved by an offset, those outside the book dropped."""
    p = table(spark, sf_dir, "part").withColumn("o", F.col("p_partkey") % 7 - 3)
    pages = F.filter(F.transform(F.array("p_size", F.col("p_size") + 1, F.col("p_size") * 2), lambda x: x + F.col("o")), lambda x: x.between(1, 60))
    total = F.aggregate(pages, F.lit(0).cast("long"), lambda a, x: a + x)
    return p.select("p_partkey", total.alias("page_sum"), F.size(pages).alias("n"))


@query(f"""WITH x AS (SELECT conv_id, turn, {terms_sql("text")} AS a FROM conversations),
y AS (SELECT *, lag(a) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM x)
SELECT conv_id, turn, len(list_intersect(a, b))::INTEGER AS reused, (len(a) - len(list_intersect(a, b)))::INTEGER AS fresh FROM y WHERE b IS NOT NULL""")
def reused_terms(spark, sf_dir):
    """Terms of a turn that the turn before had, and new ones."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.search_terms(F.col("text")).alias("a"))
    c = c.withColumn("b", F.lag("a").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b IS NOT NULL")
    both = F.size(F.array_intersect("a", "b"))
    return c.select("conv_id", "turn", both.alias("reused"), (F.size("a") - both).alias("fresh"))


@query()
def cache_skips(spark, sf_dir):
    """Orders of a customer, newest first, that fit a byte budget when those too large are skipped: sequential, so held
    against brute force in the tests. A customer's orders bound the array."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.reverse(F.array_sort(F.collect_list(F.struct("o_orderkey", F.round("o_totalprice").cast("long").alias("size"))))).alias("x"))
    kept = d.within_budget(F.col("x"), lambda e: e["size"], 1_000_000)
    return o.select("o_custkey", F.explode(kept).alias("k")).select("o_custkey", "k.o_orderkey", "k.size")


@query()
def aligned_outlines(spark, sf_dir):
    """Questions and answers of a conversation aligned in rising order by term similarity; sequential within it."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", t.search_terms(F.col("text")).alias("a"))
    q, r = c.where("role = 'user'").select("conv_id", F.col("turn").alias("q"), F.col("a").alias("qa")), c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("r"), F.col("a").alias("ra"))
    pairs = q.join(r, "conv_id").select("conv_id", "q", "r", t.dice(F.col("qa"), F.col("ra")).alias("s"))
    return structure.aligned(pairs, "conv_id", "q", "r", "s", 0.1)
