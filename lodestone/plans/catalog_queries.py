"""Catalogue, structure, media and retention queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import catalog, duplicates, structure
from ..operators.ranking import top_by
from ..sources.tables import table
from .registry import query

CUT = "TIMESTAMP '1997-01-01'"


@query("SELECT doc_id, lang, source FROM documents WHERE lower(lang) IN ('en', 'de') AND lower(source) IN ('src1', 'src2', 'src3')")
def filtered_documents(spark, sf_dir):
    where = catalog.document_filter({"language": ["EN", "de"], "source": ["src1", "SRC2", "src3"]})
    return table(spark, sf_dir, "documents").where(where).select("doc_id", "lang", "source")


@query("SELECT source, lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id DESC) AS r FROM documents WHERE n_chars >= 200) WHERE r = 1")
def current_editions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("work", F.concat_ws("/", "source", "lang"))
    return catalog.current_editions(d, "work", [F.col("n_chars").desc(), F.col("doc_id").desc()], F.col("n_chars") < 200).select("source", "lang", "doc_id", "n_chars")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def visible_documents(spark, sf_dir):
    hidden = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(hidden, "doc_id", "left_anti").select("doc_id", "source")


@query("""SELECT p_partkey, p_name FROM part p WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_returnflag = 'R')
  OR EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_discount > 0.09)""")
def admitted_terms(spark, sf_dir):
    """Either of two conditions on a part's lines: two semi joins and a union, which hash joins can do."""
    p, l = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    by = lambda cond: p.join(l.where(cond).select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")
    return by("l_returnflag = 'R'").select("p_partkey", "p_name").union(by("l_discount > 0.09").select("p_partkey", "p_name")).distinct()


@query("""SELECT c.c_custkey, coalesce(e.o_orderkey, r.o_orderkey) AS o_orderkey, e.o_orderkey IS NULL AS fallback FROM customer c
LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) e ON e.o_custkey = c.c_custkey
LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) r ON r.o_custkey = c.c_custkey
WHERE coalesce(e.o_orderkey, r.o_orderkey) IS NOT NULL""")
def exact_or_representative(spark, sf_dir):
    """A customer's last open order, else its first order: both by one aggregate of the orders."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey"))).alias("exact"), F.min("o_orderkey").alias("representative"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey").select("c_custkey", F.coalesce("exact", "representative").alias("o_orderkey"), F.col("exact").isNull().alias("fallback"))


@query("""SELECT c_custkey, c_name, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total, max(o_orderdate) AS latest
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2""")
def customer_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("t"), F.max("o_orderdate").alias("latest"))
    c = table(spark, sf_dir, "customer").join(o, "c_custkey", "left")
    return c.select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n_orders"), F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"), "latest")


@query("""WITH p AS (SELECT source, doc_id, length(trim(text)) < 300 AS scanned, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, count(*) OVER (PARTITION BY source) AS total FROM documents),
r AS (SELECT *, page - row_number() OVER (PARTITION BY source, scanned ORDER BY page) AS run FROM p),
q AS (SELECT *, (row_number() OVER (PARTITION BY source, scanned, run ORDER BY page) - 1) // (CASE WHEN scanned THEN 4 ELSE 8 END) AS part FROM r)
SELECT source, min(page)::INTEGER AS core_start, max(page)::INTEGER AS core_end, greatest(1, min(page) - 1)::INTEGER AS conversion_start,
  least(any_value(total), max(page) + 1)::INTEGER AS conversion_end, scanned FROM q GROUP BY source, scanned, run, part""")
def page_range_plan(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", (F.length(F.trim("text")) < 300).alias("scanned"))
    r = structure.page_ranges(d, "source", "doc_id", "scanned", 8, 4)
    return r.select("source", *[F.col(c).cast("int").alias(c) for c in ("core_start", "core_end", "conversion_start", "conversion_end")], "scanned")


@query("""WITH n AS (SELECT p_partkey AS node, p_partkey * 7 % 5000 AS lo, p_partkey * 7 % 5000 + p_size AS hi, p_size AS depth FROM part),
j AS (SELECT c_custkey, node, row_number() OVER (PARTITION BY c_custkey ORDER BY depth DESC, lo DESC, node) AS r FROM customer JOIN n ON c_custkey BETWEEN lo AND hi)
SELECT c_custkey, node FROM j WHERE r = 1""")
def section_of_page(spark, sf_dir):
    """The deepest interval that holds a point, ties to the later start."""
    n = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") * 7 % 5000).alias("lo"), (F.col("p_partkey") * 7 % 5000 + F.col("p_size")).alias("hi"), F.col("p_size").alias("depth"))
    found = structure.deepest_holding(table(spark, sf_dir, "customer"), "c_custkey", n, "lo", "hi", [-F.col("depth"), -F.col("lo"), F.col("node")], 64)
    return found.select("c_custkey", F.col("best.o2").alias("node"))


@query("""SELECT conv_id, turn, coalesce(lag(turn) OVER w, -1) AS previous, coalesce(lead(turn) OVER w, -1) AS next, (row_number() OVER w - 1 = turn) AS in_order,
  coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS question_turn
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def turn_chain(spark, sf_dir):
    c = structure.chain(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "turn")
    place = Window.partitionBy("conv_id").orderBy("turn")
    question = structure.carried(F.when(F.col("role") == "user", F.col("turn")), ["conv_id"], ["turn"])
    none = F.lit(-1)
    return c.select("conv_id", "turn", F.coalesce("previous", none).alias("previous"), F.coalesce("next", none).alias("next"), (F.row_number().over(place) - 1 == F.col("turn")).alias("in_order"), F.coalesce(question, none).alias("question_turn"))


@query("""WITH u AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE role = 'user')
SELECT conv_id, turn, md5(substr(CASE WHEN before IS NULL THEN text ELSE before || chr(10) || text END, 1, 2400)) AS question FROM u""")
def standalone_questions(spark, sf_dir):
    """A user's turn with the question before it, 2400 characters at most."""
    u = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return u.select("conv_id", "turn", F.md5(F.substring(F.when(F.col("before").isNull(), F.col("text")).otherwise(F.concat("before", F.lit("\n"), "text")), 1, 2400)).alias("question"))


@query("""SELECT o_custkey, o_orderkey, sum(round(o_totalprice)::BIGINT) OVER w AS used, sum(round(o_totalprice)::BIGINT) OVER w > 1000000 AS evicted, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) > 5 AS beyond_newest
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def cache_eviction(spark, sf_dir):
    """Newest first: what passes a running budget, and what lies beyond the newest five."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice").cast("long").alias("size"))
    e = structure.over_budget(o, ["o_custkey"], [F.col("o_orderkey").desc()], "size", 1_000_000)
    return e.withColumn("beyond_newest", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_orderkey").desc())) > 5).drop("size")


@query("""SELECT doc_id, round(avg((line <= nxt)::INTEGER), 9) AS in_order FROM (SELECT doc_id, line, lead(line) OVER (PARTITION BY doc_id ORDER BY no) AS nxt FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents)) WHERE nxt IS NOT NULL GROUP BY doc_id""")
def ordered_line_share(spark, sf_dir):
    """Share of neighbouring lines in alphabetical order, within each document's own array."""
    from ..functions.text import let

    share = let(F.split("text", "\n"), lambda x: F.when(F.size(x) > 1, F.aggregate(F.transform(F.slice(x, 2, F.size(x)), lambda y, i: (F.get(x, i) <= y).cast("int")), F.lit(0), lambda a, y: a + y) / (F.size(x) - 1)))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(share, 9).alias("in_order")).where("in_order IS NOT NULL")


@query("""SELECT h AS content_hash, min(doc_id) AS canonical, count(*) AS n FROM (SELECT doc_id, sha256(text) AS h FROM documents) GROUP BY h HAVING count(*) > 1""")
def exact_duplicate_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return d.groupBy("content_hash").agg(F.min("doc_id").alias("canonical"), F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""WITH l AS (SELECT DISTINCT doc_id, trim(line) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '')
SELECT md5(line) AS line_hash, count(*) AS n_documents, max(length(line))::BIGINT AS n_chars FROM l GROUP BY line HAVING count(*) >= 3 AND length(line) <= 80""")
def repeated_decorations(spark, sf_dir):
    """Short lines in three documents or more."""
    lines = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: (x != "") & (F.length(x) <= 80)))
    l = table(spark, sf_dir, "documents").select(F.explode(lines).alias("line"))
    return l.groupBy("line").agg(F.count(F.lit(1)).alias("n_documents")).where("n_documents >= 3").select(F.md5("line").alias("line_hash"), "n_documents", F.length("line").cast("long").alias("n_chars"))


@query("""SELECT source, lang, count(*) AS n, round(avg((n_chars >= 200)::INTEGER), 9) AS substantive, round(least(1.0, 0.55 + 0.25 * avg((n_chars >= 200)::INTEGER) + 0.20 * avg((length(text) - length(replace(text, chr(10), '')) > 2)::INTEGER)), 9) AS quality
FROM documents GROUP BY source, lang""")
def quality_by_source(spark, sf_dir):
    long = F.avg((F.col("n_chars") >= 200).cast("int"))
    lines = F.avg((F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) > 2).cast("int"))
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.round(long, 9).alias("substantive"), F.round(F.least(F.lit(1.0), 0.55 + 0.25 * long + 0.20 * lines), 9).alias("quality"))


@query("""SELECT l_orderkey, substr(sha256('[' || string_agg('"part:' || l_partkey || '"', ',' ORDER BY 'part:' || l_partkey) || ']'), 1, 16) AS digest FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY l_orderkey""")
def selection_digests(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(catalog.selection_digest(F.concat(F.lit("part:"), F.col("l_partkey").cast("string"))).alias("digest"))


@query("""WITH b AS (SELECT doc_id // 1000 AS bucket, sha256(string_agg(doc_id || ':' || sha256(text), ',' ORDER BY doc_id)) AS d FROM documents GROUP BY 1)
SELECT bucket, d AS digest FROM b""")
def index_fingerprints(spark, sf_dir):
    """Digests of buckets of 1000 ids each: no list grows with the table."""
    d = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 1000).alias("bucket"), "doc_id", F.sha2("text", 256).alias("h"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "h"))), lambda x: F.concat(x["doc_id"].cast("string"), F.lit(":"), x["h"]))
    return d.groupBy("bucket").agg(F.sha2(F.array_join(listed, ","), 256).alias("digest"))


@query(f"""WITH j AS (SELECT *, o_orderdate < {CUT} AS old, o_orderstatus = 'O' AS active, o_orderpriority = '1-URGENT' AS pinned FROM orders)
SELECT o_orderpriority, count(*) FILTER (old AND NOT active AND NOT pinned) AS eligible, count(*) FILTER (old AND (active OR pinned)) AS protected,
  coalesce(sum(n) FILTER (old AND NOT active AND NOT pinned), 0)::BIGINT AS dependents FROM j LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY o_orderpriority""")
def retention_plan(spark, sf_dir):
    """What a cut-off would purge, what activity or a pin protects, and the rows that depend on it: one pass a table."""
    o = table(spark, sf_dir, "orders")
    old, active, pinned = F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp"), F.col("o_orderstatus") == "O", F.col("o_orderpriority") == "1-URGENT"
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    free = old & ~active & ~pinned
    return o.join(n, "o_orderkey", "left").groupBy("o_orderpriority").agg(F.count_if(free).alias("eligible"), F.count_if(old & (active | pinned)).alias("protected"), F.coalesce(F.sum(F.when(free, F.col("n"))), F.lit(0)).cast("long").alias("dependents"))


@query("""SELECT 'orphan_line' AS code, l_orderkey || ':' || l_linenumber AS id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'missing_customer', o_orderkey::VARCHAR FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'order_without_lines', o_orderkey::VARCHAR FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'duplicate_line', l_orderkey || ':' || l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'line_gap', l_orderkey::VARCHAR FROM lineitem GROUP BY l_orderkey HAVING max(l_linenumber) - min(l_linenumber) + 1 <> count(DISTINCT l_linenumber)
UNION ALL SELECT 'unlabelled_document', doc_id::VARCHAR FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'turn_gap', conv_id::VARCHAR FROM conversations GROUP BY conv_id HAVING max(turn) <> count(*) - 1""")
def index_validation(spark, sf_dir):
    """Integrity rules as one query each; rows are (code, id)."""
    l, o, c = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer"))
    labels, docs, turns = (table(spark, sf_dir, n) for n in ("labels", "documents", "conversations"))
    line = F.concat(F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string"))
    per_order = l.groupBy("l_orderkey").agg((F.max("l_linenumber") - F.min("l_linenumber") + 1 != F.count_distinct("l_linenumber")).alias("gap"))
    rules = [
        catalog.rule(l.join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti"), "orphan_line", None, line),
        catalog.rule(o.join(c.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti"), "missing_customer", None, F.col("o_orderkey")),
        catalog.rule(o.join(l.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti"), "order_without_lines", None, F.col("o_orderkey")),
        catalog.rule(l.groupBy("l_orderkey", "l_linenumber").count(), "duplicate_line", F.col("count") > 1, line),
        catalog.rule(per_order, "line_gap", F.col("gap"), F.col("l_orderkey")),
        catalog.rule(labels.join(docs.select("doc_id"), "doc_id", "left_anti"), "unlabelled_document", None, F.col("doc_id")),
        catalog.rule(turns.groupBy("conv_id").agg(F.max("turn").alias("m"), F.count(F.lit(1)).alias("n")), "turn_gap", F.col("m") != F.col("n") - 1, F.col("conv_id")),
    ]
    return reduce(lambda a, b: a.unionByName(b), rules)


@query("""WITH n AS (SELECT o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderstatus = 'O')
SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderstatus <> 'O' UNION ALL SELECT o_orderkey, o_custkey, round(o_totalprice, 2) FROM n""")
def merged_orders(spark, sf_dir):
    """Insert or update by key: open orders in a new version."""
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    new = old.where("o_orderstatus = 'O'").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return catalog.merged(old, new, ["o_orderkey"]).select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("""WITH d AS (SELECT *, sha256(text) AS h, count(*) OVER (PARTITION BY sha256(text)) AS same FROM documents),
r AS (SELECT source, lang, doc_id, same, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS r FROM d)
SELECT source, lang, doc_id, same > 1 AS duplicate, r::INTEGER AS place FROM r WHERE r <= 3""")
def library_list(spark, sf_dir):
    """The three largest documents of each source and language, marked if their content occurs again."""
    d = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars", F.sha2("text", 256).alias("h"))
    same = d.groupBy("h").agg(F.count(F.lit(1)).alias("same"))
    top = top_by(d, ["source", "lang"], [F.col("n_chars").desc(), F.col("doc_id")], 3, "place")
    return top.join(same, "h").select("source", "lang", "doc_id", (F.col("same") > 1).alias("duplicate"), "place")


@query("""SELECT doc_id, format('Which passage of {} covers "{}"?', source, substr(text, 1, 40)) AS question FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def silver_cases(spark, sf_dir):
    """One evaluation case for each source and language, from its first document."""
    first = top_by(table(spark, sf_dir, "documents"), ["source", "lang"], [F.col("doc_id")], 1)
    return first.select("doc_id", F.format_string('Which passage of %s covers "%s"?', "source", F.substring("text", 1, 40)).alias("question"))


@query("""SELECT source, median(n_chars) AS median, median(abs(n_chars - m)) AS mad FROM (SELECT source, n_chars, median(n_chars) OVER (PARTITION BY source) AS m FROM documents) GROUP BY source""")
def median_deviation(spark, sf_dir):
    """Median and median absolute deviation, each from counts of values, so a hot source costs no sort."""
    d = table(spark, sf_dir, "documents").select("source", "n_chars")
    m = d.groupBy("source").agg(F.median("n_chars").alias("m"))
    return d.join(m, "source").groupBy("source").agg(F.first("m").alias("median"), F.median(F.abs(F.col("n_chars") - F.col("m"))).alias("mad"))


SIGNS = """h AS (SELECT vec_id, list_transform(embedding, lambda x: (x > 0)::INTEGER) AS b FROM embeddings),
m AS (SELECT vec_id, min(vec_id) OVER (PARTITION BY b) AS rep, b FROM h)"""


def sign_hashes(spark, sf_dir):
    """(vec_id, h): a bit for each of a vector's 64 signs."""
    bits = F.aggregate("embedding", F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR((x > 0).cast("long")))
    return table(spark, sf_dir, "embeddings").select("vec_id", bits.alias("h"))


@query(f"WITH {SIGNS} SELECT vec_id, rep FROM m")
def equal_perceptual_hashes(spark, sf_dir):
    """The first vector of equal sign hashes for each."""
    return catalog.with_first(sign_hashes(spark, sf_dir), "vec_id", "h").select("vec_id", "rep")


@query("""WITH RECURSIVE h AS (SELECT vec_id, list_transform(range(60), lambda i: (embedding[i // 6 + 1] > 0)::INTEGER) AS b, vec_id % 3 AS kind FROM embeddings),
m AS (SELECT *, min(vec_id) OVER w AS rep, count(*) OVER w AS n FROM h WINDOW w AS (PARTITION BY b, kind)),
o AS (SELECT vec_id, b, (100 + kind * 10) / 100.0::DOUBLE AS r, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM m WHERE vec_id = rep),
walk AS (SELECT 0::BIGINT AS i, []::STRUCT(v BIGINT, b INTEGER[], r DOUBLE)[] AS c
  UNION ALL SELECT walk.i + 1, CASE WHEN len(list_filter(c, lambda x: abs(x.r - o.r) / greatest(x.r, o.r) <= 0.12 AND list_sum(list_transform(list_zip(x.b, o.b), lambda z: abs(z[1] - z[2]))) <= 6)) > 0 THEN c
    ELSE list_append(c, {'v': o.vec_id, 'b': o.b, 'r': o.r}) END FROM walk JOIN o ON o.i = walk.i),
f AS (SELECT unnest(c) AS x FROM walk WHERE i = (SELECT max(i) FROM walk)),
p AS (SELECT o.vec_id AS id, min(f.x.v) AS canonical FROM o JOIN f ON abs(f.x.r - o.r) / greatest(f.x.r, o.r) <= 0.12 AND f.x.v <= o.vec_id
  AND list_sum(list_transform(list_zip(f.x.b, o.b), lambda z: abs(z[1] - z[2]))) <= 6 GROUP BY 1)
SELECT vec_id AS id, rep AS canonical, 'exact' AS match FROM m WHERE n > 1
UNION ALL SELECT id, canonical, 'perceptual' FROM (SELECT *, count(*) OVER (PARTITION BY canonical) AS n FROM p) WHERE n > 1""")
def duplicate_media(spark, sf_dir):
    """Groups of vectors as media, greedy in id order. A hash has six bits for each of the first ten signs, so near is one
    sign apart; exact are those of one hash and remainder by three, which gives the aspect, too."""
    kind = F.col("vec_id") % 3
    bits = F.aggregate(F.slice("embedding", 1, 10), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 6).bitwiseOR(F.when(x > 0, 63).otherwise(0).cast("long")))
    assets = table(spark, sf_dir, "embeddings").select("vec_id", bits.alias("h")).select("vec_id", "h", F.concat_ws("/", "h", kind).alias("pixels"), (100 + kind * 10).alias("width"), F.lit(100).alias("height"))
    return duplicates.duplicate_groups(assets, "vec_id", "pixels", "h", "width", "height")


@query(f"""WITH {SIGNS}, r AS (SELECT rep AS v, b FROM m WHERE vec_id = rep),
p AS (SELECT x.v AS a, y.v AS b, list_sum(list_transform(list_zip(x.b, y.b), lambda z: abs(z[1] - z[2])))::INTEGER AS distance FROM r x JOIN r y ON x.v < y.v)
SELECT a, b, distance FROM p WHERE distance <= 6""")
def near_perceptual_hashes(spark, sf_dir):
    """Pairs of different 64-bit sign hashes at a distance of 6 bits or less, each hash standing for the vectors that have
    it. Six bits spoil six bytes at most, so some two of the eight are equal: 28 keys of 16 bits for each hash."""
    h = catalog.with_first(sign_hashes(spark, sf_dir), "vec_id", "h").where("vec_id = rep").select("vec_id", "h")
    byte = lambda i: F.call_function("shiftrightunsigned", F.col("h"), F.lit(8 * i)).bitwiseAND(255)
    keys = [F.struct(F.lit(8 * i + j).alias("bytes"), (byte(i) * 256 + byte(j)).alias("value")) for i in range(8) for j in range(i)]
    k = h.select("vec_id", "h", F.explode(F.array(*keys)).alias("k")).select("vec_id", "h", "k.*")
    x, y = k.select(F.col("vec_id").alias("a"), F.col("h").alias("ha"), "bytes", "value"), k.select(F.col("vec_id").alias("b"), F.col("h").alias("hb"), "bytes", "value")
    pairs = x.join(y, ["bytes", "value"]).where("a < b").withColumn("distance", F.bit_count(F.col("ha").bitwiseXOR(F.col("hb"))))
    return pairs.where("distance <= 6").select("a", "b", "distance").distinct()
