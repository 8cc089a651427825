"""Ranked retrieval, fusion, selection, evaluation and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import catalog, graph, postings, ranking, selection
from ..operators import documents as d
from ..sources.tables import spread, table
from .registry import query
from .text_queries import BOOK, STOP, terms_sql

TOKENS = rf"list_filter(regexp_extract_all(lower({{}}), '[\p{{L}}\p{{N}}_]+'), lambda w: w NOT IN ({STOP}))"


def tokens_sql(column: str) -> str:
    return TOKENS.replace("{}", column).replace("{{", "{").replace("}}", "}")


def index_tokens(column: str):
    return F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}_]+"), lambda w: (w != "") & ~w.isin(*t.STOP_WORDS))


BM25 = f"""d AS (SELECT doc_id, w, len(w) AS len FROM (SELECT doc_id, {tokens_sql("text")} AS w FROM documents)),
st AS (SELECT count(*) AS n_docs, avg(len) AS mean_length FROM d),
q AS (SELECT item_id, unnest(list_distinct({tokens_sql("text")})) AS term FROM benchmark),
tf AS (SELECT term, doc_id, len, count(*) AS tf FROM (SELECT doc_id, len, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT item_id, doc_id, round(sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean_length))), 9) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM sc)"""
OVERLAP = f"""ob AS (SELECT item_id, unnest({terms_sql("text")}) AS term FROM benchmark),
od AS (SELECT doc_id, len(x) AS n, unnest(x) AS term FROM (SELECT doc_id, {terms_sql("text")} AS x FROM documents)),
oq AS (SELECT item_id, doc_id, round(count(*) / sqrt(any_value(n)), 9) AS score FROM ob JOIN od USING (term) GROUP BY ALL),
ov AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM oq)"""


def bm25_of_benchmark(spark, sf_dir, k, only=None):
    index = postings.shared(table(spark, sf_dir, "documents"), "doc_id", index_tokens("text"), "index tokens")
    only = None if only is None else only.select(F.col("doc_id").alias("doc"))
    return postings.search(index, table(spark, sf_dir, "benchmark"), "item_id", index_tokens("text"), k, only).withColumnRenamed("doc", "doc_id")


def overlap_of_benchmark(spark, sf_dir, k):
    """A second channel: shared distinct terms over the root of a document's."""
    terms = t.search_terms(F.col("text"))
    return ranking.overlap_top_k(table(spark, sf_dir, "documents"), "doc_id", terms, table(spark, sf_dir, "benchmark"), "item_id", terms, k)


@query(f"WITH {BM25} SELECT item_id, doc_id, rank, round(score, 6) AS score FROM bm WHERE rank <= 10")
def bm25_top_k(spark, sf_dir):
    return bm25_of_benchmark(spark, sf_dir, 10).select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {BM25}, al AS (SELECT doc_id FROM documents WHERE lower(lang) = 'de' AND lower(source) IN ('src1', 'src2')),
fr AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM bm WHERE doc_id IN (SELECT doc_id FROM al))
SELECT item_id, doc_id, rank, round(score, 6) AS score FROM fr WHERE rank <= 3""")
def bm25_filtered_before_limit(spark, sf_dir):
    """The three best documents of a filtered library: the filter is a semi join before the limit, so it costs no results."""
    only = table(spark, sf_dir, "documents").where(catalog.document_filter({"language": "DE", "source": ["src1", "src2"]}))
    return bm25_of_benchmark(spark, sf_dir, 3, only).select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"))


MEDIA_STOP = ", ".join(f"'{w}'" for w in t.MEDIA_STOP_WORDS)


@query(rf"""WITH d AS (SELECT conv_id, turn, role, w, len(w) AS len FROM (SELECT conv_id, turn, role, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM conversations)),
st AS (SELECT count(*) AS n_docs, avg(len) AS mean_length FROM d),
q AS (SELECT item_id, unnest(list_filter(w, lambda x, i: list_position(w, x) = i)[1:12]) AS term FROM
  (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 3 AND x NOT IN ({MEDIA_STOP})) AS w FROM benchmark)),
tf AS (SELECT term, conv_id, turn, role, len, count(*) AS tf FROM (SELECT conv_id, turn, role, len, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT item_id, conv_id, turn, role, round(sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean_length))), 9) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, conv_id, turn, role)::INTEGER AS rank FROM sc)
SELECT item_id, r.conv_id, r.turn, r.role, rank, round(score, 6) AS score, length(text)::INTEGER AS asset_chars FROM r JOIN conversations USING (conv_id, turn, role) WHERE rank <= 16""")
def media_text_search(spark, sf_dir):
    """The 16 best turns, as captions of assets, for up to 12 words of three letters or more of each passage; hits are
    joined to their assets on three keys."""
    turns = table(spark, sf_dir, "conversations")
    assets = turns.select(F.struct("conv_id", "turn", "role").alias("asset"), "text")
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    asked = F.slice(F.array_distinct(F.filter(words("text"), lambda w: (F.length(w) >= 3) & ~w.isin(*t.MEDIA_STOP_WORDS))), 1, 12)
    index = postings.shared(assets, "asset", words("text"), "media words")
    hits = postings.search(index, table(spark, sf_dir, "benchmark"), "item_id", asked, 16).select("item_id", "doc.*", "rank", F.round("score", 6).alias("score"))
    return hits.join(turns.select("conv_id", "turn", "role", F.length("text").alias("asset_chars")), ["conv_id", "turn", "role"])


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS item, round(list_cosine_similarity(q.e, c.e), 9) AS similarity FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item)::INTEGER AS rank FROM s)
SELECT query_id, item, rank, round(similarity, 6) AS similarity FROM r WHERE rank <= 10""")
def dense_top_k(spark, sf_dir):
    """Exact cosine search; queries are the rows whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings")
    found = ranking.dense_top_k(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 10)
    return found.select("query_id", "item", "rank", F.round("similarity", 6).alias("similarity"))


FUSED = f"""WITH {BM25}, {OVERLAP},
al AS (SELECT item_id, doc_id, rank, 1.2 AS w, 'fts' AS path FROM bm WHERE rank <= 40 UNION ALL SELECT item_id, doc_id, rank, 1.0, 'hybrid' FROM ov WHERE rank <= 40),
fu AS (SELECT item_id, doc_id, round(sum(w / (60 + rank)), 12) AS score, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM al GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM fu)"""


def fused_ranking(spark, sf_dir, k):
    fts = bm25_of_benchmark(spark, sf_dir, 40).select("item_id", "doc_id", F.col("rank").alias("pos"), F.lit("fts").alias("path"))
    other = overlap_of_benchmark(spark, sf_dir, 40).select("item_id", "doc_id", F.col("rank").alias("pos"), F.lit("hybrid").alias("path"))
    return ranking.fused(fts.unionByName(other), "item_id", "doc_id", k=k)


@query(f"{FUSED} SELECT item_id, doc_id, rank, paths, round(score, 9)::DOUBLE AS score FROM fr WHERE rank <= 20")
def rank_fusion(spark, sf_dir):
    """Two channels of 40 results fused, the best 20 of each query."""
    return fused_ranking(spark, sf_dir, 20).select("item_id", "doc_id", "rank", "paths", F.round("score", 9).alias("score"))


@query(f"""{FUSED},
pr AS (SELECT item_id, doc_id, 1 / (1 + exp(-(1.35 * (score * 100) - 0.55))) AS p, md5(text) AS h FROM fr JOIN documents USING (doc_id) WHERE rank <= 20),
de AS (SELECT *, row_number() OVER (PARTITION BY item_id, h ORDER BY p DESC, doc_id) AS r FROM pr WHERE p >= 0.62)
SELECT item_id, doc_id, round(p, 6) AS relevance FROM de WHERE r = 1""")
def eligible_candidates(spark, sf_dir):
    """Fused candidates calibrated, held to the strict threshold, one for each content."""
    return eligible(spark, sf_dir).select("item_id", "doc_id", F.round("p", 6).alias("relevance"))


def eligible(spark, sf_dir):
    found = fused_ranking(spark, sf_dir, 20).select("item_id", "doc_id", ranking.calibrated(F.col("score") * 100).alias("p"))
    found = found.where(F.col("p") >= max(ranking.FLOOR, ranking.THRESHOLDS["strict"]))
    content = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    return ranking.keep_best(found.join(content, "doc_id"), ["item_id", "h"], "p", "doc_id")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY p DESC, o_orderkey) AS rank FROM (SELECT o_custkey, o_orderkey, round(o_totalprice / 500000, 6) AS p FROM orders)),
w AS (SELECT *, p - lead(p) OVER (PARTITION BY o_custkey ORDER BY rank) AS gap, count(*) OVER (PARTITION BY o_custkey) AS n, max(p) OVER (PARTITION BY o_custkey) AS top FROM r WHERE rank <= 8),
c AS (SELECT *, max(CASE WHEN rank >= 2 AND gap >= 0.08 THEN gap END) OVER (PARTITION BY o_custkey) AS best, sum((p >= top - 0.15)::INTEGER) OVER (PARTITION BY o_custkey) AS near FROM w),
m AS (SELECT *, min(CASE WHEN rank >= 2 AND gap = best THEN rank END) OVER (PARTITION BY o_custkey) AS cut_at FROM c)
SELECT o_custkey, o_orderkey, rank::INTEGER AS rank, CASE WHEN n <= 2 THEN 'available' WHEN best IS NOT NULL THEN 'score_gap' ELSE 'top_delta' END AS reason FROM m
WHERE rank <= CASE WHEN n <= 2 THEN n WHEN best IS NOT NULL THEN cut_at ELSE greatest(2, near) END""")
def score_gap_cut(spark, sf_dir):
    """Each customer's orders as scored candidates, cut at the largest gap."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") / 500000, 6).alias("p"))
    return ranking.gap_cut(rows, "o_custkey", "p", "o_orderkey", 2, 8).select("o_custkey", "o_orderkey", "rank", "reason")


@query()
def diversified_selection(spark, sf_dir):
    """Greedy choice of 5 diverse candidates of each query; sequential, so held against brute force in the tests."""
    # Terms only of the few that are candidates.
    rows = eligible(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return ranking.diversified(rows.select("item_id", "doc_id", "p", t.search_terms(F.col("text")).alias("terms")), "item_id", "doc_id", "p", "terms", 5)


@query()
def adaptive_selection(spark, sf_dir):
    """Evidence of each passage: candidates of two channels, scored anew by shared words, with one language and one source
    as required facets; a greedy choice, so held against plain loops in the tests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source")).alias("facets"))
    asked = table(spark, sf_dir, "benchmark").select("item_id", t.search_terms(F.col("text")).alias("wanted"))
    # Terms only of the few that are candidates.
    found = fused_ranking(spark, sf_dir, 20).select("item_id", "doc_id").join(docs, "doc_id").join(asked, "item_id")
    found = found.withColumn("content", F.md5("text")).withColumn("terms", t.search_terms(F.col("text")))
    rows = found.select("item_id", F.format_string("%012d", "doc_id").alias("item"), (5 * d.overlap(F.col("terms"), F.col("wanted")) - 1).alias("score"), F.col("doc_id").cast("string").alias("document"), "content", F.col("source").alias("section"), "terms", "facets", F.array(F.lit("lang:en"), F.lit("source:src1")).alias("required"))
    chosen = selection.selected(rows, "item_id", "normal", selection.Budget(2, 8))
    return chosen.select("item_id", F.col("item").cast("long").alias("doc_id"), F.round("relevance", 6).alias("relevance"), "place", "reason", F.array_join("missing", ",").alias("missing"))


def gold(spark, sf_dir):
    """Documents that hold a benchmark passage verbatim, one row for each row of a passage and a document."""
    return holding(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "doc_id")


def holding(docs, items):
    """(item_id, doc_id): documents (doc_id, text) that hold a passage (item_id, text) verbatim, anywhere in a word.

    A passage is sought by five words inside it: only its first and last word can be parts of longer ones. The few that
    are too short for that are sought in every text. Both are checked.
    """
    words = F.split("text", r"[ \n]")
    items = items.where("text IS NOT NULL").select("item_id", F.col("text").alias("passage"), words.alias("words"))
    docs, inside = docs.select("doc_id", "text"), F.contains("text", "passage")
    long = items.where(F.size("words") >= 7).select("item_id", "passage", F.array_join(F.slice("words", 2, 5), " ").alias("gram"))
    met = docs.withColumn("gram", F.explode(F.array_distinct(grams("text", 5)))).join(long, "gram").where(inside)
    short = docs.join(items.where(F.size("words") < 7), inside)
    return met.select("item_id", "doc_id").unionByName(short.select("item_id", "doc_id"))


def grams(column: str, n: int):
    return t.let(F.split(column, r"[ \n]"), lambda words: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " ")))


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def known_item_gold(spark, sf_dir):
    return gold(spark, sf_dir)


@query(f"""WITH {BM25},
gd AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
ft AS (SELECT g.item_id, min(rank) AS first FROM (SELECT DISTINCT item_id FROM gd) g LEFT JOIN (SELECT bm.* FROM bm JOIN gd USING (item_id, doc_id) WHERE rank <= 50) USING (item_id) GROUP BY g.item_id)
SELECT count(*) AS n_queries, round(avg((coalesce(first, 999) <= 5)::INTEGER), 9) AS recall_5, round(avg((coalesce(first, 999) <= 10)::INTEGER), 9) AS recall_10,
  round(avg(coalesce(1.0 / first, 0)), 9)::DOUBLE AS mrr, round(avg(CASE WHEN first <= 10 THEN 1.0 / log2(first + 1) ELSE 0 END), 9) AS ndcg_10 FROM ft""")
def retrieval_metrics(spark, sf_dir):
    return ranking.metrics(bm25_of_benchmark(spark, sf_dir, 50), gold(spark, sf_dir), "item_id", "doc_id")


@query("""WITH x AS (SELECT n_chars, toxic FROM labels JOIN documents USING (doc_id)),
c AS (SELECT n_chars, count(*) AS n, sum(toxic) AS pos FROM x GROUP BY n_chars),
r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS mr FROM c)
SELECT sum(pos)::BIGINT AS n_pos, sum(n - pos)::BIGINT AS n_neg, round((sum(mr * pos) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * sum(n - pos)), 9)::DOUBLE AS auc FROM r""")
def auc_by_rank_sums(spark, sf_dir):
    x = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return ranking.rank_auc(x, "n_chars", "toxic")


@query()
def platt_calibration(spark, sf_dir):
    """Logistic calibration of a length score on the quality labels; an iterative fit, held against brute force in the tests."""
    x = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    scale, bias = ranking.platt(x.select(F.round(F.log(F.col("n_chars") + 1.0) - 7.0, 3).alias("s"), "quality"), "s", "quality")
    return spark.createDataFrame([(float(scale), float(bias))], "scale double, bias double")


@query(f"""WITH d AS (SELECT doc_id, list_filter(string_split({BOOK.format("text")}, ' '), lambda w: length(w) >= 3 AND NOT regexp_matches(w, '[0-9]') AND w NOT IN ({STOP})) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS phrase, n FROM d, unnest([1, 2, 3, 4, 5]) AS s(n), unnest(range(1, len(w) - n + 2)) AS r(i))
SELECT phrase, count(*) AS df, ((1 + 0.25 * (any_value(n) - 1)) * count(*))::DOUBLE AS score FROM g GROUP BY phrase HAVING count(*) >= 2
ORDER BY score DESC, length(phrase) DESC, phrase LIMIT 100""")
def keyphrases(spark, sf_dir):
    """The 100 best phrases of 1 to 5 words by document frequency."""
    return graph.keyphrases(table(spark, sf_dir, "documents"), "doc_id", t.term_tokens(F.col("text")), 5, 100).select("phrase", "df", "score")


@query("""SELECT a.l_partkey AS a, b.l_partkey AS b, count(DISTINCT a.l_orderkey) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey
GROUP BY 1, 2 HAVING count(DISTINCT a.l_orderkey) >= 2""")
def cooccurring_terms(spark, sf_dir):
    """Parts that occur together in two orders or more; an order's lines bound its pairs."""
    return graph.cooccurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey").select("a", "b", "n")


def sold(spark, sf_dir):
    """Quantity w by (l_partkey, l_suppkey), and the lines it is summed from."""
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    rows = l.count()
    return spread(l, rows, "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("w")), rows


@query("""WITH e AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
u AS (SELECT 'p' || l_partkey AS node, 's' || l_suppkey AS neighbour, w FROM e UNION ALL SELECT 's' || l_suppkey, 'p' || l_partkey, w FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, neighbour)::INTEGER AS rank FROM u)
SELECT node, neighbour, round(w, 6) AS weight, rank FROM r WHERE rank <= 4""")
def graph_neighbours(spark, sf_dir):
    """The four heaviest neighbours of parts and suppliers over the edges between them."""
    e, rows = sold(spark, sf_dir)
    e = e.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), "w")
    return graph.neighbours(e, "src", "dst", "w", 4, rows).select("node", "neighbour", F.round("w", 6).alias("weight"), "rank")


@query()
def capped_neighbours(spark, sf_dir):
    """Edges between parts and suppliers by quantity, the heaviest first, five at most at each node; a walk, so held
    against one in the tests."""
    e, _ = sold(spark, sf_dir)
    return graph.capped(e, "l_partkey", "l_suppkey", "w")
