"""Library, model list, roll-up and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.fuzzy import fuzzy_score
from ..operators.ranking import top_by
from ..sources.tables import table
from .registry import query


@query()
def fuzzy_ranking(spark, sf_dir):
    """The 50 best titles for a query of two words by the best alignment of their letters; a dynamic program, held against
    a plain one in the tests."""
    scored = table(spark, sf_dir, "part").select("p_partkey", "p_name", fuzzy_score(F.col("p_name"), "gr le").alias("score")).where("score IS NOT NULL")
    return scored.orderBy(F.col("score").desc(), "p_name", "p_partkey").limit(50)


@query("""SELECT p_partkey, p_name, round(3.0 / length(s), 9)::DOUBLE AS score FROM (SELECT *, regexp_extract(lower(p_name), '(r.*?e.*?t)', 1) AS s FROM part) WHERE length(s) > 0 ORDER BY score DESC, p_partkey LIMIT 50""")
def fuzzy_library_search(spark, sf_dir):
    """The 50 names that match a pattern's letters in order most closely."""
    score = t.fuzzy(F.col("p_name"), "ret")
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", F.round(score, 9).alias("score")).where("score IS NOT NULL").orderBy(F.col("score").desc(), "p_partkey").limit(50)


@query("SELECT p_partkey, 2::BIGINT AS n_authors, p_brand || '|' || p_type AS authors, (p_size * 100)::BIGINT AS downloads FROM part")
def author_lists(spark, sf_dir):
    """Author lists and compact counts written and parsed back."""
    a = t.authors(F.concat("p_brand", F.lit(" und "), "p_type"))
    count = t.compact_count(F.concat((F.col("p_size") / 10).cast("decimal(10,1)").cast("string"), F.lit("k")))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(a).cast("long").alias("n_authors"), F.array_join(a, "|").alias("authors"), count.alias("downloads"))


@query("""SELECT role, count(*) AS n_turns, count(DISTINCT conv_id) AS n_conversations, round(avg(length(text)), 6) AS mean_chars, count(*) - count(DISTINCT conv_id) AS saved FROM conversations GROUP BY role""")
def role_counts(spark, sf_dir):
    """Turns by role, and how many lookups a batch saves when each conversation is fetched once."""
    c = table(spark, sf_dir, "conversations").groupBy("role", "conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("s"))
    return c.groupBy("role").agg(F.sum("n").alias("n_turns"), F.count(F.lit(1)).alias("n_conversations"), F.round(F.sum("s") / F.sum("n"), 6).alias("mean_chars"), (F.sum("n") - F.count(F.lit(1))).alias("saved"))


@query("""SELECT s_nationkey, max_by(s_suppkey, s_acctbal) AS suppkey, round(max(s_acctbal), 2) AS acctbal, n_name, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY s_nationkey, n_name, r_name""")
def current_generations(spark, sf_dir):
    """The latest row of each group by one aggregate, with its names."""
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.max_by("s_suppkey", "s_acctbal").alias("suppkey"), F.round(F.max("s_acctbal"), 2).alias("acctbal"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_nationkey", "suppkey", "acctbal", "n_name", "r_name")


@query("""SELECT p_brand, p_partkey, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY (p_size <= 30) DESC, p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3""")
def recommended_models(spark, sf_dir):
    """The three best of each kind: those that fit first, then by score."""
    return top_by(table(spark, sf_dir, "part"), ["p_brand"], [(F.col("p_size") <= 30).desc(), F.col("p_retailprice").desc(), F.col("p_partkey")], 3).select("p_brand", "p_partkey", "rank")


@query("""SELECT lang, metric, round(value, 6)::DOUBLE AS value FROM (
  SELECT lang, unnest(['documents', 'characters', 'mean_lines', 'labelled', 'toxic']) AS metric,
    unnest([count(*)::DOUBLE, sum(n_chars)::DOUBLE, avg(length(text) - length(replace(text, chr(10), '')) + 1), count(l.doc_id)::DOUBLE, coalesce(sum(l.toxic), 0)::DOUBLE]) AS value
  FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY lang)""")
def quality_rollup(spark, sf_dir):
    """Metrics of each language as rows: one aggregate, then a map unfolded."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "toxic", F.lit(1).alias("seen")), "doc_id", "left")
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    a = d.groupBy("lang").agg(F.count(F.lit(1)).cast("double").alias("documents"), F.sum("n_chars").cast("double").alias("characters"), F.avg(lines).alias("mean_lines"), F.count("seen").cast("double").alias("labelled"), F.coalesce(F.sum("toxic"), F.lit(0)).cast("double").alias("toxic"))
    return a.unpivot("lang", ["documents", "characters", "mean_lines", "labelled", "toxic"], "metric", "value").select("lang", "metric", F.round("value", 6).alias("value"))


@query("""SELECT l_suppkey, count(*) FILTER (r AND NOT a) AS only_returned, count(*) FILTER (r AND a) AS in_both, count(*) FILTER (a AND NOT r) AS only_kept FROM (
  SELECT l_suppkey, l_partkey, bool_or(l_returnflag = 'R') AS r, bool_or(l_returnflag <> 'R') AS a FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def facet_coverage(spark, sf_dir):
    """Differences and intersections of two sets of parts for each supplier, without building either."""
    p = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_returnflag") != "R").alias("a"))
    return p.groupBy("l_suppkey").agg(F.count_if(F.col("r") & ~F.col("a")).alias("only_returned"), F.count_if(F.col("r") & F.col("a")).alias("in_both"), F.count_if(F.col("a") & ~F.col("r")).alias("only_kept"))


@query(r"""SELECT conv_id, turn, i::INTEGER AS facet, md5(f) AS digest FROM (SELECT conv_id, turn, unnest(x) AS f, unnest(range(1, len(x) + 1)) AS i FROM (
  SELECT conv_id, turn, p[1:3] AS x FROM (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')),
    '(?i)\b(?:und|and)\s+((?:was|wie|warum|wann|wo|welche[rmns]?|wer|wodurch|what|how|why|where|which|who)\b)', chr(2) || '\1', 'g'), '[;?\x02]+|\b(?i:sowie|außerdem|zusätzlich|and additionally)\b'),
    lambda c: trim(c, ' -–—,.;:?')), lambda c: c <> '') AS p FROM conversations WHERE role = 'user')))""")
def question_facets(spark, sf_dir):
    """Clauses of questions, three at most."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.posexplode(t.facets(F.col("text"), 3)).alias("i", "f"))
    return c.select("conv_id", "turn", (F.col("i") + 1).alias("facet"), F.md5("f").alias("digest"))
