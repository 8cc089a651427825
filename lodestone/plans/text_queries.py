"""Text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from ..sources.tables import table
from .registry import query

STOP = ", ".join(f"'{w}'" for w in t.STOP_WORDS)
WORDS = r"[\p{L}\p{N}]+(?:[-_/][\p{L}\p{N}]+)*"
SPACED = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
TERMS = rf"""list_distinct(list_filter(list_transform(list_filter(regexp_extract_all({SPACED.format("{}")}, '{WORDS}'),
  lambda w: length(w) >= 2 OR regexp_matches(w, '^[\p{{Lu}}\p{{Nd}}]$')), lambda w: replace(lower(w), 'ß', 'ss')), lambda w: w NOT IN ({STOP})))"""
BOOK = "trim(regexp_replace(strip_accents(replace(lower({}), 'ß', 'ss')), '[^a-z0-9]+', ' ', 'g'))"


def terms_sql(column: str) -> str:
    return TERMS.replace("{}", column).replace("{{", "{").replace("}}", "}")


@query(rf"""SELECT doc_id, length({SPACED.format("text")})::BIGINT AS n_chars, md5({SPACED.format("text")}) AS digest FROM documents""")
def normalized_query_text(spark, sf_dir):
    s = t.one_space(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(s).cast("long").alias("n_chars"), F.md5(s).alias("digest"))


@query(f"SELECT doc_id, len(x)::BIGINT AS n_terms, md5(array_to_string(list_sort(x), ' ')) AS digest FROM (SELECT doc_id, {terms_sql('text')} AS x FROM documents)")
def search_terms_of_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", t.search_terms(F.col("text")).alias("x"))
    return d.select("doc_id", F.size("x").cast("long").alias("n_terms"), F.md5(F.array_join(F.array_sort("x"), " ")).alias("digest"))


@query(f"SELECT doc_id, md5({BOOK.format('text')}) AS digest, length({BOOK.format('text')})::BIGINT AS n FROM documents")
def book_text_of_documents(spark, sf_dir):
    s = t.book_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(s).alias("digest"), F.length(s).cast("long").alias("n"))


@query(f"""SELECT doc_id, len(x)::BIGINT AS n_terms, md5(array_to_string(x, ' ')) AS digest FROM (
  SELECT doc_id, list_filter(string_split({BOOK.format("text")}, ' '), lambda w: length(w) >= 3 AND NOT regexp_matches(w, '[0-9]') AND w NOT IN ({STOP})) AS x FROM documents)""")
def term_tokens_of_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", t.term_tokens(F.col("text")).alias("x"))
    return d.select("doc_id", F.size("x").cast("long").alias("n_terms"), F.md5(F.array_join("x", " ")).alias("digest"))


@query(r"""SELECT doc_id, greatest(1, ceil(length(text) / 4.0))::BIGINT AS estimated, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))::BIGINT AS raw FROM documents""")
def token_estimates(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", t.estimated_tokens(F.col("text")).alias("estimated"), t.raw_tokens(F.col("text")).alias("raw"))


@query(r"""SELECT doc_id, len(x)::BIGINT AS n_sentences, list_max(list_transform(x, lambda s: length(s)))::BIGINT AS longest FROM (
  SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS x FROM documents)""")
def sentence_spans(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", t.sentences(F.col("text")).alias("x"))
    return d.select("doc_id", F.size("x").cast("long").alias("n_sentences"), F.array_max(F.transform("x", F.length)).cast("long").alias("longest"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM l)
SELECT doc_id, line_no::BIGINT AS line_no, a::BIGINT AS start_char, (a + length(line))::BIGINT AS end_char FROM o WHERE trim(line) <> ''""")
def line_spans(spark, sf_dir):
    """Offsets by a running sum within a document's own array: no shuffle."""
    lines = F.split("text", "\n")
    d = table(spark, sf_dir, "documents").select("doc_id", F.aggregate(
        lines, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<a:bigint,line:string>>").alias("out")),
        lambda s, x: F.struct((s["at"] + F.length(x) + 1).alias("at"), F.concat(s["out"], F.array(F.struct(s["at"].alias("a"), x.alias("line")))).alias("out")), lambda s: s["out"]).alias("x"))
    e = d.select("doc_id", F.posexplode("x").alias("line_no", "l")).where(F.trim("l.line") != "")
    return e.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("l.a").alias("start_char"), (F.col("l.a") + F.length("l.line")).cast("long").alias("end_char"))


def _cues(words):
    return " + ".join(f"(length(p) - length(replace(p, '{w}', ''))) // {len(w)}" for w in words)


@query(f"""SELECT doc_id, CASE WHEN g >= e THEN 'de' ELSE 'en' END AS language, CASE WHEN g = 0 AND e = 0 THEN 0.4::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM (
  SELECT doc_id, {_cues(t.GERMAN_CUES)} AS g, {_cues(t.ENGLISH_CUES)} AS e FROM (SELECT doc_id, ' ' || lower(text) || ' ' AS p FROM documents))""")
def language_of_documents(spark, sf_dir):
    name, sure = t.language(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("language"), sure.alias("confidence"))


@query("""WITH b AS (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 9, '0') AS d FROM orders),
w AS (SELECT o_orderkey, unnest([0, 1, 2, 3]) AS form, unnest(['978-' || d || '-' || (o_orderkey % 10), d[:1] || '-' || d[2:5] || '-' || d[6:] || '-' || (o_orderkey % 10), d || CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE '7' END, 'ISBN ' || d]) AS raw FROM b),
c AS (SELECT *, regexp_replace(upper(raw), '[^0-9X]', '', 'g') AS d FROM w),
v AS (SELECT *, list_transform(string_split(d, ''), lambda x: CASE WHEN x = 'X' THEN 10 ELSE TRY_CAST(x AS INTEGER) END) AS n FROM c)
SELECT o_orderkey, form, CASE WHEN len(n) = 10 AND list_sum(list_transform(n, lambda x, i: x * (11 - i)))::INTEGER % 11 = 0 THEN d
  WHEN len(n) = 13 AND list_sum(list_transform(n, lambda x, i: x * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END))::INTEGER % 10 = 0 THEN d END AS isbn FROM v""")
def isbn_checks(spark, sf_dir):
    """Right and wrong ISBNs in four forms; most fail their check digit, the last is too short."""
    d, last = F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), (F.col("o_orderkey") % 10).cast("string")
    part = lambda i, n: F.substring(d, i, n)
    raw = [F.concat(F.lit("978-"), d, F.lit("-"), last), F.concat_ws("-", part(1, 1), part(2, 4), part(6, 4), last), F.concat(d, F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise("7")), F.concat(F.lit("ISBN "), d)]
    w = table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(F.array(*raw)).alias("form", "raw"))
    return w.select("o_orderkey", "form", t.isbn(F.col("raw")).alias("isbn"))


ROMAN_TENS = ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]
ROMAN_ONES = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]


@query(f"""WITH w AS (SELECT p_partkey, repeat('M', p_partkey::INTEGER % 4) || {ROMAN_TENS}[p_size // 10 + 1] || lower({ROMAN_ONES}[p_size % 10 + 1]) AS r FROM part),
v AS (SELECT *, list_transform(string_split(upper(r), ''), lambda x: CASE x WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 WHEN 'M' THEN 1000 END) AS v FROM w)
SELECT p_partkey, r AS written, list_sum(list_transform(v, lambda x, i: CASE WHEN x < coalesce(v[i + 1], 0) THEN -x ELSE x END))::INTEGER AS page FROM v""")
def roman_page_numbers(spark, sf_dir):
    """Page numbers written as Roman numerals, in either case, and read back."""
    n, thousands = F.col("p_size"), (F.col("p_partkey") % 4).cast("int")
    pick = lambda words, i: F.element_at(F.array(*[F.lit(x) for x in words]), i.cast("int") + 1)
    written = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.repeat(F.lit("M"), thousands), pick(ROMAN_TENS, n / 10), F.lower(pick(ROMAN_ONES, n % 10))).alias("written"))
    return written.select("p_partkey", "written", t.roman(F.col("written")).alias("page"))


@query(r"""WITH w AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 7 WHEN 0 THEN l_partkey::VARCHAR WHEN 1 THEN l_partkey || 'f' WHEN 2 THEN ' ' || l_partkey || ' ff. ' WHEN 3 THEN l_partkey || '–' || (l_partkey + l_quantity * 20)::INTEGER
  WHEN 4 THEN l_partkey || '-' || l_suppkey WHEN 5 THEN 'p' || l_partkey ELSE l_partkey || '-' END AS raw FROM lineitem),
x AS (SELECT *, regexp_extract(raw, '^\s*(\d+)(?:\s*[-–—]\s*(\d+))?(?:\s*(ff?)\.?)?\s*$', ['a', 'b', 's']) AS m FROM w),
y AS (SELECT *, TRY_CAST(m.a AS INTEGER) AS lo, CASE WHEN m.b <> '' THEN TRY_CAST(m.b AS INTEGER) ELSE TRY_CAST(m.a AS INTEGER) + length(m.s)::INTEGER END AS hi FROM x)
SELECT l_orderkey, l_linenumber, lo AS first_page, hi AS last_page, m.s AS suffix FROM y WHERE lo >= 1 AND hi >= lo AND hi - lo <= 500""")
def page_locators(spark, sf_dir):
    """Locators in five right forms and wrong ones: ranges that fall or are too long, letters, an open range."""
    p, kind = F.col("l_partkey").cast("string"), F.col("l_linenumber") % 7
    far = (F.col("l_partkey") + F.col("l_quantity") * 20).cast("int").cast("string")
    raw = F.when(kind == 0, p).when(kind == 1, F.concat(p, F.lit("f"))).when(kind == 2, F.concat(F.lit(" "), p, F.lit(" ff. "))).when(kind == 3, F.concat(p, F.lit("–"), far)).when(kind == 4, F.concat_ws("-", p, F.col("l_suppkey").cast("string"))).when(kind == 5, F.concat(F.lit("p"), p)).otherwise(F.concat(p, F.lit("-")))
    # A filter on the struct would work it out a second time.
    found = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.inline(F.array_compact(F.array(t.page_locator(raw)))))
    return found.select("l_orderkey", "l_linenumber", F.col("first").alias("first_page"), F.col("last").alias("last_page"), "suffix")


ENTRY = r"^(.*?\D)[, ]\s*((?:[1-9]\d*(?:-[1-9]\d*)?(?:ff?)?)(?:, ?[1-9]\d*(?:-[1-9]\d*)?(?:ff?)?)*)$"


@query(rf"""WITH w AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name || ' ' || (p_size + 1) || ', ' || (p_size + 9) || 'f' WHEN 1 THEN p_name || ', ' || p_size || '-' || (p_size + 4) WHEN 2 THEN p_name || ', see ' || p_brand
  WHEN 3 THEN p_name || ' 0, ' || p_size WHEN 4 THEN repeat(p_name || ' a ', 6) || p_size ELSE p_size::VARCHAR END AS s FROM part),
x AS (SELECT *, trim(regexp_replace(regexp_extract(s, '{ENTRY}', 1), '[,\s]+$', '')) AS term, regexp_extract(s, '{ENTRY}', 2) AS pages FROM w)
SELECT p_partkey, term, replace(pages, ' ', '') AS locators FROM x WHERE pages <> '' AND term <> '' AND len(string_split(term, ' ')) <= 12""")
def index_entries(spark, sf_dir):
    """Subject index lines: right ones, and ones without pages, with a zero, with too long a term, without a term."""
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    more = lambda n: (F.col("p_size") + n).cast("string")
    line = F.when(kind == 0, F.concat("p_name", F.lit(" "), more(1), F.lit(", "), more(9), F.lit("f"))).when(kind == 1, F.concat("p_name", F.lit(", "), size, F.lit("-"), more(4))).when(kind == 2, F.concat("p_name", F.lit(", see "), "p_brand"))
    line = line.when(kind == 3, F.concat("p_name", F.lit(" 0, "), size)).when(kind == 4, F.concat(F.repeat(F.concat("p_name", F.lit(" a ")), F.lit(6)), size)).otherwise(size)
    d = table(spark, sf_dir, "part").select("p_partkey", t.index_entry(line).alias("x")).where("x IS NOT NULL")
    return d.select("p_partkey", F.col("x.term").alias("term"), F.array_join("x.locators", ",").alias("locators"))


URLS = ["https://host{}.example/a?b", "http://localhost:{}/x", "https://10.{}.2.3/", "ftp://host{}/", "https://user:pw@host{}/", "nonsense {}", "http://172.{}.1.1/x", "http://[::1]/{}", "HTTP://Host{}.Example:8080#f", "http://127.0.0.{}", "https:///{}"]


@query(rf"""WITH u AS (SELECT 'p' || page_id AS id, url FROM pages UNION ALL SELECT 'c' || c_custkey, replace({URLS}[c_custkey % {len(URLS)} + 1], '{{}}', (c_custkey % 40)::VARCHAR) FROM customer),
a AS (SELECT *, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS authority FROM u),
h AS (SELECT *, lower(regexp_replace(regexp_replace(authority, '^.*@', ''), ':\d+$', '')) AS host FROM a)
SELECT id, scheme, host, CASE WHEN host = '' THEN 'invalid' WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN contains(authority, '@') THEN 'credentials' WHEN host = 'localhost' OR host = '[::1]' OR starts_with(host, '127.') THEN 'loopback'
  WHEN starts_with(host, '10.') OR starts_with(host, '192.168.') OR starts_with(host, '169.254.') OR (starts_with(host, '172.') AND TRY_CAST(string_split(host, '.')[2] AS INTEGER) BETWEEN 16 AND 31) THEN 'private' ELSE 'allow' END AS policy FROM h""")
def url_policy(spark, sf_dir):
    """What an egress check makes of the pages' addresses and of made ones of every kind."""
    url = F.replace(F.element_at(F.array(*[F.lit(x) for x in URLS]), (F.col("c_custkey") % len(URLS)).cast("int") + 1), F.lit("{}"), (F.col("c_custkey") % 40).cast("string"))
    made = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), url.alias("url"))
    u = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), "url").unionByName(made)
    scheme = F.lower(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return u.select("id", scheme.alias("scheme"), F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":\d+$", "")).alias("host"), t.host_policy(F.col("url")).alias("policy"))


PLAIN = r"trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT page_id, length({PLAIN})::BIGINT AS n_chars, md5({PLAIN}) AS digest, len(regexp_extract_all(html, '<h1[^>]*>'))::BIGINT AS n_headings FROM pages")
def plain_text_of_pages(spark, sf_dir):
    s = t.one_space(F.regexp_replace("html", "<[^>]+>", " "))
    return table(spark, sf_dir, "pages").select("page_id", F.length(s).cast("long").alias("n_chars"), F.md5(s).alias("digest"), F.regexp_count("html", F.lit("<h1[^>]*>")).cast("long").alias("n_headings"))


@query(f"""WITH x AS (SELECT conv_id, turn, {terms_sql("text")} AS a FROM conversations),
y AS (SELECT *, lag(a) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM x)
SELECT conv_id, turn, round(CASE WHEN len(a) + len(b) > 0 THEN 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) ELSE 0.0 END, 9)::DOUBLE AS dice,
  round(CASE WHEN len(list_distinct(a || b)) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(a || b)) ELSE 0.0 END, 9)::DOUBLE AS jaccard FROM y WHERE b IS NOT NULL""")
def turn_similarity(spark, sf_dir):
    """Dice and Jaccard similarity of a turn's terms with the turn before."""
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.search_terms(F.col("text")).alias("a"))
    d = d.withColumn("b", F.lag("a").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b IS NOT NULL")
    return d.select("conv_id", "turn", F.round(t.dice(F.col("a"), F.col("b")), 9).alias("dice"), F.round(t.jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"))


@query("""SELECT doc_id, 'ev-' || substr(sha256(source || chr(0) || lang || chr(0) || sha256(text)), 1, 24) AS evidence_id, sha256(text) AS content_hash FROM documents""")
def evidence_ids(spark, sf_dir):
    h = F.sha2("text", 256)
    return table(spark, sf_dir, "documents").select("doc_id", t.prefixed_id("ev", F.col("source"), F.col("lang"), h).alias("evidence_id"), h.alias("content_hash"))


def _signals() -> str:
    return " + ".join(f"CASE WHEN regexp_matches(q, '{p}') THEN {w} ELSE 0 END" for name, w, p in t.SIGNALS if name != "direct")


@query(rf"""WITH q AS (SELECT conv_id, turn, {SPACED.format("text")} AS q FROM conversations WHERE role = 'user'),
c AS (SELECT *, list_filter(list_transform(string_split_regex(regexp_replace(q, '(?i)\b(?:und|and)\s+((?:was|wie|warum|wann|wo|welche[rmns]?|wer|wodurch|what|how|why|where|which|who)\b)', chr(2) || '\1', 'g'), '[;?\x02]+|\b(?i:sowie|außerdem|zusätzlich|and additionally)\b'), lambda x: trim(x, ' -.,:?')), lambda x: x <> '') AS cl FROM q),
n AS (SELECT *, len(list_filter(cl, lambda x: regexp_matches(x, '{t.QUESTION_WORD}'))) AS asked FROM c),
s AS (SELECT conv_id, turn, ({_signals()} + CASE WHEN regexp_matches(q, '{t.SIGNALS[-1][2]}') AND asked < 2 THEN -1 ELSE 0 END + CASE WHEN asked >= 2 THEN 1 ELSE 0 END)::INTEGER AS score FROM n)
SELECT conv_id, turn, score, CASE WHEN score <= 0 THEN 'simple' WHEN score <= 2 THEN 'standard' ELSE 'complex' END AS complexity FROM s""")
def query_complexity(spark, sf_dir):
    score, kind = t.complexity(F.col("text"))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", score.cast("int").alias("score"), kind.alias("complexity"))


@query(f"""WITH x AS (SELECT doc_id, {terms_sql("text")} AS a FROM documents)
SELECT doc_id, len(list_intersect(a, [{", ".join(f"'{w}'" for w in t.NEGATIONS)}])) > 0 AS negated FROM x""")
def negation_of_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.negated(t.search_terms(F.col("text"))).alias("negated"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 9) AS norm,
  round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS unit_sum FROM embeddings""")
def unit_vectors(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    square = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(square, 9).alias("norm"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / square, 6).alias("unit_sum"))


@query("""SELECT l_orderkey, l_linenumber, round(1.0 / (1.0 + exp(-(1.35 * x - 0.55))), 9) AS probability, 1.0 / (1.0 + exp(-(1.35 * x - 0.55))) >= 0.62 AS strict
FROM (SELECT *, l_discount * 100 - l_tax * 50 AS x FROM lineitem)""")
def calibrated_probability(spark, sf_dir):
    from ..operators.ranking import THRESHOLDS, calibrated

    p = calibrated(F.col("l_discount") * 100 - F.col("l_tax") * 50)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(p, 9).alias("probability"), (p >= THRESHOLDS["strict"]).alias("strict"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS x0, l_quantity / 50 + l_tax * 5 AS x1, l_discount * 8 AS y0, l_discount * 8 + 0.3 AS y1 FROM lineitem),
c AS (SELECT l_orderkey, l_linenumber, least(greatest(x0, 0), 1) AS x0, least(greatest(x1, 0), 1) AS x1, least(greatest(y0, 0), 1) AS y0, least(greatest(y1, 0), 1) AS y1 FROM b)
SELECT l_orderkey, l_linenumber, round(greatest(x1 - x0, 0) * greatest(y1 - y0, 0), 9) AS area,
  ((x0 <= 0.01)::INTEGER + (y0 <= 0.01)::INTEGER + (x1 >= 0.99)::INTEGER + (y1 >= 0.99)::INTEGER)::INTEGER AS edges FROM c WHERE x1 > x0 AND y1 > y0""")
def normalized_boxes(spark, sf_dir):
    """Boxes clamped to the page, without empty ones; area and how many page edges they touch."""
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    q, d, x = F.col("l_quantity") / 50, F.col("l_discount") * 8, F.col("l_tax") * 5
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", unit(q).alias("x0"), unit(q + x).alias("x1"), unit(d).alias("y0"), unit(d + 0.3).alias("y1")).where("x1 > x0 AND y1 > y0")
    edges = (F.col("x0") <= 0.01).cast("int") + (F.col("y0") <= 0.01).cast("int") + (F.col("x1") >= 0.99).cast("int") + (F.col("y1") >= 0.99).cast("int")
    return b.select("l_orderkey", "l_linenumber", F.round((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), 9).alias("area"), edges.alias("edges"))
