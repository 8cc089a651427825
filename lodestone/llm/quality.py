"""Quality rules as one projection (operator 6): a threshold table compiled to built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[ \t\n\x0B\f\r]+"
SYMBOLS = "#*$%&|<>"
#: Function words of the corpus's four languages (fixed values).
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "that", "for", "le", "la", "de", "et", "les", "des", "un", "une", "der", "die", "und", "den", "von", "mit", "ist", "das", "el", "los", "las", "que", "en", "y", "por", "del"]


@dataclass(frozen=True)
class Rule:
    """`numerator` / `denominator` must lie in [low, high]; compared as integers times `scale`, so no rounding decides."""

    name: str
    numerator: str
    denominator: str
    low: int | None
    high: int | None
    scale: int = 100


#: The default table. Bounds are hundredths.
RULES = [
    Rule("word_length_ok", "word_chars", "n_words", 200, 1200),
    Rule("symbols_ok", "n_symbols", "n_words", None, 10),
    Rule("dup_lines_ok", "n_dup_lines", "n_text_lines", None, 30),
    Rule("stop_words_ok", "n_stop_words", "n_words", 1, None),
    Rule("capitals_ok", "n_capitals", "word_chars", None, 40),
]


#: Stands among places for two different windows of one hash.
CLASH = -1


def let(value: Column, then) -> Column:
    """then(value) with value computed once: lambdas that name an outer expression would compute it for every element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def repeated_words(words: Column, n: Column, bits: Column, hash_of=F.xxhash64) -> Column:
    """Words that lie in 3-word windows found twice or more.

    Each window is a long of hash bits above `bits` position bits; equal windows are neighbours once these are sorted,
    and neighbours of equal bits are compared word by word. Should two of them differ, the text's windows are sorted by
    their words instead, so windows of one hash never hide each other.
    A position covers three words, less what the next marked position covers itself.
    """
    top = lambda x: F.call_function("shiftrightunsigned", x, bits)
    three, starts = F.lit(3).cast("long"), F.sequence(F.lit(0), n - 3)

    def hashed(w: Column) -> Column:
        return F.transform(starts, lambda i: F.call_function("shiftleft", hash_of(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long")))

    def marked(s: Column, w: Column) -> Column:
        place = lambda x: (x - F.call_function("shiftleft", top(x), bits)).cast("int")
        same = lambda x, y: reduce(lambda a, b: a & b, [F.get(w, place(x) + j) == F.get(w, place(y) + j) for j in range(3)])
        alike = lambda x, y: (top(x) == top(y)) & same(x, y)

        def mark(x: Column, i: Column) -> Column:
            before, after = F.get(s, i - 1), F.get(s, i + 1)
            return F.when((top(x) == top(before)) & ~same(x, before), CLASH).when(alike(x, before) | alike(x, after), place(x).cast("long"))

        return F.filter(F.transform(s, mark), lambda p: p.isNotNull())

    def by_words(w: Column) -> Column:
        windows = F.sort_array(F.transform(starts, lambda i: F.struct(F.struct(*[F.get(w, i + j).alias(f"w{j}") for j in range(3)]).alias("w"), i.cast("long").alias("at"))))
        twice = lambda s: F.transform(s, lambda x, i: F.when((x["w"] == F.get(s, i - 1)["w"]) | (x["w"] == F.get(s, i + 1)["w"]), x["at"]))
        return let(windows, lambda s: F.sort_array(F.filter(twice(s), lambda p: p.isNotNull())))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(three, F.coalesce(F.get(p, i + 1) - x, three))), F.lit(0).cast("long"), lambda a, x: a + x)

    def places(w: Column) -> Column:
        found = let(F.sort_array(hashed(w)), lambda s: F.sort_array(marked(s, w)))
        return let(found, lambda p: F.when(F.get(p, F.lit(0)) == CLASH, by_words(w)).otherwise(p))

    return F.when(n < 3, F.lit(0).cast("long")).otherwise(let(words, lambda w: let(places(w), covered)))


def quality(docs: DataFrame, rules: list[Rule] = RULES, stop_words: list[str] = STOP_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, one boolean for each rule, base_failed and kept, for every row; one projection without shuffle or user functions.

    Null and empty texts have no words, fail the base and are not kept. A ratio over nothing passes. Null ids stay null,
    repeated rows stay repeated, other columns are left out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, SPACE, "") != "")
    solid = F.regexp_replace(text, SPACE, "")
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), words.alias("words"), lines.alias("lines"), solid.alias("solid"))
    base = base.withColumn("bits", F.ceil(F.log2(F.size("words") + 1)).cast("int"))
    n = F.size("words")
    table = F.array(*[F.lit(w) for w in stop_words])
    counts = base.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length("solid").cast("long").alias("word_chars"),
        (F.length("solid") - F.length(F.translate("solid", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(F.col("lines"), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words"), n, F.col("bits")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_text_lines"),
        F.size(F.filter("words", lambda w: F.array_contains(table, F.lower(w)))).cast("long").alias("n_stop_words"),
        (F.length("solid") - F.length(F.translate("solid", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_capitals"),
    )
    verdicts = [((F.lit(True) if r.low is None else F.col(r.numerator) * r.scale >= F.col(r.denominator) * r.low) & (F.lit(True) if r.high is None else F.col(r.numerator) * r.scale <= F.col(r.denominator) * r.high)).alias(r.name) for r in rules]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = counts.select("*", *verdicts, failed.alias("base_failed"))
    return judged.withColumn("kept", ~F.col("base_failed") & reduce(lambda a, b: a & b, [F.col(r.name) for r in rules], F.lit(True)))


def quality_sql(rules: list[Rule] = RULES, stop_words: list[str] = STOP_WORDS) -> str:
    """The same over the table documents in DuckDB's SQL."""
    verdicts = [" AND ".join(([f"{r.numerator} * {r.scale} >= {r.denominator} * {r.low}"] if r.low is not None else []) + ([f"{r.numerator} * {r.scale} <= {r.denominator} * {r.high}"] if r.high is not None else [])) for r in rules]
    listed = ", ".join(f"'{w}'" for w in stop_words)
    return rf"""
WITH base AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
grams AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM (
    SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM base))),
covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE n > 1) GROUP BY r),
counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_text_lines,
    len(list_filter(w, lambda x: lower(x) IN ({listed})))::BIGINT AS n_stop_words,
    len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_capitals
  FROM base LEFT JOIN covered USING (r)),
judged AS (
  SELECT *, {", ".join(f"({v}) AS {r.name}" for v, r in zip(verdicts, rules, strict=True))},
    (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM counts)
SELECT *, (NOT base_failed AND {" AND ".join(r.name for r in rules)}) AS kept FROM judged"""
