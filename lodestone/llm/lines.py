"""Removal of repeated runs of lines by winnowing over line hashes (operator 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged
from .quality import SPACE, let

#: A run repeats from so many lines on; a single line repeats if it has LONG_WORDS words or more.
RUN_LINES, LONG_WORDS = 3, 50
NO_ID = 2**63 - 1


def selected(docs: DataFrame, run_lines: int, long_words: int, by_words: bool) -> DataFrame:
    """(key, sub, at, fp, windows): the lines that winnowing selects, with the windows that select them.

    A window is run_lines neighbouring lines, or one line of long_words words; by_words: also fewer lines that have
    long_words words together. It selects its least line hash, the leftmost of equals, so equal windows select equal
    fingerprints at the same line of theirs. windows: first and last line number and 128 bits of the content. Blank lines
    aren't counted; at counts the others from 0.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("no"), F.trim(x).alias("t"))), lambda x: x["t"] != "")
    hashed = F.transform(lines, lambda x: F.struct(x["no"].alias("no"), F.xxhash64(x["t"]).alias("h"), F.xxhash64(F.lit(1), x["t"]).alias("g"), F.size(F.split(x["t"], SPACE)).alias("n")))
    spans = [1, *(range(2, run_lines) if by_words else []), run_lines]

    def window(h: Column, i: Column, n: int) -> Column:
        """The window of n lines from line i; null where there is none."""
        some = [F.get(h, i + j) for j in range(n)]
        words = sum((x["n"] for x in some[1:]), some[0]["n"])
        whole = some[-1].isNotNull() & (F.lit(True) if n == run_lines else words >= long_words)
        least = F.array_min(F.array(*[F.struct(x["h"].alias("fp"), (i + j).alias("at")) for j, x in enumerate(some)]))
        content = F.struct(
            some[0]["no"].alias("first"), some[-1]["no"].alias("last"), least["at"].alias("at"),
            F.xxhash64(F.lit(n), *[x["h"] for x in some]).alias("w1"), F.xxhash64(*[x["g"] for x in some], F.lit(n)).alias("w2"))
        return F.when(whole, content)

    def around(w: Column, i: Column) -> Column:
        """The windows that select line i, all of which begin at most run_lines - 1 lines before it."""
        near = [F.get(w, i - j)[f"s{n}"] for n in spans for j in range(n)]
        return F.filter(F.array(*near), lambda x: x["at"] == i)

    def lines_of(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - 1)
        every = F.transform(places, lambda i: F.struct(*[window(h, i, n).alias(f"s{n}") for n in spans]))
        return let(every, lambda w: F.transform(places, lambda i: F.struct(i.alias("at"), F.get(h, i)["h"].alias("fp"), around(w, i).alias("windows"))))

    found = docs.select("key", "sub", F.explode(let(hashed, lambda h: F.when(F.size(h) > 0, F.filter(lines_of(h), lambda x: F.size(x["windows"]) > 0)))).alias("x"))
    return found.select("key", "sub", "x.at", "x.fp", "x.windows")


def repeated_runs(docs: DataFrame, run_lines: int, long_words: int, by_words: bool) -> DataFrame:
    """(key, sub, runs): maximal runs of lines whose windows occur earlier, by key and line, in this or another document.

    Lines selected meet by fingerprint, and those whose fingerprint stands in one place only are out with all windows
    around them: no window there can occur twice. Of the others each window is joined to the first place of its content,
    and windows of a document that touch are joined to runs, which extends a match as far as it goes both ways.
    """
    marks = staged(selected(docs, run_lines, long_words, by_words), "line-marks")
    place = F.struct("key", "sub", "at")
    shared = marks.groupBy("fp").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("fp")
    near = marks.join(shared, "fp", "left_semi").select("key", "sub", F.explode("windows").alias("w")).select("key", "sub", "w.first", "w.last", "w.w1", "w.w2")
    near = staged(near, "line-windows")
    begin = F.struct("key", "sub", "first")
    origin = near.groupBy("w1", "w2").agg(F.min(begin).alias("origin"), F.max(begin).alias("latest")).where("origin <> latest").select("w1", "w2", "origin")
    again = near.join(origin, ["w1", "w2"]).where(begin > F.col("origin")).select("key", "sub", "first", "last").distinct()
    in_order = Window.partitionBy("key", "sub").orderBy("first", "last")
    before = F.max("last").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opened = again.withColumn("opens", F.coalesce((F.col("first") > before + 1).cast("int"), F.lit(1))).withColumn("run", F.sum("opens").over(in_order))
    runs = opened.groupBy("key", "sub", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("key", "sub").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def without(lines: Column, runs: Column) -> Column:
    """(text, n_removed): what is left of lines without runs, but for the runs' blank lines. Each line is looked at once."""
    blank = lambda x: F.trim(x) == ""
    inside = lambda r: F.slice(lines, r["first"] + 1, r["last"] - r["first"] + 1)
    begin = lambda j: F.coalesce(F.get(runs, j - 1)["last"], F.lit(-1)) + 1
    kept = F.transform(runs, lambda r, j: F.concat(F.slice(lines, begin(j) + 1, r["first"] - begin(j)), F.filter(inside(r), blank)))
    rest = F.slice(lines, F.element_at(runs, -1)["last"] + 2, F.size(lines))
    left = let(F.flatten(F.concat(kept, F.array(rest))), lambda k: F.when(F.exists(k, lambda x: ~blank(x)), F.array_join(k, "\n")).otherwise(F.lit("")))
    n = F.aggregate(runs, F.lit(0), lambda a, r: a + F.size(F.filter(inside(r), lambda x: ~blank(x))))
    return F.struct(left.alias("text"), n.alias("n_removed"))


def remove_repeated_runs(docs: DataFrame, run_lines: int = RUN_LINES, long_words: int = LONG_WORDS, by_words: bool = False) -> DataFrame:
    """docs with `text` freed from later repeats, and the columns n_lines, n_removed, n_runs after its own.

    A run of run_lines lines (or one line of long_words words) goes wherever it occurred before, in a document of smaller
    doc_id or further up in its own; overlapping windows extend a match both ways to its full length. With by_words any
    run of whole lines goes that has run_lines lines or long_words words. Lines are compared
    without outer spaces, blank lines neither count nor go, unless nothing else is left: then the text is empty. Null
    texts stay null with 0 lines. Rows without an id come last in order; rows with equal id and text are one document
    and change alike. An empty table stays empty. Counts are named n_lines, n_removed, n_runs, or with leading
    underscores where docs has such columns itself.
    """
    names = []
    for stem in ("n_lines", "n_removed", "n_runs"):
        while stem.lower() in {c.lower() for c in docs.columns}:
            stem = f"_{stem}"
        names.append(stem)
    body = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("sub"), body)
    slim = keyed.select("key", "sub", F.col("row.text").alias("text")).where("text IS NOT NULL")
    joined = keyed.join(repeated_runs(slim, run_lines, long_words, by_words), ["key", "sub"], "left")
    text = F.col("row.text")
    n_lines = F.coalesce(F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")), F.lit(0))
    made = F.when(F.col("runs").isNotNull(), let(F.split(text, "\n"), lambda lines: without(lines, F.col("runs"))))
    done = joined.select("row", "runs", n_lines.alias("n_lines"), made.alias("made"))
    cells = [F.when(F.col("runs").isNull(), text).otherwise(F.col("made.text")).alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return done.select(
        *cells,
        F.col("n_lines").cast("long").alias(names[0]),
        F.coalesce("made.n_removed", F.lit(0)).cast("long").alias(names[1]),
        F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias(names[2]))


def lines_sql(run_lines: int = RUN_LINES, long_words: int = LONG_WORDS) -> str:
    """Digest of the same result over the table documents in DuckDB's SQL, by the windows' contents themselves."""
    content = ", ".join(f"lead(t, {j}) OVER d" for j in range(run_lines))
    return rf"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents),
l AS (SELECT doc_id, no, x, trim(x) AS t FROM raw),
w AS (
  SELECT doc_id, no AS first, lead(no, {run_lines - 1}) OVER d AS last, [{content}] AS c FROM l WHERE t <> ''
  WINDOW d AS (PARTITION BY doc_id ORDER BY no)
  UNION ALL
  SELECT doc_id, no, no, [t] FROM l WHERE t <> '' AND len(regexp_split_to_array(t, '[ 	-
]+')) >= {long_words}),
again AS (
  SELECT * FROM (SELECT doc_id, first, last, row_number() OVER (PARTITION BY c ORDER BY doc_id, first) AS r FROM w WHERE last IS NOT NULL) WHERE r > 1),
gone AS (SELECT DISTINCT l.doc_id, l.no FROM l JOIN again a ON l.doc_id = a.doc_id AND l.no BETWEEN a.first AND a.last),
marked AS (SELECT l.*, g.no IS NOT NULL AS g FROM l LEFT JOIN gone g USING (doc_id, no)),
runs AS (SELECT *, g AND NOT coalesce(lag(g) OVER (PARTITION BY doc_id ORDER BY no), false) AS begins FROM marked),
docs AS (
  SELECT doc_id, count(*) FILTER (t <> '') AS n_lines, count(*) FILTER (g AND t <> '') AS n_removed, count(*) FILTER (begins) AS n_runs,
    CASE WHEN count(*) FILTER (g) = 0 THEN string_agg(x, chr(10) ORDER BY no)
      WHEN count(*) FILTER (NOT g AND t <> '') = 0 THEN '' ELSE string_agg(x, chr(10) ORDER BY no) FILTER (NOT g OR t = '') END AS kept
  FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN docs USING (doc_id)"""
