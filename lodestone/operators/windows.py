"""Windows of evidence: the lines of a table, the lines around a formula or the sentences that answer a question best.

Lines and sentences are rows while they are scored; only their lengths and scores are shuffled, by the text's id, and
the text is joined once to the window chosen. A window is a span of the original text. Null and empty texts have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import search_terms, technical_literals
from .documents import overlap

#: Ends of lines and of sentences, as cuts of no width.
LINE_END = r"(?<=\n)|(?<=\r)(?!\n)|(?<=[\x0b\x0c\x1c-\x1e\x85\u2028\u2029])"
SENTENCE_END = r"(?U)(?<=[.!?])(?=\s)"
#: A table's separator, signs of a formula, what a kind's score gains.
SEPARATOR = r"(?U)^\s*\|?[\s:|-]+\|?\s*$"
FORMULA = "[=≤≥≈∑√α-ωΑ-Ω]"
TABLE_GAIN, FORMULA_GAIN, LITERAL_GAIN = 0.25, 0.2, 0.25


def support(piece: Column, wanted: Column, literals: Column) -> Column:
    """Share of wanted terms in a piece, and a quarter for each wanted literal in it; 0 where nothing is wanted."""
    lexical = overlap(search_terms(piece), wanted)
    return F.when(F.size(wanted) > 0, lexical + LITERAL_GAIN * F.size(F.array_intersect(technical_literals(piece), literals))).otherwise(0.0)


def pieces(texts: DataFrame, cut: str) -> DataFrame:
    """(id, at, start, stop, piece, wanted, literals) of texts (id, text, wanted) cut where `cut` matches."""
    each = texts.select("id", "wanted", technical_literals(F.array_join("wanted", " ")).alias("literals"), F.posexplode(F.split("text", cut)).alias("at", "piece"))
    return each.where("piece <> ''")


def placed(rows: DataFrame) -> DataFrame:
    """Rows with start and stop from their size, summed over those before in the same text."""
    upto = Window.partitionBy("id").orderBy("at")
    return rows.withColumn("stop", F.sum("size").over(upto)).withColumn("start", F.col("stop") - F.col("size"))


def scored_lines(texts: DataFrame) -> DataFrame:
    line = F.col("piece")
    piped = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) >= 2
    formula = line.rlike(FORMULA)
    rows = pieces(texts, LINE_END).withColumn("score", support(line, F.col("wanted"), F.col("literals")))
    n_literals = F.size(technical_literals(line))
    return placed(rows.select("id", "at", F.length(line).alias("size"), line.rlike(r"(?U)\S").alias("filled"), piped.alias("piped"), line.rlike(SEPARATOR).alias("rule"), formula.alias("formula"), "score", n_literals.alias("n_literals")))


def table_windows(lines: DataFrame, most: int) -> DataFrame:
    """(id, start, stop, score): of the tables of a text (two lines or more with two bars each) the one whose best row
    scores most, the first of equals; from its first line, and its caption, to that row (the last of equals), less the
    first lines that `most` characters have no room for."""
    by_at = Window.partitionBy("id").orderBy("at")
    before = F.lag(F.when(F.col("filled"), F.col("start"))).over(by_at)
    rows = lines.withColumn("caption", before).withColumn("run", F.sum(F.when(F.col("piped"), 0).otherwise(1)).over(by_at)).where("piped")
    run = Window.partitionBy("id", "run")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(run)).withColumn("ruled", F.min(F.when(F.col("rule"), F.col("at"))).over(run)).withColumn("last", F.max("at").over(run)).withColumn("first", F.min("at").over(run))
    data = ~F.col("rule") & (F.col("ruled").isNull() | (F.col("at") > F.col("ruled")) | (F.col("ruled") == F.col("last")))
    rows = rows.where("n >= 2").withColumn("best", F.max(F.when(data, F.struct("score", "at", "stop"))).over(run)).where("best IS NOT NULL AND at <= best.at")
    fits = (F.col("best.stop") - F.col("start") <= most) | (F.col("at") == F.col("best.at"))
    caption = (F.col("at") == F.col("first")) & (F.col("best.stop") - F.col("caption") <= most)
    spans = rows.where(fits).groupBy("id", "run").agg(F.min(F.when(caption, F.col("caption")).otherwise(F.col("start"))).alias("start"), F.first("best").alias("best"))
    chosen = spans.groupBy("id").agg(F.max(F.struct(F.col("best.score").alias("score"), (-F.col("run")).alias("r"), "start", F.col("best.stop").alias("stop"))).alias("w"))
    return chosen.select("id", "w.start", "w.stop", (F.col("w.score") + TABLE_GAIN).alias("score"))


def around(rows: DataFrame, reach: int, best: Column, most: int, left_first) -> DataFrame:
    """(id, start, stop, score): the best row with up to `reach` neighbours on each side, one less at a time while they
    exceed `most` characters; left_first(a, b): whether the left side with a neighbours loses one before the right side
    with b."""
    by_at = Window.partitionBy("id").orderBy("at")
    near = by_at.rowsBetween(-reach, reach)
    rows = rows.withColumn("near", F.collect_list(F.struct("at", "start", "stop")).over(near))
    top = rows.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.col("score").desc(), *([best] if best is not None else []), "at"))).where("place = 1")
    left = F.size(F.filter("near", lambda x: x["at"] < F.col("at")))
    top = top.withColumn("a", left).withColumn("b", F.size("near") - left - 1).withColumn("pivot", F.col("a"))
    span = lambda s: F.get("near", F.col("pivot") + s["b"])["stop"] - F.get("near", F.col("pivot") - s["a"])["start"]

    def step(s: Column, _: Column) -> Column:
        done = (span(s) <= most) | ((s["a"] == 0) & (s["b"] == 0))
        left = (s["a"] > 0) & (left_first(s["a"], s["b"]) | (s["b"] == 0))
        return F.struct(F.when(~done & left, s["a"] - 1).otherwise(s["a"]).alias("a"), F.when(~done & ~left, s["b"] - 1).otherwise(s["b"]).alias("b"))

    top = top.withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(2 * reach)), F.struct("a", "b"), step))
    return top.select("id", F.get("near", F.col("pivot") - F.col("s.a"))["start"].alias("start"), F.get("near", F.col("pivot") + F.col("s.b"))["stop"].alias("stop"), "score")


def formula_windows(lines: DataFrame, most: int) -> DataFrame:
    """(id, start, stop, score): the line with a formula's sign that scores most, then has most literals, then comes
    first, with two lines on each side as far as `most` characters have room."""
    rows = lines.withColumn("raw", F.col("score")).withColumn("score", F.when(F.col("formula"), F.col("raw")).otherwise(-1.0))
    return around(rows, 2, F.col("n_literals").desc(), most, lambda a, b: a >= b).where("score >= 0").withColumn("score", F.col("score") + FORMULA_GAIN)


def prose_windows(texts: DataFrame, most: int) -> DataFrame:
    """(id, start, stop, score): the sentence that scores most, the first of equals, with one on each side as far as
    `most` characters have room. A text of white space alone is one sentence."""
    piece = F.col("piece")
    rows = pieces(texts, SENTENCE_END).withColumn("score", support(piece, F.col("wanted"), F.col("literals")))
    head = F.length(piece) - F.length(F.regexp_replace(piece, r"(?U)^\s+", ""))
    tail = F.length(piece) - F.length(F.regexp_replace(piece, r"(?U)\s+$", ""))
    rows = placed(rows.select("id", "at", F.length(piece).alias("size"), head.alias("head"), tail.alias("tail"), piece.rlike(r"(?U)\S").alias("filled"), "score"))
    inner = rows.where("filled").select("id", "at", (F.col("start") + F.col("head")).alias("start"), (F.col("stop") - F.col("tail")).alias("stop"), "score")
    return around(inner, 1, None, most, lambda a, b: a > b)


def trimmed(df: DataFrame, most: int) -> DataFrame:
    """df with columns text, start, stop, wanted: start and stop without outer white space and at most `most`
    characters apart, a third of them before the first wanted term in the span, cut at a space where one is near."""
    part = F.substring("text", F.col("start") + 1, F.col("stop") - F.col("start"))
    head = F.length(part) - F.length(F.regexp_replace(part, r"(?U)^\s+", ""))
    tail = F.length(part) - F.length(F.regexp_replace(part, r"(?U)\s+$", ""))
    bare = lambda d: d.withColumn("h", head).withColumn("t", tail).withColumn("start", F.least(F.col("start") + F.col("h"), F.col("stop"))).withColumn("stop", F.greatest(F.col("stop") - F.col("t"), F.col("start"))).drop("h", "t")
    d = bare(df)
    whole = F.col("stop") - F.col("start") <= most
    found = F.filter(F.transform("wanted", lambda w: F.regexp_instr(part, F.concat(F.lit(r"(?iU)(?<!\w)\Q"), w, F.lit(r"\E(?!\w)")))), lambda x: x > 0)
    d = d.withColumn("focus", F.when(~whole, F.col("start") + F.coalesce(F.array_min(found) - 1, F.lit(0))))
    d = d.withColumn("lo", F.greatest("start", F.col("focus") - most // 3)).withColumn("hi", F.least("stop", F.col("lo") + most)).withColumn("lo", F.greatest("start", F.col("hi") - most))
    ahead = F.instr(F.substring("text", F.col("lo") + 1, F.least(F.lit(40), F.col("hi") - F.col("lo"))), " ")
    d = d.withColumn("lo", F.when((F.col("lo") > F.col("start")) & (ahead > 0), F.col("lo") + ahead).otherwise(F.col("lo")))
    begin = F.greatest(F.col("lo"), F.col("hi") - 40)
    back = F.instr(F.reverse(F.substring("text", begin + 1, F.col("hi") - begin)), " ")
    d = d.withColumn("hi", F.when((F.col("hi") < F.col("stop")) & (back > 0) & (F.col("hi") - back > F.col("lo")), F.col("hi") - back).otherwise(F.col("hi")))
    return bare(d.withColumn("start", F.coalesce("lo", "start")).withColumn("stop", F.coalesce("hi", "stop"))).drop("focus", "lo", "hi")


def evidence_windows(texts: DataFrame, most: int = 640) -> DataFrame:
    """(id, kind, start, stop, score) of texts (id, text, wanted[, kind]): the window that scores most, prose before
    table before formula among equals; where kind says table or formula and the text has one, that one."""
    if "kind" not in texts.columns:
        texts = texts.withColumn("kind", F.lit(None).cast("string"))
    lines = scored_lines(texts)
    found = [prose_windows(texts, most).withColumn("order", F.lit(0)), table_windows(lines, most).withColumn("order", F.lit(1)), formula_windows(lines, most).withColumn("order", F.lit(2))]
    kinds = F.array(F.lit("prose"), F.lit("table"), F.lit("formula"))
    every = found[0].unionByName(found[1]).unionByName(found[2]).withColumn("found", F.get(kinds, F.col("order")))
    asked = every.join(texts.select("id", "kind"), "id").withColumn("asked", F.col("kind").isin("table", "formula") & (F.col("kind") == F.col("found")))
    best = asked.groupBy("id").agg(F.max(F.struct(F.coalesce("asked", F.lit(False)).alias("asked"), "score", (-F.col("order")).alias("o"), "start", "stop", "found")).alias("w"))
    spans = best.select("id", F.col("w.found").alias("found"), F.col("w.start").alias("start"), F.col("w.stop").alias("stop"), F.col("w.score").alias("score"))
    return trimmed(spans.join(texts.select("id", "text", "wanted"), "id"), most).select("id", F.col("found").alias("kind"), "start", "stop", "score")
