"""Outlines of books out of bookmarks, printed contents and headings. Books are runs of a hundred parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reconcile
from ..sources.tables import table
from .registry import query


def signals(spark, sf_dir):
    """(books, bookmarks, contents, headings): each part is a section; a third have bookmarks, half stand in the contents,
    whose labels begin eight pages late; every seventh has no heading, every fifth a second one on the next page."""
    p = table(spark, sf_dir, "part")
    key, place = F.col("p_partkey"), (F.col("p_partkey") % 100).cast("int")
    title = F.concat_ws(" ", F.initcap("p_name"), F.lower("p_type"), F.col("p_size").cast("string"))
    number = F.concat((F.floor(place / 9) + 1).cast("string"), F.when(place % 9 > 0, F.concat(F.lit("."), (place % 9).cast("string"))).otherwise(""), F.lit(" "))
    depth = F.when(place % 9 == 0, 0).otherwise(1)
    s = p.where(key >= 0).select(F.floor(key / 100).cast("int").alias("book"), key.alias("at"), place.alias("place"), title.alias("title"), number.alias("number"), depth.alias("depth"), (place * 2 + 9).cast("int").alias("page"), key.cast("string").alias("ref"))
    books = s.select("book", F.lit(220).alias("total_pages")).distinct()
    bookmarks = s.where("place % 3 = 0 AND book % 4 <> 1").select("book", "at", "title", "depth", "page", F.concat(F.lit("b"), "ref").alias("ref"))
    contents = s.where("place % 2 = 0 AND book % 4 <> 2").select("book", "at", F.concat("number", F.upper("title")).alias("title"), "depth", F.when(F.col("place") % 10 != 4, F.col("page") - 8).alias("page"), F.concat(F.lit("c"), "ref").alias("ref"))
    h = s.where("place % 7 <> 6 AND book % 4 <> 3").select("book", "at", F.concat("number", "title").alias("title"), "page", F.when(F.col("place") % 4 > 0, F.col("depth") + 1).alias("level"), F.lit(0.65).alias("confidence"), F.concat(F.lit("h"), "ref").alias("ref"))
    again = s.where("place % 5 = 1").select("book", "at", "title", (F.col("page") + 1).alias("page"), F.lit(None).cast("int").alias("level"), F.lit(0.5).alias("confidence"), F.lit(None).cast("string").alias("ref"))
    return books, bookmarks, contents, h.unionByName(again)


@query()
def reconciled_outlines(spark, sf_dir):
    """Nodes of all books' outlines; an alignment and three walks, so held against a plain version in the tests."""
    nodes = reconcile.reconciled(*signals(spark, sf_dir))
    return nodes.withColumn("refs", F.array_join("refs", ",")).withColumn("confidence", F.round("confidence", 9))


@query("""WITH RECURSIVE n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER - 1 AS i, (length(text) % 5)::INTEGER AS depth, (turn // 2 * 3 + 1)::INTEGER AS page FROM conversations),
w AS (SELECT conv_id, i, page, 0 AS level FROM n WHERE i = 0
  UNION ALL SELECT n.conv_id, n.i, n.page, least(n.depth, w.level + 1) FROM w JOIN n ON n.conv_id = w.conv_id AND n.i = w.i + 1)
SELECT conv_id, i AS ordinal, level, coalesce((SELECT max(b.i) FROM w b WHERE b.conv_id = a.conv_id AND b.i < a.i AND b.level = a.level - 1), -1)::INTEGER AS parent,
  greatest(page, coalesce((SELECT min(b.page) FROM w b WHERE b.conv_id = a.conv_id AND b.page > a.page AND b.level <= a.level) - 1, 400))::INTEGER AS page_end FROM w a""")
def outline_levels(spark, sf_dir):
    """Depths that jump brought to steps of one, parents and page ends; turns two by two share a page."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), "turn", (F.length("text") % 5).cast("int").alias("depth"), (F.floor(F.col("turn") / 2) * 3 + 1).cast("int").alias("page"))
    n = reconcile.numbered(c, "ordinal", "turn").withColumn("ordinal", F.col("ordinal") - 1)
    o = reconcile.levels(n, "book", "ordinal", "depth", "page", F.lit(400))
    return o.select(F.col("book").alias("conv_id"), "ordinal", "level", F.coalesce("parent", F.lit(-1)).alias("parent"), "page_end")


@query("""SELECT book::INTEGER AS book, CASE WHEN book % 4 = 1 THEN 'printed-toc' WHEN book % 4 = 2 THEN 'bookmarks' ELSE 'reconciled' END AS mode FROM (SELECT DISTINCT p_partkey // 100 AS book FROM part)""")
def outline_modes(spark, sf_dir):
    """What each book's outline rests on."""
    books, bookmarks, contents, headings = signals(spark, sf_dir)
    return reconcile.summary(reconcile.reconciled(books, bookmarks, contents, headings), bookmarks, contents).select("book", "mode")
