"""One outline of a book out of its bookmarks, its printed contents and the headings of its pages.

Titles meet by joins on some of their words and on nearby pages, never all with all; what hangs on an order (which title
goes with which, who repeats whom) is a fold or a graph of those pairs alone; depths and ends are running windows.
Staged files of few megabytes hold many rows, so all joins are told to merge: a broadcast would pass them through the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from ..sources.tables import staged
from .booklines import NUMBERING
from .duplicates import first_independent
from .structure import aligned, page_ranges

#: Similarity at which a contents line is a heading's, at which titles are one, at which an anchor takes a heading; pages
#: within which titles are one, as anchors and as headings; pages that still count for a pair (fixed values).
IS_HEADING, SAME, PAIR, ANCHOR_PAGES, HEADING_PAGES, PAIR_PAGES = 0.82, 0.9, 0.68, 2, 1, 5
#: Trust in the kinds of sources; the deepest level; pages of a window without structure, native and scanned (fixed values).
BOOKMARK, CONTENTS, NUMBERED, WINDOW, DEEPEST, NATIVE_PAGES, SCANNED_PAGES = 0.98, 0.92, 0.85, 0.45, 6, 8, 4
NODE = ["book", "node_id", "parent_id", "depth", "ordinal", "title", "page_start", "page_end", "source_kind", "confidence", "refs"]


def title_text(s: Column) -> Column:
    """Letters a-z and digits of the folded title without marks; only other than plain letters go through Python."""
    bare = F.coalesce(t.without_marks(F.when(s.rlike(r"[^\x00-\x7f]"), s)), s)
    return F.trim(F.regexp_replace(t.folded(bare), "[^a-z0-9]+", " "))


def words(title: Column) -> Column:
    """Distinct words of a title behind its number, in one order for all titles: long ones first, which are rarer."""
    plain = F.filter(F.split(title_text(F.regexp_replace(F.trim(title), "(?i)" + NUMBERING.pattern, "")), " "), lambda w: w != "")
    return F.transform(F.sort_array(F.transform(F.array_distinct(plain), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])


def number_depth(title: Column) -> Column:
    """Dots in the number that a title begins with, 0 for a Roman one, null without a number."""
    number = F.regexp_extract(title, "(?i)" + NUMBERING.pattern, 1)
    return F.when(number.rlike("^[0-9]"), F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))).when(number != "", 0)


def of_equal_words(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """All pairs of a book whose words have a Dice similarity of `least` or more, as (book, l, r, similarity).

    So similar titles share least / (2 - least) of either's words, hence one among the first few in a common order: only
    those few are joined. left and right: (book, l or r, words).
    """

    def keyed(df: DataFrame, id_col: str) -> DataFrame:
        n = F.size("words")
        first = n - F.ceil(n * (least / (2 - least)) - 1e-9).cast("int") + 1
        return df.where(n > 0).select("book", id_col, F.col("words").alias(f"{id_col}_words"), F.explode(F.slice("words", F.lit(1), first)).alias("word"))

    pairs = keyed(left, "l").join(keyed(right, "r").hint("merge"), ["book", "word"]).withColumn("similarity", t.dice(F.col("l_words"), F.col("r_words")))
    return pairs.where(F.col("similarity") >= least).select("book", "l", "r", "similarity").distinct()


def in_turn(pairs: DataFrame) -> DataFrame:
    """(book, l, r, similarity): each l in its order takes the most similar r behind the one taken before, the first of
    equals. One walk over a book's similar pairs."""

    def run(key, pdf):
        import pandas as pd

        last, taken, rows = 0, None, []
        for row in pdf.sort_values(["l", "similarity", "r"], ascending=[True, False, True]).itertuples(index=False):
            if row.l != taken and row.r > last:
                last, taken = row.r, row.l
                rows.append(row)
        return pd.DataFrame(rows, columns=pdf.columns)

    return pairs.groupBy("book").applyInPandas(run, pairs.schema)


def first_titles(nodes: DataFrame, pages: int) -> DataFrame:
    """nodes without those that repeat an earlier kept one: the same title (SAME) at most `pages` away.

    nodes: (book, n, page, words, fixed, ...); n is the order in a book. A fixed one always stays.
    """
    side = lambda c: nodes.select("book", F.struct("n", "page", "fixed").alias(c), "words")
    near = of_equal_words(side("l"), side("r").where("NOT r.fixed"), SAME).where((F.col("l.n") < F.col("r.n")) & (F.abs(F.col("l.page") - F.col("r.page")) <= pages))
    key = lambda n: F.struct("book", F.col(n).alias("n"))
    edges = staged(near.select(key("l.n").alias("a"), key("r.n").alias("b")), "repeats")
    kept = first_independent(nodes.select(key("n").alias("id")), edges)
    return nodes.join(kept.select("id.book", "id.n").hint("merge"), ["book", "n"])


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy("book").orderBy(*order)))


def pairs_of(anchors: DataFrame, headings: DataFrame) -> DataFrame:
    """(book, a, h, score) of the anchors and headings that may be one. Away from PAIR_PAGES only nearly equal titles reach
    PAIR; within it, pages meet by cells."""
    wide = PAIR_PAGES + 1
    a = anchors.select("book", "a", F.col("page").alias("a_page"), F.col("depth").alias("a_depth"), F.col("words").alias("a_words"))
    h = headings.select("book", "h", F.col("page").alias("h_page"), "level", number_depth(F.col("title")).alias("number"), F.col("words").alias("h_words"))
    close = a.withColumn("cell", F.floor(F.col("a_page") / wide)).join(h.withColumn("cell", F.explode(F.array(*[F.floor(F.col("h_page") / wide) + i for i in (-1, 0, 1)]))).hint("merge"), ["book", "cell"]).drop("cell")
    far = of_equal_words(anchors.select("book", F.col("a").alias("l"), "words"), headings.select("book", F.col("h").alias("r"), "words"), (PAIR - 0.20) / 0.55 - 1e-9)
    far = far.select("book", F.col("l").alias("a"), F.col("r").alias("h")).join(a.hint("merge"), ["book", "a"]).join(h.hint("merge"), ["book", "h"])
    apart = F.abs(F.col("a_page") - F.col("h_page"))
    both = close.where(apart <= PAIR_PAGES).unionByName(far.where(apart > PAIR_PAGES))
    page = F.when(apart == 0, 1.0).when(apart <= 2, 0.8).when(apart <= PAIR_PAGES, 0.4).otherwise(0.0)
    number = F.when(F.col("number").isNull() | (F.col("number") == F.col("a_depth")), 1.0).otherwise(0.4)
    level = F.when(F.col("level").isNull() | (F.greatest(F.lit(0), F.col("level") - 1) == F.col("a_depth")), 1.0).otherwise(0.5)
    score = F.lit(0.55) * t.dice(F.col("a_words"), F.col("h_words")) + F.lit(0.25) * page + F.lit(0.10) * number + F.lit(0.10) * level
    return both.select("book", "a", "h", score.alias("score")).where(F.col("score") >= PAIR)


def levels(nodes: DataFrame, book: str, ordinal: str, depth: str, page: str, total: Column) -> DataFrame:
    """Adds level, parent (an ordinal) and page_end to nodes numbered from 0 in the order of their pages.

    A node lies one level at most below the one before it, the first on level 0: a running minimum of depth less place
    says how deep that lets it be. The parent is the last node before of the level above; a node ends before the next
    one of its level or above that begins on a later page.
    """
    place = Window.partitionBy(book).orderBy(ordinal)
    till = place.rowsBetween(Window.unboundedPreceding, 0)
    deep = nodes.withColumn("level", (F.col(ordinal) + F.least(F.lit(0), F.min(F.col(depth) - F.col(ordinal)).over(till))).cast("int"))
    before = place.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(book).orderBy(page).rangeBetween(1, Window.unboundedFollowing)
    parent, end = F.lit(None).cast("int"), F.lit(None).cast("int")
    for d in range(DEEPEST + 1):
        own = F.col("level") == d
        parent = F.when(own, F.max(F.when(F.col("level") == d - 1, F.col(ordinal))).over(before)).otherwise(parent) if d else parent
        end = F.when(own, F.min(F.when(F.col("level") <= d, F.col(page))).over(later)).otherwise(end)
    return deep.withColumn("parent", parent).withColumn("page_end", F.greatest(F.col(page), F.coalesce(end - 1, total)))


def windows_of(books: DataFrame, scanned: DataFrame | None) -> DataFrame:
    """Nodes of books without structure: runs of pages of one kind, cut to their size."""
    pages = books.select("book", F.explode(F.sequence(F.lit(1), F.col("total_pages"))).alias("page"))
    if scanned is None:
        pages = pages.withColumn("scanned", F.lit(False))
    else:
        pages = pages.join(scanned.select("book", "page", F.lit(True).alias("scanned")).distinct().hint("merge"), ["book", "page"], "left").withColumn("scanned", F.coalesce("scanned", F.lit(False)))
    r = numbered(page_ranges(pages, "book", "page", "scanned", NATIVE_PAGES, SCANNED_PAGES), "ordinal", "core_start")
    title = F.concat(F.lit("Seiten "), F.col("core_start").cast("string"), F.lit("–"), F.col("core_end").cast("string"))
    r = r.select("book", (F.col("ordinal") - 1).alias("ordinal"), title.alias("title"), F.lit(0).alias("depth"), F.col("core_start").alias("page_start"), F.col("core_end").alias("page_end"))
    return r.select("*", F.lit(None).cast("string").alias("parent_id"), node_id().alias("node_id"), F.lit("window").alias("source_kind"), F.lit(WINDOW).alias("confidence"), F.array().cast("array<string>").alias("refs")).select(NODE)


def node_id() -> Column:
    return t.prefixed_id("sec", F.col("book").cast("string"), title_text(F.col("title")), F.col("page_start").cast("string"), F.col("depth").cast("string"))


def contents_anchors(contents: DataFrame, headings: DataFrame, books: DataFrame) -> DataFrame:
    """Contents lines with the page they lead to; lines that neither a label nor a heading resolves are left out.

    Where three labels or more differ from the pages of their headings by one offset (the median, from which the median
    deviation is 1 at most), all labels of the book are moved by it; a line of a heading's own title takes its page.
    """
    similar = of_equal_words(contents.select("book", F.col("c").alias("l"), "words"), headings.select("book", F.col("h").alias("r"), "words"), IS_HEADING)
    found = in_turn(similar).join(headings.select("book", F.col("h").alias("r"), F.col("page").alias("h_page")).hint("merge"), ["book", "r"]).select("book", F.col("l").alias("c"), "similarity", "h_page")
    lines = staged(contents.join(found.hint("merge"), ["book", "c"], "left"), "contents")
    moved = lines.where("page IS NOT NULL AND h_page IS NOT NULL").select("book", (F.col("h_page") - F.col("page")).alias("by"))
    middle = moved.groupBy("book").agg(F.bround(F.median("by")).cast("int").alias("middle"))
    offsets = moved.join(middle.hint("merge"), "book").groupBy("book", "middle").agg(F.count(F.lit(1)).alias("n"), F.median(F.abs(F.col("by") - F.col("middle"))).alias("off")).where("n >= 3 AND off <= 1").select("book", "middle")
    page = F.when(F.col("similarity") >= SAME, F.col("h_page")).otherwise(F.coalesce(F.col("page") + F.coalesce("middle", F.lit(0)), "h_page"))
    target = lines.join(offsets.hint("merge"), "book", "left").join(books.hint("merge"), "book").withColumn("page", F.least("total_pages", F.greatest(F.lit(1), page)))
    return target.where("old IS NOT NULL OR h_page IS NOT NULL")


def reconciled(books: DataFrame, bookmarks: DataFrame, contents: DataFrame, headings: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """The nodes of each book's outline (NODE).

    books: (book, total_pages); bookmarks: (book, at, title, depth, page, ref); contents: (book, at, title, depth, page or
    null, ref); headings: (book, at, title, page, level or null, confidence, ref); scanned: (book, page). `at` orders what
    shares a page, and the contents. Rows of unknown books and rows without a title, bookmarks without a page or depth
    and headings without a page are left out, other columns too; a null confidence is 0.65, a null depth of a contents
    line 0. Books without any anchor, and with no heading or fewer than three for over 20 pages, get windows.

    Of chains of equal sums that match anchors to headings the one found first stays (structure.aligned). An outline is
    bounded by its book, and so are its windows and its walk.
    """
    books = books.where("total_pages >= 1").select("book", F.col("total_pages").cast("int").alias("total_pages")).dropDuplicates(["book"])
    has = F.trim("title") != ""
    h = headings.join(books.hint("merge"), "book", "left_semi").where(has & F.col("page").isNotNull())
    h = h.select("book", "at", F.trim("title").alias("title"), F.col("page").cast("int").alias("page"), F.col("level").cast("int").alias("level"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.65)).alias("confidence"), "ref", words(F.col("title")).alias("words"))
    h = staged(numbered(h, "h", "page", "at", "title"), "headings")
    c = contents.join(books.hint("merge"), "book", "left_semi").where(has)
    c = c.select("book", F.trim("title").alias("title"), F.coalesce(F.col("depth").cast("int"), F.lit(0)).alias("depth"), F.col("page").cast("int").alias("page"), F.col("page").cast("int").alias("old"), "ref", "at", words(F.col("title")).alias("words"))
    c = staged(numbered(c, "c", "at", "title"), "lines")
    b = bookmarks.join(books.hint("merge"), "book", "left_semi").where(has & F.col("page").isNotNull() & F.col("depth").isNotNull())
    b = b.select("book", F.trim("title").alias("title"), F.col("depth").cast("int").alias("depth"), F.col("page").cast("int").alias("page"), "ref", "at", words(F.col("title")).alias("words"))
    b = numbered(b, "i", "page", "depth", "at", "title")
    lead = ["book", "title", "depth", "page", "ref", "words"]
    drawn = b.select(*lead, "i", F.lit("bookmark").alias("kind"), F.lit(BOOKMARK).alias("trust"), F.lit(True).alias("fixed"))
    drawn = drawn.unionByName(contents_anchors(c, h, books).select(*lead, F.col("c").alias("i"), F.lit("printed-toc").alias("kind"), F.lit(CONTENTS).alias("trust"), F.lit(False).alias("fixed")))
    drawn = staged(numbered(drawn, "n", F.col("fixed").desc(), "i"), "drawn")
    anchors = staged(numbered(first_titles(drawn, ANCHOR_PAGES), "a", "page", "depth", "title", "n"), "anchors")

    known = books.join(anchors.select("book").distinct().withColumn("led", F.lit(True)).hint("merge"), "book", "left").join(h.groupBy("book").agg(F.count(F.lit(1)).alias("n")).hint("merge"), "book", "left")
    n = F.coalesce("n", F.lit(0))
    bare = known.where(F.col("led").isNull() & ((n == 0) | ((F.col("total_pages") > 20) & (n < 3)))).select("book", "total_pages")
    h = h.join(bare.hint("merge"), "book", "left_anti")

    scored = staged(pairs_of(anchors, h), "pairs")
    met = aligned(scored, "book", "a", "h", "score", PAIR).join(scored.hint("merge"), ["book", "a", "h"])
    met = staged(met.join(h.select("book", "h", F.col("title").alias("h_title"), F.col("page").alias("h_page"), F.col("ref").alias("h_ref"), F.col("words").alias("h_words")).hint("merge"), ["book", "h"]), "met")
    deep = lambda d: F.least(F.lit(DEEPEST), F.greatest(F.lit(0), d))
    m = anchors.join(met.hint("merge"), ["book", "a"], "left")
    given = m.select(
        "book", F.coalesce("h_title", "title").alias("title"), F.coalesce("h_page", "page").alias("page"), deep(F.col("depth")).alias("depth"), F.when(F.col("h").isNull(), F.col("kind")).otherwise("mixed").alias("kind"),
        F.least("trust", "score").alias("confidence"), F.array_compact(F.array("ref", "h_ref")).alias("refs"), F.coalesce("h_words", "words").alias("words"), F.col("a").alias("i"), F.lit(True).alias("fixed"))
    number = number_depth(F.col("title"))
    alone = h.join(met.select("book", "h").hint("merge"), ["book", "h"], "left_anti").select(
        "book", "title", "page", deep(F.coalesce(number, F.coalesce("level", F.lit(1)) - 1)).alias("depth"), F.lit("body-heading").alias("kind"),
        F.when(number.isNotNull(), NUMBERED).otherwise(F.col("confidence")).alias("confidence"), F.array_compact(F.array("ref")).alias("refs"), "words", F.col("h").alias("i"), F.lit(False).alias("fixed"))
    all_titles = staged(numbered(given.unionByName(alone), "n", F.col("fixed").desc(), "i"), "titles")
    left = first_titles(all_titles, HEADING_PAGES).withColumn("order", F.struct("title", "n"))
    one = left.groupBy("book", "page", "depth", title_text(F.col("title")).alias("plain")).agg(
        F.min("order").alias("order"), F.max("confidence").alias("confidence"), F.when(F.min("kind") == F.max("kind"), F.min("kind")).otherwise("mixed").alias("kind"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("order", "refs"))), lambda x: x["refs"]))).alias("refs"))
    placed = numbered(one, "ordinal", "page", "depth", "order").withColumn("ordinal", F.col("ordinal") - 1).join(books.hint("merge"), "book")
    tree = levels(placed, "book", "ordinal", "depth", "page", F.col("total_pages"))
    nodes = tree.select("book", F.col("level").alias("depth"), "ordinal", "parent", F.col("order.title").alias("title"), F.col("page").alias("page_start"), "page_end", F.col("kind").alias("source_kind"), "confidence", "refs")
    nodes = staged(nodes.withColumn("node_id", node_id()), "nodes")
    above = nodes.select("book", F.col("ordinal").alias("parent"), F.col("node_id").alias("parent_id"))
    return nodes.join(above.hint("merge"), ["book", "parent"], "left").select(NODE).unionByName(windows_of(bare, scanned))


def summary(nodes: DataFrame, bookmarks: DataFrame, contents: DataFrame) -> DataFrame:
    """(book, mode, confidence, n_nodes): what an outline rests on, and the mean trust in its nodes to six places."""
    n = nodes.groupBy("book").agg(F.round(F.avg("confidence"), 6).alias("confidence"), F.count(F.lit(1)).alias("n_nodes"), F.bool_and(F.col("source_kind") == "window").alias("bare"))
    n = reduce(lambda df, x: df.join(x[0].select("book", F.lit(True).alias(x[1])).distinct().hint("merge"), "book", "left"), [(bookmarks, "marked"), (contents, "printed")], n)
    mode = F.when(F.col("bare"), "window-fallback").when(F.col("marked") & F.col("printed"), "reconciled").when(F.col("marked"), "bookmarks").when(F.col("printed"), "printed-toc").otherwise("body-headings")
    return n.select("book", mode.alias("mode"), "confidence", "n_nodes")
