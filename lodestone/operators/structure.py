"""Ordered structure: page ranges, intervals, chains, hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def page_ranges(pages: DataFrame, book: str, order: str, scanned: str, native_size: int, scanned_size: int) -> DataFrame:
    """Runs of pages alike in `scanned`, cut to bounded size; with the halo of one page on both sides, clipped.

    Columns: book, core_start, core_end, conversion_start, conversion_end, scanned; pages count from 1 in `order`.
    """
    place = Window.partitionBy(book).orderBy(order)
    p = pages.withColumn("page", F.row_number().over(place)).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy(book)))
    p = p.withColumn("new", (F.col(scanned) != F.coalesce(F.lag(scanned).over(place), ~F.col(scanned))).cast("int")).withColumn("run", F.sum("new").over(place))
    p = p.withColumn("part", F.floor((F.row_number().over(Window.partitionBy(book, "run").orderBy("page")) - 1) / F.when(F.col(scanned), scanned_size).otherwise(native_size)))
    r = p.groupBy(book, "run", "part", scanned).agg(F.min("page").alias("core_start"), F.max("page").alias("core_end"), F.max("total").alias("total"))
    return r.select(book, "core_start", "core_end", F.greatest(F.lit(1), F.col("core_start") - 1).alias("conversion_start"), F.least("total", F.col("core_end") + 1).alias("conversion_end"), scanned)


def interval_join(points: DataFrame, point: str, nodes: DataFrame, lo: str, hi: str, width: int) -> DataFrame:
    """Points in closed intervals, by an equi-join on cells of `width`: an interval is copied to the cells it touches."""
    cells = nodes.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return points.withColumn("_cell", F.floor(F.col(point) / width)).join(cells, "_cell").where((F.col(point) >= F.col(lo)) & (F.col(point) <= F.col(hi))).drop("_cell")


def deepest_holding(points: DataFrame, point: str, nodes: DataFrame, lo: str, hi: str, order: list[Column], width: int) -> DataFrame:
    """(point, best): the first interval by `order` that holds each distinct point, as a struct of `order`; points are whole
    numbers.

    An interval is cut into halved cells of `width` and less, so that each point of a piece is in the interval; of all
    intervals with one piece only the first stays. A point then asks the few pieces that hold it. So no point meets every
    interval that holds it.
    """
    best = F.struct(*[x.alias(f"o{i}") for i, x in enumerate(order)])
    # Intervals alike in their bounds and in all but the last of the order leave first, by a hash aggregate of numbers.
    alike = nodes.where(F.col(hi) >= F.col(lo)).select(F.col(lo).alias("lo"), F.col(hi).alias("hi"), best.alias("b"))
    last = f"o{len(order) - 1}"
    alike = alike.select("lo", "hi", "b.*").groupBy("lo", "hi", *[f"o{i}" for i in range(len(order) - 1)]).agg(F.min(last).alias(last))
    sizes = [1 << i for i in reversed(range(width.bit_length()))]
    pieces = alike.select(F.explode(pieces_of(F.col("lo"), F.col("hi"), sizes)).alias("p"), F.struct(*[f"o{i}" for i in range(len(order))]).alias("b"))
    first = pieces.groupBy("p.size", "p.at").agg(F.min("b").alias("b"))
    asked = points.where(F.col(point).isNotNull()).select(point).distinct()
    asked = asked.select(point, F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("size"), F.floor(F.col(point) / n).alias("at")) for n in sizes])).alias("_piece")).select(point, "_piece.*")
    return asked.join(first, ["size", "at"]).groupBy(point).agg(F.min("b").alias("best"))


def pieces_of(lo: Column, hi: Column, sizes: list[int]) -> Column:
    """Array of (size, at): disjoint cells of falling sizes, each half of the one before, that make up lo to hi. Of a size
    those inside the interval whose double is not."""
    def inside(n: int) -> tuple[Column, Column]:
        return F.ceil(lo / n), F.floor((hi + 1) / n) - 1

    def cells(n: int, a: Column, b: Column) -> Column:
        of = F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<long>"))
        return F.transform(of, lambda i: F.struct(F.lit(n).cast("long").alias("size"), i.alias("at")))

    parts = [cells(sizes[0], *inside(sizes[0]))]
    for n in sizes[1:]:
        (a, b), (up_a, up_b) = inside(n), inside(2 * n)
        none = up_a > up_b
        parts.append(cells(n, a, F.when(none, b).otherwise(up_a * 2 - 1)))
        parts.append(F.when(none, F.array().cast("array<struct<size:bigint,at:bigint>>")).otherwise(cells(n, up_b * 2 + 2, b)))
    return F.concat(*parts)


def first_inside(points: DataFrame, point: str, nodes: DataFrame, node: str, lo: str, hi: str, k: int, width: int) -> DataFrame:
    """(node, point, place): the k smallest points inside each node's intervals, points that repeat as often as they do.

    The points of a cell of `width` are one array, of each value k at most; an interval meets the arrays of the cells it
    touches and takes k of each, so no row is made for a point that an interval drops.
    """
    values = points.where(F.col(point).isNotNull()).groupBy(point).agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))
    values = values.select(F.floor(F.col(point) / width).alias("_cell"), F.array_repeat(point, F.col("n")).alias("x"))
    cells = values.groupBy("_cell").agg(F.sort_array(F.flatten(F.collect_list("x"))).alias("x"))
    touched = nodes.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    some = touched.join(cells, "_cell").select(node, F.slice(F.filter("x", lambda p: p.between(F.col(lo), F.col(hi))), 1, k).alias("x")).where(F.size("x") > 0)
    first = some.groupBy(node).agg(F.slice(F.sort_array(F.flatten(F.collect_list("x"))), 1, k).alias("x"))
    return first.select(node, F.posexplode("x").alias("place", point)).withColumn("place", F.col("place") + 1)


def chain(df: DataFrame, by: list[str], order: list[str], item: str) -> DataFrame:
    place = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("previous", F.lag(item).over(place)).withColumn("next", F.lead(item).over(place))


def carried(value: Column, by: list[str], order: list[str]) -> Column:
    """The last non-null value so far."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def over_budget(df: DataFrame, by: list[str], order: list[Column], size: str, limit: int) -> DataFrame:
    """Adds used, the running sum, and evicted, whether it passes limit."""
    return df.withColumn("used", F.sum(size).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).withColumn("evicted", F.col("used") > limit)


def outline(df: DataFrame, by: str, order: str, depth: str, start: str, deepest: int) -> DataFrame:
    """Adds parent, the order of the nearest node before of smaller depth, and end, the start of the next node that is
    not deeper, less one (null at the end). One window pass for each level of a bounded depth, no self join."""
    place = Window.partitionBy(by).orderBy(order)
    before, after = place.rowsBetween(Window.unboundedPreceding, -1), place.rowsBetween(1, Window.unboundedFollowing)
    parent, end = F.lit(None), F.lit(None)
    for d in range(1, deepest + 1):
        parent = F.when(F.col(depth) == d, F.max(F.when(F.col(depth) < d, F.col(order))).over(before)).otherwise(parent)
        end = F.when(F.col(depth) == d, F.first(F.when(F.col(depth) <= d, F.col(start)), ignorenulls=True).over(after) - 1).otherwise(end)
    return df.withColumn("parent", parent).withColumn("end", end)


def ancestors(nodes: DataFrame, node: str, parent: str, deepest: int) -> DataFrame:
    """(node, path, cyclic): ids from the root to each node; a walk of more than `deepest` steps is a cycle.

    One join for each level; every level keeps only the nodes that still have a parent.
    """
    up = nodes.select(F.col(node).alias("up"), F.col(parent).alias("above"))
    walk = nodes.select(F.col(node).alias("node"), F.col(parent).alias("at"), F.array(F.col(node)).alias("path"))
    done = []
    for _ in range(deepest):
        done.append(walk.where("at IS NULL").select("node", "path", F.lit(False).alias("cyclic")))
        walk = walk.where("at IS NOT NULL").join(up, F.col("at") == F.col("up")).select("node", F.col("above").alias("at"), F.concat(F.array("at"), "path").alias("path"))
    done.append(walk.select("node", "path", F.col("at").isNotNull().alias("cyclic")))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def regions(df: DataFrame, by: str, order: str, flag: str, gap: int) -> DataFrame:
    """(by, first, last, n): runs of flagged rows whose places differ by `gap` at most."""
    p = df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(flag)
    place = Window.partitionBy(by).orderBy("place")
    p = p.withColumn("new", (F.col("place") - F.lag("place").over(place) > gap).cast("int")).withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(place))
    return p.groupBy(by, "run").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count(F.lit(1)).alias("n")).drop("run")


def aligned(pairs: DataFrame, by: str, left: str, right: str, score: str, least: float) -> DataFrame:
    """(by, left, right): the chain of pairs that rises on both sides with the greatest sum of scores of `least` or more.

    Within a book, whose outline bounds the pairs of a group, pairs are taken by their left side, and the best chain that
    ends below a right side is read from a Fenwick tree of prefix maxima: n log n. Of equal sums the chain found first stays.
    """

    def run(key, pdf):
        import pandas as pd

        rows = [(a, b, s) for a, b, s in zip(pdf[left], pdf[right], pdf[score], strict=True) if s >= least]
        rows.sort(key=lambda r: r[1], reverse=True)
        rows.sort(key=lambda r: r[0])  # of one left side the greatest right one comes first, so none follows another
        place = {b: i for i, b in enumerate(sorted({r[1] for r in rows}), 1)}
        tree: list[tuple[float, int]] = [(0.0, 1)] * (len(place) + 1)  # (sum, minus the pair that ends the chain)
        back: list[int] = []
        top = (0.0, 1)
        for i, (_, b, s) in enumerate(rows):
            prior, k = (0.0, 1), place[b] - 1
            while k:
                prior = max(prior, tree[k])
                k &= k - 1
            back.append(-prior[1])
            own, k = (prior[0] + s, -i), place[b]
            top = max(top, own)
            while k < len(tree):
                tree[k] = max(tree[k], own)
                k += k & -k
        at, out = -top[1], []
        while at >= 0:
            out.append((key[0], rows[at][0], rows[at][1]))
            at = back[at]
        return pd.DataFrame(out[::-1], columns=[by, left, right])

    kinds = dict(pairs.dtypes)
    return pairs.groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, {left} {kinds[left]}, {right} {kinds[right]}")
