"""Groups of exact and near copies of media, greedy in the order of their ids, by rounds over a graph."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import staged

#: Bits that near hashes may differ in, and the part by which sides may (fixed values).
MOST_BITS, MOST_ASPECT = 6, 0.12
#: Pieces a hash is cut into, by the number of hashes: with more pieces, more of them must be equal, so fewer strangers meet.
PIECES = [(10_000_000, 8), (300_000_000, 9), (1 << 62, 10)]


def alike(h1: Column, r1: Column, h2: Column, r2: Column) -> Column:
    return (F.bit_count(h1.bitwiseXOR(h2)) <= MOST_BITS) & (F.abs(r1 - r2) / F.greatest(r1, r2) <= MOST_ASPECT)


def near_edges(nodes: DataFrame, pieces: int) -> DataFrame:
    """(a, b) of all different nodes (id, h, ratio) that are alike, a < b. Six bits spoil six pieces at most, so any two
    alike share all the others: they meet by each choice of so many pieces."""
    cuts = [64 * i // pieces for i in range(pieces + 1)]
    piece = [F.call_function("shiftrightunsigned", F.col("h"), F.lit(lo)).bitwiseAND((1 << (hi - lo)) - 1) for lo, hi in zip(cuts, cuts[1:], strict=False)]

    def key(number: int, chosen: tuple[int, ...]) -> Column:
        value = F.lit(0).cast("long")
        for i in chosen:
            value = F.shiftleft(value, cuts[i + 1] - cuts[i]).bitwiseOR(piece[i])
        return F.struct(F.lit(number).alias("choice"), value.alias("value"))

    keys = [key(n, c) for n, c in enumerate(combinations(range(pieces), pieces - MOST_BITS))]
    k = nodes.select("id", "h", "ratio", F.explode(F.array(*keys)).alias("k")).select("id", "h", "ratio", "k.choice", "k.value")
    x, y = (k.select("choice", "value", *[F.col(c).alias(f"{c}{i}") for c in ("id", "h", "ratio")]) for i in (1, 2))
    pairs = x.join(y, ["choice", "value"]).where((F.col("id1") < F.col("id2")) & alike(F.col("h1"), F.col("ratio1"), F.col("h2"), F.col("ratio2")))
    return pairs.select(F.col("id1").alias("a"), F.col("id2").alias("b")).distinct()


def first_independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The ids that a walk in their order chooses, when it skips what has an edge to one chosen before.

    By rounds: an id without a smaller undecided neighbour is chosen, its neighbours are out, and both leave the graph.
    Only edges between undecided ids stay, so rounds shrink; without edges all that is left is chosen. Files of few megabytes
    hold many ids, so these joins are told not to broadcast.
    """
    left, open_edges, chosen = nodes.select("id"), edges, []
    while not open_edges.isEmpty():
        first = left.join(open_edges.select(F.col("b").alias("id")).hint("merge"), "id", "left_anti")
        first = staged(first, "chosen")
        out = open_edges.join(first.select(F.col("id").alias("a")).hint("merge"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        gone = staged(first.unionByName(out), "decided")
        chosen.append(first)
        left = staged(left.join(gone.hint("merge"), "id", "left_anti"), "undecided")
        keep = open_edges.join(gone.select(F.col("id").alias("a")).hint("merge"), "a", "left_anti").join(gone.select(F.col("id").alias("b")).hint("merge"), "b", "left_anti")
        open_edges = staged(keep.select("a", "b"), "edges")
    for c in chosen:
        left = left.unionByName(c)
    return left


def duplicate_groups(assets: DataFrame, id_col: str, pixels: str, phash: str, width: str, height: str) -> DataFrame:
    """(id, canonical, match): a row for each member, canonical ones too, of every group of two or more.

    exact: assets of equal pixel hash, by the smallest id. perceptual: of the first of each pixel hash, in the order of
    ids, one that no earlier canonical has taken is canonical and takes all later ones whose 64-bit hash differs in six
    bits or less and whose aspect differs by 12 % or less. Assets of one hash and aspect share their neighbours and so
    their fate: they go through the graph as one, so a hash that very many assets have costs one node. A null pixel hash
    is in no group, a null perceptual hash in no perceptual one; a side that is null or 0 counts as 1. Texts of the
    pairs are not kept: only edges between different hashes, while the rounds last.
    """
    side = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) == 0, 1.0).otherwise(F.col(c).cast("double"))
    known = assets.where(F.col(pixels).isNotNull()).select(F.col(id_col).alias("id"), F.col(pixels).alias("pixels"), F.col(phash).alias("h"), (side(width) / side(height)).alias("ratio"))
    firsts = known.groupBy("pixels").agg(F.min_by(F.struct("id", "h", "ratio"), "id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = staged(firsts.select("pixels", "first.*", "n"), "firsts")
    exact = known.join(firsts.where("n > 1").select("pixels", F.col("id").alias("canonical")), "pixels").select("id", "canonical", F.lit("exact").alias("match"))
    members = firsts.where("h IS NOT NULL").select("id", "h", "ratio")
    nodes = staged(members.groupBy("h", "ratio").agg(F.min("id").alias("id")), "nodes")
    n = nodes.count()
    edges = staged(near_edges(nodes, next(p for most, p in PIECES if n <= most)), "edges")
    chosen = staged(first_independent(nodes, edges), "chosen")
    taken = edges.join(chosen.select(F.col("id").alias("a")), "a", "left_semi").join(chosen.select(F.col("id").alias("b")), "b", "left_anti")
    canonical = chosen.select("id", F.col("id").alias("canonical")).unionByName(taken.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("canonical")))
    of_hash = nodes.join(canonical, "id").select("h", "ratio", "canonical")
    near = members.join(of_hash, ["h", "ratio"]).select("id", "canonical")
    grouped = near.join(near.groupBy("canonical").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("canonical"), "canonical")
    return exact.unionByName(grouped.select("id", "canonical", F.lit("perceptual").alias("match")))
