"""Exact top-k inner-product search as a Voronoi kNN join (operator 7)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

PIVOTS, BLOCK_ROWS, QUERY_ROWS = 16, 4096, 512
#: Blocks of data that one part of a query group gets, about, and parts at least. More parts mean more copies of the
#: queries, which are small beside the data.
PART_BLOCKS, LEAST_PARTS = 64, 8
BLOCK_SCHEMA = "cell int, block long, n int, radius double, near array<double>, ids binary, dim int, vectors binary"
#: Answers a task holds before it keeps the best of each query, and then hands on what it has.
HELD_ANSWERS = 500_000


def packed(rows: list[np.ndarray]) -> tuple[int, bytes]:
    dim = max(map(len, rows))
    out = np.zeros((len(rows), dim), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return dim, out.tobytes()


def padded(m: np.ndarray, dim: int) -> np.ndarray:
    return m if m.shape[1] == dim else np.pad(m, ((0, 0), (0, dim - m.shape[1])))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: by way of doubles or 64-bit integers where these hold every sum, else of Python's, cut to
    the range of 64 bits."""
    dim = max(a.shape[1], b.shape[1])
    a, b = padded(a, dim), padded(b, dim)
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * dim
    if most < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    limits = np.iinfo(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, limits.min, limits.max).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of each row's k highest scores, ties to the smaller id; ids rise."""
    n = scores.shape[1]
    if n <= k or scores.max() >= 2**62 // n or scores.min() <= -(2**62) // n:
        return np.argsort(~scores, axis=1, kind="stable")[:, :k]  # ~x falls as x rises, over the whole range
    key = scores * n - np.arange(n)
    top = np.argpartition(-key, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(key, top, 1), axis=1), 1)


def integers(rows: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) as long; rows whose vector is null or holds nulls or non-finite components are out."""
    whole = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))
    fine = fine.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    return fine.select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


def in_cells(rows: DataFrame, pivots: np.ndarray, size: int, k: int) -> DataFrame:
    """Blocks of at most `size` vectors of one Voronoi cell, with their greatest distance from the pivot and the k + 1 least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}
        names = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]

        def block(cell: int) -> pa.RecordBatch:
            ids, rows, far = held.pop(cell)
            order = np.argsort(ids, kind="stable")
            dim, data = packed([rows[i] for i in order])
            key = np.array(ids, np.int64)[order]
            number = int(np.bitwise_xor.reduce(key)) ^ len(key) << 48
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([number], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([max(far)], pa.float64()), pa.array([heapq.nsmallest(k + 1, far)], pa.list_(pa.float64())), pa.array([key.tobytes()], pa.binary()), pa.array([dim], pa.int32()), pa.array([data], pa.binary())], names)

        for b in batches:
            vectors = [np.array(v, np.int64) for v in b.column(1).to_pylist()]
            if not vectors:
                continue
            dim, data = packed([*vectors, pivots[0]])
            m = np.frombuffer(data, np.int64).reshape(-1, dim)[:-1].astype(float)
            p = padded(pivots, dim).astype(float)
            d2 = (m**2).sum(1)[:, None] - 2 * m @ p.T + (p**2).sum(1)
            cell = d2.argmin(1)
            far = np.sqrt(((m - p[cell]) ** 2).sum(1))
            for i, v, c, f in zip(b.column(0).to_pylist(), vectors, cell.tolist(), far.tolist(), strict=True):
                ids, rows, dist = held.setdefault(c, ([], [], []))
                ids.append(i)
                rows.append(v)
                dist.append(f)
                if len(ids) == size:
                    yield block(c)
        for c in sorted(held):
            yield block(c)

    return rows.mapInArrow(run, BLOCK_SCHEMA)


def best_of_each(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best answers of each query."""
    order = np.lexsort((vec, ~score, query))
    q = query[order]
    new = np.r_[True, q[1:] != q[:-1]]
    nth = np.arange(len(q)) - np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
    keep = order[nth < k]
    return query[keep], vec[keep], score[keep]


def bounds(pivots: np.ndarray, groups: dict[int, float], near: dict[int, list[float]], k: int) -> dict[int, float]:
    """For each query group a score that its every query reaches k times, whichever its own row is.

    For a query q within r of pivot g and a vector x within d of pivot j: |qx - gj| <= r|j| + d|g| + r d.
    """
    norm = np.sqrt((pivots.astype(float) ** 2).sum(1))
    out = {}
    for g, r in groups.items():
        low = [float(product(pivots[g : g + 1], pivots[j : j + 1])[0, 0]) - r * norm[j] - d * norm[g] - r * d for j, ds in near.items() for d in ds]
        low.sort(reverse=True)
        out[g] = low[k] if len(low) > k else -np.inf
    return out


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of greatest integer inner product with each query, ties to the smaller id.

    Components count as floor(scale * x). Data and queries are grouped by their nearest pivot (the first rows by a hash
    of the id; `pivots` bounds them and all that the driver sees: a radius and k + 1 distances for each). From these a
    group has a score its queries surely reach; only blocks that can reach it are copied to the group. A cell of any
    size is split in blocks, so equal vectors in great number spread over tasks. Rows with a query's id are not its
    answers. A vector that is null or holds null or non-finite components takes no part, nor does a null id; a shorter
    vector counts as if filled with zeros; components and scores beyond the range of long count as its ends; a query id that repeats is answered once, by its least vector; other columns
    are ignored. No queries or no rows: no answers.
    """
    data, asked = integers(rows, id_col, vector_col, scale), integers(queries, id_col, vector_col, scale)
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    chosen = [np.array(r["v"], np.int64) for r in data.where(F.size("v") > 0).orderBy(F.xxhash64("id"), "id", "v").limit(pivots).collect()] or [np.zeros(1, np.int64)]
    dim, raw = packed(chosen)
    centre = np.frombuffer(raw, np.int64).reshape(-1, dim)
    blocks = staged(in_cells(data, centre, BLOCK_ROWS, k), "blocks")
    groups = staged(in_cells(asked.repartition("id"), centre, QUERY_ROWS, k), "queries")
    radius = {r["cell"]: r["radius"] for r in groups.groupBy("cell").agg(F.max("radius").alias("radius")).collect()}
    least = blocks.select("cell", F.explode("near").alias("d")).withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("d"))).where(F.col("r") <= k + 1)
    near: dict[int, list[float]] = {}
    for r in least.collect():
        near.setdefault(r["cell"], []).append(r["d"])
    reach = bounds(centre, radius, near, k)
    norm = np.sqrt((centre.astype(float) ** 2).sum(1))

    # The most a block can score with a group, as an expression of its cell and radius; a table of pivots by groups.
    parts = [F.struct(F.lit(j).alias("cell"), F.lit(g).alias("grp"), F.lit(float(product(centre[g : g + 1], centre[j : j + 1])[0, 0]) + r * float(norm[j]) - reach[g]).alias("spare"), F.lit(float(norm[g]) + r).alias("slope")) for g, r in radius.items() for j in range(len(centre))]
    if not parts:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    table = data.sparkSession.range(1).select(F.explode(F.array(*parts)).alias("t")).select("t.*")
    # Rounding grows with the greatest products that a bound is made of, so what it forgives does too.
    slack = 1e-6 * (1 + F.col("slope") * (float(norm.max()) + F.col("radius")) + F.abs("spare"))
    n_parts = max(LEAST_PARTS, -(-blocks.count() // PART_BLOCKS))
    copies = blocks.join(F.broadcast(table), "cell").where(F.col("spare") + F.col("slope") * F.col("radius") + slack >= 0)
    left = copies.select("grp", F.expr(f"pmod(block, {n_parts})").cast("int").alias("salt"), F.col("ids").alias("d_ids"), F.col("dim").alias("d_dim"), F.col("vectors").alias("d_vectors"))
    right = groups.select(F.col("cell").alias("grp"), F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("salt"), F.col("ids").alias("q_ids"), F.col("dim").alias("q_dim"), F.col("vectors").alias("q_vectors"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0

        def best_held() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return best_of_each(*(np.concatenate(c) for c in zip(*held, strict=True)), k)

        def out(answers) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in answers], ["query_id", "vec_id", "score"])

        for b in batches:
            for i in range(len(b)):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                ids, asked = np.frombuffer(row["d_ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                if not row["d_dim"] or not row["q_dim"]:
                    scores = np.zeros((len(asked), len(ids)), np.int64)
                else:
                    scores = product(np.frombuffer(row["q_vectors"], np.int64).reshape(-1, row["q_dim"]), np.frombuffer(row["d_vectors"], np.int64).reshape(-1, row["d_dim"]))
                # One more than k for each own row among the ids, which are dropped here.
                own = np.searchsorted(ids, asked, "right") - np.searchsorted(ids, asked)
                top = best(scores, ids, k + int(own.max()))
                query, vec, score = np.repeat(asked, top.shape[1]), ids[top].ravel(), np.take_along_axis(scores, top, 1).ravel()
                other = query != vec
                held.append(best_of_each(query[other], vec[other], score[other], k))
                n += len(held[-1][0])
            if n > HELD_ANSWERS:
                held = [best_held()]
                n = len(held[0][0])
                if n > HELD_ANSWERS // 2:
                    yield out(held.pop())
                    n = 0
        if held:
            yield out(best_held())

    local = left.join(right, ["grp", "salt"]).mapInArrow(solve, "query_id long, vec_id long, score long")
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return local.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
