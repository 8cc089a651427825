"""Product codes of vectors by filtering Lloyd rounds over kd-trees (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024.0
#: Vectors of one block, over which a task builds a tree for each part; points of a leaf at most; leaves whose points are compared together.
BLOCK_ROWS, LEAF, LEAVES = 8192, 32, 16
LIMITS = np.iinfo(np.int64)


def exact(most: int, terms: int) -> type:
    """A kind of number in which sums of `terms` products of values up to `most` are exact: doubles or 64-bit integers
    where these hold them, else Python's."""
    bound = 16 * terms * most * most
    return np.float64 if bound < 2**53 else np.int64 if bound < 2**62 else object


def largest(*arrays: np.ndarray) -> int:
    return max([1, *(max(int(a.max()), -int(a.min())) for a in arrays if a.size)])


def cut(v: np.ndarray) -> np.ndarray:
    """As long; beyond its range its ends."""
    return np.clip(v, LIMITS.min, LIMITS.max).astype(np.int64) if v.dtype == object else v.astype(np.int64)


def borders(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin and end among n points in the tree's order."""
    return np.arange((1 << level) + 1) * n >> level


@dataclass
class Tree:
    """A balanced kd-tree over integer points: its nodes of a level are equal runs of the points' order. Each node keeps
    its box and the sums of its points; a count is the length of its run."""

    order: np.ndarray
    points: np.ndarray
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]

    @staticmethod
    def build(points: np.ndarray) -> Tree:
        n = len(points)
        levels = 1
        while n >> levels - 1 > LEAF:
            levels += 1
        order = np.arange(n)
        for level in range(levels - 1):  # each run is sorted along the widest side of its box and halved
            at = borders(n, level)
            low, high = np.minimum.reduceat(points[order], at[:-1]), np.maximum.reduceat(points[order], at[:-1])
            run = np.repeat(np.arange(1 << level), np.diff(at))
            side = (high.astype(float) - low.astype(float)).argmax(1)[run]
            order = order[np.lexsort((points[order, side], run))]
        points = points[order]
        kind = np.int64 if largest(points) < 2**62 // max(n, 1) else object
        at = [borders(n, level)[:-1] for level in range(levels)]
        return Tree(order, points, [np.minimum.reduceat(points, a) for a in at], [np.maximum.reduceat(points, a) for a in at], [np.add.reduceat(points.astype(kind), a) for a in at])

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry of each point in the tree's order, count of each entry, sums of each entry) by nearest entry, ties to the
        lower one. A node drops the entries that no point of its box can prefer to the one nearest its middle; where one
        is left, the node's count and sums go to it as they are."""
        n, (k, d) = len(self.points), book.shape
        kind = exact(largest(book, self.low[0], self.high[0]), d)
        c = book.astype(kind)
        square = (c * c).sum(1)
        apart = np.abs(c[:, None, :] - c[None, :, :])
        entry = np.zeros(n, np.int64)
        count, total = np.zeros(k, np.int64), np.zeros((k, d), self.sums[0].dtype)
        nodes, left = np.zeros(1, np.int64), np.ones((1, k), bool)
        number = np.arange(k)
        for level, (low, high, sums) in enumerate(zip(self.low, self.high, self.sums, strict=True)):
            if not len(nodes):
                break
            at = borders(n, level)
            twice_middle, side = (low[nodes].astype(kind) + high[nodes].astype(kind)), (high[nodes].astype(kind) - low[nodes].astype(kind))
            dots = twice_middle @ c.T
            # 2 * (distance from the middle squared), but for what all entries share
            far = 2 * square - 2 * dots
            far = np.where(left, far, far.max() + 1)
            star = far.argmin(1)
            # The least, over the box, of an entry's squared distance less that of the star.
            gap = np.empty((len(nodes), k), kind)
            for s in np.unique(star).tolist():
                own = star == s
                gap[own] = square - square[s] - (dots[own] - dots[own, s : s + 1]) - side[own] @ apart[s].T
            left &= (gap < 0) | ((gap == 0) & (number < star[:, None]))
            left[np.arange(len(nodes)), star] = True
            done = left.sum(1) == 1
            for node, s in zip(nodes[done].tolist(), star[done].tolist(), strict=True):
                entry[at[node] : at[node + 1]] = s
            np.add.at(count, star[done], np.diff(at)[nodes[done]])
            np.add.at(total, star[done], sums[nodes[done]])
            nodes, left = nodes[~done], left[~done]
            if level < len(self.low) - 1:
                nodes, left = np.ravel(np.stack([2 * nodes, 2 * nodes + 1], 1)), np.repeat(left, 2, axis=0)
        at = borders(n, len(self.low) - 1)
        for i in range(0, len(nodes), LEAVES):
            some = nodes[i : i + LEAVES]
            rows = np.concatenate([np.arange(at[x], at[x + 1]) for x in some.tolist()])
            near = np.flatnonzero(left[i : i + LEAVES].any(0))
            score = square[near] - 2 * (self.points[rows].astype(kind) @ c[near].T)
            entry[rows] = near[score.argmin(1)]
            count += np.bincount(entry[rows], minlength=k)
            np.add.at(total, entry[rows], self.points[rows].astype(total.dtype))
        return entry, count, total


def kept_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: float) -> DataFrame:
    """(id, label, v): components as floor(scale * x); rows whose vector is null or holds null or non-finite ones are out."""
    whole = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), whole.alias("v"))
    fine = fine.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    return fine.withColumn("v", F.transform("v", lambda x: F.floor(x * scale)))


def blocks_of(vectors: DataFrame, width: int, parts: int) -> DataFrame:
    """(ids, labels, tree of each part) of at most BLOCK_ROWS vectors, as they come."""
    label = vectors.schema["label"].dataType.simpleString()
    tree = "order: binary, points: binary, low: binary, high: binary, sums: binary"
    schema = f"ids array<long>, labels array<{label}>, trees array<struct<{tree}>>"
    fields = [x.split(":")[0] for x in tree.split(", ")]
    kind = pa.list_(pa.struct([(x, pa.binary()) for x in fields]))

    def block(ids: list, labels: list, rows: list) -> pa.RecordBatch:
        m = np.zeros((len(rows), width * parts), np.int64)
        for i, r in enumerate(rows):
            m[i, : len(r)] = r
        trees = []
        for p in range(parts):
            t = Tree.build(m[:, p * width : (p + 1) * width])
            told = [t.order, t.points, *(np.concatenate(x) for x in (t.low, t.high, t.sums))]
            trees.append(dict(zip(fields, map(written, told), strict=True)))
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), labels, pa.array([trees], kind)], ["ids", "labels", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        labels: list[pa.Array] = []
        rows: list = []

        def out() -> pa.RecordBatch:
            own = pa.concat_arrays(labels)
            made = block(ids, pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), rows)
            ids.clear(), labels.clear(), rows.clear()
            return made

        for b in batches:
            for i in range(0, len(b), BLOCK_ROWS):
                part = b.slice(i, BLOCK_ROWS)
                if len(ids) + len(part) > BLOCK_ROWS:
                    yield out()
                ids += part.column(0).to_pylist()
                labels.append(part.column(1))
                rows += [v.values.to_numpy() for v in part.column(2)]
        if ids:
            yield out()

    return vectors.select("id", "label", "v").mapInArrow(run, schema)


def written(x: np.ndarray) -> bytes:
    """Whole numbers in 4 bytes each where they fit, else in 8, else as text; a leading byte says which."""
    if x.dtype == object:
        return b"\0" + ",".join(map(str, x.ravel().tolist())).encode()
    small = x.astype("<i4") if largest(x) < 2**31 else x.astype("<i8")
    return bytes([small.itemsize]) + small.tobytes()


def read(data: bytes, width: int) -> np.ndarray:
    if not data[0]:
        return np.array(list(map(int, data[1:].split(b","))), object).reshape(-1, width)
    return np.frombuffer(data, f"<i{data[0]}", offset=1).reshape(-1, width).astype(np.int64)


def loaded(block: dict, width: int) -> Tree:
    """A staged tree."""
    low, high, sums = (read(block[x], width) for x in ("low", "high", "sums"))
    at = [(1 << level) - 1 for level in range((len(low) + 1).bit_length())]
    levels = [slice(a, b) for a, b in zip(at[:-1], at[1:], strict=True)]
    return Tree(read(block["order"], 1)[:, 0], read(block["points"], width), [low[s] for s in levels], [high[s] for s in levels], [sums[s] for s in levels])


@dataclass
class Codebooks:
    """entries[part, entry, position]."""

    entries: np.ndarray

    @staticmethod
    def first(vectors: DataFrame, width: int, parts: int, n: int) -> Codebooks:
        """The parts of the n vectors of the smallest ids; rows of one id by their components, null ids at the end."""
        rows = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(n).select("v").collect()
        m = np.zeros((len(rows), width * parts), np.int64)
        for i, r in enumerate(rows):
            m[i, : len(r["v"])] = r["v"]
        return Codebooks(np.ascontiguousarray(m.reshape(len(rows), parts, width).transpose(1, 0, 2)))

    def text(self) -> str:
        """All components, by part, entry and position."""
        return ",".join(map(str, self.entries.ravel().tolist()))


def improved(blocks: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every entry becomes the floor of the mean of the parts nearest to it; an entry without parts stays."""
    entries = books.entries
    parts, k, width = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), object)
        for b in batches:
            for trees in b.column(0):
                for p, t in enumerate(trees.as_py()):
                    _, n, s = loaded(t, width).assign(entries[p])
                    count[p] += n
                    total[p] += s.astype(object)
        for p in range(parts):
            used = np.flatnonzero(count[p])
            sums = [[str(x) for x in row] for row in total[p][used].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([p] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array(count[p][used], pa.int64()), pa.array(sums, pa.list_(pa.string()))], ["part", "entry", "n", "sums"])

    partial = blocks.select("trees").mapInArrow(run, "part int, entry int, n long, sums array<string>")
    means = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    new = entries.copy()
    for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *means).collect():  # a row for each entry at most
        new[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return Codebooks(new)


def trained(vectors: DataFrame, blocks: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    books = Codebooks.first(vectors, width, parts, entries)
    for _ in range(rounds):
        books = improved(blocks, books)
    return books


def coded(blocks: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code, error): the nearest entries' numbers in hexadecimal, two digits each, and the squared distances' sum."""
    entries = books.entries
    parts, n_entries, width = entries.shape
    digits = max(2, len(f"{n_entries - 1:x}"))
    label = blocks.schema["labels"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = [f"{i:0{digits}x}" for i in range(n_entries)]
        for b in batches:
            for i in range(len(b)):
                ids, labels = b.column(0)[i].values, b.column(1)[i].values
                code = np.zeros((len(ids), parts), np.int64)
                error: np.ndarray | int = 0
                for p, t in enumerate(b.column(2)[i].as_py()):
                    tree = loaded(t, width)
                    entry, _, _ = tree.assign(entries[p])
                    kind = object if exact(largest(tree.points, entries[p]), 4 * parts * width) is object else np.int64
                    off = tree.points.astype(kind) - entries[p][entry].astype(kind)
                    code[tree.order, p] = entry
                    back = np.empty(len(ids), kind)
                    back[tree.order] = (off * off).sum(1)
                    error = error + back
                codes = ["".join(map(told.__getitem__, row)) for row in code.tolist()]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes), pa.array(cut(error))], ["id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"id long, label {label}, code string, error long")


def product_codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks]:
    """(id, code, error, label_error) of every vector, and the codebooks.

    Components count as floor(scale * x). Vectors are cut into equal consecutive parts, each with a codebook of its own:
    at first the parts of the `entries` vectors of smallest id, then improved in `rounds` Lloyd rounds. Tasks build
    kd-trees over blocks of vectors once and stage them; a round filters a codebook down each tree and sends a count and
    a sum for each entry, so the driver gets a row for each entry. label_error is the sum of error over equal labels.

    A vector that is null or holds null or non-finite components is dropped; one that is shorter than the longest, or
    than a multiple of `parts`, counts as if filled with zeros. Null ids stay, last in the choice of first entries;
    repeated rows stay, each for itself; null labels are summed together. Components and errors beyond the range of long
    count as its ends. Fewer vectors than entries: so many entries. No vectors: no rows. Other columns are left out.
    """
    spark: SparkSession = rows.sparkSession
    vectors = kept_vectors(rows, id_col, vector_col, label_col, scale)
    longest = vectors.agg(F.max(F.size("v"))).first()[0]
    width = max(1, -(-(longest or 0) // parts))
    label = vectors.schema["label"].dataType
    if longest is None:
        return spark.createDataFrame([], f"{id_col} long, code string, error long, label_error long"), Codebooks(np.zeros((parts, 0, width), np.int64))
    blocks = staged(blocks_of(vectors, width, parts), "blocks", "zstd")
    books = trained(vectors, blocks, width, parts, entries, rounds)
    found = staged(coded(blocks, books), "codes")
    sums = found.groupBy(F.col("label").alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LIMITS.max)).cast("long").alias("label_error"))
    # Null labels meet each other; it is an equi-join, whose hot labels Spark can split.
    joined = found.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error"), books


def codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> str:
    """The same in DuckDB's dialect, every part against every entry; vectors of one length, a multiple of `parts`."""
    assigned = """
a{i} AS MATERIALIZED (
  SELECT q.rn, q.p, any_value(q.x) AS x,
    min(list_sum(list_transform(list_zip(q.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * {k} + b.e) AS m
  FROM parts q JOIN b{i} b ON b.p = q.p GROUP BY q.rn, q.p)"""
    improved = """
s{i} AS (
  SELECT p, e, k, sum(x)::BIGINT AS s, count(*) AS n
  FROM (SELECT p, m % {k} AS e, unnest(x) AS x, unnest(range(len(x))) AS k FROM a{i}) GROUP BY p, e, k),
b{j} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(n.c, b.c) AS c
  FROM b{i} b LEFT JOIN (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY k) AS c FROM s{i} GROUP BY p, e) n ON n.p = b.p AND n.e = b.e)"""
    steps = [(assigned + "," + improved).format(i=i, j=i + 1, k=entries) for i in range(rounds)]
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS rn, vec_id, label, v
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
parts AS MATERIALIZED (
  SELECT rn, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) t(p)),
b0 AS (SELECT p, rn AS e, x AS c FROM parts WHERE rn < {entries}),{",".join(steps)},{assigned.format(i=rounds, k=entries)},
told AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, k)) AS sha FROM (SELECT p, e, unnest(c) AS x, unnest(range(len(c))) AS k FROM b{rounds})),
coded AS (SELECT rn, string_agg(printf('%02x', m % {entries}), '' ORDER BY p) AS code, sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY rn)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256
FROM kept JOIN coded USING (rn), told"""
