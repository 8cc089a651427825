"""Catalogue operators: filters, editions, merges, retention, integrity rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import top_by

#: Keys of the document filter and the columns they look at.
FILTER_KEYS = {"language": "lang", "source": "source", "document": "doc_id"}
#: Keys of a library's filter: several look at one column, some at lists (fixed values).
LIBRARY_KEYS = {
    "document_id": "doc_id", "logical_document_id": "doc_id", "document_ids": "doc_id", "logical_document_ids": "doc_id", "work_id": "work_id", "title": "title",
    "edition": "edition_label", "edition_number": "edition_number", "publication_year": "publication_year", "document_status": "document_status",
    "language": "lang", "authors": "authors", "author": "authors", "isbn": "isbn", "tags": "tags",
}
LIST_KEYS = {"authors", "author", "isbn", "tags"}
#: Keys that name a version, so that older editions stay in (fixed values).
VERSION_KEYS = {"document_id", "logical_document_id", "document_ids", "logical_document_ids", "edition", "edition_number", "publication_year", "document_status"}


def document_filter(filters: dict[str, object], keys: dict[str, str] = FILTER_KEYS) -> Column | None:
    """A predicate of all keys, each met by any of its values without regard to case; None without filters.

    An empty list of values admits everything; an unknown key is an error. No filter at all (None) differs from a filter
    that nothing meets.
    """
    unknown = set(filters) - set(keys)
    if unknown:
        raise ValueError(f"unknown filter keys {sorted(unknown)}")
    parts = []
    for key, value in filters.items():
        wanted = [str(v).lower() for v in (value if isinstance(value, (list, tuple, set)) else [value])]
        if wanted and key in LIST_KEYS:
            parts.append(F.coalesce(F.arrays_overlap(F.transform(keys[key], F.lower), F.array(*[F.lit(w) for w in wanted])), F.lit(False)))
        elif wanted:
            parts.append(F.lower(F.col(keys[key]).cast("string")).isin(wanted))
    return reduce(lambda a, b: a & b, parts) if parts else None


def library(docs: DataFrame, filters: dict[str, object], policy: str = "all") -> DataFrame:
    """Documents that meet all filters; with policy current-only the latest edition of each work, unless a filter names a
    version."""
    if policy not in ("all", "current-only"):
        raise ValueError(f"unknown policy {policy}")
    where = document_filter(filters, LIBRARY_KEYS)
    found = docs if where is None else docs.where(where)
    if policy == "all" or VERSION_KEYS & set(filters):
        return found
    order = [F.coalesce("edition_number", F.lit(0)).desc(), F.coalesce("publication_year", F.lit(0)).desc(), F.col("doc_id").desc()]
    return current_editions(found, "work_id", order, F.coalesce("document_status", F.lit("active")) == "superseded")


def allow_list(ids: list | None, column: str) -> Column:
    """None lets everything through, an empty list nothing."""
    if ids is None:
        return F.lit(True)
    return F.col(column).isin(list(ids)) if ids else F.lit(False)


def current_editions(docs: DataFrame, work: str, order: list[Column], superseded: Column | None = None) -> DataFrame:
    """The latest edition of each work that isn't superseded."""
    alive = docs if superseded is None else docs.where(~superseded)
    return top_by(alive, [work], order, 1, "_r").drop("_r")


def with_first(df: DataFrame, id_col: str, key: str, salts: int = 64) -> DataFrame:
    """Adds rep, the smallest id of the rows with the same key. Rows of a hot key are folded by key and salt, and joined
    back by both, so no task gets them all."""
    salted = df.withColumn("_salt", F.pmod(F.col(id_col), F.lit(salts)))
    some = salted.groupBy(key, "_salt").agg(F.min(id_col).alias("_least"))
    first = some.join(some.groupBy(key).agg(F.min("_least").alias("rep")), key).select(key, "_salt", "rep")
    return salted.join(first, [key, "_salt"]).drop("_salt")


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or update: rows of new replace those of old with the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def latest(log: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """One row of each key: the last non-null value of every column by `order`; a map-side aggregate, no sort."""
    last = [F.max_by(F.when(F.col(v).isNotNull(), F.col(v)), F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values]
    return log.groupBy(*keys).agg(*last)


def idempotent(requests: DataFrame, keys: list[str], payload: str, order: str) -> DataFrame:
    """Adds outcome: 'new' for a key's first request, 'reused' for later ones of the same payload, else 'conflict'."""
    first = requests.groupBy(*keys).agg(F.min_by(F.struct(F.col(order).alias("o"), F.sha2(payload, 256).alias("h")), order).alias("first"))
    same = F.sha2(payload, 256) == F.col("first.h")
    return requests.join(first, keys).withColumn("outcome", F.when(F.col(order) == F.col("first.o"), "new").when(same, "reused").otherwise("conflict")).drop("first")


def selection_digest(ids: Column) -> Column:
    """Order-free digest of a bounded set of ids: 16 hex digits of the sha-256 of their sorted compact JSON list."""
    return F.substring(F.sha2(F.to_json(F.array_sort(F.collect_set(ids))), 256), 1, 16)


#: Digests that one digest is made of, and levels of them below the last.
TREE_WIDTH, TREE_LEVELS = 1000, 3


def tree_digest(df: DataFrame, by: list[str], order: Column, item: Column, n: str = "n") -> DataFrame:
    """(by, n, digest): a sha-256 of each group's items in order that no task makes of a whole group: items of 1000
    successive orders are joined and hashed, then 1000 such hashes, and so on. order: a whole number of 0 or more."""
    x = df.select(*by, order.cast("long").alias("_k"), item.alias("_d"), F.lit(1).cast("long").alias("_n"))
    for last in [False] * TREE_LEVELS + [True]:
        keys = [F.col(b) for b in by] if last else [*map(F.col, by), F.expr(f"_k div {TREE_WIDTH}").alias("_k")]
        listed = F.transform(F.array_sort(F.collect_list(F.struct("_k", "_d"))), lambda e: e["_d"])
        x = x.groupBy(*keys).agg(F.sha2(F.array_join(listed, ","), 256).alias("_d"), F.sum("_n").alias("_n"))
    return x.select(*by, F.col("_n").alias(n), F.col("_d").alias("digest"))


def tree_digest_sql(source: str, by: str, name: str = "tree") -> str:
    """CTEs of the same in SQL, the last called `name` (by, n, digest); source: a table of by, k and d."""
    out, last = [], source
    for level in range(TREE_LEVELS):
        n = "count(*)" if level == 0 else "sum(n)"
        out.append(f"{name}{level} AS (SELECT {by}, k // {TREE_WIDTH} AS k, sha256(string_agg(d, ',' ORDER BY k, d)) AS d, {n}::BIGINT AS n FROM {last} GROUP BY {by}, k // {TREE_WIDTH})")
        last = f"{name}{level}"
    return ",\n".join([*out, f"{name} AS (SELECT {by}, sum(n)::BIGINT AS n, sha256(string_agg(d, ',' ORDER BY k, d)) AS digest FROM {last} GROUP BY {by})"])


def rule(df: DataFrame, code: str, broken: Column | None, key: Column) -> DataFrame:
    """(code, id) of the rows that break a rule."""
    return (df if broken is None else df.where(broken)).select(F.lit(code).alias("code"), key.cast("string").alias("id"))


def without_keys(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Delete by key; applied to each dependent table it is a cascade."""
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def contiguous(spans: DataFrame, by: str, first: str, last: str, total: Column) -> DataFrame:
    """(by, code) of units whose spans, in order, don't cover 1 to total exactly once."""
    place = Window.partitionBy(by).orderBy(first, last)
    s = spans.withColumn("_before", F.coalesce(F.lag(last).over(place), F.lit(0))).withColumn("_step", F.col(first) - F.col("_before"))
    units = s.groupBy(by).agg(F.max("_step").alias("most"), F.min("_step").alias("least"), F.max(last).alias("end"), F.max(total).alias("total"))
    code = F.when(F.col("least") < 1, "overlap").when(F.col("most") > 1, "gap").when(F.col("end") != F.col("total"), "short")
    return units.select(by, code.alias("code")).where("code IS NOT NULL")


def live_blobs(blobs: DataFrame, marks: list[DataFrame], digest: str, cutoff: Column, changed: str) -> DataFrame:
    """Blobs to sweep: referenced by none of the marks and older than the cut-off."""
    marked = reduce(lambda a, b: a.union(b), [m.select(digest) for m in marks]).distinct()
    return blobs.join(marked, digest, "left_anti").where(F.col(changed) < cutoff)
