"""Weighted near-duplicates by DartMinHash signatures and banded joining (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from .common import GOLDEN, mix64, staged

SHINGLE, SIMILARITY = 5, 0.8
#: 20 bands of 5 coordinates: a pair at similarity 0.8 shares a band with probability 1 - (1 - 0.8^5)^20 = 0.9996.
BANDS, ROWS = 20, 5
#: Ids that are broadcast at most (16 MB); beyond that the join shuffles.
BROADCAST_IDS = 2_000_000
#: Parts that the copies of one text are dealt into.
COPY_SALTS = 64
#: Words a worker remembers the hash of.
REMEMBERED = 500_000


class Words:
    """64-bit hashes of words, remembered."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def hashes(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def cells(texts: list[str], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Unit cells of weighted shingle sets: the m-th occurrence of a shingle in a document is a cell of its own, so the
    weighted Jaccard similarity of two documents is the plain one of their cells. Returns cells and each one's document.

    Words are lower-case runs without white space; a text of fewer words than a shingle has is one shingle.
    """
    split = [t.lower().split() for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    hashed = words.hashes([w for x in split for w in x])
    if not len(hashed):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    padded = np.r_[hashed, np.zeros(SHINGLE - 1, np.uint64)]
    owner = np.repeat(np.arange(len(split)), n)
    begin = np.repeat(np.cumsum(n) - n, n)
    left = n[owner] - (np.arange(len(hashed)) - begin)  # words from here on
    gram = np.zeros(len(hashed), np.uint64)
    for i in range(SHINGLE):
        gram = mix64(gram * GOLDEN + np.where(left > i, padded[i : i + len(hashed)], np.uint64(0)) + np.uint64(i))
    take = (left >= SHINGLE) | ((np.arange(len(hashed)) == begin) & (n[owner] < SHINGLE))
    gram, owner = gram[take], owner[take]
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    new = np.r_[True, (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])]
    place = np.arange(len(gram))
    nth = place - np.maximum.accumulate(np.where(new, place, 0))
    return mix64(gram + nth.astype(np.uint64) * GOLDEN), owner


def darts(cell: np.ndarray, owner: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """Signatures (n_docs, k) of uint32: for each coordinate a digest of the earliest dart that fell on it.

    Every unit cell is a target for a Poisson stream of darts whose arrival times and coordinates are hashes of the cell
    alone, so documents that share a cell share its darts. A document with weight W needs the darts until about
    (k ln k + 2k) / W; coordinates still empty then are filled by doubling its time. Time spent follows the cells plus
    k ln k darts, not their product.
    """
    weight = np.bincount(owner, minlength=n_docs).astype(float)
    limit = (k * np.log(k) + 2 * k) / np.maximum(weight, 1)
    signature = np.zeros((n_docs, k), np.uint32)
    open_docs = weight > 0
    while open_docs.any():
        live = open_docs[owner]
        c, o = cell[live], owner[live]
        time, nth = np.zeros(len(c)), 0
        found_doc, found_at, found_time, found_dart = [], [], [], []
        while len(c):
            nth += 1
            u = mix64(c + np.uint64(nth * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF))
            time = time - np.log((u >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54)
            inside = time <= limit[o]
            c, o, time = c[inside], o[inside], time[inside]
            dart = mix64(u[inside] ^ GOLDEN)
            found_doc.append(o)
            found_at.append((dart % np.uint64(k)).astype(np.int64))
            found_time.append(time)
            found_dart.append((dart >> np.uint64(32)).astype(np.uint32))
        slot = np.concatenate(found_doc) * k + np.concatenate(found_at)
        when, dart = np.concatenate(found_time), np.concatenate(found_dart)
        first = np.full(n_docs * k, np.inf)
        np.minimum.at(first, slot, when)
        earliest = when == first[slot]
        flat = signature.reshape(-1)
        flat[slot[earliest]] = dart[earliest]
        filled = np.isfinite(first).reshape(n_docs, k).all(axis=1)
        open_docs &= ~filled
        limit = np.where(open_docs, limit * 2, limit)
    return signature


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(signature), bands), np.uint64)
    for r in range(rows):
        out = mix64(out * GOLDEN + signature[:, r::rows].astype(np.uint64) + np.uint64(r + 1))
    return mix64(out + np.arange(bands, dtype=np.uint64) * GOLDEN).view(np.int64)


def slices(texts: list[str], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about `most` characters."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if len(texts) > begin:
        yield begin, len(texts)


def signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, digest, bands) of every row, in one pass without shuffle; bands is empty for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in slices(texts):
                some = texts[lo:hi]
                cell, owner = cells(some, words)
                has = np.bincount(owner, minlength=len(some)) > 0
                keys = band_keys(darts(cell, owner, len(some), bands * rows), bands, rows)
                digest = pa.array([xxhash.xxh3_128_digest(t.encode()) for t in some], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(has, bands, 0))], pa.int32()), pa.array(keys[has].reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), digest, lists], ["key", "digest", "bands"])

    return docs.mapInArrow(run, "key long, digest binary, bands array<long>")


def shingled(docs: DataFrame) -> DataFrame:
    """(key, cells): the sorted cells of each row, cut to 32 bits each: enough to compare two documents. Over a corpus of
    billions of cells most of them meet one by chance, so solid_sizes() then bounds less, and rightly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in slices(texts):
                cell, owner = cells(texts[lo:hi], words)
                short = (cell >> np.uint64(32)).astype(np.uint32)
                ends = np.cumsum(np.bincount(owner, minlength=hi - lo))
                parts = [np.sort(x).tobytes() for x in np.split(short, ends[:-1])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(parts, pa.binary())], ["key", "cells"])

    return docs.mapInArrow(run, "key long, cells binary")


def shared_cells(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """How many cells each pair shares: all pairs' cells sorted at once, the pair's number above them."""
    pair = np.arange(len(a), dtype=np.uint64)
    sizes = [np.fromiter((len(x) >> 2 for x in side), np.int64, len(side)) for side in (a, b)]
    key = np.concatenate([np.frombuffer(b"".join(side), np.uint32).astype(np.uint64) | np.repeat(pair, n) << np.uint64(32) for side, n in zip((a, b), sizes, strict=True)])
    key.sort()
    twice = key[1:][key[1:] == key[:-1]] >> np.uint64(32)
    return np.bincount(twice.astype(np.int64), minlength=len(a))


@F.pandas_udf(DoubleType())
def similarity(a, b):
    """Weighted Jaccard similarity of two columns of sorted cells."""
    import pandas as pd

    a, b = a.tolist(), b.tolist()
    n = np.array([(len(x) + len(y)) >> 2 for x, y in zip(a, b, strict=True)], np.int64)
    common = np.zeros(len(a), np.int64)
    lo, held = 0, 0
    for i in range(len(a)):
        held += int(n[i])
        if held > 4_000_000 or i == len(a) - 1:
            common[lo : i + 1] = shared_cells(a[lo : i + 1], b[lo : i + 1])
            lo, held = i + 1, 0
    return pd.Series(common / np.maximum(n - common, 1), dtype="float64")


def components(edges: DataFrame) -> DataFrame:
    """(key, root) of every node of the undirected edges (a, b), root being the smallest key of its component.

    Large-star and small-star steps in turn; each round's edges go to the shared folder, so no lineage grows, and no
    list of neighbours is gathered: a star is a window minimum by partial aggregation and a join.
    """
    links = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        down = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u")
        links = staged(small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "links")
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = links.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("key"), "root").union(links.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct().join(roots.select(F.col("u").alias("key")), "key", "left_anti"))


def quick_labels(edges: DataFrame) -> DataFrame:
    """(key, root) of every node of the edges (a, b): the smallest node within a few steps. Equal roots are surely
    connected; different ones may be too. It costs a fraction of components()."""
    both = edges.select(F.col("a").alias("key"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("key"), F.col("a").alias("v")))
    one = both.groupBy("key").agg(F.least(F.min("v"), F.col("key")).alias("root"))
    two = one.join(one.select(F.col("key").alias("root"), F.col("root").alias("next")), "root").select("key", F.col("next").alias("root"))
    return two.join(two.select(F.col("key").alias("root"), F.col("root").alias("next")), "root").select("key", F.col("next").alias("root"))


def only(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of df whose key is among ids, which are broadcast if they are few enough by count."""
    n = ids.limit(BROADCAST_IDS + 1).count()
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids.hint("merge"), "key", "left_semi")


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, n, key): cells of a batch, how many of its documents have each, and one of them."""
    for b in batches:
        keys = b.column("key").to_numpy()
        cell = [np.frombuffer(x, np.uint32) for x in b.column("cells").to_pylist()]
        owner = np.repeat(keys, [len(x) for x in cell])
        found, first, n = np.unique(np.concatenate(cell), return_index=True, return_counts=True) if cell else (np.zeros(0, np.uint32), np.zeros(0, int), np.zeros(0, int))
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int32)), pa.array(n.astype(np.int64)), pa.array(owner[first].astype(np.int64))], ["cell", "n", "key"])


def solid_sizes(cell: DataFrame) -> DataFrame:
    """(key, size, solid): cells of a document, and those that another one has too."""
    single = cell.mapInArrow(counted, "cell int, n long, key long").groupBy("cell").agg(F.sum("n").alias("n"), F.min("key").alias("key")).where("n = 1")
    alone = single.groupBy("key").agg(F.count(F.lit(1)).alias("alone"))
    size = (F.octet_length("cells") / 4).cast("int")
    return cell.select("key", size.alias("size")).join(alone, "key", "left").select("key", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).cast("int").alias("solid"))


def within_reach_by_head(threshold: float):
    """Whether a head h and a member x of one bucket can reach the threshold, by what both share with the bucket's first
    member b: |h & x| <= min(|h & b|, |x & b|) + the fewer of their other cells that more than one document has. Where
    one of them was never compared with b, the first bound alone holds."""
    other = lambda solid, common: F.greatest(F.col(solid) - F.col(common), F.lit(0))
    most = F.least("hc", "common") + F.least(other("hs", "hc"), other("solid", "common"))
    unknown = F.col("hc").isNull() | F.col("common").isNull()
    most = F.when(unknown, F.least("hs", "solid")).otherwise(F.least("hs", "solid", most))
    return most >= threshold * (F.col("hz") + F.col("size") - most) - 1e-9


def within_reach(size: str, solid: str, other_size: str, other_solid: str, threshold: float):
    """Whether two documents can reach the threshold: they share no more cells than either has in common with any."""
    most = F.least(solid, other_solid)
    return most >= threshold * (F.col(size) + F.col(other_size) - most) - 1e-9


def links(texts: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Verified links (a, b) whose components are those of all pairs that share a band and reach the threshold.

    Each bucket is compared with its smallest member first. Then only pairs of one bucket that aren't known to be
    connected still matter. Members outside the bucket's main component become heads, more of them each round, and a
    head is compared with all its bucket's members under other labels. So no link that could join two classes is lost,
    while copies and near copies of one text cost a comparison each. Pairs that can't reach the threshold, because too
    many cells of one are in no other document, are never formed. reps: (key, bands).
    """
    band = reps.select("key", F.posexplode("bands").alias("band", "bucket"))
    size = band.groupBy("band", "bucket").agg(F.min("key").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    band = staged(band.join(size, ["band", "bucket"]).select("key", "band", "bucket", "head"), "bands")
    ids = staged(band.select("key").distinct(), "ids")
    cell = staged(shingled(only(texts, ids)), "cells")
    sizes = staged(solid_sizes(cell), "sizes")
    pairs = band.where("key <> head").select(F.col("head").alias("a"), F.col("key").alias("b")).distinct()
    pairs = pairs.join(sizes.select(F.col("key").alias("a"), F.col("size").alias("za"), F.col("solid").alias("sa")), "a").join(sizes.select(F.col("key").alias("b"), F.col("size").alias("zb"), F.col("solid").alias("sb")), "b")
    pairs = pairs.where(within_reach("za", "sa", "zb", "sb", threshold)).select("a", "b")
    done = served = member = None
    heads = 16
    while True:
        sides = pairs.join(cell.select(F.col("key").alias("a"), F.col("cells").alias("ca")), "a").join(cell.select(F.col("key").alias("b"), F.col("cells").alias("cb")), "b")
        tested = staged(sides.select("a", "b", similarity("ca", "cb").alias("similarity")), "pairs")
        if done is None:
            # What each member shares with the first of its bucket, as far as they were compared.
            with_head = band.join(tested.select(F.col("a").alias("head"), F.col("b").alias("key"), "similarity"), ["head", "key"], "left").join(sizes, "key")
            head_size = sizes.select(F.col("key").alias("head"), F.col("size").alias("head_size"))
            both = F.col("size") + F.col("head_size")
            common = F.when(F.col("key") == F.col("head"), F.col("size")).otherwise(F.round(F.col("similarity") * both / (1 + F.col("similarity"))).cast("int"))
            with_head = with_head.where(F.col("solid") >= threshold * F.col("size") - 1e-9).join(head_size, "head")
            every = reps.select("key", "bands")
            # A row for each document with its buckets, BANDS at most, so labels are joined to documents.
            place = F.struct("band", "bucket", common.alias("common"))
            member = staged(with_head.groupBy("key", "size", "solid").agg(F.collect_list(place).alias("places")).join(every, "key"), "compared")
        done = tested if done is None else done.unionByName(tested)
        good = done.where(F.col("similarity") >= threshold).select("a", "b")
        label = quick_labels(good)
        labelled = member.join(label, "key", "left").select("key", "size", "solid", "bands", F.coalesce("root", "key").alias("label"), F.explode("places").alias("place"))
        rows = labelled.select("place.band", "place.bucket", "key", "size", "solid", "place.common", "bands", "label")
        mixed = rows.groupBy("band", "bucket").agg(F.min("label").alias("main"), F.max("label").alias("top")).where("main <> top").select("band", "bucket", "main")
        rows = staged(rows.join(mixed, ["band", "bucket"]), "mixed")
        # A bucket under one label is connected and done with.
        member = rows.groupBy("key", "size", "solid").agg(F.collect_list(F.struct("band", "bucket", "common")).alias("places"), F.first("bands").alias("bands"))
        open_rows = rows.where("label <> main")
        if served is not None:
            open_rows = open_rows.join(served, ["band", "bucket", "key"], "left_anti")
        in_bucket = Window.partitionBy("band", "bucket").orderBy("key")
        chosen = staged(open_rows.withColumn("r", F.row_number().over(in_bucket)).where(F.col("r") <= heads).drop("r", "main"), "heads")
        if chosen.isEmpty():
            return good
        now = chosen.select("band", "bucket", "key")
        served = now if served is None else served.unionByName(now)
        heads *= 8
        head = chosen.select("band", "bucket", F.col("key").alias("h"), F.col("label").alias("hl"), F.col("size").alias("hz"), F.col("solid").alias("hs"), F.col("common").alias("hc"), F.col("bands").alias("hb"))
        # A pair is formed in the first band it shares: there one of the two is or will be a head, too.
        first = F.array_position(F.zip_with("hb", "bands", lambda x, y: x == y), True) - 1 == F.col("band")
        wide = head.join(rows, ["band", "bucket"]).where(F.col("hl") != F.col("label")).where(within_reach_by_head(threshold)).where(first)
        pairs = wide.select(F.least("h", "key").alias("a"), F.greatest("h", "key").alias("b")).distinct().join(done.select("a", "b"), ["a", "b"], "left_anti")


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id) of every id: class_id is the smallest id of the documents linked to it.

    Exact copies share the class of their first; different texts are linked where the weighted Jaccard similarity of
    their 5-word shingles reaches the threshold; classes are the connected components. Null and empty texts, and texts of white space, are near only to texts equal to them. Rows
    with a null id are left out, since no class can name them; rows that repeat an id count as one document, with the
    text that sorts first by its digest. Other columns are left out.
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows_ = staged(signed(texts, bands, rows), "signed")
    each = rows_.groupBy("key").agg(F.min_by("digest", "digest").alias("digest"))
    # Copies of one text in any number: folded by digest and salt, and joined back by both, so no task gets them all.
    each = each.withColumn("salt", F.pmod("key", F.lit(COPY_SALTS)))
    some = each.groupBy("digest", "salt").agg(F.min("key").alias("least"))
    first = some.join(some.groupBy("digest").agg(F.min("least").alias("rep")), "digest").select("digest", "salt", "rep")
    member = staged(each.join(first, ["digest", "salt"]).select("key", "rep", "digest"), "members")
    reps = rows_.join(member.where("key = rep").select("key", "digest"), ["key", "digest"], "left_semi").dropDuplicates(["key"]).where(F.size("bands") > 0).select("key", "bands")
    root = components(links(texts, reps, threshold))
    out = member.join(root.select(F.col("key").alias("rep"), "root"), "rep", "left")
    return out.select(F.col("key").alias("doc_id"), F.coalesce("root", "rep").alias("class_id"))


def keep_first(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Rows of docs, with their own columns, that are the first of their class of near duplicates, by id.

    Rows without an id stay. Of rows that repeat an id one stays, the least by its text. The text moves only where more
    ids go than can be broadcast.
    """
    classes = staged(near_duplicates(docs, threshold), "classes")
    gone = classes.where("doc_id <> class_id").select("doc_id")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    left = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
    twice = staged(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return left
    few = twice.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    twice = F.broadcast(twice) if few else twice
    again = left.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("row")).select("row.*")
    return left.join(twice, "doc_id", "left_anti").unionByName(again)
