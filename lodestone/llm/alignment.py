"""Alignment of two tokenizers' tokens, with corpus-wide counts of the pairs that end together (operator 11)."""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, staged
from .packing import Encoder
from .tokens import byte_alphabet

#: Distinct pairs that a task holds before it hands on what it has counted.
HELD_PAIRS = 4_000_000
#: Links counted or looked up at a time.
LINKS = 1_000_000
#: Pairs of one shard file.
SHARD_PAIRS = 4_000_000
TOKEN_SCHEMA = "key long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"
#: How a document's links are staged: A's ids, then B's, in so many bytes each.
ID_TYPE = {True: np.dtype("<u2"), False: np.dtype("<u4")}


class Plain(Encoder):
    """ids of a byte-level BPE that takes its special tokens' strings for plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        back = {c: b for b, c in byte_alphabet().items()}
        self.bytes = [b""] * len(self.ends)
        for k, v in vocab.items():
            self.bytes[v] = bytes(back[c] for c in k) if all(c in back for c in k) else k.encode()

    def ids(self, text: str) -> np.ndarray:
        if self.long.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=())


class Pieces:
    """ids of a sentencepiece model and the bytes its pieces stand for."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.model.id_to_piece, range(n)))]

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.uint32)


class Aligner:
    """Encodes a text both ways and cuts the tokens into groups where both have an end."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Plain(path_a), Pieces(path_b)
        self.size = [np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b)]
        # Each id with the mark that may follow it in a group's text; B's ids come after A's.
        self.shift = 3 * len(self.a.bytes)
        self.id_type = ID_TYPE[max(len(self.a.bytes), len(self.b.bytes)) <= 1 << 16]
        self.told = [f"{i}{mark}" for i in range(len(self.a.bytes)) for mark in ",|;"] + [f"{i}{mark}" for i in range(len(self.b.bytes)) for mark in ",|;"]

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Both encodings; None where the text is null or empty, or its tokens don't spell it."""
        if not text:
            return None
        spaced = f" {text}"
        raw = spaced.encode()
        a, b = self.a.ids(spaced), self.b.ids(text)
        for ids, table in ((a, self.a.bytes), (b, self.b.bytes)):
            if b"".join(map(table.__getitem__, ids.tolist())) != raw:
                return None
        return a, b

    def ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the A and of the B tokens that end together, in order. A token without bytes would end where
        the one before it does; neither kind of file has one, as each piece has a character."""
        end_a, end_b = np.cumsum(self.size[0][a]), np.cumsum(self.size[1][b])
        at = np.searchsorted(end_b, end_a)
        both = end_b[at] == end_a
        return np.flatnonzero(both), at[both]

    def digest(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """Of all groups as text: A's ids with commas, a bar, B's ids with commas; semicolons between groups."""
        mark_a, mark_b = 3 * a.astype(np.int64), self.shift + 3 * b.astype(np.int64)
        mark_a[last_a] += 1
        mark_b[last_b] += 2
        # An A token stands behind the B tokens of the groups before its own; a B token behind the A tokens up to its group's end.
        group_a = np.searchsorted(last_a, np.arange(len(a)))
        group_b = np.searchsorted(last_b, np.arange(len(b)))
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.r_[0, last_b + 1][group_a]] = mark_a
        order[np.arange(len(b)) + (last_a + 1)[group_b]] = mark_b
        return hashlib.sha256("".join(map(self.told.__getitem__, order.tolist()))[:-1].encode()).hexdigest()


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def packed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One int64 for each pair; B's id leads, so that a sort brings the pairs of a B id together."""
    return b.astype(np.int64) << 32 | a.astype(np.int64)


def unpacked(links: pa.Scalar, id_type: np.dtype) -> np.ndarray:
    """Pair keys of staged links."""
    ids = np.frombuffer(links.as_buffer(), id_type)
    return packed(ids[: len(ids) // 2], ids[len(ids) // 2 :])


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, each once, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts[order], first)


def pair_counts(tokens: DataFrame, vocabulary_a: str, vocabulary_b: str) -> DataFrame:
    """(pair, n): counts of each partition's links, np.unique over some millions at a time; a task's sums are handed on
    when they have grown to HELD_PAIRS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = aligner(vocabulary_a, vocabulary_b).id_type
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []
        size = 0

        def counted() -> tuple[np.ndarray, np.ndarray]:
            if not waiting:
                return keys, counts
            new, n = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            return summed(np.concatenate([keys, new]), np.concatenate([counts, n])) if len(keys) else (new, n)

        for b in batches:
            for data in b.column(0):
                links = unpacked(data, id_type)
                for i in range(0, len(links), LINKS):
                    waiting.append(links[i : i + LINKS])
                    size += len(waiting[-1])
                    if size >= LINKS:
                        (keys, counts), size = counted(), 0
                if len(keys) > HELD_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])
                    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, counts = counted()
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])

    return tokens.where(F.length("links") > 0).select("links").mapInArrow(run, "pair long, n long")


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def kept_shards(counts: DataFrame, folder: str) -> DataFrame:
    """Writes the pairs, range-partitioned and sorted by Spark, run by run summed, as shards in the folder; a row for each
    shard with its bounds and, for each B id in it, the highest count.

    A shard is one array of keys and counts in numpy's format. It is written under a name of its own and then renamed;
    a task that runs again writes the same shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(folder)
        held_keys: list[np.ndarray] = []
        held_counts: list[np.ndarray] = []

        def shard() -> pa.RecordBatch:
            keys, counts = np.concatenate(held_keys), np.concatenate(held_counts)
            held_keys.clear()
            held_counts.clear()
            own, name = f"{base}/.{uuid.uuid4().hex}", f"pairs-{int(keys[0]):016x}.npy"
            out = io.BytesIO()
            np.save(out, np.stack([keys, counts]))
            with fs.open_output_stream(own) as f:
                f.write(out.getbuffer())
            fs.move(own, f"{base}/{name}")
            first = np.flatnonzero(np.r_[True, keys[1:] >> 32 != keys[:-1] >> 32])
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([int(keys[0])]), pa.array([int(keys[-1])]), pa.array([(keys[first] >> 32).tobytes()], pa.binary()), pa.array([np.maximum.reduceat(counts, first).tobytes()], pa.binary())],
                ["name", "low", "high", "heads", "tops"],
            )

        for b in batches:
            if not len(b):
                continue
            keys, counts = b.column(0).to_numpy(), b.column(1).to_numpy()
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            keys, counts = keys[first], np.add.reduceat(counts, first)
            if held_keys and held_keys[-1][-1] == keys[0]:  # a run goes on in this batch
                held_counts[-1] = np.r_[held_counts[-1][:-1], held_counts[-1][-1] + counts[0]]
                keys, counts = keys[1:], counts[1:]
            if len(keys):
                if sum(map(len, held_keys)) >= SHARD_PAIRS:
                    yield shard()
                held_keys.append(keys)
                held_counts.append(counts)
        if held_keys:
            yield shard()

    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = counts.repartitionByRange(n, "pair").sortWithinPartitions("pair")
    return ordered.mapInArrow(run, "name string, low long, high long, heads binary, tops binary")


class Shards:
    """Sorted count shards, each mapped into memory while it is asked (read whole, one at a time, where the shared folder
    is in a store that can't be mapped)."""

    def __init__(self, folder: str, names: list[str], low: np.ndarray, high: np.ndarray):
        self.folder, self.names, self.low, self.high = folder, names, low, high
        self.fs, self.base = opened(folder)
        self.map = lru_cache(maxsize=None if isinstance(self.fs, pafs.LocalFileSystem) else 1)(self.load)

    def load(self, name: str) -> np.ndarray:
        if isinstance(self.fs, pafs.LocalFileSystem):
            return np.load(f"{self.base}/{name}", mmap_mode="r")
        with self.fs.open_input_file(f"{self.base}/{name}") as f:
            return np.load(io.BytesIO(f.read()))

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted keys, all of which have been counted."""
        out = np.zeros(len(keys), np.int64)
        begin, end = np.searchsorted(keys, self.low), np.searchsorted(keys, self.high, "right")
        for k in np.flatnonzero(begin < end).tolist():
            table, part = self.map(self.names[k]), slice(begin[k], end[k])
            out[part] = table[1][np.searchsorted(table[0], keys[part])]
        return out


def aligned(docs: DataFrame, vocabulary_a: str, vocabulary_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's groups of tokens of two tokenizers, and how its links stand in the corpus: id, n_a, n_b, n_groups,
    n_links, n_best, count_sum, groups_sha256, and links (binary: A's ids, then B's, two bytes each, or four if a vocabulary
    has over 65,536 entries).

    vocabulary_a: a byte-level BPE file of tokenizers, used on a space and the text; vocabulary_b: a sentencepiece model
    that adds the space itself. Tokens of both end together where their bytes do; there a link joins them, and the
    tokens between two such places are a group. n_best counts the links whose id pair no other pair of the same B id
    outdoes in the whole corpus.

    Each text is encoded once; its links are staged in the shared folder, counted by partition, sorted by range, summed
    run by run into shards, and looked up there. The driver sees a row for each shard and the highest count of each B
    id, which B's vocabulary bounds. Null or empty texts, and texts that the tokens' bytes don't spell (some character
    that a model changes), have no tokens: zeros and an empty digest. Null ids stay null, repeated rows stay repeated and
    count each time; other columns are left out; an empty table stays empty.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(vocabulary_a, vocabulary_b)
        names = [x.split()[0] for x in TOKEN_SCHEMA.split(", ")]

        def out(keys: list, rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string()), pa.array(columns[5], pa.binary())], names)

        for b in batches:
            keys, rows, held = [], [], 0
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = both.tokens(text)
                keys.append(key)
                if found is None:
                    rows.append((0, 0, 0, 0, "", b""))
                else:
                    last_a, last_b = both.ends(*found)
                    links = np.r_[found[0][last_a], found[1][last_b]].astype(both.id_type)
                    rows.append((len(found[0]), len(found[1]), len(last_a), len(last_a), both.digest(*found, last_a, last_b), links.tobytes()))
                    held += len(last_a)
                if held > LINKS:
                    yield out(keys, rows)
                    keys, rows, held = [], [], 0
            if keys:
                yield out(keys, rows)

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    tokens = staged(rows.mapInArrow(encode, TOKEN_SCHEMA), "tokens", "zstd")
    folder = scratch(spark, "shards")
    shards = sorted(kept_shards(staged(pair_counts(tokens, vocabulary_a, vocabulary_b), "pairs"), folder).collect(), key=lambda r: r["low"])
    names = [r["name"] for r in shards]
    low, high = (np.array([r[c] for r in shards], np.int64) for c in ("low", "high"))
    heads = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["heads"], np.int64) for r in shards)])
    tops = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["tops"], np.int64) for r in shards)])
    if len(heads):  # a B id's pairs may go on in the next shard
        first = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]])
        heads, tops = heads[first], np.maximum.reduceat(tops, first)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, id_type = Shards(folder, names, low, high), aligner(vocabulary_a, vocabulary_b).id_type

        def of(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            keys, where = np.unique(links, return_inverse=True)
            counts = table.counts(keys)
            return counts[where], (counts == tops[np.searchsorted(heads, keys >> 32)])[where]

        for b in batches:
            size = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index("links"))), 0).to_numpy(zero_copy_only=False) // (2 * id_type.itemsize)
            done = np.cumsum(size) // LINKS  # some documents at a time
            for part in np.split(np.arange(len(b)), np.flatnonzero(np.diff(done)) + 1):
                if not len(part):
                    continue
                some = b.slice(part[0], len(part))
                ends = np.r_[0, np.cumsum(size[part])]
                links = np.concatenate([unpacked(x, id_type) for x in some.column(some.schema.get_field_index("links"))])
                count, best = of(links)
                total, best = np.r_[0, np.cumsum(count)], np.r_[0, np.cumsum(best, dtype=np.int64)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(best[ends[1:]] - best[ends[:-1]]), pa.array(total[ends[1:]] - total[ends[:-1]])], [*b.schema.names, "n_best", "count_sum"])

    told = tokens.mapInArrow(look_up, TOKEN_SCHEMA + ", n_best long, count_sum long")
    return told.select(F.col("key").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "links")
