"""Token counts of a byte-level BPE by rank-synchronous array merging (operator 8)."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-token pattern of byte-level BPE (a fixed value of the public format).
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens whose counts a worker remembers; beyond that it starts anew, so memory stays bounded.
REMEMBERED = 400_000
#: Bytes of distinct pre-tokens merged in one round of arrays.
ROUND_BYTES = 4_000_000
#: Pre-tokens of more bytes are merged with lists of places by rank, so that a round costs what it merges.
LONG_PIECE = 256
#: Where a text may be cut between two pre-tokens: before a lone space.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[int, str]:
    """Byte -> printable character of the byte-level format: printable bytes stand for themselves, the others follow from U+0100."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


def checked(spec: dict) -> dict:
    """The tokenizer file if all of it is what this module computes, else an error."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += [k for k, v in (("normalizer", None), ("truncation", None), ("padding", None)) if spec.get(k) != v]
    if model.get("type", "BPE") != "BPE":
        odd.append("model type")
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        odd.append("pre_tokenizer")
    odd += [f"added token {t['content']!r}" for t in spec.get("added_tokens", []) if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]
    if odd:
        raise ValueError(f"not a plain byte-level BPE: {', '.join(odd)}")
    return spec


class Merges:
    """The merge table as arrays: symbols are vocabulary ids, pairs are sorted keys with rank and result."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = checked(json.load(f))
        vocab = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left = np.fromiter((vocab[a] for a, _ in pairs), np.int64, len(pairs))
        self.right = np.fromiter((vocab[b] for _, b in pairs), np.int64, len(pairs))
        self.result = np.fromiter((vocab[a + b] for a, b in pairs), np.int32, len(pairs))
        self.size = max(vocab.values()) + 1
        made_at = np.full(self.size, -1)
        made_at[self.result[::-1]] = np.arange(len(pairs))[::-1]
        if len(pairs) and (np.maximum(made_at[self.left], made_at[self.right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge comes before one that makes its parts")
        key = self.left * self.size + self.right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int32), self.result[order]
        alphabet = byte_alphabet()
        self.of_byte = np.array([vocab[alphabet[b]] for b in range(256)], np.int32)
        self.special = {t["content"] for t in spec.get("added_tokens", [])}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; the number of merges where there is none."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], len(self.rank))

    def long_counts(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each piece, as counts() has them. The places of each rank's pairs are listed, and the lowest rank of
        all pieces is merged at all its places at once; only the pairs beside them change."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        symbols = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[ends - lengths] = -1, -1
        alive = np.ones(n, bool)
        none = len(self.rank)
        places: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def add(at: np.ndarray) -> None:
            rank = self.ranks(symbols[at], symbols[after[at]])
            at, rank = at[rank < none], rank[rank < none]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            edges = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1], True]) if len(rank) else np.zeros(1, np.int64)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                r = int(rank[a])
                if r not in places:
                    places[r] = []
                    heapq.heappush(queue, r)
                places[r].append(at[a:b])

        add(np.flatnonzero(after >= 0))
        while queue:
            r = heapq.heappop(queue)
            lists = places.pop(r)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            at = at[alive[at] & (symbols[at] == self.left[r]) & (after[at] >= 0)]
            at = at[symbols[after[at]] == self.right[r]]
            if not len(at):
                continue
            if self.left[r] == self.right[r]:  # of pairs that overlap every second one counts, from the left
                run = np.r_[True, after[at[:-1]] != at[1:]]
                at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))) % 2 == 0]
            gone = after[at]
            symbols[at] = self.result[r]
            alive[gone] = False
            beyond = after[gone]
            after[at] = beyond
            inner = beyond >= 0
            before[beyond[inner]] = at[inner]
            add(np.unique(np.concatenate([at[inner], before[at][before[at] >= 0]])))
        return np.add.reduceat(alive.astype(np.int64), ends - lengths)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each piece. Every round merges, in all pieces at once, each piece's pair of lowest rank."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        done = lengths.copy()
        symbols = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(n), lengths)
        none = np.int32(len(self.rank))
        while len(symbols) > 1:
            key = symbols[:-1].astype(np.int64) * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            pair_rank = np.where((self.key[at] == key) & (owner[:-1] == owner[1:]), self.rank[at], none)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(np.r_[pair_rank, none], starts)
            size = np.diff(np.r_[starts, len(symbols)])
            best = np.repeat(lowest, size)[:-1]
            hit = np.flatnonzero((pair_rank == best) & (best < none))
            if not len(hit):
                done[owner[starts]] = size
                break
            # Of hits that overlap (the pair of a symbol with itself) every second one counts, from the left.
            run = np.r_[True, np.diff(hit) != 1]
            hit = hit[(np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))) % 2 == 0]
            symbols[hit] = self.made[at[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            still = lowest < none
            if not still.all():  # pieces without a pair leave the arrays
                done[owner[starts[~still]]] = size[~still]
                keep &= np.repeat(still, size)
            symbols, owner = symbols[keep], owner[keep]
        else:
            if len(symbols):
                done[owner] = 1
        return done


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


class Counter:
    """Counts tokens of texts; remembers pre-tokens it has merged."""

    def __init__(self, path: str):
        self.table, self.known = merges(path), {}
        self.pattern = regex.compile(PRE_TOKEN)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(self.table.special, key=len, reverse=True))) if self.table.special else None

    def learn(self, new: list[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known = {}
        for counts, some in ((self.table.counts, [p for p in new if len(p) <= LONG_PIECE]), (self.table.long_counts, [p for p in new if len(p) > LONG_PIECE])):
            batch, held = [], 0
            for i, piece in enumerate(some):
                batch.append(piece.encode())
                held += len(batch[-1])
                if held > ROUND_BYTES or i == len(some) - 1:
                    self.known.update(zip(some[i + 1 - len(batch) : i + 1], counts(batch).tolist(), strict=True))
                    batch, held = [], 0

    def count(self, texts: list[str]) -> list[int]:
        parts, extra = [], []
        for text in texts:
            if self.special is not None and (found := len(self.special.findall(text))):
                parts.append([p for x in self.special.split(text) for p in self.pattern.findall(x)])
                extra.append(found)
            else:
                parts.append(self.pattern.findall(text))
                extra.append(0)
        new = list({p for x in parts for p in x}.difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = list({p for x in parts for p in x})
        if new:
            self.learn(new)
        known = self.known
        return [sum(map(known.__getitem__, x)) + e for x, e in zip(parts, extra, strict=True)]


def in_slices(texts: list[str], most: int = 1_000_000) -> Iterator[list[tuple[int, str]]]:
    """Consecutive slices of numbered texts of about `most` characters; a longer text comes in several, cut where no
    pre-token is, before a lone space."""
    held, size = [], 0
    for i, t in enumerate(texts):
        a = 0
        while len(t) - a > most and (m := BETWEEN.search(t, a + most)):
            yield [(i, t[a : m.start()])]
            a = m.start()
        rest = t[a:] if a else t
        if held and size + len(rest) > most:
            yield held
            held, size = [], 0
        held.append((i, rest))
        size += len(rest)
    if held:
        yield held


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row; no shuffle; memory is a batch of texts, the pre-tokens of a slice of them
    (or of the longest stretch without a lone space), and REMEMBERED counts.

    vocabulary: path of a byte-level BPE file in the tokenizers format. Strings of its added tokens inside a text count
    as one token each; no other token is added. Null and empty texts have 0 bytes and 0 tokens. Null ids stay null;
    repeated rows stay repeated; other columns are left out; an empty table stays empty. A file that is no plain
    byte-level BPE is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [0] * len(texts)
            for some in in_slices(texts):
                for (i, _), c in zip(some, counter.count([t for _, t in some]), strict=True):
                    n[i] += c
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64())], ["key", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "key long, n_bytes long, n_tokens long").withColumnRenamed("key", id_col)
