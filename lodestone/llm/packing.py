"""Order-preserving packing of token streams by dynamic programming (operator 10)."""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import PRE_TOKEN, byte_alphabet, checked

#: Penalties in padding tokens: what a cut at a sentence end, or at any other place within a document, may cost.
SENTENCE_CUT, HARD_CUT = 4, 12
#: Stretches without a sentence end for so many tokens get hard cuts at this distance.
LONG_GAP, HARD_STEP = 256, 32
#: Tokens of one dynamic program; the window left open at its end begins the next one.
BLOCK = 1 << 19
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SENTENCE_ENDS = (b".", b"!", b"?", b"\n")


def in_id_order(spec: dict) -> dict:
    """The tokenizer file if its merges make tokens of rising ids, each by one merge only, else an error. Then the lowest
    rank of a merge is the lowest id of what it makes, which is the order in which tiktoken merges."""
    vocab = spec["model"]["vocab"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if any(a >= b for a, b in zip(made, made[1:], strict=False)):
        raise ValueError("the order of the merges isn't the order of the ids they make")
    return spec


class Encoder:
    """ids of a byte-level BPE. tiktoken merges with the ranks of the same vocabulary, which gives the same ids in a fifth
    of the time; texts with runs over LONG_RUN characters without white space go to tokenizers, which is quicker there."""

    LONG_RUN = 2000

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = in_id_order(checked(json.load(f)))
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        back = {c: b for b, c in byte_alphabet().items()}
        ranks = {bytes(back[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in added}
        self.fast = tiktoken.Encoding("packing", pat_str=PRE_TOKEN.replace("(?:[sdmt]|ll|ve|re)", "s|'t|'re|'ve|'m|'ll|'d"), mergeable_ranks=ranks, special_tokens=added)
        self.whole, self.added = Tokenizer.from_file(path), set(added)
        self.long = re.compile(r"(?<!\S)\S{%d}|(?<!\s)\s{%d}" % (self.LONG_RUN, self.LONG_RUN))
        ends = np.zeros(max([*ranks.values(), *added.values()]) + 1, bool)
        for k, v in ranks.items():
            ends[v] = k.endswith(SENTENCE_ENDS)
        self.ends = ends

    def ids(self, text: str) -> np.ndarray:
        if self.long.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special=self.added, disallowed_special=())


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut_points(bounds: np.ndarray, sentence: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places where a window may end, with the penalty of each; 0 and total are among them."""
    soft = np.union1d(np.union1d(bounds, sentence), [0, total])
    gap = np.flatnonzero(np.diff(soft) > LONG_GAP)
    hard = [np.arange(soft[g] + HARD_STEP, soft[g + 1], HARD_STEP) for g in gap]
    points = np.union1d(soft, np.concatenate(hard)) if hard else soft
    penalty = np.full(len(points), HARD_CUT, np.int64)
    penalty[np.searchsorted(points, sentence)] = SENTENCE_CUT
    penalty[np.searchsorted(points, bounds)] = 0
    penalty[[0, -1]] = 0
    return points, penalty


def best_cuts(points: list[int], penalty: list[int], window: int) -> list[int]:
    """Cuts of least padding plus penalties. cost of (i, j] is window - (p_j - p_i), 0 if that length is a power of two.

    The ends of windows go forward; f_i + p_i of those within reach stand in a monotone queue, whose head is the best
    padded transition. Lengths that are powers of two are looked up besides.
    """
    n, where = len(points), np.asarray(points)
    exact: dict[int, list[int]] = {}  # end -> begins of windows whose length is a power of two
    for p in (1 << b for b in range(window.bit_length())):
        k = np.searchsorted(where, where - p)
        for j in np.flatnonzero((where >= p) & (where[k] == where - p)).tolist():
            exact.setdefault(j, []).append(int(k[j]))
    best, back = [0] * n, [0] * n
    queue: deque[tuple[int, int, int]] = deque([(points[0], 0, points[0])])  # (f_i + p_i, i, p_i), rising
    for j, at in enumerate(points[1:], 1):
        while queue[0][2] < at - window:
            queue.popleft()
        value, i, _ = queue[0]
        value += window - at
        if j in exact:
            for k in exact[j]:
                if best[k] < value:
                    value, i = best[k], k
        value += penalty[j]
        best[j], back[j] = value, i
        key = value + at
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j, at))
    cuts, j = [], n - 1
    while j:
        cuts.append(points[j])
        j = back[j]
    return cuts[::-1]


class Packer:
    """Packs documents in order as they come; holds a block of tokens at most, besides the document that overruns it."""

    def __init__(self, window: int, first_id: int):
        self.window, self.next_id = window, first_id
        self.held: list[tuple[int | None, np.ndarray, int, int]] = []  # doc, ids, start within the document, its tokens
        self.sentences: list[np.ndarray] = []
        self.size = 0

    def add(self, doc: int | None, ids: np.ndarray, sentences: np.ndarray) -> Iterator[list]:
        total = len(ids)
        for a in range(0, total, BLOCK):
            part = ids[a : a + BLOCK]
            self.sentences.append(sentences[(sentences > a) & (sentences <= a + len(part))] - a + self.size)
            self.held.append((doc, part, a, total))
            self.size += len(part)
            if self.size >= BLOCK:
                yield from self.flush(last=False)

    def flush(self, last: bool) -> Iterator[list]:
        if not self.size:
            return
        ends = np.cumsum([len(x[1]) for x in self.held])
        whole = np.array([x[2] + len(x[1]) == x[3] for x in self.held])
        sentence = np.concatenate(self.sentences)
        points, penalty = cut_points(ends[whole], sentence[sentence < self.size], self.size)
        cuts = best_cuts(points.tolist(), penalty.tolist(), self.window)
        if last and cuts:  # the last window in powers of two needs no padding
            a = cuts[-2] if len(cuts) > 1 else 0
            rest = cuts[-1] - a
            cuts[-1:] = [a + sum(1 << b for b in range(rest.bit_length() - 1, k - 1, -1) if rest >> b & 1) for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
        elif len(cuts) > 1:
            cuts.pop()
        elif not last:
            return
        begins = ends - np.array([len(x[1]) for x in self.held])
        a = 0
        ends_list = ends.tolist()
        for b in cuts:
            k = bisect_left(ends_list, a + 1)
            place = a
            while place < b:
                doc, ids, start, total = self.held[k]
                lo, hi = place - int(begins[k]), min(b, ends_list[k]) - int(begins[k])
                yield [doc, start + lo, hi - lo, zlib.crc32(ids[lo:hi].astype("<u4").tobytes()), total, self.next_id, place - a]
                place += hi - lo
                k += 1
            self.next_id += 1
            a = b
        keep = []
        for (doc, ids, start, total), lo in zip(self.held, begins.tolist(), strict=True):
            if lo + len(ids) > a:
                skip = max(0, a - lo)
                keep.append((doc, ids[skip:], start + skip, total))
        self.held, self.sentences, self.size = keep, [sentence[sentence > a] - a], self.size - a


def pack(docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most `window` tokens; columns of PIECE_SCHEMA.

    Each input partition is one stream in its own order, cut into windows that end at document or sentence ends where
    that costs little padding; no shuffle, and only a block of tokens in memory. Sequence ids hold the partition in
    their upper bits, so a task that runs again gives the same ids. The last window of a stream is cut in powers of two.
    Null and empty texts are a document of the end id alone. Repeated rows are packed each on its own, null ids stay
    null; other columns are left out; an empty table gives no pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        packer = Packer(window, TaskContext.get().partitionId() << 40)

        def out(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [x.split()[0] for x in PIECE_SCHEMA.split(", ")])

        rows: list[list] = []
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(enc.ids(text), np.uint32(end_id))
                ends = np.flatnonzero(enc.ends[ids[:-1]]) + 1
                rows += packer.add(doc, ids, ends)
            if len(rows) > 5000:
                yield out(rows)
                rows = []
        rows += packer.flush(last=True)
        if rows:
            yield out(rows)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, PIECE_SCHEMA)
