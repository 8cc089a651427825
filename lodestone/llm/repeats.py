"""Removal of long repeated byte strings by run-length indexes (operator 1).

Equal strings of `length` bytes have equal anchors, the leftmost least hash of their inner 16-byte strings, wherever they
stand. So documents are cut into segments of neighbouring windows with one anchor. First only hashes of the segments
meet, by anchor, and tell which can hold anything shared: a window of 50 bytes holds the anchor and at least 17 bytes
beside it on one side, so one of two hashes of 33 bytes must be shared. Then the text of those segments meets: of each
anchor the text of the smallest document goes into a run-length index, and the anchor's other texts are streamed through
it. Work and shuffle are linear in the text; no pairs of documents are formed.

Hot passages are folded before they meet. A task that has seen a hash in two documents says so once and passes the
segments with it on at once; a segment equal to one that the task has sent for a smaller document goes as a whole, without
being sent. So what meets of a passage that all documents hold grows with the tasks, not with the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, staged
from .lines import NO_ID
from .runindex import first_owners, ranges

LENGTH, ANCHOR = 50, 16
#: Bytes of text hashed at once in a task (longer texts go in overlapping pieces), of text whose hashes meet in a task,
#: and of segments' text for one index.
BATCH_BYTES, SKETCH_BYTES, INDEX_BYTES = 2_000_000, 16_000_000, 5_000_000
#: Ids that are broadcast at most (some 75 MB as a hash table); beyond that the join shuffles.
BROADCAST_IDS = 500_000
#: Segments of a batch with one hash from which on it is told once for all; sent texts that a task remembers.
HOT, REMEMBERED = 8, 300_000
#: Segments alike in all hashes that follow one another in a document, as in a text of one letter, go as one, so many at most.
ALIKE = 32
SKETCHES = "part int, about binary, n int"
SEGMENTS = "part int, texts binary, about binary, n int"
CANDIDATES = "id long, sub long, start int, stop int, route long"
SPANS = "id long, sub long, start int, stop int"
PLACE = np.uint64((1 << 24) - 1)
LOW = np.uint64((1 << 24) - 1)


def segments(buffer: np.ndarray, sizes: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Segments of texts that lie one after another in buffer: begin, end, document, anchor, and the hashes of the
    anchor with what follows (right) and what precedes it (left) within a window."""
    n = len(buffer)
    wide = np.zeros(n + ANCHOR, np.uint8)
    wide[:n] = buffer
    eight = np.lib.stride_tricks.as_strided(wide, (n + 8, 8), (1, 1)).copy().view("<u8").ravel()
    hashes = mix64(mix64(eight[:n]) + eight[8:])
    del eight
    least = hashes & ~PLACE | np.arange(n, dtype=np.uint64)
    reach, span = length - ANCHOR + 1, 1
    while span < reach:  # minima over `reach` neighbours by doubling
        d = min(span, reach - span)
        least[:-d] = np.minimum(least[:-d], least[d:])
        span += d
    stops = np.cumsum(sizes)
    counts = np.maximum(sizes - length + 1, 0)
    at = ranges(stops - sizes, counts)
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), counts)
    if not len(at):
        return {k: np.zeros(0, np.int64) for k in ("begin", "end", "doc")} | {k: np.zeros(0, np.uint64) for k in ("anchor", "right", "left")}
    best = least[at]
    first = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])])
    place = (best[first] & PLACE).astype(np.int64)
    last = np.r_[first[1:], len(at)] - 1
    beside = length - ANCHOR >> 1
    anchor = hashes[place]
    right = mix64(anchor + mix64(hashes[np.minimum(place + beside, n - 1)]))
    left = mix64(mix64(anchor) + hashes[np.maximum(place - beside, 0)])
    owner = doc[first]
    other = np.r_[True, (owner[1:] != owner[:-1]) | (anchor[1:] != anchor[:-1]) | (right[1:] != right[:-1]) | (left[1:] != left[:-1])]
    if not other.all():
        nth = np.arange(len(other)) - np.maximum.accumulate(np.where(other, np.arange(len(other)), 0))
        opens = np.flatnonzero(nth % ALIKE == 0)
        first, last, owner, anchor, right, left = first[opens], last[np.r_[opens[1:], len(last)] - 1], owner[opens], anchor[opens], right[opens], left[opens]
    return {"begin": at[first], "end": at[last] + length, "doc": owner, "anchor": anchor, "right": right, "left": left}


def pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """(id, sub, offset, bytes) by about BATCH_BYTES; longer texts in pieces that overlap by length - 1 bytes."""
    out, held = [], 0
    for b in batches:
        for i, s, t in zip(b.column("id").to_pylist(), b.column("sub").to_pylist(), b.column("bytes").to_pylist(), strict=True):
            for at in range(0, max(len(t) - length + 1, 0), BATCH_BYTES):
                piece = t[at : at + BATCH_BYTES + length - 1] if len(t) > BATCH_BYTES else t
                out.append((i, s, at, piece))
                held += len(piece)
                if held >= BATCH_BYTES:
                    yield out
                    out, held = [], 0
    if out:
        yield out


def by_part(route: np.ndarray, parts: int) -> np.ndarray:
    return ((route >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def in_parts(part: np.ndarray, some: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part and those of `some` that fall in it, in their order."""
    mine = part[some]
    order = np.argsort(mine, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(mine[order]) != 0, True]) if len(order) else np.zeros(1, np.int64)
    return ((int(mine[order[a]]), some[order[a:b]]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def columns(blob: bytes, n: int, kinds: list[str]) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(blob), 0, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


SKETCH_KINDS = ["<u2", "u1", "<u4", "<u4", "<i4", "<u2", "<i8", "<i8"]
DIRECT_KINDS = ["<i8", "<i4", "<u2", "<i8", "<i8"]


def steps(start: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Starts as differences within a document; a document's first is negative, -1 - start."""
    return np.where(np.r_[False, doc[1:] == doc[:-1]], np.diff(start, prepend=0), -1 - start).astype("<i4")


class Familiar:
    """Hashes that a task has met in two documents, HOT times or more in one batch."""

    def __init__(self):
        self.told = np.zeros(0, np.uint64)

    def of(self, key: np.ndarray, id_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which of the keys are familiar, and of those that are so only now: a place, the least id and the greatest."""
        order = np.argsort(key)
        edge = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
        size = np.diff(np.r_[edge, len(order)])
        known = np.zeros(len(key), bool)
        before = np.isin(key[order[edge]], self.told) if len(self.told) else np.zeros(len(edge), bool)
        big = np.flatnonzero((size >= HOT) & ~before)
        if len(big):
            members = order[ranges(edge[big], size[big])]
            begins = np.cumsum(size[big]) - size[big]
            low, high = np.minimum.reduceat(id_[members], begins), np.maximum.reduceat(id_[members], begins)
            big, low, high = (x[low < high] for x in (big, low, high))
        else:
            low = high = np.zeros(0, np.int64)
        now = np.union1d(np.flatnonzero(before), big)
        known[order[ranges(edge[now], size[now])]] = True
        new = order[edge[big]]
        self.told = np.union1d(self.told, key[new])[-REMEMBERED:]
        return known, new, low, high


def sketch(length: int, parts: int):
    """Rows of SKETCHES: hashes and places of the segments, by batch and part of the anchors. Rows of negative n hold
    segments that are known to share a hash; they are dealt out by batch. Segments of size 0 only tell of a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, familiar = zstandard.ZstdCompressor(level=1), Familiar()
        for number, some in enumerate(pieces(batches, length)):
            sizes = np.array([len(x[3]) for x in some], np.int64)
            found = segments(np.frombuffer(b"".join(x[3] for x in some), np.uint8), sizes, length)
            doc = found["doc"]
            if not len(doc):
                continue
            id_, sub, offset = (np.array(c, np.int64) for c in list(zip(*some, strict=True))[:3])
            start = (found["begin"] - (np.cumsum(sizes) - sizes)[doc] + offset[doc]).astype(np.int32)
            size = (found["end"] - found["begin"]).astype("<u2")
            route, right, left = mix64(found["anchor"]), found["right"], found["left"]
            part, low = by_part(route, parts), route >> np.uint64(8) & LOW
            at_right, new_right, *ids_right = familiar.of(right, id_[doc])
            at_left, new_left, *ids_left = familiar.of(left, id_[doc])
            rows: tuple[list, list, list] = ([], [], [])

            def add(p: int, n: int, cols: list[np.ndarray], rows=rows) -> None:
                for col, x in zip(rows, (p, press.compress(b"".join(c.tobytes() for c in cols)), n), strict=True):
                    col.append(x)

            def put(p: int, k: np.ndarray, r: np.ndarray, x: np.ndarray, step: np.ndarray, s: np.ndarray, i: np.ndarray, j: np.ndarray, low=low) -> None:
                add(p, len(k), [(low[k] & np.uint64(0xFFFF)).astype("<u2"), (low[k] >> np.uint64(16)).astype("u1"), (r >> np.uint64(32)).astype("<u4"), (x >> np.uint64(32)).astype("<u4"), step, s, i, j])

            known = at_right | at_left
            for p, k in in_parts(part, np.flatnonzero(~known)):
                put(p, k, right[k], left[k], steps(start[k], doc[k]), size[k], id_[doc[k]], sub[doc[k]])
            for new, (least, most), is_right in ((new_right, ids_right, True), (new_left, ids_left, False)):
                place, told = np.repeat(new, 2), np.stack([least, most], 1).ravel()
                for p, k in in_parts(part[place], np.arange(len(place))):
                    at, none = place[k], np.zeros(len(k), np.uint64)
                    put(p, at, right[at] if is_right else none, none if is_right else left[at], np.full(len(k), -1, "<i4"), np.zeros(len(k), "<u2"), told[k], told[k])
            k = np.flatnonzero(known)
            if len(k):
                add(number % parts, -len(k), [(part[k] << 24 | low[k].astype(np.int64)).astype("<i8"), steps(start[k], doc[k]), size[k], id_[doc[k]], sub[doc[k]]])
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.int32())], ["part", "about", "n"])

    return run


def absolute(step: np.ndarray) -> np.ndarray:
    """Starts from steps. The first of each row of a batch is negative, -1 - start, so rows alike in all else are told apart."""
    anew = step < 0
    step = np.where(anew, -1 - step.astype(np.int64), step)
    total = np.cumsum(step)
    base = np.maximum.accumulate(np.where(anew, np.arange(len(step)), 0))
    return total - total[base] + step[base]


def in_two(key: np.ndarray, id_: np.ndarray) -> np.ndarray:
    """Where key is one that two documents have."""
    order = np.argsort(key)
    edge = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(key) else order
    least, most = np.minimum.reduceat(id_[order], edge), np.maximum.reduceat(id_[order], edge)
    out = np.zeros(len(key), bool)
    out[order] = np.repeat(least < most, np.diff(np.r_[edge, len(order)]))
    return out


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of CANDIDATES: the segments of a part of the anchors that share a 33-byte hash with another document."""

    def out(id_, sub, start, size, route) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(id_), pa.array(sub), pa.array(start.astype(np.int32)), pa.array((start + size).astype(np.int32)), pa.array(route)], ["id", "sub", "start", "stop", "route"])

    cols: list[list[np.ndarray]] = []
    for b in batches:
        for row in b.to_pylist():
            if row["n"] < 0:
                route, step, size, id_, sub = columns(row["about"], -row["n"], DIRECT_KINDS)
                yield out(id_, sub, absolute(step), size, route)
                continue
            low, high, *others = columns(row["about"], row["n"], SKETCH_KINDS)
            cols.append([low.astype(np.int64) | high.astype(np.int64) << 16 | row["part"] << 24, *others])
    if not cols:
        return
    route, right, left, step, size, id_, sub = (np.concatenate(c) for c in zip(*cols, strict=True))
    cols.clear()
    start = absolute(step)
    keep = np.flatnonzero((in_two(right, id_) | in_two(left, id_)) & (size > 0))
    for a in range(0, len(keep), 100_000):
        k = keep[a : a + 100_000]
        yield out(id_[k], sub[k], start[k], size[k], route[k])


def joined_spans(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal spans of sorted ones that touch or overlap."""
    out: list[list[int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


TEXT_KINDS = ["<u2", "<i4", "<u4", "<i8", "<i8"]


def cut(parts: int):
    """Rows of SEGMENTS: the text of the candidates of documents, by part. Candidates equal to one that this task has
    sent for a smaller document aren't sent: they are whole spans, in rows of negative n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        least: dict[bytes, int] = {}
        held: list[tuple[bytes, int, int, int, int, int]] = []
        spans: list[tuple[int, int, int, int]] = []
        number = 0

        def rows() -> pa.RecordBatch:
            out: tuple[list, list, list, list] = ([], [], [], [])

            def add(p: int, texts: bytes, about: bytes, n: int) -> None:
                for col, x in zip(out, (p, press.compress(texts), press.compress(about), n), strict=True):
                    col.append(x)

            if held:
                part = np.array([x[1] for x in held], np.int64)
                for p, k in in_parts(part, np.arange(len(held))):
                    mine = [held[i] for i in k.tolist()]
                    _, _, group, start, id_, sub = (np.array(c) if j else c for j, c in enumerate(zip(*mine, strict=True)))
                    size = np.fromiter((len(x[0]) for x in mine), "<u2", len(mine))
                    add(p, b"".join(x[0] for x in mine), b"".join([size.tobytes(), start.astype("<i4").tobytes(), group.astype("<u4").tobytes(), id_.astype("<i8").tobytes(), sub.astype("<i8").tobytes()]), len(mine))
            if spans:
                add(number % parts, b"", np.array(spans, "<i8").tobytes(), -len(spans))
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.int32())], ["part", "texts", "about", "n"])

        for b in batches:
            for i, row in enumerate(b.column("found")):
                text, id_, sub = b.column("bytes")[i].as_py(), b.column("id")[i].as_py(), b.column("sub")[i].as_py()
                flat = row.values
                route = mix64(flat.field("route").to_numpy())
                part, group = by_part(route, parts).tolist(), (route & np.uint64(0xFFFFFFFF)).tolist()
                whole = []
                for p, g, s, e in zip(part, group, flat.field("start").to_pylist(), flat.field("stop").to_pylist(), strict=True):
                    t = text[s:e]
                    if least.setdefault(t, id_) < id_:
                        whole.append((s, e))
                    else:
                        least[t] = id_
                        held.append((t, p, g, s, id_, sub))
                spans += [(id_, sub, s, e) for s, e in joined_spans(sorted(whole))]
                if len(least) > REMEMBERED:
                    least.clear()
                if len(held) + len(spans) > 60_000:
                    yield rows()
                    held.clear()
                    spans.clear()
                    number += 1
        if held or spans:
            yield rows()

    return run


def marked(length: int):
    """Rows of SPANS from the segments of a part: what also starts in a document with a smaller id."""

    def out(id_, sub, start, stop) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(id_), pa.array(sub), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], ["id", "sub", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        held: list[tuple] = []
        for b in batches:
            for row in b.select(["texts", "about", "n"]).to_pylist():
                if row["n"] < 0:
                    yield out(*np.frombuffer(zstandard.decompress(row["about"]), "<i8").reshape(-1, 4).T.copy())
                    continue
                size, start, group, id_, sub = columns(row["about"], row["n"], TEXT_KINDS)
                text = zstandard.decompress(row["texts"])
                stop = np.cumsum(size.astype(np.int64))
                which = np.fromiter((known.setdefault(text[e - s : e], len(known)) for e, s in zip(stop.tolist(), size.tolist(), strict=True)), np.int64, row["n"])
                held.append((which, start, group, id_, sub))
        if not known:
            return
        which, start, group, id_, sub = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        owners, groups = np.full(len(known), np.iinfo(np.int64).max), np.zeros(len(known), np.int64)
        np.minimum.at(owners, which, id_)
        groups[which] = group
        strings = list(known)
        known.clear()
        owner, begins, windows = first_owners(strings, owners, groups, length)
        least, most = np.minimum.reduceat(owner, begins), np.maximum.reduceat(owner, begins)
        whole = np.flatnonzero(most[which] < id_)
        if len(whole):
            yield out(id_[whole], sub[whole], start[whole], start[whole] + windows[which[whole]] + length - 1)
        # Of the other occurrences each window goes whose owner is smaller.
        partly = np.flatnonzero((least[which] < id_) & (most[which] >= id_))
        for a in range(0, len(partly), 100_000):
            k = partly[a : a + 100_000]
            w = which[k]
            count = windows[w]
            of = np.repeat(np.arange(len(w)), count)
            hit = owner[ranges(begins[w], count)] < id_[k][of]
            offset = ranges(np.zeros(len(w), np.int64), count)
            opens = np.flatnonzero(hit & np.r_[True, ~hit[:-1] | (of[1:] != of[:-1])])
            closes = np.flatnonzero(hit & np.r_[~hit[1:] | (of[1:] != of[:-1]), True])
            o = k[of[opens]]
            yield out(id_[o], sub[o], start[o] + offset[opens], start[o] + offset[closes] + length)

    return run


def remaining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their spans."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for b in batches:
        kept, runs = [], []
        for text, spans in zip(b.column("bytes").to_pylist(), b.column("spans").to_pylist(), strict=True):
            merged = joined_spans(sorted((s["start"], s["stop"]) for s in spans or ()))
            edges = [0, *(x for m in merged for x in m), len(text)]
            kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
            runs.append([{"start": x, "stop": y} for x, y in merged])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in b.column("bytes").to_pylist()], pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])


RESULT = "doc_id long, n_bytes long, removed array<struct<start:int,stop:int>>, kept binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, removed, kept) of every row: the UTF-8 bytes of its text without those that lie in a string of
    `length` bytes which also starts in a row with a smaller id. removed: the maximal spans that went.

    Null and empty texts, and those shorter than `length`, keep all. Rows that share an id don't shorten each other, and
    rows of equal id and text come out alike; rows without an id count as the largest id. Other columns are left out; an
    empty table stays empty.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text.alias("bytes"))
    rows = rows.withColumn("sub", F.xxhash64("bytes"))
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(16, -(-total // SKETCH_BYTES))
    sketched = rows.where(F.octet_length("bytes") >= length).select("id", "sub", "bytes").mapInArrow(sketch(length, parts), SKETCHES)
    likely = sketched.repartitionById(parts, F.col("part")).mapInArrow(candidates, CANDIDATES)
    likely = staged(likely.groupBy("id", "sub").agg(F.collect_list(F.struct("start", "stop", "route")).alias("found")), "candidates")
    size = likely.agg(F.sum(F.aggregate("found", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"]))).first()[0] or 0
    index_parts = max(16, -(-size // INDEX_BYTES))
    texts = only(rows, likely.select("id", "sub"))[0].join(likely, ["id", "sub"]).select("id", "sub", "bytes", "found").mapInArrow(cut(index_parts), SEGMENTS)
    spans = texts.repartitionById(index_parts, F.col("part")).mapInArrow(marked(length), SPANS)
    by_doc = staged(spans.groupBy("id", "sub").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    some, others = only(rows, by_doc.select("id", "sub"))
    hit = some.join(by_doc, ["id", "sub"]).select("doc_id", "bytes", "spans").mapInArrow(remaining, RESULT)
    clean = others.select("doc_id", F.octet_length("bytes").cast("long").alias("n_bytes"), F.array().cast("array<struct<start:int,stop:int>>").alias("removed"), F.col("bytes").alias("kept"))
    return clean.unionByName(hit)


def only(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose (id, sub) is among ids, and the others; the text moves only if there are too many ids to broadcast."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    ids = F.broadcast(ids) if few else ids
    return rows.join(ids, ["id", "sub"], "left_semi"), rows.join(ids, ["id", "sub"], "left_anti")
