"""A run-length Burrows-Wheeler index of strings, and matching statistics of other strings streamed through it."""

from __future__ import annotations

import numpy as np

#: Stands after each string. UTF-8 never has this byte.
SEPARATOR = b"\xff"
NONE = np.iinfo(np.int64).max


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], ..., starts[0] + counts[0] - 1, starts[1], ..."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Dense ranks from 1, the order (equal keys by place), and how many ranks there are. Keys that leave room for their
    places are sorted with them in one word."""
    bits = max(len(key).bit_length(), 1)
    if int(key.max(initial=0)).bit_length() + bits <= 64:
        both = np.sort(key << np.uint64(bits) | np.arange(len(key), dtype=np.uint64))
        order, ordered = (both & np.uint64((1 << bits) - 1)).astype(np.int64), both >> np.uint64(bits)
    else:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
    dense = np.cumsum(np.r_[True, ordered[1:] != ordered[:-1]])
    rank = np.empty(len(key), np.uint64)
    rank[order] = dense
    return rank, order, int(dense[-1])


class RunLengthIndex:
    """Strings sorted by all their suffixes, of which only the runs of the Burrows-Wheeler transform are kept: each run's
    byte, where it begins (a bit vector with counts), how often its byte came before, and the text places of its first
    and last suffix. The text itself is there to be looked at by place.

    `owners` is a number for each string; owner_at(place) is the least owner among the strings that hold the `length`
    bytes at a place. Where no two strings share such bytes (`apart`) it is the string's own.
    """

    def __init__(self, strings: list[bytes], owners: np.ndarray, length: int, apart: bool):
        raw = SEPARATOR.join(strings) + SEPARATOR
        text = np.frombuffer(raw, np.uint8)
        n, self.length = len(text), length
        sizes = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
        self.stops = np.cumsum(sizes) - 1
        self.begins = self.stops - sizes + 1
        stop = np.repeat(self.stops, sizes)
        place = np.arange(n)
        present = np.bincount(text, minlength=256) > 0
        present[SEPARATOR[0]] = False
        code = np.cumsum(present) * present  # bytes that occur are numbered from 1
        coded = code[text]
        rank, order, count, have = self.initial(coded, int(code.max()), stop, place, length)
        at_half = rank
        longest = int(sizes.max())
        self.half = have
        while have < longest:
            if have <= length:
                at_half, self.half = rank, have
            rank, order, more = ranked(self.paired(rank, stop, place, have))
            have *= 2
            if more == count:  # nothing was told apart by so many bytes more, so nothing ever will
                break
            count = more
        self.owner = self.least_owners(at_half, np.repeat(owners, sizes), sizes, length, apart)
        before = np.where(order == np.repeat(self.begins, sizes)[order], 0, coded[order - 1]).astype(np.int32)
        heads = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
        run_size = np.diff(np.r_[heads, n])
        self.heads, self.run_code = heads.astype(np.int32), before[heads]
        self.head_sample, self.tail_sample = order[heads].astype(np.int32), order[heads + run_size - 1].astype(np.int32)
        by_code = np.argsort(self.run_code, kind="stable")
        sums = np.cumsum(run_size[by_code]) - run_size[by_code]
        group = np.r_[True, np.diff(self.run_code[by_code]) != 0]
        seen = np.zeros(len(heads), np.int64)  # of the run's byte in runs before it
        seen[by_code] = sums - np.maximum.accumulate(np.where(group, sums, 0))
        below = np.cumsum(np.bincount(coded, minlength=int(code.max()) + 1))
        first = np.r_[0, below[:-1]]  # suffixes that begin with a smaller byte
        self.step = (first[self.run_code] + seen - heads).astype(np.int32)  # of a place in the run to the suffix a byte longer
        self.tail = (heads + run_size - 1).astype(np.int32)
        self.n_runs, self.start = len(heads), int(order[0])
        self.keys = self.run_code[by_code].astype(np.int64) * self.n_runs + by_code  # runs of a byte in order
        bits = np.zeros((n >> 6) + 1, np.uint64)
        np.bitwise_or.at(bits, heads >> 6, np.uint64(1) << (heads & 63).astype(np.uint64))
        self.bits = bits
        ones = np.bitwise_count(bits).astype(np.int32)
        self.ones = np.cumsum(ones, dtype=np.int32) - ones
        self.upto = ~np.uint64(0) >> np.arange(63, -1, -1, dtype=np.uint64)
        self.code = code.astype(np.int32)
        self.words = np.lib.stride_tricks.as_strided(np.frombuffer(raw + bytes(16), np.uint8), (n + 8, 8), (1, 1)).copy().view("<u8").ravel()

    @staticmethod
    def initial(coded: np.ndarray, codes: int, stop: np.ndarray, place: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Ranks by the first bytes, `most` of them or as many as leave room for places in a word."""
        bits = codes.bit_length()
        first = max(1, min((64 - max(len(coded).bit_length(), 1)) // max(bits, 1), 8, most))
        wide = np.r_[coded.astype(np.uint64), np.zeros(first, np.uint64)]
        key = np.zeros(len(coded), np.uint64)
        for i in range(first):
            key = key << np.uint64(bits) | np.where(place + i < stop, wide[i : i + len(coded)], np.uint64(0))
        return *ranked(key), first

    @staticmethod
    def paired(rank: np.ndarray, stop: np.ndarray, place: np.ndarray, by: int) -> np.ndarray:
        later = np.zeros(len(rank), np.uint64)
        later[: len(rank) - by] = rank[by:]
        later[place + by >= stop] = 0
        return rank << np.uint64(max(len(rank).bit_length(), 1)) | later

    def least_owners(self, half: np.ndarray, owner: np.ndarray, sizes: np.ndarray, length: int, apart: bool) -> np.ndarray:
        if apart:
            return owner
        out = np.full(len(owner), NONE)
        # Equal in `half` bytes here and further on: equal in `length` bytes.
        w = ranges(self.begins, np.maximum(sizes - length, 0))
        key = half[w] << np.uint64(32) | half[w + max(length - self.half, 0)]
        order = np.argsort(key)
        edge = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(w) else w
        out[w[order]] = np.repeat(np.minimum.reduceat(owner[w[order]], edge), np.diff(np.r_[edge, len(w)])) if len(w) else NONE
        return out

    def run_of(self, place: np.ndarray) -> np.ndarray:
        word = place >> 6
        return self.ones[word] + np.bitwise_count(self.bits[word] & self.upto[place & 63]) - 1

    def common(self, p: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at text places p and q share, exact below `most`."""
        out = np.zeros(len(p), np.int32)
        at = np.flatnonzero(most > 0)
        while len(at):
            x = self.words[p[at] + out[at]] ^ self.words[q[at] + out[at]]
            out[at] += np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int32)
            at = at[(x == 0) & (out[at] < most[at])]
        return out

    def statistics(self, text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of strings that lie one after another in text: for each byte how long the longest match of
        what begins there with indexed text is, and a place of it. All strings go through the index at once, from their
        ends. A step stays in its run, or goes to the nearest end of a run of the wanted byte, above or below,
        whichever's suffix shares more with what is matched."""
        stops = np.cumsum(sizes)
        string = np.argsort(-sizes, kind="stable")  # the longest first: those that are through drop off the end
        last, size = stops[string] - 1, sizes[string]
        place, long = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int32)
        ptr = np.full(len(sizes), self.start, np.int32)
        lengths, places = np.zeros(len(text), np.int32), np.zeros(len(text), np.int32)
        most = int(size[0]) if len(size) else 0
        live = np.searchsorted(-size, -np.arange(1, most + 1), "right")  # strings of so many bytes or more
        coded = self.code[text]
        for step in range(most):
            k = live[step]
            at = last[:k] - step
            c = coded[at]
            run = self.run_of(place[:k])
            off = np.flatnonzero((self.run_code[run] != c) | (c == 0))
            went = place[:k] + self.step[run]
            ptr[:k] -= 1
            long[:k] += 1
            if len(off):
                wanted = c[off].astype(np.int64)
                nearest = np.searchsorted(self.keys, wanted * self.n_runs + run[off])
                up, down = self.keys[np.maximum(nearest - 1, 0)], self.keys[np.minimum(nearest, self.n_runs - 1)]
                above = (nearest > 0) & (up // self.n_runs == wanted) & (wanted > 0)
                below = (nearest < self.n_runs) & (down // self.n_runs == wanted) & (wanted > 0)
                up, down = up % self.n_runs, down % self.n_runs
                here, matched = ptr[off] + 1, long[off] - 1
                to_up = np.where(above, self.common(here, self.tail_sample[up], np.where(above, matched, 0)), -1)
                to_down = np.where(below, self.common(here, self.head_sample[down], np.where(below, matched, 0)), -1)
                rises = to_up >= to_down
                target = np.where(rises, up, down)
                found = above | below
                went[off] = np.where(found, np.where(rises, self.tail[target], self.heads[target]) + self.step[target], 0)
                ptr[off] = np.where(found, np.where(rises, self.tail_sample[target], self.head_sample[target]) - 1, self.start)
                long[off] = np.where(found, np.minimum(matched, np.maximum(to_up, to_down)) + 1, 0)
            place[:k] = went
            lengths[at], places[at] = long[:k], ptr[:k]
        return lengths, places

    def owners_of(self, text: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each byte of the strings in text the least owner of indexed strings with the `length` bytes that begin
        there, NONE where there is none."""
        lengths, places = self.statistics(text, sizes)
        return np.where(lengths >= self.length, self.owner[places], NONE)


def first_owners(strings: list[bytes], owners: np.ndarray, groups: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of `length` bytes of distinct strings the least owner of strings with equal windows.

    Equal windows must lie in strings of one group. A group's string of least owner owns all its windows. It is indexed,
    and the group's others are streamed through the index. What of them stays unmatched is new; those strings take part
    in the next round, in which eight times as many of each group are indexed. Returns the owners, and where each
    string's windows begin and how many it has.
    """
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    windows = sizes - length + 1
    begins = np.cumsum(windows) - windows
    found = np.full(int(windows.sum()), NONE)
    pending = np.lexsort((owners, groups))
    take = 1
    while len(pending):
        edge = np.flatnonzero(np.r_[True, np.diff(groups[pending]) != 0])
        size = np.diff(np.r_[edge, len(pending)])
        nth = np.arange(len(pending)) - np.repeat(edge, size)
        picked, rest = pending[nth < take], pending[nth >= take]
        mine = ranges(begins[picked], windows[picked])
        index = None
        if take == 1:
            found[mine] = np.minimum(found[mine], np.repeat(owners[picked], windows[picked]))
            needed = pending[(nth == 0) & (np.repeat(size, size) > 1)]
            if len(needed):
                index = RunLengthIndex([strings[i] for i in needed.tolist()], owners[needed], length, True)
        else:
            index = RunLengthIndex([strings[i] for i in picked.tolist()], owners[picked], length, False)
            found[mine] = np.minimum(found[mine], index.owner[ranges(index.begins, windows[picked])])
        if len(rest):
            some = np.frombuffer(b"".join([strings[i] for i in rest.tolist()]), np.uint8)
            got = index.owners_of(some, sizes[rest])[ranges(np.cumsum(sizes[rest]) - sizes[rest], windows[rest])]
            theirs = ranges(begins[rest], windows[rest])
            found[theirs] = np.minimum(found[theirs], got)
            open_ = np.logical_or.reduceat(found[theirs] == NONE, np.cumsum(windows[rest]) - windows[rest])
            rest = rest[open_]
        pending, take = rest, take * 8
    return found, begins, windows
