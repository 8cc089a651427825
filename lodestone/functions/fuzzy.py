"""Scores of fuzzy matches: the best alignment of a query's letters with a title's, with affine gaps."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a matched letter, the begin of a gap and each further letter of it count; what a letter gains at a word's start,
#: where small letters turn to capitals or letters to digits, and behind a matched one; the first letter's gain counts twice
#: (fixed values).
MATCH, GAP, LONGER, WORD, TURN, BEHIND, FIRST = 16, 3, 1, 8, 7, 4, 2
NONE = np.int64(-(1 << 40))


def bare(text: str) -> str:
    """Letters without their marks, one for one."""
    return "".join(unicodedata.normalize("NFD", c)[0] if c.isalpha() else c for c in text)


def gains(text: str) -> list[int]:
    """What a match gains at each place of a title."""
    out = []
    for before, c in zip(" " + text, text, strict=False):
        if not c.isalnum():
            out.append(0)
        elif not before.isalnum():
            out.append(WORD)
        else:
            out.append(TURN if (before.islower() and c.isupper()) or (c.isdigit() and not before.isdigit()) else 0)
    return out


def atom_scores(titles: np.ndarray, gain: np.ndarray, atom: str) -> np.ndarray:
    """The score of each title (a row of code points, 0 behind its end) for one word of a query; NONE without a match.

    Row by row of the dynamic program over all titles at once: the best alignment that ends at a place comes from the
    place before, or over a gap from the best further left, which is a running maximum.
    """
    n, width = titles.shape
    place = np.arange(width)
    last = np.zeros((n, width), np.int64)
    for i, c in enumerate(atom):
        hit = titles == ord(c)
        if i == 0:
            last = np.where(hit, MATCH + FIRST * gain, NONE)
            continue
        run = np.full((n, width), NONE)
        run[:, 1:] = last[:, :-1] + np.maximum(gain[:, 1:], BEHIND)
        gap = np.full((n, width), NONE)
        best = np.maximum.accumulate(last + place * LONGER, axis=1)
        gap[:, 2:] = best[:, :-2] - GAP - (place[2:] - 2) * LONGER + gain[:, 2:]
        step = np.maximum(run, gap)
        last = np.where(hit & (step > NONE // 2), MATCH + step, NONE)
    return last.max(axis=1, initial=NONE)


def scores(titles: pd.Series, query: str) -> pd.Series:
    """The sum over a query's words; null where one doesn't match; 0 for a query without words."""
    plain = [bare(t) if t else "" for t in titles]
    width = max(map(len, plain), default=0)
    codes, gain = np.zeros((len(plain), width), np.int64), np.zeros((len(plain), width), np.int64)
    for i, t in enumerate(plain):
        codes[i, : len(t)] = [ord(x) for x in (c.lower()[:1] for c in t)]
        gain[i, : len(t)] = gains(t)
    total = np.zeros(len(plain), np.int64)
    for atom in bare(query).lower().split():
        total = np.maximum(total, NONE) + atom_scores(codes, gain, atom)
    return pd.Series([int(x) if x >= 0 else None for x in total], dtype="Int64")


def fuzzy_score(title: Column, query: str) -> Column:
    """Score of a title for a query as long, null without a match: every word of the query has to occur in it as a
    subsequence, without regard to case or marks. Titles go in Arrow batches; a null title matches only an empty query."""

    @F.pandas_udf("long")
    def run(titles: pd.Series) -> pd.Series:
        order = np.argsort(titles.fillna("").str.len().to_numpy(), kind="stable")  # titles of like length together
        out = pd.Series([None] * len(titles), dtype="Int64")
        for i in range(0, len(order), 1024):
            part = order[i : i + 1024]
            out.iloc[part] = scores(titles.iloc[part], query).to_numpy()
        return out

    return run(title)
