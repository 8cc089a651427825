"""Greedy duplicate groups against a walk over all assets."""

import random

import pytest

from lodestone.operators import duplicates

SCHEMA = "id string, px string, h long, w int, hh int"


def by_walk(rows):
    exact = {}
    for r in rows:
        if r[1] is not None:
            exact.setdefault(r[1], []).append(r)
    out = [(r[0], min(x[0] for x in g), "exact") for g in exact.values() if len(g) > 1 for r in g]
    reps = sorted(min(g, key=lambda r: r[0]) for g in exact.values())
    ratio = lambda r: (r[3] or 1) / (r[4] or 1)
    taken = set()
    for i, c in enumerate(reps):
        if c[0] in taken or c[2] is None:
            continue
        group = [c[0]]
        for x in reps[i + 1 :]:
            near = x[2] is not None and ((c[2] ^ x[2]) & (2**64 - 1)).bit_count() <= 6 and abs(ratio(x) - ratio(c)) / max(ratio(x), ratio(c)) <= 0.12
            if x[0] not in taken and near:
                group.append(x[0])
                taken.add(x[0])
        if len(group) > 1:
            out += [(m, c[0], "perceptual") for m in group]
    return sorted(out)


@pytest.mark.parametrize("pieces", [8, 9, 10])
def test_groups_equal_a_walk(spark, monkeypatch, pieces):
    monkeypatch.setattr(duplicates, "PIECES", [(1 << 62, pieces)])
    random.seed(pieces)
    middles = [random.getrandbits(64) for _ in range(6)]
    rows = []
    for i in range(220):
        h = random.choice(middles)
        for _ in range(random.randrange(0, 6)):
            h ^= 1 << random.randrange(64)
        h = h - 2**64 if h >= 2**63 else h
        rows.append((f"m{random.randrange(10**6):06d}{i}", random.choice([None, f"p{i % 150}", f"p{i}"]), random.choice([h, h, h, None]), random.choice([None, 0, 100, 105, 130]), 100))
    rows += [(f"x{i}", f"blank{i}", 0, 10, 10) for i in range(50)]
    got = duplicates.duplicate_groups(spark.createDataFrame(rows, SCHEMA), "id", "px", "h", "w", "hh").collect()
    assert sorted(map(tuple, got)) == by_walk(rows)


def test_no_assets(spark):
    assert duplicates.duplicate_groups(spark.createDataFrame([], SCHEMA), "id", "px", "h", "w", "hh").count() == 0
