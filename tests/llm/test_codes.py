"""Product codes by filtered Lloyd rounds against every part compared with every entry."""

import math

import numpy as np
import pytest

from lodestone.llm.codes import Tree, codes_sql, loaded, product_codes, written

SCHEMA = "vec_id long, embedding array<double>, label int"


def by_brute_force(rows, parts=4, entries=256, rounds=4):
    kept = [(i, lab, [math.floor(1024 * x) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max(len(v) for *_, v in kept) // parts))
    kept = [(i, lab, v + [0] * (width * parts - len(v))) for i, lab, v in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for *_, v in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for *_, v in kept:
                groups.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e], strict=True)] if e in groups else old for e, old in enumerate(books[p])]
    found = [(i, lab, [nearest(cut(v, p), books[p]) for p in range(parts)]) for i, lab, v in kept]
    errors, most = {}, 2**63 - 1
    for _, lab, n in found:
        errors[lab] = min(most, errors.get(lab, 0) + sum(d for d, _ in n))
    text = ",".join(str(x) for b in books for c in b for x in c)
    return sorted(((i, "".join(f"{e:02x}" for _, e in n), min(most, sum(d for d, _ in n)), errors[lab]) for i, lab, n in found), key=repr), text


def got(spark, rows, schema=SCHEMA, **how):
    codes, books = product_codes(spark.createDataFrame(rows, schema).repartition(3), **how)
    return sorted((tuple(r) for r in codes.select("vec_id", "code", "error", "label_error").collect()), key=repr), books.text()


@pytest.mark.parametrize("n", [3, 700])
def test_equals_brute_force(spark, n):
    rng = np.random.default_rng(n)
    middles = rng.normal(0, 0.2, (9, 16))
    rows = [(int(i) * 7 % 1009, (middles[i % 9] + rng.normal(0, 0.03, 16)).tolist(), [None, 1, 2][i % 3]) for i in range(n)]
    assert got(spark, rows) == by_brute_force(rows)


def test_bad_rows_copies_ties_and_null_ids(spark):
    v = [0.5, -0.25, 0.0, 1.0, -0.0001, 0.3, 0.3, 0.3]
    rows = [(1, v, 1), (1, v, 1), (2, None, 1), (3, [None, *v[1:]], 1), (4, [math.nan, *v[1:]], 2), (5, [math.inf, *v[1:]], 2), (None, v, None), (6, [-x for x in v], None), (7, v[:5], 3), (8, [], 3)] + [(100 + i, v, 5) for i in range(300)]
    assert got(spark, rows) == by_brute_force(rows)


def test_few_entries_make_ties(spark):
    rows = [(i, [float(x) / 1024 for x in (i % 3, i % 2, -(i % 3), 0)], i % 2) for i in range(60)]
    assert got(spark, rows, entries=5, rounds=3) == by_brute_force(rows, entries=5, rounds=3)


def test_great_components(spark):
    rows = [(i, [1e12 * (i % 5 - 2), float(i), -3e9 * i, 0.1], None) for i in range(40)]
    assert got(spark, rows, entries=4) == by_brute_force(rows, entries=4)
    beyond = got(spark, [(1, [1e300] * 4, 1), (2, [-1e300] * 4, 1), (3, [0.0] * 4, 1)], entries=2)[0]
    assert [r[0] for r in beyond] == [1, 2, 3] and max(r[2] for r in beyond) <= 2**63 - 1


def test_no_rows_and_clashing_columns(spark):
    assert got(spark, [])[0] == [] and got(spark, [(1, None, 1)])[0] == []
    rows = [(i, [i / 8, 0.5, 0.25, 1.0], 1, 9, "x") for i in range(5)]
    clashing = got(spark, rows, "vec_id long, embedding array<double>, label int, error long, code string")
    assert clashing == by_brute_force([r[:3] for r in rows])


def test_tree_drops_entries_and_keeps_sums():
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(m, 3, (1500, 4)) for m in (0, 500, -900, 4000)]).astype(np.int64)
    tree = Tree.build(points)
    fields = dict(zip(("order", "points", "low", "high", "sums"), map(written, [tree.order, tree.points, *(np.concatenate(x) for x in (tree.low, tree.high, tree.sums))]), strict=True))
    tree = loaded(fields, 4)
    book = np.array([[0] * 4, [500] * 4, [-900] * 4, [4000] * 4, [10**6] * 4])
    entry, count, total = tree.assign(book)
    assert count.tolist() == [1500, 1500, 1500, 1500, 0] and (total.sum(0) == points.sum(0)).all()
    assert (entry == ((tree.points[:, None, :] - book) ** 2).sum(2).argmin(1)).all()
    untouched = Tree(tree.order, np.zeros_like(tree.points), tree.low, tree.high, tree.sums)  # whole subtrees go by boxes and sums alone
    assert untouched.assign(book)[1].tolist() == count.tolist()


def test_sql_gives_the_same(spark, tmp_path):
    import duckdb

    data = "/root/testdata/sf0.001"
    try:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    except duckdb.IOException:
        pytest.skip("needs the driver's tables")
    from lodestone.llm.queries import op13_vector_codes

    told = sorted(con.execute(codes_sql()).fetchall())
    assert told == sorted(tuple(r) for r in op13_vector_codes(spark, data).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
