"""A whole small index has no faults; each single change gives the code that names it."""

import json

import pytest

from lodestone.operators.validation import TABLES, index_faults


def whole():
    payload = json.dumps({"schema_version": "3", "content_hash": "h", "evidence": [{"evidence_id": f"e{i}"} for i in range(3)], "media": {"assets": [{"media_id": "m1"}]}})
    return {
        "books": [["b", "g", "p"]],
        "structures": [["b", "g", 6]],
        "snapshots": [["b", "g", "h", payload]],
        "nodes": [["b", "n1", None], ["b", "n2", "n1"], ["b", "n3", "n2"]],
        "terms": [["b", "t1"], ["b", "t2"]],
        "segments": [["b", "s1", "g", "absolute", 1, 1, 3, 4], ["b", "s2", "g", "absolute", 3, 4, 6, 6]],
        "chunks": [["b", f"c{i}", "g", ["r"], [i + 1, i + 1], "n2", "s1", i, f"h{i}", f"e{i}", f"e{i - 1}" if i else None, f"e{i + 1}" if i < 2 else None] for i in range(3)],
        "edges": [["b", "x1", "n1", "n2", "parent_of", ["e0"]], ["b", "x2", "t1", "t2", "near", []]],
        "targets": [["b", "t1", "n1", "e1"], ["b", "t2", None, None]],
        "assets": [["b", "m1", "g", "n3", json.dumps({"media_id": "m1", "evidence_ids": ["e2"]})]],
        "links": [["b", "l1", "section_contains_media", "n3", "m1"], ["b", "l2", "media_mentions_term", "m1", "t1"]],
    }


#: (code, table, row, column, value); a row of None: the table is emptied, a column of None: the row is added.
CHANGES = [
    ("mixed_generation", "books", 0, 1, "old"), ("mixed_pipeline", "books", 0, 2, None), ("books_missing", "books", None, 0, None), ("structure_missing", "structures", None, 0, None), ("structure_generation", "structures", 0, 1, "old"),
    ("snapshot_missing", "snapshots", None, 0, None), ("snapshot_generation", "snapshots", 0, 1, "old"), ("orphan_structure", "structures", 0, None, ["z", "g", 3]), ("parent_missing", "nodes", 2, 2, "n9"), ("parent_cycle", "nodes", 0, 2, "n3"),
    ("segment_generation", "segments", 0, 2, "old"), ("segment_pages_not_absolute", "segments", 0, 3, "relative"), ("segment_boundaries", "segments", 1, 7, 5), ("segments_missing", "segments", None, 0, None), ("segment_core_gap_or_overlap", "segments", 1, 5, 5), ("segment_core_coverage", "segments", 1, 6, 5),
    ("chunk_generation", "chunks", 0, 2, "old"), ("refs_missing", "chunks", 0, 3, []), ("pages_missing", "chunks", 0, 4, []), ("section_missing", "chunks", 0, 5, None), ("chunk_segment_missing", "chunks", 0, 6, "s9"), ("chunk_outside_core", "chunks", 0, 4, [5]), ("chunk_page_invalid", "chunks", 0, 4, [7]),
    ("chunk_order_duplicate", "chunks", 1, 7, 0), ("chunk_order_duplicate", "chunks", 1, 7, None), ("chunk_order_gap", "chunks", 2, 7, 5), ("chunk_overlap_duplicate", "chunks", 0, None, ["b", "c9", "g", ["r"], [1, 1], "n2", "s1", 3, "h0", "e9", "e2", None]), ("chunks_missing", "chunks", None, 0, None),
    ("evidence_missing", "chunks", 0, 9, ""), ("evidence_duplicate", "chunks", 0, 9, "e1"), ("previous_chain", "chunks", 1, 10, "e2"), ("next_chain", "chunks", 1, 11, None),
    ("snapshot_invalid", "snapshots", 0, 3, "{"), ("snapshot_schema", "snapshots", 0, 3, '{"schema_version":"1","content_hash":"h"}'), ("snapshot_hash", "snapshots", 0, 2, "other"), ("snapshot_evidence", "snapshots", 0, 3, '{"schema_version":"3","content_hash":"h"}'), ("snapshot_media", "assets", None, 0, None),
    ("edge_source_missing", "edges", 0, 2, "q"), ("edge_target_missing", "edges", 1, 3, "q"), ("edge_endpoint_kind", "edges", 1, 2, "n1"), ("edge_evidence_missing", "edges", 0, 5, ["e7"]), ("edge_parent_mismatch", "edges", 0, 2, "n3"), ("edge_parent_cycle", "edges", 0, None, ["b", "x3", "n2", "n1", "parent_of", []]),
    ("target_node_missing", "targets", 0, 2, "n9"), ("target_evidence_missing", "targets", 0, 3, "e9"), ("media_generation", "assets", 0, 2, None), ("media_section_missing", "assets", 0, 3, "n9"), ("media_payload_invalid", "assets", 0, 4, "nonsense"), ("media_payload_id", "assets", 0, 4, '{"media_id":"m2"}'), ("media_evidence_missing", "assets", 0, 4, '{"media_id":"m1","evidence_ids":["e9"]}'),
    ("media_link_relation", "links", 0, 2, "likes"), ("media_link_endpoint", "links", 0, 3, "t1"),
]


def test_every_change_is_found(spark):
    """All indexes in one run: each under books of its own."""
    tables, want = {name: [] for name in TABLES}, {}
    for i, (code, table, row, column, value) in enumerate([(None, "books", 0, 0, "b"), *CHANGES]):
        index = whole()
        if code == "books_missing":
            continue
        if row is None:
            index[table] = []
        elif column is None:
            index[table].append(value)
        else:
            index[table][row][column] = value
        mark = lambda v, i=i: f"{i}.{v}" if isinstance(v, str) else v
        ids = {"books": [0], "structures": [0], "snapshots": [0], "nodes": [0, 1, 2], "terms": [0, 1], "segments": [0, 1], "chunks": [0, 1, 5, 6, 9, 10, 11], "edges": [0, 1, 2, 3], "targets": [0, 1, 2, 3], "assets": [0, 1, 3], "links": [0, 1, 3, 4]}
        for name, rows in index.items():
            for r in rows:
                r = [mark(v) if k in ids[name] and v != "" else v for k, v in enumerate(r)]
                for k, v in enumerate(r):  # ids within payloads and lists
                    if isinstance(v, str) and v.startswith("{") and len(v) > 1:
                        p = json.loads(v)
                        for key in ("evidence_id", "media_id"):
                            for x in [p, *p.get("evidence", []), *p.get("media", {}).get("assets", [])]:
                                if key in x:
                                    x[key] = mark(x[key])
                        if "evidence_ids" in p:
                            p["evidence_ids"] = [mark(x) for x in p["evidence_ids"]]
                        r[k] = json.dumps(p)
                    if name == "edges" and k == 5:
                        r[k] = [mark(x) for x in v]
                tables[name].append(r)
        want[i] = code
    frames = {name: spark.createDataFrame([tuple(r) for r in rows], TABLES[name]) for name, rows in tables.items()}
    found = {}
    for r in index_faults(frames, "g", "p").collect():
        found.setdefault(int(r.id.split(".")[0]), set()).add(r.code)
    assert 0 not in found
    for i, code in want.items():
        assert code is None or code in found.get(i, set()), (i, code, found.get(i))
    single = {"mixed_generation", "mixed_pipeline", "structure_generation", "segment_generation", "chunk_generation", "refs_missing", "pages_missing", "section_missing", "snapshot_hash", "media_generation", "media_link_relation", "media_link_endpoint", "parent_missing", "target_node_missing", "previous_chain", "next_chain"}
    assert all(found[i] == {code} for i, code in want.items() if code in single)


def test_no_books_and_no_generation(spark):
    frames = {name: spark.createDataFrame([], kind) for name, kind in TABLES.items()}
    assert {r.code for r in index_faults(frames, "g").collect()} == {"generation_missing", "books_missing"}


@pytest.mark.parametrize("n", [1, 5, 64])
def test_long_chains_and_cycles(spark, n):
    from lodestone.operators.validation import on_cycles

    chain = [("b", f"n{i}", f"n{i - 1}" if i else None) for i in range(n)]
    ring = [("b", f"r{i}", f"r{(i + 1) % n}") for i in range(n)] + [("b", "tail", "r0")]
    got = on_cycles(spark.createDataFrame(chain + ring, "book string, node string, parent string")).collect()
    assert {r.node for r in got} == {r[1] for r in ring}


@pytest.mark.parametrize("most", [0, 100_000])
def test_chunks_are_gathered_few_times_and_only_faulty_ones_one_by_one(spark, monkeypatch, most):
    from lodestone.operators import validation

    sizes, real = {}, validation.staged

    def counted(df, name):
        out = real(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(validation, "staged", counted)
    monkeypatch.setattr(validation, "MOST_FEW", most, raising=False)
    index, n = whole(), 40
    index["chunks"] = [["b", f"c{i}", "g", ["r"], [i % 6 + 1], "n2", "s1" if i % 6 < 3 else "s2", i, f"h{i}", f"e{i}", f"e{i - 1}" if i else None, f"e{i + 1}" if i < n - 1 else None] for i in range(n)]
    index["snapshots"][0][3] = json.dumps({"schema_version": "3", "content_hash": "h", "evidence": [{"evidence_id": f"e{i}"} for i in range(n)], "media": {"assets": [{"media_id": "m1"}]}})
    index["chunks"].append(["b", "bad", "g", ["r"], [7, None], "n9", "s9", 41, "h0", "", None, None])
    index["chunks"].append(["x", "lone", "g", ["r"], None, None, None, None, "h0", "e0", None, None])
    frames = {name: spark.createDataFrame([tuple(r) for r in rows], TABLES[name]) for name, rows in index.items()}
    found = index_faults(frames, "g", "p")
    got = sorted((r.code, r.id) for r in found.collect())
    assert got == sorted([("section_missing", "bad"), ("chunk_segment_missing", "bad"), ("chunk_page_invalid", "bad"), ("evidence_missing", "bad"), ("chunk_order_gap", "b"),
        ("section_missing", "lone"), ("chunk_segment_missing", "lone"), ("pages_missing", "lone"), ("chunk_order_duplicate", "x:None"), ("evidence_duplicate", "e0")])
    assert (sizes["faulty"], sizes["repeated"]) == (2, 0)
    monkeypatch.undo()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("chunk_overlap_duplicate") and plan.count("Window") <= 6
