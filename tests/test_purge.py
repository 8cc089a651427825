"""Purge through JSON against plain walks over parsed values."""

import json
import random
from pathlib import Path

import pytest

from lodestone.operators import purge
from lodestone.plans import catalogue, purge_queries

DATA = Path("/root/testdata/sf0.001")

NAMES = ["doc-00001", "doc-00002", "seg-a1", "seg-b2", "file-x9", "file-y8", "e1", "unrelated", "zz"]


def value(r, depth=0):
    kind = r.random()
    if depth > 3 or kind < 0.35:
        return r.choice([*NAMES, "see doc-00001 and seg-a1.", "über file-x9", "", 7, None, True, 1.5])
    if kind < 0.6:
        return [value(r, depth + 1) for _ in range(r.randrange(4))]
    keys = ["document_id", "path", "source", "chunk_ids", "picture_refs", "note", "nested"]
    return {k: value(r, depth + 1) for k in r.sample(keys, r.randrange(5))}


def names_below(x, key=None):
    if isinstance(x, dict):
        return set().union(*[names_below(v, k) for k, v in x.items()])
    if isinstance(x, list):
        return set().union(*[names_below(v, key) for v in x])
    return {x} if isinstance(x, str) and x and key in purge.OWN_KEYS + purge.LIST_KEYS else set()


def objects(x):
    below = x.values() if isinstance(x, dict) else x if isinstance(x, list) else []
    return [o for y in below for o in objects(y)] + [x] * isinstance(x, dict)


def is_own(o, refs):
    return any(isinstance(o.get(k), str) and o[k] in refs for k in purge.OWN_KEYS)


def test_learnt_and_scrubbed_as_by_walks(spark):
    r = random.Random(5)
    values = [value(r) for _ in range(150)]
    records = spark.createDataFrame([("w", i, json.dumps(v)) for i, v in enumerate(values)] + [("other", 0, '{"path": "doc-00001"}'), ("w", 999, None)], "scope string, record int, text string")
    seeds = spark.createDataFrame([("w", "t", "doc-00001"), ("w", "u", "zz")], "scope string, target string, reference string")
    texts = purge.staged(purge.strings(records), "strings")
    found = purge.learned(texts, seeds)
    for target, start in (("t", "doc-00001"), ("u", "zz")):
        refs, before = {start}, None
        while refs != before:
            before = set(refs)
            for v in values:
                for o in objects(v):
                    if is_own(o, refs):
                        refs |= names_below(o)
        assert {x["reference"] for x in found.where(f"target = '{target}'").collect()} == refs
    only = spark.createDataFrame([("w", "doc-00001"), ("w", "seg-a1"), ("w", "e1")], "scope string, reference string")
    got = {(x["scope"], x["record"]): x for x in purge.scrubbed(records, only, texts).collect()}
    assert len(got) == 152 and got["other", 0]["state"] == "kept" and got["w", 999]["state"] == "kept"
    refs = ["doc-00001", "seg-a1", "e1"]
    states = set()
    for i, v in enumerate(values):
        want = purge.without(v, refs)
        row = got["w", i]
        states.add(row["state"])
        if row["state"] == "kept":
            assert json.loads(row["text"]) == v == want
        else:
            assert (json.loads(row["text"]) if row["text"] else None) == (want if want not in ({}, []) else None)
    assert states == {"kept", "changed", "gone"}


def test_only_the_targets_own_parts_go():
    x = {"sources": [{"document_id": "doc-00001", "n": 1}, {"document_id": "doc-00002", "note": "after doc-00001"}], "ids": ["doc-00001", "doc-000012", "e1"], "short": "e1 stays inside"}
    want = {"sources": [{"document_id": "doc-00002", "note": "after [purged-document]"}], "ids": ["[purged-document]2"], "short": "e1 stays inside"}
    assert purge.without(x, ["doc-00001", "e1"]) == want
    assert purge.without({"path": "e1"}, ["e1"]) is None


def test_pinned_and_unreadable_records_block(spark):
    pinned = spark.createDataFrame([("w", 1, '{"path": "e1"}'), ("w", 2, '["e1"]'), ("w", 3, '{"answer": "told by doc-00001."}'), ("w", 4, "{broken"), ("v", 5, '"doc-00001"'), ("w", 6, None)], "scope string, record int, text string")
    refs = spark.createDataFrame([("w", "t", "doc-00001"), ("w", "t", "e1"), ("v", "s", "nothing")], "scope string, target string, reference string")
    assert sorted(map(tuple, purge.blockers(pinned, refs).collect())) == [("t", 1), ("t", 3), ("t", 4)]


def test_unreadable_records_abort_a_purge(spark):
    records = spark.createDataFrame([("w", 4, "{broken")], "scope string, record int, text string")
    with pytest.raises(Exception, match="purge aborted"):
        purge.strings(records).collect()


def test_places_of_jobs_go_from_both_lists(spark):
    payload = {"sources": [{"path": "/a/one"}, {"path": "/b/two"}, {"path": "/c/three"}], "by": "/b/two"}
    result = {"documents": [{"document_id": "d1"}, {"document_id": "d2"}, {"note": "holds /a/one"}], "n": 3}
    jobs = spark.createDataFrame([("w", 1, json.dumps(payload), json.dumps(result)), ("w", 2, json.dumps({"sources": []}), None), ("v", 1, json.dumps(payload), None)], "scope string, record int, payload string, result string")
    refs = spark.createDataFrame([("w", "/a/one")], "scope string, reference string")
    got = {(x["scope"], x["record"]): x for x in purge.purged_jobs(jobs, refs).collect()}
    assert json.loads(got["w", 1]["payload"]) == {"sources": [{"path": "/b/two"}], "by": "/b/two"}
    assert json.loads(got["w", 1]["result"]) == {"documents": [{"document_id": "d2"}], "n": 3}
    assert [got[k]["touched"] for k in (("w", 1), ("w", 2), ("v", 1))] == [2, 0, 0]
    assert json.loads(got["v", 1]["payload"]) == payload and got["w", 2]["result"] is None


def test_what_a_name_leads_to_is_kept_once_for_all_records_and_targets(spark, monkeypatch):
    sizes, real = [], purge.staged

    def counted(df, name):
        out = real(df, name)
        sizes.append(out.count())
        return out

    records = spark.createDataFrame([("w", i, json.dumps({"document_id": "doc-00001", "source": f"file-{i % 3}"})) for i in range(300)], "scope string, record int, text string")
    texts = real(purge.strings(records), "strings")
    seeds = spark.createDataFrame([("w", t, "file-0") for t in range(5)], "scope string, target int, reference string")
    monkeypatch.setattr(purge, "staged", counted)
    found = {tuple(x) for x in purge.learned(texts, seeds).select("target", "reference").collect()}
    assert found == {(t, n) for t in range(5) for n in ("doc-00001", "file-0", "file-1", "file-2")}
    assert max(sizes) <= 20


def test_stored_texts_are_not_broadcast(spark):
    records = spark.createDataFrame([("w", i, json.dumps({"document_id": "doc-00001"})) for i in range(30)], "scope string, record int, text string")
    texts = purge.staged(purge.strings(records), "strings")
    refs = purge.staged(spark.createDataFrame([("w", "t", "doc-00001")], "scope string, target string, reference string"), "refs")
    assert "BroadcastHashJoin" not in purge.mentions(texts, refs)._jdf.queryExecution().executedPlan().toString()


def test_names_are_found_where_records_are_as_in_a_join(spark, monkeypatch):
    r = random.Random(8)
    records = spark.createDataFrame([("w", i, json.dumps(value(r))) for i in range(120)] + [("other", 0, '{"path": "doc-00001"}'), ("w", 998, '{"path": "e1", "note": "e1"}'), ("w", 999, None)], "scope string, record int, text string")
    refs = spark.createDataFrame([("w", n, x) for n, x in enumerate(["doc-00001", "seg-a1", "file-x9", "e1", "zz", "doc-00001"])], "scope string, target int, reference string")
    steps, real = [], purge.staged
    monkeypatch.setattr(purge, "staged", lambda df, name: steps.append(name) or real(df, name))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    every = lambda: [rows(x) for x in (purge.mentioned(records, refs), purge.blockers(records, refs), purge.scrubbed(records, refs))]
    got = every()
    assert "strings" not in steps  # each is found in the record's own task, so none is shuffled
    assert {kind for *_, kind in got[0]} == {"own", "equal", "inside"} and len(got[2]) == 123
    monkeypatch.setattr(purge, "MOST_REFERENCES", 0)
    assert every() == got
    assert "strings" in steps


def test_leads_by_records_are_those_by_strings(spark, monkeypatch):
    r = random.Random(9)
    records = spark.createDataFrame([("w", i, json.dumps(value(r))) for i in range(200)] + [("w", 999, None)], "scope string, record int, text string")
    seeds = spark.createDataFrame([("w", "t", "doc-00001"), ("w", "u", "zz"), ("other", "u", "e1")], "scope string, target string, reference string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(purge.learned(purge.staged(purge.strings(records), "strings"), seeds))
    assert len(want) > 6
    assert rows(purge.followed(purge.leads(records), seeds)) == want
    monkeypatch.setattr(purge, "MOST_REFERENCES", 0)
    assert rows(purge.followed(purge.leads(records), seeds)) == want


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["learned_references", "purged_payloads", "pinned_mentions", "struck_sources"])
def test_purges_shuffle_numbers_and_stage_no_texts(spark, monkeypatch, name):
    staged = []
    for module in (purge, purge_queries):
        monkeypatch.setattr(module, "staged", lambda df, step, _real=module.staged: staged.append((step, df.columns)) or _real(df, step))
    catalogue.QUERIES[name](spark, str(DATA))
    assert {"leads"} <= {step for step, _ in staged} and "strings" not in {step for step, _ in staged}
    assert not [columns for _, columns in staged if {"text", "payload"} & set(columns)]
