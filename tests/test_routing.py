"""Routed retrieval against a walk over plain dictionaries."""

import random
from pathlib import Path

import pytest

from lodestone.operators import routing
from lodestone.plans import routing_queries

DATA = Path("/root/testdata/sf0.001")

WORDS = [f"t{i}" for i in range(9)]
SECTIONS = [f"n{i}" for i in range(6)]


def workspace(seed):
    r = random.Random(seed)
    pick = lambda xs, none=0.0: None if r.random() < none else r.choice(xs)
    docs = ["a", "b"]
    targets = [(pick(docs), pick(WORDS), f"k{i}", pick(SECTIONS, 0.2), pick(["e1", "e2", "e3", "e4", ""], 0.3), r.randrange(4), r.randrange(3) / 2, pick(["defined", "mentioned"])) for i in range(40)]
    chunks = [(pick(docs), f"c{i}", pick(["e1", "e2", "e3"], 0.2), pick(SECTIONS, 0.1), pick(["s0", "s1"], 0.1), r.randrange(5)) for i in range(14)]
    nodes = [(d, n, i, i / 10) for d in docs for i, n in enumerate(SECTIONS) if r.random() < 0.8]
    ends = {"alias_of": WORDS, "see_also": WORDS, "co_occurs": WORDS, "parent_of": SECTIONS, "next_section": SECTIONS, "other": WORDS}
    edges = []
    for i in range(70):
        kind = pick(list(ends))
        edges.append((pick(docs), f"x{i:02}", pick(ends[kind]), pick(ends[kind]), kind, r.randrange(3) / 2))
    terms = [(d, w) for d in docs for w in WORDS if r.random() < 0.8]
    seeds = [(q, i + 1, pick(docs), w) for q in range(4) for i, w in enumerate(r.sample(WORDS + SECTIONS + ["gone"], 5))]
    return seeds, targets, chunks, nodes, edges, terms


def walk(data, limit, segments, expand, everywhere, adjacent):
    seeds, targets, chunks, nodes, edges, terms = data
    may = lambda c: segments is None or c[4] in segments

    def stand_in(doc, node):
        return min(((c[5], c[1], c[2]) for c in chunks if c[0] == doc and c[3] == node and may(c)), key=lambda x: x[:2], default=None)

    def of_term(doc, term, path=None, edge=None):
        out = []
        for _, _, key, node, evidence, page, sure, relation in sorted((t for t in targets if t[:2] == (doc, term)), key=lambda t: (-t[6], t[5], t[2])):
            chunk = None
            same = [c for c in chunks if evidence and c[0] == doc and c[2] == evidence]
            if good := sorted((c[5], c[1]) for c in same if may(c)):
                chunk = good[0][1]
            elif not same and node and (found := stand_in(doc, node)):
                _, chunk, evidence = found
            if chunk or segments is None:
                out.append((doc, term, node, evidence or None, chunk, path or f"book-{relation}", edge))
        return out[:4]

    def section(doc, node, term, path, edge=None):
        if (doc, node) not in {n[:2] for n in nodes}:
            return []
        found = stand_in(doc, node)
        return [(doc, term, node, found and found[2], found and found[1], path, edge)] if found or segments is None else []

    results = []
    for q in sorted({s[0] for s in seeds}):
        waiting = []
        for _, _, doc, term in sorted(s for s in seeds if s[0] == q):
            queue = of_term(doc, term) or section(doc, term, term, "book-section")
            if not queue and segments is None:
                queue = [(doc, term, None, None, None, "book-term", None)]
            homes = sorted({i[2] for i in queue if i[2]})
            about = sorted((e for e in edges if e[0] == doc), key=lambda e: (-e[5], e[1]))
            if expand and (doc, term) in terms:
                together = 0
                for _, edge, a, b, kind, _ in about:
                    if kind in routing.BETWEEN_TERMS and term in (a, b) and (doc, other := b if a == term else a) in terms:
                        more = of_term(doc, other, f"book-graph-{kind}", edge)
                        if kind == "co_occurs":
                            more = more[: 4 - together]
                            together += len(more)
                        queue += more
            if everywhere:
                for here in homes:
                    for _, edge, a, b, kind, _ in about:
                        if kind == "parent_of" and here in (a, b):
                            queue += section(doc, b if a == here else a, term, "book-graph-child" if a == here else "book-graph-parent", edge)
            if adjacent:
                done = set()
                for here in homes:
                    for way, near, far in (("next", 2, 3), ("previous", 3, 2)):
                        first = next((e for e in about if e[4] == "next_section" and e[near] == here), None)
                        if way not in done and first and (more := section(doc, first[far], term, f"book-graph-{way}", first[1])):
                            queue += more
                            done.add(way)
            waiting.append(queue)
        seen, n = set(), 0
        while any(waiting) and n < limit:
            for queue in waiting:
                while queue and n < limit:
                    item = queue.pop(0)
                    if (identity := (item[0], item[4] or item[3] or item[2] or item[1])) not in seen:
                        seen.add(identity)
                        n += 1
                        results.append((q, n, *item))
                        break
    return results


SCHEMAS = [
    "query int, seed int, doc string, term string", "doc string, term string, key string, node string, evidence string, page int, confidence double, relation string",
    "doc string, chunk string, evidence string, node string, segment string, place int", "doc string, node string, page int, confidence double",
    "doc string, edge string, source string, target string, relation string, weight double", "doc string, term string"]


def frames(spark, data):
    return [spark.createDataFrame(rows, schema) for rows, schema in zip(data, SCHEMAS, strict=True)]


@pytest.mark.parametrize(("seed", "limit", "segments", "flags"), [(1, 12, None, (True, True, True)), (2, 12, ["s0"], (True, True, True)), (3, 3, ["s0", "s1"], (True, False, True)), (4, 12, None, (False, False, False)), (5, 40, ["s1"], (True, True, True)), (6, 40, None, (True, True, True))])
def test_routes_as_a_walk_takes_them(spark, seed, limit, segments, flags):
    data = workspace(seed)
    got = routing.routed(routing.queues(*frames(spark, data), limit, segments, *flags), limit)
    columns = ["query", "place", "doc", "term", "node", "evidence", "chunk", "path", "edge"]
    want = walk(data, limit, segments, *flags)
    assert want and sorted(tuple(r) for r in got.select(columns).collect()) == want


def test_nothing_admitted_and_empty_tables_give_nothing(spark):
    offers = routing.queues(*frames(spark, workspace(7)), 5, [], True, True, True)
    assert routing.routed(offers, 5).count() == 0
    assert routing.routed(routing.queues(*frames(spark, [[]] * 6), 5, None, True, True, True), 5).count() == 0


def test_more_seeds_than_stated_raise(spark):
    offers = routing.queues(*frames(spark, workspace(8)), 5)
    with pytest.raises(Exception, match="over 1"):
        routing.routed(offers, 5, most_seeds=1).collect()


def test_a_hot_term_keeps_only_what_can_be_used(spark):
    edges = [("a", f"x{i:04}", "t", f"u{i}", "see_also", 1.0) for i in range(500)]
    targets = [("a", f"u{i}", "k", "n", None, 1, 1.0, "defined") for i in range(500)]
    data = ([(0, 1, "a", "t")], targets, [("a", f"c{i}", None, f"m{i}", "s", i) for i in range(3)], [("a", "n", 1, 1.0)], edges, [("a", "t")] + [("a", f"u{i}") for i in range(500)])
    found = routing.queues(*frames(spark, data), 6, None, True).collect()
    # Every target stands for section n alone, as none has a chunk: one identity beside the bare term.
    assert sorted((r["identity"], r["path"]) for r in found) == [("n", "book-graph-see_also"), ("t", "book-term")]


def test_a_term_that_many_ask_for_is_expanded_once(spark, monkeypatch):
    sizes, real = [], routing.staged

    def counted(df, name):
        out = real(df, name)
        sizes.append((name, out.count()))
        return out

    edges = [("a", f"x{i}", "t", f"u{i}", "see_also", 1.0) for i in range(3)]
    targets = [("a", f"u{i}", "k", "n", f"e{i}", 1, 1.0, "defined") for i in range(3)]
    chunks = [("a", f"c{i}", f"e{i}", "n", "s", i) for i in range(3)]
    data = ([(q, 1, "a", "t") for q in range(40)], targets, chunks, [("a", "n", 1, 1.0)], edges, [("a", "t")] + [("a", f"u{i}") for i in range(3)])
    monkeypatch.setattr(routing, "staged", counted)
    found = routing.queues(*frames(spark, data), 6, ["s"], True).collect()
    assert sorted((r["query"], r["chunk"]) for r in found) == [(q, f"c{i}") for q in range(40) for i in range(3)]
    assert ("seeds", 1) in sizes and ("queues", 3) in sizes


@pytest.mark.parametrize(("seed", "limit", "segments"), [(11, 12, None), (12, 4, ["s0"])])
def test_turns_over_identities_are_those_over_whole_queues(spark, seed, limit, segments):
    data = frames(spark, workspace(seed))
    rows = lambda df: sorted(map(tuple, df.select("query", "place", "seed", *routing.ITEM).collect()), key=repr)
    want = rows(routing.routed(routing.queues(*data, limit, segments, True, True, True), limit))
    assert want and rows(routing.retrieved(*data, limit, segments, True, True, True)) == want
    with pytest.raises(Exception, match="over 1"):
        routing.retrieved(*data, limit, segments, True, True, True, most_seeds=1).collect()


def test_sections_around_are_sought_only_for_queues_that_are_not_full(spark, monkeypatch):
    sizes, real = {}, routing.staged

    def counted(df, name):
        out = real(df, name)
        sizes[name] = out.count()
        return out

    n = 30
    targets = [("a", f"t{i}", f"k{j}", "n1", f"e{i}-{j}", j, 1.0, "defined") for i in range(n) for j in range(4)]
    chunks = [("a", f"c{i}-{j}", f"e{i}-{j}", "n1", "s", j) for i in range(n) for j in range(4)]
    nodes = [("a", f"n{i}", i, 1.0) for i in range(3)]
    edges = [("a", "up", "n0", "n1", "parent_of", 1.0), ("a", "on", "n1", "n2", "next_section", 1.0)]
    data = ([(i, 1, "a", f"t{i}") for i in range(n)] + [(n, 1, "a", "n2")], targets, chunks + [("a", "x0", "f0", "n0", "s", 1), ("a", "x2", "f2", "n2", "s", 1)], nodes, edges, [("a", f"t{i}") for i in range(n)])
    monkeypatch.setattr(routing, "staged", counted)
    found = routing.queues(*frames(spark, data), 4, ["s"], True, True, True).collect()
    assert sizes["home"] == 1
    assert sorted((r["query"], r["at"], r["identity"]) for r in found) == sorted([(i, j + 1, f"c{i}-{j}") for i in range(n) for j in range(4)] + [(n, 1, "x2"), (n, 2, "c0-0")])


def test_many_terms_are_resolved_without_a_broadcast_as_few_are(spark, monkeypatch):
    monkeypatch.setattr(routing, "MOST_TERMS", 0)
    data = workspace(14)
    got = routing.retrieved(*frames(spark, data), 12, ["s0"], True, True, True)
    assert sorted(tuple(r) for r in got.select("query", "place", "doc", "term", "node", "evidence", "chunk", "path", "edge").collect()) == walk(data, 12, ["s0"], True, True, True)


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_lines_meet_parts_once(spark):
    _, targets, chunks, *_ = routing_queries.book(spark, str(DATA))
    for df in (targets, chunks):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
