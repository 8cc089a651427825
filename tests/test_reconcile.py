"""Outlines out of three kinds of signals, against a plain version that compares all with all."""

import hashlib
import random
import re
import unicodedata
from statistics import median

from pyspark.sql import functions as F

from lodestone.operators import reconcile

BOOKS = "book string, total_pages int"
MARKS = "book string, at int, title string, depth int, page int, ref string"
HEADS = "book string, at int, title string, page int, level int, confidence double, ref string"
NUMBER = re.compile(r"^\s*(?:(?:chapter|kapitel|teil|part|article|artikel)\s+)?((?:\d+|[IVXLCDM]+)(?:\.\d+)*)(?:[.):]?\s+)", re.I)


def plain(title):
    bare = "".join(c for c in unicodedata.normalize("NFKD", title) if not unicodedata.combining(c))
    return " ".join(re.sub("[^a-z0-9]+", " ", bare.casefold()).split())


def similar(a, b):
    x, y = (set(plain(NUMBER.sub("", s.strip())).split()) for s in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


def number(title):
    m = NUMBER.match(title)
    return None if not m else m[1].count(".") if m[1][0].isdigit() else 0


def pair(a, h):
    apart = abs(a["page"] - h["page"])
    page = 1.0 if apart == 0 else 0.8 if apart <= 2 else 0.4 if apart <= 5 else 0.0
    of_number = 1.0 if number(h["title"]) in (None, a["depth"]) else 0.4
    level = 1.0 if h["level"] is None or max(0, h["level"] - 1) == a["depth"] else 0.5
    return 0.55 * similar(a["title"], h["title"]) + 0.25 * page + 0.10 * of_number + 0.10 * level


def chain(scored):
    """The heaviest rising chain, by all pairs of pairs; the first found of equals."""
    rows = sorted(scored, key=lambda r: (r[0], -r[1]))
    best = []
    for a, h, s in rows:
        before = max([(w, -j) for j, (w, _) in enumerate(best) if rows[j][0] < a and rows[j][1] < h] + [(0.0, 1)])
        best.append((before[0] + s, -before[1]))
    at = max([(w, -j) for j, (w, _) in enumerate(best)] + [(0.0, 1)])
    at, out = -at[1], {}
    while at >= 0:
        out[rows[at][0]] = (rows[at][1], rows[at][2])
        at = best[at][1]
    return out


def outline(total, bookmarks, contents, headings, scanned=()):
    headings = sorted(headings, key=lambda h: (h["page"], h["at"], h["title"]))
    behind, found = 0, {}
    for i, c in enumerate(sorted(contents, key=lambda c: c["at"])):
        score, j = max([(similar(c["title"], h["title"]), -j) for j, h in enumerate(headings) if j >= behind] + [(0.0, 0)])
        if score >= 0.82:
            found[i], behind = (headings[-j], score), 1 - j
    lines = sorted(contents, key=lambda c: c["at"])
    moved = [found[i][0]["page"] - c["page"] for i, c in enumerate(lines) if c["page"] is not None and i in found]
    by = round(median(moved)) if len(moved) >= 3 else 0
    by = by if len(moved) >= 3 and median(abs(x - by) for x in moved) <= 1 else 0
    anchors = [{**b, "kind": "bookmark", "trust": 0.98} for b in sorted(bookmarks, key=lambda b: (b["page"], b["depth"], b["at"], b["title"]))]
    for i, c in enumerate(lines):
        h, score = found.get(i, (None, 0.0))
        if c["page"] is None and h is None:
            continue
        page = min(total, max(1, h["page"] if score >= 0.9 or c["page"] is None else c["page"] + by))
        if not any(similar(a["title"], c["title"]) >= 0.9 and abs(a["page"] - page) <= 2 for a in anchors):
            anchors.append({**c, "page": page, "kind": "printed-toc", "trust": 0.92})
    anchors.sort(key=lambda a: (a["page"], a["depth"], a["title"]))
    if not anchors and (not headings or (total > 20 and len(headings) < 3)):
        out, at = [], 1
        while at <= total:
            end = at
            while end < total and end + 1 - at < (4 if at in scanned else 8) and (end + 1 in scanned) == (at in scanned):
                end += 1
            out.append((f"Seiten {at}–{end}", 0, None, at, end, "window", 0.45, []))
            at = end + 1
        return out
    met = chain([(i, j, s) for i, a in enumerate(anchors) for j, h in enumerate(headings) if (s := pair(a, h)) >= 0.68])
    nodes = []
    for i, a in enumerate(anchors):
        h, s = (headings[met[i][0]], met[i][1]) if i in met else (a, 1.0)
        nodes.append([h["title"], h["page"], min(6, a["depth"]), "mixed" if i in met else a["kind"], min(a["trust"], s), [x for x in dict.fromkeys([a["ref"], h["ref"]]) if x]])
    taken = {j for j, _ in met.values()}
    for j, h in enumerate(headings):
        if j not in taken and not any(abs(n[1] - h["page"]) <= 1 and similar(n[0], h["title"]) >= 0.9 for n in nodes):
            d = number(h["title"])
            nodes.append([h["title"], h["page"], min(6, d if d is not None else max(0, (h["level"] or 1) - 1)), "body-heading", 0.85 if d is not None else h["confidence"], [h["ref"]] if h["ref"] else []])
    nodes.sort(key=lambda n: (n[1], n[2], n[0]))
    one = {}
    for n in nodes:
        first = one.setdefault((n[1], n[2], plain(n[0])), n)
        if first is not n:
            first[4], first[5] = max(first[4], n[4]), list(dict.fromkeys(first[5] + n[5]))
            first[3] = first[3] if first[3] == n[3] else "mixed"
    out, stack = [], []
    for n in one.values():
        while stack and stack[-1][1] >= n[2]:
            stack.pop()
        depth = 0 if not stack else min(n[2], stack[-1][1] + 1)
        stack.append((len(out), depth))
        out.append([n[0], depth, stack[-2][0] if len(stack) > 1 else None, n[1], None, n[3], n[4], n[5]])
    for i, n in enumerate(out):
        end = next((x[3] for x in out[i + 1 :] if x[1] <= n[1] and x[3] > n[3]), total + 1) - 1
        n[4] = max(n[3], end)
    return [tuple(n) for n in out]


def random_book(name):
    vocabulary = "Zement Wasser Beton Grundlagen Festigkeit Planung Stoffe Prüfung".split()
    title = lambda: random.choice(["", "1 ", "2.1 ", "IV. ", "Kapitel 3 "]) + " ".join(random.sample(vocabulary, random.randrange(1, 4)))
    total = random.choice([12, 40, 90])
    page = lambda: random.randrange(1, total + 1)
    n = random.choice([0, 0, 1, 6, 15])
    heads = [(name, i, title(), page(), random.choice([None, 0, 1, 2, 3, 9]), 0.65, f"h{i}") for i in range(random.choice([0, 2, 8, 25]))]
    marks = [(name, i, title(), random.randrange(4), page(), f"b{i}") for i in range(n)]
    lines = [(name, i, random.choice(heads)[2].upper() if heads and random.random() < 0.6 else title(), random.randrange(3), random.choice([None, page()]), None) for i in range(random.choice([0, n, 12]))]
    if heads:  # labels that lag by three pages
        lines += [(name, 50 + i, h[2], 0, h[3] - 3 if h[3] > 3 else None, f"c{i}") for i, h in enumerate(sorted(heads, key=lambda h: h[3])[:6])]
    return total, marks, lines, heads


def frames(spark, books, marks, lines, heads):
    return spark.createDataFrame(books, BOOKS), spark.createDataFrame(marks, MARKS), spark.createDataFrame(lines, MARKS), spark.createDataFrame(heads, HEADS)


def as_dicts(rows, schema):
    return [dict(zip([c.split()[0] for c in schema.split(", ")], r, strict=True)) for r in rows]


def nodes_of(rows):
    at = {(r.book, r.node_id): r.ordinal for r in rows}
    return [(r.title, r.depth, None if r.parent_id is None else at[r.book, r.parent_id], r.page_start, r.page_end, r.source_kind, round(r.confidence, 9), list(r.refs)) for r in sorted(rows, key=lambda r: r.ordinal)]


def test_outlines_equal_a_plain_version(spark):
    random.seed(21)
    made = {f"b{i}": random_book(f"b{i}") for i in range(40)}
    scans = {"b1": {2, 3, 9}, "b2": {1}}
    books = [(k, v[0]) for k, v in made.items()]
    parts = [[r for v in made.values() for r in v[i]] for i in (1, 2, 3)]
    scanned = spark.createDataFrame([(b, p) for b, s in scans.items() for p in s], "book string, page int")
    got = reconcile.reconciled(*frames(spark, books, *parts), scanned).collect()
    kinds = set()
    for book, (total, *_) in made.items():
        marks, lines, heads = (as_dicts([r for r in part if r[0] == book], s) for part, s in zip(parts, (MARKS, MARKS, HEADS), strict=True))
        want = outline(total, marks, lines, heads, scans.get(book, ()))
        assert nodes_of([r for r in got if r.book == book]) == [(*n[:6], round(n[6], 9), n[7]) for n in want], book
        kinds |= {n[5] for n in want}
    assert kinds == {"bookmark", "printed-toc", "mixed", "body-heading", "window"}


def test_bookmarks_take_headings_and_awkward_rows_stay_out(spark):
    marks = [("x", 1, "Grundlagen", 0, 4, "b1"), ("x", 2, "Zément", 1, 7, None), ("x", 3, "  ", 0, 9, None), ("x", 4, None, 0, 9, None), ("x", 5, "Ohne", None, 9, None), (None, 6, "Fremd", 0, 9, None), ("y", 7, "Fremd", 0, 9, None)]
    heads = [("x", 1, "1 Grundlagen", 4, 1, None, "h1"), ("x", 2, "1.1 Zement", 7, 1, None, None), ("x", 3, "1.1 Zement", 7, 1, None, None), ("x", 4, "Weg", None, 1, None, None)]
    books, b, c, h = frames(spark, [("x", 30), ("x", 30), ("z", 5), ("n", None), ("o", 0)], marks, [], heads)
    got = reconcile.reconciled(books, b.withColumn("words", F.lit(1)), c, h.withColumn("h", F.lit("clash")).withColumn("total_pages", F.lit(1))).orderBy("book", "ordinal").collect()
    assert [(r.book, r.title, r.depth, r.page_start, r.page_end, r.source_kind, list(r.refs)) for r in got] == [
        ("x", "1 Grundlagen", 0, 4, 30, "mixed", ["b1", "h1"]), ("x", "1.1 Zement", 1, 7, 30, "mixed", []), ("z", "Seiten 1–5", 0, 1, 5, "window", [])]
    assert got[1].parent_id == got[0].node_id == "sec-" + hashlib.sha256(b"x\x001 grundlagen\x004\x000").hexdigest()[:24]
    modes = {r.book: (r.mode, r.n_nodes) for r in reconcile.summary(reconcile.reconciled(books, b, c, h), b, c).collect()}
    assert modes == {"x": ("bookmarks", 2), "z": ("window-fallback", 1)}
    assert reconcile.reconciled(*(df.limit(0) for df in (books, b, c, h))).count() == 0
