"""Windows of evidence against a plain search over all spans."""

import random
import re

from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators import windows


def spans_of(parts):
    at, out = 0, []
    for p in parts:
        out.append((at, at + len(p), p))
        at += len(p)
    return out


def score(piece, wanted):
    words = set(re.findall(r"[a-z]+|\d+", piece.lower()))
    numbers = set(re.findall(r"\d+", piece))
    return sum(w in words for w in wanted) / len(wanted) + 0.25 * len(numbers & {w for w in wanted if w.isdigit()})


def best_table(text, wanted, most):
    lines, found, i = spans_of(text.splitlines(keepends=True)), [], 0
    while i < len(lines):
        j = i
        while j < len(lines) and lines[j][2].count("|") >= 2:
            j += 1
        if j - i >= 2:
            rule = [k for k in range(i, j) if not set(lines[k][2]) - set(" |-:\n")]
            rows = [k for k in range(i, j) if k not in rule and (not rule or k > rule[0] or rule[0] == j - 1)]
            if rows:
                top = max(rows, key=lambda k: (score(lines[k][2], wanted), k))
                begin = next(k for k in range(i, top + 1) if k == top or lines[top][1] - lines[k][0] <= most)
                begin -= begin == i > 0 and bool(lines[i - 1][2].strip()) and lines[top][1] - lines[i - 1][0] <= most
                found.append((lines[begin][0], lines[top][1], round(score(lines[top][2], wanted) + 0.25, 6)))
        i = max(j, i + 1)
    return max(found, key=lambda x: x[2], default=None)


def best_formula(text, wanted, most):
    lines = spans_of(text.splitlines(keepends=True))
    signs = [k for k, x in enumerate(lines) if "=" in x[2] or "α" in x[2]]
    if not signs:
        return None
    top = max(signs, key=lambda k: (score(lines[k][2], wanted), len(set(re.findall(r"\d+|α", lines[k][2]))), -k))
    lo, hi = max(0, top - 2), min(len(lines) - 1, top + 2)
    while lines[hi][1] - lines[lo][0] > most and lo < hi:
        lo, hi = (lo + 1, hi) if top - lo >= hi - top else (lo, hi - 1)
    return lines[lo][0], lines[hi][1], round(score(lines[top][2], wanted) + 0.2, 6)


def best_prose(text, wanted, most):
    parts = [(m.start(), m.end()) for m in re.finditer(r"\S(?:.*?[.!?](?=\s|$)|.*$)", text, re.S)]
    parts = [(a, a + len(text[a:b].rstrip())) for a, b in parts]
    top = max(range(len(parts)), key=lambda k: (score(text[slice(*parts[k])], wanted), -k))
    lo, hi = max(0, top - 1), min(len(parts) - 1, top + 1)
    while parts[hi][1] - parts[lo][0] > most and lo < hi:
        lo, hi = (lo + 1, hi) if top - lo > hi - top else (lo, hi - 1)
    return parts[lo][0], parts[hi][1], round(score(text[slice(*parts[top])], wanted), 6)


def made_texts(seed, n):
    r = random.Random(seed)
    word = lambda: r.choice(["pump", "valve", "rotor", "flow", "inlet", "17", "204", "35"])
    kinds = [lambda: f"| {word()} | {word()} |", lambda: "|---|---|", lambda: f"{word()} = {word()}", lambda: f"The {word()} has {word()}. No {word()} here! ", lambda: "", lambda: f"α {word()}"]
    for i in range(n):
        yield i, "The start.\n" + "\n".join(r.choice(kinds)() for _ in range(r.randint(1, 14))), sorted({word(), word()})


def test_windows_are_those_of_a_plain_search(spark):
    made = list(made_texts(5, 150))
    texts = spark.createDataFrame(made, "id long, text string, wanted array<string>").cache()
    lines = windows.scored_lines(texts)
    for most in (40, 90):
        for name, got, wants in (("table", windows.table_windows(lines, most), best_table), ("formula", windows.formula_windows(lines, most), best_formula), ("prose", windows.prose_windows(texts, most), best_prose)):
            rows = {r.id: (r.start, r.stop, round(r.score, 6)) for r in got.collect()}
            want = {i: w for i, text, wanted in made if (w := wants(text, wanted, most))}
            assert rows == want, (name, most)


def test_evidence_is_a_short_span_of_the_text_with_its_terms(spark):
    far = "lead in words " * 30
    cases = [
        (1, far + "the rotor turns quickly " + far, ["rotor"], None),
        (2, "Values\n| part | n |\n|---|---|\n| rotor | 17 |\nend", ["flow"], "table"),
        (3, "Flow rises.\nq = 17\nThen it falls.", ["flow"], "formula"),
        (4, "", ["flow"], None), (5, None, ["flow"], None), (6, "One. Two.", [], None), (7, "  \n ", ["x"], None),
    ]
    texts = spark.createDataFrame(cases, "id long, text string, wanted array<string>, kind string")
    got = {r.id: r for r in windows.evidence_windows(texts, 60).collect()}
    text = {c[0]: c[1] for c in cases}
    assert set(got) == {1, 2, 3, 6}
    for i, r in got.items():
        part = text[i][r.start : r.stop]
        assert 0 < len(part) <= 60 and part == part.strip()
    assert "rotor" in text[1][got[1].start : got[1].stop]
    assert (got[2].kind, got[3].kind, got[6].kind) == ("table", "formula", "prose")
    assert text[2][got[2].start : got[2].stop].startswith("Values")


def test_support_counts_terms_and_literals(spark):
    row = spark.createDataFrame([("Rotor 17 mm and rotor", ["rotor", "17"])], "p string, w array<string>")
    assert row.select(windows.support(F.col("p"), F.col("w"), t.technical_literals(F.array_join("w", " ")))).first()[0] == 1.0
