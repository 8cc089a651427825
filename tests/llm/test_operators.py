"""Operators of the training-data subpackage against brute force, on small tables with awkward rows."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import toxicity
from lodestone.llm.common import mix64
from lodestone.llm.knn import top_k
from lodestone.llm.lines import remove_repeated_runs
from lodestone.llm.mixing import Mix, mixture
from lodestone.llm.near import cells, darts, keep_first, near_duplicates, Words
from lodestone.llm.packing import Encoder, in_id_order, pack
from lodestone.llm.privacy import pseudonymised
from lodestone.llm.quality import quality, repeated_words
from lodestone.llm.queries import vocabulary
from lodestone.llm.repeats import remove_repeats
from lodestone.llm.tokens import Counter as TokenCounter
from lodestone.llm.tokens import Merges, count_tokens, in_slices

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [None, "", " ", "\n\n", "a", "a" * 30_000, "\x00" * 120, "don't <|endoftext|> WE'LL ½² 日本語 🙂", "x y\nx y\nx y\nx y"]


def table(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, ["en", None][i % 2], ["s1", "s2", None][i % 3], None if t is None else len(t)) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, AWKWARD).unionByName(spark.createDataFrame([(None, "no id", None, None, None), (4, "a", "en", "s1", 1), (4, "a", "en", "s1", 1)], SCHEMA))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def words():
    random.seed(5)
    return ["".join(random.choice("abcdefghij") for _ in range(random.randrange(2, 7))) for _ in range(400)]


# --- operator 1


def removed_by_brute_force(texts, n=50):
    first = {}
    for k in sorted(texts):
        for i in range(len(texts[k]) - n + 1):
            first.setdefault(texts[k][i : i + n], k)
    out = {}
    for k, t in texts.items():
        spans = []
        for i in range(len(t) - n + 1):
            if first[t[i : i + n]] < k:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + n
                else:
                    spans.append([i, i + n])
        out[k] = spans
    return out


def test_repeats_match_brute_force(spark):
    random.seed(3)
    syllables = ["ab", "cab", "bca", "é", "\x00", "日本"]
    blocks = ["".join(random.choice(syllables) for _ in range(60)) for _ in range(6)] + ["x", "yz"]
    texts = {i: "".join(random.choice(blocks) for _ in range(random.randrange(6))) for i in range(60)}
    texts |= {100: "a" * 3000, 101: "a" * 70, 102: "b" * 49, 103: "", 104: "a" * 49 + "b", 105: "\x00" * 200, 106: "q" + "\x00" * 120 + "z"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in remove_repeats(df).collect()}
    for k, spans in removed_by_brute_force({k: t.encode() for k, t in texts.items()}).items():
        raw = texts[k].encode()
        assert [[s.start, s.stop] for s in got[k].removed] == spans
        edges = [0, *(x for s in spans for x in s), len(raw)]
        assert bytes(got[k].kept) == b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def test_repeats_of_awkward_rows(spark, docs, empty):
    assert remove_repeats(docs).count() == docs.count()
    assert remove_repeats(empty).count() == 0
    same = spark.createDataFrame([(1, "q" * 80), (1, "q" * 80), (None, "q" * 80)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, len(r.kept)) for r in remove_repeats(same).collect()) == [(0, 0), (1, 80), (1, 80)]


def test_adjacent_repeated_rows_keep_their_places(spark):
    random.seed(11)
    letters = lambda n: "".join(random.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    shared = [letters(90) for _ in range(3)]
    again = letters(3000) + shared[0] + letters(2000) + shared[1] + letters(3000) + shared[2] + letters(500)
    texts = {0: letters(100).join(shared), 1: again}
    rows = [(0, texts[0]), *[(1, again)] * 3, *[(None, again)] * 2]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = [(r.doc_id, [[s.start, s.stop] for s in r.removed]) for r in remove_repeats(df).collect()]
    spans = removed_by_brute_force({k: t.encode() for k, t in texts.items()})
    assert len(spans[1]) == 3
    assert sorted(got, key=str) == sorted([(0, []), *[(1, spans[1])] * 3, *[(None, [[0, len(again)]])] * 2], key=str)


# --- operator 2


def test_line_runs_match_brute_force(spark):
    random.seed(4)
    pool = [f"line {i}" for i in range(12)] + ["", "  ", " ".join(["w"] * 60)]
    texts = ["\n".join(random.choice(pool) for _ in range(random.randrange(14))) for _ in range(80)]
    got = {r.doc_id: r for r in remove_repeated_runs(table(spark, texts)).collect()}
    seen, gone = set(), {}
    for k, t in enumerate(texts):
        lines = [(i, x.strip(" ")) for i, x in enumerate(t.split("\n")) if x.strip(" ")]
        gone[k] = set()
        for n in (3, 1):
            for i in range(len(lines) - n + 1):
                content = tuple(x for _, x in lines[i : i + n])
                if n == 1 and len(content[0].split()) < 50:
                    continue
                if content in seen:
                    gone[k].update(range(lines[i][0], lines[i + n - 1][0] + 1))
                seen.add(content)
    for k, t in enumerate(texts):
        kept = [x for i, x in enumerate(t.split("\n")) if i not in gone[k] or not x.strip(" ")]
        want = t if not gone[k] else "\n".join(kept) if any(x.strip(" ") for x in kept) else ""
        assert got[k].text == want


def test_runs_of_two_lines_go_by_their_words(spark):
    random.seed(13)
    pool = [" ".join(f"{c}{i}" for i in range(n)) for c, n in zip("abcdefghij", (1, 2, 20, 26, 30, 30, 45, 49, 55, 60), strict=True)] + ["", " "]
    texts = ["\n".join(random.choice(pool) for _ in range(random.randrange(9))) for _ in range(120)]
    two = pool[4] + "\n\n" + pool[5]
    texts = [two, f"alone\n{two}\nother", *texts]
    got = {r.doc_id: r for r in remove_repeated_runs(table(spark, texts), by_words=True).collect()}
    seen = set()
    for k, t in enumerate(texts):
        lines = [(i, x.strip(" ")) for i, x in enumerate(t.split("\n")) if x.strip(" ")]
        gone = set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                content = tuple(x for _, x in lines[a:b])
                if b - a < 3 and sum(len(x.split()) for x in content) < 50:
                    continue
                if content in seen:
                    gone.update(range(lines[a][0], lines[b - 1][0] + 1))
                seen.add(content)
        kept = [x for i, x in enumerate(t.split("\n")) if i not in gone or not x.strip(" ")]
        want = t if not gone else "\n".join(kept) if any(x.strip(" ") for x in kept) else ""
        assert got[k].text == want
    assert got[1].text == "alone\n\nother"


def test_line_runs_of_a_very_long_text(spark):
    lines = [f"line {i % 30_000}" if i % 7 else "" for i in range(100_000)]
    rows = [(1, "\n".join(lines), "own"), (2, "x\n" + "\n".join(lines[:50_000]) + "\ny", "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_runs string")
    got = {r.doc_id: r for r in remove_repeated_runs(df).collect()}
    solid = [i for i, x in enumerate(lines) if x]
    seen, gone = set(), set()
    for a in range(len(solid) - 2):
        some = solid[a : a + 3]
        content = tuple(lines[i] for i in some)
        if content in seen:
            gone.update(some)
        seen.add(content)
    assert got[1].n_removed == len(gone) and got[1].text == "\n".join(x for i, x in enumerate(lines) if i not in gone)
    assert got[2].n_removed == sum(1 for x in lines[:50_000] if x) and got[2].text.replace("\n", "") == "xy" and got[2].n_runs == "other"


def test_line_runs_keep_names_and_nulls(spark, docs, empty):
    out = remove_repeated_runs(docs.withColumn("n_lines", F.lit("own")))
    assert out.columns[-3:] == ["_n_lines", "n_removed", "n_runs"] and out.count() == docs.count()
    assert out.where("text IS NULL").count() == 1
    assert remove_repeated_runs(empty).count() == 0


# --- operator 3


def test_toxicity_learns_and_locates(spark, words):
    random.seed(6)
    texts, labels = [], []
    for i in range(600):
        sentences = [" ".join(random.choice(words) for _ in range(8)) for _ in range(random.randrange(1, 9))]
        bad = i % 4 == 0
        if bad:
            sentences[random.randrange(len(sentences))] += random.choice([" grobian", " grobly", " vileness"])
        texts.append(". ".join(sentences))
        labels.append((i, int(bad)))
    frame = table(spark, texts)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(frame, known)
    rows = toxicity.score(frame, model).withColumn("held_out", toxicity.held_out()).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum((r.score >= 0.7) == (r.doc_id % 4 == 0) for r in held) / len(held) > 0.95
    for r in rows:
        if r.doc_id % 4 == 0 and r.offending:
            assert any("grob" in texts[r.doc_id][s.start : s.end] or "vile" in texts[r.doc_id][s.start : s.end] for s in r.offending)
    kept = {r.doc_id for r in toxicity.keep_clean(frame, model).collect()}
    assert kept == {r.doc_id for r in rows if r.score < 0.7}


def test_toxicity_of_awkward_rows(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1), (None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect())
    assert toxicity.keep_clean(docs, model).count() == docs.count()
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


# --- operator 4


def test_mixture_follows_weights(spark):
    rows = [(i, "x" * 40, "en" if i % 10 else "de", f"s{i % 3}", "web" if i % 4 else "book") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain string")
    mix = Mix({"domain": {"web": 1, "book": 1}}, share=(1, 2), epochs=2)
    out = mixture(df, mix)
    assert out.columns == [*df.columns, "epoch"]
    got = Counter(r.domain for r in out.collect())
    # 10 tokens a document: book holds 500 documents, twice at most; each domain's half of 1000 is 500 documents.
    assert abs(got["book"] - 500) < 10 and abs(got["web"] - 500) < 10
    short = mixture(df, Mix({"domain": {"web": 1, "book": 9}}, share=(1, 1), epochs=1))
    assert Counter(r.domain for r in short.collect())["book"] == 500  # all it has; the rest goes to its sibling
    assert short.count() == 2000


def test_mixture_prefix_is_whole_over_many_buckets(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"))
    out = mixture(df, Mix(share=(1, 3), epochs=1)).select("doc_id").collect()
    order = sorted(range(30_000), key=lambda i: hashlib.md5(f"7:0:{i}".encode()).hexdigest())
    assert {r.doc_id for r in out} == set(order[:10_000])


def test_mixture_of_awkward_rows(docs, empty):
    assert mixture(docs.withColumn("epoch", F.lit(1)), Mix(share=(1, 1), epochs=1)).columns[-1] == "_epoch"
    assert mixture(docs, Mix(share=(1, 1), epochs=1)).count() == docs.count()
    assert mixture(empty).count() == 0


# --- operator 5


def weighted(t):
    w = t.lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_dart_signatures_estimate_weighted_similarity():
    a = " ".join(f"w{i}" for i in range(300))
    b = a.replace("w7 ", "v7 ").replace("w150 ", "v150 ") + " w1 w2 w3 w4 w5 w6"
    cell, owner = cells([a, b, ""], Words())
    sig = darts(cell, owner, 3, 1024)
    x, y = weighted(a), weighted(b)
    true = sum((x & y).values()) / sum((x | y).values())
    assert abs((sig[0] == sig[1]).mean() - true) < 0.05
    assert (darts(cell[owner == 1], owner[owner == 1] - 1, 1, 1024)[0] == sig[1]).all()  # the batch doesn't matter


def test_near_duplicates_match_brute_force(spark, words):
    random.seed(8)
    texts = []
    for _ in range(25):
        base = [random.choice(words) for _ in range(random.randrange(30, 200))]
        for _ in range(random.randrange(1, 6)):
            copy = list(base)
            for _ in range(random.randrange(5)):
                copy[random.randrange(len(copy))] = random.choice(words)
            texts.append(" ".join(copy))
    texts += ["", "", "one two", "one two", "ONE two"]
    got = {r.doc_id: r.class_id for r in near_duplicates(table(spark, texts)).collect()}
    root = list(range(len(texts)))
    sets = [weighted(t) for t in texts]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        union = sum((sets[a] | sets[b]).values())
        if texts[a] == texts[b] or union and sum((sets[a] & sets[b]).values()) >= 0.8 * union:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {i: find(i) for i in range(len(texts))}


def classes_by_brute_force(texts):
    root = list(range(len(texts)))
    sets = [weighted(t) for t in texts]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        union = sum((sets[a] | sets[b]).values())
        if texts[a] == texts[b] or union and sum((sets[a] & sets[b]).values()) >= 0.8 * union:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in range(len(texts))}


def test_near_copies_of_differing_length_match_brute_force(spark, words):
    # The first of a bucket can often reach one of two near copies, but not the longer one.
    random.seed(12)
    passages = [[random.choice(words) for _ in range(random.randrange(20, 60))] for _ in range(40)]
    texts = []
    for _ in range(70):
        copy = sum(random.sample(passages, 3), [])
        for _ in range(random.randrange(3, 6)):
            texts.append(" ".join(copy))
            longer = max(1, int(len(copy) * random.uniform(0.02, 0.22)))
            copy = copy + [random.choice(words) for _ in range(longer)]
    got = {r.doc_id: r.class_id for r in near_duplicates(table(spark, texts)).collect()}
    assert got == classes_by_brute_force(texts)


def test_large_group_of_near_copies_is_one_class(spark, words):
    random.seed(9)
    base = [random.choice(words) for _ in range(120)]
    texts = []
    for i in range(150):
        copy = list(base)
        copy[random.randrange(len(copy))] = f"unique{i}"
        texts.append(" ".join(copy))
    assert {r.class_id for r in near_duplicates(table(spark, texts)).collect()} == {0}


def test_near_duplicates_of_awkward_rows(docs, empty):
    out = near_duplicates(docs)
    assert out.count() == docs.where("doc_id IS NOT NULL").select("doc_id").distinct().count()
    kept = keep_first(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({r.class_id for r in out.collect()}) and sum(r.doc_id is None for r in kept) == 1
    assert near_duplicates(empty).count() == 0 and keep_first(empty).count() == 0


# --- operator 6


def test_quality_counts(spark, docs, empty):
    text = "the cat sat on the cat sat on mat\nA#b *\nA#b *\n\n"
    row = quality(table(spark, [text])).first()
    assert (row.n_words, row.n_symbols, row.n_dup_lines) == (13, 4, 1)
    w = text.split()
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    marked = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    assert row.n_repeat_words == len(marked)
    rows = quality(docs).collect()
    assert len(rows) == docs.count() and all(not r.kept for r in rows if r.n_words < 50)
    assert quality(empty).count() == 0


def test_windows_of_one_hash_do_not_hide_each_other(spark):
    """A hash of nothing but a word's length makes different windows meet, in turn: a, b, a."""
    random.seed(12)
    texts = ["a b c d e f a b c", "x y z x y z x y z", "a b c", "a b", "one two six ten two six"] + [" ".join(random.choice("abcd") for _ in range(random.randrange(3, 40))) for _ in range(40)]
    df = spark.createDataFrame([(i, x.split()) for i, x in enumerate(texts)], "i int, w array<string>")
    n = F.size("w")
    poor = repeated_words(F.col("w"), n, F.ceil(F.log2(n + 1)).cast("int"), lambda a, *_: F.length(a).cast("long")).alias("poor")
    good = repeated_words(F.col("w"), n, F.ceil(F.log2(n + 1)).cast("int")).alias("good")
    for r in df.select("w", poor, good).collect():
        grams = Counter(zip(r.w, r.w[1:], r.w[2:], strict=False))
        want = len({i + j for i in range(len(r.w) - 2) if grams[tuple(r.w[i : i + 3])] > 1 for j in range(3)})
        assert r.poor == r.good == want


# --- operator 7


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [[float(x) for x in rng.normal(size=6)] for _ in range(300)]
    vectors[10:60] = [vectors[10]] * 50
    rows = [(i, v) for i, v in enumerate(vectors)] + [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in top_k(df, df.where("vec_id % 10 = 0"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    whole = np.floor(256 * np.array(vectors, np.float32).astype(float)).astype(int)
    for q in range(0, 300, 10):
        scores = whole @ whole[q]
        assert got[q] == [(i, int(scores[i])) for i in sorted((j for j in range(300) if j != q), key=lambda j: (-scores[j], j))[:5]]
    assert set(got) == set(range(0, 300, 10))
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(none, none).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in top_k(two, two.where("vec_id = 0")).collect()] == [(0, 1)]


# --- operators 8 and 10


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def odd_texts():
    random.seed(2)
    return [t or "" for t in AWKWARD] + ["".join(chr(random.choice([random.randrange(32, 127), random.randrange(0xA0, 0x2FFF)])) for _ in range(400)) for _ in range(30)]


def test_token_counts_match_the_library(spark, tokenizer, odd_texts, docs, empty):
    want = [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in odd_texts]
    assert TokenCounter(vocabulary()).count(odd_texts) == want
    rows = {r.doc_id: r for r in count_tokens(table(spark, odd_texts), vocabulary()).collect()}
    assert [rows[i].n_tokens for i in range(len(want))] == want and [rows[i].n_bytes for i in range(len(want))] == [len(t.encode()) for t in odd_texts]
    assert count_tokens(docs, vocabulary()).count() == docs.count() and count_tokens(empty, vocabulary()).count() == 0


def test_long_pre_tokens_match_the_library(tokenizer):
    random.seed(16)
    letters = lambda n, of: "".join(random.choice(of) for _ in range(n))
    words = "the quick brown fox jumps over a lazy dog and then some more of it".split()
    texts = [letters(400_000, "abcdefghijklmnopqrstuvwxyz"), "".join(random.choice(words) for _ in range(20_000)), "a" * 50_001, "ab" * 20_000, "日本語の文章" * 5_000, letters(50_000, "ABCabc0123+/"), "=-" * 9_000]
    texts += [letters(n, "abc") for n in range(250, 262)]
    counter = TokenCounter(vocabulary())
    assert counter.count(texts) == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_long_texts_are_counted_in_slices(spark, tokenizer):
    random.seed(17)
    text = " ".join(random.choice(["one", "two", "don't", "  three", "four\n", "<|endoftext|>", "½²", "é"]) for _ in range(500_000))
    assert len(list(in_slices([text]))) > 1
    row = count_tokens(spark.createDataFrame([(1, text, 3)], "doc_id long, text string, n_tokens int"), vocabulary()).first()
    assert (row.n_tokens, row.n_bytes) == (len(tokenizer.encode(text, add_special_tokens=False).ids), len(text.encode()))


def test_other_tokenizer_files_are_refused(tmp_path):
    import json

    spec = json.loads(open(vocabulary(), encoding="utf-8").read())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="plain byte-level"):
            Merges(str(path))


def test_both_ways_of_encoding_give_the_same_ids(tokenizer):
    random.seed(18)
    enc = Encoder(vocabulary())
    words = "the of and über naïve straße don't 12 3456 ... !! \t \n\n x_y http://a.b/c?d=e 日本語 🙂 <|endoftext|>".split(" ")
    texts = ["".join(random.choice(words) + random.choice(["", " ", "  "]) for _ in range(random.randrange(1, 400))) for _ in range(400)]
    texts += ["".join(random.choice("abcdefg") for _ in range(n)) for n in (1990, 1999, 2000, 2001, 2010)] + [" " * n for n in (1999, 2000, 2001)]
    for t in texts:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert enc.fast.encode(t, allowed_special=enc.added, disallowed_special=()) == ids and enc.ids(t).tolist() == ids


def test_packing_is_an_exact_round_trip(spark, tokenizer, odd_texts, docs, empty):
    texts = odd_texts + ["A sentence of some words. " * 40] * 30
    rows = pack(table(spark, texts), vocabulary()).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            piece = np.array(ids[at : at + r.length], "<u4")
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(piece.tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.02 * total
    assert pack(docs, vocabulary()).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert pack(empty, vocabulary()).count() == 0


def test_cuts_are_of_least_cost():
    from lodestone.llm.packing import best_cuts

    random.seed(1)
    for _ in range(30):
        points = sorted({0, *random.sample(range(1, 60), 14), 60})
        penalty = [0, *(random.choice([0, 2, 5]) for _ in points[1:-1]), 0]
        window = 16
        full = sorted({*points, *range(0, 61, 8)})
        cost_of = {p: (penalty[points.index(p)] if p in points else 5) for p in full}
        price = lambda n: 0 if n & (n - 1) == 0 else window - n
        best = {0: 0}
        for b in full[1:]:
            best[b] = min(best[a] + price(b - a) + cost_of[b] for a in full if a < b and b - a <= window)
        cuts = best_cuts(full, [cost_of[p] for p in full], window)
        assert sum(price(b - a) + cost_of[b] for a, b in zip([0, *cuts], cuts, strict=False)) == best[60]


# --- operator 9


def test_surrogates_keep_type_coreference_and_distinctness(spark, docs, empty):
    a = 'Mail Ann.Lee@corp.co.uk, +1 (212) 555-0199, card 4111 1111 1111 1111, ip 10.0.0.1. Mr. John Smith met Mrs. Mary Smith; Mr. Smith left. TOKEN="9233A8ECF7C5B09FE5949719B6B82BC439E9329B"'
    b = "call +1-212-555-0199 4111111111111111 ANN.LEE@CORP.CO.UK ssn 123-45-6789 Госпожа Анна Петрова"
    rows = {r.doc_id: r for r in pseudonymised(table(spark, [a, b, "clean text 12 of 2024"])).collect()}
    one, two = rows[0].text, rows[1].text
    for secret in ("Ann.Lee", "555-0199", "4111", "10.0.0.1", "John", "Smith", "9233A8EC", "123-45-6789", "Петрова"):
        assert secret not in one + two
    assert rows[2].text == "clean text 12 of 2024" and rows[2].n_entities == 0
    import re

    mail = re.search(r"\S+@\S+(?=,)", one)[0]
    assert mail.endswith(".uk") and mail.upper() in two  # one person, in the case of each place
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", one) and re.sub(r"\D", "", re.search(r"\+1 \(.{14}", one)[0])[:11] == re.sub(r"\D", "", two)[:11]
    names = re.search(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+); Mr\. (\w+) left", one)
    assert names[2] == names[4] == names[5] and names[1].endswith("n") and names[3].endswith("na")
    assert re.search(r"Госпожа [А-Я][а-я]+на [А-Я][а-я]+ко", two)
    many = [f"write to user{i}@mail.example.com" for i in range(400)]
    assert len({r.text for r in pseudonymised(table(spark, many)).collect()}) == 400
    assert pseudonymised(docs).count() == docs.count() and pseudonymised(empty).count() == 0
    assert pseudonymised(docs.withColumn("n_entities", F.lit(1))).columns[-1] == "_n_entities"


def test_keys_of_letters_alone_are_found(spark):
    keys = ["sk-" + "abcDEFghiJ" * 2, "ghp_" + "QwErTyUiOp" * 2, "AKIA" + "ABCDEFGHIJKLMNOP", "abcdefab" * 4]
    rows = pseudonymised(table(spark, [f"the key is {k} and no more" for k in keys])).collect()
    assert len(rows) == 4
    for r in rows:
        assert r.n_entities == 1 and keys[r.doc_id] not in r.text


def test_mixing_bits_is_a_bijection():
    assert len(np.unique(mix64(np.arange(100_000, dtype=np.uint64)))) == 100_000


def test_hot_passages_and_texts_of_one_letter_match_brute_force(spark):
    random.seed(14)
    letters = lambda n: "".join(random.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    hot, cut_hot = letters(160), letters(400)
    texts = {i: letters(random.randrange(80)) + (hot if i % 3 else cut_hot[random.randrange(200) :]) + letters(random.randrange(80)) for i in range(90)}
    texts |= {200: "z" * 5000, 201: "z" * 300 + "y" * 300, 202: "ab" * 900, 203: "ba" * 40, 204: "x" + "z" * 60}
    rows = list(texts.items())
    random.shuffle(rows)
    for n in (1, 6):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        got = {r.doc_id: [[s.start, s.stop] for s in r.removed] for r in remove_repeats(df).collect()}
        assert got == removed_by_brute_force({k: t.encode() for k, t in texts.items()})


def test_repeats_ignore_other_columns_and_take_long_texts(spark):
    random.seed(15)
    word = lambda: "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    long = " ".join(word() for _ in range(300_000))
    rows = [(1, "first", long[1_000_000:1_000_400], 5), (2, "second", long, 6)]
    df = spark.createDataFrame(rows, "doc_id long, kept string, text string, id long").withColumn("bytes", F.lit(1)).withColumn("spans", F.lit(2))
    got = {r.doc_id: [[s.start, s.stop] for s in r.removed] for r in remove_repeats(df).collect()}
    assert got == {1: [], 2: [[1_000_000, 1_000_400]]}


# --- more awkward input


def test_top_k_of_ties_repeated_rows_and_great_numbers(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(7, [1.0, 0.0]), (50, [1e30, -1e30]), (51, [-1e30, 1e30]), (52, [2.0**50, 0.0]), (60, []), (61, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("own")).withColumn("rank", F.lit(0))
    got = {}
    for r in top_k(df, df.where("vec_id % 10 = 0"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    limit = 2**63 - 1
    assert [v for v, _ in got[0]] == [50, 52, 61, 1, 2] and [s for _, s in got[0]][:2] == [limit, limit]
    assert [v for v, _ in got[10]][2:] == [61, 0, 1]
    assert got[50] == [(i, limit) for i in range(5)]
    assert got[60] == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0)]


def test_toxicity_scores_are_the_noisy_or_of_sentences(spark, words):
    import math
    import re

    random.seed(19)
    model = toxicity.Model({w: random.uniform(-2, 2) for w in words[:60]} | {f"{w[:3]}-": random.uniform(-1, 1) for w in words[60:90]}, -1.5)
    texts = [" ".join(random.choice(words) + random.choice(["", "", ".", "!", "\n", ","]) for _ in range(random.randrange(60))) for _ in range(80)] + [None, "", "...", "x " * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("n_sentences", F.lit(2))
    for r in toxicity.score(df, model).collect():
        clean, n = 1.0, 0
        for s in re.split(r"[.!?\n]+", texts[r.doc_id] or ""):
            found = set(re.findall(r"[^\W_]+", s.lower()))
            if found:
                n += 1
                z = model.bias + sum(model.weights.get(f, 0) for w in found for f in [w, *(f"{w[:k]}-" for k in (3, 4, 5, 6) if len(w) > k)])
                clean *= 1 - 1 / (1 + math.exp(-z))
        assert r.n_sentences == n and abs(r.score - (1 - clean)) < 1e-9


def test_a_sample_takes_rows_of_one_id_and_text_once(spark):
    rows = [(i, f"word{i % 7} and more", i % 2) for i in range(300)] + [(1, "word1 and more", 1)] * 50
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[:300]], "doc_id long, toxic int")
    assert abs(toxicity.fit(docs, labels).bias - toxicity.fit(docs.dropDuplicates(), labels).bias) < 1e-9


def test_mixture_of_ties_and_repeated_rows(spark):
    rows = [(i % 20, "abcd" * 5, "en", "s") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("tokens", F.lit(0)).withColumn("key", F.lit("k"))
    got = Counter(r.doc_id for r in mixture(df, Mix(share=(1, 2), epochs=1)).collect())
    assert set(got.values()) == {3} and len(got) == 10  # rows of one id stay together


def test_quality_of_long_texts_and_clashing_names(spark, words):
    random.seed(20)
    text = " ".join(random.choice(words) for _ in range(150_000))
    df = spark.createDataFrame([(1, text, 1), (2, "a b c " * 50_000, 2)], "doc_id long, text string, n_words int").withColumn("kept", F.lit("x"))
    got = {r.doc_id: r for r in quality(df).collect()}
    w = text.split()
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    assert got[1].n_repeat_words == len({i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)})
    assert got[2].n_words == got[2].n_repeat_words == 150_000 and got[2].base_failed


def test_near_duplicates_of_long_texts_copies_and_clashing_names(spark, words):
    random.seed(24)
    base = [random.choice(words) for _ in range(40_000)]
    other = list(base)
    for i in range(0, 40_000, 400):
        other[i] = "changed"
    rows = [(5, " ".join(base), "a"), (6, " ".join(other), "b"), *[(10 + i, "one two three four five six", "c") for i in range(200)], (5, " ".join(base), "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string").withColumn("key", F.lit(0)).withColumn("bands", F.lit(1))
    got = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    assert got == {5: 5, 6: 5} | {10 + i: 10 for i in range(200)}
    kept = keep_first(df).collect()
    assert sorted(r.doc_id for r in kept) == [5, 10] and all(r.key == 0 for r in kept)


def test_packing_of_long_texts_repeated_rows_and_clashing_names(spark, tokenizer):
    text = "word and word " * 40_000
    df = spark.createDataFrame([(1, text, 7), (2, "x", 8), (2, "x", 8)], "doc_id long, text string, offset int").withColumn("length", F.lit("l"))
    rows = pack(df, vocabulary()).collect()
    n = len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
    assert sum(r.length for r in rows if r.doc_id == 1) == n and sum(r.length for r in rows if r.doc_id == 2) == 4


def test_packing_refuses_merges_out_of_the_order_of_ids():
    spec = {"model": {"vocab": {"a": 0, "b": 1, "ab": 2, "abb": 3}, "merges": ["a b", "ab b"]}}
    assert in_id_order(spec) is spec
    for merges, ids in ((["a b", "ab b"], {"ab": 3, "abb": 2}), ([["a", "b"], ["a", "b"]], {})):
        with pytest.raises(ValueError, match="order"):
            in_id_order({"model": {"vocab": spec["model"]["vocab"] | ids, "merges": merges}})


def test_top_k_of_small_and_very_great_vectors(spark):
    """Rounding of a bound grows with radii; what it forgives must, too."""
    random.seed(13)
    rows = [(i, [random.uniform(-1, 1) * (1e7 if i % 9 == 4 else 1.0) for _ in range(8)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    got = {}
    for r in top_k(df, df.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in range(0, 400, 50):
        best = sorted(((i, sum(a * b for a, b in zip(vectors[q], v, strict=True))) for i, v in vectors.items() if i != q), key=lambda x: (-x[1], x[0]))[:5]
        assert got[q] == best
