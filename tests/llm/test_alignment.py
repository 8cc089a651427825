"""Alignment of two tokenizers against a plain loop over byte offsets."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import alignment
from lodestone.llm.alignment import aligned, summed
from lodestone.llm.queries import vocabulary

SCHEMA = "doc_id long, text string"
TEXTS = [None, "", " ", "\n\n", "a", "the cat sat on the mat", "the cat sat on the mat", "  two  spaces ", "▁ under", "x\x00y", "don't <|endoftext|> <s> </s> <unk> stop", "½² 日本語 🙂 ﬁne", "tab\tand\r\nline", "Zeitgeist über Straße " * 50, "a" * 5_000, "ab " * 4_000]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def by_loops(rows):
    """The same by tokenizers and sentencepiece, token by token."""
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    path = vocabulary()
    a_model = Tokenizer.from_file(path)
    a_model.encode_special_tokens = True
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in keep)}
    a_bytes = {v: bytes(byte_of[c] for c in k) for k, v in json.load(open(path, encoding="utf-8"))["model"]["vocab"].items() if all(c in byte_of for c in k)}
    b_model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))

    def b_bytes(i):
        piece = b_model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()

    found = []
    for key, text in rows:
        a, b = (a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)) if text else ([], [])
        raw = (" " + text).encode() if text else b""
        if b"".join(map(a_bytes.get, a)) != raw or b"".join(map(b_bytes, b)) != raw:
            a, b = [], []
        ends = [set(np.cumsum([len(f(i)) for i in ids]).tolist()) if ids else set() for ids, f in ((a, a_bytes.get), (b, b_bytes))]
        shared, groups = ends[0] & ends[1], []
        for ids, f, side in ((a, a_bytes.get, 0), (b, b_bytes, 1)):
            at, group = 0, []
            n = 0
            for i in ids:
                group.append(i)
                at += len(f(i))
                if at in shared:
                    if side == 0:
                        groups.append((group, None))
                    else:
                        groups[n] = (groups[n][0], group)
                    n, group = n + 1, []
        found.append((key, a, b, groups))
    counts = Counter((g[0][-1], g[1][-1]) for *_, groups in found for g in groups)
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for key, a, b, groups in found:
        links = [counts[g[0][-1], g[1][-1]] for g in groups]
        best = sum(counts[g[0][-1], g[1][-1]] == top[g[1][-1]] for g in groups)
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((key, len(a), len(b), len(groups), len(links), best, sum(links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_equals_loops_over_awkward_texts(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (5, "the cat sat on the mat"), (5, TEXTS[5])]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = aligned(table, vocabulary(), vocabulary("piece_bpe_32k.model"))
    assert got(out) == by_loops(rows)


def test_small_shards_and_batches_give_the_same(spark, monkeypatch):
    rows = [(i, f"{t} {i}") for i, t in enumerate(TEXTS[4:] * 3)]
    for name in ("HELD_PAIRS", "LINKS", "SHARD_PAIRS"):
        monkeypatch.setattr(alignment, name, 7)
    out = aligned(spark.createDataFrame(rows, SCHEMA).coalesce(1), vocabulary(), vocabulary("piece_bpe_32k.model"))
    assert got(out) == by_loops(rows)


def test_links_clashing_columns_and_empty_table(spark):
    clashing = spark.createDataFrame([(1, "the cat", 5, "x")], "doc_id long, text string, n_a long, links string")
    row = aligned(clashing, vocabulary(), vocabulary("piece_bpe_32k.model")).first()
    ids = np.frombuffer(row["links"], "<u2")
    assert len(ids) == 2 * row["n_links"] and row["count_sum"] >= row["n_links"] == row["n_best"]
    assert aligned(spark.createDataFrame([], SCHEMA), vocabulary(), vocabulary("piece_bpe_32k.model")).count() == 0


def test_very_long_text_counts_whole(spark):
    long = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.repeat(F.lit("lorem ipsum "), 100_000).alias("text"))
    row = aligned(long, vocabulary(), vocabulary("piece_bpe_32k.model")).first()
    assert row["n_groups"] >= 200_000 and row["n_best"] == row["n_links"]


@pytest.mark.parametrize("n", [1, 5, 1000])
def test_summed(n):
    rng = np.random.default_rng(n)
    keys, counts = rng.integers(0, 50, n), rng.integers(1, 9, n)
    k, c = summed(keys, counts)
    assert dict(zip(k.tolist(), c.tolist(), strict=True)) == {x: int(counts[keys == x].sum()) for x in set(keys.tolist())} and (np.diff(k) > 0).all()
