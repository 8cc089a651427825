"""Claims out of streams of text deltas, whatever the deltas' borders."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<claim>", "</claim>"
#: Longest buffer, block and text; fields and states of a claim (fixed values).
MOST_BUFFER, MOST_BLOCK, MOST_TEXT = 64_000, 8_000, 2_000
FIELDS, STATES = {"id", "text", "evidence_ids", "facet_id", "status"}, {"supported", "insufficient"}
OUTPUT = "stream string, n int, claim_id string, text string, evidence_ids array<string>, facet_id string, status string, error string"
STATE = "buffer string, expected long, n int, waiting string, closed boolean"


def numbered(letter: str, value: object) -> bool:
    return isinstance(value, str) and re.fullmatch(rf"{letter}[1-9][0-9]*", value) is not None


def claim_of(raw: str, most_text: int = MOST_TEXT) -> dict:
    """The claim of a block's JSON; ValueError says what is wrong with it."""
    try:
        claim = json.loads(raw)
    except ValueError:
        raise ValueError("no JSON") from None
    if not isinstance(claim, dict):
        raise ValueError("no object")
    if more := sorted(set(claim) - FIELDS):
        raise ValueError(f"unknown fields: {', '.join(more)}")
    text, proofs = claim.get("text"), claim.get("evidence_ids", [])
    wrong = [
        ("id", not numbered("C", claim.get("id"))),
        ("text", not isinstance(text, str) or not text.strip() or len(text) > most_text),
        ("evidence_ids", not isinstance(proofs, list) or not all(numbered("E", x) for x in proofs) or len(set(proofs)) < len(proofs)),
        ("facet_id", claim.get("facet_id") is not None and not numbered("F", claim["facet_id"])),
        ("status", claim.get("status", "supported") not in STATES),
    ]
    if bad := [name for name, is_wrong in wrong if is_wrong]:
        raise ValueError(f"wrong {bad[0]}")
    return {"claim_id": claim["id"], "text": text.strip(), "evidence_ids": proofs, "facet_id": claim.get("facet_id"), "status": claim.get("status", "supported")}


@dataclass
class Reader:
    """Takes deltas and gives finished claims; keeps an open block, or as much text as may begin a tag, and no more."""

    buffer: str = ""
    most_buffer: int = MOST_BUFFER
    most_block: int = MOST_BLOCK
    most_text: int = MOST_TEXT

    def feed(self, delta: str) -> Iterator[dict]:
        self.buffer += delta
        if len(self.buffer) > self.most_buffer:
            raise ValueError("buffer too long")
        while (at := self.buffer.find(OPEN)) >= 0:
            end = self.buffer.find(CLOSE, at + len(OPEN))
            body = self.buffer[at + len(OPEN) : end if end >= 0 else None]
            if len(body) > self.most_block:
                raise ValueError("block too long")
            if end < 0:
                self.buffer = self.buffer[at:]
                return
            self.buffer = self.buffer[end + len(CLOSE) :]
            yield claim_of(body, self.most_text)
        self.buffer = self.buffer[1 - len(OPEN) :]


def claims_of(deltas: DataFrame, stream: str, seq: str, delta: str, **limits: int) -> DataFrame:
    """Columns of OUTPUT, as a streaming plan: the claims of each stream in the order of their deltas, counted by n.

    deltas: (stream, seq, delta), seq counting from 0. The state of a stream is its open block, bounded by most_buffer,
    and the deltas that came before their turn, bounded alike. A delta that comes again is passed over. A wrong block or
    a buffer that grows too long gives one row with an error and closes the stream, as its later blocks can't be trusted;
    deltas of a closed stream are passed over. Null deltas are empty; a null stream is one of its own.
    """
    most = limits.get("most_buffer", MOST_BUFFER)
    columns = [x.split(" ")[0] for x in OUTPUT.split(", ")]

    def run(key, frames, state) -> Iterator[pd.DataFrame]:
        buffer, expected, n, waiting, closed = state.get if state.exists else ("", 0, 0, "{}", False)
        early: dict[int, str] = {int(k): v for k, v in json.loads(waiting).items()}
        reader, out = Reader(buffer, **limits), []
        for frame in frames:
            for at, text in zip(frame["seq"], frame["delta"], strict=True):
                if int(at) >= expected:
                    early.setdefault(int(at), text or "")
        try:
            while not closed and expected in early:
                text, expected = early.pop(expected), expected + 1
                for claim in reader.feed(text):
                    n += 1
                    out.append(claim | {"n": n, "error": None})
            if not closed and sum(map(len, early.values())) > most:
                raise ValueError("too much before its turn")
        except ValueError as fault:
            closed = True
            out.append({"claim_id": None, "text": None, "evidence_ids": None, "facet_id": None, "status": None, "n": n + 1, "error": str(fault)})
        kept = ("", "{}") if closed else (reader.buffer, json.dumps(early))
        state.update((kept[0], expected, n, kept[1], closed))
        if out:
            yield pd.DataFrame([x | {"stream": key[0]} for x in out], columns=columns)

    from pyspark.sql.streaming.state import GroupStateTimeout

    rows = deltas.select(F.col(stream).cast("string").alias("stream"), F.col(seq).cast("long").alias("seq"), F.coalesce(delta, F.lit("")).alias("delta")).where("seq >= 0")
    return rows.groupBy("stream").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
