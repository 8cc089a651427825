"""Purge of documents out of stored JSON: what it names, what it named before, and what is left without it."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import staged
from .ranking import top_by

#: Keys whose strings are references: in a record of the document itself, and in lists (fixed values).
OWN_KEYS = ["logical_document_id", "document_id", "segment_document_id", "chunk_id", "evidence_id", "media_id", "fingerprint", "original_source", "managed_source", "source", "source_path", "source_uri", "path"]
LIST_KEYS = ["logical_document_ids", "document_ids", "segment_document_ids", "chunk_ids", "evidence_ids", "media_ids", "picture_refs"]
#: Shorter references are not looked for inside strings; what stands in their place (fixed values).
LEAST_LENGTH, REMOVED = 6, "[purged-document]"
NAMED = frozenset(OWN_KEYS + LIST_KEYS)
#: Strings that a task gives on at once, about.
ROWS = 20_000
#: References that a task holds, to find them where the strings are; of more, the strings are shuffled.
MOST_REFERENCES = 2_000_000


def readable(records: DataFrame) -> DataFrame:
    """(scope, record, text) of records; text that is no JSON raises when it is read, as what can't be read can't be purged."""
    bad = F.raise_error(F.concat(F.lit("stored JSON cannot be read, purge aborted: "), F.col("record").cast("string")))
    unread = F.col("text").isNotNull() & F.try_parse_json("text").isNull()
    return records.select("scope", "record", F.when(unread, bad.cast("string")).otherwise(F.col("text")).alias("text"))


def walked(records: DataFrame, rows_of: Callable[[object, str | None], Iterable[tuple]], columns: str) -> DataFrame:
    """(scope, record, columns): what rows_of(scope, text) gives for each record, where it is, without a shuffle; nothing but a record's own text has
    to fit a task."""
    read = readable(records)
    kind = {f.name: f.dataType.simpleString() for f in read.schema}
    schema = f"scope {kind['scope']}, record {kind['record']}, {columns}"
    found_schema = read.sparkSession.createDataFrame([], columns).schema
    kinds = [pa.list_(pa.string()) if f.dataType.typeName() == "array" else pa.string() for f in found_schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []

            def given() -> pa.RecordBatch:
                of, values = pa.array(at, pa.int64()), list(zip(*found, strict=True)) or [[]] * len(kinds)
                return pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), *map(pa.array, values, kinds)], ["scope", "record", *found_schema.names])

            for i, (scope, text) in enumerate(zip(b.column(0).to_pylist(), b.column(2), strict=True)):
                for row in rows_of(scope, text.as_py()):
                    at.append(i)
                    found.append(row)
                    if len(at) >= ROWS:
                        yield given()
                        at, found = [], []
            yield given()

    return read.mapInArrow(run, schema)


def strings(records: DataFrame) -> DataFrame:
    """(scope, record, value, key, owner, above): every non-empty string in the JSON of records (scope, record, text).

    key: the one it stands under, through lists; owner: the object whose own value it is, null for one in a list; above:
    the objects around it. Objects are named by their number in the record. A null text has no strings; text that is no
    JSON raises.
    """
    return walked(records.where("text IS NOT NULL"), lambda _, text: strings_of(json.loads(text)), "value string, key string, owner string, above array<string>")


def strings_of(value) -> list[tuple]:
    """(value, key, owner, above) of the non-empty strings in a JSON value."""
    found, waiting, n_objects = [], [(value, None, None, ())], 0
    plain = lambda x: x if x.isascii() else x.encode("utf-8", "replace").decode()  # noqa: E731  half a surrogate pair is no text
    while waiting:
        x, key, owner, above = waiting.pop()
        if isinstance(x, str):
            if x:
                found.append((plain(x), key, owner, above))
        elif isinstance(x, dict):
            name, n_objects = str(n_objects), n_objects + 1
            waiting.extend((y, plain(k), name, (*above, name)) for k, y in x.items())
        elif isinstance(x, list):
            waiting.extend((y, key, None, above) for y in x)
    return found


def leads_of(value) -> Iterator[tuple[str, str]]:
    """(reference, below) of a JSON value: what an object has under its own keys, and the references below it."""
    own, below = {}, {}
    for x, key, owner, above in strings_of(value):
        if key in NAMED:
            for o in above:
                below.setdefault(o, set()).add(x)
            if owner is not None and key in OWN_KEYS:
                own.setdefault(owner, set()).add(x)
    return ((r, x) for o, names in own.items() for r in names for x in below[o] if r != x)


def leads(records: DataFrame) -> DataFrame:
    """(scope, reference, below), each once: what a reference leads to by the records (scope, record, text). An object lies
    in one record, so a record's leads are found where it is, and only they are shuffled; a pair that leads both ways is
    one row of that shuffle."""
    def ways(_, text: str) -> Iterator[tuple[str, str, str]]:
        found = {}
        for r, x in leads_of(json.loads(text)):
            pair, way = ((r, x), 1) if r < x else ((x, r), 2)
            found[pair] = found.get(pair, 0) | way
        return ((*pair, str(way)) for pair, way in found.items())

    met = walked(records.where("text IS NOT NULL"), ways, "a string, b string, way string")
    each = staged(met.groupBy("scope", "a", "b").agg(F.bit_or(F.col("way").cast("tinyint")).alias("way")), "leads")
    there = each.where("way & 1 = 1").select("scope", F.col("a").alias("reference"), F.col("b").alias("below"))
    return there.unionByName(each.where("way & 2 = 2").select("scope", F.col("b").alias("reference"), F.col("a").alias("below")))


def learned(texts: DataFrame, seeds: DataFrame) -> DataFrame:
    """(scope, target, reference): seeds and all references of objects tied to them, to a fixpoint.

    An object that has a known reference under one of its own keys is the document's: every reference below it counts
    from then on, so ids of former generations are learnt from records that still tell of them. texts: as `strings`
    gives them; where the records are at hand, `followed` by their `leads` is the same without a shuffle of strings.
    """
    own = texts.where(F.col("owner").isNotNull() & F.col("key").isin(OWN_KEYS)).select("scope", "record", F.col("owner").alias("object"), F.col("value").alias("reference")).distinct()
    below = texts.where(F.col("key").isin(OWN_KEYS + LIST_KEYS)).select("scope", "record", F.explode("above").alias("object"), F.col("value").alias("below")).distinct()
    # Files of few megabytes hold many rows of alike strings, so these joins are told not to broadcast.
    pairs = own.join(below.hint("merge"), ["scope", "record", "object"]).where("reference <> below").select("scope", "reference", "below").distinct()
    return followed(staged(pairs, "leads"), seeds)


def followed(leads: DataFrame, seeds: DataFrame) -> DataFrame:
    """(scope, target, reference): seeds and what they lead to, to a fixpoint. What a reference leads to is the same for
    every target and record, so it is worked out once; a round follows only what was learnt in the last one, and shuffles
    only the leads of that."""
    known = new = staged(seeds.where("reference <> ''").select("scope", "target", "reference").distinct(), "known")
    while not new.isEmpty():
        on = from_any(leads, new)
        more = new.join(on.hint("merge"), ["scope", "reference"]).select("scope", "target", F.col("below").alias("reference")).distinct()
        new = staged(more.join(known.hint("merge"), ["scope", "target", "reference"], "left_anti"), "new")
        known = staged(known.unionByName(new), "known")
    return known


def from_any(leads: DataFrame, references: DataFrame) -> DataFrame:
    """Leads that a join with references can meet: where a task can hold these, the rest is left out before a shuffle."""
    names = held(references.select("reference"))
    if names is None:
        return leads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = names.value.known
        for b in batches:
            yield b.take(pa.array([i for i, x in enumerate(b.column(1).to_pylist()) if x in known], pa.int64()))

    return leads.select("scope", "reference", "below").mapInArrow(run, leads.select("scope", "reference", "below").schema)


class Names:
    """References as a task holds them: `known`, and by scope and window those that are sought by it."""

    def __init__(self, rows: pa.Table):
        self.rows, self.ready = rows, False

    def __getstate__(self):
        return {"rows": self.rows, "ready": False}

    def __getattr__(self, name: str):
        if name not in ("known", "by") or self.ready:
            raise AttributeError(name)
        columns = {c: self.rows[c].to_pylist() for c in self.rows.column_names}
        self.ready = True
        if "scope" not in columns:
            self.known = set(columns["reference"])
        else:
            self.by = {}
            for scope, window, reference in zip(columns["scope"], columns["window"], columns["reference"], strict=True):
                known, sought = self.by.setdefault(scope, (set(), {}))
                known.add(reference)
                if window is not None:
                    sought.setdefault(window, []).append(reference)
        return getattr(self, name)

    def mentioned(self, scope, value) -> set[tuple[str, str]]:
        """(reference, kind) as `mentions` says, of a JSON value."""
        known, sought = self.by.get(scope, ((), {}))
        found = set()
        for x, key, owner, _ in strings_of(value) if known else ():
            if x in known:
                found.add((x, "own" if owner is not None and key in OWN_KEYS else "equal"))
            for i in range(len(x) - LEAST_LENGTH + 1):
                for r in sought.get(x[i : i + LEAST_LENGTH], ()):
                    if r in x:
                        found.add((r, "inside"))
        return found


def held(references: DataFrame) -> Broadcast | None:
    """Names out of a staged table for every task, if they are no more than a task holds."""
    if references.count() > MOST_REFERENCES:
        return None
    return references.sparkSession.sparkContext.broadcast(Names(references.toArrow()))


def windowed(df: DataFrame, column: str) -> DataFrame:
    """df with `window`: a row for each distinct run of LEAST_LENGTH characters of a column."""
    runs = F.transform(F.sequence(F.lit(1), F.length(column) - (LEAST_LENGTH - 1)), lambda i: F.substring(F.col(column), i, LEAST_LENGTH))
    return df.where(F.length(column) >= LEAST_LENGTH).withColumn("window", F.explode(F.array_distinct(runs)))


def anchors(references: DataFrame) -> DataFrame:
    """(scope, window, reference): each reference with its rarest window among all references, so ids with one beginning
    don't meet at that; a null one for references that are too short to be sought inside strings."""
    refs = staged(references.select("scope", "reference").distinct(), "references")
    each = windowed(refs, "reference")
    often = each.groupBy("scope", "window").agg(F.count(F.lit(1)).alias("n"))
    rarest = top_by(each.join(often.hint("merge"), ["scope", "window"]), ["scope", "reference"], [F.col("n"), F.col("window")], 1).select("scope", "window", "reference")
    short = refs.where(F.length("reference") < LEAST_LENGTH).select("scope", F.lit(None).cast("string").alias("window"), "reference")
    return staged(rarest.unionByName(short), "anchors")


def mentioned(records: DataFrame, references: DataFrame) -> DataFrame:
    """(scope, record, reference, kind) as `mentions`, each once for a record (scope, record, text): found where the record
    is, without a shuffle, as long as a task can hold the references."""
    names = held(anchors(references))
    if names is None:
        return mentions(staged(strings(records), "strings"), references)
    return walked(records.where("text IS NOT NULL"), lambda scope, text: names.value.mentioned(scope, json.loads(text)), "reference string, kind string")


def mentions(texts: DataFrame, references: DataFrame) -> DataFrame:
    """(scope, record, reference, kind): references that a record's strings are (`own` under an own key of an object,
    `equal` elsewhere) or have inside (`inside`, from LEAST_LENGTH characters on).

    For the last a reference is sought by its rarest window; every meeting is verified. Each distinct string is searched
    once, however many records hold it.
    """
    anchor = anchors(references)
    met = windowed(texts.select("scope", "value").distinct(), "value").join(anchor.hint("merge"), ["scope", "window"])
    told = met.where(F.contains("value", "reference")).select("scope", "value", "reference", F.lit(True).alias("inside"))
    told = staged(told.unionByName(anchor.select("scope", F.col("reference").alias("value"), "reference", F.lit(False).alias("inside"))).distinct(), "told")
    owned = F.col("owner").isNotNull() & F.col("key").isin(OWN_KEYS)
    kind = F.when(F.col("inside"), "inside").when(owned, "own").otherwise("equal")
    return texts.select("scope", "record", "value", "key", "owner").join(told.hint("merge"), ["scope", "value"]).select("scope", "record", "reference", kind.alias("kind")).distinct()


def blockers(pinned: DataFrame, references: DataFrame) -> DataFrame:
    """(target, record): pinned records (scope, record, text) that tell of a target: an object of its own, or a string
    with one of its references inside. One whose JSON can't be read blocks every target of its scope."""
    read = F.col("text").isNull() | F.try_parse_json("text").isNotNull()
    hits = mentioned(pinned.where(read), references).where("kind <> 'equal'").select("scope", "record", "reference")
    told = references.join(hits.hint("merge"), ["scope", "reference"]).select("target", "record")
    dark = pinned.where(~read).select("scope", "record").join(references.select("scope", "target").distinct(), "scope").select("target", "record")
    return told.unionByName(dark).distinct()


def without(value, references: list[str]):
    """A JSON value without a document's own objects and list entries, its references in other strings struck out; None
    for one that is such an object."""
    known = set(references)
    inside = sorted((r for r in known if len(r) >= LEAST_LENGTH), key=lambda r: (-len(r), r))

    def cleaned(x):
        if isinstance(x, dict):
            if any(isinstance(x.get(k), str) and x[k] in known for k in OWN_KEYS):
                return []
            return [{k: v[0] for k, child in x.items() if (v := cleaned(child))}]
        if isinstance(x, list):
            return [[y for child in x if not (isinstance(child, str) and child in known) for y in cleaned(child)]]
        if isinstance(x, str):
            for r in inside:
                x = x.replace(r, REMOVED)
        return [x]

    return (cleaned(value) or [None])[0]


def scrub(text: str | None, references) -> tuple[str | None, str]:
    """(text, state) of a record's JSON without the references it mentions."""
    if text is None or not references:
        return text, "kept"
    x = without(json.loads(text), list(references))
    return (None, "gone") if x is None or x in ({}, []) else (json.dumps(x), "changed")


def scrubbed(records: DataFrame, references: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(scope, record, text, state): records with the purge done: `kept` as they were, `changed`, or `gone` with a null
    text, where the record itself was the document's or nothing is left of it.

    Only records that mention a reference are written anew, each with the references it mentions; other documents'
    siblings in the same record stay. As long as a task can hold the references, records are scrubbed where they are;
    of more, records meet what they mention in a join. texts: the records' `strings`, for that.
    """
    names = held(anchors(references))
    if names is not None:
        def rows(scope, text: str | None) -> list[tuple]:
            return [scrub(text, text is not None and {r for r, _ in names.value.mentioned(scope, json.loads(text))})]

        return walked(records, rows, "text string, state string")
    texts = staged(strings(records), "strings") if texts is None else texts
    wanted = mentions(texts, references).groupBy("scope", "record").agg(F.collect_set("reference").alias("references"))

    @F.pandas_udf("text string, state string")
    def clean(text: pd.Series, refs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([scrub(t, () if r is None else list(r)) for t, r in zip(text, refs, strict=True)], columns=["text", "state"], dtype=object)

    met = records.join(wanted.hint("merge"), ["scope", "record"], "left").withColumn("new", clean("text", "references"))
    return met.select("scope", "record", "new.text", "new.state")


def struck_entries(jobs: DataFrame, references: DataFrame) -> DataFrame:
    """(scope, record, entry): places, from 0, of a job's `sources` (payload) or `documents` (result) that tell of a
    target; as both lists run side by side, a place that is struck in one is struck in both, and what hangs on it
    (segments, checkpoints) goes with it. jobs: (scope, record, payload, result)."""
    def entries(column: str, key: str) -> DataFrame:
        at = F.variant_get(F.try_parse_json(column), f"$.{key}", "array<variant>")
        return jobs.select("scope", F.col("record").alias("job"), F.posexplode(at).alias("entry", "v")).select("scope", F.struct("job", "entry").alias("record"), F.to_json("v").alias("text"))

    both = entries("payload", "sources").unionByName(entries("result", "documents"))
    hits = mentioned(both, references).where("kind <> 'equal'")
    return hits.select("scope", F.col("record.job").alias("record"), F.col("record.entry").alias("entry")).distinct()


def purged_jobs(jobs: DataFrame, references: DataFrame) -> DataFrame:
    """Jobs (scope, record, payload, result) with struck places out of both lists, and the rest scrubbed. `touched`: the
    number of places struck; a job with any has its errors, progress and idempotency keys removed by its caller."""
    struck = staged(struck_entries(jobs, references), "struck")
    listed = struck.groupBy("scope", "record").agg(F.collect_set("entry").alias("entries"))

    @F.pandas_udf("string")
    def shorter(text: pd.Series, key: pd.Series, entries: pd.Series) -> pd.Series:
        def cut(t, k, gone):
            if t is None or gone is None:
                return t
            x, gone = json.loads(t), set(gone)
            if isinstance(x, dict) and isinstance(x.get(k), list):
                x[k] = [y for i, y in enumerate(x[k]) if i not in gone]
            return json.dumps(x)

        return pd.Series([cut(*row) for row in zip(text, key, entries, strict=True)], dtype=object)

    cut = jobs.join(listed, ["scope", "record"], "left")
    cut = staged(cut.select("scope", "record", shorter("payload", F.lit("sources"), "entries").alias("payload"), shorter("result", F.lit("documents"), "entries").alias("result"), F.coalesce(F.size("entries"), F.lit(0)).alias("touched")), "jobs")
    parts = [cut.select("scope", F.struct("record", F.lit(name).alias("of")).alias("record"), F.col(name).alias("text")) for name in ("payload", "result")]
    clean = scrubbed(parts[0].unionByName(parts[1]), references).select("scope", F.col("record.record").alias("record"), F.col("record.of").alias("of"), "text", "state")
    wide = clean.groupBy("scope", "record").agg(*[F.max(F.when(F.col("of") == n, F.when(F.col("state") == "gone", F.lit("{}")).otherwise(F.col("text")))).alias(n) for n in ("payload", "result")])
    return wide.join(cut.select("scope", "record", "touched"), ["scope", "record"])
