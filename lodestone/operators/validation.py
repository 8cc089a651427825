"""Whether a generation of an index is whole: every rule as a join or an aggregate, all faults in one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import spread, staged
from .ranking import keep_best

#: Columns of the tables of a generation.
TABLES = {
    "books": "book string, generation string, pipeline string",
    "structures": "book string, generation string, total_pages int",
    "snapshots": "book string, generation string, content_hash string, payload string",
    "nodes": "book string, node string, parent string",
    "terms": "book string, term string",
    "segments": "book string, segment string, generation string, page_mode string, conversion_start int, core_start int, core_end int, conversion_end int",
    "chunks": "book string, chunk string, generation string, refs array<string>, pages array<int>, section string, segment string, place int, content_hash string, evidence string, previous string, next string",
    "edges": "book string, edge string, source string, target string, relation string, evidence array<string>",
    "targets": "book string, term string, node string, evidence string",
    "assets": "book string, media string, generation string, section string, payload string",
    "links": "book string, link string, relation string, source string, target string",
}
#: Relations between sections, and what the ends of each relation of media are (fixed values).
OF_NODES = ["parent_of", "next_section"]
LINKED = {
    "section_contains_media": ("node", "media"),
    "evidence_depicts_media": ("evidence", "media"),
    "evidence_context_for_media": ("evidence", "media"),
    "media_mentions_term": ("media", "term"),
    "media_duplicate_of": ("media", "media"),
    "media_variant_of": ("media", "media"),
}
SNAPSHOT = "schema_version string, content_hash string, evidence array<struct<evidence_id string>>, media struct<assets array<struct<media_id string>>>"
SCHEMAS = ["2", "3"]
#: Rows of a table of what may be faulty that is broadcast; larger ones are shuffled.
MOST_FEW = 100_000


def faults(df: DataFrame, code: str, key: Column, broken: Column | None = None) -> DataFrame:
    return (df if broken is None else df.where(broken)).select(F.lit(code).alias("code"), key.cast("string").alias("id"))


def several(df: DataFrame, broken: dict[str, tuple[Column, Column]]) -> DataFrame:
    """The faults of several codes, each with its key and condition, out of one reading of df."""
    found = [F.when(F.coalesce(of, F.lit(False)), F.struct(F.lit(code).alias("code"), key.cast("string").alias("id"))) for code, (key, of) in broken.items()]
    return df.select(F.explode(F.array_compact(F.array(*found))).alias("f")).select("f.code", "f.id")


def few(df: DataFrame, name: str) -> DataFrame:
    """df staged and counted, to be broadcast if it is small, and else to be merged."""
    df = staged(df, name)
    return F.broadcast(df) if df.count() <= MOST_FEW else df.hint("merge")


def misplaced(chunks: DataFrame, nodes: DataFrame, segments: DataFrame, structures: DataFrame) -> DataFrame:
    """Faults of chunks by their section, segment and pages. Chunks of one book, section and segment are held against these by
    their least and greatest page first; only those of groups with a fault are looked at one by one."""
    keys = ["book", "section", "segment"]
    groups = chunks.groupBy(*keys).agg(F.min(F.array_min("pages")).alias("least"), F.max(F.array_max("pages")).alias("most"), F.bool_or(F.exists("pages", lambda p: p.isNull())).alias("gaps"))
    bounds = segments.groupBy("book", "segment").agg(F.max("core_start").alias("_lo"), F.min("core_end").alias("_hi"), F.lit(True).alias("_segment"))
    known = nodes.select("book", F.col("id").alias("section")).distinct().withColumn("_section", F.lit(True))
    facts = groups.join(known, ["book", "section"], "left").join(bounds, ["book", "segment"], "left").join(structures.select("book", "total_pages"), "book", "left")
    pages = F.coalesce("total_pages", F.lit(0))
    missing = {"section_missing": F.col("_section").isNull(), "chunk_segment_missing": F.col("_segment").isNull()}
    wrong = [F.coalesce(c, F.lit(False)) for c in (F.col("least") < F.col("_lo"), F.col("most") > F.col("_hi"), F.col("gaps"), F.col("least") < 1, F.col("most") > pages)]
    faulty = few(facts.where(reduce(Column.__or__, [*missing.values(), *wrong])).select(*[F.col(k).alias(f"_{k}_") for k in keys], "_section", "_segment", "_lo", "_hi", "total_pages"), "faulty")
    placed = chunks.select("chunk", "pages", *keys).join(faulty, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in keys]))
    outside = F.exists("pages", lambda p: (p < F.col("_lo")) | (p > F.col("_hi")))
    invalid = F.exists("pages", lambda p: p.isNull() | (p < 1) | (p > pages))
    return several(placed, {code: (F.col("chunk"), of) for code, of in (missing | {"chunk_outside_core": outside, "chunk_page_invalid": invalid}).items()})


def repeated(chunks: DataFrame, same: list[str]) -> DataFrame:
    """Chunks that an earlier one of their book is like: what has the same hash is sought first, and only that is compared."""
    hashed = chunks.select("chunk", "place", *same, F.xxhash64(*same).alias("_h"))
    met = few(hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_h"), "repeated")
    order = Window.partitionBy(*same).orderBy("place", "chunk")
    return hashed.join(met, "_h", "left_semi").withColumn("_r", F.row_number().over(order)).where("_r > 1")


def lacking(df: DataFrame, column: str, known: DataFrame, kind: str | None = None) -> DataFrame:
    """Rows of df whose (book, column) is not among known (book, id, kind)."""
    of = known if kind is None else known.where(F.col("kind") == kind)
    return df.join(of.select("book", F.col("id").alias(column)).distinct(), ["book", column], "left_anti")


def on_cycles(parents: DataFrame) -> DataFrame:
    """Of (book, node, parent) the nodes whose walk up never ends, by doubling: after round k a row is 2^k steps up, so as
    many rounds do as the nodes' number has bits; those whose walk has ended leave."""
    step = staged(parents.where(F.col("parent").isNotNull()).select("book", "node", F.col("parent").alias("at")), "steps")
    for _ in range(max(1, step.count()).bit_length() + 1):
        if step.isEmpty():
            break
        further = step.select("book", F.col("node").alias("at"), F.col("at").alias("beyond"))
        step = staged(step.join(further, ["book", "at"]).select("book", "node", F.col("beyond").alias("at")), "steps")
    return step.select("book", "node").distinct()


def index_faults(tables: dict[str, DataFrame], generation: str, pipeline: str | None = None) -> DataFrame:
    """(code, id), each once: what is wrong with the tables (columns as in TABLES) as the index of one generation.

    pipeline: the generation's own version; None: the generation is not known, a fault of its own. A table without faults gives no
    rows. Ids repeat over books, so all keys hold the book. Lists of a book's segments are windows by book; its chunks
    meet by keys and aggregates, but for the chain of evidence and places, where a book's narrow rows meet.
    """
    t = tables
    gone = t["books"].limit(1)
    out = [] if pipeline is not None else [faults(t["books"].sparkSession.range(1), "generation_missing", F.lit(""))]
    empty = t["books"].sparkSession.range(1).join(gone.select(F.lit(0).cast("long").alias("id")), "id", "left_anti")
    out.append(faults(empty, "books_missing", F.lit("")))
    other = F.coalesce(F.col("generation") != generation, F.lit(True))
    book = F.col("book")
    out.append(faults(t["books"], "mixed_generation", book, other))
    if pipeline is not None:
        out.append(faults(t["books"], "mixed_pipeline", book, F.coalesce(F.col("pipeline") != pipeline, F.lit(True))))
    for name, singular in (("structures", "structure"), ("snapshots", "snapshot")):
        out.append(faults(t["books"].join(t[name].select("book"), "book", "left_anti"), f"{singular}_missing", book))
        out.append(faults(t[name].join(t["books"].select("book"), "book", "left_semi"), f"{singular}_generation", book, other))
    out.append(faults(t["structures"].join(t["books"].select("book"), "book", "left_anti"), "orphan_structure", book))

    nodes = t["nodes"].select("book", F.col("node").alias("id"), F.lit("node").alias("kind"))
    terms = t["terms"].select("book", F.col("term").alias("id"), F.lit("term").alias("kind"))
    media = t["assets"].select("book", F.col("media").alias("id"), F.lit("media").alias("kind"))
    child = t["nodes"].where(F.col("parent").isNotNull())
    out.append(faults(lacking(child, "parent", nodes), "parent_missing", F.col("node")))
    out.append(faults(on_cycles(t["nodes"]), "parent_cycle", F.col("node")))

    seg = t["segments"]
    out.append(faults(seg, "segment_generation", F.col("segment"), other))
    out.append(faults(seg, "segment_pages_not_absolute", F.col("segment"), F.coalesce(F.col("page_mode") != "absolute", F.lit(True))))
    rising = (F.col("conversion_start") <= F.col("core_start")) & (F.col("core_start") <= F.col("core_end")) & (F.col("core_end") <= F.col("conversion_end"))
    out.append(faults(seg, "segment_boundaries", F.col("segment"), ~F.coalesce(rising, F.lit(False))))
    out.append(faults(t["books"].join(seg.select("book"), "book", "left_anti"), "segments_missing", book))
    own = seg.join(t["books"].select("book"), "book", "left_semi").withColumn("first", F.coalesce("core_start", F.lit(0))).withColumn("last", F.coalesce("core_end", F.lit(0)))
    order = Window.partitionBy("book").orderBy("first", "segment")
    expected = own.withColumn("expected", F.coalesce(F.lag("last").over(order) + 1, F.lit(1)))
    out.append(faults(expected, "segment_core_gap_or_overlap", F.concat_ws(":", "book", "expected"), F.coalesce(F.col("core_start") != F.col("expected"), F.lit(True))))
    ends = own.groupBy("book").agg(F.max_by("last", F.struct("first", "segment")).alias("end"))
    out.append(faults(ends.join(t["structures"], "book"), "segment_core_coverage", book, F.col("end") != F.col("total_pages")))

    chunks, chunk = t["chunks"], F.col("chunk")
    out.append(faults(chunks, "chunk_generation", chunk, other))
    for name in ("refs", "pages"):
        out.append(faults(chunks, f"{name}_missing", chunk, F.coalesce(F.size(name) < 1, F.lit(True))))
    out.append(misplaced(chunks, nodes, seg, t["structures"]))
    n_chunks = chunks.count()
    places = spread(chunks.select("book", "place"), n_chunks, "book").groupBy("book", "place").agg(F.count(F.lit(1)).alias("n"))
    all_of = Window.partitionBy("book")
    spans = places.withColumn("lo", F.min("place").over(all_of)).withColumn("hi", F.max("place").over(all_of)).withColumn("of", F.count("place").over(all_of))
    spans = spans.join(t["books"].select("book").distinct().withColumn("_book", F.lit(True)), "book", "left")
    again = F.col("place").isNull() | (F.col("n") > 1)
    gap = F.col("_book") & ((F.col("lo") != 0) | (F.col("hi") != F.col("of") - 1))
    out.append(several(spans, {"chunk_order_duplicate": (F.concat_ws(":", "book", F.coalesce(F.col("place").cast("string"), F.lit("None"))), again), "chunk_order_gap": (book, gap)}))
    out.append(faults(repeated(chunks, ["book", "content_hash", "pages", "refs"]), "chunk_overlap_duplicate", chunk))
    out.append(faults(t["books"].join(chunks.select("book").distinct(), "book", "left_anti"), "chunks_missing", book))
    said = chunks.where(F.coalesce("evidence", F.lit("")) != "")
    out.append(faults(chunks, "evidence_missing", chunk, F.coalesce("evidence", F.lit("")) == ""))
    # Who says it and how often is asked by several rules, of which each would gather all evidence again.
    said_by = staged(said.groupBy(F.col("evidence").alias("id")).agg(F.min("book").alias("book"), F.count(F.lit(1)).alias("n")), "evidence")
    out.append(faults(said_by, "evidence_duplicate", F.col("id"), F.col("n") > 1))
    evidence = said_by.select("book", "id", F.lit("evidence").alias("kind"))
    # Of all evidence only what other tables name is gathered again for their rules.
    payloads = t["assets"].select("book", F.explode(F.from_json("payload", "evidence_ids array<string>")["evidence_ids"]).alias("id"))
    named = [t["edges"].select("book", F.explode("evidence").alias("id")), t["targets"].select("book", F.col("evidence").alias("id")), payloads, *[t["links"].select("book", F.col(end).alias("id")) for end in ("source", "target")]]
    named = evidence.join(few(reduce(DataFrame.unionByName, named).distinct(), "named"), ["book", "id"], "left_semi")
    line = Window.partitionBy("book").orderBy("place", "chunk")
    by_book = spread(said.select("book", "chunk", "place", "evidence", "previous", "next"), n_chunks, "book")
    links = keep_best(by_book, ["book", "evidence"], "place", "chunk").withColumn("_p", F.lag("evidence").over(line)).withColumn("_n", F.lead("evidence").over(line))
    out.append(several(links, {f"{name}_chain": (F.concat_ws(":", "book", "evidence"), ~F.col(name).eqNullSafe(F.col(want))) for name, want in (("previous", "_p"), ("next", "_n"))}))

    told = t["snapshots"].withColumn("s", F.from_json("payload", SNAPSHOT)).withColumn("bad", F.try_parse_json("payload").isNull())
    out.append(faults(told, "snapshot_invalid", book, F.col("bad")))
    good = told.where(~F.col("bad"))
    out.append(faults(good, "snapshot_schema", book, ~F.coalesce(F.col("s.schema_version").isin(*SCHEMAS), F.lit(False))))
    out.append(faults(good, "snapshot_hash", book, ~F.col("s.content_hash").eqNullSafe(F.col("content_hash"))))
    for code, listed, stored in (("snapshot_evidence", "s.evidence.evidence_id", evidence), ("snapshot_media", "s.media.assets.media_id", media)):
        has = good.select("book", F.explode(listed).alias("id"), F.lit(1).alias("side"))
        sides = has.unionByName(stored.select("book", "id", F.lit(2).alias("side"))).groupBy("book", "id").agg(F.bit_or("side").alias("side"))
        wrong = sides.where("side < 3 OR id IS NULL OR book IS NULL").join(good.select("book", F.lit(True).alias("_good")).distinct(), "book", "left")
        out.append(faults(wrong, code, book, (F.col("side") != 2) | F.col("_good")))

    edges, edge = t["edges"], F.col("edge")
    graph = nodes.unionByName(terms)
    for end in ("source", "target"):
        out.append(faults(lacking(edges, end, graph), f"edge_{end}_missing", edge))
        for kind, of in (("node", F.col("relation").isin(*OF_NODES)), ("term", ~F.col("relation").isin(*OF_NODES))):
            out.append(faults(lacking(edges.where(of), end, graph, kind), "edge_endpoint_kind", edge))
    shown = edges.select("book", "edge", F.explode("evidence").alias("shown"))
    out.append(faults(lacking(shown, "shown", named), "edge_evidence_missing", edge))
    up = edges.where(F.col("relation") == "parent_of").select("book", "edge", F.col("target").alias("node"), F.col("source").alias("above"))
    met = up.join(t["nodes"], ["book", "node"], "left")
    out.append(faults(met, "edge_parent_mismatch", edge, ~F.col("parent").eqNullSafe(F.col("above"))))
    graph_parent = up.groupBy("book", "node").agg(F.max_by("above", "edge").alias("parent"))
    out.append(faults(on_cycles(graph_parent), "edge_parent_cycle", F.col("node")))

    for column, of in (("node", nodes), ("evidence", named)):
        out.append(faults(lacking(t["targets"].where(F.col(column).isNotNull()), column, of), f"target_{column}_missing", F.col("term")))
    assets, asset = t["assets"].withColumn("bad", F.try_parse_json("payload").isNull()).withColumn("p", F.from_json("payload", "media_id string, evidence_ids array<string>")), F.col("media")
    out.append(faults(assets, "media_generation", asset, other))
    out.append(faults(lacking(assets, "section", nodes), "media_section_missing", asset))
    out.append(faults(assets, "media_payload_invalid", asset, F.col("bad")))
    out.append(faults(assets, "media_payload_id", asset, ~F.col("bad") & ~F.col("p.media_id").eqNullSafe(F.col("media"))))
    shown = assets.where(~F.col("bad")).select("book", "media", F.explode("p.evidence_ids").alias("shown"))
    out.append(faults(lacking(shown, "shown", named), "media_evidence_missing", asset))
    ends = reduce(DataFrame.unionByName, (nodes, terms, media, named))
    out.append(faults(t["links"], "media_link_relation", F.col("link"), ~F.coalesce(F.col("relation").isin(*LINKED), F.lit(False))))
    for side, end in enumerate(("source", "target")):
        kinds = F.create_map(*[F.lit(x) for relation, pair in LINKED.items() for x in (relation, pair[side])])
        wanted = t["links"].where(F.col("relation").isin(*LINKED)).withColumn("kind", kinds[F.col("relation")]).withColumn("id", F.col(end))
        out.append(faults(wanted.join(ends, ["book", "id", "kind"], "left_anti"), "media_link_endpoint", F.col("link")))
    return reduce(DataFrame.unionByName, out).distinct()
