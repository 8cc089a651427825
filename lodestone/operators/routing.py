"""Retrieval by a book's own apparatus: terms and sections that a query names, one step along the graph, evidence."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import staged
from .ranking import top_by

#: Targets of a term, and places in a queue for what occurs with it (fixed values).
TARGETS, TOGETHER = 4, 4
#: Rows of a table of terms or sections that is broadcast; larger ones are shuffled.
MOST_TERMS = 100_000
#: Relations between terms, and the path of a section by its relation (fixed values).
BETWEEN_TERMS = ["alias_of", "see_also", "co_occurs"]

ITEM = ["doc", "term", "node", "page", "evidence", "chunk", "confidence", "path", "edge"]


def admitted(segments: list[str] | None) -> Column:
    """Whether a chunk's segment may be read: all of them without a list, none with an empty one."""
    return F.lit(True) if segments is None else F.coalesce(F.col("segment").isin(segments), F.lit(False)) if segments else F.lit(False)


def representatives(chunks: DataFrame, segments: list[str] | None) -> DataFrame:
    """(doc, node, chunk, evidence): the first admitted chunk of each section, by place, then chunk."""
    first = F.min(F.struct("place", "chunk", "evidence"))
    return chunks.where(F.col("node").isNotNull() & admitted(segments)).groupBy("doc", "node").agg(first.alias("first")).select("doc", "node", "first.chunk", "first.evidence")


def small(df: DataFrame, name: str) -> DataFrame:
    """df staged and counted, to be broadcast if it is small."""
    df = staged(df, name)
    return F.broadcast(df) if df.count() <= MOST_TERMS else df


def resolved(targets: DataFrame, chunks: DataFrame, segments: list[str] | None = None, k: int = TARGETS) -> DataFrame:
    """The first k targets of each term (confidence falling, page, key) with the chunk that shows them, `at` from 1.

    A target's chunk is the first admitted one of its evidence. Only where no chunk at all has that evidence, admitted or
    not, its section's first admitted chunk stands in. With segments, targets without a chunk fall away before the cut.
    Empty evidence counts as none.
    """
    targets = targets.withColumn("evidence", F.nullif("evidence", F.lit("")))
    told = F.col("evidence").isNotNull()
    exact = chunks.where(F.col("evidence").isNotNull()).groupBy("doc", "evidence").agg(F.min(F.when(admitted(segments), F.struct("place", "chunk"))).alias("exact"), F.lit(True).alias("known"))
    instead = small(representatives(chunks, segments).select("doc", "node", F.col("chunk").alias("_chunk"), F.col("evidence").alias("_evidence")), "sections")
    # Targets without evidence meet none, so they stay out of that shuffle.
    t = targets.where(told).join(exact, ["doc", "evidence"], "left").unionByName(targets.where(~told), allowMissingColumns=True).join(instead, ["doc", "node"], "left")
    fallback = F.col("known").isNull() & F.col("_chunk").isNotNull()
    t = t.withColumn("chunk", F.when(fallback, F.col("_chunk")).otherwise(F.col("exact.chunk"))).withColumn("evidence", F.when(fallback, F.col("_evidence")).otherwise(F.col("evidence")))
    if segments is not None:
        t = t.where("chunk IS NOT NULL")
    order = [F.col("confidence").desc_nulls_last(), F.col("page").asc_nulls_first(), F.col("key")]
    return top_by(t, ["doc", "term"], order, k, "at").select("doc", "term", "node", "page", "evidence", "chunk", "confidence", "relation", "at")


def eligible(targets: DataFrame, chunks: DataFrame, segments: list[str]) -> DataFrame:
    """(doc, term) of all that segments leave something of: to restrict a search for seeds before its limit. A term is
    one with a resolved target, or the id of a section that has an admitted chunk."""
    by_target = resolved(targets, chunks, segments, 1).select("doc", "term")
    return by_target.unionByName(representatives(chunks, segments).select("doc", F.col("node").alias("term"))).distinct()


def queues(seeds: DataFrame, targets: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, terms: DataFrame, limit: int, segments: list[str] | None = None, expand: bool = False, everywhere: bool = False, adjacent: bool = False) -> DataFrame:
    """(query, seed, at, identity, ITEM): what each seed of a query offers, in its order, the first `limit` of distinct
    identity. No more of a queue can come to use, since every item taken from it is among the results from then on.

    seeds (query, seed, doc, term): a query's terms in order. targets (doc, term, key, node, evidence, page, confidence,
    relation), chunks (doc, chunk, evidence, node, segment, place), nodes (doc, node, page, confidence), edges (doc, edge,
    source, target, relation, weight), terms (doc, term); ids are strings.

    A queue begins with the term's resolved targets; without any, with the section of that id, else (without segments)
    with the bare term. expand: targets of terms that edges join it to, heaviest edge first, four at most of those that
    merely occur together. everywhere: parents and children of the queue's own sections. adjacent: one next and one
    previous section a seed, from the first section that has one. Hot nodes meet no list: edges are joined and cut by
    rank, which Spark does before it shuffles.

    A query's seed is one term, and a term's queue is the same for all who ask, so each distinct term is expanded once.
    """
    asked, found = expanded(seeds, targets, chunks, nodes, edges, terms, limit, segments, expand, everywhere, adjacent)
    return asked.join(found.hint("merge"), same_term()).select("query", "seed", "at", "identity", *ITEM)


def same_term() -> Column:
    return F.col("_in").eqNullSafe(F.col("doc")) & F.col("_of").eqNullSafe(F.col("asked"))


def expanded(seeds: DataFrame, targets: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, terms: DataFrame, *how) -> tuple[DataFrame, DataFrame]:
    """(query, seed, _in, _of): what is asked for, a term _of a document _in; and the queues of distinct terms."""
    asked = staged(seeds.select("query", "seed", F.col("doc").alias("_in"), F.col("term").alias("_of")), "asked")
    once = asked.select(F.col("_in").alias("doc"), F.col("_of").alias("asked")).distinct()
    return asked, staged(term_queues(once, targets, chunks, nodes, edges, terms, *how), "queues")


def firsts(found: DataFrame, limit: int) -> DataFrame:
    """The first `limit` of distinct identity of each term asked for, `at` from 1."""
    keys = ["doc", "asked", "identity"]
    once = found.groupBy(*keys).agg(F.min(F.struct("order", *[c for c in found.columns if c not in [*keys, "order"]])).alias("item"))
    return top_by(once, ["doc", "asked"], [F.col("item.order"), F.col("identity")], limit, "at").select(*keys, "item.*", "at")


def term_queues(seeds: DataFrame, targets: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, terms: DataFrame, limit: int, segments: list[str] | None, expand: bool, everywhere: bool, adjacent: bool) -> DataFrame:
    """(doc, asked, at, identity, ITEM): what `queues` says of distinct (doc, asked). Sections around a queue's own come
    after all else, so they are sought only for queues that are not full without them."""
    seeds = staged(seeds, "seeds")
    edges = edges.select("doc", "edge", "source", "target", "relation", "weight")
    ways = edges.select("doc", F.col("source").alias("here"), F.col("target").alias("there"), F.lit(0).alias("way"), "edge", "relation", "weight").unionByName(
        edges.where("source <> target OR relation = 'next_section'").select("doc", F.col("target").alias("here"), F.col("source").alias("there"), F.lit(1).alias("way"), "edge", "relation", "weight"))
    none = F.lit(None).cast("string")

    def place(part: int, section=None, way=None, weight=None, edge=None, at=None) -> Column:
        given = [(section, "string"), (way, "int"), (weight, "double"), (edge, "string"), (at, "int")]
        return F.struct(F.lit(part).alias("part"), *[(F.lit(None) if c is None else c).cast(kind).alias(f"p{i}") for i, (c, kind) in enumerate(given)]).alias("order")

    def item(order: Column, path: Column, term: Column = none, edge: Column = none) -> list[Column]:
        """What a row is shuffled with, each string once: the chunk is the identity if `shown`; the term is the one asked for
        and the edge that of the order, unless given."""
        return ["doc", "asked", F.coalesce("chunk", "evidence", "node", term, "asked").alias("identity"), order, term.alias("term"), "node", "page", "evidence", F.col("chunk").isNotNull().alias("shown"), "confidence", path.alias("path"), edge.alias("edge")]

    known = seeds.join(terms.select("doc", F.col("term").alias("asked")).distinct(), ["doc", "asked"], "left_semi")
    steps = known.join(ways.where(F.col("relation").isin(BETWEEN_TERMS)).withColumnRenamed("here", "asked"), ["doc", "asked"])
    steps = staged(steps.join(terms.select("doc", F.col("term").alias("there")).distinct(), ["doc", "there"], "left_semi"), "steps") if expand else None
    wanted = seeds.select("doc", F.col("asked").alias("term"))
    if expand:
        wanted = wanted.union(steps.select("doc", F.col("there").alias("term")))
    wanted = staged(wanted.distinct(), "wanted")
    if wanted.count() <= MOST_TERMS:
        hits = resolved(targets.join(F.broadcast(wanted), ["doc", "term"], "left_semi"), chunks, segments)
    else:
        hits = resolved(targets, chunks, segments).join(wanted.hint("merge"), ["doc", "term"], "left_semi")
    hits = staged(hits, "targets")
    of_asked = hits.withColumnRenamed("term", "asked")
    direct = seeds.join(of_asked, ["doc", "asked"]).select(*item(place(0, at=F.col("at")), F.concat(F.lit("book-"), "relation")))

    sections = nodes.select("doc", "node", "page", "confidence").join(representatives(chunks, segments), ["doc", "node"], "left" if segments is None else "inner")
    sections = small(sections.select("doc", "node", "page", "evidence", "chunk", "confidence"), "sections")
    bare = seeds.join(of_asked.select("doc", "asked").distinct(), ["doc", "asked"], "left_anti")
    by_section = bare.join(sections.withColumn("asked", F.col("node")), ["doc", "asked"]).select(*item(place(0), F.lit("book-section")))
    own = staged(direct.unionByName(by_section), "own")
    found = own
    if segments is None:
        rest = bare.join(nodes.select("doc", F.col("node").alias("asked")).distinct(), ["doc", "asked"], "left_anti")
        empty = [none.alias("node"), F.lit(None).cast(nodes.schema["page"].dataType).alias("page"), none.alias("evidence"), none.alias("chunk"), F.lit(0.0).alias("confidence")]
        found = found.unionByName(rest.select("*", *empty).select(*item(place(0), F.lit("book-term"))))
    if expand:
        near = steps.join(hits.withColumnRenamed("term", "there").withColumnRenamed("relation", "_as"), ["doc", "there"])
        near = near.select(*item(place(1, weight=-F.col("weight"), edge=F.col("edge"), at=F.col("at")), F.concat(F.lit("book-graph-"), "relation"), F.col("there")), "relation")
        together = top_by(near.where("relation = 'co_occurs'"), ["doc", "asked"], [F.col("order")], TOGETHER)
        found = found.unionByName(near.where("relation <> 'co_occurs'").drop("relation")).unionByName(together.drop("relation", "rank"))
    ahead = firsts(found, limit)
    if everywhere or adjacent:
        ahead = staged(ahead.withColumn("n", F.max("at").over(Window.partitionBy("doc", "asked"))), "ahead")
        full, short = ahead.where(F.col("n") >= limit).drop("n"), ahead.where(F.col("n") < limit)
        home = own.where("node IS NOT NULL").select("doc", "asked", F.col("node").alias("here")).distinct().join(short.select("doc", "asked").distinct(), ["doc", "asked"], "left_semi")
        home = staged(home, "home")
        found = short.drop("n", "at")
        if everywhere:
            around = home.join(ways.where("relation = 'parent_of'"), ["doc", "here"]).withColumnRenamed("there", "node").join(sections, ["doc", "node"])
            name = F.when(F.col("way") == 0, "book-graph-child").otherwise("book-graph-parent")
            found = found.unionByName(around.select(*item(place(2, section=F.col("here"), weight=-F.col("weight"), edge=F.col("edge")), name)))
        if adjacent:
            # Of a section and a direction only the heaviest edge counts, whether or not it leads to a section.
            heaviest = top_by(ways.where("relation = 'next_section'"), ["doc", "here", "way"], [F.col("weight").desc(), F.col("edge")], 1)
            beside = home.join(heaviest.drop("rank", "relation"), ["doc", "here"]).withColumnRenamed("there", "node").join(sections, ["doc", "node"])
            one = top_by(beside, ["doc", "asked", "way"], [F.col("here")], 1)
            name = F.when(F.col("way") == 0, "book-graph-next").otherwise("book-graph-previous")
            found = found.unionByName(one.select(*item(place(3, section=F.col("here"), way=F.col("way")), name, edge=F.col("edge"))))
        ahead = full.unionByName(firsts(found, limit))
    whole = {"term": F.coalesce("term", "asked"), "chunk": F.when(F.col("shown"), F.col("identity")), "edge": F.coalesce("order.p3", "edge")}
    return ahead.select("doc", "asked", "at", "identity", *[whole[c].alias(c) if c in whole else c for c in ITEM[1:]])


def turns(queues: list[list], limit: int, most_seeds: int) -> list[tuple[int, int]]:
    """(queue, item) by numbers, in turn: each queue gives its first item that none gave before, until there are `limit`."""
    if len(queues) > most_seeds:
        raise ValueError(f"a query has {len(queues)} seeds, over {most_seeds}")
    seen, taken = set(), []
    waiting = [(k, iter(enumerate(q))) for k, q in enumerate(queues)]
    while waiting and len(taken) < limit:
        going = []
        for k, queue in waiting:
            fresh = next(((i, x) for i, x in queue if x not in seen), None)
            if fresh is not None and len(taken) < limit:
                seen.add(fresh[1])
                taken.append((k, fresh[0]))
                going.append((k, queue))
        waiting = going
    return taken


def routed(offers: DataFrame, limit: int, most_seeds: int | None = None) -> DataFrame:
    """Queues taken in turn: each gives its first item that no queue gave before, until a query has `limit` results;
    `place` from 1. Groups are bounded: `limit` items of each of at most `most_seeds` queues (3 * limit; more raises)."""
    most_seeds = 3 * limit if most_seeds is None else most_seeds
    kind = {f.name: f.dataType.simpleString() for f in offers.schema}

    @F.udf(f"array<struct<place:int,seed:{kind['seed']},doc:{kind['doc']},identity:string>>")
    def take(rows):
        queues = [list(q) for _, q in groupby(rows, key=lambda r: r.seed)]
        picked = turns([[(r.doc, r.identity) for r in q] for q in queues], limit, most_seeds)
        return [(n, queues[k][i].seed, queues[k][i].doc, queues[k][i].identity) for n, (k, i) in enumerate(picked, 1)]

    by_query = offers.select("query", "seed", "at", "doc", "identity").repartition("query").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("seed", "at", "doc", "identity"))).alias("rows"))
    picked = by_query.select("query", F.explode(take("rows")).alias("p")).select("query", "p.*")
    return picked.join(offers, ["query", "seed", "doc", "identity"]).select("query", "place", "seed", *ITEM)


def retrieved(seeds: DataFrame, targets: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, terms: DataFrame, limit: int, segments: list[str] | None = None, expand: bool = False, everywhere: bool = False, adjacent: bool = False, most_seeds: int | None = None) -> DataFrame:
    """`routed` over `queues`, without writing out each seed's queue: turns are taken over lists of identities, and only
    what was taken meets the items."""
    most_seeds = 3 * limit if most_seeds is None else most_seeds
    asked, found = expanded(seeds, targets, chunks, nodes, edges, terms, limit, segments, expand, everywhere, adjacent)
    kind = {f.name: f.dataType.simpleString() for f in asked.schema}

    @F.udf(f"array<struct<place:int,seed:{kind['seed']},_in:{kind['_in']},_of:{kind['_of']},_at:int>>")
    def take(rows):
        picked = turns([[(r["_in"], x) for x in r["ids"]] for r in rows], limit, most_seeds)
        return [(n, rows[k]["seed"], rows[k]["_in"], rows[k]["_of"], i + 1) for n, (k, i) in enumerate(picked, 1)]

    ids = found.groupBy("doc", "asked").agg(F.array_sort(F.collect_list(F.struct("at", "identity"))).alias("ids")).select("doc", "asked", "ids.identity")
    waiting = asked.join(ids.hint("merge"), same_term()).select("query", "seed", "_in", "_of", F.col("identity").alias("ids")).repartition("query")
    by_query = waiting.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("seed", "_in", "_of", "ids"))).alias("rows"))
    picked = staged(by_query.select("query", F.explode(take("rows")).alias("p")).select("query", "p.*"), "picked")
    return picked.join(found.hint("merge"), same_term() & (F.col("_at") == F.col("at"))).select("query", "place", "seed", *ITEM)
