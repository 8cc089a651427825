"""Mixing sources to target weights by hierarchical budgeting (operator 4), in DataFrame operations alone."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, staged

#: Documents of a leaf that one bucket of its order holds, about; the bucket in which the budget ends is sorted as one.
BUCKET_DOCS = 4096
#: Leaves that are broadcast at most; with more the table of leaves is joined by shuffle.
BROADCAST_LEAVES = 50_000
LEVELS = ["domain", "lang", "source"]
DOMAINS = 4


@dataclass(frozen=True)
class Mix:
    """Integer target weights of each level's names (default for others), the budget as a share of all tokens, and how
    often a document may occur."""

    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    default: int = 1
    share: tuple[int, int] = (3, 5)
    epochs: int = 2
    seed: int = 7


#: The production mix: weights by domain and language, sources of a language alike.
MIX = Mix({"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}})


def tokens_of(text: Column) -> Column:
    """A token for every 4 characters begun; 0 for null and empty texts."""
    return F.shiftright(F.length(F.coalesce(text, F.lit(""))) + 3, 2).cast("long")


def domain_of(docs: DataFrame) -> Column:
    """The column domain if there is one; else sources fall into DOMAINS groups by their md5."""
    if "domain" in docs.columns:
        return F.coalesce(F.col("domain").cast("string"), F.lit(""))
    return F.concat(F.lit("d"), (F.conv(F.substring(F.md5(F.coalesce(F.col("source").cast("string"), F.lit(""))), 1, 1), 16, 10).cast("int") % DOMAINS).cast("string"))


def weight_of(mix: Mix, level: str) -> Column:
    table = mix.weights.get(level) or {}
    given = F.create_map(*[F.lit(x) for x in chain(*table.items())])[F.col(level)] if table else F.lit(None)
    return F.coalesce(given, F.lit(mix.default)).cast("long")


def shared_out(children: DataFrame, parent: list[str], level: str, mix: Mix) -> DataFrame:
    """Adds quota: the parent's budget by weight, where no child gets more than cap and the rest takes what is over.

    By rising cap / weight the children that are full form a prefix: child i is full if its cap is no more than its part
    of what is left before it. The others share what the full ones leave; fractions of a token are dropped.
    """
    big = "decimal(38,0)"
    rows = children.withColumn("w", weight_of(mix, level))
    in_order = Window.partitionBy(*parent).orderBy(F.when(F.col("w") > 0, F.col("cap").cast("double") / F.col("w")).otherwise(F.lit(float("inf"))), level)
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    after = in_order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everyone = Window.partitionBy(*parent)
    rows = rows.withColumn("left_b", F.col("budget").cast(big) - F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(big)).withColumn("left_w", F.sum("w").over(after))
    rows = rows.withColumn("full", (F.col("w") > 0) & (F.col("cap").cast(big) * F.col("left_w") <= F.col("left_b") * F.col("w")))
    rows = rows.withColumn("open_b", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everyone), F.lit(0))).withColumn("open_w", F.sum(F.when(~F.col("full"), F.col("w"))).over(everyone))
    part = F.expr("CASE WHEN full THEN cap WHEN w = 0 OR open_w = 0 THEN 0 ELSE CAST((CAST(open_b AS DECIMAL(19,0)) * CAST(w AS DECIMAL(19,0))) DIV CAST(open_w AS DECIMAL(19,0)) AS BIGINT) END")
    return rows.withColumn("quota", part).drop("w", "left_b", "left_w", "full", "open_b", "open_w", "budget")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves (domain, lang, source, supply, n_docs) with quota. A node can take what its leaves hold, epochs times; so a
    leaf's shortage goes to its siblings first, and only what a whole branch can't take to the branch's siblings."""
    leaves = leaves.withColumn("cap", F.col("supply") * mix.epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    domains = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("supply").alias("supply"))
    whole = Window.partitionBy(F.lit(0))
    num, den = mix.share
    domains = domains.withColumn("all", F.sum("supply").over(whole)).withColumn("budget", F.expr(f"(CAST(all AS DECIMAL(19,0)) * {num}) DIV {den}")).drop("supply", "all")
    at_domain = shared_out(domains, [], "domain", mix).select("domain", F.col("quota").alias("budget"))
    at_lang = shared_out(langs.join(at_domain, "domain"), ["domain"], "lang", mix).select("domain", "lang", F.col("quota").alias("budget"))
    return shared_out(leaves.join(at_lang, ["domain", "lang"]), ["domain", "lang"], "source", mix).drop("cap")


def order_key(mix: Mix, epoch: Column, doc_id: Column) -> Column:
    """The place of a document in an epoch: md5 of seed, epoch and id."""
    return F.md5(F.concat(F.lit(f"{mix.seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def cuts(docs: DataFrame, leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves with `whole`, the epochs taken whole, and cut_key, cut_id: the last document of the next epoch's prefix.

    Sums by bucket of the order tell in which bucket a leaf's budget ends; only this bucket, of about BUCKET_DOCS
    documents whatever the leaf's size, is put in order.
    """
    leaves = leaves.withColumn("whole", F.when(F.col("supply") > 0, F.expr("quota div supply")).otherwise(F.lit(1)).cast("long"))
    leaves = leaves.withColumn("rest", F.when(F.col("supply") > 0, F.expr("quota % supply")).otherwise(F.lit(0)).cast("long"))
    leaves = leaves.withColumn("depth", F.least(F.lit(12), F.ceil(F.log2(F.greatest(F.col("n_docs") / BUCKET_DOCS, F.lit(1.0))) / 4)).cast("int"))
    slim = docs.select(*LEVELS, "doc_id", "tokens")
    few = leaves.where("rest > 0").select(*LEVELS, "whole", "rest", "depth")
    placed = slim.join(few, LEVELS).withColumn("key", order_key(mix, F.col("whole"), F.col("doc_id"))).withColumn("bucket", F.expr("substr(key, 1, depth)"))
    sums = placed.groupBy(*LEVELS, "bucket", "rest").agg(F.sum("tokens").alias("sum"))
    up_to = Window.partitionBy(*LEVELS).orderBy("bucket")
    ends = sums.withColumn("before", F.coalesce(F.sum("sum").over(up_to.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ends = ends.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("sum") > F.col("rest"))).select(*LEVELS, "bucket", "before")
    last = placed.join(ends, [*LEVELS, "bucket"]).withColumn("upto", F.col("before") + F.sum("tokens").over(Window.partitionBy(*LEVELS, "bucket").orderBy("key", "doc_id")))
    cut = last.groupBy(*LEVELS).agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.struct("key", F.coalesce("doc_id", F.lit(-(2**63))).alias("id")))).alias("cut"), F.min("bucket").alias("bucket"))
    # Without a document of the last bucket within the budget the prefix ends where that bucket begins.
    cut = cut.select(*LEVELS, F.coalesce("cut.key", "bucket").alias("cut_key"), F.coalesce("cut.id", F.lit(-(2**63))).alias("cut_id"))
    return leaves.join(cut, LEVELS, "left").select(*LEVELS, "whole", "cut_key", "cut_id", "quota", "supply")


def mixture(docs: DataFrame, mix: Mix = MIX) -> DataFrame:
    """Rows of docs chosen for the mix, each as often as its leaf's epochs say, with the number of the epoch as the last
    column `epoch` (with leading underscores where docs has one).

    Leaves are (domain, lang, source); null names count as ''. A budget of share of all tokens goes down the tree by
    weight; see budgets(). A leaf's documents come in whole epochs, then the longest prefix of a seeded order of the
    next one that doesn't exceed its budget. Rows of one leaf and id go in or stay out together. Documents without
    tokens count nothing and come along with whole epochs or the prefix. The text is read for its length once, and never
    shuffled: prefixes are cut by key. An empty table stays empty.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source"))
    tagged = docs.select(domain_of(docs).alias("domain"), lang.alias("lang"), source.alias("source"), F.col("doc_id").cast("long").alias("doc_id"), tokens_of(F.col("text")).alias("tokens"), own)
    slim = staged(tagged.select(*LEVELS, "doc_id", "tokens"), "leaves")
    leaves = slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("supply"), F.count(F.lit(1)).alias("n_docs"))
    table = cuts(slim, budgets(leaves, mix), mix)
    few = slim.select(*LEVELS).distinct().limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    joined = tagged.join(F.broadcast(table) if few else table, LEVELS)
    key = order_key(mix, F.col("whole"), F.col("doc_id"))
    inside = F.col("cut_key").isNotNull() & (F.struct(key, F.coalesce("doc_id", F.lit(-(2**63)))) <= F.struct("cut_key", "cut_id"))
    times = (F.col("whole") + inside.cast("int")).cast("int")
    epoch = fresh(docs, "epoch") if "epoch" in {c.lower() for c in docs.columns} else "epoch"
    copies = joined.withColumn("times", times).where("times > 0").withColumn("n", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    return copies.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("n").alias(epoch))


def mixture_sql(mix: Mix = MIX, domains: int = DOMAINS) -> str:
    """doc_id, lang, source, epoch of the same rows over the table documents, in DuckDB's SQL."""

    def case(level: str) -> str:
        table = mix.weights.get(level) or {}
        return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {mix.default} END::BIGINT" if table else f"{mix.default}::BIGINT"

    def share(name: str, children: str, parent: str, level: str) -> str:
        by = f"PARTITION BY {parent}" if parent else ""
        return f"""
{name}_w AS (SELECT *, {case(level)} AS w FROM ({children})),
{name}_o AS (SELECT *, budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_b,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w
  FROM {name}_w WINDOW o AS ({by} ORDER BY CASE WHEN w > 0 THEN cap::DOUBLE / w ELSE 'infinity'::DOUBLE END, {level})),
{name}_f AS (SELECT *, w > 0 AND cap::HUGEINT * left_w <= left_b::HUGEINT * w AS filled FROM {name}_o),
{name}_s AS (SELECT *, budget - coalesce(sum(CASE WHEN filled THEN cap END) OVER ({by}), 0) AS open_b,
    sum(CASE WHEN NOT filled THEN w END) OVER ({by}) AS open_w FROM {name}_f),
{name} AS (SELECT * EXCLUDE (budget), CASE WHEN filled THEN cap WHEN w = 0 OR open_w = 0 THEN 0 ELSE (open_b::HUGEINT * w) // open_w END::HUGEINT AS quota FROM {name}_s)"""

    num, den = mix.share
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, ((length(coalesce(text, '')) + 3) // 4)::HUGEINT AS tokens,
    'd' || (('0x' || md5(coalesce(source, ''))[1])::INTEGER % {domains}) AS domain
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens)::HUGEINT AS supply, (sum(tokens) * {mix.epochs})::HUGEINT AS cap FROM d GROUP BY ALL),
{share("a", f"SELECT domain, sum(cap) AS cap, any_value((SELECT sum(supply) FROM leaf) * {num} // {den}) AS budget FROM leaf GROUP BY domain", "", "domain")},
{share("b", "SELECT l.domain, l.lang, sum(l.cap) AS cap, any_value(a.quota) AS budget FROM leaf l JOIN a USING (domain) GROUP BY l.domain, l.lang", "domain", "lang")},
{share("c", "SELECT l.*, b.quota AS budget FROM leaf l JOIN b USING (domain, lang)", "domain, lang", "source")},
e AS (SELECT domain, lang, source, CASE WHEN supply > 0 THEN quota // supply ELSE 1 END AS whole, CASE WHEN supply > 0 THEN quota % supply ELSE 0 END AS rest FROM c),
k AS (SELECT d.*, whole, rest, md5('{mix.seed}:' || whole || ':' || doc_id) AS key FROM d JOIN e USING (domain, lang, source)),
p AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id) <= rest AND rest > 0 AS inside FROM k)
SELECT doc_id, lang, source, unnest(range((whole + inside::INTEGER)::BIGINT))::INTEGER AS epoch FROM p"""
