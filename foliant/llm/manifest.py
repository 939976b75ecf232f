"""Operator 11: a Merkle manifest of a dataset, with proofs by nested-interval labels.

A row's leaf is the SHA-256 of its columns. Rows of one source, in the order of doc_id, make a tree of sixteen children
a node; the sources' trees make one more tree above them. A node carries the interval of leaf ranks that it covers.
Leaves get their ranks by one range exchange of their digests, never of texts, so a source that holds most rows is
spread over many tasks. Each level is summed up from the one below by groups of sixteen. Going down again, a node meets
its parent at the parent's level by the bucket of its interval and by containment; the children of the parent's
interval without the node's own are its siblings, and with those of the parent's ancestors they are its proof.

Defined results: a null column is ``-`` in the leaf; a null doc_id comes first in its source and is never tampered with.
Rows with one doc_id are leaves of their own in the order of their digests, equal rows in any. A null source is the first
source; empty strings are sources too. An empty table has no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import attach, partitions, written

FANOUT = 16
WIDTH = 64  # characters of a digest
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "struct<before:string,after:string>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts in a row."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(c: Column) -> Column:
    """A value's length in UTF-8 bytes and the value, or ``-`` for null: no two rows of fields read alike."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, every: int = 5) -> DataFrame:
    """(source, doc_id, leaf, tampered): the leaf's digest, and for every fifth document by CRC-32 the digest of the row
    with its text's A-Z in lower case, else null."""
    names = ("doc_id", "source", "lang", "n_chars", "text")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), "lang", "n_chars", "text")
    leaf = digest(*[field(F.col(c)) for c in names])
    folded = digest(*[field(F.translate("text", UPPER, LOWER) if c == "text" else F.col(c)) for c in names])
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    return rows.select("source", "doc_id", leaf.alias("leaf"), F.when(struck, folded).alias("tampered"), F.monotonically_increasing_id().alias("tie"))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``rank``, their place in ``order``. Parts are sorted where a range exchange puts them; a row's rank
    is its place in its part after the rows of the parts before it, of which there is one count a part."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumn("place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("place", 33)
    sizes = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select("part", before.alias("base"))  # a row a part of the exchange
    inside = F.col("place").bitwiseAND((1 << 33) - 1)
    return dealt.join(F.broadcast(base), part == F.col("part")).withColumn("rank", F.col("base") + inside).drop("base", "part", "place")


def span_of(level: int) -> int:
    """Children that a node ``level`` above them covers."""
    return FANOUT**level


def build(items: DataFrame, most: int) -> list[DataFrame]:
    """Runs by level of (key, pos, size, lo, hi, digest, item): trees by ``key`` with ``size`` items each, at most
    ``most``, item ``pos`` covering leaf ranks [lo, hi). A run holds its children's digests in a row as ``kids``, covers
    the interval [lo, hi), and has the digest of what it holds; level 0 also keeps the items. A tree of one item keeps
    that item's digest."""
    levels: list[DataFrame] = []
    child = items.select("key", "pos", "size", "lo", "hi", "digest", "item")
    while True:
        level = len(levels)
        parts = F.array_sort(F.collect_list(F.struct("pos", "digest", "lo", "hi", *(["item"] if level == 0 else []))))
        grouped = child.groupBy("key", "size", F.floor(F.col("pos") / FANOUT).alias("pos")).agg(parts.alias("m"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        kids = F.concat_ws("", F.transform("m", lambda x: x["digest"]))
        run = grouped.select("key", "pos", "size", "lo", "hi", kids.alias("kids"), *(["m"] if level == 0 else []))
        alone = F.col("size") == 1
        levels.append(written(run.withColumn("digest", F.when(alone, F.col("kids")).otherwise(digest(F.col("kids")))), "runs"))
        if span_of(level + 1) >= most:
            return levels
        child = levels[-1].where(F.col("size") > span_of(level + 1))


def roots(levels: list[DataFrame]) -> DataFrame:
    """(key, size, lo, hi, digest) of each tree's root."""
    found = [r.where((F.col("size") <= span_of(k + 1)) & (F.col("size") > (span_of(k) if k else 0))).select("key", "size", "lo", "hi", "digest") for k, r in enumerate(levels)]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def around(kids: Column, index: Column) -> Column:
    """What stands before and after a child among ``kids``: the parent's interval without the child's own."""
    at = (index * WIDTH).cast("int")
    return F.struct(F.substring(kids, F.lit(1), at).alias("before"), F.substring(kids, at + WIDTH + 1, F.length(kids)).alias("after"))


def descend(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """(key, item, digest, steps) of all items: siblings level by level, from the item's own to those in ``top`` (key,
    steps) above its tree's root."""
    above: DataFrame | None = None  # runs of the level above with the steps of their node
    for level in range(len(levels) - 1, -1, -1):
        runs, limit = levels[level], span_of(level + 1)
        # this level's runs of one a tree are roots: what is above them is in ``top``
        here = runs.where((F.col("size") <= limit) & (F.col("size") > (span_of(level) if level else 0))).join(top.select("key", "steps"), "key")
        if above is not None:
            own, parent = runs.where(F.col("size") > limit).alias("c"), above.alias("p")
            inside = (F.col("c.key") == F.col("p.key")) & (F.floor(F.col("c.pos") / FANOUT) == F.col("p.pos")) & (F.col("p.lo") <= F.col("c.lo")) & (F.col("c.hi") <= F.col("p.hi"))
            step = around(F.col("p.kids"), F.col("c.pos") - F.col("p.pos") * FANOUT)
            met = own.join(parent, inside).select("c.*", F.concat(F.array(step), F.col("p.steps")).alias("steps"))
            here = here.unionByName(met)
        above = here
    item = above.select("key", "size", "pos", "kids", "steps", F.explode("m").alias("x"))
    step = around(F.col("kids"), F.col("x.pos") - F.col("pos") * FANOUT)
    steps = F.when(F.col("size") == 1, F.col("steps")).otherwise(F.concat(F.array(step), F.col("steps")))
    return item.select("key", "x.item", "x.digest", steps.alias("steps"))


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, start, lambda acc, s: digest(s["before"], acc, s["after"]))


def manifest(docs: DataFrame, every: int = 5) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, and ``steps``, its proof: the
    siblings before and after it, level by level."""
    none = F.array().cast(f"array<{STEP}>")
    rows = leaves(docs, every).withColumns({"named": F.col("source").isNotNull(), "source": F.coalesce("source", F.lit(""))})
    placed = ranked(rows, "named", "source", "doc_id", "leaf", "tie")
    groups = placed.groupBy("named", "source").agg(F.min("rank").alias("key"), F.count("*").alias("size"), F.count("*").alias("n"))
    groups = written(groups, "sources")  # a row a source
    most, n = groups.agg(F.max("size"), F.count("*")).first()
    if not n:
        return placed.select("doc_id", "leaf", F.lit("").alias("subroot"), F.lit("").alias("root"), F.lit("").alias("proof_sha256"), F.lit("").alias("folded_root"), F.lit(True).alias("verified"), none.alias("steps"))
    keyed = attach(placed, groups, "named", "source")  # a source with most rows is met by broadcast
    item = F.struct("doc_id", "tampered")
    items = keyed.select("key", (F.col("rank") - F.col("key")).alias("pos"), "size", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), F.col("leaf").alias("digest"), item.alias("item"))
    below = build(items, most)
    # sources in their order make the tree above, each covering the ranks of its leaves
    tops = ranked(roots(below).select("key", "lo", "hi", "digest"), "lo")
    tops = tops.select(F.lit(0).alias("key"), F.col("rank").alias("pos"), F.lit(n).alias("size"), "lo", "hi", "digest", F.struct(F.col("key").alias("source_key"), F.col("digest").alias("subroot")).alias("item"))
    over = build(tops, n)
    root = roots(over).first()["digest"]
    proofs = descend(over, over[-1].sparkSession.range(1).select(F.lit(0).alias("key"), none.alias("steps")))
    proofs = written(proofs.select(F.col("item.source_key").alias("key"), "item.subroot", "steps"), "proofs")  # a row a source
    found = descend(below, proofs)
    # the subroot goes with the last step of a source's own tree; folding the leaf again would cost as much as a proof
    named = found.join(proofs.select("key", "subroot"), "key")
    flat = F.concat_ws("", F.transform("steps", lambda s: F.concat(s["before"], s["after"])))
    out = named.select("item.doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root).alias("root"), digest(flat).alias("proof_sha256"), fold(F.coalesce("item.tampered", "digest"), F.col("steps")).alias("folded_root"), "steps")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
