"""Near duplicates by shingle similarity: two texts link when their sets of word shingles have a Jaccard similarity
of at least ``SIMILARITY``.

Candidates come from fingerprints: SimHash as in operator 4, and ``BANDS`` independent ones of ``ROWS`` least hashes
each. At a similarity of 0.8 the bands alone miss some 7 pairs of 10000, fewer above. What fingerprints join makes
candidate groups, which only bound the work: inside a group every link is found by comparing whole shingle sets.

Equal sets are one node before any of this. Groups over ``NODES`` nodes or ``GRAMS`` shingles are cut into rings around
a pivot; what lies near it is linked to it at once, and only rings that can hold further links are dealt out over pairs
of blocks. A cell yields a spanning forest of its links.

Defined results: null, empty and blank texts have the empty set and link with each other; fewer words than a shingle
are one shingle. A null doc_id is no candidate for the smallest one. doc_id may have any type that has an order. Other
columns are ignored by ``similar`` and kept by ``keep_first``, whatever their names and types.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import neardup
from .components import components
from .ragged import blocks, give_back, texts_of
from .store import attach, free, partitions, remove, small_batches, written

SIMILARITY = (4, 5)  # as a fraction
BANDS, ROWS = 24, 6
NODES, GRAMS = 1024, 1 << 19
PIVOTS = 8
#: Bytes kept of a shingle's hash: in a pair of texts of 20,000 words, unlike shingles fall together with a chance of
#: one in 700,000.
WIDTH = 6
_draw = np.random.default_rng(42)
FACTORS = _draw.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
OFFSETS = _draw.integers(0, 1 << 64, BANDS * ROWS, np.uint64)


def band_keys(grams: np.ndarray) -> list[int]:
    """A signed key for each band of least hashes; none for the empty set."""
    if not len(grams):
        return []
    low = np.full(BANDS * ROWS, np.uint64((1 << 64) - 1))
    for a in range(0, len(grams), 1024):
        np.minimum(low, (grams[a : a + 1024, None] * FACTORS + OFFSETS).min(axis=0), out=low)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(low.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def set_hash(grams: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(grams.tobytes(), neardup.SEED)], np.uint64).view(np.int64)[0])


TABLE = "row long, node long, fp long, size long, bands array<long>, grams binary"


def described(docs: DataFrame, shingle: int) -> DataFrame:
    """Each row of (doc_id, text) with its shingle set, the set's hash as node, its SimHash and its band keys."""
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(TABLE).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, "text")
            for a, b in blocks([len(t) for t in texts], 1 << 20):
                columns: list[list] = [[] for _ in range(5)]
                for text in texts[a:b]:
                    h = np.array(neardup.shingle_hashes(text, shingle), np.uint64)
                    grams = np.unique(h)
                    fp = neardup.majority(h)
                    for c, x in zip(columns, (set_hash(grams), fp, len(grams), band_keys(grams), np.unique(grams >> np.uint64(64 - 8 * WIDTH)).view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()), strict=True):
                        c.append(x)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
                made = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], *made], schema.names)
            give_back()

    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(run, schema)


def wide(raw: pa.Buffer) -> np.ndarray:
    """A set's hashes from their bytes."""
    out = np.zeros((len(raw) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)
    return out.view("<u8").ravel()


def sieve(found: DataFrame, column: str, most: int = 1 << 28) -> Column:
    """A condition that holds for every value of ``column`` in ``found`` and for few others: a bit for each of some 16
    hashes a value. The bitmap is made by partial sums and has ``most`` bits at the most, 32 MB whatever the corpus;
    beyond that it lets more pass, and the join after it decides."""
    bits = 1 << 15
    n = found.count()
    while bits < min(16 * n, most):
        bits *= 2
    at = F.pmod(F.xxhash64(column), F.lit(bits).cast("long"))
    made = found.select((at + 1).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("m"))
    whole = np.zeros((bits >> 15, 4096), np.uint8)
    for b, m in made.toLocalIterator():
        whole[b - 1] = np.frombuffer(m, np.uint8)
    sent = found.sparkSession.sparkContext.broadcast(whole.ravel())

    def hit(h):
        v = h.to_numpy()
        return pd.Series((sent.value[v >> 3] >> (v & 7)) & 1 == 1)

    return F.pandas_udf(hit, "boolean")(at)


def forest(nodes: np.ndarray, grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between sets."""
    p, q = SIMILARITY
    sizes = np.array([len(g) for g in grams])
    order = np.argsort(sizes, kind="stable")
    nodes, sizes, grams = nodes[order], sizes[order], [grams[k] for k in order]
    known, flat = np.unique(np.concatenate(grams), return_inverse=True)
    ends = np.cumsum(sizes)
    starts, mark, free = ends - sizes, np.zeros(len(known), bool), np.ones(len(nodes), bool)
    left, right = [], []
    for first in range(len(nodes)):
        if not free[first]:
            continue
        free[first], queue = False, [first]
        while queue:
            x = queue.pop()
            lo, hi = np.searchsorted(sizes * q, sizes[x] * p), np.searchsorted(sizes * p, sizes[x] * q, "right")
            if not free[lo:hi].any():
                continue
            own = flat[starts[x] : ends[x]]
            mark[own] = True
            common = np.add.reduceat(mark[flat[starts[lo] : ends[hi - 1]]], starts[lo:hi] - starts[lo], dtype=np.int64)
            mark[own] = False
            got = lo + np.flatnonzero(free[lo:hi] & (common * (p + q) >= p * (sizes[lo:hi] + sizes[x])))
            free[got] = False
            left += [nodes[x]] * len(got)
            right += nodes[got].tolist()
            queue += got.tolist()
    return np.array(left, np.int64), np.array(right, np.int64)


def candidates(table: DataFrame) -> DataFrame:
    """(node, root): nodes that fingerprints join, by groups. Fingerprints are nodes of their own here, named by a hash,
    so what they link needs no join."""
    keys = written(table.select("node", F.explode("bands").alias("key")).distinct(), "bands")
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    banded = attach(keys, hubs, "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    prints = written(table.where("size > 0").select("fp").distinct(), "prints")
    named = lambda c: F.xxhash64(F.lit("fingerprint"), F.col(c))
    near = neardup.links(prints, neardup.plan(prints)).select(named("a").alias("a"), named("b").alias("b"))
    same = table.where("size > 0").select(F.col("node").alias("a"), named("fp").alias("b"))
    found = components(banded.union(same).union(near))  # its edges are written by now
    remove(keys, "bands"), remove(prints, "prints")
    return found


def by_cell(dealt: DataFrame, make, schema: str, *order: str) -> DataFrame:
    """What ``make`` yields for the rows (tuples that begin with root and cell) of each cell, in ``order``."""
    dealt = dealt.repartition(partitions(dealt.sparkSession), "root", "cell").sortWithinPartitions("root", "cell", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c if pa.types.is_binary(c.type) else c.to_pylist() for c in batch.columns), strict=True))
        for _, cell in groupby(rows, key=itemgetter(0, 1)):
            yield from make(cell)
        give_back()

    return dealt.mapInArrow(run, schema)


def rings(table: DataFrame, big: DataFrame) -> DataFrame:
    """(root, node, row, size, pivot, ring, near) of the nodes of ``big``, groups over one block. Some nodes of a group
    are drawn as pivots and meet every block; the one with the most near nodes counts. One minus the similarity is a
    distance, so linked nodes lie in one ring around the pivot or in neighbouring ones, rings being as wide as a link
    reaches."""
    draws = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node"))["node"] for k in range(PIVOTS)]
    drawn = big.groupBy("root").agg(F.array(*draws).alias("all")).select(F.explode(F.array_distinct("all")).alias("node"), F.lit(0).alias("late"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    cells = F.when(F.col("late") == 0, F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).otherwise(F.array(own))
    held = big.join(drawn, "node", "left").select("root", "node", "row", "size", own.alias("own"), F.coalesce("late", F.lit(1)).alias("late"), cells.alias("cells"))
    held = written(held, "pivots")
    sets = table.select("row", "grams").where(sieve(held, "row")).join(held, "row")
    dealt = sets.select("root", F.explode("cells").alias("cell"), "late", "own", "node", "row", "size", "grams")
    p, q = SIMILARITY
    schema = "root long, node long, row long, size long, pivot long, ring int, near boolean"
    kinds = (*[pa.int64()] * 5, pa.int32(), pa.bool_())
    names = [x.split()[0] for x in schema.split(", ")]

    def make(cell: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        pivots: list[tuple[int, np.ndarray]] = []
        waiting: list[tuple] = []
        out: list[tuple] = []

        def place(root, node, row, size, grams):
            for pivot, other in pivots:
                common = len(np.intersect1d(grams, other, assume_unique=True))
                union = len(grams) + len(other) - common
                out.append((root, node, row, size, pivot, q * (union - common) // ((q - p) * union), common * q >= p * union))

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for root, at, late, own, node, row, size, raw in cell:
            grams = wide(raw.as_buffer())
            if not late:
                pivots.append((node, grams))
                if own == at:
                    waiting.append((root, node, row, size, grams))
                continue
            place(root, node, row, size, grams)
            if len(out) >= 4096:
                yield batch()
                out.clear()
        for x in waiting:
            place(*x)
        if out:
            yield batch()

    found = written(by_cell(dealt, make, schema, "late"), "rings")
    votes = found.groupBy("root", "pivot").agg(F.count_if("near").alias("near"), F.count("*").alias("n"))
    best = votes.groupBy("root").agg(F.max(F.struct("near", "pivot"))["pivot"].alias("best"), F.sum("n").alias("n"))
    return attach(found, best, "root").where("pivot = best").drop("best")


def blocks_of(n: Column, grams: Column) -> Column:
    return F.ceil(F.greatest(n / NODES, grams / GRAMS)).cast("int")


def ring_cells() -> Column:
    """Cells of a node: its block meets the blocks of its own ring, but for the innermost, which the pivot joins, and
    those of the rings beside it. A cell is named by a hash of its two blocks; cells of one name are compared as one."""
    ring, own = F.col("ring"), F.pmod(F.xxhash64("node"), F.element_at("blocks", F.col("ring"))).cast("int")

    def met(step: int) -> Column:
        def name(j: Column) -> Column:
            if step == 0:
                return F.xxhash64(ring, F.least(own, j), ring, F.greatest(own, j))
            ends = [ring, own, ring + 1, j] if step == 1 else [ring - 1, j, ring, own]
            return F.xxhash64(*ends)

        made = F.transform(F.sequence(F.lit(0), F.element_at("blocks", ring + step) - 1), name)
        return F.coalesce(F.when((ring > 0) | F.lit(step != 0), made), F.array().cast("array<bigint>"))

    return F.concat(met(-1), met(0), met(1))


def links(table: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): links enough to join what any links join; each is a pair of nodes whose whole sets were compared. A group
    of one block is a cell. In a greater one all that is near the pivot is linked to it, and only rings with neighbours
    are dealt out over pairs of blocks, so a dense group costs in proportion to its size."""
    leads = table.groupBy("node").agg(F.min("row").alias("row"), F.min("size").alias("size"))
    held = written(roots.join(leads, "node"), "candidates")
    groups = held.groupBy("root").agg(blocks_of(F.count("*"), F.sum("size")).alias("blocks"), F.count("*").alias("n")).where("n > 1")
    groups = written(groups, "groups")
    held = attach(held, groups, "root")
    celled = held.where("blocks = 1").select("row", "node", "root", F.array(F.lit(0).cast("long")).alias("cells"))
    starred = None
    if not groups.where("blocks > 1").isEmpty():
        ringed = written(rings(table, held.where("blocks > 1")), "ringed")
        sizes = ringed.groupBy("root", "ring").agg(blocks_of(F.count("*"), F.sum("size")).alias("b"), F.count("*").alias("n"))
        shapes = sizes.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("ring", "b"))).alias("blocks"), F.sum("n").alias("n"))
        dealt = attach(ringed, shapes, "root").select("row", "node", "root", ring_cells().alias("cells"))
        celled = celled.union(dealt.where(F.size("cells") > 0))
        starred = ringed.where("near and node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    # only the sets of candidates move: a sieve of their rows stands before the shuffle of sets
    held = written(celled, "cells")
    sets = table.select("row", "grams").where(sieve(held, "row")).join(held, "row")
    dealt = sets.select("root", F.explode("cells").alias("cell"), "node", "grams")

    def make(cell: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        rows = list(cell)
        if len(rows) > 1:
            a, b = forest(np.array([row[2] for row in rows], np.int64), [wide(row[3].as_buffer()) for row in rows])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    found = by_cell(dealt, make, "a long, b long")
    return found.union(starred) if starred is not None else found


def _classed(docs: DataFrame, doc_id: str, text: str, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, component_id) of every row, and (node, root, component_id) of every set of shingles."""
    small_batches(docs.sparkSession)
    table = written(described(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), shingle), "shingles")
    names = written(table.select("doc_id", "node"), "nodes")
    roots = components(links(table, candidates(table)))  # its edges are written by now, and the sets are done with
    remove(table, "shingles")
    nodes = names.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    rooted = written(nodes.join(roots, "node", "left").select("node", "n", "first", F.coalesce("root", "node").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("k"))
    found = written(attach(rooted.drop("first"), least, "root", n="k").select("node", "root", "component_id", "n"), "classes")
    return attach(names, found, "node").select("doc_id", "component_id"), found.drop("n")


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """(doc_id, component_id) for every row: the least doc_id that links reach."""
    return _classed(docs, doc_id, text, shingle)[0]


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """One row of each class stays, with the columns of ``docs``; see ``neardup.keep_least`` for which."""
    rows, nodes = _classed(docs, doc_id, text, shingle)
    (node,) = free([*docs.columns, "node", "root", "component_id"], "_node")

    def bare(frame: DataFrame, group: str, first: str) -> DataFrame:
        names, at = [*frame.columns, node], frame.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = [set_hash(np.unique(np.array(neardup.shingle_hashes(t or "", shingle), np.uint64))) for t in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], names)

        found = frame.mapInArrow(run, T.StructType([*frame.schema.fields, T.StructField(node, T.LongType())]))
        return found.join(nodes.select(F.col("node").alias(node), F.col("root").alias(group), F.col("component_id").alias(first)), node).drop(node)

    return neardup.keep_least(docs, rows, bare, doc_id, text)
