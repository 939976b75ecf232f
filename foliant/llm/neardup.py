"""Operator 4: SimHash near duplicates by the generalised pigeonhole.

A text's fingerprint has 64 bits, each the majority among the XXH64 hashes of its word shingles. Two fingerprints
within ``RADIUS`` bits agree within t_i bits on some part i whenever the parts' t_i + 1 add up to RADIUS + 1. The
parts group bits that go together over all fingerprints; how many parts, and which t_i each gets (unequal, -1
leaves a part out), comes from dynamic programming on candidate counts estimated from all fingerprints. An index
row per part meets probe rows with up to t_i bits changed; what meets is verified by its distance.

Equal fingerprints are one row before any of this. Rows that meet under one key are compared in groups of at most
``GROUP``; larger groups are dealt out over pairs of blocks. A group yields a spanning forest of its links, never
its pairs, which leaves components as they are and loses no link between different components.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; fewer words than a
shingle are one shingle. Repeated rows each get their row. A null doc_id is no candidate for the smallest one, and a
class without any other has a null component_id.
Other columns are ignored by ``near_duplicates`` and kept by ``keep_first``, whatever their names and types.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .ragged import blocks, texts_of
from .store import attach, free, partitions, written

RADIUS, GROUP = 4, 4096
SPACE = re.compile(rb"[ \t-\r]+")
SEED = 42


def shingle_hashes(text: str, shingle: int) -> list[int]:
    """The XXH64 hashes of a text's word shingles in order; none for a blank text."""
    words = b" ".join([w for w in SPACE.split(text.encode().lower()) if w])
    if not words:
        return []
    digest, gaps = xxhash.xxh64_intdigest, np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    m = max(1, len(gaps) + 2 - shingle)
    starts = [0, *(gaps[: m - 1] + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(words)]
    return [digest(words[s:e], SEED) for s, e in zip(starts, ends, strict=True)]


def simhash(texts: list[str], shingle: int) -> np.ndarray:
    """Fingerprints as unsigned 64-bit integers, the first bit the highest."""
    out = np.zeros(len(texts), np.uint64)
    for a, b in blocks([len(t) for t in texts], 1 << 20):
        hashes: list[int] = []
        sizes = np.zeros(b - a, np.int64)
        for k in range(a, b):
            found = shingle_hashes(texts[k], shingle)
            hashes += found
            sizes[k - a] = len(found)
        full = np.flatnonzero(sizes)
        if not len(full):
            continue
        h = np.array(hashes, ">u8")
        firsts = (np.cumsum(sizes) - sizes)[full]
        for p in range(0, len(full), 256):  # unpacked bits take 64 bytes a shingle
            q = min(p + 256, len(full))
            lo, hi = firsts[p], firsts[q - 1] + sizes[full[q - 1]]
            ones = _bit_sums(h[lo:hi], firsts[p:q] - lo)
            major = ones * 2 > sizes[full[p:q], None]
            out[a + full[p:q]] = np.packbits(major, axis=1).view(">u8").ravel()
    return out


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of one text's shingle hashes as a signed integer."""
    if not len(hashes):
        return 0
    ones = _bit_sums(hashes.astype(">u8"), np.zeros(1, np.int64))
    return int(np.packbits(ones * 2 > len(hashes), axis=1).view(">i8")[0, 0])


def _bit_sums(h: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """(rows, 64): in how many hashes of a row each bit is set; long rows are unpacked bit by byte."""
    raw = h.view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.add.reduceat(np.unpackbits(raw[:, [k]], axis=1), firsts, axis=0, dtype=np.int64) for k in range(8)], axis=1)


def fingerprinted(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = 5, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` with each row's fingerprint as a signed long."""
    keep = docs.columns if keep is None else keep
    frame = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(f"{out}_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = simhash(texts_of(batch, f"{out}_text"), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], [*keep, out])

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields[:-1], T.StructField(out, T.LongType())]))


# --- the plan: parts and thresholds ---------------------------------------------------------------------------


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how often each pair of bits is set together, over all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((64, 64))
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            n += len(bits)
            both += bits.T @ bits
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(65), pa.int32()), "v": [[float(n)], *both.tolist()]})

    sums = prints.select("fp").mapInArrow(count, "k int, v array<double>").select("k", F.posexplode("v").alias("i", "x"))
    table = {(r["k"], r["i"]): r["x"] for r in sums.groupBy("k", "i").agg(F.sum("x").alias("x")).collect()}  # 64 * 64 + 1 rows
    return int(table.get((0, 0), 0)), np.array([[table.get((a + 1, b), 0.0) for b in range(64)] for a in range(64)])


def parts_of(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits 0..63 in ``parts`` groups of near equal size; bits that correlate go together, so that what is alike
    in one part says little about the others."""
    mean = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    tie = np.abs(both / max(n, 1) - np.outer(mean, mean)) / np.outer(spread, spread)
    free, out = set(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        at = max(sorted(free), key=lambda b: sum(tie[b, c] for c in free if c != b))
        group = [at]
        free.discard(at)
        while len(group) < size:
            at = max(sorted(free), key=lambda b: sum(tie[b, c] for c in group))
            group.append(at)
            free.discard(at)
        out.append(sorted(group))
    return out


def within(both: np.ndarray, n: int, bits: list[int], most: int) -> np.ndarray:
    """P(two fingerprints differ in at most t of these bits) for t = 0..most, from how even each bit is."""
    share = np.diag(both)[bits] / max(n, 1)
    p = np.zeros(most + 1)
    p[0] = 1
    for q in 2 * share * (1 - share):
        p[1:] = p[1:] * (1 - q) + p[:-1] * q
        p[0] *= 1 - q
    return np.cumsum(p)


def ball(bits: int, t: int) -> int:
    """Keys that differ from one in at most ``t`` bits."""
    return sum(math.comb(bits, k) for k in range(t + 1))


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = total at the least cost; costs[i][t] is part i's at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t in range(-1, min(len(row), total - used)):
                c = cost + (row[t] if t >= 0 else 0.0)
                if used + t + 1 not in new or c < new[used + t + 1][0]:
                    new[used + t + 1] = (c, [*ts, t])
        best = new
    return best[total]


def plan(prints: DataFrame, radius: int = RADIUS, most: int = 2) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is used. Pairs that meet at t = 0 are counted over all fingerprints;
    at t > 0 they grow as the bits' evenness says. A row sent costs as much as some 40 pairs compared."""
    n, both = bit_statistics(prints)
    layouts = {m: parts_of(both, n, m) for m in range(2, radius + 3)}
    keys = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), key_of("fp", bits).alias("key")) for m, ps in layouts.items() for i, bits in enumerate(ps)])
    same = prints.select(F.explode(keys).alias("k")).groupBy("k").count().groupBy("k.m", "k.i").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs"))
    pairs = {(r["m"], r["i"]): r["pairs"] for r in same.collect()}  # a few rows
    found = []
    for m, ps in layouts.items():
        costs = []
        for i, bits in enumerate(ps):
            p = within(both, n, bits, most)
            meet = [max(pairs.get((m, i), 0.0) * p[t] / p[0], n * (n - 1) / 2 * p[t] if t else 0.0) for t in range(most + 1)]
            costs.append([meet[t] + 40.0 * n * (1 + (ball(len(bits), t) - 1) / 2) for t in range(most + 1)])
        if sum(min(most, 10) + 1 for _ in ps) >= radius + 1:
            found.append((*allocate(costs, radius + 1), m))
    _, ts, m = min(found)
    return [(bits, t) for bits, t in zip(layouts[m], ts, strict=True) if t >= 0]


def mask_of(bits: list[int]) -> int:
    """Bit 0 is the highest; as a signed long."""
    value = sum(1 << (63 - b) for b in bits)
    return value - (1 << 64) if value >> 63 else value


def key_of(fp: str, bits: list[int]):
    return F.col(fp).bitwiseAND(F.lit(mask_of(bits)).cast("long"))


# --- probing and verifying ------------------------------------------------------------------------------------


def meetings(prints: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, fp): an index row per part, and probe rows with up to t bits of the part changed. Of two keys
    that differ only the lesser one probes, so a pair meets once."""
    rows = []
    for i, (bits, t) in enumerate(parts):
        masks = [mask_of(list(c)) for k in range(1, t + 1) for c in combinations(bits, k)]
        key = key_of("fp", bits)
        keys = F.array(key)
        if masks:
            changed = F.transform(F.array(*[F.lit(x).cast("long") for x in masks]), lambda x: key_of("fp", bits).bitwiseXOR(x))  # noqa: B023
            keys = F.concat(keys, F.filter(changed, lambda x: x > key_of("fp", bits)))  # noqa: B023
        rows.append(F.transform(keys, lambda x: F.struct(F.lit(i).alias("part"), x.alias("key"))))  # noqa: B023
    return prints.select("fp", F.explode(F.concat(*rows)).alias("at")).select("at.part", "at.key", "fp")


def forest(group: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links inside each run of equal ``group`` numbers."""
    left, right = [], []
    fps = fps.view(np.uint64)  # bits of negative integers would be counted by their absolute value
    firsts = np.flatnonzero(np.diff(group, prepend=group[0] - 1)) if len(group) else np.zeros(0, int)
    sizes = np.diff(np.append(firsts, len(group)))
    small = np.repeat(sizes <= 16, sizes)
    at = np.flatnonzero(small)
    for lag in range(1, 16):  # small groups: every row against the row so many further, over all groups at once
        at = at[at + lag < len(group)]
        at = at[group[at] == group[at + lag]]
        if not len(at):
            break
        hit = at[np.bitwise_count(fps[at] ^ fps[at + lag]) <= radius]
        left.append(fps[hit])
        right.append(fps[hit + lag])
    for f, n in zip(firsts[sizes > 16], sizes[sizes > 16], strict=True):
        rest = np.unique(fps[f : f + n])  # rows not yet reached; each is compared with those that remain
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                x = queue.pop()
                near = np.bitwise_count(rest ^ x) <= radius
                if near.any():
                    got = rest[near]
                    left.append(np.full(len(got), x))
                    right.append(got)
                    queue.extend(got)
                    rest = rest[~near]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]).view(np.int64), np.concatenate([none, *right]).view(np.int64)


def links(prints: DataFrame, parts: list[tuple[list[int], int]], radius: int = RADIUS) -> DataFrame:
    """(a, b): links enough to join what any links join."""
    spark = prints.sparkSession
    met = meetings(prints, parts)
    sizes = met.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    n_blocks = F.ceil(F.col("n") / (GROUP // 2)).cast("int")
    met = attach(met, sizes.withColumn("blocks", n_blocks), "part", "key")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    cells = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(own, j).cast("long") * F.col("blocks") + F.greatest(own, j))
    )
    dealt = met.select("part", "key", F.explode(cells).alias("cell"), "fp")
    dealt = dealt.repartition(partitions(spark), "part", "key", "cell").sortWithinPartitions("part", "key", "cell", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups come one after the other; the last of a batch waits for the next batch."""
        held: tuple[np.ndarray, ...] = tuple(np.zeros(0, np.int64) for _ in range(4))

        def edges(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            new = np.zeros(len(columns[0]), bool)
            for c in columns[:3]:
                new[1:] |= c[1:] != c[:-1]
            a, b = forest(np.cumsum(new), columns[3], radius)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            columns = tuple(np.concatenate([h, batch.column(k).to_numpy().astype(np.int64)]) for k, h in enumerate(held))
            if not len(columns[0]):
                continue
            last = np.ones(len(columns[0]), bool)
            for c in columns[:3]:
                last &= c == c[-1]
            cut = int(np.argmax(last))
            yield edges(tuple(c[:cut] for c in columns))
            held = tuple(c[cut:] for c in columns)
        yield edges(held)

    return dealt.mapInArrow(run, "a long, b long")


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id) of (fp, first): the least ``first`` that links reach, over distinct fingerprints."""
    parts = plan(prints, radius)
    roots = components(links(prints, parts, radius))
    rooted = written(prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    return attach(rooted.drop("first"), least, "root").select("fp", "root", "component_id")


def _classed(docs: DataFrame, doc_id: str, text: str, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, root, component_id) of every row, and (fp, root, component_id) of every fingerprint."""
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    table = written(fingerprinted(plain, shingle=shingle, keep=["doc_id"]), "simhash")
    prints = written(table.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "prints")
    found = written(classes(prints.drop("n"), radius).join(prints.select("fp", "n"), "fp"), "classes")
    return attach(table, found, "fp"), found.drop("n")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row, doc_id of any type that has an order. Texts are read once and
    never shuffled."""
    found, _ = _classed(docs, doc_id, text, shingle, radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, radius: int = RADIUS) -> DataFrame:
    """One row of each class stays, with the columns of ``docs``; see ``keep_least`` for which."""
    rows, prints = _classed(docs, doc_id, text, shingle, radius)
    (fp,) = free([*docs.columns, "fp", "root", "component_id"], "_fp")

    def bare(frame: DataFrame, group: str, first: str) -> DataFrame:
        named = prints.select(F.col("fp").alias(fp), F.col("root").alias(group), F.col("component_id").alias(first))
        return fingerprinted(frame, text, fp, shingle).join(named, fp).drop(fp)

    return keep_least(docs, rows, bare, doc_id, text)


def keep_least(docs: DataFrame, found: DataFrame, bare, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of each class's smallest doc_id, which is the component_id that ``found`` gives it. Rows that repeat a
    doc_id are one document, and the copy with the least text stays; of copies with one text, the first that is read.
    Rows without a doc_id are documents of their own: they go where their class has a row with an id, else the one with
    the least text stays. ``bare`` adds to them two columns of the names given: the class, and its component_id.
    Columns may have any names and types, maps too: only doc_id and the text are compared."""
    kept_name, group, first, number, best = free([*docs.columns, "fp", "root", "component_id", "node"], "_kept", "_class", "_first", "_number", "_best")
    own, columns = F.col(f"`{doc_id}`"), [F.col(f"`{c}`") for c in docs.columns]
    kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(kept_name)).distinct()
    twice = docs.where(own.isNotNull()).groupBy(own.alias(kept_name)).agg(F.count("*").alias(number)).where(F.col(number) > 1).select(kept_name)
    here = own == F.col(kept_name)
    rows = docs.join(kept, here, "left_semi")

    def least(frame: DataFrame, by: str) -> DataFrame:
        """The row with the least text of each group."""
        order = F.struct(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"), F.col(number).alias("n"))
        numbered = frame.withColumn(number, F.monotonically_increasing_id())
        picked = numbered.groupBy(F.col(f"`{by}`")).agg(F.min_by(F.struct(*columns), order).alias(best))
        return picked.select(*[F.col(f"`{best}`.`{c}`").alias(c) for c in docs.columns])

    if not twice.isEmpty():
        again = rows.join(twice, here, "left_semi")
        rows = rows.join(twice, here, "left_anti").unionByName(least(again, doc_id))
    nameless = docs.where(own.isNull())
    if not nameless.select(own).isEmpty():
        rows = rows.unionByName(least(bare(nameless, group, first).where(F.col(first).isNull()), group))
    return rows
