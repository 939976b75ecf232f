"""Operator 1: digests of improbable features.

Every 64-byte window of a text has a Shannon entropy. Entropy levels are ranked by how rare they are over the
whole corpus; a window that is the rarest (the leftmost at a tie) of 64 neighbouring windows at least 16 times is
a feature. A feature sets five bits of a Bloom filter of 2048 bits; after 160 features the next filter begins.
Two digests are alike as far as their filters share more bits than chance would give.

Defined results: null and empty texts have the empty digest; a text under 64 bytes is one feature, padded with
zero bytes; a text in which no window is chosen often enough gives its rarest window. Equal texts have equal
digests. Two empty digests are alike 1, an empty one and another 0. Repeated rows each get their row. Other
columns of the input are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ragged import blocks, texts_of
from .store import partitions

WINDOW, NEIGHBOURS, CHOSEN = 64, 64, 16
BITS, HASHES, PER_FILTER = 2048, 5, 160
SHIFT = 13  # of fixed-point entropies, to levels 0..768
LEVELS = (6 << 20 >> SHIFT) + 1
LOW = LEVELS // 10  # runs of one byte and the like say nothing; they rank last
BLOCK = 1 << 17

_counts = np.arange(WINDOW + 1)
#: Share of the entropy that a byte found so many times in a window adds, in units of 2**-20 bits.
PART = np.zeros(WINDOW + 1, np.int32)
PART[1:] = np.round(_counts[1:] / WINDOW * np.log2(WINDOW / _counts[1:]) * (1 << 20))
FALL = np.zeros(WINDOW + 1, np.int32)
FALL[1:] = PART[:-1] - PART[1:]


def levels(buf: np.ndarray) -> np.ndarray:
    """Entropy level of the window that starts at each byte; ``buf`` has 64 bytes or more. Sliding on by one byte
    changes the counts of two byte values only, and these counts come from 63 shifted comparisons."""
    n = len(buf)
    ahead, behind, same = np.ones(n, np.uint8), np.ones(n, np.uint8), np.empty(n, bool)
    for lag in range(1, WINDOW):
        eq = np.equal(buf[lag:], buf[: n - lag], out=same[: n - lag]).view(np.uint8)
        ahead[: n - lag] += eq
        behind[lag:] += eq
    out = np.empty(n - WINDOW + 1, np.int32)
    out[0] = PART[np.bincount(buf[:WINDOW])].sum()
    if n > WINDOW:
        out[1:] = FALL[ahead[: n - WINDOW]]
        out[1:] -= FALL[behind[WINDOW:]]
        np.cumsum(out, out=out)
    return out >> SHIFT


def _joined(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes in a row, each padded to a window; where each starts; how many windows it has."""
    sizes = np.array([max(len(b), WINDOW) if b else 0 for b in raw], np.int64)
    buf = np.frombuffer(b"".join(b.ljust(WINDOW, b"\0") if b else b for b in raw), np.uint8)
    return buf, np.cumsum(sizes) - sizes, np.maximum(sizes - WINDOW + 1, 0)


def _histogram(raw: list[bytes]) -> np.ndarray:
    out = np.zeros(LEVELS, np.int64)
    for a, b in blocks([len(x) for x in raw], BLOCK):
        buf, starts, windows = _joined(raw[a:b])
        if len(buf):
            inside = np.zeros(len(buf) + 1, np.int32)
            np.add.at(inside, starts[windows > 0], 1)
            np.add.at(inside, (starts + windows)[windows > 0], -1)
            level = levels(buf)
            out += np.bincount(level[np.cumsum(inside)[: len(level)] > 0], minlength=LEVELS)
    return out


def level_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(level, windows): how often each entropy level occurs in all windows of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            total += _histogram([t.encode() for t in texts_of(batch)])
        yield pa.RecordBatch.from_arrays([pa.array(range(LEVELS), pa.int32()), pa.array(total)], ["level", "windows"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(count, "level int, windows long")
    return found.groupBy("level").agg(F.sum("windows").alias("windows"))


def ranks_of(counts: DataFrame) -> np.ndarray:
    """Rank of each level, the rarest first; low levels come last. There are 769 levels whatever the corpus."""
    n = np.zeros(LEVELS, np.int64)
    for level, windows in counts.collect():
        n[level] = windows
    order = sorted(range(LEVELS), key=lambda k: (k < LOW, n[k], k))
    ranks = np.empty(LEVELS, np.int64)
    ranks[order] = np.arange(LEVELS)
    return ranks


def _bits(features: np.ndarray) -> np.ndarray:
    """(m, 64) bytes to (m, 5) bit numbers."""
    words = np.ascontiguousarray(features).view(np.uint64)
    h = np.full(len(words), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(29)
    return np.stack([(h >> np.uint64(11 * k)) & np.uint64(BITS - 1) for k in range(HASHES)], 1).astype(np.int64)


def digests(raw: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """A (filters, 256) array of bytes for each text."""
    out: list[np.ndarray] = []
    for a, b in blocks([len(x) for x in raw], BLOCK):
        out += _digests(raw[a:b], ranks)
    return out


def _digests(raw: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    none = np.zeros((0, BITS // 8), np.uint8)
    buf, starts, windows = _joined(raw)
    if not len(buf):
        return [none] * len(raw)
    n = len(buf) - WINDOW + 1
    key = (ranks[levels(buf)] << 40) | np.arange(n)
    full = np.flatnonzero(windows)
    cross = np.zeros(len(buf) + 1, np.int32)  # windows that reach into the next text
    np.add.at(cross, (starts + windows)[full], 1)
    np.add.at(cross, (starts + windows)[full] + WINDOW - 1, -1)
    key[np.cumsum(cross)[:n] > 0] = np.iinfo(np.int64).max
    low, width = key, 1
    while width < NEIGHBOURS:  # the least of 64 neighbours by doubling
        low = np.minimum(low[: max(0, len(low) - width)], low[width:])
        width *= 2
    wide = np.zeros(len(buf) + 1, np.int32)
    enough = full[windows[full] >= NEIGHBOURS]
    np.add.at(wide, starts[enough], 1)
    np.add.at(wide, (starts + windows)[enough] - NEIGHBOURS + 1, -1)
    picked = low[np.cumsum(wide)[: len(low)] > 0] & ((1 << 40) - 1)
    chosen = np.flatnonzero(np.bincount(picked, minlength=n) >= CHOSEN)
    owner = np.searchsorted(starts[full], chosen, "right") - 1
    bare = np.setdiff1d(np.arange(len(full)), owner)
    if len(bare):
        cuts = np.stack([starts[full][bare], (starts + windows)[full][bare]], 1).ravel()
        rarest = np.minimum.reduceat(np.append(key, np.iinfo(np.int64).max), cuts)[::2] & ((1 << 40) - 1)
        chosen, owner = np.append(chosen, rarest), np.append(owner, bare)
        order = np.argsort(chosen, kind="stable")
        chosen, owner = chosen[order], owner[order]
    counts = np.bincount(owner, minlength=len(full))
    filters = -(-counts // PER_FILTER)
    first = np.cumsum(filters) - filters
    row = first[owner] + (np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]) // PER_FILTER
    bits = np.zeros((int(filters.sum()), BITS), bool)
    view = np.lib.stride_tricks.sliding_window_view(buf, WINDOW)
    bits[row[:, None], _bits(view[chosen])] = True
    packed = np.packbits(bits, axis=1)
    out = [none] * len(raw)
    for k, at in enumerate(full):
        out[at] = packed[first[k] : first[k] + filters[k]]
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Mean over the smaller digest's filters of their best normalised bit overlap with the other's, 0 to 1."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    if x.shape == y.shape and np.array_equal(x, y):
        return 1.0
    if len(x) > len(y):
        x, y = y, x
    nx, ny = np.bitwise_count(x).sum(1, dtype=np.int64), np.bitwise_count(y).sum(1, dtype=np.int64)
    total = 0.0
    for row, n in zip(x, nx, strict=True):
        common = np.bitwise_count(row & y).sum(1, dtype=np.int64)
        most = np.minimum(n, ny)
        chance = n * ny / BITS
        cut = chance + 0.3 * (most - chance)
        total += float(np.max(np.clip((common - cut) / np.maximum(most - cut, 1e-9), 0, 1)))
    return total / len(x)


def to_text(digest: np.ndarray) -> str:
    return base64.b64encode(digest.tobytes()).decode()


def _neighbours(docs: DataFrame) -> DataFrame:
    """(bucket, guest, doc_id, text): the texts in parts by ranges of doc_id, each part with the next part's first
    text as a guest at its end; the first text of all follows the last. Only the parts' bounds reach the driver."""
    spark = docs.sparkSession
    parts = partitions(spark)
    probs = [k / parts for k in range(1, parts)]
    cuts = sorted(set(docs.approxQuantile("doc_id", probs, 0.25 / parts))) if probs else []

    def part_of(lo: int, hi: int):
        """How many cuts lie below an id, lo to hi of them; each comparison halves what is left."""
        mid = (lo + hi) // 2
        return F.lit(lo) if lo == hi else F.when(F.col("doc_id") > int(cuts[mid]), part_of(mid + 1, hi)).otherwise(part_of(lo, mid))

    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(part_of(0, len(cuts)))
    docs = docs.withColumn("bucket", bucket)
    ends = docs.groupBy("bucket").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("bare")).orderBy("bucket").collect()
    if not ends:
        return docs.select("bucket", F.lit(0).alias("guest"), "doc_id", "text")
    before = [0] * (len(cuts) + 1)
    firsts: list[int | None] = [None] * (len(cuts) + 1)
    for k, row in enumerate(ends):
        before[row["bucket"]] = ends[k - 1]["bucket"]
        firsts[row["bucket"]] = None if row["bare"] else row["first"]
    at = lambda xs: F.element_at(F.array(*[F.lit(x).cast("long") for x in xs]), F.col("bucket") + 1)
    home = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest"))
    away = F.struct(at(before).cast("int").alias("bucket"), F.lit(1).alias("guest"))
    places = F.when(F.col("doc_id").eqNullSafe(at(firsts)), F.array(home, away)).otherwise(F.array(home))
    dealt = docs.select(F.explode(places).alias("p"), "doc_id", "text").select("p.bucket", "p.guest", "doc_id", "text")
    return dealt.repartitionByRange(parts, "bucket").sortWithinPartitions("bucket", "guest", "doc_id", "text")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Digest of every text and of its edited text: the last half replaced by the start of the next document by
    doc_id (of rows with one doc_id by text), the first document following the last. Two passes over the texts:
    one counts entropy levels, the other shuffles each text once to stand beside its neighbour."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ranks = ranks_of(level_counts(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # bucket, guest, doc_id, text, digest
        for batch in batches:
            texts = texts_of(batch)
            ids, buckets, guests = (batch.column(c).to_pylist() for c in ("doc_id", "bucket", "guest"))
            for a, b in blocks([len(t) for t in texts], 1 << 22):
                found = digests([t.encode() for t in texts[a:b]], ranks)
                rows = [last] if last else []
                rows += zip(buckets[a:b], guests[a:b], ids[a:b], texts[a:b], found, strict=True)
                pairs = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if not x[1] and x[0] == y[0]]
                last = rows[-1]
                edited = [(x[3][: len(x[3]) - len(x[3]) // 2] + y[3][: len(x[3]) // 2]).encode() for x, y in pairs]
                others = digests(edited, ranks)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[2] for x, _ in pairs], pa.int64()),
                        pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                        pa.array([to_text(x[4]) for x, _ in pairs], pa.string()),
                        pa.array([to_text(d) for d in others], pa.string()),
                        pa.array([likeness(x[4], d) for (x, _), d in zip(pairs, others, strict=True)], pa.float64()),
                        pa.array([likeness(x[4], y[4]) for x, y in pairs], pa.float64()),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return _neighbours(docs).mapInArrow(run, RESULT)
