"""Operator 13: benchmark decontamination by winnowing.

A benchmark item's windows are its runs of ``WINDOW`` words, or the whole item where it is shorter. Of each window the
least hash of its ``GRAM``-word grams is kept: neighbouring windows mostly share it, so a text has few fingerprints, and
two texts that share a window share its fingerprint for certain. Training texts keep those of their fingerprints that
may be the benchmark's (a bitmap of bounded size says so) with the windows that they stand for; training and benchmark
fingerprints are joined together with a digest of the window's words, which extends a hit to the words around it. What
occurs then marks words and items. Texts are read once and never shuffled.

Windows of each length occurring in the benchmark are winnowed alike; below ``GRAM`` words the window is its own gram.

Defined results: null, empty and wordless texts have no words and no hits, and such items no windows. Rows that repeat
an item_id are one item with the windows of all; a null item_id is named as an empty string. Repeated documents each get
their row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ragged import blocks, give_back, texts_of
from .store import attach, written

WINDOW, GRAM = 10, 5
#: Probes of a fingerprint in the bitmap, and bits of the bitmap at the most: 32 MB whatever the benchmark's size.
PROBES, BITS = 3, 1 << 28
#: Every byte as part of a word (A-Z in lower case) or as a gap.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_draw = np.random.default_rng(13)
LETTERS = _draw.integers(0, 1 << 64, 256, np.uint64)
PLACES = _draw.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
ORDER = _draw.integers(0, 1 << 64, WINDOW, np.uint64) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes whose bits all depend on all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of several texts: their bytes, where each begins and ends, its hash, and the texts' counts of words."""

    def __init__(self, texts: list[str]):
        raw = [t.encode().translate(FOLD) for t in texts]
        self.bytes = b" ".join([b"", *raw, b""]) if raw else b" "
        buffer = np.frombuffer(self.bytes, np.uint8)
        inside = buffer != 32
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.ends = edges[::2], edges[1::2]
        bounds = np.cumsum([1, *(len(r) + 1 for r in raw)])
        self.counts = np.diff(np.searchsorted(self.starts, bounds))
        lengths = self.ends - self.starts
        self.hashes = np.zeros(len(lengths), np.uint64)
        if len(lengths):
            letters = LETTERS[buffer[inside]]
            firsts = np.cumsum(lengths) - lengths
            at = np.arange(len(letters)) - np.repeat(firsts, lengths)
            turn = PLACES[at & 63] + (at >> 6).astype(np.uint64) * np.uint64(2)
            self.hashes = mixed(np.add.reduceat(letters * turn, firsts))

    def __len__(self) -> int:
        return len(self.starts)

    def window(self, first: int, length: int) -> bytes:
        """The words from ``first`` on, a space between them."""
        return b" ".join(self.bytes[self.starts[first] : self.ends[first + length - 1]].split())


def fingerprints(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of ``length`` words within one text begin, and the fingerprint of each: its grams' least hash."""
    ends = np.repeat(np.cumsum(words.counts), words.counts)
    starts = np.flatnonzero(np.arange(len(words)) + length <= ends)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    gram = min(GRAM, length)
    n = len(words) - gram + 1
    grams = words.hashes[:n] * ORDER[0]
    for k in range(1, gram):
        grams += words.hashes[k : n + k] * ORDER[k]
    grams = mixed(grams + np.uint64(length))
    least = grams.copy()
    for k in range(1, length - gram + 1):
        np.minimum(least[:-k], grams[k:], out=least[:-k])
    return starts, least[starts]


def digest(window: bytes) -> bytes:
    return xxhash.xxh3_128_digest(window)


def probes(h: np.ndarray, bits: int) -> np.ndarray:
    """(hashes, PROBES) places in a bitmap of ``bits`` bits, a power of two."""
    return np.stack([mixed(h + np.uint64(k)) & np.uint64(bits - 1) for k in range(1, PROBES + 1)], axis=1).astype(np.int64)


# --- the benchmark --------------------------------------------------------------------------------------------


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, length, fp, window) of every window of every item."""
    names = ["item", "length", "fp", "window"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, "text")
            for a, b in blocks([len(t) for t in texts], 1 << 20):
                words = Words(texts[a:b])
                owner = np.repeat(np.arange(a, b), words.counts)
                own = np.minimum(words.counts, WINDOW)
                for length in np.unique(own[own > 0]).tolist():
                    starts, fps = fingerprints(words, length)
                    keep = own[owner[starts] - a] == length
                    starts, fps = starts[keep], fps[keep]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(owner[starts])),
                            pa.array(np.full(len(starts), length, np.int32)),
                            pa.array(fps.view(np.int64)),
                            pa.array([digest(words.window(s, length)) for s in starts.tolist()], pa.binary()),
                        ],
                        names,
                    )

    frame = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return frame.mapInArrow(run, "item string, length int, fp long, window binary")


def bitmap(fps: DataFrame, most: int = BITS) -> np.ndarray:
    """A bitmap with every fingerprint's places set, of some 16 bits each and ``most`` bits at the most; beyond that
    it lets more pass, and the join decides. It is put together by partial sums."""
    bits = 1 << 15
    n = fps.count()
    while bits < min(16 * n, most):
        bits *= 2

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.unique(probes(h, bits)) + 1)})

    found = fps.select("fp").mapInArrow(places, "at long")
    made = found.groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m"))
    whole = np.zeros((bits >> 15, 4096), np.uint8)
    for b, m in made.toLocalIterator():
        whole[b - 1] = np.frombuffer(m, np.uint8)
    return whole.ravel()


def passes(h: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Which of the fingerprints may be in the bitmap."""
    ok = np.arange(len(h))
    for k in range(1, PROBES + 1):
        at = (mixed(h[ok] + np.uint64(k)) & np.uint64(8 * len(whole) - 1)).astype(np.int64)
        ok = ok[(whole[at >> 3] >> (at & 7)) & 1 == 1]
    out = np.zeros(len(h), bool)
    out[ok] = True
    return out


# --- training texts -------------------------------------------------------------------------------------------

TABLE = "doc_id long, n_words long, starts array<int>, lengths array<int>, fps array<long>, windows array<binary>"


def candidates(docs: DataFrame, lengths: list[int], sent) -> DataFrame:
    """Every document with the windows whose fingerprint may be the benchmark's."""
    names = [x.split()[0] for x in TABLE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, "text")
            for a, b in blocks([len(t) for t in texts], 1 << 20):
                words = Words(texts[a:b])
                owner = np.repeat(np.arange(b - a), words.counts)
                first = np.cumsum(words.counts) - words.counts
                at, sizes, fps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for length in lengths:
                    starts, h = fingerprints(words, length)
                    # neighbouring windows share their fingerprint: it is looked up once
                    turns = np.flatnonzero(np.diff(h, prepend=~h[:1]))
                    hit = np.repeat(passes(h[turns], sent.value), np.diff(turns, append=len(h)))
                    at.append(starts[hit]), fps.append(h[hit]), sizes.append(np.full(int(hit.sum()), length))
                at, sizes, fps = np.concatenate(at), np.concatenate(sizes), np.concatenate(fps)
                order = np.argsort(at, kind="stable")
                at, sizes, fps = at[order], sizes[order], fps[order]
                ends = np.append(0, np.cumsum(np.bincount(owner[at], minlength=b - a))).astype(np.int32)
                ragged = lambda x: pa.ListArray.from_arrays(pa.array(ends), x)  # noqa: B023, E731
                windows = [digest(words.window(s, n)) for s, n in zip(at.tolist(), sizes.tolist(), strict=True)]
                columns = [pa.array((at - first[owner[at]]).astype(np.int32)), pa.array(sizes.astype(np.int32)), pa.array(fps.view(np.int64)), pa.array(windows, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(words.counts.astype(np.int64)), *map(ragged, columns)], names)
            give_back()

    return docs.mapInArrow(run, TABLE)


def covered(spans_: Column) -> Column:
    """How many words lie in the spans (start, length), which are sorted."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(acc, s):
        end = F.greatest(acc["end"], s["start"] + s["length"])
        return F.struct((acc["n"] + end - F.greatest(acc["end"], s["start"])).alias("n"), end.alias("end"))

    return F.aggregate(spans_, start, add, lambda acc: acc["n"].cast("long"))


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items) of every document: its hit words as
    spans (start, length), and the items that occur in it."""
    spark = docs.sparkSession
    own = written(item_windows(items, item_id, item_text).distinct(), "windows")
    lengths = sorted(r["length"] for r in own.select("length").distinct().collect())  # WINDOW at the most
    sent = spark.sparkContext.broadcast(bitmap(own.select("fp").distinct()))
    frame = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    table = written(candidates(frame, lengths, sent).select(F.monotonically_increasing_id().alias("row"), "*"), "marked")
    # windows with the same items are one group, known by sums over the items: a document meets a group's items once,
    # however many of its windows it holds, and no window's items are gathered
    keys = ("length", "fp", "window")
    sums = [F.sum(F.xxhash64(F.lit(k), "item").cast("decimal(38,0)")) for k in range(2)]
    grouped = own.groupBy(*keys).agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", F.count("*"), *sums).cast("binary"), 256).alias("group"))
    grouped = written(grouped, "held")
    members = attach(own, grouped, *keys).select("group", "item").distinct()
    found = table.select("row", F.explode(F.arrays_zip("starts", "lengths", "fps", "windows")).alias("w"))
    found = found.select("row", F.col("w.starts").alias("start"), F.col("w.lengths").alias("length"), F.col("w.fps").alias("fp"), F.col("w.windows").alias("window"))
    counts = found.groupBy(*keys).agg(F.count("*").alias("n"))
    met = written(attach(found, grouped.drop("n").join(counts, list(keys)), *keys).select("row", "start", "length", "group"), "hits")
    marked = met.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"))
    pairs = met.select("row", "group").distinct().join(members, "group")
    per = pairs.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = table.select("row", "doc_id", "n_words").join(marked, "row", "left").join(per, "row", "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    spans_ = F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>"))
    out = out.select("doc_id", "n_words", covered(spans_).alias("n_hit"), F.size(items_).cast("long").alias("n_items"), F.sha2(F.array_join(items_, ",").cast("binary"), 256).alias("items_sha256"), spans_.alias("spans"), items_.alias("items"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "spans", "items")
