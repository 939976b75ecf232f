"""Operator 9: a factorisation machine for text quality.

Features are hashed words (their share of the text, square-rooted), structure statistics and the text's length as
metadata. The score is b + sum of w_i x_i + sum over pairs of <v_i, v_j> x_i x_j; the pair sum costs as much as
one pass, as half of the square of sums less the sum of squares in each factor. Word weights are learned by
Adagrad on a sample of at most ``SAMPLE`` labelled rows, those with the least hash of doc_id, so it is the same
rows on any cluster.

Defined results: null and empty texts are scored like any text, from their statistics. Repeated rows each get
their row; of several labels for a doc_id the least counts. With no labels of either kind every score is 0.5.
Labels, lang, source and doc_id are no inputs. Other columns are ignored by ``scores``, kept by ``keep_good``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ragged import Memo, blocks, give_back, row_sums, texts_of
from .store import small_batches

BUCKETS, RANK, SAMPLE = 1 << 15, 8, 8_000
CUT = 0.3  # of the contract: predicted is 1 from this score on
SPACE = re.compile(r"[ \t-\r]+")
STATS = 11


def _stats(text: str, words: list[str]) -> list[float]:
    n, chars = max(len(words), 1), max(len(text), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    ends = sum(text.count(c) for c in ".,;:")
    return [
        np.log1p(len(words)),
        np.log1p(len(lines)),
        len(text) / n,
        sum(text.count(c) for c in "#*$%&|<>") / n,
        text.count("!") / n,
        ends / n,
        sum(map(str.isupper, words)) / n,
        sum(map(text.count, "0123456789")) / chars,
        1 - len(set(lines)) / max(len(lines), 1),
        len(set(words)) / n,
        text.count('"') / n + text.count("@") / n,
    ]


def features(texts: list[str], memo: Memo) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: bucket numbers, values, rows' lengths; and the dense statistics."""
    parts, stats = [], np.zeros((len(texts), STATS), np.float32)
    for k, text in enumerate(texts):
        words = [w for w in SPACE.split(text) if w]
        stats[k] = _stats(text, words)
        parts.append(words)
    sizes = np.array([len(p) for p in parts], np.int64)
    flat = memo.numbers([w for p in parts for w in p])
    bucket = memo.flat[memo.starts[flat]].astype(np.int64) if len(flat) else np.zeros(0, np.int64)
    key, counts = np.unique(np.repeat(np.arange(len(texts)), sizes) * BUCKETS + bucket, return_counts=True)
    row = key // BUCKETS
    values = np.sqrt(counts / sizes[row]) if len(key) else np.zeros(0)
    return key % BUCKETS, values.astype(np.float32), np.bincount(row, minlength=len(texts)), stats


def words_to_buckets() -> Memo:
    return Memo(lambda words: [(xxhash.xxh64_intdigest(w.lower()) % BUCKETS,) for w in words], np.int32)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # buckets, then statistics
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def dense(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4).astype(np.float32)

    def margins(self, index: np.ndarray, values: np.ndarray, sizes: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score before the logistic function; each row's sums of factors, which the gradient needs."""
        v = self.factors[index] * values[:, None]
        own = self.factors[BUCKETS:]
        total = row_sums(v, sizes) + dense @ own
        squares = row_sums(v * v, sizes) + (dense * dense) @ (own * own)
        first = row_sums(self.linear[index] * values, sizes) + dense @ self.linear[BUCKETS:]
        return self.bias + first + 0.5 * (total * total - squares).sum(1), total


def fit(index: np.ndarray, values: np.ndarray, sizes: np.ndarray, stats: np.ndarray, labels: np.ndarray, epochs: int = 12, rate: float = 0.08, decay: float = 2e-5) -> Machine:
    """Adagrad over small batches of the sample's ``features``, on the logistic loss."""
    dtype, rows_ = np.float32, len(sizes)
    scale = stats.std(0) if rows_ else np.ones(STATS)
    m = Machine(0.0, np.zeros(BUCKETS + STATS, dtype), np.random.default_rng(7).normal(0, 0.02, (BUCKETS + STATS, RANK)).astype(dtype), stats.mean(0) if rows_ else np.zeros(STATS), np.where(scale > 1e-6, scale, 1.0))
    if len(set(labels.tolist())) < 2:
        m.factors[:] = 0
        return m
    m.bias = float(np.log(labels.mean() / (1 - labels.mean())))
    dense, ends = m.dense(stats), np.cumsum(sizes)
    seen_w, seen_v = np.full(len(m.linear), 1e-2, dtype), np.full(m.factors.shape, 1e-2, dtype)
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        order = rng.permutation(rows_)
        for at in range(0, len(order), 128):
            rows = order[at : at + 128]
            n = sizes[rows]
            take = np.repeat(ends[rows] - n - (np.cumsum(n) - n), n) + np.arange(n.sum())
            i, x, d = index[take], values[take], dense[rows]
            margin, total = m.margins(i, x, n, d)
            error = (1 / (1 + np.exp(-margin)) - labels[rows]).astype(dtype) / len(rows)
            per = np.repeat(error, n)
            u, where = np.unique(i, return_inverse=True)
            gw = np.bincount(where, per * x, len(u)).astype(dtype)
            each = per[:, None] * (x[:, None] * np.repeat(total, n, 0) - (x * x)[:, None] * m.factors[i])
            gv = np.stack([np.bincount(where, each[:, k], len(u)) for k in range(RANK)], 1).astype(dtype)
            own = m.factors[BUCKETS:]
            u = np.append(u, np.arange(BUCKETS, BUCKETS + STATS))
            gw = np.append(gw, d.T @ error)
            gv = np.vstack([gv, d.T @ (error[:, None] * total) - ((d * d).T @ error)[:, None] * own])
            gw, gv = gw + decay * m.linear[u], gv + decay * m.factors[u]
            seen_w[u] += gw * gw
            seen_v[u] += gv * gv
            m.linear[u] -= rate * gw / np.sqrt(seen_w[u])
            m.factors[u] -= 0.5 * rate * gv / np.sqrt(seen_v[u])
            m.bias -= rate * float(error.sum())
    return m


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = words_to_buckets()
    for batch in batches:
        texts = texts_of(batch, "text")
        for a, b in blocks([len(t) for t in texts], 1 << 20):
            index, values, sizes, stats = features(texts[a:b], memo)
            ends = np.cumsum(sizes).tolist()
            cut = lambda x: pa.array([x[e - n : e].tobytes() for e, n in zip(ends, sizes.tolist(), strict=True)], pa.binary())  # noqa: B023, E731
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), cut(index.astype("<i4")), cut(values.astype("<f4")), pa.array([r.tobytes() for r in stats.astype("<f4")], pa.binary())], ["id", "y", "index", "value", "stats"])
            memo.trim()


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` labelled rows that aren't held out. Their features are made by tasks; the driver gets
    the sparse rows, some kilobytes each, and no texts. The join moves ids of the sample, not texts: they are few
    enough to be sent to every reader of texts."""
    small_batches(docs.sparkSession)
    marked = labels.where(~held_out(doc_id) & F.col(doc_id).isNotNull() & F.col(label).isNotNull()).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
    known = docs.select(F.col(doc_id).alias("id")).where(F.col("id").isNotNull()).distinct()
    marked = marked.groupBy("id").agg(F.min("y").alias("y")).join(known, "id", "left_semi")
    chosen = marked.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    found = rows.mapInArrow(_sample_features, f"id {rows.schema['id'].dataType.simpleString()}, y int, index binary, value binary, stats binary").toArrow().sort_by("id")
    whole = lambda c, kind: np.frombuffer(b"".join(found[c].to_pylist()), kind)
    sizes = np.array([len(x) // 4 for x in found["index"].to_pylist()], np.int64)
    return fit(whole("index", "<i4"), whole("value", "<f4"), sizes, whole("stats", "<f4").reshape(-1, STATS), (found["y"].to_numpy() > 0).astype(float))


def _scored(docs: DataFrame, machine: Machine, out: str) -> DataFrame:
    """``docs`` with the score in a further column; its own column "text" is what is scored."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # 1.2 MB whatever the corpus
    names = [*docs.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, m = words_to_buckets(), sent.value
        for batch in batches:
            texts = texts_of(batch)
            got = np.zeros(len(texts))
            for a, b in blocks([len(t) for t in texts], 1 << 20):
                index, values, sizes, stats = features(texts[a:b], memo)
                got[a:b] = 1 / (1 + np.exp(-np.clip(m.margins(index, values, sizes, m.dense(stats))[0], -30, 30)))
                memo.trim()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], names)
            give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", machine: Machine | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every text."""
    machine = machine or train(docs, labels, doc_id, text)
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = _scored(plain, machine, "score").drop("text")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches the cut, with the columns of ``docs``."""
    machine = train(docs, labels, doc_id, text)
    name = "score"
    while name in docs.columns:
        name += "_"
    frame = docs if text == "text" else docs.withColumnRenamed(text, "text")
    kept = _scored(frame, machine, name).where(F.col(name) >= CUT).drop(name)
    return kept if text == "text" else kept.withColumnRenamed("text", text)
