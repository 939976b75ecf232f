"""Operator 12: whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Rows are the centred integer vectors X. Every round multiplies X by a right vector and X transposed by the left vector
that comes of it, in one pass over the rows: left vectors have an entry a row, stay with their rows as combinations of
the right ones, and are made anew in each pass, so nothing of the rows' number ever leaves the tasks. Both sides are
orthogonalised in full, the left one through inner products that the pass sums up. The small bidiagonal matrix' singular
values and vectors give the components and their deviations.

Defined results: a null vector and one with null or non-finite entries has no rows, and neither has one whose length is
not the commonest (of two as common, the longer). Repeated rows count as often as they stand there. Components without
variance are left out, so equal vectors, a single one, or none give no rows. A deviation beyond 64 bits is null. Entries
count up to 2^40 on either side, greater ones as that. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
TINY = 1e-12  # of the largest singular value: nothing is left
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that count, x being whole numbers."""
    v = F.col(embedding)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.cast("array<double>").alias("v")).where(v.isNotNull() & F.coalesce(finite, F.lit(False)))
    most = float(1 << 40)
    x = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(most)), F.lit(-most))).cast("long") + SHIFT)
    return rows.select("vec_id", x.alias("x"))


class Centre:
    """What centres a row: S = quotient * n + remainder, and x - S/n is (x - quotient) - remainder/n, a small whole
    number less a fraction."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.d = n, len(sums)
        self.quotient = np.array([s // n for s in sums], np.int64)
        self.remainder = np.array([s % n for s in sums], np.int64)
        self.fraction = np.array([(s % n) / n for s in sums])

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.quotient) - self.fraction

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n*x - S)^2 of each row, exact."""
        small = x - self.quotient
        rough = float(self.n) ** 2 * (np.abs(small).max(1, initial=0).astype(float) + 1) ** 2 * self.d
        fits = rough < 2.0**62
        out: list[int | None] = [None] * len(x)
        for k, v in zip(np.flatnonzero(fits).tolist(), ((self.n * small[fits] - self.remainder) ** 2).sum(1).tolist(), strict=True):
            out[k] = v
        for k in np.flatnonzero(~fits).tolist():
            exact = sum((self.n * a - b) ** 2 for a, b in zip(small[k].tolist(), self.remainder.tolist(), strict=True))
            out[k] = exact if exact < 1 << 63 else None
        return out


class Rows:
    """The rows as a table in the shared folder, and sums over all of them."""

    def __init__(self, table: DataFrame):
        length = table.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        self.d, self.n = (length["d"], length["count"]) if length else (0, 0)
        self.table = table.where(F.size("x") == self.d)
        totals = {r["k"]: int(r["s"]) for r in self._totals().collect()} if self.n else {}  # d rows
        self.centre = Centre(self.n, [totals[k] for k in range(self.d)] if totals else [])

    def _totals(self) -> DataFrame:
        d = self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [0] * d
            for batch in batches:  # entries of 41 bits, batches of 10,000 rows: their sums fit
                total = [a + b for a, b in zip(total, entries(batch.column(0), d).sum(0).tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"k": pa.array(range(d), pa.int32()), "s": pa.array([str(t) for t in total], pa.string())})

        parts = self.table.select("x").mapInArrow(run, "k int, s string")
        return parts.groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))

    def total(self, make, width: int) -> np.ndarray:
        """The sum over all rows of ``make(centred rows)``, ``width`` numbers: one row a task and number is exchanged."""
        centre = self.centre

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(width)
            for batch in batches:
                out += make(centre.rows(entries(batch.column(0), centre.d)))
            yield pa.RecordBatch.from_pydict({"k": pa.array(range(width), pa.int32()), "s": pa.array(out)})

        found = self.table.select("x").mapInArrow(run, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
        out = np.zeros(width)
        for r in found:
            out[r["k"]] = r["s"]
        return out


def entries(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), d)


def fresh(d: int, right: np.ndarray, draw: np.random.Generator) -> np.ndarray | None:
    """A unit vector at right angles to the columns of ``right``; None if they fill the space."""
    for _ in range(3):
        v = draw.standard_normal(d)
        for _ in range(3):
            v -= right @ (right.T @ v)
        size = np.linalg.norm(v)
        if size > 1e-6:
            return v / size
    return None


def bidiagonal(rows: Rows, want: int, steps: int, held: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right vectors) of the ``want`` greatest, at right angles to ``held``; at most ``steps`` rounds.
    It ends when no residual of theirs is above rounding. Where the vectors reached so far are closed under X, a fresh
    direction goes on, so equal values are found too."""
    d, draw = rows.d, np.random.default_rng(42)
    right, left, back = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # v; u as combinations of X's columns; X'u
    diagonal: list[float] = []
    beside: list[float] = []
    v = fresh(d, held, draw)
    while v is not None and len(diagonal) < steps:
        k = len(diagonal)
        ask = v - (beside[-1] * left[:, -1] if k else 0.0)
        known = np.concatenate([ask[:, None], left], axis=1)

        def products(x: np.ndarray, known: np.ndarray = known) -> np.ndarray:
            u = x @ known  # the new left vector and those before it, as far as these rows go
            return np.concatenate([x.T @ u[:, 0], u[:, 1:].T @ u[:, 0], [u[:, 0] @ u[:, 0]]])

        got = rows.total(products, d + k + 1)
        over = got[d : d + k]  # the left side's orthogonalisation
        alpha = float(np.sqrt(max(got[-1] - over @ over, 0.0)))
        right = np.concatenate([right, v[:, None]], axis=1)
        if alpha <= TINY * scale:
            alpha, u, r = 0.0, np.zeros(d), np.zeros(d)
        else:
            u = (ask - left @ over) / alpha
            r = (got[:d] - back @ over) / alpha
        left, back = np.concatenate([left, u[:, None]], axis=1), np.concatenate([back, r[:, None]], axis=1)
        diagonal.append(alpha)
        basis = np.concatenate([held, right], axis=1)
        rest = r
        for _ in range(3):
            rest = rest - basis @ (basis.T @ rest)
        beta = float(np.linalg.norm(rest))
        small = np.diag(diagonal) + (np.diag(beside, 1) if beside else 0.0)
        p, values, q = np.linalg.svd(small)
        if beta <= TINY * scale:
            beta, v = 0.0, fresh(d, basis, draw)
        else:
            v = rest / beta
            if k + 1 >= want and np.all(beta * np.abs(p[-1, :want]) <= 1e-14 * scale):
                break
        beside.append(beta)
    vectors = right @ q.T
    return values[:want], vectors[:, :want]


def components(rows: Rows, want: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, unit vectors as columns, trace) of the rows' covariance, falling."""
    none = np.zeros(0), np.zeros((rows.d, 0)), 0.0
    if not rows.n or not rows.d:
        return none
    whole = float(rows.total(lambda x: np.array([np.square(x).sum()]), 1)[0])
    if whole <= 0:
        return none
    scale, want = float(np.sqrt(whole)), min(want, rows.d)
    nothing = np.zeros((rows.d, 0))
    values, vectors = bidiagonal(rows, want, rows.d, nothing, scale)
    if rows.d > want:  # beside what was found: is a greater one left, as where two values are the same?
        others, beside = bidiagonal(rows, 1, min(12, rows.d - want), vectors, scale)
        if len(others) and others[0] > values[-1] * (1 + 1e-9):
            others, beside = bidiagonal(rows, want, rows.d - want, vectors, scale)
            values, vectors = np.append(values, others), np.concatenate([vectors, beside], axis=1)
            order = np.argsort(-values, kind="stable")[:want]
            values, vectors = values[order], vectors[:, order]
    keep = values > 1e-10 * scale
    return values[keep] ** 2 / rows.n, vectors[:, keep], whole / rows.n


def whitened(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", want: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component; see ``RESULT``."""
    rows = Rows(written(integers(vectors, vec_id, embedding), "vectors"))
    values, axes, trace = components(rows, want)
    m = len(values)
    project = axes / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = x @ project
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    got = rows.total(moments, m + m * m) / max(rows.n, 1) if m else np.zeros(0)
    error = float(np.abs(got[m:].reshape(m, m) - np.outer(got[:m], got[:m]) - np.eye(m)).max()) if m else 0.0
    shares, n, centre = [float(e / trace) for e in values], rows.n, rows.centre
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not m or not batch.num_rows:
                continue
            x = entries(batch.column(1), centre.d)
            k = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(k), m))),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)),
                    pa.array(np.full(k * m, n)),
                    pa.array(centre.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(k), m))),
                    pa.array((centre.rows(x) @ project).ravel()),
                    pa.array(np.tile(shares, k)),
                    pa.array(np.full(k * m, error)),
                ],
                names,
            )

    return rows.table.select("vec_id", "x").mapInArrow(run, RESULT)
