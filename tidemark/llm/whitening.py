"""Whitening of embeddings: blockwise TSQR, then one-sided Jacobi rotations of the small triangle.

Entries become integers (``floor(scale * c)``), so that counts and sums are exact. The fit list holds each different
integer vector once. Every task reduces its centred rows, batch by batch, to one upper triangle R with R'R = X'X; the
triangles are written and reduced in groups until one is left, whose size is that of the dimension squared, whatever
the number of rows. Plane rotations make the columns of that triangle orthogonal: their lengths are the singular values
of all centred rows, and the accumulated rotations are the components. Nothing squares the data before the rotations,
so small standard deviations keep their digits.

Defined cases: rows whose vector is null, empty, or holds null, NaN or infinite entries are dropped, as are those not of
the table's usual dimension (that of most rows; of equals, the smallest). Repeated vectors count once in the fit and
each get a row. A component without variance (fewer different vectors than dimensions, all rows equal) has a null
``whitened`` and explains 0.0. ``deviation`` is null where it is beyond a long. No rows: no components and no rows.
Columns of the input that are named like those added give way to them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import bounded_batches, materialize, private

#: Triangles that one task stacks at a time.
FAN_IN = 32


@dataclass
class Whitening:
    """What a fit leaves: a few numbers for each dimension and component."""

    column: str
    scale: float
    n: int = 0
    sums: list[int] = field(default_factory=list)
    variances: np.ndarray = field(default_factory=lambda: np.zeros(0))
    components: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def positive(self) -> np.ndarray:
        """Which components have variance, up to rounding."""
        e = self.variances
        return np.sqrt(e) > (np.sqrt(e[0]) if len(e) else 0.0) * 8 * max(1, len(e)) * np.finfo(float).eps

    @property
    def explained(self) -> np.ndarray:
        return np.where(self.positive, self.variances / max(self.variances.sum(), np.finfo(float).tiny), 0.0)

    def whiten(self, x: np.ndarray, k: int) -> np.ndarray:
        """Rows of integers on the first ``k`` components, each over its standard deviation; NaN without variance."""
        good = self.positive[:k]
        length = np.where(good, np.sqrt(self.variances[:k]), np.nan)
        return (x - self.mean) @ self.components[:, :k] / length


def integers(vectors: DataFrame, column: str, scale: float) -> Column:
    """The integer vector of a row, null where the row takes no part."""
    c = F.col(column)
    fine = (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(c.cast("array<double>"), lambda v: F.floor(v * scale) + 0))


def usual(rows: DataFrame, x: str) -> DataFrame:
    """``rows`` whose vector has the usual dimension."""
    found = rows.where(F.col(x).isNotNull()).groupBy(F.size(x).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.col(x).isNotNull() & (F.size(x) == (found["d"] if found else -1)))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(fit: DataFrame, terms: Callable[[np.ndarray], np.ndarray], of: str = "long", into: str = "decimal(38,0)") -> list:
    """Sums over all rows of ``terms`` (a batch of integer vectors to one array): added up in each task, then by place."""
    kind = pa.int64() if of == "long" else pa.float64()

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                part = terms(matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total, kind)], names=["place", "s"])

    sums = fit.select("x").mapInArrow(add, f"place int, s {of}").groupBy("place").agg(F.sum(F.col("s").cast(into)).alias("s"))
    return [r["s"] for r in sums.orderBy("place").collect()]


def triangle(fit: DataFrame, mean: np.ndarray) -> np.ndarray:
    """R of all centred rows: a triangle a task, stacked ``FAN_IN`` at a time until one is left."""
    d = len(mean)

    def reduce(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            if len(batch):
                r = np.linalg.qr(np.vstack([r, matrix(batch.column(0)) - mean]), mode="r")
        if len(r):
            yield pa.record_batch([pa.array([r.ravel()], pa.list_(pa.float64()))], names=["r"])

    def stack(group) -> np.ndarray:
        rows = [np.asarray(r, dtype=float).reshape(-1, d) for r in group["r"]]
        r = rows[0]
        for other in rows[1:]:
            r = np.linalg.qr(np.vstack([r, other]), mode="r")
        return r

    def merge(group):
        import pandas as pd

        return pd.DataFrame({"r": [stack(group).ravel()]})

    level = materialize(fit.select("x").mapInArrow(reduce, "r array<double>"), "tsqr")
    while (left := level.count()) > FAN_IN:
        groups = -(-left // FAN_IN)
        dealt = level.withColumn("g", F.pmod(F.xxhash64("r"), F.lit(groups)))
        level = materialize(dealt.groupBy("g").applyInPandas(merge, "r array<double>"), "tsqr")
    return stack(level.toPandas()) if left else np.zeros((0, d))


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of ``r``, falling, and its right singular vectors as columns, by one-sided plane rotations.

    A sweep meets every pair of columns once; the pairs of a round are disjoint, so they turn together.
    """
    d = r.shape[1]
    u, v = np.array(r, dtype=float), np.eye(d)
    seats = np.arange(d + d % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(max(1, len(seats) - 1)):
            left, right = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            real = (left < d) & (right < d)
            i, j = left[real], right[real]
            a, b, c = (u[:, i] ** 2).sum(0), (u[:, j] ** 2).sum(0), (u[:, i] * u[:, j]).sum(0)
            turn = np.abs(c) > 1e-15 * np.sqrt(a * b)
            if turn.any():
                turned, i, j = True, i[turn], j[turn]
                with np.errstate(over="ignore"):  # no turn to speak of
                    zeta = (b[turn] - a[turn]) / (2 * c[turn])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                cos = 1 / np.hypot(1.0, t)
                sin = cos * t
                for m in (u, v):
                    p, q = m[:, i], m[:, j]
                    m[:, i], m[:, j] = cos * p - sin * q, sin * p + cos * q
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not turned:
            break
    sigma = np.sqrt((u**2).sum(0))
    order = np.argsort(-sigma, kind="stable")
    return sigma[order], v[:, order]


def fit_whitening(vectors: DataFrame, column: str = "embedding", scale: float = 256.0, components: int = 4) -> Whitening:
    """Fit on each different integer vector once; ``identity_error`` is measured over the first ``components``."""
    bounded_batches(vectors.sparkSession)
    model = Whitening(column, scale)
    rows = usual(vectors.select(integers(vectors, column, scale).alias("x")), "x")
    fit = materialize(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")), "fit-list")
    model.n = fit.count()
    if not model.n:
        return model
    # In halves of 32 bits: no task's sum of longs overflows.
    halves = summed(fit, lambda x: np.concatenate([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)]))
    d = len(halves) // 2
    model.sums = [(int(h) << 32) + int(low) for h, low in zip(halves[:d], halves[d:], strict=True)]
    sigma, model.components = jacobi(triangle(fit, model.mean))
    model.variances = sigma**2 / model.n
    k = int(model.positive[:components].sum())
    if k:
        own = model

        def moments(x: np.ndarray) -> np.ndarray:
            w = own.whiten(x, k)
            return np.concatenate([w.sum(0), (w.T @ w).ravel()])

        found = np.array(summed(fit, moments, "double", "double")) / model.n
        covariance = found[k:].reshape(k, k) - np.outer(found[:k], found[:k])
        model.identity_error = float(np.abs(covariance - np.eye(k)).max())
    return model


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list:
    """Sum over dimensions of (n*x - S)**2, exactly; None where a long can't hold it."""
    reach = n * max(int(x.max()), -int(x.min()), 0) + max(abs(s) for s in sums) if x.size else 0
    if reach * reach * len(sums) < 1 << 63:
        return ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(1).tolist()
    exact = ((x.astype(object) * n - np.array(sums, dtype=object)) ** 2).sum(1)
    return [v if v < 1 << 63 else None for v in exact.tolist()]


def whitened(vectors: DataFrame, model: Whitening, components: int = 4, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (by default all columns) of the rows that take part, with ``deviation`` and ``whitened``, an entry a component."""
    keep = [c for c in (vectors.columns if keep is None else keep) if c.lower() not in ("deviation", "whitened")]
    x = private(keep, "_x")
    rows = vectors.select(*keep, integers(vectors, model.column, model.scale).alias(x))
    rows = rows.where(F.col(x).isNotNull() & (F.size(x) == (len(model.sums) or -1)))
    schema = rows.drop(x).withColumns({"deviation": F.lit(None).cast("long"), "whitened": F.array(F.lit(None).cast("double"))}).schema
    k = min(components, len(model.sums))

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            found = matrix(batch.column(x))
            values = pa.array(model.whiten(found, k).ravel(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * k), values)
            made = [pa.array(deviations(found, model.n, model.sums), pa.int64()), lists]
            yield pa.record_batch([*(batch.column(c) for c in keep), *made], names=[*keep, "deviation", "whitened"])

    return rows.mapInArrow(apply, schema)
