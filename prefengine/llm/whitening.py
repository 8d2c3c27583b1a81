"""Whitening of integer embeddings by pivoted Cholesky and one-sided Jacobi.

Every vector becomes integers x = floor(scale c) + shift.  The covariance V is that of the distinct
vectors.  Tasks send exact sums first, then the scatter of their vectors centred by them, a row of
the matrix per group, so nothing that grows with the rows reaches one place.  On the driver, whose work
depends on the dimension alone, V is factored with diagonal pivoting, V = L Lᵀ, and one-sided Jacobi
rotates the columns of the triangular factor itself until they are orthogonal: V = (L J)(L J)ᵀ.  The
squared column norms of L J are then the eigenvalues and its normalised columns the eigenvectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefengine.llm.common import fresh, shared_table

#: Rows of a batch that are worked on at once, and sums below which 64-bit integers are exact.
ROWS, EXACT = 4096, 1 << 62


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """A (d x rank) with A Aᵀ = v and, in the order of the pivots, triangular; rows keep their places.

    The largest diagonal entry that is left is the next pivot; one that has lost all but rounding of
    its first value counts as zero, whatever the scale of the other dimensions."""
    d = len(v)
    rest, first = v.astype(np.float64).copy(), np.diag(v).astype(np.float64)
    least = 4 * d * np.finfo(np.float64).eps * first
    columns, left = [], np.ones(d, bool)
    for _ in range(d):
        diagonal = np.where(left & (np.diag(rest) > least), np.diag(rest), 0.0)
        p = int(np.argmax(diagonal))
        if diagonal[p] <= 0:
            break
        column = np.where(left, rest[:, p], 0.0) / np.sqrt(diagonal[p])
        columns.append(column)
        rest -= np.outer(column, column)
        left[p] = False
    return np.array(columns).reshape(len(columns), d).T


def jacobi(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (rows) of a aᵀ: the columns of ``a`` are rotated in
    pairs until all are orthogonal.  Each round takes every column once, in disjoint pairs."""
    a = a.copy()
    r = a.shape[1]
    ring = np.arange(r + r % 2)  # an odd number of columns leaves one out each round
    tolerance = np.finfo(np.float64).eps * max(1, len(a)) ** 0.5
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            i, j = ring[: len(ring) // 2], ring[::-1][: len(ring) // 2]
            i, j = i[(i < r) & (j < r)], j[(i < r) & (j < r)]
            x, y = a[:, i], a[:, j]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            go = np.abs(xy) > tolerance * np.sqrt(xx * yy)
            if go.any():
                turned, i, j, x, y = True, i[go], j[go], x[:, go], y[:, go]
                half = (yy[go] - xx[go]) / (2 * xy[go])
                t = np.where(half >= 0, 1.0, -1.0) / (np.abs(half) + np.hypot(1.0, half))
                c = 1 / np.hypot(1.0, t)
                a[:, i], a[:, j] = c * (x - t * y), c * (t * x + y)
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if not turned:
            break
    norms = np.sqrt((a * a).sum(0))
    order = np.argsort(-norms, kind="stable")
    u = (a[:, order] / norms[order]).T
    sign = np.where(u[np.arange(len(u)), np.abs(u).argmax(1)] < 0, -1.0, 1.0) if len(u) else np.ones(0)
    return norms[order] ** 2, u * sign[:, None]


class Whitening(NamedTuple):
    """What a fit leaves: rows fitted on, exact sums, eigenvalues (falling), components (rows), trace."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - sums, exact: 64-bit integers where they hold it, else Python's."""
        most = self.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, self.sums), default=0)
        return self.n * x - np.array(self.sums, np.int64) if most < EXACT else self.n * x.astype(object) - np.array(self.sums, object)

    def project(self, deviations: np.ndarray) -> np.ndarray:
        """The whitened coordinates of vectors given by ``deviations``."""
        return (deviations.astype(np.float64) / self.n) @ (self.components / np.sqrt(self.eigenvalues)[:, None]).T


def vectors_of(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of a batch with their vectors as a matrix."""
    for lo in range(0, batch.num_rows, ROWS):
        piece = batch.slice(lo, ROWS)
        yield piece, piece.column(column).flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, -1)


def integers(vectors: DataFrame, vector_col: str, out: str, scale: int, shift: int) -> DataFrame:
    """The rows that take part, with x as an array of longs in ``out``."""
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) * scale >= float(EXACT))  # noqa: E731  infinite ones too
    fine = vectors.filter(F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda e: bad(e.cast("double"))))
    return fine.withColumn(out, F.transform(vector_col, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")) + F.lit(shift)))


def scatter(x: DataFrame, column: str, size: int, centred: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of y yᵀ with y = centred(vector), size x size: each task sends its own sum row
    by row, and the rows of one place meet."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for _, matrix in vectors_of(batch, column):
                y = centred(matrix)
                total += y.T @ y
        if total.any():
            yield pa.RecordBatch.from_pydict({"place": pa.array(range(size), pa.int32()), "sums": pa.array(list(total), pa.list_(pa.float64()))})

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        sums = rows.column("sums").combine_chunks().flatten().to_numpy().reshape(-1, size)
        order = np.lexsort(sums.T)  # the same total whatever order the parts come in
        return pa.table({"place": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([sums[order].sum(0)], pa.list_(pa.float64()))})

    schema = "place int, sums array<double>"
    rows = x.select(column).mapInArrow(partial, schema).groupBy("place").applyInArrow(meet, schema).collect()
    out = np.zeros((size, size))
    for r in rows:  # as many as there are dimensions
        out[r["place"]] = r["sums"]
    return (out + out.T) / 2


def fit(x: DataFrame, column: str, components: int) -> Whitening | None:
    """Fit on all rows of ``x``, vectors of longs of one length; None without rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            for piece, matrix in vectors_of(batch, column):
                most = max(abs(int(matrix.max(initial=0))), abs(int(matrix.min(initial=0))))
                own = matrix.sum(0, dtype=np.int64 if most * len(matrix) < EXACT else object)
                n, sums = n + piece.num_rows, own.astype(object) if sums is None else sums + own
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array([-1, *range(len(sums))], pa.int32()), "total": pa.array([str(t) for t in [n, *sums]], pa.string())})

    totals = x.select(column).mapInArrow(add, "dim int, total string").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    total = {r["dim"]: int(r["total"]) for r in totals.collect()}  # a row per dimension
    if not total:
        return None
    n, sums = total[-1], [total[i] for i in range(len(total) - 1)]
    empty = Whitening(n, sums, np.zeros(0), np.zeros((0, len(sums))), 0.0)
    v = scatter(x, column, len(sums), lambda matrix: empty.deviations(matrix).astype(np.float64) / n) / n
    scale = float(np.diag(v).max(initial=0.0))
    if scale <= 0:
        return empty
    values, axes = jacobi(pivoted_cholesky(v / scale))
    return Whitening(n, sums, values[:components] * scale, axes[:components], float(np.trace(v)))


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row that takes
    part and each of the first ``components`` components, numbered from 1 by falling eigenvalue.

    Fitted on each distinct x once: ``n`` of them with sums S; ``deviation`` is the sum over dimensions of
    (n x - S)²; ``whitened`` is x - S/n on the component over the root of its eigenvalue;
    ``explained`` is the eigenvalue over the trace; ``identity_error`` is the largest entry, by amount, of the
    covariance of ``whitened`` over the fitted vectors minus the identity, measured on all of them.

    Defined cases: vectors that are null or hold a null, a non-finite entry or one of 2^62/``scale`` and
    more take no part, nor do those whose length is not the most frequent (the smaller of two); a null id
    stays and repeated rows each come; a deviation beyond a long is null; components without variance
    (constant or dependent dimensions, or too few distinct vectors) don't come, so equal vectors, or
    none, give no rows; equal eigenvalues may share their axes in any turn; other columns are
    ignored."""
    out, spark = fresh(vectors, "x"), vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = integers(vectors, vector_col, out, scale, shift).select(F.col(id_col).cast("long").alias("vec_id"), F.col(out).alias("x"))
    common = x.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not common or not common[0]["dim"]:
        return spark.createDataFrame([], schema)
    x = x.filter(F.size("x") == common[0]["dim"])
    distinct = shared_table(x.select("x").distinct(), "whitening-vectors")
    model = fit(distinct, "x", components)
    k = len(model.eigenvalues)
    if not k:
        return spark.createDataFrame([], schema)
    seen = scatter(distinct, "x", k, lambda matrix: model.project(model.deviations(matrix))) / model.n
    error = float(np.abs(seen - np.eye(k)).max())
    explained = model.eigenvalues / model.trace

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, matrix in vectors_of(batch, "x"):
                rows, d = piece.num_rows, model.deviations(matrix)
                about = (d.astype(np.float64) ** 2).sum(1)
                exact = [int(e) for e in (d * d).sum(1)] if about.max() < EXACT else [sum(int(e) ** 2 for e in row) if a < 4 * EXACT else 4 * EXACT for row, a in zip(d, about)]
                deviation = pa.array([e if e < 2 * EXACT else None for e in exact], pa.int64())
                at = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_pydict({
                    "vec_id": piece.column("vec_id").take(at), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    "n": pa.array(np.full(rows * k, model.n, np.int64)), "deviation": deviation.take(at),
                    "whitened": model.project(d).ravel(), "explained": np.tile(explained, rows), "identity_error": np.full(rows * k, error)})

    return x.mapInArrow(turn, schema)
