"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Entries become whole numbers on a grid of 1/64, so sums are exact. Spark adds three small things over all rows: the sums
of each dimension, the scatter of the centred vectors (d x d), and the moments of the whitened rows (32 x 32). The scatter is
factored as L L' with diagonal pivoting, which stops at the rank, and the columns of L are rotated in disjoint
pairs until they are orthogonal (Hestenes' one-sided Jacobi on the triangular factor, after Veselic and Hari): the squared
column norms are the eigenvalues and the normalised columns the components, small ones to high relative
accuracy, without the scatter ever being squared again.

Dropped are rows whose vector is null or empty, holds a null or non-finite entry or one whose grid number is no long, and rows
whose length is not the most frequent one (the longer of equally frequent ones). Components of no variance do not exist, so equal
vectors, or a single one, give no rows. Repeated rows and null ids count as they are. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


#: Grid steps per unit, shift that makes grid numbers positive, and the most components returned.
STEPS, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Rows that numpy multiplies at once.
ROWS = 2048
_LIMIT = float(1 << 62)


def _usable(batch: pa.RecordBatch, column: str, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(places of the usable vectors of a batch, their entries as doubles); without ``dim`` only the places and lengths."""
    vectors = batch.column(column)
    length = np.nan_to_num(pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    some = np.flatnonzero(length > 0) if dim is None else np.flatnonzero(length == dim)
    kept = vectors.take(pa.array(some))
    flat = kept.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null reads as NaN
    good = np.isfinite(values) & (np.abs(values) < _LIMIT / STEPS)
    starts = np.concatenate(([0], np.cumsum(length[some])))
    bad = np.concatenate(([0], np.cumsum(~good)))
    fine = bad[starts[1:]] == bad[starts[:-1]]
    if dim is None:
        return some[fine], length[some][fine]
    return some[fine], values.reshape(-1, dim)[fine]


def _grid(values: np.ndarray) -> np.ndarray:
    return np.floor(values * STEPS).astype(np.int64) + SHIFT


def _lengths(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(0, np.int64)
        for batch in batches:
            _, length = _usable(batch, column, None)
            more = np.bincount(length)
            n, more = (np.pad(a, (0, max(len(n), len(more)) - len(a))) for a in (n, more))
            n = n + more
        yield pa.record_batch({"dim": np.flatnonzero(n), "n": n[n > 0].astype(np.int64)})
    return run


def _blocks(batches: Iterator[pa.RecordBatch], column: str, dim: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            _, values = _usable(batch.slice(at, ROWS), column, dim)
            if len(values):
                yield _grid(values)


def _sums(column: str, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, high = 0, np.zeros(dim, object), 0
        for x in _blocks(batches, column, dim):
            top = max(int(x.max()), -int(x.min()))
            n, high = n + len(x), max(high, top)
            total = total + (x.sum(axis=0) if top < 1 << 50 else x.astype(object).sum(axis=0))
        yield pa.record_batch({"i": pa.array(range(dim), pa.int32()), "n": pa.array([n] * dim, pa.int64()), "s": pa.array([str(int(t)) for t in total], pa.string()), "high": pa.array([high] * dim, pa.int64())})
    return run


def centred(x: np.ndarray, n: int, total: np.ndarray, high: int) -> np.ndarray:
    """n * x - S, exactly: longs where they hold it, else unbounded integers."""
    if n * high < 1 << 61:
        return x * n - total.astype(np.int64)
    return x.astype(object) * n - total


def _scatter(column: str, dim: int, n: int, total: np.ndarray, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((dim, dim))
        for x in _blocks(batches, column, dim):
            z = (centred(x, n, total, high) / n).astype(float)
            own += z.T @ z
        i, j = np.tril_indices(dim)
        yield pa.record_batch({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": own[i, j]})
    return run


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L of a = L L' with the largest remaining diagonal first, rows in the order of ``a``; as many columns as the rank."""
    a, d = a.copy(), len(a)
    out, diagonal = np.zeros((d, d)), a.diagonal().copy()
    floor = d * np.finfo(float).eps * max(float(diagonal.max(initial=0)), 0)
    open_ = np.ones(d, bool)
    for k in range(d):
        p = int(np.argmax(np.where(open_, diagonal, -np.inf)))
        if not diagonal[p] > floor:
            return out[:, :k]
        root = np.sqrt(diagonal[p])
        column = np.where(open_, (a[:, p] - out[:, :k] @ out[p, :k]) / root, 0)
        column[p] = root
        out[:, k] = column
        open_[p] = False
        diagonal = diagonal - column * column
    return out


def jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components as columns) of L L', falling: columns of L rotated in disjoint pairs until orthogonal."""
    l, r = factor.copy(), factor.shape[1]
    if r == 0:
        return np.zeros(0), factor
    seats = np.arange(r + r % 2)  # a tournament: each pair meets once a sweep
    small = np.finfo(float).eps * len(l)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            p, q = np.sort([seats[:len(seats) // 2], seats[::-1][:len(seats) // 2]], axis=0)
            p, q = p[q < r], q[q < r]
            x, y = l[:, p], l[:, q]
            a, b, c = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            turn = np.abs(c) > small * np.sqrt(a * b)
            if turn.any():
                turned = True
                x, y, p, q, a, b, c = x[:, turn], y[:, turn], p[turn], q[turn], a[turn], b[turn], c[turn]
                zeta = (b - a) / (2 * c)
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                cos = 1 / np.hypot(1, t)
                l[:, p], l[:, q] = cos * (x - t * y), cos * (t * x + y)
            seats = np.concatenate((seats[:1], seats[-1:], seats[1:-1]))
        if not turned:
            break
    norm = np.sqrt((l * l).sum(axis=0))
    order = np.argsort(-norm, kind="stable")
    parts = l[:, order] / norm[order]
    lead = parts[np.abs(parts).argmax(axis=0), np.arange(r)]
    return norm[order] ** 2, parts * np.where(lead < 0, -1, 1)


def _whiten(column: str, dim: int, n: int, total: np.ndarray, high: int, weights: np.ndarray):
    """Deviation and whitened values of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                place, values = _usable(batch, column, dim)
                y = centred(_grid(values), n, total, high)
                far = max((abs(int(v)) for v in (y.max(initial=0), y.min(initial=0))), default=0)
                square = (y * y).sum(axis=1) if far * far * dim < 1 << 62 else (y.astype(object) ** 2).sum(axis=1)
                w = ((y / n).astype(float) @ weights).ravel()
                ends = pa.array(np.arange(len(y) + 1, dtype=np.int32) * weights.shape[1])
                yield pa.record_batch({"vec_id": batch.column("vec_id").take(pa.array(place)).cast(pa.int64()), "deviation": pa.array([str(int(v)) for v in square], pa.string()), "w": pa.ListArray.from_arrays(ends, pa.array(w))})
    return run


def _moments(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, product = np.zeros(width), np.zeros((width, width))
        for batch in batches:
            w = batch.column("w").flatten().to_numpy().reshape(-1, width)
            total += w.sum(axis=0)
            product += w.T @ w
        i, j = np.indices((width, width)).reshape(2, -1)
        yield pa.record_batch({"i": pa.array(np.append(i, np.arange(width)), pa.int32()), "j": pa.array(np.append(j, np.full(width, -1)), pa.int32()), "v": np.append(product.ravel(), total)})
    return run


def fitted(embeddings: DataFrame, column: str = "embedding") -> Row | None:
    """Row(n, dim, total, high, values, components, trace) over all usable vectors; None without one."""
    vectors = embeddings.select(column)
    lengths = vectors.mapInArrow(_lengths(column), "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n"))
    top = lengths.orderBy(F.desc("n"), F.desc("dim")).first()
    if top is None:
        return None
    dim = top["dim"]
    made = vectors.mapInArrow(_sums(column, dim), "i int, n long, s string, high long")
    sums = made.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.max("high").alias("high")).orderBy("i").collect()
    n, high, total = sums[0]["n"], sums[0]["high"], np.array([int(r["s"]) for r in sums], object)
    cells = vectors.mapInArrow(_scatter(column, dim, n, total, high), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    a = np.zeros((dim, dim))
    a[cells.column("i").to_numpy(), cells.column("j").to_numpy()] = cells.column("v").to_numpy() / n
    a = a + np.tril(a, -1).T
    values, components = jacobi(pivoted_cholesky(a))
    return Row(n=n, dim=dim, total=total, high=high, values=values, components=components, trace=float(a.trace()))


def whitened(embeddings: DataFrame, column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation decimal, whitened, explained, identity_error): a row for each vector and component.

    ``deviation`` is the sum of (n x - S)^2 over the dimensions, exact.
    """
    spark, schema = embeddings.sparkSession, "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    fit = fitted(embeddings, column)
    if fit is None or not len(fit.values):
        return spark.createDataFrame([], schema)
    values = fit.values[:most]
    weights, width = fit.components[:, :most] / np.sqrt(values), len(values)
    rows = embeddings.select("vec_id", column).mapInArrow(_whiten(column, fit.dim, fit.n, fit.total, fit.high, weights), "vec_id long, deviation string, w array<double>")
    cells = rows.select("w").mapInArrow(_moments(width), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (cells.column(c).to_numpy() for c in "ijv")
    second, mean = np.zeros((width, width)), np.zeros(width)
    second[i[j >= 0], j[j >= 0]] = v[j >= 0] / fit.n
    mean[i[j < 0]] = v[j < 0] / fit.n  # zero but for rounding
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(width)).max())
    share = F.array(*[F.lit(float(e / fit.trace)) for e in values])
    out = rows.select("vec_id", F.lit(fit.n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), F.posexplode("w").alias("k", "whitened"))
    return out.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "whitened", share[F.col("k")].alias("explained"), F.lit(error).alias("identity_error"))
