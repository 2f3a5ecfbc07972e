"""Whitening of embeddings by matrix-free block subspace iteration.

Each entry c becomes the whole number floor(scale * c) + shift.  Vectors that are null or hold a null or non-finite
entry go; all others are fitted and answered.  No covariance is ever formed of more columns than the block has: a pass of Spark
reads the vectors, centres them, and adds up Xᵀ(XQ) for an orthonormal block Q; the driver holds matrices of
dimensions times block only.  From one pass come the Rayleigh-Ritz values and vectors of Q and their residuals, and the
product, orthonormalised by QR, is the next block.

A component is certified when its residual is at most ``TOLERANCE`` of the largest eigenvalue.  The error of the block
falls by the ratio of the first eigenvalue outside it to the k-th.  Where the rate measured says that more than
``PATIENCE`` passes remain, the block doubles, which lowers that ratio; a block as wide as the space is exact at once.  At
``MAX_BLOCK`` columns, for spaces that are much wider, a Chebyshev filter of the interval below the block's last Ritz value takes
the place of the plain product: its growth per pass is that of the square root of the gap.

Partial sums are added up in two levels (the square root of the number of partitions in each), so what reaches the
driver grows with that root times the block, not with rows.  Each pass reads the table anew: nothing is kept that a lost
executor could take along.

Defined cases: vectors of another length than the most frequent one (the longer of two as frequent) take no part.  Rows
that repeat an id, or have none, are vectors of their own.  Directions without variance (below ``RANK`` of the largest
eigenvalue) have no whitened value, so fewer than k components come back; with one vector or equal ones, none.
``deviation`` is null where it exceeds 64 bits; whole numbers stop at ±2**40.  Further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_workers
from .topk import matrix

SCALE, SHIFT = 1024, 100_000
TOLERANCE, RANK = 1e-13, 1e-10
FIRST_BLOCK, MAX_BLOCK = 16, 512
PATIENCE = 4
#: Passes of one Chebyshev filter, and passes in all before the iteration gives up.
DEGREE, MOST_PASSES = 12, 400
#: Where whole numbers stop, so that sums of them are exact in 64 bits.
MOST = 2.0**40

SUMS = "sums array<double>"


def whole_vectors(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x): the whole numbers of each vector without nulls, NaN and infinities."""
    c = F.col("embedding").cast("array<double>")
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("c")).where("c IS NOT NULL AND size(c) > 0").where(~bad)
    within = lambda v: F.greatest(F.least(v * F.lit(float(scale)), F.lit(MOST)), F.lit(-MOST))
    return rows.select("vec_id", F.transform("c", lambda v: F.floor(within(v)) + F.lit(shift)).alias("x"))


def add_up(partials: DataFrame) -> np.ndarray | None:
    """The sum of the rows ``sums``, of a length that all have: first in about sqrt(n) groups, then here."""
    groups = max(1, math.isqrt(partials.rdd.getNumPartitions()))
    found = [r[0] for r in partials.repartition(groups).mapInArrow(on_workers(__name__, "add_rows"), SUMS).collect()]
    return np.sum([np.asarray(x) for x in found], axis=0) if found else None


def sums_batch(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["sums"])


def add_rows(batches):
    total = None
    for rows in batches:
        for row in rows.column(0):
            own = row.values.to_numpy()
            total = own.copy() if total is None else total + own
    if total is not None:
        yield sums_batch(total)


def multiply(batches, centre: np.ndarray, block: np.ndarray):
    """One partition's share of Xᵀ(XQ) over centred rows, and of their squared lengths."""
    product, trace = np.zeros(block.shape), 0.0
    seen = False
    for rows in batches:
        x = matrix(rows.column(1)) - centre
        product += x.T @ (x @ block)
        trace += float(np.einsum("ij,ij->", x, x))
        seen = seen or len(x) > 0
    if seen:
        yield sums_batch(np.append(product.ravel(), trace))


def covariance_sums(batches, centre: np.ndarray, axes: np.ndarray, middle: np.ndarray):
    """One partition's share of the sums and products of whitened rows, less ``middle``."""
    k = axes.shape[1]
    sums, products, seen = np.zeros(k), np.zeros((k, k)), False
    for rows in batches:
        w = (matrix(rows.column(1)) - centre) @ axes - middle
        sums += w.sum(0)
        products += w.T @ w
        seen = seen or len(w) > 0
    if seen:
        yield sums_batch(np.concatenate([sums, products.ravel()]))


class Passes:
    """Products of the covariance with blocks, each a pass over the vectors; counts them."""

    def __init__(self, rows: DataFrame, n: int, centre: np.ndarray):
        self.rows, self.n, self.centre, self.count, self.trace = rows, n, centre, 0, 0.0

    def __call__(self, block: np.ndarray) -> np.ndarray:
        self.count += 1
        sums = add_up(self.rows.mapInArrow(on_workers(__name__, "multiply", self.centre, block), SUMS)) / self.n
        self.trace = float(sums[-1])
        return sums[:-1].reshape(block.shape)


def subspace_iteration(times, d: int, k: int, first: int = FIRST_BLOCK, most: int = MAX_BLOCK, tolerance: float = TOLERANCE, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a d x d operator, unit vectors, and their residuals relative to the largest.

    times: the product of the operator with a block; tolerance: the residuals that certify a component.
    """
    r = np.random.default_rng(seed)
    k = min(k, d)
    width = min(d, max(first, k))
    block = np.linalg.qr(r.standard_normal((d, width)))[0]
    last = None
    for _ in range(MOST_PASSES):
        product = times(block)
        ritz = block.T @ product
        values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, images = block @ turn, product @ turn
        largest = max(values[0], np.finfo(float).tiny)
        residuals = np.linalg.norm(images[:, :k] - vectors[:, :k] * values[:k], axis=0) / largest
        worst = float(residuals.max())
        # rounding of the sums leaves what no further pass removes
        if worst <= tolerance or (width == d and last is not None):
            break
        rate = worst / last if last else None
        last = worst
        if rate is not None and (rate >= 1 or math.log(tolerance / worst) / math.log(rate) > PATIENCE):
            if width < min(d, most):
                width = min(d, most, 2 * width)
                images = np.hstack([images, largest * r.standard_normal((d, width - images.shape[1]))])
                last = None if width < d else last
            elif width < d:
                images = chebyshev(times, vectors, images, float(values[-1]))
        block = np.linalg.qr(images)[0]
    else:
        raise RuntimeError(f"subspace iteration: residuals of {worst:.1e} after {MOST_PASSES} passes")
    return values[:k], vectors[:, :k], residuals


def chebyshev(times, block: np.ndarray, image: np.ndarray, edge: float) -> np.ndarray:
    """The Chebyshev polynomial of degree DEGREE that is small on eigenvalues from 0 to ``edge``, applied to the block."""
    half = max(edge, np.finfo(float).tiny) / 2
    before, now = block, (image - half * block) / half
    for _ in range(DEGREE - 1):
        size = np.linalg.norm(now, axis=0)  # each column on its own, so that the recurrence can't overflow
        before, now = before / size, now / size
        before, now = now, 2 * (times(now) - half * now) / half - before
    return now


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """The sum over dimensions of (n * x - sums)², exact; null beyond 64 bits."""
    middle = sums // n  # taken off both, so that the products stay small
    away = n * (x - middle) - (sums - n * middle)
    size = np.einsum("ij,ij->i", away.astype(float), away.astype(float))
    exact = np.einsum("ij,ij->i", away, away)  # wraps around where size says so
    fits = size < 9.2e18
    for i in np.flatnonzero(~fits & (size < 9.25e18)).tolist():
        whole = sum(int(v) ** 2 for v in away[i])
        fits[i] = whole < 1 << 63
        exact[i] = whole if fits[i] else 0
    return pa.array(exact, pa.int64(), mask=~fits)


WHITENED = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def whiten_batches(batches, n: int, sums: np.ndarray, axes: np.ndarray, explained: np.ndarray, identity_error: float, rows: int = 4096):
    k, centre = axes.shape[1], sums / n
    for whole in batches:
        for start in range(0, whole.num_rows, rows):
            part = whole.slice(start, rows)
            x = matrix(part.column(1))
            m = len(x)
            every = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([part.column(0).take(every), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()), deviations(x, n, sums).take(every), pa.array(((x - centre) @ axes).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, identity_error))], schema=WHITENED)


def whole_sums(batches):
    """One partition's number of rows and sums by dimension, exact."""
    total = None
    for rows in batches:
        x = matrix(rows.column(1))
        if len(x):
            own = np.append(x.sum(0), len(x))
            total = own if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], ["sums"])


def fit(rows: DataFrame, d: int, k: int, first: int = FIRST_BLOCK, most: int = MAX_BLOCK) -> dict:
    """What whitening needs, from whole vectors (vec_id, x) of d components, one at least.

    n, sums, values, axes (a column per component: unit vector over the root of its eigenvalue), explained, passes,
    residuals, identity_error.
    """
    partials = rows.mapInArrow(on_workers(__name__, "whole_sums"), "sums array<long>").select(F.posexplode("sums").alias("at", "sum"))
    *sums, n = (r[0] for r in partials.groupBy("at").agg(F.sum("sum").alias("sum")).orderBy("at").select("sum").collect())
    sums = np.array(sums, np.int64)
    times = Passes(rows, n, sums / n)
    values, vectors, residuals = subspace_iteration(times, d, k, first, most, max(TOLERANCE, np.finfo(float).eps * math.sqrt(n)))
    on = values > RANK * max(values[0], 0) if values[0] > 0 else np.zeros(len(values), bool)
    values, vectors = values[on], vectors[:, on]
    axes = vectors / np.sqrt(values)
    error = 0.0
    if len(values):
        def moments(middle: np.ndarray) -> np.ndarray:
            return add_up(rows.mapInArrow(on_workers(__name__, "covariance_sums", sums / n, axes, middle), SUMS)) / n

        m = len(values)
        middle = moments(np.zeros(m))[:m]
        error = float(np.abs(moments(middle)[m:].reshape(m, m) - np.eye(m)).max())
    return {"n": n, "sums": sums, "values": values, "axes": axes, "explained": values / times.trace if times.trace else values, "passes": times.count, "residuals": residuals, "identity_error": error}


def whiten(vectors: DataFrame, k: int = 8, scale: int = SCALE, shift: int = SHIFT, first: int = FIRST_BLOCK, most: int = MAX_BLOCK) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each vector and component up to k."""
    rows = whole_vectors(vectors, scale, shift)
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], out)
    rows = rows.where(F.size("x") == lengths["d"])
    model = fit(rows, lengths["d"], k, first, most)
    if not len(model["values"]):
        return vectors.sparkSession.createDataFrame([], out)
    return rows.mapInArrow(on_workers(__name__, "whiten_batches", model["n"], model["sums"], model["axes"], model["explained"], model["identity_error"]), out)
