"""Whitening of embeddings by the leading eigenvectors of their covariance, which is never formed.

Block subspace iteration: a pass over the centred rows X gives Xᵀ(XQ) for a block Q of directions.
What is new in it (the residuals of the leading Ritz vectors, made orthonormal by QR against the
blocks before) is the next pass's block, and Rayleigh-Ritz over the held blocks gives the
approximations. The held blocks have a bounded number of columns; beyond it the leading Ritz vectors
take their place. Passes go on until the residuals of all k components certify them, and a pass of
its own recomputes those residuals from the rows. Without the blocks before, the same accuracy would take
hundreds of passes where neighbouring eigenvalues are within a hundredth of each other.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewell.llm.common import small_batches
from tracewell.storage import stored

#: Components of the result, directions of a block besides them, and most directions that are held.
COMPONENTS, MORE, HELD = 4, 8, 48
#: A component is certified by a residual of so small a share of the largest eigenvalue.
CLOSE = 1e-13
#: Residuals that no longer fall, because of rounding, are enough below this share.
ROUNDING = 1e-11
PASSES = 400
#: Components with a smaller share of the trace have no variance but for rounding.
FLAT = 1e-13


def quantized(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id_col, x): floor(256 c) of each entry as long; without vectors that are null or hold null or non-finite entries. Null ids stay."""
    c = F.col(column).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias(id_col), c.alias("_c")).where(F.coalesce(F.forall("_c", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False)))
    return rows.select(id_col, F.transform("_c", lambda e: F.floor(e * 256).cast("long")).alias("x"))


def _grid(column: pa.Array, width: int) -> np.ndarray:
    """Lists of longs as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), width)


def added(rows: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray], size: int, kind: str = "double") -> np.ndarray:
    """The sum of part(matrix), `size` numbers, over all batches of the column x.

    Each task adds up its own batches, and Spark adds the tasks' numbers by place, so that the driver gets
    `size` numbers, however many tasks there are.
    """

    def run(batches):
        total = None
        for rb in batches:
            if rb.num_rows:
                v = part(_grid(rb.column("x"), width))
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["place", "v"])

    sums = rows.select("x").mapInArrow(run, f"place int, v {kind}").groupBy("place").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size, np.int64 if kind == "long" else np.float64)
    for r in sums:
        out[r.place] = r.v
    return out


def _orthonormal(new: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Orthonormal columns for what `new` has beyond the columns held."""
    for _ in range(2):
        new = np.linalg.qr(new - held @ (held.T @ new))[0]
    return new


def leading(times: Callable[[np.ndarray], np.ndarray], width: int, k: int = COMPONENTS, more: int = MORE, held: int = HELD, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, values, residuals) of the k largest eigenvalues of a symmetric matrix V known by times(Q) = VQ, values falling.

    residuals: |V v - e v| as shares of the largest eigenvalue, from a last product of their own. Raises
    ArithmeticError where `passes` products don't certify all of them.
    """
    k, block = min(k, width), min(k + more, width)
    held = max(held, 3 * block)
    z, vz = np.zeros((width, 0)), np.zeros((width, 0))
    q, lows = np.linalg.qr(np.random.default_rng(12).normal(size=(width, block)))[0], []
    used = 0
    while used < passes:
        z, vz, used = np.hstack([z, q]), np.hstack([vz, times(q)]), used + 1
        t = z.T @ vz
        e, u = np.linalg.eigh((t + t.T) / 2)
        e, u = e[::-1], u[:, ::-1]
        y, vy = z @ u, vz @ u
        off = vy - y * e
        scale = max(float(abs(e[0])), np.finfo(float).tiny)
        lows.append(float(np.linalg.norm(off[:, :k], axis=0).max()) / scale)
        settled = lows[-1] <= ROUNDING and len(lows) > 8 and min(lows[-6:]) >= min(lows[:-6])
        if lows[-1] <= CLOSE or settled or z.shape[1] == width:
            y, _ = np.linalg.qr(y[:, :k])
            vy, used = times(y), used + 1
            t = y.T @ vy
            e, u = np.linalg.eigh((t + t.T) / 2)
            e, y, vy = e[::-1], y @ u[:, ::-1], vy @ u[:, ::-1]
            residuals = np.linalg.norm(vy - y * e, axis=0) / scale
            if residuals.max() <= (ROUNDING if settled or z.shape[1] == width else 10 * CLOSE):
                return y, e, residuals
            z, vz, q = y, vy, _orthonormal(np.hstack([vy - y * e, np.random.default_rng(used).normal(size=(width, min(more, width - k)))])[:, : width - k], y)
            continue
        if z.shape[1] + block > held:
            z, vz = y[:, : held - 2 * block], vy[:, : held - 2 * block]
        q = _orthonormal(off[:, : min(block, width - z.shape[1])], z)
    raise ArithmeticError(f"{passes} passes leave residuals of {lows[-1]:.1e}")


class Whitening:
    """n vectors x with sums s; components (columns) with eigenvalues, the trace, and residuals."""

    def __init__(self, n: int, s: np.ndarray, vectors: np.ndarray, values: np.ndarray, trace: float, residuals: np.ndarray):
        self.n, self.s, self.vectors, self.values, self.trace, self.residuals = n, s, vectors, values, trace, residuals

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.s / self.n) @ self.vectors) / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sums of (n x - s)^2, exact; OverflowError where they don't fit a long."""
        rough = (self.n * x.astype(np.float64) - self.s.astype(np.float64)) ** 2
        if rough.sum(1).max(initial=0) >= 2.0**63:
            raise OverflowError("a deviation exceeds 64 bits")
        gap = self.n * x - self.s
        return (gap * gap).sum(1)


def fit(x: DataFrame, k: int = COMPONENTS) -> tuple[Whitening | None, int, DataFrame]:
    """(whitening, width, list) of rows (x): the list has each distinct vector once, shorter vectors filled with zeros to the width.

    None where no component has a variance: no rows, no dimensions, or one distinct vector.
    """
    spark = x.sparkSession
    small_batches(spark)
    width = x.agg(F.max(F.size("x")).alias("w")).first().w or 0
    full = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    each = stored(x.select(full.alias("x")).distinct(), "vectors")
    if not width:
        return None, width, each
    sums = added(each, width, lambda m: np.append(m.sum(0), len(m)), width + 1, "long")
    s, n = sums[:width], int(sums[width])
    mean = s / n
    trace = float(added(each, width, lambda m: np.array([np.square(m - mean).sum()]), 1)[0]) / n

    def times(q: np.ndarray) -> np.ndarray:
        def part(m: np.ndarray) -> np.ndarray:
            centred = m - mean
            return (centred.T @ (centred @ q)).reshape(-1)

        return added(each, width, part, q.size).reshape(q.shape) / n

    if not trace:
        return None, width, each
    vectors, values, residuals = leading(times, width, k)
    real = values > FLAT * trace
    return Whitening(n, s, vectors[:, real], values[real], trace, residuals[real]), width, each


def identity_error(w: Whitening, width: int, each: DataFrame) -> float:
    """Largest absolute entry of the covariance of the whitened list minus the identity."""
    k = len(w.values)

    def part(m: np.ndarray) -> np.ndarray:
        y = w.whitened(m)
        return np.append((y.T @ y).reshape(-1), y.sum(0))

    got = added(each, width, part, k * k + k) / w.n
    mean = got[k * k :]
    return float(np.abs(got[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error, residual): a row for each usable vector and component (from 1).

    Vectors that are null or hold null or non-finite entries are left out; null ids stay null; repeated rows
    come each, but count once in the fit, as equal vectors of different ids do. Shorter vectors are filled
    with zeros. There are as many components as have a variance, `k` at most: none for an empty table or for one
    distinct vector, which gives an empty result. Other columns are ignored. Components with equal
    eigenvalues are some orthonormal basis of their space.
    """
    rows = quantized(vectors, id_col, column)
    w, width, each = fit(rows.select("x"), k)
    schema = f"`{id_col}` long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    if w is None:
        return rows.sparkSession.createDataFrame([], schema)
    error, many = identity_error(w, width, each), len(w.values)
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"]

    def run(batches):
        for rb in batches:
            x = _grid(rb.column("x"), width)
            at = np.repeat(np.arange(len(x)), many)
            tiled = lambda v: pa.array(np.tile(v, len(x)))
            yield pa.RecordBatch.from_arrays([
                rb.column(id_col).take(pa.array(at)), tiled(np.arange(1, many + 1, dtype=np.int32)), pa.array(np.full(len(at), w.n)), pa.array(w.deviations(x)[at]),
                pa.array(w.whitened(x).reshape(-1)), tiled(w.values / w.trace), pa.array(np.full(len(at), error)), tiled(w.residuals)], names=names)

    full = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    return rows.select(id_col, full.alias("x")).mapInArrow(run, schema)
