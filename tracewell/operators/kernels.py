"""Alignment measures of many pairs at a time, in time that grows with the cells of their tables.

A table of n x m cells is filled diagonal by diagonal: the cells of one diagonal depend on the two
diagonals before alone, so one numpy step fills a whole diagonal of all pairs of a block. Pairs of
about the same size share a block, as shorter ones are padded; padding never reaches a pair's own last cell.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Cells of one diagonal of a block of pairs, about.
CELLS = 1 << 17


class Side:
    """Padded frame numbers of one side of some pairs, their sizes, and further arrays (of doubles) by name."""

    def __init__(self, frames: pa.Array, more: dict[str, pa.Array], filler: int):
        self.size = frames.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.width = int(self.size.max(initial=0))
        self.frames = self._padded(frames, filler, np.int64)
        self.more = {k: self._padded(v, 0, np.float64) for k, v in more.items()}

    def _padded(self, lists: pa.Array, filler: int, kind) -> np.ndarray:
        out = np.full((len(self.size), self.width), filler, kind)
        out[np.arange(self.width)[None, :] < self.size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        return out

    def total(self, values: np.ndarray) -> np.ndarray:
        return np.where(np.arange(self.width)[None, :] < self.size[:, None], values, 0).sum(1)


def last_cells(x: Side, y: Side, first: np.ndarray, left: np.ndarray, cell: Callable) -> np.ndarray:
    """The last cell of each pair's table. first, left: borders (pairs x places from 0) along y and along x.

    cell(rows, columns, equal, corner, up, left, on_x, on_y) gives the cells of a diagonal: rows and columns count
    from 1, and on_x(a) and on_y(a) are the values that arrays a of x and y have there.
    """
    n, m = x.width, y.width
    out = np.where((x.size == 0) | (y.size == 0), np.where(x.size == 0, first[np.arange(len(x.size)), np.minimum(y.size, first.shape[1] - 1)], left[np.arange(len(x.size)), np.minimum(x.size, left.shape[1] - 1)]), 0.0)
    before = np.zeros((len(x.size), n + 1))
    now = before.copy()
    now[:, 0] = first[:, 0]
    for t in range(1, n + m + 1):
        before, now, old = now, np.zeros_like(now), before
        lo, hi = max(1, t - m), min(n, t - 1)
        if lo <= hi:
            on_x = lambda a: a[:, lo - 1 : hi]  # noqa: B023, E731
            on_y = lambda a: a[:, t - hi - 1 : t - lo][:, ::-1]  # noqa: B023, E731
            rows = np.arange(lo, hi + 1)
            now[:, lo : hi + 1] = cell(rows, t - rows, on_x(x.frames) == on_y(y.frames), old[:, lo - 1 : hi], before[:, lo - 1 : hi], before[:, lo : hi + 1], on_x, on_y)
        if t <= m:
            now[:, 0] = first[:, t]
        if t <= n:
            now[:, t] = left[:, t]
        done = np.flatnonzero((x.size + y.size == t) & (x.size > 0) & (y.size > 0))
        out[done] = now[done, x.size[done]]
    return out


def _borders(x: Side, y: Side, step: float) -> tuple[np.ndarray, np.ndarray]:
    pairs = len(x.size)
    return np.broadcast_to(step * np.arange(y.width + 1), (pairs, y.width + 1)), np.broadcast_to(step * np.arange(x.width + 1), (pairs, x.width + 1))


def levenshtein(x: Side, y: Side) -> np.ndarray:
    d = last_cells(x, y, *_borders(x, y, 1.0), lambda i, j, same, corner, up, left, on_x, on_y: np.minimum(corner + ~same, np.minimum(up, left) + 1))
    return 1 - d / np.maximum(x.size, y.size)


def pdm(x: Side, y: Side, c: float = 0.1, o: float = 0.1) -> np.ndarray:
    """Equal sides have 1; others the gain by common frames over that of a whole common beginning with one frame more."""

    def cell(i, j, same, corner, up, left, on_x, on_y):
        return np.maximum(corner + same * (np.exp(-c * (np.minimum(i, j) - 1)) * np.exp(-o * np.abs(i - j))), np.maximum(up, left))

    got = last_cells(x, y, *_borders(x, y, 0.0), cell)
    most = np.cumsum(np.exp(-c * np.arange(max(x.width, y.width) + 1)))[np.minimum(x.size, y.size)]
    wide = min(x.width, y.width)
    equal = (x.size == y.size) & ((x.frames[:, :wide] == y.frames[:, :wide]) | (np.arange(wide)[None, :] >= x.size[:, None])).all(1)
    return np.where(equal, 1.0, got / most)


def needleman_wunsch(x: Side, y: Side, match: float = 1, mismatch: float = 1, gap: float = 1) -> np.ndarray:
    cell = lambda i, j, same, corner, up, left, on_x, on_y: np.maximum(corner + np.where(same, match, -mismatch), np.maximum(up, left) - gap)
    return last_cells(x, y, *_borders(x, y, -gap), cell) / np.maximum(x.size, y.size)


def brodie(x: Side, y: Side) -> np.ndarray:
    """p: shares of frames. Both self-weights place frames by the length of x; NaN where both are 0."""
    px, n = x.more["p"], x.size[:, None]

    def cell(i, j, same, corner, up, left, on_x, on_y):
        return np.maximum(corner + np.where(same, (1 - on_x(px)) * (1 - (i - 1) / n) * np.exp(-np.abs(i - j) / 2), -1.0), np.maximum(up, left))

    own = lambda side: side.total((1 - side.more["p"]) * (1 - np.arange(side.width)[None, :] / n))
    with np.errstate(divide="ignore", invalid="ignore"):
        most = np.maximum(own(x), own(y))
        return np.where(most == 0, np.nan, last_cells(x, y, *_borders(x, y, 0.0), cell) / most)


def tracesim(x: Side, y: Side) -> np.ndarray:
    """w: weights of frames."""
    wx, wy = x.more["w"], y.more["w"]
    before = lambda w: np.concatenate([np.zeros((len(w), 1)), np.cumsum(w, 1)], 1)

    def cell(i, j, same, corner, up, left, on_x, on_y):
        a, b = on_x(wx), on_y(wy)
        return np.where(same, corner, np.minimum(a + b + corner, np.minimum(a + up, b + left)))

    d = last_cells(x, y, before(wy), before(wx), cell)
    d = np.where((x.size == 0) | (y.size == 0), 0, d)
    total = x.total(wx) + y.total(wy)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total == 0, 0.0, 1 - d / total)


def measured(pairs: DataFrame, kernel: Callable[[Side, Side], np.ndarray], arrays: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """(i, j, columns `keep`, value) of pairs (i, j, x, y, ...): frame numbers x and y, and for each further array a columns ax and ay; NaN is null."""
    names = ["i", "j", *keep]

    def run(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            sizes = [rb.column(c).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in "xy"]
            order = np.lexsort(sizes)
            width = (sizes[0] + 1)[order]
            out, at = np.zeros(rb.num_rows), 0
            while at < len(order):  # pairs by rising size, as long as their block's diagonals have few cells
                widest = np.maximum.accumulate(width[at:])
                many = max(1, int(np.searchsorted(widest * np.arange(1, len(widest) + 1), CELLS, side="right")))
                part = order[at : at + many]
                take = lambda c: rb.column(c).take(pa.array(part))  # noqa: B023, E731
                out[part] = kernel(*(Side(take(s), {a: take(a + s) for a in arrays}, -1 - k) for k, s in enumerate("xy")))
                at += many
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in names), pa.array(out, mask=np.isnan(out))], names=[*names, "value"])

    kinds = "".join(f"{c} {pairs.schema[c].dataType.simpleString()}, " for c in names)
    return pairs.select(*names, "x", "y", *(a + s for a in arrays for s in "xy")).mapInArrow(run, f"{kinds}value double")
