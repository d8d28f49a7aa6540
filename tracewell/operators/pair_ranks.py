"""Rank correlations of the similarity of all pairs of vectors with what their sign codes say.

A pair is a cell (similarity to nine places, equal signs, equal segments). Tasks count cells, and send them packed
and compressed to the ranges of similarities that they belong to; a range is worked out in one task, a
bounded number of values at a time, and returns a row of sums. Ranges are ordered, so sums over them give the
correlations of all pairs, and no pair is a row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewell.operators import dense

#: Similarities of a range (a power of two, 24 at most, as gaps have three bytes), pairs that are sorted at once, and values of a range that are worked out at once.
RANGE, CHUNK, VALUES = 17, 1 << 23, 1 << 12
#: Signs of a code, and bits of the places of a cell: equal signs and, below them, equal segments.
BITS, SIGNS, SEGMENTS = 64, 7, 7
CELL = SIGNS + SEGMENTS
#: Pairs of a range that are kept one by one; beyond, they are counted in a table of all values. And pairs of a run, each two of which are compared.
HELD, RUN = 1 << 23, 64


def _summed(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order, and their counts."""
    cells = np.sort(cells)
    at = _starts(cells)
    return cells[at], np.diff(np.append(at, len(cells)))


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])))


def packed(cells: np.ndarray) -> pa.Table:
    """(part, data): cells (key, signs, segments in one number) by ranges of keys, sorted, keys as gaps, bytes in planes."""
    cells, n = _summed(cells)
    part = cells >> (RANGE + CELL)
    starts = _starts(part)
    low = (cells >> CELL) & ((1 << RANGE) - 1)
    gap = np.diff(low, prepend=0)
    gap[starts] = low[starts]
    planes = [(gap >> at & 255).astype(np.uint8) for at in (0, 8, 16)] + [(cells >> SEGMENTS & (1 << SIGNS) - 1).astype(np.uint8), (cells & (1 << SEGMENTS) - 1).astype(np.uint8)]
    codec, data = pa.Codec("zstd", compression_level=1), []
    for x, y in zip(starts, np.append(starts[1:], len(cells))):
        counts = n[x:y]
        raw = b"".join([np.int64(y - x).tobytes(), *(p[x:y].tobytes() for p in planes), counts.tobytes() if counts.max() > 1 else b""])
        data.append(np.int64(len(raw)).tobytes() + codec.compress(raw, asbytes=True))
    return pa.table({"part": pa.array(part[starts], pa.int32()), "data": pa.array(data, pa.binary())})


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    """Cells without the range of their keys, and their counts (none if each is 1)."""
    raw = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    p = np.frombuffer(raw, np.uint8, 5 * n, 8).reshape(5, n)
    gap = p[0].astype(np.int32)
    for plane, at in ((p[1], 8), (p[2], 16)):
        if plane.any():
            gap |= plane.astype(np.int32) << at
    cells = np.cumsum(gap, dtype=np.int64) << CELL
    cells |= p[3].astype(np.int16) << SEGMENTS | p[4]
    return cells, np.frombuffer(raw, np.int64, n, 8 + 5 * n) if len(raw) > 8 + 5 * n else None


def _similarities(part: int, low: np.ndarray) -> np.ndarray:
    key = low + (part << RANGE)
    return np.where(key == dense.NAN, np.nan, key / dense.PLACES)


def _none(part: int, segments: int) -> dict:
    """Sums of a range, still empty: `many` and `placed` for each number of equal segments and, behind them, of equal signs; `lower`, `both` and `gap` of either kind."""
    width = segments + 1 + BITS + 1
    return {"part": part, "many": np.zeros(width), "placed": np.zeros(width), "lower": [0.0, 0.0], "both": [0.0, 0.0], "gap": [0.0, 0.0], "tied": 0.0, "cubes": 0.0}


def _pairs_of(n: np.ndarray) -> float:
    n = n.astype(float)
    return float((n * (n - 1) / 2).sum())


def _lower(code: np.ndarray, top: int) -> float:
    """Pairs of places of which the earlier one has the larger code: those of different runs from counts of each run, those of one run by comparing."""
    runs = -(-len(code) // RUN)
    # padding stands behind all and is largest, so it is in no such pair
    padded = np.full(runs * RUN, top + 1, np.uint8)
    padded[: len(code)] = code
    rows = padded.reshape(runs, RUN)
    inside = sum(int(np.count_nonzero(rows[:, :-d] > rows[:, d:])) for d in range(1, RUN))
    across, seen = 0.0, np.zeros(top + 1)
    for at in range(0, runs, VALUES):
        some = rows[at : at + VALUES]
        table = np.bincount((np.arange(len(some))[:, None] * (top + 2) + some).ravel(), minlength=len(some) * (top + 2)).reshape(-1, top + 2)[:, : top + 1]
        across += _across(table, seen)
        seen += table.sum(0)
    return inside + across


def _across(table: np.ndarray, seen: np.ndarray) -> float:
    """Pairs of an earlier row, or of what was seen before, with a later row and a smaller place in it."""
    earlier = np.cumsum(table, 0) - table + seen
    return float((table[:, :-1] * np.cumsum(earlier[:, :0:-1], 1)[:, ::-1]).sum())


def _sums_of_pairs(part: int, cells: np.ndarray, segments: int) -> dict:
    """The sums of a range of which every pair is a cell."""
    out = _none(part, segments)
    cells = np.sort(cells)
    value = cells >> CELL
    at = _starts(value)
    t = np.diff(np.append(at, len(cells)))
    out["tied"], out["cubes"] = _pairs_of(t), float((t.astype(float) ** 3 - t).sum())
    middle, sim = np.repeat(2.0 * at + t, t), np.repeat(_similarities(part, value[at]), t)
    signs, equal = cells >> SEGMENTS & (1 << SIGNS) - 1, cells & (1 << SEGMENTS) - 1
    # of one value the larger code comes later, so no pair of one value counts as discordant
    by_segments = np.sort(value << CELL | equal << SIGNS | signs)
    for kind, (code, top, start) in enumerate(((by_segments >> SIGNS & (1 << SEGMENTS) - 1, segments, 0), (signs, BITS, segments + 1))):
        own = slice(start, start + top + 1)
        out["lower"][kind] = _lower(code, top)
        both = value << CELL | code
        out["both"][kind] = _pairs_of(np.diff(np.append(_starts(both), len(both))))
        out["gap"][kind] = float(((sim - code / top) ** 2).sum())
        out["many"][own], out["placed"][own] = np.bincount(code, minlength=top + 1), np.bincount(code, middle, top + 1)
    return out


def _sums_of_table(part: int, table: np.ndarray, segments: int) -> dict:
    """The sums of a range from its table of counts by value, and by equal segments and equal signs."""
    out, below = _none(part, segments), 0.0
    for at in range(0, len(table), VALUES):
        some = table[at : at + VALUES].astype(float)
        some, low = some[some.any(1)], at + np.flatnonzero(some.any(1))
        t = some[:, : segments + 1].sum(1)
        out["tied"] += _pairs_of(t)
        out["cubes"] += float((t**3 - t).sum())
        middle = 2 * (below + np.cumsum(t) - t) + t
        below += float(t.sum())
        for kind, (top, start) in enumerate(((segments, 0), (BITS, segments + 1))):
            own = slice(start, start + top + 1)
            out["lower"][kind] += _across(some[:, own], out["many"][own])
            out["both"][kind] += _pairs_of(some[:, own])
            out["gap"][kind] += float((some[:, own] * (_similarities(part, low)[:, None] - np.arange(top + 1) / top) ** 2).sum())
            out["many"][own] += some[:, own].sum(0)
            out["placed"][own] += middle @ some[:, own]
    return out


class _Range:
    """Cells of one range: one by one while they are few, then a table of fixed size."""

    def __init__(self, part: int, segments: int):
        self.part, self.segments, self.held, self.many, self.table = part, segments, [], 0, None

    def add(self, cells: np.ndarray, n: np.ndarray | None) -> None:
        many = len(cells) if n is None else int(n.sum())
        if self.table is None and self.many + many > HELD:
            self.table = np.zeros((1 << RANGE, self.segments + 1 + BITS + 1), np.int64)
            for old in self.held:
                self._count(old, 1)
            self.held = []
        self.many += many
        if self.table is None:
            self.held.append(cells if n is None else np.repeat(cells, n))
        else:
            self._count(cells, 1 if n is None else n)

    def _count(self, cells: np.ndarray, n) -> None:
        np.add.at(self.table, (cells >> CELL, cells & (1 << SEGMENTS) - 1), n)
        np.add.at(self.table, (cells >> CELL, self.segments + 1 + (cells >> SEGMENTS & (1 << SIGNS) - 1)), n)

    def sums(self) -> dict:
        return _sums_of_pairs(self.part, np.concatenate(self.held), self.segments) if self.table is None else _sums_of_table(self.part, self.table, self.segments)


def _ranges(found: DataFrame, segments: int) -> DataFrame:
    """The sums of each range of (part, data)."""
    many = pa.list_(pa.float64())
    schema = pa.schema([("part", pa.int32()), ("many", many), ("placed", many), ("lower", many), ("both", many), ("gap", many), ("tied", pa.float64()), ("cubes", pa.float64())])

    def row(of: _Range) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in of.sums().items()}], schema=schema)

    def run(batches):
        own = None
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if own is None or own.part != part:
                    if own is not None:
                        yield row(own)
                    own = _Range(part, segments)
                own.add(*unpacked(data.as_py()))
        if own is not None:
            yield row(own)

    tasks = max(1, 4 * found.sparkSession.sparkContext.defaultParallelism)
    ddl = "part int, many array<double>, placed array<double>, lower array<double>, both array<double>, gap array<double>, tied double, cubes double"
    return found.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(run, ddl)


def agreement(rows: DataFrame, size: int, names: tuple[str, str]) -> list[tuple]:
    """(method, n, rho, tau, error) of all pairs i < j of rows (id, v) whose similarity is not null, against the share of equal segments of `size` signs
    and against the share of equal signs: rank correlations (null if one side is constant) and the root of the mean squared difference. Nothing without pairs."""
    segments = BITS // size
    low = np.uint64(sum(1 << at for at in range(0, BITS, size)))

    def work(a: dense.Block, b: dense.Block, alone: bool):
        signs_a, signs_b = a.codes(BITS)[:, 0], b.codes(BITS)[:, 0]
        held, many = [], 0
        for x, y in dense._tiles(a, b):
            key = dense.keys(a, b, x, y)
            differ = signs_a[x, None] ^ signs_b[y]
            some = differ.copy()
            for at in range(1, size):
                some |= differ >> np.uint64(at)
            cell = key << CELL
            cell |= (BITS - np.bitwise_count(differ)).astype(np.int64) << SEGMENTS
            cell |= segments - np.bitwise_count(some & low)
            ok = key != dense.NULL
            if alone:
                ok &= a.ids[x, None] < b.ids[y]
            held.append(cell.ravel() if ok.all() else cell[ok])
            many += len(held[-1])
            if many >= CHUNK:
                yield packed(np.concatenate(held))
                held, many = [], 0
        if many:
            yield packed(np.concatenate(held))

    got = sorted(_ranges(dense.in_blocks(rows, work, "part int, data binary", once=True), segments).collect(), key=lambda r: r.part)
    whole = int(sum(sum(r.many[: segments + 1]) for r in got))
    out = []
    for kind, (name, own) in enumerate(zip(names, (slice(0, segments + 1), slice(segments + 1, None)))) if whole else ():
        many = np.sum([r.many[own] for r in got], 0)
        # twice the ranks, less their mean
        y = 2 * (np.cumsum(many) - many) + many - whole
        below, product, lower, seen = 0.0, 0.0, 0.0, np.zeros(len(many))
        for r in got:
            m = np.array(r.many[own])
            product += float((y * (np.array(r.placed[own]) + (2 * below - whole) * m)).sum())
            lower += r.lower[kind] + float((m[:-1] * np.cumsum(seen[:0:-1])[::-1]).sum())
            seen += m
            below += float(m.sum())
        xx = (float(whole) ** 3 - whole - sum(r.cubes for r in got)) / 3
        yy = float((y * y * many).sum())
        pairs = whole * (whole - 1) / 2
        tx, ty, txy = sum(r.tied for r in got), float((many * (many - 1) / 2).sum()), sum(r.both[kind] for r in got)
        side = math.sqrt(max(0.0, pairs - tx)) * math.sqrt(max(0.0, pairs - ty))
        rho = product / math.sqrt(xx * yy) if xx > 0 and yy > 0 else None
        out.append((name, whole, rho, (pairs - tx - ty + txy - 2 * lower) / side if side else None, math.sqrt(sum(r.gap[kind] for r in got) / whole)))
    return out
