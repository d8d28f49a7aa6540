"""Distributions and rank correlations of measures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.storage import stored


def histogram(values: DataFrame, column: str, bins: int = 30, above: float | None = None) -> DataFrame:
    """(bin, low, high, n): equal bins between the extremes, the last one closed; values above a threshold only, if given."""
    v = values.select(F.col(column).cast("double").alias("v")).where("v is not null")
    if above is not None:
        v = v.where(F.col("v") > above)
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if ends.lo is None:
        return values.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    lo, hi = (ends.lo, ends.hi) if ends.lo < ends.hi else (ends.lo - 0.5, ends.hi + 0.5)
    width = (hi - lo) / bins
    place = F.least(F.floor((F.col("v") - lo) / width).cast("int"), F.lit(bins - 1))
    counts = v.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    every = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", (F.lit(lo) + F.col("bin") * width).alias("low"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def spearman(values: DataFrame, a: str, b: str) -> DataFrame:
    """(rho): the correlation of average ranks. Ranks come from counts of distinct values, not from one sort of all rows in a task."""

    def ranked(df: DataFrame, c: str) -> DataFrame:
        return df.join(average_ranks(df, c), c)

    both = ranked(ranked(values.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()), a), b)
    return both.agg(F.corr(f"rank_{a}", f"rank_{b}").alias("rho"))


def average_ranks(values: DataFrame, column: str) -> DataFrame:
    """(column, rank_column) of each distinct value: the mean of the places that it takes in the sorted order.

    Values are range-partitioned; one window runs inside the partitions and one over their sums.
    """
    counts = values.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    spread = stored(counts.repartitionByRange("v").select("v", "n", F.spark_partition_id().alias("part")), "ranks")
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = spread.groupBy("part").agg(F.sum("n").alias("many"))
    earlier = sums.select("part", F.coalesce(F.sum("many").over(ahead(Window.orderBy("part"))), F.lit(0)).alias("earlier"))
    inside = F.coalesce(F.sum("n").over(ahead(Window.partitionBy("part").orderBy("v"))), F.lit(0))
    return spread.join(F.broadcast(earlier), "part").select(F.col("v").alias(column), (F.col("earlier") + inside + (F.col("n") + 1) / 2).alias(f"rank_{column}"))


def tau_b(x: np.ndarray, y: np.ndarray) -> float | None:
    """Kendall's tau-b; null if one side is constant."""
    n = len(x)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    tied = lambda c: int((c * (c - 1) // 2).sum())
    tx = tied(np.unique(x, return_counts=True)[1])
    ty = tied(np.unique(y, return_counts=True)[1])
    runs = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if n else np.zeros(0, int)
    txy = tied(np.diff(np.append(runs, n)))
    pairs = n * (n - 1) // 2
    if pairs in (tx, ty):
        return None
    return (pairs - tx - ty + txy - 2 * _weighted_inversions(y, np.ones(n, np.int64))) / (float(pairs - tx) ** 0.5 * float(pairs - ty) ** 0.5)


def _pairs_within(x: Column) -> Column:
    """Number of pairs among x rows."""
    return F.shiftright(x * (x - 1), 1)


def _weighted_inversions(v: np.ndarray, n: np.ndarray) -> int:
    """Sum of n_i * n_j over i < j with v_i > v_j, by merging runs of doubled length."""
    order = np.argsort(v, kind="stable")
    rank = np.empty(len(v), np.int64)
    rank[order] = np.cumsum(np.append(False, v[order][1:] != v[order][:-1])) if len(v) else order
    total, size = 0, 1
    most = int(rank.max(initial=0)) + 1
    while size < len(rank):
        # within each run of 2 * size places: what stands in its left half and is larger, for each place of its right half
        run = np.arange(len(rank)) // (2 * size)
        right = np.arange(len(rank)) // size % 2 == 1
        key = run * most + rank
        at = np.argsort(key[~right], kind="stable")
        keys, sums = key[~right][at], np.concatenate(([0], np.cumsum(n[~right][at])))
        ends = np.searchsorted(keys, (run[right] + 1) * most)
        total += int(((sums[ends] - sums[np.searchsorted(keys, key[right], side="right")]) * n[right]).sum())
        size *= 2
    return total


def kendall(rows: DataFrame) -> DataFrame:
    """(k, n, tau): Kendall's tau-b of x and y for each group k of rows (k int, x, y double); tau is null if one side is constant.

    Equal rows are counted before anything is sent. What is left is range-partitioned by (k, x, y) and again by
    (k, y), so that neither a large group nor a frequent value makes a large task. Discordant pairs
    are those in one part of the first partitioning (counted there), those in different parts of both (counted from
    a table with one number for each two parts), and those in different parts of the first but one of the second
    (counted there, where each value of y has one row for each part of the first).
    """
    cells = stored(rows.groupBy("k", "x", "y").agg(F.count("*").alias("n")).repartitionByRange("k", "x", "y").withColumn("p", F.spark_partition_id()), "cells")
    by_y = stored(cells.groupBy("k", "p", "y").agg(F.sum("n").alias("n")).repartitionByRange("k", "y").withColumn("b", F.spark_partition_id()), "by_y")
    schema = pa.schema([("k", pa.int32()), ("d", pa.int64())])

    def counted(sort: list[tuple[str, str]]):
        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by(sort)
            d = _weighted_inversions(t.column("y").to_numpy(), t.column("n").to_numpy())
            return pa.table([t.column("k").slice(0, 1).cast(pa.int32()), pa.array([d])], schema=schema)

        return run

    def across(t: pa.Table) -> pa.Table:
        """Pairs of parts: an earlier part of (x, y) with a later part of y, times a later one with an earlier one."""
        p, b = (np.unique(t.column(c).to_numpy(), return_inverse=True)[1] for c in ("p", "b"))
        table = np.zeros((p.max() + 1, b.max() + 1), np.int64)
        np.add.at(table, (p, b), t.column("n").to_numpy())
        later = np.cumsum(table[::-1], 0)[::-1][1:]  # rows of later parts
        below = np.cumsum(later, 1)[:, :-1]  # of those, in earlier parts of y
        return pa.table([t.column("k").slice(0, 1).cast(pa.int32()), pa.array([int((table[:-1, 1:] * below).sum())])], schema=schema)

    inside = cells.select("k", "x", "y", "n", "p").groupBy("k", "p").applyInArrow(counted([("x", "ascending"), ("y", "ascending")]), "k int, d long")
    same_y = by_y.select("k", "p", "y", "n", "b").groupBy("k", "b").applyInArrow(counted([("p", "ascending"), ("y", "ascending")]), "k int, d long")
    parts = by_y.groupBy("k", "p", "b").agg(F.sum("n").alias("n")).groupBy("k").applyInArrow(across, "k int, d long")
    discordant = inside.union(same_y).union(parts).groupBy("k").agg(F.sum("d").alias("d"))
    tied = lambda df, *by: df.groupBy("k", *by).agg(F.sum("n").alias("n")).groupBy("k").agg(F.sum(_pairs_within(F.col("n"))).alias("t"))
    tx, ty = (tied(df, c).withColumnRenamed("t", f"t{c}") for df, c in ((cells, "x"), (by_y, "y")))
    whole = cells.groupBy("k").agg(F.sum("n").alias("n"), F.sum(_pairs_within(F.col("n"))).alias("txy"))
    both = whole.join(tx, "k").join(ty, "k").join(discordant, "k").withColumn("all", _pairs_within(F.col("n")))
    top = (F.col("all") - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.col("d")).cast("double")
    side = lambda c: F.sqrt((F.col("all") - F.col(c)).cast("double"))
    return both.select("k", "n", F.try_divide(top, side("tx") * side("ty")).alias("tau"))


def kendall_matrix(measures: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, tau): tau-b of each two measures over the rows where neither is null and not both are 0."""
    chosen = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    columns = F.array(*(F.struct(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in chosen))
    rows = measures.select(F.posexplode(columns).alias("k", "m")).select("k", "m.x", "m.y").where("x is not null and y is not null and (x <> 0 or y <> 0)")
    named = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in chosen))
    return kendall(rows).select(F.get(named, F.col("k")).alias("m"), "tau").select("m.a", "m.b", "tau")


def output_shape(hashes: DataFrame) -> DataFrame:
    """(mean_abs, exact): mean absolute component of hash vectors (id, h), and the share of components at 1 or -1."""
    x = hashes.select(F.explode("h").alias("x"))
    return x.agg(F.avg(F.abs(F.col("x").cast("double"))).alias("mean_abs"), F.avg(F.when(F.abs("x") == 1, 1.0).otherwise(0.0)).alias("exact"))
