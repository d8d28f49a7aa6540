"""Word mover's distance between traces: frame vectors from co-occurrence, bounds, and exact transport for what is left.

A frame's vector adds the sign patterns of the frames around it, weighted by positive pointwise mutual
information, so that Spark's aggregations give all vectors and no model is held anywhere. The distance of
two traces is the least cost of moving the frame counts of one, as shares, onto those of the other, where a
move costs the distance of the two vectors. Each share moved to its nearest frame alone is a lower bound, from
either side; only pairs whose larger bound stays within reach of a row's k nearest are solved exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.storage import stored

#: Entries of a frame's vector.
DIMENSIONS = 32
#: Neighbours on each side of a frame that are its context; the frame itself is one, too.
REACH = 2
#: Frames of a block of rows, about: every two blocks are one task's work.
BLOCK_FRAMES = 1024
#: Frames of a row whose distances to a whole block are held at a time.
STRIP = 256
#: Tasks for each core, over which blocks are dealt.
TASKS_PER_CORE = 8
#: What a lower bound may lie above its distance by rounding.
SLACK = 1e-9


def cooccurrence(frames: DataFrame, reach: int = REACH) -> DataFrame:
    """(term, other, n): how often `other` stands at most `reach` frames from `term` in rows (id, frames), each place itself included.

    Null frames are places without a frame; rows with a null or empty array give nothing.
    """
    placed = frames.select(F.posexplode("frames").alias("pos", "term"), "frames")
    around = F.slice("frames", F.greatest(F.lit(1), F.col("pos") + 1 - reach), F.least(F.lit(reach), F.col("pos")) + 1 + reach)
    met = placed.select("term", F.explode(around).alias("other")).where("term is not null and other is not null")
    return met.groupBy("term", "other").agg(F.count("*").alias("n"))


def digest(term: Column) -> Column:
    """What stands for a frame, so that no frame's text is shuffled: the 16 bytes of its MD5."""
    return F.unhex(F.md5(term))


def _signs(frame: str) -> list[Column]:
    """Entries of 1 and -1, from the first bits of the frame's digest."""
    bits = F.conv(F.hex(F.substring(F.col(frame), 1, DIMENSIONS // 8)), 16, 10).cast("long")
    return [F.when(F.shiftright(bits, DIMENSIONS - 1 - d).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0) for d in range(DIMENSIONS)]


def frame_vectors(frames: DataFrame, reach: int = REACH) -> DataFrame:
    """(frame, v): a vector of length 1 for every frame of rows (id, frames), by its digest, or zeros where nothing about its context is unusual."""
    met = stored(cooccurrence(frames.select("id", F.transform("frames", digest).alias("frames")), reach), "cooccurrence")
    totals = stored(met.groupBy("term").agg(F.sum("n").alias("c")), "totals")
    whole = float(totals.agg(F.sum("c")).first()[0] or 0)
    both = met.join(totals, "term").join(totals.select(F.col("term").alias("other"), F.col("c").alias("c_other")), "other")
    unusual = F.greatest(F.lit(0.0), F.log(F.col("n") * F.lit(whole) / (F.col("c").cast("double") * F.col("c_other"))))
    weighted = both.withColumn("w", unusual)
    sums = weighted.groupBy("term").agg(*(F.sum(F.col("w") * s).alias(f"x{d}") for d, s in enumerate(_signs("other"))))
    raw = sums.select("term", F.array(*(F.col(f"x{d}") for d in range(DIMENSIONS))).alias("x"))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x))
    return raw.withColumn("length", length).select(F.col("term").alias("frame"), F.transform("x", lambda x: F.when(F.col("length") > 0, x / F.col("length")).otherwise(0.0)).alias("v"))


def placed_bags(bags: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, frames, counts, v): each row of bags (id, term, n) in one, with hashes, counts and the joined vectors (frame, v) of its frames, by hash.

    Frames without a vector are left out, and rows that have none at all.
    """
    one = F.struct(F.xxhash64("frame").alias("frame"), F.col("n").cast("long").alias("n"), "v")
    rows = bags.select("id", digest(F.col("term")).alias("frame"), "n").join(vectors, "frame").groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("b"))
    return rows.select("id", F.col("b.frame").alias("frames"), F.col("b.n").alias("counts"), F.flatten("b.v").alias("v"))


# ---- one pair


def transport_cost(cost: np.ndarray, supply: np.ndarray, demand: np.ndarray, most: float = math.inf) -> tuple[float, bool]:
    """Least cost of moving whole supplies onto whole demands of the same sum, by shortest augmenting paths, and True.

    The prices kept on the way give a lower bound that only rises; once it is above `most`, it is returned with False.
    """
    given, asked = supply.astype(np.float64), demand.astype(np.float64)
    supply, demand = supply.astype(np.int64).copy(), demand.astype(np.int64).copy()
    n, m = cost.shape
    if n == 1 or m == 1:
        return float((cost * (demand[None, :] if n == 1 else supply[:, None])).sum()), True
    flow = np.zeros((n, m), np.int64)
    # prices under which every move costs nothing or more, and as much as fits along moves that cost nothing
    v = cost.min(0)
    u = (cost - v).min(1)
    for i, j in zip(*np.nonzero(cost - u[:, None] - v <= 1e-12)):
        much = min(supply[i], demand[j])
        flow[i, j], supply[i], demand[j] = much, supply[i] - much, demand[j] - much
    for s in range(n):
        while supply[s]:
            below = float(u @ given + v @ asked)
            if below > most:
                return below, False
            far, back = np.full(m, np.inf), np.full(m, -1)  # distance of a column, and the row before it
            row_far, row_back = np.full(n, np.inf), np.full(n, -1)
            row_far[s] = 0.0
            open_, fresh = np.ones(m, bool), [s]
            while True:
                for i in fresh:
                    by = row_far[i] + cost[i] - u[i] - v
                    nearer = open_ & (by < far)
                    far[nearer], back[nearer] = by[nearer], i
                j = int(np.argmin(np.where(open_, far, np.inf)))
                open_[j] = False
                if demand[j]:
                    break
                fresh = np.flatnonzero((flow[:, j] > 0) & np.isinf(row_far))
                row_far[fresh], row_back[fresh] = far[j], j
            end = far[j]
            reached, done = np.isfinite(row_far), ~open_
            u[reached] += end - row_far[reached]
            v[done] -= end - far[done]
            path = []
            while True:
                path.append((back[j], j))
                if back[j] == s:
                    break
                j = row_back[back[j]]
            last = path[0][1]
            much = min(supply[s], demand[last], *(flow[path[t][0], path[t + 1][1]] for t in range(len(path) - 1)))
            for t, (i, j) in enumerate(path):
                flow[i, j] += much
                if t + 1 < len(path):
                    flow[i, path[t + 1][1]] -= much
            supply[s] -= much
            demand[last] -= much
    return float((flow * cost).sum()), True


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between the rows of two matrices."""
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(squares, 0))


def movers_distance(x: tuple, y: tuple, most: float = math.inf) -> tuple[float, bool]:
    """Distance of two rows (frames, counts, vectors) and True, or a lower bound of it above `most` and False.

    What both share stays where it is, as distances obey the triangle inequality.
    """
    (fx, nx, vx), (fy, ny, vy) = x, y
    supply, demand = nx * ny.sum(), ny * nx.sum()
    whole = int(nx.sum()) * int(ny.sum())
    _, i, j = np.intersect1d(fx, fy, assume_unique=True, return_indices=True)
    same = np.minimum(supply[i], demand[j])
    supply, demand = supply.copy(), demand.copy()
    supply[i] -= same
    demand[j] -= same
    left, right = np.flatnonzero(supply), np.flatnonzero(demand)
    if not len(left):
        return 0.0, True
    d, solved = transport_cost(distances(vx[left], vy[right]), supply[left], demand[right], most * whole)
    return d / whole, solved


# ---- blocks


class Block:
    """Rows of one block: ids, per row (frames, counts, vectors), and all their frames end to end."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values("id")
        self.ids = rows["id"].to_numpy()
        self.limits = rows["reach"].to_numpy(float)
        self.rows = [(np.asarray(f), np.asarray(n), np.asarray(v).reshape(-1, DIMENSIONS)) for f, n, v in zip(rows["frames"], rows["counts"], rows["v"])]
        sizes = [len(f) for f, _, _ in self.rows]
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
        self.vectors = np.concatenate([v for _, _, v in self.rows])
        self.shares = np.concatenate([n / n.sum() for _, n, _ in self.rows])


def lower_bounds(a: Block, b: Block) -> np.ndarray:
    """Of each row of a and each row of b: all shares at their nearest frame of the other row, the larger of both ways."""
    out = np.empty((len(a.rows), len(b.rows)))
    for r, (_, n, v) in enumerate(a.rows):
        share, there, nearest = n / n.sum(), np.zeros(len(b.rows)), np.full(len(b.vectors), np.inf)
        for at in range(0, len(v), STRIP):
            d = distances(v[at : at + STRIP], b.vectors)
            there += share[at : at + STRIP] @ np.minimum.reduceat(d, b.starts, axis=1)
            nearest = np.minimum(nearest, d.min(0))
        out[r] = np.maximum(there, np.add.reduceat(nearest * b.shares, b.starts))
    return out


def block_nearest(a: Block, b: Block, k: int, itself: bool) -> tuple[list[tuple], int]:
    """(query, neighbour, distance) of what may be among the k nearest of a's rows in b and, unless both are one block, of b's in a; and how many pairs were begun."""
    lower, known, out = lower_bounds(a, b), {}, []

    def ask(own: Block, other: Block, bounds: np.ndarray, key) -> None:
        for q in range(len(own.rows)):
            got: list[tuple] = []
            for t in np.argsort(bounds[q], kind="stable"):
                within = min(own.limits[q], got[k - 1][0] if len(got) >= k else math.inf)
                if bounds[q, t] > within + SLACK:
                    break
                if itself and t == q:
                    continue
                pair = key(q, t)
                d, solved = known.get(pair, (-1.0, False))
                if not solved and d <= within + SLACK:
                    d, solved = known[pair] = movers_distance(a.rows[pair[0]], b.rows[pair[1]], within + SLACK)
                if solved:
                    got = sorted([*got, (round(d, 9), int(other.ids[t]))])[:k]
            out.extend((int(own.ids[q]), nn, d) for d, nn in got if d <= own.limits[q] + SLACK)

    ask(a, b, lower, (lambda q, t: (min(q, t), max(q, t))) if itself else (lambda q, t: (q, t)))
    if not itself:
        ask(b, a, lower.T, lambda q, t: (t, q))
    return out, len(known)


def _listed(found: list[tuple], solved: int) -> pd.DataFrame:
    """The found triples, and one row without a query that carries the count of solved pairs."""
    return pd.DataFrame([(*f, 0) for f in found] + [(None, None, None, solved)], columns=["q", "nn", "d", "solved"]).astype({"q": "Int64", "nn": "Int64", "d": "float64", "solved": "int64"})


_FOUND = "q long, nn long, d double, solved long"


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy("d", "nn")
    return found.where("q is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_traces(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(q, rank, nn, d): the k nearest other rows of every row (id, frames, counts, v), by the word mover's distance to nine places, ties to the smaller id; and (q, nn, d, solved), all that tasks found, whose `solved` sums to the pairs that transport was begun for.

    Rows are dealt to blocks of about BLOCK_FRAMES frames. Each block is searched in itself first; the kth distance
    found there limits the search between blocks, where each pair of blocks is one task. Ids are distinct. All rows
    come back if there are fewer than k others; an empty table gives an empty result.
    """
    total = rows.agg(F.sum(F.size("frames"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_FRAMES))
    # distinct ids dealt by a hash
    dealt = stored(rows.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), "dealt")

    def alone(part: pd.DataFrame) -> pd.DataFrame:
        block = Block(part.assign(reach=math.inf))
        return _listed(*block_nearest(block, block, k, True))

    # the work of a block grows with its pairs, not its bytes, so the number of tasks is fixed here
    tasks = lambda keys: min(keys, TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism)
    own = stored(dealt.repartition(tasks(blocks), "p").groupBy("p").applyInPandas(alone, _FOUND), "own")
    limits = own.where("q is not null").groupBy("q").agg(F.when(F.count("*") >= k, F.max("d")).alias("reach"))
    ready = dealt.join(limits.withColumnRenamed("q", "id"), "id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    left = ready.select("*", F.explode(F.expr(f"filter(sequence(0, {blocks - 1}), x -> x > p)")).alias("r"))
    # columns of their own, as both sides come from one table
    right = ready.select(F.col("p").alias("r"), *(F.col(c).alias(c) for c in ready.columns if c != "p")).withColumn("p", F.explode(F.expr(f"filter(sequence(0, {blocks - 1}), x -> x < r)")))

    def between(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return _listed(*block_nearest(Block(x), Block(y), k, False)) if len(x) and len(y) else _listed([], 0)

    side = lambda df: df.repartition(tasks(max(1, blocks * (blocks - 1) // 2)), "p", "r").groupBy("p", "r")
    found = own.union(side(left).cogroup(side(right)).applyInPandas(between, _FOUND))
    found = stored(found, "found")
    return _top(found, k).select("q", F.col("rank").cast("long").alias("rank"), "nn", "d"), found
