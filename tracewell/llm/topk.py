"""Exact top-k inner products of integer vectors by pivot-table elimination.

A table holds the distances of every vector to many pivots. They fix a vector's place in the pivots'
span (its coordinates) and its height over it, whatever else the vector is. So the largest lower bound
of d(q, x) that both rows of the table allow together is the distance of these places, heights on one
side, which is never below the largest difference |d(q, p) - d(x, p)| over the pivots p. Since
q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2 it gives an upper bound of the score. A query's candidates are
evaluated in the order of their bounds until the k-th best score is above the next bound.

Few pivots tell nothing of vectors that point everywhere: on such vectors of 64 dimensions, 24 pivots
leave 97 % of the candidates to be evaluated. So there are PIVOT_SHARE times as many pivots as dimensions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tracewell.llm.vectors import in_blocks, matrix, one_row_an_id, top, usable

#: Pivots for each dimension, and the most vectors that they are chosen from.
PIVOT_SHARE, SAMPLE_ROWS = 7 / 8, 2000
#: A pivot that is no farther than this from the span of those before, as a share of the first one's distance, is left out.
FLAT = 0.02
#: Candidates evaluated between two looks at the bounds, at first.
STEP = 32
LONG = 2**63 - 1
#: What rounding may take from a bound, as a share of the squared lengths.
SLACK = 1e-5


def choose_pivots(sample: np.ndarray) -> np.ndarray:
    """Vectors far from each other: each next pivot is the one farthest from the span of those before."""
    if not len(sample):
        return sample
    chosen, rest = [0], sample - sample[0]
    widest = float(np.linalg.norm(rest, axis=1).max())
    while len(chosen) <= PIVOT_SHARE * sample.shape[1]:
        high = np.linalg.norm(rest, axis=1)
        at = int(high.argmax())
        if not high[at] > FLAT * widest:
            break
        chosen.append(at)
        along = rest[at] / high[at]
        rest = rest - np.outer(rest @ along, along)
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T))


def places(table: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Coordinates in the span of the pivots (the first one is the origin), and heights over it, from distances alone."""
    edges = pivots[1:] - pivots[0]
    if not len(edges):
        return table[:, :1]
    square = table * table
    inner = (square[:, :1] + (edges * edges).sum(1) - square[:, 1:]) / 2
    at = np.linalg.solve(np.linalg.cholesky(edges @ edges.T), inner.T).T
    return np.hstack([at, np.sqrt(np.maximum(0, square[:, :1] - (at * at).sum(1, keepdims=True)))])


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of q with the rows of x; beyond the range of a long they stop at its ends."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, len(q)) < 2**52:
        return (x @ q).astype(np.int64)
    whole = [int(c) for c in q.tolist()]
    return np.array([max(-LONG - 1, min(LONG, sum(a * int(b) for a, b in zip(whole, row)))) for row in x.tolist()], np.int64)


def answers(q_ids, q, x_ids, x, pivots, best):
    """For each query (its id's places among x taken out) the best rows of x."""
    dq, dx = distances(q, pivots), distances(x, pivots)
    aq, ax = places(dq, pivots), places(dx, pivots)
    nq, nx = (q * q).sum(1), (x * x).sum(1)
    spread = nx + dx[:, 0] ** 2
    for i in range(len(q)):
        # the squared distance of two places is that of both to the origin, less twice their inner product
        low = np.maximum(0, dq[i, 0] ** 2 + dx[:, 0] ** 2 - 2 * (ax @ aq[i]))
        bound = (nq[i] + nx - low) / 2 + SLACK * (nq[i] + dq[i, 0] ** 2 + spread) + 1e-6
        bound[~np.isfinite(bound)] = np.inf
        bound[x_ids == q_ids[i]] = -np.inf
        kept, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        # in the order of the bounds, of which only as many are sorted as are looked at
        rest, size = np.arange(len(x)), STEP
        rest = rest[bound > -np.inf]
        while len(rest):
            if len(rest) > size:
                cut = np.argpartition(-bound[rest], size)
                now, rest = rest[cut[:size]], rest[cut[size:]]
            else:
                now, rest = rest, rest[:0]
            at = np.concatenate((kept, now))
            s = np.concatenate((found, scores(q[i], x[now])))
            order = top(x_ids[at], s, best)
            kept, found = at[order], s[order]
            if len(found) == best and len(rest):
                rest = rest[bound[rest] >= found[-1]]
            size *= 2
        yield np.full(len(kept), q_ids[i]), x_ids[kept], found


def exact_top_k(vectors: DataFrame, every: int = 50, best: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of vectors (vec_id, embedding) with vec_id divisible by `every`.

    Components become floor(scale * x); scores are integer inner products. A query meets every row
    but those with its own vec_id; rows that repeat another id stay candidates each, and a repeated
    query id is asked once, with its smallest vector. Vectors of unlike lengths are filled with zeros.
    Null ids and vectors with null or non-finite components take no part; an empty table has no answers.
    """
    rows = usable(vectors).select("vec_id", F.transform("v", lambda x: _floor(x * scale)).alias("v"))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    width = size.d or 0
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE_ROWS).toArrow()
    pivots = choose_pivots(matrix(sample.column("v"), width)) if sample.num_rows else np.zeros((1, width))
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def answer(q, x):
        yield from answers(q.column("vec_id").to_numpy(), matrix(q.column("v"), width), x.column("vec_id").to_numpy(), matrix(x.column("v"), width), shared.value, best)

    queries = one_row_an_id(rows.where(F.col("vec_id") % every == 0))
    return in_blocks(queries, rows, size.n, best, answer, "long")


def _floor(x):
    """Floor of a double as a double, whatever its size."""
    whole = F.floor(x).cast("double")
    return F.when(F.abs(x) < 2.0**52, whole).otherwise(x)
