"""Approximate nearest neighbours by inner product: anisotropic product quantisation, then exact reranking.

Vectors are cut into pairs of components, and each pair is coded by one of sixteen centroids in
four bits. The loss of a code is score-aware: with r the residual of x, it is |r|^2 plus ETA - 1
times the squared part of r along x, since that part falsifies large inner products most. The
residual along x couples all pairs of components, so codes and centroids are found by coordinate
descent, one pair at a time. A query scans the codes of all rows through look-up tables (for two
neighbouring codes, one byte), and its RERANK best rows of each block are scored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracewell.llm.vectors import AT_ONCE, in_blocks, matrix, one_row_an_id, top, usable

#: Most vectors that the centroids are fitted on; every row is indexed.
SAMPLE_ROWS = 10_000
CENTROIDS, SWEEPS, ROUNDS = 16, 2, 8
#: Share of a vector's length from which inner products count as large.
THRESHOLD = 0.3
#: Rows of a block that are scored exactly for a query.
RERANK = 160


def eta(width: int) -> float:
    """Weight of the parallel against the orthogonal part of the residual."""
    return max(1.0, (width - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))


def units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def assign(x: np.ndarray, books: np.ndarray, weight: float) -> np.ndarray:
    """Codes (rows x pairs): nearest centroids first, then coordinate descent on the score-aware loss."""
    n, pairs = len(x), len(books)
    xs, us = x.reshape(n, pairs, 2), units(x).reshape(n, pairs, 2)
    codes = np.empty((n, pairs), np.uint8)
    along = np.zeros(n)
    for m in range(pairs):
        gap = xs[:, m, None, :] - books[m]
        codes[:, m] = (gap * gap).sum(2).argmin(1)
        along += ((xs[:, m] - books[m][codes[:, m]]) * us[:, m]).sum(1)
    for _ in range(SWEEPS):
        for m in range(pairs):
            gap = xs[:, m, None, :] - books[m]
            part = (gap * us[:, m, None, :]).sum(2)
            rest = along - part[np.arange(n), codes[:, m]]
            codes[:, m] = ((gap * gap).sum(2) + (weight - 1) * (rest[:, None] + part) ** 2).argmin(1)
            along = rest + part[np.arange(n), codes[:, m]]
    return codes


def fit(sample: np.ndarray, seed: int = 5) -> np.ndarray:
    """Centroids, pairs x 16 x 2, by alternating codes and least squares for each centroid."""
    n, pairs, weight = len(sample), sample.shape[1] // 2, eta(sample.shape[1])
    rnd = np.random.default_rng(seed)
    xs, us = sample.reshape(n, pairs, 2), units(sample).reshape(n, pairs, 2)
    books = np.stack([xs[rnd.choice(n, CENTROIDS, replace=n < CENTROIDS), m] for m in range(pairs)])
    for _ in range(ROUNDS):
        codes = assign(sample, books, weight)
        along = sum(((xs[:, m] - books[m][codes[:, m]]) * us[:, m]).sum(1) for m in range(pairs))
        for m in range(pairs):
            rest = along - ((xs[:, m] - books[m][codes[:, m]]) * us[:, m]).sum(1)
            goal = rest + (xs[:, m] * us[:, m]).sum(1)
            for k in range(CENTROIDS):
                at = codes[:, m] == k
                if at.any():
                    u = us[at, m]
                    a = at.sum() * np.eye(2) + (weight - 1) * u.T @ u
                    books[m, k] = np.linalg.solve(a, xs[at, m].sum(0) + (weight - 1) * goal[at] @ u)
            along = rest + ((xs[:, m] - books[m][codes[:, m]]) * us[:, m]).sum(1)
    return books


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes a byte; an odd one stands alone."""
    if codes.shape[1] % 2:
        codes = np.hstack([codes, np.zeros((len(codes), 1), np.uint8)])
    return codes[:, 0::2] * 16 + codes[:, 1::2]


def tables(q: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Parts of the inner product, bytes x queries x 256."""
    part = np.einsum("qmd,mkd->mqk", q.reshape(len(q), len(books), 2), books).astype(np.float32)
    if len(part) % 2:
        part = np.concatenate([part, np.zeros_like(part[:1])])
    return (part[0::2, :, :, None] + part[1::2, :, None, :]).reshape(len(part) // 2, len(q), 256)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added up in the same order for every row."""
    return (x * q).sum(-1)


def search(q_ids, q, x_ids, x, codes, books, best):
    for a in range(0, len(q), AT_ONCE):
        look = tables(q[a : a + AT_ONCE], books)
        near = np.zeros((look.shape[1], len(x)), np.float32)
        for j in range(len(look)):
            near += look[j].take(codes[:, j], axis=1)
        for i, row in enumerate(near):
            own = q_ids[a + i]
            row[x_ids == own] = -np.inf
            at = np.argpartition(-row, RERANK)[:RERANK] if len(row) > RERANK else np.arange(len(row))
            at = at[x_ids[at] != own]
            s = exact(q[a + i], x[at])
            order = top(x_ids[at], s, best)
            yield np.full(len(order), own), x_ids[at[order]], s[order]


def index(rows: DataFrame, books, width: int) -> DataFrame:
    """rows (vec_id, v) with their codes."""

    def run(batches):
        for rb in batches:
            x = matrix(rb.column("v"), width)
            codes = packed(assign(x, books.value, eta(width)))
            yield pa.RecordBatch.from_arrays([rb.column("vec_id"), rb.column("v"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "v", "codes"])

    return rows.mapInArrow(run, "vec_id long, v array<double>, codes binary")


def nearest(vectors: DataFrame, every: int = 20, best: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of vectors (vec_id, embedding) with vec_id divisible by `every`.

    The score is the inner product of the original vectors in double precision. A query meets every
    row but those with its own vec_id; rows that repeat another id stay candidates each, and a
    repeated query id is asked once, with its smallest vector. Vectors of unlike lengths are filled
    with zeros. Null ids, null and zero vectors, and vectors with null or non-finite components take
    no part; an empty table has no answers.
    """
    rows = usable(vectors, nonzero=True)
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    width = (size.d or 0) + (size.d or 0) % 2
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE_ROWS).toArrow()
    fitted = fit(matrix(sample.column("v"), width)) if sample.num_rows else np.zeros((0, CENTROIDS, 2))
    books = vectors.sparkSession.sparkContext.broadcast(fitted)

    def answer(q, x):
        codes = np.frombuffer(b"".join(x.column("codes").to_pylist()), np.uint8).reshape(x.num_rows, -1)
        yield from search(q.column("vec_id").to_numpy(), matrix(q.column("v"), width), x.column("vec_id").to_numpy(), matrix(x.column("v"), width), codes, books.value, best)

    queries = one_row_an_id(rows.where(F.col("vec_id") % every == 0))
    return in_blocks(queries, index(rows, books, width), size.n, best, answer, "double")
