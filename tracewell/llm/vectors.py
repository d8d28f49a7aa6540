"""A stated set of query vectors against all vectors, in blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Least and most candidates of a block (about; dealt by a hash; a 64th of all between the two), and most queries.
LEAST_ROWS, BLOCK_ROWS, BLOCK_QUERIES = 4096, 65_536, 16_384
#: Queries that are scored at a time inside a task.
AT_ONCE = 128


def usable(vectors: DataFrame, nonzero: bool = False) -> DataFrame:
    """(vec_id, v) with v an array of doubles; without null ids, null vectors, and vectors with null or non-finite components."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False)))
    return rows.where(F.exists("v", lambda x: x != 0)) if nonzero else rows


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of an array column as a matrix; shorter ones are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes] or [[]]).astype(int)] = flat
    return out


def in_blocks(queries: DataFrame, rows: DataFrame, count: int, best: int, answer, score_type: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the `best` answers of each query over all blocks, ties to smaller vec_id.

    queries (vec_id, v) has one row an id. answer(queries, rows) takes two Arrow tables and yields (query_id,
    vec_id, score) arrays, up to `best` for each query, from one block of queries and one of rows.
    Every row meets every block of queries once; a block is bounded, whatever the tables' sizes.
    """
    asked = queries.count()
    parts = max(1, -(-count // max(LEAST_ROWS, min(BLOCK_ROWS, count // 64))))
    many = max(1, -(-asked // BLOCK_QUERIES))
    row_no = F.pmod(F.hash("vec_id", "v"), F.lit(parts)).cast("int")
    left = queries.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(many)).cast("int")).withColumn("xb", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = rows.withColumn("xb", row_no).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    kind = pa.int64() if score_type == "long" else pa.float64()
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", kind)])

    def run(q: pa.Table, x: pa.Table) -> pa.Table:
        parts = list(answer(q, x)) if q.num_rows and x.num_rows else []
        cols = [np.concatenate(c) if parts else [] for c in (zip(*parts) if parts else ([], [], []))]
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    found = left.groupBy("xb", "qb").cogroup(right.groupBy("xb", "qb")).applyInArrow(run, f"query_id long, vec_id long, score {score_type}")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= best).select("query_id", "rank", "vec_id", "score")


def one_row_an_id(rows: DataFrame) -> DataFrame:
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def top(ids: np.ndarray, scores: np.ndarray, best: int) -> np.ndarray:
    """Places of the best scores, ties to smaller ids."""
    if len(scores) > 4 * best:
        least = np.partition(scores, len(scores) - best)[len(scores) - best]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:best]]
