"""Learned hashes of traces: vocabularies, training pairs by strata of similarity, and hashing of whole tables.

A dense tower reads a trace's counts of the terms of a bounded vocabulary, a convolutional one its frames
as numbers of a bounded dictionary. Both are trained on the driver on pairs of a bounded catalog; the
trained tower hashes any number of traces on the executors, sparse rows in small dense blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tracewell.operators import features as X, learned
from tracewell.storage import shipped

#: Terms of a vocabulary and frames of a dictionary, at most: those that most traces hold, ties in order of their texts.
VOCABULARY, FRAMES = 8192, 16_384
#: Strata of similarity, and training pairs of each, at most.
STRATA, PAIRS = 10, 800
#: Numbers of a frame sequence, at most.
LENGTH = 128
#: Rows that become dense at a time inside a task.
AT_ONCE = 256


def vocabulary(counts: DataFrame, most: int = VOCABULARY, least: int = 1) -> DataFrame:
    """(term, place from 0): the terms of counts (id, term, n) with the largest document frequencies, of `least` or more."""
    top = X.document_frequency(counts).where(F.col("df") >= least).orderBy(F.desc("df"), "term").limit(most)
    return top.select("term", (F.row_number().over(Window.orderBy(F.desc("df"), "term")) - 1).cast("int").alias("place"))


def sparse_rows(ids: DataFrame, weights: DataFrame, places: DataFrame) -> DataFrame:
    """(id, places, weights) of every row of ids (id): weights (id, term, w) of the terms in places (term, place, bounded), others left out."""
    held = weights.join(F.broadcast(places), "term").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", F.col("w").cast("double").alias("w")))).alias("x"))
    both = ids.select("id").join(held, "id", "left")
    return both.select("id", F.coalesce(F.col("x.place"), F.array().cast("array<int>")).alias("places"), F.coalesce(F.col("x.w"), F.array().cast("array<double>")).alias("weights"))


def dense(places: pa.Array, weights: pa.Array, width: int) -> np.ndarray:
    """Sparse rows as a matrix."""
    out = np.zeros((len(places), width))
    owner = np.repeat(np.arange(len(places)), places.value_lengths().to_numpy(zero_copy_only=False))
    out[owner, places.flatten().to_numpy(zero_copy_only=False)] = weights.flatten().to_numpy(zero_copy_only=False)
    return out


def sparse_hashed(rows: DataFrame, tower, width: int) -> DataFrame:
    """(id, h): outputs of a dense tower for sparse rows (id, places, weights)."""
    shared = shipped(rows.sparkSession, tower)

    def run(batches):
        held = shared()
        for rb in batches:
            for a in range(0, rb.num_rows, AT_ONCE):
                part = rb.slice(a, AT_ONCE)
                h = held.output(dense(part.column("places"), part.column("weights"), width))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(h.tolist(), pa.list_(pa.float64()))], names=["id", "h"])

    return rows.select(F.col("id").cast("long").alias("id"), "places", "weights").mapInArrow(run, "id long, h array<double>")


def frame_numbers(docs: DataFrame, dictionary: DataFrame, length: int) -> DataFrame:
    """(id, seq) of every row of docs (id, frames): frames as numbers of a bounded dictionary (frame, rank from 1), 0 for unknown ones, padded or cut to `length`."""
    items = docs.select("id", F.posexplode(F.slice("frames", 1, length)).alias("pos", "frame")).join(F.broadcast(dictionary), "frame", "left")
    listed = items.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("rank", F.lit(0)).alias("rank")))).alias("f"))
    ranks = F.coalesce(F.transform("f", lambda x: x["rank"].cast("int")), F.array().cast("array<int>"))
    return docs.select("id").join(listed, "id", "left").select("id", F.slice(F.concat(ranks, F.array_repeat(F.lit(0), length)), 1, length).alias("seq"))


def strata(pairs: DataFrame, each: int = PAIRS) -> DataFrame:
    """(i, j, sim) of at most `each` pairs of each of STRATA equal ranges of similarity from 0 to 1, chosen by a hash."""
    inside = pairs.where("sim is not null").withColumn("_s", F.least(F.floor(F.greatest(F.lit(0.0), F.col("sim")) * STRATA), F.lit(STRATA - 1)))
    w = Window.partitionBy("_s").orderBy(F.xxhash64("i", "j"), "i", "j")
    return inside.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= each).select("i", "j", "sim")


def trained(tower, rows: np.ndarray, ids: np.ndarray, pairs: DataFrame, b: int, objective=learned.hash_objective, epochs: int = 10) -> list[float]:
    """Train a tower on pairs (i, j, sim) of the rows with these ids; the losses of the epochs, none without pairs."""
    got = pairs.toPandas().sort_values(["i", "j"])
    order = np.argsort(ids)
    at = lambda c: order[np.searchsorted(ids[order], got[c].to_numpy())]
    if not len(got):
        return []
    return learned.train(tower, at("i"), at("j"), got["sim"].to_numpy(float), b, objective, epochs=epochs, batch=256, rows=rows)


def predicted(pairs: DataFrame, hashes: DataFrame, b: int) -> DataFrame:
    """pairs (i, j, sim) with `guess`: the share of segments of b outputs in which the codes of hashes (id, h) agree."""
    from tracewell.functions.hashing import binarized
    from tracewell.operators.lsh import segment_hamming

    codes = hashes.select("id", binarized(F.col("h")).alias("code"))
    both = pairs.join(codes.select(F.col("id").alias("i"), F.col("code").alias("x")), "i").join(codes.select(F.col("id").alias("j"), F.col("code").alias("y")), "j")
    return both.select("i", "j", "sim", segment_hamming(F.col("x"), F.col("y"), b).alias("guess"))
