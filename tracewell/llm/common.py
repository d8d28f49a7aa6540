"""What several operators of this subpackage share: words of texts, and sets of documents joined by links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewell.storage import discard, stored

#: Text handled at a time inside one Arrow batch, in characters; bounds a worker's memory.
CHUNK_CHARS = 2_000_000
#: Most rows of an Arrow batch; long texts make Spark's own default too large for a worker.
BATCH_ROWS = 1000
#: Array elements of a block of running sums, and code points of a piece of text.
BLOCK, PIECE = 256, 1024


class Numbered(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def small_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches to BATCH_ROWS rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def boxed(docs: DataFrame, *use: str) -> DataFrame:
    """The columns `use` of docs, and all others in one struct `box`, so that no name can clash with those of an operator."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in use]
    return docs.select(*use, F.struct(*others, F.lit(0).alias("__tracewell")).alias("box"))


def unboxed(df: DataFrame, docs: DataFrame, *use: str) -> DataFrame:
    """The columns of docs, in their order, from df with the columns `use` and `box`."""
    return df.select(*(F.col(c) if c in use else F.col("box").getField(c).alias(c) for c in docs.columns))


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def before(values: Column, zero: Column, join) -> Column:
    """For each element of an array the elements before it joined (an associative function of two), by whole blocks and the part of one."""
    part = lambda b, n: F.aggregate(F.slice(values, b * BLOCK + 1, n), zero, join)
    blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), ((F.size(values) - 1) / BLOCK).cast("int")))
    whole = F.transform(blocks, lambda b: part(b, F.lit(BLOCK)))
    ahead = lambda v: F.transform(v, lambda _, b: F.aggregate(F.slice(v, F.lit(1), b), zero, join))
    return let(whole, lambda v: let(ahead(v), lambda base: F.transform(values, lambda _, i: join(F.get(base, (i / BLOCK).cast("int")), part((i / BLOCK).cast("int"), i % BLOCK)))))


def sums_before(values: Column) -> Column:
    """For each element of an array of numbers the sum of all before it (long)."""
    return before(values, F.lit(0).cast("long"), lambda a, x: a + x)


def most_before(values: Column) -> Column:
    """For each element of an array of integers the largest before it, -1 for the first."""
    return before(values, F.lit(-1), lambda a, x: F.greatest(a, x))


def pieces(text: Column) -> Column:
    """A text as an array of pieces of PIECE code points, from which `cut` takes a part in time that grows with the part."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """Code points start to end (exclusive) of the text that `pieces` gave parts of."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    near = F.concat_ws("", F.slice(parts, first + 1, last - first + 1))
    return F.when(end > start, F.substring(near, (start - first * PIECE + 1).cast("int"), (end - start).cast("int"))).otherwise("")


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z in lower case; null has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def chunks(texts: list, most: int = CHUNK_CHARS):
    """(start, end) of runs of texts with about `most` characters each; one long text is a run of its own."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def numbered_words(texts: list) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the word numbers of all texts in a row, and how many belong to each text."""
    seen = Numbered()
    get = seen.__getitem__
    ids: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = words_of(t)
        counts[i] = len(w)
        ids.extend(map(get, w))
    return list(seen), np.array(ids, np.int64), counts


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the smallest node reachable.

    Alternates two steps until the edges are stars: each node hands its smallest neighbour to its
    larger neighbours, then to its smaller ones. Both are a group-by with partial sums and an
    equi-join of narrow rows, with one row for each node on one side, so that the rows of a node with
    very many neighbours can be split among tasks.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = stored(pairs, "edges")
    while True:
        unsettled = pairs.groupBy("u").count().where("count > 1").select("u").union(pairs.select(F.col("v").alias("u")).join(pairs.select("u"), "u", "left_semi"))
        if not unsettled.take(1):
            break
        both = pairs.union(pairs.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select("u", F.col("m").alias("v")).union(joined.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        old, pairs = pairs, stored(small, "edges")
        discard(old)
        discard(large)
    roots = pairs.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
