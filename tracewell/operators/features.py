"""The catalog of frequent traces, sparse feature tables (id, term, weight) and corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.functions import text as T
from tracewell.storage import stored


def catalog(docs: DataFrame, most: int = 1000, column: str = "text", clean_first: bool = True) -> DataFrame:
    """(id, text): the `most` most frequent distinct traces, numbered by frequency and then by text.

    Texts are cleaned before they are told apart (clean_first), or after, when the catalog may repeat.
    """
    raw = F.col(column).cast("string")
    texts = docs.where(raw.isNotNull()).select((T.clean_trace(raw) if clean_first else raw).alias("text"))
    top = texts.groupBy("text").count().orderBy(F.desc("count"), "text").limit(most)
    numbered = top.select((F.row_number().over(Window.orderBy(F.desc("count"), "text")) - 1).cast("long").alias("id"), "text")
    return numbered if clean_first else numbered.withColumn("text", T.clean_trace(F.col("text")))


def own_ids(docs: DataFrame) -> bool:
    """Whether no id of docs (id, ...) repeats; only ids are shuffled for it."""
    return not docs.groupBy("id").count().where("count > 1").take(1)


def counted(terms: Column) -> Column:
    """The distinct elements of an array with their counts, as an array of structs (term, n): runs of the sorted array."""
    run = lambda s: F.filter(F.transform(s, lambda _, i: i), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    ends = lambda s, at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("n")))
    let = lambda value, body: F.transform(F.array(value), body)[0]
    return let(F.array_sort(terms), lambda s: let(run(s), lambda at: ends(s, at)))


def term_counts(docs: DataFrame, terms: Column) -> DataFrame:
    """(id, term, n): how often each document of docs (id, ...) holds each term of an array column."""
    return docs.select("id", F.explode(terms).alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))


def own_counts(docs: DataFrame, terms: Column) -> DataFrame:
    """`term_counts` of documents whose ids don't repeat: each row counts its own terms, and nothing is shuffled."""
    return docs.select("id", F.explode(counted(terms)).alias("c")).select("id", "c.term", "c.n")


def frames_of(docs: DataFrame) -> tuple[DataFrame, Column]:
    return docs, T.tokens(T.vector_text(F.col("text")))


def bigrams_of(docs: DataFrame) -> tuple[DataFrame, Column]:
    return docs.select("id", T.tokens(T.vector_text(F.col("text"))).alias("w")), T.adjacent(F.col("w"))


def durfex_of(docs: DataFrame) -> tuple[DataFrame, Column]:
    """Runs of one to three package tokens."""
    return docs.select("id", T.tokens(T.packages(F.col("text"))).alias("w")), F.concat("w", T.adjacent(F.col("w"), 2), T.adjacent(F.col("w"), 3))


def bag_of_frames(docs: DataFrame) -> DataFrame:
    return term_counts(*frames_of(docs))


def bag_of_bigrams(docs: DataFrame) -> DataFrame:
    return term_counts(*bigrams_of(docs))


def durfex_counts(docs: DataFrame) -> DataFrame:
    return term_counts(*durfex_of(docs))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def tfidf(counts: DataFrame, n_docs: int, fitted: DataFrame | None = None, scale: float = 1.0) -> DataFrame:
    """(id, term, w): counts times ln((1 + N) / (1 + df)) + 1, each document at length `scale`.

    fitted: the document frequencies (term, df) of another corpus; terms that it lacks are left out.
    """
    df = document_frequency(counts) if fitted is None else fitted
    raw = counts.join(df, "term").withColumn("w", F.col("n") * (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0))
    length = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return raw.join(length, "id").select("id", "term", (F.col("w") / F.col("length") * scale).alias("w"))


def transform_counts(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Counts of new documents in the terms of a fitted vocabulary; unknown terms are left out."""
    return counts.join(vocabulary.select("term").distinct(), "term", "left_semi").select("id", "term", "n")


def frame_statistics(counts: DataFrame, n_docs: int) -> DataFrame:
    """(term, total, idf, share): idf is 1 + ln(N / total occurrences), share is total / N."""
    total = counts.groupBy("term").agg(F.sum("n").alias("total"))
    return total.select("term", "total", (1 + F.log(F.lit(float(n_docs)) / F.col("total"))).alias("idf"), (F.col("total") / F.lit(float(n_docs))).alias("share"))


def frame_dictionary(frames: DataFrame) -> DataFrame:
    """(frame, rank): the distinct frames of an array column `frames`, sorted and numbered from 1.

    Numbers come from the counts of a range partitioning, so that no single task sees all frames.
    """
    spread = frames.select(F.explode("frames").alias("frame")).distinct().repartitionByRange("frame").sortWithinPartitions("frame")
    part = stored(spread.select("frame", F.spark_partition_id().alias("part")), "frames")
    sizes = part.groupBy("part").count()
    before = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    inside = Window.partitionBy("part").orderBy("frame")
    return part.join(F.broadcast(before), "part").select("frame", (F.col("before") + F.row_number().over(inside)).cast("long").alias("rank"))


def ranked_frames(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(id, ranks): frames of docs (id, frames) as their numbers in the dictionary, 0 for unknown ones."""
    items = docs.select("id", F.posexplode("frames").alias("pos", "frame")).join(dictionary, "frame", "left")
    listed = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("rank", F.lit(0)).alias("rank"))))
    return items.groupBy("id").agg(F.transform(listed, lambda x: x["rank"].cast("int")).alias("ranks"))


def longest(docs: DataFrame, items: str = "frames") -> int:
    return docs.agg(F.max(F.size(items))).first()[0] or 0


def split(rows: DataFrame, number: Column, parts: int = 5) -> DataFrame:
    """rows with `validation`: one part of `parts`, by a number that each row has for good."""
    return rows.withColumn("validation", F.pmod(number, F.lit(parts)) == 0)
