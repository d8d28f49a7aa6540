"""Streaming lookup: arriving hashes against a stored bucket table, by a stream-static join without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewell.operators import lsh


def arriving(spark: SparkSession, folder: str, file: str, schema, per_trigger: int = 1) -> DataFrame:
    """Parquet files of one name in a folder, as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", file).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).parquet(folder)


def lists_of_stream(vectors: DataFrame, lists: DataFrame, hot: DataFrame, count: int, width: int) -> DataFrame:
    """(q, band, ids): the lists of an index (lsh.bucket_lists) in the buckets of the arriving vectors, whole; a vector may be in its own."""
    return lsh.in_lists(lsh.bands(lsh.sign_hash(vectors), count, width), lists, hot).select("q", "band", "ids")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process everything that is there now into a Parquet table, exactly once, and read the table."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
