"""Sources and sinks: traces from CSV or Parquet, catalogs, pair measures, bucket tables and models."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession

CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "nullValue": "\\N"}


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header, by a given schema; quoted texts may hold newlines and doubled quotes, and \\N is null."""
    return spark.read.options(**{k: str(v) for k, v in CSV.items()}).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    options = {k: str(v) for k, v in CSV.items() if k not in ("multiLine",)}
    df.write.mode("overwrite").options(**options).csv(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_index(banded: DataFrame, path: str) -> None:
    """A bucket table (id, band, key), a folder a band, so that a lookup in some bands reads no others.

    Ranges of (band, key, id) are written by tasks of their own, so that neither a band nor a hot key is one task.
    """
    banded.repartitionByRange("band", "key", "id").sortWithinPartitions("band", "key").write.mode("overwrite").partitionBy("band").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_buckets(banded: DataFrame, name: str, path: str, count: int) -> None:
    """A bucket table (id, band, key) as a table of the session's catalog, dealt to `count` files by (band, key) and sorted.

    Joins on (band, key) read it where it lies; only the other side is shuffled. A hot key is one file: AQE splits its reading.
    """
    banded.repartition(count, "band", "key").write.mode("overwrite").option("path", path).bucketBy(count, "band", "key").sortBy("band", "key").saveAsTable(name)


def append_buckets(banded: DataFrame, name: str, count: int) -> None:
    """One generation more of a table that `save_buckets` made with the same count of buckets."""
    banded.repartition(count, "band", "key").write.mode("append").bucketBy(count, "band", "key").sortBy("band", "key").saveAsTable(name)


def probe_buckets(queries: DataFrame, name: str) -> DataFrame:
    """(q, band, nn): rows of the table in the buckets of the queries (id, band, key), without a shuffle of the table."""
    held = queries.sparkSession.table(name).withColumnRenamed("id", "nn")
    return queries.withColumnRenamed("id", "q").join(held.hint("merge"), ["band", "key"]).where("q <> nn").select("q", "band", "nn")


def save_model(spark: SparkSession, arrays: dict[str, np.ndarray], path: str) -> None:
    """Named arrays as one row of a Parquet table, on any file system that Spark writes."""
    held = io.BytesIO()
    np.savez(held, **arrays)
    spark.createDataFrame([(bytearray(held.getvalue()),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(bytes(spark.read.parquet(path).first().model))) as f:
        return {k: f[k] for k in f.files}
