"""A bucket index that grows with a stream: what arrives is looked up among all that came before, then entered.

Each micro-batch is one generation of the index, a folder named by the batch's number that a replay of
the batch writes anew. A batch is joined with the generations up to its own, never with later ones, so
that a batch which is processed again after a failure gives the same rows: each link is there exactly
once, whatever was lost and however the input was cut to batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewell.operators import lsh

_ENTRY = "id {id}, band int, key string, gen long"
_LINK = "q {id}, nn {id}, band int, gen long"


def _id_type(banded: DataFrame) -> str:
    return banded.schema["id"].dataType.simpleString()


def enter(banded: DataFrame, gen: int, path: str) -> None:
    """Look up rows (id, band, key) among the generations before `gen` and among their own, then leave them as generation `gen`.

    Within a generation the row of the larger id counts as the later one. Null ids and keys take no part; repeated rows count once.
    """
    spark, kind = banded.sparkSession, _id_type(banded)
    rows = banded.where("id is not null and key is not null").select("id", F.col("band").cast("int").alias("band"), "key").distinct()
    rows.sortWithinPartitions("band", "key").write.mode("overwrite").parquet(f"{path}/index/gen={gen}")
    held = index(spark, path, kind).where(F.col("gen") <= gen).select("id", "band", "key", (F.col("gen") == gen).alias("own"))
    mine = spark.read.schema(f"id {kind}, band int, key string").parquet(f"{path}/index/gen={gen}")
    met = lsh.in_lists(mine, *lsh.bucket_lists(held, "own")).select("q", F.explode("ids").alias("nn"), "band", "own")
    met = met.where((F.col("q") != F.col("nn")) & (~F.col("own") | (F.col("nn") < F.col("q"))))
    met.select("q", "nn", "band").write.mode("overwrite").parquet(f"{path}/links/gen={gen}")


def index(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """(id, band, key, gen): all generations that are written."""
    return spark.read.schema(_ENTRY.format(id=id_type)).option("basePath", f"{path}/index").parquet(f"{path}/index")


def links(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """(q, nn, band): q met the earlier nn in a band. An id that arrives again meets what it met before only once; links are shuffled only where one does."""
    found = spark.read.schema(_LINK.format(id=id_type)).option("basePath", f"{path}/links").parquet(f"{path}/links").select("q", "nn", "band")
    again = index(spark, path, id_type).groupBy("id", "band").count().where("count > 1").take(1)
    return found.distinct() if again else found


def grow(banded: DataFrame, path: str) -> None:
    """Enter everything that is there now of a stream (id, band, key) into the index at `path`, and stop; a later call goes on from there."""
    stream = banded.writeStream.foreachBatch(lambda batch, number: enter(batch, number, path))
    query = stream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
