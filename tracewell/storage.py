"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where it is unset (local tests)."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="tracewell-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    sc.setCheckpointDir(_own["dir"])
    return f"file://{_own['dir']}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a table that `stored` wrote, once no plan reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more, which it does when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def shipped(spark: SparkSession, value) -> Callable[[], object]:
    """A function that gives value to tasks, broadcast with the code of this package's classes in it.

    A plain broadcast names classes by their module, which executors without the package can't import.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
