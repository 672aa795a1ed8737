"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A local session that names none gets one, as in tests; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet to the shared folder and reads it back.

    Survives lost executors, and later plans know its size. Removed by ``discard``, or when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stratum-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*stored: DataFrame | None, shuffles: bool = False) -> None:
    """Removes tables that ``materialize`` wrote and no later plan reads.

    With ``shuffles``, also the shuffle files behind them: Spark removes those of plans that the driver has
    dropped when it collects its garbage, so that is asked for. Worth it after large shuffles only.
    """
    spark = None
    for df in stored:
        path = getattr(df, "_stored_at", None)
        if path:
            spark = df.sparkSession
            _remove(spark, path)
    if spark is not None and shuffles:
        spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session, or its gateway, is already gone
        return


def broadcast_if(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Marks ``df`` for broadcast only when its counted rows stay within ``most``."""
    return F.broadcast(df) if rows <= most else df


class Shipped:
    """A broadcast object of one of our classes: by value, as executors need no copy of this package."""

    def __init__(self, spark: SparkSession, obj):
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(obj))

    def get(self):
        return cloudpickle.loads(self._sent.value)
