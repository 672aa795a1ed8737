"""Tables kept between plans: lineage cuts, results built once for their input, row numbers without one task."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BUILT: dict[tuple, DataFrame] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A local session that names none gets one, as in tests; a cluster must name it."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: later plans know its size.

    A checkpoint keeps the estimate of the plan it cut, and estimates multiply at each join: after ten rounds of
    joins with themselves they have millions of digits. ``unlink`` removes the table, or the session's end.
    """
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._written_at = at
    atexit.register(_remove, df.sparkSession, at)
    return out


def unlink(*tables: DataFrame) -> None:
    """Removes tables of ``written`` that no later plan reads."""
    for df in tables:
        if getattr(df, "_written_at", None):
            _remove(df.sparkSession, df._written_at)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session, or its gateway, is already gone
        return


#: Rows of a task in which large tables meet: what it sorts and hashes stays within some 200 MB, however large the tables.
TASK_ROWS = 500_000


def dealt(rows: int, *tables: tuple[DataFrame, str]) -> list[DataFrame]:
    """Tables, each with its column, dealt by that column into as many parts as ``rows`` rows need.

    Parts that Spark chooses itself are joined up to a size of compressed bytes, which may be many millions of rows.
    """
    parts = max(int(tables[0][0].sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    return [df.repartition(parts, key_col) for df, key_col in tables]


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table: a table that has changed has another one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)))


def build_once(spark: SparkSession, name: str, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives for the table at ``path``, written to the shared folder the first time and read from there.

    A session that meets the table changed builds it anew.
    """
    key = (spark.sparkContext.applicationId, name, fingerprint(spark, path))
    if key not in _BUILT:
        df = make()
        at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(at)
        _BUILT[key] = spark.read.schema(df.schema).parquet(at)
    return _BUILT[key]


def number_rows(df: DataFrame, order: list[Column | str], name: str = "n") -> DataFrame:
    """``df`` with the place of each row in the order, from 1, counted by ranges of it and not in one task.

    The order must tell all rows apart, else rows alike are numbered as they come.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = cut_lineage(rows.withColumn("_at", F.monotonically_increasing_id()))  # the part's number above 33 bits of place
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["part"], r["k"]) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("k")).collect())  # one row a part
    first, total = [], 0
    for p, k in sizes:
        first.append((p, total))
        total += k
    offset = df.sparkSession.createDataFrame(first, "_part long, _first long")
    return rows.withColumn("_part", part).join(F.broadcast(offset), "_part").withColumn(name, F.col("_first") + place + 1).drop("_part", "_first", "_at")


def running_total(rows: DataFrame, place: str, value: str, name: str = "before", block: int = 100_000) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows at smaller places (from 1, without gaps), by blocks of places."""
    rows = rows.withColumn("_b", F.floor((F.col(place) - 1) / block))
    sums = rows.groupBy("_b").agg(F.sum(value).alias("_s"))
    above = sums.withColumn("_start", F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).select("_b", "_start")  # a row a block
    inside = F.sum(value).over(Window.partitionBy("_b").orderBy(place)) - F.col(value)
    return rows.join(above, "_b").withColumn(name, F.col("_start") + inside).drop("_b", "_start")
