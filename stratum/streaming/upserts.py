"""The append-only logs as streams: insert-or-ignore, the adopted view, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.operators.state import latest


def first_of_each(stream: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """Insert-or-ignore on a stream: a key's first row within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def keep_latest(path: str, keys: list[str], order: list[str]):
    """A ``foreachBatch`` sink: the last row of each key over all batches, as versions under ``path``.

    A batch that is replayed writes its own version again, so the result holds after a retry.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if epoch > 0:
            rows = spark.read.schema(batch.schema).parquet(f"{path}/v={epoch - 1}").unionByName(batch)
        latest(rows, keys, [F.desc(c) for c in order]).write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return write


def counts_by_window(stream: DataFrame, ts: str, key: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n"))
