"""Which database a session uses, and the tables' schema version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VERSIONS = ("0001-init", "0002-reading", "0003-simplified", "0004-embedding")


def resolve_source(arg: str | None, env: str | None, bundled: str) -> str:
    """The first that is not blank: the argument, the environment's, the bundled one."""
    return next((x.strip() for x in (arg, env) if x and x.strip()), bundled)


def apply_versions(spark: SparkSession, applied: DataFrame) -> DataFrame:
    """The version table with all versions, in order; those already there keep their row."""
    want = spark.createDataFrame([(i, v) for i, v in enumerate(VERSIONS)], "ord int, version string")
    return want.join(applied, "version", "left").orderBy("ord").select("version")


def rewrite(df: DataFrame, path: str, files: int) -> None:
    """A compact, compressed copy; an empty table is refused."""
    if df.isEmpty():
        raise ValueError("refusing to write an empty table")
    df.coalesce(files).write.mode("overwrite").option("compression", "zstd").parquet(path)
