"""Sharding along a Hilbert curve.

Several metadata columns are quantised to ``BITS`` bits each by the quantiles of their values, rows
are ordered by the Hilbert index of the resulting cell, and the order is cut into runs of nearly equal
bytes. Neighbours on the curve are near in every dimension, so each shard's minimum and maximum prune
on all of them at once.

No global sort is made. The cells are at most ``2 ** (BITS * dims)``; their row and byte counts are the
only thing that the driver gathers, and running sums over them place each cell. Inside a cell, rows
are dealt by a hash to ``SUB`` sub-buckets, placed in the same way, so that a cell which holds a third of
all rows is split over many tasks; only inside a sub-bucket are rows ordered. Rows that pass through
the shuffle hold an id and a few numbers, never a text.

Law ``bytes``: row i with bytes before it b and size s goes to shard floor(shards * (b + s/2) / total), so
a shard's bytes differ from total/shards by at most the largest document.

Defined results: a null text has size 1 (0 bytes plus 1) and CRC 0, like the empty one. A null in a
dimension is smaller than any value. Rows alike in id and text may trade places. Null ids are allowed.
With fewer rows than shards some shards are empty. An empty table gives no rows. Columns with the names
of results are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

SHARDS, BITS, SUB = 16, 5, 256
DIMENSIONS = ("source", "lang", "n_chars")


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of integer points (n, dims), each below ``2 ** bits``."""
    x = np.array(points, np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess work of the Gray code, from the highest bit
        p = q - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            t = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _value(c: Column, kind: str) -> Column:
    """A value in the order of the column: strings and binaries as they are, others as numbers."""
    if kind in ("string", "binary"):
        return c
    if kind in ("date", "timestamp"):
        return F.unix_timestamp(c.cast("timestamp")).cast("double")
    return c.cast("double")


def _string_edges(rows: DataFrame, c: str, probs: list[float]) -> list:
    """Exact quantiles of a column by whole values: running counts over the sorted values, range by range."""
    by = materialize(rows.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).orderBy(c).withColumn("part", F.spark_partition_id()), "values")
    before, total = {}, 0
    for part, n in sorted((r["part"], r["n"]) for r in by.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        before[part] = total
        total += n
    if not total:
        return []
    start = F.element_at(F.create_map(*[F.lit(x).cast(t) for k, v in before.items() for x, t in ((k, "int"), (v, "long"))]), F.col("part"))
    upto = start + F.sum("n").over(Window.partitionBy("part").orderBy(c).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return list(by.withColumn("upto", upto).agg(*[F.min(F.when(F.col("upto") >= p * total, F.col(c))).alias(f"q{i}") for i, p in enumerate(probs)]).first())


def _cells(rows: DataFrame, dims: int, bits: int) -> Column:
    """The cell number of a row with columns d0, d1, ...: its quantised dimensions side by side."""
    cuts = (1 << bits) - 1
    probs = [i / (cuts + 1) for i in range(1, cuts + 1)]
    kinds = dict(rows.dtypes)
    numeric = [f"d{i}" for i in range(dims) if kinds[f"d{i}"] == "double"]
    # quantiles of a bounded sketch for numbers: ``cuts`` of them for each dimension
    got = rows.agg(*[F.percentile_approx(c, probs, 10_000).alias(c) for c in numeric]).first().asDict() if numeric else {}
    cell = F.lit(0)
    for i in range(dims):
        edges = sorted(set((got[f"d{i}"] if f"d{i}" in got else _string_edges(rows, f"d{i}", probs)) or []), key=lambda e: e.encode() if isinstance(e, str) else e)
        at = F.lit(0)
        for e in edges:  # nulls compare to null, and count as below every edge
            at = at + F.coalesce((F.col(f"d{i}") >= F.lit(e)).cast("int"), F.lit(0))
        cell = cell * (1 << bits) + at
    return cell


def _numbers(docs: DataFrame, dimensions, id_col: str, text_col: str) -> list[Column]:
    kinds = dict(docs.dtypes)
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    return [
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        *[_value(F.col(c), kinds[c]).alias(f"d{i}") for i, c in enumerate(dimensions)],
    ]


def _place(docs: DataFrame, dimensions, shards: int, bits: int, id_col: str, text_col: str, rows: Column | None) -> DataFrame:
    """doc_id, size, text_crc32, cell, shard, slot, and the column ``rows`` of ``docs`` if given.

    The narrow columns are read once more for the counts; ``rows`` goes through one shuffle.
    """
    if bits * len(dimensions) > 16:
        raise ValueError("bits * dimensions may be 16 at most")
    dims, spark = len(dimensions), docs.sparkSession
    narrow = materialize(docs.select(*_numbers(docs, dimensions, id_col, text_col)), "sizes")
    cell = _cells(narrow, dims, bits)
    keyed = lambda df: df.withColumn("cell", cell).withColumn("sub", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SUB)).cast("int"))
    hist = materialize(keyed(narrow).groupBy("cell", "sub").agg(F.sum("size").alias("b"), F.count("*").alias("n")), "cells")
    # 2 ** 16 rows at most
    cells = hist.groupBy("cell").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).toPandas()
    pts = np.stack([(cells["cell"].to_numpy(np.int64) >> (bits * (dims - 1 - i))) & ((1 << bits) - 1) for i in range(dims)], 1)
    cells = cells.assign(h=hilbert_index(pts, bits)).sort_values("h")
    total = max(1, int(cells["b"].sum()))
    placed = [(int(c), int(b), int(n)) for c, b, n in zip(cells["cell"], cells["b"].cumsum() - cells["b"], cells["n"].cumsum() - cells["n"])]
    base = F.broadcast(spark.createDataFrame(placed, "cell int, cell_b long, cell_n long"))
    before = Window.partitionBy("cell").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    z = F.lit(0).cast("long")
    subs = hist.join(base, "cell").select("cell", "sub", (F.col("cell_b") + F.coalesce(F.sum("b").over(before), z)).alias("b0"), (F.col("cell_n") + F.coalesce(F.sum("n").over(before), z)).alias("n0"))
    inside = Window.partitionBy("cell", "sub").orderBy("doc_id", "text_crc32", "size")
    run = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def put(df, *more):
        numbered = keyed(df).withColumn("b1", F.sum("size").over(run)).withColumn("n1", F.row_number().over(inside))
        return numbered.join(subs, ["cell", "sub"]).select(
            "doc_id", "size", "text_crc32", "cell", *more,
            # twice the middle of the row, so that whole numbers do
            F.least(F.lit(shards - 1), F.floor((2 * (F.col("b0") + F.col("b1")) - F.col("size")) * shards / F.lit(2.0 * total))).cast("int").alias("shard"),
            (F.col("n0") + F.col("n1") - 1).alias("at"),
        )

    # a row for each shard; ties change who sits in a place, not the places
    first = {r["shard"]: r["first_at"] for r in put(narrow).groupBy("shard").agg(F.min("at").alias("first_at")).collect()}
    start = F.element_at(F.create_map(*[F.lit(x).cast(t) for k, v in first.items() for x, t in ((k, "int"), (v, "long"))]), F.col("shard")) if first else z
    out = put(narrow) if rows is None else put(docs.select(*_numbers(docs, dimensions, id_col, text_col), rows.alias("r")), "r")
    return out.withColumn("slot", F.col("at") - start).drop("at")


def assign(docs: DataFrame, dimensions=DIMENSIONS, shards: int = SHARDS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, cell, law, shard, slot and grown_shard of every row."""
    out = _place(docs, dimensions, shards, bits, id_col, text_col, None)
    return out.select("doc_id", "size", "text_crc32", "cell", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_rows(docs: DataFrame, dimensions=DIMENSIONS, shards: int = SHARDS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``shard`` and ``slot``; columns of ``docs`` that have these names give way."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")])
    return _place(docs, dimensions, shards, bits, id_col, text_col, row).select("r.*", "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, in curve order, so that file statistics prune on every dimension."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_shard_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents")).drop("cell")


ORACLE = None
