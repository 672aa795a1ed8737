"""Exact top-k inner-product search by term-at-a-time accumulation.

Every component of a vector is a term. A block of candidates becomes one postings list per
component (the rows where it is not zero, and its values there); each query row scatters
``weight * posting`` into a dense score array over the block, a partition selection keeps the k
best, and the bests of all blocks are merged.

Queries go out in blocks of ``QUERY_BLOCK`` vectors, so what is broadcast has a fixed bound; one
pass over the candidates is made for each block.

Defined results: a vector that is null, empty or holds a null or non-finite component takes no
part, nor does a row without id. Vectors of unlike length are compared on the components that both
have. Repeated rows are separate candidates; rows that carry the query's id are never its result. A
query id that repeats is searched once for each of its rows, and the best k of them all are kept. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Query vectors broadcast at once (64 components: 16 MB), and scored at once against a block.
QUERY_BLOCK = 32768
QUERY_ROWS = 256


def quantized(vec: Column) -> Column:
    return F.transform(vec, lambda x: F.floor(x.cast("double") * 256).cast("long"))


def usable(vec: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vec.isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, bad)


def _postings(ids: np.ndarray, flat: np.ndarray, lengths: np.ndarray):
    """(rows, values) of each component that some row of the block has."""
    row = np.repeat(np.arange(len(ids)), lengths)
    start = np.cumsum(lengths) - lengths
    dim = np.arange(len(flat)) - np.repeat(start, lengths)
    keep = flat != 0
    row, dim, val = row[keep], dim[keep], flat[keep]
    order = np.argsort(dim, kind="stable")
    row, dim, val = row[order], dim[order], val[order]
    cut = np.searchsorted(dim, np.arange((dim[-1] if len(dim) else -1) + 2))
    return [(row[a:b], val[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def accumulate(weights: np.ndarray, postings, n: int) -> np.ndarray:
    """Dense scores of ``n`` candidates for each query row, one term at a time."""
    acc = np.zeros((len(weights), n), weights.dtype)
    for d, (rows, vals) in enumerate(postings[: weights.shape[1]]):
        w = weights[:, d]
        q = np.flatnonzero(w)
        if not len(rows) or not len(q):
            continue
        if len(rows) == n and len(q) == len(w):
            acc += w[:, None] * vals[None, :]
        else:
            acc[np.ix_(q, rows)] += w[q, None] * vals[None, :]
    return acc


def select(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """The k best (id, score) of each row, ties to the smaller id, without the row's own id."""
    out = []
    for s, me in zip(scores, own):
        ok = ids != me
        s, i = s[ok], ids[ok]
        if len(s) > k:
            edge = np.partition(s, len(s) - k)[len(s) - k]
            at = np.flatnonzero(s >= edge)
            s, i = s[at], i[at]
        best = np.lexsort((i, -s))[:k]
        out.append((i[best], s[best]))
    return out


def _dense(flat: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, col] = flat
    return out


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())


def _search_block(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Each partition's best rows for one block of queries."""
    got = queries.select("id", "v").toArrow().combine_chunks()
    if not got.num_rows:
        return rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    q_ids = got.column(0).to_numpy()
    q_flat, q_len = _lists(got.column(1).combine_chunks())
    sent = rows.sparkSession.sparkContext.broadcast((q_ids, q_flat, q_len))

    def run(batches):
        q_ids, q_flat, q_len = sent.value
        weights = _dense(q_flat, q_len, int(q_len.max()))
        n = len(q_ids)
        best_id, best = [np.empty(0, np.int64)] * n, [np.empty(0, np.int64)] * n
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy(zero_copy_only=False)
            flat, lengths = _lists(b.column(1))
            posts = _postings(ids, flat, lengths)
            big = float(np.abs(flat).max(initial=0)) * float(np.abs(q_flat).max(initial=0)) * max(1, weights.shape[1])
            kind = np.int64 if big < 2**62 else object  # whole numbers of any size, if ever needed
            for a in range(0, n, QUERY_ROWS):
                w = weights[a : a + QUERY_ROWS].astype(kind)
                got = select(accumulate(w, [(r, v.astype(kind)) for r, v in posts], len(ids)), ids, q_ids[a : a + QUERY_ROWS], k)
                for j, (i, s) in enumerate(got, a):
                    i, s = np.concatenate([best_id[j], i]), np.concatenate([best[j], s])
                    keep = np.lexsort((i, -s))[:k]
                    best_id[j], best[j] = i[keep], s[keep]
        sizes = [len(x) for x in best_id]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(q_ids, sizes)), pa.array(np.concatenate(best_id)), pa.array(np.concatenate(best).astype(np.int64))],
                ["query_id", "vec_id", "score"],
            )

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def topk(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k best rows of ``vectors`` for every row of ``queries``: query_id, rank, vec_id, score."""
    def ready(df):
        v = F.col(vec_col)
        return df.filter(F.col(id_col).isNotNull() & usable(v)).select(F.col(id_col).cast("long").alias("id"), quantized(v).alias("v"))

    rows = ready(vectors)
    # queries in blocks of a bounded size, dealt at random; one block at a time is sent, whatever their number
    spark = rows.sparkSession
    ask = materialize(ready(queries).withColumn("lot", F.rand(1)), "queries")
    blocks = -(-ask.count() // (QUERY_BLOCK * 7 // 8))
    found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    for i in range(blocks):
        part = _search_block(rows, ask.filter((F.col("lot") >= i / blocks) & (F.col("lot") < (i + 1) / blocks)), k)
        found = found.unionByName(part if blocks == 1 else materialize(part, "found"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return topk(v, v.filter(F.col("vec_id") % 50 == 0), 5)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
