"""Vectors: int8 quantisation and exhaustive cosine ranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantize_int8(v: Column) -> Column:
    """Components times 127, rounded half up and held within +-127."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x.cast("double") * 127 + 0.5).cast("int"))))


def dequantize_int8(q: Column) -> Column:
    return F.transform(q, lambda x: (x / F.lit(127.0)).cast("float"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 if either has no length. Unlike sizes are an error."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(n == 0, 0.0).otherwise(dot(a, b) / n)
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors differ in size")).cast("double"))


def vector_rank(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", vec_col: str = "vec", digits: int = 9) -> DataFrame:
    """The k rows nearest by cosine to one vector, ties to the smaller id."""
    if k <= 0:
        return vectors.select(id_col, F.lit(0.0).alias("score")).limit(0)
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(id_col, F.round(cosine(F.col(vec_col), q), digits).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


#: Queries of a block of them, and blocks of vectors that the queries go to.
QUERIES, SPREAD = 32_768, 64


def vector_rank_batch(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec", digits: int = 9) -> DataFrame:
    """(query_id, rank, id, score) for a table of query vectors (query_id, query_vec).

    Blocks of vectors meet blocks of queries in products of matrices, and each keeps its best k before the shuffle.
    Cosines that may be among them are computed once more in order. A null vector has a null score, which comes last.
    """
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    q = queries.select("query_id", F.col("query_vec").alias("vec"))
    kinds = dict(v.dtypes)["id"], dict(q.dtypes)["query_id"]
    schema = f"query_id {kinds[1]}, id {kinds[0]}, score double"
    n = v.count()
    x, y = max(1, min(-(-n // BLOCK), SPREAD), -(-n // LARGE)), max(1, -(-q.count() // QUERIES))
    both = lambda own, of, others: F.explode(F.transform(F.sequence(F.lit(0), F.lit(others - 1)), lambda o: F.struct(F.pmod(F.xxhash64(own), F.lit(of)).cast("int").alias("own"), o.alias("other"))))
    put_v = v.withColumn("at", both("id", x, y)).select(F.col("at.own").alias("x"), F.col("at.other").alias("y"), F.lit(False).alias("asks"), "id", F.lit(None).cast(kinds[1]).alias("query_id"), "vec")
    put_q = q.withColumn("at", both("query_id", y, x)).select(F.col("at.other").alias("x"), F.col("at.own").alias("y"), F.lit(True).alias("asks"), F.lit(None).cast(kinds[0]).alias("id"), "query_id", "vec")
    scale = 10.0**digits

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        ask, give = t.filter(t["asks"]), t.filter(pc.invert(t["asks"]))
        give = give.take(pc.sort_indices(give, [("id", "ascending")], null_placement="at_start"))
        pairs = []  # place in ask, place in give, score
        if len(ask) and len(give) and k > 0:
            (qn, ql, qu, q_at), (vn, vl, vu, v_at) = ((*unit_rows(z["vec"].filter(z["vec"].is_valid())), np.flatnonzero(z["vec"].is_valid().to_numpy())) for z in (ask, give))
            one_size(qn, vn)
            a, b = _Rows(qn, ql), _Rows(vn, vl)
            slack = 4e-16 * (vu.shape[1] + 8) if tame(ql, vl) else np.inf
            for i in range(0, len(qu), TILE):
                p, at, s = _best(a, b, qu, vu, i, k, scale, slack)
                pairs.append((q_at[p], v_at[at], s))
            blank = np.flatnonzero(ask["vec"].is_null().to_numpy())
            for rows, most in ((q_at, np.flatnonzero(give["vec"].is_null().to_numpy()) if len(v_at) < k else v_at[:0]), (blank, np.arange(len(give)))):
                most = most[:k]
                pairs.append((np.repeat(rows, len(most)), np.tile(most, len(rows)), None))
        out = [pa.table([ask["query_id"].take(pa.array(p)), give["id"].take(pa.array(at)), pa.nulls(len(p), pa.float64()) if s is None else pa.array(s)], names=["query_id", "id", "score"]) for p, at, s in pairs]
        return pa.concat_tables(out) if out else pa.table([ask["query_id"][:0], give["id"][:0], pa.array([], pa.float64())], names=["query_id", "id", "score"])

    s = put_v.unionByName(put_q).repartition(x * y, "x", "y").groupBy("x", "y").applyInArrow(run, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


class _Rows:
    def __init__(self, vec: np.ndarray, length: np.ndarray) -> None:
        self.vec, self.length = vec, length


def _best(a: _Rows, b: _Rows, qu: np.ndarray, vu: np.ndarray, i: int, k: int, scale: float, slack: float):
    """(row of a, row of b, score in steps of 1 / scale) of the k best of b for each row of a from i, ties to the earlier row of b."""
    u, step = qu[i : i + TILE], 1 / scale
    row, at, score = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    worst = np.full(len(u), -np.inf)  # the k-th best so far: a later row has to be better by a step
    with np.errstate(invalid="ignore"):
        for j in range(0, len(vu), WIDE):
            s = u @ vu[j : j + WIDE].T
            s[np.isnan(s)] = np.inf
            low = worst + step / 2 - slack
            met = s >= low[:, None]
            if s.shape[1] > k and np.count_nonzero(met) > 4 * k * len(u):
                kth = np.partition(s, s.shape[1] - k, 1)[:, s.shape[1] - k]
                met = s >= np.maximum(low, kth - step - slack)[:, None]
            p, q = np.nonzero(met)
            if not len(p):
                continue
            x = cosines_in_order(a, b, p + i, q + j)
            x = np.where(np.isfinite(x), np.sign(x) * np.floor(np.abs(x) * scale + 0.5) / scale, x)
            old = np.isin(row, p)
            r, z, c = np.r_[row[old], p], np.r_[at[old], q + j], np.r_[score[old], x]
            order = np.lexsort((z, -np.where(np.isnan(c), np.inf, c), r))
            r, z, c = r[order], z[order], c[order]
            first = np.r_[True, r[1:] != r[:-1]]
            place = np.arange(len(r)) - np.maximum.accumulate(np.where(first, np.arange(len(r)), 0))
            keep = place < k
            row, at, score = np.r_[row[~old], r[keep]], np.r_[at[~old], z[keep]], np.r_[score[~old], c[keep]]
            full = place == k - 1
            worst[r[full]] = np.where(np.isnan(c[full]), np.inf, c[full])
    return row + i, at, score


#: Vectors in a block of a small table; blocks of a larger one, as each vector goes to so many tasks; vectors in a block at most;
#: rows and columns of blocks that are multiplied at once.
BLOCK, BLOCKS, LARGE, TILE, WIDE = 4096, 16, 131_072, 512, 2048


def blocks_of(n: int) -> int:
    """Blocks for n vectors: with their number bounded, what is dealt to pairs of them grows as the vectors do."""
    return max(1, min(-(-n // BLOCK), BLOCKS), -(-n // LARGE))


def deal(v: DataFrame, blocks: int) -> DataFrame:
    """``v`` with its block, by a hash of the id."""
    return v.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))


def deal_pairs(v: DataFrame, blocks: int) -> DataFrame:
    """The rows of every two blocks x <= y, with ``block`` to tell them apart."""
    put = deal(v, blocks).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    put = put.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")).drop("other")
    return put.repartition(blocks * (blocks + 1) // 2, "x", "y")


def two_sides(t: pa.Table, x: int, y: int) -> tuple[pa.Table, pa.Table]:
    return t.filter(pc.equal(t["block"], x)), t.filter(pc.equal(t["block"], y))


def one_size(*vecs: np.ndarray) -> None:
    if len({v.shape[1] for v in vecs if len(v)}) > 1:
        raise ValueError("vectors differ in size")


def unit_rows(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of a column as a matrix, their lengths as ``cosine`` has them, and the vectors divided by those."""
    a = col.combine_chunks()
    sizes = pc.unique(pc.list_value_length(a)).to_pylist()
    if len(sizes) > 1:
        raise ValueError("vectors differ in size")
    v = a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), sizes[0] if sizes else 0)
    length, unit = np.zeros(len(v)), np.empty(v.shape)
    with np.errstate(all="ignore"):
        for k in range(v.shape[1]):
            x = v[:, k].astype(np.float64)
            length += x * x
        length = np.sqrt(length)
        np.divide(v, np.where(length == 0, 1, length)[:, None], out=unit)
    return v, length, unit


def tame(*lengths: np.ndarray) -> bool:
    """No product of two lengths comes near the ends of what a float holds."""
    return all(((x == 0) | (x > 1e-140) & (x < 1e140) | ~np.isfinite(x)).all() for x in lengths)


def cosines_in_order(a, b, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of rows p of a and q of b, added in the order of the components, so that the last digit is that of ``cosine``."""
    x = np.zeros(len(p))
    with np.errstate(all="ignore"):
        for k in range(a.vec.shape[1]):
            x += a.vec[p, k].astype(np.float64) * b.vec[q, k]
        n = a.length[p] * b.length[q]
        return np.divide(x, n, out=np.zeros_like(x), where=n != 0)


def _block_pairs(vectors: DataFrame, run, schema: str) -> DataFrame:
    """``run(a, b, same)`` on the rows of every two blocks, each two once; ``same``: both are one block.

    ``vectors``: id, vec and more; rows without an id or a vector take no part.
    """
    v = vectors.filter("id is not null and vec is not null")

    def both(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = key
        return run(pdf[pdf["block"] == x], pdf[pdf["block"] == y], x == y)

    return deal_pairs(v, blocks_of(v.count())).groupBy("x", "y").applyInPandas(both, schema)


def _tiles(a: pd.DataFrame, b: pd.DataFrame, same: bool):
    """(rows of a, cosines with all rows of b, mask of pairs of unlike ids that are met here first), tile by tile."""
    if a["vec"].map(len).nunique() > 1 or not set(a["vec"].map(len)) >= set(b["vec"].map(len)):
        raise ValueError("vectors differ in size")
    va, vb = (np.array([np.asarray(x, np.float64) for x in d["vec"]]) for d in (a, b))
    la, lb = (np.sqrt(np.cumsum(v * v, 1)[:, -1]) for v in (va, vb))
    ia, ib = a["id"].to_numpy(), b["id"].to_numpy()
    for i in range(0, len(va), TILE):
        n = la[i : i + TILE, None] * lb
        s = np.divide(va[i : i + TILE] @ vb.T, n, out=np.zeros_like(n), where=n != 0)
        ok = ia[i : i + TILE, None] != ib
        if same:
            ok &= np.arange(i, i + len(ok))[:, None] < np.arange(len(vb))
        yield i, s, ok, (va, vb, la, lb, ia, ib)


def similar_pairs(vectors: DataFrame, least: float, id_col: str = "id", vec_col: str = "vec", digits: int = 9) -> DataFrame:
    """(a, b, sim), a < b, of all pairs of vectors whose cosine is ``least`` or more, compared in blocks."""
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    kind = dict(v.dtypes)["id"]

    def run(a, b, same):
        out = [pd.DataFrame({"a": a["id"][:0], "b": a["id"][:0], "sim": np.zeros(0)})]
        for i, s, ok, (va, vb, la, lb, ia, ib) in _tiles(a, b, same) if len(a) and len(b) else ():
            p, q = np.nonzero(ok & (s >= least - 1e-6))
            p += i
            # once more in the order of the components, so that the last digit is that of ``cosine``
            x = np.zeros(len(p))
            for k in range(va.shape[1]):
                x += va[p, k] * vb[q, k]
            out.append(pd.DataFrame({"a": np.minimum(ia[p], ib[q]), "b": np.maximum(ia[p], ib[q]), "sim": x / (la[p] * lb[q])}))
        return pd.concat(out)

    return _block_pairs(v, run, f"a {kind}, b {kind}, sim double").withColumn("sim", F.round("sim", digits)).filter(F.col("sim") >= round(least, 12))


def pair_similarity_by_label(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, digits: int = 6) -> DataFrame:
    """(category, pairs, mean_sim, min_sim, max_sim) over all ordered pairs of unlike ids; category: whether the labels are equal."""
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).cast("string").alias("label"))

    def run(a, b, same):
        out = []
        for i, s, ok, _ in _tiles(a, b, same) if len(a) and len(b) else ():
            la, lb = a["label"].to_numpy(object)[i : i + len(s)], b["label"].to_numpy(object)
            none = pd.isna(la)[:, None] | pd.isna(lb)
            equal = la[:, None] == lb
            for category, mask in ((True, ok & ~none & equal), (False, ok & ~none & ~equal), (None, ok & none)):
                x = s[mask]
                if len(x):
                    out.append((category, len(x), x.sum(), x.min(), x.max()))
        return pd.DataFrame(out, columns=["category", "n", "total", "low", "high"])

    parts = _block_pairs(v, run, "category boolean, n long, total double, low double, high double")
    n = F.sum("n")
    return parts.groupBy("category").agg(
        (2 * n).alias("pairs"), F.round(F.sum("total") / n, digits).alias("mean_sim"), F.round(F.round(F.min("low"), 9), digits).alias("min_sim"), F.round(F.round(F.max("high"), 9), digits).alias("max_sim")
    )


def load_vectors(raw: DataFrame, meta: DataFrame, id_col: str, vec_col: str, kind_col: str | None = None) -> dict[str, DataFrame]:
    """Vectors by kind, without those of another size than the metadata row says; none if there is no such row."""
    row = meta.select("dim").first()
    if row is None:
        return {}
    ok = raw.filter(F.size(vec_col) == row["dim"]).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), *([kind_col] if kind_col else []))
    if not kind_col:
        return {"all": ok}
    return {k: ok.filter(F.col(kind_col) == k).drop(kind_col) for k in ("han", "ko")}


def embed(df: DataFrame, text_col: str, embedder, out: str = "vec", most: int = 512) -> DataFrame:
    """Vectors of texts by a plug-in, ``embedder(list of texts) -> list of vectors``, in Arrow batches."""
    @F.pandas_udf("array<float>")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series(list(embedder(["" if x is None else x[:most] for x in t])))

    return df.withColumn(out, run(F.col(text_col)))


def check_embeddings(vectors: DataFrame, expected: int, dim: int) -> dict[str, bool]:
    """Whether there are as many vectors as there should be, all of one size."""
    r = vectors.agg(F.count("*").alias("n"), F.coalesce(F.min(F.size("vec")), F.lit(dim)).alias("a"), F.coalesce(F.max(F.size("vec")), F.lit(dim)).alias("b")).first()
    return {"count": r["n"] == expected, "dim": r["a"] == dim == r["b"]}
