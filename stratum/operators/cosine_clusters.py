"""Fuzzy density clustering of vectors by cosine, without a table of their similar pairs.

The clusters are those of ``clustering.fdbscan_batch`` over all pairs of vectors, whose number grows with the
square of the vectors. Here the vectors are dealt to pairs of blocks (``deal_pairs``), and three passes
keep of each pair of blocks no more than the rows they need: the densities of its vectors, then the classes of
connected cores within one block, then what joins classes of two blocks and how similar a border point is to a
class. Cosines are whole numbers of 1e-9, so sums are exact and do not rest on an order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clustering import fdbscan_batch, members_of
from .components import components
from .storage import cut_lineage, written
from .vectors import TILE, WIDE, blocks_of, cosines_in_order, deal, deal_pairs, one_size, similar_pairs, tame, two_sides, unit_rows

#: Cosines are counted in this unit.
UNIT = 1_000_000_000


def _least(x: float) -> int:
    """The smallest positive number of units that reaches ``x``, which is compared after rounding to 12 decimals."""
    return max(1, -(-round(x * 1e12) // (10**12 // UNIT)))


class _Block:
    """The rows of a block in the order of their ids."""

    def __init__(self, t: pa.Table) -> None:
        t = t.take(pc.sort_indices(t, [("id", "ascending")])).combine_chunks()
        self.table, self.ids, self.n = t, t["id"].combine_chunks(), t.num_rows
        self.vec, self.length, self.unit = unit_rows(t["vec"])

    def column(self, name: str, width: int) -> pa.Array:
        a = self.table[name].combine_chunks()
        assert len(a) == 0 or pc.all(pc.equal(pc.list_value_length(a), width)).as_py()
        return a.flatten()

    def densities(self, width: int) -> np.ndarray:
        return self.column("rho", width).to_numpy(zero_copy_only=False).reshape(self.n, width)

    def tops(self, width: int) -> np.ndarray:
        """The place in the block of the first core of each row's class, by candidate; -1 where the row is no core."""
        at = pc.fill_null(pc.index_in(self.column("top", width), value_set=self.ids, skip_nulls=True), -1)
        return at.to_numpy(zero_copy_only=False).reshape(self.n, width)


def _near(a: _Block, b: _Block, rows, j: int, least: int):
    """(p, q, units): rows of a (of ``rows``, a slice or places) and of b (from j) whose cosine is ``least`` units or more."""
    u = a.unit[rows]
    s = u @ b.unit[j : j + WIDE].T
    at = np.flatnonzero(s > (least - 1) / UNIT)
    p, q = np.divmod(at, s.shape[1])
    r = s.ravel()[at] * UNIT
    n = np.floor(r)
    r -= n
    # a product of matrices adds in another order: where that could change the rounding, once more in order
    close = np.flatnonzero(np.abs(r - 0.5) < 4e-16 * UNIT * (u.shape[1] + 8)) if tame(a.length, b.length) else np.arange(len(at))
    n += r >= 0.5
    p = np.arange(a.n)[rows][p]
    q += j
    if len(close):
        x = cosines_in_order(a, b, p[close], q[close]) * UNIT
        n[close] = np.where(np.isfinite(x), np.floor(np.nan_to_num(x)) + (np.nan_to_num(x) % 1 >= 0.5), 0)
    keep = n >= least
    return p[keep], q[keep], n[keep].astype(np.int64)


def _tiles(a: _Block, b: _Block, same: bool, least: Callable[[], int]):
    """The pairs of two blocks that are similar enough, each once, tile by tile; ``least`` is asked before each tile."""
    for i in range(0, a.n, TILE):
        for j in range(0, b.n, WIDE):
            if same and j + WIDE <= i:
                continue
            p, q, n = _near(a, b, slice(i, i + TILE), j, least())
            if same:
                k = p < q
                p, q, n = p[k], q[k], n[k]
            yield p, q, n


def _join(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> bool:
    """Makes one class of the classes of p and q in ``label``, in which each node has the first of its class; whether any were two."""
    changed = False
    while True:
        u, v = label[p], label[q]
        two = u != v
        if not two.any():
            return changed
        changed = True
        p, q, u, v = p[two], q[two], u[two], v[two]
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while True:
            far = label[label]
            if (far == label).all():
                break
            label[:] = far


class _Settings:
    """Candidates by the level of their least similarity; levels ascend."""

    def __init__(self, rows: list) -> None:
        self.names = [r["candidate"] for r in rows]
        sims = [_least(r["sim_min"]) for r in rows]
        self.levels = sorted(set(sims))
        self.level = np.array([self.levels.index(s) for s in sims], int)
        self.sim = np.array(sims, np.int64)
        self.mu = np.array([_least(r["mu_min"]) for r in rows], np.int64)

    def cores(self, rho: np.ndarray) -> np.ndarray:
        return rho[:, self.level] >= self.mu


def _densities(v: DataFrame, blocks: int, s: _Settings) -> DataFrame:
    """(id, rho): the units each vector has at each level, of those that have any."""
    kind, levels = dict(v.dtypes)["id"], np.array(s.levels)

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        (x, y), k = (c.as_py() for c in key), len(levels)
        same, (ta, tb) = x == y, two_sides(t, x, y)
        a = _Block(ta)
        b = a if same else _Block(tb)
        one_size(a.vec, b.vec)
        got = [np.zeros((z.n, k), np.int64) for z in ((a,) if same else (a, b))]
        for p, q, n in _tiles(a, b, same, lambda: s.levels[0]):
            top = np.searchsorted(levels, n, "right") - 1
            for out, at in ((got[0], p), (got[-1], q)):
                if len(at):
                    lo, hi = at.min(), at.max() + 1
                    out[lo:hi] += np.bincount((at - lo) * k + top, n, (hi - lo) * k).astype(np.int64).reshape(-1, k)
        out = []
        for z, g in zip((a, b), got):
            g = np.cumsum(g[:, ::-1], 1)[:, ::-1]
            some = np.flatnonzero(g[:, 0])
            out.append(pa.table([z.ids.take(pa.array(some)), *[pa.array(g[some, i]) for i in range(k)]], names=["id", *[f"r{i}" for i in range(k)]]))
        return pa.concat_tables(out)

    schema = f"id {kind}, " + ", ".join(f"r{i} long" for i in range(len(levels)))
    parts = deal_pairs(v.select("id", "vec"), blocks).groupBy("x", "y").applyInArrow(run, schema)
    return parts.groupBy("id").agg(*[F.sum(f"r{i}").alias(f"r{i}") for i in range(len(levels))]).select("id", F.array(*[f"r{i}" for i in range(len(levels))]).alias("rho"))


def _classes(v: DataFrame, blocks: int, s: _Settings) -> DataFrame:
    """``v`` (id, vec, rho) with ``top``: by candidate, the first core that a core is connected with in its block, null if the row is no core."""
    types = dict(v.dtypes)

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        a = _Block(t)
        core = s.cores(a.densities(len(s.levels)))
        label = [np.arange(a.n) for _ in s.names]
        left = {c for c in range(len(s.names)) if core[:, c].sum() > 1}
        for p, q, n in () if not left else _tiles(a, a, True, lambda: min(s.sim[c] for c in left)):
            for c in list(left):
                e = (n >= s.sim[c]) & core[p, c] & core[q, c]
                if e.any() and _join(label[c], p[e], q[e]) and len(set(label[c][core[:, c]].tolist())) == 1:
                    left.discard(c)
            if not left:  # what is one class already needs no more pairs
                break
        at = np.stack([np.where(core[:, c], label[c], -1) for c in range(len(s.names))], 1).ravel()
        top = a.ids.take(pa.array(at, mask=at < 0))
        top = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) + 1, len(s.names)), pa.int32()), top)
        return a.table.select(["id", "vec", "rho"]).append_column("top", top)

    # no two blocks meet here
    return deal(v, blocks).groupBy("block").applyInArrow(run, f"id {types['id']}, vec {types['vec']}, rho array<long>, top array<{types['id']}>")


def _between(v: DataFrame, blocks: int, s: _Settings) -> DataFrame:
    """(candidate, p, a, b, units): classes a and b of two blocks that are connected (p null), and the units that p, no core, has with class a."""
    kind = dict(v.dtypes)["id"]

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        x, y = (c.as_py() for c in key)
        same, (ta, tb) = x == y, two_sides(t, x, y)
        a = _Block(ta)
        b = a if same else _Block(tb)
        c_n, k = len(s.names), len(s.levels)
        tops = {id(z): z.tops(c_n) for z in (a, b)}
        rhos = {id(z): z.densities(k) for z in (a, b)}
        out = []

        def put(c, p, u, v, n):
            out.append(pa.table([pa.array(np.full(len(u), s.names[c], np.int32)), p if p is not None else pa.nulls(len(u), a.ids.type), u, v if v is not None else pa.nulls(len(u), a.ids.type), n if n is not None else pa.nulls(len(u), pa.int64())], names=["candidate", "p", "a", "b", "units"]))

        if not same:
            left = {}
            for c in range(c_n):
                ta, tb = tops[id(a)][:, c], tops[id(b)][:, c]
                ka, kb = np.unique(ta[ta >= 0]), np.unique(tb[tb >= 0])
                if len(ka) and len(kb):
                    left[c] = (ka, kb, np.where(ta >= 0, np.searchsorted(ka, ta), -1), np.where(tb >= 0, np.searchsorted(kb, tb) + len(ka), -1), np.arange(len(ka) + len(kb)))
            graphs = dict(left)
            for p, q, n in _tiles(a, b, False, lambda: min(s.sim[c] for c in left)) if left else ():
                for c, (_, _, na, nb, label) in list(left.items()):
                    e = n >= s.sim[c]
                    u, w = na[p[e]], nb[q[e]]
                    e = (u >= 0) & (w >= 0)
                    if e.any() and _join(label, u[e], w[e]) and not label.any():
                        del left[c]
                if not left:
                    break
            for c, (ka, kb, _, _, label) in graphs.items():
                ids = pa.concat_arrays([a.ids.take(pa.array(ka)), b.ids.take(pa.array(kb))])
                moved = np.flatnonzero(label != np.arange(len(label)))
                put(c, None, ids.take(pa.array(label[moved])), ids.take(pa.array(moved)), None)
        for z, w in ((a, a),) if same else ((a, b), (b, a)):
            rho = rhos[id(z)]
            edge = ~s.cores(rho) & (rho[:, s.level] > 0)
            rows, top = np.flatnonzero(edge.any(1)), tops[id(w)]
            rows = rows if (top >= 0).any() else rows[:0]
            for i in range(0, len(rows), TILE):
                met = [_near(z, w, rows[i : i + TILE], j, s.levels[0]) for j in range(0, w.n, WIDE)]
                p, q, n = (np.concatenate(m) for m in zip(*met))
                if same:
                    p, q, n = (m[p != q] for m in (p, q, n))
                for c in range(c_n):
                    e = (n >= s.sim[c]) & edge[p, c] & (top[q, c] >= 0)
                    if e.any():
                        both, at = np.unique(p[e] * np.int64(w.n) + top[q[e], c], return_inverse=True)
                        units = np.bincount(at, n[e]).astype(np.int64)
                        put(c, z.ids.take(pa.array(both // w.n)), w.ids.take(pa.array(both % w.n)), None, pa.array(units))
        empty = pa.table([pa.array([], x) for x in (pa.int32(), a.ids.type, a.ids.type, a.ids.type, pa.int64())], names=["candidate", "p", "a", "b", "units"])
        return pa.concat_tables([empty, *out])

    return deal_pairs(v, blocks).groupBy("x", "y").applyInArrow(run, f"candidate int, p {kind}, a {kind}, b {kind}, units long")


def cosine_fdbscan_batch(rows: DataFrame, params: DataFrame, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(candidate, point, cluster, membership, core) of every vector that is in a cluster, as ``fdbscan_batch`` gives for all pairs.

    ``params``: candidate, sim_min, mu_min, a stated set. Rows without an id or a vector, and vectors that are not finite, are in no cluster.
    """
    v = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).filter("id is not null and vec is not null")
    n = v.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).first()
    if n["n"] != n["ids"]:  # an id that is there twice has the best of its cosines, which a sum by blocks does not see
        e = cut_lineage(similar_pairs(v, min([r["sim_min"] for r in params.collect()], default=0)))
        return fdbscan_batch(v.select(F.col("id").alias("point")), e, params)
    s = _Settings(params.select("candidate", "sim_min", "mu_min").collect())
    none = F.array(*[F.lit(0).cast("long")] * len(s.levels))
    blocks = blocks_of(n["n"])
    dense = v.join(_densities(v, blocks, s), "id", "left").select("id", "vec", F.coalesce("rho", none).alias("rho"))
    classes = written(_classes(dense, blocks, s), "classes")
    met = written(_between(classes, blocks, s), "met")
    names = F.array(*[F.lit(c).cast("int") for c in s.names])
    core = classes.select(F.col("id").alias("p"), F.posexplode("top").alias("at", "top")).filter("top is not null").select(F.get(names, F.col("at")).alias("candidate"), "p", "top")
    label = components(core.select("candidate", F.col("top").alias("node")), met.filter("p is null").select("candidate", "a", "b"), ["candidate"])
    label = label.withColumnRenamed("node", "top")
    cores = core.join(label, ["candidate", "top"]).select("candidate", "p", "label")
    border = met.filter("p is not null").withColumnRenamed("a", "top").join(label, ["candidate", "top"]).select("candidate", "p", "label", "units")
    return members_of(cores, border, label, "units")


def cosine_fdbscan(rows: DataFrame, sim_min: float, mu_min: float, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(point, cluster, membership, core) for one setting."""
    one = rows.sparkSession.createDataFrame([(0, float(sim_min), float(mu_min))], "candidate int, sim_min double, mu_min double")
    return cosine_fdbscan_batch(rows, one, id_col, vec_col).drop("candidate")
