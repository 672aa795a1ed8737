"""Near-duplicate detection with HyperMinHash.

A document's set of word shingles is hashed into ``REGISTERS`` buckets. A bucket's smallest hash is kept
as a register of 16 bits: its count of leading zeros and the ``MANTISSA`` bits that follow. Bands of
``ROWS`` registers, with empty ones filled from another bucket that a fixed random order picks, are the
keys under which documents meet (a pair at the threshold of 0.8 misses all bands with a chance of
3e-6). The share of equal registers, corrected for the collisions that compression makes, estimates the
Jaccard similarity; pairs that are well below the threshold go, and the others are verified on full sets.

Copies do not make pairs: documents with equal sets are one *node*. Within a band's bucket each node is
compared with a pivot, which differs from bucket to bucket, and verified with the best of its pivots; the links
give components, and a further round with other pivots joins most of what is left. Only where a bucket still
holds nodes of different components are those compared pair by pair, in blocks of ``BLOCK`` nodes that are dealt
to different tasks: registers first, and then full sets of the nodes that an estimate puts near the threshold. A
link becomes a row only if it joins what the task has not joined yet. So no component is lost and no group emits
all its pairs.

Sets are never all stored: texts are read again for the nodes of candidate pairs only.

Defined results: a document without words has an empty set and is linked with nothing; one with fewer
words than a shingle has its whole sequence. A null id is smaller than nothing: it is never a component's
id unless all ids are null, and then component_id is null. Rows that repeat an id keep their own texts;
``kept`` holds for each row whose id is the component's. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if, discard, materialize, table
from .graph import components

REGISTERS, ROWS, MANTISSA = 252, 6, 10
BANDS = REGISTERS // ROWS
PIVOT_ROUNDS, BLOCK = 2, 256
BROADCAST_ROWS = 500_000
_CACHE = 200_000
_FILL = np.random.default_rng(7).random((REGISTERS, REGISTERS)).astype(np.float32)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hash of a word, remembered for the most recent words."""

    def __missing__(self, w):
        if len(self) >= _CACHE:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


def shingle_set(text: str | None, k: int, seen: _Words) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text."""
    ws = (text or "").encode("utf-8", "replace").lower().split()
    n = len(ws)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(seen.__getitem__, ws), np.uint64, n)
    size = min(k, n)
    x = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[j : n - size + 1 + j])
    return np.unique(x)


def sketch(s: np.ndarray) -> np.ndarray:
    """Registers of a set; 0 is empty."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(s):
        bucket = ((s >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)  # ascending, as s is
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        v = np.minimum.reduceat(_mix(s + np.uint64(0x632BE59BD9B4E019)), starts)
        zeros = 64 - np.frexp(v.astype(np.float64))[1]
        zeros = np.clip(zeros, 0, 61).astype(np.uint64)
        mantissa = (v << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
        out[bucket[starts]] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out


def filled(regs: np.ndarray) -> np.ndarray:
    """Empty registers take the value of the non-empty one that comes first in their own order."""
    full, gaps = np.flatnonzero(regs), np.flatnonzero(regs == 0)
    if len(gaps) and len(full):
        regs = regs.copy()
        regs[gaps] = regs[full[_FILL[np.ix_(gaps, full)].argmin(1)]]
    return regs


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard of register rows, and the number of buckets it rests on."""
    used = ((a > 0) | (b > 0)).sum(1)
    same = ((a == b) & (a > 0)).sum(1)
    la, lb = na[:, None] / REGISTERS, nb[:, None] / REGISTERS
    lo = 2.0 ** -np.arange(1.0, 48.0)[None, :]
    width = lo * 2.0**-MANTISSA
    # chance that the minima of two independent buckets get the same register
    hit = (width * la * lb / (la + lb) * (np.exp(-(la + lb) * lo) - np.exp(-(la + lb) * 2 * lo))).sum(1)
    return np.clip((same / np.maximum(used, 1) - hit) / (1 - hit), 0, 1), used


def _signed(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, th, n, fp (128 bits of the set), regs (filled) and mask of the empty ones."""
    kind = dict(docs.dtypes)[id_col]
    names = ["doc_id", "th", "n", "fp", "regs", "mask"]

    def run(batches):
        seen = _Words()
        for b in batches:
            n, fp, regs, mask = [], [], [], []
            for t in b.column(2).to_pylist():
                s = shingle_set(t, k, seen)
                r = sketch(s)
                n.append(len(s))
                fp.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
                regs.append(filled(r).tobytes())
                mask.append(np.packbits(r > 0).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(regs, pa.binary()), pa.array(mask, pa.binary())], names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"doc_id {kind}, th long, n long, fp binary, regs binary, mask binary")


def _likely(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, est): the pairs whose estimate does not rule them out."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            c = lambda i: np.array(b.column(i).to_pylist(), float)
            est, used = estimate(_registers(b.column(2).to_pylist(), b.column(3).to_pylist()), _registers(b.column(5).to_pylist(), b.column(6).to_pylist()), c(4), c(7))
            keep = pa.array(_keep(est, used, threshold))
            yield from pa.table([b.column(0), b.column(1), pa.array(est)], ["a", "b", "est"]).filter(keep).to_batches()

    side = lambda x: nodes.select(F.col("fp").alias(x), F.col("regs").alias(f"r{x}"), F.col("mask").alias(f"m{x}"), F.col("n").alias(f"n{x}"))
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    j = j.filter(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold) - 1e-9)
    return j.select("a", "b", "ra", "ma", "na", "rb", "mb", "nb").mapInArrow(run, "a binary, b binary, est double")


def _registers(filled_rows, masks) -> np.ndarray:
    """Register rows, 0 where a bucket is empty."""
    n = len(filled_rows)
    return np.frombuffer(b"".join(filled_rows), np.uint16).reshape(n, -1) * np.unpackbits(np.frombuffer(b"".join(masks), np.uint8).reshape(n, -1), axis=1)[:, :REGISTERS]


def _keep(est: np.ndarray, used: np.ndarray, threshold: float) -> np.ndarray:
    """Not ruled out: within five standard deviations, and a bucket or two for small sets."""
    used = np.maximum(used, 1)
    return est >= threshold - 5 * np.sqrt(threshold * (1 - threshold) / used) - 2 / used


class _Block:
    """The rows of one task: two blocks of a large bucket, or some small buckets, in the order of their keys."""

    def __init__(self, pdf: pd.DataFrame):
        self.rows = pdf = pdf.sort_values(["key", "fp"], ignore_index=True)
        self.bands = np.frombuffer(b"".join(pdf["regs"]), np.uint16).reshape(len(pdf), BANDS, ROWS)
        self.regs = _registers(pdf["regs"], pdf["mask"])
        self.n, self.i, self.x, self.y, self.band, key = (pdf[c].to_numpy() for c in ("n", "i", "x", "y", "band", "key"))
        self.group = pd.factorize(pdf["label"])[0]
        self.cut = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(pdf)]

    def near(self, threshold: float):
        """(row, rows): the pairs of a bucket that are of unlike group and not ruled out.

        A pair that also meets under an earlier band is left to that band's bucket. ``group`` may change meanwhile.
        """
        n, regs, group = self.n, self.regs, self.group
        for start, end in zip(self.cut[:-1], self.cut[1:]):
            at = np.arange(start, end)
            one = self.x[start] == self.y[start]
            left, second = at[self.i[at] == self.x[start]], at[self.i[at] == self.y[start]]
            for k, r in enumerate(left):
                right = left[k + 1 :] if one else second
                right = right[(group[right] != group[r]) & (np.minimum(n[right], n[r]) >= np.maximum(n[right], n[r]) * threshold - 1e-9)]
                if not len(right):
                    continue
                other = regs[right]
                same, used = ((other == regs[r]) & (other > 0)).sum(1), ((other > 0) | (regs[r] > 0)).sum(1)
                right = right[_keep(same / np.maximum(used, 1), used, threshold)]  # the correction only lowers an estimate
                if len(right):
                    est, used = estimate(np.broadcast_to(regs[r], (len(right), REGISTERS)), regs[right], np.full(len(right), float(n[r])), n[right].astype(float))
                    met = (self.bands[right, : self.band[r]] == self.bands[r, : self.band[r]]).all(2).any(1)
                    right = right[_keep(est, used, threshold) & ~met]
                if len(right):
                    yield r, right


def _links_in_blocks(mixed: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Verified links (a, b) between nodes of unlike label in the buckets of ``mixed`` (key, band, fp, label, c).

    A task holds two blocks of a bucket of more than BLOCK nodes, or some smaller buckets. Registers alone are dealt
    to all of them; full sets follow only for the nodes that are near another one there. A link is a row only if it
    joins what was not joined before, so a block of n nodes makes fewer than n rows.
    """
    threshold = percent / 100
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    lanes = mixed.filter(F.col("c") <= BLOCK).count() // (4 * BLOCK) + 1
    m = mixed.join(nodes.select("fp", "regs", "mask", "n"), "fp").withColumn("i", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
    m = m.withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("x", F.least("i", "j")).withColumn("y", F.greatest("i", "j"))
    m = m.withColumn("pack", F.when(F.col("c") <= BLOCK, F.pmod(F.xxhash64("key"), F.lit(lanes))).otherwise(F.col("key")))
    names = ["pack", "key", "x", "y", "band", "i", "fp", "label", "regs", "mask", "n"]
    kinds = "pack long, key long, x int, y int, band int, i int, fp binary, label binary, regs binary, mask binary, n long"

    def close(pdf):
        block = _Block(pdf)
        some = np.zeros(len(pdf), bool)
        for r, right in block.near(threshold):
            some[r] = True
            some[right] = True
        return block.rows[some]

    few = materialize(m.select(*names).groupBy("pack", "x", "y").applyInPandas(close, kinds), "close")
    sets = _sets(few.select("fp").distinct(), nodes, docs, k, id_col, text_col)

    def compare(pdf):
        block = _Block(pdf.drop_duplicates(["key", "fp"]))
        fp, s, group = block.rows["fp"].to_numpy(), [np.asarray(v) for v in block.rows["s"]], block.group
        out = []
        for r, right in block.near(threshold):
            for q in right:
                if group[q] != group[r]:
                    both = len(np.intersect1d(s[r], s[q], assume_unique=True))
                    if 100 * both >= percent * (len(s[r]) + len(s[q]) - both):
                        out.append((min(fp[r], fp[q]), max(fp[r], fp[q])))
                        group[group == group[q]] = group[r]
        return pd.DataFrame(out, columns=["a", "b"])

    found = materialize(few.join(sets, "fp").select(*names, "s").groupBy("pack", "x", "y").applyInPandas(compare, "a binary, b binary").distinct(), "joined")
    discard(few, sets)
    return found


def _sets(need: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(fp, s): the full sets of some nodes, from their texts. A row that is there several times may give some alike."""
    need = materialize(need.join(nodes.select("fp", "rep"), "fp").select("fp", F.struct(F.col("rep.doc_id").alias("doc_id")).alias("rid"), F.col("rep.th").alias("rth")), "need")

    def run(batches):
        seen, given = _Words(), set()
        for b in batches:
            fresh = [i for i, f in enumerate(b.column(0).to_pylist()) if not (f in given or given.add(f))]
            if fresh:
                b = b.take(pa.array(fresh))
                sets = [shingle_set(t, k, seen).view(np.int64) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["fp", "s"])

    rows = docs.select(F.struct(F.col(id_col).alias("doc_id")).alias("rid"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("rth"), F.col(text_col).alias("t"))
    texts = rows.join(broadcast_if(need, need.count(), BROADCAST_ROWS), ["rid", "rth"]).select("fp", "t")
    sets = materialize(texts.mapInArrow(run, "fp binary, s array<long>"), "sets")
    discard(need)
    return sets


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    need = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    sets = _sets(need, nodes, docs, k, id_col, text_col)
    side = lambda x: sets.select(F.col("fp").alias(x), F.col("s").alias(f"s{x}"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    j = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb")).alias("t"))
    found = materialize(j.filter(F.col("i") * 100 >= (F.col("t") - F.col("i")) * percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "verified")
    discard(sets)
    return found


def links(docs: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(signed rows, nodes, verified links between nodes that hold every component together, labels of linked nodes)."""
    signed = materialize(_signed(docs, k, id_col, text_col), "sketches")
    # equal sets are one node, told by the first id that has it
    nodes = materialize(
        signed.filter("fp is not null").groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th")).alias("rep"), F.first("regs").alias("regs"), F.first("mask").alias("mask"), F.first("n").alias("n")), "nodes"
    )
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("regs"), i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    placed = nodes.select("fp", F.posexplode(band).alias("band", "key"))
    # only keys that meet; the others are most
    # (sums are written before they are joined back, so that Spark can split a large bucket's rows in the join)
    met = materialize(placed.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "keys")
    placed = materialize(placed.join(met, "key").select("key", "band", "fp", "c"), "bands")
    discard(met, shuffles=True)
    label = edges = done = None
    for r in range(PIVOT_ROUNDS + 1):
        if label is None:
            at = placed.withColumn("label", F.col("fp"))
        else:
            at = placed.join(label.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
            mixed = at.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.min("fp").alias("a"), F.max("fp").alias("b"), F.max("c").alias("n")).filter("l0 <> l1")
            # a bucket of two that have been compared holds nothing more
            mixed = materialize(mixed.join(done.withColumn("n", F.lit(2).cast("long")), ["a", "b", "n"], "left_anti").select("key"), "keys")
            at = materialize(at.join(mixed, "key"), "mixed")
            discard(mixed)
        if r == PIVOT_ROUNDS:
            new = _links_in_blocks(at, nodes, docs, k, percent, id_col, text_col)
        else:
            pivot = materialize(at.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(r), "key", "fp").alias("o"), "fp", "label")).alias("p")), "pivots")
            pairs = materialize(at.join(pivot, "key").filter(F.col("label") != F.col("p.label")).select(F.col("fp").alias("a"), F.col("p.fp").alias("b")).distinct(), "pairs")
            likely = materialize(_likely(pairs, nodes, percent / 100), "likely")
            # a node is verified with its best pivot only; what that leaves apart meets again
            best = materialize(likely.groupBy("a").agg(F.max(F.struct("est", "b")).alias("x")).select("a", F.col("x.b").alias("b")), "best")
            new = _verified(best, nodes, docs, k, percent, id_col, text_col)
            undirected = lambda d: d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            over = undirected(pairs.join(likely.select("a", "b"), ["a", "b"], "left_anti").unionByName(best))
            before, done = done, materialize((over if done is None else over.unionByName(done)).distinct(), "done")
            discard(pivot, pairs, likely, best, before)
        if label is None:
            edges, label = new, components(new)
        else:
            # new links join classes: components of the classes, not of all nodes again
            discard(at, shuffles=True)
            old = label
            of = lambda x: old.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
            joined = new.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
            top = components(materialize(joined, "classes-joined")).select(F.col("node").alias("label"), F.col("label").alias("top"))
            fresh = new.select(F.col("a").alias("node")).unionByName(new.select(F.col("b").alias("node"))).distinct().join(old, "node", "left_anti").withColumn("label", F.col("node"))
            label = materialize(old.unionByName(fresh).join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")
            edges = edges.unionByName(new)
    discard(placed, done)
    return signed, nodes, edges, label


def classes(docs: DataFrame, k: int = 2, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th, n_shingles, component_id of every row; fp and the component's first text for those with words."""
    signed, nodes, _, label = links(docs, k, percent, id_col, text_col)
    of = nodes.select("fp", "rep").join(label.select(F.col("node").alias("fp"), "label"), "fp", "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    first = of.groupBy("label").agg(F.min("rep").alias("top"))
    of = of.join(first, "label").select("fp", F.col("top.doc_id").alias("top_id"), F.col("top.th").alias("top_th"))
    out = signed.select("doc_id", "th", F.col("n").alias("n_shingles"), "fp").join(materialize(of, "classes"), "fp", "left")
    return out.select("doc_id", "th", "n_shingles", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("top_id")).alias("component_id"), F.coalesce("top_th", "th").alias("top_th"), "fp")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns: one of each class, and every row without words.

    The row that stays has the class's smallest id; of rows alike in id and text one stays.
    """
    c = classes(docs, k, percent, id_col, text_col)
    gone = F.col("fp").isNotNull() & ~(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("top_th")))
    state = materialize(c.select(F.struct("doc_id").alias("rid"), "th", gone.alias("gone"), F.col("fp").isNotNull().alias("set")).groupBy("rid", "th").agg(F.max("gone").alias("gone"), F.count("*").alias("rows"), F.max("set").alias("set")), "state")
    row = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("r"), F.struct(F.col(f"`{id_col}`").alias("doc_id")).alias("rid"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("th"))
    bad = materialize(state.filter("gone or (set and rows > 1)").select("rid", "th", "gone"), "gone")
    n = bad.count()
    kept = row.join(broadcast_if(bad, n, BROADCAST_ROWS), ["rid", "th"], "left")
    single = kept.filter("gone is null").select("r")
    # rows alike in id and text, of which one is to stay
    again = kept.filter("not gone").groupBy("rid", "th").agg(F.first("r").alias("r")).select("r")
    return single.unionByName(again).select("r.*")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = classes(table(spark, sf_dir, "documents"))
    return c.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, w[i] || coalesce(' ' || w[i + 1], '') AS s FROM (SELECT *, unnest(range(1, greatest(2, len(w)))) AS i FROM w WHERE len(w) > 0)),
sets AS (SELECT rid, list_sort(list(s)) AS ss, count(*) AS n FROM s GROUP BY rid),
node AS (SELECT md5(array_to_string(ss, chr(10))) AS node, min(rid) AS rid, min(n) AS n FROM sets GROUP BY 1),
ns AS (SELECT node.node, node.n, s.s FROM node JOIN s USING (rid)),
c AS (SELECT a.node AS a, b.node AS b, a.n AS na, b.n AS nb, count(*) AS i FROM ns a JOIN ns b ON a.s = b.s AND a.node < b.node AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM c WHERE 100 * i >= 80 * (na + nb - i)),
sym AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT node AS a, node AS b FROM node UNION SELECT r.a, sym.b FROM reach r JOIN sym ON r.b = sym.a),
ids AS (SELECT md5(array_to_string(ss, chr(10))) AS node, w.rid, w.doc_id, n FROM sets JOIN w USING (rid)),
low AS (SELECT r.a AS node, min(doc_id) AS component_id FROM reach r JOIN ids ON ids.node = r.b GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(ids.n, 0) AS BIGINT) AS n_shingles, CASE WHEN ids.node IS NULL THEN w.doc_id ELSE component_id END AS component_id,
       coalesce(w.doc_id = CASE WHEN ids.node IS NULL THEN w.doc_id ELSE component_id END, false) AS kept
FROM w LEFT JOIN ids USING (rid) LEFT JOIN low ON ids.node = low.node
"""
