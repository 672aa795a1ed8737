"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the text are cut into bins at quantiles of the training rows. Cyclic boosting visits one
feature after the other and fits a shallow tree (a few leaves over the feature's bins) to the gradient
of the log loss; the trees of a feature add up to one lookup table. Then the pairs of features whose
two-dimensional cuts lower the loss most get tables of their own, boosted in the same way. A score is
the sigmoid of an intercept plus one table entry for each feature and pair: vectorised bin additions.

Learning reads labels only from rows whose crc32(doc_id as text) mod 4 is not 2, and a bounded sample
of those: the ``SAMPLE_ROWS`` labelled ids with the smallest hash. Every whole text is scored. Labels,
lang, source and doc_id are never features.

Defined results: a null text is scored as the empty one, which has features like any other. Repeated
rows get equal scores, one result for each row. Labels that are null, and ids without a text row, teach
nothing; a repeated label counts as often as it is there. Without labels, or with one class only, the
score is the smoothed share of label 1 (0.5 without any). A null doc_id is held in. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shipped, table

SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
BINS, PAIRS, PAIR_BINS = 24, 6, 6
FEATURES = (
    "log_words", "word_length", "letter_share", "upper_share", "digit_share", "symbol_share", "stop_share",
    "distinct_share", "repeat_share", "top_word_share", "pipe_share", "long_word_share", "line_words", "byte_entropy",
)
_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 white, 5 sentence signs, 6 symbols, 7 beyond ASCII
for _b in range(256):
    _ch = chr(_b)
    _CLASS[_b] = 7 if _b > 127 else 1 if _ch.islower() else 2 if _ch.isupper() else 3 if _ch.isdigit() else 4 if _ch in " \t\n\r\x0b\x0c" else 5 if _ch in ".,;:!?'\"()-" else 6 if 32 < _b < 127 else 0


def features(text: str | None) -> np.ndarray:
    """The feature vector of one whole text."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if n else np.zeros(256, np.int64)
    kind = np.bincount(_CLASS, weights=by, minlength=8)
    words = raw.split()
    k = len(words)
    out = np.zeros(len(FEATURES))
    if not k:
        return out
    solid = max(1.0, n - kind[4])
    distinct: dict[bytes, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    repeats = sum(map(bytes.__eq__, words[1:], words[:-1]))
    p = by[by > 0] / n
    lines = raw.count(b"\n") + 1
    out[:] = (
        np.log1p(k), solid / k, (kind[1] + kind[2] + kind[7]) / solid, kind[2] / solid, kind[3] / solid, kind[6] / solid, kind[5] / solid,
        np.log(len(distinct)) / np.log(k) if k > 1 else 1.0, repeats / k, max(distinct.values()) / k, by[124] / k, sum(len(w) > 20 for w in distinct) / len(distinct), np.log1p(k / lines), -(p * np.log2(p)).sum(),
    )
    return out


class Gam:
    """Cut points, lookup tables of features and pairs, and an intercept."""

    def __init__(self, cuts, tables, pairs, intercept):
        self.cuts, self.tables, self.pairs, self.intercept = cuts, tables, pairs, intercept

    def score(self, x: np.ndarray) -> np.ndarray:
        x = np.where(np.isfinite(x), x, 0.0)
        bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]
        z = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            z += t[bins[j]]
        for a, b, ca, cb, t in self.pairs:
            z += t[np.searchsorted(ca, x[:, a], side="right"), np.searchsorted(cb, x[:, b], side="right")]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _quantile_cuts(v: np.ndarray, bins: int) -> np.ndarray:
    u = np.unique(np.quantile(v, np.arange(1, bins) / bins, method="lower"))
    return u[u > v.min()] if len(v) else u


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, l2: float) -> np.ndarray:
    """Values by bin of a tree over ordered bins, grown best split first."""
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + l2)

    def best(a, b):
        m = np.arange(a + 1, b)
        if not len(m):
            return (0.0, a)
        v = gain(a, m) + gain(m, b) - gain(a, b)
        return (float(v.max()), int(m[v.argmax()]))

    parts = [(0, len(g), *best(0, len(g)))]
    while len(parts) < leaves:
        k = max(range(len(parts)), key=lambda i: parts[i][2])
        a, b, v, m = parts[k]
        if v <= 1e-9:
            break
        parts[k : k + 1] = [(a, m, *best(a, m)), (m, b, *best(m, b))]
    out = np.empty(len(g))
    for a, b, _, _ in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + l2)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2, leaves: int = 3, l2: float = 5.0) -> Gam:
    """Cyclic boosting of the single features, then of the chosen pairs."""
    n, d = x.shape
    share = (y.sum() + 1.0) / (n + 2.0)
    intercept = float(np.log(share / (1 - share)))
    x = np.where(np.isfinite(x), x, 0.0)
    cuts = [_quantile_cuts(x[:, j], BINS) if n else np.empty(0) for j in range(d)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    if n == 0 or y.min() == y.max():
        return Gam(cuts, tables, [], intercept)
    bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]
    z = np.full(n, intercept)

    def slopes():
        p = 1.0 / (1.0 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(d):
            g, h = slopes()
            m = len(tables[j])
            t = rate * _tree(np.bincount(bins[j], g, m), np.bincount(bins[j], h, m), leaves, l2)
            tables[j] += t
            z += t[bins[j]]
    coarse = [_quantile_cuts(x[:, j], PAIR_BINS) for j in range(d)]
    small = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(coarse)]
    g, h = slopes()
    gains = []
    for a in range(d):
        for b in range(a + 1, d):
            m = (len(coarse[a]) + 1, len(coarse[b]) + 1)
            at = small[a] * m[1] + small[b]
            gg, hh = np.bincount(at, g, m[0] * m[1]), np.bincount(at, h, m[0] * m[1])
            gains.append((float((gg**2 / (hh + l2)).sum()), a, b))
    pairs = [[a, b, coarse[a], coarse[b], np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))] for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    for _ in range(rounds // 2):
        for p in pairs:
            g, h = slopes()
            shape = p[4].shape
            at = small[p[0]] * shape[1] + small[p[1]]
            gg, hh = np.bincount(at, g, p[4].size).reshape(shape), np.bincount(at, h, p[4].size).reshape(shape)
            # a tree of depth two: the better first axis, then each side cut on the other
            rows = _tree(gg.sum(1), hh.sum(1), 2, l2)
            t = np.empty(shape)
            for v in np.unique(rows):
                side = rows == v
                t[side] = _tree(gg[side].sum(0), hh[side].sum(0), 2, l2)
            t *= rate
            p[4] += t
            z += t.ravel()[at]
    return Gam(cuts, tables, [tuple(p) for p in pairs], intercept)


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % folds == fold, F.lit(False))


def _featured(rows: DataFrame, keep: str) -> DataFrame:
    """(text, other columns) to (other columns, f array<double>)."""
    names = [c for c in rows.columns if c != "text"]

    def run(batches):
        for b in batches:
            f = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(f, pa.list_(pa.float64()))], [*names, "f"])

    return rows.mapInArrow(run, f"{keep}, f array<double>")


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_ROWS) -> Gam:
    """A model from at most ``sample`` labelled rows, of those not held out."""
    known = labels.filter(F.col(target).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(
        F.col(id_col).alias("id"), F.col(target).cast("int").alias("y")
    )
    few = known.orderBy(F.xxhash64(F.col("id").cast("string")), "id", "y").limit(sample)
    rows = docs.join(F.broadcast(few), F.col(id_col) == F.col("id")).select(F.col(text_col).alias("text"), "y", F.xxhash64(F.col("id").cast("string")).alias("o"))
    got = _featured(rows, "y int, o long").orderBy("o", "y", "f").limit(2 * sample).toPandas()
    x = np.array(got["f"].tolist(), float).reshape(len(got), len(FEATURES))
    return fit(x, (got["y"].to_numpy() > 0).astype(float))


def scored(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    sent = Shipped(docs.sparkSession, model)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        model = sent.get()
        for b in batches:
            f = np.array([features(t) for t in b.column(1).to_pylist()], float).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(f), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    out = scored(docs, train(docs, labels, **kw))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs``, with their columns, that the classifier accepts."""
    sent = Shipped(docs.sparkSession, train(docs, labels, text_col=text_col, **kw))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = sent.get()
        for text in parts:
            yield pd.Series(model.score(np.array([features(t) for t in text], float).reshape(len(text), len(FEATURES))))

    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), F.col(f"`{text_col}`").alias("t"))
    return row.filter(score("t") >= THRESHOLD).select("r.*")


def op3_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = None
