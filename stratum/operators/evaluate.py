"""Ranking quality: recall, hit rate, reciprocal rank and nDCG for each query, and their means."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_query(ranks: DataFrame, qrels: DataFrame, k: int, by: list[str], digits: int = 9) -> DataFrame:
    """Metrics of each query (columns ``by``) from ranks (by, item, rank) and qrels (query columns, item).

    Queries of ``ranks`` without a relevant item score 0. Relevance is binary; the ideal has min(k, relevant) hits.
    """
    keys = [c for c in by if c in qrels.columns]
    size = qrels.select(*keys, "item").distinct().groupBy(*keys).agg(F.count("*").alias("relevant"))
    j = ranks.join(qrels.select(*keys, "item").distinct().withColumn("rel", F.lit(1)), [*keys, "item"], "left")
    top = (F.col("rank") <= k) & F.col("rel").isNotNull()
    g = j.groupBy(*by).agg(
        F.count(F.when(top, 1)).alias("found"), F.min(F.when(F.col("rel").isNotNull(), F.col("rank"))).alias("first"),
        F.coalesce(F.sum(F.when(top, 1 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("dcg"),
    ).join(size, keys, "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("relevant").cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    none = F.coalesce(F.col("relevant"), F.lit(0)) == 0
    return g.select(
        *by, F.when(none, 0.0).otherwise(F.round(F.col("found") / F.col("relevant"), digits)).alias("recall"), (F.col("found") > 0).cast("int").alias("hit"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), digits).alias("rr"), F.when(none, 0.0).otherwise(F.round(F.col("dcg") / ideal, digits)).alias("ndcg"),
    )


def means(metrics: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """Means of the metrics by group, and over all if ``by`` is empty; 0 for none."""
    m = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), digits)
    return metrics.groupBy(*by).agg(m("recall").alias("recall"), m("hit").alias("hit_rate"), m("rr").alias("mrr"), m("ndcg").alias("ndcg"), F.count("*").alias("queries"))


def by_language_and_overall(metrics: DataFrame, lang: str, arm: str) -> DataFrame:
    """Both tables at once, by grouping sets; a null language is the overall row."""
    out = metrics.groupingSets([[arm, lang], [arm]], arm, lang).agg(*[F.round(F.avg(c), 6).alias(c) for c in ("recall", "hit", "rr", "ndcg")], F.count("*").alias("queries"))
    return out


def pair_similarity(pairs: DataFrame, category: str, sim: str, digits: int = 6) -> DataFrame:
    return pairs.groupBy(category).agg(F.count("*").alias("pairs"), *[F.round(f(sim), digits).alias(f"{n}_sim") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])


def rerank(hits: DataFrame, scorer, query_col: str, text_col: str, top: int, by: str) -> DataFrame:
    """Hits ranked at ``top`` or better, ordered anew by a plug-in ``scorer(queries, texts) -> scores``."""
    @F.pandas_udf("double")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(list(scorer(list(q), list(t))), dtype="float64")

    w = Window.partitionBy(by).orderBy(F.desc("rerank_score"), "item")
    return hits.filter(F.col("rank") <= top).withColumn("rerank_score", run(query_col, text_col)).withColumn("rank", F.row_number().over(w))


def membership_entropy(members: DataFrame, point: str = "point", share: str = "membership") -> DataFrame:
    """(point, entropy) of points that belong to several clusters."""
    e = -F.sum(F.col(share) * F.log(F.col(share)))
    return members.groupBy(point).agg(F.count("*").alias("n"), F.round(e, 9).alias("entropy")).filter("n > 1").select(point, "entropy")
