"""Reciprocal-rank fusion, and hybrid retrieval over several ranked arms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 60
WEIGHTS = {"han": 2.0, "reading": 3.0, "ko": 2.0, "vec_han": 1.0, "vec_ko": 1.5}


def ranked(hits: DataFrame, order: list, id_col: str = "id") -> DataFrame:
    """(item, rank) of one arm's bounded list of hits, in a total order."""
    w = Window.partitionBy(F.lit(0)).orderBy(*order)
    return hits.select(F.col(id_col).alias("item"), F.row_number().over(w).alias("rank"))


def weighted_rrf(ranks: DataFrame, k: int = K, by: list[str] | None = None, digits: int = 12) -> DataFrame:
    """(item, score) from (item, rank, weight): the sum of weight / (k + rank), best first."""
    if k <= 0:
        raise ValueError("k must be positive")
    s = F.round(F.sum(F.col("weight") / (F.lit(k) + F.col("rank"))), digits)
    return ranks.groupBy(*(by or []), "item").agg(s.alias("score"))


def rrf(ranks: DataFrame, k: int = K, by: list[str] | None = None) -> DataFrame:
    return weighted_rrf(ranks.withColumn("weight", F.lit(1.0)), k, by)


def sort_fused(fused: DataFrame, limit: int | None = None) -> DataFrame:
    out = fused.orderBy(F.desc("score"), "item")
    return out if limit is None else out.limit(limit)


def fuse(arms: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = K) -> DataFrame:
    """Fused (item, score) of arms, each (item, rank), in one plan."""
    w = WEIGHTS | (weights or {})
    parts = [a.select("item", "rank", F.lit(float(w.get(n, 1.0))).alias("weight")) for n, a in arms.items()]
    return weighted_rrf(reduce(DataFrame.unionByName, parts), k)


def hybrid(arms: dict[str, DataFrame], passages: DataFrame, limit: int = 20, weights: dict[str, float] | None = None, k: int = K, strict: Column | None = None) -> DataFrame:
    """The best ``limit`` items with their rows.

    The limit holds before rows are looked up, so items without one shorten the result. ``strict`` filters
    all arms alike; without it only those arms are filtered that were when they were made.
    """
    if strict is not None:
        ok = passages.filter(strict).select(F.col("id").alias("item"))
        arms = {n: a.join(ok, "item", "left_semi") for n, a in arms.items()}
    best = sort_fused(fuse(arms, weights, k), limit)
    return best.join(passages.withColumnRenamed("id", "item"), "item").withColumn("score", F.round("score", 6))
