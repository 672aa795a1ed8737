"""Where an entity occurs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def occurrences(mentions: DataFrame, dims: list[tuple[DataFrame, str]], where: Column, order: list[str], limit: int | None = 100) -> DataFrame:
    """Mentions joined to each (dimension, key), filtered, in a total order. Mentions without a dimension row go."""
    out = mentions
    for d, key in dims:
        out = out.join(d, key)
    out = out.filter(where)
    return out if limit is None else out.orderBy(*order).limit(limit)


def lookup_entity(mention: DataFrame, entity: DataFrame, node: DataFrame, corpus: DataFrame, surface: str, kind: str | None = None, limit: int = 100) -> DataFrame:
    """Occurrences of a surface in path order."""
    e = entity.filter(F.col("surface") == surface)
    if kind is not None:
        e = e.filter(F.col("type") == kind)
    e = e.select(F.col("entity_id"), "type", "surface")
    n = node.select("node_id", "path", "title")
    c = corpus.select("corpus_id", F.col("code").alias("corpus_code"))
    return occurrences(mention, [(e, "entity_id"), (n, "node_id"), (c, "corpus_id")], F.lit(True), ["corpus_code", "path", "char_offset", "mention_id"], limit)
