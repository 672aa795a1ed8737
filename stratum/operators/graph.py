"""Co-occurrence of entities in units: ego networks, degrees, pairs and Jaccard similarity.

Mentions are rows of a unit column (an article or a paragraph) and an entity column, with a type if
asked for. Each operator first narrows to the seed's units by a semi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scopes by name and the unit column of each.
SCOPES = {"article": "node_id", "paragraph": "passage_id"}


def scope_column(scope: str) -> str:
    if scope not in SCOPES:
        raise ValueError(f"no scope {scope!r}; there are {', '.join(SCOPES)}")
    return SCOPES[scope]


def neighbours(mentions: DataFrame, unit: str, entity: str, targets: DataFrame, limit: int | None = 50, keep: Column | None = None) -> DataFrame:
    """(entity, cooc): entities in units with any target, by the number of those units; targets themselves are left out.

    ``targets`` has the column ``entity``.
    """
    m = mentions.select(F.col(unit).alias("unit"), F.col(entity).alias("entity"), *([] if keep is None else [keep.alias("keep")]))
    units = m.join(targets.select("entity"), "entity", "left_semi").select("unit").distinct()
    near = m if keep is None else m.filter("keep")
    out = near.join(units, "unit", "left_semi").join(targets.select("entity"), "entity", "left_anti").select("unit", "entity").distinct().groupBy("entity").agg(F.count("*").alias("cooc"))
    return out if limit is None else out.orderBy(F.desc("cooc"), "entity").limit(limit)


def ego(mentions: DataFrame, unit: str, entity: str, seed: DataFrame, min_cooc: int = 2, limit: int = 200) -> tuple[DataFrame, Column]:
    """The seed's neighbours with ``cooc`` of at least min_cooc, best first; and whether more were there."""
    every = neighbours(mentions, unit, entity, seed, None).filter(F.col("cooc") >= min_cooc).orderBy(F.desc("cooc"), "entity").limit(limit + 1)
    n = every.count()
    return every.orderBy(F.desc("cooc"), "entity").limit(limit), n > limit


def degrees(mentions: DataFrame, unit: str, entity: str, members: DataFrame) -> DataFrame:
    """(entity, degree): units of each member."""
    m = mentions.select(F.col(unit).alias("unit"), F.col(entity).alias("entity"))
    return m.join(members.select("entity"), "entity", "left_semi").distinct().groupBy("entity").agg(F.count("*").alias("degree"))


def pairs(mentions: DataFrame, unit: str, entity: str, members: DataFrame, min_cooc: int = 1) -> DataFrame:
    """(a, b, cooc), a < b: members that share at least min_cooc units. The join is an equi-join on the unit."""
    m = mentions.select(F.col(unit).alias("unit"), F.col(entity).alias("entity")).join(members.select("entity"), "entity", "left_semi").distinct()
    a, b = m.select("unit", F.col("entity").alias("a")), m.select("unit", F.col("entity").alias("b"))
    out = a.join(b, "unit").filter(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count("*").alias("cooc"))
    return out.filter(F.col("cooc") >= min_cooc)


def jaccard(pair: DataFrame, degree: DataFrame, digits: int = 12) -> DataFrame:
    """(a, b, cooc, sim): shared units over all units of either."""
    da, db = degree.select(F.col("entity").alias("a"), F.col("degree").alias("da")), degree.select(F.col("entity").alias("b"), F.col("degree").alias("db"))
    sim = F.col("cooc") / (F.col("da") + F.col("db") - F.col("cooc"))
    return pair.join(da, "a").join(db, "b").select("a", "b", "cooc", F.round(sim, digits).alias("sim"))


def local_graph(mentions: DataFrame, unit: str, entity: str, seed: DataFrame, min_cooc: int = 2, limit: int = 200) -> tuple[DataFrame, DataFrame, bool]:
    """(members with the seed, edges with similarity, truncated)."""
    near, more = ego(mentions, unit, entity, seed, min_cooc, limit)
    members = near.select("entity").unionByName(seed.select("entity")).distinct()
    return members, jaccard(pairs(mentions, unit, entity, members, min_cooc), degrees(mentions, unit, entity, members)), more
