"""Query expansion by dictionaries: simplified to traditional, readings to surfaces, variant groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions.text import chars

CAP = 16


def options_of(table: DataFrame, char: str = "char", simplified: str = "simplified") -> DataFrame:
    """(simplified, options): the traditional characters of each simplified one, in order."""
    return table.groupBy(simplified).agg(F.sort_array(F.collect_set(char)).alias("options")).withColumnRenamed(simplified, "simplified")


def expand_traditional(queries: DataFrame, q: str, table: DataFrame, cap: int = CAP) -> DataFrame:
    """``queries`` with candidates (array) and changed.

    Characters from left to right multiply the candidates by their options, of which the first ``cap`` stay
    at each step; the query itself is the last. ``table`` is a character table: a few thousand rows.
    """
    m = options_of(table).agg(F.map_from_entries(F.collect_list(F.struct("simplified", "options"))).alias("_m"))
    d = queries.join(F.broadcast(m), F.lit(True))
    opts = lambda c: F.coalesce(F.element_at("_m", c), F.array(c))
    step = lambda acc, c: F.slice(F.flatten(F.transform(acc, lambda a: F.transform(opts(c), lambda o: F.concat(a, o)))), 1, cap)
    cand = F.aggregate(chars(F.col(q)), F.array(F.lit("")), step)
    changed = F.exists(chars(F.col(q)), lambda c: F.element_at("_m", c).isNotNull())
    return d.withColumn("candidates", F.when(F.length(q) > 0, F.array_distinct(F.concat(cand, F.array(q)))).otherwise(F.array().cast("array<string>"))).withColumn("changed", F.when(F.length(q) > 0, changed).otherwise(False)).drop("_m")


def lookup_by_reading(entity: DataFrame, reading: DataFrame, q: Column | str, limit: int | None = 50) -> DataFrame:
    """Entities any of whose adopted readings is q, with their original (and its source) and conventional readings.

    ``entity``: entity_id and more. ``reading``: entity_id, reading, reading_type, source, adopted.
    """
    q = F.lit(q) if isinstance(q, str) else q
    live = reading.filter("adopted")
    hit = live.filter(F.col("reading") == q).select("entity_id").distinct()
    pick = lambda kind, col: F.max(F.when(F.col("reading_type") == kind, F.col(col)))
    both = live.join(hit, "entity_id", "left_semi").groupBy("entity_id").agg(pick("original", "reading").alias("original"), pick("original", "source").alias("original_source"), pick("conventional", "reading").alias("conventional"))
    out = entity.join(both, "entity_id")
    return out if limit is None else out.orderBy("entity_id").limit(limit)


def expand_variants(members: DataFrame, surface: str, name: str = "surface", group: str = "group_id") -> DataFrame:
    """(surface): all names in a group with any entity of this name, or the name alone."""
    groups = members.filter(F.col(name) == surface).select(group).distinct()
    found = members.join(groups, group, "left_semi").select(F.col(name).alias("surface")).distinct()
    alone = found.sparkSession.createDataFrame([(surface,)], "surface string")
    return found.unionByName(alone).distinct()


def variant_pairs(members: DataFrame, name: str = "surface", group: str = "group_id") -> DataFrame:
    """(surface, variant) for every name at once: one hop over shared groups, each name with itself."""
    m = members.select(F.col(group).alias("g"), F.col(name).alias("surface")).distinct()
    return m.join(m.withColumnRenamed("surface", "variant"), "g").select("surface", "variant").distinct()


def add_variant_group(entity: DataFrame, variant_member: DataFrame, group_id: int, names: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(entities, members) with a group of two or more (type, surface); missing entities are made, known members kept once."""
    if len(set(names)) < 2:
        raise ValueError("a variant group has two members at least")
    from .state import resolve_entities

    spark = entity.sparkSession
    want = spark.createDataFrame([(t, s, i) for i, (t, s) in enumerate(dict.fromkeys(names))], "type string, surface string, pos long")
    every = resolve_entities(entity, want)
    ids = every.join(want, ["type", "surface"], "left_semi").select(F.lit(group_id).cast("long").alias("group_id"), "entity_id")
    return every, variant_member.unionByName(ids.join(variant_member, ["group_id", "entity_id"], "left_anti"))


def search_phrases(df: DataFrame, surface: str = "surface") -> list[str]:
    """The names of a bounded expansion, in order, for an OR search."""
    return [r[0] for r in df.select(surface).distinct().orderBy(surface).collect()]
