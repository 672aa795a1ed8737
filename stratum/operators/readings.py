"""Readings of names: synthesis from character readings, conventional forms, review queues.

Deviation: a character with initial-law readings only is offered for review, so that it can be settled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions.text import chars, han_count, has_han, to_dueum

PRIORITY = {"seed": 0, "llm": 1, "unihan": 2}


def char_summary(char_reading: DataFrame) -> DataFrame:
    """For each character: its readings in order, how many are not by the initial law, and the first of each sort."""
    r = F.sort_array(F.collect_list(F.struct("seq", "reading", "is_dueum")))
    plain = F.filter("all", lambda x: x["is_dueum"] == 0)
    return char_reading.groupBy("char").agg(r.alias("all")).select(
        "char", F.transform("all", lambda x: x["reading"]).alias("readings"), F.size(plain).alias("n_plain"), F.get(plain, F.lit(0))["reading"].alias("first_plain"), F.get("all", F.lit(0))["reading"].alias("first"))


def merge_sources(char_reading: DataFrame) -> DataFrame:
    """Characters with a seed or reviewed reading have that alone; reviewed ones count for known characters only."""
    rank = F.coalesce(*[F.when(F.col("source") == s, p) for s, p in PRIORITY.items()], F.lit(2))
    known = char_reading.filter(rank == 2).select("char").distinct()
    use = char_reading.withColumn("_p", rank).join(known.withColumn("_k", F.lit(True)), "char", "left").filter((F.col("_p") != 1) | F.col("_k"))
    w = Window.partitionBy("char")
    return use.withColumn("_b", F.min("_p").over(w)).filter("_p = _b").drop("_p", "_b", "_k")


def synthesize(entities: DataFrame, char_reading: DataFrame, id_col: str = "entity_id", surface: str = "surface") -> DataFrame:
    """(entity_id, surface, reading, confirmed, review): character readings put together, and the characters in doubt."""
    s = char_summary(char_reading)
    x = entities.select(F.col(id_col).alias("entity_id"), F.col(surface).alias("surface"), F.posexplode_outer(chars(F.col(surface))).alias("pos", "char")).join(s, "char", "left")
    han = has_han(F.col("char"))
    r = F.when(~han, F.col("char")).when(F.col("n_plain").isNull(), F.col("char")).when(F.col("n_plain") == 0, F.col("first")).otherwise(F.col("first_plain"))
    ok = ~han | F.coalesce(F.col("n_plain") == 1, F.lit(False))
    x = x.select("entity_id", "surface", "pos", "char", F.coalesce(r, F.lit("")).alias("r"), F.coalesce(ok, F.lit(True)).alias("ok"))
    parts = F.sort_array(F.collect_list(F.struct("pos", "r")))
    review = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(~F.col("ok"), F.struct("pos", "char")))), lambda v: v["char"]))
    return x.groupBy("entity_id", "surface").agg(F.array_join(F.transform(parts, lambda v: v["r"]), "").alias("reading"), F.bool_and("ok").alias("confirmed"), review.alias("review"))


def conventional(rows: DataFrame, dictionary: DataFrame, surface: str = "surface", original: str = "reading") -> DataFrame:
    """``rows`` with the conventional reading and its source: the dictionary's if it has a syllable for each character, else the initial law's."""
    d = dictionary.select(F.col("han").alias(surface), F.col("headword").alias("_d"))
    fits = F.length("_d") == han_count(F.col(surface))
    return rows.join(d, surface, "left").withColumn("conventional", F.when(fits, F.col("_d")).otherwise(to_dueum(F.col(original)))).withColumn("conventional_source", F.when(fits, "dict").otherwise("rule")).drop("_d")


def build_readings(entities: DataFrame, char_reading: DataFrame, surface_seed: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(entity_id, reading_type, reading, source, confidence, status, adopted) of all entities in one job.

    Original: the surface's seed (100), a confirmed synthesis (10) or a draft (1). Conventional, of adopted
    originals: dictionary (50) or rule (5).
    """
    o = synthesize(entities, merge_sources(char_reading)).join(surface_seed.select("surface", F.col("original").alias("seed")), "surface", "left")
    seeded = F.col("seed").isNotNull()
    o = o.select(
        "entity_id", "surface", F.coalesce("seed", "reading").alias("reading"), F.when(seeded, "seed").otherwise("synth").alias("source"),
        F.when(seeded, 100).when(F.col("confirmed"), 10).otherwise(1).alias("confidence"), F.when(seeded, "seeded").when(F.col("confirmed"), "auto_confirmed").otherwise("draft").alias("status"), (seeded | F.col("confirmed")).alias("adopted"),
    )
    c = conventional(o.filter("adopted"), dictionary)
    c = c.select("entity_id", F.lit("conventional").alias("reading_type"), F.col("conventional").alias("reading"), F.col("conventional_source").alias("source"), F.when(F.col("conventional_source") == "dict", 50).otherwise(5).alias("confidence"), F.lit("auto_confirmed").alias("status"), F.lit(True).alias("adopted"))
    return o.select("entity_id", F.lit("original").alias("reading_type"), "reading", "source", "confidence", "status", "adopted").unionByName(c)


def pending_chars(entities: DataFrame, char_reading: DataFrame, seeds: DataFrame, surface: str = "surface") -> DataFrame:
    """(char, reason, candidates): Han characters in use without one sure reading; rare ones have none at all."""
    used = entities.select(F.explode(chars(F.col(surface))).alias("char")).filter(has_han(F.col("char"))).distinct()
    settled = char_reading.filter(F.col("source").isin("llm", "seed")).select("char").unionByName(seeds.select("char"))
    x = used.join(settled, "char", "left_anti").join(char_summary(char_reading), "char", "left")
    reason = F.when(F.col("n_plain").isNull(), "rare").when(F.col("n_plain") != 1, "polyphone")
    return x.select("char", reason.alias("reason"), F.coalesce("readings", F.array().cast("array<string>")).alias("candidates")).filter("reason is not null")


def import_chars(char_reading: DataFrame, results: DataFrame) -> DataFrame:
    """``char_reading`` with reviewed readings (char, reading) put in; blank ones are passed over."""
    from .state import upsert

    good = results.filter(F.trim(F.coalesce("reading", F.lit(""))) != "").select("char", F.trim("reading").alias("reading"), F.lit("llm").alias("source"), F.lit(-1).alias("seq"), F.lit(0).alias("is_dueum")).dropDuplicates(["char", "reading"])
    return upsert(char_reading, good.select(char_reading.columns), ["char", "reading"])


def single_readings(char_reading: DataFrame) -> DataFrame:
    """(char, reading) of characters with one sure reading: a seed's or reviewer's, else the only one not by the initial law."""
    first = char_reading.filter(F.col("source").isin("seed", "llm") | (F.col("seq") == -1)).groupBy("char").agg(F.min_by("reading", "seq").alias("a"))
    other = char_summary(char_reading).filter("n_plain = 1").select("char", F.col("first_plain").alias("b"))
    return first.join(other, "char", "full").select("char", F.coalesce("a", "b").alias("reading"))


def classify_by_variant(review: DataFrame, variants: DataFrame, single: DataFrame) -> DataFrame:
    """(char, via, field, reading): a character is settled if its variants' sure readings are exactly one. ``variants``: char, target, field, ord."""
    v = review.select("char").distinct().join(variants, "char", "left").filter(F.col("target").isNull() | (F.col("target") != F.col("char")))
    s = single.select(F.col("char").alias("target"), F.col("reading").alias("r"))
    known = v.join(s, "target").groupBy("char").agg(F.count_distinct("r").alias("n"), F.min_by(F.struct("target", "field", "r"), "ord").alias("f"))
    one = F.col("n") == 1
    return review.select("char").distinct().join(known, "char", "left").select("char", F.when(one, F.col("f.target")).alias("via"), F.when(one, F.col("f.field")).alias("field"), F.when(one, F.col("f.r")).alias("reading"))


def review_split(pending: DataFrame, classified: DataFrame) -> DataFrame:
    """(char, queue) of every pending character: variant-resolved, unresolved or polyphone."""
    return pending.join(classified.select("char", F.col("reading").isNotNull().alias("ok")), "char", "left").select(
        "char", F.when(F.col("reason") == "polyphone", "polyphone").when(F.col("ok"), "variant-resolved").otherwise("unresolved").alias("queue")
    )


def finalize_manifest(queue: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """The verdicts joined to the queue, and how many are missing, unknown, double or blank: all 0 if it may be used."""
    j = queue.select("char", F.lit(1).alias("q")).join(verdicts.groupBy("char").agg(F.count("*").alias("n"), F.first("reading").alias("reading")), "char", "full")
    r = j.agg(F.count(F.when(F.col("n").isNull(), 1)).alias("missing"), F.count(F.when(F.col("q").isNull(), 1)).alias("unknown"), F.count(F.when(F.col("n") > 1, 1)).alias("double"), F.count(F.when(F.col("n").isNotNull() & (F.trim(F.coalesce("reading", F.lit(""))) == ""), 1)).alias("blank")).first()
    return j.filter("q = 1 and n = 1").select("char", "reading"), r.asDict()
