"""Readers of character and word dictionaries, seeds and batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratum.functions.text import code_point, headword, to_dueum

VARIANT_FIELDS = ("kSemanticVariant", "kSpecializedSemanticVariant", "kZVariant", "kTraditionalVariant", "kSimplifiedVariant")


def _fields(spark: SparkSession, path: str) -> DataFrame:
    """(char, field, value, line) of a tab-separated file of code points."""
    t = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).filter(~F.col("value").rlike(r"^\s*(#|$)"))
    p = F.split("value", "\t")
    t = t.select(F.get(p, F.lit(0)).alias("cp"), F.get(p, F.lit(1)).alias("field"), F.get(p, F.lit(2)).alias("value"), "line").filter(F.col("cp").rlike("^U\\+[0-9A-Fa-f]{4,6}$"))
    return t.select(code_point(F.substring("cp", 3, 8)).alias("char"), "field", "value", "line")


def unihan_readings(spark: SparkSession, path: str) -> DataFrame:
    """(char, reading, source, seq, is_dueum): readings in order; a character's last line holds.

    A reading is by the initial law if it is what the law makes of another of the character's readings.
    """
    x = _fields(spark, path).filter("field = 'kHangul'")
    w = Window.partitionBy("char").orderBy(F.desc("line"))
    x = x.withColumn("n", F.row_number().over(w)).filter("n = 1").select("char", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("seq", "r"))
    x = x.select("char", F.regexp_replace("r", ":.*$", "").alias("reading"), "seq").filter("reading <> ''").groupBy("char", "reading").agg(F.min("seq").alias("seq"))
    law = x.select("char", F.col("reading").alias("from"), to_dueum(F.col("reading")).alias("reading")).filter(F.col("from") != F.col("reading")).select("char", "reading").distinct().withColumn("d", F.lit(1))
    return x.join(law, ["char", "reading"], "left").select("char", "reading", F.lit("unihan").alias("source"), "seq", F.coalesce("d", F.lit(0)).alias("is_dueum"))


def unihan_variants(spark: SparkSession, path: str) -> DataFrame:
    """(char, target, field, ord) of the allowed fields, without links of a character to itself."""
    x = _fields(spark, path).filter(F.col("field").isin(*VARIANT_FIELDS))
    x = x.select("char", "field", "line", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("pos", "t"))
    x = x.select("char", "field", "line", "pos", F.regexp_extract("t", "^U\\+([0-9A-Fa-f]{4,6})", 1).alias("hex")).filter("hex <> ''")
    w = Window.partitionBy("char").orderBy("line", "pos")
    return x.select("char", code_point(F.col("hex")).alias("target"), "field", "line", "pos").filter("target <> char").withColumn("ord", F.row_number().over(w)).select("char", "target", "field", "ord")


def simplified_table(variants: DataFrame) -> DataFrame:
    """(char, simplified): the first simplified form that is not the character itself."""
    return variants.filter("field = 'kSimplifiedVariant'").groupBy("char").agg(F.min_by("target", "ord").alias("simplified"))


def word_dictionary(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(han, headword): the first headword of each spelling, over files in order of name."""
    schema = "channel struct<item: array<struct<word_info: struct<word: string, original_language_info: array<struct<original_language: string, language_type: string>>>>>>"
    x = spark.read.schema(schema).json(paths, multiLine=True).select(F.input_file_name().alias("f"), F.posexplode("channel.item").alias("i", "item"))
    x = x.select("f", "i", F.col("item.word_info.word").alias("word"), F.posexplode("item.word_info.original_language_info").alias("j", "o"))
    x = x.select("f", "i", "j", F.col("o.original_language").alias("han"), headword(F.col("word")).alias("headword")).filter("han rlike '\\\\p{IsHan}' and headword <> ''")
    return x.groupBy("han").agg(F.min_by("headword", F.struct("f", "i", "j")).alias("headword"))


def seeds(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(char, original) and (surface, original) of a seed file."""
    v = "map<string, struct<original: string, note: string>>"
    x = spark.read.schema(f"char {v}, surface {v}").json(path, multiLine=True)
    one = lambda c: x.select(F.explode(c).alias(c, "v")).select(c, F.col("v.original").alias("original"))
    return one("char"), one("surface")


def batch_results(spark: SparkSession, path: str, item: str, under: str = "results") -> DataFrame:
    """Items of a JSON file that is either a list or an object with the list under a name. ``item``: their DDL."""
    raw = spark.read.text(path, wholetext=True)
    a, b = F.from_json("value", f"array<struct<{item}>>"), F.from_json("value", f"struct<`{under}`: array<struct<{item}>>>")[under]
    return raw.select(F.explode(F.when(F.ltrim("value").startswith("["), a).otherwise(b)).alias("x")).select("x.*")


def translation_results(spark: SparkSession, path: str) -> DataFrame:
    return batch_results(spark, path, "passage_id: long, text: string")


def reading_results(spark: SparkSession, path: str) -> DataFrame:
    return batch_results(spark, path, "char: string, reading: string", "chars")
