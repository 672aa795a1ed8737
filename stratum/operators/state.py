"""Upserts and state machines as append-only logs with a latest view.

Plain tables have no MERGE: a change is a row with a sequence number, and the present state is the last
row of each key. Deviation: a draft that replaces an adopted row is not adopted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import number_rows


def latest(log: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key by ``order`` (descending columns)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return log.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with ``changes`` (one row for each key) put in place or added."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def insert_or_ignore(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``table`` with those rows whose key it lacks; of several with a key the first in order."""
    fresh = latest(rows, keys, [F.col(c) for c in order])
    return table.unionByName(fresh.join(table, keys, "left_anti").select(table.columns))


def resolve_entities(entity: DataFrame, mentioned: DataFrame) -> DataFrame:
    """Entities (entity_id, type, surface) with those added that are mentioned (type, surface, pos), numbered as first seen."""
    fresh = mentioned.groupBy("type", "surface").agg(F.min("pos").alias("pos")).join(entity, ["type", "surface"], "left_anti")
    top = entity.agg(F.coalesce(F.max("entity_id"), F.lit(0)).alias("top"))
    new = number_rows(fresh, ["pos", "type", "surface"]).join(F.broadcast(top), F.lit(True)).select((F.col("top") + F.col("n")).cast("long").alias("entity_id"), "type", "surface")
    return entity.select(F.col("entity_id").cast("long").alias("entity_id"), "type", "surface").unionByName(new)


def pending(passages: DataFrame, done: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Passages without a finished row, by id."""
    out = passages.join(done.select(key), key, "left_anti")
    return out if limit is None else out.orderBy(key).limit(limit)


def pending_for(passages: DataFrame, translation: DataFrame, provider: str, limit: int | None = None) -> DataFrame:
    return pending(passages, translation.filter((F.col("provider") == provider) & (F.col("status") == "done")), "passage_id", limit)


def count_pending(passages: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return pending(passages, done, key).agg(F.count("*").alias("n"))


def adopted(log: DataFrame, key: str | list[str], order: list) -> DataFrame:
    """The one adopted row of each key: the last that was adopted."""
    return latest(log.filter("adopted"), [key] if isinstance(key, str) else key, order)


def translation_state(log: DataFrame) -> DataFrame:
    """Translations from their log (passage_id, provider, model, text, status, adopted, seq): at most one adopted for a passage.

    A failure changes the status alone: text and model stay from the last success.
    """
    good = latest(log.filter("status = 'done'"), ["passage_id", "provider"], [F.desc("seq")]).select("passage_id", "provider", F.col("model").alias("m"), F.col("text").alias("t"))
    now = latest(log, ["passage_id", "provider"], [F.desc("seq")]).join(good, ["passage_id", "provider"], "left")
    live = adopted(log, "passage_id", [F.desc("seq")]).select("passage_id", F.col("provider").alias("live"))
    return now.join(live, "passage_id", "left").select("passage_id", "provider", F.coalesce("m", "model").alias("model"), F.col("t").alias("text"), "status", F.coalesce(F.col("provider") == F.col("live"), F.lit(False)).alias("adopted"))


def translate(passages: DataFrame, provider, name: str, model: str = "unknown") -> DataFrame:
    """Log rows from a plug-in, ``provider(text) -> text``; a row that fails is marked, and the others go on."""
    import pandas as pd

    def run(frames):
        for f in frames:
            text, status, error = [], [], []
            for t in f["text"]:
                try:
                    v = provider(t)
                    if not (v or "").strip():
                        raise ValueError("blank result")
                    text.append(v), status.append("done"), error.append(None)
                except Exception as e:
                    text.append(None), status.append("failed"), error.append(str(e))
            yield pd.DataFrame({"passage_id": f["passage_id"], "provider": name, "model": model, "text": text, "status": status, "adopted": [s == "done" for s in status], "error": error})

    return passages.select("passage_id", "text").mapInPandas(run, "passage_id long, provider string, model string, text string, status string, adopted boolean, error string")


def import_results(results: DataFrame, provider: str, model: str = "unknown") -> tuple[DataFrame, DataFrame]:
    """(log rows, counts imported and skipped) of batch results (passage_id, text); blank ones are skipped."""
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    rows = results.filter(~blank).select("passage_id", F.lit(provider).alias("provider"), F.lit(model).alias("model"), "text", F.lit("done").alias("status"), F.lit(True).alias("adopted"))
    return rows, results.agg(F.count(F.when(~blank, 1)).alias("imported"), F.count(F.when(blank, 1)).alias("skipped"))


def reading_state(log: DataFrame) -> DataFrame:
    """Readings of entities from their log: one adopted for an entity and kind, superseded candidates kept."""
    key = ["entity_id", "reading_type"]
    now = latest(log, [*key, "source"], [F.desc("seq")])
    live = adopted(now, key, [F.desc("seq")]).select(*key, F.col("source").alias("live"))
    return now.join(live, key, "left").withColumn("adopted", F.coalesce(F.col("source") == F.col("live"), F.lit(False))).drop("live", "seq")
