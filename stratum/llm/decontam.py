r"""Benchmark decontamination by size-partitioned MinHash containment search. DataFrame operations only.

A test item is a set of word shingles (``K`` words, ASCII lower case). A document holds the item if it has
at least ``THRESHOLD`` of that set. The minimum of a random hash over an item's shingles is a shingle that
a document has with a chance equal to the containment, however long the document is; so the item's
sketch is its bottom shingles by hash, and a document is a candidate if it has one of them.

Items are partitioned by their number n of shingles, and each partition's sketch has the size
m(n) = n - ceil(THRESHOLD * n) + 1: a document that lacks all m of them lacks too much of the item to reach
the threshold, so the search misses nothing. Only document shingles whose hash is at most the largest
in any sketch are looked up. Candidate pairs are then verified on the shingles themselves.

Items of fewer than K words have one shingle, all their words, and are searched among the documents'
shingles of that length. The sketches are broadcast if they count at most ``BROADCAST_ROWS``, and joined
by shuffle beyond that.

Defined results: a null or blank item is found nowhere; a null or empty document holds nothing. Repeated
items give a pair each, as do repeated documents. Null ids are allowed. Empty tables give no pairs. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if, materialize, table, words

K, THRESHOLD = 5, 0.8
#: Rows of sketches (16 bytes), of candidate texts' keys (40 bytes) that may be broadcast.
BROADCAST_ROWS = 1_000_000


def _tokens(text: Column) -> Column:
    return words(ascii_lower(F.coalesce(text, F.lit(""))))


def _each(tokens: Column, k: int, make) -> Column:
    """make(list of k neighbouring tokens) at each position."""
    at = F.sequence(F.lit(0), F.size(tokens) - k)
    return F.when(F.size(tokens) >= k, F.transform(at, lambda i: make([F.get(tokens, i + j) for j in range(k)])))


def _strings(tokens: Column, k: int) -> Column:
    return _each(tokens, k, lambda w: F.concat_ws(" ", *w))


def _hashes(tokens: Column, k: int) -> Column:
    return _each(tokens, k, lambda w: F.xxhash64(*w))


def _text_key(text: Column) -> Column:
    return F.md5(F.encode(F.coalesce(text, F.lit("")), "utf-8"))


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, pairs): the distinct texts by key that hold an item, and (text_key, item, n, shared) for each item held."""
    toks = items.select(F.col(item_col).alias("item"), _tokens(F.col(item_text)).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(k))
    per_k = lambda make: F.coalesce(*[F.when(F.col("len") == j, make(F.col("w"), j)) for j in range(1, k + 1)])
    # equal items are one set: a key by content
    sets = toks.withColumn("len", length).select("item", "len", per_k(_strings).alias("sh"), per_k(_hashes).alias("hs")).select("item", "len", F.array_distinct("sh").alias("sh"), F.array_sort(F.array_distinct("hs")).alias("hs"))
    sets = materialize(sets.withColumn("set_id", F.md5(F.array_join("sh", "\n"))).withColumn("n", F.size("sh")), "items")
    one = sets.groupBy("set_id").agg(F.min(F.struct("len", "n", "sh", "hs")).alias("x")).select("set_id", "x.*")
    need = F.ceil(F.col("n") * F.lit(threshold) - 1e-9)
    sketch = materialize(one.select("set_id", "len", F.explode(F.slice("hs", F.lit(1), (F.col("n") - need + 1).cast("int"))).alias("h")), "sketches")
    bounds = {r["len"]: (r["top"], r["c"]) for r in sketch.groupBy("len").agg(F.max("h").alias("top"), F.count("*").alias("c")).collect()}  # k rows

    tokens = docs.select(_text_key(F.col(text_col)).alias("text_key"), _tokens(F.col(text_col)).alias("w"))
    found = None
    for j, (top, rows) in sorted(bounds.items()):
        side = broadcast_if(sketch.filter(F.col("len") == j).select("set_id", "h"), rows, BROADCAST_ROWS)
        low = F.array_distinct(F.filter(_hashes(F.col("w"), j), _at_most(top)))
        hit = tokens.select("text_key", F.explode(low).alias("h")).join(side, "h").select("text_key", "set_id").distinct()
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "text_key string, set_id string")
    found = materialize(found, "candidates")
    keys = materialize(found.select("text_key").distinct(), "keys")
    keyed = docs.select(_text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("t"))
    texts = keyed.join(broadcast_if(keys, keys.count(), BROADCAST_ROWS), "text_key").groupBy("text_key").agg(F.first("t").alias("t"))
    lens = sorted(bounds)
    grams = texts.select("text_key", _tokens(F.col("t")).alias("w")).select("text_key", *[F.coalesce(F.array_distinct(_strings(F.col("w"), j)), F.array().cast("array<string>")).alias(f"s{j}") for j in lens])
    pairs = grams.join(found, "text_key").join(one.select("set_id", "len", "n", "sh"), "set_id")
    shared = F.size(F.array_intersect("sh", F.coalesce(*[F.when(F.col("len") == j, F.col(f"s{j}")) for j in lens]))) if lens else F.lit(0)
    pairs = pairs.select("text_key", "set_id", F.col("n").cast("long").alias("n"), shared.cast("long").alias("shared")).filter(F.col("shared") >= need)
    pairs = materialize(pairs, "held")
    return keyed, pairs.join(sets.select("set_id", "item"), "set_id").select("text_key", "item", "n", "shared")


def _at_most(top):
    return lambda h: h <= F.lit(top)


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared and containment of each document and item that it holds."""
    _, pairs = contained(docs, items, id_col=id_col, text_col=text_col, **kw)
    pairs = materialize(pairs, "pairs")
    rows = docs.select(F.col(id_col).alias("doc_id"), _text_key(F.col(text_col)).alias("text_key"))
    out = rows.join(broadcast_if(pairs, pairs.count(), BROADCAST_ROWS), "text_key")
    return out.select("doc_id", F.col("item").alias("item_id"), F.col("n").alias("n_shingles"), F.col("shared").alias("n_shared"), (F.col("shared") / F.col("n")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs``, with their columns, that hold no item."""
    _, pairs = contained(docs, items, text_col=text_col, **kw)
    bad = materialize(pairs.select("text_key").distinct(), "contaminated")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), _text_key(F.col(f"`{text_col}`")).alias("text_key"))
    return row.join(broadcast_if(bad, bad.count(), BROADCAST_ROWS), "text_key", "left_anti").select("r.*")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS rid FROM benchmark),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS rid FROM documents),
ish AS (SELECT DISTINCT item_id, rid, least(5, len(w)) AS k, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s
        FROM (SELECT *, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT item_id, rid, count(*) AS n FROM ish GROUP BY ALL),
dsh AS (SELECT DISTINCT doc_id, rid, k, array_to_string(w[i : i + k - 1], ' ') AS s
        FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM ish) WHERE len(w) >= k)),
c AS (SELECT doc_id, dsh.rid AS drid, item_id, ish.rid AS irid, count(*) AS shared FROM dsh JOIN ish USING (k, s) GROUP BY ALL)
SELECT doc_id, c.item_id, CAST(n AS BIGINT) AS n_shingles, CAST(shared AS BIGINT) AS n_shared, shared / n AS containment
FROM c JOIN sizes ON c.irid = sizes.rid WHERE 5 * shared >= 4 * n
"""
