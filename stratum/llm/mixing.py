"""Mixing sources to target weights by hash-threshold histograms. DataFrame operations only.

Each document has a 60-bit hash of its id and text. Words are summed by source and by the hash's
first ``BITS`` bits; running sums over that bounded histogram find the bucket in which a source's
budget ends, and only the rows of that bucket are summed again by the next bits, ``LEVELS`` times.
What results is one threshold for each source, so documents are filtered by a comparison and never
sorted. Budgets nest: a smaller budget takes a subset of what a larger one takes.

Targets: sources in code point order, null last, weigh 1, 2, 3, repeating. They share ``share`` of
all words; a target stops at ``cap`` times its source's words and what it leaves goes to the other
sources by weight, until none is above. A target of q whole sources and a rest takes every document q
times, and those under the threshold once more.

Defined results: a null or empty text has size 0; it is taken as its hash says and counts nothing.
Rows alike in id and text share a hash and are taken together. If all words are in one source, its
target is all of them. A table without words has targets of 0 and takes nothing; an empty one gives
no rows. A null id is a value like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if, materialize, table

BITS, LEVELS = 12, 4
WEIGHTS = (1, 2, 3)
CAP = 3
#: Sources broadcast at most; more of them are joined by shuffle.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def hashed(doc_id: Column, text: Column) -> Column:
    """60 bits, the same in every engine that has MD5."""
    s = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(F.encode(s, "utf-8")), 1, 15), 16, 10).cast("long")


def _key(source: Column) -> Column:
    # nulls last, and a key that an equi-join matches
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, cap: int = CAP) -> DataFrame:
    """source_key, source_size, target from (source_key, source_size); a row for each source.

    With sources by ascending cap-to-weight ratio, those at their cap are a prefix, so running sums
    give the level at which the rest share what remains.
    """
    order = Window.partitionBy().orderBy("source_key")
    n = len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % n + 1).cast("int"))
    level = Window.partitionBy().orderBy("ratio", "source_key")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    capped = F.col("source_size") * cap
    out = (
        sizes.withColumn("w", w).withColumn("capped", capped.cast("double")).withColumn("ratio", F.col("capped") / F.col("w"))
        .withColumn("all", F.sum("source_size").over(whole).cast("double") * share)
        .withColumn("w_left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("left", F.col("all") - F.coalesce(F.sum("capped").over(before), F.lit(0.0)))
        .withColumn("lambda", F.col("left") / F.col("w_left"))
        .withColumn("full", F.col("ratio") <= F.col("lambda"))
        # sources after the capped prefix all share the level found at the first of them
        .withColumn("shared", F.first(F.when(~F.col("full"), F.col("lambda")), ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    return out.select("source_key", "source_size", F.when(F.col("full"), F.col("capped")).otherwise(F.col("shared") * F.col("w")).alias("target"))


def thresholds(rows: DataFrame, goal: DataFrame, small) -> DataFrame:
    """source_key, upto: a row is taken once more if its hash, cut to BITS * LEVELS bits, is below ``upto``.

    ``rows``: source_key, size, h. ``goal``: source_key and ``rest``, the words yet to take.
    """
    at = goal.select("source_key", F.col("rest").alias("need"), F.lit(0).cast("long").alias("prefix"))
    for level in range(1, LEVELS + 1):
        shift = 60 - BITS * level
        inside = rows.join(small(at.select("source_key", "prefix")), "source_key").filter(F.shiftright("h", shift + BITS) == F.col("prefix"))
        hist = inside.groupBy("source_key", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("s"))
        w = Window.partitionBy("source_key").orderBy("b")
        hist = hist.withColumn("after", F.sum("s").over(w)).withColumn("before", F.col("after") - F.col("s"))
        cut = hist.join(small(at.select("source_key", "need")), "source_key").filter(F.col("after") > F.col("need"))
        first = cut.groupBy("source_key").agg(F.min(F.struct("b", "before", "after")).alias("m"))
        # no bucket passes the budget: all that is inside is taken
        at = at.join(first, "source_key", "left").select(
            "source_key",
            F.when(F.col("m").isNull(), F.col("need")).otherwise(F.col("need") - F.col("m.before")).alias("need"),
            F.coalesce(F.col("m.b"), (F.col("prefix") + 1) * (1 << BITS)).alias("prefix"),
            F.coalesce(F.col("m.after") - F.col("m.before"), F.lit(0).cast("long")).alias("last"),
        )
        if level < LEVELS:
            at = at.select("source_key", "need", "prefix")
        at = materialize(at, "threshold")
    # the last bucket, as a rule one document, is taken if more than half of it is needed
    return at.select("source_key", F.when(F.col("need") * 2 > F.col("last"), F.col("prefix") + 1).otherwise(F.col("prefix")).alias("upto"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """doc_id, h, source_key, size, source_size, target and ``copies`` (how often the mix takes the document)."""
    rows, cuts = _cuts(docs, id_col, text_col, source_col, **kw)
    return rows.join(cuts, "source_key").withColumn("copies", _copies())


def _copies() -> Column:
    """How often the mix takes a row, from its hash and its source's cut."""
    return F.col("epochs") + F.when((F.shiftright("h", 60 - BITS * LEVELS) < F.col("upto")) & (F.col("source_size") > 0), 1).otherwise(0)


def _cuts(docs: DataFrame, id_col: str, text_col: str, source_col: str, **kw) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, source_key, size) of every row, and each source's source_size, target, epochs and upto, ready to be joined."""
    rows = materialize(
        docs.select(F.col(id_col).alias("doc_id"), hashed(F.col(id_col), F.col(text_col)).alias("h"), _key(F.col(source_col)).alias("source_key"), n_words(F.col(text_col)).alias("size")), "sizes"
    )
    goal = materialize(
        targets(rows.groupBy("source_key").agg(F.sum("size").alias("source_size")), **kw)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")),
        "targets",
    )
    n = goal.count()
    small = lambda df: broadcast_if(df, n, BROADCAST_SOURCES)
    return rows, small(goal.join(thresholds(rows, goal, small), "source_key"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The rows of the mix, with the columns of ``docs``: documents taken twice are there twice.

    A row's copies follow from its hash and its source's cut alone, so no text is shuffled.
    """
    _, cuts = _cuts(docs, id_col, text_col, source_col, **kw)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r")
    keyed = docs.select(row, _key(F.col(source_col)).alias("source_key"), hashed(F.col(id_col), F.col(text_col)).alias("h"))
    kept = keyed.join(cuts, "source_key").withColumn("n", _copies()).filter("n > 0")
    return kept.select("r", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int")))).select("r.*")


def op7_mix_hash_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(table(spark, sf_dir, "documents"))
    return p.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, ''))[1:12] AS BIGINT) AS h
  FROM documents),
s AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY k),
w AS (SELECT *, [1.0::DOUBLE, 2.0, 3.0][1 + (row_number() OVER (ORDER BY k) - 1) % 3] AS w, CAST(source_size * 3 AS DOUBLE) AS capped FROM s),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(capped) OVER (ORDER BY capped / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY capped / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lam FROM w),
t AS (SELECT k, source_size, CASE WHEN capped / w <= lam THEN capped ELSE w * (SELECT arg_min(lam, capped / w) FROM l WHERE capped / w > lam) END AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
b AS (SELECT k, h, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY k ORDER BY h) AS upto FROM d GROUP BY k, h),
x AS (SELECT b.k, b.h, g.source_size, g.target,
             g.epochs + CASE WHEN source_size = 0 THEN 0
               WHEN upto <= target - epochs * source_size THEN 1
               WHEN upto - n <= target - epochs * source_size AND 2 * (target - epochs * source_size - (upto - n)) > n THEN 1 ELSE 0 END AS copies
      FROM b JOIN g USING (k))
SELECT d.doc_id, d.size, x.source_size, x.target, CAST(d.size * x.copies AS BIGINT) AS taken
FROM d JOIN x ON d.k = x.k AND d.h = x.h
"""
