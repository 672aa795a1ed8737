"""BM25 over exact phrases.

A query is a set of phrases, each a list of adjacent tokens, joined by OR. A document's score is the
negative sum over phrases of idf * f * (k1+1) / (f + k1*(1-b+b*len/avg)); lower is better. idf is
ln((N-n+.5)/(n+.5)), at least 1e-6. N, n and the mean length are of the whole index, whatever filter the
hits pass. Occurrences may overlap. Hits are ordered by score rounded to ``DIGITS``, then id.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions.text import han_string, index_tokens

K1, B, DIGITS = 1.2, 0.75, 6


def build_index(docs: DataFrame, id_col: str, text_col: str, mode: str = "word", *keep: str) -> DataFrame:
    """id, tokens, n_tokens and kept columns: materialise this once and query it many times."""
    t = index_tokens(F.coalesce(F.col(text_col), F.lit("")), mode)
    return docs.select(F.col(id_col).alias("id"), *keep, t.alias("tokens")).withColumn("n_tokens", F.size("tokens"))


def build_characters(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """``build_index`` in mode ``han`` with the tokens, of one character each, as one string: searches are of parts of it."""
    t = han_string(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("id"), *keep, t.alias("tokens")).withColumn("n_tokens", F.length("tokens"))


def character_frequency(tokens: Column, phrase: Sequence[str]) -> Column:
    """``phrase_frequency`` in a string of tokens of one character."""
    word = "".join(phrase)
    if any(len(t) != 1 for t in phrase):
        return F.lit(0)
    if any(word[:i] == word[-i:] for i in range(1, len(word))):  # occurrences may overlap
        return F.regexp_count(tokens, F.lit(f"(?=\\Q{word}\\E)"))
    less = F.octet_length(tokens) - F.octet_length(F.replace(tokens, F.lit(word), F.lit("")))
    return (less / len(word.encode())).cast("int")


def _frequency(index: DataFrame, phrase: Sequence[str]) -> Column:
    of = character_frequency if dict(index.dtypes)["tokens"] == "string" else phrase_frequency
    return of(F.col("tokens"), phrase)


def phrase_frequency(tokens: Column, phrase: Sequence[str]) -> Column:
    """How often the phrase's tokens stand side by side; overlapping occurrences count."""
    k = len(phrase)
    if k == 1:
        return F.size(F.filter(tokens, lambda t: t == phrase[0]))
    at = F.sequence(F.lit(0), F.size(tokens) - k)
    same = lambda i: reduce(lambda a, b: a & b, [F.get(tokens, i + j) == p for j, p in enumerate(phrase)])
    # the first token decides for most documents
    return F.when((F.size(tokens) >= k) & F.array_contains(tokens, phrase[0]), F.size(F.filter(at, same))).otherwise(0)


def index_stats(index: DataFrame, phrases: Sequence[Sequence[str]] = ()) -> DataFrame:
    """One row: n_docs, avg_len, and df_i for each phrase."""
    return index.agg(
        F.count("*").alias("n_docs"), F.avg("n_tokens").alias("avg_len"),
        *[F.count(F.when(_frequency(index, p) > 0, 1)).alias(f"df_{i}") for i, p in enumerate(phrases)],
    )


def idf(n_docs: Column, df: Column) -> Column:
    v = F.log((n_docs - df + 0.5) / (df + 0.5))
    return F.when(v > 0, v).otherwise(F.lit(1e-6))


def term_weight(f: Column, length: Column, avg_len: Column) -> Column:
    return f * (K1 + 1) / (f + K1 * (1 - B + B * length / avg_len))


def search(index: DataFrame, phrases: Sequence[Sequence[str]], limit: int | None = 20, where: Column | None = None) -> DataFrame:
    """Hits of an OR of phrases: the index's columns without tokens, and ``score``.

    The statistics are one scalar row, read first; the second pass scores and keeps the top rows.
    """
    phrases = [list(p) for p in dict.fromkeys(tuple(p) for p in phrases) if p]
    if limit is not None and limit < 0:
        raise ValueError("limit may not be negative")
    cols = [c for c in index.columns if c != "tokens"]
    if not phrases:
        return index.select(*cols, F.lit(0.0).alias("score")).limit(0)
    s = index_stats(index, phrases).first()
    if where is not None:
        index = index.filter(where)
    # a generator stops the filter below from being pushed into the tokeniser, which would then run for each position
    freqs = F.array(*[_frequency(index, p).cast("int") for p in phrases])
    hits = index.select(*cols, F.explode(F.array(freqs)).alias("f")).filter(F.exists("f", lambda x: x > 0))
    hits = hits.select(*cols, *[F.get("f", F.lit(i)).alias(f"f_{i}") for i in range(len(phrases))])
    avg, n = F.lit(s["avg_len"]), F.lit(float(s["n_docs"]))
    parts = [idf(n, F.lit(float(s[f"df_{i}"]))) * term_weight(F.col(f"f_{i}"), F.col("n_tokens"), avg) for i in range(len(phrases))]
    out = hits.select(*cols, F.round(-reduce(lambda a, b: a + b, parts), DIGITS).alias("score"))
    return out if limit is None else out.orderBy("score", "id").limit(limit)


def search_text(index: DataFrame, terms: Sequence[str], mode: str = "word", **kw) -> DataFrame:
    """``search`` for terms that are cut into phrases by the index's own tokeniser."""
    spark = index.sparkSession
    rows = spark.createDataFrame([(t,) for t in terms], "t string").select(index_tokens(F.col("t"), mode).alias("p")).collect() if terms else []
    return search(index, [r["p"] for r in rows], **kw)


def count_characters(docs: DataFrame, text_col: str) -> DataFrame:
    """(char, cf) of every character in a column, counted batch by batch, so that none becomes a row."""

    def run(batches):
        for b in batches:
            text = b.column(0).drop_null().cast(pa.large_binary())
            held = b"".join(text.to_pylist()).decode("utf-8", "replace").encode("utf-32-le")
            n = np.bincount(np.frombuffer(held, np.uint32))
            code = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([chr(c) for c in code.tolist()], pa.string()), pa.array(n[code], pa.int64())], ["char", "n"])

    return docs.select(text_col).mapInArrow(run, "char string, n long").groupBy("char").agg(F.sum("n").alias("cf"))


def postings(index: DataFrame, terms: Sequence[str] | None = None) -> DataFrame:
    """(term, id, pos, n_tokens): write this partitioned or bucketed by term to serve many queries.

    With ``terms`` only theirs, chosen before tokens become rows.
    """
    if terms is None:
        return index.select("id", "n_tokens", F.posexplode("tokens").alias("pos", "term"))
    asked = F.array(*[F.lit(t) for t in sorted(set(terms))])
    some = F.filter(F.transform("tokens", lambda t, i: F.struct(i.alias("pos"), t.alias("term"))), lambda x: F.array_contains(asked, x["term"]))
    return index.filter(F.arrays_overlap("tokens", asked)).select("id", "n_tokens", F.explode(some).alias("x")).select("id", "n_tokens", "x.pos", "x.term")


def batch_search(post: DataFrame, totals: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """Many queries at once: (query_id, rank, id, score) from postings.

    ``queries``: query_id, phrase_id, tokens. ``totals``: n_docs, avg_len. Tokens of all phrases meet
    the postings in one equi-join on the term; an occurrence is a start at which all tokens are met.
    """
    q = queries.select("query_id", "phrase_id", F.size("tokens").alias("k"), F.posexplode("tokens").alias("off", "term"))
    met = post.join(q, "term").groupBy("query_id", "phrase_id", "k", "id", "n_tokens", (F.col("pos") - F.col("off")).alias("start")).agg(F.count("*").alias("n"))
    f = met.filter(F.col("n") == F.col("k")).groupBy("query_id", "phrase_id", "id", "n_tokens").agg(F.count("*").alias("f"))
    df = f.groupBy("query_id", "phrase_id").agg(F.count("*").alias("df"))
    scored = f.join(df, ["query_id", "phrase_id"]).join(F.broadcast(totals), F.lit(True))
    part = idf(F.col("n_docs"), F.col("df")) * term_weight(F.col("f"), F.col("n_tokens"), F.col("avg_len"))
    out = scored.groupBy("query_id", "id").agg(F.round(-F.sum(part), DIGITS).alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("query_id", "rank", "id", "score")
