"""One object over a set of tables: the methods that a user or a tool server calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions.text import index_tokens
from stratum.operators import bm25, clustering, expand, fusion, graph, lookup, vectors

MAX_LIMIT, MAX_CLUSTER_LIMIT = 200, 1000


def check_limit(limit: int, most: int = MAX_LIMIT) -> int:
    if not isinstance(limit, int) or not 1 <= limit <= most:
        raise ValueError(f"limit is a whole number from 1 to {most}")
    return limit


class TextCorpus:
    """Searches over the tables passage, corpus, entity, mention, node and what dictionaries there are.

    ``tables`` maps names to DataFrames. Token indexes are built once for each object; ``embed`` is a plug-in
    for query vectors, and without it, or without vectors, hybrid search has lexical arms only.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], embed: Callable[[str], list[float]] | None = None, vectors_by_kind: dict[str, DataFrame] | None = None):
        self.spark, self.t, self.embed, self.vec = spark, tables, embed, vectors_by_kind or {}
        self._index: dict[str, DataFrame] = {}

    def index(self, kind: str) -> DataFrame:
        if kind not in self._index:
            if kind == "han":
                p = self.t["passage"].join(self.t["corpus"].select("corpus_id", F.col("code").alias("corpus_code")), "corpus_id")
                i = bm25.build_index(p, "passage_id", "text", "han", "corpus_code", "node_id", "text")
            else:
                i = bm25.build_index(self.t["translation"].filter("adopted"), "passage_id", "text", "ko", "text")
            self._index[kind] = i.cache()
        return self._index[kind]

    def refresh(self, **tables: DataFrame) -> None:
        """Puts changed tables in place; the indexes that rest on them are built anew when next asked for."""
        self.t.update(tables)
        rests = {"han": {"passage", "corpus"}, "ko": {"translation"}}
        for kind in [k for k in self._index if not tables or rests[k] & set(tables)]:
            self._index.pop(kind).unpersist()

    def _phrases(self, terms: list[str], mode: str) -> list[list[str]]:
        rows = self.spark.createDataFrame([(i, x) for i, x in enumerate(dict.fromkeys(terms))], "i int, t string") if terms else None
        return [r["p"] for r in rows.orderBy("i").select(index_tokens(F.col("t"), mode).alias("p")).collect()] if terms else []

    def traditionalize(self, term: str) -> tuple[list[str], bool]:
        """The traditional spellings of a term with the term itself, and whether there were any."""
        if "char_simplified" not in self.t:
            return [term], False
        q = self.spark.createDataFrame([(term,)], "q string")
        r = expand.expand_traditional(q, "q", self.t["char_simplified"]).first()
        return list(r["candidates"]), r["changed"]

    def search_han(self, term: str, limit: int = 20, corpus: str | None = None) -> DataFrame:
        where = None if corpus is None else F.col("corpus_code") == corpus
        return bm25.search(self.index("han"), self._phrases(self.traditionalize(term)[0], "han"), limit, where)

    def search_ko(self, term: str, limit: int = 20) -> DataFrame:
        return bm25.search(self.index("ko"), self._phrases([term], "ko"), limit)

    def lookup_reading(self, reading: str, limit: int = 50) -> DataFrame:
        return expand.lookup_by_reading(self.t["entity"], self.t["entity_reading"], reading, limit)

    def search_by_reading(self, reading: str, limit: int | None = None, corpus: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(entities of the reading, hits of their names and variants); one limit, if given, holds for both."""
        found = self.lookup_reading(reading, limit or 50)
        names: list[str] = []
        for s in [r["surface"] for r in found.select("surface", "entity_id").orderBy("entity_id").collect()]:  # at most ``limit``
            names += expand.search_phrases(self.variants(s))
        where = None if corpus is None else F.col("corpus_code") == corpus
        return found, bm25.search(self.index("han"), self._phrases(names, "han"), limit or 20, where)

    def variants(self, surface: str) -> DataFrame:
        if "variant_member" not in self.t:
            return self.spark.createDataFrame([(surface,)], "surface string")
        m = self.t["variant_member"].join(self.t["entity"].select("entity_id", "surface"), "entity_id")
        return expand.expand_variants(m, surface)

    def with_variants(self, surface: str, limit: int = 20, corpus: str | None = None) -> DataFrame:
        where = None if corpus is None else F.col("corpus_code") == corpus
        return bm25.search(self.index("han"), self._phrases(expand.search_phrases(self.variants(surface)), "han"), limit, where)

    def lookup_place(self, surface: str, kind: str | None = None, limit: int = 100) -> DataFrame:
        return lookup.lookup_entity(self.t["mention"], self.t["entity"], self.t["node"], self.t["corpus"], surface, kind, limit)

    def _seed(self, surface: str, kind: str | None = None) -> DataFrame:
        e = self.t["entity"].filter(F.col("surface") == surface)
        return (e if kind is None else e.filter(F.col("type") == kind)).select(F.col("entity_id").alias("entity"))

    def _mentions(self, kind: str | None = None) -> DataFrame:
        m = self.t["mention"].select("passage_id", "node_id", F.col("entity_id").alias("entity"))
        e = self.t["entity"].select(F.col("entity_id").alias("entity"), "type", "surface")
        m = m.join(e, "entity")
        return m if kind is None else m.filter(F.col("type") == kind)

    def cluster(self, surface: str, scope: str = "article", kind: str | None = None, neighbour_type: str | None = None, limit: int = 50) -> DataFrame:
        keep = None if neighbour_type is None else F.col("type") == neighbour_type
        near = graph.neighbours(self._mentions(), graph.scope_column(scope), "entity", self._seed(surface, kind), limit, keep)
        return near.join(self.t["entity"].select(F.col("entity_id").alias("entity"), "type", "surface"), "entity").orderBy(F.desc("cooc"), "surface", "entity")

    def place_clusters(self, seed: str, scope: str = "article", kind: str = "지명", mode: str = "fixed", **kw) -> dict:
        if "limit" in kw:
            check_limit(kw["limit"], MAX_CLUSTER_LIMIT)
        return clustering.place_clusters(self._mentions(kind), graph.scope_column(scope), "entity", self._seed(seed, kind), mode, **kw)

    def suggest_parameters(self, seed: str, scope: str = "article", kind: str = "지명", limit: int = 200) -> dict | None:
        return clustering.suggest(self._mentions(kind), graph.scope_column(scope), "entity", self._seed(seed, kind), limit)

    def search_hybrid(self, term: str, limit: int = 20, retrieve: int = 200, weights: dict[str, float] | None = None, corpus: str | None = None, strict_corpus: bool = False, semantic: bool = True) -> tuple[DataFrame, bool]:
        """(hits, whether vectors took part). ``corpus`` reaches the han and reading arms; ``strict_corpus`` all of them."""
        arms = {"han": fusion.ranked(self.search_han(term, retrieve, corpus), ["score", "id"])}
        if "entity_reading" in self.t:
            arms["reading"] = fusion.ranked(self.search_by_reading(term, retrieve, corpus)[1], ["score", "id"])
        if "translation" in self.t:
            arms["ko"] = fusion.ranked(self.search_ko(term, retrieve), ["score", "id"])
        vec = bool(semantic and self.embed and self.vec)
        if vec:
            q = self.embed(term)
            for kind, v in self.vec.items():
                arms[f"vec_{kind}"] = fusion.ranked(vectors.vector_rank(v, q, retrieve), [F.desc("score"), "id"])
        rows = self.t["passage"].join(self.t["corpus"].select("corpus_id", F.col("code").alias("corpus_code")), "corpus_id").withColumnRenamed("passage_id", "id").select("id", "corpus_code", "node_id", "text")
        strict = F.col("corpus_code") == corpus if strict_corpus and corpus else None
        return fusion.hybrid(arms, rows, limit, weights, strict=strict).orderBy(F.desc("score"), "item"), vec
