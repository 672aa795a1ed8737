"""What a query keeps and sends grows as its input does."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum import catalog
from stratum.operators import components, cosine_clusters, vectors

from test_whole import brute_fdbscan, cosines, folder  # noqa: F401


def test_blocks_are_bounded():
    assert [vectors.blocks_of(n) for n in (0, 10, 4097, 100_000, 1_000_000)] == [1, 1, 2, 16, 16]
    assert vectors.blocks_of(30 * vectors.LARGE) == 30


def test_sweep_keeps_no_table_of_pairs(spark, folder, monkeypatch):  # noqa: F811
    d, rows = folder
    monkeypatch.setattr(vectors, "BLOCK", 60)
    monkeypatch.setattr(vectors, "similar_pairs", None)
    ids, s = [r[0] for r in rows], cosines(rows)
    got = {r["candidate"]: r for r in catalog.fdbscan_sweep(spark, d).collect()}
    for k, (a, b) in enumerate((a, b) for a in catalog.clustering.FACTORS for b in catalog.clustering.FACTORS):
        m = brute_fdbscan(ids, s, round(catalog._SIM * a, 12), round(catalog._MU * b, 12))
        assert got[k]["clusters"] == len({c for _, c in m})
        assert abs(got[k]["noise_rate"] - (1 - len({p for p, _ in m}) / len(ids))) < 1e-6
        assert abs(got[k]["multi_border"] - sum(1 for p in {p for p, _ in m} if sum(x == p for x, _ in m) > 1) / len(ids)) < 1e-6


def test_blocks_keep_classes_and_not_pairs(spark, monkeypatch):
    """120 vectors all alike have 7,140 pairs; of each two blocks no more than a row is kept."""
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in np.r_[1.0, rng.standard_normal(5) * 0.01]]) for k in range(120)]
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    s = cosine_clusters._Settings(spark.createDataFrame([(0, 0.3, 1.0)], "candidate int, sim_min double, mu_min double").collect())
    dense = v.join(cosine_clusters._densities(v, 5, s), "id")
    assert dense.count() == 120 and dense.agg(F.min(F.get("rho", F.lit(0)))).first()[0] > 118e9
    assert cosine_clusters._between(cosine_clusters._classes(dense, 5, s), 5, s).count() == 10


def test_points_without_a_vector(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.8, 0.2]), (4, None), (None, [1.0, 0.0]), (5, [float("nan"), 1.0]), (6, [0.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    assert {r["point"] for r in cosine_clusters.cosine_fdbscan(v, 0.3, 1.0).collect()} == {1, 2, 3}
    twice = v.unionByName(v.filter("id = 1"))
    assert {r["point"] for r in cosine_clusters.cosine_fdbscan(twice, 0.3, 1.0).collect()} == {1, 2, 3}
    with pytest.raises(Exception, match="differ in size"):
        cosine_clusters.cosine_fdbscan(v.unionByName(spark.createDataFrame([(9, [1.0])], v.schema)), 0.3, 1.0).collect()


def test_rounds_know_their_size(spark):
    edges = spark.createDataFrame([(0, k, k + 1) for k in range(40)], "g int, a long, b long")
    nodes = edges.select("g", F.col("a").alias("node")).union(edges.select("g", "b"))
    got = components.components(nodes, edges, ["g"])
    assert {r["label"] for r in got.collect()} == {0}
    assert int(str(got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1_000_000


@pytest.mark.parametrize("name", ["fdbscan_noise", "membership_entropy", "fdbscan_members"])
def test_clusters_keep_no_table_of_pairs(spark, folder, monkeypatch, name):  # noqa: F811
    monkeypatch.setattr(vectors, "BLOCK", 60)
    monkeypatch.setattr(vectors, "similar_pairs", None)
    d, rows = folder
    m = brute_fdbscan([r[0] for r in rows], cosines(rows), catalog._SIM, catalog._MU)
    within = [p for p, _ in m]
    want = {"fdbscan_noise": {r[0] for r in rows} - set(within), "membership_entropy": {p for p in within if within.count(p) > 1}, "fdbscan_members": set(within)}
    assert {r["point"] for r in catalog.QUERIES[name](spark, d).collect()} == want[name]


def test_batch_ranking_meets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 30)
    monkeypatch.setattr(vectors, "QUERIES", 7)
    rng = np.random.default_rng(3)
    m = rng.integers(-2, 3, (150, 4)).astype(float)  # with copies and rows of no length
    v = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(m)] + [(900, None)], "id long, vec array<double>")
    out = vectors.vector_rank_batch(v, v.filter("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec")), 6)
    assert "NestedLoop" not in out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    n = np.sqrt((m * m).sum(1))
    s = np.round(np.divide(m @ m.T, np.outer(n, n), out=np.zeros((150, 150)), where=np.outer(n, n) != 0), 9)
    for k in range(0, 150, 10):
        want = [(j, s[k, j]) for j in sorted(range(150), key=lambda j: (-s[k, j], j))[:6]]
        assert [i for i, _ in got[k]] == [i for i, _ in want] and all(abs(a - b) < 2e-9 for (_, a), (_, b) in zip(got[k], want))
    assert got[900] == [(j, None) for j in range(6)]


def test_characters_as_a_string(spark):
    from stratum.operators import bm25

    docs = spark.createDataFrame([(1, "金金金城, 金 金城"), (2, "𠀀金𠀀金𠀀 x 城"), (3, None), (4, "abc"), (5, "城金城金城")], "id long, text string")
    a, b = bm25.build_index(docs, "id", "text", "han"), bm25.build_characters(docs, "id", "text")
    for phrases in ([["金"]], [["金", "金"]], [["城", "金", "城"]], [["𠀀", "金", "𠀀"], ["金", "城"]], [["金城"]], [[".", "金"]]):
        want = bm25.search(a, phrases, 20).collect()
        assert bm25.search(b, phrases, 20).collect() == want
        assert bm25.index_stats(a, phrases).first() == bm25.index_stats(b, phrases).first()


def test_han_index_holds_no_arrays(spark, tmp_path):
    """An array of one-character strings took longer to write and to search than the limit allows at 6 GB."""
    d = str(tmp_path)
    spark.createDataFrame([(1, "The other, the der", "en", "a"), (2, "Öder 山", "de", "b"), (3, None, "en", "a")], "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    index = catalog.characters_index(spark, d, "han")
    assert dict(index.dtypes)["tokens"] == "string"
    assert [r["n_tokens"] for r in index.orderBy("id").collect()] == [14, 4, 0]
    assert {r["id"] for r in catalog.bm25_han(spark, d).collect()} == {1, 2}
    assert {r["term"]: r["cf"] for r in catalog.han_characters(spark, d).collect()}["山"] == 1


def test_characters_are_counted_in_place(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, "The kk K 山山𠀀", "en", "a"), (2, None, "en", "a"), (3, "", "en", "a")], "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    out = catalog.han_characters(spark, d)
    assert "Generate" not in out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
    want = {catalog.han(c): n for c, n in (("t", 1), ("h", 1), ("e", 1))} | {"山": 2, "𠀀": 1}
    want[catalog.han("k")] = want.get(catalog.han("k"), 0) + 3
    assert {r["term"]: r["cf"] for r in out.collect()} == want


@pytest.mark.parametrize("name", [
    "cooc_article",
    "cooc_neighbor_type",
    "cooc_paragraph",
    "ego_degree",
    "ego_jaccard",
    "ego_neighbors",
    "ego_pairs",
    "fdbscan_auto",
    "fdbscan_suggest",
    "lookup_occurrences",
    "place_clusters",
    "place_noise",
])
def test_mentions_are_dealt_by_their_rows(spark, monkeypatch, name):
    """A task of the join of lines with orders has so many rows at most, whatever Spark's own number of parts is."""
    from stratum.operators import storage

    parts, deal = [], storage.dealt

    def seen(rows, *tables):
        out = deal(rows, *tables)
        parts.extend(df.rdd.getNumPartitions() for df in out)
        return out

    monkeypatch.setattr(storage, "TASK_ROWS", 400)
    monkeypatch.setattr(storage, "dealt", seen)
    catalog.QUERIES[name](spark, "/root/testdata/sf0.001").limit(1).count()
    lines = catalog.table(spark, "/root/testdata/sf0.001", "lineitem").count()
    assert parts and min(parts) >= lines / 400 > 4


def test_quantile_gathers_no_group(spark):
    from stratum.operators import clustering

    v = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), ((F.col("id") * 7919) % 3000).cast("double").alias("v"))
    one = clustering.quantile(v, [], "v", 0.8)
    assert "SortMergeJoin" not in one._sc._jvm.PythonSQLUtils.explainString(one._jdf.queryExecution(), "simple")
    rows = v.collect()
    at = lambda xs: sorted(xs)[int(0.8 * (len(xs) - 1))]
    assert one.first()[0] == at([r["v"] for r in rows])
    got = {r["g"]: r["q"] for r in clustering.quantile(v, ["g"], "v", 0.8).collect()}
    assert got == {g: at([r["v"] for r in rows if r["g"] == g]) for g in "ab"}
