import pytest
from pyspark.sql import functions as F

from stratum.operators import bm25, evaluate, expand, fusion, vectors

DOCS = ["金 城 金 城 王", "金 城", "王 王 王 水", "水 江 江 江", "漢 城 金", "金", "A bc57 年", "x", "y"]


@pytest.fixture(scope="module")
def index(spark):
    rows = [(i, d.lower().split()) for i, d in enumerate(DOCS, 1)]
    return spark.createDataFrame(rows, "id long, tokens array<string>").withColumn("n_tokens", F.size("tokens")).cache()


@pytest.mark.parametrize("phrases, expected", [
    (["金 城"], {2: -1.2237706506682742, 1: -1.2122618357717073}), (["江 江"], {4: -2.0910259297829232}),
    (["金 城", "王"], {1: -2.0212817638285587, 3: -1.5593206677869946, 2: -1.2237706506682742}), (["bc57"], {7: -1.6502150580989554}), (["金 水"], {}),
])
def test_scores(spark, index, phrases, expected):
    ps = [p.split() for p in phrases]
    rows = bm25.search(index, ps).collect()
    assert [r["id"] for r in rows] == list(expected)
    assert [r["score"] for r in rows] == [round(v, 6) for v in expected.values()]
    q = spark.createDataFrame([(1, i, p) for i, p in enumerate(ps)], "query_id long, phrase_id int, tokens array<string>")
    batch = bm25.batch_search(bm25.postings(index), bm25.index_stats(index), q).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in batch] == [(r["id"], r["score"]) for r in rows]


def test_idf_floor_and_edges(spark, index):
    i = spark.createDataFrame([(1, ["a"]), (2, ["a"]), (3, ["a", "b"])], "id long, tokens array<string>").withColumn("n_tokens", F.size("tokens"))
    assert [r["score"] for r in bm25.search(i, [["a"]]).collect()] == [-1e-6, -1e-6, -1e-6]
    assert bm25.search(index, []).count() == 0 and bm25.search(index, [[]]).count() == 0
    with pytest.raises(ValueError):
        bm25.search(index, [["a"]], -1)
    # statistics are of the whole index
    assert [r["score"] for r in bm25.search(index, [["金", "城"]], where=F.col("id") == 2).collect()] == [round(-1.2237706506682742, 6)]


def test_fusion(spark):
    r = spark.createDataFrame([("a", 1, 1, 2.0), ("b", 2, 1, 1.0)], "arm string, item long, rank int, weight double")
    assert {x["item"]: x["score"] for x in fusion.weighted_rrf(r).collect()} == {1: round(2 / 61, 12), 2: round(1 / 61, 12)}
    r = spark.createDataFrame([(9, 1), (100, 1), (10, 1)], "item long, rank int")
    assert [x["item"] for x in fusion.sort_fused(fusion.rrf(r)).collect()] == [9, 10, 100]
    with pytest.raises(ValueError):
        fusion.rrf(r, 0)


def test_vectors(spark):
    v = spark.createDataFrame([(10, [1.0, 0.0]), (20, [0.0, 1.0]), (30, [0.7, 0.7])], "id long, vec array<float>")
    assert [r["id"] for r in vectors.vector_rank(v, [1.0, 0.0], 3).collect()] == [10, 30, 20]
    assert vectors.vector_rank(v, [1.0, 0.0], 0).count() == 0
    q = spark.createDataFrame([([2.0, -3.0, 0.5],)], "v array<double>").select(vectors.quantize_int8(F.col("v")).alias("q"), vectors.dequantize_int8(vectors.quantize_int8(F.col("v"))).alias("d")).first()
    assert q["q"] == [127, -127, 64] and q["d"][:2] == [1.0, -1.0] and abs(q["d"][2] - 0.5) <= 1 / 127
    with pytest.raises(Exception, match="size"):
        vectors.vector_rank(v, [1.0], 3).collect()
    meta = spark.createDataFrame([(2,)], "dim int")
    assert vectors.load_vectors(v, meta, "id", "vec")["all"].count() == 3 and vectors.load_vectors(v, meta.limit(0), "id", "vec") == {}
    e = vectors.embed(spark.createDataFrame([("ab",), (None,)], "t string"), "t", lambda ts: [[float(len(t))] for t in ts])
    assert sorted(r["vec"][0] for r in e.collect()) == [0.0, 2.0]


def test_metrics(spark):
    ranks = spark.createDataFrame([("a", i, i) for i in range(1, 6)] + [("b", x, i) for i, x in enumerate([9, 8, 2, 1], 1)] + [("c", x, i) for i, x in enumerate([3, 1, 2], 1)] + [("d", 1, 1)], "q string, item long, rank int")
    rel = spark.createDataFrame([("a", 2), ("a", 4), ("a", 9), ("b", 2), ("c", 1), ("c", 2)], "q string, item long")
    m3 = {r["q"]: r for r in evaluate.per_query(ranks, rel, 3, ["q"]).collect()}
    m5 = {r["q"]: r for r in evaluate.per_query(ranks, rel, 5, ["q"]).collect()}
    assert abs(m3["a"]["recall"] - 1 / 3) < 1e-8 and abs(m5["a"]["recall"] - 2 / 3) < 1e-8
    assert abs(m3["b"]["rr"] - 1 / 3) < 1e-8 and m3["d"]["recall"] == m3["d"]["ndcg"] == 0.0 and m3["d"]["hit"] == 0
    from math import log2

    assert abs(m3["c"]["ndcg"] - (1 / log2(3) + 1 / 2) / (1 + 1 / log2(3))) < 1e-8
    assert evaluate.means(evaluate.per_query(ranks, rel, 3, ["q"]), []).first()["queries"] == 4


def test_expansion(spark):
    t = spark.createDataFrame([("遼", "辽"), ("東", "东"), ("後", "后")], "char string, simplified string")
    q = spark.createDataFrame([("辽东",), ("后",), ("王",)], "q string")
    rows = {r["q"]: (r["candidates"], r["changed"]) for r in expand.expand_traditional(q, "q", t).collect()}
    assert rows["辽东"] == (["遼東", "辽东"], True) and rows["后"] == (["後", "后"], True) and rows["王"] == (["王"], False)
    many = spark.createDataFrame([(a, "x") for a in "abcdef"], "char string, simplified string")
    assert len(expand.expand_traditional(spark.createDataFrame([("xxx",)], "q string"), "q", many).first()["candidates"]) == 17
    m = spark.createDataFrame([(1, "石橋"), (1, "松江"), (2, "松江"), (2, "王城")], "group_id int, surface string")
    assert {r[0] for r in expand.expand_variants(m, "石橋").collect()} == {"石橋", "松江"}
    assert {r[0] for r in expand.expand_variants(m, "松江").collect()} == {"石橋", "松江", "王城"}
    assert [r[0] for r in expand.expand_variants(m, "x").collect()] == ["x"]


def test_filter_is_not_pushed_into_the_tokeniser(spark):
    from stratum.plans.explain import summary

    d = spark.createDataFrame([(1, "of the x"), (2, "the of")], "doc_id long, text string")
    hits = bm25.search(bm25.build_index(d, "doc_id", "text"), [["of", "the"]])
    assert [r["id"] for r in hits.collect()] == [1]
    assert summary(hits)["BroadcastNestedLoopJoin"] == summary(hits)["CartesianProduct"] == 0
