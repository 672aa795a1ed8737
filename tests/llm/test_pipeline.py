import corpus_pipeline as P
from stratum import llm


def test_stages(spark, tmp_path):
    from test_cases import BASE, ROWS, SCHEMA, prose

    d = spark.createDataFrame(ROWS, SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 25)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, prose(12, 3))], "item_id long, text string")
    for name, t in (("documents", d), ("labels", labels), ("benchmark", bench)):
        t.write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = d
    for name, f in P.STAGES[:-1]:
        out = f(spark, docs, str(tmp_path))
        assert out.columns == d.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    last = P.run(spark, str(tmp_path))
    assert last.count() == docs.count() and {"shard", "slot"} <= set(last.columns)
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert 3 not in ids and 31 not in ids and 32 not in ids


def test_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in llm.QUERIES) == list(range(1, 11))
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
