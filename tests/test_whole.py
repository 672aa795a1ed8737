"""Queries do the whole job: no row is left out by its id, and no step by a fixed stop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum import catalog
from stratum.operators import vectors


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Vectors in three groups, most of them with ids of 500 and more."""
    rng = np.random.default_rng(4)
    mid = rng.standard_normal((3, 12))
    rows = []
    for k in range(260):
        e = mid[k % 3] + rng.standard_normal(12) * (0.55 if k % 5 else 3)
        rows.append((k if k < 40 else 470 + k, [float(np.float32(x)) for x in e], k % 4))
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d, rows


def cosines(rows):
    v = np.array([r[1] for r in rows], np.float64)
    n = np.sqrt((v * v).sum(1))
    return np.round(v @ v.T / (n[:, None] * n), 9)


def brute_fdbscan(ids, s, least, mu):
    """{(id, cluster): (membership, core)}"""
    near = (s >= least) & (s > 0) & ~np.eye(len(ids), dtype=bool)
    core = np.round((s * near).sum(1), 12) >= mu
    top = {int(i): int(i) for i in np.flatnonzero(core)}
    while True:
        new = {i: min([t] + [top[j] for j in np.flatnonzero(near[i] & core)], key=lambda x: ids[x]) for i, t in top.items()}
        if new == top:
            break
        top = new
    number = {t: k for k, t in enumerate(sorted(set(top.values()), key=lambda x: ids[x]))}
    out = {(ids[i], number[t]): (1.0, True) for i, t in top.items()}
    for i in np.flatnonzero(~core):
        js = np.flatnonzero(near[i] & core)
        for c in {number[top[j]] for j in js}:
            out[(ids[i], c)] = (round(float(sum(s[i, j] for j in js if number[top[j]] == c) / s[i, js].sum()), 6), False)
    return out


def test_clustering_takes_all_vectors(spark, folder, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 50)
    monkeypatch.setattr(vectors, "TILE", 16)
    d, rows = folder
    ids = [r[0] for r in rows]
    want = brute_fdbscan(ids, cosines(rows), catalog._SIM, catalog._MU)
    got = {(r["point"], r["cluster"]): (r["membership"], r["core"]) for r in catalog.fdbscan_members(spark, d).collect()}
    assert got.keys() == want.keys() and all(got[k][1] == v[1] and abs(got[k][0] - v[0]) < 2e-6 for k, v in want.items())
    assert {r[0] for r in catalog.fdbscan_noise(spark, d).collect()} == set(ids) - {k[0] for k in want}
    h = {}
    for (p, _), (m, _) in want.items():
        h.setdefault(p, []).append(m)
    got = {r["point"]: r["entropy"] for r in catalog.membership_entropy(spark, d).collect()}
    want_h = {p: -sum(x * np.log(x) for x in m) for p, m in h.items() if len(m) > 1}
    assert got.keys() == want_h.keys() and all(abs(got[p] - x) < 1e-5 for p, x in want_h.items())
    sweep = {r["candidate"]: r for r in catalog.fdbscan_sweep(spark, d).collect()}
    for i, a in enumerate(catalog.clustering.FACTORS):
        m = brute_fdbscan(ids, cosines(rows), round(catalog._SIM * a, 12), round(catalog._MU, 12))
        assert abs(sweep[i * 4 + 1]["noise_rate"] - (1 - len({k[0] for k in m}) / len(ids))) < 1e-6


def test_lm_teaches_every_place():
    from stratum.llm import lm

    rng = np.random.default_rng(2)
    counts = np.r_[rng.integers(1, 90, 60), np.zeros(40, np.int64), 30]
    m = lm.Model(counts)
    m.w[: lm.NODES] = rng.standard_normal((lm.NODES, 3 * lm.D)).astype(np.float32)
    seqs = [np.r_[rng.integers(0, 60, k), 100] for k in (0, 1, 15, 16, 31, 40, 47, 100)]
    win, y = lm.training_windows(m, seqs)
    assert sorted(y[y >= 0]) == sorted(np.concatenate(seqs))  # each once
    loss, grads, n = m.gradients(win, y)
    assert n == sum(map(len, seqs))
    for name, i in (("w", (3, 5)), ("w", (70, 20)), ("ev", (2, 1)), ("ek", (4, 3)), ("eq", (5, 2)), ("ep", (1, 1)), ("es", (7, 6)), ("far", (3,)), ("b", (2,))):
        x, e = getattr(m, name), 1e-2
        keep, at = x[i], []
        for d in (e, -e):
            x[i] = keep + d
            at.append(m.gradients(win, y)[0] * n)
        x[i] = keep
        assert abs((at[0] - at[1]) / (2 * e) - grads[name][i]) < 2e-2 * max(1, abs(grads[name][i])), name


def test_shards_tell_long_strings_apart(spark):
    from stratum.llm import sharding

    names = [f"https://example.org/{k}" for k in range(4)] + [f"source_{k}" for k in range(4)]
    d = spark.createDataFrame([(i, "some text", names[i % 8], None if i % 9 == 0 else names[i % 8].encode()) for i in range(160)], "doc_id long, text string, source string, raw binary")
    for c in ("source", "raw"):
        got = {}
        for r in sharding.assign(d, (c,), shards=8).join(d.select("doc_id", F.col(c).alias("v")), "doc_id").collect():
            got.setdefault(r["v"], set()).add(r["cell"])
        got.pop(None, None)
        assert all(len(x) == 1 for x in got.values())
        cells = [got[x].pop() for x in sorted(got)]
        assert cells == sorted(cells) and len(set(cells)) == 8


def test_searches_and_pairs_take_all_vectors(spark, folder, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 50)
    d, rows = folder
    s = cosines(rows)
    ids, label = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    same, other = label[:, None] == label, ids[:, None] != ids
    got = {r["category"]: r for r in catalog.pair_cosine_by_category(spark, d).collect()}
    for c in (True, False):
        x = s[other & (same == c)]
        assert got[c]["pairs"] == len(x) and all(abs(got[c][k] - v) < 2e-6 for k, v in (("mean_sim", x.mean()), ("min_sim", x.min()), ("max_sim", x.max())))
    top = {}
    for r in catalog.vec_topk_batch(spark, d).orderBy("query_id", "rank").collect():
        top.setdefault(r["query_id"], []).append(r["id"])
    want = {int(i): [int(ids[j]) for j in sorted(range(len(ids)), key=lambda j: (-s[k, j], ids[j]))[:10]] for k, i in enumerate(ids) if i % 50 == 0}
    assert len(want) > 4 and top == want


def test_upsert_takes_all_orders(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 7.0)], "c_custkey long, c_acctbal double").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(5, 1, 10.0), (6, 1, 90.0), (7, 2, 30.0), (8, 4, 40.0)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{d}/orders.parquet")
    assert {r["id"]: r["value"] for r in catalog.upsert_latest(spark, d).collect()} == {1: 90.0, 2: 30.0, 3: 7.0, 4: 40.0}


def test_pii_goes_on_until_nothing_is_new(spark, monkeypatch):
    from stratum.llm import pii

    def luhn(n):
        return str(n) + next(str(c) for c in range(10) if sum(x if i % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2) for i, x in enumerate([c, *map(int, reversed(str(n)))])) % 10 == 0)

    seeds = [luhn(411111111111000 + i) for i in range(8)]
    far = [[str(4000000000001 + 10 * k + i) for i in range(4)] for k in range(4)]
    text = ["one first {} next", "two second {} after", "three third {} then", "four fourth {} last"]
    rows = [text[0].format(s) for s in seeds] + [text[0].format(x) for x in far[0]]
    for k in (1, 2, 3):
        rows += [text[k].format(x) for x in far[k - 1] + far[k]]
    got = {r["doc_id"] for r in pii.extract(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect() if r["added"]}
    assert {i for i, t in enumerate(rows) if any(x in t for x in far[3])} <= got
    monkeypatch.setattr(pii, "MOST_ROUNDS", 2)
    with pytest.raises(RuntimeError, match="converge"):
        pii.extract(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
