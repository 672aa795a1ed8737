"""Every operator over nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.llm import decontam, lm, mixing, neardup, pii, quality, repeats, sharding, topk, warc

RND = random.Random(3)
WORDS = ["the", "of", "and", "tion", "ment", "heit", "über", "Ré", "x1", "stone", "river", "glass", "paper", "light"] + [f"w{i}" for i in range(60)]


def prose(n, seed=None):
    r = random.Random(seed) if seed is not None else RND
    return " ".join(r.choice(WORDS) for _ in range(n))


BASE = prose(120, 1)
NEAR = BASE.replace(BASE.split()[50], "changed", 1)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, size int, shard string, tk string, r string"
ROWS = (
    [(i, prose(40, i), "en", f"s{i % 3}", 200, None, "k", i, "x", None, "r") for i in range(1, 25)]
    + [(30, BASE, "en", "s0", 700, 1.0, "k", 1, "x", "t", "r"), (31, NEAR, "de", None, None, None, None, None, None, None, None), (32, BASE.upper(), "en", "s1", 700, 1.0, "k", 1, "x", "t", "r")]
    + [(40, None, None, None, None, None, None, None, None, None, None), (41, "", "en", "s0", 0, None, None, 0, None, None, None), (42, " \t\n", "fr", "s1", 3, None, None, 0, None, None, None), (43, "one", "fr", "s2", 3, None, None, 0, None, None, None)]
    + [(None, "no id here at all, mail a.b@c.de", "en", "s0", 30, None, None, 0, None, None, None)]
    + [(50, "twice the very same row in this table", "en", "s2", 30, None, None, 0, None, None, None)] * 2
    + [(60, prose(6000, 9) + " " + BASE, "en", "s2", 30000, None, None, 0, None, None, None)]
)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(t):
    return (t or "").encode().lower().split()


def test_shards(spark, docs, none):
    rows = sharding.assign(docs).collect()
    assert len(rows) == len(ROWS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    total, most = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for s, v in by.items():
        assert 0 <= s < 16 and sorted(r["slot"] for r in v) == list(range(len(v))) and abs(sum(r["size"] for r in v) - total / 16) <= most
    full = sharding.shard_rows(docs)
    assert full.columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot"] and full.count() == len(ROWS)
    assert sharding.assign(none).count() == 0 and sharding.shard_rows(none).count() == 0


def test_hilbert_neighbours():
    pts = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    h = sharding.hilbert_index(pts, 3)
    assert sorted(h) == list(range(512))
    assert (np.abs(np.diff(pts[np.argsort(h)], axis=0)).sum(1) == 1).all()


def test_lm(spark, docs, none):
    rows = lm.score(docs).collect()
    assert len(rows) == len(ROWS) and lm.score(none).count() == 0
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter()
    for r in ROWS:
        if not held(r[0]):
            c.update([*words_of(r[1]), "END"])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r in ROWS:
        ws = [*words_of(r[1]), "END"]
        want[(r[0], held(r[0]), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)


def small_model():
    """A model of 300 ids, the end last, with random parameters and counts from made-up texts."""
    rng = np.random.default_rng(3)
    texts = [np.r_[rng.choice(40, rng.integers(1, 90)) ** 2 % 90, 299] for _ in range(60)]
    flat = np.concatenate(texts)
    counts = np.bincount(flat, minlength=300)
    rows = lm.input_rows(counts)
    pairs, n = np.unique(rows[np.r_[299, flat[:-1]]].astype(np.int64) * lm.INPUTS + rows[flat], return_counts=True)
    m = lm.Model(counts, pairs, n)
    m.with_triples(rng.integers(0, 9, (int(m.contexts.value.max()) + 1, lm.CLASSES)) * (np.bincount(m.cls, minlength=lm.CLASSES) > 0))
    m.wc = rng.standard_normal(m.wc.shape).astype(np.float32)
    return m, texts


def test_lm_is_a_distribution_and_windows_do_not_matter():
    m, texts = small_model()
    rng = np.random.default_rng(1)
    for one, two in ((m.row[1], m.row[4]), (m.end_row, m.end_row), (lm.INPUTS - 2, m.row[9])):
        same = lambda x: np.full(300, x, np.int32)
        lp = m.log_probs(np.tile(rng.standard_normal(lm.D).astype(np.float32), (300, 1)), same(one), same(two), np.arange(300))
        assert abs(np.exp(lp).sum() - 1) < 1e-4
    seq = [*texts[:9], np.array([299]), np.array([2] * 15 + [299]), np.array([4] * 16 + [299])]
    one = np.concatenate([lm.score_sequences(m, [s]) for s in seq])
    assert np.allclose(lm.score_sequences(m, seq), one, atol=1e-3)


def test_lm_attention_by_hand():
    """Token by token, without batches and masks."""
    m, texts = small_model()
    for t in texts[:6]:
        x = [m.end_row, *m.row[t[:-1]]]
        total = 0.0
        for i, y in enumerate(t):
            first = max(0, (i // lm.BLOCK - 1) * lm.BLOCK)
            w = [math.exp(float(np.dot(m.eq[x[i]].astype(float), m.ekv[x[j], : lm.D])) + float(m.far[i - j])) for j in range(first, i + 1)]
            h = sum(a * m.ekv[x[j], lm.D :].astype(float) for a, j in zip(w, range(first, i + 1))) / sum(w)
            two = x[i - 1] if i else m.end_row
            there, at = m.contexts.find(np.array([two * lm.INPUTS + x[i]]))
            z = m.start[lm.INPUTS + at[0] if there[0] else x[i]] + h @ m.wc
            n = dict(zip(m.pairs.tolist(), m.pair_counts.tolist())).get(x[i] * lm.INPUTS + m.row[y], 0)
            inside = (n + lm.BACK_ID * m.share[y]) / (m.by_class[x[i], m.cls[y]] + lm.BACK_ID)
            total += z[m.cls[y]] - math.log(np.exp(z.astype(float)).sum()) + math.log(inside)
        assert abs(total - lm.score_sequences(m, [t])[0]) < 1e-2


def test_lm_gradients():
    m, texts = small_model()
    win, y, _ = lm.windows(m, texts[:5])
    _, grads, n = m.gradients(win, y)
    loss = lambda: float(m.gradients(win, y)[0]) * n
    for name, at in (("wc", (2, 3)), ("far", (5,)), ("eq", (int(m.row[4]), 1)), ("ekv", (int(m.row[4]), 2)), ("ekv", (int(m.row[9]), lm.D + 1))):
        x, g = getattr(m, name), grads[name]
        want = g[at] if not isinstance(g, tuple) else g[1][g[0] == at[0], at[1]].sum()
        old = x[at]
        x[at] = old + 0.02
        up = loss()
        x[at] = old - 0.02
        down = loss()
        x[at] = old
        assert abs((up - down) / 0.04 - want) < 0.05 * max(1, abs(want)), name


def test_lm_beats_the_base(spark):
    """Held-out texts of 200 words of which each is followed by one of three."""
    r = random.Random(4)

    def text():
        at = [r.randrange(200)]
        for _ in range(119):
            at.append((at[-1] * 7 + r.randrange(1, 4)) % 200)
        return " ".join(f"{WORDS[i % 14]}{i}" for i in at)

    d = spark.createDataFrame([(i, text()) for i in range(300)], "doc_id long, text string").repartition(4)
    x = lm.score(d).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert x[2] > 3000 and x[0] > x[1]


def test_quality(spark, docs, none):
    good = [(i, prose(60, i), 1) for i in range(100, 260)]
    bad = [(i, "spam!!! " * 40, 0) for i in range(300, 420)]
    d = spark.createDataFrame([(i, t) for i, t, _ in good + bad] + [(1, None), (2, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in good + bad] + [(100, None, None), (None, 1, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(d, labels).collect()
    truth = {i: q for i, _, q in good + bad}
    out = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(out) > 30 and sum(r["predicted"] == truth[r["doc_id"]] for r in out) / len(out) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows) and len(rows) == 283
    assert {r["score"] for r in quality.classify(d, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(none, labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns and quality.keep_good(none, labels).count() == 0


PII = "Mail joe.x@mail.example.com; ip 10.0.0.255 and 10.0.0.256, v 1.2.3.4.5 card 4111 1111 1111 1111 bad 4111111111111112 call +1 (269) 555-3296. née é a@b.c_d@e.f +12 (3)"
RX = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for k, rx in RX.items():
        for m in re.finditer(rx, t):
            d = re.sub("[^0-9]", "", m[0])
            if k == "email" or k == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or k == "card" and 16 <= len(d) <= 19 and luhn(d) or k == "phone" and 8 <= len(d) <= 15:
                out.append((list(RX).index(k), m.start(), m.end()))
    return out


def test_pii(spark, docs, none):
    texts = [PII, "", None, "\U00020000 a@b.cc" + "1.2.3.4 " * 50, "9" * 5000, "a.b@" + "c." * 3000 + "d", "1-1" * 3000, "+" + "1 " * 50]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.extract(d).collect():
        assert [tuple(b) for b in r["base"]] == base_spans(texts[r["doc_id"]] or ""), texts[r["doc_id"]]
        assert r["added"] == []
    assert pii.extract(docs).count() == len(ROWS) and pii.extract(none).count() == 0


def test_pii_discovers_by_context(spark):
    seeds = [(i, f"some text then my card number 411111111111{d} please {i}") for i, d in enumerate(["1111", "1129", "1137", "1145", "1152", "1160", "1178", "1186"])]
    seeds = [(i, t) for i, t in seeds if base_spans(t)]
    assert len(seeds) >= 3
    d = spark.createDataFrame(seeds * 2 + [(90, "give my card number 4111111111112 please"), (91, "order 4111111111113 came")], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(x) for x in r["added"]] for r in pii.extract(d).collect()}
    assert all(v == [] for k, v in got.items() if k != 90)
    assert got[90] == [(2, 20, 33)]


def test_pii_discovers_each_kind(spark):
    """Seeds of a kind teach a context; a form that the base patterns miss is found there, and nowhere else."""
    cards = [c for c in (f"411111111111{i:04d}" for i in range(10000)) if base_spans(c)][:6]
    rows = (
        [(i, f"please write to my private address user{i}@mail.example.com before noon {i}") for i in range(6)]
        + [(10 + i, f"the server answers at numeric host 10.0.0.{i} since monday {i}") for i in range(6)]
        + [(20 + i, f"they charged the credit card {c} again today {i}") for i, c in enumerate(cards)]
        + [(30 + i, f"ring us on telephone number +1 (269) 555-329{i} after lunch {i}") for i in range(6)]
        + [(90, "please write to my private address someone (at) mail (dot) example before noon"), (91, "the server answers at numeric host 10-20-30-177 since monday"), (92, "they charged the credit card 4111111111112 again today"), (93, "ring us on telephone number 269.555.3299 after lunch")]
        + [(94, "an order of 4111111111112 pieces"), (95, "call 269.555.3299 or not"), (96, "x4111111111112y = \"9b0b572391524\" the credit card")]
    )
    got = {r["doc_id"]: [(k, rows_text[s:e]) for k, s, e in r["added"]] for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect() for rows_text in [dict(rows)[r["doc_id"]]]}
    assert {i: v for i, v in got.items() if v} == {90: [(0, "someone (at) mail (dot) example")], 91: [(1, "10-20-30-177")], 92: [(2, "4111111111112")], 93: [(3, "269.555.3299")]}


def test_pii_common_context_does_not_promote(spark):
    """A context in which identifiers of all kinds and plain numbers stand says nothing of one kind."""
    cards = [c for c in (f"411111111111{i:04d}" for i in range(10000)) if base_spans(c)][:5]
    rows = [(i, f"of the {c} in a{i}") for i, c in enumerate(cards)] + [(10 + i, f"of the u{i}@m.example in b{i}") for i in range(5)] + [(20 + i, f"of the 100000{i}7 in c{i}") for i in range(5)]
    assert all(r["added"] == [] for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def jaccard_classes(rows, k, percent):
    sets = []
    for r in rows:
        w = words_of(r[1])
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    n = len(rows)
    top = list(range(n))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                top[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        if sets[i] and r[0] is not None:
            low[root(i)] = min(low.get(root(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), low.get(root(i)) if sets[i] else r[0]) for i, r in enumerate(rows))


def test_near_duplicates(spark, docs, none):
    rows = [r[:2] for r in ROWS]
    b = BASE.split()
    chain = [(200 + i, " ".join(b[:20] + [f"c{j}" for j in range(i * 3)] + b[20 + i * 3 :])) for i in range(12)]  # links from one to the next
    many = spark.createDataFrame(rows + chain, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.classes(many).collect())
    assert got == jaccard_classes(rows + chain, 2, 80)
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] or 0) for r in kept.select("doc_id").collect())
    assert 30 in ids and 31 not in ids and 32 not in ids and ids.count(50) == 1 and {40, 41, 42, 43, 60} <= set(ids)
    assert neardup.classes(none).count() == 0 and neardup.one_of_each(none).count() == 0


def test_hyperminhash_estimate():
    rng = np.random.default_rng(0)
    for j in (0.3, 0.8, 0.95):
        x = rng.integers(0, 2**63, 6000, dtype=np.uint64)
        c = int(3000 * 2 * j / (1 + j))
        a, b = np.unique(x[:3000]), np.unique(x[3000 - c : 6000 - c])
        est, _ = neardup.estimate(neardup.sketch(a)[None], neardup.sketch(b)[None], np.array([len(a)]), np.array([len(b)]))
        assert abs(est[0] - j) < 0.15


def test_warc(spark, none):
    rows = [(1, "http://a/b c", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u\r\nX: y", None), (4, "u", ""), (None, "u", "<p>x</p>"), (5, "ü", "é" * 9000), (5, "ü", "é" * 9000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(warc.planned(pages), 200)).collect()
    import base64

    dig = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = Counter((i, u or "", len((h or "").encode()), dig(h), "response" if i == top[h or ""] else "revisit", None if i == top[h or ""] else top[h or ""]) for i, u, h in rows)
    assert Counter(tuple(r) for r in got) == want
    assert warc.read_archives(warc.write_archives(warc.planned(pages.limit(0)))).count() == 0


def test_warc_breaks():
    good = warc.encode_record(1, "u", b"abc") + warc.encode_record(2, "u", b"")
    assert [r[0] for r in warc.read_records(good)] == [1, 2] and [len(m) > 0 for m in warc.members(good, 7)] == [True, True]
    for bad in (good[:-3], b"junk", good + b"x"):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(bad))
    z = zlib.decompress(warc.encode_record(1, "u", b"abc"), 31)
    for a, b in ((b"abc", b"abd"), (b"Content-Length: ", b"Content-Length: 1")):
        with pytest.raises(warc.WarcError):
            c = zlib.compressobj(6, zlib.DEFLATED, 31)
            list(warc.read_records(c.compress(z.replace(a, b)) + c.flush()))


def test_mixing(spark, docs, none):
    p = mixing.plan(docs).collect()
    assert len(p) == len(ROWS) and mixing.plan(none).count() == 0
    goal = {r["source_key"]: (r["target"], r["source_size"]) for r in p}
    total = sum(len(words_of(r[1])) for r in ROWS)
    assert abs(sum(t for t, _ in goal.values()) - total) < 1e-6 * total and all(t <= 3 * s + 1e-6 for t, s in goal.values())
    for k, (t, s) in goal.items():
        mine = [r for r in p if r["source_key"] == k]
        assert abs(sum(r["size"] * r["copies"] for r in mine) - t) <= max(r["size"] for r in mine) and all(r["copies"] <= 3 for r in mine)
    m = mixing.mix(docs)
    assert m.columns == docs.columns and m.count() == sum(r["copies"] for r in p)
    assert sorted(map(str, m.select("doc_id").collect())) == sorted(map(str, mixing.mix(docs).select("doc_id").collect()))


def test_repeats(spark, docs, none):
    body = "".join(chr(97 + random.Random(5).randrange(26)) for _ in range(1)) + "".join(random.Random(6).choices("abcdefgh ", k=1500))
    other = "".join(random.Random(7).choices("abcdefgh ", k=900))
    texts = [body, other[:300] + body[200:900] + other[300:], "ab" * 700, None, "", body[:399], "é" * 350, other, other] + [f"{other[i:i + 5]}{body[100 + i : 560 + i]}" for i in range(0, 60, 7)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = Counter(b[i : i + 400] for t in texts for b in [(t or "").encode()] for i in range(len(b) - 399))
    for r in repeats.strip(d).collect():
        b = (texts[r["doc_id"]] or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = [True] * 400
        assert bytes(r["kept"]) == bytes(x for x, g in zip(b, gone) if not g) and r["n_bytes"] == len(b), r["doc_id"]
        assert r["n_removed"] == sum(gone) and r["n_spans"] == sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
    assert repeats.strip(docs).count() == len(ROWS) and repeats.strip(none).count() == 0


def test_shared_words(spark, docs, none):
    r = random.Random(8)
    word = lambda k: "".join(r.choices("abcdé", k=r.randrange(1, 4))) + str(k)
    passage = [word(k) for k in range(60)]
    own = lambda n, a: [f"o{a}x{k}" for k in range(n)]
    texts = [" ".join(own(30, 1) + passage + own(20, 2)), "\n".join(own(7, 3) + passage + own(90, 4)), " ".join(own(70, 5) + passage[:50]), " ".join(passage[9:] + own(5, 6)), None, "", " ".join(own(60, 7)), " ".join(own(60, 7)), " ".join(own(40, 8)), " ".join(own(40, 8)), " ".join(own(51, 9) + own(51, 9)), " ".join(own(3, 10) + passage + passage[:55] + own(3, 11)), " ".join(own(3, 10) + passage + passage[:53])]
    split = [(t or "").split() for t in texts]
    got = {bytes(x["tk"]): x["n_shared_words"] for x in repeats.shared_words(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    for i, (t, w) in enumerate(zip(texts, split)):
        seen = {tuple(v[j : j + 51]) for k, v in enumerate(split) if k != i for j in range(len(v) - 50)}
        gone = [False] * len(w)
        for j in range(len(w) - 50):
            if tuple(w[j : j + 51]) in seen:
                gone[j : j + 51] = [True] * 51
        assert got.get(hashlib.md5((t or "").encode()).digest(), 0) == sum(gone), i
    assert repeats.shared_words(none).count() == 0


def test_decontamination(spark, docs, none):
    items = [(1, BASE[:200]), (2, " ".join(BASE.split()[30:50])), (3, "no such item in any of the texts"), (4, None), (5, ""), (6, "one"), (None, "the very same row in this"), (2, " ".join(BASE.split()[30:50]))]
    t = spark.createDataFrame(items, "item_id long, text string")

    def grams(x, k):
        w = words_of(x)
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want = Counter()
    for r in ROWS:
        for i, x in items:
            k = min(5, len(words_of(x)))
            s = grams(x, k) if k else set()
            if s and len(s & grams(r[1], k)) >= 0.8 * len(s):
                want[(r[0], i, len(s), len(s & grams(r[1], k)))] += 1
    assert Counter((r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in decontam.find(docs, t).collect()) == want
    left = decontam.drop_contaminated(docs, t)
    assert left.columns == docs.columns and left.count() == len(ROWS) - sum(1 for r in ROWS if any(k[0] == r[0] for k in want))
    assert decontam.find(none, t).count() == 0 and decontam.find(docs, t.limit(0)).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(2)
    v = [(i, [float(np.float32(x)) for x in rng.standard_normal(8)]) for i in range(120)]
    v += [(7, v[50][1]), (200, None), (201, [1.0, None]), (202, [float("nan")]), (None, [1.0] * 8), (250, [1.0, 2.0]), (300, [0.0] * 8), (203, []), (50, v[50][1])]
    t = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e in v if i is not None and e and not any(x is None or not math.isfinite(x) for x in e)]
    want = {}
    for q, e in ok:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(e, f)), i) for i, f in ok if i != q)
            want.setdefault(q, []).extend(s)
    got = {}
    for r in topk.topk(t, t.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert got == {q: sorted(s)[:5] for q, s in want.items()}
    assert topk.topk(t.limit(0), t).count() == 0 and topk.topk(t, t.limit(0)).count() == 0


def test_near_duplicates_of_a_hot_passage(spark):
    """Hundreds of texts share a passage and nearly reach the threshold; some chains of them do."""
    passage = prose(60, 77)
    rows = [(i, f"{passage} {' '.join(f'v{i}x{j}' for j in range(14 + i % 3))}") for i in range(320)]
    rows += [(1000 + i, f"{passage} {' '.join(f'z{j}' for j in range(i, i + 16))}") for i in range(40)]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == jaccard_classes(rows, 2, 80)
