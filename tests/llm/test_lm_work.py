"""The language model's work: the same results in fewer passes."""

import numpy as np
import pytest

from stratum.llm import lm


def test_masked_places_weigh_nothing():
    """Weights near the least float made the products with them many times slower."""
    rng = np.random.default_rng(5)
    texts = [np.r_[(rng.random(n) ** 2 * 150).astype(int), 299] for n in (0, 1, 15, 16, 40, 90)]
    flat = np.concatenate(texts)
    counts = np.bincount(flat, minlength=300)
    rows = lm.input_rows(counts)
    pairs, n = np.unique(rows[np.r_[299, flat[:-1]]] * lm.INPUTS + rows[flat], return_counts=True)
    m = lm.Model(counts, pairs, n)
    win, y, _ = lm.windows(m, texts)
    a = m.attention(win)[1]
    ahead = np.arange(2 * lm.BLOCK)[None] > lm.BLOCK + np.arange(lm.BLOCK)[:, None]
    assert (a[:, ahead] == 0).all() and (a[:, ~ahead][win[:, 0] != lm._PAD] > 1e-30).all()
    first = win[:, 0] == lm._PAD
    assert first.any() and (a[first][:, :, : lm.BLOCK] == 0).all()
    m.eq *= 1e3  # beyond what needs no clipping
    h, a, *_ = m.attention(win)
    assert np.isfinite(h).all() and np.isfinite(a).all() and (a[:, ahead] == 0).all()


@pytest.fixture
def sub():
    return lm.Subwords(lm.ranks())


ODD = ["The cat, the CAT; it's 12ab'll", "a   b c　 d", None, "", " \n ", "x" * 300 + " \u0085 b \u0085\u0085 été", "漢字　かな  ", "the cat \x1c \x1fz ᠎ q"]


def test_words_cut_together_are_cut_alike(sub, monkeypatch):
    want = [[i for w in lm.words_of(t) for i in sub.ids(w)] + [sub.end] for t in ODD]
    calls = []
    enc = sub._enc

    class Counting:
        def encode_ordinary(self, s):
            calls.append(s)
            return enc.encode_ordinary(s)

    monkeypatch.setattr(sub, "_enc", Counting())
    known = lm.Lexicon(sub)
    for _ in range(2):  # the second time all words are known
        numbers, n, flat, lens = known.cut(ODD)
        known.count(numbers)
        assert [x.tolist() for x in np.split(flat, np.cumsum(lens)[:-1])] == want
        assert n.tolist() == [len(lm.words_of(t)) + 1 for t in ODD]
    plain = [c for c in calls if c.count(" ") > 1]
    assert len(plain) == 1 and "cat" in plain[0]  # one call for all that have no white space of another script
    h, c, ids = known.counted()
    flat = np.concatenate([np.array(x) for x in want])
    hashes, times = np.unique(lm.word_hashes(flat, sub.starts), return_counts=True)
    assert dict(zip(h.tolist(), c.tolist())) == dict(zip(hashes.tolist(), (2 * times).tolist()))
    assert (ids == 2 * np.bincount(flat, minlength=sub.size)).all()


def test_hashes_are_found_exactly():
    rng = np.random.default_rng(9)
    h = np.unique(np.r_[rng.integers(-(1 << 63), 1 << 63, 4000), (7 << 40) + np.arange(50), -np.arange(1, 30)])
    some = rng.permutation(h)[: len(h) // 2]
    want = dict(zip(some.tolist(), rng.random(len(some)).tolist()))
    there, value = lm.Hashes(some, np.array([want[x] for x in some.tolist()]), 8).find(h)
    assert there.tolist() == [x in want for x in h.tolist()]
    assert value[there].tolist() == [want[x] for x in h.tolist() if x in want]
    assert not lm.Hashes(np.empty(0, np.int64), np.empty(0)).find(h)[0].any()


def test_steps_prepared_together_are_the_same_steps():
    rng = np.random.default_rng(11)
    texts = [np.r_[(rng.random(rng.integers(0, 200)) ** 2 * 150).astype(int), 299] for _ in range(300)]
    flat = np.concatenate(texts)
    counts = np.bincount(flat, minlength=300)
    rows = lm.input_rows(counts)
    pairs, n = np.unique(rows[np.r_[299, flat[:-1]]] * lm.INPUTS + rows[flat], return_counts=True)
    one, two = lm.Model(counts, pairs, n), lm.Model(counts, pairs, n)
    win, y, _ = lm.windows(one, texts)
    assert len(win) > 5 * lm.STEP and len(win) % lm.STEP
    one.steps(win, y, {})
    acc = {}
    for a in range(0, len(win), lm.STEP):
        two.step(win[a : a + lm.STEP], y[a : a + lm.STEP], acc, lm.RATE)
    assert np.abs(one.vector() - two.vector()).max() < 1e-6
