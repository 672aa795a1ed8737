"""The language model's output: the attention decides between all ids, not between classes only."""

import numpy as np

from stratum.llm import lm


def trained_output():
    """A model of 300 ids, the end last, of which more have rows than there are classes, with random parameters."""
    rng = np.random.default_rng(3)
    texts = [np.r_[(rng.random(rng.integers(1, 90)) ** 2 * 150).astype(int), 299] for _ in range(60)]
    flat = np.concatenate(texts)
    counts = np.bincount(flat, minlength=300)
    rows = lm.input_rows(counts)
    pairs, n = np.unique(rows[np.r_[299, flat[:-1]]].astype(np.int64) * lm.INPUTS + rows[flat], return_counts=True)
    m = lm.Model(counts, pairs, n)
    m.with_triples(rng.integers(0, 9, (int(m.contexts.value.max()) + 1, lm.CLASSES)) * (np.bincount(m.cls, minlength=lm.CLASSES) > 0))
    m.wc, m.wo = (rng.standard_normal(x.shape).astype(np.float32) for x in (m.wc, m.wo))
    return m, texts


def same(x, n):
    return np.full(n, x, np.int64)


def test_attention_decides_between_ids_of_a_class():
    m, _ = trained_output()
    ids = np.arange(300)
    one, two = same(m.row[4], 300), same(m.row[9], 300)
    lp = [m.log_probs(np.tile(h, (300, 1)).astype(np.float32), one, two, ids) for h in np.random.default_rng(6).standard_normal((2, lm.D))]
    assert all(abs(np.exp(x).sum() - 1) < 1e-4 for x in lp)
    both = [i for i in ids if (m.cls == m.cls[i]).sum() > 1 and m.row[i] < lm.INPUTS - 2]
    assert len(both) > 20
    odds = [x[i] - x[j] for x in lp for i, j in zip(both, both[1:]) if m.cls[i] == m.cls[j]]
    odds = np.array(odds).reshape(2, -1)
    assert odds.shape[1] > 3 and (np.abs(odds[0] - odds[1]) > 1e-2).all()


def test_output_by_hand():
    m, texts = trained_output()
    rng = np.random.default_rng(7)
    counts = dict(zip(m.pairs.tolist(), m.pair_counts.tolist()))
    members = {c: np.flatnonzero((m.cls == c) & (m.row[:-1] < lm.INPUTS - 2)) for c in range(lm.CLASSES)}
    ids = np.concatenate(texts[:4])
    h, one = rng.standard_normal((len(ids), lm.D)).astype(np.float32), rng.choice(m.row[np.unique(ids)], len(ids)).astype(np.int64)
    got = m.in_class(h, one, ids)
    for k, i in enumerate(ids):
        def weight(j):
            n = counts.get(int(one[k]) * lm.INPUTS + int(m.row[j]), 0)
            return (n + lm.BACK_ID * m.share[j]) * np.exp(float(h[k].astype(float) @ m.wo[m.place[m.row[j]]].astype(float)))

        want = weight(i) / sum(weight(j) for j in members[m.cls[i]])
        assert abs(got[k] - want) < 1e-4


def test_every_place_teaches_every_parameter():
    m, texts = trained_output()
    seqs = [np.r_[t[:-1][: k % 7 * 9], 299] for k, t in enumerate(texts)] + [np.array([299]), np.arange(2, 60)]
    win, y, _ = lm.windows(m, seqs)
    assert sorted(y[y >= 0]) == sorted(np.concatenate(seqs))  # each once
    _, grads, n = m.gradients(win, y)
    assert n == sum(map(len, seqs)) and set(grads) == set(lm._PARAMS)
    loss = lambda: float(m.gradients(win, y)[0]) * n
    r = int(m.row[4])
    for name, at in (("wo", (int(m.place[r]), 1)), ("wo", (int(m.place[m.row[9]]), 6)), ("wc", (3, 1)), ("far", (18,)), ("far", (3,)), ("eq", (r, 2)), ("ekv", (r, 5)), ("ekv", (r, lm.D + 3)), ("ekv", (int(m.end_row), lm.D))):
        x, g = getattr(m, name), grads[name]
        want = g[at] if not isinstance(g, tuple) else g[1][g[0] == at[0], at[1]].sum()
        old = x[at]
        x[at] = old + 0.02
        up = loss()
        x[at] = old - 0.02
        down = loss()
        x[at] = old
        assert abs((up - down) / 0.04 - want) < 0.05 * max(1, abs(want)), name
    before = m.wo.copy()
    m.step(win, y, {}, 0.1)
    lone = np.bincount(m.class_of_row[m.row[np.unique(y[y >= 0])]], minlength=lm.CLASSES) < 2
    taught = [m.place[r] for r in m.row[np.unique(y[y >= 0])] if not lone[m.class_of_row[r]]]
    assert len(taught) > 20 and (m.wo != before)[taught].any(1).all()


def test_much_used_ids_are_in_small_classes():
    """A softmax in a class costs the class's size at each use; all in classes of equal size would cost 64."""
    rng = np.random.default_rng(8)
    use = (1e8 / np.arange(1, 1985) ** 1.4).astype(int)
    topic = rng.integers(0, 12, len(use))
    after = rng.poisson(use[:, None] / 400 * (rng.random((12, 300)) ** 4)[topic])
    cls = lm.word_classes(after.astype(np.float32), use.astype(float), lm.CLASSES - 1)
    sizes = np.bincount(cls, minlength=lm.CLASSES - 1)
    assert sizes.sum() == len(use) and (sizes[cls] * use).sum() / use.sum() < 32
