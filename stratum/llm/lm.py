r"""LM scoring with a causal self-attention model over subword ids, trained in numpy.

Words are lower-cased (A-Z), and each, with a space before it, is cut into the ids of a public byte-level
vocabulary; one end id closes a text. A text's probability is that of its ids. One head of causal attention, with a
learned bias for distance, reads a window of ``2 * BLOCK`` ids, and its output gives a logit to every id: the softmax
over ids is in two factors, an id's class among the ``CLASSES`` classes and the id in its class, each with trained
output weights, each normalised. Both start from counts, the direct path: classes from those after the last two ids,
backed off to the last one; an id in its class from those after the last id, backed off to its own. Classes are
k-means groups of the ids by what they follow, in bands of use. Windows overlap by half: each holds ``BLOCK`` ids of context and
scores the following ``BLOCK`` once each, in batched, masked attention.

Gathered from the whole corpus, without cap: counts of all words, all ids and all pairs of neighbouring ids of all
training texts. Words are told by 64-bit hashes of their ids. Every training text is cut into windows, each partition
trains on every place of every window from the same start, and the parameters are averaged by the windows they rest
on; the partial sums are added up in Spark, so the driver receives one model.

Bounds on the model, not on the data: the ``INPUTS`` - 2 most used ids have rows, pairs, output weights and a class of
their own among the first; other ids share a row and the last class, where they go by their own counts. The ``CONTEXTS`` most
used pairs have class counts of their own; after other pairs the last id decides alone. Every place is counted,
taught and scored whatever its row.

Words with a count of ``hot`` or more, a threshold that leaves at most ``HOT_WORDS`` of them, are broadcast;
each occurrence of another word is looked up by a shuffle join. That holds at every size, and frequent words,
which would make hot keys, never reach the join.

Defined results: a null text is empty: one token, the end. Words longer than ``_PIECE`` code points are cut there
before the vocabulary cuts them. Repeated rows are scored alike, and count as often as they are there. A null id is
held in. With no training text N is 0, nothing is known, and the base score is minus infinity's stand-in:
log10(1/1) per token, as (0+1)/(0+1*(0+1)). An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shipped, materialize, table
from .quality import held_out

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK, D = 16, 8
#: Rows of the input tables (the last two are of rare ids and of padding), classes, and pairs with counts of their own.
INPUTS, CLASSES, CONTEXTS = 2048, 32, 1 << 16
#: Strength of what counts are backed off to: the class after one id, after two, and the id in its class.
BACK_ONE, BACK_TWO, BACK_ID = 8.0, 8.0, 8.0
HOT_WORDS = 400_000
_PIECE, _CACHE, _CHUNK, _PART, _CELLS, _RUNS = 128, 400_000, 8192, 4096, 1 << 16, 32
#: Rows of BLOCK places in a step, each with all its places, and the rate of learning.
STEP, RATE = 128, 0.1
_PARAMS = ("eq", "ekv", "far", "wc", "wo")
_RARE, _PAD = INPUTS - 2, INPUTS - 1
_SLOTS = 1 << 20
#: Where, in the ids with rows from the most used, a band of classes ends and the next begins.
_BANDS = (1 / 32, 1 / 8, 3 / 8)
_ONES = np.ones((INPUTS, 1), np.float32)
_DIST = BLOCK + np.arange(BLOCK)[:, None] - np.arange(2 * BLOCK)[None, :]
_FAR, _SEEN = np.abs(_DIST), (_DIST >= 0).astype(np.float32)


def ranks(path: str = TOKENIZER) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def word_starts(table: dict[bytes, int]) -> np.ndarray:
    """For each id: it begins a word, as its bytes begin with a space, or it is the end."""
    out = np.zeros(len(table) + 1, bool)
    out[[i for b, i in table.items() if b[:1] == b" "]] = True
    out[-1] = True
    return out


class Subwords:
    """Ids of words."""

    def __init__(self, table: dict[bytes, int]):
        self._enc = tiktoken.Encoding("own", pat_str=_SPLIT, mergeable_ranks=table, special_tokens={})
        self.end = len(table)
        self.size = len(table) + 1
        self.starts = word_starts(table)

    def ids(self, w: bytes) -> list[int]:
        s = " " + w.decode("utf-8", "replace")
        out: list[int] = []
        for a in range(0, len(s), _PIECE):  # a bound on the work for texts without white space
            out += self._enc.encode_ordinary(s[a : a + _PIECE])
        return out

    def all_ids(self, words: list[bytes]):
        """(ids of all the words, where each word's begin, how many it has); the words in any order.

        Words without white space of any script are cut in one call, as no piece of the pattern goes across a space there.
        """
        texts = [w.decode("utf-8", "replace") for w in words]
        easy = np.array([len(t) < _PIECE and t.split() == [t] for t in texts], bool)
        flat = self._enc.encode_ordinary("".join([" " + t for t, e in zip(texts, easy.tolist()) if e]))
        rest = [self.ids(words[i]) for i in np.flatnonzero(~easy)]
        size = np.empty(len(words), np.int64)
        at = np.flatnonzero(self.starts[flat])
        size[easy], size[~easy] = np.diff(at, append=len(flat)), [len(x) for x in rest]
        order = np.r_[np.flatnonzero(easy), np.flatnonzero(~easy)]
        first = np.empty(len(words), np.int64)
        first[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate([np.array(flat, np.uint16), *(np.array(x, np.uint16) for x in rest)]), first, size


class Lexicon(dict):
    """Numbers of words in order of first use, their ids, and how often they were counted. Number 0, no word, is the end."""

    def __init__(self, sub: Subwords):
        self.sub, self.fresh = sub, []
        self[b""] = 0
        self.flat, self.first, self.size = np.array([sub.end], np.uint16), np.zeros(1, np.int64), np.ones(1, np.int64)
        self.counts = np.zeros(1, np.int64)

    def __missing__(self, w: bytes) -> int:
        n = self[w] = len(self)
        self.fresh.append(w)
        return n

    def _numbers(self, texts: pa.Array):
        """(numbers of all words, the end behind each text's; words of each text, the end with them)"""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        words, bounds = lists.flatten(), lists.offsets.to_numpy()
        real = pc.greater(pc.binary_length(words), 0)  # white space at either end of a text leaves an empty one
        upto = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))]
        n = np.diff(upto.take(bounds - bounds[0]))
        coded = words.filter(real).dictionary_encode()  # so that each word of these texts is looked up once
        once = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        once = pc.binary_join(once, " ")[0].as_py().encode().split()
        number = np.fromiter(map(self.__getitem__, once), np.int64, len(once))
        out = np.zeros(len(coded) + len(n), np.int64)
        out[np.arange(len(coded)) + np.repeat(np.arange(len(n)), n)] = number.take(coded.indices.to_numpy())
        return out, n + 1

    def cut(self, texts):
        """(numbers of all words, the end behind each text's; words of each text, the end with them; ids; ids of each text)."""
        numbers, n = self._numbers(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        if self.fresh:
            flat, first, size = self.sub.all_ids(self.fresh)
            self.first, self.size = np.r_[self.first, len(self.flat) + first], np.r_[self.size, size]
            self.flat, self.counts = np.r_[self.flat, flat], np.r_[self.counts, np.zeros(len(size), np.int64)]
            self.fresh = []
        size = self.size.take(numbers)
        upto = np.cumsum(size)
        at = np.repeat(self.first.take(numbers) - upto + size, size)
        at += np.arange(len(at))
        return numbers, n, self.flat.take(at), np.diff(upto.take(np.cumsum(n) - 1), prepend=0)

    def count(self, numbers: np.ndarray) -> None:
        self.counts += np.bincount(numbers, minlength=len(self))

    def full(self) -> bool:
        return len(self) > _CACHE or len(self.flat) > 16 * _CACHE

    def counted(self):
        """(hashes of the words that were counted, how often; how often each id was)"""
        order = np.argsort(self.first)  # as their ids lie
        c = self.counts[order]
        ids = np.bincount(self.flat, np.repeat(c, self.size[order]), self.sub.size).astype(np.int64)  # whole below 2 ** 53
        return word_hashes(self.flat, self.sub.starts)[c > 0], c[c > 0], ids


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def input_rows(counts: np.ndarray) -> np.ndarray:
    """The input row of each id, and of padding: the most used have their own."""
    top = np.argsort(-counts, kind="stable")[:_RARE]
    top = top[counts[top] > 0]
    row = np.full(len(counts) + 1, _RARE, np.int64)
    row[top] = np.arange(len(top))
    row[-1] = _PAD
    return row


def word_classes(after: np.ndarray, weight: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A class for each row of ``after`` (how often it follows each other), most used first, in bands of use.

    A softmax over a class costs its size at each use, so the much used ids are in small classes.
    """
    n = len(after)
    if n <= k:
        return np.arange(n)
    out, first = np.zeros(n, np.int64), 0
    for i, (a, b) in enumerate(zip((0, *_BANDS), (*_BANDS, 1))):
        a, b, last = int(n * a), int(n * b), k * (i + 1) // (len(_BANDS) + 1)
        out[a:b] = first + _means(after[a:b], weight[a:b], last - first, seed)
        first = last
    return out


def _means(after: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Weighted k-means in a space of few dimensions."""
    n = len(after)
    if n <= k:
        return np.arange(n)
    rng, w = np.random.default_rng(seed), np.sqrt(weight).astype(np.float32)
    x = np.sqrt(after / np.maximum(after.sum(1, keepdims=True), 1)).astype(np.float32) * w[:, None]
    q = rng.standard_normal((after.shape[1], 24)).astype(np.float32)
    for _ in range(4):  # the leading directions
        q = np.linalg.qr(x.T @ (x @ q))[0]
    f, p = x @ q / w[:, None], weight / weight.sum()
    mid = f[rng.choice(n, k, replace=False, p=p)]
    for _ in range(12):
        near = ((mid * mid).sum(1)[None] - 2 * f @ mid.T).argmin(1)
        size = np.bincount(near, weight, k)
        mid = np.stack([np.bincount(near, weight * f[:, j], k) for j in range(f.shape[1])], 1) / np.maximum(size, 1e-9)[:, None]
        lone = np.flatnonzero(size == 0)
        mid[lone] = f[rng.choice(n, len(lone), p=p)]
    return ((mid * mid).sum(1)[None] - 2 * f @ mid.T).argmin(1)


class Keys:
    """Whole numbers with a value each, found by their hash; of keys that meet in a slot the last is there."""

    def __init__(self, keys: np.ndarray, slots: int = _SLOTS):
        self.bits = np.uint64(64 - (slots.bit_length() - 1))
        self.key, self.value = np.full(slots, -1, np.int64), np.zeros(slots, np.int32)
        at = self._slot(keys)
        self.key[at], self.value[at] = keys, np.arange(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def find(self, keys: np.ndarray):
        """(is it there, its number)"""
        at = self._slot(keys)
        return self.key[at] == keys, self.value[at]


def contexts(pairs: np.ndarray, pair_counts: np.ndarray) -> Keys:
    """The most used pairs, in a table. ``pairs``: row of the first times INPUTS, plus row of the second."""
    top = np.argsort(-pair_counts, kind="stable")[:CONTEXTS]
    return Keys(pairs[top[::-1]])  # so that the more used one stays


def neighbours(win: np.ndarray, use: np.ndarray, end_row: int):
    """(inputs, the inputs before them) at the places ``use`` of rows of BLOCK with the row before: what is no input counts as an end."""
    at, flat = use + use // BLOCK * BLOCK + BLOCK, win.ravel()
    two = flat.take(at - 1)
    two[two == _PAD] = end_row
    return flat.take(at), two


class Model:
    """Parameters of the attention and of its output, and the counts that classes and the ids in them start from.

    ``wo`` has a row for each id with an input row, at its ``place``: the ids of a class lie side by side.

    ``pairs`` and ``pair_counts`` are of input rows, of all training texts; ``triples`` are the counts of each class
    after each context.
    """

    def __init__(self, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, seed: int = 1):
        self.row, self.pad = input_rows(counts), len(counts)
        self.end_row = self.row[self.pad - 1]
        first, second = pairs // INPUTS, pairs % INPUTS
        after = np.zeros((INPUTS, INPUTS), np.float32)
        after[second, first] = pair_counts
        own = np.flatnonzero(self.row[:-1] < _RARE)
        own = own[np.argsort(self.row[own])]
        self.class_of_row = np.full(INPUTS, CLASSES - 1, np.int64)
        if len(own):
            self.class_of_row[: len(own)] = word_classes(after[: len(own)], counts[own].astype(float), CLASSES - 1)
        self.cls = self.class_of_row[self.row[:-1]]
        self.cls8 = self.cls.astype(np.uint8)
        plus = counts + 1.0
        total = np.bincount(self.cls, plus, CLASSES)
        self.share = plus / total[self.cls]
        self.by_class = np.zeros((INPUTS, CLASSES))
        np.add.at(self.by_class, (first, self.class_of_row[second]), pair_counts)
        self.one = (self.by_class + BACK_ONE * total / total.sum()) / (self.by_class.sum(1, keepdims=True) + BACK_ONE)
        self.contexts = contexts(pairs, pair_counts)
        self.start = np.log(np.maximum(self.one, 1e-30)).astype(np.float32)
        ordered = np.argsort(pairs)
        self.pairs, self.pair_counts = pairs[ordered], pair_counts[ordered]
        rng = np.random.default_rng(seed)
        f = lambda *n: (rng.standard_normal(n) * 0.3).astype(np.float32)
        self.eq, self.ekv = f(INPUTS, D), f(INPUTS, 2 * D)
        self.far = -0.05 * np.arange(2 * BLOCK, dtype=np.float32)
        self.wc, self.wo = np.zeros((D, CLASSES), np.float32), np.zeros((INPUTS, D), np.float32)
        by_place = np.argsort(self.class_of_row[: len(own)], kind="stable")
        self.place = np.zeros(INPUTS, np.int64)
        self.place[by_place] = np.arange(len(own))
        self.bounds = np.searchsorted(self.class_of_row[by_place], np.arange(CLASSES + 1))
        self.sizes = np.diff(self.bounds)
        self.member_share = self.share[own[by_place]]
        self.inside = self.at = None

    def starts_inside(self) -> list[np.ndarray]:
        """For each class, its ids' probabilities in it after each input, from counts: (INPUTS, ids of the class)."""
        if self.inside is None:
            n = np.zeros((INPUTS, self.bounds[-1]), np.float32)
            own = self.class_of_row[self.pairs % INPUTS] < CLASSES - 1
            n[self.pairs[own] // INPUTS, self.place[self.pairs[own] % INPUTS]] = self.pair_counts[own]
            self.inside = []
            for c, (a, b) in enumerate(zip(self.bounds[:-1], self.bounds[1:])):
                x = n[:, a:b] + np.float32(BACK_ID) * self.member_share[a:b].astype(np.float32)
                self.inside.append(x / (self.by_class[:, c, None] + BACK_ID).astype(np.float32))
        return self.inside

    def starts_at(self) -> np.ndarray:
        """For each pair of inputs, the row of ``start`` that their classes start from: their own, or the last input's."""
        if self.at is None:
            self.at = np.tile(np.arange(INPUTS, dtype=np.int32), INPUTS)
            if len(self.start) > INPUTS:
                there = self.contexts.key >= 0
                self.at[self.contexts.key[there]] = INPUTS + self.contexts.value[there]
        return self.at

    def __getstate__(self):
        return self.__dict__ | {"inside": None, "at": None}  # made again where they are used

    def with_triples(self, triples: np.ndarray) -> "Model":
        """``triples``: (contexts, CLASSES), in the contexts' own numbering."""
        keys = np.zeros(len(triples), np.int64)
        there = self.contexts.key >= 0
        keys[self.contexts.value[there]] = self.contexts.key[there]
        two = (triples + BACK_TWO * self.one[keys % INPUTS]) / (triples.sum(1, keepdims=True) + BACK_TWO)
        self.start = np.log(np.maximum(np.concatenate([self.one, two]), 1e-30)).astype(np.float32)
        self.at = None
        return self

    def vector(self) -> np.ndarray:
        return np.concatenate([getattr(self, p).ravel() for p in _PARAMS])

    def load(self, v: np.ndarray) -> "Model":
        at = 0
        for p in _PARAMS:
            x = getattr(self, p)
            setattr(self, p, v[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return self

    def attention(self, win: np.ndarray):
        """(n, BLOCK, D) outputs for rows of BLOCK inputs behind the BLOCK inputs before them, and what led to them.

        These are the weights before they are divided by their sums, queries, keys and values, and the sums. The row before
        is all padding or none, and behind a text's last place nothing is read, so a mask by rows is enough. What is masked
        weighs exactly 0: products with the least numbers, as of a very small weight, take a hundred times as long.
        """
        kv, q = self.ekv.take(win, 0), self.eq.take(win[:, BLOCK:], 0)
        a = np.matmul(q, np.ascontiguousarray(kv[:, :, :D].transpose(0, 2, 1)))
        a += self.far.take(_FAR)
        _within(a, -80, 40)
        np.exp(a, out=a)
        a *= _SEEN
        a[win[:, 0] == _PAD, :, :BLOCK] = 0
        total = (a.reshape(-1, 2 * BLOCK) @ _ONES[: 2 * BLOCK]).reshape(-1, BLOCK, 1)
        return np.matmul(a, kv)[:, :, D:] / total, a, q, kv, total  # both halves at once are the faster product

    def class_weights(self, h: np.ndarray, at: np.ndarray):
        """(weights of all classes with the attention's outputs, from the rows ``at`` of ``start``; their sums)."""
        z = self.start.take(at, 0)
        z += h @ self.wc
        _within(z, -80, 80)
        np.exp(z, out=z)
        return z, (z @ _ONES[:CLASSES]).ravel()

    def in_class(self, h: np.ndarray, one: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Probability of each id in its class with the attention's outputs, after the inputs ``one``."""
        p, inside, wt = self.share.take(ids), self.starts_inside(), np.ascontiguousarray(self.wo.T)
        cls = self.cls8.take(ids)
        order, ends = np.argsort(cls, kind="stable"), np.cumsum(np.bincount(cls, minlength=CLASSES)).tolist()
        place = self.place.take(self.row.take(ids))
        for c, (lo, hi) in enumerate(zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist())):
            if hi == lo:  # the class of ids without rows
                continue
            part = max(1, _CELLS // (hi - lo))
            for a in range(ends[c - 1] if c else 0, ends[c], part):
                use = order[a : min(a + part, ends[c])]
                z = h.take(use, 0) @ wt[:, lo:hi]
                _within(z, -40, 40)
                np.exp(z, out=z)
                z *= inside[c].take(one.take(use), 0)
                p[use] = z.ravel().take(np.arange(len(use)) * (hi - lo) + place.take(use) - lo) / (z @ _ONES[: hi - lo]).ravel()
        return p

    def places(self, win: np.ndarray, y: np.ndarray, step: int):
        """For each run of ``step`` windows what no parameter decides, made for all at once.

        The places with a target, by class; their ids, classes and inputs, and the rows of ``start``; of their ids' classes,
        the sizes, where in the tables of ``in_class_gradients`` theirs begin, and the id in them; by class, the places, where
        they end and where their tables end; which windows are behind the one before them.
        """
        flat, runs = y.ravel(), -(-len(win) // step)
        use = np.flatnonzero(flat >= 0)
        key = use // (step * BLOCK) * CLASSES + self.cls.take(flat.take(use))
        n = np.bincount(key, minlength=runs * CLASSES).reshape(runs, CLASSES)
        use = use.take(np.argsort(key.astype(np.uint16) if runs * CLASSES <= 1 << 16 else key, kind="stable"))
        ids = flat.take(use)
        cls, (one, two) = self.cls.take(ids), neighbours(win, use, self.end_row)
        start, each = self.starts_at().take(two * INPUTS + one), self.sizes.take(cls)
        first, inside = np.cumsum(each) - each, self.place.take(self.row.take(ids)) - self.bounds.take(cls)
        few = win.astype(np.uint16).view(np.uint64)  # compared four at a time
        behind = np.zeros(len(win), bool)
        (few[1:, : BLOCK // 4] == few[:-1, BLOCK // 4 :]).all(1, out=behind[1:])
        behind[::step] = False
        upto = np.cumsum(n.sum(1)).tolist()
        by_class = zip(n.tolist(), np.cumsum(n, 1).tolist(), np.cumsum(n * self.sizes, 1).tolist())
        for i, (a, b, c) in enumerate(zip([0, *upto], upto, by_class)):
            yield use[a:b] - i * step * BLOCK, ids[a:b], cls[a:b], one[a:b], start[a:b], each[a:b], first[a:b] - (first[a] if a < b else 0), inside[a:b], c, behind[i * step : (i + 1) * step]

    def in_class_gradients(self, h: np.ndarray, at):
        """(probability of each id in its class, gradients of the summed negative logs of ``h`` and of ``wo``) at ``places``."""
        _, ids, _, one, _, each, first, inside, (n, ends, cells), _ = at
        starts, p = self.starts_inside(), self.share.take(ids)
        z, start = np.empty(cells[-1], np.float32), np.empty(cells[-1], np.float32)  # all classes' tables (places, ids of the class)
        some, wt = [], np.ascontiguousarray(self.wo.T)
        for c, (k, b, d, lo, e) in enumerate(zip(n, ends, self.sizes.tolist(), self.bounds.tolist(), cells)):
            if k and d:  # not the class of ids without rows
                zc, to, rows = z[e - k * d : e].reshape(k, d), slice(b - k, b), slice(lo, lo + d)
                np.matmul(h[to], wt[:, rows], out=zc)
                starts[c].take(one[to], 0, out=start[e - k * d : e].reshape(k, d), mode="clip")
                some.append((zc, to, rows))
        own = len(ids) - n[-1]  # the class of ids without rows is the last
        dh, dw = np.zeros_like(h), np.zeros_like(wt)
        if not own:
            return p, dh, np.ascontiguousarray(dw.T)
        _within(z, -40, 40)
        np.exp(z, out=z)
        z *= start
        total = np.ones((len(ids), 1), np.float32)
        total[:own, 0] = np.add.reduceat(z, first[:own])
        own_at = first[:own] + inside[:own]
        p[:own] = z.take(own_at) / total[:own, 0]
        z[own_at] -= total[:own, 0]
        part = (h / total).T  # divided here: fewer than the weights
        for zc, to, rows in some:
            np.dot(zc, self.wo[rows], out=dh[to])
            np.matmul(part[:, to], zc, out=dw[:, rows])
        dh /= total
        return p, dh, np.ascontiguousarray(dw.T)

    def log_probs(self, h: np.ndarray, one: np.ndarray, two: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural log of the probabilities of the ids."""
        p = self.in_class(h, one, ids)
        cls = self.cls.take(ids)
        for a in range(0, len(ids), _PART):
            to = slice(a, a + _PART)
            z, total = self.class_weights(h[to], self.starts_at().take(two[to] * INPUTS + one[to]))
            p[to] *= z.ravel().take(np.arange(len(z)) * CLASSES + cls[to]) / total
        return np.log(p)

    def gradients(self, win: np.ndarray, y: np.ndarray, places=None, with_loss: bool = True):
        """(mean loss or none, gradients of the summed loss by parameter, targets). Those of tables: (rows, gradient of each)."""
        places = places or next(self.places(win, y, len(win)))
        use, _, cls, _, start, _, _, _, _, behind = places
        h, a, q, kv, total = self.attention(win)
        hu, m = h.reshape(-1, D).take(use, 0), len(use)
        z, sums = self.class_weights(hu, start)
        inside, back, wo = self.in_class_gradients(hu, places)
        at = np.arange(m) * CLASSES + cls
        loss = float(-np.log(z.ravel().take(at) / sums * inside + 1e-30).sum() / m) if with_loss else None
        z.ravel()[at] -= sums
        back += (z @ np.ascontiguousarray(self.wc.T)) / sums[:, None]
        wc = (hu / sums[:, None]).T @ z
        # of the outputs, divided so that the weights need not be; 0 where there is no target
        back /= total.reshape(-1, 1).take(use, 0)
        at = np.full(y.size, m)
        at[use] = np.arange(m)
        dh = np.concatenate([back, np.zeros((1, D), np.float32)]).take(at, 0)
        off = (dh * h.reshape(-1, D)) @ _ONES[:D]  # what the softmax takes off
        dh = dh.reshape(-1, BLOCK, D)
        da = np.matmul(dh, np.ascontiguousarray(kv[:, :, D:].transpose(0, 2, 1)))
        da -= off.reshape(-1, BLOCK, 1)
        da *= a
        far = np.bincount(_FAR.ravel(), np.ones(len(da), np.float32) @ da.reshape(len(da), -1), 2 * BLOCK).astype(np.float32)
        alone = np.flatnonzero(~behind & (win[:, 0] != _PAD))
        # of each place: its query, key and value, the latter two with what the next window adds
        n, dkv = len(win), np.empty((len(win), 2 * BLOCK, 2 * D), np.float32)
        g = np.empty((n + len(alone), BLOCK, 3 * D), np.float32)
        np.matmul(da, kv[:, :, :D], out=g[:n, :, :D])
        np.matmul(da.transpose(0, 2, 1), q, out=dkv[:, :, :D])
        np.matmul(a.transpose(0, 2, 1), dh, out=dkv[:, :, D:])
        g[n:, :, :D], g[n:, :, D:] = 0, dkv[alone, :BLOCK]
        dkv[~behind, :BLOCK] = 0
        dkv[:-1, BLOCK:] += dkv[1:, :BLOCK]
        g[:n, :, D:] = dkv[:, BLOCK:]
        rows, g = _row_sums(np.concatenate([win[:, BLOCK:], win[alone, :BLOCK]]).ravel(), g.reshape(-1, 3 * D))
        return loss, {"wc": wc, "wo": wo, "far": far, "eq": (rows, g[:, :D]), "ekv": (rows, g[:, D:])}, m

    def step(self, win: np.ndarray, y: np.ndarray, acc: dict, rate: float, places=None) -> None:
        """One Adagrad step on every place of the windows."""
        _, grads, m = self.gradients(win, y, places, False)
        for name, g in grads.items():
            x = getattr(self, name)
            if name not in acc:
                acc[name] = np.full(x.shape, 1e-2, np.float32)
            c = acc[name]
            rows = slice(None)
            if isinstance(g, tuple):
                rows, g = g
            g = g * np.float32(64 / m)
            to = c[rows] + g * g
            c[rows] = to
            x[rows] -= rate * g / np.sqrt(to)


    def steps(self, win: np.ndarray, y: np.ndarray, acc: dict) -> None:
        """Steps on STEP windows each, in turn."""
        for a in range(0, len(win), _RUNS * STEP):
            w, t = win[a : a + _RUNS * STEP], y[a : a + _RUNS * STEP]
            for i, places in enumerate(self.places(w, t, STEP)):
                self.step(w[i * STEP : (i + 1) * STEP], t[i * STEP : (i + 1) * STEP], acc, RATE, places)


def _within(x: np.ndarray, low: float, high: float) -> None:
    """Clips, if there is anything to clip: looking is several times faster."""
    if x.size and (x.min() < low or x.max() > high):
        np.clip(x, low, high, out=x)


def _row_sums(rows: np.ndarray, g: np.ndarray):
    """(rows, sum of ``g`` over the places of each)."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    ids = rows.take(order)
    cut = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    pairs = g.take(order, 0).view(np.complex64)  # two columns at once
    return ids[cut], np.add.reduceat(pairs, cut, 0).view(np.float32)


def layout(seqs: list[np.ndarray], pad: int, end: int):
    """(inputs, targets, sequence number) in rows of BLOCK; a row of padding before each sequence."""
    sizes = np.array([len(s) for s in seqs])
    rows = -(-sizes // BLOCK) + 1
    first = (np.cumsum(rows) - rows + 1) * BLOCK
    total = int(rows.sum()) * BLOCK
    x, y = np.full(total, pad, np.int64), np.full(total, -1, np.int64)
    flat = np.concatenate(seqs)
    at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))
    y[at] = flat
    x[at[flat != end] + 1] = flat[flat != end]  # the next place is of the same sequence: only its last is the end
    x[first] = end
    return x.reshape(-1, BLOCK), y.reshape(-1, BLOCK), np.repeat(np.arange(len(seqs)), rows)


def windows(m: Model, seqs: list[np.ndarray]):
    """(windows, targets, sequence number): every id of the sequences is a target once, behind BLOCK to 2 * BLOCK - 1 places."""
    x, y, of = layout(seqs, m.pad, m.pad - 1)
    x = m.row[x]
    at = np.flatnonzero((y >= 0).any(1))
    return np.concatenate([x[at - 1], x[at]], 1), y[at], of[at]


def score_sequences(m: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each sequence of ids, closed by the end."""
    win, y, of = windows(m, seqs)
    out = np.zeros(len(seqs))
    for a in range(0, len(win), _CHUNK):
        w, t = win[a : a + _CHUNK], y[a : a + _CHUNK]
        use = np.flatnonzero(t.ravel() >= 0)
        h = np.concatenate([m.attention(w[b : b + STEP])[0] for b in range(0, len(w), STEP)]).reshape(-1, D)
        one, two = neighbours(w, use, m.end_row)
        lp = m.log_probs(h.take(use, 0), one, two, t.ravel().take(use))
        out += np.bincount(np.repeat(of[a : a + _CHUNK], BLOCK).take(use), lp, len(seqs))
    return out


def _summed(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[cut], np.add.reduceat(c, cut)


def word_hashes(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of an id stream. ``starts[id]``: a word, or the end, begins there."""
    at = np.flatnonzero(starts[flat])
    place = np.arange(len(flat)) - np.repeat(at, np.diff(np.r_[at, len(flat)]))
    x = flat.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(20)) + np.uint64(1)
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.add.reduceat(x ^ (x >> np.uint64(31)), at).view(np.int64)


class Hashes:
    """Well mixed hashes with a value each, found by their first bits and the few that share them."""

    def __init__(self, h: np.ndarray, value: np.ndarray, bits: int = 20):
        h = h.view(np.uint64)
        order = np.argsort(h)
        self.h, self.value, self.shift = np.r_[h[order], np.uint64(0)], np.r_[value[order], 0.0], np.uint64(64 - bits)
        self.begin = np.searchsorted(self.h[:-1] >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, h: np.ndarray):
        """(is it there, its value)"""
        h = h.view(np.uint64)
        slot = (h >> self.shift).view(np.int64)
        at, end = self.begin.take(slot), self.begin.take(slot + 1)
        there = (self.h.take(at) == h) & (at < end)
        left = np.flatnonzero(~there & (at + 1 < end))
        while len(left):
            at[left] += 1
            hit = self.h.take(at[left]) == h[left]
            there[left[hit]] = True
            left = left[~hit & (at[left] + 1 < end[left])]
        return there, self.value.take(at)


def _tokenized(rows: DataFrame, table_, kind: str) -> DataFrame:
    """Rows of four sorts: documents with their ids (2), and this task's counts of words (0), ids (1) and pairs of ids (3)."""
    names = ["sort", "rid", "doc_id", "held_out", "n_tokens", "ids", "h", "c"]

    def counted(sort, h, c, ids_type):
        n = len(h)
        none = lambda t: pa.nulls(n, t)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, sort, np.int32)), none(pa.int64()), none(ids_type), none(pa.bool_()), none(pa.int64()), none(pa.binary()), pa.array(h, pa.int64()), pa.array(c, pa.int64())], names)

    def run(batches):
        from pyspark import TaskContext

        sub = Subwords(table_.value)
        known, ids, rid, id_type = Lexicon(sub), np.zeros(sub.size, np.int64), TaskContext.get().partitionId() << 33, None
        fresh, pairs = [], (np.empty(0, np.int64), np.empty(0, np.int64))

        def summed():
            got, c = np.unique(np.concatenate(fresh), return_counts=True)
            got = got.astype(np.int64)
            return _summed([pairs[0], got >> 16 << 20 | got & 0xFFFF], [pairs[1], c])

        for b in batches:
            out = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            id_type = b.column(0).type
            for a in range(0, b.num_rows, 1024):
                numbers, n_tokens, flat, lens = known.cut(b.column(1).slice(a, 1024))
                k = len(lens)
                learn = ~out[a : a + k]
                if learn.any():
                    known.count(numbers[np.repeat(learn, n_tokens)])
                    kept = flat[np.repeat(learn, lens)].astype(np.uint32)
                    # a text begins behind an end, and each is closed by one
                    fresh.append(np.r_[np.uint32(sub.end), kept[:-1]] << np.uint32(16) | kept)
                    if sum(map(len, fresh)) > 2_000_000:
                        pairs, fresh = summed(), []
                bounds = np.r_[0, 2 * np.cumsum(lens)].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, 2, np.int32)), pa.array(np.arange(rid, rid + k)), b.column(0).slice(a, k), b.column(2).slice(a, k), pa.array(n_tokens, pa.int64()), pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(bounds), pa.py_buffer(flat)]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names
                )
                rid += k
                if known.full():
                    h, c, more = known.counted()
                    ids += more
                    known = Lexicon(sub)
                    yield counted(0, h, c, id_type)
        h, c, more = known.counted()
        ids += more
        if len(h):
            yield counted(0, h, c, id_type)
        at = np.flatnonzero(ids)
        if len(at):
            yield counted(1, at, ids[at], id_type)
        if fresh:
            pairs = summed()
        if len(pairs[0]):
            yield counted(3, *pairs, id_type)

    return rows.mapInArrow(run, f"sort int, rid long, doc_id {kind}, held_out boolean, n_tokens long, ids binary, h long, c long")


def _pairs(cut: DataFrame, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of the first times INPUTS plus row of the second, count) of all pairs; at most INPUTS squared come to the driver."""
    spark = cut.sparkSession
    rows = spark.createDataFrame([(int(i), int(row[i])) for i in np.flatnonzero(row[:-1] < _RARE)], "id long, row long")
    p = cut.filter("sort = 3").groupBy("h").agg(F.sum("c").alias("c")).select(F.shiftright("h", 20).alias("a"), F.col("h").bitwiseAND((1 << 20) - 1).alias("b"), "c")
    for x in ("a", "b"):
        p = p.join(F.broadcast(rows.select(F.col("id").alias(x), F.col("row").alias(f"r{x}"))), x, "left")  # INPUTS rows at most
    key = F.coalesce("ra", F.lit(_RARE)) * INPUTS + F.coalesce("rb", F.lit(_RARE))
    got = p.groupBy(key.alias("k")).agg(F.sum("c").alias("c")).toArrow()
    order = np.argsort(got.column(0).to_numpy())
    return got.column(0).to_numpy()[order].astype(np.int64), got.column(1).to_numpy()[order].astype(np.int64)


def _sequences(batch, column: int, at: int, n: int) -> list[np.ndarray]:
    return [np.frombuffer(t, np.uint16).astype(np.int64) for t in batch.column(column).slice(at, n).to_pylist()]


def _triples(docs: DataFrame, m: Model) -> np.ndarray:
    """How often each class follows each context, of all training texts: (contexts, CLASSES)."""
    spark = docs.sparkSession
    sent, size = Shipped(spark, (m.contexts, m.row, m.class_of_row, m.end_row)), int(m.contexts.value.max(initial=-1)) + 1

    def run(batches):
        keys, row, cls, end = sent.get()
        total = np.zeros(size * CLASSES, np.int64)
        for b in batches:
            for a in range(0, b.num_rows, 64):
                seqs = _sequences(b, 0, a, 64)
                r = row[np.concatenate(seqs)]
                one, two = np.r_[end, r[:-1]], np.r_[end, end, r[:-2]][: len(r)]
                first = np.cumsum([0, *map(len, seqs[:-1])])
                two[first] = end
                there, at = keys.find(two.astype(np.int64) * INPUTS + one)
                np.add.at(total, at[there].astype(np.int64) * CLASSES + cls[r[there]], 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["k", "c"])

    got = docs.mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).toArrow()  # CONTEXTS * CLASSES rows at most
    out = np.zeros(size * CLASSES, np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out.reshape(size, CLASSES)


def _train(docs: DataFrame, m: Model) -> Model:
    """The average of the models that the partitions train from one start."""
    spark = docs.sparkSession
    start = Shipped(spark, m)

    def run(batches):
        m, acc, used = start.get(), {}, 0
        win, y = np.zeros((0, 2 * BLOCK), np.int32), np.zeros((0, BLOCK), np.int64)

        def learn(final):
            nonlocal win, y, used
            n = len(win) if final else len(win) - len(win) % STEP
            m.steps(win[:n], y[:n], acc)
            used += n
            win, y = win[n:], y[n:]

        for b in batches:
            for a in range(0, b.num_rows, 64):
                w, t, _ = windows(m, _sequences(b, 0, a, 64))
                win, y = np.concatenate([win, w]), np.concatenate([y, t])
                learn(False)
        learn(True)
        if used:
            v = m.vector() * np.float64(used)
            parts = np.array_split(v, 16)
            for i, p in enumerate(parts):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([used], pa.int64()), pa.array([p], pa.list_(pa.float64()))], ["part", "n", "v"])

    def add(key, frames):
        total, n = None, 0
        for f in frames:
            for v, k in zip(f["v"], f["n"]):
                total = v.copy() if total is None else total + v
                n += int(k)
        import pandas as pd

        yield pd.DataFrame({"part": [key[0]], "n": [n], "v": [total]})

    parts = docs.mapInArrow(run, "part int, n long, v array<double>")
    # partial sums by tens of tasks, then in all
    some = parts.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(64)))

    def first(pdfs):
        keep: dict = {}
        for f in pdfs:
            for p, n, v in zip(f["part"], f["n"], f["v"]):
                have = keep.get(p)
                keep[p] = (n, v.copy()) if have is None else (have[0] + n, have[1] + v)
        import pandas as pd

        if keep:
            yield pd.DataFrame({"part": list(keep), "n": [x[0] for x in keep.values()], "v": [x[1] for x in keep.values()]})

    some = some.repartition(64, "lane", "part").drop("lane").mapInPandas(first, "part int, n long, v array<double>")

    def whole(pdf):
        import pandas as pd

        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "n": [pdf["n"].sum()], "v": [np.sum(np.stack(pdf["v"].to_numpy()), 0)]})

    got = some.groupBy("part").applyInPandas(whole, "part int, n long, v array<double>").orderBy("part").collect()
    if got:
        m.load(np.concatenate([np.array(r["v"]) for r in got]) / got[0]["n"])
    return m


def _hot_words(counts: DataFrame):
    """(threshold, hashes, counts): the most frequent words, at most HOT_WORDS."""
    by = counts.groupBy("c").agg(F.count("*").alias("k"))
    w = Window.partitionBy().orderBy(F.desc("c"))
    # words in 2 ** 16 classes of count at most: those above are frequent
    by = by.groupBy(F.least("c", F.lit(1 << 16)).alias("c")).agg(F.sum("k").alias("k"))
    ok = by.withColumn("upto", F.sum("k").over(w)).filter(F.col("upto") <= HOT_WORDS).agg(F.min("c")).first()[0]
    if ok is None:
        return 1 << 62, np.empty(0, np.int64), np.empty(0, np.int64)
    hot = counts.filter(F.col("c") >= ok).select("h", "c").toArrow()
    h, c = hot.column(0).to_numpy(), hot.column(1).to_numpy()
    return ok, h, c


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and n_subwords of every row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(ranks(tokenizer))
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"), held_out(F.col(id_col), 7, 2).alias("held_out"))
    cut = materialize(_tokenized(rows, sent, kind), "ids")
    texts = cut.filter("sort = 2").select("rid", "doc_id", "held_out", "n_tokens", "ids")
    words = materialize(cut.filter("sort = 0").groupBy("h").agg(F.sum("c").alias("c")), "counts")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ids = np.zeros(len(sent.value) + 1, np.int64)
    for r in cut.filter("sort = 1").groupBy("h").agg(F.sum("c").alias("c")).toLocalIterator():  # the vocabulary at most
        ids[r["h"]] = r["c"]
    learn = texts.filter(~F.col("held_out")).select("ids")
    m = Model(ids, *_pairs(cut, input_rows(ids)))
    model = Shipped(spark, _train(learn, m.with_triples(_triples(learn, m))))
    floor, hot_h, hot_c = _hot_words(words)
    hot = spark.sparkContext.broadcast((hot_h, np.log10(hot_c + 1.0)))
    starts = spark.sparkContext.broadcast(word_starts(sent.value))
    names = ["rid", "doc_id", "held_out", "n_tokens", "hot_known", "hot_log", "score", "n_subwords", "tail"]

    def run(batches):
        m, words, begin = model.get(), Hashes(*hot.value), starts.value
        for b in batches:
            for a in range(0, b.num_rows, 64):
                seqs = _sequences(b, 4, a, 64)
                k, flat, lens = len(seqs), np.concatenate(seqs), np.array([len(x) for x in seqs])
                lp = score_sequences(m, seqs) / np.log(10)
                h = word_hashes(flat, begin)
                of = np.repeat(np.arange(k), lens)[begin[flat]]
                known, logs = words.find(h)
                tail, cut_at = h[~known], np.searchsorted(of[~known], np.arange(k + 1))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, k), b.column(1).slice(a, k), b.column(2).slice(a, k), b.column(3).slice(a, k), pa.array(np.bincount(of[known], minlength=k), pa.int64()), pa.array(np.bincount(of[known], logs[known], k), pa.float64()),
                     pa.array(lp), pa.array(lens, pa.int64()), pa.ListArray.from_arrays(pa.array(cut_at, pa.int32()), pa.array(tail, pa.int64()))], names
                )

    out = f"rid long, doc_id {kind}, held_out boolean, n_tokens long, hot_known long, hot_log double, score double, n_subwords long, tail array<long>"
    done = materialize(texts.mapInArrow(run, out), "scores")
    tail = done.select("rid", F.explode("tail").alias("h")).groupBy("rid", "h").agg(F.count("*").alias("k"))
    tail = tail.join(words.filter(F.col("c") < floor), "h").groupBy("rid").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("more_log"))
    logs = F.col("hot_log") + F.coalesce("more_log", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))
    return done.join(tail, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("hot_known") + F.coalesce("more", F.lit(0).cast("long"))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), logs.alias("base_score"), "score", "n_subwords"
    )


def op2_lm_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


ORACLE = None
