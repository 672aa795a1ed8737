r"""Removal of repeated byte strings: every byte covered by a ``LENGTH``-byte string that starts anywhere else too.

The strings are found by anchors and window hashes, not by a suffix array of the corpus; the README says why.

Every window of LENGTH bytes has an *anchor*, the leftmost of its GRAM-byte strings with the smallest hash,
so equal windows have equal anchors. The windows of a text with one anchor in common are a *run*, described
by the anchor's hash and a hash of all its windows. Four steps, each exact and each smaller:

1. Runs whose anchor hash is nowhere else hold no repeat and go.
2. Runs that agree in both hashes are equal windows throughout; they are settled without looking at windows,
   so a group of copies counts as one run.
3. What is left are the borders of repeats: runs whose anchor is known elsewhere with other surroundings, one
   run for each pair of hashes. They are cut into *parts* of at most STEP windows that lie alike to the anchor;
   the windows of a part share a core of LENGTH - STEP + 1 bytes. A part whose core is nowhere else holds no
   repeat, and parts that agree in core and in all windows are settled.
4. Only the windows of the parts that remain are counted one by one and joined back.

Passages are found alike, with words in the place of bytes and the steps 3 and 4 as one (``shared_words``).

Counts are aggregated before they are shuffled, so a passage in a third of all texts is a few rows for each
task. Texts are told by MD5, windows by 64-bit hashes.

Defined results: a null text is empty. Texts under LENGTH bytes lose nothing. A text that is there twice is a
repeat throughout; so is each of the overlapping windows of a periodic text. Repeated rows give one result
each. Null ids are allowed. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, broadcast_if, discard, materialize, table

LENGTH, GRAM, STEP = 400, 64, 32
#: Words of a passage, and of the strings that are its anchors.
PASSAGE, WORD_GRAM = 51, 8
#: Bytes hashed at a time: long texts are taken in pieces that overlap by a window, short ones side by side.
PIECE = 1 << 17
BROADCAST_ROWS = 500_000
_RNG = np.random.default_rng(11)
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_U = np.uint64


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def hashes(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM, anchors: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """(gram hash at each place, anchor place and window hash of each window) of a piece of bytes, or of word hashes.

    Hashes of 2, 4, ... bytes come from those of half the size, and so do sliding minima.
    """
    one = _TABLE[raw] if raw.dtype == np.uint8 else raw
    h, size, step, spare = one, 1, 0, {}
    while size < gram:
        h = h[:-size] * _ODD[step] + (h[size:] ^ (h[size:] >> _U(31))) * _ODD[step + 1]
        size, step = size * 2, step + 2
        spare[size] = h
    windows = len(raw) - length + 1
    w, at, j = np.zeros(windows, _U), 0, 20
    while at < length:  # gram-sized pieces, then the largest powers of two that fit
        size = min(gram, 1 << ((length - at).bit_length() - 1))
        part = spare[size] if size > 1 else one
        w += (part[at : at + windows] ^ (part[at : at + windows] >> _U(29))) * _ODD[j]
        at, j = at + size, j + 1
    h = _finish(h)
    if not anchors:
        return h, None, _finish(w)
    # the hash's high bits over the place: the smallest is the leftmost of the smallest
    low = (h & ~_U(PIECE * 4 - 1)) | np.arange(len(h), dtype=_U)
    span, width = 1, length - gram + 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: windows], low[width - span : width - span + windows])
    return h, (low[:windows] & _U(PIECE * 4 - 1)).astype(np.int64), _finish(w)


def pieces(texts: list, length: int = LENGTH):
    """(bytes or word hashes, [(text number, offset in the text, offset here, windows)]) side by side, about PIECE each."""
    buf, have, size = [], [], 0
    for i, t in enumerate(texts):
        total = len(t) - length + 1
        for a in range(0, total, PIECE):
            n = min(PIECE, total - a)
            buf.append(t[a : a + n + length - 1])
            have.append((i, a, size, n))
            size += len(buf[-1])
            if size >= PIECE:
                yield _array(buf), have
                buf, have, size = [], [], 0
    if have:
        yield _array(buf), have


def _array(parts: list) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.uint8) if isinstance(parts[0], bytes) else np.concatenate(parts)


def runs(texts: list, length: int = LENGTH, gram: int = GRAM):
    """(text number, first window, windows, anchor hash, hash of all windows) of every run, as arrays."""
    for raw, have in pieces(texts, length):
        h, anchor, w = hashes(raw, length, gram)
        of, first, here, n = (np.array(x) for x in zip(*have))
        idx = np.repeat(here - (np.cumsum(n) - n), n) + np.arange(n.sum())
        part = np.repeat(np.arange(len(n)), n)
        a = anchor[idx]
        cut = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (part[1:] != part[:-1])])
        body = np.add.reduceat(_finish(w[idx] + (a - idx).astype(_U) * _ODD[60]), cut)
        sizes = np.diff(np.r_[cut, len(idx)])
        p = part[cut]
        yield of[p], idx[cut] - here[p] + first[p], sizes, h[a[cut]], _finish(body + sizes.astype(_U))


def _slices(text, starts: list[int], sizes: list[int], length: int, gram: int):
    """(numbers of runs, offset, gram hashes, anchors, window hashes): neighbouring runs of one text together."""
    order = sorted(range(len(starts)), key=lambda i: starts[i])
    i = 0
    while i < len(order):
        a = starts[order[i]]
        j, end = i + 1, a + sizes[order[i]]
        while j < len(order) and starts[order[j]] <= end + length and starts[order[j]] + sizes[order[j]] - a <= PIECE:
            end = max(end, starts[order[j]] + sizes[order[j]])
            j += 1
        yield order[i:j], a, *hashes(_array([text[a : end + length - 1]]), length, gram)
        i = j


def window_hashes(text, starts: list[int], sizes: list[int], length: int = LENGTH, gram: int = GRAM) -> list[np.ndarray]:
    """Window hashes of some runs of one text."""
    got: dict[int, np.ndarray] = {}
    for ks, a, _, _, w in _slices(text, starts, sizes, length, gram):
        for k in ks:
            got[k] = w[starts[k] - a : starts[k] - a + sizes[k]]
    return [got[k] for k in range(len(starts))]


def parts(text: bytes, starts: list[int], sizes: list[int], length: int = LENGTH, gram: int = GRAM):
    """(number of the run, first window, windows, core hash, hash of all windows) of the parts of some runs of one text."""
    core_length = length - STEP + 1
    offsets = [*range(0, core_length - gram, gram), core_length - gram]
    for ks, a, h, anchor, w in _slices(text, starts, sizes, length, gram):
        ks = np.array(ks)
        n = np.array(sizes)[ks]
        run = np.repeat(np.arange(len(ks)), n)
        s = np.repeat(np.array(starts)[ks] - a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        p = anchor[s]  # one for all windows of a run
        before = p - s
        block = before // STEP
        cut = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (block[1:] != block[:-1])])
        count = np.diff(np.r_[cut, len(s)])
        b, q = block[cut], p[cut]
        core = b.astype(_U) * _ODD[61] + h[q]
        for j, o in enumerate(offsets):
            g = h[q - STEP * b + o]
            core = core + (g ^ (g >> _U(29))) * _ODD[j + 30]
        body = np.add.reduceat(_finish(w[s] + before.astype(_U) * _ODD[60]), cut)
        yield ks[run[cut]], s[cut] + a, count, _finish(core), _finish(body + count.astype(_U))


def cut(text: bytes, starts: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> tuple[bytes, int]:
    """(what is left, removed runs) without the bytes under the windows that start in the given runs."""
    d = np.zeros(len(text) + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + sizes + length - 1, -1)
    gone = np.cumsum(d)[:-1] > 0
    edges = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), edges


def _bytes(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "utf-8")


def repeated(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(tk, runs): for each text, by MD5, that has repeats, where their windows start: array of (a, size)."""
    rows = docs.select(_bytes(F.col(text_col)).alias("b")).withColumn("tk", F.unhex(F.md5("b"))).filter(F.octet_length("b") >= length)

    def find(batches):
        for b in batches:
            tk = b.column(1)
            for a in range(0, b.num_rows, 256):
                for of, first, size, key, body in runs(b.column(0).slice(a, 256).to_pylist(), length):
                    yield pa.RecordBatch.from_arrays([tk.take(pa.array(of + a)), pa.array(first, pa.int32()), pa.array(size, pa.int32()), pa.array(key.view(np.int64)), pa.array(body.view(np.int64))], ["tk", "a", "size", "key", "body"])

    copies = rows.groupBy("tk").agg(F.count("*").alias("copies")).filter("copies > 1")
    found = materialize(rows.select("b", "tk").mapInArrow(find, "tk binary, a int, size int, key long, body long"), "runs")
    # one row for each run of each text, whatever its copies; and only where the anchor is met again
    known = found.groupBy("key").agg(F.count("*").alias("c"), F.min("tk").alias("t0"), F.max("tk").alias("t1"), F.min("a").alias("a0"), F.max("a").alias("a1"))
    # keys are written before they are joined back: Spark can then split the rows of a common anchor in the join
    known = materialize(known.filter("c > 1 and (t0 <> t1 or a0 <> a1)").select("key"), "known")
    cand = materialize(found.join(known, "key").distinct(), "candidates")
    discard(found, known, shuffles=True)
    kinds = materialize(cand.groupBy("key", "body").agg(F.count("*").alias("same"), F.min(F.struct("tk", "a", "size")).alias("one")), "kinds")
    settled = cand.join(kinds.filter("same > 1").select("key", "body"), ["key", "body"], "left_semi").select("tk", "a", "size")
    # anchors with different surroundings, one run of each kind; equal windows lie alike to their anchor, so
    # no two of a run are equal, and anchors with one kind of run are settled
    several = materialize(kinds.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "several")
    border = kinds.join(several, "key").select(F.col("one.tk").alias("tk"), F.col("one.a").alias("a"), F.col("one.size").alias("size"), (F.col("same") == 1).alias("open"))

    def texts_of(some: DataFrame, name: str) -> DataFrame:
        need = materialize(some.groupBy("tk").agg(F.collect_list(F.struct("a", "size", "open")).alias("r")), name)
        keys = need.select("tk")
        return rows.join(broadcast_if(keys, keys.count(), BROADCAST_ROWS), "tk", "left_semi").dropDuplicates(["tk"]).join(need, "tk").select("tk", "b", "r")

    def split(batches):
        for b in batches:
            for tk, raw, rs in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                flag = np.array([r["open"] for r in rs])
                got = [np.concatenate(x) for x in zip(*parts(raw, [r["a"] for r in rs], [r["size"] for r in rs], length))]
                yield pa.RecordBatch.from_arrays([pa.array([tk.as_py()] * len(got[0]), pa.binary()), pa.array(got[1], pa.int32()), pa.array(got[2], pa.int32()), pa.array(flag[got[0]]), pa.array(got[3].view(np.int64)), pa.array(got[4].view(np.int64))], ["tk", "a", "size", "open", "core", "body"])

    cores = materialize(texts_of(border, "borders").mapInArrow(split, "tk binary, a int, size int, open boolean, core long, body long"), "parts")
    sorts = materialize(cores.groupBy("core", "body").agg(F.count("*").alias("same"), F.min(F.struct("tk", "a", "size", "open")).alias("one")), "sorts")
    alike = cores.filter("open").join(sorts.filter("same > 1").select("core", "body"), ["core", "body"], "left_semi").select("tk", "a", "size")
    several = materialize(sorts.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core"), "several")
    last = sorts.join(several, "core").select(F.col("one.tk").alias("tk"), F.col("one.a").alias("a"), F.col("one.size").alias("size"), ((F.col("same") == 1) & F.col("one.open")).alias("open"))

    def windows(batches):
        for b in batches:
            for tk, raw, rs in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                ws = window_hashes(raw, [r["a"] for r in rs], [r["size"] for r in rs], length)
                n = np.array([len(w) for w in ws])
                at = np.repeat(np.array([r["a"] for r in rs]) - (np.cumsum(n) - n), n) + np.arange(n.sum())
                flag = np.repeat(np.array([r["open"] for r in rs]), n)
                yield pa.RecordBatch.from_arrays([pa.array([tk.as_py()] * len(at), pa.binary()), pa.array(at, pa.int32()), pa.array(flag), pa.array(np.concatenate(ws).view(np.int64))], ["tk", "s", "open", "w"])

    seen = materialize(texts_of(last, "parts-left").mapInArrow(windows, "tk binary, s int, open boolean, w long"), "windows")
    twice = materialize(seen.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1").select("w"), "twice")
    borders = seen.filter("open").join(twice, "w").groupBy("tk").agg(F.sort_array(F.collect_list("s")).alias("s"))
    borders = borders.select("tk", F.transform("s", lambda s: F.struct(s.alias("a"), F.lit(1).alias("size"))).alias("runs"))
    settled = settled.unionByName(alike)
    inside = settled.groupBy("tk").agg(F.collect_list(F.struct("a", "size")).alias("runs"))
    both = inside.unionByName(borders).groupBy("tk").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    # every window of a text with copies is a repeat: no runs, told by ``whole``
    return both.join(copies.select("tk", F.lit(True).alias("whole")), "tk", "full").select("tk", F.coalesce("whole", F.lit(False)).alias("whole"), F.when(F.col("whole"), None).otherwise(F.col("runs")).alias("runs"))


def strip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, kept (the bytes left), n_bytes, n_removed, n_spans and tk (the text's MD5) of every row."""
    kind = dict(docs.dtypes)[id_col]
    verdict = materialize(repeated(docs, text_col, length), "verdicts")
    n = verdict.count()
    rows = docs.select(F.col(id_col).alias("doc_id"), _bytes(F.col(text_col)).alias("b")).withColumn("tk", F.unhex(F.md5("b")))
    marked = rows.join(broadcast_if(verdict.select("tk", "whole"), n, BROADCAST_ROWS), "tk", "left")
    size, zero = F.octet_length("b").cast("long"), F.lit(0).cast("long")
    # untouched and wholly removed texts need no lookup of runs, so copies never meet in a join
    plain = marked.filter("whole is null or whole").select(
        "doc_id", F.when(F.col("whole"), F.lit(b"")).otherwise(F.col("b")).alias("kept"), size.alias("n_bytes"), F.when(F.col("whole"), size).otherwise(zero).alias("n_removed"), F.when(F.col("whole"), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n_spans"), "tk"
    )

    def run(batches):
        for b in batches:
            out = [[] for _ in range(4)]
            for raw, rs in zip(b.column(1).to_pylist(), b.column(2)):
                flat = rs.values
                kept, spans = cut(raw, flat.field("a").to_numpy().astype(np.int64), flat.field("size").to_numpy().astype(np.int64), length)
                for o, x in zip(out, (kept, len(raw), len(raw) - len(kept), spans)):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.binary()), *(pa.array(x, pa.int64()) for x in out[1:]), b.column(3)], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "tk"])

    part = marked.filter("not whole").join(verdict.filter("not whole").select("tk", "runs"), "tk").select("doc_id", "b", "runs", "tk")
    return plain.unionByName(part.mapInArrow(run, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long, tk binary"))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, runs of anything but ASCII white space."""
    raw = np.frombuffer(text, np.uint8)
    ink = (raw != 32) & ((raw < 9) | (raw > 13))
    at = np.flatnonzero(ink)
    if not len(at):
        return np.empty(0, _U)
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])
    place = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
    return _finish(np.add.reduceat(_finish(_TABLE[raw[at]] + place.astype(_U) * _ODD[62]), start))


def shared_words(docs: DataFrame, text_col: str = "text", words: int = PASSAGE) -> DataFrame:
    """(tk, n_shared_words) of texts, by MD5, that share a passage of ``words`` words with another document.

    The words under such passages are counted. A text of that many words that two documents have is shared throughout.
    """
    rows = docs.select(_bytes(F.col(text_col)).alias("b")).withColumn("tk", F.unhex(F.md5("b"))).filter(F.octet_length("b") >= 2 * words - 1)

    def find(batches):
        for b in batches:
            tk = b.column(1)
            for a in range(0, b.num_rows, 256):
                for of, first, size, key, body in runs([word_hashes(t) for t in b.column(0).slice(a, 256).to_pylist()], words, WORD_GRAM):
                    yield pa.RecordBatch.from_arrays([tk.take(pa.array(of + a)), pa.array(first, pa.int32()), pa.array(size, pa.int32()), pa.array(key.view(np.int64)), pa.array(body.view(np.int64))], ["tk", "a", "size", "key", "body"])

    found = materialize(rows.select("b", "tk").mapInArrow(find, "tk binary, a int, size int, key long, body long"), "word-runs")
    known = materialize(found.groupBy("key").agg(F.min("tk").alias("t0"), F.max("tk").alias("t1")).filter("t0 <> t1").select("key"), "known")
    cand = materialize(found.join(known, "key").distinct(), "word-candidates")
    discard(found, known, shuffles=True)
    # runs alike in all windows in two texts are settled; of the others that share an anchor the windows are looked at
    kinds = materialize(cand.groupBy("key", "body").agg(F.min("tk").alias("t0"), F.max("tk").alias("t1"), F.min(F.struct("tk", "a", "size")).alias("one"), F.max(F.struct("tk", "a", "size")).alias("two")), "kinds")
    alike = kinds.filter("t0 <> t1")
    several = materialize(kinds.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "several")
    single = materialize(kinds.filter("t0 = t1").join(several, "key", "left_semi").select("key", "body"), "single")
    # two texts stand for a settled kind, so that a run of either is met by the other
    witness = alike.join(several, "key", "left_semi").select(F.explode(F.array("one", "two")).alias("x")).select("x.tk", "x.a", "x.size", F.lit(False).alias("open"))
    border = cand.join(single, ["key", "body"], "left_semi").select("tk", "a", "size", F.lit(True).alias("open")).unionByName(witness)
    some = materialize(border.groupBy("tk").agg(F.collect_list(F.struct("a", "size", "open")).alias("r")), "word-borders")
    keys = some.select("tk")
    texts = rows.join(broadcast_if(keys, keys.count(), BROADCAST_ROWS), "tk", "left_semi").dropDuplicates(["tk"]).join(some, "tk").select("tk", "b", "r")

    def windows(batches):
        for b in batches:
            for c in range(0, b.num_rows, 64):
                part = b.slice(c, 64)
                ws = [word_hashes(t) for t in part.column(1).to_pylist()]
                first = np.cumsum([0, *map(len, ws[:-1])])
                w = hashes(np.concatenate(ws), words, WORD_GRAM, anchors=False)[2]
                runs_ = part.column(2)
                of = np.repeat(np.arange(len(ws)), np.diff(runs_.offsets.to_numpy()))
                a, n, flag = (runs_.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("a", "size", "open"))
                at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
                of = np.repeat(of, n)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array(at, pa.int32()), pa.array(np.repeat(flag, n)), pa.array(w[first[of] + at].view(np.int64))], ["tk", "s", "open", "w"])

    seen = materialize(texts.mapInArrow(windows, "tk binary, s int, open boolean, w long"), "word-windows")
    twice = materialize(seen.groupBy("w").agg(F.min("tk").alias("t0"), F.max("tk").alias("t1")).filter("t0 <> t1").select("w"), "twice")
    lone = seen.filter("open").join(twice, "w").groupBy("tk").agg(F.collect_set("s").alias("s"))
    inside = cand.join(alike.select("key", "body"), ["key", "body"], "left_semi").groupBy("tk").agg(F.flatten(F.collect_list(F.sequence("a", F.col("a") + F.col("size") - 1))).alias("s"))
    at = lone.unionByName(inside).groupBy("tk").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("s"))
    none = F.struct(F.lit(-words).alias("last"), F.lit(0).cast("long").alias("n"))
    cover = F.aggregate("s", none, lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(words), x - acc["last"])).alias("n")), lambda acc: acc["n"])
    count = F.size(F.regexp_extract_all(F.decode("b", "utf-8"), F.lit(WORD), F.lit(0))).cast("long")
    copies = materialize(rows.groupBy("tk").agg(F.count("*").alias("c")).filter("c > 1").select("tk"), "copies")
    copies = rows.join(broadcast_if(copies, copies.count(), BROADCAST_ROWS), "tk", "left_semi").groupBy("tk").agg(F.max(count).alias("all")).filter(F.col("all") >= words)
    out = at.select("tk", cover.alias("n")).join(copies.select("tk", "all"), "tk", "full")
    return materialize(out.select("tk", F.coalesce("all", "n").alias("n_shared_words")), "shared-words")


def op8_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest, and n_shared_words: words in passages of over 50 words that another document has too.

    A passage of 51 words is often shorter than the 400 bytes that ``n_removed`` rests on.
    """
    docs = table(spark, sf_dir, "documents")
    words = shared_words(docs)
    out = strip(docs).join(broadcast_if(words, words.count(), BROADCAST_ROWS), "tk", "left")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.coalesce("n_shared_words", F.lit(0).cast("long")).alias("n_shared_words"))


ORACLE = None
