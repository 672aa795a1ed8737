r"""Personal data by bootstrapped contextual extraction. DataFrame operations only.

Base spans come from one pattern for each kind (email, ip, card, phone), leftmost and non-overlapping,
with matches that fail their check dropped. The pieces between matches and the matches themselves give
every position in code points, so no text leaves the JVM.

The base spans are seeds. Each seed, and each other identifier-like string (a *candidate*), has
patterns of two words each: the two before it, the two before those next to it, one on either side, and the two
after it. A side with too few words makes no pattern, so unlike texts never share an empty one. Words are taken from
the ``LEFT`` code points before and the ``RIGHT`` after; a longer word is cut there. On the graph of patterns
and instances Spark repeats, until a round accepts nothing new and scores stand still: a pattern's confidence in a kind is the mean score of its
instances, if they support it with ``SUPPORT`` at least; a candidate's score is the noisy-or of its
patterns. Candidates at ``CONFIDENT`` or more that stand in a pattern of ``PRECISE`` or more, and look
like the kind, are added as spans. A candidate is never a part of a longer run of letters and digits.

The expressions are those of the contract with possessive quantifiers and a look-behind, which match
the same spans but run in linear time and constant stack on any text.

Defined results: a null text is empty and has no spans. Rows alike in id and text have equal results,
one for each row, and count once as evidence. Null ids are allowed. An empty table gives no rows. Other
columns are ignored. ``n_*`` and ``base_sha256`` are of base spans, ``spans`` has the added ones too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table

KINDS = ("email", "ip", "card", "phone")
_L = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_L}]))[{_L}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
#: Strings that may be identifiers: seven or more digits with a sign or two between, or a spelled-out address.
CANDIDATE = r"(?<![A-Za-z0-9])\+?[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+(?![A-Za-z0-9])|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]{1,64}+(?:\x20?(?:\.|[(\[](?:dot|DOT)[)\]])\x20?[A-Za-z0-9-]{1,64}+){1,8}+"
LOOKS = {
    "email": r"^[A-Za-z].*(?:at|AT)",
    "ip": r"^[0-9]{1,3}(?:[\x20().-]{1,2}[0-9]{1,3}){3}$",
    "card": r"^(?:[0-9][\x20-]?){13,19}$",
    "phone": r"^\+?(?:[0-9][\x20().-]{0,2}){7,15}$",
}
SUPPORT, PRECISE, CONFIDENT = 3.0, 0.8, 0.9
#: Rounds before an error, and the rise of all scores together that counts as none.
MOST_ROUNDS, STILL = 100, 1e-4
#: Code points looked at before and after a string, and words taken from them.
LEFT, RIGHT = 80, 80
_SPAN = "array<struct<k:int,s:int,e:int>>"


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        d = F.translate(m, " -", "")
        return F.length(d).between(16, 19) & F.call_function("luhn_check", d)
    if kind == "phone":
        return F.length(F.regexp_replace(m, F.lit("[^0-9]"), F.lit(""))).between(8, 15)
    return F.lit(True)


def spans(text: Column, pattern: str, k: int, valid) -> Column:
    """Spans (k, s, e) of the matches of ``pattern`` that pass ``valid``."""
    rx = F.lit(pattern)
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, rx, F.lit(0)).alias("m"))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(_SPAN).alias("out"))

    def step(acc, x):
        s = acc["pos"] + F.length(x["p"])
        m = x["m"]
        one = F.array(F.struct(F.lit(k).alias("k"), s.alias("s"), (s + F.length(m)).alias("e")))
        return F.struct((s + F.coalesce(F.length(m), F.lit(0))).alias("pos"), F.when(m.isNotNull() & valid(m), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(zipped, start, step, lambda a: a["out"])


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, th, base spans and candidate spans with their text and patterns."""
    none = F.array().cast(_SPAN)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    digits = F.col("t").rlike("[0-9]")
    gate = {"email": F.contains("t", F.lit("@")), "ip": digits, "card": digits, "phone": F.contains("t", F.lit("+"))}
    found = rows.select("doc_id", "t", F.xxhash64("t").alias("th"), *[
        F.when(gate[k], spans(F.col("t"), PATTERNS[k], i, lambda m, k=k: _valid(k, m))).otherwise(none).alias(k) for i, k in enumerate(KINDS)
    ], F.when(digits | F.contains("t", F.lit("at")) | F.contains("t", F.lit("AT")), spans(F.col("t"), CANDIDATE, -1, lambda m: F.lit(True))).otherwise(none).alias("c"))
    found = found.select("doc_id", "th", "t", F.concat(*KINDS).alias("base"), "c")
    free = F.filter("c", lambda c: ~F.exists("base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    found = found.select("doc_id", "th", "t", "base", F.concat(F.col("base"), free).alias("every"))

    def context(x):
        left = ascii_lower(F.substring(F.col("t"), F.greatest(x["s"] - (LEFT - 1), F.lit(1)), F.least(x["s"], F.lit(LEFT))))
        right = ascii_lower(F.substring(F.col("t"), x["e"] + 1, F.lit(RIGHT)))
        # what touches the string on the right is a mark or the rest of its word, not a word
        before = F.regexp_extract_all(left, F.lit(r"\S+"), F.lit(0))
        after = F.regexp_extract_all(F.regexp_replace(right, F.lit(r"^\S+"), F.lit("")), F.lit(r"\S+"), F.lit(0))
        b, a = lambda i: F.try_element_at(before, F.lit(-i)), lambda i: F.try_element_at(after, F.lit(i))
        shapes = (F.concat(F.lit("< "), b(2), F.lit(" "), b(1)), F.concat(F.lit("<< "), b(3), F.lit(" "), b(2)), F.concat(b(1), F.lit(" _ "), a(1)), F.concat(F.lit("> "), a(1), F.lit(" "), a(2)))
        return F.struct(
            x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.substring(F.col("t"), x["s"] + 1, x["e"] - x["s"]).alias("i"),
            F.array_distinct(F.array_compact(F.array(*shapes))).alias("p"),
        )

    return found.select("doc_id", "th", "base", F.transform("every", context).alias("every"))


def _graph(seen: DataFrame) -> DataFrame:
    """Accepted (doc_id, th, k, s, e) of candidates."""
    edges = materialize(seen.select("i", "k", F.explode("p").alias("p")).distinct(), "edges")
    count = edges.select("p", "i").distinct().groupBy("p").agg(F.count("*").alias("n"))
    seeds = edges.filter("k >= 0").select("i", "k", F.lit(1.0).alias("score")).distinct()
    score, patterns, cands = seeds, None, edges.filter("k < 0").select("p", "i")
    last = None
    for _ in range(MOST_ROUNDS):
        patterns = (
            edges.select("p", "i").distinct().join(score, "i").groupBy("p", "k").agg(F.sum("score").alias("support"))
            .join(count, "p").select("p", "k", "support", (F.col("support") / F.col("n")).alias("conf")).filter(F.col("support") >= SUPPORT)
        )
        patterns = materialize(patterns, "patterns")
        fit = F.lit(False)
        for i, k in enumerate(KINDS):
            fit = fit | ((F.col("k") == i) & F.col("i").rlike(LOOKS[k]))
        log = F.sum(F.log(1 - F.least(F.col("conf"), F.lit(0.999))))
        found = cands.join(patterns, "p").filter(fit).groupBy("i", "k").agg((1 - F.exp(log)).alias("score"))
        score = materialize(seeds.unionByName(found.join(seeds.select("i", "k"), ["i", "k"], "left_anti")), "scores")
        # scores only rise from round to round, so equal counts are equal sets
        now = [
            *patterns.agg(F.count("*"), F.count(F.when(F.col("conf") >= PRECISE, 1))).first(),
            *score.agg(F.count("*"), F.count(F.when(F.col("score") >= CONFIDENT, 1)), F.coalesce(F.sum("score"), F.lit(0.0))).first(),
        ]
        if last and now[:4] == last[:4] and now[4] - last[4] < STILL:
            break
        last = now
    else:
        raise RuntimeError("extraction did not converge")
    # one kind for each instance: the best, then the first listed
    best = score.join(seeds.select("i").distinct(), "i", "left_anti").filter(F.col("score") >= CONFIDENT)
    best = best.groupBy("i").agg(F.min(F.struct((-F.col("score")).alias("o"), "k")).alias("b")).select("i", F.col("b.k").alias("kind"))
    sure = patterns.filter(F.col("conf") >= PRECISE).select("p", F.col("k").alias("kind"))
    return seen.filter("k < 0").select("doc_id", "th", "s", "e", "i", F.explode("p").alias("p")).join(best, "i").join(sure, ["p", "kind"]).select("doc_id", "th", F.col("kind").alias("k"), "s", "e").distinct()


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and added: arrays of (k, s, e), k the place of the kind in KINDS."""
    rows = materialize(_base(docs, id_col, text_col), "spans")
    seen = rows.select("doc_id", "th", F.explode("every").alias("x")).select("doc_id", "th", "x.*")
    added = _graph(seen).groupBy("doc_id", "th").agg(F.collect_list(F.struct("k", "s", "e")).alias("added"))
    added = added.select(F.col("doc_id").alias("d2"), F.col("th").alias("th2"), "added")
    out = rows.join(added, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("th2")), "left")
    return out.select("doc_id", "base", F.coalesce("added", F.array().cast(_SPAN)).alias("added"))


def _joined(a: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(a), lambda x: F.concat_ws(":", F.element_at(name, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _of(i: int):
    return lambda b: b["k"] == i


def op4_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = extract(table(spark, sf_dir, "documents"))
    n = [F.size(F.filter("base", _of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return x.select("doc_id", *n, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"))


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of ``op4_pii_bootstrap``, which SQL can say too."""
    return op4_pii_bootstrap(spark, sf_dir).drop("spans")


ORACLE = None


def _base_sql() -> str:
    """Pieces between matches and the matches give every start; the contract's expressions as they stand."""
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, len({digits}) + 1), lambda j: CASE WHEN j % 2 = 1 THEN CAST(substr({digits}, -j, 1) AS INT) ELSE (CAST(substr({digits}, -j, 1) AS INT) * 2) % 10 + (CAST(substr({digits}, -j, 1) AS INT) * 2) // 10 END)) % 10 = 0"
    valid = {"email": "true", "ip": "len(list_filter(string_split(m, '.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0", "card": f"len({digits}) BETWEEN 16 AND 19 AND {luhn}", "phone": f"len({digits}) BETWEEN 8 AND 15"}
    parts = []
    for i, k in enumerate(KINDS):
        parts.append(f"""SELECT rid, {i} AS o, '{k}' AS kind, s, m FROM (SELECT rid, ms[i] AS m, CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
FROM (SELECT rid, ps, ms, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT rid, string_split_regex(t, '{plain[k]}') AS ps, regexp_extract_all(t, '{plain[k]}') AS ms FROM d))) WHERE {valid[k]}""")
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
g AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)}, string_agg(kind || ':' || s || ':' || (s + length(m)), ',' ORDER BY o, s) AS x FROM f GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(x, '')) AS base_sha256 FROM d LEFT JOIN g USING (rid)"""


BASE_ORACLE = _base_sql()
