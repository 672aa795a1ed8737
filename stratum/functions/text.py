"""Tokenisers and text scalar functions, all as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ideographs that are indexed: the basic block, extensions A to F and the compatibility blocks.
CJK = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2ebef}\x{2f800}-\x{2fa1f}"
HANGUL = r"\x{ac00}-\x{d7a3}"


def is_cjk(c: Column) -> Column:
    """The first character is an indexed ideograph."""
    return c.rlike(f"^[{CJK}]")


def has_han(c: Column) -> Column:
    """Some character is of the Han script, which is wider than ``is_cjk``."""
    return c.rlike(r"\p{IsHan}")


def han_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{IsHan}"))


def _lower(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.lower(t))


def han_tokens(c: Column) -> Column:
    """One token for each ideograph; anything else goes, so neighbours may stand apart in the text."""
    return F.regexp_extract_all(c, F.lit(f"[{CJK}]"), F.lit(0))


def han_string(c: Column) -> Column:
    """The tokens of ``han_tokens`` side by side."""
    return F.regexp_replace(c, f"[^{CJK}]+", "")


def ko_tokens(c: Column) -> Column:
    """A token for each syllable or ideograph and for each run of ASCII letters and digits."""
    return F.regexp_extract_all(c, F.lit(f"[{HANGUL}]|[{CJK}]|[0-9A-Za-z]+"), F.lit(0))


def word_tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, for text in alphabets."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def index_tokens(c: Column, mode: str) -> Column:
    """Tokens as an index holds them: case does not matter."""
    return {"han": han_tokens, "ko": lambda x: _lower(ko_tokens(x)), "word": word_tokens}[mode](c)


def char_count(c: Column) -> Column:
    return F.size(han_tokens(c))


def chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def code_point(c: Column) -> Column:
    """The character of a hexadecimal code point, supplementary planes included."""
    return F.decode(F.unhex(F.lpad(c, 8, "0")), "UTF-32")


def utf16_offset(c: Column, at: Column) -> Column:
    """A code-point offset counted in UTF-16 units."""
    return at + F.regexp_count(F.substring(c, F.lit(1), at), F.lit(r"[\x{10000}-\x{10ffff}]"))


def map_chars(c: Column, mapping: Column) -> Column:
    """Each character by ``mapping`` (a MAP column); targets beyond the basic plane are not taken."""
    to = lambda x: mapping[x]
    fits = lambda t: t.isNotNull() & ~t.rlike(r"[\x{10000}-\x{10ffff}]")
    return F.array_join(F.transform(chars(c), lambda x: F.when(fits(to(x)), to(x)).otherwise(x)), "")


def to_simplified(df: DataFrame, col: str, table: DataFrame, char: str = "char", simplified: str = "simplified", out: str = "simplified_text") -> DataFrame:
    """``df`` with the simplified text and whether it changed. ``table`` is a character table: a few thousand rows."""
    m = table.agg(F.map_from_entries(F.collect_list(F.struct(char, simplified))).alias("_m"))
    d = df.join(F.broadcast(m), F.lit(True))
    return d.withColumn(out, map_chars(F.col(col), F.col("_m"))).withColumn("changed", F.col(out) != F.col(col)).drop("_m")


def to_dueum(c: Column) -> Column:
    """The initial-sound law on a word's first syllable: r and n before a y-vowel fall away, other r becomes n."""
    cp = F.ascii(c)
    i = cp - 0xAC00
    cho, jung = F.floor(i / 588), F.floor((i % 588) / 28)
    y_vowel = jung.isin(2, 3, 6, 7, 12, 17, 20)
    new = F.when((cho == 5) & y_vowel, 11).when(cho == 5, 2).when((cho == 2) & y_vowel, 11)
    head = F.decode(F.unhex(F.lpad(F.hex((cp + (new - cho) * 588).cast("long")), 8, "0")), "UTF-32")
    ok = cp.between(0xAC00, 0xD7A3) & new.isNotNull()
    return F.when(ok, F.concat(head, F.substring(c, F.lit(2), F.length(c)))).otherwise(c)


def headword(c: Column) -> Column:
    """A dictionary headword without its number, hyphens, spaces and marks."""
    return F.regexp_replace(F.regexp_replace(c, r"[0-9]+$", ""), r"[-\s·^]", "")


def truncate(c: Column, most: int = 60) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def reading_display(reading_type: Column) -> tuple[Column, Column]:
    """(role, label) shown for a kind of reading."""
    first = reading_type == "original"
    return F.when(first, "primary").otherwise("secondary"), F.when(first, "original reading").otherwise("conventional reading")


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))
