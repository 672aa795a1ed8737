import pytest
from pyspark.sql import functions as F

from stratum.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("x, y", [("卒本川", "卒 本 川"), ("新羅, 本紀 第一.", "新 羅 本 紀 第 一"), ("\U00020000王", "\U00020000 王"), ("abc 123 한글", "")])
def test_han(spark, x, y):
    assert one(spark, x, T.han_tokens) == y.split()


@pytest.mark.parametrize("x, y", [("일식이 있었다", "일 식 이 있 었 다"), ("BC57년", "BC57 년"), ("24년 6월", "24 년 6 월"), ("고구려(高句麗), 백제.", "고 구 려 高 句 麗 백 제")])
def test_ko(spark, x, y):
    assert one(spark, x, T.ko_tokens) == y.split()


@pytest.mark.parametrize("x, y", [("려", "여"), ("리", "이"), ("락", "낙"), ("로", "노"), ("녀", "여"), ("려수", "여수"), ("가", "가"), ("abc", "abc"), ("", "")])
def test_dueum(spark, x, y):
    assert one(spark, x, T.to_dueum) == y


def test_small_ones(spark):
    assert one(spark, "김-유 신^02", T.headword) == "김유신"
    assert one(spark, "a" * 61, T.truncate) == "a" * 60 + "…"
    assert one(spark, "20000", T.code_point) == "\U00020000"
    assert one(spark, "\U00020000王x", lambda c: T.utf16_offset(c, F.lit(2))) == 3
    assert one(spark, "々x", T.has_han) is True and one(spark, "々", T.is_cjk) is False


def test_simplified(spark):
    t = spark.createDataFrame([("遼", "辽"), ("東", "东"), ("高", "\U00020000")], "char string, simplified string")
    d = spark.createDataFrame([("遼東",), ("高",)], "x string")
    rows = {r["x"]: (r["simplified_text"], r["changed"]) for r in T.to_simplified(d, "x", t).collect()}
    assert rows == {"遼東": ("辽东", True), "高": ("高", False)}
