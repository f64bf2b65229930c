import pytest
from pyspark.sql import functions as F

from sheetflow.functions import hashing, temporal, validators


def check(spark, tokens, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    c = validators.chain(F.col("v"), tokens)
    rows = df.select("k", c.code.alias("code"), c.value.alias("value")).orderBy("k").collect()
    return [(r.code, r.value) for r in rows]


def test_not_null_lets_blanks_pass(spark):
    assert [c for c, _ in check(spark, ["notNull"], [None, "", " ", "a"])] == ["E_VALIDATE_NULL", "E_VALIDATE_NULL", None, None]


def test_lengths(spark):
    assert [c for c, _ in check(spark, ["len>=2", "len<=3"], [None, "a", "ab", "abcd"])] == [None, "E_VALIDATE_TYPE", None, "E_VALIDATE_TYPE"]


def test_int(spark):
    assert check(spark, ["int"], ["12", " 7 ", "1.5", "x", "", "99999999999999999999", None]) == [
        (None, 12), (None, 7), ("E_VALIDATE_TYPE", None), ("E_VALIDATE_TYPE", None), ("E_VALIDATE_TYPE", None), ("E_VALIDATE_TYPE", None), (None, None),
    ]


def test_int_bound(spark):
    assert [c for c, _ in check(spark, ["int>=1"], ["1", "0", "-3", "x"])] == [None] + ["E_VALIDATE_TYPE"] * 3


def test_decimal_refuses_suffixes(spark):
    assert check(spark, ["decimal"], ["1.5", ".5e2", "1d", "abc"]) == [(None, 1.5), (None, 50.0), ("E_VALIDATE_TYPE", None), ("E_VALIDATE_TYPE", None)]


def test_regex_is_anchored(spark):
    assert [c for c, _ in check(spark, ["regex:[a-z]+|x1"], ["abc", "abc\n", "x1", "Abc", None])] == [None, "E_VALIDATE_REGEX", None, "E_VALIDATE_REGEX", None]


def test_enum_is_trimmed_and_exact(spark):
    assert [c for c, _ in check(spark, ["enum:A, B"], ["A", "B", "b", " A"])] == [None, None, "E_VALIDATE_TYPE", "E_VALIDATE_TYPE"]


def test_first_failure_counts(spark):
    assert [c for c, _ in check(spark, ["notNull", "regex:\\d+", "len<=2"], ["", "abc", "123"])] == ["E_VALIDATE_NULL", "E_VALIDATE_REGEX", "E_VALIDATE_TYPE"]


@pytest.mark.parametrize("tokens", [["what"], ["len<=x"], ["int", "decimal"]])
def test_bad_tokens(spark, tokens):
    with pytest.raises(validators.BadToken):
        validators.chain(F.lit("a"), tokens)


def parsed(spark, value, kind, *patterns):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(temporal.parse(F.col("v"), kind, patterns).cast("string")).first()[0]


@pytest.mark.parametrize(("value", "pattern", "want"), [
    ("2026/5/21", "yyyy/M/d", "2026-05-21 00:00:00"), ("2026/05/21", "yyyy/M/d", "2026-05-21 00:00:00"), ("2026-5-21", "yyyy-MM-dd", None), ("2024-02-30", "yyyy-MM-dd", None),
    ("21.5.85", "d.M.yy", "1985-05-21 00:00:00"), ("21 at 5 2026", "d 'at' M yyyy", "2026-05-21 00:00:00"),
])
def test_dates(spark, value, pattern, want):
    assert parsed(spark, value, "date", pattern) == want


def test_times_and_fallbacks(spark):
    assert parsed(spark, "9:30 PM", "time", "HH:mm", "h:mm AP") == "1970-01-01 21:30:00"
    assert parsed(spark, "01/06/2026", "date", "yyyy-MM-dd", "d/M/yyyy") == "2026-06-01 00:00:00"


def test_epoch_keeps_zero_and_negative(spark):
    df = spark.createDataFrame([("0",), ("-86400",), (None,), ("x",)], "v string")
    text, failed = temporal.export_value(F.col("v"), "datetime", "epochSec", "", "yyyy-MM-dd")
    assert [tuple(r) for r in df.select(text, failed).collect()] == [("1970-01-01", False), ("1969-12-31", False), (None, False), (None, True)]


def test_unknown_pattern_token():
    with pytest.raises(temporal.BadPattern):
        temporal.translate("yyyy-QQ")


def test_row_encoding_keeps_fields_apart(spark):
    a = spark.createDataFrame([("12", "3"), ("1", "23")], "a string, b string")
    assert a.select(hashing.row_hash(a).alias("h")).distinct().count() == 2
    typed, text = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([("1",)], "a string")
    assert typed.select(hashing.row_hash(typed)).first() != text.select(hashing.row_hash(text)).first()


def test_checksum_ignores_order(spark):
    df = spark.range(100).selectExpr("id", "cast(id * 7 % 13 as string) as t")
    first = hashing.table_checksum(df, "x").first()
    assert hashing.table_checksum(df.orderBy(F.desc("id")), "x").first() == first
    assert hashing.table_checksum(df.limit(0), "x").first().content_checksum == "0"
