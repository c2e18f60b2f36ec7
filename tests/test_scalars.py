"""Scalar functions against the unit cases of the format."""

import pytest
from pyspark.sql import functions as F

from quire.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("A1", (0, 0)), ("$B$10", (9, 1)), ("XFD1048576", (1048575, 16383)), ("XFE1", None), ("A0", None), ("A1048577", None), ("", None)])
def test_addresses(spark, text, want):
    got = one(spark, S.a1_parse(F.lit(text)))
    assert (got and tuple(got)) == want
    if want:
        assert one(spark, S.a1_format(F.lit(want[0]), F.lit(want[1]))) == text.replace("$", "")


@pytest.mark.parametrize(("text", "want"), [("1 234,5", 1234.5), ("1,2,3", None), ("", None), ("1e3", 1000.0), ("abc", None), ("1d", None), ("NaN", None), ("1 000", 1000.0)])
def test_numbers_from_text(spark, text, want):
    assert one(spark, S.coerce_number(F.lit(text))) == want


@pytest.mark.parametrize(("vtype", "raw", "kind", "num", "txt"), [("n", " 1.5 ", "number", 1.5, None), ("n", "abc", "text", None, "abc"), ("s", "3", "shared", 3.0, None), ("b", "true", "bool", 1.0, None), ("b", "yes", "text", None, "yes"), ("e", "#DIV/0!", "error", None, "#DIV/0!"), ("e", "#FOO", "text", None, "#FOO"), ("str", " x ", "text", None, " x "), ("n", "", "empty", None, None)])
def test_typed_values(spark, vtype, raw, kind, num, txt):
    assert tuple(one(spark, S.typed_value(F.lit(vtype), F.lit(raw)))) == (kind, num, txt)


@pytest.mark.parametrize(("num", "code", "want"), [(1.5, "0", "2"), (2.5, "0", "3"), (-2.5, "0", "-3"), (0.125, "0.00", "0.13"), (1234567.0, "#,##0", "1,234,567"), (0.25, "0%", "25%"), (0.1234, "0.00%", "12.34%"), (1.0, "yyyy-mm-dd", "1900-01-01"), (60.0, "yyyy-mm-dd", "1900-02-29"), (61.0, "yyyy-mm-dd", "1900-03-01"), (-1.0, "yyyy-mm-dd", "#####"), (-0.001, "0.00", "0.00")])
def test_plain_formats(spark, num, code, want):
    assert one(spark, S.format_plain(F.lit(num), F.lit(code))) == want


def test_comparison(spark):
    cmp = lambda ka, na, ta, kb, nb, tb: one(spark, S.excel_compare(*map(F.lit, (ka, na, ta, kb, nb, tb))))
    assert cmp("number", 9.0, "", "text", 0.0, "1") == -1
    assert cmp("text", 0.0, "Ab", "text", 0.0, "aB") == 0
    assert cmp("text", 0.0, "z", "bool", 0.0, "") == -1
    assert cmp("empty", 0.0, "", "number", 0.0, "") == 0
    assert cmp("empty", 0.0, "", "text", 0.0, "a") == -1
    assert cmp("error", 0.0, "", "text", 0.0, "a") is None


@pytest.mark.parametrize(("text", "want"), [("P1DT12H", 1.5), ("PT30M", 30 / 1440), ("PT", None), ("P", None), ("x", None)])
def test_durations(spark, text, want):
    got = one(spark, S.duration_to_fraction(F.lit(text)))
    assert got == want if want is None else abs(got - want) < 1e-12


def test_formats_of_any_double(spark):
    codes = ["0", "0.00", "#,##0", "#,##0.00", "0%", "0.00%", "yyyy-mm-dd"]
    values = [float("nan"), float("inf"), -float("inf"), 1e30, -1e300, 1234567.125, -0.004, None]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {c: [r[1] for r in table.select("i", S.format_plain(F.col("v"), F.lit(c)).alias("t")).orderBy("i").collect()] for c in codes}
    assert got["#,##0.00"] == ["#NUM!"] * 5 + ["1,234,567.13", "0.00", None]
    assert got["0"][:3] == ["#NUM!"] * 3 and got["0"][3] == "1000000000000000000000000000000" or got["0"][3].startswith("10000000000000000")
    assert got["yyyy-mm-dd"][:4] == ["#NUM!", "#NUM!", "#####", "#NUM!"] and all(got[c][-1] is None for c in codes)


def test_times_and_addresses(spark):
    one = spark.range(1)
    v = one.select(
        S.iso_to_serial(F.lit("1900-03-01T12:00:00Z")).alias("a"), S.iso_to_serial(F.lit("2020-13-01")).alias("b"), S.clock_to_fraction(F.lit("36:00")).alias("c"), S.clock_to_fraction(F.lit("1:2:3.5")).alias("d"), S.serial_to_timestamp(F.lit(45002.5)).cast("string").alias("e"), S.serial_to_timestamp(F.lit(0.5), True).cast("string").alias("f"),
        *[S.a1_problem(F.lit(x)).alias(f"p{i}") for i, x in enumerate(("A1", "", "1A", "XFE1", "A0", "A1048577", "AAAA1"))],
    ).first()
    assert (v["a"], v["b"], v["c"], round(v["d"] * 86400, 6), v["e"], v["f"]) == (61.5, None, 1.5, 3723.5, "2023-03-17 12:00:00", "1904-01-01 12:00:00")
    assert [v[f"p{i}"] for i in range(7)] == [None, "empty", "no address", "column", "row", "row", "column"]


def test_display(spark):
    from quire.functions.number_format import display_text, format_number

    rows = [("number", 2.5, None, None, "0", None), ("bool", 0.0, None, None, None, None), ("error", None, "#N/A", None, None, None), ("empty", None, None, "=A1", None, None), ("text", None, "t", None, None, None), ("number", 1.0, None, None, "0", "")]
    t = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, n double, t string, f string, c string, e string")
    got = [tuple(r["x"]) for r in t.select("i", display_text(F.col("k"), F.col("n"), F.col("t"), F.col("f"), F.col("c"), F.col("e")).alias("x")).orderBy("i").collect()]
    assert got == [("3", "right"), ("FALSE", "center"), ("#N/A", "center"), ("", "left"), ("t", "left"), ("", "left")]
    assert spark.range(1).select(format_number(F.lit(45000.0), F.lit("yyyy-mm-dd"), True).alias("x")).first()["x"] == "2027-03-16"
