"""Number formats against the table of the format's unit cases."""

import pytest
from pyspark.sql import functions as F

from quire.functions.number_format import format_number, is_date, render

CASES = [
    (42, "General", "42"), (0.1 + 0.2, "General", "0.3"), (1e12, "General", "1E+12"), (float("nan"), "General", "#NUM!"), (1.5, "0", "2"), (2.5, "0", "3"), (-2.5, "0", "-3"), (0.125, "0.00", "0.13"), (0.5, "#.##", ".5"),
    (1234567, "#,##0", "1,234,567"), (1234567, "#,##0,", "1,235"), (1234567, "0,,", "1"), (0.25, "0%", "25%"), (0.1234, "0.00%", "12.34%"), (1234.5, "[$€-407]#,##0.00", "€1,234.50"), (-5, "0.00;[Red](0.00)", "(5.00)"),
    (0, "0.00;(0.00);—", "—"), (-5, "0.00;", ""), (123456, "0.00E+00", "1.23E+05"), (1234, "##0.0E+0", "1.2E+3"), (1, "yyyy-mm-dd", "1900-01-01"), (60, "yyyy-mm-dd", "1900-02-29"), (61, "yyyy-mm-dd", "1900-03-01"),
    (45002.5, "dd.mm.yyyy hh:mm", "17.03.2023 12:00"), (1, "dddd", "Sunday"), (60, "ddd", "Wed"), (0.5, "h:mm AM/PM", "12:00 PM"), (1.5, "[h]:mm:ss", "36:00:00"), (-1, "yyyy", "#####"), (12345678, "000-00-0000", "012-34-5678"),
]


@pytest.mark.parametrize(("num", "code", "want"), CASES)
def test_render(num, code, want):
    assert render(float(num), code) == want


def test_1904_and_column(spark):
    assert render(0.0, "yyyy-mm-dd", True) == "1904-01-01" and render(45000.0, "yyyy-mm-dd", True) == "2027-03-16"
    assert is_date("d mmm") and not is_date("0.00")
    t = spark.createDataFrame([(1.5, "0"), (None, "0"), (2.0, None)], "n double, c string")
    assert [r[0] for r in t.select(format_number(F.col("n"), F.col("c"))).collect()] == ["2", None, "2"]
