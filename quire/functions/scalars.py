"""Scalar functions on cells: addresses, numbers, dates, comparison, formats. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.schemas import ERRORS, MAX_COL, MAX_ROW

#: What a number may look like; the cast alone also takes forms like ``1d`` or ``NaN``.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: White space in the sense of the format, no-break spaces and the byte order mark included.
SPACES = r"[\s   -     　﻿]+"


def to_number(text: Column) -> Column:
    """Double if the text is a plain number, else null."""
    return F.when(F.rlike(text, F.lit(NUMBER)), text.try_cast("double"))


def coerce_number(text: Column) -> Column:
    """White space goes, the first comma is a decimal point; anything but a finite number is null."""
    plain = F.regexp_replace(text, SPACES, "")
    pointed = F.when(F.locate(",", plain) > 0, F.concat(F.substring_index(plain, ",", 1), F.lit("."), F.regexp_replace(plain, "^[^,]*,", ""))).otherwise(plain)
    value = to_number(pointed)
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def column_letters(col: Column) -> Column:
    """Letters of a 0-based column (A, Z, AA, XFD); null outside the sheet."""
    n = col.cast("long")
    letter = lambda x: F.char(F.lit(65) + x)
    third = F.when(n >= 702, letter(F.floor((n - 702) / 676))).otherwise(F.lit(""))
    second = F.when(n >= 26, letter(F.pmod(F.floor((n - 26) / 26), F.lit(26)))).otherwise(F.lit(""))
    return F.when(n.between(0, MAX_COL), F.concat(third, second, letter(F.pmod(n, F.lit(26)))))


def a1_format(row: Column, col: Column) -> Column:
    """Address of a 0-based cell."""
    return F.when(row.between(0, MAX_ROW), F.concat(column_letters(col), (row + 1).cast("long").cast("string")))


def letters_to_column(letters: Column) -> Column:
    return F.aggregate(F.split(letters, ""), F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64)) - 1


def a1_parse(address: Column) -> Column:
    """struct(row, col) of an address; anchors are dropped; null if it is none."""
    pattern = F.lit(r"^\$?([A-Za-z]{1,3})\$?([1-9][0-9]{0,6})$")
    letters, digits = (F.regexp_extract(address, r"^\$?([A-Za-z]{1,3})\$?([1-9][0-9]{0,6})$", i) for i in (1, 2))
    col, row = letters_to_column(F.upper(letters)), digits.try_cast("long") - 1
    return F.when(F.rlike(address, pattern) & (col <= MAX_COL) & (row <= MAX_ROW), F.struct(row.alias("row"), col.alias("col")))


def a1_problem(address: Column) -> Column:
    """Why :func:`a1_parse` gives null: empty, no address, column or row beyond the sheet; null for good addresses."""
    shape = r"^\$?([A-Za-z]+)\$?([0-9]+)$"
    letters, digits = (F.regexp_extract(address, shape, i) for i in (1, 2))
    row = digits.try_cast("decimal(38,0)")
    return (
        F.when(F.coalesce(F.length(address), F.lit(0)) == 0, "empty").when(~F.rlike(address, F.lit(shape)), "no address").when((F.length(letters) > 3) | (letters_to_column(F.upper(F.substring(letters, 1, 3))) > MAX_COL), "column")
        .when(F.startswith(digits, F.lit("0")) | row.isNull() | (row > MAX_ROW + 1), "row")
    )


def range_parse(text: Column) -> Column:
    """struct(r0, c0, r1, c1) of a range or a single cell, corners put in order."""
    a, b = a1_parse(F.substring_index(text, ":", 1)), a1_parse(F.when(F.locate(":", text) > 0, F.regexp_replace(text, "^[^:]*:", "")).otherwise(text))
    box = F.struct(F.least(a["row"], b["row"]).alias("r0"), F.least(a["col"], b["col"]).alias("c0"), F.greatest(a["row"], b["row"]).alias("r1"), F.greatest(a["col"], b["col"]).alias("c1"))
    return F.when(a.isNotNull() & b.isNotNull(), box)


def serial_to_date(num: Column, date1904: bool = False) -> Column:
    """Date of a serial number; serial 60 (29 February 1900 in this format) gives the day after 28 February."""
    days = F.floor(num).try_cast("int")
    base = F.date_add(F.lit("1904-01-01").cast("date"), days) if date1904 else F.when(days >= 60, F.date_add(F.lit("1899-12-30").cast("date"), days)).otherwise(F.date_add(F.lit("1899-12-31").cast("date"), days))
    return F.when(num >= 0, base)


def date_to_serial(date: Column, date1904: bool = False) -> Column:
    if date1904:
        return F.datediff(date, F.lit("1904-01-01").cast("date")).cast("double")
    n = F.datediff(date, F.lit("1899-12-30").cast("date"))
    return F.when(n >= 61, n).when(n >= 2, n - 1).cast("double")


def serial_to_timestamp(num: Column, date1904: bool = False) -> Column:
    """Timestamp (without zone) of a serial number, to the second; null before the first day."""
    seconds = F.round((num - F.floor(num)) * 86400).cast("long")
    return F.when(num >= 0, F.timestamp_add("SECOND", seconds, serial_to_date(num, date1904).cast("timestamp_ntz")))


def timestamp_to_serial(at: Column, date1904: bool = False) -> Column:
    """Serial number of a timestamp: days and the fraction of the day."""
    at = at.cast("timestamp_ntz")
    return date_to_serial(F.to_date(at), date1904) + (F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)) / 86400.0


_TIME = r"^(\d+):([0-5]?\d)(?::([0-5]?\d(?:\.\d+)?))?$"
_ISO = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?))?(?:Z|[+-]\d{2}:?\d{2})?$"


def clock_to_fraction(text: Column) -> Column:
    """Day fraction of ``HH:MM`` or ``HH:MM:SS.f``; null if it is none."""
    part = lambda i: F.coalesce(F.regexp_extract(text, _TIME, i).try_cast("double"), F.lit(0.0))
    return F.when(F.rlike(text, F.lit(_TIME)), part(1) / 24 + part(2) / 1440 + part(3) / 86400)


def iso_to_serial(text: Column, date1904: bool = False) -> Column:
    """Serial number of an ISO date with or without time; zones are not read; null if it is none."""
    day = F.regexp_extract(text, _ISO, 1).try_cast("date")
    clock = F.coalesce(clock_to_fraction(F.regexp_extract(text, _ISO, 2)), F.lit(0.0))
    return F.when(F.rlike(text, F.lit(_ISO)), date_to_serial(day, date1904) + clock)


_DURATION = r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"


def duration_to_fraction(text: Column) -> Column:
    """Day fraction of an ISO duration such as ``P1DT12H30M5S``; null if it is none."""
    part = lambda i, unit: F.coalesce(F.regexp_extract(text, _DURATION, i).try_cast("double"), F.lit(0.0)) / unit
    ok = F.rlike(text, F.lit(_DURATION)) & (F.length(text) > 1) & ~F.endswith(text, F.lit("T"))
    return F.when(ok, part(1, 1.0) + part(2, 24.0) + part(3, 1440.0) + part(4, 86400.0))


def value_rank(kind: Column) -> Column:
    return F.when(kind == "number", 0).when(kind == "text", 1).when(kind == "bool", 2)


def excel_compare(kind_a: Column, num_a: Column, txt_a: Column, kind_b: Column, num_b: Column, txt_b: Column) -> Column:
    """-1, 0 or 1: numbers < texts < booleans, texts regardless of case; an empty cell equals 0 and '' and is less than other texts; errors compare to nothing (null)."""
    order = lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0)
    kind = lambda own, other: F.when(own == "empty", F.when(other == "text", F.lit("text")).otherwise(F.lit("number"))).otherwise(own)
    ka, kb = kind(kind_a, kind_b), kind(kind_b, kind_a)
    na, nb = F.coalesce(num_a, F.lit(0.0)), F.coalesce(num_b, F.lit(0.0))
    ta, tb = F.lower(F.coalesce(txt_a, F.lit(""))), F.lower(F.coalesce(txt_b, F.lit("")))
    same = F.when(ka == "text", order(ta, tb)).otherwise(order(na, nb))
    return F.when((kind_a == "error") | (kind_b == "error"), F.lit(None)).when(ka != kb, order(value_rank(ka), value_rank(kb))).otherwise(same).cast("int")


def half_up(num: Column, places: int) -> Column:
    """Absolute value rounded half away from zero on its shortest decimal form, as a decimal; null from 1e26 (0 places: 1e38) on."""
    small = F.round(F.abs(num).cast("string").try_cast("decimal(38,12)"), places).try_cast(f"decimal(38,{places})")
    return small if places else F.coalesce(small, F.abs(num).try_cast("decimal(38,0)"))


def format_plain(num: Column, code: Column, date1904: bool = False) -> Column:
    """Text of a number under the plain codes 0, 0.00, #,##0, #,##0.00, 0%, 0.00% and yyyy-mm-dd; null under others.

    NaN, infinities and numbers too large for the code (from 1e26 on with
    decimals, else from 1e38) are ``#NUM!``.
    """
    two, none = half_up(num, 2), half_up(num, 0)
    text = lambda d: d.cast("string")
    finite = lambda t: F.when(num.isNotNull(), F.coalesce(t, F.lit("#NUM!")))
    sign = lambda t: F.when((num < 0) & F.rlike(t, F.lit("[1-9]")), F.concat(F.lit("-"), t)).otherwise(t)
    return (
        F.when(code == "0", finite(sign(text(none))))
        .when(code == "0.00", finite(sign(text(two))))
        .when(code == "#,##0", finite(sign(F.format_number(none, 0))))
        .when(code == "#,##0.00", finite(sign(F.format_number(two, 2))))
        .when(code == "0%", finite(F.concat(sign(text(half_up(num * 100, 0))), F.lit("%"))))
        .when(code == "0.00%", finite(F.concat(sign(text(half_up(num * 100, 2))), F.lit("%"))))
        .when(code == "yyyy-mm-dd", F.when(num < 0, F.lit("#####")).when(~(num < 2958466), F.lit("#NUM!")).when((F.floor(num) == 60) & F.lit(not date1904), F.lit("1900-02-29")).otherwise(F.date_format(serial_to_date(num, date1904), "yyyy-MM-dd")))
    )


def typed_number(vtype: Column, raw: Column) -> Column:
    """The num of :func:`typed_value` for cells of kind number, null for others."""
    return F.when(F.coalesce(vtype, F.lit("n")) == "n", to_number(F.trim(raw)))


def typed_value(vtype: Column, raw: Column) -> Column:
    """struct(kind, num, txt): number, shared, text, bool, error or empty; what cannot be read stays text."""
    t = F.when(F.coalesce(vtype, F.lit("n")).isin("str", "inlineStr", "d"), raw).otherwise(F.trim(raw))
    kind = F.coalesce(vtype, F.lit("n"))
    num = to_number(t)
    truth = F.when(F.lower(t).isin("1", "true"), 1.0).when(F.lower(t).isin("0", "false"), 0.0)
    made = lambda k, n, x: F.struct(F.lit(k).alias("kind"), n.cast("double").alias("num"), x.alias("txt"))
    null_txt, null_num = F.lit(None).cast("string"), F.lit(None).cast("double")
    return (
        F.when(F.coalesce(F.length(t), F.lit(0)) == 0, made("empty", null_num, null_txt))
        .when((kind == "n") & num.isNotNull(), made("number", num, null_txt))
        .when((kind == "s") & F.rlike(t, F.lit(r"^\d{1,9}$")), made("shared", t.try_cast("double"), null_txt))
        .when((kind == "b") & truth.isNotNull(), made("bool", truth, null_txt))
        .when((kind == "e") & t.isin(*ERRORS), made("error", null_num, t))
        .otherwise(made("text", null_num, t))
    )
