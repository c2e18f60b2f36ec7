"""Whole number formats: every distinct code is parsed once per batch, values are rendered under it.

Sections by sign, digit placeholders, grouping, scaling, percent, exponents,
literals, dates, times and elapsed times.  Fractions (``# ?/?``) are not known.
"""

from __future__ import annotations

import datetime
import math
import re
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_TOKEN = re.compile(r'"[^"]*"|\\.|_.|\*.|\[[^\]]*\]|General|AM/PM|A/P|E[+-]|[yY]+|[mM]+|[dD]+|[hH]+|[sS]+(?:\.0+)?|[0#?.,%@]|.', re.I | re.S)
# English names.
MONTHS = "January February March April May June July August September October November December".split()
DAYS = "Sunday Monday Tuesday Wednesday Thursday Friday Saturday".split()


# The codes of built-in formats by id, as the file format's standard lists them for en-US.
BUILTIN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 5: "$#,##0_);($#,##0)", 6: "$#,##0_);[Red]($#,##0)", 7: "$#,##0.00_);($#,##0.00)", 8: "$#,##0.00_);[Red]($#,##0.00)",
    9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "m/d/yyyy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yyyy h:mm",
    37: "#,##0_);(#,##0)", 38: "#,##0_);[Red](#,##0)", 39: "#,##0.00_);(#,##0.00)", 40: "#,##0.00_);[Red](#,##0.00)", 41: '_(* #,##0_);_(* (#,##0);_(* "-"_);_(@_)', 42: '_($* #,##0_);_($* (#,##0);_($* "-"_);_(@_)',
    43: '_(* #,##0.00_);_(* (#,##0.00);_(* "-"??_);_(@_)', 44: '_($* #,##0.00_);_($* (#,##0.00);_($* "-"??_);_(@_)', 45: "mm:ss", 46: "[h]:mm:ss", 47: "mm:ss.0", 48: "##0.0E+0", 49: "@",
}


def builtin_code(fmt_id: Column) -> Column:
    """The code of a built-in format, null for other ids."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in BUILTIN.items() for x in pair]), fmt_id.cast("int"))


@lru_cache(maxsize=4096)
def parse(code: str) -> list[list[tuple[str, str]]]:
    """Sections as lists of (kind, text); kinds: lit, digit, date, elapsed, ampm, exp, text, general."""
    sections: list[list[tuple[str, str]]] = [[]]
    for m in _TOKEN.finditer(code):
        t = m[0]
        low = t.lower()
        out = sections[-1]
        if t == ";":
            sections.append([])
        elif t[0] == '"':
            out.append(("lit", t[1:-1]))
        elif t[0] == "\\" and len(t) == 2:
            out.append(("lit", t[1]))
        elif t[0] == "_" and len(t) == 2:
            out.append(("lit", " "))
        elif t[0] == "*" and len(t) == 2:
            continue
        elif t[0] == "[" and len(t) > 2:
            if t[1] == "$":
                out.append(("lit", t[2:-1].split("-")[0]))
            elif set(low[1:-1]) in ({"h"}, {"m"}, {"s"}):
                out.append(("elapsed", low[1:-1]))
        elif low == "general":
            out.append(("general", ""))
        elif low in ("am/pm", "a/p"):
            out.append(("ampm", t))
        elif low in ("e+", "e-"):
            out.append(("exp", t))
        elif low[0] in "ymdhs":
            out.append(("date", low))
        elif t in "0#?.,":
            out.append(("digit", t))
        elif t == "%":
            out.append(("percent", "%"))
        elif t == "@":
            out.append(("text", ""))
        else:
            out.append(("lit", t))
    return sections


def is_date(code: str) -> bool:
    return any(k in ("date", "elapsed") for k, _ in parse(code)[0])


def general(x: float) -> str:
    if math.isnan(x) or math.isinf(x):
        return "#NUM!"
    if x == 0:
        return "0"
    if 1e-9 <= abs(x) < 1e11:
        text = f"{x:.{max(0, 9 - max(0, math.floor(math.log10(abs(x)))))}f}"
        return (text.rstrip("0").rstrip(".") if "." in text else text) or "0"
    mantissa, exponent = f"{x:.5E}".split("E")
    return f"{mantissa.rstrip('0').rstrip('.')}E{exponent[0]}{exponent[1:].zfill(2)}"


def _fill(digits: str, places: str, grouped: bool) -> list[str]:
    """Text for each placeholder of the whole part; the first takes all digits that are left."""
    out, used = [], 0
    for i in range(len(places) - 1, -1, -1):
        piece = ""
        while True:
            char = digits[-1 - used] if used < len(digits) else {"0": "0", "?": " ", "#": ""}[places[i]] if not piece else ""
            if char == "":
                break
            if grouped and used and used % 3 == 0 and char != " ":
                piece = "," + piece
            piece, used = char + piece, used + 1
            if i:
                break
        out.append(piece)
    return out[::-1]


def _number(x: float, tokens: list[tuple[str, str]]) -> str:
    digits = [(k, t) for k, t in tokens if k in ("digit", "exp")]
    exp_at = next((i for i, (k, _) in enumerate(digits) if k == "exp"), len(digits))
    mantissa = "".join(t for _, t in digits[:exp_at])
    whole, _, decimals = mantissa.partition(".")
    scale = len(whole) - len(whole.rstrip(","))
    if "." not in mantissa:
        scale = len(mantissa) - len(mantissa.rstrip(","))
    grouped = "," in whole.rstrip(",").lstrip(",")
    int_places, dec_places = whole.replace(",", ""), decimals.replace(",", "")
    percent = sum(k == "percent" for k, _ in tokens)
    value = Decimal(repr(abs(x))) * (Decimal(100) ** percent) / (Decimal(1000) ** scale)
    exponent = 0
    if exp_at < len(digits) and value:
        n = max(1, len(int_places))
        exponent = value.adjusted()
        exponent -= exponent % n if n > 1 else 0
        value = value.scaleb(-exponent)
    value = value.quantize(Decimal(1).scaleb(-len(dec_places)), ROUND_HALF_UP)
    if exp_at < len(digits) and len(int_places) <= 1 and value >= 10:
        exponent, value = exponent + 1, (value / 10).quantize(Decimal(1).scaleb(-len(dec_places)), ROUND_HALF_UP)
    left, _, right = f"{value:f}".partition(".")
    places = _fill("" if left.strip("0") == "" else left, int_places, grouped)
    keep = len(right)
    while keep and right[keep - 1] == "0" and dec_places[keep - 1] == "#":
        keep -= 1
    exp_places = "".join(t for k, t in digits[exp_at + 1 :])
    out, i, d, seen_dot, in_exp = [], 0, 0, False, False
    if not int_places and left.strip("0"):
        out.append(left)
    for k, t in tokens:
        if k == "exp":
            in_exp = True
            out.append("E" + ("-" if exponent < 0 else "+" if t[1] == "+" else "") + str(abs(exponent)).zfill(len(exp_places)))
        elif k == "digit" and not in_exp:
            if t == ".":
                seen_dot = True
                out.append(".")
            elif t == ",":
                continue
            elif not seen_dot:
                out.append(places[i])
                i += 1
            else:
                out.append(right[d] if d < keep else " " if t == "?" else "")
                d += 1
        elif k in ("lit", "percent"):
            out.append(t)
    return "".join(out)


def _date(x: float, tokens: list[tuple[str, str]], date1904: bool) -> str:
    if x < 0:
        return "#####"
    fine = max((len(t) - t.index(".") - 1 for k, t in tokens if k == "date" and "." in t), default=0)
    ticks = int((Decimal(repr(x)) * 86400 * 10**fine).quantize(Decimal(1), ROUND_HALF_UP))
    seconds, part = divmod(ticks, 10**fine)
    day, rest = divmod(seconds, 86400)
    hour, minute, second = rest // 3600, rest // 60 % 60, rest % 60
    if date1904:
        at = datetime.date(1904, 1, 1) + datetime.timedelta(day)
        year, month, dom, weekday = at.year, at.month, at.day, at.isoweekday() % 7
    elif day == 60:
        year, month, dom, weekday = 1900, 2, 29, 3
    elif day == 0:
        year, month, dom, weekday = 1900, 1, 0, 6
    else:
        at = datetime.date(1899, 12, 31 if day < 60 else 30) + datetime.timedelta(day)
        year, month, dom, weekday = at.year, at.month, at.day, (day - 1) % 7
    half = any(k == "ampm" for k, _ in tokens)
    timed = [t if k in ("date", "elapsed") else "" for k, t in tokens]
    timed_at = [i for i, t in enumerate(timed) if t]
    out = []
    for i, (k, t) in enumerate(tokens):
        if k == "elapsed":
            n = {"h": seconds // 3600, "m": seconds // 60, "s": seconds}[t[0]]
            out.append(str(n).zfill(len(t)))
        elif k == "ampm":
            out.append(t.split("/")[hour >= 12])
        elif k == "date":
            n = len(t)
            place = timed_at.index(i)
            before = timed[timed_at[place - 1]] if place else ""
            after = timed[timed_at[place + 1]] if place + 1 < len(timed_at) else ""
            if t[0] == "m" and n <= 2 and (before[:1] == "h" or after[:1] == "s"):
                out.append(str(minute).zfill(n))
            elif t[0] == "m":
                out.append(str(month).zfill(n) if n <= 2 else MONTHS[month - 1][:3] if n == 3 else MONTHS[month - 1][0] if n == 5 else MONTHS[month - 1])
            elif t[0] == "y":
                out.append(f"{year % 100:02d}" if n <= 2 else f"{year:04d}")
            elif t[0] == "d":
                out.append(str(dom).zfill(n) if n <= 2 else DAYS[weekday][:3] if n == 3 else DAYS[weekday])
            elif t[0] == "h":
                out.append(str((hour - 1) % 12 + 1 if half else hour).zfill(min(n, 2)))
            else:
                width, _, zeros = t.partition(".")
                out.append(str(second).zfill(min(len(width), 2)) + (f".{part:0{fine}d}"[: len(zeros) + 1] if zeros else ""))
        elif k in ("lit", "digit"):
            out.append(t)
    return "".join(out)


_PLAIN = re.compile(r"(#,#*0|#*0)(?:\.(0+))?")


@lru_cache(maxsize=4096)
def _plain(code: str) -> tuple[Decimal, Decimal, str, str, str] | None:
    """(factor, step, format, text before, text after) of a code with one section of digits and texts alone, whose digits all show."""
    sections = parse(code)
    kinds = [k for k, _ in sections[0]]
    if len(sections) > 1 or not {"digit"} <= set(kinds) <= {"digit", "lit", "percent"}:
        return None
    first, last = kinds.index("digit"), len(kinds) - kinds[::-1].index("digit")
    m = _PLAIN.fullmatch("".join(t for _, t in sections[0][first:last]))
    if not m or set(kinds[first:last]) != {"digit"} or ("," in m[1] and m[1] != "#,##0"):
        return None
    text = lambda tokens: "".join(t for _, t in tokens)
    return Decimal(100) ** kinds.count("percent"), Decimal(1).scaleb(-len(m[2] or "")), ",f" if "," in m[1] else "f", text(sections[0][:first]), text(sections[0][last:])


@lru_cache(maxsize=50_000)
def _date_text(x: float, code: str, section: int, date1904: bool) -> str:
    return _date(x, parse(code)[section], date1904)


def render(x: float, code: str, date1904: bool = False) -> str:
    """Text of a number under a format code."""
    code = code or "General"
    if math.isnan(x) or math.isinf(x):
        return "#NUM!"
    if (plain := _plain(code)) is not None and abs(x) < 1e15:
        factor, step, form, before, after = plain
        body = before + format((Decimal(repr(abs(x))) * factor).quantize(step, ROUND_HALF_UP), form) + after
        return "-" + body if x < 0 and re.search("[1-9]", body) else body
    sections = parse(code)
    if x < 0 and len(sections) > 1:
        tokens, sign = sections[1], ""
    elif x == 0 and len(sections) > 2:
        tokens, sign = sections[2], ""
    else:
        tokens, sign = sections[0], "-" if x < 0 else ""
    if any(k == "general" for k, _ in tokens):
        return sign + "".join(general(abs(x)) if k == "general" else t for k, t in tokens if k in ("general", "lit"))
    if any(k in ("date", "elapsed") for k, _ in tokens):
        return _date_text(x, code, next(k for k, s in enumerate(sections) if s is tokens), date1904)
    if not any(k == "digit" for k, _ in tokens):
        return (sign if tokens else "") + "".join(t for k, t in tokens if k in ("lit", "percent"))
    body = _number(x, tokens)
    return sign + body if sign and re.search("[1-9]", body) else body


@F.pandas_udf(StringType())
def _rendered(num: pd.Series, code: pd.Series, date1904: pd.Series) -> pd.Series:
    return pd.Series([render(float(x), c, bool(d)) if pd.notna(x) else None for x, c, d in zip(num, code, date1904)], dtype=object)


def format_number(num: Column, code: Column, date1904: Column | bool = False) -> Column:
    """Text of a number under any code (a string column); null numbers stay null.  ``date1904``: the date system, per row or for all."""
    system = date1904 if isinstance(date1904, Column) else F.lit(date1904)
    return _rendered(num.cast("double"), F.coalesce(code, F.lit("General")), F.coalesce(system, F.lit(False)))


def display_text(kind: Column, num: Column, txt: Column, formula: Column, code: Column, edit: Column | None = None, date1904: Column | bool = False) -> Column:
    """struct(shown, align) of a cell.

    An edited text is shown as it was written.  An empty cell shows nothing,
    with a formula too; numbers go through their format, truth values are TRUE
    or FALSE, texts and errors are themselves.  Numbers stand right, truth
    values and errors in the middle, the rest left.
    """
    edited = edit if edit is not None else F.lit(None).cast("string")
    shown = F.when(kind == "number", format_number(num, code, date1904)).when(kind == "bool", F.when(num != 0, "TRUE").otherwise("FALSE")).when(kind.isin("text", "error", "shared"), F.coalesce(txt, F.lit(""))).otherwise(F.when(formula.isNotNull(), "").otherwise(""))
    align = F.when(edited.isNotNull(), "left").when(kind == "number", "right").when(kind.isin("bool", "error"), "center").otherwise("left")
    return F.struct(F.coalesce(edited, shown).alias("shown"), align.alias("align"))
