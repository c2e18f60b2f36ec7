"""The style tables of workbooks: cell formats over base formats over fonts, fills and borders, and differential formats."""

from __future__ import annotations

import io
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.number_format import builtin_code
from quire.sources.packages import attributes, child, local, number, read_xml, toggle, value

SIDES = ("left", "right", "top", "bottom")
#: Parts of a format and the flags that turn them off.
PARTS = {"num_fmt_id": "apply_num_fmt", "font_id": "apply_font", "fill_id": "apply_fill", "border_id": "apply_border"}
FONT = ("bold", "italic", "underline", "strike", "font_color")
LOOK = (*FONT, "fill", *(f"border_{s}" for s in SIDES))
_SCHEMA = (
    "section string, idx long, base_id long, num_fmt_id long, font_id long, fill_id long, border_id long, apply_num_fmt boolean, apply_font boolean, apply_fill boolean, apply_border boolean, align string, code string, "
    "bold boolean, italic boolean, underline boolean, strike boolean, font_color string, fill string, border_left string, border_right string, border_top string, border_bottom string"
)
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]


def _color(node: ElementTree.Element | None) -> str | None:
    """RRGGBB, or theme:N, indexed:N as they stand."""
    if node is None:
        return None
    a = attributes(node)
    if a.get("rgb"):
        return a["rgb"][-6:].upper()
    return next((f"{k}:{a[k]}" for k in ("theme", "indexed") if k in a), None)


def _font(node: ElementTree.Element | None) -> dict:
    if node is None:
        return {}
    line = value(node, "u") or ("single" if child(node, "u") is not None else None)
    return {"bold": toggle(node, "b"), "italic": toggle(node, "i"), "underline": None if line is None else line != "none", "strike": toggle(node, "strike"), "font_color": _color(child(node, "color"))}


def _fill(node: ElementTree.Element | None, differential: bool = False) -> dict:
    """A solid fill shows its foreground; that of a differential format, which may name no pattern, its background."""
    pattern = child(node, "patternFill") if node is not None else None
    if pattern is None or attributes(pattern).get("patternType", "solid" if differential else "none") == "none":
        return {}
    shown = [_color(child(pattern, c)) for c in (("bgColor", "fgColor") if differential else ("fgColor", "bgColor"))]
    return {"fill": shown[0] or shown[1]}


def _border(node: ElementTree.Element | None) -> dict:
    sides = {s: child(node, s) for s in SIDES} if node is not None else {}
    return {f"border_{s}": f"{attributes(n)['style']} {_color(child(n, 'color')) or ''}".strip() for s, n in sides.items() if n is not None and attributes(n).get("style", "none") != "none"}


def _flag(text: str | None) -> bool | None:
    return None if text is None else text in ("1", "true")


def _format(node: ElementTree.Element) -> dict:
    a = attributes(node)
    ids = {"base_id": "xfId", "num_fmt_id": "numFmtId", "font_id": "fontId", "fill_id": "fillId", "border_id": "borderId"}
    flags = {"apply_num_fmt": "applyNumberFormat", "apply_font": "applyFont", "apply_fill": "applyFill", "apply_border": "applyBorder"}
    return {**{k: number(a.get(v)) or 0 for k, v in ids.items()}, **{k: _flag(a.get(v)) for k, v in flags.items()}, "align": value(node, "alignment", attribute="horizontal")}


def read_style_tables(parts: DataFrame) -> DataFrame:
    """book, section, idx and the columns of that section: xf, base, font, fill, border, dxf (differential) and code (number formats)."""

    def walk(name: str, stream: io.BytesIO) -> Iterator[tuple]:
        root = ElementTree.parse(stream).getroot()
        lists = {local(n.tag): list(n) for n in root}
        row = lambda section, idx, held: tuple({"section": section, "idx": idx, **held}.get(c) for c in _NAMES)
        for section, key, read in (("xf", "cellXfs", _format), ("base", "cellStyleXfs", _format), ("font", "fonts", _font), ("fill", "fills", _fill), ("border", "borders", _border)):
            for k, node in enumerate(lists.get(key, ())):
                yield row(section, k, read(node))
        for k, node in enumerate(lists.get("dxfs", ())):
            own = {"code": value(node, "numFmt", attribute="formatCode")}
            yield row("dxf", k, {**own, **_font(child(node, "font")), **_fill(child(node, "fill"), True), **_border(child(node, "border"))})
        for node in lists.get("numFmts", ()):
            a = attributes(node)
            if number(a.get("numFmtId")) is not None:
                yield row("code", number(a.get("numFmtId")), {"code": a.get("formatCode")})

    return read_xml(parts, r"^xl/styles\.xml$", _SCHEMA, walk).drop("part").withColumnRenamed("path", "book")


def cell_styles(tables: DataFrame) -> DataFrame:
    """book, style, num_fmt (a code), align and the columns of ``LOOK``: every cell format with what it shows.

    A part whose apply flag is explicitly false comes from the base format.  A
    code is the workbook's own, else the built-in one of its id, else General;
    an id that no list holds shows nothing.
    """
    section = lambda name: tables.where(F.col("section") == name)
    base = section("base").select("book", F.col("idx").alias("base_id"), *[F.col(p).alias(f"_{p}") for p in PARTS])
    xf = section("xf").select("book", F.col("idx").alias("style"), "base_id", "align", *PARTS, *PARTS.values()).join(base, ["book", "base_id"], "left")
    xf = xf.withColumns({p: F.when(F.col(flag) == F.lit(False), F.coalesce(f"_{p}", p)).otherwise(F.col(p)) for p, flag in PARTS.items()}).select("book", "style", "align", *PARTS)
    # The first of the formats that share an id.
    codes = section("code").groupBy("book", F.col("idx").alias("num_fmt_id")).agg(F.first("code").alias("code"))
    held = {"font": FONT, "fill": ("fill",), "border": tuple(f"border_{s}" for s in SIDES)}
    for name, columns in held.items():
        xf = xf.join(section(name).select("book", F.col("idx").alias(f"{name}_id"), *columns), ["book", f"{name}_id"], "left")
    xf = xf.join(codes, ["book", "num_fmt_id"], "left")
    return xf.select("book", "style", F.coalesce("code", builtin_code(F.col("num_fmt_id")), F.lit("General")).alias("num_fmt"), "align", *LOOK)


def differential_styles(tables: DataFrame) -> DataFrame:
    """book, style (dxfId), num_fmt and the columns of ``LOOK`` that it sets, null where it leaves a cell as it is."""
    return tables.where("section = 'dxf'").select("book", F.col("idx").alias("style"), F.col("code").alias("num_fmt"), *LOOK)
