"""Open document spreadsheets as rows with repeat counts, for :func:`quire.sources.repeats.expand_repeats`."""

from __future__ import annotations

import io
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.scalars import clock_to_fraction, duration_to_fraction, iso_to_serial
from quire.sources.packages import attributes, local, number, read_xml


def _text(cell: ElementTree.Element) -> str:
    """Paragraphs of a cell, line by line; runs of spaces, tabs and breaks are elements of their own."""

    def inside(node: ElementTree.Element) -> str:
        out = node.text or ""
        for x in node:
            tag = local(x.tag)
            out += " " * (number(attributes(x).get("c")) or 1) if tag == "s" else "\t" if tag == "tab" else "\n" if tag == "line-break" else "" if tag == "annotation" else inside(x)
            out += x.tail or ""
        return out

    return "\n".join(inside(p) for p in cell if local(p.tag) == "p")


def read_ods_rows(parts: DataFrame) -> DataFrame:
    """book, sheet, row_ord, row_repeat, cell_ord, col_repeat, kind, num, txt, formula, row_span, col_span.

    A covered cell takes its columns without a value.  Dates, times and
    durations are serial numbers.
    """

    def walk(name: str, stream: io.BytesIO) -> Iterator[tuple]:
        sheet, row, repeat = None, -1, 1
        cells: list[tuple] = []
        for event, node in ElementTree.iterparse(stream, events=("start", "end")):
            tag, a = local(node.tag), attributes(node)
            if event == "start" and tag == "table":
                sheet, row = a.get("name"), -1
            elif event == "start" and tag == "table-row":
                row, repeat, cells = row + 1, number(a.get("number-rows-repeated")) or 1, []
            elif event == "end" and tag in ("table-cell", "covered-table-cell"):
                times = number(a.get("number-columns-repeated")) or 1
                if tag == "covered-table-cell":
                    cells.append((times, None, None, None, None, 1, 1))
                else:
                    kind = a.get("value-type")
                    raw = a.get("value") or a.get("date-value") or a.get("time-value") or a.get("boolean-value") or a.get("string-value")
                    text = _text(node)
                    cells.append((times, kind, raw, text if kind == "string" or kind is None and text else None, a.get("formula"), number(a.get("number-rows-spanned")) or 1, number(a.get("number-columns-spanned")) or 1))
            elif event == "end" and tag == "table-row":
                for k, c in enumerate(cells or [(1, None, None, None, None, 1, 1)]):
                    yield sheet, row, repeat, k, *c
                node.clear()

    schema = "sheet string, row_ord long, row_repeat long, cell_ord long, col_repeat long, kind string, raw string, text string, formula string, row_span long, col_span long"
    rows = read_xml(parts, r"^content\.xml$", schema, walk)
    k = F.col("kind")
    num = F.when(k.isin("float", "currency", "percentage"), F.col("raw").try_cast("double")).when(k == "date", iso_to_serial(F.col("raw"))).when(k == "time", F.coalesce(duration_to_fraction(F.col("raw")), clock_to_fraction(F.col("raw")))).when(k == "boolean", F.when(F.col("raw") == "true", 1.0).otherwise(0.0))
    txt = F.when(k == "string", F.coalesce("raw", "text")).when(num.isNull(), F.coalesce("text", "raw"))
    kind = F.when(k == "boolean", "bool").when(num.isNotNull(), "number").when(F.length(txt) > 0, "text")
    return rows.select(F.col("path").alias("book"), "sheet", "row_ord", "row_repeat", "cell_ord", "col_repeat", kind.alias("kind"), num.alias("num"), txt.alias("txt"), "formula", "row_span", "col_span")
