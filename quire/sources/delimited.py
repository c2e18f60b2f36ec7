"""Delimited text as rows and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sniff_separator(spark: SparkSession, path: str) -> str:
    """``;`` if the first line has more of them than commas, else ``,``."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    return ";" if line.count(";") > line.count(",") else ","


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, drop_blank: bool = True) -> DataFrame:
    """Quoted text with doubled quotes and line breaks inside quotes, as string columns; blank rows go if asked."""
    sep = {"tab": "\t", r"\t": "\t"}.get(sep, sep) if sep else sniff_separator(spark, path)
    rows = spark.read.csv(path, sep=sep, quote='"', escape='"', multiLine=True, header=False, inferSchema=False)
    if drop_blank and rows.columns:
        rows = rows.where(F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in rows.columns]).isNotNull())
    return rows


def _files(spark: SparkSession, path: str, sep: str | None) -> DataFrame:
    """path, row, col, raw, fault of each file under ``path``; a fault is the file's only row."""
    sep = {"tab": "\t", r"\t": "\t"}.get(sep, sep) if sep else None
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    columns, end = ["path", "row", "col", "raw", "fault"], "\0end"

    def run(frames):
        import csv
        import io
        from collections import deque
        from itertools import pairwise

        import pandas as pd

        csv.field_size_limit(2**31 - 1)

        def rows_of(text: str):
            first = text.split("\n", 1)[0]
            own = sep or (";" if first.count(";") > first.count(",") else ",")
            # Behind the last line stands one more, which an open quote would swallow.
            return csv.reader(io.StringIO(f"{text}\n{end}" if text[-1:] not in ("\n", "\r") else text + end, newline=""), delimiter=own)

        for frame in frames:
            for name, text in zip(frame["path"], frame["value"]):
                try:
                    closed = deque(rows_of(text), maxlen=1)[0] == [end]
                    fault = None if closed else "unclosed quote"
                except csv.Error as e:
                    fault = str(e)
                cells = [(name, None, None, None, fault)] if fault else []
                for r, (row, after) in enumerate(pairwise(rows_of(text)) if not fault else ()):
                    if after == [end] and not any(x.strip() for x in row):
                        break  # a blank last row
                    cells += [(name, r, c, x, None) for c, x in enumerate(row)]
                    if len(cells) > _AT_ONCE:
                        yield pd.DataFrame(cells, columns=columns).astype(object)
                        cells = []
                yield pd.DataFrame(cells, columns=columns).astype(object)

    return files.mapInPandas(run, "path string, row long, col long, raw string, fault string")


#: Cells handed over at once.
_AT_ONCE = 50_000


def delimited_cells(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """path, row, col, raw: each delimited file under ``path`` as the cells of a sheet; only a blank last row goes.

    Rows end at line feeds, carriage returns or both; a quote opens a field only
    at its start.  A file is one table, read as a whole by one task, as its rows
    are known only from its start.  A file with a fault gives no cells:
    :func:`delimited_faults` lists it.
    """
    return _files(spark, path, sep).where("fault IS NULL").drop("fault")


def delimited_faults(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """path, fault of the files under ``path`` that end inside quotes or cannot be read."""
    return _files(spark, path, sep).where("fault IS NOT NULL").select("path", "fault")


def header_records(rows: DataFrame, fields: str = "fields", order: str = "line") -> DataFrame:
    """Rows with an array of fields as columns named by the first row (least ``order``).

    Names are trimmed, a blank one is ``ColumnN``; missing fields are empty.
    """
    head = rows.orderBy(order).select(fields, order).first()
    if head is None:
        return rows
    names = [(n or "").strip() or f"Column{i + 1}" for i, n in enumerate(head[0])]
    body = rows.where(F.col(order) != head[1])
    return body.select(*[c for c in rows.columns if c not in (fields, order)], *[F.trim(F.coalesce(F.get(fields, F.lit(i)), F.lit(""))).alias(n) for i, n in enumerate(names)])
