"""One way to read packages of any kind: canonical tables by name, all of one schema per name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources import decks, opendocument, packages, repeats, texts, workbooks


def _sheets(parts: DataFrame) -> dict[str, DataFrame]:
    names = workbooks.read_sheets(parts)
    cells = workbooks.read_book_cells(parts)
    ods = opendocument.read_ods_rows(parts)
    other = repeats.expand_repeats(ods).select("book", "sheet", "row", "col", F.lit(None).cast("string").alias("vtype"), F.coalesce(F.col("num").cast("string"), "txt").alias("raw"), "formula", F.lit(None).cast("long").alias("style"), "txt")
    return {"sheets": names, "cells": cells.select(*other.columns).unionByName(other), "merges": workbooks.read_merges(parts, names), "dims": workbooks.read_dims(parts, names), "links": workbooks.read_hyperlinks(parts, names), "rules": workbooks.read_rules(parts, names), "comments": workbooks.read_comments(parts, names)}


def _documents(parts: DataFrame) -> dict[str, DataFrame]:
    return {"blocks": texts.read_blocks(parts), "runs": texts.read_runs(parts), "table_cells": texts.read_table_cells(parts), "styles": texts.read_styles(parts), "num_levels": texts.read_num_levels(parts), "notes": texts.read_notes(parts), "metadata": texts.read_metadata(parts)}


def _decks(parts: DataFrame) -> dict[str, DataFrame]:
    slides = decks.read_slides(parts)
    return {"slides": slides, "deck_paragraphs": decks.read_paragraphs(parts, slides), "deck_charts": decks.read_charts(parts), "placeholders": decks.read_placeholders(parts)}


#: Readers by kind of package; each takes checked parts and gives its tables by name.
READERS: dict[str, Callable[[DataFrame], dict[str, DataFrame]]] = {"sheet": _sheets, "document": _documents, "deck": _decks}


def read_packages(files: DataFrame, kinds: tuple[str, ...] = tuple(READERS)) -> dict[str, DataFrame]:
    """Tables of all files (path, content) by name, for the given kinds, and ``warnings`` of all of them."""
    parts = packages.check_parts(packages.parts_of(files))
    out = {"warnings": packages.xml_warnings(parts)}
    for kind in kinds:
        out |= READERS[kind](parts)
    return out
