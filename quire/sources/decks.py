"""Slide deck packages as canonical tables: slides, paragraphs, placeholders, charts."""

from __future__ import annotations

import io
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.sources.packages import attributes, child, local, number, read_rels, read_xml, resolve_rels

SLIDES = r"^ppt/slides/[^/]+\.xml$"


def read_slides(parts: DataFrame) -> DataFrame:
    """deck, slide, part in the order of the deck's slide list, whatever the names of parts."""

    def walk(name: str, stream: io.BytesIO) -> Iterator[tuple]:
        listed = child(ElementTree.parse(stream).getroot(), "sldIdLst")
        for k, s in enumerate(listed if listed is not None else ()):
            # the plain id is a number, the one of the relationship has a prefix
            yield k, next((v for n, v in s.attrib.items() if local(n) == "id" and n != "id"), None)

    rows = read_xml(parts, r"^ppt/presentation\.xml$", "slide long, id string", walk)
    refs = rows.select(F.col("path").alias("pkg"), F.col("part").alias("source_part"), "id", "slide")
    return resolve_rels(refs, read_rels(parts)).select(F.col("pkg").alias("deck"), "slide", "part")


def _shapes(node: ElementTree.Element) -> Iterator[ElementTree.Element]:
    for x in node:
        if local(x.tag) == "sp":
            yield x
        elif local(x.tag) in ("grpSp", "spTree", "cSld"):
            yield from _shapes(x)


def _of_slides(rows: DataFrame, slides: DataFrame) -> DataFrame:
    return rows.withColumnRenamed("path", "deck").join(slides, ["deck", "part"]).drop("part")


def read_paragraphs(parts: DataFrame, slides: DataFrame) -> DataFrame:
    """deck, slide, shape, pos, ilvl, bullet (char, auto or null), title, text of the paragraphs of text shapes."""

    def walk(name: str, stream: io.BytesIO) -> Iterator[tuple]:
        pos = 0
        for k, sp in enumerate(_shapes(ElementTree.parse(stream).getroot())):
            ph = child(sp, "nvSpPr", "nvPr", "ph")
            title = ph is not None and attributes(ph).get("type") in ("title", "ctrTitle")
            for p in (x for x in (child(sp, "txBody") if child(sp, "txBody") is not None else ()) if local(x.tag) == "p"):
                pr = child(p, "pPr")
                marks = {local(x.tag) for x in pr} if pr is not None else set()
                text = "".join((x.text or "") if local(x.tag) == "t" else "\n" if local(x.tag) == "br" else "" for x in p.iter())
                yield k, pos, number(attributes(pr).get("lvl")) or 0 if pr is not None else 0, "auto" if "buAutoNum" in marks else "char" if "buChar" in marks else None, title, text
                pos += 1

    return _of_slides(read_xml(parts, SLIDES, "shape long, pos long, ilvl long, bullet string, title boolean, text string", walk), slides)


def read_placeholders(parts: DataFrame) -> DataFrame:
    """deck, part, level (slide, layout or master), shape, idx, type (null where none is given), frame (x,y,cx,cy or null)."""

    def walk(name: str, stream: io.BytesIO) -> Iterator[tuple]:
        for k, sp in enumerate(_shapes(ElementTree.parse(stream).getroot())):
            ph = child(sp, "nvSpPr", "nvPr", "ph")
            if ph is None:
                continue
            off, ext = (child(sp, "spPr", "xfrm", x) for x in ("off", "ext"))
            frame = None
            if off is not None and ext is not None:
                frame = ",".join([*(attributes(off).get(x, "0") for x in ("x", "y")), *(attributes(ext).get(x, "0") for x in ("cx", "cy"))])
            yield k, number(attributes(ph).get("idx")), attributes(ph).get("type"), frame

    rows = read_xml(parts, r"^ppt/(slides|slideLayouts|slideMasters)/[^/]+\.xml$", "shape long, idx long, type string, frame string", walk)
    level = F.when(F.contains("part", F.lit("/slides/")), "slide").when(F.contains("part", F.lit("/slideLayouts/")), "layout").otherwise("master")
    return rows.withColumnRenamed("path", "deck").withColumn("level", level)


def _targets(parts: DataFrame, kind: str) -> DataFrame:
    """pkg, source_part, part: the parts that relationships of a kind lead to."""
    rels = read_rels(parts)
    return resolve_rels(rels.where(F.col("rel_type") == kind).select("pkg", "source_part", "id"), rels).where("part IS NOT NULL").select("pkg", "source_part", "id", "part")


def read_layouts(parts: DataFrame) -> DataFrame:
    """deck, part (of a slide), layout, master: the way from a slide to its layout and on to the layout's master."""
    first = lambda kind: _targets(parts, kind).groupBy("pkg", "source_part").agg(F.min_by("part", "id").alias("part"))
    layout = first("slideLayout").where(F.rlike("source_part", F.lit(SLIDES))).select(F.col("pkg").alias("deck"), F.col("source_part").alias("part"), F.col("part").alias("layout"))
    master = first("slideMaster").select(F.col("pkg").alias("deck"), F.col("source_part").alias("layout"), F.col("part").alias("master"))
    return layout.join(master, ["deck", "layout"], "left").select("deck", "part", "layout", "master")


def charts_of_slides(parts: DataFrame, slides: DataFrame) -> DataFrame:
    """deck, slide and the columns of :func:`read_charts`: charts under the slides that show them."""
    shown = _targets(parts, "chart").select(F.col("pkg").alias("deck"), F.col("source_part").alias("_slide"), "part").distinct()
    where = slides.select("deck", "slide", F.col("part").alias("_slide"))
    return read_charts(parts).join(shown, ["deck", "part"]).join(where, ["deck", "_slide"]).drop("_slide")


def read_charts(parts: DataFrame) -> DataFrame:
    """deck, part, kind, series_ord, series, idx, category, value of the charts of a deck.

    A series without name is ``Series N``; a point without category has its
    number from 1; values that are no numbers are left out.
    """

    def points(node: ElementTree.Element | None) -> dict[int, str]:
        out = {}
        for x in node.iter() if node is not None else ():
            if local(x.tag) == "pt":
                v = child(x, "v")
                out[number(attributes(x).get("idx")) or 0] = (v.text or "") if v is not None else ""
        return out

    def walk(name: str, stream: io.BytesIO) -> Iterator[tuple]:
        area = child(ElementTree.parse(stream).getroot(), "chart", "plotArea")
        k = 0
        for plot in area if area is not None else ():
            if not local(plot.tag).endswith("Chart"):
                continue
            for ser in (x for x in plot if local(x.tag) == "ser"):
                title, names = points(child(ser, "tx")), points(child(ser, "cat"))
                values = points(child(ser, "val"))
                for i in sorted(values):
                    yield local(plot.tag).removesuffix("Chart"), k, next(iter(title.values()), None) or f"Series {k + 1}", i, names.get(i) or str(i + 1), values[i]
                k += 1

    rows = read_xml(parts, r"^ppt/charts/chart[^/]*\.xml$", "kind string, series_ord long, series string, idx long, category string, raw string", walk)
    return rows.withColumnRenamed("path", "deck").withColumn("value", F.trim("raw").try_cast("double")).where("value IS NOT NULL").drop("raw")


def slide_names(paragraphs: DataFrame) -> DataFrame:
    """deck, slide, name: the first title of a slide that is not blank, else ``Slide N``; slides without text are not listed."""
    w = W.partitionBy("deck", "slide").orderBy("pos")
    named = paragraphs.where("title AND trim(text) != ''").withColumn("_k", F.row_number().over(w)).where("_k = 1").select("deck", "slide", F.col("text").alias("_n"))
    return paragraphs.select("deck", "slide").distinct().join(named, ["deck", "slide"], "left").select("deck", "slide", F.coalesce("_n", F.concat(F.lit("Slide "), (F.col("slide") + 1).cast("string"))).alias("name"))
