"""Spreadsheet packages as canonical tables: sheets, cells, strings, merges, dimensions, links, rules, comments, names."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from xml.etree import ElementTree
from xml.parsers import expat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.packages import ROWS, Columns, attributes, child, local, names_of, number, read_rels, read_xml, real, relations, resolve_rels, target_part

SHEETS = r"^xl/worksheets/[^/]+\.xml$"
_PLACE = re.compile(r"^\$?([A-Za-z]{1,3})\$?([1-9][0-9]{0,6})$")


def _at(text: str | None) -> tuple[int, int] | None:
    m = _PLACE.match(text or "")
    if not m:
        return None
    return int(m[2]) - 1, _column(m[1])


@lru_cache(maxsize=20_000)
def _column(letters: str) -> int:
    col = 0
    for c in letters.upper():
        col = col * 26 + ord(c) - 64
    return col - 1


def _box(text: str) -> tuple[int, int, int, int] | None:
    a, _, b = text.partition(":")
    p, q = _at(a), _at(b or a)
    return (min(p[0], q[0]), min(p[1], q[1]), max(p[0], q[0]), max(p[1], q[1])) if p and q else None


def _catalogue(stream: io.BytesIO) -> Iterator[tuple]:
    """Place, name, state, relationship and date1904 of the sheets of a workbook."""
    root = ElementTree.parse(stream).getroot()
    pr = child(root, "workbookPr")
    old = pr is not None and attributes(pr).get("date1904", "0") in ("1", "true")
    for i, s in enumerate(child(root, "sheets") if child(root, "sheets") is not None else ()):
        a = attributes(s)
        yield i, a.get("name"), a.get("state", "visible"), a.get("id"), old


def read_sheets(parts: DataFrame) -> DataFrame:
    """book, sheet_ord, sheet, state, part, date1904: the catalogue of each workbook, in its order; state is visible, hidden or veryHidden."""

    def walk(name: str, stream: io.BytesIO) -> Iterator[tuple]:
        return _catalogue(stream)

    found = read_xml(parts, r"^xl/workbook\.xml$", "sheet_ord long, sheet string, state string, id string, date1904 boolean", walk)
    refs = found.select(F.col("path").alias("pkg"), F.col("part").alias("source_part"), "id", "sheet_ord", "sheet", "state", "date1904")
    return resolve_rels(refs, read_rels(parts)).select(F.col("pkg").alias("book"), "sheet_ord", "sheet", "state", "part", "date1904")


def read_defined_names(parts: DataFrame) -> DataFrame:
    """book, name, refers_to."""

    def walk(name: str, stream: io.BytesIO) -> Iterator[tuple]:
        for _, node in ElementTree.iterparse(stream):
            if local(node.tag) == "definedName":
                yield attributes(node).get("name"), node.text or ""

    return read_xml(parts, r"^xl/workbook\.xml$", "name string, refers_to string", walk).select(F.col("path").alias("book"), "name", "refers_to")


def _of_sheets(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """Rows of worksheet parts under the names of their sheets; parts that no workbook lists are nobody's."""
    return rows.withColumnRenamed("path", "book").join(sheets.select("book", "part", "sheet"), ["book", "part"]).drop("part")


#: Bytes of a sheet that are parsed before its cells are handed over.
_CHUNK = 1 << 16


class _Cells:
    """Cells of a worksheet from the events of its parser, without a tree of its nodes."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.row = self.col = -1
        self.depth = self.inline = 0  # inline: the depth of the open inline string
        self.cell: list | None = None  # depth, attributes, texts of v, f and is
        self.outer: list[list] = []
        self.text: list[str] | None = None  # where the text of the open node goes
        self.names: dict[str, str] = {}

    def start(self, tag: str, attrib: dict[str, str]) -> None:
        self.depth += 1
        self.text = None
        name = self.names.get(tag) or self.names.setdefault(tag, local(tag))
        if name == "c":
            if self.cell is not None:
                self.outer.append(self.cell)
            self.cell = [self.depth, attrib, None, None, None]
        elif name == "row":
            self.row, self.col = (number(_local(attrib).get("r")) or self.row + 2) - 1, -1
        elif self.cell is not None:
            if self.depth == self.cell[0] + 1:
                k = {"v": 2, "f": 3, "is": 4}.get(name)
                if k and self.cell[k] is None:
                    self.cell[k] = found = []
                    if k == 4:
                        self.inline = self.depth
                    else:
                        self.text = found
            elif name == "t" and self.inline:
                self.text = self.cell[4]

    def data(self, text: str) -> None:
        if self.text is not None:
            self.text.append(text)

    def end(self, tag: str) -> None:
        self.text = None
        if self.cell is not None:
            if self.depth == self.cell[0]:
                _, attrib, v, f, inline = self.cell
                a = _local(attrib)
                self.row, self.col = _at(a.get("r")) or (self.row, self.col + 1)
                s = a.get("s")
                raw = "".join(inline) if inline is not None else "".join(v) or None if v is not None else None
                style = int(s) if s is not None and len(s) < 18 and s.isascii() and s.isdigit() else number(s)
                self.rows.append((self.row, self.col, a.get("t", "n"), raw, "".join(f) or None if f is not None else None, style))
                self.cell = self.outer.pop() if self.outer else None
            elif self.depth == self.inline:
                self.inline = 0
        self.depth -= 1

    def close(self) -> None:
        pass


def _local(attrib: dict[str, str]) -> dict[str, str]:
    """Attributes by local name."""
    return {local(k): v for k, v in attrib.items()} if any("}" in k for k in attrib) else attrib


# Sheets as most programs write them: no prefixes, values without quotes, texts without carriage returns.
_ATTRIBUTES = r"""(?>\s++(?!\w++:[rst]=)(?:\w++:)?+\w++=(?:"[^"'<&\t\n\r]*+"|'[^"'<&\t\n\r]*+'))*+"""
_TEXT = r"[^<\r]*+"
_CELL = rf"<c({_ATTRIBUTES})(?:/>|>(?:<f{_ATTRIBUTES}(?:/>|>({_TEXT})</f>))?+(?:<v/>|<v>({_TEXT})</v>|(<is>)<t{_ATTRIBUTES}>({_TEXT})</t></is>)?+</c>)"
_ROW = rf"<row({_ATTRIBUTES})(/?)>"
_ROWS = re.compile(rf"(?>\s*+{_ROW}(?:(?<=/>)|(?>\s*+{_CELL})*+\s*+</row>))*+\s*+")
# The same, with what most cells say first, for rows that are known to fit.
_STEP = re.compile(
    rf"""<(?:row({_ATTRIBUTES})|(c)(?: r=["']([A-Z]{{1,3}})([1-9][0-9]{{0,6}})["'])?(?: s=["']([0-9]{{1,17}})["'])?(?: t=["']([a-zA-Z]+)["'])?({_ATTRIBUTES})"""
    rf"(?:/>|>(?:<f{_ATTRIBUTES}(?:/>|>({_TEXT})</f>))?(?:<v>({_TEXT})</v>|(<is>)<t{_ATTRIBUTES}>({_TEXT})</t>)?))"
)
_ATTRIBUTE = re.compile(r"""(\w+)=["']([^"']*)""")
_OTHER_CELL = re.compile(r"[<:](c|row)[\s/>]")
_DECLARED = re.compile(rb"""\s*<\?xml version=["']1\.0["'](?: encoding=["'][Uu][Tt][Ff]-8["'])?(?: standalone=["']\w+["'])?\s*\?>""")
_ESCAPE = re.compile("&(#?)(x?)(\\w+);")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def _unescaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[3], 16 if m[2] else 10)) if m[1] else _NAMED[m[2] + m[3]], text) if "&" in text else text


def _plain(content: bytes) -> tuple[str, int, int] | None:
    """A sheet as text and where its rows begin and end, if they are written as :data:`_ROWS` has it and the part has no fault, else none."""
    declared = _DECLARED.match(content)
    start = declared.end() if declared else 0
    if content.find(b"<!") >= 0 or content.find(b"<?", start) >= 0:
        return None
    try:
        expat.ParserCreate(namespace_separator="}").Parse(content, True)
        text = content.decode("utf-8")
    except (expat.ExpatError, UnicodeDecodeError):
        return None
    begin, end = text.find("<sheetData>") + len("<sheetData>"), text.rfind("</sheetData>")
    if begin < len("<sheetData>") or end < begin or _OTHER_CELL.search(text, 0, begin) or _OTHER_CELL.search(text, end) or not _ROWS.fullmatch(text, begin, end):
        return None
    return text, begin, end


def _plain_cells(text: str, begin: int, end: int) -> Iterator[Columns]:
    """What :class:`_Cells` finds in rows that :func:`_plain` let through, many cells at once."""
    row = col = -1
    steps = _STEP.finditer(text, begin, end)
    while some := list(islice(steps, ROWS)):
        rows, cols, types, raws, formulas, styles = [], [], [], [], [], []
        for step in some:
            of_row, cell, letters, digits, style, vtype, others, f, v, inline, t = step.groups()
            if cell is None:
                row, col = (number(dict(_ATTRIBUTE.findall(of_row)).get("r")) or row + 2) - 1, -1
                continue
            at = None
            if others:
                a = dict(_ATTRIBUTE.findall(others))
                at, vtype = _at(a.get("r")), vtype or a.get("t")
                if style is None:
                    style = number(a.get("s"))
            if letters is not None:
                row, col = int(digits) - 1, _column(letters)
            else:
                row, col = at or (row, col + 1)
            rows.append(row)
            cols.append(col)
            types.append("n" if vtype is None else vtype)
            raws.append(_unescaped(t) if inline else _unescaped(v) if v else None)
            formulas.append(_unescaped(f) if f else None)
            styles.append(style if style is None else int(style))
        if rows:
            yield Columns(len(rows), rows, cols, types, raws, formulas, styles)


def _cells_of(stream: io.BytesIO) -> Iterator[Columns]:
    """row, col, vtype, raw, formula, style of a worksheet; those before a fault come before it is raised."""
    plain = _plain(stream.getvalue())
    if plain is not None:
        yield from _plain_cells(*plain)
        return
    target = _Cells()
    parser = ElementTree.XMLParser(target=target)
    fault = None
    while fault is None:
        some = stream.read(_CHUNK)
        try:
            parser.feed(some) if some else parser.close()
        except ElementTree.ParseError as e:
            fault = e
        if target.rows:  # cells before a fault stand
            yield Columns(len(target.rows), *map(list, zip(*target.rows)))
        target.rows.clear()
        if not some:
            break
    if fault is not None:
        raise fault


def read_cells(parts: DataFrame, sheets: DataFrame) -> DataFrame:
    """book, sheet, row, col, vtype, raw, formula, style of stored cells; a cell without address stands after the one before it."""

    def walk(name: str, stream: io.BytesIO) -> Iterator[tuple]:
        return _cells_of(stream)

    rows = read_xml(parts, SHEETS, "row long, col long, vtype string, raw string, formula string, style long", walk)
    return _of_sheets(rows, sheets)


def _shared(stream: io.BytesIO) -> Iterator[tuple]:
    k = 0
    for _, node in ElementTree.iterparse(stream):
        if local(node.tag) == "si":
            texts = [t.text or "" for part in node for t in ([part] if local(part.tag) == "t" else [x for x in part if local(x.tag) == "t"] if local(part.tag) == "r" else [])]
            yield k, "".join(texts)
            k += 1
            node.clear()


def read_shared_strings(parts: DataFrame) -> DataFrame:
    """book, idx, txt; phonetic hints are left out."""

    def walk(name: str, stream: io.BytesIO) -> Iterator[tuple]:
        return _shared(stream)

    return read_xml(parts, r"^xl/sharedStrings\.xml$", "idx long, txt string", walk).select(F.col("path").alias("book"), "idx", "txt")


_BOOK, _BOOK_RELS, _STRINGS = "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/sharedStrings.xml"
_INDEX = re.compile(r"[\x00-\x20]*[+-]?[0-9]{1,18}[\x00-\x20]*")


class _Book:
    """The parts of one workbook in turn: catalogue, relationships and shared strings first, then its worksheets."""

    def __init__(self) -> None:
        self.sheets: list[tuple] = []
        self.rels: list[tuple] = []
        self.texts: dict[int, str] = {}

    def __call__(self, name: str, stream: io.BytesIO) -> Iterator[tuple]:
        # What stands before a fault of a part is kept.
        if name == _BOOK:
            self.sheets += _catalogue(stream)
        elif name == _BOOK_RELS:
            for found in relations(stream):
                self.rels.append(found)
        elif name == _STRINGS:
            for k, text in _shared(stream):
                self.texts[k] = text
        else:
            yield from self.cells(name, stream)

    def cells(self, name: str, stream: io.BytesIO) -> Iterator[tuple]:
        own = [(i, sheet, state, old) for i, sheet, state, rel, old in self.sheets for id, _, target, mode in self.rels if rel is not None and id == rel and target_part(_BOOK, target, mode) == name]
        if not own:
            return  # nobody's
        for cells in _cells_of(stream):
            _, _, types, raws, _, _ = cells.columns
            txt = [self.text(t, raw) for t, raw in zip(types, raws)] if set(types) != {"n"} else None
            for sheet in own:
                yield Columns(cells.n, *sheet, *cells.columns, txt)

    def text(self, vtype: str, raw: str | None) -> str | None:
        if vtype == "s":
            return self.texts.get(int(raw)) if raw and _INDEX.fullmatch(raw) else None
        return raw if vtype in ("str", "inlineStr", "e", "d") else None


def read_book_cells(parts: DataFrame) -> DataFrame:
    """book, sheet_ord, sheet, state, date1904, row, col, vtype, raw, formula, style, txt of stored cells.

    One pass over each package, without a join: what :func:`resolve_strings`
    makes of :func:`read_cells`, under the sheets of :func:`read_sheets`.
    """
    pattern = r"^xl/(workbook\.xml|_rels/workbook\.xml\.rels|sharedStrings\.xml|worksheets/[^/]+\.xml)$"
    schema = "sheet_ord long, sheet string, state string, date1904 boolean, row long, col long, vtype string, raw string, formula string, style long, txt string"
    sheets_last = F.startswith("name", F.lit("xl/worksheets/"))
    return read_xml(parts, pattern, schema, _Book, sheets_last).withColumnRenamed("path", "book").drop("part")


def resolve_strings(cells: DataFrame, shared: DataFrame) -> DataFrame:
    """cells plus txt: the text of shared strings (null out of range), of inline and plain strings, and of errors; none for numbers and truth values."""
    idx = F.when(F.col("vtype") == "s", F.col("raw").try_cast("long"))
    named = cells.withColumn("idx", idx).join(shared, ["book", "idx"], "left").drop("idx")
    return named.withColumn("txt", F.when(F.col("vtype") == "s", F.col("txt")).when(F.col("vtype").isin("str", "inlineStr", "e", "d"), F.col("raw")))


def read_merges(parts: DataFrame, sheets: DataFrame) -> DataFrame:
    """book, sheet, merge, r0, c0, r1, c1 in the order of the file."""

    def walk(name: str, stream: io.BytesIO) -> Iterator[tuple]:
        k = 0
        for _, node in ElementTree.iterparse(stream):
            if local(node.tag) == "mergeCell" and (box := _box(attributes(node).get("ref", ""))):
                yield k, *box
                k += 1
            elif local(node.tag) == "row":
                node.clear()

    return _of_sheets(read_xml(parts, SHEETS, "merge long, r0 long, c0 long, r1 long, c1 long", walk), sheets)


def read_dims(parts: DataFrame, sheets: DataFrame) -> DataFrame:
    """book, sheet, axis (col or row), first, last, size, hidden: declared column widths and row heights."""

    def walk(name: str, stream: io.BytesIO) -> Iterator[tuple]:
        row = -1
        for event, node in ElementTree.iterparse(stream, events=("start", "end")):
            tag, a = local(node.tag), attributes(node)
            if event == "start" and tag == "row":
                row = (number(a.get("r")) or row + 2) - 1
                if "ht" in a or "hidden" in a:
                    yield "row", row, row, real(a.get("ht")), a.get("hidden", "0") in ("1", "true")
            elif event == "end" and tag == "col":
                first, last = number(a.get("min")), number(a.get("max"))
                if first and last:
                    yield "col", first - 1, last - 1, real(a.get("width")), a.get("hidden", "0") in ("1", "true")
            elif event == "end" and tag == "row":
                node.clear()

    return _of_sheets(read_xml(parts, SHEETS, "axis string, first long, last long, size double, hidden boolean", walk), sheets)


def read_hyperlinks(parts: DataFrame, sheets: DataFrame) -> DataFrame:
    """book, sheet, link, r0, c0, r1, c1, target, target_mode, location."""

    def walk(name: str, stream: io.BytesIO) -> Iterator[tuple]:
        k = 0
        for _, node in ElementTree.iterparse(stream):
            a = attributes(node)
            if local(node.tag) == "hyperlink" and (box := _box(a.get("ref", ""))):
                yield k, *box, a.get("id"), a.get("location")
                k += 1
            elif local(node.tag) == "row":
                node.clear()

    rows = read_xml(parts, SHEETS, "link long, r0 long, c0 long, r1 long, c1 long, id string, location string", walk)
    rels = read_rels(parts).select(F.col("pkg").alias("path"), F.col("source_part").alias("part"), "id", "target", "target_mode")
    return _of_sheets(rows.join(rels, ["path", "part", "id"], "left").drop("id"), sheets)


def read_rules(parts: DataFrame, sheets: DataFrame) -> DataFrame:
    """book, sheet, block, rule_ord, ranges, priority, stop_if_true, kind, operator, formulas, thresholds (kind, value, gte), colors, icon_set, reverse, style."""
    fields = (
        "block long, rule_ord long, ranges array<struct<r0:long,c0:long,r1:long,c1:long>>, priority long, stop_if_true boolean, kind string, operator string, formulas array<string>, "
        "thresholds array<struct<kind:string,value:double,gte:boolean>>, colors array<string>, icon_set string, reverse boolean, style long"
    )
    columns = names_of(fields)
    kinds = {"percent": "percent", "percentile": "percentile", "num": "num", "min": "min", "max": "max", "formula": "formula"}

    def rows(stream: io.BytesIO) -> Iterator[dict]:
        block = 0
        for _, node in ElementTree.iterparse(stream):
            if local(node.tag) == "row":
                node.clear()
            if local(node.tag) != "conditionalFormatting":
                continue
            boxes = [dict(zip(("r0", "c0", "r1", "c1"), b)) for b in map(_box, attributes(node).get("sqref", "").split()) if b]
            for k, rule in enumerate(r for r in node if local(r.tag) == "cfRule"):
                a = attributes(rule)
                visual = next((v for v in rule if local(v.tag) in ("colorScale", "dataBar", "iconSet")), None)
                inner = list(visual) if visual is not None else []
                look = attributes(visual) if visual is not None else {}

                def threshold(c: ElementTree.Element) -> dict:
                    t = attributes(c)
                    kind = kinds.get(t.get("type", ""), "formula")
                    return {"kind": kind, "value": None if kind == "formula" else real(t.get("val")), "gte": t.get("gte", "1") in ("1", "true")}

                yield {
                    "block": block, "rule_ord": k, "ranges": boxes, "priority": number(a.get("priority")) or 0, "stop_if_true": a.get("stopIfTrue", "0") in ("1", "true"), "kind": a.get("type"), "operator": a.get("operator"),
                    "formulas": [f.text or "" for f in rule if local(f.tag) == "formula"], "thresholds": [threshold(c) for c in inner if local(c.tag) == "cfvo"], "colors": [attributes(c).get("rgb", "") for c in inner if local(c.tag) == "color"],
                    "icon_set": look.get("iconSet", "3TrafficLights1" if visual is not None and local(visual.tag) == "iconSet" else None), "reverse": look.get("reverse", "0") in ("1", "true"), "style": number(a.get("dxfId")),
                }
            block += 1

    def walk(name: str, stream: io.BytesIO) -> Iterator[tuple]:
        for row in rows(stream):
            yield tuple(row[c] for c in columns)

    return _of_sheets(read_xml(parts, SHEETS, fields, walk), sheets)


def read_comments(parts: DataFrame, sheets: DataFrame) -> DataFrame:
    """book, sheet, row, col, author, text of cell comments; an author out of range is null."""

    def walk(name: str, stream: io.BytesIO) -> Iterator[tuple]:
        root = ElementTree.parse(stream).getroot()
        authors = [x.text or "" for x in (child(root, "authors") if child(root, "authors") is not None else ())]
        for c in child(root, "commentList") if child(root, "commentList") is not None else ():
            a = attributes(c)
            at, by = _at(a.get("ref")), number(a.get("authorId"))
            if at:
                yield *at, authors[by] if by is not None and 0 <= by < len(authors) else None, "".join(t.text or "" for t in c.iter() if local(t.tag) == "t")

    rows = read_xml(parts, r"^xl/comments[^/]*\.xml$", "row long, col long, author string, text string", walk)
    refs = read_rels(parts).where("rel_type = 'comments'").select("pkg", "source_part", "id")
    owner = resolve_rels(refs, read_rels(parts)).select(F.col("pkg").alias("path"), "part", F.col("source_part").alias("_sheet"))
    return _of_sheets(rows.join(owner, ["path", "part"]).drop("part").withColumnRenamed("_sheet", "part"), sheets)


def read_number_formats(parts: DataFrame) -> DataFrame:
    """book, style, num_fmt_id, num_fmt (of formats that the workbook defines): the cell formats in their order."""

    def walk(name: str, stream: io.BytesIO) -> Iterator[tuple]:
        root = ElementTree.parse(stream).getroot()
        codes = {attributes(n).get("numFmtId"): attributes(n).get("formatCode") for n in (child(root, "numFmts") if child(root, "numFmts") is not None else ())}
        for k, xf in enumerate(child(root, "cellXfs") if child(root, "cellXfs") is not None else ()):
            fmt = attributes(xf).get("numFmtId", "0")
            yield k, number(fmt), codes.get(fmt)

    return read_xml(parts, r"^xl/styles\.xml$", "style long, num_fmt_id long, num_fmt string", walk).select(F.col("path").alias("book"), "style", "num_fmt_id", "num_fmt")
