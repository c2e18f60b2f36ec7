"""Blocks, runs, styles, lists, tables and exports of documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.lineage import checkpoint
from quire.sources.packages import decoded


def joined(parts: Column, sep: str, *order: str) -> Column:
    """Aggregate: texts joined in order."""
    # No row is null, so the plain sort has the order of array_sort; that one, like transform, is not compiled.
    return F.array_join(F.sort_array(F.collect_list(F.struct(*order, parts.alias("_p"))))["_p"], sep)


def paragraph_text(runs: DataFrame, mode: str = "export") -> DataFrame:
    """doc_id, ord, text of each paragraph; ``normalised`` drops breaks, trims, and leaves out empty paragraphs."""
    out = runs.groupBy("doc_id", "ord").agg(joined(F.col("text"), "", "run_ord").alias("text"))
    if mode == "normalised":
        out = out.withColumn("text", F.trim(F.translate("text", "\n\t\r", ""))).where("text != ''")
    return out


def cell_text(paragraphs: DataFrame, key: list[str]) -> DataFrame:
    """key, text: the paragraphs (ord, text) of each table cell that are not blank, joined by spaces, line breaks as spaces."""
    line = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" "))
    return paragraphs.groupBy(*key).agg(joined(F.when(F.trim(line) != "", line), " ", "ord").alias("text"))


def cell_line(paragraphs: Column) -> Column:
    """What :func:`cell_text` makes of a cell whose paragraphs are an array of texts."""
    lines = F.transform(paragraphs, lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit("\n"), F.lit(" ")))
    return F.array_join(F.filter(lines, lambda x: F.trim(x) != ""), " ")


CELL = ["doc_id", "table_id", "row", "cell_ord"]
_FILLED = r"(?U)\S"


def paragraph_lines(runs: DataFrame) -> DataFrame:
    """doc_id, ord, text: texts, tabs and breaks of each paragraph's runs (doc_id, ord, run_ord, kind, text)."""
    piece = F.when(F.col("kind") == "tab", "\t").when(F.col("kind").isin("break", "page"), "\n").when(F.col("kind") == "text", F.coalesce("text", F.lit(""))).otherwise("")
    return runs.groupBy("doc_id", "ord").agg(joined(piece, "", "run_ord").alias("text"))


def nested_cell_text(paragraphs: DataFrame) -> DataFrame:
    """doc_id, table_id, row, cell_ord, text: what stands in each table cell and in the tables inside it, however deep.

    ``paragraphs`` has doc_id, ord, text and ``within``, the cells around it,
    outermost first.  Paragraphs stand in the order of the document, those of a
    nested table row by row, so a cell's text is one aggregation over all
    paragraphs that have it around them, and no round per depth is needed.
    Blank paragraphs are left out, line breaks are spaces; a cell without other
    ones has no row.
    """
    line = F.replace("text", F.lit("\n"), F.lit(" "))
    inside = paragraphs.where(F.rlike("text", F.lit(_FILLED))).select("doc_id", "ord", line.alias("text"), F.explode("within").alias("_at"))
    return inside.select("doc_id", "_at.*", "ord", "text").groupBy(*CELL).agg(joined(F.col("text"), " ", "ord").alias("text"))


def nested_cell_markdown(paragraphs: DataFrame) -> DataFrame:
    """doc_id, table_id, row, cell_ord, text: cells as Markdown, their paragraphs (``body``) and tables between ``<br>``.

    Markdown has no tables inside cells, so such a table is the escaped text of
    all its cells.  ``paragraphs`` is that of :func:`nested_cell_text`, with body.
    """
    inner = F.get("within", F.col("_k") + 1)["table_id"]  # null for a paragraph right in the cell
    inside = paragraphs.select("doc_id", "ord", "text", "body", "within", F.posexplode("within").alias("_k", "_at")).select("doc_id", "_at.*", "ord", "text", "body", inner.alias("_inner"))
    own = inside.where("_inner IS NULL").select(*CELL, "ord", F.regexp_replace("body", r"(?U)^\s+|\s+$", "").alias("text"))
    line = F.replace("text", F.lit("\n"), F.lit(" "))
    flat = inside.where(F.col("_inner").isNotNull() & F.rlike("text", F.lit(_FILLED))).groupBy(*CELL, "_inner").agg(joined(line, " ", "ord").alias("text"), F.min("ord").alias("ord"))
    items = own.unionByName(flat.select(*CELL, "ord", escape_inline(F.col("text")).alias("text"))).where("text != ''")
    text = F.replace(F.replace(joined(F.col("text"), "<br>", "ord"), F.lit("\\\n"), F.lit("<br>")), F.lit("\n"), F.lit("<br>"))
    return items.groupBy(*CELL).agg(text.alias("text"))


def document_text(paragraphs: DataFrame, table_cells: DataFrame | None = None) -> DataFrame:
    """doc_id, text: paragraphs one per line, line breaks at the end taken off, one put back.

    ``table_cells`` (doc_id, ord of the table, row, cell_ord, text) stand at
    their place, a row per line, cells between tabs.
    """
    lines = paragraphs.select("doc_id", "ord", F.lit(0).cast("long").alias("_row"), F.coalesce("text", F.lit("")).alias("text"))
    if table_cells is not None:
        rows = table_cells.groupBy("doc_id", "ord", F.col("row").cast("long").alias("_row")).agg(joined(F.coalesce("text", F.lit("")), "\t", "cell_ord").alias("text"))
        lines = lines.unionByName(rows)
    return lines.groupBy("doc_id").agg(F.concat(F.regexp_replace(joined(F.col("text"), "\n", "ord", "_row"), "\n+$", ""), F.lit("\n")).alias("text"))


def merge_runs(runs: DataFrame, marks: tuple[str, ...] = ("bold",), same: tuple[str, ...] = (), apart: Column | None = None) -> DataFrame:
    """Adjacent runs with equal ``marks`` and equal ``same`` columns as one: doc_id, ord, run_ord (of the first), those columns, text.

    Rows where ``apart`` holds (images, tabs, breaks) stay alone.
    """
    w = W.partitionBy("doc_id", "ord").orderBy("run_ord")
    kept = [*marks, *same]
    alone = F.coalesce(apart, F.lit(False)) if apart is not None else F.lit(False)
    equal = F.row_number().over(w) > 1
    for c in kept:
        equal = equal & F.lag(c).over(w).eqNullSafe(F.col(c))
    equal = equal & ~F.col("_alone") & ~F.coalesce(F.lag("_alone").over(w), F.lit(False))
    grouped = runs.withColumn("_alone", alone).withColumn("_c", F.when(equal, 0).otherwise(1)).withColumn("_g", F.sum("_c").over(w))
    return grouped.groupBy("doc_id", "ord", "_g", *kept).agg(F.min("run_ord").alias("run_ord"), joined(F.col("text"), "", "run_ord").alias("text")).drop("_g")


def _branching_chains(styles: DataFrame, longest: int) -> DataFrame:
    """Chains of documents with several styles of one id: link by link, with the path of each, as a chain may part."""
    parents = styles.select(F.col("doc_id"), F.col("style_id").alias("ancestor"), F.col("based_on").alias("next")).hint("merge")
    level = styles.select("doc_id", "style_id", F.col("style_id").alias("ancestor"), F.lit(0).alias("depth"), F.array("style_id").alias("path"))
    out = level
    for depth in range(1, longest + 1):
        step = level.join(parents, ["doc_id", "ancestor"]).where("next IS NOT NULL AND NOT array_contains(path, next)").select("doc_id", "style_id", F.col("next").alias("ancestor"), F.lit(depth).alias("depth"), F.concat("path", F.array("next")).alias("path"))
        level = checkpoint(step.join(styles.select("doc_id", F.col("style_id").alias("ancestor")).hint("merge"), ["doc_id", "ancestor"], "left_semi"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.drop("path")


def style_chains(styles: DataFrame, longest: int = 32) -> DataFrame:
    """style_id, depth, ancestor: each style (depth 0) and what it is based on, up to ``longest`` links, ending at a repeat or a missing parent.

    Chains of 1, 2, 4 ... links are joined end to end, so a few rounds find
    all; the tables are dealt by style and none is sent to the driver.
    """
    twice = checkpoint(styles.groupBy("doc_id", "style_id").count().where("count > 1").select("doc_id").distinct())
    own, branching = styles.select("doc_id", "style_id", "based_on"), None
    if not twice.isEmpty():
        branching = _branching_chains(own.join(twice, "doc_id", "left_semi"), longest)
        own = own.join(twice, "doc_id", "left_anti")
    known = own.select("doc_id", F.col("style_id").alias("based_on")).hint("merge")
    first = own.where("based_on != style_id").join(known, ["doc_id", "based_on"], "left_semi")
    chains = step = checkpoint(first.select("doc_id", "style_id", F.col("based_on").alias("ancestor"), F.lit(1).alias("depth")))
    length = 1
    while length < longest and not step.isEmpty():
        far = step.where(F.col("depth") == length).withColumnRenamed("ancestor", "_mid").drop("depth")
        on = chains.withColumnRenamed("style_id", "_mid").hint("merge")
        step = far.join(on, ["doc_id", "_mid"]).select("doc_id", "style_id", "ancestor", (F.col("depth") + length).alias("depth"))
        step = checkpoint(step.where((F.col("ancestor") != F.col("style_id")) & (F.col("depth") <= longest)))
        chains, length = chains.unionByName(step), 2 * length
    # On a loop each style comes again; the first time is the chain's.
    once = chains.groupBy("doc_id", "style_id", "ancestor").agg(F.min("depth").alias("depth"))
    out = own.select("doc_id", "style_id", F.col("style_id").alias("ancestor"), F.lit(0).alias("depth")).unionByName(once)
    return out if branching is None else out.unionByName(branching)


def cascade(items: DataFrame, chains: DataFrame, styles: DataFrame, props: list[str]) -> DataFrame:
    """items (doc_id, item, style_id, direct props) with resolved props: direct, else the nearest style of the chain that sets it."""
    layers = chains.join(styles.select("doc_id", F.col("style_id").alias("ancestor"), *props).hint("merge"), ["doc_id", "ancestor"])  # not sent to the driver
    nearest = layers.groupBy("doc_id", "style_id").agg(*[F.min_by(p, F.when(F.col(p).isNotNull(), F.col("depth"))).alias(f"_{p}") for p in props])
    out = items.join(nearest.hint("merge"), ["doc_id", "style_id"], "left")
    return out.withColumns({p: F.coalesce(p, f"_{p}") for p in props}).drop(*[f"_{p}" for p in props])


def _layer(df: DataFrame, key: list[str], strength: Column, props: list[str]) -> DataFrame:
    """key, _strength and the props that ``df`` has; a hanging indent takes the first line's place inside its layer."""
    has = set(df.columns)
    first = (F.col("first_line") if "first_line" in has else F.lit(None)).cast("double")
    if "hanging" in has:
        first = F.coalesce(-F.col("hanging").cast("double"), first)
    value = lambda p: first if p == "first_line" else F.col(p) if p in has else F.lit(None)
    return df.select(*key, strength.cast("long").alias("_strength"), *[value(p).alias(p) for p in props])


def cascade_layers(items: DataFrame, chains: DataFrame, styles: DataFrame, props: list[str], defaults: DataFrame | None = None, char_style: str | None = None) -> DataFrame:
    """items (doc_id, item, style_id, own props) with each of ``props`` resolved by itself.

    Weakest first: the document's defaults (doc_id, props), the chain of the
    paragraph style, the chain of the character style (column ``char_style``),
    the item's own values.  A value that is set, ``false`` and 0 too, overrides;
    an absent one keeps what is below.  ``first_line`` is negative where a layer
    has a ``hanging`` indent.  The colour ``auto`` takes the colour away.
    """
    key = ["doc_id", "item"]
    held = styles.select("doc_id", F.col("style_id").alias("ancestor"), *[c for c in styles.columns if c not in ("doc_id", "style_id", "based_on")])

    def of_style(column: str, base: int) -> DataFrame:
        used = items.select(*key, F.col(column).alias("style_id")).where("style_id IS NOT NULL")
        rows = used.hint("merge").join(chains, ["doc_id", "style_id"]).join(held.hint("merge"), ["doc_id", "ancestor"])  # not sent to the driver
        return _layer(rows, key, F.lit(base) - F.col("depth"), props)

    layers = _layer(items, key, F.lit(4000), props).unionByName(of_style("style_id", 2000))
    if char_style is not None:
        layers = layers.unionByName(of_style(char_style, 3000))
    if defaults is not None:
        layers = layers.unionByName(_layer(items.select(*key).join(defaults, "doc_id"), key, F.lit(0), props))
    out = layers.groupBy(*key).agg(*[F.max_by(p, F.when(F.col(p).isNotNull(), F.col("_strength"))).alias(p) for p in props])
    if "color" in props:
        out = out.withColumn("color", F.when(F.col("color") != "auto", F.col("color")))
    return out


def validate_styles(styles: DataFrame, chains: DataFrame, longest: int = 32) -> DataFrame:
    """doc_id, style_id, warning: missing parents, cycles (once each, at the least id), chains over ``longest`` links and duplicate ids.

    With a column ``kind`` each kind of style is looked at by itself (chains
    have it too); it stays in the result.
    """
    key = ["doc_id", *[c for c in ("kind",) if c in styles.columns]]
    ids = styles.select(*key, F.col("style_id").alias("based_on")).distinct()
    missing = styles.where("based_on IS NOT NULL").join(ids, [*key, "based_on"], "left_anti").select(*key, "style_id", F.lit("MissingParent").alias("warning"))
    ends = chains.join(styles.select(*key, F.col("style_id").alias("ancestor"), "based_on"), [*key, "ancestor"])
    loops = ends.where("based_on = style_id").select(*key, "style_id")
    members = chains.join(loops, [*key, "style_id"], "left_semi").groupBy(*key, "style_id").agg(F.min("ancestor").alias("least"))
    cycles = members.where("least = style_id").select(*key, "style_id", F.lit("CyclicBasedOn").alias("warning"))
    deep = ends.where((F.col("depth") >= longest) & F.col("based_on").isNotNull()).select(*key, "style_id", F.lit("TooDeep").alias("warning"))
    twice = styles.groupBy(*key, "style_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key, "style_id", F.lit("DuplicateStyle").alias("warning"))
    return missing.unionByName(cycles).unionByName(deep).unionByName(twice)


def validate_numbering(nums: DataFrame, abstracts: DataFrame, used: DataFrame) -> DataFrame:
    """doc_id, num_id, warning: lists without an abstract list, and lists that blocks use (doc_id, num_id) but nobody defines."""
    known = abstracts.select("doc_id", "abstract_id").distinct()
    bare = nums.join(known, ["doc_id", "abstract_id"], "left_anti").select("doc_id", "num_id", F.lit("MissingAbstractNum").alias("warning"))
    lost = used.where("num_id != 0").select("doc_id", "num_id").distinct().join(nums.select("doc_id", "num_id"), ["doc_id", "num_id"], "left_anti").withColumn("warning", F.lit("MissingNum"))
    return bare.unionByName(lost)


def heading_level(outline: Column, style_id: Column) -> Column:
    """1-9 from a resolved outline level 0-8 (9 is body), else from a HeadingN style."""
    named = F.regexp_extract(style_id, r"^Heading([1-9])$", 1).try_cast("int")
    return F.when(outline.isNotNull(), F.when(outline <= 8, outline + 1)).otherwise(named).cast("int")


def _letters(n: Column) -> Column:
    return F.repeat(F.char(F.pmod(n - 1, F.lit(26)) + 97), (F.floor((n - 1) / 26) + 1).cast("int"))


def _roman(n: Column) -> Column:
    digit = lambda d, one, five, ten: F.element_at(F.array(*map(F.lit, ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten))), d.cast("int") + 1)
    at = lambda unit: F.pmod(F.floor(n / unit), F.lit(10))
    return F.when(n.between(1, 3999), F.concat(F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")), digit(at(100), "c", "d", "m"), digit(at(10), "x", "l", "c"), digit(at(1), "i", "v", "x"))).otherwise(n.cast("string"))


def number_text(n: Column, fmt: Column) -> Column:
    return F.when(fmt == "lowerLetter", _letters(n)).when(fmt == "upperLetter", F.upper(_letters(n))).when(fmt == "lowerRoman", _roman(n)).when(fmt == "upperRoman", F.upper(_roman(n))).otherwise(n.cast("string"))


def number_lists(blocks: DataFrame, levels: DataFrame, deepest: int = 9, parent: str = "own") -> DataFrame:
    """List items of blocks (doc_id, ord, num_id, ilvl, text) with their marker.

    An item at one level restarts the deeper levels of its list; bullets and
    levels that are not defined give ``- `` and touch no counter; a heading
    (``level``, where blocks have it, is not null) is no item and advances
    nothing.  ``parent``: placeholders of upper levels show their own number,
    or (``next``) the one that comes next.
    """
    body = blocks.where("level IS NULL").drop("level") if "level" in blocks.columns else blocks
    items = body.where("num_id != 0 AND trim(text) != ''").withColumn("ilvl", F.least("ilvl", F.lit(8).cast("long")))
    known = items.join(levels, ["doc_id", "num_id", "ilvl"], "left")
    counts = known.where("num_fmt IS NOT NULL AND num_fmt != 'bullet'")
    lst = W.partitionBy("doc_id", "num_id").orderBy("ord")
    upto = lst.rowsBetween(W.unboundedPreceding, 0)
    for k in range(deepest):
        counts = counts.withColumn(f"_r{k}", F.sum((F.col("ilvl") < k).cast("int")).over(upto))
    reset = F.coalesce(*[F.when(F.col("ilvl") == k, F.col(f"_r{k}")) for k in range(deepest)])
    counts = counts.withColumn("_reset", reset)
    counts = counts.withColumn("number", F.row_number().over(W.partitionBy("doc_id", "num_id", "ilvl", "_reset").orderBy("ord")) + F.col("start") - 1)
    shown = []
    for k in range(deepest):
        last = F.last(F.when(F.col("ilvl") == k, F.struct(F.col("number").alias("n"), F.col(f"_r{k}").alias("r"), F.col("num_fmt").alias("f"))), ignorenulls=True).over(upto)
        counts = counts.withColumn(f"_p{k}", last)
        seen = F.col(f"_p{k}")
        n = F.when(seen["r"] == F.col(f"_r{k}"), seen["n"] + (F.when(F.col("ilvl") > k, 1).otherwise(0) if parent == "next" else 0)).otherwise(1)
        shown.append(F.struct(F.lit(f"%{k + 1}").alias("place"), F.coalesce(n, F.lit(1)).cast("long").alias("n"), F.coalesce(seen["f"], F.lit("decimal")).alias("f")))
    # Only placeholders that the text has are written out, by one expression for all levels.
    asked = F.filter(F.array(*shown), lambda x: F.contains(F.col("lvl_text"), x["place"]))
    marker = F.aggregate(asked, F.col("lvl_text"), lambda text, x: F.replace(text, x["place"], number_text(x["n"], x["f"])))
    counts = counts.withColumn("marker", marker).select("doc_id", "ord", "number", "marker")
    return known.join(counts, ["doc_id", "ord"], "left").select("doc_id", "ord", "num_id", "ilvl", F.col("number").cast("long").alias("number"), F.coalesce("marker", F.lit("- ")).alias("marker"), "text")


def place_table_cells(cells: DataFrame) -> DataFrame:
    """cells (doc_id, table_id, row, cell_ord, grid_span, v_merge) plus start column, row_span and whether they are a continuation."""
    w = W.partitionBy("doc_id", "table_id", "row").orderBy("cell_ord").rowsBetween(W.unboundedPreceding, -1)
    at = cells.withColumn("start_col", F.coalesce(F.sum(F.greatest(F.col("grid_span"), F.lit(1))).over(w), F.lit(0)))
    col = W.partitionBy("doc_id", "table_id", "start_col").orderBy("row")
    chained = (F.col("v_merge") == "continue") & (F.lag("row").over(col) == F.col("row") - 1) & F.lag("v_merge").over(col).isin("restart", "continue")
    at = at.withColumn("_linked", F.coalesce(chained, F.lit(False)))
    at = at.withColumn("_chain", F.sum((~F.col("_linked")).cast("int")).over(col))
    one = W.partitionBy("doc_id", "table_id", "start_col", "_chain")
    # The head of a chain is the last cell that is not linked, found in the order that is there already.
    heads = F.last(F.when(~F.col("_linked"), F.coalesce("v_merge", F.lit(""))), ignorenulls=True).over(col) == "restart"
    at = at.withColumn("continuation", F.coalesce(F.col("_linked") & heads, F.lit(False)))
    return at.withColumn("row_span", F.when(F.col("continuation"), 0).when(F.col("v_merge") == "restart", F.count(F.lit(1)).over(one)).otherwise(1).cast("long")).drop("_linked", "_chain")


def escape_inline(text: Column) -> Column:
    """Characters that mean something in Markdown escaped."""
    return F.regexp_replace(text, r"([\\`*_\[\]<>|~])", r"\\$1")


def escape_line_start(text: Column) -> Column:
    """A start that would open a heading, list, quote or underline escaped."""
    return F.regexp_replace(text, r"^([#+>=-]|\d+[.)](?:[ \t]|$))", r"\\$1")


def escape_markdown(text: Column) -> Column:
    """Inline marks escaped, and a line start that would open a heading, list or quote."""
    return escape_line_start(escape_inline(text))


def markdown_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id, ord, md: headings (``level``), list items (``marker``, ``ilvl``) and paragraphs; empty ones are left out."""
    body = escape_inline(F.col("text"))
    line = F.when(F.col("level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("level").cast("int")), F.lit(" "), body)).when(F.col("marker").isNotNull(), F.concat(F.repeat(F.lit("  "), F.col("ilvl").cast("int")), F.when(F.endswith("marker", F.lit(" ")), F.col("marker")).otherwise(F.concat("marker", F.lit(" "))), body)).otherwise(escape_line_start(body))
    return blocks.where("trim(text) != ''").select("doc_id", "ord", line.alias("md"), F.col("marker").isNotNull().alias("item"))


def to_markdown(blocks: DataFrame) -> DataFrame:
    """doc_id, md: blocks with a blank line between, list items close together."""
    w = W.partitionBy("doc_id").orderBy("ord")
    gap = F.when(F.lag("item").over(w).isNull(), "").when(F.col("item") & F.lag("item").over(w), "\n").otherwise("\n\n")
    lines = markdown_blocks(blocks).withColumn("_s", F.concat(gap, "md"))
    return lines.groupBy("doc_id").agg(joined(F.col("_s"), "", "ord").alias("md"))


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def to_html(blocks: DataFrame) -> DataFrame:
    """doc_id, html: headings, paragraphs and nested lists of plain texts, see :func:`quire.operators.exports.document_html`."""
    from quire.operators.exports import document_html

    return document_html(blocks.withColumn("body", escape_html(F.col("text"))), None)


def sections(blocks: DataFrame) -> DataFrame:
    """blocks plus section: every block belongs to the next break at or after it."""
    w = W.partitionBy("doc_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    return blocks.withColumn("section", F.coalesce(F.sum(F.col("section_break").cast("long")).over(w), F.lit(0)))


@F.pandas_udf(StringType())
def percent_decoded(column: pd.Series) -> pd.Series:
    """Escapes decoded as UTF-8; bad ones and ``+`` stay as they are."""
    return column.map(decoded)


def resolve_rels(refs: DataFrame, rels: DataFrame) -> DataFrame:
    """refs (pkg, source_part, id) plus target_mode and part: targets resolved against the source's folder, null part for external or undeclared ones."""
    found = refs.join(rels.select("pkg", "source_part", "id", "target", "target_mode"), ["pkg", "source_part", "id"], "left")
    folder = F.regexp_extract("source_part", r"^(.*/)?[^/]*$", 1)
    whole = F.when(F.startswith("target", F.lit("/")), F.col("target")).otherwise(F.concat(folder, F.col("target")))
    walk = F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), lambda a, s: F.when(s.isin("", "."), a).when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    return found.withColumn("part", F.when(F.coalesce("target_mode", F.lit("")) != "External", percent_decoded(F.array_join(walk, "/")))).withColumn("warning", F.when(F.col("target").isNull(), F.lit("UndeclaredRelation")))


def classify_link(target: Column, target_mode: Column, location: Column) -> Column:
    return F.when(target_mode == "External", F.when(F.startswith(target, F.lit("#")), "Internal").otherwise("External")).when(target.isNotNull() | location.isNotNull(), "Internal").otherwise("Broken")


def attach_comments(comments: DataFrame, authors: DataFrame) -> DataFrame:
    """comments (author_id) plus author by place in the list (doc_id, authors); null out of range."""
    names = authors.select("doc_id", F.posexplode("authors").alias("author_id", "author"))
    return comments.join(names, ["doc_id", "author_id"], "left")


def media_registry(refs: DataFrame, limit: int = 32 << 20, budget: int = 128 << 20) -> DataFrame:
    """book, part, ord, mime, kept: parts by first mention; too large ones, and ones over the budget of kept parts, are skipped."""
    ext = F.lower(F.element_at(F.split("part", r"\."), -1))
    mime = F.when(ext == "png", "image/png").when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext == "gif", "image/gif").when(ext == "svg", "image/svg+xml").otherwise("application/octet-stream")
    first = refs.groupBy("book", "part").agg(F.min("ord").alias("ord"), F.max("size").alias("size")).withColumn("mime", mime)

    def keep(frame: pd.DataFrame) -> pd.DataFrame:
        frame, used, kept = frame.sort_values("ord"), 0, []
        for size in frame["size"].tolist():
            ok = size <= limit and used + size <= budget
            used += size if ok else 0
            kept.append(ok)
        return frame.assign(kept=kept)

    return first.groupBy("book").applyInPandas(keep, "book string, part string, ord long, size long, mime string, kept boolean").drop("size")


def bookmark_orphans(marks: DataFrame) -> DataFrame:
    """Ends (doc_id, ord, id, kind) without an earlier start that is still open; a repeated end is one."""
    w = W.partitionBy("doc_id", "id").orderBy("ord")
    step = F.when(F.col("kind") == "start", 1).otherwise(-1)
    total = F.sum(step).over(w)
    floor = F.least(F.min("_t").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    t = marks.withColumn("_t", total)
    return t.withColumn("_f", F.coalesce(floor, F.lit(0))).where("kind = 'end' AND _t < _f").drop("_t", "_f")


def node_counts(nodes: DataFrame, kinds: list[str], category: str | None = None) -> DataFrame:
    """doc_id and one column per kind with the number of nodes (doc_id, kind), and text bytes; a total row has a null doc_id.

    With a ``category`` column there is a row per document, per category
    (doc_id null) and in total (both null).
    """
    aggs = [F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in kinds]
    return nodes.rollup(*([category] if category else []), "doc_id").agg(*aggs, F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("text_bytes"))


def reading_order(items: DataFrame) -> DataFrame:
    """items (doc_id, page, pos, covered) plus reading: 0-based over the document, covered ones skipped."""
    return items.where("NOT covered").withColumn("reading", (F.row_number().over(W.partitionBy("doc_id").orderBy("page", "pos")) - 1).cast("long"))


def page_slices(ordered: DataFrame) -> DataFrame:
    """doc_id, page, start, n: the stretch of the reading order on each page."""
    return ordered.groupBy("doc_id", "page").agg(F.min("reading").alias("start"), F.count(F.lit(1)).alias("n"))


# Directional classes of characters, as ranges of regular expressions.
_HEBREW_AND_KIN = r"\u0590\u05BE\u05C0\u05C3\u05C6\u05C8-\u05FF\u07C0-\u07EA\u07F4-\u07FF\u200F\uFB1D-\uFB4F\x{1E800}-\x{1EFFF}"
_ARABIC_AND_KIN = (
    r"\u060B\u061C\u0620-\u064A\u066E\u066F\u0671-\u06D5\u06E5\u06E6\u06EE\u06EF\u06FA-\u070D\u070F\u0712-\u072F\u074D-\u07A5\u07B1\u0800-\u0815\u0830-\u083E\u0840-\u0858\u0860-\u088E\u08A0-\u08C9"
    r"\uFB50-\uFDFF\uFE70-\uFEFF\x{10D00}-\x{10D23}\x{10F30}-\x{10F54}"
)
_DIGITS = r"0-9\u06F0-\u06F9\u2070\u2074-\u2079\u2080-\u2089\u2150-\u2189\u0600-\u0605\u0660-\u0669\u066B\u066C\u06DD\u0890\u0891\u08E2\x{10D30}-\x{10D39}\x{10E60}-\x{10E7E}"
_VOWELS_AND_MARKS = (
    r"\u0300-\u036F\u0483-\u0489\u0591-\u05BD\u05BF\u05C1\u05C2\u05C4\u05C5\u05C7\u0610-\u061A\u064B-\u065F\u0670\u06D6-\u06DC\u06DF-\u06E4\u06E7\u06E8\u06EA-\u06ED\u0711\u0730-\u074A\u07A6-\u07B0"
    r"\u07EB-\u07F3\u0816-\u0819\u081B-\u0823\u0825-\u0827\u0829-\u082D\u0859-\u085B\u08D3-\u08E1\u08E3-\u0902"
)
_SEPARATORS = r"\u0609\u060A\u066A\u06DE\u06E9\u060C\u061B\u061D-\u061F\u066D"
#: Strong characters: right-to-left letters, and all other alphabetic characters (with the left-to-right mark).
RTL = _HEBREW_AND_KIN + _ARABIC_AND_KIN
LTR = r"\u200E[\p{IsAlphabetic}&&[^" + RTL + _DIGITS + _VOWELS_AND_MARKS + _SEPARATORS + "]]"


def base_direction(text: Column, forced: Column) -> Column:
    """rtl if forced or if the first strong character is a right-to-left letter; digits and marks of any script are not strong."""
    first = F.regexp_extract(text, f"[{RTL}{LTR}]", 0)
    return F.when(F.coalesce(forced, F.lit(False)) | F.rlike(first, F.lit(f"[{RTL}]")), "rtl").otherwise("ltr")


def inherit_placeholders(shapes: DataFrame, layouts: DataFrame, masters: DataFrame | None = None) -> DataFrame:
    """shapes (deck, shape, idx, type, frame) with frame from the layout, by idx, else by type, else from the master (deck, idx, type, frame) likewise.

    Of several placeholders of a type the one with the least frame counts.
    """
    out = shapes
    for name, table in (("l", layouts), ("m", masters)):
        if table is None:
            continue
        by_idx = table.where("idx IS NOT NULL AND frame IS NOT NULL").groupBy("deck", "idx").agg(F.min("frame").alias(f"_i{name}"))
        by_type = table.where("frame IS NOT NULL").groupBy("deck", "type").agg(F.min("frame").alias(f"_t{name}"))
        out = out.join(by_idx, ["deck", "idx"], "left").join(by_type, ["deck", "type"], "left").withColumn("frame", F.coalesce("frame", f"_i{name}", f"_t{name}")).drop(f"_i{name}", f"_t{name}")
    return out


def inherit_frames(placeholders: DataFrame, layouts: DataFrame) -> DataFrame:
    """deck, part, shape, idx, type, frame of the placeholders of slides, with the frames that they inherit.

    ``placeholders`` (deck, part, level, shape, idx, type, frame) of all levels;
    ``layouts`` (deck, part, layout, master) says which layout and master a
    slide has.  A shape without a frame takes that of the first placeholder of
    its own layout with its idx, else of its type; where that has none, the
    master's likewise.
    """
    out = placeholders.where("level = 'slide'").select("deck", "part", "shape", "idx", "type", "frame").join(layouts, ["deck", "part"], "left")
    for level in ("layout", "master"):
        table = placeholders.where(F.col("level") == level).withColumnRenamed("part", level)
        # of several with one idx or type the first of the part counts, whether it has a frame or not
        for key in ("idx", "type"):
            first = table.where(F.col(key).isNotNull()).groupBy("deck", level, key).agg(F.min_by(F.struct("frame"), "shape").alias(f"_{key}"))
            out = out.join(first, ["deck", level, key], "left")
        out = out.withColumn("frame", F.coalesce("frame", F.when(F.col("_idx").isNotNull(), F.col("_idx.frame")).otherwise(F.col("_type.frame")))).drop("_idx", "_type")
    return out.select("deck", "part", "shape", "idx", "type", "frame")


def level_styles(levels: DataFrame) -> DataFrame:
    """levels (deck, ilvl, size, bold): each inherits from the ones above, bold adds up."""
    w = W.partitionBy("deck").orderBy("ilvl").rowsBetween(W.unboundedPreceding, 0)
    return levels.withColumns({"size": F.last("size", ignorenulls=True).over(w), "bold": F.max(F.coalesce("bold", F.lit(False))).over(w)})


#: Parts of a format and the flags that say whether a format's own one applies.
FORMAT_PARTS = {"num_fmt": "apply_num_fmt", "font": "apply_font", "fill": "apply_fill", "border": "apply_border"}


def resolve_formats(xf: DataFrame, base: DataFrame) -> DataFrame:
    """xf (base_id, parts of ``FORMAT_PARTS`` with their flags) with the base's (xf_id) part where its apply flag is explicitly false."""
    parts = [p for p in FORMAT_PARTS if p in xf.columns and p in base.columns]
    b = base.select(F.col("xf_id").alias("base_id"), *[F.col(p).alias(f"_{p}") for p in parts])
    out = xf.join(F.broadcast(b) if base.count() <= 100_000 else b, "base_id", "left")
    return out.withColumns({p: F.when(F.col(FORMAT_PARTS[p]) == F.lit(False), F.coalesce(f"_{p}", p)).otherwise(F.col(p)) for p in parts}).drop(*[f"_{p}" for p in parts])


def lines_text(runs: DataFrame) -> DataFrame:
    """doc_id, text: runs of a line joined, lines of a paragraph joined by spaces, paragraphs by line breaks in order of first appearance."""
    lines = runs.groupBy("doc_id", "par", "line").agg(joined(F.col("text"), "", "reading").alias("text"), F.min("reading").alias("reading"))
    pars = lines.groupBy("doc_id", "par").agg(joined(F.col("text"), " ", "reading").alias("text"), F.min("reading").alias("reading"))
    return pars.groupBy("doc_id").agg(joined(F.col("text"), "\n", "reading").alias("text"))


def table_tsv(cells: DataFrame) -> DataFrame:
    """doc_id, table_id, tsv: cell texts by row and column, empty rows left out."""
    rows = cells.groupBy("doc_id", "table_id", "row").agg(joined(F.trim("text"), "\t", "col").alias("t")).where("regexp_replace(t, '\t', '') != ''")
    return rows.groupBy("doc_id", "table_id").agg(joined(F.col("t"), "\n", "row").alias("tsv"))


def deck_export(paragraphs: DataFrame) -> DataFrame:
    """deck, md: per slide a title line and bullets with two spaces per level, slides in order."""
    line = F.when(F.col("title"), F.concat(F.lit("## "), "text")).otherwise(F.concat(F.repeat(F.lit("  "), F.col("ilvl").cast("int")), F.lit("- "), "text"))
    slides = paragraphs.groupBy("deck", "slide").agg(joined(line, "\n", "pos").alias("t"))
    return slides.groupBy("deck").agg(joined(F.col("t"), "\n\n", "slide").alias("md"))
