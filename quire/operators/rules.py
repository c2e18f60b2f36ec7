"""Conditional rules: matching, thresholds, predicates, visuals and the resolved style of each cell."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.scalars import excel_compare
from quire.operators.rule_formulas import expression_rules, rule_counts, tagged  # noqa: F401
from quire.operators.sheets import BAND, SHEET, clamp_ranges, in_ranges
from quire.ordering import in_groups
from quire.schemas import MAX_ROW

KEY = [*SHEET, "row", "col"]
#: Numbers in order; equal ones by their place, so that many of them can be dealt out.
_NUMERIC = ("num", "row", "col")


def explode_rules(blocks: DataFrame) -> DataFrame:
    """blocks (block, ranges array of boxes, rules array) to one row per rule and range, corners in order.

    Rules that cannot paint go: a colour scale needs as many colours as
    thresholds, visuals need two thresholds.  ``rule`` numbers the rows of a
    sheet by priority, then place in the file.
    """
    one = blocks.select(*SHEET, "block", F.posexplode("rules").alias("_r", "x"), "ranges").select(*SHEET, "block", "_r", "x.*", F.posexplode("ranges").alias("_b", "box"))
    n = F.size("thresholds")
    ok = F.when(F.col("kind") == "colorScale", (n >= 2) & (n == F.size("colors"))).when(F.col("kind").isin("dataBar", "iconSet"), n >= 2).otherwise(F.lit(True))
    box = {c: f(F.col(f"box.{a}"), F.col(f"box.{b}")) for c, f, a, b in (("r0", F.least, "r0", "r1"), ("r1", F.greatest, "r0", "r1"), ("c0", F.least, "c0", "c1"), ("c1", F.greatest, "c0", "c1"))}
    rule = F.row_number().over(W.partitionBy(*SHEET).orderBy("priority", "block", "_r", "_b")).cast("long")
    return one.where(ok).withColumns({**box, "rule": rule}).drop("box", "_r", "_b")


def rule_matches(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """Cells inside the range of each rule.

    Rules over whole columns meet the cells of their sheet, which shuffles
    cells by sheet alone; the others are cut to the used range and met by bands
    of rows about as high as they are on average, so that a cell meets few
    rules and all rules together cross few bands.
    """
    tall = (F.col("r0") <= 0) & (F.col("r1") >= MAX_ROW)
    whole = cells.join(rules.where(tall), SHEET).where("col BETWEEN c0 AND c1")
    rest = rules.where(~tall)
    height = rest.agg(F.avg(F.least(F.col("r1") - F.col("r0") + 1, F.lit(BAND)))).first()[0]
    if height is None:
        return whole
    band = min(BAND, max(8, 1 << math.ceil(math.log2(max(height, 1)))))
    banded_ = in_ranges(cells, clamp_ranges(rest, cells), band)
    return whole.unionByName(banded_.select(*whole.columns))


def rule_thresholds(matches: DataFrame, percentiles: list[float] | None = None) -> DataFrame:
    """low, high and linearly interpolated percentiles of the numbers under each rule; without numbers none.

    Percentiles come from places in a sort that can spill, and for rules over
    very many numbers that is dealt out (:func:`quire.ordering.in_groups`).
    """
    key = [*SHEET, "rule"]
    numbers = matches.where("num IS NOT NULL").select(*key, "row", "col", "num")
    ranked = in_groups(numbers, key, [F.col(c) for c in _NUMERIC], "_k", "_n")
    aggs = [F.min("num").alias("low"), F.max("num").alias("high")]
    for p in percentiles or [0.5]:
        at = (F.col("_n") - 1) * min(1.0, max(0.0, p))
        value = lambda place: F.max(F.when(F.col("_k") == place, F.col("num")))
        below, above, part = value(F.floor(at)), value(F.ceil(at)), F.max(at - F.floor(at))
        aggs.append((below + (above - below) * part).alias(f"p{round(p * 100)}"))
    return ranked.groupBy(*key).agg(*aggs)


def percent_threshold(low: Column, high: Column, percent: float) -> Column:
    return low + (high - low) * (percent / 100)


def cell_is(operator: Column, num: Column, a: Column, b: Column) -> Column:
    """Whether a number fulfils an operator on one or two numbers; an undefined comparison is false."""
    cmp = lambda x: excel_compare(F.when(num.isNull(), F.lit("empty")).otherwise(F.lit("number")), num, F.lit(""), F.lit("number"), x, F.lit(""))
    ca, cb = cmp(F.least(a, F.coalesce(b, a))), cmp(F.greatest(a, F.coalesce(b, a)))
    fired = (
        F.when(operator == "equal", cmp(a) == 0).when(operator == "notEqual", cmp(a) != 0).when(operator == "lessThan", cmp(a) < 0).when(operator == "lessThanOrEqual", cmp(a) <= 0)
        .when(operator == "greaterThan", cmp(a) > 0).when(operator == "greaterThanOrEqual", cmp(a) >= 0).when(operator == "between", (ca >= 0) & (cb <= 0)).when(operator == "notBetween", (ca < 0) | (cb > 0))
    )
    return F.coalesce(fired, F.lit(False))


def rule_limits(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """book, sheet, rule, limits: the value of each of a rule's thresholds (kind, value), in their order.

    Kinds are min, max, num, percent (linear) and percentile (linearly
    interpolated, 0 to 100); a formula, a kind without numbers to go by, or a
    missing value gives null, and the rule paints nothing.  Percentiles are
    looked up by place in the order of a rule's numbers.
    """
    key = [*SHEET, "rule"]
    asked = F.exists("thresholds", lambda t: t["kind"] == "percentile")
    wanted = rules.select(*key, "thresholds")
    numbers = matches.select(*key, "row", "col", "num").where("num IS NOT NULL")
    stats = numbers.groupBy(*key).agg(F.min("num").alias("_low"), F.max("num").alias("_high"), F.count(F.lit(1)).alias("_n"))
    low, high = F.col("_low"), F.col("_high")
    known = wanted.join(stats, key, "left")
    # place and share of each percentile between two neighbours in the order of the numbers
    rank = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("t.value") / 100)) * (F.col("_n") - 1)
    between = known.select(*key, "_n", F.posexplode("thresholds").alias("_i", "t")).where("t.kind = 'percentile' AND t.value IS NOT NULL AND _n > 0").select(*key, "_i", F.floor(rank).alias("_k"), (rank - F.floor(rank)).alias("_part"))
    ends = between.select(*key, "_i", "_part", F.explode(F.array(F.struct("_k", F.lit(True).alias("_lower")), F.struct((F.col("_k") + 1).alias("_k"), F.lit(False).alias("_lower")))).alias("e")).select(*key, "_i", "_part", "e.*")
    ranked = in_groups(numbers.join(rules.where(asked).select(*key).distinct(), key, "left_semi"), key, [F.col(c) for c in _NUMERIC], "_k")
    # Numbers stay with their rule: a difference is no key that they would be dealt by once more.
    near = ranked.select(*key, F.col("_k").alias("_at"), "num").join(ends, key).where(F.col("_at") - F.col("_k") == 0)
    found = near.groupBy(*key, "_i").agg(F.max("_part").alias("_part"), F.max(F.when(F.col("_lower"), F.col("num"))).alias("a"), F.max(F.when(~F.col("_lower"), F.col("num"))).alias("b"))
    value = F.col("a") + (F.coalesce("b", "a") - F.col("a")) * F.col("_part")
    held = found.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("_i", value.alias("v")))).alias("_at"))  # the percentiles of one rule
    limit = lambda t, i: F.when(t["kind"] == "num", t["value"]).when(t["kind"] == "min", low).when(t["kind"] == "max", high).when(t["kind"] == "percent", low + (high - low) * t["value"] / 100).when(t["kind"] == "percentile", F.try_element_at(F.col("_at"), i))
    return known.join(held, key, "left").select(*key, F.transform("thresholds", limit).alias("limits"))


def cell_is_value(operator: Column, cell: Column, a: Column, b: Column) -> Column:
    """:func:`cell_is` on tagged values: numbers before texts before truth values, errors never."""
    cmp = lambda x, y: excel_compare(x["kind"], x["num"], x["txt"], y["kind"], y["num"], y["txt"])
    swapped = cmp(a, b) > 0
    low, high = F.when(swapped, b).otherwise(a), F.when(swapped, a).otherwise(b)
    inside = (cmp(cell, low) >= 0) & (cmp(cell, high) <= 0)
    to = cmp(cell, a)
    fired = (
        F.when(operator == "equal", to == 0).when(operator == "notEqual", to != 0).when(operator == "lessThan", to < 0).when(operator == "lessThanOrEqual", to <= 0)
        .when(operator == "greaterThan", to > 0).when(operator == "greaterThanOrEqual", to >= 0).when(operator == "between", inside).when(operator == "notBetween", ~inside)
    )
    return F.coalesce(fired, F.lit(False))


def _channel(color: Column, shift: int) -> Column:
    return F.shiftright(color, shift).bitwiseAND(F.lit(255)).cast("double")


def color_between(t: Column, a: Column, b: Column) -> Column:
    """Colour at t (0..1) between two, channel by channel, rounded."""
    mix = [F.floor(_channel(a, s) + (_channel(b, s) - _channel(a, s)) * t + 0.5).cast("int") for s in (16, 8, 0)]
    return F.shiftleft(mix[0], 16) + F.shiftleft(mix[1], 8) + mix[2]


def color_scale(num: Column, low: Column, middle: Column, high: Column, colors: tuple[int, int, int]) -> Column:
    """Colour of a number on a three-point scale; clamped outside; null without number or scale."""
    a, b, c = (F.lit(x) for x in colors)
    t1 = F.when(middle > low, (num - low) / (middle - low)).otherwise(F.lit(0.0))
    t2 = F.when(high > middle, (num - middle) / (high - middle)).otherwise(F.lit(0.0))
    return F.when(num.isNotNull() & low.isNotNull(), F.when(num <= low, a).when(num >= high, c).when(num < middle, color_between(t1, a, b)).otherwise(color_between(t2, b, c)))


def scale_color(num: Column, limits: Column, colors: Column) -> Column:
    """Colour of a number on a scale of any number of points (arrays of values and colours), sorted by value, clamped outside.

    Null without number, or where a point has no value.
    """
    def colored(x: Column) -> Column:
        a, b = x["a"], x["b"]
        mixed = color_between((num - a["v"]) / (b["v"] - a["v"]), a["c"], b["c"])
        return F.when(a.isNull(), b["c"]).when(b.isNull(), a["c"]).otherwise(mixed)

    # A parameter of a lambda is worked out once; the expression itself would be sorted anew wherever it stands.
    points = F.array(F.sort_array(F.arrays_zip(limits.alias("v"), colors.alias("c"))))
    ends = F.transform(points, lambda p: F.struct(F.try_element_at(F.filter(p, lambda x: x["v"] <= num), F.lit(-1)).alias("a"), F.try_element_at(F.filter(p, lambda x: x["v"] > num), F.lit(1)).alias("b")))
    color = F.get(F.transform(ends, colored), F.lit(0))
    return F.when(num.isNotNull() & (F.size(limits) > 1) & (F.size(limits) == F.size(colors)) & ~F.exists(limits, lambda v: v.isNull()), color)


def data_bar(num: Column, low: Column, high: Column) -> Column:
    """struct(start, end) of a bar as fractions; a negative low puts the axis at zero; a flat scale is a full bar."""
    at = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))
    axis = F.when(low < 0, at(F.lit(0.0))).otherwise(F.lit(0.0))
    bar = F.when(high <= low, F.struct(F.lit(0.0).alias("start"), F.lit(1.0).alias("end"))).otherwise(F.struct(F.least(axis, at(num)).alias("start"), F.greatest(axis, at(num)).alias("end")))
    return F.when(num.isNotNull() & low.isNotNull(), bar)


def icon_level(num: Column, thresholds: list[Column], gte: list[bool] | None = None, reverse: bool = False) -> Column:
    """Highest threshold that is passed, 0 below all; ``reverse`` counts from the other end."""
    flags = gte or [True] * len(thresholds)
    level: Column = F.lit(0)
    for i, (t, g) in enumerate(zip(thresholds, flags)):
        level = F.when((num >= t) if g else (num > t), F.lit(i)).otherwise(level)
    return F.when(num.isNotNull() & thresholds[0].isNotNull(), (len(thresholds) - 1 - level) if reverse else level)


#: Columns of which the last value wins, and flags that only switch on.
LAST, FLAGS = ("fill", "num_fmt", "font_color", "border_left", "border_right", "border_top", "border_bottom", "visual"), ("bold", "italic", "underline", "strike")


def effective_style(fired: DataFrame) -> DataFrame:
    """One row per cell from its fired rules (rule, fired, stop_if_true, and what the table has of ``LAST`` and ``FLAGS``).

    Rules go in order of ``rule`` up to the first fired one that stops.  The
    last fill, format, font colour, side of a border and visual win, each by
    itself; flags only switch on; a fill after a colour scale takes the scale's
    background away.
    """
    before = W.partitionBy(*KEY).orderBy("rule").rowsBetween(W.unboundedPreceding, -1)
    live = fired.where("fired").withColumn("_stopped", F.coalesce(F.max(F.col("stop_if_true").cast("int")).over(before), F.lit(0))).where("_stopped = 0")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("rule"))).alias(c)
    at = lambda c: F.max(F.when(F.col(c).isNotNull(), F.col("rule")))
    has = set(fired.columns)
    out = live.groupBy(*KEY).agg(*[last(c) for c in LAST if c in has], *[F.bool_or(F.coalesce(c, F.lit(False))).alias(c) for c in FLAGS if c in has], at("fill").alias("_f"), at("visual").alias("_v"), F.count(F.lit(1)).alias("n_rules"))
    return out.withColumn("visual", F.when(F.startswith("visual", F.lit("colorScale")) & (F.col("_f") > F.col("_v")), F.lit(None)).otherwise(F.col("visual"))).drop("_f", "_v")
