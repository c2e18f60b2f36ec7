"""Findings of the third round: what grew faster than its input, and rules that hold beyond small keys."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import painting, rules, sheets
from quire.sources import packages

CELLS = "book string, sheet string, row long, col long, num double"


def test_regions_store_blocks_and_link_bands(spark, monkeypatch):
    """Blocks over the border of bands against a flood fill; only blocks are stored, no run of cells."""
    stored = []
    monkeypatch.setattr(sheets, "checkpoint", lambda df: stored.append(df.columns) or df.localCheckpoint())
    rng = random.Random(3)
    cells = {(s, rng.randrange(60) + 1024 * rng.choice([0, 0, 1]) + 995, rng.randrange(60)) for s in "ab" for _ in range(3000)}
    left, want = set(cells), []
    while left:
        todo = [left.pop()]
        block = []
        while todo:
            s, r, c = todo.pop()
            block.append((s, r, c))
            near = {(s, r, c + 1), (s, r, c - 1), (s, r + 1, c), (s, r - 1, c)} & left
            left -= near
            todo += near
        want.append((block[0][0], *(f(x[k] for x in block) for f in (min, max) for k in (1, 2))))
    got = sheets.regions(spark.createDataFrame([("b", *c, 1.0) for c in cells], CELLS)).select("sheet", "r0", "c0", "r1", "c1").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert any(r0 < 1024 <= r1 for _, r0, _, r1, _ in want)
    assert all("run_start" not in columns for columns in stored)


def test_addresses_beyond_the_sheet(spark, tmp_path):
    """Rows that no sheet has give no address, in the query and in its SQL."""
    duckdb = pytest.importorskip("duckdb")
    from quire.jobs.queries import ORACLES, QUERIES

    spark.range(1_048_570, 1_048_580).select(F.col("id").alias("o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted(map(tuple, QUERIES["b3_addresses"](spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert got == sorted(db.execute(ORACLES["b3_addresses"]).fetchall())
    assert [r[1] is None for r in got] == [False] * 6 + [True] * 4


def test_style_chains_take_few_rounds(spark, monkeypatch):
    """A chain of 40 styles, a loop and a double id: the same chains in a few stored tables, none per link."""
    from quire.operators import documents

    stored = []
    monkeypatch.setattr(documents, "checkpoint", lambda df: stored.append(1) or df.localCheckpoint())
    rows = [(1, k, k - 1) for k in range(1, 41)] + [(2, k, (k + 1) % 3) for k in range(4)]
    got = {tuple(r) for r in documents.style_chains(spark.createDataFrame(rows, "doc_id long, style_id long, based_on long")).collect()}
    want = {(1, k, k - d, d) for k in range(1, 41) for d in range(min(k, 33))} | {(2, k, (k + d) % 3, d) for k in range(3) for d in range(3)} | {(2, 3, 3, 0), (2, 3, 1, 1), (2, 3, 2, 2), (2, 3, 0, 3)}
    assert {x[:2] + x[2:] for x in got} == want
    assert len(stored) <= 8


def test_repeated_headers_are_numbered_once(spark):
    """40 000 equal headers: each number is tried once, not once for each header before it."""
    from quire.operators import formulas

    h = spark.range(40_000).select(F.lit(0).cast("long").alias("table_id"), F.col("id").alias("position"), F.lit("A").alias("text"))
    got = [r["name"] for r in formulas.table_headers(h).orderBy("position").collect()]
    assert got == ["A"] + [f"A{k}" for k in range(2, 40_001)]


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_totals_inside_sheets(spark, monkeypatch, most):
    """Boxes of any size and number, equal ones too, against every cell; no piece of a box is shuffled."""
    from quire.operators import totals

    monkeypatch.setattr(sheets, "IN_ONE_TASK", most)
    rng = random.Random(5)
    cells = [("b", s, r, c, rng.choice([None, float(rng.randrange(100))]), None) for s in "xy" for r in range(50) for c in (0, 1, 2, 9) if rng.random() < 0.8]
    cells = [(*x[:5], rng.choice(["é", "b", None]) if x[4] is None else None) for x in cells]
    boxes = [("b", s, r, rng.randrange(4), r + rng.randrange(60), rng.randrange(4, 12)) for s in "xyz" for r in range(40) for _ in range(2)] * 2
    df = spark.createDataFrame(boxes, "book string, sheet string, r0 long, c0 long, r1 long, c1 long")
    held = spark.createDataFrame(cells, "book string, sheet string, row long, col long, num double, bad string")
    want = []
    for box in boxes:
        inside = [x for x in cells if x[1] == box[1] and box[2] <= x[2] <= box[4] and box[3] <= x[3] <= box[5]]
        n, bad = [x[4] for x in inside if x[4] is not None], [x[5] for x in inside if x[5] is not None]
        want.append((*box, sum(n) if n else None, min(n, default=None), max(n, default=None), len(n), min(bad, default=None)))
    out = totals.with_totals(df, held, "t").select(*df.columns, "t.total", "t.low", "t.high", F.coalesce("t.stored", F.lit(0)), "t.bad")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    if most:
        assert "_ky" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_formulas_are_looked_up_inside_sheets(spark, monkeypatch, most):
    """Values by look-up and by join are the same; the look-up shuffles no match by the place of a reference."""
    from quire.operators import rule_formulas as R

    monkeypatch.setattr(sheets, "IN_ONE_TASK", most)
    cells = spark.createDataFrame([("b", "s", r, c, float(r * 3 + c) if (r + c) % 4 else None, "t" if r == 2 else None) for r in range(6) for c in range(3) if r != 4], "book string, sheet string, row long, col long, num double, txt string")
    texts = ["=A1>B2", "=$A$1", "=MOD(C3,2)", "=LEN(A1)", "=ROW()", "=FOO(1)", None, "=B9=0", "=XFD1=1"]
    one = cells.select("book", "sheet", "row", "col").withColumns({"r0": F.lit(0).cast("long"), "c0": F.lit(0).cast("long")})
    matches = one.select("*", F.explode(F.array(*map(F.lit, texts))).alias("formula1"))
    matches = matches.unionByName(matches.where("row = 1"))
    got, want = R.formula_values(matches, cells, name="v"), R.joined_values(matches, cells, name="v")
    plain = lambda df: sorted((tuple(r) for r in df.select("row", "col", "formula1", "v.kind", "v.num", "v.txt").collect()), key=repr)
    assert plain(got) == plain(want)
    if most:
        assert "_place" not in got._jdf.queryExecution().toString()


def test_short_rules_meet_few_cells(spark, monkeypatch):
    """Rules of a few rows are met by low bands."""
    from quire.operators import rules

    seen = []
    real = rules.in_ranges
    monkeypatch.setattr(rules, "in_ranges", lambda c, r, band=1024: seen.append(band) or real(c, r, band))
    cells = spark.createDataFrame([("b", "s", r, c, 1.0) for r in range(100) for c in range(2)], CELLS)
    table = spark.createDataFrame([("b", "s", k, k, 0, k + 4, 0) for k in range(90)], "book string, sheet string, rule long, r0 long, c0 long, r1 long, c1 long")
    assert rules.rule_matches(cells, table).count() == 450
    assert seen == [8]


def test_scale_sorts_its_points_once(spark):
    """The points of a scale stand once in the plan of a colour."""
    from quire.operators import rules

    color = rules.scale_color(F.col("num"), F.array(F.lit(30.0), F.lit(0.0)), F.array(F.lit(0xFF0000), F.lit(0)))
    df = spark.createDataFrame([(0.0,), (15.0,), (40.0,), (None,)], "num double").select("num", color.alias("c"))
    assert [r["c"] for r in df.collect()] == [0, 0x800000, 0xFF0000, None]
    assert df._jdf.queryExecution().analyzed().toString().count("arrays_zip") == 1


def test_lines_are_dealt_by_their_number(spark, monkeypatch, tmp_path):
    """More lines, more tasks: none sorts a share of the table that grows with it."""
    from quire.sources import adapters

    monkeypatch.setattr(adapters, "LINES_IN_TASK", 10)
    df = spark.range(100).select(F.col("id").alias("k"))
    assert adapters.dealt(df, "k").rdd.getNumPartitions() == 10
    assert adapters.dealt(df.limit(5), "k").count() == 5


def test_rules_of_a_sheet_are_worked_out_in_one_meeting(spark, rows):
    kinds = "book string, sheet string, row long, col long, kind string, num double, txt string, formula string, style long"
    cells = spark.createDataFrame([("b", "s", r, 0, "number", float(r), None, None, 0) for r in range(4)] + [("b", "s", 4, 0, "text", None, "x", None, 0)], kinds)
    some = [(1, "cellIs", "between", "2", "1"), (2, "expression", None, "$A1>2", None), (3, "cellIs", "equal", '"X"', None), (4, "cellIs", "greaterThan", "oops(", None)]
    fields = "book string, sheet string, rule long, kind string, operator string, formula1 string, formula2 string, r0 long, c0 long, r1 long, c1 long, stop_if_true boolean, style long, thresholds array<struct<kind:string,value:double,gte:boolean>>, colors array<int>, reverse boolean"
    rules = spark.createDataFrame([("b", "s", k, kind, op, one, two, 0, 0, 1048575, 0, False, k, [], [], False) for k, kind, op, one, two in some], fields)
    fired = painting.fired_rules(cells, rules)
    assert rows(fired.where("fired"), "row", "rule") == [(1, 1), (2, 1), (3, 2), (4, 2), (4, 3)]
    plan = fired._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow ") == 1  # each value had a meeting of its own, and asked for the first one's again


def test_first_merge_is_found_where_cells_and_merges_met(spark, rows):
    """No shuffle by place after the one by stretch; uncovered cells and copies of a place stay where all are asked for."""
    cells = spark.createDataFrame([("b", "s", r, 0, 1.0) for r in (0, 1, 2, 2, 3, 5, 5, 2000)], CELLS)
    merges = spark.createDataFrame([("b", "s", 0, 1, 0, 3, 0), ("b", "s", 1, 2, 0, 3, 1), ("b", "s", 2, 1000, 0, 2100, 0)], "book string, sheet string, merge long, r0 long, c0 long, r1 long, c1 long")
    assert rows(sheets.merge_covering(cells, merges), "row", "merge", "hidden") == [(1, 0, False), (2, 0, True), (2000, 2, True), (3, 0, True)]
    every = rows(sheets.merge_covering(cells, merges, how="left"), "row", "merge")
    assert every == [(0, None), (1, 0), (2, 0), (2, 0), (2000, 2), (3, 0), (5, None), (5, None)]
    plan = sheets.merge_covering(cells, merges, 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count(", 7)") == 2


def test_percentiles_are_not_dealt_by_place(spark, rows):
    """Numbers of a rule stay where they were put in order."""
    some = [("b", "s", 0, r, 0, float(r * r)) for r in range(11)]
    matches = spark.createDataFrame(some, "book string, sheet string, rule long, row long, col long, num double")
    rule = spark.createDataFrame([("b", "s", 0, [("percentile", 90.0), ("percentile", 25.0), ("max", None)])], "book string, sheet string, rule long, thresholds array<struct<kind:string,value:double>>")
    limits = rules.rule_limits(matches, rule)
    assert limits.first()["limits"] == [81.0, 6.5, 100.0]
    assert not [x for x in limits._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x and "_k" in x]


def test_small_parts_are_dealt_over_the_configured_tasks(spark):
    """The number of reading tasks is set, so small packages are not left to one task by their bytes."""
    files = spark.createDataFrame([("a", bytearray(b"x"))], "path string, content binary")
    plan = packages.check_parts(packages.parts_of(files))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_markdown_of_tables_passes_over_its_cells_once(spark):
    """F22 of round 3: width and alignments come with the rows, not from two more passes joined to them."""
    from quire.operators import exports

    schema = "doc_id long, table_id int, row long, cell_ord int, grid_span int, v_merge string, jc string, text string"
    cells = [(1, 0, 3, 0, 2, None, "left,right", "a"), (1, 0, 3, 1, 1, "restart", "end", "b\nc"), (1, 0, 4, 0, 1, None, "center", "d"), (1, 0, 4, 1, 1, None, None, None), (1, 0, 4, 2, 1, "continue", None, "e"), (1, 0, 5, 0, 4, None, None, "f")]
    md = exports.table_markdown(spark.createDataFrame(cells, schema))
    assert "Join" not in md._jdf.queryExecution().optimizedPlan().toString()
    assert md.first()["md"] == "| a | b<br>c |  |  |\n| --- | --- | ---: | --- |\n| d |  |  |  |\n| f |  |  |  |"
