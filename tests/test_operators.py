"""Operators on the small cases of FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from quire.operators import corpus, documents, edits, exports, formulas, rules, sheets


def cells(spark, rows):
    return spark.createDataFrame([("b", "s", *r) for r in rows], "book string, sheet string, row long, col long, num double")


def test_used_range(spark, rows):
    assert rows(sheets.used_range(cells(spark, [(2, 3, 1.0), (5, 1, 1.0)])), "r0", "c0", "r1", "c1") == [(2, 1, 5, 3)]


def test_content_runs(spark, rows):
    got = sheets.content_runs(cells(spark, [(0, c, 1.0) for c in (0, 1, 2, 5)]), "col")
    assert rows(got, "col", "jump") == [(0, 2), (1, 2), (2, 5), (5, 16383)]


def test_regions(spark, rows):
    got = sheets.regions(cells(spark, [(0, 0, 1.0), (0, 1, 1.0), (1, 1, 1.0), (3, 3, 1.0)]))
    assert rows(got, "r0", "c0", "r1", "c1") == [(0, 0, 1, 1), (3, 3, 3, 3)]


def test_regions_spiral(spark, rows):
    spiral = [(0, c) for c in range(7)] + [(r, 6) for r in range(1, 7)] + [(6, c) for c in range(6)] + [(r, 0) for r in range(2, 6)] + [(2, c) for c in range(1, 5)]
    assert rows(sheets.regions(cells(spark, [(*p, 1.0) for p in spiral])), "r0", "c0", "r1", "c1") == [(0, 0, 6, 6)]


def test_expand_merges(spark, rows):
    box = "book string, sheet string, range long, r0 long, c0 long, r1 long, c1 long"
    merges = spark.createDataFrame([("b", "s", 1, 0, 0, 1, 1), ("b", "s", 2, 1, 1, 2, 2)], box.replace("range", "merge"))
    start = spark.createDataFrame([("b", "s", 9, 0, 0, 0, 0)], box)
    assert rows(sheets.expand_merges(start, merges), "r0", "c0", "r1", "c1") == [(0, 0, 2, 2)]


def test_regions_high_u(spark, rows):
    u = [(r, c) for r in range(500) for c in (0, 2)] + [(499, 1)]
    assert rows(sheets.regions(cells(spark, [(*p, 1.0) for p in u])), "r0", "c0", "r1", "c1") == [(0, 0, 499, 2)]


def test_expand_long_chains(spark, rows):
    box = "book string, sheet string, range long, r0 long, c0 long, r1 long, c1 long"
    chain = [("b", "chain", k, k, k % 2, k + 1, k % 2 + 1) for k in range(300)]
    bricks = [("b", "bricks", k, k, k % 2, k + 1, k % 2) for k in range(300)]
    merges = spark.createDataFrame(chain + bricks, box.replace("range", "merge"))
    start = spark.createDataFrame([("b", "chain", 1, 0, 0, 0, 0), ("b", "bricks", 2, 0, 0, 0, 1), ("b", "bricks", 3, 400, 0, 401, 1), ("b", "bare", 4, 1, 1, 2, 2)], box)
    assert rows(sheets.expand_merges(start, merges), "range", "r0", "c0", "r1", "c1") == [(1, 0, 0, 300, 2), (2, 0, 0, 300, 1), (3, 400, 0, 401, 1), (4, 1, 1, 2, 2)]


def test_page_bands(spark, rows):
    dims = spark.createDataFrame([("b", "s", i, 30.0) for i in range(10)], "book string, sheet string, idx long, size double")
    assert rows(sheets.page_bands(dims, 100.0), "first", "last") == [(0, 2), (3, 5), (6, 8), (9, 9)]


def test_page_breaks(spark, rows):
    dims = lambda idx, size=10.0: spark.createDataFrame([("b", "s", i, size) for i in idx], "book string, sheet string, idx long, size double")
    bands = lambda *a, **k: rows(sheets.page_bands(*a, **k), "first", "last")
    two = [*range(8), *range(10, 16)]
    assert bands(dims(two), 100.0) == [(0, 11), (12, 15)]
    assert bands(dims(two), 100.0, header=20.0) == [(0, 7), (10, 15)]
    assert bands(dims(two), 100.0, default=10.0) == [(0, 7), (10, 15)]
    assert bands(dims(two), 100.0, orphans=3) == [(0, 7), (10, 15)]
    assert bands(dims(two), 100.0, widows=5) == [(0, 10), (11, 15)]
    assert bands(dims(two), 100.0, orphans=2, widows=5) == [(0, 7), (10, 15)]
    assert bands(dims(range(12)), 100.0, widows=25) == [(0, 9), (10, 11)]
    assert bands(dims(range(5), 30.0), 50.0) == [(k, k) for k in range(5)]
    assert bands(dims(range(5), 30.0), 50.0, split=True) == [(0, 1), (1, 3), (3, 4)]
    assert bands(dims(range(3), 90.0), 50.0, split=True) == [(0, 0), (1, 1), (2, 2)]


def test_rule_formulas(spark):
    from quire.functions.expressions import FormulaError, parse

    c = spark.createDataFrame([("b", "s", r, k, n, kind, t) for r, k, n, kind, t in ((0, 0, 5.0, "number", None), (0, 1, None, "text", "Abc"), (1, 0, None, "error", "#N/A"), (1, 1, 1.0, "bool", None))], "book string, sheet string, row long, col long, num double, kind string, txt string")
    fired = {}
    for f in ("=A1>4", "=B1=\"aBC\"", "=LEN($B$1)=3", "=A2=1", "=B2", "=C9=0", "=C9=\"\"", "=A1<\"x\"", "=B2>\"z\"", "=MOD(0-7,3)=2", "=MOD(-7,3)=2", "=XFD1048576>0"):
        m = c.where("row = 0 AND col = 0").withColumns({"r0": F.lit(0), "c0": F.lit(0), "formula1": F.lit(f)})
        fired[f] = rules.expression_rules(m, c).first()["fired"]
    assert [f for f, x in fired.items() if x] == ["=A1>4", "=B1=\"aBC\"", "=LEN($B$1)=3", "=B2", "=C9=0", "=C9=\"\"", "=A1<\"x\"", "=B2>\"z\"", "=MOD(-7,3)=2"]
    for bad in ("", "=", "=1+", "=(1", "=1 1", "=A1:", "=FOO", "=#"):
        try:
            parse(bad)
        except FormulaError:
            continue
        raise AssertionError(bad)


def test_formula_table(spark, rows):
    c = spark.createDataFrame([("b", "s", 1, 1, 10.0, None), ("b", "s", 4, 1, None, "oops"), ("b", "s", 5, 1, None, "12,5")], "book string, sheet string, row long, col long, num double, txt string")
    f = ["=SUM(B2:B4)+AVERAGE(2;4)", "=B2&\"x\"", "=B5+1", "=SUM(B2:B5)", "=B6*2", "=ROUND(-2.5,0)", "=PMT(0.05/12,60,10000)", "=B2/0", "=COUNT(B2:B4)", "=NOPE(1)", "=B2:B3", "=(2", "", "=FV(0.1;2;-100;0;1)", "=PV(0.1;2;-100)", "=\"a\"&TRUE", "=1=\"1\"", "=2^0.5^2"]
    table = spark.createDataFrame([("b", "s", i, x) for i, x in enumerate(f)], "book string, sheet string, formula_id long, formula string")
    got = {r["formula_id"]: (r["kind"], r["num"] if r["num"] is None else round(r["num"], 4), r["txt"]) for r in formulas.evaluate_formulas(table, c).collect()}
    assert [got[i] for i in range(len(f))] == [
        ("number", 13.0, None), ("text", None, "10x"), ("error", None, "'oops' is no number"), ("error", None, "'oops' is no number"), ("number", 25.0, None), ("number", -2.0, None), ("number", -188.7123, None), ("error", None, "division by zero"), ("number", 3.0, None),
        ("error", None, "unsupported function NOPE"), ("error", None, "a range is no result"), ("error", None, "expected ) at 'the end'"), ("error", None, "empty formula"), ("number", 231.0, None), ("number", 173.5537, None), ("text", None, "atrue"), ("bool", 0.0, None), ("number", 1.1892, None),
    ]


def test_range_aggregate_with_texts(spark, rows):
    c = spark.createDataFrame([("b", "s", 0, 0, 1.0, None), ("b", "s", 1, 0, None, "x")], "book string, sheet string, row long, col long, num double, txt string")
    f = spark.createDataFrame([("b", "s", "ok", "SUM", 0, 0, 0, 1), ("b", "s", "bad", "SUM", 0, 0, 1, 0)], "book string, sheet string, formula_id string, fn string, r0 long, c0 long, r1 long, c1 long")
    assert rows(formulas.range_aggregate(f, c), "formula_id", "value", "error") == [("bad", None, "x"), ("ok", 1.0, None)]


def test_rule_limits(spark):
    m = spark.createDataFrame([("b", "s", 1, i, 0, float(i + 1)) for i in range(4)] + [("b", "s", 2, 0, 0, None)], "book string, sheet string, rule long, row long, col long, num double")
    t = "array<struct<kind:string,value:double>>"
    r = spark.createDataFrame([("b", "s", 1, [("min", None), ("percentile", 25.0), ("percentile", 150.0), ("percent", 50.0), ("num", 9.0), ("formula", 1.0), ("percent", None)]), ("b", "s", 2, [("max", None), ("num", 3.0)])], f"book string, sheet string, rule long, thresholds {t}")
    assert {x["rule"]: x["limits"] for x in rules.rule_limits(m, r).collect()} == {1: [1.0, 1.75, 4.0, 2.5, 9.0, None, None], 2: [None, 3.0]}


def test_numbers_in_order(spark):
    from quire.ordering import in_order

    got = in_order(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(7), "k").collect()
    assert all(r["k"] == r["position"] for r in got) and len(got) == 1000


def test_rich_documents(spark):
    runs = spark.createDataFrame(
        [(1, 0, 0, "text", "Head_", None, None, True, False), (1, 1, 0, "text", " a", None, None, True, False), (1, 1, 1, "text", "b ", None, None, True, False), (1, 1, 2, "text", "c", None, "http://x (1)", False, True), (1, 1, 3, "image", "al|t", "i 1.png", "http://x (1)", None, None), (1, 1, 4, "tab", None, None, None, None, None), (1, 2, 0, "text", "# no", None, None, None, None), (1, 3, 0, "text", "one", None, None, None, None), (1, 4, 0, "text", "two", None, None, None, None), (1, 5, 0, "text", "three", None, None, None, None), (1, 7, 0, "text", "  ", None, None, None, None)],
        "doc_id long, ord long, run_ord long, kind string, text string, part string, link_target string, bold boolean, italic boolean",
    ).withColumns({"underline": F.lit(None).cast("boolean"), "strike": F.lit(None).cast("boolean")})
    blocks = spark.createDataFrame([(1, 0, 2, None, None, None, None), (1, 1, None, None, None, None, None), (1, 2, None, None, None, None, None), (1, 3, None, 5, 0, "3. ", None), (1, 4, None, 5, 1, "- ", None), (1, 5, None, 6, 0, "- ", None), (1, 6, None, None, None, None, 0), (1, 7, None, None, None, None, None)], "doc_id long, ord long, level int, num_id long, ilvl long, marker string, table_id int").withColumn("start", F.when(F.col("ord") == 3, 3))
    cells = spark.createDataFrame([(1, 0, 0, 0, 2, None, "h"), (1, 0, 1, 0, 1, None, "x\ny"), (1, 0, 1, 1, 1, None, "z")], "doc_id long, table_id int, row long, cell_ord long, grid_span int, v_merge string, text string").withColumn("jc", F.lit("right"))
    md = exports.document_markdown(blocks, runs, exports.table_markdown(cells)).first()["md"]
    assert md == "## **Head\\_**\n\n **ab** [*c*![al\\|t](i%201.png)](http://x%20%281%29)\t\n\n\\# no\n\n3. one\n  - two\n\n- three\n\n| h |  |\n| ---: | ---: |\n| x<br>y | z |"
    html = exports.document_html(blocks, runs, exports.table_html(cells)).first()["html"]
    assert html == '<h2><strong>Head_</strong></h2><p><strong> ab </strong><a href="http://x (1)"><em>c</em><img src="i 1.png" alt="al|t"></a><span class="tab"></span></p><p># no</p><ol start="3"><li>one<ul><li>two</li></ul></li></ol><ul><li>three</li></ul><table><tr><td colspan="2">h</td></tr><tr><td>x\ny</td><td>z</td></tr></table>'


def test_style_faults(spark, rows):
    long = [("d", "p", str(i), str(i + 1)) for i in range(40)] + [("d", "p", "40", None)]
    s = spark.createDataFrame([*long, ("d", "p", "a", "b"), ("d", "p", "b", "a"), ("d", "c", "a", "gone"), ("d", "c", "x", None), ("d", "c", "x", None)], "doc_id string, kind string, style_id string, based_on string")
    chains = documents.style_chains(s.where("kind = 'p'")).withColumn("kind", F.lit("p"))
    got = rows(documents.validate_styles(s, chains), "kind", "style_id", "warning")
    assert [g for g in got if g[2] != "TooDeep"] == [("c", "a", "MissingParent"), ("c", "x", "DuplicateStyle"), ("p", "a", "CyclicBasedOn")] and {g[1] for g in got if g[2] == "TooDeep"} == {str(i) for i in range(8)}
    n = spark.createDataFrame([("d", 7, 1), ("d", 8, 2)], "doc_id string, num_id long, abstract_id long")
    a = spark.createDataFrame([("d", 1)], "doc_id string, abstract_id long")
    u = spark.createDataFrame([("d", 7), ("d", 9), ("d", 0)], "doc_id string, num_id long")
    assert rows(documents.validate_numbering(n, a, u), "num_id", "warning") == [(8, "MissingAbstractNum"), (9, "MissingNum")]


def test_directions(spark):
    texts = ["abc", "שלום", "123 שלום", "\u0661\u0662 abc", "\u064Babc", "\u06F1x", "", None, "١٢٣ سلام"]
    got = [r[1] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", documents.base_direction(F.col("t"), F.lit(False)).alias("d")).orderBy("i").collect()]
    assert got == ["ltr", "rtl", "rtl", "ltr", "ltr", "ltr", "ltr", "ltr", "rtl"]


def test_delimited_faults_are_rows(spark, tmp_path):
    from quire.sources.delimited import delimited_cells, delimited_faults

    (tmp_path / "good.csv").write_text('a;"b;c"\r\n\r\n"x ""y""";z\r\n\r\n')
    got = delimited_cells(spark, str(tmp_path / "good.csv"))
    assert sorted((r["row"], r["col"], r["raw"]) for r in got.collect()) == [(0, 0, "a"), (0, 1, "b;c"), (2, 0, 'x "y"'), (2, 1, "z")]
    (tmp_path / "bad.csv").write_text('a,"b\n')
    (tmp_path / "pipe.csv").write_bytes('a\u2028b,5" pipe,c\x85d\r"x\r\ny","'.encode() + b"z" * 200_000 + b'"')
    assert [r["fault"] for r in delimited_faults(spark, str(tmp_path)).collect()] == ["unclosed quote"]
    got = delimited_cells(spark, str(tmp_path)).where("path LIKE '%pipe.csv'").collect()
    assert sorted((r["row"], r["col"], r["raw"]) for r in got) == [(0, 0, "a\u2028b"), (0, 1, '5" pipe'), (0, 2, "c\x85d"), (1, 0, "x\r\ny"), (1, 1, "z" * 200_000)]
    assert delimited_cells(spark, str(tmp_path)).where("path LIKE '%good.csv'").count() == 4


def test_rules(spark):
    m = spark.createDataFrame([("b", "s", 1, i, 0, float(i + 1)) for i in range(4)] + [("b", "s", 1, 4, 0, None)], "book string, sheet string, rule long, row long, col long, num double")
    t = rules.rule_thresholds(m, [0.25, 0.5, 1.0]).first()
    assert (t["p25"], t["p50"], t["p100"]) == (1.75, 2.5, 4.0)
    n, low, high = F.col("num"), F.lit(1.0), F.lit(4.0)
    red = [r[0] for r in m.orderBy("row").select(F.shiftright(rules.color_scale(n, low, F.lit(2.5), high, (0x000000, 0x7F8000 & 0xFF0000 | 0x7F0000, 0xFF0000)), 16)).collect()]
    assert red[0] == 0 and red[3] == 255 and red[4] is None
    ends = [r[0] for r in m.orderBy("row").select(F.round(rules.data_bar(n, low, high)["end"], 6)).collect()]
    assert ends == [0.0, 0.333333, 0.666667, 1.0, None]
    icons = [r[0] for r in m.orderBy("row").select(rules.icon_level(n, [F.lit(1.0), F.lit(1.99), F.lit(3.01)])).collect()]
    assert icons == [0, 1, 1, 2, None]
    back = [r[0] for r in m.orderBy("row").select(rules.icon_level(n, [F.lit(1.0), F.lit(1.99), F.lit(3.01)], reverse=True)).collect()]
    assert back == [2, 1, 1, 0, None]
    bar = spark.range(1).select(rules.data_bar(F.lit(-5.0), F.lit(-10.0), F.lit(10.0)).alias("x"), rules.data_bar(F.lit(3.0), F.lit(3.0), F.lit(3.0)).alias("y")).first()
    assert tuple(bar["x"]) == (0.25, 0.5) and tuple(bar["y"]) == (0.0, 1.0)


def test_stop_if_true(spark, rows):
    schema = "book string, sheet string, row long, col long, rule long, fired boolean, stop_if_true boolean, fill string, num_fmt string, bold boolean, visual string"
    fired = spark.createDataFrame([("b", "s", r, 0, 1, r == 0, True, "red", None, False, None) for r in (0, 1)] + [("b", "s", r, 0, 2, True, False, "blue", None, True, None) for r in (0, 1)], schema)
    assert rows(rules.effective_style(fired), "row", "fill", "bold") == [(0, "red", False), (1, "blue", True)]


def test_sort(spark):
    t = spark.createDataFrame([(i, k) for i, k in enumerate(["10", "9", "", "b2", "B10", "a"])], "i long, k string").withColumn("g", F.lit(1))
    order = lambda desc: [r["k"] for r in formulas.sort_range(t, "k", ["g"], "i", desc).orderBy("position").collect()]
    assert order(False) == ["9", "10", "a", "b2", "B10", ""]


def test_pivot_and_headers(spark, rows):
    t = spark.createDataFrame([("x", 1.0, "a", 0), ("y", 2.0, "b", 1), ("x", 3.0, "c", 2)], "g string, n double, t string, o long")
    got = rows(formulas.pivot_summary(t, "g", ["n", "t"], "o"), "position", "grp", "n", "t", "n_rows")
    assert got == [(-1, None, 6.0, 3.0, 3), (0, "x", 4.0, 2.0, 2), (1, "y", 2.0, 1.0, 1)]
    h = spark.createDataFrame([(1, i, x) for i, x in enumerate(["Name", "name", "", "Name"])], "table_id long, position long, text string")
    assert [r[1] for r in rows(formulas.table_headers(h), "position", "name")] == ["Name", "name2", "Column3", "Name3"]


def test_formulas(spark):
    t = spark.createDataFrame([(4.0, None)], "a double, b double")
    value = lambda f: t.select(formulas.evaluate(f, {"A1": F.col("a"), "B1": F.col("b")}).alias("x")).first()["x"]
    assert value("=A1*2+B1-10%") == 7.9 and value("=2^3/4") == 2.0 and value("=1/0") is None and value('="a"&"b"') == "ab" and value("=ROUND(2.5;0)") == 3.0


def test_axis_and_pie(spark, rows):
    s = spark.createDataFrame([("c", i, v) for i, v in enumerate([1.0, 0.0, -2.0, 3.0])], "chart string, idx long, value double")
    assert [(r[0], r[1]) for r in rows(formulas.pie_shares(s, ["chart"]), "idx", "share")] == [(0, 0.25), (3, 0.75)]
    flat = spark.createDataFrame([("c", i, 7.0) for i in range(3)], "chart string, idx long, value double")
    assert [r[1] for r in rows(formulas.chart_axis(flat, ["chart"], False), "tick", "at")] == [6.5, 6.75, 7.0, 7.25, 7.5]


def test_lists(spark):
    levels = spark.createDataFrame([(1, 1, i, "decimal", t, 1) for i, t in enumerate(["%1.", "%1.%2.", "%1.%2.%3."])], "doc_id long, num_id long, ilvl long, num_fmt string, lvl_text string, start long")
    blocks = spark.createDataFrame([(1, o, 1, i, "x") for o, i in enumerate([0, 1, 2, 1, 0])], "doc_id long, ord long, num_id long, ilvl long, text string")
    assert [r["marker"] for r in documents.number_lists(blocks, levels).orderBy("ord").collect()] == ["1.", "1.1.", "1.1.1.", "1.2.", "2."]


def test_runs_and_markdown(spark, rows):
    r = spark.createDataFrame([(1, 0, i, t, b) for i, (t, b) in enumerate([("a", True), ("b", True), ("c", False), ("d", True)])], "doc_id long, ord long, run_ord long, text string, bold boolean")
    assert [x[1] for x in rows(documents.merge_runs(r), "run_ord", "text")] == ["ab", "c", "d"]
    esc = spark.createDataFrame([("1. x",), ("# x",), ("a_b",)], "t string").select(documents.escape_markdown(F.col("t")).alias("e"))
    assert [x["e"] for x in esc.collect()] == ["\\1. x", "\\# x", "a\\_b"]


def test_table_cells(spark, rows):
    c = spark.createDataFrame([(1, 1, r, k, 1, "restart" if k == 0 and r == 0 else "continue" if k == 0 else None) for r in range(3) for k in range(2)], "doc_id long, table_id long, row long, cell_ord long, grid_span long, v_merge string")
    assert rows(documents.place_table_cells(c).where("start_col = 0"), "row", "row_span", "continuation") == [(0, 3, False), (1, 0, True), (2, 0, True)]


def test_rels(spark):
    rels = spark.createDataFrame([("p", "xl/worksheets/sheet1.xml", i, t, None) for i, t in (("1", "../media/image%201.png"), ("2", "/xl/a.xml"), ("3", "%ZZ"))], "pkg string, source_part string, id string, target string, target_mode string")
    got = {r["id"]: r["part"] for r in documents.resolve_rels(rels.select("pkg", "source_part", "id"), rels).collect()}
    assert got == {"1": "xl/media/image 1.png", "2": "xl/a.xml", "3": "xl/worksheets/%ZZ"}


def test_revisions(spark, rows):
    p = spark.createDataFrame([(1, i, m) for i, m in enumerate([True, True, False])], "doc_id long, ord long, del_mark boolean")
    r = spark.createDataFrame([(1, i, 0, f"p{i + 1}", None) for i in range(3)], "doc_id long, ord long, run_ord long, text string, rev_kind string")
    assert [x[1] for x in rows(edits.accept_revisions(p, r), "ord", "text")] == ["p1p2", "p3"]
    assert [x[1] for x in rows(edits.reject_revisions(p, r), "ord", "text")] == ["p1", "p2", "p3"]


def test_find_and_replace(spark):
    r = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "bab")], "doc_id long, ord long, run_ord long, text string")
    hit = edits.find_text(r, "ab").first()
    assert (hit["hits"], hit["first_run"]) == (2, 0)
    assert edits.replace_text(r, "ab", "X").first()["texts"] == ["XX", ""]


def test_mail_merge(spark):
    t = spark.createDataFrame([("L", "S")], "nameLong string, name string")
    assert edits.mail_merge("{{nameLong}} {{name}} «name»", t, ["name", "nameLong"]).first()["merged"] == "L S S"


def test_warnings(spark):
    same = spark.range(1500).selectExpr("1L AS doc_id", "'k' AS kind", "'m' AS message", "'l' AS location", "id AS ord")
    many = spark.range(101).selectExpr("2L AS doc_id", "'k' AS kind", "'m' AS message", "string(id) AS location", "id AS ord")
    worst = spark.range(1001).selectExpr("3L AS doc_id", "'k' AS kind", "'m' AS message", "string(id) AS location", "id AS ord")
    got = {r["doc_id"]: (r["n_unique"], r["n_total"], r["alert"], r["fatal"]) for r in corpus.summarise_warnings(same.union(many).union(worst)).collect()}
    assert got == {1: (1, 1500, False, False), 2: (101, 101, True, False), 3: (1001, 1001, True, True)}


def test_delimited(spark, tmp_path):
    from quire.sources.delimited import read_delimited, sniff_separator

    (tmp_path / "x.csv").write_text('a;b;"c ""q""\nd"\n;;\n1;2;3\n')
    assert sniff_separator(spark, str(tmp_path / "x.csv")) == ";"
    assert [tuple(r) for r in read_delimited(spark, str(tmp_path / "x.csv")).collect()] == [("a", "b", 'c "q"\nd'), ("1", "2", "3")]


def test_streams_equal_batches(spark, rows, tmp_path):
    from quire.operators.edits import CELL, latest_edits
    from quire.streaming import jobs

    schema = "book string, sheet string, row long, col long, text string, seq long, ts timestamp"
    source = str(tmp_path / "edits")
    for k in range(3):
        spark.range(20).selectExpr("'b' AS book", "'s' AS sheet", "id % 5 AS row", "0L AS col", f"concat('t', id + {k} * 20) AS text", f"id + {k} * 20 AS seq", f"timestamp_seconds(100 - {k}) AS ts").write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.stream_edits(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = jobs.read_latest(spark, str(tmp_path / "out"), CELL)
    assert rows(got, *CELL, "text", "n_edits") == rows(latest_edits(spark.read.parquet(source)), *CELL, "text", "n_edits")


def test_shifted_formulas(spark):
    assert sheets.shifted_formula('=A1+$B$2&"A1"+SUM(A2:A9)+LOG10(A3)', 1, 0, False, 1) == '=A1+$B$2&"A1"+SUM(A3:A10)+LOG10(A4)'
    c = spark.createDataFrame([("b", "s", 0, 0, "=C1+D2")], "book string, sheet string, row long, col long, formula string")
    o = spark.createDataFrame([("b", "s", 0, 1)], "book string, sheet string, o_row long, o_col long")
    assert sheets.shift_formulas(c, o, "left").first()["formula"] == "=B1+D2"


def test_header_collisions(spark):
    h = spark.createDataFrame([(1, i, x) for i, x in enumerate(["A", "A2", "a", "A"])], "table_id long, position long, text string")
    assert [r["name"] for r in formulas.table_headers(h).orderBy("position").collect()] == ["A", "A2", "a3", "A4"]


def test_rule_programs_share_shapes_and_keep_copies(spark, rows):
    from quire.operators import rule_formulas as R

    assert R.compiled("=A1>5")[0] == R.compiled("=$Q$77>0.25")[0] and R.compiled("=SUM(A1)") is None and R.compiled(None) is None and R.compiled("=A1:B2") is None and R.compiled("(" * 5000) is None
    assert [R.number_text(x) for x in (5.0, -0.0, 1e21, 1.5e-7, 12345678.25, 0.1)] == ["5", "0", "1" + "0" * 21, "0.00000015", "12345678.25", "0.1"]
    c = spark.createDataFrame([("b", "s", 0, 0, 5.0), ("b", "s", 0, 1, 7.0), ("b", "s", 9, 9, None)], "book string, sheet string, row long, col long, num double")
    f = ["=A1<B1", "=A1<B1", "=B1=A1", "=A1", None, "=J10=0", "=A1=$A$1", "=LEN(Z9)", "=\"1\"", "=MOD(\"x\",2)=0", "=MOD(\" 7 \",4)=3", "=ROW()"]
    m = spark.createDataFrame([("b", "s", 0, 0, 0, 0, x, 1.0) for x in f], "book string, sheet string, row long, col long, r0 long, c0 long, formula1 string, _n2 double")
    assert rows(R.expression_rules(m, c), "formula1", "fired") == sorted([("=A1<B1", True), ("=A1<B1", True), ("=B1=A1", False), ("=A1", True), (None, False), ("=J10=0", True), ("=A1=$A$1", True), ("=LEN(Z9)", False), ("=\"1\"", False), ("=MOD(\"x\",2)=0", False), ("=MOD(\" 7 \",4)=3", True), ("=ROW()", True)], key=repr)
    assert R.expression_rules(m.limit(0), c).count() == 0 and R.expression_rules(m, c.limit(0)).where("fired").count() == 5


def test_ten_thousand_distinct_rule_formulas(spark):
    import time

    from quire.operators import rule_formulas as R

    c = spark.range(100).selectExpr("'b' AS book", "'s' AS sheet", "id AS row", "0L AS col", "CAST(id AS DOUBLE) AS num")
    m = spark.range(20_000).selectExpr("'b' AS book", "'s' AS sheet", "id % 100 AS row", "0L AS col", "id % 100 AS r0", "0L AS c0", "concat('=A', id % 100 + 1, '>', id) AS formula1")
    began = time.perf_counter()
    assert R.expression_rules(m, c).where("fired").count() == 0  # no number exceeds its own formula's
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("few", [0, 10**9])
def test_box_totals_against_every_cell(spark, monkeypatch, few):
    import random

    from quire.operators import totals

    monkeypatch.setattr(totals, "BROADCAST_PIECES", few)
    rng = random.Random(3)
    cells = [(b, "s", r, c, rng.choice([None, float(rng.randrange(-50, 50))]), rng.choice([None] * 30 + ["x", "w"])) for b, h, w, n in (("a", 300, 40, 700), ("b", 5, 3, 9), ("c", 1, 1, 1)) for r, c in {(rng.randrange(h), rng.randrange(w)) for _ in range(n)}]
    boxes = []
    for _ in range(150):
        b, h, w = rng.choice([("a", 310, 45), ("b", 8, 5), ("c", 3, 3), ("none", 2, 2)])
        (r0, r1), (c0, c1) = sorted((rng.randrange(h), rng.randrange(h))), sorted((rng.randrange(w), rng.randrange(w)))
        boxes.append((b, "s", r0, c0, r1, c1))
    boxes += [("a", "s", 0, 0, 1_048_575, 16_383), ("a", "s", 0, 0, 255, 15), *boxes[:9]]
    got = totals.box_totals(spark.createDataFrame(boxes, "book string, sheet string, r0 long, c0 long, r1 long, c1 long"), spark.createDataFrame(cells, "book string, sheet string, row long, col long, num double, bad string")).collect()
    have = {tuple(r)[:6]: tuple(r)[6:] for r in got}
    assert len(have) == len(got)
    for box in set(boxes):
        inside = [c for c in cells if c[0] == box[0] and box[2] <= c[2] <= box[4] and box[3] <= c[3] <= box[5]]
        n = [c[4] for c in inside if c[4] is not None]
        want = (sum(n) if n else None, min(n, default=None), max(n, default=None), len(n), min((c[5] for c in inside if c[5]), default=None))
        assert have.get(box) == (want if inside else None), box


def test_rules_by_value_agree_with_columns(spark):
    import itertools

    from quire.operators import rule_formulas as R

    values = [("empty", None, None), ("number", 0.0, None), ("number", 2.0, None), ("text", None, ""), ("text", None, "aB"), ("bool", 1.0, None), ("error", None, "#N/A")]
    operators = ["equal", "notEqual", "lessThan", "lessThanOrEqual", "greaterThan", "greaterThanOrEqual", "between", "notBetween", "odd", None]
    t = "struct<kind:string,num:double,txt:string>"
    df = spark.createDataFrame([(o, *x) for o in operators for x in itertools.product(values, repeat=3)], f"operator string, cell {t}, a {t}, b {t}")
    both = df.select(R.value_rule_fires(F.lit("cellIs"), F.col("operator"), F.col("cell"), F.col("a"), F.col("b")).alias("x"), rules.cell_is_value(F.col("operator"), F.col("cell"), F.col("a"), F.col("b")).alias("y"), "operator", "cell", "a", "b")
    # a comparison that is undefined never fires, also where the other end alone would decide
    assert both.count() == 3430 and both.where("x <> y AND NOT (operator = 'notBetween' AND (a.kind = 'error' OR b.kind = 'error'))").collect() == []
    assert both.where("x AND (cell.kind = 'error' OR a.kind = 'error')").collect() == []


def test_merge_sweep_against_all_pairs(spark, rows):
    import random
    import time

    rng = random.Random(9)
    boxes = []
    for i in range(300):
        r, c = rng.randrange(3000), rng.randrange(200)
        boxes.append((rng.choice("xy"), "s", i, r, c, r + rng.choice([0, 1, 5, 2500]), c + rng.choice([0, 1, 40])))
    m = spark.createDataFrame(boxes, "book string, sheet string, merge long, r0 long, c0 long, r1 long, c1 long")
    want = sorted((a[0], "s", a[2], b[2]) for a in boxes for b in boxes if a[0] == b[0] and a[2] < b[2] and a[3] <= b[5] and b[3] <= a[5] and a[4] <= b[6] and b[4] <= a[6])
    assert rows(sheets.merge_conflicts(m)) == sorted(want, key=repr) and len(want) > 50
    assert sheets.merge_conflicts(m.limit(0)).count() == 0
    many = spark.range(100_000).selectExpr("'b' AS book", "'s' AS sheet", "id AS merge", "id % 1000 AS r0", "(id div 1000) * 3 AS c0", "id % 1000 AS r1", "(id div 1000) * 3 + 1 AS c1")
    began = time.perf_counter()
    assert sheets.merge_conflicts(many).count() == 0 and time.perf_counter() - began < 30


def test_places_in_large_groups(spark):
    from quire import ordering

    t = spark.range(900).selectExpr("id % 3 AS g", "CASE WHEN id % 7 = 0 THEN NULL ELSE id % 10 END AS v", "id AS i").where("g < 2 OR i < 30")
    order = [F.col("v").desc_nulls_last(), F.col("i")]
    a, b = (sorted(map(tuple, ordering.in_groups(t, ["g"], order, most=n).collect()), key=repr) for n in (100, 10_000))
    assert a == b and len(a) == 610


def test_headings_are_no_items(spark):
    b = spark.createDataFrame([(1, 0, 1, 0, "a", None), (1, 1, 1, 0, "Title", 1), (1, 2, 1, 0, "b", None)], "doc_id long, ord long, num_id long, ilvl long, text string, level int")
    lv = spark.createDataFrame([(1, 1, 0, "decimal", "%1.", 1)], "doc_id long, num_id long, ilvl long, num_fmt string, lvl_text string, start long")
    assert [(r["ord"], r["marker"]) for r in documents.number_lists(b, lv).orderBy("ord").collect()] == [(0, "1."), (2, "2.")]


def test_cell_line_is_the_cell_text_of_an_array_of_paragraphs(spark, rows):
    cells = spark.createDataFrame([(1, ["a\nb", " ", None, " c "]), (2, [""]), (3, ["x", "y"])], "k long, ps array<string>")
    old = documents.cell_text(cells.select("k", F.posexplode("ps").alias("ord", "text")), ["k"])
    new = cells.select("k", documents.cell_line(F.col("ps")).alias("text"))
    assert rows(new, "k", "text") == rows(old, "k", "text") == [(1, "a b  c "), (2, ""), (3, "x y")]


def test_text_with_tables_groups_no_single_cells(spark):
    import __spark_entry__

    plan = __spark_entry__.queries()["f2_text_with_tables"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and plan.count("explode") == 2
