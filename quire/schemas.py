"""Canonical tables: column lists that operators expect (extra columns are kept or ignored as documented)."""

CELLS = "book string, sheet string, row long, col long, vtype string, raw string, num double, txt string, formula string, num_fmt string, style long"
RULES = "book string, sheet string, rule long, r0 long, c0 long, r1 long, c1 long, priority long, stop_if_true boolean, kind string"
MERGES = "book string, sheet string, merge long, r0 long, c0 long, r1 long, c1 long"
DIMS = "book string, sheet string, idx long, width double, hidden boolean"
BLOCKS = "doc_id long, ord long, kind string, text string, num_id long, ilvl long, outline_lvl long, section_break boolean, del_mark boolean"
RUNS = "doc_id long, ord long, run_ord long, text string, bold boolean, rev_kind string"
EDITS = "book string, sheet string, row long, col long, text string, seq long, ts timestamp"

# Fixed values of the format.
MAX_ROW, MAX_COL = 1_048_575, 16_383
ERRORS = ("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A")
