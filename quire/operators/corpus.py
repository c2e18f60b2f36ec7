"""Jobs over a corpus: inputs, plans, warnings, diffs, timings, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.ordering import in_order

# File extensions by kind, and the output formats each kind may become.
EXTENSIONS = {"xlsx": "sheet", "xlsm": "sheet", "ods": "sheet", "xlsb": "sheet", "docx": "document", "odt": "document", "pptx": "deck", "odp": "deck"}
OUTPUTS = {"sheet": ("pdf",), "document": ("html", "md", "txt"), "deck": ("html", "md", "txt")}


def classify_format(paths: DataFrame, fmt: str) -> DataFrame:
    """paths plus ext, kind (null if foreign) and legal: whether that kind can become ``fmt``."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.coalesce(*[F.when(ext == e, F.lit(k)) for e, k in EXTENSIONS.items()])
    return paths.withColumns({"ext": ext, "kind": kind, "legal": F.coalesce(kind.isin(*[k for k, v in OUTPUTS.items() if fmt in v]), F.lit(False))})


def plan_jobs(paths: DataFrame, fmt: str, existing: DataFrame | None = None, force: bool = False) -> DataFrame:
    """path, output, problem: two inputs of one output, or an output that exists and is not to be overwritten."""
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "")
    planned = paths.withColumn("output", F.concat(name, F.lit(f".{fmt}")))
    out = planned.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("output"))).withColumn("problem", F.when(F.col("_n") > 1, "collision")).drop("_n")
    if existing is not None and not force:
        there = existing.select("output", F.lit(True).alias("_e")).distinct()
        out = out.join(there, "output", "left").withColumn("problem", F.coalesce("problem", F.when(F.col("_e"), F.lit("exists")))).drop("_e")
    return out


def summarise_warnings(warnings: DataFrame, many: int = 100, fatal: int = 1000) -> DataFrame:
    """doc_id, unique and total warnings, alert (over ``many``), fatal (any warning after ``fatal`` unique ones)."""
    key = ["doc_id", "kind", "message", "location"]
    once = warnings.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"), F.max("ord").alias("last"))
    k = F.row_number().over(W.partitionBy("doc_id").orderBy("ord"))
    ranked = once.withColumn("_k", k)
    limit = F.max(F.when(F.col("_k") == fatal, F.col("ord")))
    out = ranked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_unique"), F.sum("n").alias("n_total"), limit.alias("_limit"), F.max("last").alias("_last"))
    return out.select("doc_id", "n_unique", "n_total", (F.col("n_unique") > many).alias("alert"), F.coalesce(F.col("_last") > F.col("_limit"), F.lit(False)).alias("fatal"))


def diff_extractions(left: DataFrame, right: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, verdict: match if the paragraph lists are equal, else the known class, else unclassified."""
    both = left.select("doc_id", "pos", F.col("text").alias("a")).join(right.select("doc_id", "pos", F.col("text").alias("b")), ["doc_id", "pos"], "full_outer")
    same = both.groupBy("doc_id").agg(F.bool_and(F.col("a").eqNullSafe(F.col("b"))).alias("same"), F.count(F.lit(1)).alias("n"))
    return same.join(known.select("doc_id", "cls"), "doc_id", "left").select("doc_id", "n", F.when(F.col("same"), "match").otherwise(F.coalesce("cls", F.lit("unclassified"))).alias("verdict"))


def diff_gate(verdicts: DataFrame, ratio: float = 0.95, least: int = 50, non_goals: int = 8) -> DataFrame:
    """One row: counts, ratio, list of failures."""
    n = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    one = verdicts.agg(F.count(F.lit(1)).alias("n_docs"), n("match").alias("n_match"), n("non-goal").alias("n_non_goal"), n("bug").alias("n_bug"), n("unclassified").alias("n_unclassified"))
    share = F.coalesce(F.try_divide(F.col("n_match"), F.col("n_docs") - F.col("n_non_goal")), F.lit(0.0))
    fails = F.array_compact(F.array(F.when(share < ratio, "ratio"), F.when(F.col("n_docs") < least, "few"), F.when(F.col("n_non_goal") > non_goals, "non-goals"), F.when(F.col("n_bug") > 0, "bugs"), F.when(F.col("n_unclassified") > 0, "unclassified")))
    return one.withColumns({"ratio": share, "failures": F.array_join(fails, ",")})


def markup_counts(pages: DataFrame, needles: dict[str, str]) -> DataFrame:
    """page_id and the number of occurrences of each needle in html."""
    count = lambda s: ((F.length("html") - F.length(F.replace("html", F.lit(s), F.lit("")))) / len(s)).cast("long")
    return pages.select("page_id", *[count(s).alias(name) for name, s in needles.items()])


def timing_stats(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, min, nearest-rank median and 95th percentile, max."""
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")
    return samples.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), disc(0.5).alias("median"), disc(0.95).alias("p95"), F.max(value).alias("high"))


def compare_engines(stats: DataFrame, a: str, b: str) -> DataFrame:
    """file, speedup (median of a over median of b) for files of both engines, and whether it is the overall (upper) median."""
    side = lambda e, name: stats.where(F.col("engine") == e).select("file", F.col("median").alias(name), F.col("out_bytes").alias(f"o_{name}"))
    both = side(a, "a").join(side(b, "b"), "file").where("least(o_a, o_b) * 2 >= greatest(o_a, o_b)")
    ranked = both.select("file", (F.col("a") / F.col("b")).alias("speedup"))
    placed = in_order(ranked, "speedup", "file", name="_k")
    n = placed.agg(F.count(F.lit(1)).alias("_n"))  # one row
    return placed.crossJoin(F.broadcast(n)).select("file", "speedup", (F.col("_k") == F.floor(F.col("_n") / 2)).alias("is_median"))


# The layer that each diagnostic code belongs to, and the codes after which a retry can help.
LAYERS = {
    "malformed-package": "parse", "encrypted": "parse", "limit-exceeded": "parse", "layout-failed": "layout", "render-failed": "render", "transport-unavailable": "transport", "export-failed": "export", "io-failed": "export",
    "unsupported-format": "orchestration", "cancelled": "orchestration", "internal": "internal",
}
RETRYABLE = ("cancelled", "transport-unavailable")


def diagnostics(results: DataFrame) -> DataFrame:
    """results (code) plus layer and retryable; an unknown code is internal, no code has neither."""
    code = F.when(F.col("code").isin(*LAYERS), F.col("code")).when(F.col("code").isNotNull(), "internal")
    layer = F.coalesce(*[F.when(code == c, F.lit(x)) for c, x in LAYERS.items()])
    return results.withColumns({"layer": layer, "retryable": code.isin(*RETRYABLE)})


def batch_summary(results: DataFrame) -> DataFrame:
    """Totals by format, and over all (null): ok, failed, those of the failed that a retry can help (where results have codes), bytes and milliseconds."""
    again = [F.count(F.when(~F.col("ok") & F.col("retryable"), 1)).alias("n_retryable")] if "code" in results.columns else []
    rows = diagnostics(results) if again else results
    return rows.rollup("format").agg(F.count(F.when(F.col("ok"), 1)).alias("n_ok"), F.count(F.when(~F.col("ok"), 1)).alias("n_failed"), *again, F.sum("bytes").alias("bytes"), F.sum("ms").alias("ms"))


def cell_set_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has (with their number of times), and on which side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
