"""Edits, tracked revisions, search and mail merge."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators.documents import joined

CELL = ["book", "sheet", "row", "col"]


def latest_edits(edits: DataFrame) -> DataFrame:
    """The last text written to each cell, by time, then sequence; an empty text is an edit."""
    return edits.groupBy(*CELL).agg(F.max_by("text", F.struct("ts", "seq")).alias("text"), F.count(F.lit(1)).alias("n_edits"))


def apply_edits(cells: DataFrame, latest: DataFrame) -> DataFrame:
    """cells (with ``shown``) and edited cells that are not stored; the edit changes the shown text only."""
    return cells.join(latest.select(*CELL, F.col("text").alias("_t")), CELL, "full_outer").withColumn("shown", F.coalesce("_t", "shown")).withColumn("edited", F.col("_t").isNotNull()).drop("_t")


def apply_run_edits(runs: DataFrame, edits: DataFrame) -> DataFrame:
    """runs with edits (doc_id, par, run, text) by place; edits without a run come back as error rows."""
    placed = runs.withColumns({"par": F.dense_rank().over(W.partitionBy("doc_id").orderBy("ord")) - 1, "run": F.row_number().over(W.partitionBy("doc_id", "ord").orderBy("run_ord")) - 1})
    keys = ["doc_id", "par", "run"]
    return placed.select(*keys, "text").join(edits.select(*keys, F.col("text").alias("_t")), keys, "full_outer").select(*keys, F.coalesce("_t", "text").alias("text"), F.when(F.col("text").isNull(), F.lit("out of range")).alias("error"))


def accept_revisions(paragraphs: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, ord, text after all revisions are taken.

    Deleted and moved-away runs go.  A deleted paragraph mark pulls the next
    paragraph in, pairwise: in a chain of deleted marks every other one acts.
    """
    w = W.partitionBy("doc_id").orderBy("ord")
    chain = paragraphs.withColumn("_c", F.col("ord") - F.sum(F.col("del_mark").cast("int")).over(w))
    place = F.row_number().over(W.partitionBy("doc_id", "_c", "del_mark").orderBy("ord"))
    acting = chain.withColumn("_acts", F.col("del_mark") & (place % 2 == 1))
    target = acting.withColumn("_to", F.when(F.lag("_acts", 1, False).over(w), F.lag("ord").over(w)).otherwise(F.col("ord"))).select("doc_id", "ord", "_to")
    live = runs.where("coalesce(rev_kind, '') NOT IN ('del', 'moveFrom')")
    text = target.join(live, ["doc_id", "ord"], "left").groupBy("doc_id", "_to").agg(joined(F.coalesce("text", F.lit("")), "", "ord", "run_ord").alias("text"))
    return text.withColumnRenamed("_to", "ord")


def reject_revisions(paragraphs: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, ord, text as before all revisions: inserted and moved-in runs go, deleted text is back."""
    live = runs.where("coalesce(rev_kind, '') NOT IN ('ins', 'moveTo')")
    return paragraphs.select("doc_id", "ord").join(live, ["doc_id", "ord"], "left").groupBy("doc_id", "ord").agg(joined(F.coalesce("text", F.lit("")), "", "run_ord").alias("text"))


def resolve_table_revisions(cells: DataFrame, accept: bool) -> DataFrame:
    """table cells (rev_kind of the cell, row_rev_kind of its row) after all revisions are taken, or as before them.

    Deleted rows and cells go when revisions are accepted, inserted ones when
    they are rejected; the rows that are left are numbered anew from 0.
    """
    gone = ("del", "moveFrom") if accept else ("ins", "moveTo")
    live = cells.where(~F.coalesce("rev_kind", F.lit("")).isin(*gone) & ~F.coalesce("row_rev_kind", F.lit("")).isin(*gone))
    row = F.dense_rank().over(W.partitionBy("doc_id", "table_id").orderBy("row")) - 1
    return live.withColumn("row", row.cast("long")).drop("rev_kind", "row_rev_kind")


def resolve_property_changes(items: DataFrame, props: list[str], accept: bool) -> DataFrame:
    """items with ``props`` as they are, or as recorded in ``prev_<prop>`` where ``changed``; the records are dropped."""
    out = items
    if not accept:
        out = out.withColumns({p: F.when(F.coalesce("changed", F.lit(False)), F.col(f"prev_{p}")).otherwise(F.col(p)) for p in props})
    return out.drop("changed", *[f"prev_{p}" for p in props])


def occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping, case-sensitive count."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def find_text(runs: DataFrame, needle: str) -> DataFrame:
    """doc_id, ord, hits, first_run: hits over the joined paragraph, and the run where the first one starts."""
    w = W.partitionBy("doc_id", "ord").orderBy("run_ord").rowsBetween(W.unboundedPreceding, -1)
    placed = runs.withColumn("_from", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)))
    text = placed.groupBy("doc_id", "ord").agg(joined(F.col("text"), "", "run_ord").alias("text"))
    hit = text.withColumns({"hits": occurrences(F.col("text"), needle), "_at": F.locate(needle, "text") - 1}).where("hits > 0").drop("text")
    at = placed.join(hit, ["doc_id", "ord"]).where("_from <= _at AND _at < _from + length(text)")
    return at.groupBy("doc_id", "ord", "hits").agg(F.min("run_ord").alias("first_run"))


def replace_text(runs: DataFrame, needle: str, replacement: str, every: bool = True) -> DataFrame:
    """doc_id, ord, texts: run texts after replacing all hits of a paragraph, or only the first of a document (``every`` false).

    The replacement goes to the run where the hit starts (on a border: the
    earlier run), the runs below it lose their part.
    """
    pars = runs.groupBy("doc_id", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("run_ord", "text"))), lambda x: x["text"]).alias("texts"))

    def replaced(column: pd.Series, most: int) -> pd.Series:
        def one(texts) -> list[str]:
            texts, start, done_ = list(texts), 0, 0
            while done_ < most:
                done_ += 1
                at = "".join(texts).find(needle, start)
                if at < 0:
                    return texts
                left, out, done = at, [], False
                rest = len(needle)
                for t in texts:
                    if not done and left <= len(t):
                        cut = min(len(t) - left, rest)
                        out.append(t[:left] + replacement + t[left + cut :])
                        rest, done = rest - cut, True
                    elif done and rest:
                        cut = min(len(t), rest)
                        out.append(t[cut:])
                        rest -= cut
                    else:
                        left -= 0 if done else len(t)
                        out.append(t)
                texts, start = out, at + len(replacement)
            return texts

        return column.map(one)

    @F.pandas_udf("array<string>")
    def run(column: pd.Series) -> pd.Series:
        return replaced(column, 2**31)

    @F.pandas_udf("array<string>")
    def once(column: pd.Series) -> pd.Series:
        return replaced(column, 1)

    if every:
        return pars.select("doc_id", "ord", run("texts").alias("texts"))
    hit = F.locate(needle, F.array_join("texts", "")) > 0
    first = F.min(F.when(hit, F.col("ord"))).over(W.partitionBy("doc_id"))
    marked = pars.withColumn("_first", first)
    return marked.select("doc_id", "ord", F.when(F.col("ord") == F.col("_first"), once("texts")).otherwise(F.col("texts")).alias("texts"))


def mail_merge(template: str, records: DataFrame, fields: list[str]) -> DataFrame:
    """records plus merged: ``{{field}}`` and ``«field»`` filled in, longest field names first."""
    text = F.lit(template)
    for f in sorted(fields, key=lambda x: (-len(x), x)):
        value = F.coalesce(F.col(f).cast("string"), F.lit(""))
        text = F.replace(F.replace(text, F.lit("{{" + f + "}}"), value), F.lit("«" + f + "»"), value)
    return records.withColumn("merged", text)
