"""The driver's tables as canonical tables, each with the same definition in SQL.

``cells``: one book per supplier, one sheet per return flag, a row per line,
four numeric columns.  Keys are spread over many books, so windows by book and
sheet stay small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
VALUES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines of one task, so that a task's sorts stay in memory however large the table is.
LINES_IN_TASK = 250_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over as many tasks as it has rows for; what groups by more columns stays where it is."""
    n = -(-df.count() // LINES_IN_TASK)  # of a stored table, whose footers tell it
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


#: Cells of one task where ranges are looked up, which sorts them.
CELLS_IN_TASK = 1_000_000


def cell_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that the cells are dealt over: as many as they have rows for, at least the configured ones."""
    n = len(VALUES) * read(spark, sf_dir, "lineitem").count()  # the footers tell it
    return max(-(-n // CELLS_IN_TASK), int(spark.conf.get("spark.sql.shuffle.partitions")))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with book, sheet and row."""
    row = F.row_number().over(W.partitionBy("book", "sheet").orderBy(*_ORDER))
    return dealt(named(spark, sf_dir), "book", "sheet").withColumn("row", row.cast("long") - 1)


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with book and sheet."""
    return read(spark, sf_dir, "lineitem").withColumns({"book": F.concat(F.lit("S"), F.col("l_suppkey").cast("string")), "sheet": F.col("l_returnflag")})


def sheet_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, sheet of all sheets."""
    return named(spark, sf_dir).select("book", "sheet").distinct()


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, sheet, row, col, num."""
    return lines(spark, sf_dir).select("book", "sheet", "row", F.posexplode(F.array(*VALUES)).alias("col", "num")).withColumn("col", F.col("col").cast("long"))


def sparse_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that hold something: no discount and no tax are blanks."""
    return cells(spark, sf_dir).where("num != 0")


LINES_SQL = """lines AS (
  SELECT *, 'S' || l_suppkey AS book, l_returnflag AS sheet,
    row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS row FROM lineitem)"""
CELLS_SQL = LINES_SQL + """, cells AS (
  SELECT book, sheet, row, 0::BIGINT AS col, l_quantity AS num FROM lines UNION ALL SELECT book, sheet, row, 1, l_extendedprice FROM lines
  UNION ALL SELECT book, sheet, row, 2, l_discount FROM lines UNION ALL SELECT book, sheet, row, 3, l_tax FROM lines)"""
SPARSE_SQL = CELLS_SQL + ", sparse AS (SELECT * FROM cells WHERE num <> 0)"


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ord, text: the lines of documents as paragraphs."""
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text")).withColumn("ord", F.col("ord").cast("long"))


PARAGRAPHS_SQL = """paragraphs AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS ord, unnest(string_split(text, chr(10))) AS text FROM documents)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ord, run_ord, text, bold: conversations as one paragraph per conversation and one run per turn, bold by role."""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(0).cast("long").alias("ord"), F.col("turn").alias("run_ord"), "text", (F.col("role") == "assistant").alias("bold"))


RUNS_SQL = "runs AS (SELECT conv_id AS doc_id, 0 AS ord, turn AS run_ord, text, role = 'assistant' AS bold FROM conversations)"


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, sheet, row, col, text, seq, ts: events as edits of the cell of their user and type."""
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("U"), (F.col("user_id") % 7).cast("string")).alias("book"), F.col("event_type").alias("sheet"), F.col("user_id").alias("row"), (F.col("event_id") % 3).alias("col"), F.col("value").cast("string").alias("text"), F.col("event_id").alias("seq"), "ts"
    )


EDITS_SQL = "edits AS (SELECT 'U' || (user_id % 7) AS book, event_type AS sheet, user_id AS row, event_id % 3 AS col, value::VARCHAR AS text, event_id AS seq, ts FROM events)"
