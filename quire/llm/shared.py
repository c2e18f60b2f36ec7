"""Tables that cut lineage, and small helpers that several operators use."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.lineage import checkpoint, shared_folder, shuffles_dropped

__all__ = ["ROW", "arrow_rows", "checkpoint", "documents", "drop_table", "numbered", "only", "shared_folder", "table", "written"]

#: So many document ids (8 bytes each) are broadcast at most.
BROADCAST_IDS = 2_000_000

#: Column of row keys, see :func:`numbered`; made for each process, so that no table has it.
ROW = f"__row_{uuid.uuid4().hex}"

_written: list[str] = []


def table(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Later stages then depend on files that every executor sees, not on shuffle
    files of an executor that may be lost.  A table that is not to be kept is
    on the list of :func:`written`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quire-{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    if not keep:
        _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df_or_path, spark: SparkSession | None = None) -> None:
    """Delete a table of :func:`table` that nothing will read again."""
    spark = spark or df_or_path.sparkSession
    paths = [df_or_path] if isinstance(df_or_path, str) else {p.rsplit("/", 1)[0] for p in df_or_path.inputFiles()}
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _written[:] = [x for x in _written if not path.endswith(x.split(":", 1)[-1])]


def written() -> list[str]:
    """Tables that nobody has dropped yet, oldest first."""
    return list(_written)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a key ``ROW`` of each row, written once, so that a row keeps its key however often it is read."""
    return table(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def only(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows of ``docs`` whose ``key`` is in ``ids``, the other rows).

    Up to ``BROADCAST_IDS`` ids are broadcast, so texts stay where they are;
    more are joined by a shuffle.
    """
    own = f"__{uuid.uuid4().hex}"  # no column of docs has this name
    ids = ids.select(F.col(ids.columns[0]).alias(own)).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    same = F.col(key).eqNullSafe(F.col(own))
    return docs.join(ids, same, "left_semi"), docs.join(ids, same, "left_anti")


@contextmanager
def arrow_rows(spark: SparkSession, most: int):
    """Arrow batches of at most ``most`` rows for actions inside the block: rows that hold large values."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id long, text string, ``others``), null text as empty; other columns go."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), *others)
