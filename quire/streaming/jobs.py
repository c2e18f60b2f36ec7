"""Incremental forms of batch operators, as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators.edits import CELL
from quire.sources.packages import check_parts, parts_of


#: A sink's batches are merged into a new base when so many have come since the last one.
COMPACT = 8


def _versions(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """(whole bases, batches) of a sink, by number."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"base": [], "epoch": []}
    for status in fs.listStatus(root) if fs.exists(root) else ():
        kind, _, number = status.getPath().getName().partition("=")
        if kind in found and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found[kind].append(int(number))
    return sorted(found["base"]), sorted(found["epoch"])


def _merged(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    bases, epochs = _versions(spark, path)
    base = bases[-1] if bases else -1
    tables = [(f"base={base}", base)] if bases else []
    tables += [(f"epoch={e}", e) for e in epochs if e > base]
    rows = None
    for name, number in tables:
        one = spark.read.parquet(f"{path}/{name}").withColumn("_epoch", F.lit(number))
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        raise FileNotFoundError(f"nothing is stored in {path}")
    others = [c for c in rows.columns if c not in (*keys, "_epoch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "_epoch").alias("x")).select(*keys, "x.*")


def _upsert(path: str, keys: list[str], compact: int):
    """Each batch's state rows as a version of the sink, written anew when a batch runs again; the last version of a key is its value.

    After ``compact`` batches all versions are merged into a base.  What the
    base before the last one needed is then deleted, so the sink stays within
    two bases and two rounds of batches, and a reader that began before a merge
    still finds its files.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        bases, epochs = _versions(spark, path)
        last = bases[-1] if bases else -1
        if epoch <= last or sum(e > last for e in epochs) < compact:
            return
        _merged(spark, path, keys).write.mode("overwrite").parquet(f"{path}/base={epoch}")
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for name in [f"base={b}" for b in bases if b < last] + [f"epoch={e}" for e in epochs if e <= last]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(root, name), True)

    return write


_WARNING = ["doc_id", "kind", "message", "location"]


def stream_edits(edits: DataFrame, out: str, checkpoint: str, compact: int = COMPACT) -> StreamingQuery:
    """The last text per cell by time, then sequence, kept as state; both are in the row, so late rows are right without a watermark."""
    state = edits.groupBy(*CELL).agg(F.max_by("text", F.struct("ts", "seq")).alias("text"), F.count(F.lit(1)).alias("n_edits"))
    return state.writeStream.outputMode("update").foreachBatch(_upsert(out, list(CELL), compact)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The last version of each key in a sink of :func:`stream_edits` or :func:`stream_warnings`: its base and the batches since."""
    return _merged(spark, out, keys)


def stream_warnings(warnings: DataFrame, out: str, checkpoint: str, compact: int = COMPACT) -> StreamingQuery:
    """Counts and first and last place per warning, kept as state."""
    state = warnings.groupBy(*_WARNING).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"), F.max("ord").alias("last"))
    return state.writeStream.outputMode("update").foreachBatch(_upsert(out, _WARNING, compact)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def warning_totals(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, n_unique, n_total from the state of :func:`stream_warnings`."""
    latest = read_latest(spark, out, _WARNING)
    return latest.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_unique"), F.sum("n").alias("n_total"))


def stream_ingest(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Packages that arrive in a folder, each once, as checked parts; a bad file becomes a diagnostic row.

    A batch has a folder of its own that is written anew when the batch runs
    again, so nothing is there twice.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def write(batch: DataFrame, epoch: int) -> None:
        check_parts(parts_of(batch.select("path", "content"))).drop("bytes").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
