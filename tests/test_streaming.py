"""Streaming sinks: restart in the middle, size after many batches."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from quire.operators.edits import CELL, latest_edits
from quire.streaming import jobs

SCHEMA = "book string, sheet string, row long, col long, text string, seq long, ts timestamp"


def add(spark, source, k):
    spark.range(12).selectExpr("'b' AS book", "'s' AS sheet", "id % 5 AS row", "0L AS col", f"concat('t', id + {k} * 12) AS text", f"id + {k} * 12 AS seq", f"timestamp_seconds(100 + {k % 4}) AS ts").coalesce(1).write.mode("append").parquet(source)


def test_sink_is_compacted_and_survives_restarts(spark, tmp_path, rows):
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    folders = []
    for k in range(9):  # each call is a query that goes on where the last one ended
        add(spark, source, k)
        jobs.stream_edits(spark.readStream.schema(SCHEMA).parquet(source), out, cp, compact=2).awaitTermination()
        folders.append(len(os.listdir(out)))
    assert max(folders) <= 2 + 2 * 2 + 1 and sum(x.startswith("base=") for x in os.listdir(out)) <= 2
    want = rows(latest_edits(spark.read.parquet(source)), *CELL, "text", "n_edits")
    assert rows(jobs.read_latest(spark, out, CELL), *CELL, "text", "n_edits") == want


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path, rows):
    out = str(tmp_path / "out")
    write = jobs._upsert(out, ["k"], 2)
    batch = lambda k, v: spark.createDataFrame([(k, v)], "k long, v long")
    for epoch, (k, v) in enumerate([(1, 10), (2, 20), (1, 11), (1, 12)]):
        write(batch(k, v), epoch)
        write(batch(k, v), epoch)  # the driver was lost before the batch was noted as done
        assert dict(rows(jobs.read_latest(spark, out, ["k"])))[k] == v
    os.makedirs(f"{out}/base=99")  # a merge that did not end
    assert rows(jobs.read_latest(spark, out, ["k"])) == [(1, 12), (2, 20)]


def test_warning_counts_after_merges(spark, tmp_path, rows):
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for k in range(5):
        spark.range(6).select((F.col("id") % 2).alias("doc_id"), F.lit("k").alias("kind"), F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("message"), F.lit("l").alias("location"), (F.col("id") + 10 * k).alias("ord")).coalesce(1).write.mode("append").parquet(source)
        jobs.stream_warnings(spark.readStream.schema("doc_id long, kind string, message string, location string, ord long").parquet(source), out, cp, compact=2).awaitTermination()
    assert rows(jobs.warning_totals(spark, out)) == [(0, 3, 15), (1, 3, 15)]
