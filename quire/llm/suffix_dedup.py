"""Repeated passages by a logarithmic family of sampled suffix arrays.

A byte is removed if a 200-byte string over it starts anywhere else in the
corpus.  A full suffix array has an entry per byte; here only the suffixes that
start at *anchors* are kept, about one in 64.  Every 200-byte window has one
anchor, found from its own bytes alone, so equal windows have equal anchors at
equal places, and nothing is lost.

The corpus comes in batches.  Each batch gets its own array: one entry for each
distinct 73-byte beginning of its suffixes, with its number of places and the
first of them, in the order of the first eight bytes and then of a hash of all
73.  The array is merge-scanned against every level of the family (a sort-merge
join of tables that are dealt and sorted alike, so nothing is shuffled):
suffixes of both that agree in 73 bytes are matches.  Then it becomes a level,
and two levels of one rank merge into one of the next, so n batches are merged
log n times each.  Levels are stored tables: a later batch is matched against
them without reading their texts again.

Places of matched suffixes are looked up in the texts.  The *stretch* of bytes
under all windows of an anchor decides: equal stretches repeat as a whole;
different stretches of one anchor are cut out and compared window by window.
Stretches and windows are equal if two independent 64-bit hashes are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.kernels import U64, anchors, heads, mix, prefix_sums, segments, slice_hash, text_buffer
from quire.llm.shared import BROADCAST_IDS, ROW, checkpoint, documents, drop_table, numbered, only, shared_folder, table

WINDOW = 200
GRAM = 73
BATCHES = 4
#: Anchors with more different stretches than this are compared through sorted rows, one per window.
STRETCHES_IN_TASK = 4096
SUFFIX = ["head", "gram"]


def _anchors(batch: pa.RecordBatch, window: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(bytes, anchor hash, its place in the bytes, row, first window in the text, windows) of each scanned segment of (row, text)."""
    raw, offsets = text_buffer(batch.column(1))
    rows = batch.column(0).to_numpy(zero_copy_only=False)
    for low, high, i, j in segments(offsets, window):
        own = raw[low:high]
        key, at, first, count = anchors(own, offsets[i + 1 : j] - low, window, gram)
        doc = np.searchsorted(offsets, first + low, side="right") - 1
        yield own, key, at, first, rows[doc].astype(np.int64), first + low - offsets[doc], count


def suffixes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """head, gram, n, row, start: sampled suffixes of ``docs`` (row, text), equal ones of a segment as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, key, at, _, row, start, _ in _anchors(batch, window, gram):
                unique, first, n = np.unique(key, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(heads(own, at[first])), pa.array(unique.view(np.int64)), pa.array(n), pa.array(row[first]), pa.array(start[first])], names=["head", "gram", "n", "row", "start"])

    return docs.select(ROW, "text").mapInArrow(run, "head long, gram long, n long, row long, start long")


def stretches_of(docs: DataFrame, matched: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """gram, stretch_a, stretch_b, row, start, windows: all places of the suffixes in ``matched`` (gram), with two hashes of their stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, key, at, first, row, start, count in _anchors(batch, window, gram):
                place = mix((count << 16 | (at - first)).astype(U64))
                hashes = [mix(slice_hash(*prefix_sums(own, other), first, first + count - 1 + window) ^ place) for other in (False, True)] if len(key) else [key, key]
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (key, *hashes, row, start, count)], names=["gram", "stretch_a", "stretch_b", "row", "start", "windows"])

    found = docs.select(ROW, "text").mapInArrow(run, "gram long, stretch_a long, stretch_b long, row long, start long, windows long")
    return found.join(F.broadcast(matched) if matched.count() <= BROADCAST_IDS else matched, "gram", "left_semi")


class IndexFamily:
    """Sampled suffix arrays (head, gram, n, row, start) of geometrically growing rank, as tables bucketed by suffix."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, str] = {}

    def add(self, batch: DataFrame) -> DataFrame:
        """The matches (gram) of a batch (:func:`suffixes`) in itself and with all batches before; its array joins the family."""
        first = F.min(F.struct("row", "start"))
        new = self._stored(batch.repartition(self.buckets, *SUFFIX).groupBy(*SUFFIX).agg(F.sum("n").alias("n"), first.alias("x")).select(*SUFFIX, "n", "x.row", "x.start"))
        array = self.spark.table(new)
        matches = array.where("n > 1").select("gram")
        for level in self.levels.values():
            matches = matches.unionByName(array.join(self.spark.table(level), SUFFIX, "left_semi").select("gram"))
        matches = checkpoint(matches.distinct())
        rank = 0
        while rank in self.levels:
            old = self.levels.pop(rank)
            merged = self._stored(self._merged(self.spark.table(old), self.spark.table(new)))
            for name in (old, new):
                self._drop(name)
            rank, new = rank + 1, merged
        self.levels[rank] = new
        return matches

    @staticmethod
    def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
        left = a.select(*SUFFIX, F.col("n").alias("n_a"), F.struct("row", "start").alias("a"))
        right = b.select(*SUFFIX, F.col("n").alias("n_b"), F.struct("row", "start").alias("b"))
        both = left.join(right, SUFFIX, "full_outer")
        return both.select(*SUFFIX, (F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0))).alias("n"), F.least("a", "b").alias("x")).select(*SUFFIX, "n", "x.row", "x.start")

    def _stored(self, array: DataFrame) -> str:
        name = f"quire_suffixes_{uuid.uuid4().hex}"
        array.write.bucketBy(self.buckets, *SUFFIX).sortBy(*SUFFIX).option("compression", "zstd").option("path", f"{shared_folder(self.spark)}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_table(f"{shared_folder(self.spark)}/{name}", self.spark)

    def close(self) -> None:
        """Drop all levels."""
        while self.levels:
            self._drop(self.levels.popitem()[1])


_SPAN = "row long, start long, end long"


def _runs(doc: np.ndarray, at: np.ndarray, window: int) -> pa.RecordBatch:
    """Spans of repeated windows, windows that follow each other as one."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)]) if len(doc) else np.zeros(0, bool))
    last = np.concatenate([first[1:], [len(doc)]]).astype(np.int64) - 1
    last = last[: len(first)]
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(at[first]), pa.array(at[last] + window)], names=["row", "start", "end"])


def _cut_out(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """gram, n, row, start, bytes of each wanted stretch (row, gram, n, start, windows)."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("gram", "n", "start", "windows")).alias("asked"))  # at most one per byte of the text
    rows = docs.join(lists, F.col(ROW) == F.col("row")).select(F.encode("text", "UTF-8").alias("raw"), "row", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, row, asked in zip(*(c.to_pylist() for c in batch.columns)):
                out.extend((x["gram"], x["n"], row, x["start"], raw[x["start"] : x["start"] + x["windows"] + window - 1]) for x in asked)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["gram", "n", "row", "start", "bytes"])

    return rows.mapInArrow(run, "gram long, n long, row long, start long, bytes binary")


def _windows(batch: pa.RecordBatch, window: int) -> tuple[np.ndarray, ...]:
    """gram, n, row, start and two hashes of every window of the stretches in a batch."""
    raw, offsets = text_buffer(batch.column("bytes"))
    count = np.diff(offsets) - window + 1
    item = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
    begin = offsets[:-1][item] + step
    gram, n, row, start = (batch.column(c).to_numpy() for c in ("gram", "n", "row", "start"))
    keys = [mix(slice_hash(*prefix_sums(raw, other), begin, begin + window)) for other in (False, True)]
    return gram[item], n[item], row[item], start[item] + step, *keys


def _compare_in_task(stretches: DataFrame, window: int) -> DataFrame:
    """Spans of windows that several stretches of an anchor have.

    Rows come sorted by anchor; the rows of the last anchor of a batch wait for
    the next one.
    """

    def spans(batch: pa.RecordBatch) -> pa.RecordBatch:
        gram, n, doc, at, key, other = _windows(batch, window)
        order = np.lexsort((other, key, gram))
        fresh = np.concatenate([[True], (gram[order][1:] != gram[order][:-1]) | (key[order][1:] != key[order][:-1]) | (other[order][1:] != other[order][:-1])])
        where = np.empty(len(order), np.int64)
        where[order] = np.cumsum(fresh) - 1
        repeated = (np.bincount(where, n)[where] > 1) & (n == 1)
        return _runs(doc[repeated], at[repeated], window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                if held is not None:
                    part = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
                gram = part.column("gram").to_numpy()
                cut = int(np.searchsorted(gram, gram[-1]))
                if cut:
                    yield spans(part.slice(0, cut))
                held = part.slice(cut)
        if held is not None:
            yield spans(held)

    return stretches.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, _SPAN)


def _compare_in_rows(stretches: DataFrame, window: int) -> DataFrame:
    """The same for anchors with very many stretches: one row per window, counted by Spark."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                gram, n, row, start, key, other = _windows(batch.slice(at, 4096), window)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram, n, row, start, key.view(np.int64), other.view(np.int64))], names=["gram", "n", "row", "start", "key", "other"])

    rows = stretches.mapInArrow(explode, "gram long, n long, row long, start long, key long, other long")
    window_key = ["gram", "key", "other"]
    repeated = rows.groupBy(*window_key).agg(F.sum("n").alias("total")).where("total > 1").select(*window_key)
    return rows.where("n = 1").join(repeated, window_key, "left_semi").select("row", "start", (F.col("start") + window).alias("end"))


def matched_suffixes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """gram: suffixes that occur more than once in ``docs`` (row, text), by adding batch after batch to a family."""
    family = IndexFamily(docs.sparkSession)
    found = []
    for b in range(batches):
        found.append(family.add(suffixes(docs.where(F.pmod(F.xxhash64(ROW), F.lit(batches)) == b), window, gram)))
    family.close()
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return checkpoint(out.distinct())


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, stretches_in_task: int = STRETCHES_IN_TASK) -> DataFrame:
    """row, start, end: byte spans under repeated windows of ``docs`` (row, text); they may overlap."""
    shared = table(stretches_of(docs, matched_suffixes(docs, window, gram, batches), window, gram), "matched-suffixes")
    stretch = ["gram", "stretch_a", "stretch_b"]
    stretches = table(shared.groupBy(*stretch).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "start", "windows")).alias("x")), "stretches")
    again = stretches.where("n > 1").select(*stretch)
    # A passage that very many texts share is one stretch: broadcast, it needs no task of its own.
    whole = shared.join(F.broadcast(again) if again.count() <= BROADCAST_IDS // 4 else again, stretch, "left_semi").select("row", "start", (F.col("start") + F.col("windows") + window - 1).alias("end"))
    variants = stretches.groupBy("gram").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1")
    several = checkpoint(stretches.join(variants, "gram").select("variants", F.col("x.row").alias("row"), "gram", "n", F.col("x.start").alias("start"), F.col("x.windows").alias("windows")))
    here = only(docs, several.select("row").distinct(), ROW)[0]
    few = _compare_in_task(_cut_out(here, several.where(F.col("variants") <= stretches_in_task), window), window)
    found = whole.unionByName(few)
    many = several.where(F.col("variants") > stretches_in_task)
    if not many.isEmpty():
        found = found.unionByName(_compare_in_rows(table(_cut_out(here, many, window), "wide-stretches"), window))
    return found


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, stretches_in_task: int = STRETCHES_IN_TASK) -> DataFrame:
    """doc_id, kept (binary), n_bytes, removed (array of byte spans); one row per input row.

    Texts are UTF-8 bytes, null is empty.  Every byte under a ``window``-byte
    string that starts anywhere else goes, in the same text or another;
    strings are judged on the input.  Rows are told apart by a key of their own
    where doc_ids repeat: rows with the same doc_id, and repeated rows, are
    texts like any other.  Rows with a null doc_id are kept whole and repeat
    nothing.  Texts shorter than ``window``
    are kept whole.  Other columns are ignored; an empty table gives no rows.
    """
    rows = documents(docs)
    named = rows.where("doc_id IS NOT NULL")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        named = named.withColumn(ROW, F.col("doc_id"))
    else:
        named = numbered(named)
    spans = repeated_spans(named, window, gram, batches, stretches_in_task)
    lists = table(spans.distinct().groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")), "repeat-spans")  # at most one per byte of the text
    hit, clean = only(named, lists.select("row"), ROW)
    clean = clean.select("doc_id", "text").unionByName(rows.where("doc_id IS NULL"))
    hit = hit.join(lists, F.col(ROW) == F.col("row")).select(F.encode("text", "UTF-8").alias("raw"), "doc_id", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, doc_id, spans in zip(*(c.to_pylist() for c in batch.columns)):
                merged: list[list[int]] = []
                for s in spans:
                    if merged and s["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["end"])
                    else:
                        merged.append([s["start"], s["end"]])
                edges = [0, *(x for s in merged for x in s), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((doc_id, kept, len(raw), [{"start": a, "end": b} for a, b in merged]))
            spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.binary(), pa.int64(), spans_type))], names=["doc_id", "kept", "n_bytes", "removed"])

    schema = "doc_id long, kept binary, n_bytes long, removed array<struct<start:long,end:long>>"
    whole = clean.select("doc_id", F.encode("text", "UTF-8").alias("kept"), F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("removed"))
    return hit.mapInArrow(cut, schema).unionByName(whole)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
