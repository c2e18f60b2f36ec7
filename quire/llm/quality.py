"""Quality classification by importance resampling.

Two bags of hashed 1- and 2-grams are counted over the corpus: one for the
target (labelled good documents), one for all raw text.  A document's
importance is the log-ratio of the two generative models summed over its
n-grams.  Sampling without replacement in proportion to importance is the
Gumbel top-k: add Gumbel noise to the log-weights and keep the k largest keys.
k is the number of documents that the labelled rows say are good.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.kernels import U64, chunks, mix, text_buffer, word_hashes
from quire.llm.shared import ROW, checkpoint, documents, numbered, only, table

BUCKETS = 1 << 16
SMOOTHING = 1.0
SEED = 17
#: The target model and the cut are fitted on at most so many labelled documents (16 bytes each reach every task).
LABELLED_ROWS = 200_000
_KEY_BINS = 4096


def grams(raw: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all 1- and 2-grams (words, A-Z folded) and the document of each."""
    hashes, counts = word_hashes(raw, offsets)
    doc = np.repeat(np.arange(len(counts)), counts)
    pairs = mix(hashes[:-1] * U64(3) + hashes[1:] * U64(0xC2B2AE3D27D4EB4F))
    same = doc[1:] == doc[:-1]
    at = np.concatenate([hashes & U64(buckets - 1), pairs[same] & U64(buckets - 1)]).astype(np.int64)
    return at, np.concatenate([doc, doc[1:][same]])


def count_grams(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, raw, target: n-gram counts over all ``docs`` (text, target boolean).

    Each task adds up its documents and sends one row per bucket that it saw.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw_counts, target_counts = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            raw, offsets = text_buffer(batch.column(0))
            good = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for i, j in chunks(offsets):
                at, doc = grams(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], buckets)
                raw_counts += np.bincount(at, minlength=buckets)
                target_counts += np.bincount(at[good[i:j][doc]], minlength=buckets)
        seen = np.flatnonzero(raw_counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw_counts[seen]), pa.array(target_counts[seen])], names=["bucket", "raw", "target"])

    return docs.select("text", "target").mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log p_target - log p_raw per bucket; a table of ``buckets`` numbers, whatever the corpus."""
    rows = counts.toPandas()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[rows["bucket"]], target[rows["bucket"]] = rows["raw"], rows["target"]
    p = lambda n: np.log((n + SMOOTHING) / (n.sum() + SMOOTHING * buckets))
    return (p(target) - p(raw)) if target.sum() else np.zeros(buckets)


def score(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``docs`` (doc_id, text, other columns) with ``text`` replaced by log_weight and n_grams."""
    held = docs.sparkSession.sparkContext.broadcast(ratios)
    others = [c for c in docs.columns if c != "text"]
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(0))
            weight, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i, j in chunks(offsets):
                at, doc = grams(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], len(held.value))
                weight[i:j] = np.bincount(doc, held.value[at], minlength=j - i)
                n[i:j] = np.bincount(doc, minlength=j - i)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(weight), pa.array(n)], names=[*others, "log_weight", "n_grams"])

    return docs.select("text", *others).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in others) + ", log_weight double, n_grams long")


def best_cut(scored: DataFrame) -> float:
    """The log-weight per n-gram that best separates labelled good from bad documents (one row per doc_id).

    Both kinds count the same, however many there are.  Without labels of both
    kinds the cut is 0, where a document is as likely under either model.
    """
    rows = scored.where("quality IS NOT NULL").select("doc_id", (F.col("log_weight") / F.greatest(F.lit(1), F.col("n_grams"))).alias("w"), (F.col("quality") == 1).alias("good"))
    rows = rows.groupBy("doc_id").agg(F.min("w").alias("w"), F.min("good").alias("good")).toPandas()  # one row per labelled id, LABELLED_ROWS at most
    good = rows["good"].to_numpy(dtype=bool)
    if not good.any() or good.all():
        return 0.0
    rows = rows.iloc[np.argsort(rows["w"].to_numpy(), kind="stable")]
    w, good = rows["w"].to_numpy(), rows["good"].to_numpy(dtype=bool)
    # at cut i the rows before i are rejected
    right = np.concatenate([[0], np.cumsum(~good)]) / (~good).sum() + 1 - np.concatenate([[0], np.cumsum(good)]) / good.sum()
    i = int(np.flatnonzero(right == right.max()).mean())
    return float((w[max(i - 1, 0)] + w[min(i, len(w) - 1)]) / 2)


def top_k(rows: DataFrame, key: str, k: int, tie: str = "doc_id") -> DataFrame:
    """The k rows with the largest ``key``, ties by smallest ``tie``, by counting; rows repeated at the k-th key come once.

    The k-th key is closed in by histograms of fixed size, so nothing is sorted
    as a whole and no row reaches the driver but bin counts.
    """
    low, high, above = rows.agg(F.min(key), F.max(key)).first() + (0,)
    if low is None or k <= 0:
        return rows.limit(0)
    for _ in range(8):
        if high <= low:
            break
        width = (high - low) / _KEY_BINS
        bins = rows.where(F.col(key).between(low, high)).groupBy(F.least(F.lit(_KEY_BINS - 1), F.floor((F.col(key) - low) / width)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).toPandas().sort_values("bin", ascending=False)
        total = above + np.cumsum(bins["n"].to_numpy())
        i = int(np.searchsorted(total, k))
        if i >= len(bins):
            return rows
        above, low, high = int(total[i] - bins["n"].iloc[i]), float(bins["low"].iloc[i]), float(bins["high"].iloc[i])
        if total[i] == k:
            return rows.where(F.col(key) >= low)
    border = rows.where(F.col(key).between(low, high)).distinct().orderBy(F.desc(key), tie).limit(k - above)
    return rows.where(F.col(key) > high).unionByName(border)


def classify(docs: DataFrame, labels: DataFrame, seed: int = SEED, buckets: int = BUCKETS, labelled_rows: int = LABELLED_ROWS, others: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, log_weight, n_grams, key, kept and ``others``; one row per input row.

    Target: half of the documents labelled quality 1 and not toxic; the other
    half, against those labelled bad, sets the cut (toxic ones labelled quality
    1 are in neither).  Of the labels at most ``labelled_rows`` are used,
    chosen by hash.  All documents count as raw.  Words are runs of
    other than ``[\\x20\\x09-\\x0D]``, A-Z folded.  The key is the log-weight in
    excess of the labelled cut per n-gram (the target model comes from few
    documents, so its log-ratio is low by about that much for each n-gram of
    any text, and long good texts would weigh least) plus Gumbel noise that depends on doc_id and
    seed alone; the k largest keys are kept, k being the number of documents
    above the cut.  Null and empty texts have no n-grams: they weigh nothing
    and are never kept.  Repeated rows get the same key and flag; rows that
    share a doc_id, or have none, with other texts are judged by their own
    keys.  A document labelled more than once counts as good only if all its
    labels say so.
    """
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    marks = F.broadcast(checkpoint(marks.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(labelled_rows)))
    rows = documents(docs).join(marks, "doc_id", "left")
    # Half of the good documents make the target model, the other half, unseen by it, the cut.
    unseen = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(2)) == 1
    ratios = log_ratios(count_grams(rows.select("text", ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & ~unseen).alias("target")), buckets), buckets)
    scored = table(score(documents(docs, others=others), ratios), "scores")
    clean = F.coalesce("toxic", F.lit(0)) == 0
    cut = best_cut(scored.join(marks, "doc_id").where((F.col("quality") == 0) | (clean & unseen)))
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    margin = F.col("log_weight") - F.col("n_grams") * F.lit(cut)
    keyed = scored.withColumn("key", F.when(F.col("n_grams") > 0, margin - F.log(-F.log(uniform))))
    live = keyed.where("n_grams > 0")
    kept = top_k(live, "key", live.where(margin >= 0).count()).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.lit(True).alias("__kept")).distinct()
    return keyed.join(kept, keyed["doc_id"].eqNullSafe(F.col("__id")) & (keyed["key"] == F.col("__key")), "left").select("doc_id", "log_weight", "n_grams", "key", F.coalesce("__kept", F.lit(False)).alias("kept"), *others)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`classify` keeps, each by its own key, with all columns."""
    rows = numbered(docs)
    return only(rows, table(classify(rows, labels, others=(ROW,)).where("kept").select(ROW), "kept-rows"), ROW)[0].select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample: the documents that are kept."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept")
