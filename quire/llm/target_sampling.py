"""Target-distribution importance resampling over n-gram buckets.

Features are the runs of one to ``longest`` consecutive words of a text, each
in the bucket of its bytes' CRC-32.  A bucket's gain is the smoothed log-ratio
of its share among the target's features and among all documents'; a document
weighs the mean gain of its features, gets Gumbel noise that depends on its id
and the seed alone, and the highest scores are drawn.

CRC-32 is affine over GF(2): the checksum of n bytes is the exclusive-or of one
number per byte, which depends on the byte and its distance from the end alone,
and of a constant for n.  So the numbers stand in a table (distance x byte),
all features of a chunk are gathered through it at once, and
``bitwise_xor.reduceat`` over their spans gives the checksums.  A span longer
than the table is cut into blocks from its end; the blocks' numbers are folded
from the first to the last, where moving a number on by a block is four look-ups
in the same table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.kernels import chunks, text_buffer
from quire.llm.shared import table
from quire.ordering import in_order

BUCKETS = 10_000
LONGEST = 2
SEED = 7
PERCENT = 25
LEAST_WORDS = 20
#: Distances of the position table (64 KB); longer spans are folded by blocks of as many bytes.
DISTANCES = 64
#: Bytes gathered at once.
GATHER = 1 << 20

#: Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320


def position_table(distances: int = DISTANCES) -> np.ndarray:
    """What each byte adds to a checksum, by its distance from the end: (distances, 256), uint32."""
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = (row >> np.uint32(1)) ^ np.where(row & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    rows = [row]
    for _ in range(distances - 1):
        rows.append((rows[-1] >> np.uint32(8)) ^ row[rows[-1] & np.uint32(0xFF)])
    return np.stack(rows)


_TABLE = position_table()
_FLAT = _TABLE.ravel()


def moved(values: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Numbers after ``n`` further zero bytes, 4 to ``DISTANCES`` of them: their four bytes stand at the front of those."""
    out = np.zeros(len(values), np.uint32)
    for k in range(4):
        out ^= _TABLE[np.asarray(n) - 1 - k, (values >> np.uint32(8 * k)) & np.uint32(0xFF)]
    return out


def _far(values: np.ndarray, n: int) -> np.ndarray:
    """:func:`moved` for any one ``n``."""
    while n > DISTANCES + 3 or n == DISTANCES:
        values, n = moved(values, DISTANCES), n - DISTANCES
    if n > DISTANCES:
        values, n = moved(values, n - 4), 4
    if n >= 4:
        return moved(values, n)
    for _ in range(n):
        values = (values >> np.uint32(8)) ^ _TABLE[0, values & np.uint32(0xFF)]
    return values


def length_constants(lengths: np.ndarray) -> np.ndarray:
    """What the length alone adds: the start value moved on by as many bytes, and the last inversion."""
    few, at = np.unique(lengths, return_inverse=True)
    value, n, out = np.full(1, 0xFFFFFFFF, np.uint32), 0, np.zeros(len(few), np.uint32)
    for i, to in enumerate(few.tolist()):
        value, n = _far(value, to - n), to
        out[i] = value[0] ^ np.uint32(0xFFFFFFFF)
    return out[at]


def crc32_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of ``raw[start:end]`` for each span; spans may overlap or be empty."""
    lengths = ends - starts
    n_blocks = np.maximum(1, -(-lengths // DISTANCES))
    first = np.cumsum(n_blocks) - n_blocks
    span = np.repeat(np.arange(len(starts)), n_blocks)
    left = (n_blocks[span] - 1 - (np.arange(len(span)) - first[span])) * DISTANCES  # bytes after the block
    to = ends[span] - left
    size = np.minimum(to - starts[span], DISTANCES)
    values = np.zeros(len(span), np.uint32)
    filled = np.flatnonzero(size)
    edges = np.concatenate([[0], np.cumsum(size[filled])])
    i = 0
    while i < len(filled):
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + GATHER, side="right")) - 1)
        some = filled[i:j]
        back = np.repeat(edges[i + 1 : j + 1], size[some]) - 1 - np.arange(edges[i], edges[j])
        values[some] = np.bitwise_xor.reduceat(_FLAT[back * 256 + raw[np.repeat(to[some], size[some]) - 1 - back]], edges[i:j] - edges[i])
        i = j
    out = values[first]
    long, k = np.flatnonzero(n_blocks > 1), 1
    while len(long):
        out[long] = moved(out[long], DISTANCES) ^ values[first[long] + k]
        k += 1
        long = long[n_blocks[long] > k]
    return out ^ length_constants(lengths)


_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts, word ends, words per document): words in lower case, one space after each.

    A word is a run of ASCII digits, letters and all that is not ASCII; it ends
    where its document ends.
    """
    n = len(offsets) - 1
    inside = _WORD[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[1:-1][offsets[1:-1] < len(raw)]
    begins[cuts] = inside[cuts]
    starts = np.flatnonzero(begins)
    stops = inside.copy()
    stops[:-1] &= begins[1:] | ~inside[1:]
    lengths = np.flatnonzero(stops) + 1 - starts
    ends = np.cumsum(lengths + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
    held = np.ones(len(out), bool)
    held[ends] = False
    out[held] = _LOWER[raw[inside]]
    return out, ends - lengths, ends, np.diff(np.searchsorted(starts, offsets))


def features(raw: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, its document, words per document) of all texts of a buffer."""
    text, starts, ends, counts = words(raw, offsets)
    doc = np.repeat(np.arange(len(counts)), counts)
    found, docs = [], []
    for n in range(1, longest + 1):
        same = np.flatnonzero(doc[n - 1 :] == doc[: max(0, len(doc) - n + 1)])
        found.append((crc32_spans(text, starts[same], ends[same + n - 1]) % np.uint32(buckets)).astype(np.int64))
        docs.append(doc[same])
    return np.concatenate(found), np.concatenate(docs), counts


def _texts(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).alias("text"))


def count_features(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of all texts (one column) by bucket; each task sends one row per bucket that it saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            raw, offsets = text_buffer(batch.column(0))
            for i, j in chunks(offsets):
                counts += np.bincount(features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], buckets, longest)[0], minlength=buckets)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["bucket", "n"])

    rows = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # ``buckets`` rows at most
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"]] = rows["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log-ratio of each bucket's smoothed shares, rounded down."""
    s, t, buckets = corpus.astype(float), target.astype(float), len(corpus)
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """``docs`` (text last) with ``text`` replaced by n_words, n_features and weight."""
    held, others = docs.sparkSession.sparkContext.broadcast(gain), docs.columns[:-1]
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(batch.num_columns - 1))
            n_words, n, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for i, j in chunks(offsets):
                at, doc, n_words[i:j] = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], len(held.value), longest)
                n[i:j] = np.bincount(doc, minlength=j - i)
                np.add.at(total[i:j], doc, held.value[at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1))], names=[*others, "n_words", "n_features", "weight"])

    return docs.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in others) + ", n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank (from 1 in order of drawing, else null): one row per row of ``docs``.

    ``percent`` of the rows with ``least_words`` words or more are drawn, the
    highest scores first, ties by smaller doc_id.  Null and empty texts have no
    features, weigh 0 and are never drawn.  Rows without a doc_id share one
    noise, that of an empty id, and lose ties; rows that share a doc_id share
    its noise too and are drawn each by its own weight.  Other columns go.  An
    empty target gives every bucket the smoothed share.
    """
    gain = gains(count_features(_texts(docs, text_col), buckets, longest), count_features(_texts(target, target_col), buckets, longest))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = table(weigh(rows, gain, longest).withColumn("score", F.col("weight") + noise), "weights")
    may = scored.where(F.col("n_words") >= least_words)
    most = may.count() * percent // 100
    keys = {"_down": -F.col("score"), "_last": F.col("doc_id").isNull()}
    placed = in_order(may.withColumns(keys), "_down", "_last", "doc_id", "n_features", "weight", name="_place")
    drawn = placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("_place") < most, F.col("_place") + 1).alias("rank"))
    return drawn.unionByName(scored.where(F.col("n_words") < least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: CRC-32 byte by byte, for each distinct feature once.
ORACLE_SQL = r"""
WITH RECURSIVE bits(k, i, v) AS (
  SELECT 0, i, i FROM range(256) r(i)
  UNION ALL SELECT k + 1, i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
), steps AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
texts AS (
  SELECT 0 AS kind, row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, coalesce(text, '') FROM benchmark
), w AS (
  SELECT kind, id, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM texts
), f AS (
  SELECT kind, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS feature FROM w
), c AS (
  SELECT feature, xor(4294967295, list_reduce(list_transform(range(1, octet_length(encode(feature)) + 1), lambda i: CAST('0x' || substr(hex(encode(feature)), 2 * i - 1, 2) AS BIGINT)), lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1]), 4294967295)) % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM f), steps
), n AS (
  SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM f JOIN c USING (feature) GROUP BY bucket
), total AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM n),
g AS (
  SELECT bucket, floor(1000 * ln(CAST((n.t + 1) * (total.s + 10000) AS DOUBLE) / CAST((n.s + 1) * (total.t + 10000) AS DOUBLE))) AS gain FROM n, total
), d AS (
  SELECT id, count(*) AS n_features, floor(sum(gain) / count(*)) AS weight FROM f JOIN c USING (feature) JOIN g USING (bucket) WHERE kind = 0 GROUP BY id
), scored AS (
  SELECT w.doc_id, len(w.w) AS n_words, coalesce(d.n_features, 0) AS n_features, CAST(coalesce(d.weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(d.weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || w.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM w LEFT JOIN d USING (id) WHERE kind = 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM placed
"""
