"""Exact deduplication by content hash, in DataFrame operations only.

Texts are compared after all white space of ``[\\x20\\x09-\\x0D]`` is deleted.
A group is found by a 128-bit hash (MD5); the texts themselves are the rest of
the grouping key, so bytes are compared inside each hash group and a collision
makes two classes.  Copies collapse before the shuffle (partial aggregation
with fixed-width buffers), so a group that holds a third of all rows sends one
row per map task.  A text without copies needs no join.  The groups of several
rows are joined back to their members on digests, never on texts: broadcast up
to ``BROADCAST_GROUPS`` of them, so that no task gets all rows of a large
group, else by a shuffle whose large partitions are split at run time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import ROW, documents, numbered, only, table

#: So many groups (about 200 bytes each) are broadcast at most.
BROADCAST_GROUPS = 200_000
WHITE_SPACE = "[\\x20\\x09-\\x0D]"


def _big(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(38,0)")


def normalise(text: Column) -> Column:
    return F.regexp_replace(text, WHITE_SPACE, "")


def classes(docs: DataFrame, content_hash: Callable[[Column], Column] = F.md5, others: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(members, classes) of equal texts.

    ``members``: doc_id, hash, digest, own_best and ``others``, one row per input row.  ``classes``:
    hash, digest, best, group_size, one row per distinct text; ``best`` orders
    rows by most code points, then smallest doc_id, in one fixed-width number,
    which keeps the aggregation hash-based.
    """
    norm = normalise(F.col("text"))
    rows = documents(docs, others=others).select(
        "doc_id",
        content_hash(norm).alias("hash"),
        F.sha2(norm, 256).alias("digest"),
        norm.alias("norm"),
        ((_big(2**31) - F.length("text").cast("decimal(38,0)")) * _big(2**65) + F.coalesce(F.col("doc_id").cast("decimal(38,0)") + _big(2**63), _big(2**64))).cast("decimal(38,0)").alias("best"),
        *others,
    )
    texts = rows.groupBy("hash", "digest", "norm").agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("group_size"))
    one = texts.groupBy("hash", "digest").agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts"))
    clash = F.raise_error(F.lit("two texts share both content hash and SHA-256"))
    return rows.select("doc_id", "hash", "digest", F.col("best").alias("own_best"), *others), one.withColumn("best", F.when(F.col("texts") == 1, F.col("best")).otherwise(clash)).drop("texts")


def _grouped(members: DataFrame, found: DataFrame) -> DataFrame:
    """members plus best and group_size of their class."""
    several = table(found.where("group_size > 1"), "copy-groups")
    held = F.broadcast(several) if several.count() <= BROADCAST_GROUPS else several
    out = members.join(held, ["hash", "digest"], "left")
    return out.withColumns({"best": F.coalesce("best", "own_best"), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})


def exact_dedup(docs: DataFrame, content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row per input row.

    Null text counts as empty, so nulls, empty and blank texts are one group.
    Of equal texts the row with the most code points stays, then the smallest
    doc_id (a null doc_id comes last).  Rows repeated with the same doc_id and
    text are one document: each of them carries the same flag.  Other columns
    are ignored, whatever their names.  An empty table gives no rows.
    """
    members, found = classes(docs, content_hash)
    keep = F.col("best") % _big(2**65)
    keep_id = F.when(keep == _big(2**64), F.lit(None)).otherwise((keep - _big(2**63)).cast("long"))
    return _grouped(members, found).select("doc_id", keep_id.cast("long").alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all columns: the one that :func:`exact_dedup` keeps.

    Rows are told apart by a key of their own, so of repeated rows one stays,
    and rows that share a doc_id or have none are judged one by one.
    """
    rows = numbered(docs)
    members, found = classes(rows, others=(ROW,))
    first = _grouped(members, found).where("own_best = best").groupBy("hash", "digest").agg(F.min(ROW).alias(ROW))
    return only(rows, table(first.select(ROW), "kept-rows"), ROW)[0].select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, (-n)::HUGEINT * 9223372036854775808 + doc_id) AS keep_id FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
