"""URL filters by a cascade of Bloom filters.

Level 1 encodes the listed keys, level 2 the keys of the corpus that level 1
takes for listed, level 3 the listed keys that level 2 takes for those, and so
on until nobody is mistaken.  For every key of the corpus the parity of the
first level that refuses it is then the exact answer, so pages are judged in
one pass without a join.  The filters follow the number of *rules*, not of
pages; beyond ``max_filter_bytes``, or ``most_shapes`` shapes of rules, the same
answer comes from a shuffled join.

A url's keys are host suffixes (at label borders) joined to path prefixes, one
for each shape (labels, path length) that occurs among the rules.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.kernels import U64, mix
from quire.llm.shared import checkpoint

BITS_PER_KEY = 12
MAX_FILTER_BYTES = 128 << 20
MAX_SHAPES = 10_000
VERDICTS = ("block", "allow")
#: The rules of the corpus query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


@dataclass
class Level:
    """One Bloom filter; ``words`` hold its bits."""

    words: np.ndarray
    bits: int
    hashes: int
    salt: int

    def positions(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return positions(a, b, self.bits, self.hashes, self.salt)

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self.positions(a, b)
        return ((self.words[at >> U64(6)] >> (at & U64(63))) & U64(1)).all(axis=0)


def positions(a: np.ndarray, b: np.ndarray, bits: int, hashes: int, salt: int) -> np.ndarray:
    a, b = mix(a.astype(U64) ^ U64(salt)), mix(b.astype(U64) + U64(salt)) | U64(1)
    return np.stack([(a + U64(i) * b) % U64(bits) for i in range(hashes)])


def contains(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Membership of keys by their two hashes."""
    undecided, out = np.arange(len(a)), np.zeros(len(a), bool)
    for depth, level in enumerate(levels):
        hit = level.has(a[undecided], b[undecided])
        out[undecided[~hit]] = depth % 2 == 1
        undecided = undecided[hit]
    out[undecided] = len(levels) % 2 == 1
    return out


def hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("a"), F.xxhash64(F.lit(77), key).alias("b")]


def _build(keys: DataFrame, depth: int, bits_per_key: int) -> Level:
    """The filter of distinct keys (a, b).  Only its words reach the driver."""
    n = keys.count()
    bits = max(64, -(-n * bits_per_key // 64) * 64)
    hashes, salt = max(1, round(bits_per_key * math.log(2))), 0x9E3779B97F4A7C15 * (depth + 1) % 2**64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            at = np.unique(positions(x.column(0).to_numpy(), x.column(1).to_numpy(), bits, hashes, salt))
            yield pa.RecordBatch.from_arrays([pa.array((at >> U64(6)).astype(np.int64)), pa.array((U64(1) << (at & U64(63))).view(np.int64))], names=["word", "bit"])

    rows = keys.select("a", "b").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    words = np.zeros(bits // 64, dtype=U64)
    words[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64).view(U64)
    return Level(words, bits, hashes, salt)


def _asked(keys: DataFrame, levels: list[Level]) -> DataFrame:
    """The rows of ``keys`` that the last level takes."""
    level = keys.sparkSession.sparkContext.broadcast(levels[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield x.filter(pa.array(level.value.has(x.column("a").to_numpy(), x.column("b").to_numpy())))

    return keys.mapInArrow(run, keys.schema)


def cascade(listed: DataFrame, universe: DataFrame, bits_per_key: int = BITS_PER_KEY) -> list[Level]:
    """Levels for ``listed``, exact on every key of ``universe``; both have columns key, a, b.

    The universe is read once; after that each level works on the keys that
    the last one mistook, a small share of those before.  Null keys are nobody.
    """
    inside = listed.select("key", "a", "b").where("key IS NOT NULL").distinct()
    levels = [_build(inside, 0, bits_per_key)]
    outside = _asked(universe.select("key", "a", "b").where("key IS NOT NULL"), levels).distinct().join(inside.select("key"), "key", "left_anti")
    while True:
        outside = checkpoint(outside)
        if outside.isEmpty():
            return levels
        levels.append(_build(outside, len(levels), bits_per_key))
        inside, outside = outside, _asked(inside, levels)


def rule_keys(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with key, shape and hashes."""
    key = F.concat("host", "path")
    return rules.select(key.alias("key"), F.col("verdict"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("prefix"), *hashed(key))


def url_keys(urls: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """``urls`` (with host, path) plus keys: array of (n, key, a, b), longest first."""
    labels = F.split("host", r"\.")
    made = [F.when((F.size(labels) >= n) & (F.length("path") >= p), F.concat(F.array_join(F.slice(labels, F.size(labels) - (n - 1), F.lit(n)), "."), F.substring("path", 1, p))) for n, p in shapes]
    keys = F.filter(F.array(*made), lambda k: k.isNotNull()) if made else F.array().cast("array<string>")
    order = F.array_sort(F.transform(keys, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("key"), *hashed(k))))
    return urls.withColumn("keys", order)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", bits_per_key: int = BITS_PER_KEY, max_filter_bytes: int = MAX_FILTER_BYTES, most_shapes: int = MAX_SHAPES) -> DataFrame:
    """page_id, host, path, rule, verdict; one row per page.

    ``rules`` has host, path, verdict (``block`` or ``allow``).  A rule fits
    its host and all subdomains when the url's path starts with the rule's
    path; the longest fitting rule (as host and path together, then the first
    in text order) decides, else ``default``.  A rule given with both verdicts
    blocks.  Null urls and urls without ``://`` have empty host and path and so
    no rule.  Repeated pages are judged row by row; columns other than page_id
    and url are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    listed = rule_keys(rules)
    n_rules = listed.count()
    shapes = sorted((r["labels"], r["prefix"]) for r in listed.select("labels", "prefix").distinct().limit(most_shapes + 1).collect())
    if 2 * n_rules * bits_per_key // 8 > max_filter_bytes or len(shapes) > most_shapes:
        return _judge_by_join(urls, rules, default)
    keyed = url_keys(urls, shapes)
    seen = keyed.select(F.explode("keys").alias("k")).select("k.key", "k.a", "k.b")
    known = listed.select("key", "a", "b")
    # One cascade over the keys of all urls tells the rules; which of those block is told by one over the rules alone.
    filters = [cascade(known, seen.unionByName(known), bits_per_key), cascade(listed.where("verdict = 'block'"), known, bits_per_key)]
    held = spark.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keys = x.column("keys")
            flat = keys.flatten()
            a, b = flat.field("a").to_numpy(), flat.field("b").to_numpy()
            every, block = held.value
            verdict = np.where(contains(every, a, b), np.where(contains(block, a, b), 0, 1), -1)
            row = np.repeat(np.arange(len(x)), keys.value_lengths().fill_null(0).to_numpy())
            hits = np.flatnonzero(verdict >= 0)
            rows, first = np.unique(row[hits], return_index=True)
            at = np.full(len(x), -1)
            at[rows] = hits[first]
            none = at < 0
            rule = flat.field("key").take(pa.array(np.where(none, 0, at), mask=none))
            said = np.where(none, default, np.array(VERDICTS)[verdict[at]]) if len(a) else np.full(len(x), default)
            yield pa.RecordBatch.from_arrays([x.column("page_id"), x.column("host"), x.column("path"), rule.cast(pa.string()), pa.array(said.tolist(), pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return keyed.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def _judge_by_join(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same for lists too long, or of too many shapes, to send to every task: rules meet the urls of their host."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))
    rows = urls.withColumn("__row", F.monotonically_increasing_id())
    listed = rules.groupBy(F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).agg(F.max((F.col("verdict") == "block").cast("int")).alias("blocks"))
    met = rows.select("__row", "path", F.explode(suffixes).alias("rule_host")).join(listed, "rule_host").where(F.startswith("path", F.col("rule_path")))
    key = F.concat("rule_host", "rule_path")
    best = met.groupBy("__row").agg(F.min(F.struct((-F.length(key)).alias("n"), key.alias("key"), (1 - F.col("blocks")).alias("allowed"))).alias("best"))
    verdict = F.when(F.col("best.allowed") == 0, "block").when(F.col("best.allowed") == 1, "allow").otherwise(default)
    return rows.join(best, "__row", "left").select("page_id", "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


ORACLE_SQL = r"""
WITH rules(rhost, rpath, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), j AS (
  SELECT p.*, rhost || rpath AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM p LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM j WHERE k = 1
"""
