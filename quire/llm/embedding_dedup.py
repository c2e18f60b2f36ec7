"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors are turned onto the principal axes of the whole table, widest first,
and dealt into tiles by their first coordinate.  Pairs of tiles whose boxes and
suffix norms cannot reach the threshold are left out, groups of neighbouring
tiles against groups first, so far groups never list their tiles.  For the others one task
per pair of tiles adds up the products of the leading axes for all vectors of
both, bounds the rest by the product of suffix norms, drops what cannot reach
the threshold, and goes on with the next axes for the survivors only.  What is
left is checked by the cosine of the original components in double precision.

Equal vectors are one vector with a number of copies.  A task returns link
counts and a forest of links, a row or two per vector, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.components import components, roots
from quire.llm.shared import checkpoint, table

THRESHOLD = 0.9
TILE = 4096
#: Neighbouring tiles whose pairs are pruned together first.
FAN = 64
#: Axes added at a time.
STEP = 16
#: Axes whose ranges bound a pair of tiles.
BOX = 8
#: Room for rounding in single precision; survivors are checked in double.
_SLACK = 1e-4


def valid(vector: Column) -> Column:
    """Not null, not empty, not all zero, every component finite."""
    x = lambda v: v.cast("double")
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    """Unit rows in double precision, shorter ones filled with zeros."""
    out = np.zeros((len(column), width))
    for row, v in zip(out, column):
        row[: len(v)] = v
    # Scaled first, so that squares of very large or small components stay finite.
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Axes as columns, widest first, from the second moments of all vectors."""

    def run(frames):
        total = np.zeros((width, width))
        for frame in frames:
            if len(frame):
                x = _matrix(frame["vector"], width)
                total += x.T @ x
        yield pd.DataFrame({"k": np.arange(width * width), "v": total.ravel()})

    rows = vectors.select("vector").mapInPandas(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    moments = np.zeros(width * width)
    moments[rows["k"]] = rows["v"]
    return np.linalg.eigh(moments.reshape(width, width))[1][:, ::-1].copy()


def tile_links(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i of a, j of b) with cosine >= threshold; i < j if both are the same tile."""
    turned = [(x @ axes).astype(np.float32) for x in (a, b)]
    cuts = list(range(0, axes.shape[1], STEP))
    # suffix[k][s]: norm of what comes after axis block s
    suffix = [np.sqrt(np.maximum(0, np.stack([(x[:, c + STEP :] ** 2).sum(axis=1) for c in cuts]))) for x in turned]
    found = []
    for at in range(0, len(a), 512):
        x = turned[0][at : at + 512]
        sums = x[:, :STEP] @ turned[1][:, :STEP].T
        i, j = np.nonzero(sums + np.multiply.outer(suffix[0][0][at : at + 512], suffix[1][0]) >= threshold - _SLACK)
        if same:
            i, j = i[i + at < j], j[i + at < j]
        part = sums[i, j]
        for s, c in enumerate(cuts[1:], 1):
            if not len(i):
                break
            part = part + np.einsum("ij,ij->i", x[i, c : c + STEP], turned[1][j, c : c + STEP])
            keep = part + suffix[0][s][at + i] * suffix[1][s][j] >= threshold - _SLACK
            i, j, part = i[keep], j[keep], part[keep]
        i = i + at
        exact = np.einsum("ij,ij->i", a[i], b[j]) >= threshold
        found.append((i[exact], j[exact]))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _pairs(box: DataFrame, threshold: float) -> DataFrame:
    """tile, other, dim: pairs of boxes (tile, dim, rest, box) whose vectors can reach the threshold."""
    last = box.agg(F.max("tile")).first()[0] or 0
    other = box.select(F.col("tile").alias("other"), "dim", F.col("rest").alias("rest_b"), F.col("box").alias("box_b"))
    asked = box.select("tile", "dim", "rest", "box", F.explode(F.sequence("tile", F.lit(last).cast("long"))).alias("other")).join(other, ["other", "dim"])
    return asked.where(_most() >= threshold - _SLACK).select("tile", "other", "dim")


def _most() -> Column:
    """The largest product that vectors of two boxes can have."""
    corner = lambda p, q: F.greatest(p[0] * q[0], p[0] * q[1], p[1] * q[0], p[1] * q[1])
    return F.aggregate(F.zip_with("box", "box_b", corner), F.col("rest") * F.col("rest_b"), lambda s, x: s + x)


def tile_pairs(box: DataFrame, threshold: float, fan: int = FAN) -> DataFrame:
    """:func:`_pairs` of tiles, found by pairs of groups of ``fan`` neighbouring tiles that can reach the threshold."""
    axes = box.select(F.max(F.size("box"))).first()[0] or 0
    side = lambda f, k, i: f(F.get(F.get("box", F.lit(k)), F.lit(i)))
    group = F.floor(F.col("tile") / fan).cast("long")
    wide = F.array(*[F.array(side(F.min, k, 0), side(F.max, k, 1)) for k in range(axes)])
    groups = checkpoint(box.groupBy(group.alias("tile"), "dim").agg(F.max("rest").alias("rest"), wide.alias("box")))
    near = _pairs(groups, threshold).select(F.col("tile").alias("g"), F.col("other").alias("h"), "dim")
    left = box.select(group.alias("g"), "tile", "dim", "rest", "box")
    right = box.select(group.alias("h"), F.col("tile").alias("other"), "dim", F.col("rest").alias("rest_b"), F.col("box").alias("box_b"))
    return near.join(left, ["g", "dim"]).join(right, ["h", "dim"]).where((F.col("tile") <= F.col("other")) & (_most() >= threshold - _SLACK)).select("tile", "other", "dim")


def embedding_links(reps: DataFrame, width: int, threshold: float = THRESHOLD, tile: int = TILE, fan: int = FAN) -> DataFrame:
    """u, v, n: link counts (v null) and links enough to connect all (n 0).

    ``reps`` has vec_id, copies, vector: distinct valid vectors, read several times.
    """
    spark = reps.sparkSession
    axes = principal_axes(reps, width)
    held = spark.sparkContext.broadcast(axes)
    number = max(1, -(-reps.count() // tile))

    def lead(frames):
        for frame in frames:
            if len(frame):
                turned = _matrix(frame["vector"], width) @ held.value
                frame = frame.assign(lead=list(turned[:, :BOX]), rest=np.sqrt((turned[:, BOX:] ** 2).sum(axis=1)), first=turned[:, 0])
                yield frame

    led = reps.mapInPandas(lead, reps.schema.simpleString()[7:-1].replace(":", " ") + ", lead array<double>, rest double, first double")
    tiles = table(led.repartitionByRange(number, "first", "vec_id").withColumn("tile", F.spark_partition_id().cast("long")), "tiles")
    size = F.size("vector")
    box = tiles.groupBy("tile", size.alias("dim")).agg(*[F.struct(F.min(F.col("lead")[k]), F.max(F.col("lead")[k])).alias(f"b{k}") for k in range(min(BOX, width))], F.max("rest").alias("rest"))
    box = checkpoint(box.select("tile", "dim", "rest", F.array(*[F.array(F.col(f"b{k}.col1"), F.col(f"b{k}.col2")) for k in range(min(BOX, width))]).alias("box")))
    asked = checkpoint(tile_pairs(box, threshold, fan))
    rows = tiles.select("tile", size.alias("dim"), "vec_id", "copies", "vector")
    left = asked.join(rows, ["tile", "dim"]).select("tile", "other", "dim", F.lit(0).alias("side"), "vec_id", "copies", "vector")
    right = asked.where("tile != other").join(rows.withColumnRenamed("tile", "other"), ["other", "dim"]).select("tile", "other", "dim", F.lit(1).alias("side"), "vec_id", "copies", "vector")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        sides = [frame[frame["side"] == s] for s in (0, 1)]
        same = not len(sides[1])
        a, b = sides[0], sides[0] if same else sides[1]
        x = _matrix(a["vector"], width)
        y = x if same else _matrix(b["vector"], width)
        i, j = tile_links(x, y, held.value, threshold, same)
        ids = np.concatenate([a["vec_id"].to_numpy(), np.zeros(0, np.int64) if same else b["vec_id"].to_numpy()])
        shift = 0 if same else len(a)
        copies = [f["copies"].to_numpy() for f in (a, b)]
        n = np.bincount(i, copies[1][j], minlength=len(ids)) + np.bincount(j + shift, copies[0][i], minlength=len(ids))
        seen = np.flatnonzero(n)
        root = roots(i, j + shift, len(ids))
        far = np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"u": np.concatenate([ids[seen], ids[far]]), "v": pd.array([None] * len(seen) + ids[root[far]].tolist(), dtype="Int64"), "n": np.concatenate([n[seen].astype(np.int64), np.zeros(len(far), np.int64)])})

    return left.unionByName(right).groupBy("tile", "other", "dim").applyInPandas(compare, "u long, v long, n long")


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, fan: int = FAN) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per input row.

    ``vectors`` has vec_id and embedding (array of numbers).  Vectors that are
    null, empty or zero or hold null or non-finite components link with
    nothing, and so do vectors of different lengths.  Repeated rows count as
    other vectors of the same vec_id.  Other columns (labels) are ignored; an
    empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    good = rows.where(valid(F.col("vector")) & F.col("vec_id").isNotNull())
    # Equal vectors meet by a hash of the vector; -0.0 and 0.0 may stay apart, which changes no result.
    digest = F.sha2(F.to_json(F.struct("vector")), 256)
    same = good.select("vec_id", digest.alias("digest"), "vector").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    members = checkpoint(good.select("vec_id", digest.alias("digest")).join(same, "digest").select("vec_id", "rep", "copies"))
    reps = members.where("vec_id = rep").select("vec_id", "copies").distinct()
    reps = table(good.join(reps, "vec_id").dropDuplicates(["vec_id"]).select("vec_id", "copies", "vector"), "vectors")
    width = reps.agg(F.max(F.size("vector"))).first()[0]
    out = rows.select("vec_id")
    if width is None:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = table(embedding_links(reps, width, threshold, tile, fan), "embedding-links")
    counts = found.where("v IS NULL").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    named = components(found.where("v IS NOT NULL").select("u", "v")).withColumnRenamed("node", "rep")
    labelled = members.distinct().join(counts, "rep", "left").join(named, "rep", "left").select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    component = F.coalesce("component", "vec_id")
    return out.join(labelled, "vec_id", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(node, seen) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.seen FROM r JOIN l ON l.a = r.node)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = v.vec_id JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) m ON m.node = v.vec_id
"""
