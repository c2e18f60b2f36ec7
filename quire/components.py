"""Connected components of a link table, by alternating star contraction.

Links first shrink to a forest inside each task.  While that is larger than one
task may hold, every round hangs nodes on the least label they see (a large
star, then a small star) until nothing changes.  Nodes with very many links are aggregated in part before the
shuffle, and each round's table is a checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.lineage import checkpoint


#: A forest of at most so many links (16 bytes each) is finished in one task; a larger one goes on in rounds.
SMALL_LINKS = 1_000_000


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least member of each node's component; nodes are 0..n-1."""
    parent = list(range(n))
    for x, y in zip(a.tolist(), b.tolist()):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    out = np.array(parent, dtype=np.int64)
    while True:
        up = out[out]
        if (up == out).all():
            return out
        out = up


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = ids[roots(at[: len(a)], at[len(a) :], len(ids))]
        far = root != ids
        yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(root[far])], names=["u", "v"])


def _whole_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of all batches of a task; they are few."""
    held = list(batches)
    if held:
        yield from _forest(iter([pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=None)[0]]) if sum(map(len, held)) else iter(()))


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node that can be reached), for each node with a link.

    ``links`` has two long columns, in any order, loops and repeats allowed.
    """
    u, v = links.columns[:2]
    edges = links.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u != v")
    edges = checkpoint(edges.mapInArrow(_forest, "u long, v long").distinct())
    last = None
    while edges.count() > SMALL_LINKS:
        # Large star: larger neighbours of a node move to the least of its neighbours and itself.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: smaller neighbours and the node itself move to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v")
        edges = checkpoint(small.distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if now == last:
            break
        last = now
    else:
        edges = checkpoint(edges.coalesce(1).mapInArrow(_whole_forest, "u long, v long"))
    forest = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return forest.unionByName(forest.select(F.col("component").alias("node"), "component")).distinct()
