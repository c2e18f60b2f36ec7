"""Numbers of rows in a total order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.lineage import checkpoint


def in_order(df: DataFrame, *columns: str | Column, name: str = "position") -> DataFrame:
    """``df`` plus ``name``: each row's place (from 0) by ``columns``.

    Rows are dealt out by ranges and sorted inside each; a row's number is its
    place in its partition plus the rows of the partitions before.
    """
    dealt = checkpoint(df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_id", F.monotonically_increasing_id()))
    sizes = dealt.groupBy(F.shiftright("_id", 33).alias("_p")).count()
    before = sizes.select("_p", (F.sum("count").over(W.orderBy("_p")) - F.col("count")).alias("_before"))  # one row per partition
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")
    return dealt.withColumn("_p", F.shiftright("_id", 33)).join(F.broadcast(before), "_p").withColumn(name, place.cast("long")).select(*df.columns, name)


#: A group of at most so many rows is sorted in one task, which spills; larger ones are dealt out by ranges.
IN_ONE_TASK = 4_000_000


def in_groups(df: DataFrame, by: list[str], order: list[Column], name: str = "position", size: str = "", most: int = IN_ONE_TASK) -> DataFrame:
    """``df`` plus ``name``: each row's place (from 0) in its group ``by`` in the order of ``order``, and ``size``, if asked: the group's rows.

    Groups of more than ``most`` rows, of which there are few, are put in order
    by ranges of (group, order), so that no task sees a whole one.
    """
    plain = (F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1).cast("long")
    added = {name: plain, **({size: F.count(F.lit(1)).over(W.partitionBy(*by))} if size else {})}
    large = df.groupBy(*by).count().where(F.col("count") > most).select(*[F.col(c).alias(f"_{c}_") for c in by])
    large = large.sparkSession.createDataFrame(large.collect(), large.schema)  # one row for each ``most`` rows at most
    if large.isEmpty():
        return df.withColumns(added)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in by]
    rest = df.join(F.broadcast(large), same, "left_anti").withColumns(added)
    placed = in_order(df.join(F.broadcast(large), same, "left_semi"), *by, *order, name="_place")
    first = placed.groupBy(*by).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_size")).select(*[F.col(c).alias(f"_{c}_") for c in by], "_first", "_size")
    split = placed.join(F.broadcast(first), same).withColumns({name: F.col("_place") - F.col("_first"), **({size: F.col("_size")} if size else {})})
    return rest.unionByName(split.select(*df.columns, *added))
