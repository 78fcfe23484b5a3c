"""Running numbers over whole tables, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.lineage import written as cut


def numbered(rows: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """rows with their place (from 0) in the given order; ties in any order.

    Rows are sorted into ranges and written; a row's place is its place in its range and the number
    of rows in the ranges before. Only the counts of ranges, as many as partitions, meet in one task.
    """
    kept = cut(rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", 33))
    counts = kept.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = counts.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    # a row per partition
    return kept.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_before")


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str = "n") -> DataFrame:
    """rows with their place (from 0) in order among the rows of equal keys; ties in any order, keys are not null.

    As numbered(), less the number of the key's first row. Keys of more than a thousandth of the
    rows, of which few can exist, get theirs by broadcast, so that no task holds all rows of a key.
    """
    every = numbered(rows, *keys, *order, name="_n")
    first = cut(every.groupBy(*keys).agg(F.min("_n").alias("_first"), F.count("*").alias("_size")))
    most = max(1000, (first.agg(F.sum("_size")).first()[0] or 0) // 1000)
    large = F.broadcast(first.where(F.col("_size") > most).select(*keys, F.col("_first").alias("_hot")))
    marked = every.join(large, keys, "left")
    rest = marked.where("_hot is null").join(first.select(*keys, "_first"), keys)
    both = rest.unionByName(marked.where("_hot is not null").withColumn("_first", F.col("_hot")))
    return both.withColumn(name, F.col("_n") - F.col("_first")).drop("_n", "_first", "_hot")
