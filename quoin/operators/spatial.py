"""Radius, nearest-neighbour and proximity joins on a grid, so that they are equi-joins and not products."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.lineage import cut


def _cells(points: DataFrame, r: float, prefix: str = "c") -> DataFrame:
    return points.withColumns({f"{prefix}{k}": F.floor(F.col(k) / r).cast("long") for k in "xyz"})


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by keys in a fixed number of parts: before a join of many comparisons of few bytes, which would else be put together in one task."""
    spark = rows.sparkSession
    return rows.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def radius_join(left: DataFrame, right: DataFrame, r: float, keep_left: tuple[str, ...] = (), keep_right: tuple[str, ...] = ()) -> DataFrame:
    """(pid_a, pid_b, d2, kept columns with _a and _b) of points closer than r.

    The left side is repeated to the 27 cells around its own (cells have side r), then both meet by
    cell and the exact distance decides.
    """
    near = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip("ijk", d, strict=True)]) for d in itertools.product((-1, 0, 1), repeat=3)]))
    a = _cells(left, r).withColumn("o", near).select(F.col("pid").alias("pid_a"), *[F.col(c).alias(f"{c}_a") for c in ("x", "y", "z", *keep_left)], *[(F.col(f"c{k}") + F.col(f"o.{o}")).alias(f"c{k}") for k, o in zip("xyz", "ijk", strict=True)])
    b = _cells(right, r).select(F.col("pid").alias("pid_b"), *[F.col(c).alias(f"{c}_b") for c in ("x", "y", "z", *keep_right)], "cx", "cy", "cz")
    d2 = sum(((F.col(f"{k}_a") - F.col(f"{k}_b")) * (F.col(f"{k}_a") - F.col(f"{k}_b")) for k in "xyz"), F.lit(0.0))
    return dealt(a, "cx", "cy", "cz").join(dealt(b, "cx", "cy", "cz").hint("shuffle_hash"), ["cx", "cy", "cz"]).withColumn("d2", d2).where(F.col("d2") < r * r).select("pid_a", "pid_b", "d2", *[f"{c}_a" for c in keep_left], *[f"{c}_b" for c in keep_right])


def neighbours(points: DataFrame, r: float, **kept: tuple[str, ...]) -> DataFrame:
    """Ordered pairs of different points closer than r."""
    return radius_join(points, points, r, **kept).where("pid_a <> pid_b")


def _first_radius(points: DataFrame, first: float, k: int) -> float:
    """first, or so small a half, quarter and so on (to 2^-40) of it that a point shares its cell with at most 2 (k + 1) on average."""
    r = first
    while r > first * 2.0**-40:
        cells = _cells(points, r).groupBy("cx", "cy", "cz").agg(F.count("*").cast("double").alias("n"))
        n, squares = cells.agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
        if not n or squares / n <= 2 * (k + 1):
            break
        r /= 2
    return r


def nearest(left: DataFrame, right: DataFrame, k: int, first: float, same: bool = True) -> DataFrame:
    """(pid_a, pid_b, d2, place): the k nearest right points of each left point, ties by pid; same leaves out equal pids.

    Points with fewer than k within a radius are searched again with twice the radius; once the grid
    holds all points in neighbouring cells, whatever there is counts, so the answer is exact. Where first would give a point
    far more than k in its cell on average, a smaller radius goes before it, so pairs grow with the points and not with their square; of right
    points at one place only the first k + 1 are asked.
    """
    at_one = Window.partitionBy("x", "y", "z").orderBy("pid")
    right = cut(right.withColumn("_at", F.dense_rank().over(at_one)).where(F.col("_at") <= k + 1).drop("_at"))
    bounds = right.agg(*[(F.max(c) - F.min(c)).alias(c) for c in "xyz"]).first()
    outer = left.agg(*[F.min(c).alias(f"l{c}") for c in "xyz"], *[F.max(c).alias(f"h{c}") for c in "xyz"]).first()
    inner = right.agg(*[F.min(c).alias(f"l{c}") for c in "xyz"], *[F.max(c).alias(f"h{c}") for c in "xyz"]).first()
    if bounds["x"] is None or outer["lx"] is None:
        return radius_join(left, right, first).withColumn("place", F.lit(1)).limit(0)
    reach = sum((max(outer[f"h{c}"], inner[f"h{c}"]) - min(outer[f"l{c}"], inner[f"l{c}"])) ** 2 for c in "xyz") ** 0.5
    rest, r, out = left, _first_radius(right, first, k), None
    order = Window.partitionBy("pid_a").orderBy("d2", "pid_b")
    while True:
        pairs = radius_join(rest, right, r)
        if same:
            pairs = pairs.where("pid_a <> pid_b")
        ranked = pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
        last = r > reach
        ranked = cut(ranked)
        enough = ranked.groupBy(F.col("pid_a").alias("pid")).agg(F.count("*").alias("n")).where(F.lit(True) if last else F.col("n") >= k).select("pid")
        good = ranked.join(enough.withColumnRenamed("pid", "pid_a"), "pid_a", "left_semi")
        out = good if out is None else out.union(good)
        rest = cut(rest.join(enough, "pid", "left_anti"))
        if last or rest.isEmpty():
            return out
        r *= 2


def soft_radius(points: DataFrame, r: float, least: int = 2, fallback: int = 3) -> DataFrame:
    """Neighbours within r; points with fewer than least take their fallback nearest instead."""
    near = neighbours(points, r).select("pid_a", "pid_b", "d2")
    rich = near.groupBy("pid_a").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("pid_a")
    poor = points.join(rich.withColumnRenamed("pid_a", "pid"), "pid", "left_anti")
    return near.join(rich, "pid_a", "left_semi").unionByName(nearest(poor, points, fallback, r).drop("place"))


def patch_proximity(points: DataFrame, r: float) -> DataFrame:
    """(gid_a < gid_b): patches with points closer than r."""
    pairs = radius_join(points.where("gid is not null"), points.where("gid is not null"), r, ("gid",), ("gid",))
    return pairs.where("gid_a < gid_b").select("gid_a", "gid_b").distinct()


def nearest_match(left: DataFrame, right: DataFrame, r: float) -> DataFrame:
    """(pid_a, pid_b, d2): each left point's nearest right point within r."""
    return radius_join(left, right, r).groupBy("pid_a").agg(F.min_by(F.struct("pid_b", "d2"), F.struct("d2", "pid_b")).alias("best")).select("pid_a", "best.pid_b", "best.d2")
