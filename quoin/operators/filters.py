"""Filters and status changes of points and primitives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.operators.aggregates import populations
from quoin.sources.schema import ACTIVE, FIXED, SMALL, UNSET


def popular(points: DataFrame, limit: int) -> DataFrame:
    """Patches with at least limit points."""
    return populations(points).where(F.col("n") >= limit)


def promoted(primitives: DataFrame, points: DataFrame, significance: DataFrame, limit: int, multiple: float, scale: float) -> DataFrame:
    """Primitives with new status: SMALL or UNSET ones become UNSET if they have over limit points and a significance of multiple * scale, else SMALL; others keep theirs."""
    joined = primitives.join(populations(points), "gid", "left").join(significance.select("gid", "significance"), "gid", "left")
    large = (F.coalesce("n", F.lit(0)) > limit) & (F.coalesce("significance", F.lit(-1.0)) >= multiple * scale)
    status = F.when(F.col("status").isin(SMALL, UNSET), F.when(large, UNSET).otherwise(SMALL)).otherwise(F.col("status"))
    return joined.withColumn("status", status.cast("byte")).drop("n", "significance")


def selected(primitives: DataFrame, points: DataFrame) -> DataFrame:
    """Active or fixed primitives that have points."""
    return primitives.where(F.col("status").isin(ACTIVE, FIXED)).join(populations(points), "gid", "left_semi")


def with_points(primitives: DataFrame, points: DataFrame, keep_small: bool = False) -> DataFrame:
    """Primitives that some point is assigned to; small ones regardless if asked."""
    own = primitives.join(populations(points), "gid", "left_semi")
    return own if not keep_small else own.where(F.col("status") != SMALL).unionByName(primitives.where(F.col("status") == SMALL))


def without_points(primitives: DataFrame, points: DataFrame) -> DataFrame:
    return primitives.join(populations(points), "gid", "left_anti")


def orphans(points: DataFrame, limit: int) -> DataFrame:
    """Points without a patch or of one with fewer than limit points."""
    return points.join(popular(points, limit), "gid", "left_anti")


def with_primitive(points: DataFrame, primitives: DataFrame) -> DataFrame:
    """Points whose patch has a primitive."""
    return points.join(primitives.select("gid").distinct(), "gid", "left_semi")


def without_singles(primitives: DataFrame, points: DataFrame, limit: int) -> DataFrame:
    """Primitives whose direction others share, or that are small, or have over twice limit points."""
    own = primitives.join(populations(points), "gid", "left").withColumn("arity", F.count("*").over(Window.partitionBy("did")))
    return own.where((F.col("arity") > 1) | (F.col("status") == SMALL) | (F.coalesce("n", F.lit(0)) > 2 * limit)).drop("n", "arity")


def chosen_only(primitives: DataFrame, chosen: DataFrame) -> DataFrame:
    """Primitives of chosen patches stay; others that were to be promoted go back to SMALL."""
    mark = primitives.join(chosen.select("gid").distinct().withColumn("mark", F.lit(1)), "gid", "left")
    return mark.withColumn("status", F.when((F.col("status") == UNSET) & F.col("mark").isNull(), F.lit(SMALL)).otherwise(F.col("status")).cast("byte")).drop("mark")


def shown(primitives: DataFrame, points: DataFrame, gids: list[int] | None = None, dids: list[int] | None = None, statuses: list[int] | None = None, limit: int = 0, hide_empty: bool = False) -> DataFrame:
    """A viewer's choice of primitives."""
    for name, values in (("gid", gids), ("did", dids), ("status", statuses)):
        primitives = primitives.where(F.col(name).isin(values)) if values else primitives
    return primitives.join(popular(points, max(limit, 1)), "gid", "left_semi") if limit or hide_empty else primitives


def every_nth(points: DataFrame, n: int) -> DataFrame:
    return points.where(F.col("pid") % n == 0)


def ambiguous(near: DataFrame, most: int, tolerance: float) -> DataFrame:
    """pids near more than most triangles whose normals differ from the first one's by over tolerance (rows pid, tid, angle_to_first)."""
    return near.groupBy("pid").agg(F.count("*").alias("n"), F.max("angle_to_first").alias("worst")).where((F.col("n") > most) & (F.col("worst") > tolerance)).select("pid")


def deduplicated(candidates: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Candidates without later ones of the same patch and direction whose normal is within tolerance of an earlier (smaller lid)."""
    key = [F.round(F.col(c) / tolerance).cast("long") for c in ("nx", "ny", "nz")]
    order = Window.partitionBy("gid", "did", *key).orderBy("lid")
    return candidates.withColumn("seen", F.row_number().over(order)).where("seen = 1").drop("seen")


def stratified_unassign(points: DataFrame, share: float, least: int) -> DataFrame:
    """points in which each patch keeps share of its points, at least least, by pid order; the others lose their patch."""
    order = Window.partitionBy("gid").orderBy("pid")
    size = F.count("*").over(Window.partitionBy("gid"))
    keep = F.greatest(F.lit(least), F.floor(size * share))
    return points.withColumn("place", F.row_number().over(order)).withColumn("gid", F.when(F.col("place") <= keep, F.col("gid"))).drop("place")


def largest_patches(points: DataFrame, k: int, extra: int = 0, seed: int = 1) -> DataFrame:
    """The k most populated gids and extra others by hash."""
    n = populations(points)
    top = n.orderBy(F.desc("n"), "gid").limit(k)
    return top if not extra else top.unionByName(n.join(top, "gid", "left_anti").orderBy(F.xxhash64("gid", F.lit(seed)), "gid").limit(extra))


def subsampled(points: DataFrame, share: float, seed: int = 123456) -> DataFrame:
    """About share of all points, by a hash of the pid."""
    return points.where(F.pmod(F.xxhash64("pid", F.lit(seed)), F.lit(1_000_000)) < share * 1_000_000)


def subsampled_primitives(points: DataFrame, primitives: DataFrame, k: int, extra: int, share: float, least: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(points, primitives) of the k largest patches and extra others by hash, each with share of its points (at least least) assigned."""
    kept = largest_patches(points, k, extra, seed).select("gid")
    return stratified_unassign(points.join(kept, "gid", "left_semi"), share, least), primitives.join(kept, "gid", "left_semi")


def shuffled(points: DataFrame, seed: int = 1) -> DataFrame:
    """points in the order of a hash of their pid: the order in which seeds are tried."""
    return points.orderBy(F.xxhash64("pid", F.lit(seed)), "pid")


def rescaled(points: DataFrame) -> DataFrame:
    """points moved and scaled so that the longest side of their box is one."""
    from quoin.operators.aggregates import box

    b = F.broadcast(box(points))
    side = F.greatest(*[F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"])
    scale = F.when(side > 0, side).otherwise(F.lit(1.0))
    return points.crossJoin(b).withColumns({c: (F.col(c) - F.col(f"min_{c}")) / scale for c in "xyz"}).drop(*[f"{m}_{c}" for m in ("min", "max") for c in "xyz"])
