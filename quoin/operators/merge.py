"""Merging of primitives and adoption of orphans, as driver-led rounds."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.functions import geometry as g
from quoin.lineage import cut, written
from quoin.operators import fit, graph
from quoin.operators import joins as jn


def merge_round(points: DataFrame, primitives: DataFrame, scale: float, kind: str = "plane", limit: float = 0.175) -> tuple[DataFrame, DataFrame, int]:
    """(points, primitives, merged): primitives of one direction, parallel to within limit, whose extents contain each other within scale become one; its points and fit are anew.

    Perpendicular sides that share a direction id (one orientation system) and an edge stay apart.

    Chains of mergeable pairs merge as a whole, which is what repeated pairwise rounds reach.
    """
    extents = fit.plane_extents(points.where("gid is not null"), primitives, scale)
    pairs = jn.mergeable_planes(extents, scale)
    own = primitives.select("gid", "did", "nx", "ny", "nz")
    both = pairs.join(own.toDF(*[f"{c}_a" for c in own.columns]), "gid_a").join(own.toDF(*[f"{c}_b" for c in own.columns]), "gid_b")
    turn = g.folded(g.angle(g.Vec.of("nx_a", "ny_a", "nz_a"), g.Vec.of("nx_b", "ny_b", "nz_b")))
    same = both.where("did_a = did_b").where(turn < limit)
    edges = cut(same.select(F.col("gid_a").alias("src"), F.col("gid_b").alias("dst")))
    if edges.isEmpty():
        return points, primitives, 0
    to = graph.components(edges).where("node <> component").select(F.col("node").alias("gid"), F.col("component").alias("_to"))
    moved = written(points.join(to, "gid", "left").withColumn("gid", F.coalesce("_to", "gid")).drop("_to"))
    gone = to.select("gid")
    changed = to.select(F.col("_to").alias("gid")).distinct()
    kept = primitives.join(gone, "gid", "left_anti")
    fresh = fit.fit_patches(moved.join(changed, "gid", "left_semi"), kind, scale).select("gid", *[F.col(c).alias("_" + c) for c in ("px", "py", "pz", "nx", "ny", "nz")])
    new = kept.join(fresh, "gid", "left").withColumns({c: F.coalesce("_" + c, c) for c in ("px", "py", "pz", "nx", "ny", "nz")}).drop("_px", "_py", "_pz", "_nx", "_ny", "_nz")
    return moved, written(new), gone.count()


def merged(points: DataFrame, primitives: DataFrame, scale: float, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """merge_round() until nothing changes, or rounds times at most."""
    for _ in itertools.count() if rounds is None else range(rounds):
        points, primitives, n = merge_round(points, primitives, scale)
        if not n:
            break
    return points, primitives


def adopted(points: DataFrame, primitives: DataFrame, scale: float, rounds: int | None = None) -> DataFrame:
    """points whose orphans are given to a finite plane within scale, extents growing with each round, until none is adopted, or rounds times at most."""
    for _ in itertools.count() if rounds is None else range(rounds):
        extents = fit.plane_extents(points.where("gid is not null"), primitives, scale)
        new = cut(jn.adopt_finite(points, extents, scale).select("pid", F.col("gid").alias("_gid")))
        if new.isEmpty():
            break
        points = written(points.join(new, "pid", "left").withColumn("gid", F.coalesce("gid", "_gid")).drop("_gid"))
    return points


def not_compared(pairs: DataFrame, compared: DataFrame) -> DataFrame:
    """Pairs (gid_a, gid_b) that aren't in compared, whichever way round."""
    known = compared.select(F.least("gid_a", "gid_b").alias("_a"), F.greatest("gid_a", "gid_b").alias("_b")).distinct()
    return pairs.join(known, (F.least("gid_a", "gid_b") == F.col("_a")) & (F.greatest("gid_a", "gid_b") == F.col("_b")), "left_anti")


def still_compared(compared: DataFrame, moved: DataFrame) -> DataFrame:
    """compared without the pairs of patches (gid) that changed since."""
    gone = moved.select("gid").distinct()
    return compared.join(gone.withColumnRenamed("gid", "gid_a"), "gid_a", "left_anti").join(gone.withColumnRenamed("gid", "gid_b"), "gid_b", "left_anti").select("gid_a", "gid_b")


def changed(before: DataFrame, after: DataFrame) -> bool:
    """Whether the sets of (gid, did) differ."""
    a, b = before.select("gid", "did"), after.select("gid", "did")
    return not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty())
