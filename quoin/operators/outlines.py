"""Outlines of flat patches: alpha shapes from the arcs that neighbours block around each point."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import geometry as g
from quoin.operators import graph
from quoin.operators.spatial import dealt

TOLERANCE = 1e-9


def in_plane(points: DataFrame, planes: DataFrame) -> DataFrame:
    """(gid, pid, u, v): points (gid, pid, x, y, z) in the frame of their patch's plane (gid, px, py, pz, nx, ny, nz), whose first axis is the normal crossed with the coordinate axis least along it."""
    n = g.Vec.of("nx", "ny", "nz").unit()
    least = F.when((F.abs(n.x) <= F.abs(n.y)) & (F.abs(n.x) <= F.abs(n.z)), 0).when(F.abs(n.y) <= F.abs(n.z), 1).otherwise(2)
    axis = g.Vec(*[F.when(least == k, 1.0).otherwise(0.0) for k in range(3)])
    first = n.cross(axis).unit()
    second = n.cross(first)
    frames = planes.select("gid", "px", "py", "pz", first.struct().alias("_u"), second.struct().alias("_v"))
    off = g.Vec.of("x", "y", "z").minus(g.Vec.of("px", "py", "pz"))
    return points.select("gid", "pid", "x", "y", "z").join(frames, "gid").select("gid", "pid", off.dot(g.Vec.field(F.col("_u"))).alias("u"), off.dot(g.Vec.field(F.col("_v"))).alias("v"))


def alpha_edges(points: DataFrame, radius: float) -> DataFrame:
    """(gid, src, dst, ua, va, ub, vb): the directed edges of each patch's alpha shape, the shape on their left; points are (gid, pid, u, v).

    An edge joins two points of a patch that a disc of the radius touches from outside while no point
    is in it. A disc that touches a point may stand anywhere around it but for one arc per neighbour
    within twice the radius, so a point's edges end the gaps between its arcs: a window per point over
    its neighbours, found by grid cells. Edges without area on either side come both ways. Points at
    one place are the one of the smallest pid; rows with a null are left out; no points give no rows.
    """
    if not 0 < radius < math.inf:
        raise ValueError("the radius must be positive and finite; the outline without one is the convex hull")
    reach = 2.0 * radius
    own = points.select(F.col("gid").cast("long").alias("gid"), F.col("pid").cast("long").alias("pid"), F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v")).dropna()
    own = own.groupBy("gid", "u", "v").agg(F.min("pid").alias("pid"))
    # points stay in their cells and neighbours come there, so a point's pairs are made where its window is, and never moved
    celled = own.withColumns({"i": F.floor(F.col("u") / reach), "j": F.floor(F.col("v") / reach)})
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    a = celled.select("gid", "i", "j", F.col("pid").alias("src"), F.col("u").alias("ua"), F.col("v").alias("va"))
    b = celled.withColumn("o", around).select("gid", (F.col("i") + F.col("o.a")).alias("i"), (F.col("j") + F.col("o.b")).alias("j"), F.col("pid").alias("dst"), F.col("u").alias("ub"), F.col("v").alias("vb"))
    du, dv = F.col("ub") - F.col("ua"), F.col("vb") - F.col("va")
    cell = ["gid", "i", "j"]
    pairs = dealt(a, *cell).join(dealt(b, *cell).hint("shuffle_hash"), cell).where("src <> dst").withColumn("d", F.sqrt(du * du + dv * dv)).where(F.col("d") < reach * (1 - TOLERANCE))
    # centres at these angles around src are nearer to dst than the radius
    half = F.acos(F.col("d") / reach)
    arcs = pairs.withColumn("half", half).withColumn("start", F.pmod(F.atan2(dv, du) - F.col("half"), F.lit(2 * math.pi))).withColumn("end", F.col("start") + 2 * F.col("half"))
    point = Window.partitionBy(*cell, "src")
    in_turn = point.orderBy(F.round("start", 9), "d", "dst")
    before = F.max("end").over(in_turn.rowsBetween(Window.unboundedPreceding, -1))
    around_once = F.max("end").over(point) - 2 * math.pi
    gaps = arcs.withColumn("blocked", F.greatest(before, around_once)).where(F.col("start") > F.col("blocked") + TOLERANCE)
    return gaps.select("gid", "src", "dst", "ua", "va", "ub", "vb")


def rings(edges: DataFrame) -> DataFrame:
    """(gid, ring, n_edges, area) of alpha_edges(): connected edges, named by their smallest pid, and the area on their left, negative for a hole; pids are unique over all patches."""
    part = graph.components(edges).withColumnRenamed("node", "src")
    turn = F.col("ua") * F.col("vb") - F.col("ub") * F.col("va")
    return edges.join(part, "src").groupBy("gid", F.col("component").alias("ring")).agg(F.count("*").alias("n_edges"), (F.sum(turn) / 2).alias("area"))


def shapes(edges: DataFrame) -> DataFrame:
    """(gid, n_edges, area) of alpha_edges(): a patch's area is that of all its rings, holes subtracted."""
    turn = F.col("ua") * F.col("vb") - F.col("ub") * F.col("va")
    return edges.groupBy("gid").agg(F.count("*").alias("n_edges"), (F.sum(turn) / 2).alias("area"))


def largest(edges: DataFrame) -> DataFrame:
    """edges of each patch's ring of the largest area (of the smallest name if tied)."""
    best = rings(edges).groupBy("gid").agg(F.min_by("ring", F.struct(-F.col("area"), F.col("ring"))).alias("ring"))
    part = graph.components(edges).select(F.col("node").alias("src"), F.col("component").alias("ring"))
    return edges.join(part, "src").join(best, ["gid", "ring"], "left_semi").select(edges.columns)
