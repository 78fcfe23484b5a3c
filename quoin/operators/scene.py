"""Whole-scene changes and the synthetic scene generator."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.functions import geometry as g
from quoin.operators.joins import beside


def swapped(points: DataFrame) -> DataFrame:
    """The Gauss sphere: place and normal change roles."""
    return points.withColumns({**{k: F.col("n" + k) for k in "xyz"}, **{"n" + k: F.col(k) for k in "xyz"}})


def sampled(primitives: DataFrame, step: float) -> DataFrame:
    """Grid samples of line primitives (gid, x, y, z, dx, dy, dz, width) at distance step."""
    n = F.floor(F.col("width") / step).cast("int")
    rows = primitives.withColumn("k", F.explode(F.sequence(F.lit(0), n)))
    return rows.select(F.xxhash64("gid", "k").alias("pid"), *[(F.col(k) + F.col("d" + k) * F.col("k") * step).alias(k) for k in "xyz"], (-F.col("dy")).alias("nx"), F.col("dx").alias("ny"), F.lit(0.0).alias("nz"), "gid")


def first_hits(sources: DataFrame, segments: DataFrame, rays: int) -> DataFrame:
    """(sid, ray, gid, x, y): where each of rays evenly spread rays of each source (sid, x, y) first meets a segment (gid, x0, y0, x1, y1)."""
    way = F.col("ray") * (2 * math.pi / rays)
    cast = sources.select("sid", F.col("x").alias("ox"), F.col("y").alias("oy"), F.explode(F.sequence(F.lit(0), F.lit(rays - 1))).alias("ray")).withColumns({"rx": F.cos(way), "ry": F.sin(way)})
    both = beside(cast, segments)
    sx, sy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    cross = F.col("rx") * sy - F.col("ry") * sx
    qx, qy = F.col("x0") - F.col("ox"), F.col("y0") - F.col("oy")
    t = F.when(cross != 0, (qx * sy - qy * sx) / cross)
    u = F.when(cross != 0, (qx * F.col("ry") - qy * F.col("rx")) / cross)
    hits = both.withColumns({"t": t, "u": u}).where("t > 0 and u between 0 and 1")
    best = hits.groupBy("sid", "ray").agg(F.min(F.struct("t", "gid", "ox", "oy", "rx", "ry")).alias("h"))
    return best.select("sid", "ray", "h.gid", (F.col("h.ox") + F.col("h.t") * F.col("h.rx")).alias("x"), (F.col("h.oy") + F.col("h.t") * F.col("h.ry")).alias("y"))


def _noise(seed: int, name: str) -> Column:
    """A number in (0, 1) from the pid, the same on every run."""
    return (F.pmod(F.xxhash64("pid", F.lit(seed), F.lit(name)), F.lit(1_000_003)) + 0.5) / 1_000_003


def _gauss(seed: int, name: str) -> Column:
    return F.sqrt(-2 * F.log(_noise(seed, name + "u"))) * F.cos(2 * math.pi * _noise(seed, name + "v"))


def displacement(points: DataFrame, kind: str, size: float, seed: int = 1) -> DataFrame:
    """(pid, dx, dy, dz) of one layer: uniform in a cube, normal, or bias along the point's normal."""
    if kind == "uniform":
        d = [(2 * _noise(seed, k) - 1) * size for k in "xyz"]
    elif kind == "normal":
        d = [_gauss(seed, k) * size for k in "xyz"]
    elif kind == "bias":
        d = [F.col("n" + k) * size for k in "xyz"]
    else:
        raise ValueError(kind)
    return points.select("pid", *[c.alias("d" + k) for k, c in zip("xyz", d, strict=True)])


def displaced(points: DataFrame, layers: list[DataFrame]) -> DataFrame:
    """points moved by the sum of all layers."""
    if not layers:
        return points
    every = layers[0]
    for layer in layers[1:]:
        every = every.unionByName(layer)
    total = every.groupBy("pid").agg(*[F.sum("d" + k).alias("d" + k) for k in "xyz"])
    return points.join(total, "pid", "left").withColumns({k: F.col(k) + F.coalesce("d" + k, F.lit(0.0)) for k in "xyz"}).drop("dx", "dy", "dz")


def extruded(points: DataFrame, height: float, layers: int) -> DataFrame:
    """A 2D cloud repeated at layers heights up to height."""
    k = F.explode(F.sequence(F.lit(0), F.lit(layers - 1)))
    return points.withColumn("k", k).withColumn("z", F.col("k") * (height / max(1, layers - 1))).withColumn("pid", F.xxhash64("pid", "k")).drop("k")


def box_scene(spark: SparkSession, per_face: int = 200, noise: float = 0.005, seed: int = 1) -> DataFrame:
    """Six unit faces: pid, x, y, z, nx, ny, nz, gid."""
    rows = spark.range(6 * per_face).select(F.col("id").alias("pid"), (F.col("id") % 6).alias("gid"))
    axis, side = (F.col("gid") / 2).cast("int"), F.when(F.col("gid") % 2 == 0, 0.0).otherwise(1.0)
    u, v, e = _noise(seed, "u"), _noise(seed, "v"), _gauss(seed, "n") * noise
    x = F.when(axis == 0, side + e).otherwise(u)
    y = F.when(axis == 1, side + e).when(axis == 0, u).otherwise(v)
    z = F.when(axis == 2, side + e).otherwise(v)
    normal = [F.when(axis == i, 2 * side - 1).otherwise(0.0) for i in range(3)]
    return rows.select("pid", x.alias("x"), y.alias("y"), z.alias("z"), *[c.alias(k) for k, c in zip(("nx", "ny", "nz"), normal, strict=True)], "gid")


def stairs_scene(spark: SparkSession, steps: int = 8, per_strip: int = 50, seed: int = 1) -> DataFrame:
    """steps parallel and steps perpendicular strips."""
    rows = spark.range(2 * steps * per_strip).select(F.col("id").alias("pid"), (F.col("id") % (2 * steps)).alias("gid"))
    k, flat = (F.col("gid") / 2).cast("int"), F.col("gid") % 2 == 0
    u, v = _noise(seed, "u"), _noise(seed, "v")
    return rows.select("pid", F.when(flat, k + u).otherwise(k + 1.0).alias("x"), v.alias("y"), F.when(flat, k.cast("double")).otherwise(k + u).alias("z"), F.when(flat, 0.0).otherwise(1.0).alias("nx"), F.lit(0.0).alias("ny"), F.when(flat, 1.0).otherwise(0.0).alias("nz"), "gid")


def rectangles_scene(spark: SparkSession, cells: int, degrees: list[float], seed: int = 1) -> DataFrame:
    """One line primitive per cell of a grid, at one of the angles by hash: gid, x, y, z, dx, dy, dz, width."""
    angles = F.array(*[F.lit(math.radians(a)) for a in degrees])
    pick = F.element_at(angles, (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(degrees))) + 1).cast("int"))
    return spark.range(cells * cells).select(F.col("id").alias("gid"), (F.col("id") % cells).cast("double").alias("x"), F.floor(F.col("id") / cells).cast("double").alias("y"), F.lit(0.0).alias("z"), F.cos(pick).alias("dx"), F.sin(pick).alias("dy"), F.lit(0.0).alias("dz"), F.lit(0.8).alias("width"))


def rotated_groups(lines: DataFrame, turns: dict[int, float]) -> DataFrame:
    """Lines of each listed group turned about Z by its angle."""
    by = F.lit(0.0)
    for gid, angle in turns.items():
        by = F.when(F.col("gid") == gid, F.lit(float(angle))).otherwise(by)
    turned = g.rotated(g.Vec.of("nx", "ny", "nz"), g.Vec.lit(0, 0, 1), by)
    return lines.withColumns(dict(zip(("nx", "ny", "nz"), turned, strict=True)))
