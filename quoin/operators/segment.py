"""Segmentation of point clouds into patches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.functions import geometry as g
from quoin.lineage import cut
from quoin.operators import fit, graph, spatial
from quoin.operators.aggregates import populations
from quoin.sources.schema import UNSET


def local_fits(points: DataFrame, r: float, kind: str = "plane", refit: int = 2) -> DataFrame:
    """A robust primitive around each point from its neighbours within r (three nearest if fewer than two): gid is the pid."""
    near = spatial.soft_radius(points, r).select(F.col("pid_a").alias("gid"), F.col("pid_b").alias("pid"))
    own = points.select(F.col("pid").alias("gid"), "pid")
    members = near.unionByName(own).join(points.select("pid", "x", "y", "z"), "pid")
    return fit.fit_patches(members, kind, r, refit)


def oriented(points: DataFrame, r: float) -> DataFrame:
    """points with the normal of their local fit; those without a fit keep theirs."""
    n = local_fits(points, r).select(F.col("gid").alias("pid"), *[F.col(f"n{k}").alias(f"m{k}") for k in "xyz"])
    return points.join(n, "pid", "left").withColumns({f"n{k}": F.coalesce(f"m{k}", f"n{k}") for k in "xyz"}).drop("mx", "my", "mz")


def is_oriented(points: DataFrame) -> bool:
    """Whether over half the points have a normal longer than 0.1."""
    r = points.agg(F.avg(F.when(g.Vec.of("nx", "ny", "nz").norm() > 0.1, 1.0).otherwise(0.0)).alias("share")).first()
    return (r["share"] or 0.0) > 0.5


class _Grid:
    """Free points by cell, for radius searches within one task."""

    def __init__(self, xyz: np.ndarray, r: float, patch: np.ndarray):
        self.xyz, self.r, self.patch = xyz, r, patch
        self.at = np.floor(xyz / r).astype(np.int64)
        rows: dict[tuple, list[int]] = {}
        for i, c in enumerate(map(tuple, self.at.tolist())):
            rows.setdefault(c, []).append(i)
        self.cells = {c: np.array(own) for c, own in rows.items()}

    def near(self, i: int) -> np.ndarray:
        """Points without a patch within r of i, the nearest first; cells lose those that have one."""
        x, y, z = self.at[i].tolist()
        found = []
        for c in ((x + a, y + b, z + d) for a in (-1, 0, 1) for b in (-1, 0, 1) for d in (-1, 0, 1)):
            own = self.cells.get(c)
            if own is not None:
                free = own[self.patch[own] < 0]
                if len(free) < len(own):
                    self.cells[c] = free
                found.append(free)
        rows = np.concatenate(found) if found else np.empty(0, np.int64)
        d2 = ((self.xyz[rows] - self.xyz[i]) ** 2).sum(axis=1)
        keep = d2 < self.r**2
        rows, d2 = rows[keep], d2[keep]
        return rows[np.lexsort((rows, d2))]


AHEAD = 64


def grow(xyz: np.ndarray, normals: np.ndarray, r: float, limit: float) -> np.ndarray:
    """Patch number per point: from each free point in order, depth first, neighbours within r whose normal is within limit of the patch's running mean join."""
    patch = np.full(len(xyz), -1, np.int64)
    grid = _Grid(xyz, r, patch)
    for seed in range(len(xyz)):
        if patch[seed] >= 0:
            continue
        patch[seed], total, count = seed, normals[seed].copy(), 1
        # a point is put here once, when it joins
        stack = [seed]
        while stack:
            near, at = grid.near(stack.pop()), 0
            while at < len(near):
                # some neighbours at a time against the mean; the first to join changes it for those after
                some, mean = near[at : at + AHEAD], total / count
                n = normals[some]
                cross = np.stack([mean[1] * n[:, 2] - mean[2] * n[:, 1], mean[2] * n[:, 0] - mean[0] * n[:, 2], mean[0] * n[:, 1] - mean[1] * n[:, 0]])
                a = np.arctan2(np.sqrt((cross * cross).sum(axis=0)), n @ mean)
                joins = ~(np.minimum(a, np.pi - a) > limit)
                first = int(joins.argmax())
                if not joins[first]:
                    at += len(some)
                    continue
                j = int(some[first])
                patch[j] = seed
                total, count = total + normals[j], count + 1
                stack.append(j)
                at += first + 1
    return patch


def region_grow(points: DataFrame, r: float, limit: float, scene: str | None = None) -> DataFrame:
    """points with gid, the smallest pid of their patch. Growth is sequential, so each scene (a column; all points if not given) is one group; scenes are bounded clouds.

    Points go in the order of their pid, which makes reruns agree. For clouds beyond one task use connected_patches().
    """
    kind = "pid long, x double, y double, z double, nx double, ny double, nz double, gid long"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pid").reset_index(drop=True)
        patch = grow(frame[["x", "y", "z"]].to_numpy(), frame[["nx", "ny", "nz"]].to_numpy(), r, limit)
        frame["gid"] = frame.pid.to_numpy()[patch]
        return frame[["pid", "x", "y", "z", "nx", "ny", "nz", "gid"]]

    keyed = points.withColumn("_scene", F.col(scene) if scene else F.lit(0))
    return keyed.select("_scene", "pid", "x", "y", "z", "nx", "ny", "nz").groupBy("_scene").applyInPandas(lambda f: run(f.drop(columns="_scene")), kind)


def region_grow_tiled(points: DataFrame, r: float, limit: float, tile: float) -> DataFrame:
    """points with gid, the smallest pid of their patch, for clouds beyond one task: grown in each cubic tile of side tile, then joined at the seams.

    Patches of different tiles are one if some of their points are within r of each other and their
    mean normals within limit. Inside a tile growth is that of region_grow(); a cloud within one tile
    gives the same patches. A tile's points are one group, so tile is chosen by density.
    """
    side = F.concat_ws(",", *[F.floor(F.col(c) / tile).cast("string") for c in "xyz"])
    grown = cut(region_grow(points.withColumn("_tile", side), r, limit, "_tile").withColumn("_tile", side))
    ways = cut(grown.groupBy("gid").agg(*[F.avg(c).alias(c) for c in ("nx", "ny", "nz")]))
    near = F.least(*[F.least(F.pmod(F.col(c), F.lit(tile)), tile - F.pmod(F.col(c), F.lit(tile))) for c in "xyz"])
    rim = grown.where(near <= r)
    seams = spatial.radius_join(rim, rim, r, ("gid", "_tile"), ("gid", "_tile")).where("_tile_a <> _tile_b and gid_a < gid_b").select("gid_a", "gid_b").distinct()
    own = lambda s: ways.toDF(f"gid_{s}", *[f"{c}_{s}" for c in ("nx", "ny", "nz")])
    angle = g.folded(g.angle(g.Vec.of("nx_a", "ny_a", "nz_a"), g.Vec.of("nx_b", "ny_b", "nz_b")))
    joined = graph.components(seams.join(own("a"), "gid_a").join(own("b"), "gid_b").where(angle <= limit), "gid_a", "gid_b")
    out = grown.join(joined.withColumnRenamed("node", "gid"), "gid", "left").withColumn("gid", F.coalesce("component", "gid"))
    return out.drop("component", "_tile").select("pid", "x", "y", "z", "nx", "ny", "nz", "gid")


def connected_patches(points: DataFrame, r: float, limit: float) -> DataFrame:
    """points with gid, the component of neighbours within r whose normals are within limit of each other: an order-free variant for clouds of any size."""
    n = ("nx", "ny", "nz")
    pairs = spatial.radius_join(points, points, r, n, n).where("pid_a < pid_b")
    angle = g.folded(g.angle(g.Vec.of("nx_a", "ny_a", "nz_a"), g.Vec.of("nx_b", "ny_b", "nz_b")))
    parts = graph.components(pairs.where(angle <= limit).select(F.col("pid_a").alias("src"), F.col("pid_b").alias("dst")))
    return points.drop("gid").join(parts.select(F.col("node").alias("pid"), F.col("component").alias("gid")), "pid", "left").withColumn("gid", F.coalesce("gid", "pid"))


def patchify(points: DataFrame, r: float, limit: float, least: int, kind: str = "plane", refit: int = 2, tile: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(points with gid, primitives) of grown patches of at least least points, one robust primitive each; did is the gid, status unset. Other points lose their patch.

    tile, if given, is the side of the tiles that large clouds are grown in.
    """
    grown = region_grow(points, r, limit) if tile is None else region_grow_tiled(points, r, limit, tile)
    large = populations(grown).where(F.col("n") >= least).select("gid", F.lit(1).alias("_large"))
    tagged = grown.join(large, "gid", "left").withColumn("gid", F.when(F.col("_large") == 1, F.col("gid"))).drop("_large")
    prims = fit.fit_patches(tagged, kind, r, refit).drop("n").withColumn("did", F.col("gid")).withColumn("status", F.lit(UNSET)).withColumn("gen_angle", F.lit(None).cast("double"))
    return tagged, prims
