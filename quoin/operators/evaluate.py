"""Scores against ground truth."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.functions import geometry as g
from quoin.lineage import cut
from quoin.operators import joins as jn
from quoin.operators import tiles


def relation_scores(truth: DataFrame, estimate: DataFrame, matches: DataFrame) -> DataFrame:
    """One row (precision, recall, f): edges (src, dst) of the estimate that are edges of the truth under matches (gid_a of truth, gid_b of estimate)."""
    name = matches.select(F.col("gid_b"), F.col("gid_a"))
    e = estimate.join(name.toDF("src", "s"), "src", "left").join(name.toDF("dst", "d"), "dst", "left").select(F.least("s", "d").alias("u"), F.greatest("s", "d").alias("v"))
    t = truth.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    hits = e.where("u is not null and v is not null").distinct().join(t, ["u", "v"], "left_semi").agg(F.count("*").alias("hits"))
    sizes = e.agg(F.count("*").alias("ne")).crossJoin(t.agg(F.count("*").alias("nt"))).crossJoin(hits)
    return _scores(sizes)


def _scores(sizes: DataFrame) -> DataFrame:
    p, r = F.try_divide("hits", "ne"), F.try_divide("hits", "nt")
    p, r = F.coalesce(p.cast("double"), F.lit(0.0)), F.coalesce(r.cast("double"), F.lit(0.0))
    return sizes.select(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f"))


def pair_scores(primitives: DataFrame, rules: Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """relation_scores() of relations that a rule tells from two rows, where estimate and truth name primitives alike: pairs are counted by tiles and never rows.

    rules(a, b) gets the number columns of primitives (gid differs) as a column and as a row, and tells which pairs of them are edges of the truth
    and of the estimate; each pair counts once.
    """
    names = [c for c in primitives.columns if c != "gid"]

    def run(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        left, right = (dict(zip(names, tiles.numbers(f, *names), strict=True)) for f in (a, b))
        out = np.zeros(3, np.int64)
        for some in tiles.chunks(len(a)):
            later = tiles.later(a, b, some, same)
            truth, found = (x & later for x in rules({c: x[some, None] for c, x in left.items()}, right))
            out += [found.sum(), truth.sum(), (truth & found).sum()]
        return pd.DataFrame([out], columns=["ne", "nt", "hits"])

    return _scores(tiles.within(primitives, run, "ne long, nt long, hits long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("ne", "nt", "hits")]))


def unambiguous(near: DataFrame, most: int = 1, tolerance: float = 0.2) -> DataFrame:
    """(pid, tid, distance): the nearest triangle of rows pid, tid, distance, tnx, tny, tnz; points near more than most triangles whose normals differ by over tolerance from the first one's (by tid) are left out."""
    first = near.groupBy("pid").agg(F.min_by(F.struct("tnx", "tny", "tnz"), "tid").alias("f"))
    turned = near.join(first, "pid").withColumn("a", g.folded(g.angle(g.Vec.of("tnx", "tny", "tnz"), g.Vec(F.col("f.tnx"), F.col("f.tny"), F.col("f.tnz")))))
    best = turned.groupBy("pid").agg(F.count("*").alias("n"), F.max("a").alias("worst"), F.min(F.struct("distance", "tid")).alias("b"))
    return best.where(~((F.col("n") > most) & (F.col("worst") > tolerance))).select("pid", "b.tid", "b.distance")


def triangle_assignment(points: DataFrame, triangles: DataFrame, scale: float, most: int = 1, tolerance: float = 0.2) -> DataFrame:
    """(pid, tid, distance) of points near a triangle, as unambiguous() gives it; triangles may have normals (tnx, tny, tnz) of their own.

    A point may be near very many triangles, so pairs are never rows: points and triangles meet by tiles, once for the nearest, the first and how
    many there are, and once more for the worst angle of points near more than most.
    """
    if "tnx" not in triangles.columns:
        normal = g.triangle_normal(*[g.Vec.of(c + "x", c + "y", c + "z") for c in "abc"])
        triangles = triangles.withColumns({"tnx": normal.x, "tny": normal.y, "tnz": normal.z})
    corners = [c + k for c in "abc" for k in "xyz"]
    own = cut(triangles.select("tid", *corners, "tnx", "tny", "tnz"))
    counted = cut(jn.triangle_counts(points, own, scale, ("tnx", "tny", "tnz")))
    asked = points.select("pid", "x", "y", "z").join(counted.where(F.col("n") > most).select("pid", "first"), "pid").select("pid", "x", "y", "z", *[F.col(f"first.tn{k}").alias(f"f{k}") for k in "xyz"])

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        first, normals, out = np.stack(tiles.numbers(a, "fx", "fy", "fz")), np.stack(tiles.numbers(b, "tnx", "tny", "tnz")), []
        for i, j, _ in jn.triangle_pairs(a, b, scale):
            u, v = normals[:, j], first[:, i]
            cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
            angle = np.nan_to_num(np.arctan2(np.sqrt(cross[0] ** 2 + cross[1] ** 2 + cross[2] ** 2), u[0] * v[0] + u[1] * v[1] + u[2] * v[2]), nan=0.0)
            angle = np.where(angle > math.pi / 2, math.pi - angle, angle)
            starts = np.flatnonzero(np.diff(i, prepend=-1))
            if len(i):
                out.append(pd.DataFrame({"pid": a["pid"].to_numpy()[i[starts]], "worst": np.maximum.reduceat(angle, starts)}))
        return tiles.together(out, "pid long, worst double")

    worst = tiles.between(asked, own, run, "pid long, worst double", "pid", "tid").groupBy("pid").agg(F.max("worst").alias("worst"))
    left = counted.join(worst.where(F.col("worst") > tolerance), "pid", "left_anti")
    return left.select("pid", "best.tid", "best.distance")


def recall(projections: DataFrame, limit: float) -> DataFrame:
    """Share of points whose truth (tx, ty, tz) and estimate (ex, ey, ez) projections are within limit."""
    d = g.Vec.of("tx", "ty", "tz").minus(g.Vec.of("ex", "ey", "ez")).norm()
    return projections.agg(F.avg(F.when(d <= limit, 1.0).otherwise(0.0)).alias("recall"))


def angle_difference_errors(truth: DataFrame, estimate: DataFrame, share: float = 1.0, seed: int = 1) -> DataFrame:
    """(error): of pairs of matched primitives, the truth's angle against the estimate's; a hashed share of all pairs."""
    both = truth.select("gid", *[F.col(k).alias("t" + k) for k in ("nx", "ny", "nz")]).join(estimate.select("gid", "nx", "ny", "nz"), "gid")
    a, b = (both.select(*[F.col(c).alias(f"{c}_{s}") for c in both.columns]) for s in "ab")
    pairs = jn.beside(a, b, F.col("gid_a") < F.col("gid_b"), ("gid_a", "gid_b")).where(F.pmod(F.xxhash64("gid_a", "gid_b", F.lit(seed)), F.lit(10_000)) < share * 10_000)
    t = g.angle(g.Vec.of("tnx_a", "tny_a", "tnz_a"), g.Vec.of("tnx_b", "tny_b", "tnz_b"))
    e = g.angle(g.Vec.of("nx_a", "ny_a", "nz_a"), g.Vec.of("nx_b", "ny_b", "nz_b"))
    return pairs.select("gid_a", "gid_b", F.abs(t - e).alias("error"))
