"""The second-level problem: one representative per direction, and its result carried back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import angles as an
from quoin.functions import geometry as g
from quoin.operators import aggregates as ag
from quoin.operators import joins as jn
from quoin.operators import windows


def represent(points: DataFrame, primitives: DataFrame, significance: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points, representatives): the most significant primitive of each direction; points of other patches lose theirs."""
    measured = primitives.drop("significance").join(significance.select("gid", "significance"), "gid", "left")
    best = ag.representatives(measured.withColumn("significance", F.coalesce("significance", F.lit(-1.0))))
    keep = best.select("gid", F.lit(1).alias("_keep"))
    return points.join(keep, "gid", "left").withColumn("gid", F.when(F.col("_keep") == 1, F.col("gid"))).drop("_keep"), best


def represent_back(primitives: DataFrame, solved: DataFrame, angles: list[float]) -> DataFrame:
    """primitives with the directions that the second level chose for their representatives (did, nx, ny, nz)."""
    ways = solved.select("did", F.col("nx").alias("rx"), F.col("ny").alias("ry"), F.col("nz").alias("rz"))
    return jn.substituted(primitives, ways, angles)


def merged_directions(lines: DataFrame, angles: list[float], tolerance: float = an.HALF_DEGREE) -> DataFrame:
    """lines whose did is that of the smallest other gid at an ideal angle (within tolerance) to them, itself included."""
    a, b = (lines.select(*[F.col(c).alias(f"{c}_{s}") for c in ("gid", "did", "nx", "ny", "nz")]) for s in "ab")
    diff = an.nearest(g.angle(g.Vec.of("nx_a", "ny_a", "nz_a"), g.Vec.of("nx_b", "ny_b", "nz_b")), angles)["diff"]
    first = jn.beside(b, a, F.col("gid_b") <= F.col("gid_a"), ("gid_b", "gid_a")).where((diff < tolerance) | (F.col("gid_a") == F.col("gid_b"))).groupBy(F.col("gid_a").alias("gid")).agg(F.min_by("did_b", "gid_b").alias("did"))
    return lines.drop("did").join(first, "gid")


def perfect_relations(primitives: DataFrame, angles: list[float], limit: float) -> DataFrame:
    """(gid_a, gid_b, index) of pairs at an ideal angle to within limit: what a viewer draws as lines."""
    return jn.pair_angles(primitives, angles, limit).select("gid_a", "gid_b", "index")


def unique_ids(primitives: DataFrame) -> DataFrame:
    """primitives with lid, the place in their patch, and uid, a running number by (gid, lid)."""
    own = primitives.withColumn("lid", F.row_number().over(Window.partitionBy("gid").orderBy("did")) - 1)
    return windows.numbered(own, "gid", "lid", name="uid")


def shared_volumes(extents: DataFrame, pairs: DataFrame) -> DataFrame:
    """(gid_a, gid_b, similarity) of listed pairs: 1 - (V - (v_a + v_b)) / V with V the PCA box of both corner sets and v the box of each."""

    def volume(corners: list) -> float:
        x = np.array([[c["x"], c["y"], c["z"]] for c in corners])
        d = x - x.mean(axis=0)
        p = d @ np.linalg.eigh(d.T @ d)[1]
        return float(np.prod(np.maximum(p.max(axis=0) - p.min(axis=0), 1e-9)))

    def run(batches):
        for batch in batches:
            out = []
            for a, b in zip(batch.ca, batch.cb, strict=True):
                whole = volume([*a, *b])
                out.append(1 - (whole - (volume(a) + volume(b))) / whole)
            yield pd.DataFrame({"gid_a": batch.gid_a, "gid_b": batch.gid_b, "similarity": out})

    own = extents.select("gid", "corners")
    joined = pairs.select("gid_a", "gid_b").join(own.toDF("gid_a", "ca"), "gid_a").join(own.toDF("gid_b", "cb"), "gid_b")
    return joined.mapInPandas(run, "gid_a long, gid_b long, similarity double")
