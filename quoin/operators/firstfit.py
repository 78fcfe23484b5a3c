"""First-fit clusters of directions: the sequential choice as rounds over cells of the sphere."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.functions import geometry as g
from quoin.lineage import written

SIDES = ("x", "y", "z")


def _reaching(rows: DataFrame, leads: DataFrame, near: float) -> DataFrame:
    """rows (pid, nx, ny, nz and cell) beside the leads (lead, lx, ly, lz) within the angle whose cosine is near; leads, at most one per cell, are broadcast with the cells around them and around their opposite."""
    around = F.explode(F.array(*[F.struct(*[F.lit(d).alias(k) for d, k in zip(o, SIDES, strict=True)]) for o in itertools.product((-1, 0, 1), repeat=3)]))
    both = leads.withColumn("side", F.explode(F.array(F.lit(1.0), F.lit(-1.0)))).withColumn("o", around)
    laid = both.select("lead", "lx", "ly", "lz", *[(F.floor(F.col("side") * F.col(f"l{k}") / F.col("width")) + F.col(f"o.{k}")).alias(f"c{k}") for k in SIDES]).distinct()
    close = F.abs(g.Vec.of("nx", "ny", "nz").dot(g.Vec.of("lx", "ly", "lz"))) >= near
    return rows.join(F.broadcast(laid), [f"c{k}" for k in SIDES]).where(close)


def first_fit(directions: DataFrame, degrees: float) -> DataFrame:
    """(pid, cluster) of directions (pid, nx, ny, nz): going by pid, a direction joins the first cluster whose opening direction is within degrees of it, else opens one; a cluster is named by its opener.

    Opposite directions are equal. A direction opens a cluster exactly if no smaller opener is within
    reach, so each round takes the smallest undecided pid of every cell of the sphere, opens clusters
    at those without a smaller undecided one within reach, and settles what they reach. A round passes
    once over the undecided, against at most one candidate a cell; the cells are as wide as the reach,
    so their number depends on degrees alone (which is at least 1, to bound what is broadcast). Null and zero
    directions are left out, repeated rows (of one pid, the smallest direction) are one, and no rows give none.
    """
    if not 1 <= degrees < 90:
        raise ValueError("the angle must be from 1 up to less than 90 degrees")
    near, width = math.cos(math.radians(degrees)), 2 * math.sin(math.radians(degrees) / 2) * (1 + 1e-9)
    unit = g.Vec.of("nx", "ny", "nz").unit()
    # written first: the filters that are inferred from lengths in further steps would outgrow a method
    own = written(directions.select(F.col("pid").cast("long").alias("pid"), *[c.alias(k) for k, c in zip(("nx", "ny", "nz"), unit, strict=True)]))
    own = own.dropna().where("nx <> 0 or ny <> 0 or nz <> 0")
    own = own.groupBy("pid").agg(F.min(F.struct("nx", "ny", "nz")).alias("n")).select("pid", "n.*")
    every = written(own.withColumns({f"c{k}": F.floor(F.col(f"n{k}") / width) for k in SIDES}))
    left, opened = every, None
    while not left.isEmpty():
        leads = left.groupBy(*[f"c{k}" for k in SIDES]).agg(F.min_by(F.struct("pid", "nx", "ny", "nz"), "pid").alias("s")).select(F.col("s.pid").alias("lead"), *[F.col(f"s.n{k}").alias(f"l{k}") for k in SIDES], F.lit(width).alias("width"))
        leads = written(leads)
        waiting = _reaching(left, leads, near).where("pid < lead").select("lead").distinct()
        new = written(leads.join(waiting, "lead", "left_anti"))
        opened = new if opened is None else opened.unionByName(new)
        settled = _reaching(left, new, near).select("pid").distinct()
        left = written(left.join(settled, "pid", "left_anti"))
    if opened is None:
        return every.select("pid", F.col("pid").alias("cluster"))
    return _reaching(every, opened, near).groupBy("pid").agg(F.min("lead").alias("cluster"))
