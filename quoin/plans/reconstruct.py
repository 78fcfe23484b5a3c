"""The whole reconstruction: segment, then rounds of generate, formulate, solve and merge."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.functions.angles import angle_set
from quoin.lineage import cut, written
from quoin.operators import aggregates as ag
from quoin.operators import candidates as cd
from quoin.operators import filters as fl
from quoin.operators import merge, problem, segment, spatial
from quoin.operators import represent as rp
from quoin.sources.schema import ACTIVE, SMALL


def reconstruct(points: DataFrame, scale: float, degrees: float = 10.0, pairwise: float = 1.0, generators: tuple[float, ...] = (90.0,), rounds: int = 3, least: int = 5, unary: float = 1e5, spatial_weight: float | None = None, budget: int = 1000, safe: bool = True, tile: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(points with gid, chosen primitives with a common direction id) of a cloud: pid, place, normal.

    Small patches wait (status 2) until the significance they need, halved each round, lets them in.
    The first round allows parallels only, later ones the generators' angles, of which each direction
    keeps to the one its active primitives vote for. Candidates are safe: at an ideal angle to all of
    their direction. Each round is solved again on one representative per direction, whatever
    their number of candidates, and the result is carried back. Patches whose candidates don't fit the budget wait too; rounds are added until none
    is left. tile, if given, is the side of the tiles that the cloud is grown in.
    """
    limit = math.radians(degrees)
    if not segment.is_oriented(points):
        points = cut(segment.oriented(points, scale))
    points, prims = segment.patchify(points, scale, limit, least, tile=tile)
    points, prims = written(points), written(prims)
    need = 4.0
    k, left = 0, 0
    while k < rounds or left:
        angles = angle_set([] if k == 0 else list(generators))
        signif = ag.significance(ag.moments(points.where("gid is not null")))
        prims = written(fl.promoted(prims.withColumn("status", F.when(F.col("status") == ACTIVE, F.lit(ACTIVE)).otherwise(F.col("status"))), points, signif, least, need, scale))
        made, left = cd.generate(prims, points, angles, limit, budget, generators=[math.radians(x) for x in generators] if k else None, safe=safe and k > 0)
        made = written(made)
        prims = written(fl.chosen_only(prims, made))
        if not made.isEmpty():
            prims = written(_solved(points, prims, made, scale, angles, unary, pairwise, spatial_weight, budget))
            prims = written(_solved_again(points, prims, signif, scale, angles, limit, unary, pairwise, spatial_weight))
        points, prims = (written(table) for table in merge.merged(points, prims, scale))
        need = need / 2 if not left else need
        k += 1
    points = merge.adopted(points, prims.where(F.col("status") != SMALL), scale)
    return points, prims


def _solved_again(points: DataFrame, prims: DataFrame, signif: DataFrame, scale: float, angles: list[float], limit: float, unary: float, pairwise: float, spatial_weight: float | None) -> DataFrame:
    """prims with the result of the second level: the problem of one representative per direction, however many candidates they have.

    The active patches fit the budget, so there are at most so many directions, and the problem holds at most their square.
    """
    active = prims.where(F.col("status") == ACTIVE)
    marked, best = rp.represent(points, active, signif)
    again = written(cd.with_own(best, cd.transplanted(best, angles, limit)))
    solved = written(_solved(marked, best, again, scale, angles, unary, pairwise, spatial_weight, again.count()))
    back = rp.represent_back(active, solved.select(F.col("gid"), "nx", "ny", "nz").join(best.select("gid", "did"), "gid"), angles)
    ways = solved.select("gid", F.col("did").alias("_new")).join(best.select("gid", F.col("did").alias("did")), "gid").select("did", "_new")
    back = back.join(F.broadcast(ways), "did", "left").withColumn("did", F.coalesce("_new", "did")).select(*prims.columns)
    return back.unionByName(prims.where(F.col("status") != ACTIVE))


def _solved(points: DataFrame, prims: DataFrame, made: DataFrame, scale: float, angles: list[float], unary: float, pairwise: float, spatial_weight: float | None, budget: int) -> DataFrame:
    """prims with the chosen candidates' directions and normals, those chosen active."""
    near = spatial.patch_proximity(points, 2 * scale)
    terms = problem.formulate(points, made, near, angles, unary, pairwise, pairwise / 10 if spatial_weight is None else spatial_weight)
    terms = {n: written(d) for n, d in terms.items()}
    chosen = problem.select(terms, budget).where("status = 1").select("gid", "did", *[F.col(c).alias("_" + c) for c in ("px", "py", "pz", "nx", "ny", "nz")])
    out = prims.withColumnRenamed("did", "_old").join(chosen, "gid", "left").withColumn("did", F.coalesce("did", "_old")).withColumn("status", F.when(F.col("_px").isNull(), F.col("status")).otherwise(F.lit(ACTIVE)).cast("byte"))
    return out.withColumns({c: F.coalesce("_" + c, c) for c in ("px", "py", "pz", "nx", "ny", "nz")}).drop("_old", "_px", "_py", "_pz", "_nx", "_ny", "_nz").select(*prims.columns)
