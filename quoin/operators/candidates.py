"""Candidate generation: directions carried from one primitive to another."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import angles as an
from quoin.functions import geometry as g
from quoin.lineage import cut
from quoin.operators import aggregates as ag
from quoin.operators import filters as fl
from quoin.operators import joins as jn
from quoin.sources.schema import ACTIVE, SMALL, UNSET


def transplanted(primitives: DataFrame, angles: list[float], limit: float) -> DataFrame:
    """Candidates: each primitive that isn't small, at its place, with the direction of every other that is within limit of an ideal angle to it, turned to that angle.

    gid is the receiver's, did the giver's direction; per (gid, did, angle) the one of the smallest
    giver stays; lid counts them.
    """
    own = primitives.where(F.col("status") != SMALL)
    pairs = jn.pair_angles(own, angles, limit, ordered=True).where("did_a <> did_b")
    a = own.select(F.col("gid").alias("gid_a"), "px", "py", "pz", *[F.col(k).alias("o" + k) for k in ("nx", "ny", "nz")])
    b = own.select(F.col("gid").alias("gid_b"), *[F.col(k).alias("g" + k) for k in ("nx", "ny", "nz")])
    joined = pairs.join(a, "gid_a").join(b, "gid_b")
    ideal = F.element_at(F.array(*[F.lit(float(x)) for x in angles]), F.col("index") + 1)
    new = g.plane_from(g.Vec.of("onx", "ony", "onz"), g.Vec.of("gnx", "gny", "gnz"), ideal, F.col("index").isin(0, len(angles) - 1))
    out = joined.select(F.col("gid_a").alias("gid"), F.col("did_b").alias("did"), F.col("gid_b").alias("giver"), F.col("index").alias("angle_id"), "px", "py", "pz", *[c.alias(k) for k, c in zip(("nx", "ny", "nz"), new, strict=True)])
    first = out.withColumn("k", F.row_number().over(Window.partitionBy("gid", "did", "angle_id").orderBy("giver"))).where("k = 1").drop("k", "giver")
    return first.withColumn("lid", F.row_number().over(Window.partitionBy("gid").orderBy("did", "angle_id")))


def with_own(primitives: DataFrame, made: DataFrame) -> DataFrame:
    """Input primitives (lid 0) and the candidates made from them, without near equal ones of a patch and direction."""
    own = primitives.select("gid", "did", F.lit(None).cast("int").alias("angle_id"), "px", "py", "pz", "nx", "ny", "nz", F.lit(0).alias("lid"))
    return fl.deduplicated(own.unionByName(made))


def safe_only(made: DataFrame, existing: DataFrame, angles: list[float], tolerance: float = 1e-6) -> DataFrame:
    """Candidates at an ideal angle to every primitive of their direction: the existing ones, and the candidates (by gid and lid) taken before.

    A direction is one group; candidates are bounded by the selection problem.
    """
    kind = made.schema
    ideal = np.array(angles)

    def run(frame: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["gid", "lid"])
        taken = list(there[["nx", "ny", "nz"]].to_numpy()) if len(there) else []
        keep = []
        for i, n in enumerate(frame[["nx", "ny", "nz"]].to_numpy()):
            if taken:
                t = np.array(taken)
                turn = np.arctan2(np.linalg.norm(np.cross(t, n), axis=1), t @ n)
                if (np.abs(turn[:, None] - ideal[None]).min(axis=1) > tolerance).any():
                    continue
            taken.append(n)
            keep.append(i)
        return frame.iloc[keep]

    return made.groupBy("did").cogroup(existing.select("did", "nx", "ny", "nz").groupBy("did")).applyInPandas(run, kind)


def allowed_angles(primitives: DataFrame, angles: list[float], generators: list[float]) -> DataFrame:
    """(did, angle_id) a direction's candidates may have: the multiples of the generator (radians) that most angles between active primitives vote for; directions without a vote have no rows."""
    active = primitives.where(F.col("status") == ACTIVE)
    votes = ag.generator_votes(ag.angle_histogram(jn.pair_angles(active, angles)), angles, generators)
    rows = [(i, float(gen)) for i, a in enumerate(angles) for gen in generators if abs(a / gen - round(a / gen)) * gen < 1e-6]
    table = primitives.sparkSession.createDataFrame(rows, "angle_id int, generator double")
    # a row for each ideal angle and generator
    return votes.select("did", "generator").join(F.broadcast(table), "generator").select("did", "angle_id")


def only_allowed(made: DataFrame, allowed: DataFrame) -> DataFrame:
    """Candidates at an angle their direction allows; those of directions without rows in allowed stay."""
    known = made.join(allowed.select("did").distinct(), "did", "left_semi").join(allowed, ["did", "angle_id"], "left_semi").select(*made.columns)
    return known.unionByName(made.join(allowed.select("did").distinct(), "did", "left_anti").select(*made.columns))


def limited(made: DataFrame, budget: int, always: DataFrame | None = None) -> tuple[list[int], int]:
    """(gids, left): patches by falling number of candidates, taken while the sum stays within budget, skipping misfits; and how many are left.

    Patches of always are taken first. An error if nothing else fits, as no further round could change that.
    """
    sizes = made.groupBy("gid").agg(F.count("*").alias("n"))
    fixed = sizes.join(always.select("gid").distinct(), "gid", "left_semi").collect() if always is not None else []
    taken, room = [r["gid"] for r in fixed], budget - sum(r["n"] for r in fixed)
    rows = (sizes.join(always.select("gid").distinct(), "gid", "left_anti") if always is not None else sizes).orderBy(F.desc("n"), "gid").collect()
    if room < min((r["n"] for r in rows), default=0):
        raise ValueError(f"{len(rows)} patches to promote don't fit a budget of {budget} candidates; active ones take {budget - room}")
    for r in rows:
        if r["n"] <= room:
            taken.append(r["gid"])
            room -= r["n"]
    return sorted(taken), len(rows) + len(fixed) - len(taken)


def generate(primitives: DataFrame, points: DataFrame, angles: list[float], limit: float, budget: int = 1000, keep_singles: bool = True, least: int = 5, generators: list[float] | None = None, safe: bool = False) -> tuple[DataFrame, int]:
    """(candidates, patches left over) of one round: transplant, keep to the generator each direction votes for (radians, if given), limit the newly promoted patches, drop singles if asked.

    safe keeps candidates only that are at an ideal angle to all of their direction (see safe_only).
    """
    made = transplanted(primitives, angles, limit)
    large = primitives.where(F.col("status") != SMALL)
    if generators:
        made = only_allowed(made, cut(allowed_angles(large, angles, generators)))
    if safe:
        made = safe_only(made, large, angles)
    every = cut(with_own(large, made))
    gids, left = limited(every, budget, primitives.where(~F.col("status").isin(SMALL, UNSET)))
    out = every
    if left:
        # at most budget patches
        taken = primitives.sparkSession.createDataFrame([(x,) for x in gids], "gid long")
        out = every.join(F.broadcast(taken), "gid", "left_semi")
    if not keep_singles:
        out = fl.without_singles(out.withColumn("status", F.lit(1)), points, least).drop("status")
    return out, left
