"""The second level of the reconstruction, and neighbours that baselines ask for."""

import math

import numpy as np
from pyspark.sql import functions as F

from quoin.operators import baselines
from quoin.plans import reconstruct as rc


def test_second_level_beyond_the_budget(spark, monkeypatch):
    """F8: three patches by 3 degrees apart, of which the first level offers no candidate but their own; the second has nine, over the budget of three."""
    rows = []
    for k in range(3):
        turn = math.radians(3 * k)
        for i in range(64):
            a, b = i % 8 / 10, i // 8 / 10
            rows.append((64 * k + i, a, b * math.cos(turn), 5.0 * k + b * math.sin(turn), 0.0, -math.sin(turn), math.cos(turn), None))
    points = spark.createDataFrame(rows, "pid long, x double, y double, z double, nx double, ny double, nz double, gid long")
    own = lambda prims, points, angles, limit, budget, **_: (rc.cd.with_own(prims, rc.cd.transplanted(prims, angles, limit).limit(0)), 0)
    monkeypatch.setattr(rc.cd, "generate", own)
    _, prims = rc.reconstruct(points, 0.15, rounds=1, generators=(), unary=1.0, pairwise=100.0, budget=3)
    active = prims.where("status = 1")
    assert active.count() == 3 and active.select("did").distinct().count() == 1
    n = np.array(active.select("nx", "ny", "nz").collect())
    assert np.all(np.abs(n @ n.T) > 1 - 1e-9)


def test_baseline_neighbours():
    """The report of the tests: neighbours are without the point itself, the nearest first."""
    xyz = np.array([[0, 0, 0], [0.3, 0, 0], [0.1, 0, 0], [5, 0, 0]], float)
    assert [n.tolist() for n in baselines._near(xyz, 0.5)] == [[2, 1], [2, 0], [0, 1], []]


def test_reassigned(spark):
    """The report of the tests: points go to the nearest plane, but one among others of another plane to theirs."""
    rows = [(i, 0.1 * (i % 5), 0.1 * (i // 5), 0.02 if i == 12 else 0.0) for i in range(25)]
    points = spark.createDataFrame(rows, "pid long, x double, y double, z double")
    planes = spark.createDataFrame([(7, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (9, 0.0, 0.0, 0.03, 0.0, 0.0, 1.0)], "gid long, px double, py double, pz double, nx double, ny double, nz double")
    assert [r.gid for r in baselines.reassigned(points, planes, 0.15).orderBy(F.col("pid")).collect()] == [7] * 25
