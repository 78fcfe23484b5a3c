"""Alpha shapes against closed forms and plain definitions; first-fit clusters against the sequential choice."""

import math
import random

import numpy as np
import pytest

from quoin.operators import firstfit, fit, outlines

KIND = "gid long, pid long, u double, v double"


def plain_edges(points, radius):
    """Ordered pairs whose disc on the right, touching both, holds no point."""
    p = np.array(points)
    out = set()
    for i, a in enumerate(p):
        for j, b in enumerate(p):
            d = np.hypot(*(b - a))
            if i != j and 0 < d < 2 * radius:
                c = (a + b) / 2 + math.sqrt(radius**2 - d * d / 4) * np.array([b[1] - a[1], a[0] - b[0]]) / d
                if (((p - c) ** 2).sum(axis=1) > radius**2 * (1 - 1e-9)).all():
                    out.add((i, j))
    return out


def test_alpha_shapes(spark):
    rng = random.Random(4)
    scattered = [(rng.random(), rng.random()) for _ in range(150)]
    # an L of 48 unit squares without the point (2, 2): half squares (radius 0.71) belong to the shape, so the hole is a
    # diamond of area 2 and the inner corner gains half a square
    corner = [(float(x), float(y)) for x in range(9) for y in range(9) if (x <= 4 or y <= 4) and (x, y) != (2, 2)]
    rows = [(1, i, *p) for i, p in enumerate(scattered)] + [(2, 1000 + i, *p) for i, p in enumerate(corner)] + [(3, 2000, 0.0, 0.0), (3, 2001, 0.1, 0.0), (4, 3000, 5.0, 5.0), (5, 4000, None, 1.0), (2, 1999, 0.0, 0.0)]
    df = spark.createDataFrame(rows, KIND)
    small = outlines.alpha_edges(df.where("gid <> 2"), 0.12).cache()
    assert {(r.src, r.dst) for r in small.where("gid = 1").collect()} == plain_edges(scattered, 0.12)
    assert {r.gid: (r.n_edges, r.area) for r in outlines.shapes(small).where("gid > 2").collect()} == {3: (2, 0.0)}
    edges = outlines.alpha_edges(df.where("gid = 2"), 0.75).cache()
    found = sorted((r.n_edges, round(r.area, 9)) for r in outlines.rings(edges).collect())
    assert found == [(4, -2.0), (31, 48.5)]
    assert {(r.src - 1000, r.dst - 1000) for r in edges.collect()} == plain_edges(corner, 0.75)
    assert outlines.shapes(edges).first()["area"] == pytest.approx(46.5)
    assert outlines.largest(edges).count() == 31
    assert outlines.alpha_edges(df.limit(0), 1.0).count() == 0
    wide = outlines.shapes(outlines.alpha_edges(df.where("gid = 1"), 1e5)).first()["area"]
    assert wide == pytest.approx(fit.polygon_area(fit.hull(np.array(scattered))), abs=1e-3)
    with pytest.raises(ValueError):
        outlines.alpha_edges(df, math.inf)


def test_in_plane_keeps_distances(spark):
    points = spark.createDataFrame([(1, 1, 1.0, 2.0, 3.0), (1, 2, 2.0, 1.0, 3.0)], "gid long, pid long, x double, y double, z double")
    planes = spark.createDataFrame([(1, 0.0, 0.0, 3.0, 0.0, 0.0, 2.0)], "gid long, px double, py double, pz double, nx double, ny double, nz double")
    a, b = outlines.in_plane(points, planes).orderBy("pid").collect()
    assert math.hypot(a.u - b.u, a.v - b.v) == pytest.approx(math.sqrt(2)) and math.hypot(a.u, a.v) == pytest.approx(math.sqrt(5))


def test_first_fit(spark):
    rng = random.Random(5)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(300)]
    rows += [(301, -rows[0][1], -rows[0][2], -rows[0][3]), (302, 0.0, 0.0, 0.0), (303, None, 1.0, 0.0), rows[7]]
    opened, wanted = [], {}
    for i, *n in sorted(rows[:301]):
        n = np.array(n) / np.linalg.norm(n)
        hit = next((j for j, m in opened if abs(n @ m) >= math.cos(math.radians(25))), None)
        if hit is None:
            opened.append((i, n))
        wanted[i] = i if hit is None else hit
    df = spark.createDataFrame(rows, "pid long, nx double, ny double, nz double")
    assert {r.pid: r.cluster for r in firstfit.first_fit(df, 25).collect()} == wanted
    assert firstfit.first_fit(df.limit(0), 25).count() == 0


def test_pairs_of_alpha_edges_are_not_moved(spark):
    """a point's neighbours come to its cell, so nothing is dealt anew between the join and the window."""
    df = spark.createDataFrame([(1, i, i % 7 / 10, i % 11 / 10) for i in range(77)], KIND)
    plan = outlines.alpha_edges(df, 0.12)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(gid" in plan and plan.index("Window") < plan.index("ShuffledHashJoin") and "Exchange" not in plan[plan.index("Window") : plan.index("ShuffledHashJoin")]
