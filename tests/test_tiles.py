"""Pairs compared by tiles in numpy, against plain loops."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoin.functions import geometry
from quoin.operators import blocks, evaluate, joins, relations, segment, tiles

COLUMNS = "gid long, px double, py double, pz double, nx double, ny double, nz double"


@pytest.fixture(scope="module")
def some():
    r = random.Random(8)
    rows = []
    for i in range(120):
        n = np.array([r.gauss(0, 1), r.gauss(0, 0.3), r.gauss(0, 0.3)]) * r.choice([1, -1])
        n = n / np.linalg.norm(n) if i % 11 else np.array([r.choice([1.0, -1.0]), 0.0, 0.0])
        rows.append((i * 3, *(r.random() for _ in range(3)), *map(float, n)))
    return [*rows, (1000, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0), (1001, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (1002, 0.0, 0.0, 0.0, None, 0.0, 0.0), (1003, 0.5, 0.5, 0.5, 0.0, 0.0, 2.0), (1004, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0)]


def angles(rows):
    rows = [x for x in rows if x[4] is not None]
    for k, a in enumerate(rows):
        for b in rows[k + 1 :]:
            yield a, b, min(1.0, abs(a[4] * b[4] + a[5] * b[5] + a[6] * b[6]))


@pytest.fixture(params=[4096, 16])
def small_tiles(request, monkeypatch):
    monkeypatch.setattr(tiles, "TILE", request.param)


def test_nearly_parallel_pairs(spark, some, small_tiles):
    """the pairs of plain loops, and no shuffle after the tiles are dealt."""
    df = spark.createDataFrame(some, COLUMNS)
    gap = lambda a, b: abs(sum((b[k] - a[k]) * a[k + 3] for k in (1, 2, 3)))
    off = lambda a, b: float(np.linalg.norm(np.cross(np.subtract(b[1:4], a[1:4]), a[4:])))
    near = [(a, b) for a, b, c in angles(some) if math.acos(c) < 0.3]
    rounded = lambda df: sorted((r[0], r[1], round(r[2], 9)) for r in df.collect())
    assert rounded(relations.plane_gaps(df, 0.3)) == sorted((a[0], b[0], round(gap(a, b), 9)) for a, b in near)
    plain = sorted((a[0], b[0], round(-gap(a, b), 9)) for a, b in near if gap(a, b) < 0.2)
    assert rounded(relations.coplanar(df, 0.3, 0.2)) == plain
    assert rounded(relations.coaxial(df, 0.3, 0.2)) == sorted((a[0], b[0], round(-off(a, b), 9)) for a, b in near if off(a, b) < 0.2)
    best = {}
    for a, b, s in plain:
        best[a] = min(best.get(a, (9, 0)), (-s, b))
    assert sorted((r.gid_a, r.gid_b) for r in relations.best_coplanar(df, 0.3, 0.2).collect()) == sorted((a, b) for a, (_, b) in best.items())
    plan = relations.plane_gaps(df, 0.3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 1
    assert relations.coplanar(df.limit(0), 0.3, 0.2).count() == 0


def test_groups_of_parallels(spark, some, small_tiles):
    """what follows from a row per pair, without one."""
    df = spark.createDataFrame(some, COLUMNS)
    want = sorted(tuple(r) for r in relations.parallel_roots(relations.parallel_orthogonal(df, 0.2)).collect())
    assert sorted(tuple(r) for r in relations.parallel_stars(df, 0.2).collect()) == want
    whole = {tuple(r) for r in blocks.collapsed(df, relations.parallel_orthogonal(df, 0.1), 0.3).collect()}
    assert {tuple(r) for r in blocks.collapsed(df, relations.grouped_relations(df, 0.1), 0.3).collect()} == whole


def test_growth_of_a_dense_cloud():
    """The patches of the plain walk; a dense cloud, which once took over half a minute, in a few seconds."""
    r = np.random.default_rng(4)
    xyz, n = r.normal(0, 0.126, (5000, 3)), r.normal(0, 1, (5000, 3))
    n /= np.linalg.norm(n, axis=1)[:, None]
    patch = np.full(300, -1)
    for seed in range(300):
        if patch[seed] >= 0:
            continue
        patch[seed], total, count, stack = seed, n[seed].copy(), 1, [seed]
        while stack:
            i = stack.pop()
            d2 = ((xyz[:300] - xyz[i]) ** 2).sum(axis=1)
            for j in sorted((j for j in range(300) if d2[j] < 0.01), key=lambda j: (d2[j], j)):
                c = abs((total / count) @ n[j]) / np.linalg.norm(total / count)
                if patch[j] < 0 and math.acos(min(1.0, c)) <= 0.6:
                    patch[j], total, count = seed, total + n[j], count + 1
                    stack.append(j)
    assert (segment.grow(xyz[:300], n[:300], 0.1, 0.6) == patch).all()
    begun = time.process_time()
    segment.grow(xyz, n, 0.1, 0.6)
    assert time.process_time() - begun < 15


def test_rectangles_that_may_be_one(spark, small_tiles):
    """each two by tiles, and no join of corners with boxes."""
    r = random.Random(6)
    at = [(i * 5, r.random(), r.random()) for i in range(70)]
    corners = [(i, [{"x": x + a, "y": y + b, "z": 0.01 * (i % 3)} for a, b in ((0.0, 0.0), (0.1, 0.0), (0.1, 0.1), (0.0, 0.1))]) for i, x, y in at]
    got = joins.mergeable_planes(spark.createDataFrame(corners, "gid long, corners array<struct<x:double,y:double,z:double>>"), 0.05)
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(p) for p in got.collect()) == [(i, j) for k, (i, x, y) in enumerate(at) for j, u, v in at[k + 1 :] if abs(x - u) <= 0.15 and abs(y - v) <= 0.15]


def test_greedy_matches_of_ties(spark, monkeypatch):
    """the greedy choice by cost and ids, where more tie than a list holds."""
    monkeypatch.setattr(joins, "NEAREST", 3)
    monkeypatch.setattr(tiles, "TILE", 16)
    a, b = [(i, float(i % 5)) for i in range(24)], [(i + 3, float(i % 6)) for i in range(20)]
    free_a, free_b, want = dict(a), dict(b), []
    for c, i, j in sorted((abs(x - y), i, j) for i, x in a for j, y in b):
        if i in free_a and j in free_b:
            want.append((i, j, c))
            del free_a[i], free_b[j]
    one, two = (spark.createDataFrame(rows, "gid long, x double") for rows in (a, b))
    got = joins.matched(one, two, lambda f, h, some: abs(f["x"].to_numpy()[some, None] - h["x"].to_numpy()))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_adoption_needs_no_sort(spark):
    """what is near isn't sorted; of equal distances the smallest gid."""
    points = spark.createDataFrame([(1, 0.5, 0.5, 0.02, None), (2, 5.0, 5.0, 5.0, None)], "pid long, x double, y double, z double, gid long")
    corners = [{"x": x, "y": y, "z": 0.0} for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))]
    got = joins.adopt_finite(points, spark.createDataFrame([(8, corners), (7, corners)], "gid long, corners array<struct<x:double,y:double,z:double>>"), 0.05)
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [(1, 7, 0.02)]


def test_points_near_many_triangles(spark, monkeypatch):
    """nearest, first and count come from tiles, as the rows of all pairs give them, and the table of pairs isn't made."""
    monkeypatch.setattr(tiles, "TILE", 20)
    rng = np.random.default_rng(3)
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.normal(size=(90, 3)) * 0.3)], "pid long, x double, y double, z double")
    corners = rng.normal(size=(60, 3, 3)) * 0.3
    corners[:3, 1:] = corners[:3, :1]  # without an area
    triangles = spark.createDataFrame([(i, *map(float, c.ravel())) for i, c in enumerate(corners)], "tid long, " + ", ".join(f"{c}{k} double" for c in "abc" for k in "xyz"))
    n = geometry.triangle_normal(*[geometry.Vec.of(c + "x", c + "y", c + "z") for c in "abc"])
    pairs = joins.near_triangles(points, triangles.withColumns({"tnx": n.x, "tny": n.y, "tnz": n.z}), 0.1).cache()
    plain = lambda df: {(r.pid, r.tid, round(r.distance, 9)) for r in df.collect()}
    for most, tolerance in ((1, 0.2), (3, 0.9)):
        assert plain(evaluate.triangle_assignment(points, triangles, 0.1, most, tolerance)) == plain(evaluate.unambiguous(pairs, most, tolerance))
    assert {(r.pid, r.n) for r in joins.triangle_counts(points, triangles, 0.1).collect()} == {(r.pid, r["count"]) for r in pairs.groupBy("pid").count().collect()}
    monkeypatch.setattr(joins, "near_triangles", None)
    assert evaluate.triangle_assignment(points, triangles, 0.1).count() and joins.nearest_triangle(points, triangles, 0.1).count() == pairs.select("pid").distinct().count()


def test_pairs_are_counted_and_not_listed(spark, monkeypatch):
    """precision and recall by tiles are those of the tables of pairs."""
    monkeypatch.setattr(tiles, "TILE", 20)
    rows = spark.createDataFrame([(i, None if i % 13 == 0 else i % 5, i * 7 % 90) for i in range(150)], "gid long, did long, n long")
    got = evaluate.pair_scores(rows, lambda a, b: (a["did"] == b["did"], (a["did"] == b["did"]) & (abs(a["n"] - b["n"]) < 30) | (abs(a["n"] - b["n"]) < 2))).first()
    both = rows.toDF("src", "d1", "n1").crossJoin(rows.toDF("dst", "d2", "n2")).where("src < dst")
    same = rows.select(F.col("gid").alias("gid_a"), F.col("gid").alias("gid_b"))
    want = evaluate.relation_scores(both.where("d1 = d2"), both.where("(d1 = d2 and abs(n1 - n2) < 30) or abs(n1 - n2) < 2"), same).first()
    assert tuple(got) == pytest.approx(tuple(want)) and 0 < got["precision"] < 1
    assert tuple(evaluate.pair_scores(rows.limit(0), lambda a, b: (a["did"] == b["did"],) * 2).first()) == (0.0, 0.0, 0.0)
