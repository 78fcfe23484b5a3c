"""Joins of all pairs, beyond the number of rows that they once raised at."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quoin.functions import angles as an
from quoin.functions import geometry as g
from quoin.operators import aggregates as ag
from quoin.operators import joins, relations

MANY = 10_003


@pytest.fixture(scope="module")
def fan(spark):
    """Normals in one plane, by hundredths of a degree; number i at i hundredths."""
    turn = F.radians(F.col("id") / 100)
    return spark.range(MANY).select(F.col("id").alias("gid"), (F.col("id") % 3).alias("did"), F.cos(turn).alias("nx"), F.sin(turn).alias("ny"), F.lit(0.0).alias("nz"), F.lit(1).alias("status"))


def test_angle_histogram_of_many(fan):
    """pairs 90 degrees apart, of which there are MANY - 9000."""
    pairs = joins.pair_angles(fan, an.angle_set([90.0]), math.radians(0.005))
    rows = {(r["did"], r["angle_id"]): r["n"] for r in ag.angle_histogram(pairs, math.radians(0.005)).collect()}
    want = {d: sum((i % 3 == d) + ((i + 9000) % 3 == d) for i in range(MANY - 9000)) for d in range(3)}
    assert rows == {(d, 1): n for d, n in want.items()}


def test_relations_of_many(fan):
    """near parallels of one plane, right angles, and edges of one direction."""
    kinds = relations.parallel_orthogonal(fan, math.radians(0.015)).groupBy("kind").count()
    assert {r["kind"]: r["count"] for r in kinds.collect()} == {"parallel": MANY - 1, "orthogonal": sum(min(9001, MANY - 1) - max(8999, 0) + 1 if i + 9001 < MANY else len([k for k in (8999, 9000, 9001) if i + k < MANY]) for i in range(MANY - 8999))}
    assert relations.bound_pairs(fan, math.cos(math.radians(0.015))).where("kind = 'parallel'").count() == MANY - 1
    assert joins.same_direction_edges(fan.where("gid % 2 = 0").withColumn("did", F.floor(F.col("gid") / 4))).count() == (MANY + 1) // 2 // 2
    assert joins.same_direction_edges(fan.withColumn("did", F.floor(F.col("gid") / 2))).count() == MANY // 2


def test_energy_of_many(spark):
    """the cost of each ordered pair, of normals that are all parallel but one at right angles."""
    ways = spark.range(MANY).select(F.col("id").alias("did"), F.when(F.col("id") == 77, 0.6).otherwise(1.0).alias("nx"), F.when(F.col("id") == 77, 0.8).otherwise(0.0).alias("ny"), F.lit(0.0).alias("nz"))
    got = joins.direction_costs(ways, an.angle_set([90.0]), 1.0).agg(F.count("*").alias("n"), F.sum("cost").alias("s")).first()
    assert got["n"] == MANY * (MANY - 1)
    assert math.isclose(got["s"], 2 * (MANY - 1) * math.sqrt(math.pi / 2 - math.atan2(0.8, 0.6)), rel_tol=1e-9)


def test_tiles_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(joins, "TILE", 7)
    r = random.Random(5)
    a = [(r.choice([None, *range(40)]), i) for i in range(90)]
    b = [(r.choice([None, *range(40)]), i) for i in range(70)]
    one, two = spark.createDataFrame(a, "x int, i int"), spark.createDataFrame(b, "y int, j int")
    got = sorted((p["i"], p["j"]) for p in joins.beside(one, two, F.col("x") <= F.col("y"), ("x", "y")).collect())
    assert got == sorted((i, j) for x, i in a for y, j in b if x is not None and y is not None and x <= y)
    assert joins.beside(one, two).count() == 90 * 70 and joins.beside(one, two.limit(0)).count() == 0
    assert joins.beside(one.limit(0), two, F.col("x") <= F.col("y"), ("x", "y")).count() == 0


def test_normals_without_a_direction(spark):
    """Null normals have no angle; zero ones, and not-a-number, count as angle 0, with a limit as without one."""
    rows = [(0, 1.0, 0.0, 0.0), (1, None, 0.0, 0.0), (2, 0.0, 0.0, 0.0), (3, math.nan, 0.0, 0.0), (4, 0.0, 3.0, 0.0), (5, 0.6, 0.8, 0.0)]
    own = spark.createDataFrame([(i, i, *n) for i, *n in rows], "gid long, did long, nx double, ny double, nz double")
    angles = an.angle_set([90.0])
    every = sorted((p["gid_a"], p["gid_b"], p["index"]) for p in joins.pair_angles(own, angles).where("diff < 0.1").collect())
    assert sorted((p["gid_a"], p["gid_b"], p["index"]) for p in joins.pair_angles(own, angles, 0.1).collect()) == every
    assert {(0, 2, 0), (2, 3, 0), (0, 4, 1)} <= set(every) and not any(1 in p[:2] for p in every)


def test_quarters_are_decimals(spark):
    """0.3 is the third quarter of 0.4, though 3 * 0.4 / 4 is the next double."""
    rows = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (0.29999999999999993,), (0.0,)], "d double")
    assert [r["c"] for r in rows.select(g.distance_colour(F.col("d"), 0.4).alias("c")).collect()] == ["green", "yellow", "red", "yellow", "blue"]


def test_lines_of_many(spark):
    """MANY lines end to end, of which each two neighbours touch, and some beside each other."""
    lines = spark.range(MANY).select(F.col("id").alias("gid"), F.col("id").cast("double").alias("x0"), F.lit(0.0).alias("y0"), F.lit(0.0).alias("z0"), F.col("id") + F.lit(1.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(0.0).alias("z1")).toDF("gid", "x0", "y0", "z0", "x1", "y1", "z1")
    assert sorted(tuple(p) for p in joins.mergeable_lines(lines, 0.01).collect()) == [(i, i + 1) for i in range(MANY - 1)]


def test_lines_equal_all_pairs(spark):
    r = random.Random(3)
    rows = [(i, *[r.choice([r.random(), 0.5]) for _ in range(2)], 0.0, *[r.random() * r.choice([0.1, 1]) for _ in range(2)], 0.0) for i in range(60)] + [(60, 0.5, 0.5, 0.0, 0.5, 0.5, 0.0)]

    def away(p, a, b):
        d = [v - u for u, v in zip(a, b, strict=True)]
        n = sum(x * x for x in d)
        t = sum((x - u) * y for x, u, y in zip(p, a, d, strict=True)) / n if n else 0.0
        return math.dist(p, [u + t * y for u, y in zip(a, d, strict=True)]) if 0 <= t <= 1 else min(math.dist(p, a), math.dist(p, b))

    ends = {i: (v[:3], v[3:]) for i, *v in rows}
    near = lambda i, j: any(away(p, *ends[j]) < 0.1 for p in ends[i])
    got = joins.mergeable_lines(spark.createDataFrame(rows, "gid long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"), 0.1)
    assert sorted(tuple(p) for p in got.collect()) == [(i, j) for i in range(61) for j in range(i + 1, 61) if near(i, j) and near(j, i)]


def test_pairs_of_one_key_go_by_blocks(spark, monkeypatch):
    """no task holds all rows of a key; each pair comes once, and null keys give none."""
    monkeypatch.setattr(joins, "TILE", 10)
    rows = spark.createDataFrame([(i, 1 if i < 70 else None if i < 80 else i) for i in range(100)] + [(200, 90)], "pid long, gid long")
    got = sorted((p.pid_a, p.pid_b) for p in joins.beside_alike(rows, "gid", "pid").collect())
    assert got == sorted([(i, j) for j in range(70) for i in range(j)] + [(90, 200)])
