"""Angles of all pairs, counted and listed by tiles, against the joins that make a row per pair."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quoin.functions import angles as an
from quoin.operators import aggregates as ag
from quoin.operators import joins, tiles
from quoin.plans import catalog


@pytest.fixture(scope="module")
def odd(spark):
    """Normals of any length on and beside ideal angles, and some that have no direction, no id or no number."""
    r = random.Random(4)
    rows = [(i, r.choice([1, 2, None, 2**60 + 1]), *(r.gauss(0, 1) for _ in range(3))) for i in range(150)]
    rows += [(200 + i, 3, math.cos(math.radians(10 * i)), math.sin(math.radians(10 * i)), 0.0) for i in range(36)]
    rows += [(300, 1, 0.0, 0.0, 0.0), (301, 2, math.inf, 0.0, 0.0), (302, 2, math.nan, 0.0, 1.0), (303, 4, None, 1.0, 0.0), (304, None, 5.0, 0.0, 0.0), (305, 1, 1e-200, 0.0, 0.0), (None, 1, 1.0, 0.0, 0.0)]
    return spark.createDataFrame(rows, "gid long, did long, nx double, ny double, nz double")


@pytest.fixture(params=[4096, 24])
def small_tiles(request, monkeypatch):
    monkeypatch.setattr(tiles, "TILE", request.param)


@pytest.mark.parametrize("generators, limit", [([60.0, 90.0], 0.05), ([90.0], math.radians(14)), ([30.0], 0.9), ([], 1e-6)])
def test_counts_and_pairs_of_bands(odd, small_tiles, generators, limit):
    """the same counts and pairs as with a row per pair."""
    ideal = an.angle_set(generators)
    pairs = joins.pair_angles(odd, ideal, limit).cache()
    want = {(r.did, r.angle_id): r.n for r in ag.angle_histogram(pairs, limit).collect()}
    assert {(r.did, r.angle_id): r.n for r in joins.angle_counts(odd, ideal, limit).collect()} == want
    rows = {(r.gid_a, r.gid_b): r["diff"] for r in joins.angle_pairs(odd, ideal, limit, 5).collect()}
    assert rows == {(r.gid_a, r.gid_b): pytest.approx(r["diff"], abs=5.1e-6) for r in pairs.collect()}


def test_queries_make_no_row_per_pair(spark, folder, monkeypatch):
    """the queries count in tiles, and 30,000 directions (450 million pairs) don't make as many rows."""
    def broken(*_, **__):
        raise AssertionError("a row per pair")

    turn = F.radians(F.col("id") / 100)
    fan = spark.range(30_000).select(F.col("id").alias("gid"), (F.col("id") % 2).alias("did"), F.cos(turn).alias("nx"), F.sin(turn).alias("ny"), F.lit(0.0).alias("nz"))
    monkeypatch.setattr(joins, "pair_angles", broken)
    monkeypatch.setattr(catalog, "primitives", lambda *_: fan)
    # of i and i + 9000 + 36000 k (or 27000) the angle is right: all in the first 30,000
    right = [sum(1 for i in range(30_000 - step) for d in (i % 2, (i + step) % 2) if d == 0) for step in (9000, 27000)]
    near = {(r.did, r.angle_id): r.n for r in joins.angle_counts(fan, an.angle_set([90.0]), math.radians(0.005)).collect()}
    assert near[0, 1] == sum(right) and set(near) == {(d, k) for d in (0, 1) for k in (1, 2)}
    assert {r.did for r in catalog.QUERIES["angle_histogram"](spark, folder).collect()} == {0, 1}
    assert {r.did for r in catalog.QUERIES["generator_votes"](spark, folder).collect()} == {0, 1}
