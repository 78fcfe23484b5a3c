"""Micro-fixtures, invariants and synthetic scenes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoin.functions import angles as an
from quoin.functions import geometry as g
from quoin.operators import aggregates as ag
from quoin.operators import baselines, candidates, evaluate, filters, fit, graph, joins, problem, relations, scene, segment, selection, spatial
from quoin.sources import files


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_angles(spark):
    x, y = g.Vec.lit(1, 0, 0), g.Vec.lit(0, 1, 0)
    for b, want in ((x, 0), (y, math.pi / 2), (g.Vec.lit(-1, 0, 0), math.pi), (g.Vec.lit(1, 1, 0), math.pi / 4)):
        assert abs(value(spark, g.angle(x, b)) - want) < 1e-12
    assert an.angle_set([90.0]) == [0.0, math.pi / 2, math.pi]
    assert np.allclose(an.angle_set([60.0]), [0, math.pi / 3, 2 * math.pi / 3, math.pi])
    assert len(an.angle_set([30.0])) == 7 and an.angle_set([]) == [0.0, math.pi]
    assert np.allclose(an.deduced_generators([0, math.pi / 3, math.pi / 2, 2 * math.pi / 3, math.pi]), [math.pi / 3, math.pi / 2])


def test_rectangle_distance(spark):
    c = [g.Vec.lit(*p) for p in ((0, 0, 0), (2, 0, 0), (0, 1, 0))]
    for p, want in (((1, 0.5, 0), 0), ((1, 0.5, 3), 3), ((3, 0.5, 0), 1), ((3, 2, 2), math.sqrt(6))):
        assert abs(value(spark, g.rectangle_distance(g.Vec.lit(*p), *c)) - want) < 1e-9


def test_scatter_and_significance(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (0, 2.0, 0.0, 0.0), (0, 2.0, 1.0, 0.0), (0, 0.0, 1.0, 0.0)], "gid long, x double, y double, z double")
    m = ag.moments(points)
    r = ag.eigenvalues(m).first()
    assert np.allclose([r.sxx, r.syy, r.szz, r.l0, r.l1, r.l2], [4, 1, 0, 0, 1, 4], atol=1e-9)
    assert abs(ag.significance(m, squared=True).first().significance - 2) < 1e-9


def test_robust_weight(spark):
    for d, signed, want in ((0.0, False, 1), (0.05, False, 0.5625), (0.1, False, 0), (-0.2, True, 9), (-0.2, False, 0)):
        assert abs(value(spark, g.robust_weight(F.lit(d), 0.1, signed)) - want) < 1e-9


def test_closed_form_against_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(k, *map(float, p)) for k in range(20) for p in rng.normal(size=(30, 3)) * rng.random(3)]
    points = spark.createDataFrame(rows, "gid long, x double, y double, z double")
    for r in ag.plane_fit(points).collect():
        x = np.array([q[1:] for q in rows if q[0] == r.gid])
        d = x - x.mean(axis=0)
        values, vectors = np.linalg.eigh(d.T @ d)
        assert np.allclose([r.l0, r.l1, r.l2], values) and abs(abs(np.dot([r.nx, r.ny, r.nz], vectors[:, 0])) - 1) < 1e-9


COSTS = {(0, 0): 1.0, (0, 1): 0.2, (1, 0): 0.5, (1, 1): 2.0, (2, 2): 0.1, (2, 0): 0.9}
PAIRS = {(a, b): v for x, v in {(0, 1): 0.3, (0, 2): 0.4, (1, 2): 0.6}.items() for a, b in (x, x[::-1])}


def test_selection(spark):
    energy, choice, gap = selection.solve(COSTS, PAIRS)
    assert abs(energy - 2.2) < 1e-9 and choice == {0: 1, 1: 0, 2: 0} and gap == 0
    costs = spark.createDataFrame([(p, d, q) for (p, d), q in COSTS.items()], "gid long, did long, q double")
    pairs = spark.createDataFrame([(a, b, c) for (a, b), c in PAIRS.items()], "did_a long, did_b long, cost double")
    every = sorted((round(r.energy, 9), r.subset) for r in problem.subset_optimum(costs, pairs, [0, 1, 2]).collect())
    assert every[0] == (2.2, 3) and {s for e, s in every if e == 2.4} == {1, 5}


@pytest.mark.parametrize("seed", range(5))
def test_selection_against_enumeration(seed):
    import itertools

    rng = random.Random(seed)
    costs = {(p, d): rng.random() for p in range(4) for d in range(4) if rng.random() < 0.7 or d == p}
    pairs = {}
    for a, b in itertools.combinations(range(4), 2):
        pairs[a, b] = pairs[b, a] = rng.random() / 3
    best = min(sum(costs[p, d] for p, d in enumerate(c)) + sum(pairs[a, b] for a in set(c) for b in set(c) if a != b) for c in itertools.product(range(4), repeat=4) if all((p, d) in costs for p, d in enumerate(c)))
    assert abs(selection.solve(costs, pairs)[0] - best) < 1e-9


def _least(costs, pairs, spatial, patches, ways):
    import itertools

    best = math.inf
    for c in itertools.product(ways, repeat=len(patches)):
        if all((p, d) in costs for p, d in zip(patches, c)):
            used, own = set(c), dict(zip(patches, c))
            own_pairs = sum(pairs.get((a, b), 0.0) for a in used for b in used if a != b)
            best = min(best, sum(costs[p, d] for p, d in own.items()) + own_pairs + sum(w for (a, b), w in spatial.items() if own[a] != own[b]))
    return best


@pytest.mark.parametrize("seed", range(20))
def test_optimum_with_spatial_terms(seed):
    rng = random.Random(seed)
    patches, ways = range(rng.randint(1, 5)), range(rng.randint(1, 5))
    costs = {(p, d): rng.random() for p in patches for d in ways if rng.random() < 0.8 or d == p % len(ways)}
    pairs = {(a, b): rng.random() / 3 for a in ways for b in ways if a != b}
    spatial = {(a, b): rng.random() / 3 for a in patches for b in patches if a != b and rng.random() < 0.5}
    energy, choice, gap = selection.solve(costs, pairs, spatial)
    assert abs(energy - _least(costs, pairs, spatial, list(patches), list(ways))) < 1e-9 and gap == 0
    assert all((p, d) in costs for p, d in choice.items()) and set(choice) == set(patches)


def test_optimum_of_many_parts(spark):
    """200 variables in ten parts of four patches and five directions, against the enumeration of each part."""
    rng = random.Random(3)
    costs, pairs, spatial, want = {}, {}, {}, {}
    for part in range(10):
        patches, ways = [part * 10 + i for i in range(4)], [part * 10 + i for i in range(5)]
        own = ({(p, d): rng.random() for p in patches for d in ways}, {(a, b): rng.random() / 4 for a in ways for b in ways if a != b}, {(patches[0], patches[1]): 0.2, (patches[1], patches[2]): 0.1})
        want[part * 10] = _least(*own, patches, ways)
        for mine, all_ in zip(own, (costs, pairs, spatial)):
            all_.update(mine)
    assert len(costs) == 200
    table = lambda rows, names: spark.createDataFrame([(a, b, q) for (a, b), q in rows.items()], names)
    args = table(costs, "gid long, did long, q double"), table(pairs, "did_a long, did_b long, cost double"), table(spatial, "gid_a long, gid_b long, q double")
    got = selection.solved(*args).collect()
    assert len(got) == 40 and all(abs(r.energy - want[r.component]) < 1e-9 and r.gap == 0 for r in got)
    # the whole as one problem has the same optimum
    energy, _, gap = selection.solve(costs, pairs, spatial)
    assert abs(energy - sum(want.values())) < 1e-6 and gap < 1e-6
    with pytest.raises(ValueError):
        selection.solved(*args, most=19)
    assert selection.solved(args[0].limit(0), args[1], args[2]).count() == 0


def test_gap_is_a_bound():
    rng = random.Random(8)
    costs = {(p, d): rng.random() for p in range(12) for d in range(10)}
    pairs = {(a, b): 0.3 * rng.random() for a in range(10) for b in range(10) if a != b}
    spatial = {(a, b): 0.2 for a in range(12) for b in range(a) if rng.random() < 0.3}
    short, _, gap = selection.solve(costs, pairs, spatial, most_nodes=1)
    energy, _, none = selection.solve(costs, pairs, spatial)
    assert none == 0 and short - gap <= energy + 1e-9 <= short + 2e-9


def test_radius_and_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.random((150, 3))
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "pid long, x double, y double, z double")
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    got = {(r.pid_a, r.pid_b) for r in spatial.neighbours(points, 0.2).collect()}
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(d < 0.2), strict=True) if a != b}
    near = {(r.pid_a, r.place): r.pid_b for r in spatial.nearest(points, points, 4, 0.05).collect()}
    np.fill_diagonal(d, 9)
    order = np.argsort(d, axis=1)
    assert near == {(i, k + 1): int(order[i, k]) for i in range(150) for k in range(4)}


def test_nearest_of_many_near_points(spark):
    """a radius that holds nearly all points is not the first one asked, and copies at one place are not all asked."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(300, 3)) * 0.01, rng.random((20, 3)) * 3, np.tile([[0.5, 0.5, 0.5]], (80, 1))])
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "pid long, x double, y double, z double")
    assert spatial._first_radius(points.where("pid < 320"), 1.0, 3) < 0.05
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    near = {(r.pid_a, r.place): r.pid_b for r in spatial.nearest(points, points, 3, 1.0).collect()}
    assert near == {(i, k + 1): int(order[i, k]) for i in range(len(x)) for k in range(3)}


def test_patches_of_scenes(spark):
    box = scene.box_scene(spark, 80)
    grown = segment.region_grow(box, 0.2, 0.3).join(box.select("pid", F.col("gid").alias("face")), "pid")
    mixed = grown.groupBy("gid").agg(F.count_distinct("face").alias("f"), F.count("*").alias("n")).where("n >= 10")
    assert mixed.where("f > 1").count() == 0 and mixed.agg(F.sum("n")).first()[0] > 400
    stairs = scene.stairs_scene(spark, 4, 40)
    fits = fit.fit_patches(stairs, "plane", 0.1)
    ways = {tuple(np.round(np.abs([r.nx, r.ny, r.nz]), 3)) for r in fits.collect()}
    assert ways == {(0, 0, 1), (1, 0, 0)}


def test_reconstruct_box(spark):
    from quoin.plans.reconstruct import reconstruct

    _, prims = reconstruct(scene.box_scene(spark, 100), 0.15, rounds=2)
    normals = np.array([[r.nx, r.ny, r.nz] for r in prims.where("status = 1").collect()])
    assert len(normals) == 6 and np.all(np.max(np.abs(normals), axis=1) > math.cos(math.radians(2)))


def test_reconstruct_adds_rounds_for_patches_over_the_budget(spark):
    from quoin.plans.reconstruct import reconstruct

    _, prims = reconstruct(scene.box_scene(spark, 100), 0.15, generators=(), rounds=1, budget=8)
    assert prims.where("status = 1").count() == 6


def test_extents_and_hulls():
    xyz = np.array([[0, 0, 0], [2, 0, 0], [2, 1, 0], [0, 1, 0], [1, 0.5, 0]], float)
    c = fit.rectangle(xyz, xyz.mean(axis=0), np.array([0.0, 0, 1]))
    sides = sorted(np.linalg.norm(np.roll(c, -1, axis=0) - c, axis=1))
    assert np.allclose(sides, [1, 1, 2, 2], atol=1e-6)
    h = fit.hull(xyz[:, :2])
    assert abs(fit.polygon_area(h) - 2) < 1e-9 and fit.inside(h, np.array([1.0, 0.5])) and not fit.inside(h, np.array([3.0, 0.5]))


def test_merge_gap(spark):
    rows = [(0, [(0, 0), (1, 0), (1, 1), (0, 1)]), (1, [(1.05, 0), (2, 0), (2, 1), (1.05, 1)]), (2, [(2.5, 0), (3, 0), (3, 1), (2.5, 1)])]
    df = spark.createDataFrame([(i, [(float(x), float(y), 0.0) for x, y in c]) for i, c in rows], "gid long, corners array<struct<x:double,y:double,z:double>>")
    assert [(r.gid_a, r.gid_b) for r in joins.mergeable_planes(df, 0.1).collect()] == [(0, 1)]


def test_adoption(spark):
    plane = spark.createDataFrame([(7, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "gid long, px double, py double, pz double, nx double, ny double, nz double")
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.05, None), (1, 0.0, 0.0, 0.2, None)], "pid long, x double, y double, z double, gid long")
    assert [(r.pid, r.gid) for r in joins.adopt_once(points, plane, 0.1).collect()] == [(0, 7)]


def test_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 60), rng.randint(0, 60), float(rng.randint(1, 20))) for _ in range(70)]
    df = spark.createDataFrame(edges, "src long, dst long, w double")
    name = list(range(61))

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    total = 0.0
    for a, b, w in sorted(edges, key=lambda e: (e[2], min(e[:2]), max(e[:2]))):
        a, b = find(a), find(b)
        if a != b:
            name[max(a, b)] = min(a, b)
            total += w
    assert {r.node: r.component for r in graph.components(df).collect()} == {v: find(v) for e in edges for v in e[:2]}
    assert graph.spanning_tree(df).agg(F.sum("w")).first()[0] == total


def test_relations(spark):
    rows = [(0, 1.0, 0.0, 0.0), (1, 1.0, 0.01, 0.0), (2, 0.0, 1.0, 0.0)]
    df = spark.createDataFrame([(i, 0.0, 0.0, 0.0, *v) for i, *v in rows], "gid long, px double, py double, pz double, nx double, ny double, nz double")
    got = {(r.gid_a, r.gid_b): r.kind for r in relations.parallel_orthogonal(df, 0.05).collect()}
    assert got == {(0, 1): "parallel", (0, 2): "orthogonal", (1, 2): "orthogonal"}
    moved = relations.aligned_normals({i: np.array(v) for i, *v in rows}, [(0, 1, "parallel"), (0, 2, "orthogonal")])
    assert abs(moved[0] @ moved[1]) > 0.99999 and abs(moved[0] @ moved[2]) < 1e-3


def test_candidates(spark):
    a = math.radians(88)
    df = spark.createDataFrame([(0, 0, 1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (1, 1, 1, 0.0, 0.0, 0.0, math.cos(a), math.sin(a), 0.0)], "gid long, did long, status int, px double, py double, pz double, nx double, ny double, nz double")
    made = candidates.transplanted(df, an.angle_set([90.0]), math.radians(5)).orderBy("gid").collect()
    assert [(r.gid, r.did) for r in made] == [(0, 1), (1, 0)]
    assert abs(made[1].nx) < 1e-9 and abs(abs(made[1].ny) - 1) < 1e-9


def test_scores(spark):
    truth = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    found = spark.createDataFrame([(10, 11), (10, 12)], "src long, dst long")
    match = spark.createDataFrame([(0, 10), (1, 11), (2, 12)], "gid_a long, gid_b long")
    r = evaluate.relation_scores(truth, found, match).first()
    assert (r.precision, r.recall, r.f) == (0.5, 0.5, 0.5)
    costs = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.5), (1, 1, 0.4), (1, 0, 3.0)], "gid_a long, gid_b long, cost double")
    assert sorted(tuple(r) for r in joins.matches(costs).collect()) == [(0, 0, 1.0), (1, 1, 0.4)]


def test_baselines(spark):
    box = scene.box_scene(spark, 60)
    labels = baselines.propose_and_expand(box, "plane", 0.1)
    assert labels.count() == box.count() and 2 <= labels.select("gid").distinct().count() <= 30
    found = fit.ransac(box, "plane", 0.03, most=1).collect()
    assert len(found) == 6 and all(r.n >= 50 for r in found)
    assert baselines.normal_clusters([(1, 0, 0), (-1, 0, 0), (0, 1, 0)]) == [0, 0, 1]


def test_ransac_goes_on_while_points_agree(spark):
    from quoin.plans import catalog

    rng = np.random.default_rng(5)
    rows = [(20 * k + i, 0, *map(float, rng.uniform(0, 10, 2)), float(3 * k)) for k in range(12) for i in range(20)]
    layers = spark.createDataFrame(rows, "pid long, gid long, x double, y double, z double")
    assert [r.n for r in fit.ransac(layers, "plane", 0.03, rounds=2000).collect()] == [20] * 12
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(catalog.t, "points_embeddings", lambda *_: layers.where("pid < 120"))
        assert catalog.ransac(spark, "").count() == 6


def test_files(spark, tmp_path):
    box = scene.box_scene(spark, 5, noise=0.0)
    files.write_points(box, str(tmp_path / "cloud.ply"))
    files.write_assignments(box, str(tmp_path / "points.csv"))
    prims = fit.fit_patches(box, "plane", 0.1, 0).withColumn("did", F.col("gid")).withColumn("status", F.lit(1)).withColumn("gen_angle", F.lit(0.5))
    files.write_primitives(prims, str(tmp_path / "patches.csv"))
    points, back = files.read_scene(spark, f"{tmp_path}/cloud.ply", f"{tmp_path}/patches.csv", f"{tmp_path}/points.csv")
    assert {(r.pid, r.gid) for r in points.collect()} == {(r.pid, r.gid) for r in box.collect()}
    assert back.count() == 6 and {r.lid for r in back.collect()} == {0}
    (tmp_path / "m.obj").write_text("v 0 0 0\nv 1 0 0\nv 0 1 0\nv 1 1 0\nf 1 2 3\nf 1/1 2/2 4/3\nf 1 2 3 4\n")
    assert files.read_triangles(spark, str(tmp_path / "m.obj"), 0.5).count() == 2
    (tmp_path / "g.txt").write_text("2\n0 0 0 0 0 1 1\n1 0 0 0 0 1 1\n1\nplane 0 0 1 0\npoints 0 1\n")
    p, planes = files.read_point_planes(spark, str(tmp_path / "g.txt"))
    assert p.count() == 2 and planes.first().members == [0, 1]
    (tmp_path / "a.svg").write_text('<svg><g transform="translate(1,2)"><path d="M 0 0 L 1 0 l 0 1 Z"/></g></svg>')
    assert files.read_svg_paths(spark, str(tmp_path / "a.svg")).count() == 3
    (tmp_path / "p.prj").write_text('<scene><primitives><primitive pos="0 0 0" dir="1 0 0" dim="2 1" uid="4" did="5"/></primitives></scene>')
    assert files.read_project(spark, str(tmp_path / "p.prj")).first().gid == 4
    names = spark.createDataFrame([("a_it12.csv",), ("b.csv",)], "n string")
    assert [r.i for r in names.select(files.iteration(F.col("n")).alias("i")).collect()] == [12, -1]
    assert files.versioned(spark, str(tmp_path / "m.obj")).endswith(".0.bak")


def test_filters(spark):
    points = spark.createDataFrame([(i, i % 3) for i in range(10)] + [(10, None)], "pid long, gid long")
    assert {r.pid for r in filters.orphans(points, 4).collect()} == {1, 2, 4, 5, 7, 8, 10}
    kept = filters.stratified_unassign(points.where("gid is not null"), 0.5, 2).where("gid is not null")
    assert {r.gid: r["count"] for r in kept.groupBy("gid").count().collect()} == {0: 2, 1: 2, 2: 2}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rays_hit_the_nearest_segment(spark):
    sources = spark.createDataFrame([(0, 0.0, 0.0)], "sid long, x double, y double")
    segments = spark.createDataFrame([(1, 1.0, -1.0, 1.0, 1.0), (2, 2.0, -5.0, 2.0, 5.0)], "gid long, x0 double, y0 double, x1 double, y1 double")
    hits = {r.ray: r.gid for r in scene.first_hits(sources, segments, 8).collect()}
    assert hits[0] == 1 and 4 not in hits


def test_second_level(spark):
    from quoin.operators import represent

    prims = spark.createDataFrame([(0, 5, 1.0, 0.0, 0.0), (1, 5, 0.999, 0.04, 0.0), (2, 6, 0.0, 1.0, 0.0)], "gid long, did long, nx double, ny double, nz double")
    signif = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 1.0)], "gid long, significance double")
    points = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "pid long, gid long")
    left, best = represent.represent(points, prims, signif)
    assert {r.gid for r in best.collect()} == {1, 2} and {r.pid: r.gid for r in left.collect()} == {0: None, 1: 1, 2: 2}
    solved = spark.createDataFrame([(5, 0.0, 0.0, 1.0)], "did long, nx double, ny double, nz double")
    back = {r.gid: (r.nx, r.ny, r.nz) for r in represent.represent_back(prims, solved, an.angle_set([90.0])).collect()}
    assert np.allclose(np.abs(back[0]), [1, 0, 0], atol=1e-9) and back[2] == (0.0, 1.0, 0.0)


def rectangle(x, y, z, u, v):
    c = np.array([[0, 0, 0], u, np.add(u, v), v], float) + [x, y, z]
    return [dict(zip("xyz", map(float, p), strict=True)) for p in c]


def test_tilted_plane_does_not_merge(spark):
    large = rectangle(0, 0, 0, [1, 0, 0], [0, 1, 0])
    tilted = rectangle(0.95, 0.2, 0.02, [0.99 * 0.9, 0, 0.1], [0, 0.5, 0])
    beside = rectangle(1.02, 0.2, 0.02, [0.9, 0, 0], [0, 0.5, 0])
    far = rectangle(1.2, 0.2, 0.0, [0.5, 0, 0], [0, 0.5, 0])
    frame = spark.createDataFrame([(1, large), (2, tilted), (3, beside), (4, far)], "gid long, corners array<struct<x:double,y:double,z:double>>")
    assert {(r.gid_a, r.gid_b) for r in joins.mergeable_planes(frame, 0.05).collect()} == {(1, 3), (3, 4)}


def test_planes_on_a_grid_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    at, ways = rng.normal(size=(400, 3)), rng.normal(size=(60, 3))
    ways[:3] = np.eye(3)
    ways /= np.linalg.norm(ways, axis=1)[:, None]
    places = rng.normal(size=(60, 3)) * 1.5
    points = spark.createDataFrame([(i, *map(float, p), None) for i, p in enumerate(at)], "pid long, x double, y double, z double, gid long")
    planes = spark.createDataFrame([(i, *map(float, p), *map(float, n)) for i, (p, n) in enumerate(zip(places, ways, strict=True))], "gid long, px double, py double, pz double, nx double, ny double, nz double")
    d = np.abs(np.einsum("ijk,jk->ij", at[:, None] - places[None], ways))
    for scale in (0.001, 0.05, 3.0):
        got = {r.pid: r.gids for r in joins.covered_points(points, planes, scale).collect()}
        assert got == {i: np.nonzero(d[i] < scale)[0].tolist() for i in range(400) if (d[i] < scale).any()}
    assert joins.covered_points(points.limit(0), planes, 0.1).count() == 0 and joins.covered_points(points, planes.limit(0), 0.1).count() == 0
    plan = joins.adopt_once(points, planes, 0.05)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_numbered(spark):
    from quoin.operators import windows

    rows = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(300)).alias("k"), "id").repartition(7)
    got = sorted((r.k, r.id, r.n) for r in windows.numbered(rows, "k", "id").collect())
    assert [n for _, _, n in got] == list(range(5000)) and windows.numbered(rows.limit(0), "k").count() == 0


def test_ranked(spark):
    from quoin.operators import windows

    rows = spark.range(5000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 50).alias("k"), "id").repartition(5)
    got = {}
    for r in windows.ranked(rows, ["k"], ["id"]).collect():
        got.setdefault(r.k, []).append((r.id, r.n))
    assert all([n for _, n in sorted(v)] == list(range(len(v))) for v in got.values()) and sum(map(len, got.values())) == 5000


def test_binary_points(spark, tmp_path):
    import struct

    rows = [(0.5, 1.0, 2.0, 0.0, 3.0, 4.0), (1.5, -1.0, 0.0, 0.0, 0.0, 2.0)]
    body = b"# .PCD v0.7\nVERSION 0.7\nFIELDS x y z normal_x normal_y normal_z\nSIZE 4 4 4 4 4 4\nTYPE F F F F F F\nCOUNT 1 1 1 1 1 1\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA binary\n" + b"".join(struct.pack("<6f", *r) for r in rows)
    (tmp_path / "cloud.pcd").write_bytes(body)
    got = sorted(tuple(r) for r in files.read_binary_points(spark, str(tmp_path / "cloud.pcd")).collect())
    assert got[0][:4] == (0, 0.5, 1.0, 2.0) and np.allclose(got[0][4:7], [0, 0.6, 0.8]) and np.allclose(got[1][4:7], [0, 0, 1])


@pytest.mark.parametrize("split", [10, 200_000])
def test_hubs(spark, monkeypatch, split):
    monkeypatch.setattr(graph, "SPLIT", split)
    edges = spark.createDataFrame([(0, i) for i in range(1, 900)] + [(i, 10_000 + i) for i in range(1, 50)] + [(20_000, 20_001), (5, None), (7, 7)], "src long, dst long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert len(got) == 900 + 49 + 2 and {c for n, c in got.items() if n < 20_000} == {0} and got[20_001] == 20_000


def test_tiles_join_at_the_seams(spark):
    box = scene.box_scene(spark, 150)
    whole = {r.pid: r.gid for r in segment.region_grow(box, 0.25, 0.3).collect()}
    tiled = {r.pid: r.gid for r in segment.region_grow_tiled(box, 0.25, 0.3, 0.5).collect()}
    one = {r.pid: r.gid for r in segment.region_grow_tiled(box, 0.25, 0.3, 100.0).collect()}
    assert len(set(whole.values())) == len(set(tiled.values())) == 6 and tiled == whole and len(one) == len(whole)
    assert segment.region_grow_tiled(box.limit(0), 0.25, 0.3, 0.5).count() == 0


def test_safe_candidates_meet_the_running_output(spark):
    rows = [(1, 7, 1, 1.0, 0.0, 0.0), (2, 7, 1, 0.0, 1.0, 0.0), (3, 7, 1, 0.8, 0.6, 0.0), (4, 8, 1, 0.8, 0.6, 0.0), (5, 9, 1, 0.6, 0.8, 0.0)]
    made = spark.createDataFrame(rows, "gid long, did long, lid int, nx double, ny double, nz double")
    existing = spark.createDataFrame([(9, 1.0, 0.0, 0.0)], "did long, nx double, ny double, nz double")
    assert {r.gid for r in candidates.safe_only(made, existing, an.angle_set([90.0])).collect()} == {1, 2, 4}


def test_allowed_angles_follow_the_votes(spark):
    ways = [(1, 1, 1.0, 0.0), (2, 2, 0.0, 1.0), (3, 3, math.cos(math.pi / 3), math.sin(math.pi / 3)), (4, 4, -1.0, 0.0)]
    prims = spark.createDataFrame([(g, d, x, y, 0.0, 1) for g, d, x, y in ways], "gid long, did long, nx double, ny double, nz double, status int")
    angles = an.angle_set([60.0, 90.0])
    allowed = candidates.allowed_angles(prims, angles, [math.radians(60), math.radians(90)])
    got = {}
    for r in allowed.collect():
        got.setdefault(r.did, set()).add(round(math.degrees(angles[r.angle_id])))
    assert got[2] == {0, 90, 180} and got[3] == {0, 60, 120, 180}
    made = spark.createDataFrame([(9, 2, i) for i in range(len(angles))] + [(9, 77, 1)], "gid long, did long, angle_id int")
    assert {(r.did, round(math.degrees(angles[r.angle_id]))) for r in candidates.only_allowed(made, allowed).collect()} == {(2, 0), (2, 90), (2, 180), (77, 60)}


def test_legacy_selection():
    rng = random.Random(2)
    for _ in range(20):
        data = {i: rng.random() for i in range(8)}
        pair = {(a, b): rng.random() * 0.3 for a in data for b in data if a != b}
        cover = [set(rng.sample(range(8), 3)) for _ in range(5)]
        exact, loose = problem.legacy_selection(data, pair, cover), problem.legacy_selection(data, pair, cover, relaxed=True)
        cost = lambda c: sum(data[i] for i in c) + sum(q for (a, b), q in pair.items() if a in c and b in c)  # noqa: B023, E731
        assert all(r & exact for r in cover) and all(r & loose for r in cover) and cost(exact) <= cost(loose) + 1e-9


def test_plain_centre_and_aligned_rectangles():
    rng = np.random.default_rng(5)
    xyz = rng.normal(size=(40, 3)) * [1, 1, 0.01]
    at, way = fit.robust(xyz, "plane", 0.5, 2, plain_centre=True)
    assert np.allclose(at, xyz.mean(axis=0)) and abs(way[2]) > 0.99
    for aligned in (False, True):
        c = fit.rectangle(xyz, at, way, aligned)
        u, v = c[1] - c[0], c[3] - c[0]
        inside = [(-1e-9 <= (p - c[0]) @ u / (u @ u) <= 1 + 1e-9) and (-1e-9 <= (p - c[0]) @ v / (v @ v) <= 1 + 1e-9) for p in xyz]
        assert all(inside)
