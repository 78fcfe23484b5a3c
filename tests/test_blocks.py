"""Biconnected parts and what is built on them, against plain walks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoin.operators import blocks as bl
from quoin.operators import graph


def adjacency(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    return near


def reach(near, start, without=None, gone=()):
    seen, stack = {start}, [start]
    while stack:
        v = stack.pop()
        for w in near[v]:
            if w != without and w not in seen and (v, w) not in gone and (w, v) not in gone:
                seen.add(w), stack.append(w)
    return seen


def slow_blocks(edges):
    """Edges that meet in x share a loop if their far ends reach each other without x."""
    near, name = adjacency(edges), {e: e for e in edges}

    def find(e):
        while name[e] != e:
            e = name[e]
        return e

    for x in near:
        for a in near[x]:
            for b in near[x] & reach(near, a, without=x):
                p, q = sorted((find((min(x, a), max(x, a))), find((min(x, b), max(x, b)))))
                name[q] = p
    least = {}
    for e in edges:
        least[find(e)] = min(least.get(find(e), e), e)
    return sorted((*e, *least[find(e)]) for e in edges)


@pytest.fixture(scope="module")
def tangle():
    rng, edges = random.Random(5), set()
    for base, n, m in ((0, 40, 46), (100, 12, 11), (200, 6, 6), (300, 25, 50)):
        edges |= {tuple(sorted(rng.sample(range(base, base + n), 2))) for _ in range(m)}
    edges |= {(i, i + 1) for i in range(500, 540)} | {(600, i) for i in range(601, 640)} | {(700, 701), (701, 702), (700, 702), (702, 703), (703, 704), (702, 704)}
    return sorted(edges)


def test_blocks_points_and_bridges(spark, tangle):
    odd = [(b, a) for a, b in tangle[:20]] + tangle + [(3, 3), (None, 4), (800, 800)]
    parts = bl.blocks(spark.createDataFrame(odd, "src long, dst long")).cache()
    assert sorted((r.src, r.dst, r.block_src, r.block_dst) for r in parts.collect()) == slow_blocks(tangle)
    near = adjacency(tangle)
    cuts = {x for x in near if any(len(reach(near, min(near[x]), without=x)) + 1 < len(reach(near, x)) for _ in [0])}
    assert {r.node for r in bl.articulation_points(parts).collect()} == cuts
    cut_edges = {e for e in tangle if e[1] not in reach(near, e[0], gone={e})}
    assert {(r.src, r.dst) for r in bl.bridges(parts).collect()} == cut_edges
    loose = {(r.src, r.dst) for r in parts.where("pendant").collect()}
    for a, b in cut_edges:
        sides = [sum(w in side for v in side for w in near[v]) // 2 - len(side) + 1 for side in (reach(near, a, gone={(a, b)}), reach(near, b, gone={(a, b)}))]
        assert ((a, b) in loose) == (min(sides) == 0)
    assert loose <= cut_edges
    assert bl.blocks(parts.select("src", "dst").limit(0)).count() == 0


def test_ranges(spark):
    rng = random.Random(2)
    values = [(i, rng.randint(0, 99)) for i in range(700)]
    wanted = [(k, *sorted((rng.randint(0, 700), rng.randint(0, 700)))) for k in range(60)] + [(98, 0, 700), (99, 5, 6)]
    got = bl.over_ranges(spark.createDataFrame(values, "place long, v long"), spark.createDataFrame(wanted, "key long, first long, last long"), {"v": F.sum("v")})
    assert {r.key: r.v for r in got.collect()} == {k: sum(v for _, v in values[a:b]) for k, a, b in wanted if a < b}


def test_two_colours(spark, tangle):
    got = bl.two_coloured(spark.createDataFrame(tangle, "src long, dst long")).collect()
    near = adjacency(tangle)
    assert {r.node for r in got} == set(near)
    for r in got:
        side, stack = {r.component: 0}, [r.component]
        while stack:
            v = stack.pop()
            for w in near[v]:
                if w not in side:
                    side[w] = 1 - side[v]
                    stack.append(w)
        odd = any(side[v] == side[w] for v in side for w in near[v])
        assert r.component == min(side) and r.colour == (None if odd else side[r.node])


def slow_decomposition(edges):
    """One point after another, each found by taking it out."""
    score = {(a, b): s for a, b, s in edges}
    while True:
        near = adjacency(score)
        parts, seen = [], set()
        for v in sorted(near):
            if v not in seen:
                parts.append(reach(near, v))
                seen |= parts[-1]
        for part in parts:  # what no loop needs
            own = {e for e in score if e[0] in part}
            core = set(own)
            while loose := {v for v in part if sum(v in e for e in core) == 1}:
                core -= {e for e in core if loose & set(e)}
            core = core or {min(own, key=lambda e: (-score[e], e))}
            for e in own - core:
                del score[e]
        near = adjacency(score)
        cuts = [x for x in near if any(not near[x] <= reach(near, a, without=x) for a in near[x])]
        if not cuts:
            return sorted(score)
        of = lambda x: [e for e in score if x in e]
        weakest = min(cuts, key=lambda x: (round(sum(score[e] for e in of(x)), 9), x))
        groups = {min(near[weakest] & (side := reach(near, a, without=weakest))): near[weakest] & side for a in near[weakest]}
        mean = lambda g: round(sum(score[min(weakest, w), max(weakest, w)] for w in g) / len(g), 9)
        keep = groups[min(groups, key=lambda k: (-mean(groups[k]), k))]
        for e in of(weakest):
            if (set(e) - {weakest}).pop() not in keep:
                del score[e]


def test_weak_points_are_dissolved(spark, tangle):
    bow_tie = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (2, 3, 0.1), (3, 4, 1.0), (2, 4, 0.1)]
    assert bl.plain_decomposition(bow_tie) == {(0, 1), (0, 2), (1, 2), (3, 4)}
    rng = random.Random(9)
    scored = [(a, b, rng.choice([0.1, 0.5, 0.7, 1.0, 2.0])) for a, b in tangle]
    want = slow_decomposition(scored)
    assert sorted(bl.plain_decomposition(scored)) == want
    df = spark.createDataFrame(scored, "src long, dst long, score double")
    assert sorted((r.src, r.dst) for r in bl.decomposed(df).collect()) == want
    # the same by rounds over all components, and not in one task each
    few = [e for e in scored if e[0] >= 200 and e[0] < 300 or e[0] >= 700]
    got = bl.decomposed(spark.createDataFrame(few, "src long, dst long, score double"), plain=2)
    assert sorted((r.src, r.dst) for r in got.collect()) == slow_decomposition(few)


def test_relations_that_follow_from_others(spark):
    x, y, z = np.eye(3)
    tilted = np.array([0.02, 0.0, 1.0])
    ways = {0: x, 1: z, 2: x, 3: tilted, 4: y, 5: x, 6: x, 10: x, 11: y, 14: z, 20: x, 21: y, 22: x, 23: y + z}
    normals = spark.createDataFrame([(k, *map(float, n / np.linalg.norm(n))) for k, n in ways.items()], "gid long, nx double, ny double, nz double")
    # 0-1-2-3 is a loop of right angles, so 0 and 2, and 1 and 3, are parallel; 4 with 0 and 1 is an odd loop; 5 and 6 are parallel
    rows = [(0, 1, "orthogonal"), (1, 2, "orthogonal"), (2, 3, "orthogonal"), (0, 3, "orthogonal"), (5, 6, "parallel"), (6, 5, "parallel"), (4, 5, "orthogonal"), (4, 6, "orthogonal"), (3, 3, "orthogonal")]
    rows += [(10, 11, "orthogonal"), (11, 14, "orthogonal"), (10, 14, "orthogonal")]  # an odd loop alone
    rows += [(20, 21, "orthogonal"), (21, 22, "orthogonal"), (22, 23, "orthogonal"), (20, 23, "orthogonal")]  # 21 and 23 are not near parallel
    edges = spark.createDataFrame(rows, "gid_a long, gid_b long, kind string")
    got = {tuple(r) for r in bl.collapsed(normals, edges, 0.1).collect()}
    odd = {(10, 11, "orthogonal"), (11, 14, "orthogonal"), (10, 14, "orthogonal")}
    apart = {(20, 22, "parallel"), (20, 21, "orthogonal"), (20, 23, "orthogonal")}
    assert got == {(0, 2, "parallel"), (1, 3, "parallel"), (5, 6, "parallel"), (0, 1, "orthogonal"), (4, 5, "orthogonal")} | odd | apart
    assert bl.collapsed(normals, edges.limit(0), 0.1).count() == 0


def test_rounds_keep_size_estimates_small(spark):
    """estimates that joins multiply don't double their digits each round."""
    edges = spark.range(3000).select(F.col("id").alias("src"), ((F.col("id") * 7 + 1) % 3001).alias("dst"))
    digits = lambda df: len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert digits(graph.components(edges)) < 40
    assert digits(graph.spanning_tree(edges.withColumn("w", (F.col("src") % 5).cast("double")))) < 40


def test_many_weak_points_in_one_task(spark):
    """after a point only what it leaves is looked at again; the result is that of all anew after each point, however little is taken at first."""
    for seed in range(60):
        rng = np.random.default_rng(seed)
        at = rng.normal(size=(60, 2)) * rng.choice([0.2, 0.3, 0.4])
        a, b = np.nonzero(((at[:, None] - at) ** 2).sum(axis=2) < 0.01)
        scored = [(i, j, float(i % 7 + j % 5 + 1)) for i, j in zip(a.tolist(), b.tolist(), strict=True) if i < j]
        want = slow_decomposition(scored)
        for ball in (1, 4, 64):
            assert sorted(bl.plain_decomposition(scored, ball)) == want
    # a strip of squares with a weak flap on each: one component of over 2,000 edges, from which 700 points are dissolved
    strip = [e for k in range(0, 4200, 6) for e in ((k, k + 1, 5.0), (k, k + 6, 5.0), (k + 1, k + 7, 5.0), (k, k + 2, 1.0), (k + 2, k + 3, 1.0), (k, k + 3, 1.0))] + [(4200, 4201, 5.0)]
    got = bl.decomposed(spark.createDataFrame(strip, "src long, dst long, score double"))
    # a flap without its square's point is one edge, which stays as a component of its own
    assert sorted((r.src, r.dst) for r in got.collect()) == sorted((a, b) for a, b, s in strip if s == 5.0 or (a % 6, b % 6) == (2, 3))


def test_spanning_tree_keeps_one_edge_between_trees(spark, monkeypatch):
    """of the edges between two trees the least goes on to the next round, not all."""
    sizes = []
    real = graph.cut

    def counted(df):
        out = real(df)
        if "ta" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    near = [(10 * k, 10 * k + i, 1.0 + i) for k in range(6) for i in range(1, 10)]
    far = [(10 * j + a, 10 * k + b, 50.0 + (7 * a + 3 * b + j * k) % 31) for j in range(6) for k in range(j + 1, 6) for a in range(10) for b in range(10)]
    tree = graph.spanning_tree(spark.createDataFrame(near + far, "src long, dst long, w double"))
    assert sizes[0] == len(near + far) and sizes[1] <= 15
    assert tree.count() == 59 and set(near) <= {tuple(r) for r in tree.collect()}
