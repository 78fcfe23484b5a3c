"""The selection problem in relational form, and what it selects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.operators import joins as jn
from quoin.operators import selection, windows


def variables(candidates: DataFrame) -> DataFrame:
    """candidates with var, numbered from 0 by (gid, did)."""
    return windows.numbered(candidates, "gid", "did", name="var")


def cover(candidates: DataFrame) -> DataFrame:
    """(gid, vars): each patch takes at least one of its candidates."""
    return candidates.groupBy("gid").agg(F.array_sort(F.collect_set("var")).alias("vars"))


def implications(candidates: DataFrame) -> DataFrame:
    """(var, did): a candidate is only taken with its direction."""
    return candidates.select("var", "did")


def formulate(points: DataFrame, candidates: DataFrame, proximity: DataFrame, angles: list[float], unary: float, pairwise: float, spatial: float) -> dict[str, DataFrame]:
    """linear (var, q), spatial (v0, v1, q), directions (did_a, did_b, cost), cover and implications of candidates (gid, did, place and normal)."""
    from quoin.functions import geometry as g

    own = variables(candidates)
    d = g.plane_distance(g.Vec.of("x", "y", "z"), g.Vec.of("px", "py", "pz"), g.Vec.of("nx", "ny", "nz"))
    cost = points.select("gid", "x", "y", "z").join(own, "gid").groupBy("var").agg((unary * F.avg(d * d)).alias("q"))
    linear = own.select("var").join(cost, "var", "left").select("var", F.coalesce("q", F.lit(2.0 * unary)).alias("q"))
    ways = own.groupBy("did").agg(F.min_by(F.struct("nx", "ny", "nz"), F.struct("gid", "var")).alias("n")).select("did", "n.*")
    return {"candidates": own, "linear": linear, "spatial": jn.spatial_costs(proximity, own, spatial), "directions": jn.direction_costs(ways, angles, pairwise), "cover": cover(own), "implies": implications(own)}


def select(problem: dict[str, DataFrame], most: int = selection.MOST_VARIABLES, most_nodes: int = selection.MOST_NODES) -> DataFrame:
    """candidates with status 1 if chosen, else -2, of least energy to within the gap that selection.solved gives; at most most variables that interact."""
    own = problem["candidates"].select("var", "gid", "did")
    costs = own.join(problem["linear"], "var").select("gid", "did", "q")
    ends = [own.select(F.col("var").alias(v), F.col("gid").alias(g)) for v, g in (("v0", "gid_a"), ("v1", "gid_b"))]
    spatial = problem["spatial"].join(ends[0], "v0").join(ends[1], "v1").select("gid_a", "gid_b", "q")
    rows = selection.solved(costs, problem["directions"], spatial, most, most_nodes).select("gid", F.col("did").alias("_did"))
    return problem["candidates"].join(rows, "gid", "left").withColumn("status", F.when(F.col("did") == F.col("_did"), 1).otherwise(-2)).drop("_did")


def subset_optimum(costs: DataFrame, pairs: DataFrame, directions: list[int]) -> DataFrame:
    """(subset, energy) of every direction subset (bit i: directions[i]) that covers all patches: for at most 16 directions, relationally."""
    if len(directions) > 16:
        raise ValueError("at most 16 directions")
    spark = costs.sparkSession
    bit = F.lit(0)
    for i, d in enumerate(directions):
        bit = F.when(F.col("did") == d, 1 << i).otherwise(bit)
    masks = spark.range(1, 1 << len(directions)).select(F.col("id").cast("int").alias("subset"))
    own = costs.withColumn("bit", bit).where("bit > 0")
    best = own.join(F.broadcast(masks), F.col("subset").bitwiseAND(F.col("bit")) > 0).groupBy("subset", "gid").agg(F.min("q").alias("q"))
    data = best.groupBy("subset").agg(F.sum("q").alias("data"), F.count("*").alias("covered"))
    n = costs.select("gid").distinct().count()
    two = lambda c: sum((F.when(F.col(c) == d, 1 << i).otherwise(0) for i, d in enumerate(directions)), F.lit(0))
    smooth = pairs.withColumn("bits", two("did_a").bitwiseOR(two("did_b"))).join(F.broadcast(masks), F.col("subset").bitwiseAND(F.col("bits")) == F.col("bits")).groupBy("subset").agg(F.sum("cost").alias("pairwise"))
    return data.where(F.col("covered") == n).join(smooth, "subset", "left").select("subset", (F.col("data") + F.coalesce("pairwise", F.lit(0.0))).alias("energy"))


def legacy_selection(data: dict[int, float], pair: dict[tuple[int, int], float], cover: list[set[int]], relaxed: bool = False, exact_up_to: int = 20) -> set[int]:
    """Primitives of least data cost plus pairwise cost over ordered pairs of chosen ones, such that each cover row holds a chosen one; a bounded problem on the driver.

    Up to exact_up_to primitives every subset is weighed; beyond that, and if relaxed, values between
    0 and 1 go down the slope, those of at least a half are taken, uncovered rows take their cheapest
    and what can go without loss goes. No rows are covered by nothing.
    """
    names = sorted(data)
    cost = lambda chosen: sum(data[i] for i in chosen) + sum(q for (a, b), q in pair.items() if a in chosen and b in chosen and a != b)
    rows = [r & set(names) for r in cover]
    if any(not r for r in rows):
        raise ValueError("a row without a primitive")
    if not relaxed and len(names) <= exact_up_to:
        best = None
        for mask in range(1 << len(names)):
            chosen = {n for i, n in enumerate(names) if mask >> i & 1}
            if all(r & chosen for r in rows) and (best is None or cost(chosen) < best[0] - 1e-12):
                best = (cost(chosen), chosen)
        return best[1]
    x = dict.fromkeys(names, 0.5)
    size = 1.0 / (1 + max((abs(v) for v in data.values()), default=0) + sum(abs(q) for q in pair.values()))
    for _ in range(200):
        slope = dict(data)
        for (a, b), q in pair.items():
            if a != b:
                slope[a] += q * x[b]
                slope[b] += q * x[a]
        for r in rows:
            short = 1 - sum(x[i] for i in r)
            for i in r:
                slope[i] -= 10 / size * max(0.0, short) * size
        x = {i: min(1.0, max(0.0, v - size * slope[i])) for i, v in x.items()}
    chosen = {i for i, v in x.items() if v >= 0.5}
    for r in rows:
        if not r & chosen:
            chosen.add(min(r, key=lambda i: (data[i], i)))
    for i in sorted(chosen, key=lambda i: (-data[i], i)):
        if all(r & (chosen - {i}) for r in rows) and cost(chosen - {i}) <= cost(chosen):
            chosen = chosen - {i}
    return chosen


def exactly_one(candidates: DataFrame) -> DataFrame:
    """cover() with the number of directions a patch takes: one."""
    return cover(candidates).withColumn("takes", F.lit(1))
