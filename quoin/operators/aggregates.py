"""Aggregates over points, primitives and directions, each one shuffle on its key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import geometry as g
from quoin.lineage import cut
from quoin.sources.schema import ACTIVE, FIXED, SMALL

S = g.SCATTER


def populations(points: DataFrame) -> DataFrame:
    """Points per patch; unassigned points count nowhere."""
    return points.where("gid is not null").groupBy("gid").agg(F.count("*").alias("n"))


def population_lists(points: DataFrame) -> DataFrame:
    """The pids of each patch, ascending. A patch is a row here; count with populations() where patches may be huge."""
    return points.where("gid is not null").groupBy("gid").agg(F.array_sort(F.collect_list("pid")).alias("pids"), F.count("*").alias("n"))


def population_of(points: DataFrame, gid: int) -> DataFrame:
    return points.where(F.col("gid") == gid)


def centroids(points: DataFrame, weight: str | None = None) -> DataFrame:
    """Mean place per patch, weighted by a column if given."""
    mean = (lambda c: F.sum(F.col(c) * F.col(weight)) / F.sum(weight)) if weight else F.avg
    return points.where("gid is not null").groupBy("gid").agg(*[mean(c).alias("c" + c) for c in "xyz"])


def moments(points: DataFrame, by: str = "gid") -> DataFrame:
    """n, centroid and scatter (sums, not means, of centred products) per group in one pass."""
    pair = lambda a, b: (F.covar_pop(a, b) * F.count("*")).alias(f"s{a}{b}")
    return points.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), *[F.avg(c).alias("c" + c) for c in "xyz"], pair("x", "x"), pair("x", "y"), pair("x", "z"), pair("y", "y"), pair("y", "z"), pair("z", "z"))


def eigenvalues(scatter: DataFrame) -> DataFrame:
    """moments() with the scatter's eigenvalues l0 <= l1 <= l2."""
    return g.with_eigenvalues(scatter)


def plane_fit(points: DataFrame) -> DataFrame:
    """The unweighted least-squares plane per patch: centroid, unit normal of the smallest eigenvalue, and the eigenvalues.

    One row per patch is written to the shared folder: later steps read it several times, and the
    optimizer's inferred filters grow exponentially over the closed form's chain of columns.
    """
    e = g.with_eigenvector(eigenvalues(moments(points)), "l0")
    return cut(e.select("gid", "n", F.col("cx").alias("px"), F.col("cy").alias("py"), F.col("cz").alias("pz"), "nx", "ny", "nz", "l0", "l1", "l2"))


def line_fit(points: DataFrame) -> DataFrame:
    """The unweighted least-squares line per patch: centroid and unit direction of the largest eigenvalue."""
    e = g.with_eigenvector(eigenvalues(moments(points)), "l2")
    return cut(e.select("gid", "n", F.col("cx").alias("px"), F.col("cy").alias("py"), F.col("cz").alias("pz"), "nx", "ny", "nz", "l0", "l1", "l2"))


def significance(scatter: DataFrame, kind: str = "plane", squared: bool = False) -> DataFrame:
    """Spatial significance on the scatter sum: of a line the root of its largest eigenvalue, of a plane the root of its two largest' product's root."""
    e = eigenvalues(scatter)
    value = F.greatest(F.col("l2"), F.lit(0.0)) if kind == "line" else F.sqrt(F.greatest(F.col("l1") * F.col("l2"), F.lit(0.0)))
    out = value if squared else F.sqrt(value)
    return e.select(*[c for c in scatter.columns if c in ("gid", "n")], F.when(F.col("n") > 0, out).otherwise(F.lit(-1.0)).alias("significance"))


def line_extent(points: DataFrame, lines: DataFrame, scale: float) -> DataFrame:
    """The two extreme projections of each line's points closer than scale: (gid, x0..z0, x1..z1)."""
    p, at, d = g.Vec.of("x", "y", "z"), g.Vec.of("px", "py", "pz"), g.Vec.of("nx", "ny", "nz")
    near = points.join(lines.select("gid", "px", "py", "pz", "nx", "ny", "nz"), "gid").where(g.line_distance(p, at, d) < scale)
    t = near.groupBy("gid", "px", "py", "pz", "nx", "ny", "nz").agg(F.min(p.minus(at).dot(d)).alias("t0"), F.max(p.minus(at).dot(d)).alias("t1"))
    ends = [at.plus(d.times(F.col(k))) for k in ("t0", "t1")]
    return t.select("gid", *[c.alias(f"{k}{i}") for i, v in enumerate(ends) for k, c in zip("xyz", v, strict=True)])


def box(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Axis-aligned box, per group or of all."""
    return points.groupBy(*(by or [])).agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def voxel_grid(points: DataFrame, leaf: float) -> DataFrame:
    """The mean point of each cubic cell of side leaf."""
    cell = [F.floor(F.col(c) / leaf).alias("i" + c) for c in "xyz"]
    return points.groupBy(*cell).agg(*[F.avg(c).alias(c) for c in "xyz"], F.count("*").alias("n"))


def data_cost(points: DataFrame, planes: DataFrame, weight: float = 1.0, complexity: float = 0.0) -> DataFrame:
    """weight * mean squared plane distance per primitive, plus complexity; 2 weight for one without points."""
    d = g.plane_distance(g.Vec.of("x", "y", "z"), g.Vec.of("px", "py", "pz"), g.Vec.of("nx", "ny", "nz"))
    own = planes.select("gid", "px", "py", "pz", "nx", "ny", "nz")
    cost = points.join(own, "gid").groupBy("gid").agg((weight * F.avg(d * d)).alias("mean"))
    return planes.select("gid", "did").join(cost, "gid", "left").select("gid", "did", (F.coalesce("mean", F.lit(2.0 * weight)) + complexity).alias("cost"))


def direction_arity(primitives: DataFrame) -> DataFrame:
    """Primitives per direction."""
    return primitives.groupBy("did").agg(F.count("*").alias("n"))


def direction_points(points: DataFrame, primitives: DataFrame) -> DataFrame:
    """Points of the active primitives of each direction."""
    return primitives.where(F.col("status").isin(ACTIVE, FIXED)).join(populations(points), "gid").groupBy("did").agg(F.sum("n").alias("n"))


def representatives(primitives: DataFrame, measure: str = "significance") -> DataFrame:
    """The primitive of largest measure of each direction; the smaller gid on ties."""
    rest = [c for c in primitives.columns if c not in ("did",)]
    best = primitives.groupBy("did").agg(F.max_by(F.struct(*rest), F.struct(F.col(measure), -F.col("gid"))).alias("best"))
    return best.select("did", "best.*")


def refit_simple(points: DataFrame, planes: DataFrame, scale: float) -> DataFrame:
    """Planes moved to the mean of their inliers' projections, direction kept; a plane without inliers stays."""
    p, at, n = g.Vec.of("x", "y", "z"), g.Vec.of("px", "py", "pz"), g.Vec.of("nx", "ny", "nz")
    foot = g.plane_projection(p, at, n)
    own = planes.select("gid", "px", "py", "pz", "nx", "ny", "nz")
    mean = points.join(own, "gid").where(g.plane_distance(p, at, n) < scale).groupBy("gid").agg(*[F.avg(c).alias("m" + k) for k, c in zip("xyz", foot, strict=True)])
    return planes.join(mean, "gid", "left").withColumns({f"p{k}": F.coalesce(f"m{k}", f"p{k}") for k in "xyz"}).drop("mx", "my", "mz")


def energy(linear: DataFrame, quadratic: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """One row (data, pairwise, total) of x'q and x'Qx with x of the chosen variables (all if not given)."""
    if chosen is not None:
        linear = linear.join(chosen.select("var"), "var", "left_semi")
        quadratic = quadratic.join(chosen.select(F.col("var").alias("v0")), "v0", "left_semi").join(chosen.select(F.col("var").alias("v1")), "v1", "left_semi")
    a = linear.agg(F.coalesce(F.sum("q"), F.lit(0.0)).alias("data"))
    b = quadratic.agg(F.coalesce(F.sum("q"), F.lit(0.0)).alias("pairwise"))
    return a.crossJoin(b).withColumn("total", F.col("data") + F.col("pairwise"))


def angle_histogram(pairs: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(did, angle_id, n) of active pairs (did_a, did_b, diff, index) that lie at an ideal angle, counted for both directions."""
    exact = pairs.where(F.col("diff") < tolerance)
    # exploded, so that the pairs are made once
    both = exact.select(F.explode(F.array("did_a", "did_b")).alias("did"), F.col("index").alias("angle_id"))
    return both.groupBy("did", "angle_id").agg(F.count("*").alias("n"))


def generator_votes(histogram: DataFrame, angles: list[float], generators: list[float]) -> DataFrame:
    """(did, generator, votes): of each direction the generator whose multiples most of its angles are; the smaller generator on ties."""
    rows = [(i, float(gen)) for i, a in enumerate(angles) for gen in generators if a > 1e-6 and abs(a / gen - round(a / gen)) * gen < math.radians(0.5)]
    table = histogram.sparkSession.createDataFrame(rows, "angle_id int, generator double")
    votes = histogram.join(F.broadcast(table), "angle_id").groupBy("did", "generator").agg(F.sum("n").alias("votes"))
    return votes.groupBy("did").agg(F.max_by(F.struct("generator", "votes"), F.struct(F.col("votes"), -F.col("generator"))).alias("best")).select("did", "best.generator", "best.votes")


def noise_sigma(distances: DataFrame, reference: float = 1.0) -> DataFrame:
    """Root of the variance of distances over a reference deviation."""
    return distances.agg((F.stddev_pop("distance") / reference).alias("sigma"))


def angle_error_statistics(errors: DataFrame) -> DataFrame:
    """Mean, variance, median and share of exact zeros of error."""
    return errors.agg(F.avg("error").alias("mean"), F.var_pop("error").alias("variance"), F.percentile("error", F.lit(0.5)).alias("median"), F.avg(F.when(F.col("error") == 0, 1.0).otherwise(0.0)).alias("zero_share"))


def histogram(values: DataFrame, low: float, high: float, bins: int, column: str = "value") -> DataFrame:
    """(bin, n, cdf): counts in equal bins of [low, high], values outside in the end bins, and their running share."""
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(column) - low) / (high - low) * bins))).cast("int")
    n = values.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = Window.orderBy("bin")
    return n.withColumn("cdf", F.sum("n").over(every) / F.sum("n").over(Window.partitionBy()))


def normal_density(x: Column, mean: float, deviation: float) -> Column:
    return F.exp(-F.pow((x - mean) / deviation, 2) / 2) / (deviation * math.sqrt(2 * math.pi))


def uniform_density(x: Column, low: float, high: float) -> Column:
    return F.when(x.between(low, high), 1 / (high - low)).otherwise(F.lit(0.0))


def orientation_histogram(directions: DataFrame, step: float = 1.0) -> DataFrame:
    """(bin, n): polar angle of (nx, ny) folded to [0, 180) degrees in bins of step."""
    degrees = F.pmod(F.degrees(F.atan2("ny", "nx")), F.lit(180.0))
    return directions.groupBy(F.floor(degrees / step).alias("bin")).agg(F.count("*").alias("n"))


def sphere_map(directions: DataFrame, width: int = 360, height: int = 180) -> DataFrame:
    """(u, v, n): normals counted by pixel of a longitude-latitude map."""
    u = F.least(F.lit(width - 1), F.floor((F.atan2("ny", "nx") + math.pi) / (2 * math.pi) * width))
    v = F.least(F.lit(height - 1), F.floor(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("nz")))) / math.pi * height))
    return directions.groupBy(u.alias("u"), v.alias("v")).agg(F.count("*").alias("n"))


def pair_angle_histogram(pairs: DataFrame, step: float = 1.0) -> DataFrame:
    """(degrees, n): pair angles in degrees, rounded to step, modulo 180."""
    steps = F.degrees("angle") / step
    # round() of a double makes decimals; angles aren't negative
    whole = F.floor(steps) + F.when(steps - F.floor(steps) >= 0.5, 1).otherwise(0)
    return pairs.groupBy((F.pmod(whole * F.lit(float(step)), F.lit(180.0))).alias("degrees")).agg(F.count("*").alias("n"))


def relation_statistics(primitives: DataFrame) -> DataFrame:
    """nodes, metanodes (directions) and edges (pairs of one direction) of a relation graph."""
    return direction_arity(primitives).agg(F.sum("n").alias("nodes"), F.count("*").alias("metanodes"), F.sum(F.expr("n * (n - 1) div 2")).alias("edges"))


def active_directions(primitives: DataFrame) -> DataFrame:
    """How many directions the active primitives have."""
    return primitives.where(F.col("status") == ACTIVE).agg(F.count_distinct("did").alias("directions"))


def support_precision(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """(gid, precision): the largest distance of a support point from its plane, sphere, cylinder or cone.

    shapes: gid, kind, v: plane nx ny nz d; sphere cx cy cz r; cylinder px py pz dx dy dz r; cone ax ay az dx dy dz half-angle.
    """
    v = lambda *i: g.Vec(*[F.get("v", F.lit(k)) for k in i])
    p = g.Vec.of("x", "y", "z")
    k = lambda i: F.get("v", F.lit(i))
    axis = g.line_distance(p, v(0, 1, 2), v(3, 4, 5))
    along = p.minus(v(0, 1, 2)).dot(v(3, 4, 5))
    d = (
        F.when(F.col("kind") == "plane", F.abs(p.dot(v(0, 1, 2)) + k(3)))
        .when(F.col("kind") == "sphere", F.abs(p.minus(v(0, 1, 2)).norm() - k(3)))
        .when(F.col("kind") == "cylinder", F.abs(axis - k(6)))
        .otherwise(F.abs(axis * F.cos(k(6)) - along * F.sin(k(6))))
    )
    return points.join(shapes, "gid").groupBy("gid").agg(F.max(d).alias("precision"))


def not_small(primitives: DataFrame) -> DataFrame:
    return primitives.where(F.col("status") != SMALL)
