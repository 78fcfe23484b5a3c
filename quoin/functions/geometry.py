"""Geometry as Column expressions: vectors are three columns, so Catalyst sees plain arithmetic."""

from __future__ import annotations

import math
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Vec(NamedTuple):
    """Three columns taken as a vector."""

    x: Column
    y: Column
    z: Column

    @classmethod
    def of(cls, *names: str) -> Vec:
        return cls(*[F.col(n).cast("double") for n in names])

    @classmethod
    def lit(cls, x: float, y: float, z: float) -> Vec:
        return cls(F.lit(float(x)), F.lit(float(y)), F.lit(float(z)))

    @classmethod
    def field(cls, struct: Column) -> Vec:
        return cls(struct["x"], struct["y"], struct["z"])

    def plus(self, o: Vec) -> Vec:
        return Vec(self.x + o.x, self.y + o.y, self.z + o.z)

    def minus(self, o: Vec) -> Vec:
        return Vec(self.x - o.x, self.y - o.y, self.z - o.z)

    def times(self, k: Column | float) -> Vec:
        return Vec(self.x * k, self.y * k, self.z * k)

    def dot(self, o: Vec) -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: Vec) -> Vec:
        return Vec(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def norm(self) -> Column:
        return F.sqrt(self.dot(self))

    def unit(self) -> Vec:
        """Length one; a zero vector stays zero."""
        n = self.norm()
        return Vec(*[F.when(n > 0, c / n).otherwise(F.lit(0.0)) for c in self])

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.z.alias("z"))


def angle(a: Vec, b: Vec) -> Column:
    """Angle between vectors in [0, pi], from the length of the cross product and the dot product; not-a-number becomes 0."""
    return F.nanvl(F.atan2(a.cross(b).norm(), a.dot(b)), F.lit(0.0))


def folded(a: Column) -> Column:
    """An angle of undirected lines, in [0, pi/2]."""
    return F.when(a > math.pi / 2, math.pi - a).otherwise(a)


def plane_distance(p: Vec, at: Vec, normal: Vec, signed: bool = False) -> Column:
    """Distance of p from a plane; signed along the normal if asked."""
    d = p.minus(at).dot(normal)
    return d if signed else F.abs(d)


def plane_projection(p: Vec, at: Vec, normal: Vec) -> Vec:
    return p.minus(normal.times(p.minus(at).dot(normal)))


def line_distance(p: Vec, at: Vec, direction: Vec) -> Column:
    """Distance of p from a line of unit direction."""
    return at.minus(p).cross(direction).norm()


def line_projection(p: Vec, at: Vec, direction: Vec) -> Vec:
    return at.plus(direction.times(p.minus(at).dot(direction) / direction.dot(direction)))


def segment_distance(p: Vec, a: Vec, b: Vec) -> Column:
    """Distance of p from the segment a-b: perpendicular where the foot is inside, else to the nearer end."""
    d = b.minus(a)
    t = F.when(d.dot(d) > 0, p.minus(a).dot(d) / d.dot(d)).otherwise(F.lit(0.0))
    foot = a.plus(d.times(t))
    return F.when(t.between(0, 1), p.minus(foot).norm()).otherwise(F.least(p.minus(a).norm(), p.minus(b).norm()))


def rectangle_distance(p: Vec, c0: Vec, c1: Vec, c3: Vec) -> Column:
    """Distance of p from the rectangle with corner c0 and its two neighbours c1 and c3: a box distance in its own frame."""
    u, v = c1.minus(c0), c3.minus(c0)
    lu, lv = u.norm(), v.norm()
    q = p.minus(c0)
    a, b = q.dot(u.unit()), q.dot(v.unit())
    n = u.cross(v).unit()
    out = lambda t, side: F.greatest(-t, t - side, F.lit(0.0))
    du, dv, dn = out(a, lu), out(b, lv), q.dot(n)
    return F.sqrt(du * du + dv * dv + dn * dn)


def extents_distance(a: Column, b: Column, corners: int = 4) -> Column:
    """Distance of two finite primitives, arrays of corners (two: segments; four: rectangles): the least corner-to-primitive distance, both ways."""

    def to(points: Column, own: Column) -> Column:
        c = [Vec.field(own[i]) for i in range(corners)]
        return F.array_min(F.transform(points, lambda p: segment_distance(Vec.field(p), c[0], c[1]) if corners == 2 else rectangle_distance(Vec.field(p), c[0], c[1], c[3])))

    return F.least(to(a, b), to(b, a))


def growth_distance(d: Column, a: Column, scale: float, limit: float, weight: float = 1.0) -> Column:
    """Combined spatial and angular patch distance; below 1 a point may join."""
    return weight * weight * d * d / (scale * scale) + a * a / (limit * limit)


def full_linkage(distances: Column) -> Column:
    """The largest of an array of distances: no member is farther."""
    return F.array_max(distances)


def squared_linkage(distances: Column) -> Column:
    """Mean square of an array of distances."""
    return F.aggregate(distances, F.lit(0.0), lambda s, d: s + d * d) / F.size(distances)


def representative_linkage(distances: Column) -> Column:
    """The least of an array of distances: that of the member nearest to the patch's representative."""
    return F.array_min(distances)


def centroid_distance(p: Vec, centroid: Vec) -> Column:
    """Distance of a point from a patch's centroid."""
    return p.minus(centroid).norm()


def line_points(at: Vec, direction: Vec, width: Column) -> tuple[Vec, Vec, Vec]:
    """Tangent, mid-point and end of a line primitive that starts at a point."""
    return direction.unit(), at.plus(direction.times(width / 2)), at.plus(direction.times(width))


def robust_weight(d: Column, scale: float, signed: bool = False) -> Column:
    """((d/scale)^2 - 1)^2 for d below scale, else 0. signed keeps the sign of d, so negative distances weigh without bound."""
    e = d if signed else F.abs(d)
    return F.when(e < scale, F.pow(F.pow(e / scale, 2) - 1, 2)).otherwise(F.lit(0.0))


TRUNCATED_AT = 0.0934


def pair_energy(diff: Column, kind: str = "sqrt") -> Column:
    """Cost of an angle's difference from its ideal: sqrt, truncated sqrt, or the sixth power."""
    if kind == "sqrt":
        return F.sqrt(diff)
    if kind == "truncated":
        return F.least(F.sqrt(diff), F.lit(TRUNCATED_AT))
    if kind == "sixth":
        return F.pow(diff, 6)
    raise ValueError(kind)


def spatial_weight(distance: Column, scale: float, coefficient: float, reach: float = 2.0) -> Column:
    """coefficient * max(reach * scale - distance, 0) / scale."""
    return coefficient * F.greatest(reach * scale - distance, F.lit(0.0)) / scale


def smooth_energy(diff: Column, did_a: Column, did_b: Column, gen_a: Column, gen_b: Column, distance: Column, scale: float, coefficient: float, truncation: float | None = None) -> Column:
    """Pairwise energy that is 0 for one direction, gated by generator angle, truncated if asked, with a flat bonus coefficient for near primitives."""
    base = F.sqrt(diff) if truncation is None else F.least(F.sqrt(diff), F.lit(truncation))
    near = F.when(spatial_weight(distance, scale, coefficient) > 0, F.lit(coefficient)).otherwise(F.lit(0.0))
    gate = F.when((gen_a == gen_b) | gen_a.isNull() | gen_b.isNull(), base).otherwise(2 * base)
    return F.when(did_a == did_b, F.lit(0.0)).otherwise(gate + near)


def rotated(v: Vec, axis: Vec, by: Column) -> Vec:
    """v turned about a unit axis (Rodrigues)."""
    c, s = F.cos(by), F.sin(by)
    return v.times(c).plus(axis.cross(v).times(s)).plus(axis.times(axis.dot(v) * (1 - c)))


def plane_from(own_normal: Vec, other_normal: Vec, by: Column, extreme: Column) -> Vec:
    """The normal a plane gets from another's: as it is for the first or last ideal angle, else turned by the angle about other x own."""
    axis = other_normal.cross(own_normal).unit()
    turned = rotated(other_normal, axis, by)
    return Vec(*[F.when(extreme, a).otherwise(b) for a, b in zip(other_normal, turned, strict=True)])


def line_from(own: Vec, other: Vec, by: Column) -> Vec:
    """The direction a line gets from another's: turned about Z by plus or minus the angle, whichever is closer to its own."""
    z = Vec.lit(0, 0, 1)
    plus, minus = rotated(other, z, by), rotated(other, z, -by)
    first = F.abs(plus.dot(own)) >= F.abs(minus.dot(own))
    return Vec(*[F.when(first, a).otherwise(b) for a, b in zip(plus, minus, strict=True)])


def plane_at(normal: Vec, distance: Column) -> Vec:
    """A point of the plane with this unit normal and distance from the origin."""
    return normal.times(distance)


def four_coefficients(at: Vec, normal: Vec) -> tuple[Column, Column, Column, Column]:
    """(n, -n.at) of a plane."""
    return normal.x, normal.y, normal.z, -normal.dot(at)


def hough(at: Vec, direction: Vec) -> tuple[Column, Column]:
    """(r, angle) of a line in the plane: the foot of the perpendicular from the origin."""
    n = Vec(-direction.y, direction.x, F.lit(0.0)).unit()
    r = at.dot(n)
    flip = F.when(r < 0, -1.0).otherwise(1.0)
    return r * flip, F.atan2(n.y * flip, n.x * flip)


def from_hough(r: Column, a: Column) -> tuple[Vec, Vec]:
    """Point and direction of a line from (r, angle)."""
    return Vec(r * F.cos(a), r * F.sin(a), F.lit(0.0)), Vec(-F.sin(a), F.cos(a), F.lit(0.0))


def line_normal(direction: Vec) -> Vec:
    """n x Z of a stored normal or direction: lines are kept in files as normals."""
    return direction.cross(Vec.lit(0, 0, 1))


def triangle_sides(a: Vec, b: Vec, c: Vec) -> tuple[Column, Column, Column]:
    return a.minus(b).norm(), b.minus(c).norm(), c.minus(a).norm()


def triangle_normal(a: Vec, b: Vec, c: Vec) -> Vec:
    return b.minus(a).cross(c.minus(a)).unit()


def triangle_mean(a: Vec, b: Vec, c: Vec) -> Vec:
    return a.plus(b).plus(c).times(1 / 3)


def triangle_distance(p: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """Distance of p from a triangle: to its plane where the foot is inside, else to the nearest side."""
    n = triangle_normal(a, b, c)
    d = p.minus(a).dot(n)
    foot = p.minus(n.times(d))
    side = lambda u, v: v.minus(u).cross(foot.minus(u)).dot(n)
    inside = (side(a, b) >= 0) & (side(b, c) >= 0) & (side(c, a) >= 0) & (n.norm() > 0)
    return F.when(inside, F.abs(d)).otherwise(F.least(segment_distance(p, a, b), segment_distance(p, b, c), segment_distance(p, c, a)))


def to_frame(p: Vec, origin: Vec, ex: Vec, ey: Vec, ez: Vec) -> Vec:
    """p in the frame with this origin and axes."""
    q = p.minus(origin)
    return Vec(q.dot(ex), q.dot(ey), q.dot(ez))


def transformed(p: Vec, matrix: list[list[float]]) -> Vec:
    """p under a rigid transform given as three rows of four numbers."""
    return Vec(*[p.x * r[0] + p.y * r[1] + p.z * r[2] + r[3] for r in matrix])


def unprojected(u: Column, v: Column, depth: Column, fx: float, fy: float, cx: float, cy: float) -> Vec:
    """The point of a depth pixel under a pinhole camera."""
    return Vec((u - cx) * depth / fx, (v - cy) * depth / fy, depth)


def distance_colour(d: Column, most: float) -> Column:
    """A colour name by distance: blue, green, yellow, red in quarters of most.

    A quarter is the double nearest to its decimals, as 3 * 0.4 / 4 is over 0.3.
    """
    one, two, three = (float(Decimal(repr(float(most))) * k / 4) for k in (1, 2, 3))
    return F.when(d < one, "blue").when(d < two, "green").when(d < three, "yellow").otherwise("red")


def rgb(hue: Column, saturation: Column, value: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue (0 to 1) of a hue in degrees, saturation and value."""

    def part(shift: float) -> Column:
        k = F.pmod(F.lit(shift) + hue / 60, F.lit(6.0))
        return value - value * saturation * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return part(5.0), part(3.0), part(1.0)


def shared_area(box: Column, a: Column, b: Column) -> Column:
    """Similarity 1 - (A - (a + b)) / A of two extents in the box of their union."""
    return F.when(box > 0, 1 - (box - (a + b)) / box).otherwise(F.lit(1.0))


SCATTER = ("sxx", "sxy", "sxz", "syy", "syz", "szz")


def with_eigenvalues(df: DataFrame) -> DataFrame:
    """df with l0 <= l1 <= l2, the eigenvalues of its symmetric matrix sxx..szz in closed form.

    Built in steps of named columns, so that no expression is repeated inside others.
    """
    c = F.col
    df = df.withColumn("_q", (c("sxx") + c("syy") + c("szz")) / 3)
    df = df.withColumns({"_a": c("sxx") - c("_q"), "_b": c("syy") - c("_q"), "_c": c("szz") - c("_q")})
    off = c("sxy") * c("sxy") + c("sxz") * c("sxz") + c("syz") * c("syz")
    df = df.withColumn("_p", F.sqrt((c("_a") * c("_a") + c("_b") * c("_b") + c("_c") * c("_c") + 2 * off) / 6))
    det = c("_a") * (c("_b") * c("_c") - c("syz") * c("syz")) - c("sxy") * (c("sxy") * c("_c") - c("syz") * c("sxz")) + c("sxz") * (c("sxy") * c("syz") - c("_b") * c("sxz"))
    df = df.withColumn("_r", F.when(c("_p") > 1e-150, det / (c("_p") * c("_p") * c("_p")) / 2).otherwise(F.lit(0.0)))
    df = df.withColumn("_phi", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c("_r")))) / 3)
    df = df.withColumns({"l0": c("_q") + 2 * c("_p") * F.cos(c("_phi") + 2 * math.pi / 3), "l2": c("_q") + 2 * c("_p") * F.cos(c("_phi"))})
    return df.withColumn("l1", 3 * c("_q") - c("l0") - c("l2")).drop("_q", "_a", "_b", "_c", "_p", "_r", "_phi")


def with_eigenvector(df: DataFrame, value: str, names: tuple[str, str, str] = ("nx", "ny", "nz")) -> DataFrame:
    """df with a unit eigenvector of its matrix for the simple eigenvalue in column value: the longest cross product of two rows, first component above 1e-9 positive."""
    c = F.col
    df = df.withColumns({"_a": c("sxx") - c(value), "_b": c("syy") - c(value), "_c": c("szz") - c(value)})
    rows = [Vec(c("_a"), c("sxy"), c("sxz")), Vec(c("sxy"), c("_b"), c("syz")), Vec(c("sxz"), c("syz"), c("_c"))]
    crosses = [rows[0].cross(rows[1]), rows[0].cross(rows[2]), rows[1].cross(rows[2])]
    df = df.withColumns({f"_v{i}{k}": x for i, v in enumerate(crosses) for k, x in zip("xyz", v, strict=True)})
    df = df.withColumns({f"_n{i}": Vec(*[c(f"_v{i}{k}") for k in "xyz"]).norm() for i in range(3)})
    first, second = (c("_n0") >= c("_n1")) & (c("_n0") >= c("_n2")), c("_n1") >= c("_n2")
    df = df.withColumns({f"_w{k}": F.when(first, c(f"_v0{k}") / c("_n0")).when(second, c(f"_v1{k}") / c("_n1")).otherwise(c(f"_v2{k}") / c("_n2")) for k in "xyz"})
    df = df.withColumn("_sign", F.when(F.abs("_wx") > 1e-9, F.signum("_wx")).when(F.abs("_wy") > 1e-9, F.signum("_wy")).otherwise(F.signum("_wz")))
    df = df.withColumns({n: c(f"_w{k}") * c("_sign") for n, k in zip(names, "xyz", strict=True)})
    return df.drop("_a", "_b", "_c", "_sign", *[f"_v{i}{k}" for i in range(3) for k in "xyz"], *[f"_n{i}" for i in range(3)], *[f"_w{k}" for k in "xyz"])
