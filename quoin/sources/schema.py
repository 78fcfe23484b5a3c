"""Schemas of the three tables (points, primitives, assignments) and their codes."""

from __future__ import annotations

from pyspark.sql import types as T

# Status codes of a primitive.
ACTIVE, SMALL, FIXED, UNSET, INVALID = 1, 2, 3, -1, -2

_D = T.DoubleType()
POINTS = T.StructType([T.StructField("pid", T.LongType()), *[T.StructField(c, _D) for c in ("x", "y", "z", "nx", "ny", "nz")], T.StructField("gid", T.LongType())])
PRIMITIVES = T.StructType(
    [*[T.StructField(c, _D) for c in ("px", "py", "pz", "nx", "ny", "nz")], T.StructField("gid", T.LongType()), T.StructField("did", T.LongType()), T.StructField("status", T.ByteType()), T.StructField("gen_angle", _D), T.StructField("lid", T.LongType())]
)
ASSIGNMENTS = T.StructType([T.StructField("pid", T.LongType()), T.StructField("gid", T.LongType())])
CORRESPONDENCE = T.StructType([T.StructField(c, T.LongType()) for c in ("gid_a", "lid_a", "did_a", "gid_b", "lid_b", "did_b")])
TRIANGLES = "tid long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double"
EXTENTS = "gid long, corners array<struct<x:double,y:double,z:double>>"
