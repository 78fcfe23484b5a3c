"""Ideal angles: generation, lookup, and generators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALF_DEGREE = math.radians(0.5)


def angle_set(generators: list[float], parallel: bool = True, radians: bool = False) -> list[float]:
    """0, every multiple below pi of each generator (degrees unless radians), and pi, ascending; generators under 1e-3 rad are skipped.

    Without parallel the ends 0 and pi are left out. Multiples within 1e-6 of pi or of each other are one.
    """
    out = {0.0, math.pi} if parallel else set()
    for g in generators:
        step = abs(g if radians else math.radians(g))
        if step < 1e-3:
            continue
        k = 1
        while k * step < math.pi - 1e-6:
            if all(abs(k * step - a) > 1e-6 for a in out):
                out.add(k * step)
            k += 1
    return sorted(out)


def angle_table(generators: DataFrame, degrees_col: str = "degrees") -> DataFrame:
    """The angle set of a table of generators, as rows (angle)."""
    step = F.radians(F.abs(F.col(degrees_col).cast("double")))
    made = generators.where(step >= 1e-3).select(F.explode(F.sequence(F.lit(1), F.ceil((math.pi - 1e-6) / step).cast("int"))).alias("k"), step.alias("step")).where(F.col("k") * F.col("step") < math.pi - 1e-6).select((F.col("k") * F.col("step")).alias("angle"))
    ends = generators.sparkSession.createDataFrame([(0.0,), (math.pi,)], "angle double")
    return made.union(ends).groupBy(F.round("angle", 6).alias("key")).agg(F.min("angle").alias("angle")).select("angle")


def deduced_generators(angles: list[float], tolerance: float = HALF_DEGREE) -> list[float]:
    """The angles that are no multiple (within tolerance) of a smaller one kept before."""
    out: list[float] = []
    for a in sorted(angles):
        if a > tolerance and not any(abs(a - round(a / g) * g) < tolerance for g in out):
            out.append(a)
    return out


def dividing_generator(angle: Column, generators: list[float], tolerance: float = HALF_DEGREE) -> Column:
    """The first generator that divides the angle to within tolerance; null if none."""
    array = F.array(*[F.lit(float(g)) for g in generators])
    return F.get(F.filter(array, lambda g: F.abs(angle - F.round(angle / g) * g) < tolerance), F.lit(0))


def away(angle: Column, angles: list[float]) -> Column:
    """The distance of angle from the ideal angle closest to it."""
    each = [F.abs(angle - a) for a in angles]
    return F.least(*each) if len(each) > 1 else each[0]


def nearest(angle: Column, angles: list[float]) -> Column:
    """struct(diff, index) of the ideal angle closest to angle; the first wins a tie."""
    diff = away(angle, angles)
    index = F.when(diff.isNull(), 0)
    for i, a in enumerate(angles[:-1]):
        index = index.when(F.abs(angle - a) == diff, i)
    # by comparisons: an array of structs would be made for every pair of a join
    return F.struct(diff.alias("diff"), index.otherwise(len(angles) - 1).cast("int").alias("index"))


def listed(angle: Column, angles: list[float], tolerance: float = HALF_DEGREE) -> Column:
    """Whether some ideal angle is within tolerance."""
    return F.exists(F.array(*[F.lit(float(a)) for a in angles]), lambda a: F.abs(angle - a) < tolerance)


def union(a: Column, b: Column) -> Column:
    """Ordered union of two arrays of angles."""
    return F.array_sort(F.array_distinct(F.concat(a, b)))


def parse(text: str, inclusive_degrees: bool = False) -> list[float]:
    """A comma-separated list of generators as an angle set in radians, or in degrees up to 180."""
    generators = [float(x) for x in text.split(",") if x.strip()]
    own = angle_set(generators)
    return [math.degrees(a) for a in own] if inclusive_degrees else own
