"""All pairs of rows, compared in numpy by tiles: for pairs that are too many to be rows each."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.lineage import cut

TILE = 4096
CHUNK = 256


def _tiles(n: int, tasks: int) -> int:
    """Tiles of at most about 4,096 rows, or smaller ones where a few tasks more can share the work."""
    return max(1, math.ceil(n / TILE), min(math.ceil(n / 256), math.ceil(2 * tasks**0.5)))


def _parts(pairs: int) -> int:
    return min(pairs, 8192)


def within(rows: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame], schema: str, key: str = "gid") -> DataFrame:
    """What run makes of each two tiles of rows (number columns; key differs): run(a, b, same), both ascending by key, a's keys below b's or a and b the same tile.

    Tiles are ranges of key; each two are one group, so no task holds more than two tiles
    and what run makes of them, and a row moves once a tile.
    """
    rows = cut(rows.where(F.col(key).isNotNull()))
    k = _tiles(rows.count(), rows.sparkSession.sparkContext.defaultParallelism)
    bounds = sorted(set(rows.approxQuantile(key, [i / k for i in range(1, k)], 0.2 / k))) if k > 1 else []
    k = len(bounds) + 1
    own = rows.withColumn("_t", sum(((F.col(key) >= x).cast("int") for x in bounds), F.lit(0))).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    own = own.withColumns({"_i": F.least("_t", "_s"), "_j": F.greatest("_t", "_s")}).drop("_s")

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        i, j = int(frame["_i"].iat[0]), int(frame["_j"].iat[0])
        side = lambda n: frame[frame["_t"] == n].drop(columns=["_t", "_i", "_j"]).sort_values(key, kind="stable")
        a = side(i)
        return run(a, a if i == j else side(j), i == j)

    return own.repartition(_parts(k * (k + 1) // 2), "_i", "_j").groupBy("_i", "_j").applyInPandas(each, schema)


def between(one: DataFrame, two: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, key: str = "gid", other: str | None = None) -> DataFrame:
    """What run makes of each tile of one with each of two; tiles are dealt by a hash of key (of two: other, if named), and come ascending by it."""
    other = other or key
    one, two = cut(one.where(F.col(key).isNotNull())), cut(two.where(F.col(other).isNotNull()))
    tasks = one.sparkSession.sparkContext.defaultParallelism
    ka, kb = _tiles(one.count(), tasks), _tiles(two.count(), tasks)
    dealt = lambda rows, by, own, k, beside, n: rows.withColumn(own, F.pmod(F.xxhash64(by), F.lit(k)).cast("int")).withColumn(beside, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(_parts(ka * kb), "_i", "_j").groupBy("_i", "_j")

    def each(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        side = lambda f, by: f.drop(columns=["_i", "_j"]).sort_values(by, kind="stable")
        return run(side(a, key), side(b, other))

    return dealt(one, key, "_i", ka, "_j", kb).cogroup(dealt(two, other, "_j", kb, "_i", ka)).applyInPandas(each, schema)


def numbers(frame: pd.DataFrame, *columns: str) -> list[np.ndarray]:
    """The columns as doubles, a null as not-a-number."""
    return [frame[c].to_numpy(dtype=float, na_value=np.nan) for c in columns]


def chunks(n: int, size: int = CHUNK) -> list[slice]:
    return [slice(k, k + size) for k in range(0, n, size)]


def dot(a: list[np.ndarray], b: list[np.ndarray], some: slice) -> np.ndarray:
    """Products of some of a's rows with each of b's, summed in the order that columns are."""
    x, y, z = (u[some, None] * w for u, w in zip(a, b, strict=True))
    return x + y + z


def later(a: pd.DataFrame, b: pd.DataFrame, some: slice, same: bool, key: str = "gid") -> np.ndarray | bool:
    """Where b's key is beyond that of some of a's rows, of two tiles of within()."""
    return a[key].to_numpy()[some, None] < b[key].to_numpy() if same else True


def together(frames: list[pd.DataFrame], schema: str) -> pd.DataFrame:
    """One table of what chunks gave."""
    return pd.concat(frames, ignore_index=True) if frames else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
