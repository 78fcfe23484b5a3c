"""Iterative fits per patch in numpy; each group is a patch, bounded by the segmentation."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FIT = "gid long, n long, px double, py double, pz double, nx double, ny double, nz double"


def _oriented(v: np.ndarray) -> np.ndarray:
    first = next((c for c in v if abs(c) > 1e-9), 1.0)
    return v if first > 0 else -v


def weighted_fit(xyz: np.ndarray, kind: str, weights: np.ndarray | None = None, plain_centre: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Centroid, and the normal (plane) or direction (line) of the weighted scatter; plain_centre leaves the centroid unweighted."""
    w = np.ones(len(xyz)) if weights is None or weights.sum() <= 0 else weights
    centre = xyz.mean(axis=0) if plain_centre else (w[:, None] * xyz).sum(axis=0) / w.sum()
    d = xyz - centre
    _, vectors = np.linalg.eigh((w[:, None] * d).T @ d)
    return centre, _oriented(vectors[:, 0] if kind == "plane" else vectors[:, 2])


def distances(xyz: np.ndarray, at: np.ndarray, way: np.ndarray, kind: str, signed: bool = False) -> np.ndarray:
    d = xyz - at
    if kind == "plane":
        s = d @ way
        return s if signed else np.abs(s)
    return np.linalg.norm(np.cross(d, way), axis=1)


def robust(xyz: np.ndarray, kind: str, scale: float, refit: int, signed: bool = False, start: tuple[np.ndarray, np.ndarray] | None = None, position_only: bool = False, plain_centre: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """refit + 1 rounds of iteratively reweighted least squares; the first is unweighted unless start is given. signed keeps signed plane distances in the weights."""
    at, way = start if start is not None else weighted_fit(xyz, kind)
    for _ in range(refit + (start is not None)):
        e = distances(xyz, at, way, kind, signed)
        w = np.where(e < scale, ((e / scale) ** 2 - 1) ** 2, 0.0)
        if w.sum() <= 0:
            break
        new, turned = weighted_fit(xyz, kind, w, plain_centre)
        at, way = new, way if position_only else turned
    return at, way


def fit_patches(points: DataFrame, kind: str = "plane", scale: float = 0.05, refit: int = 2, signed: bool = False, plain_centre: bool = False) -> DataFrame:
    """A robust plane or line per patch, or its twin with an unweighted centroid. Patches of fewer than three points (planes) or two (lines) give none."""
    least = 3 if kind == "plane" else 2

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) < least:
            return pd.DataFrame(columns=[x.split()[0] for x in FIT.split(", ")])
        at, way = robust(frame[["x", "y", "z"]].to_numpy(), kind, scale, refit, signed, plain_centre=plain_centre)
        return pd.DataFrame([(key[0], len(frame), *at, *way)], columns=[x.split()[0] for x in FIT.split(", ")])

    return points.where("gid is not null").select("gid", "x", "y", "z").groupBy("gid").applyInPandas(run, FIT)


def rectangle(xyz: np.ndarray, at: np.ndarray, normal: np.ndarray, aligned: bool = False) -> np.ndarray:
    """Corners of the smallest rectangle, in the plane, around the projected points: angles by 1 degree, then by 0.2 around the best.

    aligned keeps the plane's own axes, which lie along a coordinate axis.
    """
    foot = xyz - ((xyz - at) @ normal)[:, None] * normal
    axis = np.eye(3)[np.argmin(np.abs(normal))]
    u = np.cross(normal, axis)
    u /= np.linalg.norm(u)
    v = np.cross(normal, u)
    p = np.column_stack([(foot - at) @ u, (foot - at) @ v])

    def area(a: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        turn = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
        q = p @ turn
        low, high = q.min(axis=0), q.max(axis=0)
        return float(np.prod(high - low)), low, high, turn

    best = 0.0
    if not aligned:
        coarse = min(np.radians(np.arange(-45, 46)), key=lambda a: area(a)[0])
        best = min(coarse + np.radians(np.arange(-1, 1.01, 0.2)), key=lambda a: area(a)[0])
    _, low, high, turn = area(best)
    corners = np.array([[low[0], low[1]], [high[0], low[1]], [high[0], high[1]], [low[0], high[1]]]) @ turn.T
    return at + corners[:, :1] * u + corners[:, 1:] * v


def plane_extents(points: DataFrame, planes: DataFrame, scale: float, aligned: bool = False) -> DataFrame:
    """(gid, corners): the smallest rectangle around each plane's inliers (along its own axes if aligned); planes without three inliers have none."""
    kind = "gid long, corners array<struct<x:double,y:double,z:double>>"

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        at, normal = frame[["px", "py", "pz"]].to_numpy()[0], frame[["nx", "ny", "nz"]].to_numpy()[0]
        xyz = frame[["x", "y", "z"]].to_numpy()
        xyz = xyz[distances(xyz, at, normal, "plane") < scale]
        if len(xyz) < 3:
            return pd.DataFrame({"gid": [], "corners": []})
        return pd.DataFrame({"gid": [key[0]], "corners": [[dict(zip("xyz", map(float, c), strict=True)) for c in rectangle(xyz, at, normal, aligned)]]})

    joined = points.select("gid", "x", "y", "z").join(planes.select("gid", "px", "py", "pz", "nx", "ny", "nz"), "gid")
    return joined.groupBy("gid").applyInPandas(run, kind)


def hull(xy: np.ndarray) -> np.ndarray:
    """Convex hull of 2D points, counter-clockwise (monotone chain)."""
    p = np.unique(xy, axis=0)
    if len(p) < 3:
        return p

    def half(rows) -> list:
        out: list = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def polygon_area(h: np.ndarray) -> float:
    x, y = h[:, 0], h[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def inside(h: np.ndarray, q: np.ndarray) -> bool:
    """Whether a point lies in a counter-clockwise convex polygon."""
    e, d = np.roll(h, -1, axis=0) - h, q - h
    return bool((e[:, 0] * d[:, 1] - e[:, 1] * d[:, 0] >= -1e-12).all())


def plane_hulls(points: DataFrame, planes: DataFrame) -> DataFrame:
    """(gid, area, corners): the convex hull of each plane's projected points."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        at, n = frame[["px", "py", "pz"]].to_numpy()[0], frame[["nx", "ny", "nz"]].to_numpy()[0]
        u = np.cross(n, np.eye(3)[np.argmin(np.abs(n))])
        u /= np.linalg.norm(u)
        v = np.cross(n, u)
        d = frame[["x", "y", "z"]].to_numpy() - at
        h = hull(np.column_stack([d @ u, d @ v]))
        return pd.DataFrame({"gid": [key[0]], "area": [polygon_area(h)], "corners": [[dict(zip("xyz", map(float, at + a * u + b * v), strict=True)) for a, b in h]]})

    joined = points.select("gid", "x", "y", "z").join(planes.select("gid", "px", "py", "pz", "nx", "ny", "nz"), "gid")
    return joined.groupBy("gid").applyInPandas(run, "gid long, area double, corners array<struct<x:double,y:double,z:double>>")


def ransac(points: DataFrame, kind: str, scale: float, most: int | None = None, rounds: int = 200, least: int = 5) -> DataFrame:
    """(gid, k, n, place, normal or direction) of primitives drawn from each patch one after another by random samples, until fewer than least points agree, or most of them; the seed is the patch's, so reruns agree."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pid")
        xyz, rows = frame[["x", "y", "z"]].to_numpy(), []
        rng = np.random.default_rng(int(key[0]) + 1)
        need = 3 if kind == "plane" else 2
        for k in itertools.count() if most is None else range(most):
            if len(xyz) < max(need, least):
                break
            best = None
            for _ in range(rounds):
                s = xyz[rng.choice(len(xyz), need, replace=False)]
                way = np.cross(s[1] - s[0], s[2] - s[0]) if kind == "plane" else s[1] - s[0]
                norm = np.linalg.norm(way)
                if norm > 1e-12:
                    hit = distances(xyz, s[0], way / norm, kind) < scale
                    if best is None or hit.sum() > best.sum():
                        best = hit
            if best is None or best.sum() < least:
                break
            at, way = weighted_fit(xyz[best], kind)
            rows.append((key[0], k, int(best.sum()), *at, *way))
            xyz = xyz[~best]
        return pd.DataFrame(rows, columns=["gid", "k", "n", "px", "py", "pz", "nx", "ny", "nz"])

    return points.select("gid", "pid", "x", "y", "z").groupBy("gid").applyInPandas(run, "gid long, k int, n long, px double, py double, pz double, nx double, ny double, nz double")


def ellipses(points: DataFrame, scale: float) -> DataFrame:
    """(gid, centre, a, b): PCA ellipse of each patch; half-axes are the largest projections, at least a quarter of scale."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        xyz = frame[["x", "y", "z"]].to_numpy()
        centre = xyz.mean(axis=0)
        d = xyz - centre
        vectors = np.linalg.eigh(d.T @ d)[1] if len(xyz) > 2 else np.eye(3)
        a, b = (max(0.25 * scale, float(np.abs(d @ vectors[:, i]).max())) for i in (2, 1))
        return pd.DataFrame([(key[0], *centre, a, b)], columns=["gid", "cx", "cy", "cz", "a", "b"])

    return points.select("gid", "x", "y", "z").groupBy("gid").applyInPandas(run, "gid long, cx double, cy double, cz double, a double, b double")
