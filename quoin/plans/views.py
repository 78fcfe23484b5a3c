"""SQL of the same views as quoin.sources.tables, for the oracles."""

from __future__ import annotations

PI = "3.141592653589793e0"

PTS_EMB = """pe0 AS (SELECT vec_id AS pid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z,
  CAST(embedding[4] AS DOUBLE) AS a, CAST(embedding[5] AS DOUBLE) AS b, CAST(embedding[6] AS DOUBLE) AS c, CAST(label AS BIGINT) AS gid FROM embeddings),
pts_emb AS (SELECT pid, x, y, z, a/sqrt(a*a+b*b+c*c) AS nx, b/sqrt(a*a+b*b+c*c) AS ny, c/sqrt(a*a+b*b+c*c) AS nz, gid FROM pe0)"""
PTS_LI = "pts_li AS (SELECT l_suppkey AS gid, l_quantity/50e0 AS x, l_extendedprice/105000e0 AS y, l_discount*10e0 AS z FROM lineitem)"
PTS_EV = "pts_ev AS (SELECT event_id AS pid, (epoch_us(ts)/1e6 - 1704067200e0)/2592000e0 AS x, value/500e0 AS y, user_id/150e0 AS z, user_id AS gid FROM events)"
ASSOC = "assoc_ord AS (SELECT o_orderkey AS pid, o_custkey AS gid FROM orders)"


def moments(view: str) -> str:
    """mo: n, centroid and scatter sums per gid of a view."""
    pairs = ", ".join(f"covar_pop({a},{b})*count(*) AS s{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))
    return f"mo AS (SELECT gid, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, {pairs} FROM {view} WHERE gid IS NOT NULL GROUP BY gid)"


EIGEN = """e1 AS (SELECT *, (sxx+syy+szz)/3e0 AS q FROM mo),
e2 AS (SELECT *, sqrt(((sxx-q)*(sxx-q)+(syy-q)*(syy-q)+(szz-q)*(szz-q)+2e0*(sxy*sxy+sxz*sxz+syz*syz))/6e0) AS p FROM e1),
e3 AS (SELECT *, (((sxx-q)*((syy-q)*(szz-q)-syz*syz) - sxy*(sxy*(szz-q)-syz*sxz) + sxz*(sxy*syz-(syy-q)*sxz))/(p*p*p))/2e0 AS r FROM e2),
e4 AS (SELECT *, acos(greatest(-1e0, least(1e0, r)))/3e0 AS phi FROM e3),
e5 AS (SELECT *, q + 2e0*p*cos(phi + 2e0*3.141592653589793e0/3e0) AS l0, q + 2e0*p*cos(phi) AS l2 FROM e4),
eig AS (SELECT *, 3e0*q - l0 - l2 AS l1 FROM e5)"""


def vector(value: str, name: str) -> str:
    """name: eig with the unit eigenvector vx, vy, vz of column value, first component over 1e-9 positive."""
    return f"""{name}0 AS (SELECT *, sxx-{value} AS dxx, syy-{value} AS dyy, szz-{value} AS dzz FROM eig),
{name}1 AS (SELECT *, sxy*syz-sxz*dyy AS ax, sxz*sxy-dxx*syz AS ay, dxx*dyy-sxy*sxy AS az,
  sxy*dzz-sxz*syz AS bx, sxz*sxz-dxx*dzz AS by_, dxx*syz-sxy*sxz AS bz,
  dyy*dzz-syz*syz AS gx, syz*sxz-sxy*dzz AS gy, sxy*syz-dyy*sxz AS gz FROM {name}0),
{name}2 AS (SELECT *, ax*ax+ay*ay+az*az AS na, bx*bx+by_*by_+bz*bz AS nb, gx*gx+gy*gy+gz*gz AS ng FROM {name}1),
{name}3 AS (SELECT *, CASE WHEN na>=nb AND na>=ng THEN ax WHEN nb>=ng THEN bx ELSE gx END AS ux, CASE WHEN na>=nb AND na>=ng THEN ay WHEN nb>=ng THEN by_ ELSE gy END AS uy,
  CASE WHEN na>=nb AND na>=ng THEN az WHEN nb>=ng THEN bz ELSE gz END AS uz, greatest(na,nb,ng) AS nn FROM {name}2),
{name}4 AS (SELECT *, ux/sqrt(nn) AS wx, uy/sqrt(nn) AS wy, uz/sqrt(nn) AS wz FROM {name}3),
{name}5 AS (SELECT *, CASE WHEN abs(wx)>1e-9 THEN sign(wx) WHEN abs(wy)>1e-9 THEN sign(wy) ELSE sign(wz) END AS sg FROM {name}4),
{name} AS (SELECT *, wx*sg AS vx, wy*sg AS vy, wz*sg AS vz FROM {name}5)"""


PLANES_LI = f"{PTS_LI}, {moments('pts_li')}, {EIGEN}, {vector('l0', 'pv')}, planes AS (SELECT gid, n, cx AS px, cy AS py, cz AS pz, vx AS nx, vy AS ny, vz AS nz, l0, l1, l2 FROM pv)"
PLANES_EMB = f"{PTS_EMB}, {moments('pts_emb')}, {EIGEN}, {vector('l0', 'pv')}, planes AS (SELECT gid, n, cx AS px, cy AS py, cz AS pz, vx AS nx, vy AS ny, vz AS nz, l0, l1, l2 FROM pv)"
LINES_EMB = f"{PTS_EMB}, {moments('pts_emb')}, {EIGEN}, {vector('l2', 'lv')}, lines AS (SELECT gid, n, cx AS px, cy AS py, cz AS pz, vx AS nx, vy AS ny, vz AS nz, l0, l1, l2 FROM lv)"


def angle(a: str, b: str) -> str:
    """SQL of the angle between normals of aliases a and b."""
    cross = f"pow({a}.ny*{b}.nz-{a}.nz*{b}.ny,2)+pow({a}.nz*{b}.nx-{a}.nx*{b}.nz,2)+pow({a}.nx*{b}.ny-{a}.ny*{b}.nx,2)"
    return f"atan2(sqrt({cross}), {a}.nx*{b}.nx+{a}.ny*{b}.ny+{a}.nz*{b}.nz)"


def nearest_diff(angle_sql: str, angles: list[float]) -> str:
    return "least(" + ", ".join(f"abs({angle_sql}-{a!r}e0)" if "e" not in repr(a) else f"abs({angle_sql}-{a!r})" for a in angles) + ")"


def distance2(a: str, b: str) -> str:
    return "+".join(f"({a}.{k}-{b}.{k})*({a}.{k}-{b}.{k})" for k in "xyz")
