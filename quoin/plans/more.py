"""More registered queries: files written and read back, scalar functions, filters and smaller operators, with their oracles."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.functions import angles as an
from quoin.functions import geometry as g
from quoin.lineage import cut, removed, shared_folder
from quoin.operators import aggregates as ag
from quoin.operators import candidates as cd
from quoin.operators import evaluate as ev
from quoin.operators import filters as fl
from quoin.operators import joins as jn
from quoin.operators import merge, problem, scene
from quoin.operators import relations as rl
from quoin.operators import represent as rp
from quoin.operators import spatial as sp
from quoin.plans import views as v
from quoin.plans.catalog import _PRIMS, ANGLES, ORACLES, QUERIES, RIGHT, planes_emb, primitives, query, r, rounded  # noqa: F401
from quoin.sources import files, schema
from quoin.sources import tables as t

PLACE, NORMAL = ("x", "y", "z"), ("nx", "ny", "nz")


# --- files: written to the shared folder, read back, removed


def through_file(spark: SparkSession, write, read) -> DataFrame:
    """read(path) after write(path), kept in the shared folder; the file is removed."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    write(path)
    out = cut(read(path))
    removed(spark, path)
    return out


def text_file(lines: DataFrame, order: str):
    """Writes lines(order, value) as one ordered text."""
    return lambda path: lines.orderBy(order).select("value").coalesce(1).write.text(path)


_NUMBERED = f"{v.PTS_EMB}, pn AS (SELECT *, row_number() OVER (ORDER BY pid) - 1 AS k FROM pts_emb)"


@query("ply_points", f"WITH {_NUMBERED} SELECT k AS pid, {', '.join(f'{r(c, 5)} AS {c}' for c in (*PLACE, *NORMAL))} FROM pn")
def ply_points(spark, d):
    """Points written as ASCII PLY and read again."""
    p = t.points_embeddings(spark, d)
    back = through_file(spark, lambda path: files.write_points(p, path), lambda path: files.read_points(spark, path))
    return rounded(back.select("pid", *PLACE, *NORMAL), *PLACE, *NORMAL, places=5)


@query("primitive_file", f"WITH {_PRIMS} SELECT gid, did, CAST(status AS INTEGER) AS status, {', '.join(f"{r(f'round({c}, 9)', 5)} AS {c}" for c in ('px', 'py', 'pz', *NORMAL))}, 0 AS lid FROM prims")
def primitive_file(spark, d):
    """Primitives written as their ten fields and read again."""
    p = primitives(spark, d).withColumn("gen_angle", F.lit(None).cast("double"))
    back = through_file(spark, lambda path: files.write_primitives(p, path), lambda path: files.read_primitives(spark, path))
    return rounded(back.select("gid", "did", F.col("status").cast("int").alias("status"), "px", "py", "pz", *NORMAL, F.col("lid").cast("int").alias("lid")), "px", "py", "pz", *NORMAL, places=5)


@query("primitive_file_lines", f"WITH {_PRIMS} SELECT gid, {r('round(ny, 9)', 5)} AS nx, {r('-round(nx, 9)', 5)} AS ny FROM prims")
def primitive_file_lines(spark, d):
    """The same, with stored normals turned into directions."""
    p = primitives(spark, d).withColumn("gen_angle", F.lit(None).cast("double"))
    back = through_file(spark, lambda path: files.write_primitives(p, path), lambda path: files.read_primitives(spark, path, lines_as_normals=True))
    return rounded(back.select("gid", "nx", "ny"), "nx", "ny", places=5)


_TAKEN = f"{v.ASSOC}, tk AS (SELECT pid, CASE WHEN pid % 5 <> 0 THEN gid END AS gid FROM assoc_ord)"


def partly(spark, d) -> DataFrame:
    return t.assignments_orders(spark, d).withColumn("gid", F.when(F.col("pid") % 5 != 0, F.col("gid")))


@query("assignment_file", f"WITH {_TAKEN} SELECT pid, gid FROM tk")
def assignment_file(spark, d):
    """Assignments, some missing, written and read again."""
    a = partly(spark, d)
    return through_file(spark, lambda path: files.write_assignments(a, path), lambda path: files.read_assignments(spark, path)).select("pid", "gid")


@query("scene_files", f"WITH {_NUMBERED}, {v.ASSOC} SELECT k AS pid, {r('x', 5)} AS x, a.gid FROM pn LEFT JOIN assoc_ord a ON a.pid = pn.k")
def scene_files(spark, d):
    """A cloud, primitives and assignments written as three files and read as a scene: the points with their patches."""
    p, a = t.points_embeddings(spark, d), t.assignments_orders(spark, d)
    prims = primitives(spark, d).withColumn("gen_angle", F.lit(None).cast("double"))

    def write(path: str) -> None:
        files.write_points(p, path + "/cloud")
        files.write_primitives(prims, path + "/primitives")
        files.write_assignments(a, path + "/assignments")

    back = through_file(spark, write, lambda path: files.read_scene(spark, path + "/cloud", path + "/primitives", path + "/assignments")[0])
    return rounded(back.select("pid", "x", "gid"), "x", places=5)


@query("dense_ranks", f"WITH {_TAKEN} SELECT pid, gid, dense_rank() OVER (ORDER BY gid NULLS FIRST) - 1 AS index FROM tk")
def dense_ranks(spark, d):
    """The dense rank of each point's patch; points without one share the first."""
    return files.dense_index(partly(spark, d)).select("pid", "gid", F.col("index").cast("long").alias("index"))


_OBJ = f"""{_NUMBERED}, ob AS (SELECT k, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM pn),
tr AS (SELECT a.k // 3 AS tid, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM ob a JOIN ob b ON b.k = a.k + 1 JOIN ob c ON c.k = a.k + 2 WHERE a.k % 3 = 0)"""


@query("obj_triangles", f"WITH {_OBJ} SELECT tid, ax, by_ AS byy, cz FROM tr WHERE least(sqrt(pow(ax-bx,2)+pow(ay-by_,2)+pow(az-bz,2)), sqrt(pow(cx-bx,2)+pow(cy-by_,2)+pow(cz-bz,2)), sqrt(pow(ax-cx,2)+pow(ay-cy,2)+pow(az-cz,2))) >= 0.1e0")
def obj_triangles(spark, d):
    """A mesh with a triangle for every three points, and one face of four corners, written as OBJ and read again."""
    p = t.points_embeddings(spark, d)
    k = cut(files.windows.numbered(p, "pid", name="k"))
    n = k.count()
    vertices = k.select(F.col("k").alias("o"), F.concat_ws(" ", F.lit("v"), *[F.round(c, 6).cast("string") for c in PLACE]).alias("value"))
    faces = k.where((F.col("k") % 3 == 0) & (F.col("k") + 2 < n)).select((F.col("k") + n).alias("o"), F.concat_ws(" ", F.lit("f"), *[F.concat((F.col("k") + i).cast("string"), F.lit("/1")) for i in (1, 2, 3)]).alias("value"))
    quad = spark.createDataFrame([(10**9, "f 1 2 3 4"), (-1, "# mesh")], "o long, value string")
    back = through_file(spark, text_file(vertices.unionByName(faces).unionByName(quad), "o"), lambda path: files.read_triangles(spark, path, 0.1))
    return back.select("tid", "ax", F.col("by").alias("byy"), "cz")


_DEPTH = "dp AS (SELECT l_linenumber AS u, l_quantity AS v, l_discount*10e0 AS depth FROM lineitem)"


@query("depth_cloud", f"WITH {_DEPTH} SELECT {r('(u-3e0)*depth/2e0')} AS x, {r('(v-20e0)*depth/4e0 + 1e0')} AS y, {r('depth')} AS z FROM dp WHERE depth > 0.2e0")
def depth_cloud(spark, d):
    """Points of depth pixels under a pinhole camera, moved along y."""
    pixels = t.read(spark, d, "lineitem").select(F.col("l_linenumber").alias("u"), F.col("l_quantity").alias("v"), (F.col("l_discount") * 10).alias("depth"))
    out = files.cloud_from_depth(pixels, 2.0, 4.0, 3.0, 20.0, pose=[[1, 0, 0, 0], [0, 1, 0, 1], [0, 0, 1, 0]])
    return rounded(out.select(*PLACE), *PLACE)


def put(spark: SparkSession, path: str, body: bytes) -> None:
    """A small file of bytes that the driver holds, through Spark's file systems."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(body))
    out.close()


@query("raw_depth", "SELECT (row_number() OVER (ORDER BY n_nationkey) - 1) % 5 AS u, (row_number() OVER (ORDER BY n_nationkey) - 1) // 5 AS v, round(n_nationkey*100e0 + n_regionkey, 0)*0.001e0 AS depth FROM nation")
def raw_depth(spark, d):
    """A raw 16-bit depth image of the nations, five pixels wide."""
    rows = t.read(spark, d, "nation").orderBy("n_nationkey").collect()
    body = b"".join(int(x.n_nationkey * 100 + x.n_regionkey).to_bytes(2, "little") for x in rows)
    return through_file(spark, lambda path: put(spark, path, body), lambda path: files.read_depth(spark, path, 5))


@query("binary_points", "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pid, n_nationkey*1e0 AS x, n_regionkey*0.5e0 AS y, -1e0 AS z FROM nation")
def binary_points(spark, d):
    """A big-endian PLY of the nations, read as points."""
    import struct

    rows = t.read(spark, d, "nation").orderBy("n_nationkey").collect()
    head = f"ply\nformat binary_big_endian 1.0\nelement vertex {len(rows)}\nproperty double x\nproperty float y\nproperty int z\nproperty uchar red\nend_header\n"
    body = head.encode() + b"".join(struct.pack(">dfiB", x.n_nationkey, x.n_regionkey * 0.5, -1, 7) for x in rows)
    return through_file(spark, lambda path: put(spark, path, body), lambda path: files.read_binary_points(spark, path)).select("pid", *PLACE)


@query("svg_paths", "SELECT n_nationkey*1e0+1e0 AS x0, n_regionkey*1e0+2e0 AS y0, n_nationkey*1e0+4e0 AS x1, n_regionkey*1e0+2e0 AS y1 FROM nation UNION ALL SELECT n_nationkey*1e0+4e0, n_regionkey*1e0+2e0, n_nationkey*1e0+1e0, n_regionkey*1e0+2e0 FROM nation")
def svg_paths(spark, d):
    """A drawing with a closed path for each nation inside a moved group."""
    rows = t.read(spark, d, "nation").orderBy("n_nationkey").select(F.col("n_nationkey").alias("o"), F.format_string('<path d="M %d %d h 3 Z"/>', F.col("n_nationkey").cast("int"), F.col("n_regionkey").cast("int")).alias("value"))
    frame = spark.createDataFrame([(-1, '<svg><g transform="translate(1,2)">'), (10**6, "</g></svg>")], "o long, value string")
    return through_file(spark, text_file(rows.unionByName(frame), "o"), lambda path: files.read_svg_paths(spark, path))


def project_lines(spark, d) -> DataFrame:
    s = t.read(spark, d, "supplier")
    rows = s.select(F.col("s_suppkey").alias("o"), F.format_string('<primitive pos="%d %d 0" dir="0.6 0.8 0" dim="%d 0" uid="%d" did="%d"/>', F.col("s_suppkey").cast("int"), F.col("s_nationkey").cast("int"), (F.col("s_suppkey") % 7).cast("int"), F.col("s_suppkey").cast("int"), F.col("s_nationkey").cast("int")).alias("value"))
    return rows.unionByName(spark.createDataFrame([(-1, "<scene><primitives>"), (10**12, "</primitives></scene>")], "o long, value string"))


@query("project_file", "SELECT s_suppkey*1e0 AS x, s_nationkey*1e0 AS y, 0.6e0 AS dx, 0.8e0 AS dy, (s_suppkey % 7)*1e0 AS width, CAST(s_suppkey AS BIGINT) AS gid, CAST(s_nationkey AS BIGINT) AS did FROM supplier")
def project_file(spark, d):
    """A generator's project of all suppliers, read as primitives."""
    return through_file(spark, text_file(project_lines(spark, d), "o"), lambda path: files.read_project(spark, path)).select("x", "y", "dx", "dy", "width", "gid", "did")


@query("generator_rows", "SELECT s_suppkey + 0.6e0*(s_suppkey % 7)/2 AS x, -(s_nationkey + 0.8e0*(s_suppkey % 7)/2) AS y, 0.6e0 AS nx, -0.8e0 AS ny, CAST(s_suppkey AS BIGINT) AS gid, 1 AS used FROM supplier")
def generator_rows(spark, d):
    """Ground-truth lines of the project."""
    own = through_file(spark, text_file(project_lines(spark, d), "o"), lambda path: files.read_project(spark, path))
    return files.generator_rows(own).select("x", "y", "nx", "ny", "gid", "used")


@query("mesh_polygons", "WITH n AS (SELECT n_nationkey*1e0 AS x, n_regionkey*1e0 AS y, row_number() OVER (ORDER BY n_nationkey) - 1 AS k FROM nation) SELECT CAST(k // 5 AS BIGINT) AS face, CAST(k % 5 AS INTEGER) AS corner, x, y FROM n WHERE k < 25")
def mesh_polygons(spark, d):
    """A mesh with a polygon for every five nations."""
    rows = t.read(spark, d, "nation").orderBy("n_nationkey").collect()
    head = f"ply\nformat ascii 1.0\nelement vertex {len(rows)}\nproperty float x\nproperty float y\nproperty float z\nelement face 5\nproperty list uchar int vertex_indices\nend_header\n"
    body = head + "".join(f"{x.n_nationkey} {x.n_regionkey} 0\n" for x in rows) + "".join("5 " + " ".join(str(5 * i + k) for k in range(5)) + "\n" for i in range(5))
    return through_file(spark, lambda path: put(spark, path, body.encode()), lambda path: files.read_polygons(spark, path)).select("face", "corner", "x", "y")


@query("point_planes_text", f"WITH {v.PLANES_EMB} SELECT p.gid, {r('nx', 5)} AS nx, {r('-(nx*px+ny*py+nz*pz)', 5)} AS d, (SELECT string_agg(CAST(pid AS VARCHAR), ' ' ORDER BY pid) FROM pts_emb q WHERE q.gid = p.gid) AS members FROM planes p")
def point_planes_text(spark, d):
    """Points and planes written as the counted text and read again: the planes with their points."""
    p, planes = t.points_embeddings(spark, d), planes_emb(spark, d)
    n, m = p.count(), planes.count()
    gids = [x.gid for x in planes.select("gid").orderBy("gid").collect()]
    point = p.select(F.lit(1).alias("a"), F.col("pid").alias("o"), F.concat_ws(" ", *[F.col(c).cast("string") for c in (*PLACE, *NORMAL)], F.lit("1")).alias("value"))
    both = files.point_plane_lines(planes, p)
    lines = both.select(F.lit(3).alias("a"), (F.col("gid") * 2).alias("o"), F.col("plane").alias("value")).unionByName(both.select(F.lit(3).alias("a"), (F.col("gid") * 2 + 1).alias("o"), F.col("members").alias("value")))
    counts = spark.createDataFrame([(0, 0, f"{n}"), (2, 0, f"{m}")], "a int, o long, value string")
    every = counts.unionByName(point).unionByName(lines).withColumn("key", F.struct("a", "o"))
    back = through_file(spark, text_file(every, "key"), lambda path: files.read_point_planes(spark, path)[1])
    name = F.array(*[F.lit(x).cast("long") for x in gids])
    return rounded(back.select(F.element_at(name, F.col("gid").cast("int") + 1).alias("gid"), "nx", "d", F.array_join(F.transform("members", lambda x: x.cast("string")), " ").alias("members")), "nx", "d", places=5)


@query("correspondence_file", "SELECT s_suppkey AS gid_a, CAST(0 AS BIGINT) AS lid_a, CAST(s_nationkey AS BIGINT) AS did_a, s_suppkey + 1 AS gid_b, CAST(0 AS BIGINT) AS lid_b, CAST(s_nationkey AS BIGINT) AS did_b FROM supplier")
def correspondence_file(spark, d):
    """Matches written as text with a comment and read again."""
    s = t.read(spark, d, "supplier")
    rows = s.select(F.col("s_suppkey").alias("o"), F.concat_ws(",", "s_suppkey", F.lit("0"), "s_nationkey", (F.col("s_suppkey") + 1).cast("string"), F.lit("0"), "s_nationkey").alias("value"))
    top = spark.createDataFrame([(-1, "# a, b")], "o long, value string")
    return through_file(spark, text_file(rows.unionByName(top), "o"), lambda path: files.read_correspondence(spark, path))


@query("image_cloud", "SELECT l_linenumber*1e0 AS x, l_suppkey*1e0 AS y FROM lineitem WHERE l_quantity*5 < 200")
def image_cloud(spark, d):
    """All dark pixels of an image; more are asked for than there are."""
    pixels = t.read(spark, d, "lineitem").select(F.col("l_linenumber").alias("u"), F.col("l_suppkey").alias("v"), (F.col("l_quantity") * 5).alias("value"))
    return files.cloud_from_image(pixels, 10**12).select("x", "y")


@query("file_iterations", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE CAST(p_partkey % 100 AS INTEGER) END AS iteration FROM part")
def file_iterations(spark, d):
    """Iteration numbers of file names."""
    name = F.when(F.col("p_partkey") % 3 == 0, F.lit("cloud.ply")).otherwise(F.concat(F.lit("primitives_it"), (F.col("p_partkey") % 100).cast("string"), F.lit(".selected.csv")))
    return t.read(spark, d, "part").select("p_partkey", files.iteration(name).alias("iteration"))


@query("graph_lines", "SELECT '  \"' || s_suppkey || '\" -- \"' || s_nationkey || '\";' AS value FROM supplier")
def graph_lines(spark, d):
    return files.graph_lines(t.read(spark, d, "supplier"), "s_suppkey", "s_nationkey")


_LINES = f"{v.PTS_EMB}, ln AS (SELECT pid AS gid, x AS x0, y AS y0, z AS z0, x + 0.05e0*nx AS x1, y + 0.05e0*ny AS y1, z + 0.05e0*nz AS z1, nx, ny, nz FROM pts_emb)"


def line_ends(spark, d) -> DataFrame:
    end = lambda k: F.struct(*[((F.col(c) + k * F.col("n" + c)) if k else F.col(c)).alias(c) for c in "xyz"])
    return t.points_embeddings(spark, d).select(F.col("pid").alias("gid"), *NORMAL, F.array(end(0), end(0.05)).alias("corners"))


@query("line_extent_rows", f"WITH {_LINES} SELECT gid, {', '.join(f'{r(c)} AS {c}' for c in ('x0', 'y0', 'x1', 'y1'))} FROM ln")
def line_extent_rows(spark, d):
    return rounded(files.line_extent_rows(line_ends(spark, d)), "x0", "y0", "x1", "y1")


# rectangles of embeddings: 0.1 by 0.2 in the plane of a point's normal, which lies in x and y
_RECTS = f"""{v.PTS_EMB}, rc0 AS (SELECT pid AS gid, x, y, z, sqrt(nx*nx+ny*ny) AS h, nx, ny FROM pts_emb),
rc AS (SELECT gid, x AS ox, y AS oy, z AS oz, -ny/h AS ux, nx/h AS uy, nx/h AS wx, ny/h AS wy FROM rc0)"""


def rectangles(spark, d) -> DataFrame:
    """(gid, corners, ux, uy): a rectangle for each point, 0.1 across and 0.2 up."""
    h = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny"))
    p = t.points_embeddings(spark, d).withColumns({"ux": -F.col("ny") / h, "uy": F.col("nx") / h})
    corner = lambda a, b: F.struct((F.col("x") + a * F.col("ux")).alias("x"), (F.col("y") + a * F.col("uy")).alias("y"), (F.col("z") + F.lit(float(b))).alias("z"))
    return cut(p.select(F.col("pid").alias("gid"), F.array(corner(0.0, 0), corner(0.1, 0), corner(0.1, 0.2), corner(0.0, 0.2)).alias("corners"), "ux", "uy", "x", "y", "z"))


@query("hull_rows", f"WITH {_RECTS} SELECT gid, k AS corner, {r('ox + CASE WHEN k IN (1, 2) THEN 0.1e0*ux ELSE 0e0 END')} AS x, {r('oz + CASE WHEN k > 1 THEN 0.2e0 ELSE 0e0 END')} AS z FROM rc, (SELECT CAST(k AS INTEGER) AS k FROM range(0, 4) AS s(k))")
def hull_rows(spark, d):
    return rounded(files.hull_rows(rectangles(spark, d)).select("gid", "corner", "x", "z"), "x", "z")


# --- scalar functions


def frame_sql(point: tuple[str, str, str], c: str) -> str:
    """SQL of the distance of a point from the rectangle of alias c."""
    x, y, z = point
    along, off, up = f"(({x}-{c}.ox)*{c}.ux+({y}-{c}.oy)*{c}.uy)", f"(({x}-{c}.ox)*{c}.wx+({y}-{c}.oy)*{c}.wy)", f"({z}-{c}.oz)"
    return f"sqrt(pow(greatest(-{along}, {along}-0.1e0, 0e0),2)+pow(greatest(-{up}, {up}-0.2e0, 0e0),2)+pow({off},2))"


def grown_sql(point: tuple[str, str, str], c: str, by: str) -> str:
    """SQL of whether a point lies over the rectangle of alias c grown by by."""
    x, y, z = point
    return f"((({x}-{c}.ox)*{c}.ux+({y}-{c}.oy)*{c}.uy) BETWEEN -{by} AND 0.1e0+{by} AND ({z}-{c}.oz) BETWEEN -{by} AND 0.2e0+{by})"


def corner_sql(a: str, k: int) -> tuple[str, str, str]:
    s = "0.1e0" if k in (1, 2) else "0e0"
    return f"({a}.ox+{s}*{a}.ux)", f"({a}.oy+{s}*{a}.uy)", f"({a}.oz+{'0.2e0' if k > 1 else '0e0'})"


@query("extents_distance", f"WITH {_RECTS}, nx AS (SELECT a.gid, {', '.join(f'{frame_sql(corner_sql("a", k), "b")} AS d{k}' for k in range(4))}, {', '.join(f'{frame_sql(corner_sql("b", k), "a")} AS e{k}' for k in range(4))} FROM rc a JOIN rc b ON b.gid = a.gid + 1) SELECT gid, {r('least(d0, d1, d2, d3, e0, e1, e2, e3)', 5)} AS distance FROM nx")
def extents_distance(spark, d):
    """The distance of each rectangle from the next one's."""
    own = rectangles(spark, d).select("gid", F.col("corners").alias("a"))
    both = own.join(own.select((F.col("gid") - 1).alias("gid"), F.col("a").alias("b")), "gid")
    return rounded(both.select("gid", g.extents_distance(F.col("a"), F.col("b")).alias("distance")), "distance", places=5)


@query("patch_distances", f"WITH {v.PTS_EMB}, c AS (SELECT gid, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM pts_emb GROUP BY gid), q AS (SELECT p.gid, sqrt(pow(x-cx,2)+pow(y-cy,2)+pow(z-cz,2)) AS d, {v.angle('p', 'f')} AS a FROM pts_emb p JOIN c ON c.gid = p.gid JOIN (SELECT gid, arg_min(nx, pid) AS nx, arg_min(ny, pid) AS ny, arg_min(nz, pid) AS nz FROM pts_emb GROUP BY gid) f ON f.gid = p.gid) SELECT gid, {r('max(d)', 5)} AS full_linkage, {r('avg(d*d)', 5)} AS squared, {r('min(d)', 5)} AS representative, {r('sum(4e0*d*d/0.01e0 + a*a/0.25e0)', 3)} AS growth FROM q GROUP BY gid")
def patch_distances(spark, d):
    """Linkages of each patch's points to its centroid, and the sum of their growth distances to its first point's normal."""
    p = t.points_embeddings(spark, d)
    first = p.groupBy("gid").agg(F.min_by(F.struct(*NORMAL), "pid").alias("f"))
    joined = p.join(ag.centroids(p), "gid").join(first, "gid")
    far = g.centroid_distance(g.Vec.of(*PLACE), g.Vec.of("cx", "cy", "cz"))
    a = g.angle(g.Vec.of(*NORMAL), g.Vec(*[F.col("f")[c] for c in NORMAL]))
    rows = joined.select("gid", far.alias("d"), a.alias("a")).groupBy("gid").agg(F.collect_list("d").alias("ds"), F.sum(g.growth_distance(F.col("d"), F.col("a"), 0.1, 0.5, 2.0)).alias("growth"))
    return rounded(rounded(rows.select("gid", g.full_linkage(F.col("ds")).alias("full_linkage"), g.squared_linkage(F.col("ds")).alias("squared"), g.representative_linkage(F.col("ds")).alias("representative"), "growth"), "full_linkage", "squared", "representative", places=5), "growth", places=3)


@query("pair_energies", f"WITH {v.PTS_EV}, e AS (SELECT pid, y/4e0 AS w, z/3e0 AS dist, gid FROM pts_ev) SELECT pid, {r('least(sqrt(w), 0.0934e0)')} AS truncated, {r('pow(w, 6)')} AS sixth, {r('0.3e0*greatest(2e0*0.05e0-dist, 0e0)/0.05e0')} AS near, {r('CASE WHEN gid % 3 = pid % 3 THEN 0e0 ELSE CASE WHEN gid % 2 = pid % 2 OR pid % 5 = 0 THEN least(sqrt(w), 0.2e0) ELSE 2e0*least(sqrt(w), 0.2e0) END + CASE WHEN dist < 0.1e0 THEN 0.3e0 ELSE 0e0 END END')} AS smooth FROM e")
def pair_energies(spark, d):
    """Energy kernels of events: value as angle, user as distance."""
    e = t.points_events(spark, d).select("pid", "gid", (F.col("y") / 4).alias("w"), (F.col("z") / 3).alias("dist"))
    smooth = g.smooth_energy(F.col("w"), F.col("gid") % 3, F.col("pid") % 3, F.col("gid") % 2, F.when(F.col("pid") % 5 != 0, F.col("pid") % 2), F.col("dist"), 0.05, 0.3, 0.2)
    return rounded(e.select("pid", g.pair_energy(F.col("w"), "truncated").alias("truncated"), g.pair_energy(F.col("w"), "sixth").alias("sixth"), g.spatial_weight(F.col("dist"), 0.05, 0.3).alias("near"), smooth.alias("smooth")), "truncated", "sixth", "near", "smooth")


_C, _S = repr(math.cos(0.4)) + "e0", repr(math.sin(0.4)) + "e0"


@query("line_from_other", f"WITH {v.PTS_EMB}, q AS (SELECT a.pid, a.nx AS ox, a.ny AS oy, a.nz AS oz, b.nx*{_C}-b.ny*{_S} AS px, b.nx*{_S}+b.ny*{_C} AS py, b.nx*{_C}+b.ny*{_S} AS mx, -b.nx*{_S}+b.ny*{_C} AS my, b.nz AS bz FROM pts_emb a JOIN pts_emb b ON b.pid = a.pid + 1) SELECT pid, {r('CASE WHEN abs(px*ox+py*oy+bz*oz) >= abs(mx*ox+my*oy+bz*oz) THEN px ELSE mx END', 5)} AS nx, {r('CASE WHEN abs(px*ox+py*oy+bz*oz) >= abs(mx*ox+my*oy+bz*oz) THEN py ELSE my END', 5)} AS ny FROM q")
def line_from_other(spark, d):
    """The direction each point's line gets from the next one's at 0.4 radians."""
    p = t.points_embeddings(spark, d)
    both = p.select("pid", *NORMAL).join(p.select((F.col("pid") - 1).alias("pid"), *[F.col(c).alias("o" + c) for c in NORMAL]), "pid")
    way = g.line_from(g.Vec.of(*NORMAL), g.Vec.of("onx", "ony", "onz"), F.lit(0.4))
    return rounded(both.select("pid", way.x.alias("nx"), way.y.alias("ny")), "nx", "ny", places=5)


@query("plane_forms", f"WITH {v.PTS_EMB} SELECT pid, {r('nx*0.7e0')} AS x, {r('ny*0.7e0')} AS y, {r('nx')} AS a, {r('-(nx*x+ny*y+nz*z)')} AS d, {r('x*ny-y*nx')} AS fx, {r('x*0.8e0-y*0.6e0+1e0')} AS tx, {r('-ny*x+nx*y')} AS hr FROM pts_emb")
def plane_forms(spark, d):
    """A plane's point by distance, its four coefficients, a place in another frame and under a rigid transform."""
    at, n = g.Vec.of(*PLACE), g.Vec.of(*NORMAL)
    four, there = g.four_coefficients(at, n), g.plane_at(n, F.lit(0.7))
    zero, turn = g.Vec.lit(0, 0, 0), g.Vec(F.col("ny"), -F.col("nx"), F.lit(0.0))
    local = g.to_frame(at, zero, turn, g.Vec(-F.col("ny"), F.col("nx"), F.lit(0.0)), n)
    moved = g.transformed(at, [[0.8, -0.6, 0, 1], [0.6, 0.8, 0, 0], [0, 0, 1, 0]])
    return rounded(t.points_embeddings(spark, d).select("pid", there.x.alias("x"), there.y.alias("y"), four[0].alias("a"), four[3].alias("d"), local.x.alias("fx"), moved.x.alias("tx"), local.y.alias("hr")), "x", "y", "a", "d", "fx", "tx", "hr")


@query("hough_inverse", f"WITH {v.LINES_EMB}, h AS (SELECT gid, nx/sqrt(nx*nx+ny*ny) AS dx, ny/sqrt(nx*nx+ny*ny) AS dy, px, py FROM lines) SELECT gid, {r('abs(dx*0e0 + (px*(-dy)+py*dx))', 5)} AS r, {r('1e0', 5)} AS parallel FROM h")
def hough_inverse(spark, d):
    """Lines from their (r, angle): the distance from the origin, and how parallel they are to the line."""
    rows = files.hough_rows(ag.line_fit(t.points_embeddings(spark, d)))
    at, way = g.from_hough(F.col("r"), F.col("angle"))
    own = rows.join(ag.line_fit(t.points_embeddings(spark, d)).select("gid", "nx", "ny"), "gid")
    h = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny"))
    return rounded(own.select("gid", F.abs(at.dot(g.Vec(-way.y, way.x, F.lit(0.0)))).alias("r"), F.abs((way.x * F.col("nx") + way.y * F.col("ny")) / h).alias("parallel")), "r", "parallel", places=5)


@query("shared_area", f"WITH {v.PTS_EV} SELECT pid, {r('CASE WHEN x > 0 THEN 1e0 - (x - (y + z))/x ELSE 1e0 END', 4)} AS similarity FROM pts_ev")
def shared_area(spark, d):
    return rounded(t.points_events(spark, d).select("pid", g.shared_area(F.col("x"), F.col("y"), F.col("z")).alias("similarity")), "similarity", places=4)


@query("triangle_forms", f"WITH {_OBJ} SELECT tid, {r('sqrt(pow(ax-bx,2)+pow(ay-by_,2)+pow(az-bz,2))')} AS ab, {r('(ax+bx+cx)/3e0')} AS mx, {r('((by_-ay)*(cz-az)-(bz-az)*(cy-ay))/sqrt(pow((by_-ay)*(cz-az)-(bz-az)*(cy-ay),2)+pow((bz-az)*(cx-ax)-(bx-ax)*(cz-az),2)+pow((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax),2))', 5)} AS nx FROM tr")
def triangle_forms(spark, d):
    """A side, the mean and the normal of the triangles of every three points."""
    k = files.windows.numbered(t.points_embeddings(spark, d), "pid", name="k").withColumn("at", F.struct(*[F.round(c, 6).alias(c) for c in PLACE]))
    tri = k.groupBy(F.floor(F.col("k") / 3).cast("long").alias("tid")).agg(F.array_sort(F.collect_list(F.struct("k", "at"))).alias("c")).where("size(c) = 3")
    a, b, c = (g.Vec.field(F.col("c")[i]["at"]) for i in range(3))
    return rounded(rounded(tri.select("tid", g.triangle_sides(a, b, c)[0].alias("ab"), g.triangle_mean(a, b, c).x.alias("mx"), g.triangle_normal(a, b, c).x.alias("nx")), "ab", "mx"), "nx", places=5)


@query("primitive_points", "SELECT s_suppkey, (s_nationkey + 0.6e0*(s_suppkey % 7)/2) AS mid, (s_nationkey + 0.6e0*(s_suppkey % 7)) AS far, 0.6e0 AS tangent FROM supplier")
def primitive_points(spark, d):
    """Tangent, mid-point and end of line primitives."""
    s = t.read(spark, d, "supplier")
    at, way = g.Vec(F.col("s_nationkey").cast("double"), F.lit(0.0), F.lit(0.0)), g.Vec.lit(0.6, 0.8, 0)
    tangent, mid, far = g.line_points(at, way, (F.col("s_suppkey") % 7).cast("double"))
    return s.select("s_suppkey", mid.x.alias("mid"), far.x.alias("far"), tangent.x.alias("tangent"))


@query("palette", f"WITH {v.PTS_EV}, h AS (SELECT pid, (pid % 36)*10e0 AS h FROM pts_ev), q AS (SELECT pid, h, 0.8e0*0.5e0 AS c, 0.8e0*0.5e0*(1e0-abs((h/60e0) - 2e0*floor(h/120e0) - 1e0)) AS x, 0.8e0 - 0.4e0 AS m FROM h) SELECT pid, {r('m + CASE WHEN h < 60 OR h >= 300 THEN c WHEN h < 120 OR h >= 240 THEN x ELSE 0e0 END')} AS red, {r('m + CASE WHEN h < 60 THEN x WHEN h < 180 THEN c WHEN h < 240 THEN x ELSE 0e0 END')} AS green, {r('m + CASE WHEN h < 120 THEN 0e0 WHEN h < 180 THEN x WHEN h < 300 THEN c ELSE x END')} AS blue FROM q")
def palette(spark, d):
    """Colours of hues, with saturation 0.5 and value 0.8."""
    red, green, blue = g.rgb((F.col("pid") % 36) * 10.0, F.lit(0.5), F.lit(0.8))
    return rounded(t.points_events(spark, d).select("pid", red.alias("red"), green.alias("green"), blue.alias("blue")), "red", "green", "blue")


@query("listed_angles", f"WITH {v.PTS_EV}, w AS (SELECT pid, y*1.5e0 AS w FROM pts_ev) SELECT pid, {' OR '.join(f'abs(w-{a!r}) < {an.HALF_DEGREE!r}' for a in ANGLES)} AS listed, CASE WHEN abs(w-round(w/{math.pi / 3!r})*{math.pi / 3!r}) < {an.HALF_DEGREE!r} THEN 60 WHEN abs(w-round(w/{math.pi / 2!r})*{math.pi / 2!r}) < {an.HALF_DEGREE!r} THEN 90 END AS generator FROM w")
def listed_angles(spark, d):
    """Whether a value is an ideal angle, and which generator divides it."""
    w = F.col("y") * 1.5
    e = t.points_events(spark, d)
    gen = an.dividing_generator(w, [math.pi / 3, math.pi / 2])
    return e.select("pid", an.listed(w, ANGLES).alias("listed"), F.round(F.degrees(gen), 0).cast("int").alias("generator"))


@query("parsed_angles", "SELECT round(k*15e0, 6) AS degrees FROM range(0, 13) AS s(k) UNION ALL SELECT 180e0 + 60 UNION ALL SELECT 180e0 + 90")
def parsed_angles(spark, d):
    """The angles of a text of generators in degrees, and (behind 180) the generators deduced from 60, 90, 120 and 180."""
    rows = [round(a, 6) for a in an.parse("15, 45", inclusive_degrees=True)] + [180.0 + round(math.degrees(a), 6) for a in an.deduced_generators([math.radians(a) for a in (60, 90, 120, 180)])]
    return spark.createDataFrame([(x,) for x in rows], "degrees double")


@query("angle_union", "WITH u AS (SELECT s_suppkey, list_sort(list_distinct(list_concat([0e0, 1e0, s_nationkey*1e0], [1e0, 2e0]))) AS u FROM supplier) SELECT s_suppkey, CAST(len(u) AS INTEGER) AS n, list_sum(u) AS total, u[len(u)] AS largest FROM u")
def angle_union(spark, d):
    a = F.array(F.lit(0.0), F.lit(1.0), F.col("s_nationkey").cast("double"))
    u = an.union(a, F.array(F.lit(1.0), F.lit(2.0)))
    return t.read(spark, d, "supplier").select("s_suppkey", F.size(u).alias("n"), F.aggregate(u, F.lit(0.0), lambda s, x: s + x).alias("total"), F.element_at(u, -1).alias("largest"))


# --- filters, joins, aggregates, sets


@query("not_small", f"WITH {_PRIMS} SELECT gid FROM prims WHERE status <> 2")
def not_small(spark, d):
    return ag.not_small(primitives(spark, d)).select("gid")


@query("selected", f"WITH {_PRIMS} SELECT gid FROM prims WHERE status IN (1, 3) AND gid IN (SELECT gid FROM pts_li)")
def selected(spark, d):
    return fl.selected(primitives(spark, d), t.points_lineitem(spark, d)).select("gid")


@query("with_primitive", f"WITH {_PRIMS}, {v.PTS_EMB} SELECT pid FROM pts_emb WHERE gid IN (SELECT gid FROM prims WHERE gid % 2 = 1)")
def with_primitive(spark, d):
    return fl.with_primitive(t.points_embeddings(spark, d), primitives(spark, d).where("gid % 2 = 1")).select("pid")


@query("shown", f"WITH {_PRIMS} SELECT gid FROM prims WHERE did IN (1, 2, 3, 5, 8, 13) AND status IN (1, 2) AND n >= 600")
def shown(spark, d):
    """A viewer's choice of primitives."""
    return fl.shown(primitives(spark, d).drop("n"), t.points_lineitem(spark, d), dids=[1, 2, 3, 5, 8, 13], statuses=[1, 2], limit=600).select("gid")


@query("every_nth", f"WITH {v.PTS_EV} SELECT pid FROM pts_ev WHERE pid % 7 = 0")
def every_nth(spark, d):
    """Thinning, as the operator's feature."""
    return fl.every_nth(t.points_events(spark, d), 7).select("pid")


@query("ambiguous", "SELECT l_orderkey AS pid FROM lineitem GROUP BY l_orderkey HAVING count(*) > 2 AND max(l_discount) > 0.08e0")
def ambiguous(spark, d):
    near = t.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("pid"), F.col("l_linenumber").alias("tid"), F.col("l_discount").alias("angle_to_first"))
    return fl.ambiguous(near, 2, 0.08)


@query("projection_recall", f"WITH {v.PTS_EV} SELECT {r('avg(CASE WHEN abs(x-y) <= 0.25e0 THEN 1e0 ELSE 0e0 END)')} AS recall FROM pts_ev")
def projection_recall(spark, d):
    e = t.points_events(spark, d)
    return rounded(ev.recall(e.select(F.col("x").alias("tx"), F.lit(0.0).alias("ty"), F.lit(0.0).alias("tz"), F.col("y").alias("ex"), F.lit(0.0).alias("ey"), F.lit(0.0).alias("ez")), 0.25), "recall")


@query("rescaled", f"WITH {v.PTS_EV}, b AS (SELECT min(x) AS lx, min(y) AS ly, greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)) AS s FROM pts_ev) SELECT pid, {r('(x-lx)/s', 5)} AS x, {r('(y-ly)/s', 5)} AS y FROM pts_ev, b")
def rescaled(spark, d):
    return rounded(fl.rescaled(t.points_events(spark, d)).select("pid", "x", "y"), "x", "y", places=5)


@query("subsampled_all", f"WITH {v.PTS_EV} SELECT pid FROM pts_ev")
def subsampled_all(spark, d):
    """Subsampling with share one keeps all."""
    return fl.subsampled(t.points_events(spark, d), 1.0).select("pid")


@query("change_detection", "SELECT false AS same_changed, true AS other_changed")
def change_detection(spark, d):
    """Whether a set of primitives differs from itself in another order, and from itself without one."""
    p = primitives(spark, d)
    return spark.createDataFrame([(merge.changed(p, p.orderBy(F.desc("gid"))), merge.changed(p, p.where("gid <> 1")))], "same_changed boolean, other_changed boolean")


@query("all_candidates", f"WITH {_PRIMS} SELECT gid, did FROM prims UNION ALL SELECT gid, did + 100 FROM prims WHERE status = 1")
def all_candidates(spark, d):
    """Input primitives and candidates, as one set."""
    p = primitives(spark, d)
    made = p.where("status = 1").select("gid", (F.col("did") + 100).alias("did"), F.lit(0).alias("angle_id"), "px", "py", "pz", *NORMAL, F.lit(1).alias("lid"))
    return cd.with_own(p, made).select("gid", "did")


@query("nearest_match", f"WITH {v.PTS_EMB}, k AS (SELECT a.pid AS pid_a, b.pid AS pid_b, {v.distance2('a', 'b')} AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY {v.distance2('a', 'b')}, b.pid) AS k FROM pts_emb a JOIN pts_emb b ON a.pid % 2 = 0 AND b.pid % 2 = 1 WHERE {v.distance2('a', 'b')} < 0.0036e0) SELECT pid_a, pid_b, {r('d2', 8)} AS d2 FROM k WHERE k = 1")
def nearest_match(spark, d):
    p = t.points_embeddings(spark, d)
    return rounded(sp.nearest_match(p.where("pid % 2 = 0"), p.where("pid % 2 = 1"), 0.06), "d2", places=8)


@query("adopt_finite", f"WITH {_RECTS}, k AS (SELECT p.pid, c.gid, {frame_sql(('p.x', 'p.y', 'p.z'), 'c')} AS s FROM pts_emb p JOIN rc c ON c.gid % 10 = 3 WHERE p.pid % 10 <> 3), m AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY s, gid) AS k FROM k) SELECT pid, gid, {r('s', 5)} AS distance FROM m WHERE k = 1 AND s < 0.05e0")
def adopt_finite(spark, d):
    """Points given to the nearest of a tenth of the rectangles."""
    free = t.points_embeddings(spark, d).where("pid % 10 <> 3").withColumn("gid", F.lit(None).cast("long"))
    return rounded(jn.adopt_finite(free, rectangles(spark, d).where("gid % 10 = 3").select("gid", "corners"), 0.05), "distance", places=5)


@query("mergeable_planes", f"WITH {_RECTS}, pr AS (SELECT a.gid AS ga, b.gid AS gb, {', '.join(f'{grown_sql(corner_sql("a", k), "b", "0.15e0")} AS i{k}' for k in range(4))}, {', '.join(f'abs(({corner_sql("a", k)[0]}-b.ox)*b.wx+({corner_sql("a", k)[1]}-b.oy)*b.wy) AS h{k}' for k in range(4))} FROM rc a JOIN rc b ON a.gid <> b.gid), ok AS (SELECT ga, gb FROM pr WHERE (i0 OR i1 OR i2 OR i3) AND greatest(h0, h1, h2, h3) <= 0.15e0) SELECT DISTINCT least(ga, gb) AS gid_a, greatest(ga, gb) AS gid_b FROM ok")
def mergeable_planes(spark, d):
    """Pairs of rectangles that may become one."""
    return jn.mergeable_planes(rectangles(spark, d).select("gid", "corners"), 0.15)


@query("support_precision", f"WITH {v.PLANES_EMB} SELECT q.gid, {r('max(CASE WHEN q.gid % 2 = 0 THEN abs(q.x*p.nx+q.y*p.ny+q.z*p.nz-(p.px*p.nx+p.py*p.ny+p.pz*p.nz)) ELSE abs(sqrt(pow(q.x-p.px,2)+pow(q.y-p.py,2)+pow(q.z-p.pz,2))-0.5e0) END)', 5)} AS precision FROM pts_emb q JOIN planes p ON p.gid = q.gid GROUP BY q.gid")
def support_precision(spark, d):
    """Planes of even patches, spheres of half a unit of odd ones."""
    planes = planes_emb(spark, d)
    plane = F.array("nx", "ny", "nz", -(F.col("px") * F.col("nx") + F.col("py") * F.col("ny") + F.col("pz") * F.col("nz")))
    even = F.col("gid") % 2 == 0
    shapes = planes.select("gid", F.when(even, "plane").otherwise("sphere").alias("kind"), F.when(even, plane).otherwise(F.array("px", "py", "pz", F.lit(0.5))).alias("v"))
    return rounded(ag.support_precision(t.points_embeddings(spark, d), shapes), "precision", places=5)


@query("pair_angle_histogram", f"WITH {_PRIMS}, w AS (SELECT {v.angle('a', 'b')} AS w FROM prims a JOIN prims b ON a.gid < b.gid) SELECT (round(degrees(w)/5e0)*5e0) % 180e0 AS degrees, count(*) AS n FROM w GROUP BY 1")
def pair_angle_histogram(spark, d):
    return ag.pair_angle_histogram(jn.pair_angles(primitives(spark, d), ANGLES), 5.0)


@query("densities", f"WITH {v.PTS_EV} SELECT pid, {r('exp(-pow((y-0.2e0)/0.1e0, 2)/2)/(0.1e0*sqrt(2*3.141592653589793e0))', 5)} AS normal, {r('CASE WHEN y BETWEEN 0.1e0 AND 0.3e0 THEN 1e0/(0.3e0-0.1e0) ELSE 0e0 END')} AS uniform FROM pts_ev")
def densities(spark, d):
    e = t.points_events(spark, d)
    return rounded(rounded(e.select("pid", ag.normal_density(F.col("y"), 0.2, 0.1).alias("normal"), ag.uniform_density(F.col("y"), 0.1, 0.3).alias("uniform")), "uniform"), "normal", places=5)


@query("implications", f"WITH {_PRIMS} SELECT row_number() OVER (ORDER BY gid, did) - 1 AS var, did FROM prims")
def implications(spark, d):
    """Each candidate's variable and the direction it needs."""
    return problem.implications(problem.variables(primitives(spark, d))).select(F.col("var").cast("long").alias("var"), "did")


@query("exactly_one", f"WITH {_PRIMS} SELECT did AS gid, count(*) AS vars, 1 AS takes FROM prims GROUP BY did")
def exactly_one(spark, d):
    """Directions as patches, their primitives as candidates, of which one is taken."""
    own = primitives(spark, d).select(F.col("did").alias("gid"), F.col("gid").alias("did"))
    return problem.exactly_one(problem.variables(own)).select("gid", F.size("vars").cast("long").alias("vars"), "takes")


@query("cluster_sizes", "SELECT CAST(s_nationkey + 1000000 AS BIGINT) AS nation, count(*) + 1 AS size FROM supplier GROUP BY s_nationkey HAVING count(*) + 1 >= 4")
def cluster_sizes(spark, d):
    """Components of suppliers and nations of at least four nodes."""
    from quoin.operators import graph

    edges = t.read(spark, d, "supplier").select(F.col("s_suppkey").alias("src"), (F.col("s_nationkey") + 1000000).alias("dst"))
    return graph.clusters(edges, 4).where("node >= 1000000").select(F.col("node").alias("nation"), "size")


@query("angle_relations", f"WITH {_PRIMS}, p AS (SELECT a.gid AS gid_a, b.gid AS gid_b, {v.angle('a', 'b')} AS w FROM prims a JOIN prims b ON a.gid < b.gid) SELECT gid_a, gid_b FROM p WHERE {v.nearest_diff('w', RIGHT)} < 0.05e0")
def angle_relations(spark, d):
    """What a viewer draws as perfect relations."""
    return rp.perfect_relations(primitives(spark, d), RIGHT, 0.05).select("gid_a", "gid_b")


@query("swept_samples", "SELECT s_suppkey AS gid, round(s_suppkey + 0.6e0*k*0.5e0, 6) AS x, round(0.8e0*k*0.5e0, 6) AS y FROM supplier, range(0, 15) AS s(k) WHERE k <= floor((s_suppkey % 7)/0.5e0)")
def swept_samples(spark, d):
    """Grid samples of line primitives at half a unit."""
    own = t.read(spark, d, "supplier").select(F.col("s_suppkey").alias("gid"), F.col("s_suppkey").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(0.6).alias("dx"), F.lit(0.8).alias("dy"), F.lit(0.0).alias("dz"), (F.col("s_suppkey") % 7).cast("double").alias("width"))
    return scene.sampled(own, 0.5).select("gid", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("extruded", f"WITH {v.PTS_EMB} SELECT {r('x')} AS x, {r('y')} AS y, {r('k*0.25e0')} AS z FROM pts_emb, range(0, 5) AS s(k)")
def extruded(spark, d):
    """A flat cloud repeated at five heights."""
    return rounded(scene.extruded(t.points_embeddings(spark, d).withColumn("z", F.lit(0.0)), 1.0, 5).select("x", "y", "z"), "x", "y", "z")


@query("biased_points", f"WITH {v.PTS_EMB} SELECT pid, {r('x+0.02e0*nx')} AS x, {r('y+0.02e0*ny')} AS y, {r('z+0.02e0*nz')} AS z FROM pts_emb")
def biased_points(spark, d):
    """Points moved along their normals by two layers of one hundredth."""
    p = t.points_embeddings(spark, d)
    return rounded(scene.displaced(p, [scene.displacement(p, "bias", 0.01)] * 2).select("pid", *PLACE), *PLACE)


@query("turned_groups", f"WITH {v.LINES_EMB} SELECT gid, {r('CASE WHEN gid = 3 THEN -ny WHEN gid = 4 THEN -nx ELSE nx END', 5)} AS nx, {r('CASE WHEN gid = 3 THEN nx WHEN gid = 4 THEN -ny ELSE ny END', 5)} AS ny FROM lines")
def turned_groups(spark, d):
    """Lines of two groups turned by a quarter and a half."""
    return rounded(scene.rotated_groups(ag.line_fit(t.points_embeddings(spark, d)), {3: math.pi / 2, 4: math.pi}).select("gid", "nx", "ny"), "nx", "ny", places=5)


@query("coaxial", f"WITH {_PRIMS} SELECT a.gid AS gid_a, b.gid AS gid_b FROM prims a JOIN prims b ON a.gid < b.gid WHERE acos(least(1e0, abs(a.nx*b.nx+a.ny*b.ny+a.nz*b.nz))) < 0.3e0 AND sqrt(pow((b.py-a.py)*a.nz-(b.pz-a.pz)*a.ny,2)+pow((b.pz-a.pz)*a.nx-(b.px-a.px)*a.nz,2)+pow((b.px-a.px)*a.ny-(b.py-a.py)*a.nx,2)) < 0.02e0")
def coaxial(spark, d):
    """Primitives taken as axes: parallel and close to one line."""
    return rl.coaxial(primitives(spark, d), 0.3, 0.02).select("gid_a", "gid_b")


@query("correspondence_rows", "SELECT CAST(count(*) AS BIGINT) AS n FROM supplier")
def correspondence_rows(spark, d):
    """Greedy one-to-one matches of suppliers with themselves: each is its own."""
    p = ag.plane_fit(t.points_lineitem(spark, d)).withColumn("status", F.lit(schema.ACTIVE))
    return jn.correspondences(p, p).where("gid_a = gid_b").agg(F.count("*").alias("n"))


@query("correspondence_greedy", "SELECT s_suppkey*10 + 3 AS gid_a, s_suppkey*10 AS gid_b, 3e0 AS cost FROM supplier")
def correspondence_greedy(spark, d):
    """Two shifted copies of the suppliers matched by the difference of their numbers."""
    s = t.read(spark, d, "supplier").select((F.col("s_suppkey") * 10).alias("gid"))
    return jn.matched(s.select(F.col("gid") + 3).toDF("gid"), s, lambda a, b, some: abs(a["gid"].to_numpy(dtype=float)[some, None] - b["gid"].to_numpy(dtype=float)))


@query("subsampled_primitives", f"WITH {v.ASSOC}, n AS (SELECT gid, count(*) AS n FROM assoc_ord GROUP BY gid ORDER BY n DESC, gid LIMIT 25), k AS (SELECT a.*, n.n, row_number() OVER (PARTITION BY a.gid ORDER BY a.pid) AS k FROM assoc_ord a JOIN n ON n.gid = a.gid) SELECT pid, CASE WHEN k <= greatest(3, floor(n*0.5e0)) THEN gid END AS gid FROM k")
def subsampled_primitives(spark, d):
    """The points of the 25 largest patches, half of each assigned."""
    prims = t.read(spark, d, "customer").select(F.col("c_custkey").alias("gid"))
    return fl.subsampled_primitives(t.assignments_orders(spark, d), prims, 25, 0, 0.5, 3)[0].select("pid", "gid")


@query("not_compared", "SELECT s_suppkey AS gid_a, s_suppkey + 1 AS gid_b FROM supplier WHERE s_suppkey % 2 = 1 OR s_suppkey % 10 = 0 OR s_suppkey % 5 = 4")
def not_compared(spark, d):
    """Neighbouring suppliers not compared yet: even ones were, but those beside a fifth have changed since."""
    s = t.read(spark, d, "supplier")
    pairs = s.select(F.col("s_suppkey").alias("gid_a"), (F.col("s_suppkey") + 1).alias("gid_b"))
    done = pairs.where("gid_a % 2 = 0").select(F.col("gid_b").alias("gid_a"), F.col("gid_a").alias("gid_b"))
    moved = s.select(F.col("s_suppkey").alias("gid")).unionByName(s.select((F.col("s_suppkey") + 1).alias("gid"))).where("gid % 5 = 0")
    return merge.not_compared(pairs, merge.still_compared(done, moved))


@query("aligned_extents")
def aligned_extents(spark, d):
    """Rectangles along the planes' own axes; tests hold that all inliers lie in them."""
    from quoin.operators import fit

    out = fit.plane_extents(t.points_embeddings(spark, d), planes_emb(spark, d), 0.2, aligned=True)
    return out.select("gid", F.posexplode("corners").alias("corner", "c")).select("gid", "corner", "c.x", "c.y", "c.z")


@query("region_grow_tiled")
def region_grow_tiled(spark, d):
    """Growth in tiles of half a unit, joined at the seams: the whole cloud, in many tasks."""
    from quoin.operators import segment

    return segment.region_grow_tiled(t.points_embeddings(spark, d), 0.1, 0.6, 0.5).select("pid", "gid")


@query("plane_gaps", f"WITH {_PRIMS} SELECT a.gid AS gid_a, b.gid AS gid_b, {r('abs((b.px-a.px)*a.nx+(b.py-a.py)*a.ny+(b.pz-a.pz)*a.nz)', 5)} AS value FROM prims a JOIN prims b ON a.gid < b.gid WHERE acos(least(1e0, abs(a.nx*b.nx+a.ny*b.ny+a.nz*b.nz))) < 0.4e0")
def plane_gaps(spark, d):
    return rounded(rl.plane_gaps(primitives(spark, d), 0.4), "value", places=5)


@query("bound_pairs", f"WITH {_PRIMS} SELECT a.gid AS gid_a, b.gid AS gid_b, 'parallel' AS kind FROM prims a JOIN prims b ON a.gid < b.gid WHERE abs(a.nx*b.nx+a.ny*b.ny+a.nz*b.nz) >= 0.97e0")
def bound_pairs(spark, d):
    return rl.bound_pairs(primitives(spark, d), 0.97).where("kind = 'parallel'")


@query("parallel_roots", f"WITH RECURSIVE {_PRIMS}, e AS (SELECT a.gid AS a, b.gid AS b FROM prims a JOIN prims b ON a.gid <> b.gid WHERE acos(least(1e0, abs(a.nx*b.nx+a.ny*b.ny+a.nz*b.nz))) < 0.1e0), r(node, low) AS (SELECT a, a FROM e UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.node), c AS (SELECT node, min(low) AS low FROM r GROUP BY node) SELECT low AS src, node AS dst FROM c WHERE node <> low")
def parallel_roots(spark, d):
    """Groups of parallels as stars around their smallest member."""
    return rl.parallel_stars(primitives(spark, d), 0.1)


@query("best_per_group", f"WITH {_PRIMS}, p AS (SELECT a.gid AS gid_a, b.gid AS gid_b, -abs((b.px-a.px)*a.nx+(b.py-a.py)*a.ny+(b.pz-a.pz)*a.nz) AS score FROM prims a JOIN prims b ON a.gid < b.gid WHERE acos(least(1e0, abs(a.nx*b.nx+a.ny*b.ny+a.nz*b.nz))) < 0.3e0), k AS (SELECT *, row_number() OVER (PARTITION BY gid_a ORDER BY score DESC, gid_b) AS k FROM p WHERE score > -0.2e0) SELECT gid_a, gid_b FROM k WHERE k = 1")
def best_per_group(spark, d):
    """Each plane's best coplanar partner of a larger number."""
    return rl.best_coplanar(primitives(spark, d), 0.3, 0.2).select("gid_a", "gid_b")


@query("substituted", f"WITH {_PRIMS}, d AS (SELECT did, min(gid) AS gid FROM prims GROUP BY did), w AS (SELECT d.did, p.nx AS rx, p.ny AS ry, p.nz AS rz FROM d JOIN prims p ON p.gid = d.gid), q AS (SELECT p.gid, p.nx, p.ny, p.nz, rx, ry, rz, {v.angle('p', 'o')} AS ang FROM prims p JOIN (SELECT did AS odid, rx, ry, rz, rx AS nx, ry AS ny, rz AS nz FROM w) o ON o.odid = p.did) SELECT gid, {r('abs(nx*rx+ny*ry+nz*rz)', 4)} AS before FROM q")
def substituted(spark, d):
    """How parallel each primitive was to the direction that replaces its own: that of the smallest patch of its direction."""
    p = primitives(spark, d)
    ways = p.groupBy("did").agg(F.min_by(F.struct("nx", "ny", "nz"), "gid").alias("w")).select("did", F.col("w.nx").alias("rx"), F.col("w.ny").alias("ry"), F.col("w.nz").alias("rz"))
    turned = jn.substituted(p, ways, RIGHT).select("gid", *[F.col(c).alias("t" + c) for c in NORMAL])
    both = p.join(turned, "gid").join(ways, "did")
    own, way, new = g.Vec.of(*NORMAL), g.Vec.of("rx", "ry", "rz"), g.Vec.of("tnx", "tny", "tnz")
    # turned normals are at an ideal angle to the direction, else the row is null and differs
    ideal = (F.abs(F.abs(new.dot(way)) - 1) < 1e-6) | (F.abs(new.dot(way)) < 1e-6)
    return both.select("gid", F.when(ideal, F.round(F.abs(own.dot(way)), 4) + 0.0).alias("before"))
