"""Readers and writers of the arrangement's file formats."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin.functions import geometry as g
from quoin.operators import windows
from quoin.sources import schema


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(at, value): a text's lines by place, of files in the order of their names.

    A line's place is its place in its split and the number of lines in the splits before, so a file
    is read by many tasks; only the counts of splits meet in one.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    splits = lines.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_lines"))
    before = splits.withColumn("_before", F.sum("_lines").over(Window.orderBy("_file", "_block")) - F.col("_lines")).drop("_lines")
    # a row per split
    return lines.join(F.broadcast(before), ["_file", "_block"]).select((F.col("_before") + F.col("_id") - F.col("_first")).alias("at"), "value")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """ASCII PLY or PCD: x y z and, if given, nx ny nz; pid and gid are the row number. Missing normals are (-1, -1, -1) at unit length."""
    lines = _numbered(spark, path)
    head = lines.where(F.col("value").rlike("^(end_header|DATA ascii)\\s*$")).agg(F.min("at").alias("end"))
    rows = lines.crossJoin(F.broadcast(head)).where("at > end and trim(value) <> ''").select((F.col("at") - F.col("end") - 1).cast("long").alias("pid"), F.split(F.trim("value"), "\\s+").alias("f"))
    value = lambda i: F.try_element_at("f", F.lit(i + 1)).cast("double")
    n = g.Vec(*[F.coalesce(value(i), F.lit(-1.0)) for i in (3, 4, 5)]).unit()
    return rows.select("pid", *[value(i).alias(c) for i, c in enumerate("xyz")], *[c.alias(k) for k, c in zip(("nx", "ny", "nz"), n, strict=True)], F.col("pid").alias("gid"))


_KINDS = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def read_binary_points(spark: SparkSession, path: str) -> DataFrame:
    """Binary PLY (either byte order) or PCD of one file: the columns of read_points(). A file is one row; its vertices are the first element."""
    kind = "pid long, x double, y double, z double, nx double, ny double, nz double, gid long"

    def layout(body: bytes) -> tuple[list[tuple[str, str]], int, int]:
        """(fields, rows, where the rows begin)."""
        pcd = not body.startswith(b"ply")
        mark = b"DATA binary\n" if pcd else b"end_header\n"
        at = body.index(mark) + len(mark)
        words = [line.split() for line in body[:at].decode("ascii").splitlines()]
        if pcd:
            head = {w[0]: w[1:] for w in words if w}
            sizes = [{"F": "f", "U": "u", "I": "i"}[t] + n for t, n in zip(head["TYPE"], head["SIZE"], strict=True)]
            return [(n, "<" + t) for n, t in zip(head["FIELDS"], sizes, strict=True)], int(head["POINTS"][0]), at
        order, fields, rows = "<", [], 0
        for w in words:
            if w[0] == "format":
                order = ">" if w[1] == "binary_big_endian" else "<"
            elif w[0] == "element":
                if fields:
                    break
                rows = int(w[2])
            elif w[0] == "property":
                fields.append((w[2], order + _KINDS[w[1]]))
        return fields, rows, at

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            for body in batch.content:
                fields, rows, at = layout(body)
                own = np.frombuffer(body, np.dtype(fields), rows, at)
                names = {"normal_x": "nx", "normal_y": "ny", "normal_z": "nz"}
                given = {names.get(n, n): own[n].astype(np.float64) for n, _ in fields}
                n = np.column_stack([given.get(k, np.full(rows, -1.0)) for k in ("nx", "ny", "nz")])
                length = np.sqrt((n * n).sum(axis=1))
                n = n / np.where(length > 0, length, 1.0)[:, None]
                yield pd.DataFrame({"pid": np.arange(rows), **{k: given[k] for k in "xyz"}, "nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2], "gid": np.arange(rows)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, kind)


def read_primitives(spark: SparkSession, path: str, lines_as_normals: bool = False) -> DataFrame:
    """x,y,z,nx,ny,nz,gid,did,status,gen_angle per line, the last four optional; '#' lines and blank ones are skipped; lid is the place in the patch.

    A gid of -1 raises. lines_as_normals turns the stored normal of a line into its direction.
    """
    f = F.split("value", ",")
    rows = _numbered(spark, path).where("trim(value) <> '' and not value like '#%'")
    field = lambda i, kind: F.try_element_at(f, F.lit(i + 1)).cast(kind)
    out = rows.select("at", *[field(i, "double").alias(c) for i, c in enumerate(("px", "py", "pz", "nx", "ny", "nz"))], field(6, "long").alias("gid"), field(7, "long").alias("did"), F.coalesce(field(8, "byte"), F.lit(schema.UNSET).cast("byte")).alias("status"), field(9, "double").alias("gen_angle"))
    out = out.withColumn("gid", F.when(F.coalesce("gid", F.lit(-1)) == -1, F.raise_error(F.lit("a primitive without a patch"))).otherwise(F.col("gid")))
    if lines_as_normals:
        d = g.line_normal(g.Vec.of("nx", "ny", "nz"))
        out = out.withColumns(dict(zip(("nx", "ny", "nz"), d, strict=True)))
    return out.withColumn("lid", F.row_number().over(Window.partitionBy("gid").orderBy("at")) - 1).drop("at")


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    """(pid, gid) of lines pid,gid,lid; '#' lines and lines without three whole numbers are skipped; -1 becomes null."""
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\s*-?[0-9]+\s*,\s*-?[0-9]+\s*,\s*-?[0-9]+\s*$"))
    f = F.split("value", ",")
    return rows.select(F.trim(f[0]).cast("long").alias("pid"), F.nullif(F.trim(f[1]).cast("long"), F.lit(-1).cast("long")).alias("gid"))


def dense_index(assigned: DataFrame) -> DataFrame:
    """assigned with the dense rank (from 0) of its distinct (gid, lid)."""
    keys = [c for c in ("gid", "lid") if c in assigned.columns]
    ranked = windows.numbered(assigned.select(*keys).distinct(), *keys, name="index")
    same = [F.col("a." + k).eqNullSafe(F.col("b." + k)) for k in keys]
    return assigned.alias("a").join(ranked.alias("b"), same, "left").select("a.*", "b.index")


def with_assignments(points: DataFrame, assigned: DataFrame) -> DataFrame:
    """points with the gid of their assignment; null where none."""
    return points.drop("gid").join(assigned.select("pid", "gid"), "pid", "left")


def read_scene(spark: SparkSession, cloud: str, primitives: str, assignments: str) -> tuple[DataFrame, DataFrame]:
    """(points with gid, primitives) of three files."""
    return with_assignments(read_points(spark, cloud), read_assignments(spark, assignments)), read_primitives(spark, primitives)


def read_triangles(spark: SparkSession, path: str, least_side: float = 0.0) -> DataFrame:
    """OBJ faces of exactly three corners whose sides are all at least least_side."""
    lines = _numbered(spark, path).withColumn("f", F.split(F.trim("value"), "\\s+"))
    vertices = windows.numbered(lines.where("f[0] = 'v'"), "at", name="v").select((F.col("v") + 1).alias("v"), *[F.col("f")[i].cast("double").alias(c) for i, c in ((1, "x"), (2, "y"), (3, "z"))])
    faces = windows.numbered(lines.where("f[0] = 'f' and size(f) = 4"), "at", name="tid").select("tid", *[F.split(F.col("f")[i], "/")[0].cast("int").alias(c) for i, c in ((1, "a"), (2, "b"), (3, "c"))])
    for c in "abc":
        own = vertices.select(F.col("v").alias(c), *[F.col(k).alias(c + k) for k in "xyz"])
        faces = faces.join(own, c)
    sides = g.triangle_sides(*[g.Vec.of(c + "x", c + "y", c + "z") for c in "abc"])
    return faces.where(F.least(*sides) >= least_side).select("tid", *[c + k for c in "abc" for k in "xyz"])


def cloud_from_depth(depth: DataFrame, fx: float, fy: float, cx: float, cy: float, least: float = 0.2, pose: list[list[float]] | None = None) -> DataFrame:
    """pid, x, y, z of pixels (u, v, depth) deeper than least under a pinhole camera, moved by pose if given."""
    p = g.unprojected(F.col("u"), F.col("v"), F.col("depth"), fx, fy, cx, cy)
    p = g.transformed(p, pose) if pose else p
    return depth.where(F.col("depth") > least).select(F.xxhash64("u", "v").alias("pid"), *[c.alias(k) for k, c in zip("xyz", p, strict=True)])


def cloud_from_image(pixels: DataFrame, count: int, threshold: int = 200) -> DataFrame:
    """A 2D cloud of about count pixels darker than threshold, chosen by a hash of their place."""
    dark = pixels.where(F.col("value") < threshold)
    total = dark.agg(F.count("*").alias("dark_pixels"))
    keep = F.pmod(F.xxhash64("u", "v"), F.lit(1_000_000)) < F.lit(1_000_000.0 * count) / F.col("dark_pixels")
    return dark.crossJoin(F.broadcast(total)).where(keep).select(F.xxhash64("u", "v").alias("pid"), F.col("u").cast("double").alias("x"), F.col("v").cast("double").alias("y"), F.lit(0.0).alias("z"))


def read_project(spark: SparkSession, path: str) -> DataFrame:
    """Primitives of a generator's XML project: x, y, z, dx, dy, dz, width, height, gid, did."""
    kind = "x double, y double, z double, dx double, dy double, dz double, width double, height double, gid long, did long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for body in batch.value:
                rows = []
                for p in ET.fromstring(body).iter("primitive"):
                    three = lambda k: [float(v) for v in p.get(k, "0 0 0").replace(",", " ").split()][:3]  # noqa: B023, E731
                    at, way, dim = three("pos"), three("dir"), [*[float(v) for v in p.get("dim", "0 0").replace(",", " ").split()], 0.0, 0.0][:2]
                    rows.append([*at, *way, *dim, int(p.get("uid", -1)), int(p.get("did", -1))])
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in kind.split(", ")])

    return spark.read.text(path, wholetext=True).mapInPandas(run, kind)


def read_svg_paths(spark: SparkSession, path: str) -> DataFrame:
    """Line primitives (x0, y0, x1, y1) of an SVG's path elements (M, L, l, H, V, Z), with translations of the groups around them."""
    kind = "x0 double, y0 double, x1 double, y1 double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        def walk(node, dx: float, dy: float, out: list) -> None:
            m = re.search(r"translate\(\s*([-\d.eE]+)(?:[ ,]+([-\d.eE]+))?", node.get("transform", ""))
            if m:
                dx, dy = dx + float(m[1]), dy + float(m[2] or 0)
            if node.tag.endswith("path"):
                at = start = (0.0, 0.0)
                for cmd, body in re.findall(r"([MmLlHhVvZz])([^MmLlHhVvZz]*)", node.get("d", "")):
                    v = [float(x) for x in re.findall(r"-?\d*\.?\d+(?:[eE][-+]?\d+)?", body)]
                    steps = [(v[i], v[i + 1]) for i in range(0, len(v) - 1, 2)] if cmd in "MmLl" else [(x, 0.0) for x in v] if cmd in "Hh" else [(0.0, x) for x in v]
                    for k, (x, y) in enumerate(steps):
                        new = {"H": (x, at[1]), "V": (at[0], y)}.get(cmd) or ((at[0] + x, at[1] + y) if cmd.islower() else (x, y))
                        if cmd in "Mm" and k == 0:
                            start = new
                        else:
                            out.append((at[0] + dx, at[1] + dy, new[0] + dx, new[1] + dy))
                        at = new
                    if cmd in "Zz":
                        out.append((at[0] + dx, at[1] + dy, start[0] + dx, start[1] + dy))
                        at = start
            for kid in node:
                walk(kid, dx, dy, out)

        for batch in batches:
            for body in batch.value:
                rows: list = []
                walk(ET.fromstring(body), 0.0, 0.0, rows)
                yield pd.DataFrame(rows, columns=["x0", "y0", "x1", "y1"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, kind)


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(face, corner, x, y, z) of an ASCII PLY mesh of polygons."""
    kind = "face long, corner int, x double, y double, z double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for body in batch.value:
                head, _, rest = body.partition("end_header\n")
                count = {line.split()[1]: int(line.split()[2]) for line in head.splitlines() if line.startswith("element")}
                lines = rest.splitlines()
                at = [[float(v) for v in line.split()[:3]] for line in lines[: count.get("vertex", 0)]]
                faces = [[int(v) for v in line.split()][1:] for line in lines[count.get("vertex", 0) :][: count.get("face", 0)]]
                yield pd.DataFrame([(i, k, *at[v]) for i, f in enumerate(faces) for k, v in enumerate(f)], columns=["face", "corner", "x", "y", "z"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, kind)


def read_point_planes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(points, planes) of a text of counted points, then planes: x y z nx ny nz confidence; nx ny nz d and the points of each plane."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for body in batch.value:
                lines = [x.strip() for x in body.splitlines() if x.strip() and not x.startswith("#")]
                n = int(lines[0].split()[0])
                rows = [("point", i, [float(v) for v in line.split()], []) for i, line in enumerate(lines[1 : n + 1])]
                k = -1
                for line in lines[n + 2 :]:
                    f = line.split()
                    if f[0] == "plane":
                        k += 1
                        rows.append(("plane", k, [float(v) for v in f[1:5]], []))
                    elif f[0] == "points":
                        rows[-1] = (*rows[-1][:3], [int(v) for v in f[1:]])
                yield pd.DataFrame(rows, columns=["kind", "i", "v", "members"])

    both = spark.read.text(path, wholetext=True).mapInPandas(run, "kind string, i long, v array<double>, members array<long>")
    points = both.where("kind = 'point'").select(F.col("i").alias("pid"), *[F.col("v")[k].alias(c) for k, c in enumerate(("x", "y", "z", "nx", "ny", "nz", "confidence"))])
    planes = both.where("kind = 'plane'").select(F.col("i").alias("gid"), *[F.col("v")[k].alias(c) for k, c in enumerate(("nx", "ny", "nz", "d"))], "members")
    return points, planes


def read_correspondence(spark: SparkSession, path: str) -> DataFrame:
    """gid, lid and did of matched primitives a and b."""
    return spark.read.csv(path, schema=schema.CORRESPONDENCE, comment="#")


def _texts(df: DataFrame, path: str, backup: bool) -> None:
    df.coalesce(1).write.mode("errorifexists" if not backup else "overwrite").text(path)


def write_primitives(primitives: DataFrame, path: str) -> None:
    """The ten fields of a primitive, coordinates with nine decimals, in one ordered file."""
    number = lambda c: F.format_string("%.9f", F.col(c))
    line = F.concat_ws(",", *[number(c) for c in ("px", "py", "pz", "nx", "ny", "nz")], F.col("gid").cast("string"), F.col("did").cast("string"), F.col("status").cast("string"), F.when(F.col("gen_angle").isNull(), F.lit("-1")).otherwise(number("gen_angle")))
    _texts(primitives.orderBy("gid", "lid" if "lid" in primitives.columns else "did").select(line.alias("value")), path, False)


def write_assignments(assigned: DataFrame, path: str) -> None:
    """pid,gid,-1 per point; an unassigned point has gid -1."""
    _texts(assigned.orderBy("pid").select(F.concat_ws(",", F.col("pid").cast("string"), F.coalesce("gid", F.lit(-1)).cast("string"), F.lit("-1")).alias("value")), path, False)


def write_points(points: DataFrame, path: str) -> None:
    """ASCII PLY by pid, with its header."""
    count = points.count()
    head = ["ply", "format ascii 1.0", f"element vertex {count}", *[f"property float {c}" for c in ("x", "y", "z", "nx", "ny", "nz")], "end_header"]
    spark = points.sparkSession
    top = spark.createDataFrame([(-1, i, h) for i, h in enumerate(head)], "at long, sub int, value string")
    body = points.select(F.col("pid").alias("at"), F.lit(0).alias("sub"), F.concat_ws(" ", *[F.col(c).cast("string") for c in ("x", "y", "z", "nx", "ny", "nz")]).alias("value"))
    _texts(top.unionByName(body).orderBy("at", "sub").select("value"), path, False)


def versioned(spark: SparkSession, path: str) -> str:
    """path if it is free, else the first free path.N.bak: what to move an existing result to before writing."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = lambda p: jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p))
    if not there(path):
        return path
    n = 0
    while there(f"{path}.{n}.bak"):
        n += 1
    return f"{path}.{n}.bak"


def iteration(name):
    """The iteration number in a file name column such as primitives_it3.bonmin.csv; -1 if none."""
    found = F.regexp_extract(name, r"_it(\d+)\.", 1)
    return F.when(found == "", F.lit(-1)).otherwise(found.cast("int"))


def graph_lines(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Lines of a Graphviz drawing's edges."""
    return edges.select(F.format_string('  "%s" -- "%s";', F.col(src).cast("string"), F.col(dst).cast("string")).alias("value"))


def point_plane_lines(planes: DataFrame, points: DataFrame) -> DataFrame:
    """(gid, plane, members): the two text lines of each plane."""
    members = points.where("gid is not null").groupBy("gid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("pid")), lambda x: x.cast("string")), " ").alias("list"))
    _, _, _, d = g.four_coefficients(g.Vec.of("px", "py", "pz"), g.Vec.of("nx", "ny", "nz"))
    return planes.join(members, "gid").select("gid", F.concat_ws(" ", F.lit("plane"), *[F.col(c).cast("string") for c in ("nx", "ny", "nz")], d.cast("string")).alias("plane"), F.concat(F.lit("points "), "list").alias("members"))


def line_extent_rows(extents: DataFrame) -> DataFrame:
    """x0,y0,x1,y1 of line extents for a viewer."""
    end = lambda i, k: F.col("corners")[i][k].alias(f"{k}{i}")
    return extents.where(F.size("corners") == 2).select("gid", end(0, "x"), end(0, "y"), end(1, "x"), end(1, "y"))


def hough_rows(lines: DataFrame) -> DataFrame:
    """(gid, r, angle) of line primitives."""
    r, a = g.hough(g.Vec.of("px", "py", "pz"), g.Vec.of("nx", "ny", "nz"))
    return lines.select("gid", r.alias("r"), a.alias("angle"))


def generator_rows(primitives: DataFrame) -> DataFrame:
    """Ground-truth lines of a generator's primitives: mid-point and direction with y turned over, and the used flag."""
    return primitives.select((F.col("x") + F.col("dx") * F.col("width") / 2).alias("x"), (-(F.col("y") + F.col("dy") * F.col("width") / 2)).alias("y"), "z", F.col("dx").alias("nx"), (-F.col("dy")).alias("ny"), F.col("dz").alias("nz"), "gid", "did", F.lit(1).alias("used"))


def read_depth(spark: SparkSession, path: str, width: int, unit: float = 0.001) -> DataFrame:
    """(u, v, depth) of raw 16-bit little-endian depth images of a width, in metres by unit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            for body in batch.content:
                d = np.frombuffer(body, "<u2")
                i = np.arange(len(d))
                yield pd.DataFrame({"u": i % width, "v": i // width, "depth": d * unit})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "u long, v long, depth double")


def hull_rows(hulls: DataFrame) -> DataFrame:
    """(gid, corner, x, y, z) of hull polygons (gid, corners), for a mesh."""
    return hulls.select("gid", F.posexplode("corners").alias("corner", "c")).select("gid", "corner", "c.x", "c.y", "c.z")
