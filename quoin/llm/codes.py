"""Vector code compression: product codebooks refined by nearest entries found in broadcast kd-trees."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.lineage import cut

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
LEAF = 32
#: Components of at least this are left out: their squared distances, summed over 1,024 components, would not fit a long.
LARGEST = 32768.0
AHEAD = 4096


@dataclass
class Node:
    """A box around entries (indexes into the codebook, ascending): a leaf, or split in two."""

    low: np.ndarray
    high: np.ndarray
    own: np.ndarray | None
    left: Node | None = None
    right: Node | None = None


@dataclass
class Tree:
    entries: np.ndarray
    root: Node


def kd_tree(entries: np.ndarray, leaf: int = LEAF) -> Tree:
    """entries halved at the median of their widest component; entries equal in all of them stay in one leaf."""

    def build(own: np.ndarray) -> Node:
        points = entries[own]
        low, high = points.min(axis=0), points.max(axis=0)
        axis = int((high - low).argmax())
        if len(own) <= leaf or low[axis] == high[axis]:
            return Node(low, high, own)
        order = own[np.argsort(points[:, axis], kind="stable")]
        half = len(order) // 2
        return Node(low, high, None, build(np.sort(order[:half])), build(np.sort(order[half:])))

    return Tree(entries, build(np.arange(len(entries))))


def nearest(points: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each point's nearest entry, of equally near ones the lowest index.

    Branch and bound for many points at once: each visits its nearer half first, and the other one only
    if the half's box is no farther than its best so far. A box as far as the best is visited too, as
    it may hold an entry as near with a lower index.
    """
    best = np.full(len(points), np.iinfo(np.int64).max)
    index = np.full(len(points), len(tree.entries), np.int64)

    # products of doubles are exact as long as all sums stay below 2^53
    exact = max((int(np.abs(a).max(initial=0)) for a in (points, tree.entries)), default=0) ** 2 * 4 * max(1, points.shape[1]) < 2**53
    fine, entries = points.astype(np.float64), tree.entries.astype(np.float64)
    squares, lengths = (fine * fine).sum(axis=1), (entries * entries).sum(axis=1)

    def apart(rows: np.ndarray, own: np.ndarray) -> np.ndarray:
        if exact:
            return (squares[rows, None] + lengths[own] - 2.0 * (fine[rows] @ entries[own].T)).astype(np.int64)
        out = points[rows][:, None] - tree.entries[own]
        return (out * out).sum(axis=2)

    def bound(node: Node, rows: np.ndarray) -> np.ndarray:
        p = points[rows]
        out = np.maximum(np.maximum(node.low - p, p - node.high), 0)
        return (out * out).sum(axis=1)

    def visit(node: Node, rows: np.ndarray) -> None:
        if node.own is not None:
            d = apart(rows, node.own)
            least = d.argmin(axis=1)  # the first of equal ones, and own is ascending
            d, found = d[np.arange(len(rows)), least], node.own[least]
            better = (d < best[rows]) | ((d == best[rows]) & (found < index[rows]))
            hit = rows[better]
            best[hit], index[hit] = d[better], found[better]
            return
        left, right = bound(node.left, rows), bound(node.right, rows)
        first = left <= right
        for near, far, chosen, away in ((node.left, node.right, first, right), (node.right, node.left, ~first, left)):
            mine = rows[chosen]
            if len(mine):
                visit(near, mine)
                mine = mine[away[chosen] <= best[mine]]
                if len(mine):
                    visit(far, mine)

    if len(points):
        visit(tree.root, np.arange(len(points)))
    return index, best


def whole(rows: DataFrame, id_col: str, vector_col: str, label_col: str | None, parts: int) -> tuple[DataFrame, int]:
    """(id, label, v) of the vectors that are kept, v as integers floor(1024 x), and their length."""
    own = rows.select(F.col(id_col).alias("id"), (F.col(label_col) if label_col else F.lit(None).cast("string")).alias("label"), F.col(vector_col).cast("array<double>").alias("raw"))
    # NaN is above every number in Spark's order
    fine = own.where("raw is not null and size(raw) > 0").where(F.forall("raw", lambda x: x.isNotNull() & (F.abs(x) < F.lit(LARGEST)))).where(F.size("raw") % parts == 0)
    sizes = fine.groupBy(F.size("raw").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    size = sizes["size"] if sizes else 0
    ints = F.transform("raw", lambda x: F.floor(x * F.lit(float(SCALE))).cast("long"))
    return fine.where(F.size("raw") == size).select("id", "label", ints.alias("v")), size


def first_codebooks(vectors: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES) -> list[np.ndarray]:
    """Per part the parts of the vectors of smallest id (null last, ties by vector): at most entries vectors on the driver."""
    rows = np.array([r["v"] for r in vectors.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()], np.int64).reshape(-1, size)
    return [np.ascontiguousarray(p) for p in np.split(rows, parts, axis=1)]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.int64).reshape(-1, size)


def _sums(size: int, trees) -> object:
    """Per task: for each part and entry that has parts, (part, entry, count, sums)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = size // len(trees.value)
        sums = [np.zeros((len(t.entries), width), np.int64) for t in trees.value]
        counts = [np.zeros(len(t.entries), np.int64) for t in trees.value]
        for batch in batches:
            for part, (tree, points) in enumerate(zip(trees.value, np.split(_matrix(batch.column("v"), size), len(trees.value), axis=1), strict=True)):
                for at in range(0, len(points), AHEAD):
                    own = points[at : at + AHEAD]
                    index, _ = nearest(own, tree)
                    np.add.at(sums[part], index, own)
                    np.add.at(counts[part], index, 1)
        for part in range(len(counts)):
            used = np.flatnonzero(counts[part])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), part, np.int32)), pa.array(used.astype(np.int32)), pa.array(counts[part][used]), pa.array(list(sums[part][used]), pa.list_(pa.int64()))], ["part", "entry", "count", "sums"])

    return run


def refined(vectors: DataFrame, size: int, codebooks: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """codebooks after rounds of assigning every part of vectors to its nearest entry and moving entries to the floor of their parts' mean.

    Each round broadcasts a kd-tree per codebook. Every task adds up its rows in one table as large
    as the codebooks; Spark adds these up, and the driver receives one row for each component of an
    entry at most. Sums are of whole numbers, so the order of rows and tasks doesn't matter; an entry
    without parts stays.
    """
    spark = vectors.sparkSession
    for _ in range(rounds):
        trees = spark.sparkContext.broadcast([kd_tree(c) for c in codebooks])
        partial = vectors.select("v").mapInArrow(_sums(size, trees), "part int, entry int, count long, sums array<long>")
        each = partial.select("part", "entry", "count", F.posexplode("sums").alias("place", "sum"))
        total = each.groupBy("part", "entry", "place").agg(F.sum("sum").alias("sum"), F.sum("count").alias("count")).collect()
        codebooks = [c.copy() for c in codebooks]
        for r in total:
            codebooks[r["part"]][r["entry"], r["place"]] = r["sum"] // r["count"]
        trees.unpersist()
    return codebooks


def _encode(size: int, trees) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.split(_matrix(batch.column("v"), size), len(trees.value), axis=1)
            found = [nearest(p, t) for p, t in zip(points, trees.value, strict=True)]
            code = [bytes(row).hex() for row in np.column_stack([i for i, _ in found]).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(code, pa.string()), pa.array(sum(d for _, d in found))], ["id", "label", "code", "error"])

    return run


def encoded(vectors: DataFrame, size: int, codebooks: list[np.ndarray]) -> DataFrame:
    """(id, label, code, error) of vectors: two hex digits a part, and the squared distances to the entries, summed over parts."""
    trees = vectors.sparkSession.sparkContext.broadcast([kd_tree(c) for c in codebooks])
    kinds = dict(vectors.dtypes)
    return vectors.mapInArrow(_encode(size, trees), f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def decoded(codes: DataFrame, codebooks: list[np.ndarray], code_col: str = "code") -> DataFrame:
    """codes with vector: the entries that a code names, as numbers of the scale of the vectors."""
    book = F.array(*(F.array(*(F.array(*(F.lit(float(x) / SCALE) for x in row)) for row in c)) for c in codebooks))
    at = lambda p: F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("vector", F.concat(*(F.get(F.get(book, F.lit(p)), at(p)) for p in range(len(codebooks)))))


def fingerprint(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for c in codebooks for x in c.ravel()).encode()).hexdigest()


def with_label_errors(rows: DataFrame) -> DataFrame:
    """rows with label_error, the sum of error over rows of equal label, nulls together; null where it doesn't fit a long.

    Labels of over a thousandth of the rows, of which at most a thousand exist, are met by broadcast.
    """
    per = cut(rows.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("_n")))
    most = (per.agg(F.sum("_n")).first()[0] or 0) // 1000
    hot = F.broadcast(per.where(F.col("_n") > most).select(F.col("label").alias("_hot"), F.col("label_error").alias("_sum"), F.lit(True).alias("_met")))
    marked = rows.join(hot, F.col("label").eqNullSafe(F.col("_hot")), "left").drop("_hot")
    rest = marked.where("_met is null").drop("_sum", "_met").join(per.where(F.col("_n") <= most).select(F.col("label").alias("_cold"), "label_error"), F.col("label").eqNullSafe(F.col("_cold"))).drop("_cold")
    return marked.where("_met is not null").withColumnRenamed("_sum", "label_error").drop("_met").unionByName(rest)


def compressed(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per kept vector: its id, code, error, label_error, codebooks_sha256.

    Vectors that are null or empty or hold null or non-finite components are left out, and so are those of
    components of 32,768 or more, whose length isn't a multiple of parts, or whose length isn't the most
    common one of those (the longer on ties). Components become whole numbers floor(1024 x) and all
    that follows is exact. Codebooks start as the parts of the entries smallest ids (null last; equal
    ids by vector); with fewer vectors there are fewer entries. Equal parts give equal entries, of
    which the first is used. Repeated rows count as often as they occur; null labels are one label; an
    empty table gives no rows. Other columns are ignored, whatever their names.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's number has two hex digits")
    vectors, size = whole(rows, id_col, vector_col, label_col, parts)
    if not size:
        return rows.sparkSession.createDataFrame([], f"{id_col} {dict(rows.dtypes)[id_col]}, code string, error long, label_error long, codebooks_sha256 string")
    books = refined(vectors, size, first_codebooks(vectors, size, parts, entries), rounds)
    done = with_label_errors(cut(encoded(vectors, size, books)))
    return done.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in SQL, a row a component, for tables of distinct ids and vectors of one length."""
    sql = [
        "WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c AS MATERIALIZED (SELECT vec_id, (i - 1) // (len(v) // {parts}) AS part, (i - 1) % (len(v) // {parts}) AS place, v[i] AS x FROM k, LATERAL unnest(range(1, len(v) + 1)) AS u(i))",
        f"b0 AS MATERIALIZED (SELECT part, entry, place, x FROM c JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT {entries}) USING (vec_id))",
    ]
    for n in range(rounds + 1):
        sql.append(f"d{n} AS (SELECT c.vec_id, c.part, b.entry, CAST(sum((c.x - b.x) * (c.x - b.x)) AS BIGINT) AS d FROM c JOIN b{n} AS b ON c.part = b.part AND c.place = b.place GROUP BY ALL)")
        sql.append(f"a{n} AS MATERIALIZED (SELECT vec_id, part, min((d, entry)) AS best FROM (SELECT vec_id, part, d, entry FROM d{n}) GROUP BY vec_id, part)")
        if n < rounds:
            sql.append(f"m{n} AS (SELECT c.part, a.best[2] AS entry, c.place, CAST((sum(c.x) - ((sum(c.x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x FROM c JOIN a{n} AS a ON c.vec_id = a.vec_id AND c.part = a.part GROUP BY ALL)")
            sql.append(f"b{n + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.place, coalesce(m.x, b.x) AS x FROM b{n} AS b LEFT JOIN m{n} AS m ON b.part = m.part AND b.entry = m.entry AND b.place = m.place)")
    sql.append(f"e AS (SELECT vec_id, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)")
    return ",\n".join(sql) + f"\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) FROM b{rounds}) AS codebooks_sha256 FROM e JOIN k USING (vec_id)"
