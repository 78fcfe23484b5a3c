"""Merkle dataset manifest: roots and authentication paths by traversal of aligned blocks."""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.lineage import cut
from quoin.operators import windows

RUN = 16
LEVELS = 3
BLOCK = RUN**LEVELS
TAMPERED = 5


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def height(n: int) -> int:
    """Levels above n leaves: the least number of times that runs become one node until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // RUN), levels + 1
    return levels


class Treehash:
    """The nodes of one level from the leaves below it, a leaf at a time; it holds less than a run per level."""

    def __init__(self, level: int) -> None:
        self.open: list[list[str]] = [[] for _ in range(level)]
        self.nodes: list[str] = []

    def push(self, node: str, level: int = 0) -> None:
        while level < len(self.open):
            self.open[level].append(node)
            if len(self.open[level]) < RUN:
                return
            node, self.open[level] = digest(self.open[level]), []
            level += 1
        self.nodes.append(node)

    def close(self) -> None:
        """No leaf follows: runs that are not full become nodes as they are."""
        for level in range(len(self.open)):
            if self.open[level]:
                node, self.open[level] = digest(self.open[level]), []
                self.push(node, level + 1)


def root_of(leaves: list[str], levels: int) -> str:
    hashed = Treehash(levels)
    for leaf in leaves:
        hashed.push(leaf)
    hashed.close()
    return hashed.nodes[0]


def paths(leaves: list[str], levels: int) -> Iterator[list[tuple[int, list[str]]]]:
    """For each leaf, from its run up, the (place in the run, nodes of the run) of its levels.

    Per level one run is current and one is being hashed ahead: while the current run's leaves are
    passed, the treehash of that level takes as many of the next run's leaves, one a step, so it is
    ready when it is needed. Beside the leaves themselves this holds two runs and a stack a level.
    """
    current: list[list[str]] = []
    ahead: list[Treehash] = []
    for level in range(levels):
        first = Treehash(level)
        for leaf in leaves[: RUN ** (level + 1)]:
            first.push(leaf)
        first.close()
        current.append(first.nodes)
        ahead.append(Treehash(level))
    for i in range(len(leaves)):
        for level in range(levels):
            wide = RUN ** (level + 1)
            if i and i % wide == 0:
                ahead[level].close()
                current[level], ahead[level] = ahead[level].nodes, Treehash(level)
            if i + wide < len(leaves):
                ahead[level].push(leaves[i + wide])
        yield [(i // RUN**level % RUN, current[level]) for level in range(levels)]


def _levels_of(frame: pd.DataFrame) -> int:
    """A block of a tree with other blocks has all levels; the only block of a tree has those of its leaves."""
    return LEVELS if frame["block"].iat[0] > 0 or len(frame) == BLOCK else height(len(frame))


def block_roots(nodes: DataFrame) -> DataFrame:
    """(tree, place, digest): the root of each aligned block of nodes (tree, place, digest), at the block's place."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        return pd.DataFrame({"tree": frame["tree"].iloc[:1], "place": frame["block"].iloc[:1], "digest": [root_of(frame["digest"].tolist(), _levels_of(frame))]})

    blocks = nodes.select("tree", "place", "digest", F.floor(F.col("place") / BLOCK).alias("block"))
    return blocks.groupBy("tree", "block").applyInPandas(run, "tree string, place long, digest string")


PATH = "array<struct<at:int,left:string,right:string>>"


def block_paths(nodes: DataFrame) -> DataFrame:
    """nodes (tree, place, digest) with path: for each level of the node's block, its place in its run and the run's other digests, joined, on either side."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        own = [[{"at": at, "left": "".join(run_[:at]), "right": "".join(run_[at + 1 :])} for at, run_ in p] for p in paths(frame["digest"].tolist(), _levels_of(frame))]
        return pd.DataFrame({"tree": frame["tree"], "place": frame["place"], "path": own})

    blocks = nodes.select("tree", "place", "digest", F.floor(F.col("place") / BLOCK).alias("block"))
    return blocks.groupBy("tree", "block").applyInPandas(run, f"tree string, place long, path {PATH}")


def _upper(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of nodes (tree, place, digest): (tree, place, path) up to each tree's root, and (tree, digest) of the roots.

    Blocks become nodes of a tree a 4096th as large until every tree is one node; a node's path is its block's and then that of the block.
    """
    levels = [nodes]
    while (levels[-1].agg(F.max("place")).first()[0] or 0) > 0:
        levels.append(cut(block_roots(levels[-1])))
    path = levels[-1].select("tree", "place", F.array().cast(PATH).alias("path"))
    for below in reversed(levels[:-1]):
        up = path.select("tree", F.col("place").alias("block"), F.col("path").alias("up"))
        own = block_paths(below).withColumn("block", F.floor(F.col("place") / BLOCK))
        path = cut(own.join(up, ["tree", "block"]).select("tree", "place", F.concat("path", "up").alias("path")))
    return path, levels[-1].select("tree", "digest")


def field(value: Column) -> Column:
    """A value in a leaf: its length in UTF-8 bytes, a colon and itself; a null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def manifest(rows: DataFrame, tree_col: str, order_col: str, leaf: Column, tampered: Column) -> DataFrame:
    """Per row: order_col, leaf, subroot of its tree, root, proof_sha256, folded_root, verified.

    leaf is a digest of the row, tampered that of the row as it is found later, null if nothing was
    touched. The leaves of a tree stand in the order of order_col (null first, ties by leaf, so that
    equal rows are interchangeable); the trees stand in bytewise order, null first. Every row keeps its
    own row; null, repeated and very long values are only hashed; a tree of one leaf is its leaf and
    has no siblings in itself; an empty table gives no rows. Other columns are ignored.

    Leaves are numbered over many tasks and dealt by aligned blocks of 4096, so that no task holds a
    tree. Blocks are hashed to roots, which are the nodes of smaller trees, up to the root of all. Then
    each block's traversal gives its leaves' paths one after another, to which the upper path, shared by
    the block, is appended; only digests are moved, never values or paths of leaves.
    """
    # null first, then bytewise
    own = rows.select(F.coalesce(F.concat(F.lit("+"), F.col(tree_col).cast("string")), F.lit("")).alias("tree"), F.col(order_col).alias("id"), leaf.alias("digest"), tampered.alias("tampered"))
    leaves = cut(windows.ranked(own, ["tree"], ["id", "digest"], name="place"))
    path, subroots = _upper(cut(block_roots(leaves)))
    # block_roots made each block a node; trees of one block are done there
    trees = cut(windows.numbered(subroots, "tree", name="place").select("tree", F.lit("").alias("all"), "place", "digest"))
    above, top = _upper(trees.select(F.col("all").alias("tree"), "place", "digest"))
    named = trees.select("tree", F.col("digest").alias("subroot"), F.col("place").alias("number"))
    # one row: the root of all
    shared = named.join(above.select(F.col("place").alias("number"), F.col("path").alias("over")), "number").crossJoin(F.broadcast(top.select(F.col("digest").alias("root"))))
    upper = cut(path.join(shared.drop("number"), "tree").select("tree", F.col("place").alias("block"), F.concat("path", "over").alias("path"), "subroot", "root"))
    schema = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"

    def run(frame: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        subroot, root = over["subroot"].iat[0], over["root"].iat[0]
        high = [(s["at"], s["left"], s["right"]) for s in over["path"].iat[0]]
        tail = "".join(left + right for _, left, right in high)
        proofs, folded = [], []
        for p, touched in zip(paths(frame["digest"].tolist(), _levels_of(frame)), frame["tampered"], strict=True):
            low = [("".join(run_[:at]), "".join(run_[at + 1 :])) for at, run_ in p]
            proofs.append(hashlib.sha256(("".join(a + b for a, b in low) + tail).encode()).hexdigest())
            node = touched if isinstance(touched, str) else frame["digest"].iat[len(folded)]
            for left, right in low:
                node = digest([left, node, right])
            for _, left, right in high:
                node = digest([left, node, right])
            folded.append(node)
        return pd.DataFrame({"id": frame["id"], "leaf": frame["digest"], "subroot": subroot, "root": root, "proof_sha256": proofs, "folded_root": folded})

    # as text, since pandas would read a long with nulls as a double
    blocks = leaves.withColumn("block", F.floor(F.col("place") / BLOCK)).withColumn("id", F.col("id").cast("string"))
    out = blocks.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInPandas(run, schema)
    return out.select(F.col("id").cast(dict(leaves.dtypes)["id"]).alias(order_col), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def document_manifest(docs: DataFrame) -> DataFrame:
    """manifest() of documents, a tree per source; where 5 divides the CRC of the id, the text is later found with A-Z lower-cased."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    touched = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    values = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars")]
    return manifest(docs, "source", "doc_id", leaf_of(*values, F.col("text")), F.when(touched, leaf_of(*values, lower)))


def oracle(levels: int = 5, upper: int = 2) -> str:
    """The same in SQL, for sources of up to 16^levels documents and 16^upper sources."""
    crc = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295::BIGINT)"
    own = lambda text: "sha256(" + " || ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen(CAST({v} AS VARCHAR)) || ':' || {w} END" for v, w in (("doc_id", "doc_id"), ("source", "source"), ("lang", "lang"), ("n_chars", "n_chars"), ("text", text))) + ")"
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    sql = [
        f"WITH d AS MATERIALIZED (SELECT doc_id, source, {own('text')} AS leaf, CASE WHEN {crc} % {TAMPERED} = 0 THEN {own(lower)} END AS touched FROM documents)",
        "s0 AS MATERIALIZED (SELECT source AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, leaf AS h, row_number() OVER () AS r, doc_id, leaf, touched FROM d)",
        "l0 AS MATERIALIZED (SELECT r, t, p, doc_id, leaf, '' AS proof, coalesce(touched, leaf) AS folded FROM s0)",
    ]
    names = ("s", "l")
    for stage, count in (("source", levels), ("all", upper)):
        n, rows = names
        if stage == "all":
            sql.append(f"u0 AS MATERIALIZED (SELECT 0 AS t, row_number() OVER (ORDER BY t NULLS FIRST) - 1 AS p, h, t AS of FROM s{levels})")
            sql.append(f"m0 AS MATERIALIZED (SELECT r, 0 AS t, u0.p, doc_id, leaf, proof, folded, u0.h AS subroot FROM l{levels} AS l JOIN u0 ON l.t IS NOT DISTINCT FROM u0.of)")
            n, rows = "u", "m"
        kept = ", subroot" if stage == "all" else ""
        for k in range(count):
            sql.append(f"{n}{k + 1} AS MATERIALIZED (SELECT t, p // {RUN} AS p, CASE WHEN max(many) THEN sha256(string_agg(h, '' ORDER BY p)) ELSE min(h) END AS h FROM (SELECT t, p, h, count(*) OVER (PARTITION BY t) > 1 AS many FROM {n}{k}) GROUP BY t, p // {RUN})")
            sql.append(
                f"{rows}{k + 1} AS MATERIALIZED (SELECT l.r, any_value(l.t) AS t, any_value(l.p) // {RUN} AS p, any_value(l.doc_id) AS doc_id, any_value(l.leaf) AS leaf, any_value(l.proof) || coalesce(string_agg(CASE WHEN s.p <> l.p THEN s.h END, '' ORDER BY s.p), '') AS proof, CASE WHEN max(s.many) THEN sha256(string_agg(CASE WHEN s.p = l.p THEN l.folded ELSE s.h END, '' ORDER BY s.p)) ELSE any_value(l.folded) END AS folded{', any_value(subroot) AS subroot' if kept else ''} FROM {rows}{k} AS l JOIN (SELECT t, p, h, count(*) OVER (PARTITION BY t) > 1 AS many FROM {n}{k}) AS s ON l.t IS NOT DISTINCT FROM s.t AND l.p // {RUN} = s.p // {RUN} GROUP BY l.r)"
            )
    return ",\n".join(sql) + f"\nSELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified FROM m{upper}, u{upper}"
