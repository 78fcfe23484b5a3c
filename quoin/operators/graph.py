"""Graphs of primitives: components and spanning trees as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.lineage import written as cut


SPLIT = 200_000


def _lookup(rows: DataFrame, low: DataFrame, most: int) -> DataFrame:
    """(v, m) of rows (u, v) with low (u, m, n): nodes of over most edges, of which few can exist, are met by broadcast, so that no task holds a hub; most of 0: no such nodes."""
    if not most:
        return rows.join(low.select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    hubs = F.broadcast(low.where(F.col("n") > most).select("u", F.col("m").alias("hub")))
    marked = rows.join(hubs, "u", "left")
    rest = marked.where("hub is null").join(low.select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(marked.where("hub is not null").select(F.col("v").alias("u"), F.col("hub").alias("v")))


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node each node of edges reaches, by large and small stars until nothing changes.

    Each round is two grouped minima and two lookups; the number of rounds grows with the logarithm
    of the longest chain, and the edge set never grows. A node with more than 200,000 edges
    and a thousandth of all is a hub; as there are at most some two thousand, hubs are looked up by broadcast. Nodes
    are longs. Self loops keep their node, edges with a null end are ignored, repeated edges and
    either direction are the same edge, no edges give no rows; other columns are ignored.
    """
    own = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u is not null and v is not null")
    now = cut(own.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen, size = None, now.count()
    while True:
        # a node has at most all edges, either way round
        most = max(SPLIT, size // 1000) if 2 * size > SPLIT else 0
        both = now.union(now.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = _lookup(both.where("v > u"), low, most).union(now.where("u = v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _lookup(large, least, most).union(least.select("u", "m"))
        now = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen, size = mark, mark["n"]
    return now.union(now.select("v", "v")).toDF("node", "component").groupBy("node").agg(F.min("component").alias("component"))


def clusters(edges: DataFrame, least: int = 2) -> DataFrame:
    """Components of at least least nodes, with their size."""
    c = components(edges)
    return c.join(c.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= least), "component")


def transitive_reduction(edges: DataFrame) -> DataFrame:
    """The same components as stars around their smallest member."""
    return components(edges).where("node <> component").select(F.col("component").alias("src"), F.col("node").alias("dst"))


def met(rows: DataFrame, table: DataFrame, keys: list[str], size: int) -> DataFrame:
    """rows (size of them) with table, a row per keys. Keys wanted by very many rows, of which few can exist, are met by broadcast, so that no task holds them."""
    if size <= SPLIT:
        return rows.join(table, keys)
    most = max(SPLIT, size // 1000)
    hot = cut(rows.groupBy(*keys).count().where(F.col("count") > most).select(*keys, F.lit(True).alias("_hot")))
    marked = rows.join(F.broadcast(hot), keys, "left")
    few = F.broadcast(table.join(F.broadcast(hot.drop("_hot")), keys, "left_semi"))
    return marked.where("_hot is null").drop("_hot").join(table, keys).unionByName(marked.where("_hot").drop("_hot").join(few, keys))


def spanning_tree(edges: DataFrame) -> DataFrame:
    """A minimum spanning forest of (src, dst, w) by Boruvka's rounds; ties by ids. Each round at least halves the trees.

    A tree follows its least edge to another one. As edges are in one order, only two trees can point to
    each other, of which the smaller becomes the root; the others reach their roots by pointer jumping.
    """
    own = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w").groupBy("src", "dst").agg(F.min("w").alias("w")).where("src <> dst")
    live, chosen = cut(own.withColumns({"ta": F.col("src"), "tb": F.col("dst")})), None
    while size := live.count():
        ends = live.select("src", "dst", "w", F.col("ta").alias("t"), F.col("tb").alias("to")).union(live.select("src", "dst", "w", "tb", "ta"))
        best = cut(ends.groupBy("t").agg(F.min(F.struct("w", "src", "dst", "to")).alias("e")))
        found = best.select("e.src", "e.dst", "e.w").distinct()
        chosen = found if chosen is None else chosen.unionByName(found)
        back = best.select(F.col("t").alias("to"), F.col("e.to").alias("back"))
        up = cut(met(best.select("t", F.col("e.to").alias("to")), back, ["to"], size).select("t", F.when((F.col("back") == F.col("t")) & (F.col("t") < F.col("to")), F.col("t")).otherwise(F.col("to")).alias("to")))
        while True:
            further = up.select(F.col("t").alias("to"), F.col("to").alias("then"))
            nxt = cut(met(up, further, ["to"], size).select("t", F.col("then").alias("to"), (F.col("to") != F.col("then")).alias("moved")))
            up = nxt.select("t", "to")
            if nxt.where("moved").isEmpty():
                break
        for end in ("ta", "tb"):
            live = met(live, up.withColumnsRenamed({"t": end, "to": "root"}), [end], size).withColumn(end, F.col("root")).drop("root")
        # of the edges between two trees only the least can be chosen
        least = live.where("ta <> tb").groupBy(F.least("ta", "tb").alias("ta"), F.greatest("ta", "tb").alias("tb")).agg(F.min(F.struct("w", "src", "dst")).alias("e"))
        live = cut(least.select("e.src", "e.dst", "e.w", "ta", "tb"))
    return own.limit(0) if chosen is None else cut(chosen)
