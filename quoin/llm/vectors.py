"""Embedding near-duplicates by robust-pruned flat graphs over overlapping cluster shards."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.lineage import cut
from quoin.operators.graph import components

SAMPLE = 4096
SHARD = 500
MOST = 2000
FANOUT = 64
SPREAD = 2
CHUNK = 20_000
DEGREE = 16
FAR = 3
POOL = 32
ALPHA = 1.2
BEAM = 16
SLACK = 0.05
AUDIT = 256
WANTED_RECALL = 0.95
LEAST_RECALL = 0.9


def unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt((raw * raw).sum(axis=1))[:, None]


def centroids(vectors: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means, first centres evenly spread over the rows."""
    centres = vectors[np.linspace(0, len(vectors) - 1, count).astype(int)].copy()
    for _ in range(rounds):
        near = (vectors @ centres.T).argmax(axis=1)
        for c in range(count):
            own = vectors[near == c]
            if len(own):
                mean = own.sum(axis=0)
                centres[c] = mean / max(1e-12, float(np.linalg.norm(mean)))
    return centres


def nearest_clusters(vectors: np.ndarray, centres: np.ndarray, spread: int, least: float) -> np.ndarray:
    """Each vector's spread nearest centres, nearest first; -1 for one that no partner within the range can have as its nearest.

    A partner is at most the range's chord away, so if its nearest centre is c the vector is at most
    that far from the plane between c and its own nearest centre.
    """
    take = min(spread, len(centres))
    sims = vectors @ centres.T
    near = np.argpartition(-sims, take - 1, axis=1)[:, :take]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, axis=1), axis=1, kind="stable"), axis=1)
    first = near[:, :1]
    # squared distances to centres differ by this; halved and over the centres' distance it is the way to their plane
    square = (centres * centres).sum(axis=1)
    gap = (square[near] - square[first]) / 2 - np.take_along_axis(sims, near, axis=1) + np.take_along_axis(sims, first, axis=1)
    apart = np.sqrt(np.maximum(1e-18, square[near] + square[first] - 2 * np.einsum("ijk,ik->ij", centres[near], centres[first[:, 0]])))
    chord = np.sqrt(max(0.0, 2 - 2 * least))
    near = np.where(gap <= (chord + 1e-9) * apart, near, -1)
    near[:, 0] = first[:, 0]
    return near


def robust_pruned(v: np.ndarray, degree: int = DEGREE, far: int = FAR, pool: int = POOL, alpha: float = ALPHA) -> list[np.ndarray]:
    """Adjacency lists over the rows of v (unit vectors): near neighbours kept by robust pruning, a few far ones, and reverse edges.

    Of a node's nearest pool the closest is kept and drops all that are alpha times closer to it
    than to the node, and so on.
    """
    n = len(v)
    if n == 1:
        return [np.zeros(0, np.int64)]
    rng = np.random.Generator(np.random.PCG64(n))
    take = min(pool, n - 1)
    v = v.astype(np.float32)
    from_, to_ = [], []
    for at in range(0, n, 256):
        rows = np.arange(at, min(n, at + 256))
        sims = v[rows] @ v.T
        sims[np.arange(len(rows)), rows] = -3
        cand = np.argpartition(-sims, take - 1, axis=1)[:, :take]
        order = np.argsort(-np.take_along_axis(sims, cand, axis=1), axis=1, kind="stable")
        cand = np.take_along_axis(cand, order, axis=1)
        to = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(sims, cand, axis=1)))
        w = v[cand]
        between = alpha * np.sqrt(np.maximum(0, 2 - 2 * (w @ w.transpose(0, 2, 1))))
        alive = np.ones(cand.shape, bool)
        kept = np.zeros(cand.shape, bool)
        for i in range(take):
            pick = alive[:, i] & (kept.sum(axis=1) < degree)
            kept[pick, i] = True
            alive &= ~(pick[:, None] & (between[:, i, :] <= to))
            alive[:, i] = False
        r, c = np.nonzero(kept)
        from_.append(rows[r]), to_.append(cand[r, c])
    a, b = np.concatenate(from_), np.concatenate(to_)
    # reverse edges, as many as the degree for each node
    order = np.argsort(b, kind="stable")
    rank = np.arange(len(b)) - np.searchsorted(b[order], b[order])
    back = order[rank < degree]
    one = np.concatenate([a, b[back], np.repeat(np.arange(n), far)])
    two = np.concatenate([b, a[back], rng.integers(0, n, n * far)])
    keys = np.unique(one * n + two)
    one, two = keys // n, keys % n
    one, two = one[one != two], two[one != two]
    return np.split(two, np.searchsorted(one, np.arange(1, n)))


def range_search(v: np.ndarray, graph: list[np.ndarray], least: float, beam: int = BEAM, slack: float = SLACK, at_once: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) with a < b: rows of v of which one met the other within the range (cosine at least least, to single precision).

    Greedy search from the medoid, for a block of queries at a time: the best unexpanded nodes among
    the beam are expanded until the beam is; then everything met within the range, widened by slack,
    is expanded until nothing new is in it.
    """
    n = len(v)
    v32 = v.astype(np.float32)
    width = max(1, max(map(len, graph)))
    table = np.full((n, width), -1, np.int64)
    for i, own in enumerate(graph):
        table[i, : len(own)] = own
    medoid = int((v32 @ v32.mean(axis=0)).argmax())
    left, right = [], []
    top, width_k = min(beam, n), min(at_once, n)
    for at in range(0, n, 512):
        q = v32[at : at + 512]
        m = len(q)
        score = np.full((m, n), -2, np.float32)
        open_ = np.full((m, n), -2, np.float32)  # scores of what was met and isn't expanded
        score[:, medoid] = open_[:, medoid] = q @ v32[medoid]
        active = np.arange(m)
        while len(active):
            edge = np.minimum(np.partition(score[active], n - top, axis=1)[:, n - top], least - slack)
            o = open_[active]
            pick = np.argpartition(o, n - width_k, axis=1)[:, n - width_k :]
            worth = np.take_along_axis(o, pick, axis=1) >= np.maximum(edge, -1.5)[:, None]
            r, k = np.nonzero(worth)
            if not len(r):
                break
            rows, node = active[r], pick[r, k]
            open_[rows, node] = -2
            near = table[node]
            rr, cc = np.nonzero(near >= 0)
            rows, near = rows[rr], near[rr, cc]
            fresh = np.unique((rows * n + near)[score[rows, near] < -1.5])
            rows, near = fresh // n, fresh % n
            for b in range(0, len(rows), 100_000):
                x, y = rows[b : b + 100_000], near[b : b + 100_000]
                score[x, y] = open_[x, y] = np.einsum("ij,ij->i", q[x], v32[y])
            active = active[worth.any(axis=1)]
        a, b = np.nonzero(score >= least - 1e-4)
        a += at
        left.append(a[a != b]), right.append(b[a != b])
    a, b = np.concatenate(left), np.concatenate(right)
    keys = np.unique(np.minimum(a, b) * n + np.maximum(a, b))
    return keys // n, keys % n


def _raw(frame: pd.DataFrame) -> np.ndarray:
    return np.array(frame.vec.tolist(), np.float64)


def _train(shard: int, spread: int, least: float):
    """A cell's centres from its sample, or none if splitting would lose the sample's own links (a dense cell)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        v, n = unit(_raw(frame)), int(frame.n.iloc[0])
        count = max(2, min(FANOUT, -(-spread * n // shard), len(v) // 4))
        centres = centroids(v, count)
        own = nearest_clusters(v, centres, spread, least)
        member = np.zeros((len(v), count), np.float32)
        r, c = np.nonzero(own >= 0)
        member[r, own[r, c]] = 1
        links = kept = 0
        for at in range(0, len(v), 512):
            a, b = np.nonzero(np.triu(v[at : at + 512] @ v.T >= least, at + 1))
            links += len(a)
            kept += int(((member[a + at] * member[b]).sum(axis=1) > 0).sum())
        if links >= 50 and kept < 0.97 * links or len(v) < 8:
            centres = centres[:0]
        return pd.DataFrame({"cell": [frame.cell.iloc[0]], "n": [n], "centres": [centres.ravel().tolist()]})

    return run


def _assign(spread: int, least: float):
    def run(frame: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        flat = np.asarray(model.centres.iloc[0], np.float64) if len(model) else np.zeros(0)
        if not len(frame) or not len(flat):
            return frame.assign(split=False)[["node", "vec", "copies", "cell", "split"]]
        v = unit(_raw(frame))
        near = nearest_clusters(v, flat.reshape(-1, v.shape[1]), spread, least)
        r, c = np.nonzero(near >= 0)
        out = frame.iloc[r]
        return out.assign(cell=[f"{a}.{b}" for a, b in zip(out.cell, near[r, c], strict=True)], split=True)[["node", "vec", "copies", "cell", "split"]]

    return run


def _placed(reps: DataFrame, shard: int, spread: int, least: float) -> DataFrame:
    """(node, vec, copies, cell): reps in overlapping cells of about shard nodes, split level by level; dense cells stay whole.

    Every cell larger than two shards is split by centres that its own sample gives, on the
    executors; its rows meet them in chunks of bounded size, so neither centres nor rows of a cell
    gather in one place.
    """
    done, rows = None, reps.select("node", "vec", "copies", F.concat_ws("\x01", "label", F.col("dim").cast("string")).alias("cell"))
    for level in range(20):
        sizes = rows.groupBy("cell").agg(F.count("*").alias("n"))
        large = cut(sizes.where(F.col("n") > 2 * shard))
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        # a cell has a chunk more for each CHUNK rows; hot cells are spread over their chunks
        few = rows.join(large.select("cell"), "cell", "left_anti")
        some = rows.join(large, "cell")
        sample = some.where(F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1_000_000)) < F.lit(SAMPLE * 1_000_000.0) / F.col("n"))
        models = cut(sample.groupBy("cell").applyInPandas(_train(shard, spread, least), "cell string, n long, centres array<double>"))
        parts = F.ceil(F.col("n") / F.lit(CHUNK)).cast("int")
        given = models.withColumn("chunk", F.explode(F.sequence(F.lit(0), parts - 1)))
        asked = some.withColumn("chunk", F.pmod(F.xxhash64("node"), parts).cast("int")).select("node", "vec", "copies", "cell", "chunk")
        split = asked.groupBy("cell", "chunk").cogroup(given.groupBy("cell", "chunk")).applyInPandas(_assign(spread, least), "node long, vec array<double>, copies long, cell string, split boolean")
        split = cut(split)
        ready = few.unionByName(split.where("not split").drop("split"))
        done = ready if done is None else done.unionByName(ready)
        rows = split.where("split").drop("split")
    return done.unionByName(rows)


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("node")
    ids = frame.node.to_numpy()
    return pd.DataFrame({"node": ids, "cell": frame.cell, "near": [ids[g] for g in robust_pruned(unit(_raw(frame)))]})


def _search(least: float, beam: int, slack: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        ids, raw = frame.node.to_numpy(), _raw(frame)
        v = unit(raw)
        # the united lists, as far as they lead to nodes of this shard
        sizes = np.array([len(x) for x in frame.near])
        flat = np.concatenate(frame.near.tolist()).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
        known = ids[at] == flat
        graph = np.split(at[known], np.searchsorted(np.repeat(np.arange(len(ids)), sizes)[known], np.arange(1, len(ids))))
        a, b = range_search(v, graph, least, beam, slack)
        norm = np.sqrt((raw * raw).sum(axis=1))
        sure = [np.einsum("ij,ij->i", raw[a[k : k + 100_000]], raw[b[k : k + 100_000]]) / (norm[a[k : k + 100_000]] * norm[b[k : k + 100_000]]) >= least for k in range(0, len(a), 100_000)]
        if sure:
            a, b = a[np.concatenate(sure)], b[np.concatenate(sure)]
        # a pair counts in the first cell that both are in, and there in the tile of its two blocks
        names = {c: i for i, c in enumerate(sorted({c for own in frame.cells for c in own}))}
        width = max(len(own) for own in frame.cells)
        cells = np.array([[names[c] for c in own] + [len(names) + i] * (width - len(own)) for i, own in enumerate(frame.cells)])
        common = np.full(len(a), len(names))
        for k in range(width):
            mine = cells[a, k]
            both = (cells[b] == mine[:, None]).any(axis=1) & (mine < len(names))
            common = np.where(both, np.minimum(common, mine), common)
        block, p, q = frame.block.to_numpy(), frame.p.iloc[0], frame.q.iloc[0]
        own = (common == names[frame.cell.iloc[0]]) & (np.minimum(block[a], block[b]) == p) & (np.maximum(block[a], block[b]) == q)
        a, b = a[own], b[own]
        copies = frame.copies.to_numpy()
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        label = np.arange(len(ids))
        while len(a):
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[b], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        some = links > 0
        return pd.DataFrame({"node": ids[some], "links": links[some], "root": ids[label][some]})

    return run


def _audit(reps: DataFrame, least: float, count: int, counted: DataFrame) -> float:
    """Mean over at most count nodes (by hash, of those that have links) of the share of their links that was found; 1 if none has any.

    Their links are counted by brute force over all rows in one pass. More links than there are
    count against the share as missing ones do.
    """
    some = reps.orderBy(F.xxhash64("node", F.lit(7)), "node").limit(count).select("node", "label", "dim", "vec").collect()
    groups: dict[tuple, list] = {}
    for r in some:
        groups.setdefault((r["label"], r["dim"]), []).append(r)
    # at most count vectors
    shared = reps.sparkSession.sparkContext.broadcast({k: (np.array([r["node"] for r in g]), unit(np.array([r["vec"] for r in g]))) for k, g in groups.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, own in batch.groupby(["label", "dim"]):
                if key in shared.value:
                    ids, q = shared.value[key]
                    hit = (q @ unit(_raw(own)).T >= least) & (ids[:, None] != own.node.to_numpy()[None, :])
                    yield pd.DataFrame({"node": ids, "n": hit @ own.copies.to_numpy()})

    true = reps.select("node", "label", "dim", "vec", "copies").mapInPandas(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).where("n > 0")
    found = F.coalesce("links", F.lit(0))
    share = true.join(counted, "node", "left").agg(F.avg(F.least("n", found) / F.greatest("n", found)).alias("share")).first()["share"]
    return 1.0 if share is None else float(share)


@dataclass
class Result:
    """rows: (vec_id, n_links, component_id, kept) per input row; recall: the audited one; spread: the cells a node was put in at each level."""

    rows: DataFrame
    recall: float
    spread: int


def linked(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, beam: int = BEAM, shard: int = SHARD, most: int = MOST, spread: int = SPREAD) -> Result:
    """The links of rows, as in near_duplicates(), with the audited recall."""
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vec"))
    finite = F.forall(F.col("vec"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    base = base.withColumn("good", good)
    distinct = base.where("good").groupBy("label", "vec").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    # a node is a distinct vector of a label; its number is fixed by being written
    reps = cut(distinct.withColumn("dim", F.size("vec")).withColumn("node", F.monotonically_increasing_id()))
    alone = lambda some: some.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if reps.isEmpty():
        return Result(alone(base), 1.0, spread)
    key = ["cell", "p", "q"]
    for wider in range(3):
        placed = cut(_placed(reps, shard, spread << wider, least))
        blocks = placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("blocks"))
        keyed = placed.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        tile = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("p"), F.greatest("block", k).alias("q"))))
        tiled = keyed.withColumn("tile", tile).select("cell", "tile.p", "tile.q", "node", "vec", "copies", "block")
        built = tiled.select(*key, "node", "vec").groupBy(*key).applyInPandas(_build, "node long, cell string, near array<long>")
        united = cut(built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.sort_array(F.collect_set("cell")).alias("cells")))
        found = cut(tiled.join(united, "node").groupBy(*key).applyInPandas(_search(least, beam, SLACK), "node long, links long, root long"))
        counted = cut(found.groupBy("node").agg(F.sum("links").alias("links")))
        recall = _audit(reps, least, AUDIT, counted)
        logging.getLogger(__name__).info("recall %.4f with %d cells a node", recall, spread << wider)
        if recall >= WANTED_RECALL:
            break
    if recall < LEAST_RECALL:
        raise RuntimeError(f"audited recall {recall:.3f} is below {LEAST_RECALL} with {spread << wider} cells a node")
    joined = reps.join(counted, "node", "left").join(components(found, "node", "root"), "node", "left").select("label", "vec", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    least_id = joined.groupBy("component").agg(F.min("low").alias("component_id"))
    known = joined.join(least_id, "component").select("label", "vec", "links", "component_id")
    fit = base.where("good").join(known, ["label", "vec"]).select("vec_id", F.col("links").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return Result(fit.unionByName(alone(base.where("not good"))), recall, spread << wider)


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, beam: int = BEAM, shard: int = SHARD, most: int = MOST, spread: int = SPREAD) -> DataFrame:
    """One row (vec_id, n_links, component_id, kept) per row of rows.

    Only vectors of equal, known label (and length) are compared, by cosine in double precision.
    Equal vectors of a label are one node with a number of copies. A label's nodes go to the spread
    nearest of its cells, split level by level by k-means on samples of about 4,096 nodes each until
    a cell has about shard nodes; a further cell is left out where the range proves that no partner
    needs it. Each cell is a shard whose robust-pruned graph is built alone, and a node's adjacency
    lists are united. In every shard each node then searches the united graph from the medoid,
    expanding its range; pairs found are verified, so none below least links. A cell whose sample
    shows that a split would lose links is dense and stays whole; beyond most nodes it is cut into
    hashed blocks, and each two blocks make one shard, so that no task holds an unbounded group and
    still every pair meets. Shards return link counts and a spanning forest, never all pairs. The
    mean recall over 256 nodes is audited by brute force in each call; below 0.95 nodes go to twice
    as many cells, twice at most; if it then is below 0.9 an error says so.

    Rows with a null label or id, or a vector that is null, empty, zero or holds null or non-finite
    numbers, link with nothing: n_links 0, component_id their own id, kept true (a null id: null and
    false). Of equal ids each row is a vector of its own under that id, whatever its label. Repeated
    rows are copies of one another. An empty table gives no rows; other columns are ignored.
    """
    return linked(rows, id_col, vector_col, label_col, least, beam, shard, most, spread).rows
