"""Selection of one direction per patch with a proven gap: components of the problem in parallel, a dual bound and branch and bound in each."""

from __future__ import annotations

import heapq
import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.lineage import cut
from quoin.operators import graph

MOST_VARIABLES = 1000
MOST_NODES = 1000


@dataclass
class _Terms:
    """cost (patch, direction; infinite where not allowed), pair (both directions used), and edges a, b of patches that pay weight if their directions differ."""

    cost: np.ndarray
    pair: np.ndarray
    a: np.ndarray
    b: np.ndarray
    weight: np.ndarray

    def energy(self, choice: np.ndarray) -> float:
        used = np.unique(choice)
        own = self.cost[np.arange(len(choice)), choice].sum() + self.pair[np.ix_(used, used)].sum() / 2
        return float(own + self.weight[choice[self.a] != choice[self.b]].sum())

    def beside(self, p: int, choice: np.ndarray) -> np.ndarray:
        """What patch p pays to its neighbours, by its direction."""
        others = np.concatenate([choice[self.b[self.a == p]], choice[self.a[self.b == p]]])
        weights = np.concatenate([self.weight[self.a == p], self.weight[self.b == p]])
        return weights.sum() - np.bincount(others, weights, self.cost.shape[1])

    def improved(self, choice: np.ndarray) -> tuple[float, np.ndarray]:
        """choice after moves of single patches and of all patches of a direction, until none lowers the energy."""
        best, choice = self.energy(choice), choice.copy()
        while True:
            before = best
            for p in range(len(choice)):
                used = np.zeros(self.cost.shape[1], bool)
                used[np.delete(choice, p)] = True
                price = self.cost[p] + np.where(used, 0.0, self.pair[:, used].sum(axis=1)) + self.beside(p, choice)
                choice[p] = price.argmin()
            best = self.energy(choice)
            for d in np.unique(choice):
                left = np.setdiff1d(np.unique(choice), [d])
                moved = choice.copy()
                if len(left):
                    mine = np.flatnonzero(choice == d)
                    moved[mine] = left[self.cost[np.ix_(mine, left)].argmin(axis=1)]
                    if np.isfinite(new := self.energy(moved)) and new < best - 1e-12:
                        best, choice = new, moved
            if best >= before - 1e-12:
                return best, choice


@dataclass
class _Duals:
    """open: prices that patches pay for a direction (patch, direction); both: prices of two directions used at once; edge: a patch's share of an edge's weight (edge, direction)."""

    open: np.ndarray
    both: np.ndarray
    edge: np.ndarray


def _bound(t: _Terms, allowed: np.ndarray, used: np.ndarray, duals: _Duals, best: float, rounds: int) -> tuple[float, _Duals, np.ndarray, np.ndarray]:
    """(bound, its duals, picks of the best round, how often each patch picked each direction) for choices within allowed that use all of used.

    The dual of the linear relaxation. A patch's direction is used (priced by open), two used
    directions pay their pair (a used one and one more to the extent both), and an edge's weight
    bounds what its ends may shift to each other (edge). Each round moves the prices up the slope,
    in steps by the distance to the best known energy; every price gives a bound.
    """
    rest = allowed.any(axis=0) & ~used
    cost = np.where(allowed, t.cost, np.inf)
    fixed, opening = t.pair[np.ix_(used, used)].sum() / 2, t.pair[:, used].sum(axis=1)
    free = np.triu(np.outer(rest, rest), 1)
    lam, mu, x = duals.open * rest, np.where(free, duals.both, 0.0), duals.edge.copy()
    half, rows = t.weight[:, None] / 2, np.arange(len(cost))
    top, kept, kept_pick, often = -np.inf, duals, None, np.zeros(cost.shape)
    pace, idle = 1.0, 0
    for _ in range(rounds):
        price = cost + lam
        np.add.at(price, t.a, x)
        np.add.at(price, t.b, -x)
        pick = price.argmin(axis=1)
        left = opening + mu.sum(axis=0) + mu.sum(axis=1) - lam.sum(axis=0)
        opened = rest & (left < 0)
        bound = fixed + price[rows, pick].sum() + left[opened].sum() - mu.sum()
        idle += 1
        if bound > top + 1e-12:
            top, kept, kept_pick, idle = bound, _Duals(lam.copy(), mu.copy(), x.copy()), pick, 0
        if top >= best - 1e-9 * max(1.0, abs(best)):
            break
        if idle >= 8:
            pace, idle, lam, mu, x = pace / 2, 0, kept.open.copy(), kept.both.copy(), kept.edge.copy()
            continue
        mine = np.zeros(cost.shape)
        mine[rows, pick] = 1.0
        often += mine
        up_lam = np.where(allowed & rest, mine - opened, 0.0)
        up_lam[(lam <= 0) & (up_lam < 0)] = 0.0
        up_mu = np.where(free, opened[:, None].astype(float) + opened[None, :] - 1.0, 0.0)
        up_mu[((mu <= 0) & (up_mu < 0)) | ((mu >= t.pair) & (up_mu > 0))] = 0.0
        up_x = mine[t.a] - mine[t.b]
        up_x[((x <= -half) & (up_x < 0)) | ((x >= half) & (up_x > 0))] = 0.0
        norm = (up_lam**2).sum() + (up_mu**2).sum() + (up_x**2).sum()
        if norm == 0:
            break
        step = pace * (best - bound) / norm
        lam = np.maximum(0.0, lam + step * up_lam)
        mu = np.clip(mu + step * up_mu, 0.0, t.pair)
        x = np.clip(x + step * up_x, -half, half)
    return float(top), kept, kept_pick, often / max(1.0, often.sum() / len(cost))


def _branch_and_bound(t: _Terms, most_nodes: int) -> tuple[float, np.ndarray, float]:
    """(energy, choice, lower bound). Nodes are taken by their bounds; each forks on a direction (used or not) or, once these are settled, on a patch's direction."""
    shape, edges = t.cost.shape, len(t.a)
    start = _Duals(np.zeros(shape), np.zeros((shape[1], shape[1])), np.zeros((edges, shape[1])))
    best, choice = t.improved(t.cost.argmin(axis=1))
    tie = itertools.count()
    enough = lambda bound: bound >= best - 1e-9 * max(1.0, abs(best))
    heap: list[tuple] = [(-np.inf, next(tie), np.isfinite(t.cost), np.zeros(shape[1], bool))]
    for n in range(most_nodes):
        if not heap or enough(heap[0][0]):
            return best, choice, best
        above, _, allowed, used = heapq.heappop(heap)
        single = allowed.sum(axis=1) == 1
        used = used | allowed[single].any(axis=0)
        bound, duals, pick, often = _bound(t, allowed, used, start, best, 400 if n == 0 else 60)
        if n == 0:
            start = duals
        bound = max(bound, above)
        if single.all():
            pick = allowed.argmax(axis=1)
        for new in (pick, np.where(allowed, t.cost - often, np.inf).argmin(axis=1)):
            energy, found = t.improved(new)
            if energy < best - 1e-12:
                best, choice = energy, found
        if single.all() or enough(bound):
            continue
        share = often.max(axis=0)
        open_ = allowed.any(axis=0) & ~used & (share > 0.02)
        if open_.any():
            d = int(np.where(open_, np.abs(share - 0.5), np.inf).argmin())
            without = allowed.copy()
            without[:, d] = False
            with_ = used.copy()
            with_[d] = True
            forks = [(allowed, with_), (without, used)]
        else:
            p = int(np.where(single, np.inf, often.max(axis=1)).argmin())
            d = int(np.where(allowed[p], often[p] - 1e-9 * t.cost[p], -np.inf).argmax())
            only, without = allowed.copy(), allowed.copy()
            only[p] = np.arange(shape[1]) == d
            without[p, d] = False
            forks = [(only, used), (without, used)]
        for a, u in forks:
            if a.any(axis=1).all():
                heapq.heappush(heap, (bound, next(tie), a, u))
    return best, choice, min(best, heap[0][0]) if heap else best


def solve(costs: dict[tuple[int, int], float], pair: dict[tuple[int, int], float], spatial: dict[tuple[int, int], float] | None = None, most_nodes: int = MOST_NODES) -> tuple[float, dict[int, int], float]:
    """(energy, direction chosen per patch, gap) of least sum of costs[patch, direction] + pair over ordered pairs of used directions + spatial over ordered patch pairs of different directions.

    Pair and spatial terms are at least 0, so one candidate per patch is best. No choice has an energy
    below energy - gap; the gap is 0 where the search ended before most_nodes. Of equal energies any
    may be chosen, the same in each run. No costs give an empty choice.
    """
    if not costs:
        return 0.0, {}, 0.0
    patches, ways = (sorted({k[i] for k in costs}) for i in (0, 1))
    row, column = ({v: i for i, v in enumerate(names)} for names in (patches, ways))
    cost, both = np.full((len(patches), len(ways)), np.inf), np.zeros((len(ways), len(ways)))
    for (p, d), q in costs.items():
        cost[row[p], column[d]] = q
    for (d, e), q in pair.items():
        if d in column and e in column and d != e:
            both[column[d], column[e]] += q
            both[column[e], column[d]] += q
    near: dict[tuple[int, int], float] = {}
    for (p, o), q in (spatial or {}).items():
        if p in row and o in row and p != o:
            key = (min(row[p], row[o]), max(row[p], row[o]))
            near[key] = near.get(key, 0.0) + q
    ends = np.array(sorted(near), dtype=np.int64).reshape(-1, 2)
    terms = _Terms(cost, both, ends[:, 0], ends[:, 1], np.array([near[k] for k in sorted(near)]))
    energy, choice, low = _branch_and_bound(terms, most_nodes)
    return energy, {p: ways[choice[i]] for p, i in row.items()}, max(0.0, energy - low)


def solved(costs: DataFrame, pairs: DataFrame, spatial: DataFrame | None = None, most: int = MOST_VARIABLES, most_nodes: int = MOST_NODES) -> DataFrame:
    """(component, gid, did, energy, gap) of costs (gid, did, q), pairs (did_a, did_b, cost) and spatial (gid_a, gid_b, q): the best direction per patch, with its component's energy and gap.

    Directions interact where a patch may take either, where they pay a pair cost, or where patches
    that may take them pay a spatial one. What doesn't interact is solved apart, each component (named
    by its smallest direction) in a task, so a problem of any number of components is spread over the
    cluster; a component of over most variables is an error, as its search isn't divided. Of repeated
    costs and spatial rows the least and the largest count, repeated pairs add up; rows with a null
    are left out; no costs give no rows.
    """
    own = cut(costs.groupBy(F.col("gid").cast("long").alias("gid"), F.col("did").cast("long").alias("did")).agg(F.min(F.col("q").cast("double")).alias("q")).dropna())
    ways = own.select("did").distinct()
    both = pairs.select(F.col("did_a").cast("long").alias("i"), F.col("did_b").cast("long").alias("j"), F.col("cost").cast("double").alias("q")).where("q > 0 and i <> j")
    both = both.groupBy("i", "j").agg(F.sum("q").alias("q"))
    both = both.join(ways.toDF("i"), "i", "left_semi").join(ways.toDF("j"), "j", "left_semi").select("i", "j", "q")
    first = own.groupBy("gid").agg(F.min("did").alias("first"))
    links = own.join(first, "gid").select(F.col("first").alias("src"), F.col("did").alias("dst")).union(both.select("i", "j"))
    near = None
    if spatial is not None:
        near = spatial.select(F.col("gid_a").cast("long").alias("i"), F.col("gid_b").cast("long").alias("j"), F.col("q").cast("double").alias("q")).where("q > 0 and i <> j").groupBy("i", "j").agg(F.max("q").alias("q"))
        near = cut(near.join(first.toDF("i", "src"), "i").join(first.toDF("j", "dst"), "j"))
        links = links.union(near.select("src", "dst"))
    part = graph.components(links)
    mine = lambda df, key: df.join(part.withColumnRenamed("node", key), key)
    tagged = mine(own, "did").select("component", F.lit(0).alias("kind"), F.col("gid").alias("i"), F.col("did").alias("j"), "q")
    largest = tagged.groupBy("component").count().agg(F.max("count")).first()[0] or 0
    if largest > most:
        raise ValueError(f"{largest} variables interact, over {most}; limit the candidates first")
    tagged = tagged.union(mine(both, "i").select("component", F.lit(1), "i", "j", "q"))
    if near is not None:
        tagged = tagged.union(mine(near, "src").select("component", F.lit(2), "i", "j", "q"))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        terms = [{(int(i), int(j)): float(q) for i, j, q in zip(own.i, own.j, own.q, strict=True)} for own in (rows[rows.kind == k] for k in range(3))]
        energy, choice, gap = solve(*terms, most_nodes=most_nodes)
        return pd.DataFrame({"component": int(rows.component.iloc[0]), "gid": list(choice), "did": list(choice.values()), "energy": energy, "gap": gap})

    return cut(tagged.groupBy("component").applyInPandas(one, "component long, gid long, did long, energy double, gap double"))
