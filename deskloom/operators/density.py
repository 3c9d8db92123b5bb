"""Density clusters of vectors within groups, by a group's size: hierarchical density clusters, a sweep of their least size, or average links.

Vectors are scaled to length 1. Distances between them give a minimum spanning tree,
and its edges, lightest first, a hierarchy: a component of the least size is a
cluster, which lives until it meets another one. Clusters that last longer than
those they hold are chosen, the whole group never; what lies in none is noise, and
is clustered once more with a smaller least size.

Groups of up to LOCAL rows are a task each. Larger ones are compared in blocks: the
tree grows by Borůvka rounds, in which only points whose nearest one outside is no
longer outside, and might be nearer than their component's best, search again; its
edges are then folded by levels of a bounded number, the state of components kept in
a table between them. Average links merge all pairs of clusters that are each
other's nearest in a round, which gives the same clusters as one after the other. A
merged cluster is no nearer to a third than the nearer of its two was, so only
clusters that were merged, or whose nearest was, search again, and those without a
near enough one are done. Large groups search in blocks until so few clusters are left
that one task can merge the rest.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskloom.stores import numbered_by, stored

#: Sizes of the tiers, the large tier's least cluster, the shares of a group that the middle tier tries, similarity of average links, least size of recovered clusters.
LARGE_GROUP, SMALL_GROUP, LEAST_CLUSTER = 200, 30, 15
SHARES = (0.03, 0.05, 0.08, 0.12, 0.18, 0.25)
LINKED, RECOVERED = 0.65, 5
#: Share of the least noise within which trials count as equal.
TOLERANCE = 0.05
#: Rows of a group that one task takes, rows of a block of candidates and of one of searching points, and edges folded at once.
LOCAL, BLOCK, ASKS, LEVEL = 2000, 4096, 16_384, 500_000
TILE = 512
#: Rows of blocks that average links meet in, and components of a group's cluster means (32 MB) that one task merges, their nearest ones known.
LINKS, MEANS = 16_384, 4_000_000
#: Squared distances are rounded to 12 digits, so this is the least one above 0; copies count as being so near.
NEAREST = 1e-6


def unit(vectors: np.ndarray) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, rounded so that copies have 0."""
    return np.round(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T), 0), 12)


def local_tree(x: np.ndarray) -> list[tuple[int, int, float]]:
    """The edges (a, b, distance), a < b, of the minimum spanning tree by Prim; equal distances by a, then b. Sorted so."""
    n, d2 = len(x), squares(x, x)
    rows = np.arange(n)
    best, pair = d2[0].copy(), rows.copy()
    best[0], outside, out = np.inf, np.ones(n, bool), []
    outside[0] = False
    for _ in range(n - 1):
        least = best[outside].min()
        tied = np.flatnonzero(outside & (best == least))
        v = tied[np.argmin(pair[tied])]
        out.append((int(pair[v] // n), int(pair[v] % n), float(np.sqrt(least))))
        outside[v] = False
        own = np.minimum(v, rows) * n + np.maximum(v, rows)
        nearer = outside & ((d2[v] < best) | ((d2[v] == best) & (own < pair)))
        best[nearer], pair[nearer] = d2[v][nearer], own[nearer]
    return sorted(out, key=lambda e: (e[2], e[0], e[1]))


@dataclass
class Component:
    """A component of the tree's lighter edges: its points while it is too small, then its cluster, the sum of its points' last densities, and what its closed clusters are worth."""

    size: int = 1
    points: list = field(default_factory=list)
    cluster: int | None = None
    total: float = 0.0
    within: float | None = None


def fold(edges, known: dict[int, Component], least: int):
    """(components by root, root of each merged one, [(point, cluster)], [(cluster, parent, chosen)]) after edges in order.

    known: components that earlier edges made, by their smallest point; others are
    single points. A cluster's name is the root that the edge which makes it ends.
    """
    up, found, placed, closed = {}, dict(known), [], []

    def root(p: int) -> int:
        while p in up:
            if up[p] in up:
                up[p] = up[up[p]]
            p = up[p]
        return p

    def close(c: Component, density: float, parent: int) -> float:
        worth = c.total - c.size * density
        chosen = c.within is None or worth >= c.within
        closed.append((c.cluster, parent, chosen))
        return worth if chosen else c.within

    for a, b, distance in edges:
        a, b = sorted((root(a), root(b)))
        one, two, density = found.pop(a, None) or Component(points=[a]), found.pop(b, None) or Component(points=[b]), 1 / max(distance, NEAREST)
        up[b], size = a, one.size + two.size
        if one.cluster is not None and two.cluster is not None:
            found[a] = Component(size, [], b, size * density, close(one, density, b) + close(two, density, b))
        elif one.cluster is not None or two.cluster is not None:
            big, small = (one, two) if one.cluster is not None else (two, one)
            placed += [(p, big.cluster) for p in small.points]
            found[a] = Component(size, [], big.cluster, big.total + small.size * density, big.within)
        elif size >= least:
            placed += [(p, b) for p in one.points + two.points]
            found[a] = Component(size, [], b, size * density)
        else:
            found[a] = Component(size, one.points + two.points)
    return found, {p: root(p) for p in up}, placed, closed


def condensed(n: int, edges: list, least: int) -> np.ndarray:
    """A group's labels: the chosen cluster that holds a point, or -1 for noise."""
    _, _, placed, closed = fold(edges, {}, max(2, min(least, n)))
    above, label = {c: (parent, chosen) for c, parent, chosen in closed}, np.full(n, -1)
    top: dict[int, int] = {}

    def chosen_one(c: int) -> int:
        path = []
        while c not in top and c in above:
            path.append(c)
            c = above[c][0]
        best = top.get(c, -1)
        for c in reversed(path):
            best = best if best >= 0 else c if above[c][1] else -1
            top[c] = best
        return best

    for p, c in placed:
        label[p] = chosen_one(c)
    return label


def most_similar(similar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, similarity) of each row's largest, rounded to 12 digits; of equal ones the first."""
    rows, most = np.arange(len(similar)), np.round(similar.max(axis=1), 12)
    at = (similar >= most[:, None] - 1e-12).argmax(axis=1)
    # the first may be off by a digit, so rows in which it is are rounded throughout
    off = np.flatnonzero(np.round(similar[rows, at], 12) != most)
    at[off] = np.round(similar[off], 12).argmax(axis=1)
    return at, most


def nearest_means(means: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """most_similar among the other means, for the rows asked."""
    found = [(np.zeros(0, int), np.zeros(0))]
    for low in range(0, len(asked), TILE):
        some = asked[low : low + TILE]
        similar = means[some] @ means.T
        similar[np.arange(len(some)), some] = -np.inf
        found.append(most_similar(similar))
    near, similar = (np.concatenate(c) for c in zip(*found))
    return near, similar


def linked(x: np.ndarray, least: float = LINKED, sizes: np.ndarray | None = None, known: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Average links: clusters, named by their first row, are merged, pairs that are each other's most similar at once, while their mean similarity is least or more.

    Copies are a cluster from the start, but for zeros, which are like nothing. sizes,
    known: rows of each cluster of which x has the means, without copies, and its
    nearest_means.
    """
    label = np.arange(len(x))
    if known is None:
        _, first, which = np.unique(x, axis=0, return_index=True, return_inverse=True)
        label = np.where(x.any(axis=1) & (least <= 1), first[which.reshape(-1)], label)
        ids, sizes = np.unique(label, return_counts=True)
        means, sizes = x[ids], sizes.astype(float)
        near, similar = nearest_means(means, np.arange(len(ids)))
    else:
        ids, means, sizes, (near, similar) = label, x.copy(), sizes.astype(float), known
    while True:
        rows = np.arange(len(ids))
        a = np.flatnonzero((near[near] == rows) & (rows < near) & (similar >= least))
        if not len(a):
            return label
        b = near[a]
        means[a] = (means[a] * sizes[a, None] + means[b] * sizes[b, None]) / (sizes[a] + sizes[b])[:, None]
        sizes[a] += sizes[b]
        to = np.arange(len(x))
        to[ids[b]] = ids[a]
        label = to[label]
        moved = np.zeros(len(ids), bool)
        moved[a] = moved[b] = True
        left = moved | (similar >= least)
        left[b] = False
        place, stale = np.cumsum(left) - 1, (moved | moved[near] | ~left[near])[left]
        ids, means, sizes, near, similar = ids[left], means[left], sizes[left], place[near[left]], similar[left]
        again = np.flatnonzero(stale)
        near[again], similar[again] = nearest_means(means, again)


def sizes_tried(n: int) -> list[int]:
    return sorted({max(3, int(round(n * f))) for f in SHARES})


def best_trial(trials: list[tuple[int, int, int]]) -> int | None:
    """Of trials (least size, clusters, noise) in order, the place of the best with a cluster: little noise first, then the longest run of equal numbers of clusters, then few clusters, then the larger size."""
    some = [i for i, t in enumerate(trials) if t[1]]
    if not some:
        return None
    fewest = min(trials[i][2] for i in some)
    run = []
    for i, t in enumerate(trials):
        run.append(run[-1] if i and trials[i - 1][1] == t[1] else i)
    near = [i for i in some if trials[i][2] <= fewest + max(1, round(fewest * TOLERANCE))]
    return min(near, key=lambda i: (-run.count(run[i]), trials[i][1], -trials[i][0]))


def local_groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, str]:
    """(labels, recovered, method) of a group's unit vectors: labels are any numbers, -1 for noise."""
    n, recovered = len(x), np.zeros(len(x), bool)
    label, method, least = None, "density", LEAST_CLUSTER
    if n >= LARGE_GROUP:
        label = condensed(n, local_tree(x), least)
    elif n >= SMALL_GROUP:
        tree, tried = local_tree(x), sizes_tried(n)
        labels = [condensed(n, tree, m) for m in tried]
        best = best_trial([(m, len(set(y[y >= 0])), int((y < 0).sum())) for m, y in zip(tried, labels)])
        if best is not None:
            label, method, least = labels[best], "swept", tried[best]
    if label is None or not (label >= 0).any():
        return linked(x), recovered, "linked"
    rest = np.flatnonzero(label < 0)
    if len(rest) >= 2 * RECOVERED:
        again = condensed(len(rest), local_tree(x[rest]), max(RECOVERED, least // 2))
        recovered[rest] = again >= 0
        label[rest] = np.where(again >= 0, again + n, -1)
    return label, recovered, method


# groups that are too large for one task


def _shuffled(df: DataFrame) -> DataFrame:
    """df for a join that shuffles: rounds are many and their tables small as files, so broadcasts would add up in the driver."""
    return df.hint("merge")


def _search(rows: DataFrame, asks: DataFrame, similar: bool = False) -> DataFrame:
    """(grp, id, d, other): for each of asks (grp, id, comp) the row of its group nearest to it of those in another component, ties to the smaller id.

    rows: grp, id, comp, v. d is the squared distance, or the mean similarity's
    negative, for which each row is a component. Blocks of candidates meet blocks of searching points; each pair of blocks
    sends one row a point.
    """
    block, grid = (LINKS, LINKS) if similar else (BLOCK, ASKS)
    n = rows.groupBy("grp").agg(F.count("*").alias("n"))
    n = n.select("grp", F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.ceil(F.col("n") / grid).cast("int").alias("grids"))
    deal = lambda to, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(to)).cast("int")
    every = lambda to: F.explode(F.sequence(F.lit(0), F.col(to) - 1))
    there = rows.join(n, "grp").select("grp", "id", "comp", "v", F.lit(False).alias("asks"), deal("blocks", 1).alias("block"), every("grids").alias("grid"))
    here = asks.select("grp", "id", "comp").join(_shuffled(rows.select("grp", "id", "v")), ["grp", "id"]).join(n, "grp")
    here = here.select("grp", "id", "comp", "v", F.lit(True).alias("asks"), deal("grids", 2).alias("grid"), every("blocks").alias("block"))

    def run(block: pd.DataFrame) -> pd.DataFrame:
        them, me = block[~block["asks"]].sort_values("id"), block[block["asks"]]
        out = pd.DataFrame({"grp": block["grp"].iat[0], "id": me["id"], "d": np.inf, "other": -1})
        if len(them) and len(me):
            y, ids, comps, found = np.stack(them["v"].to_numpy()), them["id"].to_numpy(), them["comp"].to_numpy(), []
            for low in range(0, len(me), TILE):
                some = me.iloc[low : low + TILE]
                x = np.stack(some["v"].to_numpy())
                if similar:
                    s, own = x @ y.T, some["id"].to_numpy()
                    at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
                    same = np.flatnonzero(ids[at] == own)
                    s[same, at[same]] = -np.inf
                    at, most = most_similar(s)
                    found.append((-most, ids[at]))
                    continue
                d = squares(x, y)
                d[some["comp"].to_numpy()[:, None] == comps[None]] = np.inf
                at = d.argmin(axis=1)
                found.append((d[np.arange(len(at)), at], ids[at]))
            out["d"], out["other"] = (np.concatenate(c) for c in zip(*found))
        return out[np.isfinite(out["d"])]

    met = there.unionByName(here).groupBy("grp", "block", "grid").applyInPandas(run, "grp long, id long, d double, other long")
    best = met.groupBy("grp", "id").agg(F.min(F.struct("d", "other")).alias("b"))
    return best.select("grp", "id", "b.d", "b.other")


def _roots(links: DataFrame) -> DataFrame:
    """(grp, comp, root) of links (grp, comp, to), one a component: each leads to a pair that link to each other, whose smaller one is the root."""
    back = links.select("grp", F.col("comp").alias("to"), F.col("to").alias("back"))
    up = links.join(_shuffled(back), ["grp", "to"]).select("grp", "comp", F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("to")), F.col("comp")).otherwise(F.col("to")).alias("root"))
    up = stored(up, "up")
    while True:
        far = up.join(_shuffled(up.select("grp", F.col("comp").alias("root"), F.col("root").alias("far"))), ["grp", "root"])
        if far.where("far <> root").isEmpty():
            return up
        up = stored(far.select("grp", "comp", F.col("far").alias("root")), "up")


def spanning_tree(rows: DataFrame) -> DataFrame:
    """(grp, a, b, distance), a < b: the minimum spanning tree of each group of rows (grp, id, v), equal distances by a, then b."""
    state = rows.select("grp", "id", F.col("id").alias("comp"))
    state = stored(state.join(_shuffled(_search(rows.join(_shuffled(state), ["grp", "id"]), state)), ["grp", "id"], "left"), "state")
    tree = None
    pair = F.struct("d", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), F.col("other_comp").alias("to"))
    while True:
        there = state.select("grp", F.col("id").alias("other"), F.col("comp").alias("other_comp"))
        rest = state.where("other IS NOT NULL").join(_shuffled(there), ["grp", "other"])
        known = rest.where("comp <> other_comp").groupBy("grp", "comp").agg(F.min(pair).alias("best"))
        stale = rest.where("comp = other_comp").join(_shuffled(known), ["grp", "comp"], "left").where(F.col("best").isNull() | (F.col("d") <= F.col("best.d")))
        stale = stored(stale.select("grp", "id", "comp"), "stale")
        fresh = _search(rows.join(_shuffled(state.select("grp", "id", "comp")), ["grp", "id"]), stale).withColumn("fresh", F.lit(True))
        # a point that searched in vain has nothing outside its component, which is then the whole group
        asked = state.join(_shuffled(stale.select("grp", "id", F.lit(True).alias("asked"))), ["grp", "id"], "left").join(_shuffled(fresh.withColumnsRenamed({"d": "d2", "other": "other2"})), ["grp", "id"], "left")
        state = stored(asked.select("grp", "id", "comp", F.when(F.col("asked"), F.col("d2")).otherwise(F.col("d")).alias("d"), F.when(F.col("asked"), F.col("other2")).otherwise(F.col("other")).alias("other")), "state")
        there = state.select("grp", F.col("id").alias("other"), F.col("comp").alias("other_comp"))
        best = state.where("other IS NOT NULL").join(_shuffled(there), ["grp", "other"]).where("comp <> other_comp").groupBy("grp", "comp").agg(F.min(pair).alias("best"))
        best = stored(best, "best")
        if best.isEmpty():
            break
        edges = best.select("grp", "best.a", "best.b", F.sqrt("best.d").alias("distance")).distinct()
        tree = edges if tree is None else tree.unionByName(edges)
        roots = _roots(best.select("grp", "comp", F.col("best.to").alias("to")))
        state = stored(state.join(_shuffled(roots), ["grp", "comp"]).select("grp", "id", F.col("root").alias("comp"), "d", "other"), "state")
    empty = state.select("grp", F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("distance")).limit(0)
    return stored(empty if tree is None else tree, "tree")


_FOLDED = "grp long, kind string, id long, to long, chosen boolean, size long, points array<long>, total double, within double"


def _level(least: int):
    def run(key: tuple, edges: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        none = lambda v: None if v is None or v != v else v
        known = {int(s.id): Component(int(s.size), [int(p) for p in s.points], None if none(s.to) is None else int(s.to), s.total, none(s.within)) for s in states.itertuples()}
        order = edges.sort_values(["distance", "a", "b"])
        found, roots, placed, closed = fold(zip(order["ca"].tolist(), order["cb"].tolist(), order["distance"].tolist()), known, least)
        blank = (None, None, None, None, None)
        out = [("root", c, r, *blank) for c, r in roots.items()] + [("root", c, c, *blank) for c in found if c not in roots]
        out += [("point", p, c, *blank) for p, c in placed] + [("cluster", c, p, s, *blank[1:]) for c, p, s in closed]
        out += [("state", r, c.cluster, None, c.size, c.points, c.total, c.within) for r, c in found.items()]
        frame = pd.DataFrame(out, columns=["kind", "id", "to", "chosen", "size", "points", "total", "within"], dtype=object)
        frame.insert(0, "grp", key[0])
        return frame

    return run


def condensed_groups(rows: DataFrame, tree: DataFrame, least: int) -> DataFrame:
    """(grp, id, label): the labels of rows (grp, id) by their spanning tree, null for noise; at most LEVEL edges are folded at once."""
    placed = stored(numbered_by(tree, "place", "grp", "distance", "a", "b"), "placed")
    first = placed.groupBy("grp").agg(F.min("place").alias("first"))
    leveled = stored(placed.join(first, "grp").withColumn("level", F.floor((F.col("place") - F.col("first")) / LEVEL)).drop("place", "first"), "leveled")
    most = (leveled.agg(F.max("level")).first()[0] or 0) + 1 if not leveled.isEmpty() else 0
    comps = rows.select("grp", "id", F.col("id").alias("comp"))
    states, parts = None, []
    for level in range(most):
        own = lambda c: comps.select("grp", F.col("id").alias(c), F.col("comp").alias(f"c{c}"))  # noqa: B023, E731
        edges = stored(leveled.where(F.col("level") == level).join(_shuffled(own("a")), ["grp", "a"]).join(_shuffled(own("b")), ["grp", "b"]), "edges")
        touched = edges.select("grp", F.col("ca").alias("id")).unionByName(edges.select("grp", F.col("cb").alias("id"))).distinct()
        if states is None:
            states = comps.select("grp", "id", F.lit(None).cast("long").alias("to"), F.lit(1).cast("long").alias("size"), F.array().cast("array<long>").alias("points"), F.lit(0.0).alias("total"), F.lit(None).cast("double").alias("within")).limit(0)
        met = edges.groupBy("grp").cogroup(states.join(_shuffled(touched), ["grp", "id"], "left_semi").groupBy("grp")).applyInPandas(_level(least), _FOLDED)
        out = stored(met, "folded")
        parts.append(out)
        fresh = out.where("kind = 'state'").select("grp", "id", "to", "size", "points", "total", "within")
        states = stored(states.join(_shuffled(touched), ["grp", "id"], "left_anti").unionByName(fresh), "states")
        roots = out.where("kind = 'root'").select("grp", F.col("id").alias("comp"), F.col("to").alias("root"))
        comps = stored(comps.join(_shuffled(roots), ["grp", "comp"], "left").select("grp", "id", F.coalesce("root", "comp").alias("comp")), "comps")
    if not parts:
        return rows.select("grp", "id", F.lit(None).cast("long").alias("label"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    points = every.where("kind = 'point'").select("grp", "id", F.col("to").alias("cluster"))
    # the highest chosen cluster above each: paths of parents, twice as long each time
    up = every.where("kind = 'cluster'").select("grp", F.col("id").alias("cluster"), F.col("to").alias("up"), F.when(F.col("chosen"), F.col("id")).alias("label"))
    up = stored(up, "clusters")
    while True:
        above = up.select("grp", F.col("cluster").alias("up"), F.col("up").alias("up2"), F.col("label").alias("label2"))
        far = stored(up.join(_shuffled(above), ["grp", "up"], "left").select("grp", "cluster", F.col("up2").alias("up"), F.coalesce("label2", "label").alias("label")), "clusters")
        up = far
        if far.where("up IS NOT NULL").isEmpty():
            break
    return rows.select("grp", "id").join(_shuffled(points), ["grp", "id"], "left").join(_shuffled(up.select("grp", "cluster", "label")), ["grp", "cluster"], "left").select("grp", "id", "label")


def linked_groups(rows: DataFrame, least: float = LINKED) -> DataFrame:
    """(grp, id, label): average links of rows (grp, id, v), as linked gives them."""
    # copies are a cluster from the start
    apart = rows.withColumn("own", F.when(F.exists("v", lambda x: x != 0) & F.lit(least <= 1), F.lit(0)).otherwise(F.col("id")))
    firsts = stored(apart.groupBy("grp", "v", "own").agg(F.min("id").alias("label"), F.count("*").alias("n")), "firsts")
    own = apart.join(_shuffled(firsts), ["grp", "v", "own"]).select("grp", "id", "label")
    means = firsts.select("grp", F.col("label").alias("id"), F.col("label").alias("comp"), "v", "n")
    near = _search(means, means, similar=True).where(F.col("d") <= -least)
    state = stored(means.join(_shuffled(near), ["grp", "id"]), "means")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, other = pdf["id"].to_numpy(), pdf["other"].to_numpy()
        at = np.minimum(np.searchsorted(ids, other), len(ids) - 1)
        similar = np.where(ids[at] == other, -pdf["d"].to_numpy(), -np.inf)
        to = ids[linked(np.stack(pdf["v"].to_numpy()), least, pdf["n"].to_numpy(), (at, similar))]
        return pd.DataFrame({"grp": key[0], "id": ids, "to": to})[to != ids]

    def relabelled(own: DataFrame, to: DataFrame) -> DataFrame:
        return own.join(_shuffled(to.withColumnRenamed("id", "label")), ["grp", "label"], "left").select("grp", "id", F.coalesce("to", "label").alias("label"))

    while True:
        sizes = stored(state.groupBy("grp").agg((F.count("*") * F.max(F.size("v")) > MEANS).alias("large")), "sizes")
        few = state.join(sizes.where("NOT large"), "grp", "left_semi")
        own = stored(relabelled(own, few.groupBy("grp").applyInPandas(run, "grp long, id long, to long")), "linked")
        if sizes.where("large").isEmpty():
            return own
        state = state.join(sizes.where("large"), "grp", "left_semi")
        back = state.select("grp", F.col("id").alias("other"), F.col("other").alias("back"))
        pairs = state.join(_shuffled(back), ["grp", "other"]).where("back = id AND id < other").select("grp", F.col("id").alias("a"), F.col("other").alias("b"))
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            return own
        own = relabelled(own, pairs.select("grp", F.col("b").alias("id"), F.col("a").alias("to")))
        merged = pairs.select("grp", F.explode(F.array("a", "b")).alias("id"), F.col("a").alias("to"))
        gone = merged.select("grp", F.col("id").alias("other"), F.lit(True).alias("lost"))
        moved = state.join(_shuffled(merged), ["grp", "id"], "left").join(_shuffled(gone), ["grp", "other"], "left")
        moved = moved.select("grp", F.coalesce("to", "id").alias("id"), "n", "v", "d", "other", (F.col("to").isNotNull() | F.col("lost").isNotNull()).alias("stale"))
        # a pair at most meets, so its mean is that of two vectors
        both = moved.groupBy("grp", "id").agg(F.collect_list(F.struct("n", "v")).alias("p"), F.sum("n").alias("n"), F.max("stale").alias("stale"), F.first("d").alias("d"), F.first("other").alias("other"))
        mean = F.transform(F.get("p", F.lit(0))["v"], lambda _, i: F.aggregate("p", F.lit(0.0), lambda acc, x: acc + x["n"] * F.get(x["v"], i)) / F.col("n"))
        # a cluster that wasn't merged keeps its vector to the last bit
        means = stored(both.select("grp", "id", F.col("id").alias("comp"), F.when(F.size("p") > 1, mean).otherwise(F.get("p", F.lit(0))["v"]).alias("v"), "n", "stale", "d", "other"), "moved")
        again = means.where("stale").drop("d", "other")
        again = again.join(_shuffled(_search(means, again, similar=True).where(F.col("d") <= -least)), ["grp", "id"])
        state = stored(means.where("NOT stale").unionByName(again).drop("stale"), "means")


def _large(rows: DataFrame) -> DataFrame:
    """(grp, id, label, recovered, method) of groups above LOCAL, all of which are of the large tier."""
    dense = stored(condensed_groups(rows, spanning_tree(rows), LEAST_CLUSTER), "labels")
    some = stored(dense.groupBy("grp").agg(F.count("label").alias("found"), F.count_if(F.col("label").isNull()).alias("noise")), "found")
    none = some.where("found = 0").select("grp")
    bare = linked_groups(rows.join(none, "grp", "left_semi")).select("grp", "id", "label", F.lit(False).alias("recovered"), F.lit("linked").alias("method")) if not none.isEmpty() else None
    again = some.where(f"found > 0 AND noise >= {2 * RECOVERED}").select("grp")
    rest = stored(rows.join(_shuffled(dense.where("label IS NULL")), ["grp", "id"]).join(again, "grp", "left_semi").select("grp", "id", "v"), "rest")
    more = condensed_groups(rest, spanning_tree(rest), max(RECOVERED, LEAST_CLUSTER // 2)).select("grp", "id", F.col("label").alias("label2"))
    out = dense.join(some.where("found > 0").select("grp"), "grp", "left_semi").join(_shuffled(more), ["grp", "id"], "left")
    out = out.select("grp", "id", F.coalesce("label", "label2").alias("label"), F.col("label2").isNotNull().alias("recovered"), F.lit("density").alias("method"))
    return out if bare is None else out.unionByName(bare)


def _named(vectors: DataFrame, group: str, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(grp, n, id, v) with vectors of length 1 and their group's number and size, and (grp, g, n): the groups, null too."""
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(group).alias("g"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda acc, a: acc + a * a))
    rows = stored(rows.select("g", "id", F.transform("x", lambda a: a / F.greatest(size, F.lit(1e-12))).alias("v")), "unit")
    groups = stored(rows.groupBy("g").agg(F.count("*").alias("n")).withColumn("grp", F.monotonically_increasing_id()), "groups")
    return rows.join(groups, rows["g"].eqNullSafe(groups["g"])).select("grp", "n", "id", "v"), groups


def average_links(vectors: DataFrame, group: str, key: str, least: float = LINKED, vector: str = "embedding", local: int = LOCAL) -> DataFrame:
    """(group, key, cluster): within each group, average-link clusters by cosine, merged while the mean similarity of two is least or more.

    A cluster is named by its smallest key. Nulls, keys and local are as for density_clusters.
    """
    named, groups = _named(vectors, group, key, vector)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        return pd.DataFrame({"grp": key[0], "id": pdf["id"], "label": pdf["id"].to_numpy()[linked(np.stack(pdf["v"].to_numpy()), least)]})

    out = named.where(F.col("n") <= local).groupBy("grp").applyInPandas(run, "grp long, id long, label long")
    if not groups.where(F.col("n") > local).isEmpty():
        out = out.unionByName(linked_groups(stored(named.where(F.col("n") > local).select("grp", "id", "v"), "large"), least))
    return out.join(groups, "grp").select(F.col("g").alias(group), F.col("id").alias(key), F.col("label").alias("cluster"))


def density_clusters(vectors: DataFrame, group: str = "label", key: str = "vec_id", vector: str = "embedding", local: int = LOCAL) -> DataFrame:
    """(group, key, cluster, recovered, method) for every row whose vector isn't null.

    Groups of LARGE_GROUP rows and more have density clusters of LEAST_CLUSTER rows at
    least (density); those of SMALL_GROUP and more the best of several least sizes
    (swept); smaller ones, and those in which no density cluster is found, average
    links (linked). Noise is clustered once more with half the least size; clusters
    found so are recovered. cluster numbers a group's clusters from 0, recovered ones
    after the others, larger ones first, of equal ones that with the smaller key; noise
    has null. A null group is a group. key is a whole number, unique within a group;
    vectors have one length and no null or non-finite component.

    local: groups of more rows are compared in blocks by several tasks; at least
    LARGE_GROUP. Both ways give the same clusters.
    """
    local = max(local, LARGE_GROUP)
    named, groups = _named(vectors, group, key, vector)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        label, recovered, method = local_groups(np.stack(pdf["v"].to_numpy()))
        return pd.DataFrame({"grp": key[0], "id": pdf["id"], "label": label, "recovered": recovered, "method": method})

    out = named.where(F.col("n") <= local).groupBy("grp").applyInPandas(run, "grp long, id long, label long, recovered boolean, method string")
    out = out.withColumn("label", F.when(F.col("label") >= 0, F.col("label")))
    if not groups.where(F.col("n") > local).isEmpty():
        out = out.unionByName(_large(stored(named.where(F.col("n") > local).select("grp", "id", "v"), "large")))
    out = stored(out, "clusters")
    sizes = out.where("label IS NOT NULL").groupBy("grp", "recovered", "label").agg((-F.count("*")).alias("size"), F.min("id").alias("first"))
    placed = stored(numbered_by(sizes, "place", "grp", "recovered", "size", "first"), "placed")
    start = placed.groupBy("grp").agg(F.min("place").alias("start"))
    numbers = placed.join(start, "grp").select("grp", "recovered", "label", (F.col("place") - F.col("start")).alias("cluster"))
    done = out.join(_shuffled(numbers), ["grp", "recovered", "label"], "left").join(groups.select("grp", "g"), "grp")
    return done.select(F.col("g").alias(group), F.col("id").alias(key), "cluster", "recovered", "method")
