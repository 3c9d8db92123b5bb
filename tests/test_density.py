"""Density clusters and average links against versions that work from the top, or pair by pair."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from deskloom.operators import density

SHARES = (0.03, 0.05, 0.08, 0.12, 0.18, 0.25)


def kruskal(x):
    n, group = len(x), list(range(len(x)))
    pairs = sorted((round(max(0.0, float(((x[a] - x[b]) ** 2).sum())), 12), a, b) for a in range(n) for b in range(a + 1, n))
    out = []
    for d, a, b in pairs:
        if group[a] != group[b]:
            out.append((math.sqrt(d), a, b))
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    return out


def parts_of(points, edges):
    """Two sets, when the last of edges is taken away."""
    near = {p: [] for p in points}
    for _, a, b in edges[:-1]:
        near[a].append(b)
        near[b].append(a)
    seen, todo = {edges[-1][1]}, [edges[-1][1]]
    while todo:
        for q in near[todo.pop()]:
            if q not in seen:
                seen.add(q)
                todo.append(q)
    return seen, set(points) - seen


def from_the_top(points, edges, least, birth):
    """(worth, chosen clusters) of a cluster that begins at a density, its points' last densities summed."""
    whole, total = set(points), 0.0
    while True:
        own = [e for e in edges if e[1] in points and e[2] in points]
        density_ = 1 / max(own[-1][0], 1e-6)
        one, two = parts_of(points, own)
        if min(len(one), len(two)) >= least:
            total += len(points) * (density_ - birth)
            kids = [from_the_top(p, own, least, density_) for p in (one, two)]
            within = sum(k[0] for k in kids)
            return (total, [whole], [c for k in kids for c in k[1]]) if total >= within else (within, [c for k in kids for c in k[1]], [c for k in kids for c in k[1]])
        small, big = sorted((one, two), key=len)
        if len(big) < least:
            return total + len(points) * (density_ - birth), [whole], []
        total += len(small) * (density_ - birth)
        points = big


def brute_density(x, least):
    """The chosen clusters as sets, the whole group never among them."""
    n = len(x)
    least = max(2, min(least, n))
    if n < 2:
        return []
    found = from_the_top(set(range(n)), kruskal(x), least, 0.0)
    return found[2]


def brute_links(x, least=0.65):
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:
        best = max((round(float(np.mean([x[i] @ x[j] for i in g for j in h])), 12), -a, -b) for a, g in enumerate(groups) for b, h in enumerate(groups) if a < b)
        if best[0] < least:
            break
        groups[-best[1]] += groups.pop(-best[2])
    return [set(g) for g in groups]


def brute(x):
    n, least, method = len(x), 15, "density"
    found = []
    if n >= 200:
        found = brute_density(x, 15)
    elif n >= 30:
        tried = sorted({max(3, round(n * f)) for f in SHARES})
        trials = [(m, brute_density(x, m)) for m in tried]
        some = [(m, c) for m, c in trials if c]
        if some:
            noise = lambda c: n - sum(map(len, c))
            fewest = min(noise(c) for _, c in some)
            counts, runs = [len(c) for _, c in trials], {}
            for i, (m, _) in enumerate(trials):
                low = high = i
                while low and counts[low - 1] == counts[i]:
                    low -= 1
                while high + 1 < len(counts) and counts[high + 1] == counts[i]:
                    high += 1
                runs[m] = high - low + 1
            near = [(m, c) for m, c in some if noise(c) <= fewest + max(1, round(fewest * 0.05))]
            least, found = min(near, key=lambda t: (-runs[t[0]], len(t[1]), -t[0]))
            method = "swept"
    if not found:
        found, method = brute_links(x), "linked"
    order = lambda sets: sorted(sets, key=lambda s: (-len(s), min(s)))
    label = {i: (c, False) for c, s in enumerate(order(found)) for i in s}
    rest = [i for i in range(n) if i not in label]
    if method != "linked" and len(rest) >= 10:
        again = [{rest[i] for i in s} for s in brute_density(x[rest], max(5, least // 2))]
        label |= {i: (len(found) + c, True) for c, s in enumerate(order(again)) for i in s}
    return [(i, *label.get(i, (None, False)), method) for i in range(n)]


def planted(n, groups, spread, seed, scattered=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 8))
    x = centres[rng.integers(0, groups, n)] * 3 + rng.normal(size=(n, 8)) * spread
    some = rng.random(n) < scattered
    x[some] = rng.normal(size=(some.sum(), 8)) * 3
    return x


# each tier: groups of 300, 120, 25 and 3, and large ones without structure
CASES = {1: planted(300, 5, 0.4, 1), 2: planted(120, 4, 0.4, 2), 3: planted(25, 3, 0.5, 3), 4: planted(3, 1, 0.1, 4), 5: planted(220, 9, 0.8, 5, 0.4), None: planted(40, 2, 0.3, 6)}


@pytest.fixture(scope="module")
def table(spark):
    rows = [(g, 1000 * (g or 9) + i, [float(v) for v in x]) for g, xs in CASES.items() for i, x in enumerate(xs)]
    return spark.createDataFrame([*rows, (1, 1, None)], "label int, vec_id long, embedding array<double>").repartition(4)


def expected():
    return {(g, 1000 * (g or 9) + i): (c, recovered, method) for g, xs in CASES.items() for i, c, recovered, method in brute(density.unit(xs))}


def test_clusters_in_each_tier_are_those_of_brute_force(table):
    got = {(r["label"], r["vec_id"]): (r["cluster"], r["recovered"], r["method"]) for r in density.density_clusters(table).collect()}
    want = expected()
    assert got == want
    kinds = Counter(m for _, _, m in want.values())
    assert set(kinds) == {"density", "swept", "linked"}
    assert any(c is None for c, _, _ in want.values()) and any(r for _, r, _ in want.values())


def test_large_groups_in_blocks_and_levels_give_the_same(spark, table, monkeypatch):
    for name, value in (("BLOCK", 100), ("ASKS", 170), ("LEVEL", 120), ("TILE", 64)):
        monkeypatch.setattr(density, name, value)
    some = table.where("label = 1")
    got = {(r["label"], r["vec_id"]): (r["cluster"], r["recovered"], r["method"]) for r in density.density_clusters(some, local=200).collect()}
    assert got == {k: v for k, v in expected().items() if k[0] == 1}


def test_average_links_of_small_and_of_large_groups(spark):
    x = planted(60, 4, 0.5, 7)
    rows = spark.createDataFrame([(1, i, [float(v) for v in y]) for i, y in enumerate(x)] + [(2, 100, [1.0] * 8), (None, 200, [0.0] * 8)], "g int, k long, embedding array<double>")
    want = {i: min(s) for s in brute_links(density.unit(x), 0.5) for i in s} | {100: 100, 200: 200}
    for local in (1000, 20):
        assert {r["k"]: r["cluster"] for r in density.average_links(rows, "g", "k", least=0.5, local=local).collect()} == want


def test_copies_and_empty_tables(spark):
    schema = "label int, vec_id long, embedding array<double>"
    assert density.density_clusters(spark.createDataFrame([], schema)).count() == 0
    same = spark.createDataFrame([(1, i, [1.0, 0.0] if i < 20 else [0.0, 1.0]) for i in range(40)], schema)
    assert {(r["vec_id"] < 20, r["cluster"]) for r in density.density_clusters(same).collect()} == {(True, 0), (False, 1)}
    spread = spark.createDataFrame([(1, i, [math.cos(i / 70), math.sin(i / 70)]) for i in range(220)], schema)
    assert {r["method"] for r in density.density_clusters(spread).collect()} <= {"linked", "density"}


def test_rounds_join_by_shuffle(spark):
    rows = spark.createDataFrame([(0, i, i, [1.0, float(i)]) for i in range(4)], "grp long, id long, comp long, v array<double>")
    plan = density._search(rows, rows)._jdf.queryExecution().toString()
    assert "strategy=merge" in plan and "SortMergeJoin [grp" in plan


def links_table(spark):
    x = np.concatenate([planted(70, 4, 0.5, 11), np.zeros((3, 8)), np.repeat(planted(4, 2, 0.5, 12), 4, axis=0)])
    return x, spark.createDataFrame([(1, i, [float(v) for v in y]) for i, y in enumerate(x)], "g int, k long, embedding array<double>").repartition(3)


@pytest.mark.parametrize("means", [0, 150, 300, 1_000_000])
def test_average_links_by_rounds_and_by_one_task(spark, monkeypatch, means):
    x, rows = links_table(spark)
    monkeypatch.setattr(density, "MEANS", means)
    monkeypatch.setattr(density, "LINKS", 30)
    want = {i: min(s) for s in brute_links(density.unit(x), 0.3) for i in s}
    assert len(set(want.values())) > 5 and [want[i] for i in (70, 71, 72)] == [70, 71, 72]
    for local in (1000, 20):
        assert {r["k"]: r["cluster"] for r in density.average_links(rows, "g", "k", least=0.3, local=local).collect()} == want


def test_large_groups_search_for_all_clusters_once(spark, monkeypatch):
    x, rows = links_table(spark)
    sought, search = [], density._search
    monkeypatch.setattr(density, "_search", lambda them, asks, similar=False: sought.append(asks) or search(them, asks, similar))
    density.average_links(rows, "g", "k", least=0.3, local=20)
    assert len(sought) == 1 and sought[0].count() == 70 + 3 + 4  # copies are one


def test_copies_are_one_cluster_without_rounds(monkeypatch):
    asked, nearest = [], density.nearest_means
    monkeypatch.setattr(density, "nearest_means", lambda means, some: asked.append(len(some)) or nearest(means, some))
    x = density.unit(np.repeat(planted(5, 2, 0.5, 12), 200, axis=0))
    label = density.linked(x, 0.99)
    assert [int(v) for v in np.unique(label)] == [0, 200, 400, 600, 800] and asked[0] == 5 and sum(asked) < 20
