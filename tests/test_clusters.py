"""Communities, nearest-neighbour clusters and k-means against plain versions with the same tie rules."""

from __future__ import annotations

import math
import random
import struct
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from quillspark.operators import clustering, communities
from quillspark.plans import clusters as plans


def hashed(*longs):
    h = 42
    for x in longs:
        h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
    return h - (1 << 64) if h >> 63 else h


def quality(adjacent, own, strength, resolution):
    m2 = sum(strength.values())
    totals = defaultdict(float)
    for n, k in strength.items():
        totals[own[n]] += k
    inside = sum(w for u, near in adjacent.items() for v, w in near.items() if own[u] == own[v])
    return round(inside / m2 - resolution * sum(t * t for t in totals.values()) / (m2 * m2), 9)


def brute(adjacent, resolution=1.0, only_gains=True, pairs=10**9):
    """Moves by half rounds; adjacent: {u: {v: w}} both ways."""
    strength = {u: sum(near.values()) for u, near in adjacent.items()}
    own, m2, half = {u: u for u in adjacent}, sum(strength.values()), 0
    q = quality(adjacent, own, strength, resolution) if adjacent else 0
    while adjacent and half < 2 * pairs:
        new = dict(own)
        for _ in range(2):
            totals = defaultdict(float)
            for n, k in strength.items():
                totals[new[n]] += k
            moved = {}
            for u in adjacent:
                if hashed(u, half // 2) % 2 != half % 2:
                    continue
                into = defaultdict(float)
                for v, w in adjacent[u].items():
                    into[new[v]] += w
                gain = lambda c: round(into[c] - resolution * strength[u] * (totals[c] - (strength[u] if c == new[u] else 0)) / m2, 9)  # noqa: B023, E731
                here = gain(new[u])
                others = [(-gain(c), c) for c in list(into) if c != new[u]]
                if others and -min(others)[0] > (max(here, 0) if only_gains else here):
                    moved[u] = min(others)[1]
            new |= moved
            half += 1
        after = quality(adjacent, new, strength, resolution)
        if after <= q:
            break
        own, q = new, after
    least = {}
    for n, c in own.items():
        least[c] = min(n, least.get(c, n))
    return {n: least[c] for n, c in own.items()}


def adjacency(edges):
    out = defaultdict(lambda: defaultdict(float))
    for u, v, w in edges:
        if u is not None and v is not None and u != v:
            w = w if w and w > 0 else 1.0
            out[u][v] += w
            out[v][u] += w
    return out


@pytest.mark.parametrize("resolution", [1.0, 2.5])
def test_communities(spark, resolution):
    rng = random.Random(4)
    graphs = {}
    for g in range(4):  # dense groups with a few links between them
        nodes = rng.sample(range(1000), 24)
        graphs[g] = [(rng.choice(nodes[i * 6 : i * 6 + 6]), rng.choice(nodes[i * 6 : i * 6 + 6]), rng.choice([1.0, 2.0, 0.5, -1.0, None])) for i in range(4) for _ in range(18)]
        graphs[g] += [(rng.choice(nodes), rng.choice(nodes), 1.0) for _ in range(6)]
    graphs[4] = [(1, 1, 1.0), (None, 2, 1.0)]
    rows = [(g, *e) for g, edges in graphs.items() for e in edges]
    df = spark.createDataFrame(rows, "graph int, src long, dst long, weight double")
    got = {(r.graph, r.node): r.community for r in communities.detect(df, resolution).collect()}
    want = {(g, n): c for g, edges in graphs.items() for n, c in brute(adjacency(edges), resolution).items()}
    assert got == want
    if resolution == 1.0:  # what a sequential walk finds isn't better by much
        assert all(quality(adjacency(graphs[g]), {n: got[g, n] for n in adjacency(graphs[g])}, {u: sum(x.values()) for u, x in adjacency(graphs[g]).items()}, 1.0) > 0.4 for g in range(4))
        return
    sizes = {(r.graph, r.community): r.size for r in communities.detect(df, resolution, least=4).collect()}
    members = defaultdict(int)
    for (g, _), c in want.items():
        members[g, c] += 1
    assert sizes == {c: n for c, n in members.items() if n >= 4}


def test_no_edges(spark):
    empty = spark.createDataFrame([], "graph int, src long, dst long, weight double")
    assert communities.detect(empty).count() == 0


def test_summary_input(spark):
    edges = [(0, 1, 2, 5.0), (0, 2, 3, 1.0), (0, 1, 3, 2.0), (0, 3, 9, 1.0), (0, 8, 9, 4.0)]
    members = [(0, 1, n) for n in (1, 2, 3)] + [(0, 8, n) for n in (8, 9)]
    names = [(0, n, f"n{n}") for n in (1, 2, 3, 8, 9)]
    out = communities.summary_input(spark.createDataFrame(members, "graph int, community long, node long"), spark.createDataFrame(edges, "graph int, src long, dst long, weight double"), spark.createDataFrame(names, "graph int, node long, name string"), 2, 2)
    assert {r.community: (r.members, r.relations) for r in out.collect()} == {1: (["n1", "n2"], ["n1 - n2", "n1 - n3"]), 8: (["n8", "n9"], ["n8 - n9"])}


def points(n=160, dims=8, seed=2):
    rng = np.random.default_rng(seed)
    return np.repeat(rng.standard_normal((5, dims)), n // 5, axis=0) + 0.25 * rng.standard_normal((n, dims))


def table(spark, x, ids=None):
    return spark.createDataFrame([(i, v) for i, v in zip(ids or range(len(x)), x.tolist(), strict=True)], "vec_id long, embedding array<double>")


def near(x, k):
    d = np.round(np.maximum(0, ((x[:, None] - x[None]) ** 2).sum(axis=2)), 9)
    return {i: [(int(j), d[i, j]) for j in sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[i, j], j))[:k]] for i in range(len(x))}


@pytest.mark.parametrize("block", [30, 4096])
def test_nearest_neighbours_are_exact(spark, block):
    x = points()
    got = defaultdict(list)
    for r in clustering.nearest_neighbours(table(spark, x), 7, block=block).orderBy("id", "d", "other").collect():
        got[r.id].append((r.other, r.d))
    want = near(x, 7)
    assert {i: [j for j, _ in v] for i, v in got.items()} == {i: [j for j, _ in v] for i, v in want.items()}
    assert all(math.isclose(a[1], b[1], abs_tol=2e-9) for i in want for a, b in zip(got[i], want[i], strict=True))


def test_neighbour_clusters(spark):
    x = points()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = defaultdict(dict)
    for i, row in near(unit, 10).items():
        for j, d in row:
            links[i][j] = links[j][i] = max(1 - d / 2, 1e-6)
    got = {r.id: r.cluster for r in clustering.neighbour_clusters(table(spark, x)).collect()}
    assert got == brute(links, only_gains=False, pairs=20)
    groups = [{got[i] for i in range(g * 32, g * 32 + 32)} for g in range(5)]
    assert sum(map(len, groups)) <= 12 and len(set().union(*groups)) >= 4
    odd = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in clustering.neighbour_clusters(odd).collect()] == [(5, 5, 1)]


def lloyd(x, centroids, seed, rounds=30):
    k, own, told = len(centroids), None, []
    for i in range(rounds):
        d = np.maximum(0, (x * x).sum(1)[:, None] + (centroids * centroids).sum(1)[None] - 2 * x @ centroids.T)
        new = d.argmin(axis=1)
        told.append(d.min(axis=1).sum())
        moved = own is None or (new != own).any()
        own, centroids = new, centroids.copy()
        for c in range(k):
            if (own == c).any():
                centroids[c] = x[own == c].mean(axis=0)
            else:
                centroids[c] = x[min(range(len(x)), key=lambda n: (chance(n, seed, k + i, c), n))]
        if not moved and len(set(own)) == k:
            break
    return own, centroids, told


def chance(n, *draw):
    return (((hashed(n, *draw) & ((1 << 64) - 1)) >> 11) + 0.5) / (1 << 53)


def first_seeds(x, k, seed):
    out = [x[min(range(len(x)), key=lambda n: chance(n, seed, 0))]]
    for i in range(1, k):
        d = np.min([((x - c) ** 2).sum(axis=1) for c in out], axis=0)
        out.append(x[min((n for n in range(len(x)) if d[n] > 1e-9), key=lambda n: -math.log(chance(n, seed, i)) / d[n])])
    return np.array(out)


@pytest.mark.parametrize("k", [1, 5, 23])
def test_k_means(spark, k):
    x, told = points(), []
    members, centroids = clustering.k_means(table(spark, x), k, seed=9, told=told)
    own, want, inertia = lloyd(x, first_seeds(x, k, 9), 9)
    assert [r.cluster for r in members.orderBy("id").collect()] == own.tolist()
    assert np.allclose(centroids, want) and np.allclose(told, inertia)
    assert all(a >= b - 1e-9 for a, b in zip(told, told[1:], strict=False))
    means = {r.cluster: (r.size, r.centroid) for r in clustering.centroids_of(members, table(spark, x)).collect()}
    assert all(np.allclose(means[c][1], want[c]) and means[c][0] == (own == c).sum() for c in range(k))


def test_k_means_edges(spark):
    x = np.array([[0.0, 1.0], [5.0, 5.0], [0.0, 1.0]])
    alone, centroids = clustering.k_means(table(spark, x, [7, 3, 9]), 5)
    assert {r.id: r.cluster for r in alone.collect()} == {3: 0, 7: 1, 9: 2} and np.allclose(centroids, x[[1, 0, 2]])
    start = np.array([[0.0, 0.0], [100.0, 100.0]])  # the second has no rows and starts anew
    many = np.vstack([points(40, 2, 3), points(40, 2, 5) + 9])
    own, want, _ = lloyd(many, start, 4)
    members, centroids = clustering.k_means(table(spark, many), 2, seed=4, start=start)
    assert [r.cluster for r in members.orderBy("id").collect()] == own.tolist() and np.allclose(centroids, want)
    same = table(spark, np.ones((9, 3)))
    assert {r.cluster for r in clustering.k_means(same, 3)[0].collect()} <= {0, 1, 2}
    with pytest.raises(ValueError, match="no vectors"):
        clustering.k_means(table(spark, x).limit(0), 2)
    with pytest.raises(ValueError, match="lengths"):
        clustering.k_means(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"), 1)


@pytest.mark.parametrize("name", ["community_summaries", "neighbour_clusters", "k_means_clusters"])
def test_registered(spark, name):
    out = plans.REGISTRY.queries[name](spark, "/root/testdata/sf0.001")
    assert out.count() > 0
