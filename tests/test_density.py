"""Density clusters against brute force: all distances, Kruskal, and a tree built merge by merge."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from agorametrics.operators import density as D
from agorametrics.operators.graph import components


def frame(spark, x):
    return spark.createDataFrame([(i * 3 + 5, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vector array<double>")


def blobs(seed, sizes, noise, dims=3):
    r = np.random.default_rng(seed)
    parts = [r.normal(0, 1, dims) * 12 + r.normal(0, 0.4 + 0.2 * k, (n, dims)) for k, n in enumerate(sizes)]
    return np.round(np.concatenate([*parts, r.uniform(-25, 25, (noise, dims))]), 3)


def brute_forest(x, min_samples):
    n = len(x)
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(axis=2), 0))
    order = [sorted((d[i, j], j) for j in range(n) if j != i)[:min_samples] for i in range(n)]
    core = [o[-1][0] if len(o) == min_samples else math.inf for o in order]
    edges = sorted({(max(d[i, j], core[i], core[j]), min(i, j), max(i, j)) for i in range(n) for _, j in order[i] if max(core[i], core[j]) < math.inf})
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    out = []
    for w, i, j in edges:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((w, i, j))
    return out


def brute_labels(n, forest, lengths, min_size):
    """Clusters of the tree in which all edges of a level join at once."""
    groups = {i: frozenset([i]) for i in range(n)}
    cluster, tree = {}, {}  # of a group; of a cluster: its groups by level, its children
    at = 0
    for length in lengths:
        met = [(i, j) for w, i, j in forest if at < w <= length or (at == 0 and w <= length)]
        at = length
        lam = 1 / max(length, D.LEAST)
        joined = defaultdict(set)
        new = dict(groups)
        for i, j in met:
            merged = new[i] | new[j]
            for k in merged:
                new[k] = merged
        for g in {v for k, v in new.items() if v != groups[k]}:
            for k in g:
                joined[g].add(groups[k])
        for g, olds in joined.items():
            big = [cluster[o] for o in olds if o in cluster]
            if len(big) == 1:
                k = big[0]
                tree[k]["sum"] += (len(g) - len(tree[k]["points"])) * lam
                tree[k]["points"] = g
                cluster[g] = k
            elif len(g) >= min_size:
                k = len(tree)
                tree[k] = {"sum": len(g) * lam, "points": g, "children": big, "top": True}
                for c in big:
                    tree[c] |= {"sum": tree[c]["sum"] - len(tree[c]["points"]) * lam, "top": False}
                cluster[g] = k
        groups = new
    tops = [k for k, c in tree.items() if c["top"]]
    value, own = {}, {}
    for k in sorted(tree):
        below = [value[c] for c in tree[k]["children"]]
        own[k] = (not below or tree[k]["sum"] >= sum(below) - 1e-12) and not (len(tops) < 2 and k in tops)
        value[k] = tree[k]["sum"] if own[k] else sum(below)
    out = [-1] * n

    def mark(k):
        if own[k]:
            for p in tree[k]["points"]:
                out[p] = min(tree[k]["points"])
        else:
            for c in tree[k]["children"]:
                mark(c)

    for k in tops:
        mark(k)
    return out


def test_components(spark):
    r = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 200, (120, 2))] + [(300 + i, 301 + i) for i in range(60)] + [(7, 7), (500, 500)]
    root = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize(("sizes", "noise", "levels"), [((14, 9), 3, 30), ((30, 18, 12), 10, 6)])
def test_equals_brute_force(spark, sizes, noise, levels):
    x = blobs(len(sizes) + levels, sizes, noise)
    points = frame(spark, x)
    want = brute_forest(x, 4)
    near = D.neighbours(points, 4)
    forest = D.spanning_forest(D.reachability(near, 4))
    ids = {i: i * 3 + 5 for i in range(len(x))}
    assert sorted((round(r.w, 6), r.a, r.b) for r in forest.collect()) == sorted((round(w, 6), ids[i], ids[j]) for w, i, j in want)
    lengths = D.level_lengths(forest, levels)
    assert len(lengths) <= levels and (levels == 30) == (len(lengths) == len({w for w, *_ in want}))
    # edges as long as a level, to the last digit, are of that level
    snapped = [(min(c for c in lengths if c >= w - 1e-9), i, j) for w, i, j in want]
    got = {r.id: r.cluster_id for r in D.clusters(points, 6, 4, levels).collect()}
    expected = brute_labels(len(x), snapped, lengths, 6)
    assert [got[ids[i]] for i in range(len(x))] == [-1 if c < 0 else ids[c] for c in expected]
    # the smaller set has no outlier, by brute force either
    assert len(set(got.values())) >= len(sizes) and (-1 in got.values()) == (-1 in expected) == (levels == 6)


def test_a_dense_spot_is_cut_into_windows(spark):
    """A third of all vectors are equal: small windows, many tasks, and they are one cluster all the same."""
    r = np.random.default_rng(3)
    x = np.concatenate([np.tile([[1.0, 2.0, 3.0]], (300, 1)), r.normal(20, 1, (200, 3)), r.uniform(-100, 100, (100, 3))])
    points = frame(spark, x).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    near = D.neighbours(points, 5, window=40)
    assert near.groupBy("id").count().where("count <> 5").count() == 0
    found = {r.id: r.cluster_id for r in D.clusters(points, 20, 5, 4, window=40).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {found[i * 3 + 5] for i in range(300)} == {5}
    others = [found[i * 3 + 5] for i in range(300, 500)]
    assert max(others.count(c) for c in set(others) - {-1}) > 120
    assert sum(found[i * 3 + 5] == -1 for i in range(500, 600)) > 60


def test_windows_carry_over_batches(spark):
    x = np.round(np.random.default_rng(5).normal(0, 1, (500, 2)), 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    got = sorted(map(tuple, D.neighbours(frame(spark, x), 3, window=1200).select("id", "other", F.round("d", 9)).collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for i in range(500):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        want += [(i * 3 + 5, j * 3 + 5, round(float(d[j]), 9)) for j in sorted((j for j in range(500) if j != i), key=lambda j: (round(float(d[j]), 9), j))[:3]]
    assert [g[0] for g in got] == [w[0] for w in sorted(want)] and sorted((a, c) for a, _, c in got) == sorted((a, c) for a, _, c in want)
    some = {(a, b): c for a, b, c in D.neighbours(frame(spark, x), 3, window=20).select("id", "other", F.round("d", 9)).collect()}
    right = sum((a, b) in some for a, b, _ in want)
    assert right > 0.85 * len(want)


def test_few_and_no_points(spark):
    assert D.clusters(frame(spark, np.zeros((0, 2))), 3, 2).collect() == []
    assert [tuple(r) for r in D.clusters(frame(spark, np.ones((1, 2))), 3, 2).collect()] == [(5, -1)]
    assert {r.cluster_id for r in D.clusters(frame(spark, np.ones((4, 2))), 3, 2).collect()} == {-1}  # all of them are no cluster
