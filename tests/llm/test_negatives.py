"""Hard negatives against brute force, the tree's bounds against all distances."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from agorametrics.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, leaf int"


def brute(rows, step, scale=256, positives=5, many=5):
    part = []
    for vec_id, vector, label, *_ in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) or abs(x * scale) > 1 << 26 for x in vector):
            continue
        part.append((vec_id, [math.floor(scale * x) for x in vector], label))
    out = []
    for a, (vec_id, x, label) in enumerate(part):
        if vec_id % step:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y, strict=False)), other, lab, b) for b, (other, y, lab) in enumerate(part)]
        near = sorted(s for s in scored if s[2] == label and s[3] != a)[:positives]
        for p, positive, *_ in near:
            hard = sorted(s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p)[:many]
            out += [(vec_id, positive, k + 1, n, -p, -s) for k, (s, n, *_) in enumerate(hard)]
    return sorted(out)


def rows_of(seed, n, dims=6, labels=3):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    return [(i, [c + r.gauss(0, 0.3) for c in r.choice(centres)], r.randrange(labels), 7) for i in range(n)]


@pytest.mark.parametrize(("sample", "fan", "block"), [(negatives.SAMPLE, negatives.FAN, negatives.BLOCK), (120, 4, 16), (40, 3, 5)])
def test_equals_brute_force(table, sample, fan, block):
    rows = rows_of(1, 300)
    rows += [(1000 + i, [0.5] * 6, i % 2, None) for i in range(40)]  # equal vectors
    rows += [rows[10], rows[10], (20, rows[20][1], 2, 1)]  # repeated rows and ids
    rows += [(None, [1.0] * 6, 1, 1), (30, None, 1, 1), (40, [1.0, None], 1, 1), (50, [1.0, float("nan")], 1, 1), (60, [float("inf")], 0, 1),
             (70, [1.0] * 6, None, 1), (80, [], 1, 1), (90, [0.7, 0.1], 1, 1), (2000, [0.4] * 9, 0, 1), (2010, [1e9], 0, 1)]
    got = negatives.mine(table(rows, SCHEMA), F.col("vec_id") % 10 == 0, sample=sample, fan=fan, block=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 10)


def test_large_components_stay_exact(table):
    r = random.Random(3)
    rows = [(i, [r.uniform(-2.0**26, 2.0**26) for _ in range(4)], i % 2, 0) for i in range(40)]
    got = negatives.mine(table(rows, SCHEMA), F.col("vec_id") % 4 == 0, scale=1, fan=3, block=8)
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, scale=1)


def test_empty_table_no_anchors_and_few_rows(table):
    def mined(rows):
        return negatives.mine(table(rows, SCHEMA), F.col("vec_id") % 100 == 0).collect()

    assert mined([]) == [] == mined([(1, [1.0], 0, 0), (2, [1.0], 0, 0)])
    assert mined([(0, [1.0], 0, 0)]) == []
    assert [tuple(r) for r in mined([(0, [1.0], 0, 0), (2, [1.0], 0, 0), (3, [0.9], 1, 0)])] == [(0, 2, 1, 3, 256 * 256, 230 * 256)]


def test_a_tree_drops_subtrees_and_never_one_with_an_answer():
    r = np.random.default_rng(5)
    x = np.floor(np.concatenate([c + r.normal(0, 3, (200, 8)) for c in r.normal(0, 200, (30, 8))]))
    tree = negatives.plant(x[::3], len(x), fan=6, leaf=100)
    met: dict = {}
    leaf = tree.descend(x, met)
    for k, node in enumerate(tree.nodes):
        m = len(node.points)
        node.low, node.high = np.full((m, m), np.inf), np.full((m, m), -np.inf)
        node.small, node.large = np.full(m, np.inf), np.full(m, -np.inf)
        for j in range(m):
            if (k, j) in met:
                node.low[:, j], node.high[:, j], node.small[j], node.large[j], _ = met[k, j]
    asked = x[::50]
    scores = asked @ x.T
    high = np.sort(scores, axis=1)[:, [-2, -40]]
    low = np.stack([high[:, 0] - 50, high[:, 1] * 0.999], axis=1)
    met_leaves = tree.meets(asked, low, high)
    for w in range(2):
        who, what = np.nonzero((scores >= low[:, w, None]) & (scores <= high[:, w, None]))
        assert met_leaves[who, leaf[what]].all()
    assert met_leaves.mean() < 0.35


def test_best_breaks_ties_by_id():
    block = negatives.Block(pa.table({"vec_id": [5, 3, 4], "label": [0, 0, 0], "row": [0, 1, 2], "vec": pa.array([[1], [1], [1]], pa.list_(pa.int32()))}))
    who, what = block.best(np.array([[7.0, 7.0, 9.0]]), np.array([[True, True, True]]), 2)
    assert sorted(block.vec_id[what].tolist()) == [3, 5] and who.tolist() == [0, 0]
