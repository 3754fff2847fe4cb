"""Hard negatives against brute force."""

import math

import numpy as np
import pytest

from quire.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, id string, block int"


def expected(rows):
    live = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * x) for x in v]) for i, v, lab, *_ in rows
            if i is not None and v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors, out = {}, []
    for i, lab, v in live:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (lab, v)), (lab, v))
    for a, (lab, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in live if i != a and len(w) == len(v))
        for top, p, _ in [s for s in scored if s[2] == lab][:5]:
            hard = [s for s in scored if s[2] != lab and 30 * -top <= 100 * -s[0] <= 90 * -top][:10]
            out += [(a, p, r + 1, n, -top, -s) for r, (s, n, _) in enumerate(hard)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = H.mine(H.labelled_vectors(df), **options).collect()
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got)


def vectors(seed, n, dim, step=25):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, dim))
    x = base[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, dim))
    x[::3] = x[0]  # a third of all rows is one vector
    x = np.round(x * 4) / 4  # ties
    return [(int(i * step), v.tolist(), int(rng.integers(0, 4)), "x", 1) for i, v in enumerate(x)]


ODD = [(100, None, 1, "", 1), (200, [float("nan")] * 6, 1, "", 1), (300, [None] * 6, 1, "", 1), (400, [float("inf")] * 6, 1, "", 1),
       (500, [1.0] * 6, None, "", 1), (None, [1.0] * 6, 1, "", 1), (90000, [], 1, None, None), (90001, [], 1, None, None), (90002, [], 2, None, None),
       (90100, [1.0, 2.0], 3, "", 1), (90101, [1.0, 2.0], 3, "", 1), (90102, [0.5, 1.0], 2, "", 1), (90102, [0.5, 1.0], 2, "", 1),
       (90200, [0.0] * 6, 1, "", 1)]


@pytest.mark.parametrize("block_bytes,leaf,fan", [(8 << 20, 128, 16), (2000, 4, 2), (700, 1, 3)])
def test_mining(spark, monkeypatch, block_bytes, leaf, fan):
    monkeypatch.setattr(H.Tree.__init__, "__defaults__", (leaf, fan))
    rows = vectors(1, 240, 6) + ODD
    rows += rows[:9]  # repeated rows, anchors among them
    assert mined(spark, rows, block_bytes=block_bytes) == expected(rows)


def test_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1, "", 1)]) == []


@pytest.mark.parametrize("n,leaf,fan", [(1, 4, 2), (4, 4, 2), (5, 4, 2), (300, 4, 3), (1000, 8, 16)])
def test_tree(n, leaf, fan):
    """Every row is in one leaf, every box holds what is below it, and the bounds hold."""
    x = np.random.default_rng(n).integers(-50, 50, (n, 5)).astype(float)
    tree = H.Tree(x, leaf, fan)
    assert sorted(tree.order) == list(range(n))
    own, a = x[tree.order], np.random.default_rng(1).integers(-9, 9, (3, 5)).astype(float)
    low, high = tree.bounds(a)

    def rows_of(node):
        start, end = tree.spans[node]
        return list(range(start, end)) if node >= tree.leaves else sum((rows_of(c) for c in range(start, end)), [])
    assert sorted(rows_of(0)) == list(range(n))
    for node in range(len(tree.low)):
        inside = own[rows_of(node)]
        assert (inside.min(0) == tree.low[node]).all() and (inside.max(0) == tree.high[node]).all()
        assert (a @ inside.T >= low[:, [node]]).all() and (a @ inside.T <= high[:, [node]]).all()


def test_boxes_are_passed_over():
    """Of well separated clusters only those that can hold a hit are read."""
    x = np.repeat(np.eye(8) * 100, 64, 0) + np.random.default_rng(0).integers(0, 3, (512, 8))
    tree, read = H.Tree(x, 16, 4), []

    def allowed(rows):
        read.append(len(rows))
        return np.ones(len(rows), bool)
    a = np.eye(8)[:1] * 10
    low, high = tree.bounds(a)
    own, ids = x[tree.order], np.arange(512)[tree.order]
    (scores, found), = H.search(tree, own, ids, allowed, a[0], low[0], high[0], [(-np.inf, np.inf, -np.inf)], 5)
    want = sorted(zip(-(x @ a[0]), range(512)))[:5]
    assert list(zip(-scores, found)) == want and sum(read) <= 112
    read.clear()
    assert not len(H.search(tree, own, ids, allowed, a[0], low[0], high[0], [(2e6, 3e6, -np.inf)], 5)[0][0]) and not read
