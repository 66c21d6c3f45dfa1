"""Hard negatives against brute force, and how many pairs the bounds pass over."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import hard_negatives
from quern.llm.queries import op13_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, score int, anchor int"


def table(spark, data):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, "x", 1, None) for i, v, lab in data], SCHEMA).repartition(5)


def brute(data, asks, least=80, most=100, k=5, m=5):
    def whole(v):
        return [math.floor(256 * float(np.float32(x))) for x in v]

    rows = [(i, whole(v), lab) for i, v, lab in data if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, a, lab in {(i, tuple(v), lab) for i, v, lab in rows if asks(i)}:
        scored = [(-sum(x * y for x, y in zip(a, c)), j, other) for j, c, other in rows]
        positives = sorted((s, j) for s, j, other in scored if other == lab and j != i)[:k]
        for s, j in positives:
            inside = sorted((t, n) for t, n, other in scored if other != lab and least * -s <= 100 * -t <= most * -s)[:m]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(inside)]
    return sorted(out)


def got(done):
    return sorted(tuple(r) for r in done.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def clustered(rng, n, d=8, centres=6, spread=0.05, labels=4):
    c = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(centres)]
    return [(i, [x + rng.gauss(0, spread) for x in c[rng.randrange(centres)]], rng.randrange(labels)) for i in range(n)]


@pytest.fixture
def small(monkeypatch):
    """Many trees, blocks and tiles."""
    for name, value in (("TREE", 7), ("BLOCK_BYTES", 900), ("FIRST", 3), ("TILE", 11), ("GATHERED", 20)):
        monkeypatch.setattr(hard_negatives, name, value)


def test_against_brute_force(spark, small):
    rng = random.Random(1)
    data = clustered(rng, 500)
    assert got(hard_negatives.mine(table(spark, data), F.col("vec_id") % 9 == 0)) == brute(data, lambda i: i % 9 == 0)
    assert got(hard_negatives.mine(table(spark, data), F.col("vec_id") % 9 == 0, least=50, most=120, positives=3, negatives=2)) == brute(data, lambda i: i % 9 == 0, 50, 120, 3, 2)


def test_odd_rows(spark, small):
    """Nulls, non-finite entries, ties, repeated rows and ids, one vector and one label that hold a third, negative scores, unequal lengths."""
    rng = random.Random(2)
    data = clustered(rng, 120, d=3, spread=0.4)
    data = [(i, [round(x, 1) for x in v], lab) for i, v, lab in data] + [(200 + i, [1.0, 1.0, 1.0], i % 2) for i in range(60)]
    data += [(300, None, 1), (301, [1.0, None, 1.0], 1), (302, [float("nan"), 1.0, 1.0], 1), (303, [float("inf"), 1.0, 1.0], 1), (304, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1)]
    data += [data[0], data[0], data[9], (9, [0.5, -0.5, 0.1], 3), (310, [0.0, 0.0, 0.0], 2), (311, [0.0, 0.0, 0.0], 2), (320, [0.4], 3), (321, [], 1), (330, [-1.0, -1.0, -1.0], 9), (340, [1.0, 2.0, 0.0], 7)]
    assert got(hard_negatives.mine(table(spark, data), F.col("vec_id") % 10 == 0)) == brute(data, lambda i: i % 10 == 0)
    assert hard_negatives.mine(table(spark, []), F.col("vec_id") % 10 == 0).collect() == []
    assert hard_negatives.mine(table(spark, [(1, [1.0], 1)]), F.col("vec_id") % 10 == 0).collect() == []
    assert hard_negatives.mine(table(spark, [(10, [1.0], 1)]), F.col("vec_id") % 10 == 0).collect() == []


@pytest.mark.parametrize("dense", [1 / 8, 1])
def test_bounds_pass_pairs_over(dense, monkeypatch):
    """On clustered vectors more than half of the pairs are never scored; what is found is the same."""
    monkeypatch.setattr(hard_negatives, "DENSE", dense)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16))
    x = np.floor(256 * (centres[rng.integers(0, 20, 4000)] + 0.02 * rng.standard_normal((4000, 16))))
    anchors = x[:200]
    order, parent, edge, depth = hard_negatives.spanning_tree(anchors)
    a = anchors[order]
    assert sorted(order) == list(range(200)) and order[0] == 0 and (parent[1:] < np.arange(1, 200)).all() and (depth[1:] == depth[parent[1:]] + 1).all()
    assert np.allclose(edge[1:], np.sqrt(((a[1:] - a[parent[1:]]) ** 2).sum(axis=1)))
    forest = hard_negatives.Forest(np.arange(200), np.arange(200), np.zeros(200, int), a, parent, edge, depth)
    s = a @ x.T
    high = np.sort(s, axis=1)[:, -100]
    low = 0.9 * high
    found = {(int(i), int(j)): v for n, r, v in forest.search(forest.trees[0][1], x, np.sqrt((x**2).sum(axis=1)), low, high) for i, j, v in zip(n, r, v)}
    want = {(int(i), int(j)): s[i, j] for i, j in zip(*np.nonzero((s >= low[:, None]) & (s <= high[:, None])))}
    assert found == want
    assert forest.asked == 200 * 4000 and forest.scored < 0.5 * forest.asked


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    data = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in rows]
    assert got(op13_hard_negatives(spark, sf)) == brute(data, lambda i: i % 100 == 0)
