"""Operator 13 against brute force."""

import math
import random

import numpy as np
import pytest

from siftrank.llm import hard_negatives, queries

VECTORS = "vec_id long, embedding array<double>, label int"


def whole(v, scale=256):
    return [math.floor(scale * x) for x in v]


def brute(rows, every=100, k=5):
    """``rows``: id -> (label, whole vector), with Python's own whole numbers."""
    width = max((len(v) for _, v in rows.values()), default=0)
    rows = {i: (y, v + [0] * (width - len(v))) for i, (y, v) in rows.items()}
    out = set()
    for a, (y, q) in rows.items():
        if a % every:
            continue
        scored = sorted(((-sum(s * t for s, t in zip(q, v)), i, z) for i, (z, v) in rows.items() if i != a))
        for s, p, z in [x for x in scored if x[2] == y][:k]:
            inside = [x for x in scored if x[2] != y and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out |= {(a, p, r, i, -s, -t) for r, (t, i, _) in enumerate(inside, 1)}
    return out


def got(df):
    rows = [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def test_query_equals_brute_force_on_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = {}
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect():
        if r.label is not None and r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding):
            rows[r.vec_id] = ((r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, whole(r.embedding))
    want = brute(rows)
    assert got(queries.op13_hard_negatives(spark, sf)) == want and want


@pytest.mark.parametrize("seed", [1, 2])
def test_many_trees(spark, monkeypatch, seed):
    """Small trees and pages, anchors in several blocks, hot labels and vectors, ties, clusters that boxes can tell apart, extra columns."""
    for name, value in (("CELL", 60), ("LEAF", 8), ("ANCHORS", 3), ("SAMPLE", 150)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 6)) * 3
    x = centres[rng.integers(0, 12, 1500)] + rng.standard_normal((1500, 6)) * 0.2
    x[300:800] = x[300]
    labels = rng.integers(0, 40, 1500)
    labels[:700] = 3
    if seed == 2:
        x, labels = np.round(x), labels % 2
    ids = rng.permutation(3000)[:1500]
    data = [(int(i), v.tolist(), int(y), "c", 1) for i, v, y in zip(ids, x, labels)]
    df = spark.createDataFrame(data, VECTORS + ", tree string, page int").repartition(5)
    want = brute({i: (y, whole(v)) for i, v, y, *_ in data}, every=10)
    assert got(hard_negatives.mine(hard_negatives.whole_vectors(df), every=10)) == want and len(want) > 500


def test_awkward_rows(spark):
    rng = random.Random(3)
    data = [(i, [rng.uniform(-2, 2) for _ in range(rng.choice((4, 4, 3, 0)))], i % 3 if i % 11 else -5) for i in range(0, 900, 9)]
    bad = [(1000, None, 1), (1100, [1.0, None, 1.0, 1.0], 1), (1200, [1.0, math.nan, 1.0, 1.0], 1), (1300, [math.inf] * 4, 1), (1400, [1e300] * 4, 1), (1500, [1.0] * 4, None), (None, [1.0] * 4, 1)]
    df = spark.createDataFrame(data + bad + data[:3] + [(18, [9.0] * 4, 2)], VECTORS)
    want = brute({i: (y, whole(v)) for i, v, y in data})
    assert got(hard_negatives.mine(hard_negatives.whole_vectors(df))) == want and want
    assert hard_negatives.mine(hard_negatives.whole_vectors(df.limit(0))).count() == 0
    assert hard_negatives.mine(hard_negatives.whole_vectors(spark.createDataFrame([(0, [], 1), (1, [], 1), (2, [], 2)], VECTORS))).count() == 1


def test_large_components_stay_exact(spark):
    """Scores beyond the whole numbers that doubles hold."""
    rng = random.Random(5)
    data = [(i, [rng.uniform(-4.5e5, 4.5e5) for _ in range(4)], i % 2) for i in range(300)]
    want = brute({i: (y, whole(v)) for i, v, y in data})
    assert got(hard_negatives.mine(hard_negatives.whole_vectors(spark.createDataFrame(data, VECTORS)))) == want
    assert max(abs(s) for *_, s in want) > 2**53


def test_boxes_bound_and_prune():
    """No box that holds a wanted row is skipped, and far boxes are."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((30, 8)) * 50
    x = np.floor(centres[np.repeat(np.arange(30), 64)] + rng.standard_normal((1920, 8)))
    labels = np.repeat(np.arange(30), 64) % 2
    tile = hard_negatives.Tiles(labels, x, 30).tile(labels, x)
    pages = [(np.flatnonzero(tile == t), labels[tile == t], x[tile == t]) for t in np.unique(tile)]
    assert sum(len(p[0]) for p in pages) == 1920 and len(pages) >= 20
    boxes = hard_negatives.Boxes(*(np.array(v) for v in zip(*((p[2].min(0), p[2].max(0), p[1].min(), p[1].max()) for p in pages))))
    q = x[:50]
    for k, p in enumerate(pages):
        s = q @ p[2].T
        assert (s.max(1) <= boxes.upper(q)[:, k]).all() and (s.min(1) >= boxes.lower(q)[:, k]).all()
    tenth = np.sort(q @ x.T, axis=1)[:, -10]
    assert (boxes.upper(q) >= tenth[:, None]).mean() < 0.5
