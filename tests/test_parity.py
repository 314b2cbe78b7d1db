"""Agreement of two scorings against plain loops, by windows and by ranges, with ties and missing values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftrank.operators import metrics, ordered


def average_ranks(values):
    low = lambda v: sum(1 for w in values if w > v)
    return np.array([low(v) + (sum(1 for w in values if w == v) + 1) / 2 for v in values])


@pytest.mark.parametrize("large", [1_000_000, 20])
def test_parity_equals_plain_loops(spark, monkeypatch, large):
    monkeypatch.setattr(ordered, "LARGE", large)
    rng = random.Random(2)
    rows = [(t, i * 7 % n, round(rng.random(), 1), rng.choice((round(rng.random(), 1), rng.random()))) for t, n in ((1, 45), (2, 12), (3, 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "target_id long, ligand_id long, a double, b double")
    got = metrics.parity(df.withColumnRenamed("a", "p_hit"), df.withColumnRenamed("b", "p_hit")).first()
    rho, overlap = [], []
    for t in (1, 2, 3):
        own = [r for r in rows if r[0] == t]
        k = -(-len(own) // 10)
        best = [{r[1] for r in sorted(own, key=lambda r: (-r[c], r[1]))[:k]} for c in (2, 3)]
        rho.append(np.corrcoef(average_ranks([r[2] for r in own]), average_ranks([r[3] for r in own]))[0, 1])
        overlap.append(len(best[0] & best[1]) / k)
    pooled = np.corrcoef(average_ranks([r[2] for r in rows]), average_ranks([r[3] for r in rows]))[0, 1]
    want = (max(abs(r[2] - r[3]) for r in rows), min(rho), np.mean(rho), pooled, min(overlap))
    assert np.allclose((got.max_abs_diff, got.min_spearman, got.mean_spearman, got.pooled_spearman, got.min_overlap), want) and got.all_finite and got.verdict == "different"


@pytest.mark.parametrize("missing", [None, float("nan")])
def test_missing_values_have_no_place(spark, monkeypatch, missing):
    rng = random.Random(3)
    value = lambda: rng.choice((missing, rng.random(), rng.random(), rng.random()))
    df = spark.createDataFrame([(t, i, value() if t < 3 else missing, value()) for t in range(4) for i in range(30)], "target_id long, ligand_id long, a double, b double")
    both = lambda: sorted((r.target_id, r.k, r.common) for r in metrics._agreement(df, 0.2).collect() if r.k)
    want = both()
    assert len(want) == 3
    monkeypatch.setattr(ordered, "LARGE", 20)
    assert both() == want


def test_ranks_of_counted_values_equal_those_of_rows(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i % 2, rng.choice((0.0, -0.0, 0.5, float("inf"))), rng.randint(0, 9) / 10) for i in range(300)], "k int, x double, y double")
    one, two = (sorted(map(tuple, f(df, ["k"], F.col("x"), F.col("y")).collect())) for f in (ordered.tied_rank_moments, ordered.rank_moments))
    assert np.allclose(one, two)


def test_equal_values_are_counted_before_they_are_dealt(spark, monkeypatch):
    """Values of few kinds pass no range partitioning of all rows."""
    monkeypatch.setattr(ordered, "rank_moments", None)
    df = spark.createDataFrame([(t, i, i % 5 / 10) for t in range(3) for i in range(40)], "target_id long, ligand_id long, p_hit double")
    assert metrics.parity(df, df).first().verdict == "same"
