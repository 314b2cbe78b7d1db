"""Draws, sums of resamples and recalls of runs against plain loops and against the ways that take a row for each."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftrank.operators import metrics, ordered, resampling, runstats


def drawn(seed, b, n):
    return [int(hashlib.md5(f"{seed}#{b}#{p}".encode()).hexdigest()[:8], 16) % n for p in range(n)]


@pytest.mark.parametrize("n", [1, 9, 10, 11, 1203, 40_001])
def test_draws_equal_single_hashes(n):
    for seed, b in ((0, 0), (1, 37), (123456, 4999), (-5, 10**15)):
        assert np.concatenate(list(resampling.draws_of(seed, b, n))).tolist() == drawn(seed, b, n)


def test_no_draw_is_a_row(spark):
    rows = [(i, None if i % 7 == 3 else i * 0.31 % 1 - 0.4) for i in range(30)]
    df = spark.createDataFrame(rows, "target_id long, x double")
    out = runstats.bootstrap(df, "x", draws=50, seed=3)
    assert "Range (0, 50, " in out._jdf.queryExecution().toString()
    got = out.first()
    means = [np.mean([rows[k][1] for k in drawn(3, b, 30) if rows[k][1] is not None]) for b in range(50)]
    assert (got.n, got.p_positive) == (26, np.mean(np.array(means) > 0)) and np.allclose((got.low, got.high), np.quantile(means, (0.025, 0.975)))


def test_sums_in_tasks_equal_joined_draws(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(c, t, None if rng.random() < 0.1 else rng.uniform(-1, 1)) for c, n in (("a", 25), ("b", 25), ("c", 13)) for t in range(n)]
    df = spark.createDataFrame(rows, "cond string, target_id long, x double")
    two = df.where("cond = 'a'").select("target_id", F.col("x").alias("b"), (F.col("x") * 2 + 0.5).alias("k2"))
    both = lambda: (sorted(map(str, runstats.paired_contrasts(df, "x", draws=60).collect())), runstats.ratio_bootstrap(two, "b", "k2", draws=60).collect(), runstats.bootstrap(two, "b", draws=60).collect())
    got = both()
    monkeypatch.setattr(resampling, "VALUES", 0)
    assert got == both()


def runs_table(spark):
    rng = random.Random(8)
    rows = []
    for t, n in ((None, 30), (1, 260), (2, 35), (3, 1), (4, 2), (5, 15)):
        for i in range(n):
            score = None if rng.random() < 0.05 else float("nan") if rng.random() < 0.03 else rng.choice((round(rng.gauss(0, 3)), rng.gauss(0, 3), 0.0)) * 1.0
            p = [None if rng.random() < 0.1 else float("nan") if rng.random() < 0.02 else rng.choice((0.5, round(rng.random(), 1), float("inf"), -0.0, 0.0)) for _ in range(2)]
            rows.append((0 if t is None else t % 2, t, f"é{i * 7 % n}", score, p[0], None if t == 5 else p[1]))
    return spark.createDataFrame(rows, "fold int, target_id long, ligand_id string, score double, x double, y double")


@pytest.mark.parametrize("large", [1_000_000, 20])
def test_recalls_of_runs_equal_those_of_a_long_table(spark, monkeypatch, large):
    df, keys, runs = runs_table(spark), ["fold", "target_id"], {("a", 1): "x", ("b", 2): "y"}
    side = lambda c, s, x: df.select(*keys, "ligand_id", "score", F.lit(c).alias("cond"), F.lit(s).alias("seed"), F.col(x).alias("p_hit"))
    long = side("a", 1, "x").unionByName(side("b", 2, "y"))
    want = metrics.recalls(long, [*keys, "cond", "seed"]).select(*keys, "cond", "seed", "recall_1_at_10").collect()
    many = None
    if large == 20:
        monkeypatch.setattr(ordered, "LARGE", large)
        many = df.groupBy(*keys).count().where("count > 20 AND target_id IS NOT NULL")
    got = runstats.recalls_of_runs(df.repartition(3, "target_id"), keys, runs, many).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 11
    assert runstats.recalls_of_runs(df.limit(0), keys, runs).count() == 0


@pytest.mark.parametrize("large", [1_000_000, 20])
def test_recalls_of_the_shared_ranking_equal_its_report(spark, monkeypatch, large):
    rng = random.Random(9)
    monkeypatch.setattr(ordered, "LARGE", large)
    truth = spark.createDataFrame([(t, i, None if rng.random() < 0.1 else rng.gauss(0, 5)) for t in range(7) for i in range(60) if rng.random() < 0.2 + t / 8], "target_id long, ligand_id long, score double")
    roles = spark.createDataFrame([(f, t, "heldout" if t % 3 == f else "unused" if t == 6 and f == 1 else "train") for f in range(3) for t in range(7)], "fold int, target_id long, role string")
    want = runstats.shared_report(truth, roles).select("fold", "target_id", "recall_1_at_10").collect()
    assert sorted(map(str, runstats.shared_recalls(truth, roles).collect())) == sorted(map(str, want)) and len(want) == 7
