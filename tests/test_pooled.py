"""Correlations over all pairs of runs in a wide table: the same values as from long runs, with ranges, ties, missing predictions and wide values."""

import random

import pytest
from pyspark.sql import functions as F

from siftrank import fixtures as B
from siftrank.operators import pooled, runstats

RUNS = {("a", 11): "a_11", ("b", 11): "b_11", ("c", 22): "c_22", ("d", 22): "d_22"}


def table(spark):
    """Runs with few different values, with one value only, without a fold, without some pairs, and with values too large for 32 bits; one truth value that half the rows have; items of one target."""
    rng = random.Random(5)
    rows = []
    for t in range(24):
        for i in range(60):
            if rng.random() < 0.7:
                score = None if rng.random() < 0.1 else 2.0 if i % 2 else rng.gauss(0, 5)
                rows.append((t % 3, t, i, score, float(rng.randint(0, 4)), 0.5, None if t % 3 == 2 else rng.gauss(0, 1), None if rng.random() < 0.2 else rng.gauss(0, 1) * (1e6 if i < 30 else 1)))
    rows += [(t % 3, t, 100 + t, 1.0, 1.0, 1.0, 1.0, 1.0) for t in range(5)]
    return spark.createDataFrame(rows, "fold int, target_id long, ligand_id long, score double, a_11 double, b_11 double, c_22 double, d_22 double").repartition(7, "ligand_id")


def values(df):
    return {(r.fold, r.cond, r.seed): (r.sel_pearson, r.sel_spearman) for r in df.collect()}


@pytest.mark.parametrize("ranges", [False, True])
def test_wide_runs_equal_long_runs(spark, monkeypatch, ranges):
    rows = table(spark)
    one = F.explode(F.array(*(F.struct(F.lit(c).alias("cond"), F.lit(s).alias("seed"), F.col(x).alias("logit")) for (c, s), x in RUNS.items())))
    want = values(runstats.pooled_selectivity(rows.select("fold", "target_id", "ligand_id", "score", one.alias("o")).select("fold", "target_id", "ligand_id", "score", "o.*")))
    for name, value in (("RANGE_ROWS", 40), ("ITEMS", 1)) if ranges else ():
        monkeypatch.setattr(pooled, name, value)
    got = values(pooled.selectivity_of_runs(rows, RUNS))
    assert set(got) == set(want) and len(got) == 11
    assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12) for k in want) and got[0, "b", 11] == (0.0, 0.0)
    assert pooled.selectivity_of_runs(rows.limit(0), RUNS).count() == 0


def test_no_row_of_a_pair_is_stored(spark, monkeypatch):
    kept, real = [], pooled.stored
    monkeypatch.setattr(pooled, "stored", lambda df: kept.append(real(df)) or kept[-1])
    rows, names = B.run_columns(B.pairs(spark, "/root/testdata/sf0.001", by_item=True))
    assert pooled.selectivity_of_runs(rows, names).count() == 38
    assert max(t.count() for t in kept) <= 38
