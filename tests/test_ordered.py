"""Order statistics over ranges: the same values as the windows, and as plain loops."""

import random
from bisect import bisect_left, bisect_right

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftrank.operators import metrics, ordered, vectors

PAIRS = "target_id long, ligand_id long, score double, p_hit double"


def table(spark, seed=1):
    """A large target with many ties, one prediction that a third of its rows have, one target whose scores are all equal, predictions beyond the clip, missing values, and small targets."""
    rng = random.Random(seed)
    rows = []
    for t, n in ((1, 700), (2, 300), (3, 40), (4, 2), (5, 1)):
        for i in range(n):
            score = 7.0 if t == 2 else rng.choice((round(rng.gauss(0, 3), 1), rng.gauss(0, 3)))
            p = 0.25 if rng.random() < 0.35 else rng.choice((0.0, 1.0, 1e-12, round(rng.random(), 2), rng.random()))
            rows.append((t, i * 11 % n, None if rng.random() < 0.05 else score, None if rng.random() < 0.03 else p))
    return spark.createDataFrame(rows, PAIRS).repartition(6)


@pytest.fixture
def by_ranges(monkeypatch):
    for name, value in (("LARGE", 20), ("KEEP", 12), ("RANGES", 8)):
        monkeypatch.setattr(ordered, name, value)


def values(df, key="target_id"):
    return {r[key]: {k: None if v is None else round(v, 9) for k, v in r.asDict().items()} for r in df.collect()}


def test_metrics_over_ranges_equal_those_in_windows(spark, monkeypatch):
    pairs = table(spark)
    want = values(metrics.per_target(pairs))
    for name, value in (("LARGE", 20), ("KEEP", 12), ("RANGES", 8)):
        monkeypatch.setattr(ordered, name, value)
    got = values(metrics.per_target(pairs))
    assert got == want and len(want) == 5
    few = ["target_id", "auprc", "recall95_budget", "ef1", "spearman"]
    for f, c in ((metrics.average_precision, "auprc"), (metrics.budget_for_recall, "recall95_budget"), (metrics.enrichment, "ef1"), (metrics.spearman, "spearman")):
        assert {t: v[c] for t, v in values(f(pairs)).items()} == {t: v[c] for t, v in want.items()} and c in few
    assert {t: v["recall_5_at_20"] for t, v in values(metrics.recalls(pairs)).items()} == {t: v["recall_5_at_20"] for t, v in want.items()}


def test_metrics_over_ranges_equal_plain_loops(spark, by_ranges):
    pairs = table(spark, 3)
    got = values(metrics.per_target(pairs))
    rows = {}
    for r in pairs.collect():
        if r.score is not None and r.p_hit is not None:
            rows.setdefault(r.target_id, []).append((r.ligand_id, r.score, r.p_hit))
    for t, own in rows.items():
        s = np.array([x[1] for x in own])
        hit = s <= np.quantile(s, 0.01)
        p = np.clip([x[2] for x in own], 1e-9, 1 - 1e-9)
        order = sorted(range(len(own)), key=lambda i: (-own[i][2], own[i][0]))
        found = np.cumsum(hit[order])
        assert got[t]["recall95_budget"] == pytest.approx((np.argmax(found >= np.ceil(0.95 * hit.sum())) + 1) / len(own))
        precision = [hit[p >= p[i]].sum() / (p >= p[i]).sum() for i in np.flatnonzero(hit)]
        assert got[t]["auprc"] == pytest.approx(np.mean(precision))


def test_quantiles_and_places_over_ranges(spark, by_ranges):
    rng = random.Random(5)
    data = {1: [rng.choice((rng.gauss(0, 1) * 10 ** rng.randint(-300, 300), round(rng.random(), 1))) for _ in range(500)], 2: [3.5] * 90, 3: [float("-inf"), float("inf")] * 15 + [rng.random() for _ in range(60)], 4: [1.0, 2.0], 5: [-1.7e308, 1.7e308] * 30 + [0.0]}
    rows = spark.createDataFrame([(k, v) for k, x in data.items() for v in x], "k long, v double").repartition(4)
    shares = [0.0, 0.01, 0.05, 0.5, 0.999, 1.0]
    want = {r.k: r.t for r in rows.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("t")).collect()}
    got = {r.k: r.t for r in ordered.quantiles(rows, ["k"], "v", shares).collect()}
    assert {k: list(map(str, v)) for k, v in got.items()} == {k: list(map(str, v)) for k, v in want.items()}
    ranks = {}
    for r in ordered.with_average_ranks(rows, ["k"], rank=F.col("v")).collect():
        ranks.setdefault(r.k, []).append((r.v, r["rank"]))
    for k, x in data.items():
        s = sorted(x)
        assert sorted(ranks[k]) == sorted((v, (bisect_left(s, v) + 1 + bisect_right(s, v)) / 2) for v in x)


def test_first_places_over_ranges(spark, by_ranges):
    """Ties at the last place go to smaller items; rows below it are not sorted."""
    rng = random.Random(6)
    rows = [(t, i, round(rng.random(), 1) if t < 3 else float("nan") if i % 2 else None) for t, n in ((1, 400), (2, 30), (3, 50), (0, 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "target_id long, ligand_id long, logit double").repartition(5)
    got = {(r.target_id, r.ligand_id, r.rk) for r in vectors.top_of_scores(df, 0.1).collect()}
    want = set()
    for t in (0, 1, 2):
        own = sorted(((-v, i) for x, i, v in rows if x == t))
        want |= {(t, i, k) for k, (_, i) in enumerate(own[: -(-len(own) // 10)], 1)}
    assert got == want


def test_empty_tables(spark, by_ranges):
    empty = spark.createDataFrame([], PAIRS)
    assert metrics.per_target(empty).count() == 0 and metrics.spearman(empty).count() == 0
    assert ordered.quantiles(empty, ["target_id"], "score", [0.5]).count() == 0
