"""Quadruplets and contrasts against plain loops."""

import random

from pyspark.sql import functions as F

from siftrank import queries
from siftrank.operators import metrics, runstats

TRUTH = "fold int, target_id long, ligand_id long, score double"


def sparse(spark, seed=1, items=40, targets=8):
    rng = random.Random(seed)
    rows = [(t % 2, t, i, rng.choice((None, float(rng.randint(0, 6)))) if rng.random() < 0.1 else float(rng.randint(0, 6))) for t in range(targets) for i in range(items) if rng.random() < 0.3]
    return rows, spark.createDataFrame(rows, TRUTH).repartition(3)


def every(rows):
    """All unordered quadruplets that qualify, as ``(fold, a, b, {i, j})``."""
    score = {(t, i): s for _, t, i, s in rows if s is not None}
    fold = {t: f for f, t, _, _ in rows}
    out = set()
    for a in fold:
        for b in fold:
            if a < b and fold[a] == fold[b]:
                both = sorted(i for t, i in score if t == a and (b, i) in score)
                for x, i in enumerate(both):
                    for j in both[x + 1 :]:
                        da, db = score[a, i] - score[a, j], score[b, i] - score[b, j]
                        if abs(da) >= 1 and abs(db) >= 1 and da * db < 0:
                            out.add((fold[a], a, b, frozenset((i, j))))
    return out


def test_few_quadruplets_are_found_whole(spark):
    rows, df = sparse(spark, items=90)
    got = runstats.quadruplets(df, 100_000, 50_000).collect()
    want = every(rows)
    assert {(r.fold, r.a, r.b, frozenset((r.i, r.j))) for r in got} == want and len(got) == len(want) > 50
    score = {(t, i): s for _, t, i, s in rows}
    assert all(r.da == score[r.a, r.i] - score[r.a, r.j] and r.db == score[r.b, r.i] - score[r.b, r.j] for r in got)


def test_no_item_is_left_out_of_large_folds(spark, monkeypatch):
    monkeypatch.setattr(runstats, "INDEX_ROWS", 30, raising=False)  # once a bound, beyond which a share of the items was taken
    rows, df = sparse(spark, items=90)
    got = runstats.quadruplets(df, 100_000, 50_000).collect()
    assert {(r.fold, r.a, r.b, frozenset((r.i, r.j))) for r in got} == every(rows)


def test_draws_go_on_until_the_quota_is_met(spark):
    rows, df = sparse(spark, 2, 120)
    got = runstats.quadruplets(df, 150, 100).collect()
    want = every(rows)
    assert {f: sum(r.fold == f for r in got) for f in (0, 1)} == {0: 150, 1: 150}
    assert all((r.fold, r.a, r.b, frozenset((r.i, r.j))) in want for r in got) and max(r.c for r in got) >= 200
    assert runstats.quadruplets(df.limit(0), 10, 100).count() == 0


def test_contrasts_of_all_pairs_equal_single_bootstraps(spark):
    rng = random.Random(3)
    rows = [(c, t, None if t == 4 and c == "b" else rng.random()) for c, n in (("a", 20), ("b", 20), ("c", 15)) for t in range(n)]
    df = spark.createDataFrame(rows, "cond string, target_id long, x double")
    got = {(r.a, r.b): (r.n, r.mean, r.low, r.high, r.p_positive) for r in runstats.paired_contrasts(df, "x", draws=200).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")} and [got[k][0] for k in sorted(got)] == [19, 15, 14]
    side = lambda c: df.where(df["cond"] == c).select("target_id", "x")
    for a, b in got:
        one = runstats.bootstrap(runstats.difference(side(a), side(b), "x"), "x", draws=200).first()
        assert got[a, b] == (one["n"], one["mean"], one["low"], one["high"], one["p_positive"])


def test_ranks_of_runs_equal_those_of_rows(spark):
    """Recall and rank correlation of runs side by side, with ties, missing predictions, a side that does not vary and keys of few rows, against windows over long runs; keys called large go the other way."""
    rng = random.Random(8)
    rows = [(0, t, i, None if rng.random() < 0.1 else float(rng.randint(0, 9)) if t % 2 else rng.gauss(0, 1), None if rng.random() < 0.2 else float(rng.randint(0, 5)), 1.0) for t, n in ((1, 80), (2, 60), (3, 2), (4, 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "fold int, target_id long, ligand_id long, score double, x double, one double").repartition(3, "target_id")
    keys, names = ["fold", "target_id"], {("x", 11): "x", ("one", 11): "one"}
    want = {}
    for (c, _), x in names.items():
        pairs = df.select("target_id", "ligand_id", "score", F.col(x).alias("p_hit"))
        want |= {(r.target_id, c): [r.recall_1_at_10] for r in metrics.recalls(pairs).collect()}
        for r in metrics.spearman(pairs).collect():
            want[r.target_id, c].append(r.spearman)
    assert want[1, "one"][1] is None and want[1, "x"][1] is not None
    for large in (None, spark.createDataFrame([(0, 1)], "fold int, target_id long")):
        got = {(r.target_id, r.cond): [r.recall_1_at_10, r.spearman] for r in runstats.recalls_of_runs(df, keys, names, large, ranks=True).collect()}
        assert {k: [v if v is None else round(v, 12) for v in x] for k, x in got.items()} == {k: [v if v is None else round(v, 12) for v in x] for k, x in want.items()}


def test_fold_report_stores_no_row_of_a_run(spark, monkeypatch):
    kept, real = [], queries.stored
    monkeypatch.setattr(queries, "stored", lambda df: kept.append(df.columns) or real(df))
    assert queries.QUERIES["fold_report"](spark, "/root/testdata/sf0.001").count() == 19
    assert kept and not any({"seed", "logit"} <= set(c) for c in kept)


def test_shared_recalls_deal_by_item_and_target_only(spark):
    rng = random.Random(9)
    rows = [(t, i, None if rng.random() < 0.1 else round(rng.gauss(0, 1), 2)) for t in range(10) for i in range(60) if rng.random() < 0.5 and (i < 55 or t == 3)]
    truth = spark.createDataFrame(rows, "target_id long, ligand_id long, score double").localCheckpoint()
    roles = spark.createDataFrame([(f, t, "heldout" if t % 5 == f else "train") for f in range(5) for t in range(10)], "fold int, target_id long, role string")
    out = runstats.shared_recalls(truth, roles)
    want = {(r.fold, r.target_id): r.recall_1_at_10 for r in runstats.shared_report(truth, roles).collect()}
    assert {(r.fold, r.target_id): r.recall_1_at_10 for r in out.collect()} == want and len(want) == 10
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("REPARTITION_BY_NUM") == 3 and "ENSURE_REQUIREMENTS" not in plan
