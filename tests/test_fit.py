"""The stochastic fit against a plain loop, and its stop."""

import numpy as np
import pytest

from siftrank.operators import splits, vectors


def table(spark, seed=1, n=60, targets=3, size=4):
    rng = np.random.default_rng(seed)
    items, goals = rng.standard_normal((n, size)), rng.standard_normal((targets, size))
    rows = []
    for t in range(targets):
        for i in range(n):
            s = items[i] @ goals[t]
            rows.append((t, i, items[i].tolist(), goals[t].tolist(), int(np.sin(2 * s) > 0.6), None if i % 6 == 0 else float(np.cos(3 * s))))
    return rows, spark.createDataFrame(rows, "target_id long, ligand_id long, v array<double>, t array<double>, y int, z double")


def plain(rows, plan, held, rate, weight, shards, per_round, patience):
    by = {(r[0], r[1]): r for r in rows}
    size = len(rows[0][2])
    p = np.concatenate([np.random.default_rng(0).standard_normal(size) * 0.01, [0.0, 1.0, 0.0, -1.0, 0.0]])
    arrays = lambda own: (np.array([np.multiply(r[2], r[3]) for r in own]), np.array([r[4] for r in own], float), np.array([np.nan if r[5] is None else r[5] for r in own]))
    curve, best, top = [], p, -np.inf
    last = max(u for u, *_ in plan) + 1
    for begin in range(0, last, shards * per_round):
        ends = []
        for k in range(shards):
            q, own = p.copy(), [u for u in range(begin, min(last, begin + shards * per_round)) if u % shards == k]
            for u in own:
                f, y, z = arrays([by[t, i] for v, _, t, i in sorted(plan) if v == u])
                q = q - rate * vectors.joint_loss(f, y, z, q, weight)[1] / len(y)
            if own:
                ends.append((len(own), q))
        p = np.average([q for _, q in ends], axis=0, weights=[n for n, _ in ends])
        metric = -vectors.joint_loss(*arrays(held), p, weight)[0] / len(held)
        curve.append((min(begin + shards * per_round, last), metric))
        if metric > top:
            top, best, since = metric, p, 0
        else:
            since += 1
        if since >= patience:
            break
    return best, curve


@pytest.mark.parametrize(("shards", "per_round", "rate"), [(1, 4, 0.1), (3, 2, 0.1), (2, 2, 40.0)])
def test_fit_equals_plain_loop(spark, shards, per_round, rate):
    rows, df = table(spark)
    seen = df.where("ligand_id % 5 > 0")
    plan = splits.balanced_batches(seen.select("target_id", "ligand_id"), 30, 8).collect()
    assert len(plan) == 240 and len({(r.update, r.target_id) for r in plan}) == 30
    batches = spark.createDataFrame(plan).join(df, ["target_id", "ligand_id"])
    p, curve = vectors.fit_batches(batches, df.where("ligand_id % 5 = 0"), rate=rate, shards=shards, per_round=per_round)
    want, line = plain(rows, [tuple(r) for r in plan], [r for r in rows if r[1] % 5 == 0], rate, 0.2, shards, per_round, 3)
    got = [(r.update, r.metric) for r in curve.orderBy("update").collect()]
    assert [u for u, _ in got] == [u for u, _ in line] and np.allclose([m for _, m in got], [m for _, m in line]) and np.allclose(p, want)
    if rate > 1:
        assert len(got) < -(-30 // (shards * per_round)), "a rate that blows up is stopped"


def test_fit_learns_what_is_not_linear_in_its_features(spark):
    """Held-out loss falls, and stays above that of the truth."""
    rows, df = table(spark, 4, 200)
    batches = spark.createDataFrame(splits.balanced_batches(df.where("ligand_id % 5 > 0").select("target_id", "ligand_id"), 64, 16).collect()).join(df, ["target_id", "ligand_id"])
    _, curve = vectors.fit_batches(batches, df.where("ligand_id % 5 = 0"), rate=0.1)
    metrics = [r.metric for r in curve.orderBy("update").collect()]
    assert max(metrics) > metrics[0] and max(metrics) < -0.05
    p, curve = vectors.fit_batches(batches.limit(0), df)
    assert curve.count() == 0 and len(p) == 5
