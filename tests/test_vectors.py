"""Sums, attention and fingerprints against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftrank.operators import labels, vectors


def test_vector_sums_of_hot_and_null_keys(spark):
    rng = random.Random(1)
    rows = [(None if i % 11 == 0 else f"k{rng.choice((0, 0, 0, 1, 2, 40 + i % 50))}", i % 2, None if i % 13 == 0 else [float(i), None if i % 7 == 0 else 2.0, *([1.0] if i % 3 else [])]) for i in range(900)]
    df = spark.createDataFrame(rows, "a string, b int, v array<double>").repartition(7)
    want = {}
    for a, b, v in rows:
        if v is not None:
            n, total = want.setdefault((a, b), (0, [0.0] * 3))
            want[a, b] = n + 1, [x + (v[i] if i < len(v) and v[i] is not None else 0.0) for i, x in enumerate(total)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = vectors.vector_sums(df, ["a", "b"]).collect()
        whole = vectors.vector_sums(df, []).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == len(want)
    for r in got:
        n, total = want[r.a, r.b]
        assert r.n == n and r.v == pytest.approx(total[: len(r.v)]) and not any(total[len(r.v) :])
    assert len(whole) == 1 and whole[0].n == sum(n for n, _ in want.values())
    assert vectors.vector_sums(df.limit(0), ["a"]).count() == 0


def test_empty_graphs_are_told(spark):
    nodes = spark.createDataFrame([(1, [1.0, 3.0]), (1, [3.0, 5.0]), (2, [0.5, 0.5]), (9, [1.0, 1.0])], "graph long, v array<double>")
    graphs = spark.createDataFrame([(1,), (2,), (3,), (3,)], "graph long")
    got = {r.graph: (r.nodes, r.v, r.empty) for r in vectors.pooled_graphs(graphs, nodes).collect()}
    assert got == {1: (2, [2.0, 4.0], False), 2: (1, [0.5, 0.5], False), 3: (0, None, True)}


@pytest.mark.parametrize("blocks", [(1024, 4096), (3, 4)])
def test_attention_in_blocks(spark, monkeypatch, blocks):
    """Products so large that plain exponentials would overflow, groups without keys or queries, a null group."""
    monkeypatch.setattr(vectors, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(vectors, "KEY_BLOCK", blocks[1])
    rng = np.random.default_rng(2)
    q = [(g, i, (rng.standard_normal(5) * s).tolist()) for g, n, s in ((1, 30, 1), (2, 7, 400), (3, 2, 1)) for i in range(n)]
    k = [(g, i, (rng.standard_normal(5) * s).tolist()) for g, n, s in ((1, 50, 1), (2, 11, 400), (4, 3, 1)) for i in range(n)]
    schema = "group int, id long, v array<double>"
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        got = {(r.group, r.pos): r.x for r in vectors.attention(spark.createDataFrame(q, schema).repartition(3), spark.createDataFrame(k, schema).repartition(3)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = {}
    for g in (1, 2):
        a, b = (np.array([v for x, _, v in t if x == g]) for t in (q, k))
        s = a @ b.T / math.sqrt(5)
        w = np.exp(s - s.max(1, keepdims=True))
        for pos, x in enumerate((w / w.sum(1, keepdims=True) @ b).mean(0)):
            want[g, pos] = x
    assert set(got) == set(want) and all(got[c] == pytest.approx(want[c]) for c in want)


def test_fingerprints_know_rows_not_order(spark):
    rows = [(i % 5, None if i % 3 == 0 else str(i), [i, i + 1]) for i in range(60)]
    df = spark.createDataFrame(rows, "a int, b string, c array<int>")
    mark = lambda d: labels.fingerprint(labels.row_marks(d)).first()
    one = mark(df)
    assert one == mark(df.repartition(7).orderBy(F.desc("b"))) and one["rows"] == 60
    parts = [labels.row_marks(df.where(c)) for c in ("a < 2", "a = 2", "a > 2")]
    assert labels.fingerprint(parts[0].unionByName(parts[1]).unionByName(parts[2])).first() == one
    others = [df.unionByName(df.limit(1)), df.unionByName(df), df.withColumn("b", F.coalesce("b", F.lit(""))), df.where("a <> 1 OR b IS NOT NULL"), df.withColumn("a", F.when(F.col("b") == "7", 9).otherwise(F.col("a")))]
    assert len({mark(d)["fingerprint"] for d in [df, *others]}) == 6
    assert mark(df.limit(0))["rows"] == 0


def test_top_scored_ranks_rounded_scores(spark):
    """Scores that agree at nine digits are ties, which go to smaller items; equal vectors tie wherever they lie in a batch."""
    rng = np.random.default_rng(4)
    one = rng.normal(size=64)
    rows = [(i, (one if i % 3 else rng.normal(size=64)).tolist()) for i in range(500)] + [(1000 + i, [1.0 + (9 - i) * -1e-13] + [0.0] * 63) for i in range(10)]
    items = spark.createDataFrame(rows, "ligand_id long, v array<double>").repartition(5)
    w = rng.normal(size=64).tolist()
    targets = spark.createDataFrame([(0, [1.0] + [0.0] * 63), (1, w)], "target_id long, v array<double>")
    want = {}
    for t, u in ((0, [1.0] + [0.0] * 63), (1, w)):
        score = {i: round(sum(a * b for a, b in zip(v, u, strict=True)), 9) for i, v in rows}
        want[t] = sorted(score, key=lambda i: (-score[i], i))[:408]
    got = vectors.top_scored(items, targets, 0.8, digits=9).orderBy("target_id", "rk").collect()
    assert {t: [r.ligand_id for r in got if r.target_id == t] for t in want} == want
