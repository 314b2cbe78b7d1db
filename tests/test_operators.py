"""Small hand-made frames for the rules that are easy to get wrong."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftrank.functions import scalar as S
from siftrank.operators import components, labels, metrics, numbering, runstats, splits, structure, vectors
from siftrank.plans import lifecycle

PAIRS = "target_id long, ligand_id long, score double, p_hit double"


def one(df):
    return df.first().asDict()


def test_coercion_and_hits(spark):
    df = spark.createDataFrame([("1.5", 2.0), ("n/a", 2.0), ("NaN", None), (None, 1.0)], "t string, tau double")
    rows = df.select(S.to_number(F.col("t")).alias("x"), S.hit(S.to_number(F.col("t")), F.col("tau")).alias("y")).collect()
    assert [(r.x, r.y) for r in rows] == [(1.5, 1), (None, 0), (None, 0), (None, 0)]


def test_group_key_and_one_hot(spark):
    df = spark.createDataFrame([("c1", "p"), ("", "p"), (None, None)], "s string, p string")
    assert [r[0] for r in df.select(S.group_key(F.col("s"), F.col("p"))).collect()] == ["c1", "ACYCLIC::p", "ACYCLIC::PARSE_FAIL"]
    assert [r[0] for r in df.select(S.one_hot_other(F.col("s"), ["c1"])).collect()] == [[1, 0], [0, 1], [0, 1]]


def test_rounding_rules(spark):
    df = spark.createDataFrame([(25,), (35,), (4,)], "n long").select(S.top_count(0.1, F.col("n")).alias("a"), S.top_ceil(0.1, F.col("n")).alias("b"))
    assert [(r.a, r.b) for r in df.collect()] == [(2, 3), (4, 4), (1, 1)]


def test_constant_sides(spark):
    pairs = spark.createDataFrame([(1, i, 5.0, i / 10) for i in range(5)] + [(2, 1, 1.0, 0.5), (2, 2, 2.0, 0.4)], PAIRS)
    assert {r.target_id: r.spearman for r in metrics.spearman(pairs).collect()} == {1: None, 2: None}
    runs = spark.createDataFrame([(0, "c", 1, t, i, float(t * i), float(i)) for t in (1, 2) for i in range(4)], "fold int, cond string, seed int, target_id long, ligand_id long, score double, logit double")
    assert {r.sel_pearson for r in runstats.selectivity(runs).collect()} == {0.0}


def test_metrics_drop_missing_truth_first(spark):
    pairs = spark.createDataFrame([(1, i, float(i), 1 - i / 20) for i in range(20)] + [(1, 99, None, 0.99), (1, 98, float("nan"), 0.99)], PAIRS)
    row = one(metrics.recalls(pairs))
    assert (row["n_ligands"], row["n_hits"], row["recall_1_at_10"]) == (20, 1, 1.0)
    assert one(metrics.budget_for_recall(pairs))["recall95_budget"] == 0.05
    assert one(metrics.average_precision(pairs))["auprc"] == 1.0
    assert one(metrics.spearman(pairs))["spearman"] == pytest.approx(1.0)


def test_average_precision_merges_ties(spark):
    pairs = spark.createDataFrame([(1, 1, 0.0, 0.5), (1, 2, 9.0, 0.5), (1, 3, 8.0, 0.5), (1, 4, 7.0, 0.1)], PAIRS)
    assert one(metrics.average_precision(pairs))["auprc"] == pytest.approx(1 / 3)


def test_empty_tables(spark):
    pairs = spark.createDataFrame([], PAIRS)
    assert metrics.per_target(pairs).count() == 0
    assert one(labels.key_audit(pairs, "target_id")) == {"rows": 0, "distinct_keys": 0, "duplicate_rows": 0}
    assert one(runstats.bootstrap(pairs.select("target_id", "score"), "score"))["n"] == 0


def test_components_against_union_find(spark):
    edges = [(i * 7 % 60, i * 11 % 60) for i in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200), (None, 1)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_item_roles_equal_the_plain_greedy(spark):
    sizes = {f"g{i}": 1 + (i * i) % 7 for i in range(40)}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g string")
    got = {r.g: r.role for r in splits.item_roles(df, "g").collect()}
    total, held, want = sum(sizes.values()), {r: 0 for r, _ in splits.TARGET_SHARES}, {}
    for g, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        role = min(splits.TARGET_SHARES, key=lambda s: (round((held[s[0]] + n) / (s[1] * total), 9), [r for r, _ in splits.TARGET_SHARES].index(s[0])))[0]
        held[role] += n
        want[g] = role
    assert got == want


def test_test_cells_are_closed(spark, tmp_path):
    cells = spark.createDataFrame([(1, 2, 0.5, "train", "val"), (1, 3, None, "train", "test")], "target_id long, ligand_id long, score double, target_role string, ligand_role string")
    lifecycle.write_labels(cells, str(tmp_path / "cells"))
    assert lifecycle.read_labels(spark, str(tmp_path / "cells"), "train", "val").count() == 1
    with pytest.raises(PermissionError):
        lifecycle.read_labels(spark, str(tmp_path / "cells"), "train", "test")


def test_structure_readers(spark, tmp_path):
    (tmp_path / "t1.pdbqt").write_text("REMARK x\nATOM 1 N ALA A 10 1.0 2.0 3.0 1.00 0.00 -0.3 N\nATOM 2 CA ALA U1002 1.0 2.0 4.0 1.00 0.00 0.1 C\nHETATM 3 CA XYZ A 11 1.5 2.0 4.0 1.0 0.0 0.2 HD\n")
    atoms = structure.parse_atoms(structure.read_lines(spark, str(tmp_path / "t1.pdbqt"))).orderBy("line_no").collect()
    assert [(a.atom_name, a.res_seq, a.x, a.charge, a.ad_type) for a in atoms] == [("N", 10, 1.0, -0.3, "N"), ("CA", 1002, 1.0, 0.1, "C"), ("CA", 11, 1.5, 0.2, "HD")]
    assert structure.sequences(structure.parse_atoms(structure.read_lines(spark, str(tmp_path / "t1.pdbqt")))).first().sequence == "AX"
    (tmp_path / "t1.conf").write_text("\n".join(f"{k} = {i}.5" for i, k in enumerate(structure.BOX)) + "\n\nno pair\n")
    assert one(structure.parse_boxes(structure.read_lines(spark, str(tmp_path / "t1.conf"))))["size_z"] == 5.5
    (tmp_path / "r1.txt").write_text("x\nREMARK VINA RESULT:   -7.5  0 0\nREMARK VINA RESULT: -6\n")
    (tmp_path / "r2.txt").write_text("nothing")
    assert [tuple(r) for r in structure.first_results(structure.read_lines(spark, str(tmp_path / "r*.txt"))).collect()] == [("r1", -7.5)]


def test_row_function_failures_keep_their_rows(spark):
    def picky(x):
        if x == "bad":
            raise ValueError(x)
        return x.upper()

    df = spark.createDataFrame([("a",), ("bad",), (None,)], "t string")
    assert sorted((r.t or "", r.result, r.status) for r in labels.apply_rows(df, "t", picky).collect()) == [("", None, "PARSE_FAIL"), ("a", "A", "OK"), ("bad", None, "PARSE_FAIL")]


def test_planted_reversals(spark):
    """A run that knows each target's own order reverses where the truth does; one that ignores the target never can."""
    rows = []
    for t in (0, 5, 10, 15):
        for i in range(60):
            truth = float((i * 7) % 60 if (t // 5) % 2 else (60 - i * 7) % 60)
            rows += [(0, "own", 1, t, i, truth, -truth), (0, "shared", 1, t, i, truth, float(i))]
    runs = spark.createDataFrame(rows, "fold int, cond string, seed int, target_id long, ligand_id long, score double, logit double")
    quads = runstats.quadruplets(runs.where("cond = 'own'").select("fold", "target_id", "ligand_id", "score"), 200, 4000)
    got = {r.cond: r.a for r in runstats.reversal_accuracy(quads, runs).groupBy("cond").agg(F.avg("accuracy").alias("a")).collect()}
    assert got == {"own": 1.0, "shared": 0.0}


def test_local_top_equals_global_top(spark):
    items = spark.createDataFrame([(i, [math.sin(i), math.cos(i)]) for i in range(100)], "ligand_id long, v array<double>").repartition(7)
    targets = spark.createDataFrame([(t, [float(t), 1.0]) for t in range(3)], "target_id long, v array<double>")
    top = {(r.target_id, r.ligand_id) for r in vectors.top_scored(items, targets, 0.1).collect()}
    plain = {(r.target_id, r.ligand_id) for r in vectors.top_of_scores(vectors.score_pairs(items, targets), 0.1).collect()}
    assert top == plain and len(top) == 30


def test_early_stop(spark):
    curve = spark.createDataFrame([(1, u * 100, m) for u, m in enumerate([0.1, 0.5, 0.5, 0.4, 0.3, 0.9], 1)] + [(2, 100, 0.2)], "k int, update int, metric double")
    got = {r.k: (r.updates, r.best_update, r.best, r.reason) for r in lifecycle.early_stop(curve, 3, ["k"]).collect()}
    assert got == {1: (500, 200, 0.5, "patience"), 2: (100, 100, 0.2, "end")}


@pytest.mark.parametrize("shares", [splits.TARGET_SHARES, (("a", 0.5), ("b", 0.25), ("c", 0.25)), (("a", 0.7), ("b", 0.3))])
def test_item_roles_with_many_groups_of_one_size(spark, shares):
    """The closed rule of the histogram against the plain loop over groups, where ties of loads are exact."""
    from fractions import Fraction

    rng = random.Random(1)
    sizes = {f"g{i:03}": rng.choice((1, 1, 1, 1, 2, 5, 30)) for i in range(300)}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g string").repartition(5)
    got = {r.g: r.role for r in splits.item_roles(df, "g", shares).collect()}
    held, want = [0] * len(shares), {}
    for g, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        r = min(range(len(shares)), key=lambda k: (Fraction(held[k] + n) / Fraction(shares[k][1]).limit_denominator(100), k))
        held[r] += n
        want[g] = shares[r][0]
    assert got == want


def test_numbers_have_no_gaps(spark):
    rows = [(i % 3 if i % 5 else None, f"k{i * 37 % 100:03}") for i in range(100)]
    df = spark.createDataFrame(rows, "g int, k string").repartition(7)
    by = {}
    for r in numbering.numbered_within(df.where("g IS NOT NULL"), ["g"], ["k"], "n").collect():
        by.setdefault(r.g, []).append((r.k, r.n))
    assert all([n for _, n in sorted(x)] == list(range(len(x))) for x in by.values()) and sum(map(len, by.values())) == 80
    assert sorted((r.k, r.n) for r in numbering.numbered_within(df, [], ["k"], "n").collect()) == [(f"k{i:03}", i) for i in range(100)]


def shingle_sets(texts, n=3):
    words = {i: tuple((t or "").lower().split()) for i, t in texts}
    return words, {i: {w[j : j + n] for j in range(len(w) - n + 1)} for i, w in words.items() if len(w) >= n}


def test_shingle_links_equal_all_pairs(spark):
    """Shared and frequent shingles, copies, short and null texts, a text inside a longer one: against the comparison of all pairs."""
    rng = random.Random(2)
    common = [" ".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(3)]
    texts = [(i, " ".join([rng.choice(common), *(rng.choice("pqrstuvw") for _ in range(rng.choice((0, 1, 2, 6, 20))))])) for i in range(60)]
    texts += [(100, texts[0][1].upper()), (101, None), (102, ""), (103, "a b"), (104, "a b c"), (105, common[0] + " " + common[1]), (106, "  a  b\tc ")]
    words, sets = shingle_sets(texts)
    least = {}
    for i in sorted(words):
        least.setdefault(words[i], i)
    reps = sorted(i for i in sets if least[words[i]] == i)
    want = set()
    for x, a in enumerate(reps):
        for b in reps[x + 1 :]:
            c = len(sets[a] & sets[b])
            if c >= 0.3 * len(sets[a] | sets[b]) and c >= 0.8 * min(len(sets[a]), len(sets[b])):
                want.add((a, b, round(c / len(sets[a] | sets[b]), 9), round(c / min(len(sets[a]), len(sets[b])), 9)))
    df = spark.createDataFrame(texts, "id long, text string")
    got = {(r.a, r.b, round(r.similarity, 9), round(r.coverage, 9)) for r in structure.shingle_links(df).collect()}
    assert got == want and len(want) > 50
    assert {(r.a, r.b) for r in structure.text_classes(df).collect()} == {(i, least[words[i]]) for i, _ in texts if _ is not None} | {(101, least[()])}


def test_nearest_in_small_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, (40, 4)).astype(float)
    df = spark.createDataFrame([(i % 2, i, x[i].tolist()) for i in range(40)], "group int, id long, v array<double>")
    want = set()
    for i in range(40):
        others = sorted((round(float(np.sqrt(((x[i] - x[j]) ** 2).sum())), 6), j) for j in range(40) if j != i and j % 2 == i % 2)[:5]
        want |= {(i % 2, i, j, d, r) for r, (d, j) in enumerate(others, 1)}
    for block in (2048, 6):
        assert {tuple(r) for r in structure.knn_edges(df, k=5, block=block).select("group", "src", "dst", "distance", "rank").collect()} == want


def test_targets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TARGETS_PER_BLOCK", 3)
    items = spark.createDataFrame([(i, [math.sin(i), math.cos(i)]) for i in range(30)], "ligand_id long, v array<double>")
    targets = spark.createDataFrame([(t, [float(t), 1.0]) for t in range(8)], "target_id long, v array<double>")
    assert vectors.score_pairs(items, targets).select("target_id", "ligand_id").distinct().count() == 240
    assert vectors.top_scored(items, targets, 0.1).count() == 24


def test_joint_fit(spark):
    """The gradient against differences, and a fit that separates hits and orders scores."""
    rng = np.random.default_rng(3)
    f, y = rng.standard_normal((50, 4)), rng.integers(0, 2, 50).astype(float)
    z = np.where(rng.random(50) < 0.3, np.nan, rng.standard_normal(50))
    p = rng.standard_normal(9)
    _, g = vectors.joint_loss(f, y, z, p, 0.2)
    for i in range(9):
        d = np.zeros(9)
        d[i] = 1e-6
        assert (vectors.joint_loss(f, y, z, p + d, 0.2)[0] - vectors.joint_loss(f, y, z, p - d, 0.2)[0]) / 2e-6 == pytest.approx(g[i], rel=1e-4, abs=1e-6)
    truth = f @ np.array([1.0, -1.0, 0.5, 0.0])
    rows = [(f[i].tolist(), int(truth[i] > 0), None if i % 7 == 0 else float(-truth[i])) for i in range(50)]
    df = spark.createDataFrame(rows, "features array<double>, y int, z double")
    done = vectors.predicted(df, vectors.fit_hits(df, steps=40)).toPandas()
    assert ((done["p_hit"] > 0.5) == (done["y"] == 1)).mean() > 0.9 and done["score_pred"].corr(done["z"]) > 0.8
    assert len(vectors.fit_hits(df.limit(0))) == 5


def test_residue_representative_and_other_kinds(spark):
    rows = [(1, 7, 3, "CA", 0.0, 0.0, 2.0, 0.1, "C"), (1, 7, 1, "CA", 0.0, 0.0, 1.0, 0.1, "Q"), (1, 7, 2, "N", 0.0, 0.0, 9.0, 0.4, "HD"), (1, 8, 4, "CB", 2.0, 0.0, 0.0, 0.0, "C")]
    atoms = spark.createDataFrame(rows, "target_id int, res int, line_no int, atom_name string, x double, y double, z double, charge double, ad_type string")
    boxes = spark.createDataFrame([(1, *[0.0] * 3, *[2.0] * 3)], "target_id int, " + ", ".join(f"{c} double" for c in structure.BOX))
    got = {r.res: r for r in structure.residue_features(atoms, boxes, ["C", "HD", "OTHER"]).collect()}
    assert got[7].center_far == pytest.approx(1 / 50) and got[7].charge == pytest.approx(0.2) and (got[7].share_C, got[7].share_HD, got[7].share_OTHER) == (0.5, 0.0, 0.5)
    assert got[8].center_far == pytest.approx(2 / 50)


def test_validation_failures_are_recorded(spark):
    df = spark.createDataFrame([(i, i % 3 == 0) for i in range(30)], "k long, fine boolean")
    order = sorted(range(30), key=lambda i: __import__("hashlib").sha256(f"{i}|s".encode()).hexdigest())
    for n in (4, 50):
        picks = [i for i in order if i % 3 == 0][:n]
        last = order.index(picks[-1]) if n == 4 else 30
        want = {(i, picks.index(i) + 1, False) for i in picks} | {(i, 0, True) for i in order[:last] if i % 3}
        assert {tuple(r) for r in splits.validation_picks(df, "k", "s", n, "fine").collect()} == want
