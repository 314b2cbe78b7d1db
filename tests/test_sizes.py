"""What large tables need: one dealing of rows for one ranking, ranks in sums, hashes taken once, and the same values as the plain way."""

import random

import pytest
from pyspark.sql import functions as F

from siftrank import fixtures as B
from siftrank import queries
from siftrank.operators import components, metrics, numbering, ordered, runstats, structure

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_recalls_deal_their_rows_once(spark):
    rng = random.Random(1)
    rows = [(t, i, rng.random(), rng.random()) for t in range(4) for i in range(50)]
    df = spark.createDataFrame(rows, "target_id long, ligand_id long, score double, p_hit double")
    text = plan(metrics.recalls(df))
    assert text.count("Exchange hashpartitioning") == 1 and "percentile" not in text and "Join" not in text


def test_ranks_in_sums_equal_ranks_of_rows(spark):
    rng = random.Random(2)
    rows = [(k, float(rng.randint(0, 40)) if k else 7.0, rng.random() if rng.random() < 0.5 else 0.25) for k in (0, 1, 2) for _ in range(300 + 200 * k)]
    df = spark.createDataFrame(rows, "k int, x double, y double").repartition(3).localCheckpoint()
    want = ordered.with_average_ranks(df, ["k"], rx=F.col("x"), ry=F.col("y")).groupBy("k").agg(*metrics.moment_columns("rx", "ry"))
    got = ordered.rank_moments(df, ["k"], F.col("x"), F.col("y"))
    for a, b in zip(got.orderBy("k").collect(), want.orderBy("k").collect(), strict=True):
        assert a.asDict() == pytest.approx(b.asDict(), rel=1e-12)


def test_pooled_selectivity_of_large_keys(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(0, c, 11, t, i, rng.choice((None, 1.0, 2.0, rng.random())), float(rng.randint(0, 9))) for c in ("a", "b") for t in range(6) for i in range(40)]
    df = spark.createDataFrame(rows, "fold int, cond string, seed int, target_id long, ligand_id long, score double, logit double")
    want = {r.cond: r.sel_spearman for r in runstats.pooled_selectivity(df).collect()}
    monkeypatch.setattr(ordered, "LARGE", 50)
    got = {r.cond: r.sel_spearman for r in runstats.pooled_selectivity(df).collect()}
    assert got == pytest.approx(want, rel=1e-9) and len(got) == 2


def test_exact_terms_are_whole_or_decimal(spark):
    for scale, kind in ((1.0, "bigint"), (1e9, "decimal(28,12)")):
        df = spark.createDataFrame([(i, None if i == 3 else scale / (i + 3)) for i in range(50)], "k long, x double")
        terms, mean = runstats.exact_terms(df, "x")
        assert dict(terms.dtypes)["x"] == kind
        assert terms.agg(mean("x").alias("m")).first()[0] == df.agg(runstats.exact_mean("x").alias("m")).first()[0]


def test_runs_of_some_conditions_dealt_by_item(spark):
    every = B.runs(spark, SMALL).where("cond = 'dual'")
    own = B.runs(spark, SMALL, ("dual",), by_item=True)
    assert own.exceptAll(every).isEmpty() and every.exceptAll(own).isEmpty()
    assert plan(runstats.deviations(own)).count("Exchange") == 1


def test_reversals_join_wanted_cells_only(spark):
    quads = spark.createDataFrame([(0, 0, 1, 2, 5, 6, 1.0, -1.0)], "fold int, c long, a long, b long, i long, j long, da double, db double")
    cells = [(0, "x", 11, t, i, float(t * (i - 5))) for t in (1, 2, 3) for i in range(9)] + [(0, "y", 11, 1, 5, 0.0)]
    runs = spark.createDataFrame(cells, "fold int, cond string, seed int, target_id long, ligand_id long, logit double")
    out = runstats.reversals(quads, runs)
    assert [(r.cond, r.right) for r in out.collect()] == [("x", 0)]
    assert sum(len(spark.read.parquet(f).columns) == 6 and spark.read.parquet(f).count() == 5 for f in {p.rsplit("/", 1)[0] for p in out.inputFiles()}) == 1


def test_packed_lines_come_back_in_order_and_few_files(spark, tmp_path):
    rows = [(f"t/{t}\t%" if t == 3 else str(t), 40 - n, f"line {n}\twith a tab") for t in range(30) for n in range(40)]
    df = spark.createDataFrame(rows, "target_id string, line_no long, value string").repartition(5)
    structure.write_packed(df, str(tmp_path / "packed"))
    assert len(list((tmp_path / "packed").glob("part-*"))) <= 4
    got = structure.read_packed(spark, str(tmp_path / "packed")).collect()
    for t in {r[0] for r in rows}:
        assert [r.value for r in sorted((r for r in got if r.target_id == t), key=lambda r: r.line_no)] == [r[2] for r in sorted((r for r in rows if r[0] == t), key=lambda r: r[1])]


def test_capped_atoms_are_dealt_by_target_once(spark, monkeypatch):
    monkeypatch.setattr(B, "LINES", 1000)
    text = plan(queries.QUERIES["nearest_capped"](spark, SMALL))
    assert text.count("Exchange hashpartitioning") == 2 and "REPARTITION_BY_NUM" in text and "Broadcast" not in text


def test_ranked_rows_are_dealt_to_more_tasks_when_there_are_more(spark, monkeypatch):
    monkeypatch.setattr(numbering, "TASK_ROWS", 20)
    df = spark.createDataFrame([(t, i, float(i % 7), float(i)) for t in range(4) for i in range(50)], "target_id long, ligand_id long, score double, p_hit double")
    assert "hashpartitioning(target_id" in plan(metrics.recalls(df)) and ", 11), REPARTITION_BY_NUM" in plan(metrics.recalls(df))


def test_shingles_of_one_text_are_kept_in_its_set_only(spark, monkeypatch):
    kept, real = [], structure.stored
    monkeypatch.setattr(structure, "stored", lambda df: kept.append(real(df)) or kept[-1])
    words = lambda k: " ".join(f"w{k}_{i}" for i in range(60))
    texts = spark.createDataFrame([(k, words(k)) for k in range(20)] + [(30, words(3) + " more")], "id long, text string")
    assert [(r.a, r.b) for r in structure.shingle_links(texts).collect()] == [(3, 30)]
    assert max(t.count() for t in kept if dict(t.dtypes).get("s") == "bigint") == 2 * 58


def test_links_deal_no_text_and_no_row_for_a_shingle_of_one_text(spark, monkeypatch):
    """Sets, texts and their shingles are not stored or dealt as they are: only what several texts have becomes rows; in many parts the links are the same, and repeated rows of one id are one text."""
    rng = random.Random(11)
    common = [" ".join(rng.choice("abcd") for _ in range(15)) for _ in range(2)]
    texts = [(i, " ".join([rng.choice(common), *(rng.choice("pqrs") + str(i // 2) for _ in range(rng.choice((0, 3, 12))))])) for i in range(80)]
    df = spark.createDataFrame([*texts, texts[0], texts[5]], "id long, text string")
    want = {tuple(r) for r in structure.shingle_links(df).collect()}
    kept, real = [], structure.stored
    monkeypatch.setattr(structure, "stored", lambda df: kept.append(real(df)) or kept[-1])
    monkeypatch.setattr(structure, "SHINGLES", 100, raising=False)
    assert {tuple(r) for r in structure.shingle_links(df).collect()} == want and len(want) > 20
    words = {i: t.split() for i, t in texts}
    sets = {i: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} for i, w in words.items()}
    several = {i: {x for x in s if sum(x in o for o in sets.values()) > 1} for i, s in sets.items()}
    arrays = [t for t in kept if dict(t.dtypes).get("s") == "array<bigint>"]
    assert arrays and all(len(r.s) <= len(several[r.id]) for t in arrays for r in t.collect())
    assert not any({"w", "text"} & set(t.columns) for t in kept)


def test_components_of_texts_in_small_blocks(spark, monkeypatch):
    """Sets of one least shingle in many blocks: the same components, and a set is sent once to each two blocks."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(30)]
    texts = spark.createDataFrame([(i, " ".join(base[:28] if i < 3 else base + [f"x{i}"] * rng.randint(0, 3) if i < 30 else [f"y{i % 4}_{j}" for j in range(10)])) for i in range(50)], "id long, text string")
    query = lambda: {tuple(r) for r in components.connected_components(structure.shingle_links(texts).select("a", "b").union(structure.text_classes(texts))).collect()}
    want = query()
    monkeypatch.setattr(structure, "BLOCK", 3)
    assert query() == want and len({c for _, c in want}) == 5
