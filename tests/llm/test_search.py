"""Operators 3, 4, 7, 9 and the pipeline."""

import random
import zlib
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftrank.llm import arrays as A
from siftrank.llm import decontamination, kneser_ney, nearest, sharding, url_lists
from siftrank.sources import checkpoints
from tests.llm.fixtures import DOCS, corpus, frame, prose, words


def test_nearest_recall_and_ties(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CELL", 300)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1200, 24)).astype("float32")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:400] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(5000, None), (5020, [0.0] * 24), (5040, [None] * 24), (5060, [float("nan")] * 24), (5080, [1.0]), (None, [1.0] * 24), (5100, [])]
    df = spark.createDataFrame(rows + bad + rows[:3], "vec_id long, embedding array<float>")
    got = {}
    for r in nearest.search(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 1200, 20))
    exact = x.astype(float)
    hits = 0
    for q, rows_ in got.items():
        rows_.sort()
        s = exact @ exact[q]
        s[q] = -np.inf
        assert [r[0] for r in rows_] == list(range(1, 21))
        assert all(abs(r[2] - s[r[1]]) < 1e-9 for r in rows_)
        assert rows_ == sorted(rows_, key=lambda r: (-r[2], r[1]))
        hits += len({r[1] for r in rows_} & set(sorted(range(len(s)), key=lambda j: (-round(s[j], 12), j))[:20]))
    assert hits / (20 * len(got)) >= 0.9
    tied = [r[1] for r in got[120]]
    assert tied == [i for i in range(100, 122) if i != 120][:20]


def test_nearest_over_several_cells(spark, monkeypatch):
    """Recall over many cells, rows and queries in several blocks, most queries in one cell, extra columns: against brute force."""
    for name, value in (("CELL", 150), ("BLOCK", 20), ("LEAF", 32)):
        monkeypatch.setattr(nearest, name, value)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((2000, 16)) * np.linspace(2, 0.2, 16)
    x[::20][:60] = x[0] + rng.standard_normal((60, 16)) * 0.01
    df = spark.createDataFrame([(i, v.tolist(), i, -1, "c") for i, v in enumerate(x)], "vec_id long, embedding array<double>, cell int, rank int, v string")
    got = {}
    for r in nearest.search(df).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = 0
    for q in range(0, 2000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(got[q]) & set(np.argsort(-s, kind="stable")[:20].tolist()))
        assert len(got[q]) == 20 and all(v == pytest.approx(s[i], rel=1e-12) for i, v in got[q].items())
    assert hits >= 0.9 * 2000


def test_nearest_takes_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in nearest.search(df).orderBy("query_id", "rank").collect()] == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]
    assert nearest.search(df.limit(0)).count() == 0


def test_chi_square():
    assert nearest.chi_square_quantile(0.95, 8) == pytest.approx(15.5073, abs=1e-3)


def test_url_lists(spark):
    t = datetime(2024, 1, 1)
    captures = [(1, "https://a.b.example.com/x/y", t), (2, "http://A.B.example.com:80/x", t + timedelta(5)), (3, "nonsense", t), (4, None, t), (5, "https://b.example.com/", None), (6, "https://u@other.org?q", t + timedelta(9))]
    entries = [
        ("b.example.com", "block", t - timedelta(1)), ("b.example.com", "remove", t + timedelta(3)), ("a.b.example.com/x", "allow", t + timedelta(4)), ("other.org", "allow", t),
        ("other.org", "block", t), (None, "block", t), ("other.org", "block", None),
    ]
    got = url_lists.evaluate(spark.createDataFrame(captures, "page_id long, url string, fetched timestamp"), spark.createDataFrame(entries, "pattern string, action string, effective timestamp"), "page_id")
    assert {r.page_id: (r.verdict, r.pattern) for r in got.collect()} == {1: ("block", "b.example.com"), 2: ("allow", "a.b.example.com/x"), 3: ("none", None), 4: ("none", None), 5: ("none", None), 6: ("block", "other.org")}


def test_url_lists_with_null_and_repeated_keys(spark):
    """Verdicts go by URL and time: null keys, one key with two URLs, repeated rows, clashing columns; and empty tables."""
    t = datetime(2024, 1, 1)
    url = "https://b.example.com/x"
    captures = [(None, url, t), (None, "https://free.org/", t), (7, url, t), (7, "https://free.org/", t), (7, url, t)]
    entries = spark.createDataFrame([("b.example.com", "block", t - timedelta(1), "x", 1)], "pattern string, action string, effective timestamp, url string, fetched int")
    df = spark.createDataFrame([(*c, "a", "h", 3) for c in captures], "page_id long, url string, fetched timestamp, action string, host string, best int")
    got = sorted(((r.page_id is None, r.host, r.verdict) for r in url_lists.evaluate(df, entries, "page_id").collect()), key=str)
    assert got == sorted([(True, "b.example.com", "block"), (True, "free.org", "none"), (False, "b.example.com", "block"), (False, "b.example.com", "block"), (False, "free.org", "none")], key=str)
    assert url_lists.evaluate(df.limit(0), entries, "page_id").count() == 0
    assert {r.verdict for r in url_lists.evaluate(df, entries.limit(0), "page_id").collect()} == {"none"}
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_lists.evaluate(url_lists.dated_pages(pages), url_lists.dated_entries(pages), "page_id").count() == 0


def plain_best_fit(sizes, capacity, shards):
    """Best-fit decreasing, one group after the other over a plain list of shards."""
    room = [capacity] * shards
    for s in sorted(sizes, reverse=True):
        fits = [(r, k) for k, r in enumerate(room) if r >= s]
        if not fits:
            return None
        room[min(fits)[1]] -= s
    return sorted(room)


def test_runs_of_equal_groups_pack_like_single_groups():
    """The packing of the histogram against best-fit decreasing over single groups."""
    rng = random.Random(8)
    for _ in range(200):
        sizes = [rng.choice((1, 2, 3, 5, 8, 13)) for _ in range(rng.randint(1, 40))]
        shards, capacity = rng.randint(1, 6), rng.randint(10, 60)
        histogram = sorted({s: sizes.count(s) for s in sizes}.items(), reverse=True)
        runs = sharding.best_fit(histogram, capacity, shards)
        want = plain_best_fit(sizes, capacity, shards)
        assert (runs is None) == (want is None)
        if runs is not None:
            room = [capacity] * shards
            for size, shard, n in runs:
                room[shard] -= size * n
            assert sorted(room) == want and min(room) >= 0


def test_shards(spark):
    rows = corpus()
    got = sharding.shard_by_bytes(frame(spark), shards=5).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    place, load = {}, {}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None
        assert place.setdefault(texts[r.doc_id], r.shard) == r.shard
        load[r.shard] = load.get(r.shard, 0) + r["size"]
    for s in range(5):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert max(load.values()) <= max(1.02 * sum(load.values()) / 5, max(len((t or "").encode()) + 8 for t in texts.values()) * 1.5)
    assert sharding.shard_by_bytes(spark.createDataFrame([], DOCS)).count() == 0


def test_a_large_group_leaves_no_shard_empty(spark):
    """Equal texts that are a third of all rows get a shard of their own, and the other shards stay near equal."""
    rng = random.Random(6)
    texts = [prose(rng, 40) for _ in range(600)]
    texts[::3] = [texts[0]] * 200
    got = sharding.shard_by_bytes(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)).collect()
    load, alone = {}, {r.shard for r in got if r.doc_id % 3 == 0}
    for r in got:
        load[r.shard] = load.get(r.shard, 0) + r["size"]
    assert len(got) == 600 and set(load) == set(range(24)) and len(alone) == 1
    rest = [n for s, n in load.items() if s not in alone]
    assert max(rest) <= 1.05 * sum(rest) / 23 and min(rest) >= 0.9 * sum(rest) / 23


@pytest.mark.parametrize("large", [[1500], [1500, 1100], [8000, 900, 900]])
def test_groups_above_an_even_share_are_alone(large):
    histogram = [(s, 1) for s in set(large)] + [(10, 800), (7, 2000)]
    histogram = [(s, large.count(s) or n) for s, n in histogram]
    load = [0] * 24
    runs = sharding.pack(histogram, 24, 0.0005)
    for size, shard, n in runs:
        load[shard] += size * n
    assert {s: sum(n for size, _, n in runs if size == s) for s, _ in histogram} == dict(histogram)
    own = {shard for size, shard, _ in runs if size in large and size * 24 > sum(load)}
    rest = [n for s, n in enumerate(load) if s not in own]
    assert min(rest) >= 0.95 * sum(rest) / len(rest) and max(rest) <= 1.05 * sum(rest) / len(rest)


def test_best_fit_decreasing():
    assert sharding.best_fit([(6, 1), (5, 1), (4, 1), (3, 2)], 11, 2) == [(6, 0, 1), (5, 0, 1), (4, 1, 1), (3, 1, 2)]
    assert sharding.best_fit([(6, 3)], 11, 2) is None


def smith_waterman(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_brute_force():
    rng = random.Random(2)
    pairs = [([rng.randint(2, 6) for _ in range(rng.randint(1, 12))], [rng.randint(2, 6) for _ in range(rng.randint(1, 20))]) for _ in range(200)]
    score, first, last = decontamination._aligned([(np.array(a, np.uint64), np.array(b, np.uint64)) for a, b in pairs])
    assert score.tolist() == [smith_waterman(a, b) for a, b in pairs]
    assert all(smith_waterman(a, b[x:y]) == s for (a, b), s, x, y in zip(pairs, score, first, last))


def test_decontamination_finds_copies_and_edits(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, 30)) for i in range(12)] + [(50, None), (51, ""), (52, "a b")]
    rows, want = [], set()
    for i in range(60):
        text = prose(rng, 60)
        if i % 3 == 0:
            item, copy = items[i % 12]
            w = copy.split()
            if i % 2:
                for k in range(3, len(w), 9):
                    w[k] = "edited"
            text = prose(rng, 20) + " " + " ".join(w) + " " + prose(rng, 20)
            want.add((i, item))
        rows.append((i, text, "en", "s", 1))
    df = spark.createDataFrame(rows + corpus()[-12:-3], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, bench).collect()}
    assert got == want
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, bench, block_words=150).collect()} == want
    assert decontamination.contaminated(df, bench.limit(0)).count() == 0
    assert decontamination.contaminated(df.limit(0), bench).count() == 0


def test_seeds_are_the_rarest_of_each_window():
    """Against a plain loop over windows; items shorter than a window, and one that is too short for a run."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.choice((2, 3, 4, 7, 30)))) for _ in range(40)]
    items = decontamination.Items(pa.table({"item_id": list(range(40)), "text": texts}), 3)
    counts = np.array([int(g % np.uint64(5)) for g in items.gram])
    want = set()
    for i in set(items.item.tolist()):
        own = np.flatnonzero(items.item == i)
        for x in range(max(1, len(own) - 3)):
            want.add((i, int(items.offset[own[x + int(np.argmin(counts[own[x : x + 4]]))]])))
    gram, item, offset = items.seeds(counts, 4)
    assert set(zip(item.tolist(), offset.tolist())) == want and len(item) == len(want) and (np.diff(gram.astype(object)) >= 0).all()


def test_a_seed_that_many_items_share(spark, monkeypatch):
    """Items that all begin alike: their hits are looked at a few at a time, with the same result."""
    rng = random.Random(6)
    start = prose(rng, 12)
    bench = spark.createDataFrame([(i, start + " " + prose(rng, 8)) for i in range(30)], "item_id long, text string")
    df = spark.createDataFrame([(i, prose(rng, 20) + " " + start + " " + prose(rng, 30), "en", "s", 1) for i in range(20)], DOCS)
    want = decontamination.contaminated(df, bench).orderBy("doc_id", "item_id").collect()
    assert len(want) == 600
    for hits in (100, 7):
        monkeypatch.setattr(decontamination, "HITS", hits)
        assert decontamination.contaminated(df, bench).orderBy("doc_id", "item_id").collect() == want


def test_decontamination_with_clashing_columns(spark):
    rng = random.Random(7)
    leak = prose(rng, 30)
    bench = spark.createDataFrame([(1, leak, 5, "x"), (1, leak, 6, "y")], "item_id long, text string, doc_id long, score string")
    df = spark.createDataFrame([(3, leak, 1, "s"), (None, leak, 2, "s"), (None, leak + " more", 2, "s"), (4, None, 2, "s"), (5, "", 1, "t")], "doc_id long, text string, item_id long, gram string")
    got = {(r.doc_id, r.item_id, r.score) for r in decontamination.contaminated(df, bench).collect()}
    assert got == {(3, 1, 1.0), (None, 1, 1.0)}


def test_indices_above_single_precision():
    keys = A.mix(np.arange(1, 1001, dtype=np.uint64))
    values = np.arange(17_000_000, 17_001_000, dtype=np.int64)
    table = kneser_ney.HashTable(keys, values)
    assert (table.find(keys, -1) == values).all() and (table.find(keys + np.uint64(1), -1) == -1).all()


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    rows = corpus(8, 30)
    leak = prose(rng, 30)
    rows += [(500, prose(rng, 30) + "\n" + leak, "en", "s", 1), (501, " ".join([*words(rng, 20), "grobwort", "grobwort", *words(rng, 20), "grobwort"]), "en", "s", 1)]
    marks = [(i, 1, 0) for i in range(30)]
    for i in range(600, 700):
        toxic = i % 2
        rows.append((i, " ".join([*words(rng, 30), *(["grobwort"] * 3 if toxic else []), *words(rng, 10)]), "en", "s", 1))
        marks.append((i, 1, toxic))
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert 501 not in kept[0] and 500 in kept[2] and 500 not in kept[3]
    assert kept[3] <= kept[2] <= kept[1] <= kept[0]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == kept[3] and all(r.round_trip for r in out.collect())


def test_pipeline_stages_take_awkward_tables(spark, tmp_path):
    """Null ids, repeated rows, clashing columns and empty tables, stage by stage."""
    rng = random.Random(12)
    leak, other = prose(rng, 40), prose(rng, 40)
    spark.createDataFrame([(i, 1, i % 2) for i in range(1000, 1400)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(i, " ".join([*words(rng, 30), *(["grobwort"] * 3 if i % 2 else [])]), "en", "s", 1) for i in range(1000, 1400)]
    extra = [(None, leak, "en", "s", 1), (None, other, None, None, None), (None, None, "en", "s", None), (60, "", "en", "s", 0), (61, None, None, None, None), (62, leak, "en", "s", 1), (62, leak, "en", "s", 1)]
    df = frame(spark, rows + extra)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        if name != "gumbel_pieces":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
        got = [(r.doc_id, r.text) for r in out.select("doc_id", F.col("text") if "text" in out.columns else F.lit("").alias("text")).collect()]
        if name == "toxicity":
            assert len([i for i, _ in got if i is None]) == 3 and {60, 61, 62} <= {i for i, _ in got}
        if name == "line_dedup":
            assert sorted(t or "" for i, t in got if i is None) == sorted(["", leak, other]) and {60, 61} <= {i for i, _ in got}
        if name == "ngram_jaccard":
            assert [i for i, _ in got].count(62) == 1 and len([i for i, _ in got if i is None]) == 3 and {60, 61} <= {i for i, _ in got}
        if name == "decontamination":
            assert sorted(t or "" for i, t in got if i is None) == sorted(["", other]) and 62 not in {i for i, _ in got} and {60, 61} <= {i for i, _ in got}
        if name == "gumbel_pieces":
            assert len([i for i, _ in got if i == 62]) == 4 and len([i for i, _ in got if i == 60]) == 1


def test_url_query_equals_sql(spark):
    from pathlib import Path

    import duckdb

    from siftrank.llm import queries

    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{data}/pages.parquet'")
    want = {r[0]: r[1:] for r in con.execute(queries.ORACLE_SQL["op4_url_lists"]).fetchall()}
    got = {r.page_id: tuple(r)[1:] for r in queries.QUERIES["op4_url_lists"](spark, str(data)).collect()}
    assert got == want


def test_pipeline_is_resumed_after_a_failed_stage(spark, tmp_path, monkeypatch):
    """Stages that were recorded are not run again, and what they stored on their way is removed."""
    spark.createDataFrame(corpus(8, 5), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    calls, inner = [], []

    def stage(name, fails):
        def f(spark, docs, sf_dir):
            calls.append(name)
            inner.append(checkpoints.stored(docs.limit(3)))
            if fails and calls.count(name) == 1:
                raise RuntimeError("an executor too many is lost")
            return docs.where(F.coalesce(F.col("doc_id"), F.lit(-1)) != len(name)).withColumn(name, F.lit(1))

        return f

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, stage(n, n == "ccc")) for n in ("a", "bb", "ccc", "dddd")])
    place = str(tmp_path / "place")
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, str(tmp_path), place)
    out = corpus_pipeline.run(spark, str(tmp_path), place)
    assert calls == ["a", "bb", "ccc", "ccc", "dddd"] and {"a", "bb", "ccc", "dddd"} <= set(out.columns)
    assert out.where("doc_id IN (1, 2, 3, 4)").count() == 0 < out.count()
    for table in inner:
        assert not checkpoints.exists(spark, table.inputFiles()[0])
