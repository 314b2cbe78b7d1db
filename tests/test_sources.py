"""Files in, files out."""

import json

from siftrank.operators import runstats
from siftrank.sources import tables


def test_score_matrix(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("key\tA\tB\nx\t-1.5\tn/a\ny\tnan\t\n")
    rows = tables.read_score_matrix(spark, str(tmp_path / "m.tsv"), ["key"], ["A", "B"]).orderBy("key").collect()
    assert [tuple(r) for r in rows] == [("x", -1.5, None), ("y", None, None)]
    two = tables.read_delimited(spark, str(tmp_path / "m.tsv"), "key string, A double, B string", ["key", "A"])
    assert sorted(map(tuple, two.collect())) == [("x", -1.5), ("y", None)]


def test_registries(spark, tmp_path):
    (tmp_path / "registry_f0_dual_R0_s11.json").write_text(json.dumps({"fold": 0, "smoke": False, "updates": 10}, indent=1))
    (tmp_path / "registry_f1_dual_const_R0_s22.json").write_text(json.dumps({"tag": "f1_dual_const_R0_s22", "smoke": True}))
    runs = tables.read_registries(spark, str(tmp_path / "registry_*.json"), "tag string, fold int, smoke boolean, updates long")
    tags = spark.createDataFrame([("f0_dual_R0_s11",), ("f1_dual_const_R0_s22",)], "tag string")
    assert [tuple(r) for r in runstats.discover(runs, tags, tags).collect()] == [("f0_dual_R0_s11", 0, "dual", "R0", 11)]
    assert runstats.discover(runs, tags, tags, include_smoke=True).count() == 2


def test_discovery_of_files(spark, tmp_path):
    for tag, record in (("f0_dual_R0_s11", {"smoke": False}), ("f1_dual_R0_s11", {"fold": 7}), ("f2_dual_R0_s11", {"smoke": True}), ("f3_dual_R0_s11", {}), ("f4_dual_R0_s11", {})):
        (tmp_path / f"registry_{tag}.json").write_text(json.dumps(record))
        if tag[1] != "3":
            (tmp_path / f"metrics_{tag}.csv").write_text("x")
        if tag[1] != "4":
            (tmp_path / f"curve_{tag}.csv").write_text("x")
    found = lambda **kw: sorted(tuple(r) for r in tables.discover_runs(spark, str(tmp_path), "fold int, smoke boolean", **kw).collect())
    assert found() == [("f0_dual_R0_s11", 0, "dual", "R0", 11), ("f1_dual_R0_s11", 7, "dual", "R0", 11)]
    assert [r[0] for r in found(include_smoke=True)] == ["f0_dual_R0_s11", "f1_dual_R0_s11", "f2_dual_R0_s11"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, float("inf"), [1, 2]), (2, 0.5, None)], "k long, x double, a array<int>")
    tables.write_json(df.drop("a"), str(tmp_path / "j"))
    assert sorted(map(tuple, spark.read.schema("k long, x double").json(str(tmp_path / "j")).collect())) == [(1, None), (2, 0.5)]
    tables.write_delimited(df, str(tmp_path / "c"))
    assert sorted(r.k for r in spark.read.csv(str(tmp_path / "c"), header=True, schema="k long, x double, a string").collect()) == [1, 2]
