"""Commit records, resumption, and tables that are removed."""

import os

import pytest
from pyspark.sql import functions as F

from siftrank.operators import structure
from siftrank.sources import checkpoints, records


def test_work_is_resumed_where_it_stopped(spark, tmp_path):
    folder, made = str(tmp_path / "jobs"), []

    def make(n):
        def f():
            made.append(n)
            if n == 3 and made.count(3) == 1:
                raise RuntimeError("lost")
            return spark.range(n)

        return f

    def run(inputs="x"):
        return [records.resumed(spark, folder, f"s{n}", make(n), inputs, fingerprinted=n == 2).count() for n in (1, 2, 3, 4)]

    with pytest.raises(RuntimeError):
        run()
    assert run() == [1, 2, 3, 4] and made == [1, 2, 3, 3, 4]
    assert run() == [1, 2, 3, 4] and made == [1, 2, 3, 3, 4]
    assert run("y") == [1, 2, 3, 4] and made[5:] == [1, 2, 3, 4]


def test_only_whole_tables_count(spark, tmp_path):
    folder = str(tmp_path / "jobs")
    assert records.committed(spark, folder, "a") is None and records.records(spark, folder).count() == 0
    spark.range(5).write.parquet(f"{folder}/data/a-stopped")
    assert records.committed(spark, folder, "a") is None
    records.commit(spark.range(7), folder, "a", fingerprinted=True)
    records.commit(spark.range(9), folder, "a", fingerprinted=True)
    assert records.committed(spark, folder, "a").count() == 9
    assert [r.rows for r in records.records(spark, folder).where("complete").collect()] == [9]
    path = records.records(spark, folder).where("complete").first()["path"]
    spark.range(8, -1, -1).withColumn("id", F.col("id") * 2).write.mode("overwrite").parquet(path)
    assert records.committed(spark, folder, "a") is None


def test_stored_tables_are_removed(spark, tmp_path):
    kept = checkpoints.stored(spark.range(3))
    with checkpoints.released(spark):
        inner = checkpoints.stored(spark.range(4))
        place = inner.inputFiles()[0].removeprefix("file://")
        assert inner.count() == 4 and os.path.exists(place)
    assert not os.path.exists(place) and kept.count() == 3


def test_lines_of_split_files_keep_their_order(spark, tmp_path):
    """A file that is read in many splits."""
    lines = spark.createDataFrame([(t, i, f"{t} line {i} " + "x" * (i % 50)) for t in ("a", "b") for i in range(3000)], "target_id string, line_no long, value string").repartition(4)
    structure.write_lines(lines, str(tmp_path / "lines"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        back = structure.read_lines(spark, str(tmp_path / "lines"))
        assert back.rdd.getNumPartitions() > 10
        for t in ("a", "b"):
            got = [r.value for r in back.where(F.col("target_id") == t).orderBy("line_no").collect()]
            assert got == [f"{t} line {i} " + "x" * (i % 50) for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
