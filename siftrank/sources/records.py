"""Stage outputs that count only once a record of them is written, so that a job that stops can be taken up where it stopped.

A table is written aside, under a name of its own; then one record says where it is, what columns and how many rows it has and, on request, its fingerprint. What has no record was not finished, whatever files there are. A table is used
again only if its columns and rows are those of its record, and if it was made from the same ``inputs``, which is any text that names them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftrank.operators import labels
from siftrank.sources.checkpoints import exists

RECORD = "name string, inputs string, path string, columns string, rows long, fingerprint string, written timestamp"


def records(spark: SparkSession, folder: str) -> DataFrame:
    """All records of a folder, with ``complete``: whether it is its name's last one."""
    if exists(spark, f"{folder}/records"):
        found = spark.read.schema(RECORD).option("recursiveFileLookup", "true").json(f"{folder}/records")
    else:
        found = spark.createDataFrame([], RECORD)
    last = found.groupBy("name", "inputs").agg(F.max_by("path", "written").alias("last"))
    return found.hint("merge").join(last, ["name", "inputs"]).withColumn("complete", F.col("path") == F.col("last")).drop("last")


def mark(table: DataFrame) -> str:
    return labels.fingerprint(labels.row_marks(table)).first()["fingerprint"]


def commit(df: DataFrame, folder: str, name: str, inputs: str = "", fingerprinted: bool = False) -> DataFrame:
    """Write a table and then its record; returns the table as it is read back. A fingerprint costs one more scan."""
    spark, own = df.sparkSession, f"{name}-{uuid.uuid4().hex}"
    path = f"{folder}/data/{own}"
    df.write.parquet(path)
    table = spark.read.parquet(path)
    row = [(name, inputs, path, table.schema.simpleString(), table.count(), mark(table) if fingerprinted else None)]
    record = spark.createDataFrame(row, "name string, inputs string, path string, columns string, rows long, fingerprint string")
    record.withColumn("written", F.current_timestamp()).coalesce(1).write.json(f"{folder}/records/{own}")
    return table


def committed(spark: SparkSession, folder: str, name: str, inputs: str = "") -> DataFrame | None:
    """The table of a name's last record, or None: no record, other inputs, or files that are not those of the record."""
    row = records(spark, folder).where((F.col("name") == name) & (F.col("inputs") == inputs) & F.col("complete")).first()
    if row is None or not exists(spark, row["path"]):
        return None
    table = spark.read.parquet(row["path"])
    fine = table.schema.simpleString() == row["columns"] and table.count() == row["rows"] and (row["fingerprint"] is None or mark(table) == row["fingerprint"])
    return table if fine else None


def resumed(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame], inputs: str = "", fingerprinted: bool = False) -> DataFrame:
    """The committed table of a name, made now if there is none."""
    found = committed(spark, folder, name, inputs)
    return commit(make(), folder, name, inputs, fingerprinted) if found is None else found
