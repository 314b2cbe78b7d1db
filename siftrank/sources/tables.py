"""Readers and writers of delimited, JSON and Parquet tables, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftrank.functions import scalar as S
from siftrank.operators import runstats


def read_delimited(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, sep: str = "\t") -> DataFrame:
    """A delimited file with a header and a known schema; only the wanted columns are parsed. NaN becomes null."""
    df = spark.read.csv(path, schema=schema, sep=sep, header=True, enforceSchema=False)
    df = df if columns is None else df.select(*columns)
    return df.select(*(S.finite(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def read_score_matrix(spark: SparkSession, path: str, ids: list[str], targets: list[str], sep: str = "\t") -> DataFrame:
    """A wide score matrix: identifiers as text, one number for each target, missing where the cell is no number."""
    schema = ", ".join(f"`{c}` string" for c in [*ids, *targets])
    raw = spark.read.csv(path, schema=schema, sep=sep, header=True, enforceSchema=False)
    return raw.select(*ids, *(S.to_number(F.col(f"`{t}`")).alias(t) for t in targets))


def read_registries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record for each multi-line JSON file of a pattern, with the file's name as ``tag`` where it holds none."""
    rows = spark.read.schema(schema).json(path, multiLine=True).withColumn("_file", F.regexp_extract(F.col("_metadata.file_name"), r"^(?:registry_)?(.+)\.json$", 1))
    tag = F.coalesce(F.col("tag"), F.col("_file")) if "tag" in rows.columns else F.col("_file")
    return rows.withColumn("tag", tag).drop("_file")


def file_tags(spark: SparkSession, folder: str, prefix: str, ending: str) -> DataFrame:
    """``tag`` of each file ``<prefix><tag><ending>`` of a folder; files are listed, not read. A folder without any gives an empty table."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*{ending}").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.substring(name, len(prefix) + 1, F.length(name) - len(prefix) - len(ending)).alias("tag"))


def discover_runs(spark: SparkSession, folder: str, schema: str, include_smoke: bool = False) -> DataFrame:
    """Runs of a folder of ``registry_<tag>.json``, ``metrics_<tag>.csv`` and ``curve_<tag>.csv``: those with all three, missing fields filled in from the tag; see :func:`runstats.discover`."""
    registries = read_registries(spark, f"{folder}/registry_*.json", schema)
    return runstats.discover(registries, file_tags(spark, folder, "metrics_", ".csv"), file_tags(spark, folder, "curve_", ".csv"), include_smoke)


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    """Delimited files with a header; a column of arrays or maps is written as JSON."""
    nested = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*nested).write.mode("overwrite").csv(path, sep=sep, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; numbers that are not finite become null."""
    df.select(*(S.finite(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
