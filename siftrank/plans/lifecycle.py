"""Job lists, resumable outputs, label stores, learning curves and timing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftrank.functions import scalar as S


def parse_jobs(specs: DataFrame, spec: str = "spec") -> DataFrame:
    """``fold, cond, base, const_target, recipe, seed`` of comma-separated ``fold:cond:recipe:seed`` jobs that are valid: recipe R1 is for dual and xattn only."""
    rows = specs.select(F.explode(F.split(spec, ",")).alias("job")).select(F.split("job", ":").alias("p")).where(F.size("p") == 4)
    rows = rows.select(F.col("p")[0].try_cast("int").alias("fold"), F.trim(F.col("p")[1]).alias("cond"), F.trim(F.col("p")[2]).alias("recipe"), F.col("p")[3].try_cast("int").alias("seed"))
    base = F.regexp_replace("cond", "_const$", "")
    fine = F.col("recipe").isin("R0") | (F.col("recipe").isin("R1") & F.col("cond").isin("dual", "xattn"))
    return rows.where("fold IS NOT NULL AND seed IS NOT NULL").where(fine).select("fold", "cond", base.alias("base"), F.col("cond").endswith("_const").alias("const_target"), "recipe", "seed")


def unfinished(requested: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs without a complete record; a partial record is redone."""
    return requested.hint("merge").join(finished.where("complete").select(*keys).distinct(), keys, "left_anti")


def write_labels(cells: DataFrame, path: str) -> None:
    """One partition for each pair of roles; a rerun replaces the partitions that it writes."""
    cells.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("target_role", "ligand_role").parquet(path)


def read_labels(spark: SparkSession, path: str, target_role: str, ligand_role: str, allow_test: bool = False, schema=None) -> DataFrame:
    """One cell, pruned to its partition. Test roles raise unless they are allowed. With a schema no file is opened to find one."""
    if not allow_test and "test" in (target_role, ligand_role):
        raise PermissionError("test cells are closed")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path).where((F.col("target_role") == target_role) & (F.col("ligand_role") == ligand_role))


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON; numbers that are not finite become null."""
    kinds = dict(df.dtypes)
    clean = [S.finite(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("json"))


def early_stop(curve: DataFrame, patience: int, by: list[str]) -> DataFrame:
    """Where training stops: ``updates, best_update, best, reason`` of each curve of ``update, metric``.

    A row is an improvement if it is larger than all before it; the first row ``patience`` evaluations after the last improvement ends the run.
    """
    order = Window.partitionBy(*by).orderBy("update")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = curve.withColumn("i", F.row_number().over(order)).withColumn("better", F.coalesce(F.col("metric") > F.max("metric").over(before), F.col("metric").isNotNull()))
    rows = rows.withColumn("last", F.max(F.when(F.col("better"), F.col("i"))).over(upto))
    rows = rows.withColumn("stop", F.min(F.when(F.col("i") - F.col("last") >= patience, F.col("i"))).over(Window.partitionBy(*by)))
    kept = rows.where("stop IS NULL OR i <= stop")
    best = F.max(F.when(F.col("better"), F.struct("i", "update", "metric")))
    return kept.groupBy(*by).agg(F.max("update").alias("updates"), best.alias("b"), F.max("stop").alias("stop")).select(
        *by, "updates", F.col("b.update").alias("best_update"), F.col("b.metric").alias("best"), F.when(F.col("stop").isNull(), "end").otherwise("patience").alias("reason")
    )


def epochs(curve: DataFrame, batch: int, pairs: int) -> DataFrame:
    return curve.withColumn("epoch", F.col("update") * batch / pairs)


def best_rate(calls: DataFrame) -> DataFrame:
    """``mode, rate``: the largest, over call sizes, of the median rate of calls that are no warm-up."""
    rate = F.try_divide(F.col("n_ok"), F.col("sec"))
    medians = calls.where("NOT warmup").groupBy("mode", "n").agg(F.median(rate).alias("rate"))
    return medians.groupBy("mode").agg(F.max("rate").alias("rate"))


def library_days(rates: DataFrame, items: int, targets: int) -> DataFrame:
    return rates.withColumn("days", F.try_divide(F.lit(items * targets), F.col("rate")) / 86_400)


def stage_ratios(blocks: DataFrame, baseline: str) -> DataFrame:
    """``network, p, model_s, total_s, pairs_per_s, ratio``: stages summed, with the shared preparation, against the baseline network at the same number of targets.

    ``blocks`` has ``network, p, n_pairs, prep_s, embed_s, score_s, select_s``.
    """
    sums = blocks.withColumn("model_s", F.col("embed_s") + F.col("score_s") + F.col("select_s")).withColumn("total_s", F.col("model_s") + F.col("prep_s"))
    base = sums.where(F.col("network") == baseline).select("p", F.col("total_s").alias("base_s"))
    return sums.join(base, "p", "left").select("network", "p", "model_s", "total_s", F.try_divide(F.col("n_pairs"), F.col("total_s")).alias("pairs_per_s"), F.try_divide(F.col("total_s"), F.col("base_s")).alias("ratio"))
