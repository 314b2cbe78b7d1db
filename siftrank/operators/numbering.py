"""Gapless numbers over rows of any number: ranges and counts of ranges, never a window over all rows of a key. And broadcasts behind a check."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftrank.sources.checkpoints import stored

#: Rows up to which a side is broadcast.
SMALL = 4096


def broadcast_small(rows: DataFrame, most: int = SMALL) -> DataFrame:
    """The rows, to be broadcast if there are ``most`` at most, and to be joined by a shuffle if there are more."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows.hint("merge")


#: Rows of a task, on average, where rows are dealt out to be sorted by keys.
TASK_ROWS = 1_000_000


def dealt(rows: DataFrame, count: int, keys: list[str]) -> DataFrame:
    """``count`` rows dealt by keys, in tasks that hold no more of them when there are more rows; up to the session's own number of tasks Spark deals them."""
    tasks = count // TASK_ROWS + 1
    return rows.repartition(tasks, *keys) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def numbered_within(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Add numbers from 0 inside each combination of ``keys`` (all rows, if there are none), in the order given. Rows that agree in keys and order are numbered in any order."""
    dealt = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = stored(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    runs = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    # a row for each range that holds part of a key
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # a row for each key and range: as many as keys and ranges together, so the table itself is seldom dealt again
    joined = placed.join(broadcast_small(stored(runs), 100_000), [*keys, "_part"])
    return joined.select(*rows.columns, (F.col("_at") - F.col("_from") + F.col("_before")).alias(name))
