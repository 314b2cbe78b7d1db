"""Score tables: reshaping, audits, thresholds, labels and fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from siftrank.functions import scalar as S
from siftrank.operators import ordered as O
from siftrank.sources.checkpoints import stored


def unpivot_scores(wide: DataFrame, ids: list[str], targets: list[str]) -> DataFrame:
    """Long form of a score matrix, missing scores kept."""
    return wide.unpivot(ids, targets, "target_id", "score")


def pivot_scores(long: DataFrame, targets: list[str]) -> DataFrame:
    """The matrix of a long table, for small exports."""
    return long.groupBy("ligand_id").pivot("target_id", targets).agg(F.first("score"))


def column_profile(long: DataFrame) -> DataFrame:
    """Valid and missing cells, range, mean and sample deviation of each target."""
    return long.groupBy("target_id").agg(
        F.count("score").alias("valid"), F.count_if(F.col("score").isNull()).alias("missing"), F.min("score").alias("min"), F.max("score").alias("max"),
        F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"),
    )


def matrix_profile(long: DataFrame) -> DataFrame:
    """One row for the whole table: cells, missing cells, and the range of all scores."""
    return long.agg(F.count("*").alias("cells"), F.count_if(F.col("score").isNull()).alias("missing"), F.min("score").alias("min"), F.max("score").alias("max"))


def key_audit(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys and rows beyond the first of their key; null is a key of its own only for the last."""
    groups = df.groupBy(key).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(key).alias("distinct_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def thresholds(pairs: DataFrame, q: float = 0.01) -> DataFrame:
    """The exact quantile of each target's scores, linear between neighbours."""
    rows = stored(pairs.where("score IS NOT NULL AND NOT isnan(score)").select("target_id", "score"))
    return O.quantiles(rows, ["target_id"], "score", [q]).select("target_id", F.col("t")[0].alias("tau"))


def with_hits(pairs: DataFrame, tau: DataFrame) -> DataFrame:
    return pairs.join(tau, "target_id", "left").withColumn("y", S.hit(F.col("score"), F.col("tau")))


def scaler(pairs: DataFrame) -> DataFrame:
    """One row: mean and sample deviation of the present scores."""
    return pairs.agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"))


def standardised(pairs: DataFrame, scale: DataFrame) -> DataFrame:
    return pairs.crossJoin(F.broadcast(scale)).select(*pairs.columns, F.try_divide(F.col("score") - F.col("mean"), F.col("std")).alias("z"), F.col("score").isNotNull().cast("int").alias("has_score"))


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed."""
    return df.join(ids, key, "left_semi")


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without nulls or NaN in the columns."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c))
    return df


def set_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many distinct keys only one side has, and whether the sets are equal."""
    a, b = a.select(key).distinct(), b.select(key).distinct()
    left = a.join(b, key, "left_anti").agg(F.count("*").alias("only_left"))
    right = b.join(a, key, "left_anti").agg(F.count("*").alias("only_right"))
    return left.crossJoin(F.broadcast(right)).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def id_fingerprint(df: DataFrame, key: str) -> DataFrame:
    """A fingerprint of a set of ids that their order does not change; the list is of ids only, one row for each group of 4,096 hash buckets first."""
    ids = df.select(F.col(key).cast("string").alias("k")).distinct()
    parts = ids.groupBy(F.substring(F.sha2("k", 256), 1, 3).alias("bucket")).agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("k"))), 256).alias("h"), F.count("*").alias("n"))
    return parts.agg(F.sum("n").alias("ids"), F.sha2(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"])), 256).alias("fingerprint"))


def row_marks(df: DataFrame) -> DataFrame:
    """The mergeable state of a table's fingerprint, one row: ``rows, sa, sb, xa, xb``. States of parts that share no rows add up to that of the whole, see :func:`fingerprint`.

    A row's hash is SHA-256 of its columns in their order, each as text with its length before it, so that null, empty text and text that looks like two columns differ. Sums and xors of two of its 60-bit parts know no order of
    rows, and repeated rows change the sums.
    """
    text = lambda c: F.when(F.col(c).isNull(), "n").otherwise(F.concat(F.lit("v"), F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")))
    hashed = df.select(F.sha2(F.concat(*(text(f"`{c}`") for c in df.columns)), 256).alias("h"))
    part = lambda at: F.conv(F.substring("h", at, 15), 16, 10).cast("long")
    wide = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(19,0)")), F.lit(0)).cast("decimal(38,0)")
    xor = lambda c: F.coalesce(F.bit_xor(c), F.lit(0).cast("long"))
    return hashed.select(part(1).alias("a"), part(16).alias("b")).agg(F.count("*").alias("rows"), wide("a").alias("sa"), wide("b").alias("sb"), xor("a").alias("xa"), xor("b").alias("xb"))


def fingerprint(states: DataFrame) -> DataFrame:
    """``rows, fingerprint`` of the table whose parts have these states."""
    whole = states.agg(F.sum("rows").alias("rows"), F.sum("sa").alias("sa"), F.sum("sb").alias("sb"), F.bit_xor("xa").alias("xa"), F.bit_xor("xb").alias("xb"))
    return whole.select("rows", F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in whole.columns)), 256).alias("fingerprint"))


def factorise(df: DataFrame, key: str, order: str) -> DataFrame:
    """Dense codes of keys by first appearance: ``key, code``.

    Codes come from counts of each range of first appearances, so no window holds all keys.
    """
    first = df.groupBy(key).agg(F.min(order).alias("first"))
    bucket = first.withColumn("bucket", F.floor(F.col("first") / 4096))
    sizes = bucket.groupBy("bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("before", before).drop("n")
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("first", key)) - 1
    return bucket.withColumn("inside", inside).join(offsets, "bucket").select(key, (F.col("inside") + F.col("before")).alias("code"))


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    """Number of groups, rows and the largest group."""
    return df.groupBy(key).agg(F.count("*").alias("n")).agg(F.count("*").alias("groups"), F.sum("n").alias("rows"), F.max("n").alias("largest"))


def manifest(cells: DataFrame) -> DataFrame:
    """Rows and valid scores of each label cell."""
    return cells.groupBy("target_role", "ligand_role").agg(F.count("*").alias("rows"), F.count("score").alias("valid"))


def apply_rows(df: DataFrame, column: str, function: Callable[[str], str]) -> DataFrame:
    """Apply a caller's function to each value; a failure keeps its row, with a status and no result: ``..., result, status``."""
    schema = StructType([*df.schema.fields, StructField("result", StringType()), StructField("status", StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            results, states = [], []
            for value in frame[column]:
                try:
                    if value is None:
                        raise ValueError("null")
                    results.append(function(value))
                    states.append("OK")
                except Exception:
                    results.append(None)
                    states.append("PARSE_FAIL")
            yield frame.assign(result=results, status=states)

    return df.mapInPandas(run, schema)


def normalised_rows(df: DataFrame, column: str) -> DataFrame:
    """:func:`apply_rows` with the built-in normaliser, without Python: ``..., result, status``."""
    return df.withColumn("result", normalised_text(column)).withColumn("status", F.when(F.col(column).isNull(), "PARSE_FAIL").otherwise("OK"))


def normalised_text(text: str = "text"):
    """The built-in normaliser: lower case, runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " "))
