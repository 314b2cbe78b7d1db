"""The thin queries ``opN_<name>``: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftrank.llm import decontamination, hard_negatives, line_dedup, near_dedup, nearest, ngram_jaccard, pieces, quality, sharding, substring_dedup, toxicity, url_lists, variants


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), substring_dedup.MIN_WORDS, take_in=True)


def op2_gumbel_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = pieces.encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return drawn.select("doc_id", "draw", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "perturbed", "log_inclusion", "round_trip")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_lists.evaluate(url_lists.dated_pages(pages), url_lists.dated_entries(pages), "page_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.duplicate_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_words=1)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(variants.counted_words(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op12_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.whole_vectors(rows.withColumn("label", moved)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_gumbel_pieces": op2_gumbel_pieces,
    "op3_nearest": op3_nearest,
    "op4_url_lists": op4_url_lists,
    "op5_quality": op5_quality,
    "op6_line_dedup": op6_line_dedup,
    "op7_sharding": op7_sharding,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_variants": op11_variants,
    "op12_near_dedup": op12_near_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE_SQL: dict[str, str] = {"op4_url_lists": url_lists.ORACLE}
