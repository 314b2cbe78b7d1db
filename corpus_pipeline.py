"""A corpus from raw documents to sampled pieces: five stages, each one operator, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftrank.llm import decontamination, line_dedup, ngram_jaccard, pieces, toxicity
from siftrank.sources import records
from siftrank.sources.checkpoints import released, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; the models learn from the labelled ones.

    Each row is judged by its text, whatever its ``doc_id``: rows without one, repeated rows and different texts under one id too. Null and empty texts have no toxic words and stay. Without labels of
    both classes all stay. An empty table gives an empty one.
    """
    return toxicity.ordinary(docs.select(*COLUMNS), _table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that resemble an earlier line; a document that loses all its words goes.

    Ties do not occur: lines are in the order of ``(doc_id, line)``. Rows without a ``doc_id`` have no place in it and stay as they are, as do null and empty texts. Repeated rows of one id are the same lines:
    they all stay, or lose the same ones. An empty table gives an empty one.
    """
    return line_dedup.remove_lines(docs, line_dedup.duplicate_lines(docs, min_words=1))


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each class of near duplicates, once.

    Rows without a ``doc_id`` stay as they are. Null and empty texts are classes of their own. Of repeated rows of one id one stays. An empty table gives an empty one.
    """
    classes = ngram_jaccard.jaccard_join(docs)
    kept = classes.where("doc_id = class_id").select("doc_id")
    named = docs.select(*COLUMNS).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).hint("merge").join(kept, "doc_id", "left_semi")
    return named.unionByName(docs.select(*COLUMNS).where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that copy or paraphrase no benchmark item.

    Null and empty texts copy nothing and stay. Repeated rows of one ``doc_id`` stay or go together. Rows without an id are judged by their texts. An empty table, or an empty benchmark, takes nothing away.
    """
    docs, benchmark = docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark")
    found = decontamination.contaminated(docs.where("doc_id IS NOT NULL"), benchmark).select("doc_id").distinct()
    kept = docs.where("doc_id IS NOT NULL").hint("merge").join(found, "doc_id", "left_anti").select(*COLUMNS)
    nameless = docs.where("doc_id IS NULL")
    if nameless.isEmpty():
        return kept
    own = nameless.withColumn("key", F.xxhash64("text"))
    bad = decontamination.contaminated(own.select(F.col("key").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("key")).distinct()
    return kept.unionByName(own.hint("merge").join(bad, "key", "left_anti").select(*COLUMNS))


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document, as piece ids, with ``n_pieces``.

    Rows of one ``doc_id`` and text get the same draws, rows without an id draw alike too. Null and empty texts have one segmentation without pieces. An empty table gives an empty one.
    """
    return pieces.encode(docs).withColumn("n_pieces", F.size("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", keep_one_of_each_class),
    ("decontamination", drop_contaminated),
    ("gumbel_pieces", sample_pieces),
]

#: SQL can express neither the models nor the sampling; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, place: str | None = None) -> DataFrame:
    """Apply all stages to ``documents``; what each returns is written as Parquet, made valid by a record, and read again.

    With a ``place`` of one's own, a run that stops is taken up after the last stage that was recorded there for the same ``sf_dir``; without one, everything is made anew in the shared checkpoint folder.
    Tables that a stage stores on its way are removed when its result is written.
    """
    place = place or f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with released(spark):
            docs = records.resumed(spark, place, name, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), inputs=sf_dir)
    return docs
