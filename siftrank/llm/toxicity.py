"""Operator 8. Toxicity: class-conditional Kneser-Ney word models, compared by length-normalised log-likelihood.

The labelled documents give counts of words in toxic and in ordinary text. Each class discounts its own counts (modified Kneser-Ney discounts) and
gives the mass it gains to one shared backoff distribution, the counts of both classes together. A rare expression thus has nearly the same probability
in both classes, and one that neither has seen the same but for a constant. Words are lower-cased runs between white space without punctuation at their
ends.

A text's features are its log-likelihood ratio for each word, and the ratios of its two most toxic words (so that a long text does not dilute them). A
logistic curve turns them into a score. It is fitted on labelled documents that the models have not counted,
a sample of at most ``CALIBRATION`` rows; the models count all the others. Labels, language, source and ``doc_id`` are no inputs of a score.

The model table ``(word, ratio)`` is broadcast behind a check of its size (``MODEL_ROWS``); a larger one stays sharded, and the documents' words are
joined to it. Both give the same sums.

Learned from: labelled rows whose crc32 of the ``doc_id`` as text, modulo 4, is 0 or 1 (counts) or 3 (curve). Never from 2.

Null and empty texts have all features 0. Repeated labels of one document count once, as toxic if any says so; null labels count as none. Without
labels of both classes every score is the same. A row with a null ``doc_id`` is scored by its text, is not held out, and teaches nothing. An empty table gives an empty result. Extra columns are ignored. Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftrank.llm import arrays as A
from siftrank.llm import kneser_ney as K
from siftrank.sources.checkpoints import cut

CLASSES = ("toxic", "ordinary")
FEATURES = ("mean_ratio", "top_ratio", "next_ratio")
MODEL_ROWS = 6_000_000
CALIBRATION = 20_000
THRESHOLD = 0.3
#: Up to this many labels are broadcast to the scan of documents; more are joined by a shuffle.
LABEL_ROWS = 500_000


def part(column: str = "doc_id") -> Column:
    """The part, from 0 to 3, that a document belongs to."""
    return F.crc32(F.encode(F.col(column).cast("string"), "UTF-8")) % 4


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """An inner join on ``doc_id`` whose label side is broadcast only behind a check of its size."""
    small = labels.count() <= LABEL_ROWS
    return docs.join(F.broadcast(labels) if small else labels.hint("merge"), "doc_id")


def word_counts(learned: DataFrame) -> DataFrame:
    """``(word, toxic, ordinary)``: a word's count in each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in A.pieces_of(whole, "text", 8_000_000):
                h, offsets = A.bare_hashes(batch.column("text"))
                words, inverse = np.unique(h, return_inverse=True)
                n = np.bincount(inverse, minlength=len(words)).astype(np.int64)
                bad = np.bincount(inverse, np.repeat(np.asarray(batch.column("toxic")), np.diff(offsets)), len(words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(A.signed(words)), pa.array(bad), pa.array(n - bad)], names=["word", *CLASSES])

    counts = learned.select("text", "toxic").mapInArrow(run, "word long, toxic long, ordinary long")
    return counts.groupBy("word").agg(*(F.sum(c).alias(c) for c in CLASSES))


def ratios(learned: DataFrame) -> tuple[DataFrame, float]:
    """The model table ``(word, ratio)`` and the ratio of any other word; ``learned`` has ``text`` and ``toxic``, 0 or 1."""
    counts = cut(word_counts(learned))
    d = {c: K.discounts(counts, c) for c in CLASSES}
    sums = counts.agg(*(F.sum(c).alias(c) for c in CLASSES), *(F.sum(K._taken(c, d[c])).alias(f"left_{c}") for c in CLASSES)).first()
    if not sums["toxic"] or not sums["ordinary"]:
        return counts.select("word", F.lit(0.0).alias("ratio")), 0.0
    shared = (F.col("toxic") + F.col("ordinary")) / F.lit(float(sums["toxic"] + sums["ordinary"]))
    gamma = {c: sums[f"left_{c}"] / sums[c] for c in CLASSES}
    p = {c: (F.col(c) - K._taken(c, d[c])) / F.lit(float(sums[c])) + shared * gamma[c] for c in CLASSES}
    other = float(np.log(gamma["toxic"] / gamma["ordinary"]))
    return counts.select("word", (F.log(p["toxic"]) - F.log(p["ordinary"])).alias("ratio")), other


def features(docs: DataFrame, model: DataFrame, other: float, model_rows: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, mean_ratio, top_ratio, next_ratio)`` of each row of ``docs``, and its columns ``carry``."""
    if model.count() > model_rows:
        return _features_joined(docs, model, other, carry)
    rows = model.toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(K.HashTable(rows.column("word").to_numpy().view(np.uint64), rows.column("ratio").to_numpy()).plain())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = K.HashTable.of(shared.value)
        for whole in batches:
            for batch in A.pieces_of(whole, "text", 1_000_000):
                h, offsets = A.bare_hashes(batch.column("text"))
                value = table.find(h, other)
                size = np.diff(offsets)
                owner = np.repeat(np.arange(len(size)), size)
                total = np.bincount(owner, value, len(size))
                value = value[np.lexsort((-value, owner))]
                best, full = np.zeros((2, len(size))), [size > 0, size > 1]
                for k in (0, 1):
                    best[k, full[k]] = value[offsets[:-1][full[k]] + k]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), pa.array(total / np.maximum(size, 1)), pa.array(best[0]), pa.array(best[1]), *(batch.column(c) for c in carry)],
                    names=["doc_id", *FEATURES, *(f"own_{c}" for c in carry)],
                )

    extra = "".join(f", own_{c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select("doc_id", "text", *(c for c in carry if c not in ("doc_id", "text"))).mapInArrow(run, "doc_id long, mean_ratio double, top_ratio double, next_ratio double" + extra)


def _features_joined(docs: DataFrame, model: DataFrame, other: float, carry: tuple[str, ...]) -> DataFrame:
    """The same for a model too large to broadcast: each text's counted words meet the sharded model; frequent words are spread by a salt.

    Each row has its own key, on disk before it is used twice: rows without a ``doc_id``, or with the same one, stay apart.
    """
    docs = cut(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", *(F.col(c).alias(f"own_{c}") for c in carry)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in A.pieces_of(whole, "text"):
                h, offsets = A.bare_hashes(batch.column("text"))
                rows = batch.column("row").take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(offsets))))
                yield pa.RecordBatch.from_arrays([rows, pa.array(A.signed(h))], names=["row", "word"])

    salts = 16
    rows = docs.select("row", "text").mapInArrow(run, "row long, word long").groupBy("row", "word").agg(F.count("*").alias("n"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    spread = model.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    rated = rows.hint("merge").join(spread, ["word", "salt"], "left").select("row", "n", F.coalesce("ratio", F.lit(other)).alias("ratio"))
    mean = rated.groupBy("row").agg((F.sum(F.col("ratio") * F.col("n")) / F.sum("n")).alias("mean_ratio"))
    twice = rated.withColumn("copy", F.explode(F.when(F.col("n") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    top = twice.withColumn("k", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("ratio")))).where("k <= 2")
    top = top.groupBy("row").agg(F.max("ratio").alias("top_ratio"), F.max(F.when(F.col("k") == 2, F.col("ratio"))).alias("next_ratio"))
    scored = docs.drop("text").hint("merge").join(mean, "row", "left").hint("merge").join(top, "row", "left")
    return scored.select("doc_id", *(F.coalesce(f, F.lit(0.0)).alias(f) for f in FEATURES), *(f"own_{c}" for c in carry))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic curve on the features and a constant, by Newton steps with a small ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, model_rows: int = MODEL_ROWS) -> tuple[DataFrame, float, np.ndarray]:
    """The model table, the ratio of unknown words, and the weights of the curve."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    marks = cut(marks.withColumn("part", part()).where("part <> 2"))
    texts = docs.select("doc_id", "text")
    model, other = ratios(with_labels(texts, marks.where("part < 2")).select("text", "toxic"))
    model = cut(model)
    sample = marks.where("part = 3").orderBy(F.xxhash64("doc_id")).limit(CALIBRATION)
    seen = features(with_labels(texts, cut(sample)), model, other, model_rows, ("toxic",)).toPandas()
    y = seen["own_toxic"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return model, other, np.array([0.0] * len(FEATURES) + [-5.0])
    x = seen[list(FEATURES)].to_numpy()
    scale = np.maximum(x.std(0), 1e-9)
    return model, other, fit_curve(x / scale, y) / np.append(scale, 1.0)


def scored(docs: DataFrame, fitted: tuple[DataFrame, float, np.ndarray], carry: tuple[str, ...] = (), model_rows: int = MODEL_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted``, the features and the columns ``carry`` (as ``own_<name>``) of each row of ``docs``."""
    model, other, w = fitted
    z = sum((F.col(f) * float(v) for f, v in zip(FEATURES, w, strict=False)), F.lit(float(w[-1])))
    return features(docs, model, other, model_rows, carry).withColumn("score", 1 / (1 + F.exp(-z))).select(
        "doc_id", F.coalesce(part() == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *FEATURES, *(f"own_{c}" for c in carry)
    )


def toxicity(docs: DataFrame, labels: DataFrame, model_rows: int = MODEL_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the features, for each row of ``docs``."""
    return scored(docs, fit(docs, labels, model_rows), (), model_rows)


def ordinary(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns; they are filtered where they are scanned."""
    kept = scored(docs, fit(docs, labels), tuple(docs.columns)).where("predicted = 0")
    return kept.select(*(F.col(f"own_{c}").alias(c) for c in docs.columns))
