"""Operator 5. Quality classifier: an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Trusted text is the text of documents labelled with quality 1. Three of four of them (by the crc32 of ``doc_id``) are counted; sharded count joins turn the counts
into the model, which gives every document its perplexity for each character. The others set each language's threshold: the ``QUANTILE`` of their perplexities, so that
text like the trusted text is kept whatever its language. A document is kept if its perplexity is at most its language's threshold.

Null and empty texts have a null perplexity and are not kept. A language (null is one) without held-out trusted documents takes the threshold over all languages; without
any, all that has a perplexity is kept. Repeated rows are judged alike; a row with a null ``doc_id`` is judged by its text and teaches nothing, since no label is its own. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrank.llm import kneser_ney as K
from siftrank.llm.toxicity import part, with_labels
from siftrank.operators.numbering import broadcast_small
from siftrank.sources.checkpoints import cut

ORDER = 5
QUANTILE = 0.995


def language_model(texts: DataFrame) -> tuple[DataFrame, float]:
    """The model table ``(key, value)`` of natural logs and the log floor of a character that no order holds."""
    counts = cut(K.gram_counts(texts.withColumn("n", F.lit(1)), ORDER, ["n"]))
    p, gamma, floor = K.lower_orders(counts, ORDER)
    p[ORDER], gamma[ORDER] = K.interpolated(counts, ORDER, "n", p[ORDER - 1])
    parts = [K.keyed(p[k], "gram", k, k, F.log("p")) for k in p]
    parts += [K.keyed(gamma[k], "context", k - 1, 100 + k, F.log("gamma")) for k in gamma]
    return K.union_all(parts), math.log(max(floor, 1e-12))


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, model_rows: int = K.MODEL_ROWS) -> DataFrame:
    """``doc_id, lang, chars, perplexity, threshold, keep`` for each row of ``docs``."""
    trusted = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality > 0")
    trusted = cut(trusted.select("doc_id", part().alias("part")))
    model, floor = language_model(with_labels(docs.select("doc_id", "text"), trusted.where("part <> 2")).select("text"))
    perplexity = F.when(F.col("chars") > 0, F.exp(-F.col("total") / F.greatest("chars", F.lit(1))))
    rows = cut(K.score(docs, model, ORDER, 1, floor, model_rows, ("lang",)).select("doc_id", "lang", "chars", perplexity.alias("perplexity")))
    fresh = with_labels(rows.where("perplexity IS NOT NULL"), trusted.where("part = 2"))
    at = F.percentile_approx("perplexity", quantile, 10_000).alias("own")
    by_lang = fresh.groupBy("lang").agg(at)
    overall = fresh.agg(at.alias("any"))
    return (
        rows.join(broadcast_small(cut(by_lang.withColumnRenamed("lang", "l"))), F.col("lang").eqNullSafe(F.col("l")), "left").crossJoin(F.broadcast(overall))
        .withColumn("threshold", F.coalesce("own", "any", F.lit(float("inf"))))
        .select("doc_id", "lang", "chars", "perplexity", "threshold", F.coalesce((F.col("perplexity") <= F.col("threshold")).cast("int"), F.lit(0)).alias("keep"))
    )
