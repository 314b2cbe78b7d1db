"""Small corpora with the awkward cases that every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha")) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(rng: random.Random, n: int) -> str:
    out, left = [], n
    while left > 0:
        k = min(left, rng.randint(4, 14))
        out.append(" ".join(words(rng, k)).capitalize() + "." + ("\n" if rng.random() < 0.3 else " "))
        left -= k
    return "".join(out).strip()


def corpus(seed: int = 5, n: int = 40) -> list[tuple]:
    """Prose with exact and near copies, a shared passage, empty, null, short, repeated and very long texts."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(20, 150)) for _ in range(n)]
    texts += texts[:3] * 2
    for t in texts[3:8]:
        w = t.split(" ")
        for _ in range(2):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    shared = prose(rng, 70)
    texts += [prose(rng, 30) + " " + shared + " " + prose(rng, 20) for _ in range(3)]
    texts += ["", None, "one", "two words", " \n\t ", "Ünïcödé 日本 😀 text\twith\ttabs", "same " * 300, "x" * 5000, prose(rng, 3000)]
    rows = [(i, t, "en" if i % 3 else "fr", None if i % 7 == 0 else f"src{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[1]]


def frame(spark, rows=None):
    """The corpus as a table, with extra columns whose names clash with those that operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus() if rows is None else rows, DOCS).repartition(3)
    return df.withColumn("d1", F.lit("x")).withColumn("rep", F.lit(1)).withColumn("n", F.lit(None).cast("int")).withColumn("word", F.lit("w"))
