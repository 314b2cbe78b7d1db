"""Operator 11 against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftrank.llm import queries, variants
from tests.llm.fixtures import DOCS, corpus, frame

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute_words(rows, least=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n):
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_apart(v, w)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: v if v is not None and n[v] >= 5 * n[w] else None for w, v in best.items()}
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n.get(form[w]), root)
    return out


def got(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def test_query_equals_brute_force_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(brute_words(rows))
    assert got(queries.op11_variants(spark, sf)) == want and len(want) > 500


def test_runs_of_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in corpus()] + [(None, "Straße Àbcdef×ghij " * 9), (7, "ÉCOLES école écoles " * 8), (7, None)]
    df = frame(spark, [(*r, "en", None, 1) for r in rows])
    words = variants.counted_words(df)
    assert {r.word: r.n for r in words.collect()} == brute_words(rows)
    assert got(variants.variants(words)) == brute(brute_words(rows))


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_neighbours_over_the_borders_of_ranges(spark, parts):
    """Words with long common beginnings and ends, runs of one letter, chains of forms, and one of 30,000 letters."""
    rng = random.Random(parts)
    n = {}
    for _ in range(500):
        w = rng.choice(("aaaaaa", "abcabc", "aaaaab", "zzzzzz")) + "".join(rng.choice("ab") for _ in range(rng.randrange(5))) + rng.choice(("", "ation", "ationes"))
        n[w] = rng.choice((5, 5, 6, 25, 130, 700))
    n |= {"bcdefgh": 5, "bcdefghi": 25, "bcdefghij": 125, "bcdefghijk": 625, "bcdefghijkl": 3125, "x" * 30_000: 7, "x" * 29_999: 40}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        table = spark.createDataFrame(list(n.items()), "word string, n long")
        assert got(variants.variants(table)) == brute(n)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_trie_numbers_are_those_of_prefixes(monkeypatch):
    """Each prefix has one number, whatever the chunks and borders are."""
    monkeypatch.setattr(variants, "CELLS", 40)
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(300)})
    cuts = [0, 1, 2, 50, 51, 120, len(words)]
    ranges = [words[a:b] for a, b in zip(cuts, cuts[1:])]
    borders = variants.Borders([(i, r[0], r[-1]) for i, r in enumerate(ranges)])
    seen, numbers = {}, set()
    for i, r in enumerate(ranges):
        trie = variants.Trie(*borders.parts[i])
        for part in (r[:3], r[3:]):
            if part:
                points = np.array([ord(c) for w in part for c in w], np.int64)
                offsets = np.concatenate([[0], np.cumsum([len(w) for w in part])])
                flat = trie.paths(points, offsets)
                for w, at in zip(part, offsets):
                    for d in range(1, len(w) + 1):
                        assert seen.setdefault(w[:d], flat[at + d - 1]) == flat[at + d - 1]
    assert len(set(seen.values())) == len(seen)


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], DOCS)
    assert variants.variants(variants.counted_words(empty)).count() == 0
    one = spark.createDataFrame([(1, "Wonderful " * 5, "en", "s", 1)], DOCS).withColumn("id", F.lit(1)).withColumn("word", F.lit(None).cast("string"))
    assert got(variants.variants(variants.counted_words(one))) == {"wonderful": (5, 0, None, None, "wonderful")}
