"""Operator 12 against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from siftrank.llm import near_dedup, queries
from tests.llm.fixtures import DOCS, corpus, frame, prose

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, n=4):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, percent=80):
    """``doc_id -> (n_shingles, component_id, kept)``; a document of several texts is linked as any of them is."""
    texts = [(i, shingles(t)) for i, t in {(r[0], r[1]) for r in rows} if i is not None]
    top = {i: i for i, _ in texts}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    at = defaultdict(list)
    for k, (_, s) in enumerate(texts):
        for x in s:
            at[x].append(k)
    for k, (i, s) in enumerate(texts):
        for m in {m for x in s for m in at[x] if m < k}:
            j, t = texts[m]
            if 100 * len(s & t) >= percent * len(s | t):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    size = defaultdict(int)
    for i, s in texts:
        size[i] = max(size[i], len(s))
    return {i: (size[i], find(i), find(i) == i) for i in size}


def got(df):
    rows = [r for r in df.collect() if r.doc_id is not None]
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}


def docs_of(texts):
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def test_query_equals_brute_force_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.op12_near_dedup(spark, sf)) == brute(rows)


def test_awkward_rows(spark):
    """Nulls, empty and very long texts, repeated rows, several texts under one id, rows without one, white space that is not ASCII's, capitals that are not."""
    rng = random.Random(4)
    long = prose(rng, 30_000)
    rows = corpus() + [(200, long, "en", None, 1), (201, long + " And one more.", "en", "s", 1)]
    rows += [(5, rows[9][1], None, None, None), (300, rows[9][1], "en", "s", 1), (301, "A\xa0b c\x85d É e", "en", "s", 1), (302, "a\xa0b c\x85d É E", "en", "s", 1), (303, "a\xa0b c\x85d é e", "en", "s", 1)]
    rows += [(None, rows[0][1], "en", "s", 1), (None, None, "en", "s", 1)]
    out = near_dedup.near_duplicates(frame(spark, rows))
    want = brute(rows)
    assert got(out) == want and want[5][1] == want[300][1] and want[301][1] == want[302][1] != want[303][1]
    nameless = sorted((r.n_shingles, r.component_id, r.kept) for r in out.where("doc_id IS NULL").collect())
    assert nameless == [(0, None, True), (len(shingles(rows[0][1])), None, True)]


@pytest.mark.parametrize("block", [3, 512])
def test_links_that_no_star_sees(spark, monkeypatch, block):
    """Copies with more and more changes: many are near each other, not near their bucket's least member."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(block)
    texts = []
    for _ in range(6):
        w = prose(rng, 160).split()
        for k in range(25):
            v = list(w)
            for x in range(k % 9):
                v[(13 * x + 5 * (k // 9)) % len(v)] = f"new{k}x{x}"
            texts.append(" ".join(v))
        for k in range(12):  # a chain
            w = list(w)
            w[(7 * k) % len(w)] = f"step{k}"
            w[(7 * k + 90) % len(w)] = f"more{k}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    rows = docs_of(texts)
    want = brute(rows)
    assert got(near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(5))) == want
    assert len({c for _, c, _ in want.values()}) < len(rows) / 3


def test_copies_and_short_texts(spark):
    rng = random.Random(1)
    texts = ["one", "ONE", "one two", "One  two", "one two three", "one two three four", "one two three four", "a b c d e", "a b c d f", "", " \n", None] + [prose(rng, 12) for _ in range(30)]
    texts += [t + " x" for t in texts[12:]] + [texts[12]] * 50
    rows = docs_of(texts)
    assert got(near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(4))) == brute(rows)


def test_same_under_every_partitioning(spark):
    """Two texts under one id keep the links of both."""
    rng = random.Random(8)
    a, b = prose(rng, 120), prose(rng, 120)
    rows = [(1, a, "", "", 1), (1, b, "", "", 1), (2, a + " end", "", "", 1), (3, b + " end", "", "", 1), (0, prose(rng, 50), "", "", 1)]
    for parts in (1, 3, 7):
        out = got(near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(parts)))
        assert out == brute(rows) and out[3][1] == out[2][1] == 1


def test_bins_agree_as_often_as_sets_do():
    """Also of sets with fewer elements than bins, where most values are borrowed."""
    rng = np.random.default_rng(3)
    for size in (4, 40, 400):
        agree, exact = [], []
        for _ in range(60):
            common, own = rng.integers(0, 1 << 63, size, dtype=np.uint64), [rng.integers(0, 1 << 63, max(1, size // 8), dtype=np.uint64) for _ in range(2)]
            sets = [np.unique(np.concatenate([common, x])) for x in own]
            v = near_dedup.one_permutation(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]), 145, 12)
            agree.append((v[0] == v[1]).mean())
            exact.append(len(common) / (len(common) + sum(map(len, own))))
        assert abs(np.mean(agree) - np.mean(exact)) < 0.02


def test_empty(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
