"""Texts of 25,000 words and words of 200,000 characters, and whole results of operators 3, 6 and 9 against brute force."""

import random

import numpy as np

from siftrank.llm import arrays, decontamination, line_dedup, near_dedup, nearest, ngram_jaccard, substring_dedup
from tests.llm.fixtures import DOCS, corpus, frame, prose
from tests.llm.test_dedup import brute_lines, got_lines, unique_docs
from tests.llm.test_search import smith_waterman


def test_long_texts(spark):
    """A long text and a near copy of it, another, and two very long words: each operator reads them to their ends."""
    rng = random.Random(21)
    long = prose(rng, 25_000)
    words = long.split(" ")
    for k in rng.sample(range(20_000), 200):
        words[k] = "changed"
    item = " ".join(words[23_000:23_040])
    texts = [long, " ".join(words), prose(rng, 25_000), "y" * 200_000, "y" * 200_000 + "z"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngram_jaccard.jaccard_join(df).collect()} == {0: (0, 1), 1: (0, 1), 2: (2, 0), 3: (3, 0), 4: (4, 0)}
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    assert got_lines(line_dedup.duplicate_lines(df)) == brute_lines(unique_docs(rows))
    passages = [(r.doc_id, r.begin, r.end) for r in substring_dedup.repeated_passages(df).collect()]
    assert {d for d, _, _ in passages} == {1}
    assert sum(e - b for _, b, e in passages) > 0.7 * len(texts[1]) and max(e for _, _, e in passages) == len(texts[1])
    found = decontamination.contaminated(df, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.score) for r in found.collect()} == {(0, 7, 1.0), (1, 7, 1.0)}


def test_decontamination_equals_brute_force(spark):
    """Every text aligned with every item: the same pairs, with the same scores, on both sides of the threshold."""
    rng = random.Random(14)
    items = [(i, prose(rng, 24)) for i in range(5)]
    rows = []
    for i in range(16):
        copy = items[i % 5][1].split()
        if i % 3 == 0:
            copy = copy[: len(copy) * (3 + i % 7) // 10]
        elif i % 3 == 1:
            copy[i % 7 :: 8] = ["edited"] * len(copy[i % 7 :: 8])
        rows.append((i, f"{prose(rng, 20)} {' '.join(copy)} {prose(rng, 20)}", "en", "s", 1))
    rows += [(90, None, None, None, None), (91, "", "", "", 0), (92, "one", "", "", 3)]
    bare = lambda t: [w.strip(arrays.PUNCTUATION) for w in (t or "").lower().split()]
    want = {}
    for i, text, *_ in rows:
        for j, other in items:
            score = smith_waterman(bare(other), bare(text)) / (2 * len(bare(other))) if text else 0
            if score >= 0.5:
                want[(i, j)] = score
    got = decontamination.contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.score for r in got.collect()} == want
    assert 0 < len(want) < 16


def test_cells_within_reach_equal_brute_force():
    """The walk down the tree against the distances of all points to the boxes of all cells."""
    rng = np.random.default_rng(5)
    splits = nearest.Splits(rng.standard_normal((900, 4)), 37)
    points, reach = rng.standard_normal((60, 4)) * 2, rng.random(60) * 3
    reach[:2] = np.inf, 0
    boxes = {}

    def walk(node, low, high):
        if node < 0:
            boxes[-node - 1] = low, high
            return
        axis, at, left, right = splits.nodes[node]
        walk(left, low, np.where(np.arange(4) == axis, at, high))
        walk(right, np.where(np.arange(4) == axis, at, low), high)

    walk(splits.root, np.full(4, -np.inf), np.full(4, np.inf))
    assert len(boxes) == splits.cells == 37
    want = {(i, c) for i, p in enumerate(points) for c, (x, y) in boxes.items() if (np.maximum(np.maximum(x - p, p - y), 0) ** 2).sum() <= reach[i]}
    assert {(int(i), c) for rows, c in splits.within(points, reach) for i in rows} == want
    assert {(i, int(c)) for i, c in enumerate(splits.cell(points))} <= want


def test_short_lines_whose_word_hashes_agree(spark, monkeypatch):
    """Lines of one to three words are equal by their whole word hashes, not by the part of them that orders words."""
    monkeypatch.setattr(line_dedup, "_LOW", np.uint64(7))
    texts = ["\n".join(f"w{i * k % 50} v{k}" if k % 2 else f"u{i * k % 60}" for k in range(20)) for i in range(12)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    assert got_lines(line_dedup.duplicate_lines(spark.createDataFrame(rows, DOCS), min_words=1)) == brute_lines(unique_docs(rows), least=1)


def test_word_counts_equal_brute_force(spark):
    import pyarrow as pa

    want = np.zeros(1 << line_dedup.RARITY_BITS, np.uint32)
    for row in corpus():
        for h in arrays.string_hash(pa.array((row[1] or "").lower().split(), pa.string())):
            want[int(h) & (len(want) - 1)] += 1
    assert (line_dedup.rarity(frame(spark)) == want).all()
    assert not line_dedup.rarity(frame(spark).limit(0)).any()
