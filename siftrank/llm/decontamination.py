"""Operator 9. Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

1. Every run of ``n`` words of a test item is a possible seed. One scan of the corpus counts all of them (sums are shuffled, not documents).
2. Of every ``spread`` consecutive runs of an item the rarest is its seed. Each item keeps seeds wherever an unedited stretch of
   ``n + spread - 1`` words is left, even an item that a third of all documents quote: rarity chooses among an item's seeds and drops none for good.
3. A second scan finds the seeds in each text. Hits of one item on neighbouring diagonals make a passage, which is aligned with the item, word by word
   (match 2, mismatch and gap -1). The score is divided by that of a perfect copy.

Items are broadcast in blocks of about ``WORDS`` words, so what a task holds of the benchmark is bounded however large it is; documents are never
shuffled. Hits are looked at ``HITS`` at a time, a text that has more by parts of the items, so a seed that many items share makes more steps, not larger ones. Words are lower-cased, without punctuation at their ends.

Null and empty texts hold no passages; items of fewer than ``n`` words, null ones among them, are not searched for. Repeated rows with one ``doc_id`` give one result row for each item,
the best; so do all rows with a null ``doc_id`` together. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrank.llm import arrays as A
from siftrank.llm.kneser_ney import HashTable

WORDS = 2_000_000
HITS = 1_000_000


def align(items: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each row pair, and the passage column where it ends. 0 pads items, 1 pads passages."""
    rows, width = passages.shape
    best, end = np.zeros(rows, np.int32), np.zeros(rows, np.int64)
    h = np.zeros((rows, width + 1), np.int32)
    ramp = np.arange(width + 1, dtype=np.int32)
    for i in range(items.shape[1]):
        s = np.where(items[:, i : i + 1] == passages, 2, -1).astype(np.int32)
        t = np.zeros_like(h)
        t[:, 1:] = np.maximum(np.maximum(h[:, :-1] + s, h[:, 1:] - 1), 0)
        h = np.maximum.accumulate(t + ramp, axis=1) - ramp
        h[:, 0] = 0
        at = h.argmax(1)
        top = h[np.arange(rows), at]
        better = top > best
        best, end = np.where(better, top, best), np.where(better, at, end)
    return best, end


def _aligned(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of (item, passage) pairs of word hashes, with the first and the last aligned passage word."""
    score, first, last = (np.zeros(len(pairs), np.int64) for _ in range(3))
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    for x in range(0, len(order), 128):
        part = order[x : x + 128]
        m, w = max(len(pairs[k][0]) for k in part), max(len(pairs[k][1]) for k in part)
        items, passages = np.zeros((len(part), m), np.uint64), np.ones((len(part), w), np.uint64)
        for r, k in enumerate(part):
            items[r, : len(pairs[k][0])], passages[r, : len(pairs[k][1])] = pairs[k]
        s, end = align(items, passages)
        back_items, back = np.zeros_like(items), np.ones_like(passages)
        for r, k in enumerate(part):
            back_items[r, : len(pairs[k][0])] = pairs[k][0][::-1]
            back[r, : end[r]] = pairs[k][1][: end[r]][::-1]
        _, begin = align(back_items, back)
        score[part], last[part], first[part] = s, end, end - begin
    return score, first, last


class Items:
    """One block of the benchmark: word hashes of each item and where each run of ``n`` words lies."""

    def __init__(self, table: pa.Table, n: int) -> None:
        self.ids = table.column("item_id").to_numpy()
        h, offsets = A.bare_hashes(table.column("text").combine_chunks())
        self.words = [h[x:y] for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
        grams, at = A.shingles(h, offsets, n)
        owner = np.repeat(np.arange(len(self.ids)), np.diff(at))
        long = (np.diff(offsets) >= n)[owner]
        self.gram, self.item, self.offset = grams[long], owner[long], (np.arange(len(owner)) - at[:-1][owner])[long]

    def seeds(self, counts: np.ndarray, spread: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every ``spread`` consecutive runs of an item the rarest, the first of equal ones: hashes in order, with item and offset. ``counts`` has how often each run occurs in the corpus."""
        if not len(self.gram):
            return self.gram, self.item, self.offset
        at = np.arange(len(self.gram))
        last = np.searchsorted(self.item, self.item, "right") - 1
        best = at.copy()
        for step in range(1, spread):
            other = np.minimum(at + step, last)
            best = np.where(counts[other] < counts[best], other, best)
        # the windows that a shorter item cuts off at its end begin before its last ``spread`` runs
        own = at[(at + spread - 1 <= last) | (self.offset == 0)]
        keep = np.unique(best[own])
        order = keep[np.argsort(self.gram[keep], kind="stable")]
        return self.gram[order], self.item[order], self.offset[order]


def _gram_counts(docs: DataFrame, items: Items, n: int) -> np.ndarray:
    """How often each run of the block's items occurs in the corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(np.unique(items.gram))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = shared.value
        table = HashTable(grams, np.arange(len(grams), dtype=np.int64))
        count = np.zeros(len(grams), np.int64)
        for whole in batches:
            for batch in A.pieces_of(whole, "text"):
                got = table.find(A.shingles(*A.bare_hashes(batch.column("text")), n)[0], -1)
                count += np.bincount(got[got >= 0], minlength=len(grams))
        hit = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(A.signed(grams[hit])), pa.array(count[hit])], names=["gram", "count"])

    rows = docs.select("text").mapInArrow(run, "gram long, count long").groupBy("gram").agg(F.sum("count").alias("count")).toArrow()
    found, count = rows.column("gram").to_numpy().view(np.uint64), rows.column("count").to_numpy()
    order = np.argsort(found)
    return np.append(count[order], 0)[np.where(np.isin(items.gram, found), np.searchsorted(found[order], items.gram), len(found))]


def _hits(got: np.ndarray, go: np.ndarray, seeds: tuple[np.ndarray, np.ndarray], offset: np.ndarray, item: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(text, item, diagonal)`` of the seeds found, at most about ``HITS`` at a time; all hits of one text and item come together.

    ``got`` has the number of the seed at each run of the texts, or -1; ``seeds`` where each seed's places in ``item`` and ``offset`` begin and how many there are.
    """
    first, times = seeds
    pos = np.flatnonzero(got >= 0)
    seed = got[pos]
    text = np.searchsorted(go, pos, "right") - 1
    upto = np.concatenate([[0], np.cumsum(times[seed])])
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]) + 1, len(pos)) if len(pos) else np.zeros(0, np.int64)
    begin = 0
    while begin < len(pos):
        end = max(int(ends[np.searchsorted(ends, begin, "right")]), int(ends[max(np.searchsorted(upto[ends], upto[begin] + HITS, "right") - 1, 0)]))
        own = slice(begin, end)
        parts = -(-int(upto[end] - upto[begin]) // HITS)
        for part in range(parts):
            if parts == 1:
                p, s, place = pos[own], seed[own], None
                start, count = first[s], times[s]
            else:
                # one text with more hits: those of every ``parts``-th item
                place = np.flatnonzero(item % parts == part)
                low, high = np.searchsorted(place, first), np.searchsorted(place, first + times)
                p, s = pos[own], seed[own]
                start, count = low[s], (high - low)[s]
            p = np.repeat(p, count)
            at = np.repeat(start, count) + np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count)
            at = at if place is None else place[at]
            doc = np.searchsorted(go, p, "right") - 1
            yield doc, item[at], p - go[:-1][doc] - offset[at]
        begin = end


def _passages(docs: DataFrame, items: Items, n: int, spread: int, threshold: float) -> DataFrame:
    gram, item, offset = items.seeds(_gram_counts(docs, items, n), spread)
    shared = docs.sparkSession.sparkContext.broadcast((gram, item, offset, items.ids, items.words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, item, offset, ids, words = shared.value
        unique, first, times = np.unique(gram, return_index=True, return_counts=True)
        table = HashTable(unique, np.arange(len(unique), dtype=np.int64))
        length = np.array([len(w) for w in words], np.int64)
        for whole in batches:
            for batch in A.pieces_of(whole, "text"):
                h, at = A.bare_hashes(batch.column("text"))
                grams, go = A.shingles(h, at, n)
                size = np.diff(at)
                for doc, it, begin in _hits(table.find(grams, -1), go, (first, times), offset, item):
                    order = np.lexsort((begin, it, doc))
                    doc, it, begin = doc[order], it[order], begin[order]
                    if not len(doc):
                        continue
                    new = np.ones(len(doc), bool)
                    new[1:] = (doc[1:] != doc[:-1]) | (it[1:] != it[:-1]) | (begin[1:] - begin[:-1] > length[it[1:]] // 4 + 2)
                    cut = np.flatnonzero(new)
                    low, high = begin[cut], begin[np.append(cut[1:], len(begin)) - 1]
                    doc, it = doc[cut], it[cut]
                    margin = length[it] // 4 + 2
                    low, high = np.maximum(low - margin, 0), np.minimum(high + length[it] + margin, size[doc])
                    pairs = [(words[i], h[at[d] + x : at[d] + y]) for d, i, x, y in zip(doc, it, low, high, strict=True)]
                    score, head, tail = _aligned(pairs)
                    ratio = score / (2.0 * length[it])
                    good = np.flatnonzero(ratio >= threshold)
                    ids_of = batch.column("doc_id").cast(pa.int64()).take(pa.array(doc[good]))
                    yield pa.RecordBatch.from_arrays(
                        [ids_of, pa.array(ids[it[good]].astype(np.int64)), pa.array(ratio[good]), pa.array((low + head)[good]), pa.array((low + tail)[good])],
                        names=["doc_id", "item_id", "score", "first_word", "end_word"],
                    )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, score double, first_word long, end_word long")


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 3, spread: int = 4, threshold: float = 0.5, block_words: int = WORDS) -> DataFrame:
    """``doc_id, item_id, score, first_word, end_word``: each document's best passage for each test item that it copies or paraphrases."""
    wanted = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = wanted.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    found = [
        _passages(docs, Items(wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow(), n), n, spread, threshold)
        for b in range(blocks)
    ]
    best = reduce(DataFrame.union, found).groupBy("doc_id", "item_id").agg(F.max(F.struct("score", -F.col("first_word"), "end_word")).alias("x"))
    return best.select("doc_id", "item_id", "x.score", (-F.col("x.col2")).alias("first_word"), "x.end_word")
