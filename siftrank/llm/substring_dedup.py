"""Operator 1. Substring dedup by hashing units: sentences within lines, so that a passage is found wherever in a line it begins or ends.

A unit is a run of words up to a line break or to a word that ends in ``.``, ``!`` or ``?``. It is normalised (lower case, white space dropped) and hashed to 128 bits.
Digests are grouped globally by a pre-aggregated ``groupBy``; the earliest occurrence in the order of ``(doc_id, position)`` is kept, every other one is a repeat. Repeats that
follow one another in a document make a passage. A passage that was put into the middle of a sentence loses its first and last unit to its surroundings, so it is lengthened again: each unit carries hashes of the last words of the
unit before it and of the first words of the one after it, ``EDGES`` of them, and where those agree with the first occurrence's, these words belong to the passage too. Passages of ``min_words`` words or more are
removed. Offsets are those of the original text, in characters.

A unit that a third of all documents share is one row after the pre-aggregation; the join that marks its occurrences is a skewed merge join, which adaptive execution splits.

Null and empty texts have no units. Rows with a null ``doc_id`` take no part: they have no place in the order. Repeated rows with one ``doc_id`` have units at the same places, which count once. An empty table gives an empty result. Extra columns are
ignored by :func:`repeated_passages`. A text without line breaks and sentence ends is one unit, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftrank.llm import arrays as A
from siftrank.sources.checkpoints import cut

_BLANK = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
#: How many words of a neighbouring unit a passage can take in; larger ones first.
EDGES = (8, 4)
#: Hashes of what is beside a unit: before it and after it, the larger part first.
PARTS = [f"edge{i}" for i in range(2 * len(EDGES))]
#: Words of a passage: fewer than are sought (50), since up to a few words at each end are not taken in, and more than ordinary documents share in footers.
MIN_WORDS = 36
_STOPS = np.array([ord(c) for c in ".!?"], np.uint32)


def _edges(h: np.ndarray, first: np.ndarray, last: np.ndarray, begin: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each unit four 64-bit hashes, of the 8 and 4 words before it and of the 8 and 4 after it, all in the neighbouring unit (0 where that is shorter), and a number whose four 16-bit parts are how many characters they reach."""
    spans, n = A.Spans(h), len(begin)
    size = end + 1 - begin
    edge, reach = np.zeros((len(PARTS), n), np.uint64), np.zeros(n, np.uint64)
    for k, count in enumerate(EDGES):
        for side, step in ((0, -1), (1, 1)):
            own = np.arange(1, n) if step < 0 else np.arange(n - 1)
            own = own[(row[own] == row[own + step]) & (size[own + step] >= count)]
            start = end[own - 1] + 1 - count if step < 0 else begin[own + 1] if len(own) else own
            chars = first[begin[own]] - first[start] if step < 0 else last[start + count - 1] - last[end[own]]
            fits = chars < 1 << 16
            own, start, chars = own[fits], start[fits], chars[fits]
            part = 2 * side + k
            edge[part, own] = np.maximum(spans.hash(start, start + count), np.uint64(1))
            reach[own] |= chars.astype(np.uint64) << np.uint64(16 * part)
    return edge, reach


def units(docs: DataFrame) -> DataFrame:
    """``(doc_id, unit, begin, end, words, d1, d2, edge0, edge1, edge2, edge3, reach)`` of every unit; ``begin`` and ``end`` are character offsets in the text. For edges and ``reach`` see :func:`_edges`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in A.pieces_of(whole, "text", 3_000_000):
                # a line break after each text keeps the last word of one apart from the first of the next
                texts = pc.fill_null(batch.column("text"), "").to_pylist()
                points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
                if not len(points):
                    continue
                kinds, code = np.unique(points, return_inverse=True)
                lower = np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in kinds.tolist()], np.uint32)[code]
                blank = np.isin(kinds, _BLANK)[code]
                edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
                first, last = edge[0::2], edge[1::2]
                if not len(first):
                    continue
                h = A.Spans(lower).hash(first, last)
                breaks = np.concatenate([[0], np.cumsum(points == 10)])
                stop = np.isin(points[last - 1], _STOPS)
                stop[:-1] |= breaks[first[1:]] > breaks[last[:-1]]
                stop[-1] = True
                end = np.flatnonzero(stop)
                begin = np.concatenate([[0], end[:-1] + 1])
                base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
                row = np.searchsorted(base, first[begin], "right") - 1
                number = np.arange(len(row)) - np.searchsorted(row, row)
                d1, d2 = A.span_hash(h, begin, end + 1), A.span_hash(A.mix(h), begin, end + 1, A.P2)
                edge, reach = _edges(h, first, last, begin, end, row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").cast(pa.int64()).take(pa.array(row)),
                        pa.array(number.astype(np.int32)),
                        pa.array((first[begin] - base[row]).astype(np.int32)),
                        pa.array((last[end] - base[row]).astype(np.int32)),
                        pa.array((end + 1 - begin).astype(np.int32)),
                        pa.array(A.signed(d1)),
                        pa.array(A.signed(d2)),
                        *(pa.array(A.signed(e)) for e in edge),
                        pa.array(A.signed(reach)),
                    ],
                    names=["doc_id", "unit", "begin", "end", "words", "d1", "d2", *PARTS, "reach"],
                )

    edges = ", ".join(f"{c} long" for c in PARTS)
    return docs.select("doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(run, f"doc_id long, unit int, begin int, end int, words int, d1 long, d2 long, {edges}, reach long")


def _taken_in(side: int) -> tuple[Column, Column]:
    """How many words, and characters, of the unit before (0) or after (1) a repeat its first occurrence has too."""
    reach = lambda k: F.shiftrightunsigned("reach", 16 * (2 * side + k)).bitwiseAND(F.lit(0xFFFF)).cast("int")
    words, chars = F.lit(0), F.lit(0)
    for k in reversed(range(len(EDGES))):
        edge = PARTS[2 * side + k]
        same = (F.col(edge) != 0) & (F.col(edge) == F.col(f"first.{edge}"))
        words, chars = F.when(same, EDGES[k]).otherwise(words), F.when(same, reach(k)).otherwise(chars)
    return words, chars


def repeated_passages(docs: DataFrame, min_words: int = 30, take_in: bool = False) -> DataFrame:
    """``doc_id, begin, end, words, units, first_doc_id``: the passages to remove, and the least document that holds part of each.

    With ``take_in`` passages are lengthened into their neighbouring units before ``min_words`` is tested.
    """
    every = units(docs)
    if not take_in:
        every = every.withColumns({c: F.lit(0).cast("long") for c in (*PARTS, "reach")})
    first = (
        every.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "unit", *PARTS)).alias("first"), F.count("*").alias("times"))
        .where("times > 1").select("d1", "d2", "first")
    )
    # read back, so that the join has plain shuffles on both sides and a frequent unit's side can be split
    repeats = every.hint("merge").join(cut(first), ["d1", "d2"]).where(F.struct("doc_id", "unit") > F.struct("first.doc_id", "first.unit"))
    (left, before), (right, after) = _taken_in(0), _taken_in(1)
    repeats = repeats.select("doc_id", "unit", "words", (F.col("begin") - before).alias("begin"), (F.col("end") + after).alias("end"), left.alias("left"), right.alias("right"), F.col("first.doc_id").alias("first_doc_id"))
    repeats = repeats.groupBy("doc_id", "unit").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.max("words").alias("words"), F.max("left").alias("left"), F.max("right").alias("right"), F.min("first_doc_id").alias("first_doc_id"))
    run = F.col("unit") - F.row_number().over(Window.partitionBy("doc_id").orderBy("unit"))
    words = F.sum("words") + F.min_by("left", "unit") + F.max_by("right", "unit")
    return (
        repeats.withColumn("run", run).groupBy("doc_id", "run")
        .agg(F.min_by("begin", "unit").alias("begin"), F.max_by("end", "unit").alias("end"), words.alias("words"), F.count("*").alias("units"), F.min("first_doc_id").alias("first_doc_id"))
        .where(F.col("words") >= min_words).drop("run")
    )


def kept_segments(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``(doc_id, begin, end, text)``: what is left of each text, with its offsets in the original. Segments are in no order."""
    cuts = removed.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("cuts"))
    joined = docs.select("doc_id", "text").where("text IS NOT NULL").hint("merge").join(cuts, "doc_id", "left")
    cuts = F.coalesce("cuts", F.array().cast("array<struct<begin:int,end:int>>"))
    ends = F.concat(F.transform(cuts, lambda c: c["begin"]), F.array(F.char_length("text")))
    begins = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: c["end"]))
    return (
        joined.select("doc_id", "text", F.explode(F.arrays_zip(begins.alias("begin"), ends.alias("end"))).alias("s"))
        .select("doc_id", F.col("s.begin").alias("begin"), F.col("s.end").alias("end"), "text").where("end > begin")
        .withColumn("text", F.substring("text", F.col("begin") + 1, F.col("end") - F.col("begin")))
    )
