"""Operator 11. Spelling variant grouping by a dictionary of pairs of trie nodes.

Every prefix of a word is a node of a forward trie and every suffix a node of a trie of the reversed words. Both are numbered: a word then is two paths of whole numbers, and what is left of it when
its character at ``i`` is skipped is the pair (prefix node ``i``, suffix node ``length - 1 - i``). Two words differ by one replaced character if and only if they share such a pair, and by one inserted character if and
only if a skip pair of the longer one equals an undivided pair (prefix node ``i``, suffix node ``length - i``) of the shorter one. So one grouping by pairs of whole numbers gives the exact neighbours, without a
distance ever being computed.

How the nodes are numbered without a trie in one place: the words are dealt by ranges and sorted. A prefix is a new node where it is longer than what the word shares with the word before it, so each
task numbers its nodes in one pass. Nodes that reach over the border of two ranges have numbers from the first and last words of the ranges, two words a range, which are all that the driver sees.

A pair is shared by at most one word for each character that occurs, and by one shorter word, so its group is bounded by the alphabet, whatever the words are; each member gets its count and its best neighbour there, not a
row for each pair. Words carry their rank (more occurrences first, then code-point order) as their number, so the best of some words is the least number.

Null texts have no words. A row without ``doc_id`` counts as one whose id is written as the empty text. Repeated rows count as often as they occur. Equal counts go in code-point order. An empty table, or one without frequent words, gives an empty
result. Extra columns are ignored. Runs of letters of any length are taken whole; memory in a task is bounded by the longest word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrank.operators.numbering import numbered_within
from siftrank.sources.checkpoints import cut, stored

#: Cells of the matrices that words are compared in.
CELLS = 1_000_000
INSERT, SKIP, FIRST_SKIP = 0, 1, 3


def counted_words(docs: DataFrame, least_length: int = 6, least_count: int = 5, every: int = 199) -> DataFrame:
    """``word, n``: the runs of letters of all texts, where one in ``every``, by a hash of document and run, has lost one of its letters."""
    plain = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # a run that is too short only gets shorter
    runs = docs.where("text IS NOT NULL").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("owner"),
        F.explode(F.regexp_extract_all(plain, F.lit(f"[a-zÀ-ÿ]{{{least_length},}}"), F.lit(0))).alias("run"),
    )
    hashed = runs.select("run", F.crc32(F.concat("owner", F.lit(":"), "run")).alias("h"))
    at = F.expr("CAST(h % length(run) AS INT)")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, short).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def ranked(words: DataFrame) -> DataFrame:
    """``id, word, n``: more frequent words have smaller numbers, equally frequent ones go in code-point order."""
    return numbered_within(words.select("word", "n", (-F.col("n")).alias("less")), [], ["less", "word"], "id").select("id", "word", "n")


def code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' code points, flat, and each word's offsets into them."""
    lengths = np.asarray(pc.utf8_length(words)).astype(np.int64)
    return np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)])


def shared_length(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    apart = np.flatnonzero(a[:n] != b[:n])
    return int(apart[0]) if len(apart) else n


class Borders:
    """What the tasks must agree on: the words at both ends of each range, and the numbers of the nodes that reach over a border."""

    def __init__(self, ends: list[tuple[int, str, str]]) -> None:
        nothing = np.zeros(0, np.int64)
        points = [(part, *(np.array([ord(c) for c in w], np.int64) for w in (first, last))) for part, first, last in sorted(ends)]
        self.parts: dict[int, tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        over = []
        for k, (_, first, _) in enumerate(points):
            width = shared_length(points[k - 1][2], first) if k else 0
            numbers = -((k << 32) + np.arange(1, width + 1))
            if k > 1:  # as far as the range before lies under the node as a whole, it is the node of the border before
                same = min(width, len(over[k - 1]), shared_length(points[k - 1][1], points[k - 1][2]))
                numbers[:same] = over[k - 1][:same]
            over.append(numbers)
        over.append(nothing)
        for k, (part, _, last) in enumerate(points):
            self.parts[part] = (k, points[k - 1][2] if k else nothing, over[k], last, over[k + 1])


class Trie:
    """Numbers of the nodes on the paths of words that come in order; only the last word and its path are held."""

    def __init__(self, place: int, word: np.ndarray, path: np.ndarray, last: np.ndarray, last_path: np.ndarray) -> None:
        self.next, self.word, self.path = (place + 1) << 40, word[: len(path)], path
        self.last, self.last_path = last[: len(last_path)], last_path

    def paths(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The nodes of all prefixes but the empty one, for each word by length, flat as the points are."""
        lengths, out, begin = np.diff(offsets), [], 0
        while begin < len(lengths):
            widest = np.maximum.accumulate(lengths[begin:])
            rows = max(1, int(np.searchsorted(widest * np.arange(1, len(widest) + 1), CELLS, "right")))
            end = begin + rows
            out.append(self._chunk(points[offsets[begin] : offsets[end]], lengths[begin:end]))
            begin = end
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _chunk(self, points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        rows, width = len(lengths), int(max(lengths.max(), 1))
        at = np.arange(width)
        filled = at[None] < lengths[:, None]
        letters = np.full((rows + 1, width), -1, np.int64)
        letters[0, : min(width, len(self.word))] = self.word[:width]
        letters[1:][filled] = points
        shared = np.cumprod((letters[1:] == letters[:-1]) & filled, axis=1).sum(1)
        first = self.next + np.concatenate([[0], np.cumsum(lengths - shared)])
        owner = np.maximum.accumulate(np.where(at[None] >= shared[:, None], np.arange(1, rows + 1)[:, None], 0), axis=0)
        held = np.zeros(width, np.int64)
        held[: min(width, len(self.path))] = self.path[:width]
        numbers = np.where(owner > 0, first[owner - 1] + at[None] - shared[owner - 1], held[None])
        over = min(width, len(self.last))
        if over:
            below = np.cumprod(letters[1:, :over] == self.last[None, :over], axis=1).astype(bool)
            numbers[:, :over] = np.where(below, self.last_path[None, :over], numbers[:, :over])
        self.next, self.word, self.path = int(first[-1]), letters[-1][filled[-1]], numbers[-1][filled[-1]]
        return numbers[filled]


def _in_ranges(words: DataFrame, key: str) -> tuple[DataFrame, Borders]:
    """The words sorted by ``key`` in ranges that stay as they are, and their borders."""
    dealt = words.repartitionByRange(key).sortWithinPartitions(key)
    fixed = cut(dealt.select("*", F.spark_partition_id().alias("part")))
    ends = fixed.groupBy("part").agg(F.min(key), F.max(key)).collect()  # a row for each range
    return fixed, Borders([tuple(r) for r in ends])


def node_pairs(words: DataFrame) -> DataFrame:
    """``prefix, suffix, member``: the pairs of nodes of all words; ``member`` is four times the word's number plus the kind of pair.

    A run of equal letters can lose any of them to the same end: only the first of them counts as ``FIRST_SKIP``, so that two words meet once.
    """

    def nodes(borders: Borders, key: str, result):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                points, offsets = code_points(batch.column(key))
                trie = trie or Trie(*borders.parts[batch.column("part")[0].as_py()])
                yield result(batch, points, offsets, trie.paths(points, offsets))

        return run

    def suffixes(batch: pa.RecordBatch, points: np.ndarray, offsets: np.ndarray, path: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(path))
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("word"), lists], names=["id", "word", "suffixes"])

    def pairs(batch: pa.RecordBatch, points: np.ndarray, offsets: np.ndarray, path: np.ndarray) -> pa.RecordBatch:
        ids, lengths = np.asarray(batch.column("id")), np.diff(offsets)
        # both paths with the root, which is 0, before them: nodes by length from 0
        begin = offsets[:-1] + np.arange(len(lengths))
        prefix, suffix = (np.zeros(len(points) + len(lengths), np.int64) for _ in range(2))
        inner = np.arange(len(points)) + np.repeat(np.arange(1, len(lengths) + 1), lengths)
        prefix[inner], suffix[inner] = path, np.asarray(batch.column("suffixes").flatten())
        i = np.arange(len(points)) - np.repeat(offsets[:-1], lengths)
        at, size = np.repeat(begin, lengths), np.repeat(lengths, lengths)
        fresh = np.ones(len(points), bool)
        fresh[1:] = points[1:] != points[:-1]
        kind = np.where(fresh | (i == 0), FIRST_SKIP, SKIP)
        j = np.arange(len(prefix)) - np.repeat(begin, lengths + 1)
        whole, whole_size = np.repeat(begin, lengths + 1), np.repeat(lengths, lengths + 1)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([prefix[at + i], prefix[whole + j]])),
                pa.array(np.concatenate([suffix[at + size - 1 - i], suffix[whole + whole_size - j]])),
                pa.array(np.concatenate([np.repeat(ids, lengths) * 4 + kind, np.repeat(ids, lengths + 1) * 4 + INSERT])),
            ],
            names=["prefix", "suffix", "member"],
        )

    backward, ends = _in_ranges(words.select("id", "word", F.reverse("word").alias("drow")), "drow")
    halves = backward.mapInArrow(nodes(ends, "drow", suffixes), "id long, word string, suffixes array<long>")
    forward, ends = _in_ranges(halves, "word")
    return forward.mapInArrow(nodes(ends, "word", pairs), "prefix long, suffix long, member long")


def near_words(words: DataFrame) -> DataFrame:
    """``id, n_near, best`` of the words that have neighbours: how many, and the least number among them."""
    groups = node_pairs(words).groupBy("prefix", "suffix").agg(F.sort_array(F.collect_list("member")).alias("all")).where("size(all) > 1")
    groups = groups.select(
        "all",
        F.filter("all", lambda m: m % 4 != INSERT).alias("skips"),
        F.filter("all", lambda m: m % 4 == FIRST_SKIP).alias("firsts"),
        F.get(F.filter("all", lambda m: m % 4 == INSERT), F.lit(0)).alias("short"),
    )
    other = lambda m: F.get("skips", F.when(F.get("skips", F.lit(0)) == m, 1).otherwise(0))
    of_skip = lambda m: F.struct(
        F.shiftright(m, 2).alias("id"),
        (F.size("skips") - 1 + F.when((m % 4 == FIRST_SKIP) & F.col("short").isNotNull(), 1).otherwise(0)).alias("near"),
        F.least(F.shiftright(other(m), 2), F.when(m % 4 == FIRST_SKIP, F.shiftright("short", 2))).alias("best"),
    )
    of_short = lambda m: F.struct(F.shiftright(m, 2).alias("id"), F.size("firsts").alias("near"), F.shiftright(F.get("firsts", F.lit(0)), 2).alias("best"))
    each = groups.select(F.explode(F.transform("all", lambda m: F.when(m % 4 == INSERT, of_short(m)).otherwise(of_skip(m)))).alias("x")).select("x.*")
    return each.where("near > 0").groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of a table of words and their counts.

    A word's form is its most frequent neighbour, if that is ``ratio`` (above 1) times as frequent or more. Forms are followed by doubled steps; their number is known, since every step multiplies the count.
    """
    words = stored(ranked(words))
    near = stored(near_words(words))
    counts = words.select(F.col("id").alias("best"), F.col("n").alias("best_n"), F.col("word").alias("best_word"))
    candidates = near.hint("merge").join(words.select("id", "n"), "id").hint("merge").join(counts, "best")
    forms = stored(candidates.where(F.col("best_n") >= F.col("n") * ratio).select("id", F.col("best").alias("up"), F.col("best_word").alias("form"), F.col("best_n").alias("form_n")))
    most, least = words.agg(F.max("n"), F.min("n")).first()
    steps = math.floor(math.log(most / least, ratio) + 1e-9) if most else 0
    tops = forms.select("id", F.col("up").alias("top"))
    for _ in range(max(steps, 1).bit_length()):
        further = tops.select(F.col("id").alias("top"), F.col("top").alias("further"))
        tops = stored(tops.hint("merge").join(further, "top", "left").select("id", F.coalesce("further", "top").alias("top")))
    roots = tops.hint("merge").join(words.select(F.col("id").alias("top"), F.col("word").alias("root")), "top").select("id", "root")
    whole = words.hint("merge").join(near.select("id", "n_near"), "id", "left").hint("merge").join(forms.select("id", "form", "form_n"), "id", "left").hint("merge").join(roots, "id", "left")
    return whole.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
