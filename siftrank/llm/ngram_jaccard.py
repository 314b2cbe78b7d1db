"""Operator 10. N-gram Jaccard join: MinHash banding, then verification on whole n-gram sets.

Steps, all of them Spark jobs:

1. One scan turns each text into a digest of its words and one hash for each band (``mapInArrow``).
2. Equal word sequences collapse into one class by a pre-aggregated ``groupBy``, so a text with a million copies
   is one row from here on.
3. Band hashes are shuffled; each bucket gives star edges to its least member, never all its pairs, and connected
   components over these edges bring candidates together.
4. Components are cut into blocks of bounded size; each pair of blocks is one small task that counts links on the
   full n-gram sets (a matrix product over shared n-grams) and returns a row for each text that has links, not for each link.

Every pair that shares a band lies in one component, and every pair of a component is verified, so what banding
finds is not lost again. Band and row counts follow from the target recall at the threshold (:func:`bands_for`).

Nulls and empty texts have no n-grams: each is a class of its own with no links. A text of fewer than ``n`` words is one
n-gram. Repeated rows with one ``doc_id`` count as one document; different texts under one id are all its texts: it is linked with what any of them is, and its copies and links are summed over them. All rows
with a null ``doc_id`` are one more document, which has no class and no links. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrank.llm import arrays as A
from siftrank.operators.components import connected_components
from siftrank.sources.checkpoints import cut, stored


def bands_for(threshold: float, recall: float, most: int = 160) -> tuple[int, int]:
    """The band count and the most rows a band can have so that a pair at ``threshold`` shares a band with probability ``recall``."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, most + 1):
        count = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if count * rows > most:
            break
        best = (count, rows)
    return best


def signatures(docs: DataFrame, n: int, bands: int, rows: int, seed: int) -> DataFrame:
    """``(doc_id, d1, d2, bands)``; a text without words has null digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = A.mix(np.arange(1, bands * rows + 1, dtype=np.uint64) + np.uint64(seed)) | np.uint64(1)
        for whole in batches:
            for batch in A.pieces_of(whole, "text", 1_000_000):
                flat, offsets = A.words(batch.column("text"))
                h = A.word_hashes(flat)
                sh, so = A.shingles(h, offsets, n)
                full = np.flatnonzero(np.diff(so) > 0)
                starts = so[:-1][full]
                sig = np.empty((bands * rows, len(full)), np.uint64)
                if len(full):
                    step = np.empty_like(sh)
                    for k, f in enumerate(factors):
                        np.multiply(sh, f, out=step)
                        sig[k] = np.minimum.reduceat(step, starts)
                keys = np.empty((len(full), bands), np.uint64)
                for b in range(bands):
                    key = np.full(len(full), b + 1, np.uint64)
                    for r in range(rows):
                        key = A.mix(key * A.P1 + sig[b * rows + r])
                    keys[:, b] = key
                d1, d2 = A.span_hash(h, offsets[:-1], offsets[1:]), A.span_hash(h, offsets[:-1], offsets[1:], A.P2)
                none = np.diff(so) == 0
                at = np.zeros(len(none) + 1, np.int32)
                at[1:] = np.cumsum(np.where(none, 0, bands))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").cast(pa.int64()),
                        pa.array(A.signed(d1), mask=none),
                        pa.array(A.signed(d2), mask=none),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(A.signed(keys.reshape(-1)))),
                    ],
                    names=["doc_id", "d1", "d2", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, d1 long, d2 long, bands array<long>")


def class_texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``cid, component, text`` of the classes ``(cid, component, rep, d1, d2)``: of all rows of the document that stands for one, those with its words, and only one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, set()
        for whole in batches:
            for batch in A.pieces_of(whole, "text", 1_000_000):
                flat, offsets = A.words(batch.column("text"))
                h = A.word_hashes(flat)
                same = A.signed(A.span_hash(h, offsets[:-1], offsets[1:])) == np.asarray(batch.column("d1"))
                same &= A.signed(A.span_hash(h, offsets[:-1], offsets[1:], A.P2)) == np.asarray(batch.column("d2"))
                ids, cids = np.asarray(batch.column("doc_id")), np.asarray(batch.column("cid"))
                keep = []
                for i in np.flatnonzero(same):  # rows of one id lie together
                    if ids[i] != last:
                        last, seen = ids[i], set()
                    if cids[i] not in seen:
                        seen.add(cids[i])
                        keep.append(i)
                yield batch.select(["cid", "component", "text"]).take(pa.array(keep, pa.int64()))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL AND doc_id IS NOT NULL")
    rows = classes.withColumnRenamed("rep", "doc_id").hint("merge").join(texts, "doc_id")
    # read back: sizes are taken from it before it is dealt out
    return stored(rows.select("doc_id", "cid", "component", "d1", "d2", "text").sortWithinPartitions("doc_id").mapInArrow(run, "cid long, component long, text string"))


def _block_links(n: int, threshold: float):
    """Links between the texts of a pair of blocks: for each text its links here and the least text it hangs together with."""

    def links(table: pa.Table) -> pa.RecordBatch | None:
        ids = np.asarray(table.column("cid"))
        block = np.asarray(table.column("block"))
        cross = table.column("bi")[0].as_py() != table.column("bj")[0].as_py()
        flat, offsets = A.words(table.column("text").combine_chunks())
        sh, so = A.shingles(A.word_hashes(flat), offsets, n)
        m = len(ids)
        key = np.unique(np.stack([sh, np.repeat(np.arange(m, dtype=np.uint64), np.diff(so))]), axis=1) if m > 64 else None
        if key is None:
            sets = [np.unique(sh[so[i] : so[i + 1]]) for i in range(m)]
            key = np.stack([np.concatenate(sets), np.repeat(np.arange(m, dtype=np.uint64), [len(s) for s in sets])])
            key = key[:, np.argsort(key[0], kind="stable")]
        value, owner = key[0], key[1].astype(np.int64)
        size = np.bincount(owner, minlength=m)
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        times = np.diff(np.append(first, len(value)))
        shared = np.repeat(times > 1, times)
        owner, column = owner[shared], np.repeat(np.cumsum(times > 1) - 1, times)[shared]
        both = np.zeros((m, m), np.float32)
        width = max(1, 16_000_000 // max(m, 1))
        total = int((times > 1).sum())
        for x in range(0, total, width):
            here = slice(*np.searchsorted(column, [x, x + width]))
            dense = np.zeros((m, min(width, total - x)), np.float32)
            dense[owner[here], column[here] - x] = 1
            both += dense @ dense.T
        union = size[:, None] + size[None, :] - both
        near = both >= threshold * union - 1e-6
        np.fill_diagonal(near, False)
        if cross:
            near &= block[:, None] != block[None, :]
        count = near.sum(1)
        have = np.flatnonzero(count)
        if not len(have):
            return None
        order = np.argsort(ids)
        root = np.empty(m, np.int64)
        root[order] = np.arange(m)
        while True:
            new = np.where(near, root[None, :], m).min(1)
            new = np.minimum(root, new)
            if (new == root).all():
                break
            root = new
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[have]), pa.array(ids[order][root[have]]), pa.array(count[have].astype(np.int64))],
            names=["cid", "root", "links"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in A.groups_of(batches, ["component", "bi", "bj"]):
            if (out := links(table)) is not None:
                yield out

    return run


def jaccard_join(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995, block: int = 512, block_bytes: int = 8_000_000, seed: int = 7
) -> DataFrame:
    """One row for each document: ``doc_id, copy_id, class_id, n_copies, n_links``.

    ``copy_id`` is the least document with the same words in the same order, ``n_copies`` how many documents have them.
    ``n_links`` counts the other texts whose n-gram sets have a Jaccard similarity of ``threshold`` or more, and
    ``class_id`` is the least document reachable over such links.
    """
    bands, rows = bands_for(threshold, recall)
    sig = cut(signatures(docs, n, bands, rows, seed))
    texts = sig.where("d1 IS NOT NULL").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("n_copies"), F.first("bands").alias("bands")
    )
    # a number for each text: one document can stand for several
    texts = cut(texts.withColumn("cid", F.monotonically_increasing_id()))
    member = texts.select("cid", F.posexplode("bands").alias("band", "key"))
    # read back, here and below, so that joins have plain shuffles on both sides and a frequent key's side can be split
    least = stored(member.groupBy("band", "key").agg(F.min("cid").alias("least"), F.count("*").alias("size")).where("size > 1").drop("size"))
    edges = member.hint("merge").join(least, ["band", "key"]).select("cid", "least").distinct()
    found = cut(connected_components(edges, "cid", "least").withColumnRenamed("node", "cid"))

    sized = class_texts(docs, found.hint("merge").join(texts.select("cid", "rep", "d1", "d2"), "cid"))
    weight = F.greatest(F.count("*") / F.lit(block), F.sum(F.length("text")) / F.lit(block_bytes))
    sizes = stored(sized.groupBy("component").agg(F.ceil(weight).cast("int").alias("blocks")))
    placed = sized.hint("merge").join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "cid", "text"
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    linked = cut(
        paired.repartition(parts, "component", "bi", "bj")
        .sortWithinPartitions("component", "bi", "bj", "cid")
        .mapInArrow(_block_links(n, threshold), "cid long, root long, links long")
    )
    counted = linked.groupBy("cid").agg(F.sum("links").alias("n_links"))
    mine = sig.where("doc_id IS NOT NULL").select("doc_id", "d1", "d2").distinct().hint("merge").join(texts.select("d1", "d2", "cid", "rep", "n_copies"), ["d1", "d2"], "left")
    mine = stored(mine.select("doc_id", "cid", "rep", "n_copies"))
    several = mine.groupBy("doc_id").agg(F.min("cid").alias("root"), F.max("cid").alias("last")).where("root <> last").select("doc_id", "root")
    own = mine.hint("merge").join(stored(several), "doc_id").where("cid IS NOT NULL").select("cid", "root")
    joined = stored(connected_components(linked.select("cid", "root").union(own), "cid", "root").withColumnRenamed("node", "cid"))
    classes = stored(joined.hint("merge").join(texts.select("cid", "rep"), "cid").groupBy("component").agg(F.min("rep").alias("class_id")))
    # one table for the last join, read back, so that the copies of a frequent text can be split
    known = stored(joined.hint("merge").join(classes, "component").hint("merge").join(counted, "cid", "left").select("cid", "class_id", "n_links"))
    out = mine.hint("merge").join(known, "cid", "left").groupBy("doc_id").agg(
        F.min(F.coalesce("rep", "doc_id")).alias("copy_id"), F.min(F.coalesce("class_id", "rep", "doc_id")).alias("class_id"),
        F.coalesce(F.sum("n_copies"), F.lit(1)).alias("n_copies"), F.sum(F.coalesce("n_links", F.lit(0))).alias("n_links"),
    )
    nameless = sig.where("doc_id IS NULL").limit(1).select("doc_id", F.lit(None).cast("long").alias("copy_id"), F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return out.union(nameless)
