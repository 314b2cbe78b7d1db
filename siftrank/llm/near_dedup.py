"""Operator 12. MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets and star-shaped candidate edges.

1. One scan hashes each text's shingles once (``mapInArrow``). The hash picks one of ``bands * rows`` bins and competes there for the minimum; an empty bin takes the value of a filled one, which a fixed random order of its own
   chooses, so that two sets choose alike and each bin still agrees with probability equal to their Jaccard similarity.
2. Equal word sequences collapse into one class by a pre-aggregated ``groupBy``, known by 128 bits of its words. From here on a text with a million copies is one row.
3. Bands are shuffled. A bucket's members are candidates with its least member only: a star, so a bucket gives as many edges as it has members.
4. Edges are confirmed on full shingle sets by two joins, whose hot keys adaptive execution can split, and make components.
5. What a star cannot see are links between members that its hub does not link with. So buckets whose members are not all in one component by now go on without their hub: their members are compared in pairs of blocks of bounded size, across components only.
   After this every pair of a bucket is settled: it lies in one component, or it has been compared. Buckets with the same members are compared once.

Bands and rows follow from the recall wanted of a pair at the threshold (29 bands of 5 rows for 0.99999).

A text of fewer than ``n`` words is one shingle. Texts without words and nulls have no shingles, and are linked with nothing. Repeated rows of one ``doc_id`` are one document; different texts under one id are all its texts: it is linked with
what any of them is, and ``n_shingles`` is the largest. Rows without an id cannot be named: each comes back with its ``n_shingles``, no component, and is kept. Ties do not occur: components are named by their least id.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrank.llm import arrays as A
from siftrank.llm.ngram_jaccard import bands_for
from siftrank.operators.components import connected_components
from siftrank.sources.checkpoints import stored

#: Texts and shingles of a block at most (a longer text is a block of its own).
BLOCK, BLOCK_SHINGLES = 512, 1_000_000


def distinct_shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' distinct shingles, flat and sorted for each text, the texts' offsets into them, and two digests of each text's words."""
    flat, offsets = A.words(texts, ascii=True)
    h = A.word_hashes(flat)
    sh, so = A.shingles(h, offsets, n)
    owner = np.repeat(np.arange(len(texts)), np.diff(so))
    order = np.lexsort((sh, owner))
    sh, owner = sh[order], owner[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (owner[1:] != owner[:-1])
    sh, owner = sh[new], owner[new]
    out = np.searchsorted(owner, np.arange(len(texts) + 1))
    return sh, out, A.span_hash(h, offsets[:-1], offsets[1:]), A.span_hash(h, offsets[:-1], offsets[1:], A.P2)


def one_permutation(sh: np.ndarray, offsets: np.ndarray, bins: int, seed: int) -> np.ndarray:
    """``bins`` values for each set that is not empty, from one hash of each element; empty bins borrow from filled ones."""
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes)
    mixed = A.mix(sh + np.uint64(seed))
    bin_of = ((mixed >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    values = np.full(len(full) * bins, none)
    row = np.repeat(np.arange(len(full)), sizes[full])
    np.minimum.at(values, row * bins + bin_of, A.mix(mixed))
    values = values.reshape(-1, bins)
    i = np.arange(bins, dtype=np.uint64)
    order = np.argsort(A.mix(i[:, None] * A.P1 + i[None] * A.P2 + np.uint64(seed)), axis=1)
    for part in range(0, len(full), 256):
        here = values[part : part + 256]
        filled = here != none
        lender = order[np.arange(bins), filled[:, order].argmax(2)]
        values[part : part + 256] = np.where(filled, here, np.take_along_axis(here, lender, 1))
    return values


def signatures(docs: DataFrame, n: int, bands: int, rows: int, seed: int) -> DataFrame:
    """``doc_id, d1, d2, n, bands``: the number of different shingles, and a hash for each band. Texts without words have no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in A.pieces_of(whole, "text", 1_000_000):
                sh, offsets, d1, d2 = distinct_shingles(batch.column("text"), n)
                values = one_permutation(sh, offsets, bands * rows, seed).reshape(-1, bands, rows)
                keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), values.shape[:2])
                for r in range(rows):
                    keys = A.mix(keys * A.P1 + values[:, :, r])
                at = np.concatenate([[0], np.cumsum((np.diff(offsets) > 0) * bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), pa.array(A.signed(d1)), pa.array(A.signed(d2)), pa.array(np.diff(offsets)),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(A.signed(keys.reshape(-1)))),
                    ],
                    names=["doc_id", "d1", "d2", "n", "bands"],
                )

    return docs.mapInArrow(run, "doc_id long, d1 long, d2 long, n long, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``cid, n, shingles`` of the wanted classes ``(cid, doc_id, d1, d2)``: read from the texts of the documents that stand for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, set()
        for whole in batches:
            for batch in A.pieces_of(whole, "text", 1_000_000):
                sh, offsets, d1, d2 = distinct_shingles(batch.column("text"), n)
                same = (A.signed(d1) == np.asarray(batch.column("d1"))) & (A.signed(d2) == np.asarray(batch.column("d2")))
                ids, cids = np.asarray(batch.column("doc_id")), np.asarray(batch.column("cid"))
                keep = []
                for i in np.flatnonzero(same):  # rows of one id lie together: a repeated row is taken once
                    if ids[i] != last:
                        last, seen = ids[i], set()
                    if cids[i] not in seen:
                        seen.add(cids[i])
                        keep.append(i)
                sets = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(A.signed(sh))).take(pa.array(keep, pa.int64())).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(cids[keep]), pa.array(np.diff(offsets)[keep]), sets], names=["cid", "n", "shingles"])

    texts = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").hint("merge").join(wanted, "doc_id")
    return texts.select("doc_id", "cid", "d1", "d2", "text").sortWithinPartitions("doc_id").mapInArrow(run, "cid long, n long, shingles array<long>")


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges ``(hub, cid)`` whose sets share ``percent`` of their union or more."""
    hubs = sets.select(F.col("cid").alias("hub"), F.col("n").alias("hub_n"), F.col("shingles").alias("hub_shingles"))
    pairs = edges.hint("merge").join(sets, "cid").hint("merge").join(hubs, "hub")
    both = pairs.select("hub", "cid", (F.col("n") + F.col("hub_n")).alias("total"), F.size(F.array_intersect("shingles", "hub_shingles")).alias("both"))
    return both.where(100 * F.col("both") >= percent * (F.col("total") - F.col("both"))).select("hub", "cid")


def _links_across(percent: int):
    """For each pair of blocks of a bucket: its texts that link with texts of other components, each with the least text that it hangs together with here."""

    def links(table: pa.Table) -> pa.RecordBatch | None:
        cid, label, block = (np.asarray(table.column(c)) for c in ("cid", "label", "block"))
        shingles = table.column("shingles").combine_chunks()
        m, size = len(cid), np.diff(np.asarray(shingles.offsets)).astype(np.int64)
        value, owner = np.asarray(shingles.flatten()), np.repeat(np.arange(m), size)
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        times = np.diff(np.append(first, len(value)))
        shared = np.repeat(times > 1, times)
        owner, column = owner[shared], np.repeat(np.cumsum(times > 1) - 1, times)[shared]
        both, total, width = np.zeros((m, m)), int((times > 1).sum()), max(1, 8_000_000 // m)
        for x in range(0, total, width):
            here = slice(*np.searchsorted(column, [x, x + width]))
            dense = np.zeros((m, min(width, total - x)), np.float32)
            dense[owner[here], column[here] - x] = 1
            both += dense @ dense.T
        near = (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (label[:, None] != label[None, :])
        if (block != block[0]).any():
            near &= block[:, None] != block[None, :]
        have = np.flatnonzero(near.any(1))
        if not len(have):
            return None
        order = np.argsort(cid)
        root = np.empty(m, np.int64)
        root[order] = np.arange(m)
        while True:
            new = np.minimum(root, np.where(near, root[None, :], m).min(1))
            if (new == root).all():
                break
            root = new
        return pa.RecordBatch.from_arrays([pa.array(cid[order][root[have]]), pa.array(cid[have])], names=["hub", "cid"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in A.groups_of(batches, ["key", "bi", "bj"]):
            if (out := links(table)) is not None:
                yield out

    return run


def links_without_hubs(spokes: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``(hub, cid)`` between members of one bucket that are in different components still. ``spokes``: ``key, hub, cid`` of all buckets; their hubs have been compared with all."""
    named = spokes.hint("merge").join(found.select(F.col("node").alias("cid"), "component"), "cid", "left").select("key", "cid", F.coalesce("component", "cid").alias("label"))
    named = stored(named)
    mark = [F.bit_xor(F.xxhash64("cid")).alias("m1"), F.sum(F.hash("cid").cast("long")).alias("m2"), F.min("cid").alias("m3")]
    open_ = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"), *mark).where("low <> high")
    once = open_.groupBy("size", "m1", "m2", "m3").agg(F.min("key").alias("key")).select("key")
    left = stored(named.hint("merge").join(stored(once), "key").hint("merge").join(sets.select("cid", "n"), "cid"))
    weight = F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_SHINGLES))
    blocks = stored(left.groupBy("key").agg(F.ceil(weight).cast("int").alias("blocks")))
    placed = left.hint("merge").join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "cid", "label"
    )
    parts = int(spokes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with_sets = stored(paired).hint("merge").join(sets.select("cid", "shingles"), "cid")
    return with_sets.repartition(parts, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj").mapInArrow(_links_across(percent), "hub long, cid long")


def near_duplicates(docs: DataFrame, n: int = 4, percent: int = 80, recall: float = 0.99999, seed: int = 12) -> DataFrame:
    """One row for each document: ``doc_id, n_shingles, component_id, kept``; see the module's text."""
    bands, rows = bands_for(percent / 100, recall)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = stored(signatures(docs, n, bands, rows, seed))
    classes = sig.where("doc_id IS NOT NULL AND n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()))

    member = classes.select("cid", "n", F.explode("bands").alias("key"))
    # read back, here and below, so that joins have plain shuffles on both sides and a frequent key's side can be split
    hubs = stored(member.groupBy("key").agg(F.min(F.struct("cid", "n")).alias("least"), F.count("*").alias("size")).where("size > 1").select("key", F.col("least.cid").alias("hub"), F.col("least.n").alias("hub_n")))
    spokes = stored(member.hint("merge").join(hubs, "key").where("cid <> hub"))
    edges = stored(spokes.where(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")).select("hub", "cid").distinct())
    every = spokes.select(F.explode(F.array("hub", "cid")).alias("cid")).distinct()
    wanted = every.hint("merge").join(classes.select("cid", F.col("rep").alias("doc_id"), "d1", "d2"), "cid")
    sets = stored(shingle_sets(docs, stored(wanted), n))
    links = stored(confirmed(edges, sets, percent))
    found = stored(connected_components(links, "hub", "cid"))
    more = stored(links_without_hubs(spokes.select("key", "cid"), found, sets, percent))

    texts = sig.where("doc_id IS NOT NULL").select("doc_id", "d1", "d2", "n").distinct()
    texts = stored(texts.hint("merge").join(classes.select("d1", "d2", "cid"), ["d1", "d2"], "left").select("doc_id", "n", "cid"))
    several = texts.groupBy("doc_id").agg(F.min("cid").alias("hub"), F.max("cid").alias("last")).where("hub <> last").select("doc_id", "hub")
    own = texts.hint("merge").join(stored(several), "doc_id").where("cid IS NOT NULL").select("hub", "cid")
    if not more.isEmpty() or not own.isEmpty():
        found = stored(connected_components(links.union(more).union(own), "hub", "cid"))
    grouped = classes.select("cid", "rep").hint("merge").join(found.select(F.col("node").alias("cid"), "component"), "cid")
    least = stored(grouped.groupBy("component").agg(F.min("rep").alias("least")))
    named = found.hint("merge").join(least, "component").select(F.col("node").alias("cid"), "least")
    single = classes.select("cid", "rep").hint("merge").join(stored(named), "cid", "left").select("cid", F.coalesce("least", "rep").alias("least"))
    out = texts.hint("merge").join(stored(single), "cid", "left").groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.min(F.coalesce("least", "doc_id")).alias("component_id"))
    nameless = sig.where("doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id")).union(nameless)
