"""Operator 13. Hard-negative mining with an STR-packed R-tree.

The index is a table of leaf pages. A sample of at most ``SAMPLE`` rows gives the upper slabs of Sort-Tile-Recursive packing, by label first and then by one coordinate after the other, the widest first; they deal all rows into
cells. Each cell, or each block of a cell that many copies have made large, is a tree, whose task packs its rows into pages of about ``LEAF`` rows in the same way. A minimum bounding box gives an interval for every coordinate, and so for
the inner product with an anchor; boxes carry the range of their labels too.

A search takes boxes in the order of their upper ends, best first: it skips those that lie outside all score windows of the anchor or have no label that it wants, and stops at the first that is strictly below the k-th best found.
(Equal scores may still hold a smaller id.) Trees are taken so as well: every anchor first goes to its best tree, and with the k-th best found there to those that can hold more. Anchors go there in blocks of bounded size. An anchor's windows,
one for each of its positives, are searched together, so that its products are computed once.

Positives are an anchor's first rows of the same label, negatives its first rows of other labels whose score lies between ``low`` and ``high`` percent of the positive's. All scores are whole numbers and exact.

Rows with a null id, label, vector, or null or non-finite component take no part, nor do those whose squared length, in whole components, is ``LIMIT`` or more, whose scores leave the range of exact arithmetic. Vectors of different lengths are
compared as if zeros followed the shorter one. Of repeated rows of one id the least by label and vector counts. Ties go to smaller ids. With fewer rows than asked for, all are returned; an anchor without positives has none, a pair without negatives no row.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftrank.llm import arrays as A
from siftrank.sources.checkpoints import stored

#: Rows of a tree (more, beyond ``CELL * MOST_CELLS`` rows in all), of a page, and anchors that go to a tree at once.
SAMPLE, CELL, MOST_CELLS, LEAF, ANCHORS = 20_000, 4_096, 16_384, 128, 2_048
LIMIT = float(1 << 56)
FAR = 1 << 60


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``(vec_id, label, v)`` of the rows that take part: components as whole numbers, shorter vectors filled up with zeros."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & (F.abs(x.cast("double")) < LIMIT))
    rows = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(F.coalesce(fine, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("v"))
    rows = rows.where(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) < LIMIT)
    rows = stored(rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.*"))
    longest = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 1)
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("v"))))


class Tiles:
    """Sort-Tile-Recursive slabs: cuts of labels, then of coordinates, into about ``pages`` tiles."""

    def __init__(self, labels: np.ndarray, x: np.ndarray, pages: int) -> None:
        self.count = 0
        self.axes = np.argsort(-np.ptp(x, axis=0), kind="stable") if x.size else np.zeros(0, int)
        self.root = self._by_label(labels, x, pages)

    def _tile(self) -> int:
        self.count += 1
        return self.count - 1

    def _by_label(self, labels: np.ndarray, x: np.ndarray, pages: int):
        values, counts = np.unique(labels, return_counts=True)
        if pages <= 1 or len(values) < 2:
            return self._by_axis(x, pages, 0)
        size, ends, held = len(labels) / pages, [], 0
        for i, c in enumerate(counts):  # labels share a slab until it fills a page; a label that fills one has its own
            if held and held + c > size:
                ends.append(i)
                held = 0
            held += c
        if not ends:
            return self._by_axis(x, pages, 0)
        cuts, slab = values[np.array(ends) - 1], np.searchsorted(values[np.array(ends) - 1], labels, "left")
        below = [self._by_axis(x[slab == s], max(1, round(pages * (slab == s).mean())), 0) for s in range(len(ends) + 1)]
        return -1, cuts, below

    def _by_axis(self, x: np.ndarray, pages: int, depth: int):
        if pages <= 1 or len(x) < 2 or depth == len(self.axes):
            return self._tile()
        slabs = math.ceil(pages ** (1 / (len(self.axes) - depth)) - 1e-9)
        axis = self.axes[depth]
        cuts = np.unique(np.quantile(x[:, axis], np.arange(1, slabs) / slabs))
        slab = np.searchsorted(cuts, x[:, axis], "left")
        return int(axis), cuts, [self._by_axis(x[slab == s], math.ceil(pages / slabs), depth + 1) for s in range(len(cuts) + 1)]

    def tile(self, labels: np.ndarray, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(labels), np.int64), [(self.root, np.arange(len(labels)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, int):
                out[rows] = node
                continue
            axis, cuts, below = node
            slab = np.searchsorted(cuts, labels[rows] if axis < 0 else x[rows, axis], "left")
            todo += [(below[s], rows[slab == s]) for s in np.unique(slab)]
        return out


class Boxes:
    """Minimum bounding boxes of sets of rows, with the ranges of their labels."""

    def __init__(self, low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        self.low, self.high, self.first, self.last = low, high, first, last

    def upper(self, q: np.ndarray) -> np.ndarray:
        """For each vector and box, the upper end of the inner products' interval; the lower end is ``-upper(-q)``."""
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T

    def lower(self, q: np.ndarray) -> np.ndarray:
        return -self.upper(-q)

    def wanted(self, labels: np.ndarray, same: bool) -> np.ndarray:
        """Whether a box can hold rows of the same label, or rows of others."""
        if same:
            return (self.first[None] <= labels[:, None]) & (labels[:, None] <= self.last[None])
        return (self.first[None] != labels[:, None]) | (self.last[None] != labels[:, None])


def _first(order_by: tuple, groups: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` of each group, in the order given."""
    order = np.lexsort((*order_by, groups))
    g = groups[order]
    return order[np.arange(len(g)) - np.searchsorted(g, g) < k]


def search_tree(pages: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ids: np.ndarray, labels: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, reach: np.ndarray, k: int, same: bool) -> tuple:
    """For each anchor and window, its first ``k`` of the rows in ``pages`` (ids, labels, vectors) that lie in the window and score ``reach`` or more: anchors, windows, ids, scores.

    All anchors take their pages in their own best-first order; those that have come to the same page are multiplied with it together.
    """
    boxes = Boxes(np.array([x.min(0) for _, _, x in pages]), np.array([x.max(0) for _, _, x in pages]), np.array([y.min() for _, y, _ in pages]), np.array([y.max() for _, y, _ in pages]))
    upper = boxes.upper(q)
    fits = boxes.wanted(labels, same) & (boxes.lower(q) <= high.max(1)[:, None])
    order = np.argsort(-upper, axis=1, kind="stable")
    windows = low.shape[1]
    need = np.maximum(low, reach)
    live = np.arange(len(ids))
    best = tuple(np.zeros(0, np.int64) for _ in range(4))
    for turn in range(len(pages)):
        page = order[live, turn]
        go = upper[live, page] >= need[live].min(1)
        live, page = live[go], page[go]
        if not len(live):
            break
        fit = fits[live, page]
        found = [best]
        for j in np.unique(page[fit]):
            own = live[fit & (page == j)]
            row_ids, row_labels, x = pages[j]
            score = q[own] @ x.T
            fine = ((row_labels[None] == labels[own][:, None]) == same) & (row_ids[None] != ids[own][:, None])
            for w in range(windows):
                a, b = np.nonzero(fine & (score >= need[own, w][:, None]) & (score <= high[own, w][:, None]))
                if len(a):
                    found.append((own[a], np.full(len(a), w), row_ids[b], score[a, b].astype(np.int64)))
        if len(found) > 1:
            anchor, window, row, score = (np.concatenate(c) for c in zip(*found, strict=True))
            slot = anchor * windows + window
            keep = _first((row, -score), slot, k)
            best = anchor[keep], window[keep], row[keep], score[keep]
            slot, score = slot[keep], score[keep]
            at = np.arange(len(slot)) - np.searchsorted(slot, slot) == k - 1
            need[best[0][at], best[1][at]] = np.maximum(need[best[0][at], best[1][at]], score[at])
    return best


class Index:
    """The packed pages of all rows as a table, and the boxes of the trees."""

    def __init__(self, rows: DataFrame) -> None:
        """``rows``: a stored table of ``vec_id, label, v``."""
        n, dims, longest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
        self.n, self.dims = n, dims or 0
        # corners of boxes can be longer than rows are
        self.kind = np.float64 if (longest or 0) * math.sqrt(self.dims + 1) < 2**52 else np.int64
        if not n:
            return
        size = max(CELL, math.ceil(n / MOST_CELLS))
        sample = rows.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("label", "v").toArrow()
        tiles = Tiles(np.asarray(sample.column("label")), self.matrix(sample.column("v").combine_chunks()), math.ceil(n / size))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = tiles.tile(np.asarray(b.column("label")), matrix(b.column("v")))
                yield pa.RecordBatch.from_arrays([pa.array(cell), *b.columns], names=["cell", *b.schema.names])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in A.groups_of(batches, ["tree"]):
                ids, labels, x = np.asarray(group.column("vec_id")), np.asarray(group.column("label")), matrix(group.column("v").combine_chunks())
                page = Tiles(labels, x, math.ceil(len(ids) / LEAF)).tile(labels, x)
                order = np.argsort(page, kind="stable")
                cuts = [0, *(np.flatnonzero(np.diff(page[order])) + 1), len(order)]
                lists = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(lists) + 1, group.column("tree")[0].as_py())), pa.array(np.arange(-1, len(lists))),
                        pa.array([[labels.min(), labels.max()], *(labels[i] for i in lists)], pa.list_(pa.int64())),
                        pa.array([[], *(ids[i] for i in lists)], pa.list_(pa.int64())),
                        pa.array([np.concatenate([x.min(0), x.max(0)]).astype(float), *(x[i].ravel().astype(float) for i in lists)], pa.list_(pa.float64())),
                    ],
                    names=["tree", "page", "labels", "ids", "v"],
                )

        matrix = self.matrix
        placed = stored(rows.select("vec_id", "label", "v").mapInArrow(place, "cell long, vec_id long, label long, v array<double>"))
        cells = stored(placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(2 * size)).alias("blocks")))
        # a row for each cell, of which there are MOST_CELLS and some more by rounding
        tree = F.col("cell") * (1 << 20) + F.pmod(F.xxhash64("vec_id"), "blocks")
        dealt = placed.join(F.broadcast(cells), "cell").select(tree.alias("tree"), "vec_id", "label", "v")
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.pages = stored(dealt.repartition(max(parts, min(tiles.count, 4096)), "tree").sortWithinPartitions("tree", "vec_id").mapInArrow(pack, "tree long, page long, labels array<long>, ids array<long>, v array<double>"))
        # a row for each tree, at most 1.5 * MOST_CELLS
        roots = self.pages.where("page < 0").orderBy("tree").select("tree", "labels", "v").toArrow()
        ends, box = np.array(roots.column("labels").to_pylist()), np.asarray(roots.column("v").combine_chunks().flatten()).reshape(-1, 2, self.dims).astype(self.kind)
        self.trees, self.roots = np.asarray(roots.column("tree")), Boxes(box[:, 0], box[:, 1], ends[:, 0], ends[:, 1])

    @property
    def matrix(self):
        kind, dims = self.kind, self.dims
        return lambda column: np.asarray(column.flatten()).reshape(len(column), dims).astype(kind)

    def search(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """``anchor_id, slot, vec_id, score``: for each window of the stored anchors ``vec_id, label, v, lows, highs``, the first ``k`` rows of the anchor's label, or of other labels, inside it."""
        first = stored(self._searched(self._spread(anchors, same, True), k, same))
        kth = F.when(F.count("*") >= k, F.min("score")).alias("kth")
        known = first.groupBy("anchor_id", "slot").agg(kth).where("kth IS NOT NULL").groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "kth"))).alias("kth"))
        further = anchors.hint("merge").join(known.withColumnRenamed("anchor_id", "vec_id"), "vec_id", "left")
        reach = F.transform("reach", lambda r, i: F.coalesce(F.try_element_at("kth", i), r))
        second = self._searched(self._spread(further.withColumn("reach", reach), same, False), k, same)
        both = first.union(second)
        rank = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id"))
        return both.withColumn("rank", rank).where(F.col("rank") <= k)

    def _spread(self, anchors: DataFrame, same: bool, first: bool) -> DataFrame:
        """Each anchor once for each tree that it goes to: the one with the highest upper end first, and later all others that can hold something."""
        matrix, roots, trees = self.matrix, self.roots, self.trees

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for begin in range(0, whole.num_rows, 512):
                    b = whole.slice(begin, 512)
                    q, low, high, reach = matrix(b.column("v")), *(np.array(b.column(c).to_pylist()) for c in ("lows", "highs", "reach"))
                    upper = roots.upper(q)
                    # an empty window wants nothing
                    need = np.where(low <= high, np.maximum(low, reach if not first else low), FAR).min(1)
                    go = roots.wanted(np.asarray(b.column("label")), same) & (roots.lower(q) <= high.max(1)[:, None]) & (upper >= need[:, None])
                    best = np.where(roots.wanted(np.asarray(b.column("label")), same), upper, -FAR).argmax(1)
                    mine = np.zeros_like(go)
                    mine[np.arange(len(go)), best] = True
                    row, tree = np.nonzero(go & (mine if first else ~mine))
                    out = b.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array(trees[tree]), *out.columns], names=["tree", *out.schema.names])

        return anchors.select("vec_id", "label", "v", "lows", "highs", "reach").mapInArrow(run, "tree long, vec_id long, label long, v array<double>, lows array<long>, highs array<long>, reach array<long>")

    def _searched(self, asked: DataFrame, k: int, same: bool) -> DataFrame:
        asked = stored(asked)
        # a row for each tree
        blocks = F.broadcast(stored(asked.groupBy("tree").agg(F.ceil(F.count("*") / F.lit(ANCHORS)).cast("int").alias("blocks"))))
        nothing = F.lit(None).cast("array<long>")
        pages = self.pages.where("page >= 0").join(blocks, "tree").select("tree", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "page", "ids", "labels", "v", nothing.alias("lows"), nothing.alias("highs"), nothing.alias("reach"))
        queries = asked.join(blocks, "tree").select(
            "tree", F.pmod(F.hash("vec_id"), "blocks").alias("block"), F.lit(-1).cast("long").alias("page"), F.array("vec_id").alias("ids"), F.array("label").alias("labels"), "v", "lows", "highs", "reach"
        )
        matrix, kind, dims = self.matrix, self.kind, self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in A.groups_of(batches, ["tree", "block"]):
                page = np.asarray(group.column("page"))
                if not (page < 0).any():
                    continue
                ask, rest = group.filter(pa.array(page < 0)).combine_chunks(), group.filter(pa.array(page >= 0))
                pages = [
                    (i.values.to_numpy(), y.values.to_numpy(), v.values.to_numpy().reshape(-1, dims).astype(kind))
                    for i, y, v in zip(rest.column("ids"), rest.column("labels"), rest.column("v"), strict=True)
                ]
                ids, labels = (np.asarray(ask.column(c).combine_chunks().flatten()) for c in ("ids", "labels"))
                low, high, reach = (np.array(ask.column(c).to_pylist()) for c in ("lows", "highs", "reach"))
                anchor, window, row, score = search_tree(pages, ids, labels, matrix(ask.column("v").combine_chunks()), low, high, reach, k, same)
                yield pa.RecordBatch.from_arrays([pa.array(ids[anchor]), pa.array(window.astype(np.int32)), pa.array(row), pa.array(score)], names=["anchor_id", "slot", "vec_id", "score"])

        parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        together = pages.union(queries).repartition(max(parts, min(len(self.trees), 4096)), "tree", "block").sortWithinPartitions("tree", "block")
        return together.mapInArrow(run, "anchor_id long, slot int, vec_id long, score long")


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of whole vectors ``(vec_id, label, v)``; anchors are the rows whose id is divisible by ``every``."""
    rows = stored(rows)
    index = Index(rows)
    if not index.n:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = rows.where(F.col("vec_id") % every == 0)
    least, most = F.lit(-FAR), F.lit(FAR)
    open_ = stored(anchors.withColumns({"lows": F.array(least), "highs": F.array(most), "reach": F.array(least)}))
    near = stored(index.search(open_, positives, True).select("anchor_id", "rank", "vec_id", "score"))

    listed = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p")).select(F.col("anchor_id").alias("vec_id"), F.transform("p", lambda p: p["score"]).alias("scores"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = b.column("scores").to_pylist()
            lows, highs = [[-(-low * s // 100) for s in p] for p in scores], [[high * s // 100 for s in p] for p in scores]
            # windows that are missing are empty
            fill = [positives - len(p) for p in scores]
            lists = [[x + [end] * f for x, f in zip(v, fill, strict=True)] for v, end in ((lows, FAR), (highs, -FAR))]
            arrays = [pa.array(v, pa.list_(pa.int64())) for v in (*lists, [[-FAR] * positives] * len(scores))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vec_id", "label", "v")), *arrays], names=["vec_id", "label", "v", "lows", "highs", "reach"])

    asked = anchors.hint("merge").join(listed, "vec_id").select("vec_id", "label", "v", "scores")
    asked = stored(asked.mapInArrow(windows, "vec_id long, label long, v array<double>, lows array<long>, highs array<long>, reach array<long>"))
    found = index.search(asked, negatives, False)
    pairs = near.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = found.select("anchor_id", "slot", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.hint("merge").join(stored(found), ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
