"""Operator 3. Approximate nearest neighbours by low-dimensional stable projections, a kd-tree and a chi-square stopping test.

Largest inner product becomes nearest distance by one more coordinate that gives every vector the same length. ``DIMS`` Gaussian projections of that space are the index: the
squared projected distance of a pair over its squared distance follows a chi-square law with ``DIMS`` degrees of freedom. So candidates are taken in the order of their projected distance and verified on
the original vectors, until the next one's squared projected distance exceeds the law's ``CONFIDENCE`` quantile times the squared distance of the k-th best found: beyond it each true neighbour
is missed with probability ``1 - CONFIDENCE`` at most.

The upper levels of the kd-tree, fitted on a sample of at most ``SAMPLE`` projected rows, deal all rows into cells of about ``CELL`` rows; the lower levels are built where a cell's rows are.
A query first searches its own cell. The bound that it finds there decides which other cells can hold more, and it goes to those only. A cell's queries are counted and go there in blocks of about ``BLOCK``, its rows
in blocks of about ``4 * CELL``, so that a cell that a third of all queries go to is many tasks, and rows are sent once more only where queries are.

Vectors that are null, zero, hold null or non-finite components, or differ in length from the longest take no part. Of equal vectors the ``k + 1`` least ids are indexed: no other copy can be
among any query's ``k`` nearest. Ties go to smaller ids. With fewer candidates than ``k``, all are returned. Repeated rows of one id count once. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftrank.llm import arrays as A
from siftrank.sources.checkpoints import cut

DIMS, CONFIDENCE, SAMPLE, CELL, BLOCK, LEAF = 8, 0.97, 20_000, 16_384, 4_096, 256


def chi_square_quantile(p: float, dims: int) -> float:
    """The quantile of the chi-square law with an even number of degrees of freedom, by bisection of its closed form."""

    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def clean(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)`` of the vectors that take part."""
    v = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where(F.coalesce(fine, F.lit(False)))
    longest = v.agg(F.max(F.size("v"))).first()[0] or 0
    return v.where(F.size("v") == longest).groupBy("vec_id").agg(F.min("v").alias("v"))


class Splits:
    """The upper levels of the kd-tree: medians of a sample, down to a given number of cells."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.nodes: list[tuple[int, float, int, int]] = []
        self.cells = 0
        self.root = self._build(sample, cells)

    def _build(self, rows: np.ndarray, cells: int) -> int:
        if cells <= 1 or len(rows) < 2:
            self.cells += 1
            return -self.cells
        axis = int(np.argmax(rows.max(0) - rows.min(0)))
        at = float(np.quantile(rows[:, axis], (cells // 2) / cells))
        mine = len(self.nodes)
        self.nodes.append((axis, at, 0, 0))
        here = rows[:, axis] <= at
        left = self._build(rows[here], cells // 2)
        right = self._build(rows[~here], cells - cells // 2)
        self.nodes[mine] = (axis, at, left, right)
        return mine

    def cell(self, y: np.ndarray) -> np.ndarray:
        node = np.full(len(y), self.root)
        while len(live := np.flatnonzero(node >= 0)):
            for n in np.unique(node[live]):
                axis, at, left, right = self.nodes[n]
                own = live[node[live] == n]
                node[own] = np.where(y[own, axis] <= at, left, right)
        return -node - 1

    def within(self, y: np.ndarray, reach: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """For each cell the points whose squared distance to it is ``reach`` at most. The tree is walked with the points that can still reach a node, so that what is held grows with its depth, not with the cells."""
        todo = [(self.root, np.arange(len(y)), np.zeros_like(y))]
        while todo:
            node, rows, gap = todo.pop()
            if node < 0:
                yield rows, -node - 1
                continue
            axis, at, left, right = self.nodes[node]
            beyond = y[rows, axis] - at
            for child, over in ((left, beyond), (right, -beyond)):
                apart = gap.copy()
                apart[:, axis] = np.maximum(apart[:, axis], over)
                near = (apart**2).sum(1) <= reach[rows]
                if near.any():
                    todo.append((child, rows[near], apart[near]))


def leaves(y: np.ndarray) -> list[np.ndarray]:
    """The leaves of a kd-tree over the rows: positions, split at medians of the widest axis until a leaf is small."""
    todo, done = [np.arange(len(y))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            done.append(rows)
            continue
        axis = int(np.argmax(np.ptp(y[rows], axis=0)))
        half = len(rows) // 2
        order = rows[np.argpartition(y[rows, axis], half)]
        todo += [order[:half], order[half:]]
    return done


def search_cell(ids: np.ndarray, x: np.ndarray, y: np.ndarray, q_ids: np.ndarray, q: np.ndarray, qy: np.ndarray, bound: np.ndarray, k: int, longest: float, limit: float):
    """Each query's nearest rows of one cell that the stopping test lets through: query positions, row positions, scores.

    Every query goes through the leaves in its own order, nearest first; queries that have come to the same leaf are verified there by one matrix product.
    Such products may differ in their last bits, so a few more than ``k`` are kept, and these are scored again one by one.
    """
    parts = leaves(y)
    low, high = np.array([y[p].min(0) for p in parts]), np.array([y[p].max(0) for p in parts])
    held = [(x[p], y[p], ids[p]) for p in parts]
    keep, m = 2 * k + 2, len(q_ids)
    best, rows = np.full((m, keep), -np.inf), np.full((m, keep), -1)
    square, reach = (q * q).sum(1) + longest**2, bound.astype(float)
    gap = np.zeros((m, len(parts)))
    for d in range(y.shape[1]):
        gap += (np.maximum(low[:, d][None] - qy[:, d][:, None], 0) + np.maximum(qy[:, d][:, None] - high[:, d][None], 0)) ** 2
    order = np.argsort(gap, axis=1)
    live = np.arange(m)
    for turn in range(len(parts)):
        leaf = order[live, turn]
        go = gap[live, leaf] <= limit * reach[live]
        live, leaf = live[go], leaf[go]
        if not len(live):
            break
        for j in np.unique(leaf):
            own = live[leaf == j]
            vx, vy, vid = held[j]
            apart = (vy * vy).sum(1)[None] + (qy[own] * qy[own]).sum(1)[:, None] - 2 * (qy[own] @ vy.T)
            score = np.where((apart <= limit * reach[own][:, None] * (1 + 1e-9) + 1e-9) & (vid[None] != q_ids[own][:, None]), q[own] @ vx.T, -np.inf)
            all_score = np.concatenate([best[own], score], axis=1)
            all_rows = np.concatenate([rows[own], np.broadcast_to(parts[j], score.shape)], axis=1)
            top = np.argpartition(-all_score, keep - 1, axis=1)[:, :keep]
            best[own], rows[own] = np.take_along_axis(all_score, top, 1), np.take_along_axis(all_rows, top, 1)
            kth = -np.partition(-best[own], k - 1, axis=1)[:, k - 1]
            closer = np.maximum(square[own] - 2 * kth, 0.0) * (1 + 1e-9) + 1e-12
            reach[own] = np.where(np.isfinite(kth), np.minimum(reach[own], closer), reach[own])
    qi, slot = np.nonzero(np.isfinite(best))
    ri = rows[qi, slot]
    score = (x[ri] * q[qi]).sum(1)
    rank = np.lexsort((ids[ri], -score, qi))
    qi, ri, score = qi[rank], ri[rank], score[rank]
    first = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    return qi[first], ri[first], score[first]


def search(vectors: DataFrame, every: int = 20, k: int = 20, seed: int = 3) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each vector whose id is divisible by ``every``."""
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    v = clean(vectors)
    # a plain rank filter, so that each partition sends its k + 1 least copies of a vector at most
    copy = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    v = cut(v)
    rows = cut(v.withColumn("copy", copy).where(F.col("copy") <= k + 1).select("vec_id", "v"))
    n, longest, dims = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b))), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], schema)
    project = np.random.default_rng(seed).standard_normal((dims + 1, DIMS))
    limit = chi_square_quantile(CONFIDENCE, DIMS)

    def matrix(column: pa.Array) -> np.ndarray:
        return np.asarray(column.flatten()).reshape(len(column), -1)

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))]) @ project

    def query_points(x: np.ndarray) -> np.ndarray:
        return x @ project[:dims]

    sample = rows.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    splits = Splits(lifted(matrix(sample)), max(1, math.ceil(n / CELL)))
    cells = splits.cells

    def placed(table: DataFrame, points, name: str) -> DataFrame:
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = splits.cell(points(matrix(b.column("v"))))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(cell.astype(np.int32))], names=["vec_id", "v", name])

        return table.select("vec_id", "v").mapInArrow(place, f"vec_id long, v array<double>, {name} int")

    kept = placed(rows, lifted, "cell")
    asked = cut(placed(v.where(F.col("vec_id") % every == 0), query_points, "home"))

    def blocks_of(table: DataFrame, size: int) -> np.ndarray:
        """How many blocks each cell's rows make; there are as many cells as sampled rows at most."""
        out = np.zeros(cells, np.int64)
        for cell, count in table.groupBy("cell").count().collect():
            out[cell] = -(-count // size)
        return out

    row_blocks = blocks_of(kept, 4 * CELL)

    def dealt(table: DataFrame, own: np.ndarray, other: np.ndarray, kind: int) -> DataFrame:
        """Each row in one block of its own kind, once for each block of the other kind in its cell."""

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell, ids = np.asarray(b.column("cell")), np.asarray(b.column("vec_id"))
                mine = (A.mix(ids.view(np.uint64)) % np.maximum(own[cell], 1).astype(np.uint64)).astype(np.int64)
                times = other[cell]
                row = np.repeat(np.arange(len(cell)), times)
                theirs = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                block = theirs * own[cell][row] + mine[row] if kind == 0 else mine[row] * other[cell][row] + theirs
                out = b.select(["cell", "vec_id", "v", "bound"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(block), pa.array(np.full(len(row), kind, np.int32))], names=[*out.schema.names, "block", "kind"])

        return table.select("cell", "vec_id", "v", "bound").mapInArrow(deal, "cell int, vec_id long, v array<double>, bound double, block long, kind int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in A.groups_of(batches, ["cell", "block"]):
            kind = np.asarray(group.column("kind"))
            ids, x, bound = np.asarray(group.column("vec_id")), matrix(group.column("v").combine_chunks()), np.asarray(group.column("bound"))
            own, ask = kind == 0, kind == 1
            if not own.any() or not ask.any():
                continue
            qi, ri, score = search_cell(ids[own], x[own], lifted(x[own]), ids[ask], x[ask], query_points(x[ask]), bound[ask], k, longest, limit)
            yield pa.RecordBatch.from_arrays([pa.array(ids[ask][qi]), pa.array(ids[own][ri]), pa.array(score)], names=["query_id", "vec_id", "score"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def searched(queries: DataFrame) -> DataFrame:
        query_blocks = blocks_of(queries, BLOCK)
        both = dealt(kept.withColumn("bound", F.lit(0.0)), row_blocks, query_blocks, 0).union(dealt(queries, query_blocks, row_blocks, 1))
        return both.repartition(max(parts, cells), "cell", "block").sortWithinPartitions("cell", "block").mapInArrow(run, "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    first = cut(searched(asked.select(F.col("home").alias("cell"), "vec_id", "v", F.lit(float("inf")).alias("bound"))))
    worst = first.groupBy("query_id").agg(F.try_element_at(F.sort_array(F.collect_list("score"), asc=False), F.lit(k)).alias("worst"))
    own = F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b)
    bound = F.coalesce(F.greatest(own + longest**2 - 2 * F.col("worst"), F.lit(0.0)) * (1 + 1e-9) + 1e-12, F.lit(float("inf")))
    waiting = asked.hint("merge").join(worst.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").select("home", "vec_id", "v", bound.alias("bound"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home = np.asarray(b.column("home"))
            points, reach = query_points(matrix(b.column("v"))), limit * np.asarray(b.column("bound"))
            for rows, cell in splits.within(points, reach):
                out = b.select(["vec_id", "v", "bound"]).take(pa.array(rows[home[rows] != cell]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(out.num_rows, cell, np.int32)), *out.columns], names=["cell", *out.schema.names])

    second = searched(cut(waiting.mapInArrow(spread, "cell int, vec_id long, v array<double>, bound double")))
    return best(first.union(second)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
