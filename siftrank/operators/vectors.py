"""Scoring pairs from vectors of items and targets: projections, products, readouts, pooling, and the selected part of each target.

Target sides are counted and broadcast in blocks of at most about ``TARGETS_PER_BLOCK``, one pass over the items for each, so neither side is ever held whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftrank.functions import scalar as S
from siftrank.operators import ordered as O
from siftrank.operators.numbering import broadcast_small, numbered_within
from siftrank.plans import lifecycle
from siftrank.sources.checkpoints import stored

TARGETS_PER_BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def affine(x: Column, weights: list[list[float]], bias: list[float], relu: bool = False) -> Column:
    """``W x + b``, element by element, cut off below 0 on request."""
    rows = [dot(x, F.array(*(F.lit(float(w)) for w in row))) + F.lit(float(b)) for row, b in zip(weights, bias, strict=True)]
    return F.array(*(F.greatest(r, F.lit(0.0)) if relu else r for r in rows))


def target_blocks(targets: DataFrame) -> list[DataFrame]:
    """The targets in parts of at most about ``TARGETS_PER_BLOCK`` rows; a table that fits one is one."""
    many = -(-targets.count() // TARGETS_PER_BLOCK)
    if many <= 1:
        return [targets]
    rows = stored(targets)
    return [rows.where(F.pmod(F.xxhash64("target_id"), F.lit(many)) == b) for b in range(many)]


def with_every_target(items: DataFrame, targets: DataFrame, select) -> DataFrame:
    """``select`` of the items beside every target, block by block of the targets."""
    return reduce(DataFrame.unionByName, (select(items.crossJoin(F.broadcast(block))) for block in target_blocks(targets)))


def score_pairs(items: DataFrame, targets: DataFrame, scale: float = 1.0) -> DataFrame:
    """``target_id, ligand_id, logit`` of every pair of ``items(ligand_id, v)`` and ``targets(target_id, v)``."""
    logit = (dot(F.col("v"), F.col("_t")) / max(scale, 1e-3)).alias("logit")
    return with_every_target(items, targets.select("target_id", F.col("v").alias("_t")), lambda rows: rows.select("target_id", "ligand_id", logit))


def remapped(targets: DataFrame, overrides: DataFrame) -> DataFrame:
    """Targets with the vector of another where ``overrides(target_id, source_id)`` says so."""
    sources = targets.select(F.col("target_id").alias("source_id"), F.col("v").alias("_v"))
    ids = targets.select("target_id").join(overrides, "target_id", "left").withColumn("source_id", F.coalesce("source_id", "target_id"))
    return ids.hint("merge").join(sources, "source_id").select("target_id", F.col("_v").alias("v"))


def constant_targets(targets: DataFrame, state: DataFrame) -> DataFrame:
    """Every target with the one vector of ``state(v)``: the control that knows no target."""
    return targets.select("target_id").crossJoin(F.broadcast(state.select("v").limit(1)))


def constant_gain(real: DataFrame, constant: DataFrame, column: str) -> DataFrame:
    """``target_id, real, constant, gain`` of a metric of each target with its own state and with the constant one."""
    both = real.select("target_id", F.col(column).alias("real")).hint("merge").join(constant.select("target_id", F.col(column).alias("constant")), "target_id")
    return both.withColumn("gain", F.col("real") - F.col("constant"))


def _products(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Products of all rows of both, summed component by component: equal rows get equal bits, wherever they lie in a batch."""
    out = np.zeros((len(x), len(w)))
    for c in range(x.shape[1]):
        out += np.multiply.outer(x[:, c], w[:, c])
    return out


def top_scored(items: DataFrame, targets: DataFrame, fraction: float = 0.10, scale: float = 1.0, digits: int | None = None) -> DataFrame:
    """The best part of every target, without ever holding all scores: a matrix product for each Arrow batch and block of targets, the batch's own best rows, then the best of all.

    ``k`` is rounded up from all items; a batch keeps at most ``k`` rows of a target, so what is shuffled shrinks with the fraction. With ``digits`` scores are rounded before they are ranked, so that ties at these digits go to smaller items,
    whatever the last bits of a sum are.
    """
    n = items.count()
    k = max(1, int(np.ceil(fraction * n)))
    kind, item_kind = (t.schema[c].dataType.simpleString() for t, c in ((targets, "target_id"), (items, "ligand_id")))

    def best_of(block: DataFrame) -> DataFrame:
        rows = block.orderBy("target_id").select("target_id", "v").toArrow()
        w = np.array(rows.column("v").to_pylist(), np.float64) / max(scale, 1e-3)
        shared = items.sparkSession.sparkContext.broadcast((rows.column("target_id").to_numpy(), w))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, w = shared.value
            for batch in batches:
                column = batch.column("v")
                x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
                own = np.asarray(batch.column("ligand_id"))
                for t in range(0, len(ids), 256):
                    s = x @ w[t : t + 256].T if digits is None else np.round(_products(x, w[t : t + 256]), digits)
                    for j in range(s.shape[1]):
                        keep = np.lexsort((own, -s[:, j]))[:k]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), ids[t + j])), pa.array(own[keep]), pa.array(s[keep, j])], names=["target_id", "ligand_id", "logit"])

        return items.select("ligand_id", "v").mapInArrow(run, f"target_id {kind}, ligand_id {item_kind}, logit double")

    found = stored(reduce(DataFrame.unionByName, map(best_of, target_blocks(targets))))
    return O.first_places(found, ["target_id"], "logit", "ligand_id", F.lit(k)).withColumn("rk", F.col("rk").cast("int"))


def top_of_scores(pairs: DataFrame, fraction: float = 0.10) -> DataFrame:
    """The best part of each target of an existing score table, ``k`` rounded up."""
    return O.first_places(stored(pairs), ["target_id"], "logit", "ligand_id", S.top_ceil(fraction, F.col("n"))).withColumn("rk", F.col("rk").cast("int"))


def split_readout(items: DataFrame, targets: DataFrame, a: list[list[float]], b: list[list[float]], b1: list[float], w2: list[float], b2: float) -> DataFrame:
    """``relu(A l + (B p + b1)) . w2 + b2``: each side's part is computed once, not for each pair."""
    left = items.select("ligand_id", affine(F.col("v"), a, [0.0] * len(a)).alias("l"))
    right = targets.select("target_id", affine(F.col("v"), b, b1).alias("p"))
    hidden = F.zip_with("l", "p", lambda x, y: F.greatest(x + y, F.lit(0.0)))
    out = dot(hidden, F.array(*(F.lit(float(w)) for w in w2))) + F.lit(float(b2))
    return with_every_target(left, right, lambda rows: rows.select("target_id", "ligand_id", out.alias("logit")))


def hadamard_score(items: DataFrame, targets: DataFrame, weights: list[float]) -> DataFrame:
    """A linear readout of the element-wise product; the weights are folded into the target side."""
    w = F.array(*(F.lit(float(x)) for x in weights))
    return score_pairs(items, targets.select("target_id", F.zip_with("v", w, lambda x, y: x.cast("double") * y).alias("v")))


def _group_codes(batch: pa.RecordBatch, by: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each combination of the keys, in order of appearance, and each row's combination."""
    code = np.zeros(batch.num_rows, np.int64)
    for c in by:
        coded = batch.column(c).dictionary_encode(null_encoding="encode")
        code = np.unique(code * (len(coded.dictionary) + 1) + np.asarray(coded.indices), return_inverse=True)[1]
    _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
    order = np.argsort(first)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return first[order], place[inverse]


def vector_sums(rows: DataFrame, by: list[str], vector: str = "v") -> DataFrame:
    """``by, n, v``: how many vectors each combination of the keys has, and their sum, component by component.

    Tasks sum each Arrow batch before anything is shuffled, so a frequent key sends a row for each batch, not for each vector; what arrives is sorted by key and summed as it streams. Null vectors do not count; shorter vectors
    are filled up with zeros.
    """

    def summed(sorted_by_key: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                whole = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
                first, group = _group_codes(whole, by)
                lists = whole.column("v")
                length = np.diff(np.asarray(lists.offsets))
                width = int(length.max(initial=0))
                flat = np.asarray(lists.flatten())
                x = np.zeros((whole.num_rows, width))
                x[np.arange(width)[None] < length[:, None]] = flat
                order = np.argsort(group, kind="stable")
                starts = np.searchsorted(group[order], np.arange(len(first)))
                total, n = np.add.reduceat(x[order], starts, axis=0), np.add.reduceat(np.asarray(whole.column("n"))[order], starts)
                ends = pa.array(np.arange(0, len(first) * width + 1, max(width, 1), dtype=np.int32) if width else np.zeros(len(first) + 1, np.int32))
                out = pa.RecordBatch.from_arrays([*(whole.column(c).take(pa.array(first)) for c in by), pa.array(n), pa.ListArray.from_arrays(ends, pa.array(total.ravel()))], names=[*by, "n", "v"])
                if sorted_by_key:
                    held = out.slice(out.num_rows - 1)
                    out = out.slice(0, out.num_rows - 1)
                if out.num_rows:
                    yield out
            if held is not None:
                yield held

        return run

    schema = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in by) + "n long, v array<double>"
    one = rows.where(F.col(vector).isNotNull()).select(*by, F.lit(1).cast("long").alias("n"), F.transform(vector, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("v"))
    partial = one.mapInArrow(summed(False), schema)
    if not by:
        # a row for each batch of the table, in as many steps as it takes to be few
        return partial.repartition(64).mapInArrow(summed(True), schema).coalesce(1).mapInArrow(summed(True), schema)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return partial.repartition(parts, *by).sortWithinPartitions(*by).mapInArrow(summed(True), schema)


def mean_vector(rows: DataFrame, by: list[str], vector: str = "v", digits: int | None = None) -> DataFrame:
    """``by, v``: the mean of each component."""
    value = lambda x: x / F.col("n") if digits is None else F.round(x / F.col("n"), digits)
    return vector_sums(rows, by, vector).select(*by, F.transform("v", value).alias("v"))


def message_sum(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, n, v``: for each node with incoming edges their number and the sum of the sources' vectors."""
    sent = edges.hint("merge").join(nodes.select(F.col("node").alias("src"), "v"), "src").select(F.col("dst").alias("node"), "v")
    return vector_sums(sent, ["node"])


def pooled_graphs(graphs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``graph, nodes, v, empty``: the mean vector of each listed graph's nodes; graphs without nodes are told, not dropped."""
    sums = vector_sums(nodes, ["graph"]).select("graph", F.col("n").alias("nodes"), F.transform("v", lambda x: x / F.col("n")).alias("v"))
    joined = graphs.select("graph").distinct().hint("merge").join(sums, "graph", "left")
    return joined.select("graph", F.coalesce("nodes", F.lit(0)).alias("nodes"), "v", F.col("nodes").isNull().alias("empty"))


#: Queries that one task holds, and keys that it looks at together.
QUERY_BLOCK, KEY_BLOCK = 1024, 4096


def attention(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """One-head readout: softmax of scaled products over the keys of the query's group, the weighted mean of the keys, and its mean over the group's queries.

    Both have ``group, id, v``; returns ``group, pos, x``. Queries of a group are dealt in blocks of about ``QUERY_BLOCK``, and the group's keys stream past each block: the task keeps each query's largest product, the sum of its weights and its
    weighted sum, and rescales them when a larger product comes, so no pair of query and key is ever a row. Groups without keys return nothing.
    """
    sizes = stored(queries.groupBy("group").agg(F.ceil(F.count("*") / F.lit(QUERY_BLOCK)).cast("int").alias("blocks")))
    vector = F.transform("v", lambda x: x.cast("double")).alias("v")
    ask = queries.hint("merge").join(sizes, "group").select("group", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.lit(0).alias("kind"), vector)
    told = keys.hint("merge").join(sizes, "group").select("group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def result() -> pa.RecordBatch:
            q, _, weight, total = state
            pooled = (total[weight > 0] / weight[weight > 0][:, None]).sum(0)
            return pa.RecordBatch.from_arrays([pa.array([now[0]], batch.schema.field("group").type), pa.array([int((weight > 0).sum())]), pa.array([pooled], pa.list_(pa.float64()))], names=["group", "n", "v"])

        for batch in batches:
            x = np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, -1) if batch.num_rows else None
            kind = np.asarray(batch.column("kind"))
            first, group = _group_codes(batch, ["group", "block"])
            for g, at in enumerate(first):
                own = np.flatnonzero(group == g)
                name = (batch.column("group")[int(at)].as_py(), batch.column("block")[int(at)].as_py())
                if name != now:
                    if state is not None and (state[2] > 0).any():
                        yield result()
                    now, state = name, None
                ask = x[own[kind[own] == 0]]
                if len(ask):  # a block's queries come before its keys
                    held = np.zeros((0, ask.shape[1])) if state is None else state[0]
                    q = np.concatenate([held, ask])
                    state = q, np.full(len(q), -np.inf), np.zeros(len(q)), np.zeros(q.shape)
                told = x[own[kind[own] == 1]]
                for k in range(0, len(told), KEY_BLOCK):
                    if state is None:
                        break
                    q, most, weight, total = state
                    part = told[k : k + KEY_BLOCK]
                    s = q @ part.T / np.sqrt(q.shape[1])
                    top = np.maximum(most, s.max(1))
                    scale, e = np.exp(most - top), np.exp(s - top[:, None])
                    state = q, top, weight * scale + e.sum(1), total * scale[:, None] + e @ part
        if state is not None and (state[2] > 0).any():
            yield result()

    kind = queries.schema["group"].dataType.simpleString()
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = ask.unionByName(told).repartition(parts, "group", "block").sortWithinPartitions("group", "block", "kind").mapInArrow(run, f"`group` {kind}, n long, v array<double>")
    # a row for each block of queries
    parts_of = blocks.select("group", "n", F.posexplode("v").alias("pos", "x")).groupBy("group", "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return parts_of.select("group", "pos", (F.col("x") / F.col("n")).alias("x"))


def ring_edges(nodes: DataFrame, key: str, k: int = 16) -> DataFrame:
    """``src, dst``: the nodes, in key order, as a ring, each with its next ``k``."""
    placed = stored(numbered_within(nodes.select(key), [], [key], "i"))
    n = placed.count()
    steps = placed.select(F.col(key).alias("src"), F.explode(F.sequence(F.col("i") + 1, F.col("i") + k)).alias("next")).select("src", (F.col("next") % max(n, 1)).alias("i"))
    return steps.hint("merge").join(placed.select("i", F.col(key).alias("dst")), "i").select("src", "dst")


def cycled(rows: DataFrame, key: str, p: int) -> DataFrame:
    """The rows, in key order, repeated until there are ``p``: ``i, ...``."""
    placed = stored(numbered_within(rows, [], [key], "_k"))
    n = placed.count()
    return rows.sparkSession.range(p).withColumnRenamed("id", "i").withColumn("_k", F.col("i") % max(n, 1)).join(broadcast_small(placed), "_k").drop("_k")


def cache_counts(requests: DataFrame) -> DataFrame:
    """How often each target's state is asked for: one encoding each, the others are hits."""
    return requests.groupBy("target_id").agg(F.count("*").alias("requests")).agg(F.count("*").alias("misses"), F.sum(F.col("requests") - 1).alias("hits"))


def losses(scored: DataFrame, weight: float = 0.2) -> DataFrame:
    """Mean classification and regression losses and their weighted sum; ``scored`` has ``logit, y, z, score_pred``."""
    bce = F.avg(S.bce_with_logits(F.col("logit"), F.col("y")))
    huber = F.avg(F.when(F.col("z").isNotNull(), S.huber(F.col("score_pred") - F.col("z"))))
    return scored.agg(bce.alias("bce"), huber.alias("huber")).withColumn("total", F.col("bce") + weight * F.col("huber"))


def joint_loss(f: np.ndarray, y: np.ndarray, z: np.ndarray, p: np.ndarray, weight: float) -> tuple[float, np.ndarray]:
    """The summed loss and its gradient at ``p``: one score ``s = w . f + b``, a logit ``a s + c`` and a predicted standardised truth ``d s + e``.

    The loss of a row is the cross entropy of the logit with ``y`` and, where ``z`` is present, ``weight`` times the Huber loss of the other.
    """
    w, (b, a, c, d, e) = p[:-5], p[-5:]
    s = f @ w + b
    logit, r = a * s + c, np.where(np.isnan(z), 0.0, d * s + e - np.nan_to_num(z))
    bce = np.maximum(logit, 0) - logit * y + np.log1p(np.exp(-np.abs(logit)))
    huber = np.where(np.abs(r) <= 1, r * r / 2, np.abs(r) - 0.5)
    g, h = 1 / (1 + np.exp(-np.clip(logit, -500, 500))) - y, weight * np.where(np.isnan(z), 0.0, np.clip(r, -1, 1))
    ds = g * a + h * d
    return float((bce + weight * huber).sum()), np.concatenate([f.T @ ds, [ds.sum(), (g * s).sum(), g.sum(), (h * s).sum(), h.sum()]])


def fit_hits(pairs: DataFrame, features: str = "features", weight: float = 0.2, steps: int = 25, rate: float = 0.15) -> np.ndarray:
    """Fit one score to hits and to standardised truth together; ``pairs`` has ``features, y, z``, ``z`` null where there is no truth.

    Each step is one job: tasks sum their rows' gradients, and only those sums leave them. Steps follow Adam's rule.
    """
    rows = pairs.select(F.col(features).cast("array<double>").alias("f"), F.col("y").cast("double").alias("y"), F.col("z").cast("double").alias("z"))
    size = rows.agg(F.max(F.size("f"))).first()[0] or 0
    p = np.concatenate([np.zeros(size), [0.0, 1.0, 0.0, -1.0, 0.0]])
    p[:size] = np.random.default_rng(0).standard_normal(size) * 0.01
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        shared = pairs.sparkSession.sparkContext.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total, many = np.zeros(len(shared.value)), 0
            for batch in batches:
                column = batch.column("f")
                f = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
                y, z = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in "yz")
                total, many = total + joint_loss(f, y, z, shared.value, weight)[1], many + len(y)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total) + 1), pa.int32()), pa.array([*total, float(many)])], names=["pos", "g"])

        sums = dict(rows.mapInArrow(run, "pos int, g double").groupBy("pos").agg(F.sum("g")).collect())
        if not sums.get(len(p)):
            return p
        g = np.array([sums[i] for i in range(len(p))]) / sums[len(p)]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p


def _rows_of(batch: pa.RecordBatch, at: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, hits and truths of a batch of ``v, t, y, z``: a feature is a product of the two vectors' components, made here, never stored."""
    v, t = (np.asarray(batch.column(c).flatten(), np.float64).reshape(batch.num_rows, -1) for c in "vt")
    y, z = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in "yz")
    return (v * t)[at], y[at], z[at]


def fit_batches(batches: DataFrame, held: DataFrame, weight: float = 0.2, rate: float = 0.05, shards: int = 4, per_round: int = 8, patience: int = 3) -> tuple[np.ndarray, DataFrame]:
    """Stochastic fit of the model of :func:`fit_hits` over a batch plan; returns the best parameters and the learning curve ``update, metric, best``.

    ``batches`` has ``update, pos, v, t, y, z``: item and target vectors, hit, standardised truth or null; see :func:`splits.balanced_batches` for the plan. ``held`` has ``v, t, y, z``. The updates of a plan are dealt to ``shards`` tasks; in a round
    each takes its next ``per_round`` updates, one step of gradient descent for each, from the same parameters, and the results are averaged, so a round is one job and only parameters leave its tasks. After each round the held-out
    loss is measured; the rule of :func:`lifecycle.early_stop` ends the fit, and the parameters of the best round are returned. With one shard this is plain descent, update by update.
    """
    spark = batches.sparkSession
    kind = lambda c: F.transform(c, lambda x: x.cast("double")).alias(c)
    told = [kind("v"), kind("t"), F.col("y").cast("double").alias("y"), F.col("z").cast("double").alias("z")]
    batches, held = stored(batches.select("update", "pos", *told)), stored(held.select(*told))
    size, last = batches.agg(F.max(F.size("v")), F.max("update")).first()
    p = np.concatenate([np.random.default_rng(0).standard_normal(size or 0) * 0.01, [0.0, 1.0, 0.0, -1.0, 0.0]])
    best, curve, step = p, [], shards * per_round
    schema = "update long, metric double"
    for begin in range(0, (last + 1) if last is not None else 0, step):

        def descend(rows: Iterator[pa.RecordBatch], p=p) -> Iterator[pa.RecordBatch]:
            whole = [b for b in rows if b.num_rows]  # the updates of one task in one round: per_round batches
            if not whole:
                return
            table = pa.Table.from_batches(whole).combine_chunks().to_batches()[0]
            update, q = np.asarray(table.column("update")), p.copy()
            for u in np.unique(update):
                f, y, z = _rows_of(table, update == u)
                q = q - rate * joint_loss(f, y, z, q, weight)[1] / len(y)
            yield pa.RecordBatch.from_arrays([pa.array([len(np.unique(update))]), pa.array([q], pa.list_(pa.float64()))], names=["updates", "p"])

        own = batches.where((F.col("update") >= begin) & (F.col("update") < begin + step)).withColumn("shard", (F.col("update") % shards).cast("int"))
        moved = own.repartition(shards, "shard").sortWithinPartitions("shard", "update", "pos")
        done = moved.mapInArrow(_by_shard(descend), "updates long, p array<double>").collect()  # a row for each shard
        p = np.average([r["p"] for r in done], axis=0, weights=[r["updates"] for r in done])

        def lose(rows: Iterator[pa.RecordBatch], p=p) -> Iterator[pa.RecordBatch]:
            total, many = 0.0, 0
            for b in rows:
                if b.num_rows:
                    total, many = total + joint_loss(*_rows_of(b), p, weight)[0], many + b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([many])], names=["loss", "n"])

        loss = held.mapInArrow(lose, "loss double, n long").agg(F.sum("loss") / F.sum("n")).first()[0]
        curve.append((min(begin + step, last + 1), -loss))
        rows = lifecycle.early_stop(spark.createDataFrame(curve, schema).withColumn("run", F.lit(0)), patience, ["run"]).first()
        best = p if rows["best_update"] == curve[-1][0] else best
        if rows["reason"] == "patience":
            break
    top = max((m for _, m in curve), default=None)
    return best, spark.createDataFrame([(u, m, m == top) for u, m in curve], schema + ", best boolean")


def _by_shard(run):
    """Several shards can share a partition: each is run on its own rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = np.asarray(batch.column("shard"))
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(int(a), int(b - a))
                if held and held[-1].column("shard")[0].as_py() != part.column("shard")[0].as_py():
                    yield from run(iter(held))
                    held = []
                held.append(part)
        if held:
            yield from run(iter(held))

    return each


def predicted(pairs: DataFrame, p: np.ndarray, features: str = "features") -> DataFrame:
    """``pairs`` with ``logit, p_hit, score_pred`` of a fitted model."""
    b, a, c, d, e = (float(x) for x in p[-5:])
    s = dot(F.col(features), F.array(*(F.lit(float(w)) for w in p[:-5]))) + F.lit(b)
    rows = pairs.withColumn("_s", s)
    return rows.withColumns({"logit": F.col("_s") * a + c, "score_pred": F.col("_s") * d + e}).withColumn("p_hit", S.sigmoid(F.col("logit"))).drop("_s")
