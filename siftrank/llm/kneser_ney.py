"""Character n-gram counts, interpolated modified Kneser-Ney smoothing and scoring, shared by operators 5 and 8.

Counts are Spark tables: a scan emits each partition's different n-grams with counts, a ``groupBy`` shards and sums them, and lower orders are
continuation counts (distinct left extensions) of the order above. Probabilities come from joins of each order with its contexts and with the order
below. Nothing of this is collected except four counts of counts for each order, from which the discounts follow.

The finished model is a table ``(key, value)``: a log value for each n-gram that occurs and a backoff weight for each context. Scoring reads it in one of
two ways that give the same sums: behind a check of its size (``MODEL_ROWS``) it is broadcast as a hash table, so documents are only scanned; a
larger model stays sharded and the documents' n-grams are joined to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftrank.llm import arrays as A
from siftrank.sources.checkpoints import cut

PAD = "\x02"
WINDOW = 128
MODEL_ROWS = 6_000_000


def _points(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each behind ``n - 1`` pads; the start of every n-gram; each text's length."""
    texts = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    size = np.asarray(pc.utf8_length(texts)).astype(np.int64)
    points = np.frombuffer((PAD * (n - 1)).join(["", *texts.to_pylist()]).encode("utf-32-le"), np.uint32)
    begin = np.concatenate([[0], np.cumsum(size + n - 1)[:-1]]) if len(size) else np.zeros(0, np.int64)
    start = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)
    return points, start, size


def window_keys(points: np.ndarray, start: np.ndarray, length: int, kind: int) -> np.ndarray:
    """A 64-bit key of each ``points[start:start + length]``; ``kind`` keeps n-grams and contexts of each order apart."""
    factors = A.mix(np.arange(1, length + 1, dtype=np.uint64) + np.uint64(kind * 1000)) | np.uint64(1)
    key = np.full(len(start), A.mix(np.array([kind + 17], np.uint64))[0], np.uint64)
    for j in range(length):
        key += (points[start + j].astype(np.uint64) + np.uint64(1)) * factors[j]
    return A.mix(key)


def gram_counts(docs: DataFrame, n: int, classes: list[str]) -> DataFrame:
    """``(gram, <class>...)``: how often each n-gram of the texts occurs in each class; ``docs`` has ``text`` and a 0/1 column for each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in A.pieces_of(whole, "text", 3_000_000):
                points, start, size = _points(batch.column("text"), n)
                _, first, inverse = np.unique(window_keys(points, start, n, 0), return_index=True, return_inverse=True)
                joined = points[(start[first][:, None] + np.arange(n)).reshape(-1)].tobytes().decode("utf-32-le")
                cols = [pa.array([joined[i : i + n] for i in range(0, len(joined), n)], pa.string())]
                for c in classes:
                    own = np.repeat(np.asarray(batch.column(c).cast(pa.float64())), size)
                    cols.append(pa.array(np.bincount(inverse, own, len(first)).astype(np.int64)))
                yield pa.RecordBatch.from_arrays(cols, names=["gram", *classes])

    schema = "gram string, " + ", ".join(f"{c} long" for c in classes)
    return docs.select("text", *classes).mapInArrow(run, schema).groupBy("gram").agg(*(F.sum(c).alias(c) for c in classes))


def discounts(counts: DataFrame, column: str) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the counts of counts; a table too small for them takes one half of each count."""
    row = counts.agg(*(F.count_if(F.col(column) == i) for i in (1, 2, 3, 4))).first()
    n1, n2, n3, n4 = (float(x) for x in row)
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), i - 0.05) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def _taken(column: str, d: tuple[float, float, float]) -> Column:
    c = F.col(column)
    return F.when(c <= 0, 0.0).when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def contexts(counts: DataFrame, order: int, column: str, d: tuple[float, float, float]) -> DataFrame:
    """``(context, total, gamma)``: the count of each context and the mass that its discounts leave for the order below."""
    return (
        counts.where(F.col(column) > 0).groupBy(F.substring("gram", 1, order - 1).alias("context"))
        .agg(F.sum(column).alias("total"), (F.sum(_taken(column, d)) / F.sum(column)).alias("gamma"))
    )


def lower_orders(top: DataFrame, order: int) -> tuple[dict[int, DataFrame], dict[int, DataFrame], float]:
    """Interpolated probabilities ``(gram, p)`` and backoff weights ``(context, gamma)`` of the orders below ``order``, and the uniform floor.

    ``top`` has the different n-grams of ``order``; what the lower orders count is how many different characters precede.
    """
    counts, grams = {}, top.select("gram")
    for k in range(order - 1, 0, -1):
        grams = counts[k] = cut(grams.groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c")))
    d = discounts(counts[1], "c")
    kinds, total, left = counts[1].agg(F.count("*"), F.sum("c"), F.sum(_taken("c", d))).first()
    floor = 1.0 / (max(kinds, 1) + 1)
    base = (left or 0.0) / max(total or 0, 1)
    p = {1: cut(counts[1].select("gram", ((F.col("c") - _taken("c", d)) / F.lit(float(total or 1)) + F.lit(base * floor)).alias("p")))}
    gamma = {}
    for k in range(2, order):
        p[k], gamma[k] = interpolated(counts[k], k, "c", p[k - 1])
    return p, gamma, base * floor if kinds else floor


def interpolated(counts: DataFrame, order: int, column: str, below: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One order's probabilities, interpolated with ``below``, and its backoff weights."""
    d = discounts(counts, column)
    held = cut(contexts(counts, order, column, d))
    joined = (
        counts.where(F.col(column) > 0).withColumn("context", F.substring("gram", 1, order - 1)).withColumn("suffix", F.substring("gram", 2, order - 1))
        .hint("merge").join(held, "context").hint("merge").join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("q")), "suffix")
    )
    p = (F.col(column) - _taken(column, d)) / F.col("total") + F.col("gamma") * F.col("q")
    return cut(joined.select("gram", p.alias("p"))), held.select("context", "gamma")


def keyed(table: DataFrame, column: str, length: int, kind: int, value: Column) -> DataFrame:
    """``(key, value)`` of a table of n-grams or contexts of ``length`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("s").to_pylist()
            points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            key = window_keys(points, np.arange(len(texts)) * length, length, kind)
            yield pa.RecordBatch.from_arrays([pa.array(A.signed(key)), batch.column("value")], names=["key", "value"])

    return table.select(F.col(column).alias("s"), value.cast("double").alias("value")).mapInArrow(run, "key long, value double")


class HashTable:
    """Vectorised lookups: a few levels of slots; what a level has no room for goes to the next. Values keep their type."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.kind = np.asarray(values).dtype
        self.levels = []
        while len(keys):
            bits = max(4, int(2 * len(keys) - 1).bit_length())
            factor = A.mix(np.array([len(self.levels)], np.uint64))[0] | np.uint64(1)
            slot = ((keys * factor) >> np.uint64(64 - bits)).astype(np.int64)
            own, first = np.unique(slot, return_index=True)
            at, have = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, self.kind)
            at[own], have[own] = keys[first], values[first]
            self.levels.append((factor, np.uint64(64 - bits), at, have))
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values = keys[left], values[left]

    def plain(self) -> tuple:
        """The table as plain arrays, which a broadcast can carry to workers that do not have this package."""
        return self.kind, self.levels

    @classmethod
    def of(cls, plain: tuple) -> HashTable:
        """The table of :meth:`plain` arrays."""
        table = cls.__new__(cls)
        table.kind, table.levels = plain
        return table

    def find(self, keys: np.ndarray, missing: float) -> np.ndarray:
        """The values of the keys; ``missing`` where there is none."""
        out = np.full(len(keys), missing, self.kind)
        rest = None
        for factor, shift, at, have in self.levels:
            k = keys if rest is None else keys[rest]
            slot = ((k * factor) >> shift).astype(np.int64)
            hit = at[slot] == k
            if rest is None:
                out[hit] = have[slot[hit]]
                rest = np.flatnonzero(~hit)
            else:
                out[rest[hit]] = have[slot[hit]]
                rest = rest[~hit]
        return out


def windows(size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each window of ``width`` units begins in the flat units of texts of these sizes, and its text."""
    count = -(-size // width)
    owner = np.repeat(np.arange(len(size)), count)
    number = np.arange(count.sum()) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return np.concatenate([[0], np.cumsum(size)[:-1]])[owner] + number * width, owner


def score(docs: DataFrame, model: DataFrame, order: int, last: int, floor: float, model_rows: int = MODEL_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, chars, total, top)`` and the columns ``carry``: each text's characters, summed log values, and its largest sum over one window.

    From ``order`` down to ``last``, the first order whose n-gram the model holds gives its value, and each miss adds its context's
    backoff weight, if it has one; a character that no order holds adds ``floor``. Texts without characters have 0, 0 and a null ``top``.
    """
    model = cut(model)
    if model.count() <= model_rows:
        return _score_scanned(docs, model, order, last, floor, carry)
    return _score_joined(docs, model, order, last, floor, carry)


def _score_scanned(docs: DataFrame, model: DataFrame, order: int, last: int, floor: float, carry: tuple[str, ...]) -> DataFrame:
    rows = model.toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(HashTable(rows.column("key").to_numpy().view(np.uint64), rows.column("value").to_numpy()).plain())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = HashTable.of(shared.value)
        for whole in batches:
            for batch in A.pieces_of(whole, "text", 1_000_000):
                points, start, size = _points(batch.column("text"), order)
                value = np.zeros(len(start), np.float64)
                rest = np.arange(len(start))
                for k in range(order, last - 1, -1):
                    at = start[rest] + (order - k)
                    got = table.find(window_keys(points, at, k, k), np.nan)
                    miss = np.isnan(got)
                    value[rest[~miss]] += got[~miss]
                    rest = rest[miss]
                    if k > 1:
                        value[rest] += table.find(window_keys(points, at[miss], k - 1, 100 + k), 0.0)
                value[rest] += floor
                begin, owner = windows(size, WINDOW)
                sums = np.add.reduceat(value, begin) if len(begin) else np.zeros(0)
                total = np.bincount(owner, sums, len(size))
                top = np.full(len(size), -np.inf)
                np.maximum.at(top, owner, sums)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), pa.array(size), pa.array(total), pa.array(top, mask=size == 0), *(batch.column(c) for c in carry)],
                    names=["doc_id", "chars", "total", "top", *carry],
                )

    extra = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select("doc_id", "text", *carry).mapInArrow(run, "doc_id long, chars long, total double, top double" + extra)


def _score_joined(docs: DataFrame, model: DataFrame, order: int, last: int, floor: float, carry: tuple[str, ...]) -> DataFrame:
    """The same for a model too large to broadcast: the n-grams of each window are joined to the sharded model, order by order.

    Each row has its own key, on disk before it is used twice: rows without a ``doc_id``, or with the same one, stay apart.
    """
    docs = cut(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", *carry))
    names = [f"{kind}{k}" for k in range(order, last - 1, -1) for kind in ("g", "c")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in A.pieces_of(whole, "text", 1_000_000):
                points, start, size = _points(batch.column("text"), order)
                begin, owner = windows(size, WINDOW)
                number = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(start))))
                row = owner[number]
                window = (begin[number] - np.concatenate([[0], np.cumsum(size)[:-1]])[row]) // WINDOW if len(begin) else number
                keys = []
                for k in range(order, last - 1, -1):
                    at = start + (order - k)
                    keys += [pa.array(A.signed(window_keys(points, at, k, k))), pa.array(A.signed(window_keys(points, at, k - 1, 100 + k)))]
                rows = batch.column("row").take(pa.array(row))
                yield pa.RecordBatch.from_arrays([rows, pa.array(window.astype(np.int64)), *keys], names=["row", "window", *names])

    schema = "row long, window long, " + ", ".join(f"{c} long" for c in names)
    spark = docs.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("row", "text").mapInArrow(run, schema).groupBy("row", "window", *names).agg(F.count("*").alias("n"))
    rows = rows.withColumn("value", F.lit(0.0)).withColumn("done", F.lit(False)).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(min(salts, 16))))
    spread = model.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(min(salts, 16) - 1).cast("long"))))
    for name in names:
        rows = rows.hint("merge").join(spread.select(F.col("key").alias(name), "salt", F.col("value").alias("v")), [name, "salt"], "left")
        rows = rows.withColumn("value", F.when(F.col("done"), F.col("value")).otherwise(F.col("value") + F.coalesce("v", F.lit(0.0))))
        if name[0] == "g":
            rows = rows.withColumn("done", F.col("done") | F.col("v").isNotNull())
        rows = rows.drop("v", name)
    value = (F.col("value") + F.when(F.col("done"), 0.0).otherwise(floor)) * F.col("n")
    summed = rows.groupBy("row", "window").agg(F.sum(value).alias("s"), F.sum("n").alias("n"))
    scored = summed.groupBy("row").agg(F.sum("n").alias("chars"), F.sum("s").alias("total"), F.max("s").alias("top"))
    return docs.drop("text").hint("merge").join(scored, "row", "left").select(
        "doc_id", F.coalesce("chars", F.lit(0)).alias("chars"), F.coalesce("total", F.lit(0.0)).alias("total"), "top", *carry
    )


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
