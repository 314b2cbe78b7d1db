"""Operator 7. Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (equal texts) are sorted by size; each enters the shard with the tightest remaining capacity that still holds it,
found by bisection in a balanced order of remaining capacities. Only sizes drive that choice, so the sequential part runs over the
histogram ``(group size, groups)``, in one small task. The histogram is bounded: distinct sizes that sum to at most
T bytes number at most ``sqrt(2 T)``. All of a size's groups that fit one shard enter it in one step. Capacity is the least, within
``tolerance``, at which the packing needs no more than the given number of shards.

Everything else is joins and counts over all rows: ranks inside one size and slots inside one shard come from per-bucket
counts and offsets, so neither a frequent size nor a shard is ever sorted in one task.

A null text has no bytes and is a group of its own, apart from empty texts; both have ``text_crc32`` 0. Repeated rows are packed with their
group and each get a slot. A table of fewer groups than shards leaves shards empty; an empty table gives an empty result.
Extra columns are ignored. A group larger than an even share makes its shard larger than the others; it is never split. It has that shard to itself,
and the even share of the remaining groups over the remaining shards is what the others are filled to.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftrank.sources.checkpoints import cut

OVERHEAD = 8
BUCKETS = 256


def best_fit(histogram: list[tuple[int, int]], capacity: int, shards: int) -> list[tuple[int, int, int]] | None:
    """Pack ``(size, count)`` entries, largest first: runs ``(size, shard, count)``, or None if they don't fit."""
    free = [(capacity, s) for s in range(shards)]
    runs = []
    for size, count in histogram:
        while count:
            at = bisect_left(free, (size, -1))
            if at == len(free):
                return None
            room, shard = free.pop(at)
            n = min(count, room // size)
            insort(free, (room - n * size, shard))
            runs.append((size, shard, n))
            count -= n
    return runs


def pack(histogram: list[tuple[int, int]], shards: int, tolerance: float) -> list[tuple[int, int, int]]:
    """Groups above an even share of what remains get a shard each; the others are packed over the other shards at the least capacity, within ``tolerance``, that holds them."""
    histogram = sorted(histogram, reverse=True)
    total = sum(s * n for s, n in histogram)
    runs, used = [], 0
    # taking a larger group out lowers the share of the rest, so the next ones are tested against that
    while histogram and histogram[0][0] * (shards - used) > total:
        size, count = histogram[0]
        runs.append((size, used, 1))
        histogram = ([(size, count - 1)] if count > 1 else []) + histogram[1:]
        total, used = total - size, used + 1
    if histogram:
        runs += [(size, used + shard, n) for size, shard, n in _least_capacity(histogram, shards - used, total, tolerance)]
    return runs


def _least_capacity(histogram: list[tuple[int, int]], shards: int, total: int, tolerance: float) -> list[tuple[int, int, int]]:
    """The packing at the least capacity, within ``tolerance``, that needs no more than ``shards`` shards."""
    low = -(-total // shards)
    high, step = low, max(1, int(low * tolerance))
    best = best_fit(histogram, high, shards)
    while best is None:
        low, high, step = high + 1, high + step, step * 2
        best = best_fit(histogram, high, shards)
    while high - low > low * tolerance:
        mid = (low + high) // 2
        if (got := best_fit(histogram, mid, shards)) is None:
            low = mid + 1
        else:
            best, high = got, mid
    return best


def _packer(shards: int, tolerance: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(int(s), int(n)) for frame in frames for s, n in zip(frame["group_size"], frame["groups"], strict=True)]
        if rows:
            yield pd.DataFrame(pack(rows, shards, tolerance), columns=["group_size", "shard", "n"]).reset_index(names="step")

    return run


def ranked_in(df: DataFrame, key: str, order: Column, name: str) -> DataFrame:
    """Add a gapless rank from 0 inside each ``key``, by ``(bucket, order)``; no window holds a whole key."""
    df = df.withColumn("bucket", F.pmod(F.xxhash64(order), F.lit(BUCKETS)))
    before = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = df.groupBy(key, "bucket").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy(key, "bucket").orderBy(order)
    return (
        df.withColumn("inside", F.row_number().over(inside) - 1).hint("merge").join(offset, [key, "bucket"])
        .withColumn(name, F.col("inside") + F.col("offset")).drop("bucket", "inside", "offset")
    )


def shard_by_bytes(docs: DataFrame, shards: int = 24, tolerance: float = 0.0005) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``: law ``bytes``, equal texts in one shard."""
    rows = cut(docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.encode(F.lit(""), "UTF-8"))).alias("text_crc32"),
        F.coalesce(F.sha2("text", 256), F.lit("null")).alias("text_key"),
    ))
    groups = rows.groupBy("text_key").agg(F.sum("size").alias("group_size"))
    histogram = groups.groupBy("group_size").agg(F.count("*").alias("groups"))
    runs = cut(histogram.repartition(1).mapInPandas(_packer(shards, tolerance), "step long, group_size long, shard int, n long"))
    upto = F.sum("n").over(Window.partitionBy("group_size").orderBy("step"))
    by_size = runs.withColumn("upto", upto).groupBy("group_size").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("runs"))
    numbered = ranked_in(groups, "group_size", F.col("text_key"), "number")
    placed = numbered.hint("merge").join(by_size, "group_size").select(
        "text_key", F.filter("runs", lambda r: r["upto"] > F.col("number"))[0]["shard"].alias("shard")
    )
    out = cut(rows.hint("merge").join(placed, "text_key").select("doc_id", "size", "text_crc32", "shard", F.struct("doc_id", "text_key", F.monotonically_increasing_id()).alias("order")))
    return ranked_in(out, "shard", F.col("order"), "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
