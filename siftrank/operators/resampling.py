"""Resamples drawn by portable hashes, a block of draws at a time.

Draw ``pos`` of resample ``b`` is ``hash_number("seed#b#pos", n)`` of :mod:`siftrank.functions.scalar`, so other SQL engines draw alike. No draw is a row: Spark deals resamples to tasks, and a task hashes the keys of a resample as arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Values that travel to every task at most; draws of a block, and of a task.
VALUES, BLOCK, TASK_DRAWS = 8_000_000, 32_768, 4_000_000

_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [*(7, 12, 17, 22) * 4, *(5, 9, 14, 20) * 4, *(4, 11, 16, 23) * 4, *(6, 10, 15, 21) * 4]
_WORDS = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]


def hash_heads(prefix: bytes, first: int, count: int) -> np.ndarray:
    """The first eight digits of the MD5, as numbers, of ``prefix`` followed by each of ``count`` numbers from ``first``, which all have as many digits; 55 bytes at most."""
    digits = len(str(first))
    size = len(prefix) + digits
    fixed = np.frombuffer((prefix + bytes(digits) + b"\x80").ljust(56, b"\0") + (8 * size).to_bytes(8, "little"), "<u4")
    varied: dict[int, np.ndarray] = {}
    left = np.arange(first, first + count)
    for at in range(size - 1, len(prefix) - 1, -1):
        left, digit = np.divmod(left, 10)
        part = (digit + 48).astype(np.uint32) << np.uint32(8 * (at % 4))
        varied[at // 4] = varied[at // 4] + part if at // 4 in varied else part + fixed[at // 4]
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, d = (np.full(count, x, np.uint32) for x in start)
    f, t = np.empty_like(a), np.empty_like(a)
    for i, (sine, turn, word) in enumerate(zip(_SINES, _TURNS, _WORDS)):
        if i < 32:
            x, y, z = (b, c, d) if i < 16 else (d, b, c)
            np.bitwise_xor(y, z, out=f)
            f &= x
            f ^= z
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        if word in varied:
            f += varied[word]
            f += np.uint32(sine)
        else:
            f += np.uint32((sine + int(fixed[word])) & 0xFFFFFFFF)
        np.left_shift(f, np.uint32(turn), out=t)
        f >>= np.uint32(32 - turn)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += np.uint32(start[0])
    return a.byteswap()


def draws_of(seed: int, b: int, n: int) -> Iterator[np.ndarray]:
    """Which of ``n`` numbered values each of the ``n`` draws of resample ``b`` takes, in blocks."""
    prefix, first = f"{seed}#{b}#".encode(), 0
    while first < n:
        count = min(n, 10 ** len(str(first)), first + BLOCK) - first
        yield hash_heads(prefix, first, count) % np.uint32(n) if n < 1 << 32 else hash_heads(prefix, first, count)
        first += count


def resampled(terms: DataFrame, draws: int, seed: int) -> DataFrame:
    """``s, b, total, present``: the sum, and the number, of the values that are there, of each series in each resample.

    ``terms`` has ``s, k, v``: whole numbers (or nulls) ``v``, numbered from 0 without gaps in their series ``s``, at most :data:`VALUES` in all. Series of equal length share their draws.
    """
    table = terms.select("s", "k", "v").toArrow()
    s, k = (table[c].to_numpy() for c in "sk")
    order = np.lexsort((k, s))
    there = table["v"].is_valid().to_numpy()[order]
    values = table["v"].fill_null(0).to_numpy()[order]
    names, starts, sizes = np.unique(s[order], return_index=True, return_counts=True)
    spark = terms.sparkSession
    held = spark.sparkContext.broadcast({
        int(n): [(int(names[i]), values[starts[i] : starts[i] + n], None if there[starts[i] : starts[i] + n].all() else there[starts[i] : starts[i] + n]) for i in np.flatnonzero(sizes == n)] for n in np.unique(sizes)
    })

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for b in batch.column(0).to_pylist():
                for n, series in held.value.items():
                    totals, present = [0] * len(series), [0] * len(series)
                    for at in draws_of(seed, b, n):
                        for i, (_, v, known) in enumerate(series):
                            totals[i] += int(v[at].sum())
                            present[i] += len(at) if known is None else int(known[at].sum())
                    out += [(name, b, *x) for (name, _, _), *x in zip(series, totals, present)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 4, names=["s", "b", "total", "present"])

    tasks = max(1, min(draws, max(spark.sparkContext.defaultParallelism, draws * int(np.unique(sizes).sum()) // TASK_DRAWS)))
    return spark.range(0, draws, 1, tasks).mapInArrow(summed, "s long, b long, total long, present long")
