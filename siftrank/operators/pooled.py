"""Correlations over all pairs of each run together, for runs over one truth that lie beside each other in a wide table.

A pair is dealt twice, in arrays: by ranges of its deviation from the truth, which all runs with a prediction for it share, and for each run by ranges of its own deviation, with the first place in hand. Equal values meet before the second
dealing, so that a frequent one is a few entries there. Ranges come from a share of the items; they choose only which task ranks a value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftrank.operators import metrics as M
from siftrank.operators.numbering import broadcast_small
from siftrank.sources.checkpoints import stored

#: Rows of a range, on average, ranges of a fold at most, and of how many items one helps to choose them.
RANGE_ROWS, RANGES, ITEMS = 500_000, 256, 64
DIGITS = 9
SUMS = ("psx", "psy", "psxx", "psyy", "psxy")


def _packed(values: np.ndarray, scale: float) -> bytes:
    """Values that are whole numbers of 32 bits at a scale, as such; others as they are."""
    whole = np.rint(values * scale)
    fits = len(whole) == 0 or (np.abs(whole).max() < 2**31 and np.array_equal(whole / scale, values))
    return (whole.astype(np.int32) if fits else values).tobytes()


def _unpacked(parts: list[bytes], sizes: np.ndarray, scale: float) -> np.ndarray:
    """Whole numbers if all parts are, else values."""
    whole = [len(p) == 4 * n for p, n in zip(parts, sizes, strict=True)]
    if all(whole):
        return np.concatenate([np.frombuffer(p, np.int32) for p in parts])
    return np.concatenate([np.frombuffer(p, np.int32) / scale if w else np.frombuffer(p, np.float64) for p, w in zip(parts, whole, strict=True)])


def _values(x: np.ndarray, scale: float) -> np.ndarray:
    return x / scale if x.dtype == np.int32 else x


def _deviations(table: pa.Table, names: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]]:
    """Folds, deviations of the negated truth and those of each run, by the rules of :func:`siftrank.operators.runstats.deviations`, for all runs that have predictions for the same pairs at a time. The table has all rows of its items."""
    table = table.filter(pc.is_valid(table["score"]))
    if not table.num_rows:
        return
    score, fold = table["score"].to_numpy(), table["fold"].to_numpy()
    item = pc.dictionary_encode(table["ligand_id"].combine_chunks(), null_encoding="encode").indices.to_numpy()
    alike: dict[bytes, list[int]] = {}
    for r, c in enumerate(names):
        alike.setdefault(pc.is_valid(table[c]).to_numpy().tobytes(), []).append(r)
    for has, own in alike.items():
        at = np.flatnonzero(np.frombuffer(has, bool))
        at = at[np.lexsort((item[at], fold[at]))]
        m = np.diff(np.flatnonzero(np.r_[True, (item[at][1:] != item[at][:-1]) | (fold[at][1:] != fold[at][:-1]), True])) if len(at) else np.zeros(0, int)
        at, m = at[np.repeat(m >= 2, m)], m[m >= 2]
        if len(at):
            first = np.r_[0, np.cumsum(m)[:-1]]
            less = lambda v: v - np.repeat(np.add.reduceat(v, first) / m, m)  # noqa: B023, E731
            yield fold[at], np.round(-less(score[at]), DIGITS), {r: np.round(less(table[names[r]].to_numpy()[at]), DIGITS) for r in own}


def _held(batches: Iterator[pa.RecordBatch]) -> list[pa.Table]:
    held = [b for b in batches if b.num_rows]
    return [pa.Table.from_batches(held)] if held else []


def _marks(rows: DataFrame, names: list[str]) -> dict[tuple[int, int], np.ndarray]:
    """Where the ranges of each fold begin, for the truth (-1) and each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _held(batches):
            for fold, y, xs in _deviations(table, names):
                for r, v in ((-1, y), *xs.items()):
                    yield pa.RecordBatch.from_arrays([pa.array(fold, pa.int32()), pa.array(np.full(len(v), r, np.int32)), pa.array(v)], names=["fold", "run", "v"])

    some = rows.where(F.pmod(F.xxhash64("ligand_id"), F.lit(ITEMS)) == 0).mapInArrow(run, "fold int, run int, v double")
    shares = F.array(*(F.lit(i / RANGES) for i in range(1, RANGES)))
    found = {}
    for r in some.groupBy("fold", "run").agg(F.count("*").alias("n"), F.percentile_approx("v", shares, 10_000).alias("q")).collect():
        many = min(RANGES, -(-r.n * ITEMS // RANGE_ROWS))
        found[r.fold, r.run] = np.unique([r.q[i * RANGES // many - 1] for i in range(1, many)])
    return found


def _blocks(rows: DataFrame, names: list[str], marks: dict[tuple[int, int], np.ndarray]) -> DataFrame:
    """``fold, y_part, n, y, x0, x1, ...``: the deviations of a task's pairs in a range of the truth's, as arrays; null for runs that have none of them."""
    fields = [("fold", pa.int32()), ("y_part", pa.int32()), ("n", pa.int32()), ("y", pa.binary()), *((f"x{r}", pa.binary()) for r in range(len(names)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _held(batches):
            for fold, y, xs in _deviations(table, names):
                part = np.zeros(len(y), np.int64)
                for f in np.unique(fold):
                    part[fold == f] = np.searchsorted(marks.get((int(f), -1), np.zeros(0)), y[fold == f], "right")
                order = np.lexsort((part, fold))
                fold, part, y, xs = fold[order], part[order], y[order], {r: x[order] for r, x in xs.items()}
                ends = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (fold[1:] != fold[:-1]), True])
                spans = list(zip(ends[:-1], ends[1:], strict=True))
                x = [[_packed(xs[r][i:j], 10**DIGITS) for i, j in spans] if r in xs else [None] * len(spans) for r in range(len(names))]
                columns = [fold[ends[:-1]], part[ends[:-1]], np.diff(ends), [y[i:j].tobytes() for i, j in spans], *x]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    return rows.mapInArrow(run, "fold int, y_part int, n int, y binary, " + ", ".join(f"x{r} binary" for r in range(len(names))))


def _twice_places(counts: np.ndarray) -> np.ndarray:
    """Twice the common place of each of the ascending values that so many rows have, from the middle of all rows."""
    return 2 * (np.cumsum(counts) - counts) + counts - counts.sum()


def _by_run(blocks: DataFrame, names: list[str], marks: dict[tuple[int, int], np.ndarray]) -> DataFrame:
    """``fold, run, x_part, y_part, n, d, x, c, s, syy`` and sums of products: a range of a run's deviations inside one of the truth's: its ``d`` different values, how many rows have each (empty if one each), and the sums of these rows' places."""
    kinds = {"fold": pa.int32(), "run": pa.int32(), "x_part": pa.int32(), "y_part": pa.int32(), "n": pa.int64(), "d": pa.int32(), "x": pa.binary(), "c": pa.binary(), "s": pa.binary(), "syy": pa.float64(), **dict.fromkeys(SUMS, pa.float64())}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        fold, y_part = (k.as_py() for k in key)
        sizes, ys, out = table["n"].to_numpy(), table["y"].to_pylist(), {c: [] for c in kinds}
        alike: dict[tuple, list[int]] = {}
        for r in range(len(names)):
            alike.setdefault(tuple(np.flatnonzero(pc.is_valid(table[f"x{r}"]).to_numpy())), []).append(r)
        for at, own in alike.items():
            if not at:
                continue
            y = np.concatenate([np.frombuffer(ys[i], np.float64) for i in at])
            _, same, counts = np.unique(y, return_inverse=True, return_counts=True)
            place = _twice_places(counts)[same].astype(np.float64)
            for r in own:
                packed = table[f"x{r}"].to_pylist()
                x = _unpacked([packed[i] for i in at], sizes[list(at)], 10**DIGITS)
                different, same, counts = np.unique(x, return_inverse=True, return_counts=True)
                s, squares = np.bincount(same, place), np.bincount(same, place * place)
                part = np.searchsorted(marks.get((fold, r), np.zeros(0)), _values(different, 10**DIGITS), "right")
                ends = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
                v = _values(x, 10**DIGITS)
                plain = dict(zip(SUMS, (v.sum(), y.sum(), v @ v, y @ y, v @ y), strict=True))
                for i, j in zip(ends[:-1], ends[1:], strict=True):
                    one = counts[i:j]
                    values = {
                        "fold": fold, "run": r, "x_part": part[i], "y_part": y_part, "n": one.sum(), "d": j - i, "x": different[i:j].tobytes(), "c": b"" if (one == 1).all() else one.astype(np.int32).tobytes(),
                        "s": _packed(s[i:j], 1), "syy": squares[i:j].sum(), **plain,
                    }
                    for c, value in values.items():
                        out[c].append(value)
                    plain = dict.fromkeys(SUMS, 0.0)  # once for all ranges
        return pa.table({c: pa.array(out[c], kind) for c, kind in kinds.items()})

    schema = "fold int, run int, x_part int, y_part int, n long, d int, x binary, c binary, s binary, syy double, " + ", ".join(f"{c} double" for c in SUMS)
    return blocks.groupBy("fold", "y_part").applyInArrow(run, schema)


def _cells(parts: DataFrame) -> DataFrame:
    """``fold, run, x_part, y_part, n`` and sums of twice the places, from the middles of both ranges, and of their products."""
    names = ["fold", "run", "x_part", "y_part", "n", "sx", "sy", "sxx", "syy", "sxy", *SUMS]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        d = table["d"].to_numpy()
        x = _unpacked(table["x"].to_pylist(), d, 10**DIGITS)
        c = np.concatenate([np.frombuffer(b, np.int32) if b else np.ones(n, np.int32) for b, n in zip(table["c"].to_pylist(), d, strict=True)])
        s = _unpacked(table["s"].to_pylist(), d, 1).astype(np.float64)
        _, same = np.unique(x, return_inverse=True)
        place, block = _twice_places(np.bincount(same, c))[same], np.repeat(np.arange(len(d)), d)
        total = lambda v: pa.array(np.bincount(block, v, len(d)))
        own = {"sx": total(c * place), "sy": total(s), "sxx": total(c * place * place), "syy": table["syy"], "sxy": total(place * s)}
        return pa.table({n: own.get(n, table[n] if n in table.column_names else None) for n in names})

    schema = "fold int, run int, x_part int, y_part int, n long, " + ", ".join(f"{c} double" for c in names[5:])
    return parts.groupBy("fold", "run", "x_part").applyInArrow(run, schema)


def selectivity_of_runs(rows: DataFrame, runs: dict[tuple[str, int], str]) -> DataFrame:
    """``fold, cond, seed, sel_pearson, sel_spearman`` over all pairs of each run together, as :func:`siftrank.operators.runstats.pooled_selectivity` has it.

    ``rows`` has ``fold int, ligand_id, score`` and a column of predictions for each run, null where a run lacks the pair, and all rows of an item in one task.
    """
    names = list(runs.values())
    number = lambda c: F.col(c).cast("double").alias(c)
    rows = rows.select("fold", "ligand_id", *map(number, ("score", *names)))
    marks = _marks(rows, names)
    cells = stored(_cells(_by_run(_blocks(rows, names, marks), names, marks)))
    keys = ["fold", "run"]
    for side in "xy":
        # where the middle of a range lies from the middle of all rows; a row for each range
        sizes, all_rows = cells.groupBy(*keys, f"{side}_part").agg(F.sum("n").alias("_n")), Window.partitionBy(*keys)
        upto = F.sum("_n").over(all_rows.orderBy(f"{side}_part"))
        middle = sizes.select(*keys, f"{side}_part", (upto - F.col("_n") / 2 - F.sum("_n").over(all_rows) / 2).alias(f"d{side}"))
        cells = cells.join(broadcast_small(stored(middle), 100_000), [*keys, f"{side}_part"])
    n, sx, sy, dx, dy = F.col("n"), F.col("sx") / 2, F.col("sy") / 2, F.col("dx"), F.col("dy")
    moments = {
        "s_n": n, "s_sx": sx + n * dx, "s_sy": sy + n * dy, "s_sxx": F.col("sxx") / 4 + 2 * dx * sx + n * dx * dx, "s_syy": F.col("syy") / 4 + 2 * dy * sy + n * dy * dy,
        "s_sxy": F.col("sxy") / 4 + dy * sx + dx * sy + n * dx * dy, "p_n": n, **{f"p_{c[1:]}": F.col(c) for c in SUMS},
    }
    sums = cells.groupBy(*keys).agg(*(F.sum(c).alias(name) for name, c in moments.items()))
    one = F.element_at(F.array(*(F.struct(F.lit(c).alias("cond"), F.lit(s).alias("seed")) for c, s in runs)), F.col("run") + 1)
    return sums.select("fold", one["cond"].alias("cond"), one["seed"].alias("seed"), M.from_moments(0.0, "p_").alias("sel_pearson"), M.from_moments(0.0, "s_").alias("sel_spearman"))
