"""Statistics over runs: seed means, shared rankings, selectivity, reversals, bootstrap intervals and paired contrasts.

A run table is long: ``fold, cond, seed, target_id, ligand_id, score, logit``. Resamples are drawn by portable hashes, so every statistic with the same seed uses the same resamples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftrank.functions import scalar as S
from siftrank.operators import metrics as M
from siftrank.operators import ordered as O
from siftrank.operators import resampling
from siftrank.operators.numbering import broadcast_small, numbered_within
from siftrank.sources.checkpoints import stored

RUN = ["fold", "cond", "seed"]
TAG = r"^f(\d+)_(.+)_(R\d)_s(\d+)$"


def parse_tags(tags: DataFrame) -> DataFrame:
    """``tag, fold, cond, recipe, seed`` of well-formed tags; fields that a record has win over those of its tag."""
    part = lambda i: F.regexp_extract("tag", TAG, i)
    own = lambda c, x: F.coalesce(F.col(c), x) if c in tags.columns else x
    return tags.where(F.col("tag").rlike(TAG)).select(
        "tag", own("fold", part(1).cast("int")).alias("fold"), own("cond", part(2)).alias("cond"), own("recipe", part(3)).alias("recipe"), own("seed", part(4).cast("int")).alias("seed")
    )


def discover(registries: DataFrame, metric_tags: DataFrame, curve_tags: DataFrame, include_smoke: bool = False) -> DataFrame:
    """Runs whose registry and both companion files exist; smoke runs only on request."""
    runs = parse_tags(registries if include_smoke else registries.where(~F.coalesce(F.col("smoke"), F.lit(False))))
    return runs.hint("merge").join(metric_tags.select("tag"), "tag", "left_semi").hint("merge").join(curve_tags.select("tag"), "tag", "left_semi")


def complete_conditions(runs: DataFrame, folds: int = 5) -> DataFrame:
    """``cond, recipe, n_folds, complete`` of each condition; only complete ones are compared."""
    return runs.groupBy("cond", "recipe").agg(F.count_distinct("fold").alias("n_folds")).withColumn("complete", F.col("n_folds") == folds)


def shared_ranking(truth: DataFrame, roles: DataFrame) -> DataFrame:
    """For each fold, each item's mean score over the fold's training targets, as a prediction for its held-out targets.

    ``truth`` has ``target_id, ligand_id, score``; ``roles`` has ``fold, target_id, role``. Items without any training score rank last.
    """
    truth, roles = stored(truth.select("target_id", "ligand_id", "score")), stored(roles)
    # an item's sums over all targets that train the same folds come first, so a pair makes no row for each fold
    trained = stored(roles.where("role <> 'heldout'").groupBy("target_id").agg(F.sort_array(F.collect_list("fold")).alias("folds")))
    sums = truth.join(broadcast_small(trained, 100_000), "target_id").groupBy("ligand_id", "folds").agg(F.sum(F.col("score").cast("decimal(28,10)")).alias("s"), F.count("score").alias("n"))
    train = sums.select("ligand_id", F.explode("folds").alias("fold"), "s", "n").groupBy("fold", "ligand_id").agg(F.try_divide(F.sum("s").cast("double"), F.sum("n")).alias("mean"))
    train = stored(train)
    held = truth.join(broadcast_small(roles.where("role = 'heldout'").select("fold", "target_id"), 100_000), "target_id")
    last = train.groupBy("fold").agg((F.max("mean") + 1).alias("last"))
    rows = held.hint("merge").join(train, ["fold", "ligand_id"], "left").join(broadcast_small(last), "fold", "left")
    return rows.select("fold", "target_id", "ligand_id", "score", F.col("mean").isNull().cast("int").alias("unseen"), (-F.coalesce("mean", "last")).alias("p_hit"))


def shared_report(truth: DataFrame, roles: DataFrame, digits: int = 6) -> DataFrame:
    """``fold, target_id, n_ligands, n_hits, recall_1_at_10, spearman, unranked``: how well the shared ranking does on each held-out target, and how many of all items the fold's training targets say nothing of.

    Predictions are rounded, so that means summed in another order cannot split ties.
    """
    truth, roles = stored(truth.select("target_id", "ligand_id", "score")), stored(roles)
    rows = shared_ranking(truth, roles).withColumn("p_hit", F.round("p_hit", digits))
    keys = ["fold", "target_id"]
    ranked = M.ranked(rows, keys, ranks=True).groupBy(*keys).agg(F.count("*").alias("n_ligands"), F.sum("h1").alias("n_hits"), *M.recall_columns((0.1,)), *M.moment_columns("rx", "ry", "_"))
    out = ranked.select(*keys, "n_ligands", "n_hits", "recall_1_at_10", M.from_moments(None, "_").alias("spearman"))
    train = broadcast_small(roles.where("role <> 'heldout'").select("fold", "target_id"), 100_000)
    seen = truth.where("score IS NOT NULL").join(train, "target_id").select("fold", "ligand_id").distinct().groupBy("fold").agg(F.count("*").alias("seen"))
    items = truth.select("ligand_id").distinct().agg(F.count("*").alias("items"))
    missing = roles.select("fold").distinct().join(seen, "fold", "left").crossJoin(F.broadcast(items)).select("fold", (F.col("items") - F.coalesce("seen", F.lit(0))).alias("unranked"))
    return out.join(broadcast_small(stored(missing)), "fold")


def shared_recalls(truth: DataFrame, roles: DataFrame, digits: int = 6) -> DataFrame:
    """``fold, target_id, recall_1_at_10`` of the shared ranking on held-out targets, as :func:`shared_report` has it. ``truth`` is read more than once and should be stored.

    The truth is dealt by item, for an item's means and the pairs that these rank in the same task, and then by target; nothing else of its size is. Only the order counts here, so items without a mean need no number that is less than all others.
    """
    truth, roles, keys = truth.select("target_id", "ligand_id", "score"), stored(roles), ["fold", "target_id"]
    sizes = truth.groupBy("target_id").agg(F.count("*").alias("_rows"))
    large = stored(sizes.where(F.col("_rows") > O.LARGE).join(roles.where("role = 'heldout'").select(*keys), "target_id").select(*keys))
    tasks = truth.count() // ARRAY_ROWS + 1
    items = truth.where("score IS NOT NULL").repartition(tasks, "ligand_id")
    trained = stored(roles.where("role <> 'heldout'").groupBy("target_id").agg(F.sort_array(F.collect_list("fold")).alias("folds")))
    sums = items.join(broadcast_small(trained, 1_000_000), "target_id").groupBy("ligand_id", "folds").agg(F.sum(F.col("score").cast("decimal(28,10)")).alias("s"), F.count("score").alias("n"))
    means = sums.select("ligand_id", F.explode("folds").alias("fold"), "s", "n").groupBy("ligand_id", "fold").agg(F.try_divide(F.sum("s").cast("double"), F.sum("n")).alias("mean"))
    # an entry for each fold
    means = means.where("mean IS NOT NULL").groupBy("ligand_id").agg(F.map_from_entries(F.collect_list(F.struct("fold", F.round(-F.col("mean"), digits)))).alias("means"))
    held = items.join(broadcast_small(roles.where("role = 'heldout'").select(*keys), 1_000_000), "target_id")
    rows = held.hint("merge").join(means, "ligand_id", "left").select(*keys, "ligand_id", "score", F.coalesce(F.try_element_at("means", "fold"), F.lit(float("-inf"))).alias("p_hit"))
    return recalls_of_runs(rows.repartition(tasks, *keys), keys, {("shared", 0): "p_hit"}, None if large.isEmpty() else large).select(*keys, "recall_1_at_10")


def deviations(runs: DataFrame, digits: int = 9) -> DataFrame:
    """Each pair's prediction and negated truth minus their item's means over the targets of the run; items with one target leave.

    Rounded, so that sums in another order cannot split ties of the ranks built on them. Runs that are dealt by item already are not dealt again.
    """
    item = Window.partitionBy("ligand_id", *RUN)
    both = runs.where("score IS NOT NULL AND logit IS NOT NULL").withColumn("m", F.count("*").over(item))
    return both.where("m >= 2").select(
        *RUN, "target_id", "ligand_id",
        F.round(F.col("logit") - F.avg("logit").over(item), digits).alias("dp"), F.round(-F.col("score") + F.avg("score").over(item), digits).alias("dt"),
    )


def _correlations(d: DataFrame, keys: list[str]) -> DataFrame:
    d = stored(d.select(*keys, "dp", "dt"))
    own = stored(d.groupBy(*keys).agg(*M.moment_columns("dp", "dt", "p_")))
    few = stored(own.where(F.col("p_n") > O.LARGE).select(*keys))
    if few.isEmpty():
        ranked = _rank_sums(d, keys, own)
    else:
        big = broadcast_small(few, 1_000_000)
        ranked = _rank_sums(d.join(big, keys, "left_anti"), keys, own).unionByName(O.rank_moments(d.join(big, keys, "left_semi"), keys, F.col("dp"), F.col("dt"), "s_"))
    sums = own.hint("merge").join(ranked, keys)
    return sums.select(*keys, M.from_moments(0.0, "p_").alias("sel_pearson"), M.from_moments(0.0, "s_").alias("sel_spearman"))


def _rank_sums(d: DataFrame, keys: list[str], own: DataFrame) -> DataFrame:
    """Of keys that one task each ranks."""
    sizes = own.where(F.col("p_n") <= O.LARGE).select(*keys, F.col("p_n").alias("_rows"))
    return O.with_average_ranks(d, keys, sizes, rx=F.col("dp"), ry=F.col("dt")).groupBy(*keys).agg(*M.moment_columns("rx", "ry", "s_"))


def selectivity(runs: DataFrame) -> DataFrame:
    """Correlations, for each target of each run, of what a prediction says beyond its item's mean; 0 where a side does not vary."""
    return _correlations(deviations(runs), [*RUN, "target_id"])


def pooled_selectivity(runs: DataFrame) -> DataFrame:
    """The same over all pairs of each run together, whatever their targets are."""
    return _correlations(deviations(runs), RUN)


def common_items(cells: DataFrame, scores: bool = True) -> DataFrame:
    """``fold, a, b, ligand_id`` and, if asked for, the scores ``sa, sb``: the items that targets ``a < b`` of a fold both score.

    An item makes a row for each two of its fold's targets that score it, so its rows are bounded by the targets of a fold.
    """
    side = lambda t, s: cells.select("fold", "ligand_id", F.col("target_id").alias(t), *([F.col("score").alias(s)] if scores else []))
    return side("a", "sa").hint("merge").join(side("b", "sb"), ["fold", "ligand_id"]).where("a < b")


def quadruplets(truth: DataFrame, per_fold: int, candidates: int, gap: float = 1.0, rounds: int = 200) -> DataFrame:
    """``fold, c, a, b, i, j, da, db``: pairs of targets and items whose true order differs between the targets by ``gap`` or more.

    All quadruplets of a fold that have four scores are numbered, by pairs of targets and their :func:`common_items`; only the items of pairs that are drawn are numbered and stored. A fold with ``candidates`` of them at most tries them all,
    so that what it returns is all there is; any other draws numbers by hashes, ``candidates`` in a round, until ``per_fold`` qualify or ``rounds`` are over; rounds are taken together, twice as many each time. The first ``per_fold`` are
    kept, by the number ``c`` of their draw. ``truth`` has ``fold, target_id, ligand_id, score``.
    """
    spark = truth.sparkSession
    cells = stored(truth.where("score IS NOT NULL AND NOT isnan(score)").select("fold", "target_id", "ligand_id", "score"))
    pair = ["fold", "a", "b"]
    pairs = common_items(cells, scores=False).groupBy(*pair).agg(F.count("*").alias("m")).where("m > 1").withColumn("own", (F.col("m") * (F.col("m") - 1) / 2).cast("long"))
    # a row for each two targets of a fold
    upto = F.sum("own").over(Window.partitionBy("fold").orderBy("a", "b"))
    pairs = stored(pairs.withColumn("upto", upto).withColumn("start", F.col("upto") - F.col("own")))
    folds = stored(pairs.groupBy("fold").agg(F.max("upto").alias("all"), F.greatest(F.lit(1), F.floor(F.max("upto") / F.count("*"))).alias("width")))
    # each pair in the buckets that its numbers lie in, twice as many as there are pairs at most
    spread = pairs.join(broadcast_small(folds), "fold").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / F.col("width")), F.floor((F.col("upto") - 1) / F.col("width")))))
    spread = spread.drop("all", "width")
    out, left, turn = None, folds, 0
    while turn < rounds:
        first, turn = turn, min(rounds, 2 * turn or 1)
        draws = spark.range(first * candidates, turn * candidates).withColumnRenamed("id", "c").crossJoin(broadcast_small(left))
        number = F.when(F.col("all") <= candidates, F.col("c")).otherwise(S.hash_number(F.concat_ws("#", F.col("fold").cast("string"), F.col("c").cast("string")), 1 << 32) * 1_000_003 % F.col("all"))
        drawn = draws.withColumn("u", number).where("u < all").withColumn("bucket", F.floor(F.col("u") / F.col("width")))
        drawn = spread.join(broadcast_small(drawn, 1_000_000), ["fold", "bucket"]).where("u >= start AND u < upto").withColumn("v", F.col("u") - F.col("start"))
        # unordered pairs of m items: each item with the one so many places further on
        drawn = stored(drawn.withColumn("ki", F.col("v") % F.col("m")).withColumn("kj", (F.col("ki") + F.floor(F.col("v") / F.col("m")) + 1) % F.col("m")).select(*pair, "m", "c", "ki", "kj"))
        wanted = stored(drawn.select(*pair, F.col("m").alias("_rows")).distinct())
        items = common_items(cells).join(broadcast_small(wanted.select(*pair), 1_000_000), pair, "left_semi")
        index = stored(O.with_places(items, pair, [F.col("ligand_id")], "k", wanted).withColumn("k", F.col("k") - 1))
        drawn = drawn.drop("m")
        for x in "ij":
            side = index.select(*pair, F.col("k").alias(f"k{x}"), F.col("ligand_id").alias(x), F.col("sa").alias(f"a{x}"), F.col("sb").alias(f"b{x}"))
            drawn = drawn.hint("merge").join(side, [*pair, f"k{x}"])
        da, db = F.col("ai") - F.col("aj"), F.col("bi") - F.col("bj")
        good = drawn.where((F.abs(da) >= gap) & (F.abs(db) >= gap) & (F.signum(da) == -F.signum(db))).select("fold", "c", "a", "b", "i", "j", da.alias("da"), db.alias("db"))
        out = good if out is None else out.unionByName(good)
        out = stored(out.withColumn("r", F.row_number().over(Window.partitionBy("fold").orderBy("c"))).where(F.col("r") <= per_fold).drop("r"))
        full = out.groupBy("fold").agg(F.count("*").alias("n")).where(F.col("n") >= per_fold)
        left = stored(folds.where(F.col("all") > candidates).join(broadcast_small(full), "fold", "left_anti"))
        if left.isEmpty():
            break
    return out


def touched_cells(quads: DataFrame) -> DataFrame:
    """``fold, target_id, ligand_id``: four cells for each quadruplet at most."""
    ends = F.explode(F.array(*(F.struct(F.col(t).alias("target_id"), F.col(x).alias("ligand_id")) for t in "ab" for x in "ij")))
    return quads.select("fold", ends.alias("w")).select("fold", "w.*").distinct()


def reversals(quads: DataFrame, runs: DataFrame) -> DataFrame:
    """``fold, cond, seed, a, b, right``: whether both predicted differences have the true directions; a zero difference is wrong."""
    # the runs are read once, and no other cell is dealt or sorted
    wanted = stored(touched_cells(quads))
    cells = runs.select(*RUN, "target_id", "ligand_id", "logit").join(broadcast_small(wanted, 1_000_000), ["fold", "target_id", "ligand_id"], "left_semi")
    cells = stored(cells)
    rows = quads.join(broadcast_small(stored(cells.select(*RUN).distinct())), "fold")
    for t in "ab":
        for x in "ij":
            rows = rows.hint("merge").join(cells.select(*RUN, F.col("target_id").alias(t), F.col("ligand_id").alias(x), F.col("logit").alias(f"p{t}{x}")), [*RUN, t, x])
    right = (F.signum(F.col("pai") - F.col("paj")) == -F.signum("da")) & (F.signum(F.col("pbi") - F.col("pbj")) == -F.signum("db"))
    return rows.select(*RUN, "a", "b", right.cast("int").alias("right"))


def touching_accuracy(rows: DataFrame) -> DataFrame:
    """``fold, cond, seed, target_id, quads, accuracy`` of the :func:`reversals` that touch each target."""
    rows = rows.select(*RUN, F.explode(F.array("a", "b")).alias("target_id"), "right")
    return rows.groupBy(*RUN, "target_id").agg(F.count("*").alias("quads"), F.avg("right").alias("accuracy"))


def reversal_accuracy(quads: DataFrame, runs: DataFrame) -> DataFrame:
    """``fold, cond, seed, target_id, quads, accuracy`` of the quadruplets that touch each target."""
    return touching_accuracy(reversals(quads, runs))


def pooled_accuracy(rows: DataFrame) -> DataFrame:
    """``fold, cond, seed, n_quads, reversal_acc`` over all :func:`reversals` of a fold, each counted once."""
    return rows.groupBy(*RUN).agg(F.count("*").alias("n_quads"), F.avg("right").alias("reversal_acc"))


def pooled_reversal_accuracy(quads: DataFrame, runs: DataFrame) -> DataFrame:
    """``fold, cond, seed, n_quads, reversal_acc`` over all quadruplets of a fold, each counted once."""
    return pooled_accuracy(reversals(quads, runs))


#: Rows of a task that ranks keys as arrays, on average.
ARRAY_ROWS = 200_000


def recalls_of_runs(rows: DataFrame, keys: list[str], runs: dict[tuple[str, int], str], large: DataFrame | None = None, ranks: bool = False) -> DataFrame:
    """``keys, cond, seed, recall_1_at_10`` of runs over one truth, by the rules of :func:`siftrank.operators.metrics.recalls`; a run leaves out the pairs that it has no prediction for. With ``ranks`` also ``spearman``, by those of
    :func:`siftrank.operators.metrics.spearman`.

    ``rows`` has ``ligand_id, score`` and a column of predictions for each run, and all rows of a key in one task: a pair is dealt once, whatever number of runs there are, and a task ranks its keys as arrays. The keys in ``large`` have
    more rows than a task should rank; theirs go over ranges.
    """
    columns, found = list(runs.values()), ["recall_1_at_10", *(["spearman"] if ranks else [])]
    if large is not None:
        over = broadcast_small(large.select(*keys), 1_000_000)
        one = F.explode(F.array(*(F.struct(F.lit(c).alias("cond"), F.lit(s).alias("seed"), F.col(x).cast("double").alias("p_hit")) for (c, s), x in runs.items())))
        long = rows.join(over, keys, "left_semi").select(*keys, "ligand_id", "score", one.alias("o")).select(*keys, "ligand_id", "score", "o.*")
        each = M.ranked(long, [*keys, "cond", "seed"], ranks=ranks).groupBy(*keys, "cond", "seed").agg(*M.recall_columns((0.1,)), *(M.moment_columns("rx", "ry", "_") if ranks else []))
        rest = (each.withColumn("spearman", M.from_moments(None, "_")) if ranks else each).select(*keys, "cond", "seed", *found)
        rows = rows.join(over, keys, "left_anti")
    rows = rows.where("score IS NOT NULL AND NOT isnan(score)").select(*keys, "ligand_id", F.col("score").cast("double").alias("score"), *(F.col(c).cast("double").alias(c) for c in columns))
    fields = [f for f in rows.schema if f.name in keys]

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held)
        code = np.zeros(table.num_rows, np.int64)
        for k in keys:
            words = pc.dictionary_encode(table[k].combine_chunks(), null_encoding="encode")
            code = code * len(words.dictionary) + words.indices.to_numpy()
            code = np.unique(code, return_inverse=True)[1]
        # rows by item inside keys, so that stable sorts leave ties to smaller items
        item = pc.rank(table["ligand_id"].combine_chunks(), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        order = np.lexsort((item, code))
        code, score = code[order].astype(np.min_scalar_type(code.max())), table["score"].to_numpy()[order]
        for (cond, seed), c in runs.items():
            p = table[c].to_numpy()[order]
            own = np.flatnonzero(~np.isnan(p))
            if len(own):
                first, recall = _recalls(code[own], score[own], p[own])
                at = pa.array(order[own[first]])
                names = [pa.array([cond] * len(at)), pa.array(np.full(len(at), seed, np.int32)), pa.array(recall)]
                if ranks:
                    names.append(_correlated_ranks(code[own], first, -p[own], score[own]))
                yield pa.RecordBatch.from_arrays([*(table[k].combine_chunks().take(at) for k in keys), *names], names=[*keys, "cond", "seed", *found])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    out = rows.mapInArrow(ranked, f"{schema}, cond string, seed int, " + ", ".join(f"{c} double" for c in found)).select(*keys, "cond", "seed", *found)
    return out if large is None else out.unionByName(rest)


def _recalls(code: np.ndarray, score: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each key, and the recall of its best 1 % inside the first 10 % of its rows by prediction; rows come by key and item."""
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    n = np.diff(np.r_[first, len(code)])

    def within(values: np.ndarray) -> np.ndarray:
        by = np.argsort(values, kind="stable")
        return by[np.argsort(code[by], kind="stable")]

    up = score[within(score)]
    at = (n - 1) * 0.01
    below, above = np.floor(at), np.ceil(at)
    x, y = up[first + below.astype(np.int64)], up[first + above.astype(np.int64)]
    with np.errstate(invalid="ignore"):
        cut = np.where(x == y, x, (above - at) * x + (at - below) * y)
    hit = score <= np.repeat(cut, n)
    place = np.arange(len(code)) - np.repeat(first, n)
    inside = place < np.repeat(np.maximum(1, np.rint(0.1 * n)), n)
    return first, np.add.reduceat((hit[within(-p)] & inside).astype(np.int64), first) / np.add.reduceat(hit.astype(np.int64), first)


def _correlated_ranks(code: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """The correlation of the average ranks of both inside each key, null for fewer than 3 rows or a side that does not vary; rows come by key."""
    n = np.diff(np.r_[first, len(code)])

    def ranks(values: np.ndarray) -> np.ndarray:
        by = np.argsort(values, kind="stable")
        by = by[np.argsort(code[by], kind="stable")]
        starts = np.flatnonzero(np.r_[True, (code[by][1:] != code[by][:-1]) | (values[by][1:] != values[by][:-1])])
        equal = np.diff(np.r_[starts, len(by)])
        out = np.empty(len(by))
        out[by] = np.repeat(starts + (equal - 1) / 2, equal) - np.repeat(first + (n - 1) / 2, n)  # from the key's middle
        return out

    x, y = ranks(a), ranks(b)
    xx, yy, xy = (np.add.reduceat(v, first) for v in (x * x, y * y, x * y))
    fine = (n >= 3) & (xx > 0) & (yy > 0)
    return pa.array(xy / np.sqrt(np.where(fine, xx * yy, 1)), mask=~fine)


def seed_means(values: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Means over whatever the keys leave out: seeds, folds."""
    return values.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in columns))


def exact_mean(column: str) -> Column:
    """A mean whose sum is exact at twelve digits, so that no order of rows changes it; nulls do not count."""
    return F.try_divide(F.sum(F.col(column).cast("decimal(28,12)")).cast("double"), F.count(column))


def exact_terms(rows: DataFrame, *columns: str) -> tuple[DataFrame, Callable[[str], Column]]:
    """The rows with the columns at twelve digits, and the mean of such a column, equal to :func:`exact_mean` of the old one."""
    return _terms(rows, *columns)[:2]


def _terms(rows: DataFrame, *columns: str) -> tuple[DataFrame, Callable[[str], Column], bool]:
    """The same, and whether the columns are whole numbers.

    They are where no sum of as many rows can overflow one, which costs a fraction of the decimals that serve otherwise.
    """
    n, *tops = rows.agg(F.count("*"), *(F.max(F.abs(F.col(c))) for c in columns)).first()
    whole = all(t is None or t * 1e12 * n < 4e18 for t in tops)
    term = lambda c: F.col(c).cast("decimal(28,12)")
    if not whole:
        return rows.withColumns({c: term(c) for c in columns}), exact_mean, False
    return rows.withColumns({c: (term(c) * F.lit(Decimal(10**12))).cast("long") for c in columns}), lambda c: whole_mean(F.sum(c), F.count(c)), True


def whole_mean(total: Column, n: Column) -> Column:
    """The mean of values at twelve digits from their sum as whole numbers."""
    return F.try_divide((total.cast("decimal(20,0)") * F.lit(Decimal("0.000000000001"))).cast("double"), n)


def resamples(n: int, draws: int, seed: int, spark) -> DataFrame:
    """``b, k``: which of ``n`` numbered targets each draw of each resample takes."""
    b = F.expr(f"id div {n}")
    key = F.concat_ws("#", F.lit(str(seed)), b.cast("string"), (F.col("id") % n).cast("string"))
    return spark.range(draws * n).select(b.alias("b"), S.hash_number(key, n).alias("k"))


def numbered(values: DataFrame, key: str) -> DataFrame:
    """Number the targets from 0 in key order, as a stored table."""
    return stored(numbered_within(values, [], [key], "k"))


def resampled_means(rows: DataFrame, n: int, columns: list[str], draws: int, seed: int) -> DataFrame:
    """``_draw`` and the mean of each column in each resample of ``n`` numbered rows. Tables that cannot travel to every task, and values beyond whole numbers, are joined, a row for each draw."""
    terms, mean, whole = _terms(rows.select("k", *columns), *columns)
    if not whole or n * len(columns) > resampling.VALUES:
        return resamples(n, draws, seed, rows.sparkSession).withColumnRenamed("b", "_draw").join(broadcast_small(terms, 1_000_000), "k").groupBy("_draw").agg(*(mean(c).alias(c) for c in columns))
    series = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("s"), F.col(c).alias("v")) for i, c in enumerate(columns))))
    sums = resampling.resampled(terms.select("k", series.alias("x")).select("x.s", "k", "x.v"), draws, seed)
    own = lambda c, i: F.max(F.when(F.col("s") == i, F.col(c)))
    return sums.groupBy(F.col("b").alias("_draw")).agg(*(whole_mean(own("total", i), own("present", i)).alias(c) for i, c in enumerate(columns)))


def bootstrap(values: DataFrame, column: str, draws: int = 5000, seed: int = 0) -> DataFrame:
    """``n, mean, low, high, p_positive``: percentile bootstrap of the mean over targets; nulls do not count."""
    rows = numbered(values.select("target_id", column), "target_id")
    n = rows.count()
    if not n:
        return values.sparkSession.createDataFrame([(0, None, None, None, None)], "n long, mean double, low double, high double, p_positive double")
    means = resampled_means(rows, n, [column], draws, seed).withColumnRenamed(column, "m")
    spread = means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.avg((F.col("m") > 0).cast("int")).alias("p_positive"))
    return rows.agg(F.count(column).alias("n"), exact_mean(column).alias("mean")).crossJoin(F.broadcast(spread))


def ratio_bootstrap(values: DataFrame, a: str, b: str, draws: int = 5000, seed: int = 1) -> DataFrame:
    """``ratio, low, high`` of two macro means, with the same resamples for both."""
    rows = numbered(values.select("target_id", F.col(a).alias("_a"), F.col(b).alias("_b")), "target_id")
    means = resampled_means(rows, rows.count(), ["_a", "_b"], draws, seed).select(F.try_divide("_a", "_b").alias("m"))
    spread = means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return rows.agg(F.try_divide(exact_mean("_a"), exact_mean("_b")).alias("ratio")).crossJoin(F.broadcast(spread))


def difference(x: DataFrame, y: DataFrame, column: str) -> DataFrame:
    """``x`` minus ``y`` for the targets of ``y``; where ``x`` has none the difference is null and leaves."""
    joined = y.select("target_id", F.col(column).alias("y")).hint("merge").join(x.select("target_id", F.col(column).alias("x")), "target_id", "left")
    return joined.select("target_id", (F.col("x") - F.col("y")).alias(column)).na.drop(subset=[column])


def paired_contrasts(values: DataFrame, column: str, pairs: DataFrame | None = None, draws: int = 5000, seed: int = 0) -> DataFrame:
    """``a, b, n, mean, low, high, p_positive``: bootstrap of the difference of each pair of conditions over the targets that both have.

    ``pairs`` has ``a, b``; without it every two conditions are compared, in their order. All pairs go through one pass, and pairs over the same targets share their resamples.
    """
    spark, values = values.sparkSession, stored(values.select("cond", "target_id", column))
    if pairs is None:
        conditions = values.select("cond").distinct()
        pairs = conditions.select(F.col("cond").alias("a")).join(F.broadcast(conditions.select(F.col("cond").alias("b"))), F.col("a") < F.col("b"))
    side = lambda c, x: values.select(F.col("cond").alias(c), "target_id", F.col(column).alias(x))
    both = broadcast_small(stored(pairs.select("a", "b"))).join(side("a", "x"), "a").hint("merge").join(side("b", "y"), ["b", "target_id"])
    rows = stored(both.select("a", "b", "target_id", (F.col("x") - F.col("y")).alias("d")).na.drop(subset=["d"]))
    sizes = stored(rows.groupBy("a", "b").agg(F.count("*").alias("_rows"), exact_mean("d").alias("mean")))
    numbered_rows = stored(O.with_places(rows, ["a", "b"], [F.col("target_id")], "k", sizes.drop("mean")).withColumn("k", F.col("k") - 1))
    terms, mean, whole = _terms(numbered_rows.hint("merge").join(sizes.select("a", "b", "_rows"), ["a", "b"]), "d")
    if whole and numbered_rows.count() <= resampling.VALUES:
        # a row for each pair of conditions that has targets
        series = stored(sizes.select("a", "b", (F.row_number().over(Window.orderBy("a", "b")) - 1).cast("long").alias("s")))
        sums = resampling.resampled(terms.join(broadcast_small(series), ["a", "b"]).select("s", "k", F.col("d").alias("v")), draws, seed).drop("b")
        means = sums.join(broadcast_small(series), "s").select("a", "b", whole_mean(F.col("total"), F.col("present")).alias("m"))
    else:
        # each draw and place of each number of targets: pairs of as many targets take the same rows, so a draw is hashed once for all of them
        places = stored(terms.groupBy("_rows", "k").agg(F.collect_list(F.struct("a", "b", "d")).alias("own")))
        takes = spark.range(draws).withColumnRenamed("id", "r").crossJoin(broadcast_small(sizes.select("_rows").distinct())).withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1)))
        takes = takes.withColumn("k", S.hash_number(F.concat_ws("#", F.lit(str(seed)), F.col("r").cast("string"), F.col("pos").cast("string")), F.col("_rows")))
        taken = takes.join(broadcast_small(places, 1_000_000), ["_rows", "k"]).select("r", F.explode("own").alias("x"))
        means = taken.groupBy("x.a", "x.b", "r").agg(mean("x.d").alias("m"))
    spread = means.groupBy("a", "b").agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.avg((F.col("m") > 0).cast("int")).alias("p_positive"))
    return sizes.select("a", "b", F.col("_rows").alias("n"), "mean").hint("merge").join(spread, ["a", "b"])


def truth_consistency(runs: DataFrame) -> DataFrame:
    """For each fold, do all its runs hold the same truth: equal within tolerance, or missing together."""
    pair = ["fold", "target_id", "ligand_id"]
    wide = runs.groupBy(*pair).agg(F.count("*").alias("n"), F.count("score").alias("present"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    same = (F.col("present") == 0) | ((F.col("present") == F.col("n")) & (F.col("hi") - F.col("lo") <= 1e-8 + 1e-5 * F.abs("hi")))
    return wide.groupBy("fold").agg(F.bool_and(same).alias("consistent"), F.count("*").alias("pairs"))


def fold_report(metric: DataFrame, oracle: DataFrame, pooled: DataFrame, pooled_reversal: DataFrame, reversal: DataFrame) -> DataFrame:
    """One row for each fold and condition.

    ``n_targets``, and means over its targets of ``recall_1_at_10``, ``spearman`` and the shared ranking's recall ``oracle_recall``, from ``metric`` (``fold, cond, target_id, recall_1_at_10, spearman``) and ``oracle``; means over seeds of the
    pooled ``sel_pearson``, ``sel_spearman`` and ``reversal_acc``, with ``n_quads``; and ``accuracy``, the mean of the targets' own reversal accuracies.
    """
    keys = ["fold", "cond"]
    own = metric.hint("merge").join(oracle.select("fold", "target_id", F.col("recall_1_at_10").alias("oracle_recall")), ["fold", "target_id"], "left")
    own = own.groupBy(*keys).agg(F.count("*").alias("n_targets"), *(F.avg(c).alias(c) for c in ("recall_1_at_10", "spearman", "oracle_recall")))
    mean = lambda df, *columns: df.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in columns))
    quads = pooled_reversal.groupBy(*keys).agg(F.avg("reversal_acc").alias("reversal_acc"), F.max("n_quads").alias("n_quads"))
    for part in (mean(pooled, "sel_pearson", "sel_spearman"), quads, mean(reversal, "accuracy")):
        own = own.hint("merge").join(part, keys, "left")
    return own


def as_map(values: DataFrame, key: str, column: str, by: list[str]) -> DataFrame:
    """A map of each target's value, for small summaries: one entry for each target of a group."""
    return values.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, column)))).alias("values"))


def low_headroom(values: DataFrame, oracle: DataFrame, column: str, below: float = 0.5) -> DataFrame:
    """Targets on which the shared ranking stays below a recall."""
    return values.hint("merge").join(oracle.where(F.col(column) < below).select("target_id"), "target_id", "left_semi")
