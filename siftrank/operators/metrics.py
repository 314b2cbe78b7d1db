"""Ranking metrics of predictions against true scores, for each target and on average.

Rules: rows without a true score or a prediction leave first, so counts are each target's own; lower scores are better and higher predictions are; hits are the rows up to the
exact quantile of the target's scores, ties included; ties of predictions go to the smaller item. Every metric is an aggregate over a target's ranked rows; :func:`per_target` takes all of them from one ranking. Targets of any size are ranked (:mod:`siftrank.operators.ordered`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftrank.functions import scalar as S
from siftrank.operators import ordered as O
from siftrank.operators.numbering import broadcast_small, dealt, numbered_within
from siftrank.sources.checkpoints import stored

KEYS = ["target_id"]


def evaluation_rows(pairs: DataFrame) -> DataFrame:
    """Rows with a usable score and prediction."""
    return pairs.where("score IS NOT NULL AND NOT isnan(score) AND p_hit IS NOT NULL AND NOT isnan(p_hit)")


def marked(rows: DataFrame, keys: list[str], sizes: DataFrame) -> DataFrame:
    """Stored evaluation rows with ``n, h1, h5`` (hits at 1 and 5 %) and ``p`` (clipped prediction)."""
    cuts = stored(O.quantiles(rows, keys, "score", [0.01, 0.05], sizes).hint("merge").join(sizes, keys))
    return rows.join(broadcast_small(cuts, 100_000), keys).select(
        *rows.columns, F.col("_rows").alias("n"), (F.col("score") <= F.col("t")[0]).cast("int").alias("h1"), (F.col("score") <= F.col("t")[1]).cast("int").alias("h5"), S.clip_probability(F.col("p_hit")).alias("p")
    )


def marked_in_keys(rows: DataFrame, keys: list[str], ranks: bool = False) -> DataFrame:
    """The same columns for keys that one task each ranks, with the average rank ``ry`` of scores if asked for, from one sort by score. The dealing by keys serves what is ranked next, too."""
    up = Window.partitionBy(*keys[::-1]).orderBy("score")  # the last key tells most rows apart
    whole = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = rows.withColumns({"n": F.count("*").over(whole), "_k": F.row_number().over(up) - 1})
    if ranks:
        out = out.withColumn("ry", (F.rank().over(up) + F.count("*").over(up.rangeBetween(Window.unboundedPreceding, 0))) / 2)

    def cut(share: float) -> Column:
        at = (F.col("n") - 1) * F.lit(share)
        below, above = F.floor(at), F.ceil(at)
        x, y = (F.max(F.when(F.col("_k") == k, F.col("score"))).over(whole) for k in (below, above))
        return F.when(x == y, x).otherwise((above - at) * x + (at - below) * y)

    out = out.withColumns({"_t1": cut(0.01), "_t5": cut(0.05)})
    hits = [(F.col("score") <= F.col(f"_t{q}")).cast("int").alias(f"h{q}") for q in (1, 5)]
    return out.select(*rows.columns, "n", *hits, S.clip_probability(F.col("p_hit")).alias("p"), *(["ry"] if ranks else []))


def ranked(pairs: DataFrame, keys: list[str] | None = None, share: float | None = None, ranks: bool = False) -> DataFrame:
    """Evaluation rows with ``n, h1, h5, p`` and ``rk``, the place in the predicted order. The pairs are read once.

    With a ``share`` also, at least for hits, ``enough`` (the ranking holds this share of its hits down to here) and ``precision`` (hits among all rows down to this prediction, equal ones included); with ``ranks`` the average
    ranks ``rx`` of predictions, best first, and ``ry`` of scores. A key of at most :data:`ordered.LARGE` rows is sorted once by prediction, in one task; larger ones go over ranges.
    """
    keys = keys or KEYS
    rows = stored(evaluation_rows(pairs))
    sizes = stored(rows.groupBy(*keys).agg(F.count("*").alias("_rows")))
    # the clipped prediction is no finer than the prediction: one sort, by both, serves equal values of either
    signs = {"_p": -F.col("p"), "_q": -F.col("p_hit")}
    order = ["_p", "_q", "ligand_id"]
    wanted = [*rows.columns, "n", "h1", "h5", "p", *(["ry"] if ranks else []), "rk", *(["enough", "precision"] if share else []), *(["rx"] if ranks else [])]

    def small(part: DataFrame) -> DataFrame:
        part = marked_in_keys(dealt(part, sizes.agg(F.sum("_rows")).first()[0] or 0, keys), keys, ranks).withColumns(signs)
        one = Window.partitionBy(*keys[::-1])
        place, equal, clipped = (one.orderBy(*order[:k]) for k in (3, 2, 1))
        part = part.withColumn("rk", F.row_number().over(place).cast("long"))
        if share:
            down, found = clipped.rangeBetween(Window.unboundedPreceding, 0), F.sum("h1").over(place.rowsBetween(Window.unboundedPreceding, 0))
            part = part.withColumn("enough", found >= F.ceil(F.lit(share) * F.sum("h1").over(one))).withColumn("precision", F.sum("h1").over(down) / F.count("*").over(down))
        if ranks:
            part = part.withColumn("rx", (F.rank().over(equal) + F.count("*").over(equal.rangeBetween(Window.unboundedPreceding, 0))) / 2)
        return part.select(*wanted)

    def large(part: DataFrame) -> DataFrame:
        many = sizes.where(F.col("_rows") > O.LARGE)
        part = marked(part, keys, many).withColumns(signs)
        part = O.with_average_ranks(part, keys, many, ry=F.col("score")) if ranks else part
        placed = stored(numbered_within(part, keys, order, "rk").withColumn("rk", F.col("rk") + 1))
        if share:
            hits = stored(numbered_within(placed.where("h1 = 1"), keys, ["rk"], "found").withColumn("found", F.col("found") + 1))
            needed = hits.groupBy(*keys).agg(F.ceil(F.lit(share) * F.count("*")).alias("needed"))
            lines = hits.groupBy(*keys, "p").agg(F.max("found").alias("upto")).hint("merge").join(placed.groupBy(*keys, "p").agg(F.max("rk").alias("rows")), [*keys, "p"])
            hits = hits.join(broadcast_small(stored(needed), 100_000), keys).hint("merge").join(stored(lines), [*keys, "p"])
            hits = hits.select(*placed.columns, (F.col("found") >= F.col("needed")).alias("enough"), (F.col("upto") / F.col("rows")).alias("precision"))
            placed = stored(hits.unionByName(placed.where("h1 = 0"), allowMissingColumns=True))
        return (O.common_ranks(placed, keys, "_q", "rk", "rx") if ranks else placed).select(*wanted)

    return O.by_size(rows, keys, small, large, sizes)


def recall_columns(budgets: tuple[float, ...] = (0.01, 0.05, 0.10, 0.20)) -> list[Column]:
    """Recall of the best 1 and 5 % inside the first part of the ranking, for each budget."""
    out = []
    for q in (1, 5):
        for b in budgets:
            inside = F.sum(F.when(F.col("rk") <= S.top_count(b, F.col("n")), F.col(f"h{q}")).otherwise(0))
            out.append(F.try_divide(inside, F.sum(f"h{q}")).alias(f"recall_{q}_at_{round(b * 100)}"))
    return out


def recalls(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or KEYS
    return ranked(pairs.select(*keys, "ligand_id", "score", "p_hit"), keys).groupBy(*keys).agg(F.count("*").alias("n_ligands"), F.sum("h1").alias("n_hits"), *recall_columns())


def budget_column() -> Column:
    return (F.min(F.when(F.col("enough"), F.col("rk"))) / F.max("n")).alias("recall95_budget")


def enrichment_column(fraction: float = 0.01) -> Column:
    k = S.top_count(fraction, F.col("n"))
    top = F.sum(F.when(F.col("rk") <= k, F.col("h1")).otherwise(0))
    return F.try_divide(top / F.max(k), F.sum("h1") / F.max("n")).alias("ef1")


def precision_column() -> Column:
    return F.try_divide(F.sum(F.col("h1") * F.col("precision")), F.sum("h1")).alias("auprc")


def loss_columns() -> list[Column]:
    y, p = F.col("h1"), F.col("p")
    many = lambda c: F.when(F.count("*") > 2, c)
    return [many(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p)))).alias("nll"), many(F.avg((p - y) * (p - y))).alias("brier"), many(F.avg(y)).alias("hit_rate_eval")]


def moment_columns(x: str, y: str, prefix: str = "") -> list[Column]:
    a, b = F.col(x), F.col(y)
    return [F.count("*").alias(f"{prefix}n"), *(F.sum(c).alias(f"{prefix}{n}") for c, n in ((a, "sx"), (b, "sy"), (a * a, "sxx"), (b * b, "syy"), (a * b, "sxy")))]


def from_moments(constant: float | None, prefix: str = "") -> Column:
    return S.pearson(*(F.col(prefix + c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")), constant)


def correlation(rows: DataFrame, keys: list[str], x: str, y: str, constant: float | None, name: str) -> DataFrame:
    """Pearson correlation inside each key from moments; see :func:`siftrank.functions.scalar.pearson` for sides that do not vary."""
    return rows.groupBy(*keys).agg(*moment_columns(x, y)).select(*keys, from_moments(constant).alias(name))


def budget_for_recall(pairs: DataFrame, share: float = 0.95) -> DataFrame:
    """The smallest part of the library, in the predicted order, that holds ``share`` of the hits."""
    return ranked(pairs, share=share).groupBy("target_id").agg(budget_column())


def enrichment(pairs: DataFrame, fraction: float = 0.01) -> DataFrame:
    """How much denser hits are in the first part of the ranking than overall."""
    return ranked(pairs).groupBy("target_id").agg(enrichment_column(fraction))


def average_precision(pairs: DataFrame) -> DataFrame:
    """Average precision with equal predictions as one threshold."""
    return ranked(pairs, share=0.95).groupBy("target_id").agg(precision_column())


def spearman(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rank correlation of predictions, best first, with scores; null for fewer than 3 rows or a side that does not vary."""
    keys = keys or KEYS
    rows = O.with_average_ranks(stored(evaluation_rows(pairs)), keys, rx=-F.col("p_hit"), ry=F.col("score"))
    return correlation(rows, keys, "rx", "ry", None, "spearman")


def probability_losses(pairs: DataFrame) -> DataFrame:
    """Negative log-likelihood and Brier score of clipped predictions against hits, and the hit rate."""
    rows = stored(evaluation_rows(pairs))
    sizes = stored(rows.groupBy("target_id").agg(F.count("*").alias("_rows")))
    return marked(rows, KEYS, sizes).groupBy("target_id").agg(*loss_columns(), F.count("*").alias("n_ligands")).where("n_ligands > 2")


def per_target(pairs: DataFrame) -> DataFrame:
    """All metrics of each target: the rows are ranked once, and one aggregate takes every metric from them."""
    rows = ranked(pairs, share=0.95, ranks=True)
    moments = moment_columns("rx", "ry", "_")
    out = rows.groupBy("target_id").agg(
        F.count("*").alias("n_ligands"), F.sum("h1").alias("n_hits"), *recall_columns(), budget_column(), enrichment_column(), precision_column(), *loss_columns(), *moments
    )
    return out.withColumn("spearman", from_moments(None, "_")).drop("_n", "_sx", "_sy", "_sxx", "_syy", "_sxy")


def macro(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Means over targets; a target without a metric does not count in its mean."""
    return metrics.agg(F.count("*").alias("targets"), *(F.avg(c).alias(c) for c in columns))


def _agreement(both: DataFrame, fraction: float) -> DataFrame:
    """``target_id, rho, k, common``: each target's rank correlation of ``a`` and ``b``, the rows that ``a`` selects, and those that both select. A target that one task ranks is dealt once, and sorted once by each."""
    sizes = stored(both.groupBy("target_id").agg(F.count("*").alias("_rows")))
    one = Window.partitionBy("target_id")

    def small(part: DataFrame) -> DataFrame:
        part = dealt(part, sizes.agg(F.sum("_rows")).first()[0] or 0, KEYS).withColumns({"_a": -F.col("a"), "_b": -F.col("b")})
        for c in "ab":
            place, equal = one.orderBy(f"_{c}", "ligand_id"), one.orderBy(f"_{c}")
            part = part.withColumn(f"p{c}", F.row_number().over(place)).withColumn(f"r{c}", (F.rank().over(equal) + F.count("*").over(equal.rangeBetween(Window.unboundedPreceding, 0))) / 2)
            # rows without a value have no place: nulls come before all others, NaN after them
            real = F.col(c).isNotNull() & ~F.isnan(c)
            part = part.withColumn(f"k{c}", real & (F.col(f"p{c}") - F.count_if(F.col(c).isNull()).over(one) <= S.top_ceil(fraction, F.count_if(real).over(one))))
        sums = part.groupBy("target_id").agg(F.count_if("ka").alias("k"), F.count_if(F.col("ka") & F.col("kb")).alias("common"), *moment_columns("ra", "rb"))
        return sums.select("target_id", from_moments(None).alias("rho"), "k", "common")

    def large(part: DataFrame) -> DataFrame:
        rho = correlation(O.with_average_ranks(part, KEYS, sizes.where(F.col("_rows") > O.LARGE), ra=-F.col("a"), rb=-F.col("b")), KEYS, "ra", "rb", None, "rho")
        keys = ["target_id", "ligand_id"]
        best = [O.first_places(part.select(*keys, c), KEYS, c, "ligand_id", S.top_ceil(fraction, F.col("n"))).select(*keys) for c in "ab"]
        count = lambda df, name: df.groupBy("target_id").agg(F.count("*").alias(name))
        out = rho.hint("merge").join(count(best[0], "k"), "target_id", "left").hint("merge").join(count(best[0].hint("merge").join(best[1], keys), "common"), "target_id", "left")
        return out.select("target_id", "rho", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("common", F.lit(0)).alias("common"))

    return O.by_size(both, KEYS, small, large, sizes)


def parity(reference: DataFrame, other: DataFrame, tolerance: float | None = 1e-3, least: float = 0.9999, fraction: float = 0.10) -> DataFrame:
    """Do two scorings of the same pairs agree: ``max_abs_diff, all_finite, min_spearman, mean_spearman, pooled_spearman, min_overlap, verdict``.

    Rank correlations are each target's, and one over all pairs; the overlap is that of the selected parts. The verdict is ``same`` if all values are finite, no target's correlation is below ``least`` and, unless it is None (half
    precision), no difference is above ``tolerance``.
    """
    keys = ["target_id", "ligand_id"]
    both = stored(reference.select(*keys, F.col("p_hit").alias("a")).hint("merge").join(other.select(*keys, F.col("p_hit").alias("b")), keys))
    fine = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    gap = both.agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("max_abs_diff"), F.bool_and(fine("a") & fine("b")).alias("all_finite"))
    each = stored(_agreement(both, fraction))
    rho = each.select("target_id", "rho")
    few = (both.agg(F.approx_count_distinct(F.xxhash64("a", "b"))).first()[0] or 0) <= O.LARGE / 2
    one_key = both.withColumn("_all", F.lit(0))
    pooled = (O.tied_rank_moments if few else O.rank_moments)(one_key, ["_all"], -F.col("a"), -F.col("b")).select(from_moments(None).alias("pooled_spearman"))
    overlap = each.where("k > 0").select("target_id", (F.col("common") / F.col("k")).alias("overlap"))
    summary = rho.hint("merge").join(overlap, "target_id").agg(F.min("rho").alias("min_spearman"), F.avg("rho").alias("mean_spearman"), F.min("overlap").alias("min_overlap"))
    agrees = F.col("all_finite") & (F.col("min_spearman") >= least) & (F.lit(True) if tolerance is None else F.col("max_abs_diff") <= tolerance)
    one = gap.crossJoin(F.broadcast(summary)).crossJoin(F.broadcast(pooled))
    return one.select("max_abs_diff", "all_finite", "min_spearman", "mean_spearman", "pooled_spearman", "min_overlap", F.when(agrees, "same").otherwise("different").alias("verdict"))
