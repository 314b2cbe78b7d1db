"""Leakage-free splits on both axes: roles for target clusters and item groups, folds, samples, and the audits that prove them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftrank.functions import scalar as S
from siftrank.operators import ordered as O
from siftrank.operators.numbering import broadcast_small, numbered_within
from siftrank.sources.checkpoints import stored

#: The roles of item groups and their shares.
TARGET_SHARES = (("train", 0.60), ("dev", 0.10), ("probcal", 0.10), ("policycal", 0.10), ("test", 0.10))


def sample_key(id_: Column, salt: str) -> Column:
    return F.sha2(F.concat(id_.cast("string"), F.lit("|" + salt)), 256)


def salted_sample(df: DataFrame, key: str, salt: str, n: int) -> DataFrame:
    """The first ``n`` rows in the order of a salted hash; each partition keeps its own first ``n`` before one small sort."""
    return df.orderBy(sample_key(F.col(key), salt), key).limit(n)


def validation_picks(items: DataFrame, key: str, salt: str, n: int, fine: str) -> DataFrame:
    """The first ``n`` items, in the order of a salted hash, for which ``fine`` holds, and the failures met on the way: ``key, place, failed``; picks are numbered from 1, failures have place 0."""
    picks = salted_sample(items.where(fine), key, salt, n)
    # ``n`` rows are numbered
    picks = stored(picks.withColumn("at", sample_key(F.col(key), salt)).withColumn("place", F.row_number().over(Window.orderBy("at", key))))
    last = picks.agg(F.max(F.struct("at", F.col(key).alias("k"))).alias("last"), F.count("*").alias("found"))
    at = F.struct(sample_key(F.col(key), salt).alias("at"), F.col(key).alias("k"))
    # with too few picks every item has been tried
    failed = items.where(f"NOT coalesce({fine}, false)").crossJoin(F.broadcast(last)).where((F.col("found") < n) | (at < F.col("last")))
    return picks.select(key, "place", F.lit(False).alias("failed")).union(failed.select(key, F.lit(0), F.lit(True)))


def disjoint_samples(df: DataFrame, key: str, salts: tuple[str, str], n: int) -> DataFrame:
    """Two samples without a common row: ``..., sample``."""
    first = salted_sample(df, key, salts[0], n)
    second = salted_sample(df.join(first.select(key), key, "left_anti"), key, salts[1], n)
    return first.withColumn("sample", F.lit(1)).unionByName(second.withColumn("sample", F.lit(2)))


def diverse_pick(targets: DataFrame, n: int, family: str = "family", name: str = "target_id") -> DataFrame:
    """Round robin over families, the largest first, names in order inside each; family ties go by name."""
    size = targets.groupBy(family).agg(F.count("*").alias("_size"))
    turn = F.row_number().over(Window.partitionBy(family).orderBy(name))
    rows = targets.join(size, family).withColumn("turn", turn)
    return rows.orderBy("turn", F.desc("_size"), family).limit(n).drop("_size")


def target_roles(clusters: DataFrame, share: float = 0.15, least: int = 6) -> DataFrame:
    """``cluster, size, role``: clusters of over two targets train; of the rest, smallest first, clusters test until there are enough targets and clusters, then dev, then train.

    ``clusters`` has ``cluster, target_id``. A prefix sum decides each cluster, so there is no loop; places come from ranges, so no window holds all clusters.
    """
    sizes = stored(clusters.groupBy("cluster").agg(F.count("*").alias("size"), F.min("target_id").alias("first")))
    small = stored(numbered_within(sizes.where("size <= 2"), [], ["size", "first"], "c"))
    totals = sizes.agg(F.ceil(F.lit(share) * F.sum("size")).alias("need"), F.count_if(F.col("size") == 1).alias("ones"))
    # clusters of one target come first, then those of two, so a place tells how many targets stand before it
    t = F.when(F.col("c") < F.col("ones"), F.col("c")).otherwise(2 * F.col("c") - F.col("ones"))
    placed = small.crossJoin(F.broadcast(totals)).withColumn("t", t).withColumn("test", (F.col("t") < F.col("need")) | (F.col("c") < least))
    taken = stored(placed.where("test").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("taken")))
    dev = F.when(F.col("t") - F.col("taken") < F.col("need"), "dev").otherwise("train")
    role = F.when(F.col("test"), "test").otherwise(dev)
    return placed.crossJoin(F.broadcast(taken)).select("cluster", "size", role.alias("role")).union(sizes.where("size > 2").select("cluster", "size", F.lit("train")))


def _greedy(weights: list[int]):
    """For each size, largest first, how many groups each role takes: rows ``size, role, step, held, count``.

    A role that holds ``held`` takes its next groups of one size at loads ``(held + j * size) * step``, ``j`` from 1 on, where ``step`` is inverse to its share; the least loads win. The loads are whole
    numbers, so the last one that all taken groups stay at or below is found by bisection.
    """
    whole = math.lcm(*weights)
    steps = [whole // w for w in weights]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(frames)).sort_values("size", ascending=False)
        held, out = [0] * len(weights), []
        for size, groups in zip(table["size"].tolist(), table["groups"].tolist(), strict=True):
            taken = lambda t: [max(0, (t // q - h) // size) for q, h in zip(steps, held, strict=True)]  # noqa: B023, E731
            low, high = 0, (max(held) + (groups + 1) * size) * whole
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if sum(taken(mid)) <= groups else (low, mid - 1)
            count = taken(low)
            for r, q in enumerate(steps):
                if sum(count) < groups and (held[r] + (count[r] + 1) * size) * q == low + 1:
                    count[r] += 1
            out += [(size, r, q, h, n) for r, (q, h, n) in enumerate(zip(steps, held, count, strict=True))]
            held = [h + n * size for h, n in zip(held, count, strict=True)]
        yield pd.DataFrame(out, columns=["size", "r", "step", "held", "count"])

    return run


def item_roles(items: DataFrame, group: str, shares: tuple[tuple[str, float], ...] = TARGET_SHARES) -> DataFrame:
    """``group, size, role``: whole groups, the largest first and by key inside one size, each to the role that it fills least relative to its share; ties go to the earlier role.

    Only sizes drive the choice, so the sequential rule runs over the histogram of sizes in one task: distinct sizes of ``n`` items number ``sqrt(2 n)`` at most, and each is a few
    rows of counts. Which place among the groups of one size a role takes follows from those by whole-number arithmetic on each row. A null group is a group.
    """
    parts = [Fraction(x).limit_denominator(10_000) for _, x in shares]
    weights = [int(p * math.lcm(*(p.denominator for p in parts))) for p in parts]
    sizes = items.groupBy(group).agg(F.count("*").alias("size"))
    placed = numbered_within(sizes, ["size"], [group], "slot")
    histogram = placed.groupBy("size").agg(F.count("*").alias("groups"))
    runs = stored(histogram.repartition(1).mapInPandas(_greedy(weights), "size long, r int, step long, held long, count long"))
    every = runs.groupBy("size").agg(F.collect_list(F.struct("r", "step", "held", "count")).alias("every"))
    turns = runs.where("count > 0").hint("merge").join(every, "size")
    # a long run is dealt out in chunks before its turns become rows
    turns = turns.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(count - 1) div 10000")))).repartition("size", "r", "chunk")
    turns = turns.withColumn("j", F.explode(F.sequence(F.col("chunk") * 10_000 + 1, F.least("count", F.col("chunk") * 10_000 + 10_000))))
    turns = turns.withColumn("load", (F.col("held") + F.col("j") * F.col("size")) * F.col("step"))
    # the turns of another role that come before this one: up to the same load for earlier roles, below it for later ones
    before = "greatest(0L, least(x.count, ((load - if(x.r < r, 0, 1)) div x.step - x.held) div size))"
    ahead = F.expr(f"aggregate(every, 0L, (n, x) -> n + if(x.r = r, 0L, {before}))")
    turns = turns.select("size", (F.col("j") - 1 + ahead).alias("slot"), F.element_at(F.array(*(F.lit(n) for n, _ in shares)), F.col("r") + 1).alias("role"))
    return placed.hint("merge").join(turns, ["size", "slot"]).select(group, "size", "role")


def family_folds(targets: DataFrame, families: DataFrame, validation: int = 6, salt: str = "val") -> DataFrame:
    """``fold, target_id, role``: the fold's families are held out; of the others the first few by hash validate and the rest train.

    ``families`` has ``fold, family``.
    """
    folds = families.select("fold").distinct()
    rows = targets.select("target_id", "family").crossJoin(broadcast_small(folds)).join(broadcast_small(families.withColumn("held", F.lit(True))), ["fold", "family"], "left")
    key = F.sha2(F.concat_ws("|", F.col("fold").cast("string"), F.col("target_id").cast("string"), F.lit(salt)), 256)
    place = F.row_number().over(Window.partitionBy("fold", F.col("held").isNull()).orderBy(key, "target_id"))
    role = F.when(F.col("held"), "heldout").when(place <= validation, "validation").otherwise("train")
    return rows.withColumn("role", role).select("fold", "target_id", "role")


def fold_invariants(folds: DataFrame, targets: DataFrame) -> DataFrame:
    """Violations of the folds' rules, each a row: empty when all hold."""
    once = folds.where("role = 'heldout'").groupBy("target_id").agg(F.count("*").alias("n")).where("n <> 1").select(F.lit("held out more than once").alias("rule"), F.col("target_id").cast("string").alias("what"))
    never = targets.select("target_id").join(folds.where("role = 'heldout'"), "target_id", "left_anti").select(F.lit("never held out"), F.col("target_id").cast("string"))
    both = folds.groupBy("fold", "target_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("two roles in a fold"), F.concat_ws("/", "fold", "target_id"))
    return once.union(never).union(both)


def leaking_groups(rows: DataFrame, group: str, role: str = "role") -> DataFrame:
    """Groups that span two roles; empty when there is no leak."""
    return rows.groupBy(group).agg(F.min(role).alias("lo"), F.max(role).alias("hi")).where("lo <> hi").select(group)


def evaluation_sets(cells: DataFrame) -> DataFrame:
    """Cells of training targets (warm) and of dev targets (cold) with unseen items: ``..., setting``."""
    setting = F.when(F.col("target_role") == "train", "warm").when(F.col("target_role") == "dev", "cold")
    return cells.where("ligand_role <> 'train'").withColumn("setting", setting).where("setting IS NOT NULL")


def balanced_batches(pairs: DataFrame, updates: int, batch: int, salt: str = "plan") -> DataFrame:
    """``update, pos, target_id, ligand_id``: each update draws one target, then items of it with replacement. Only the rows of drawn targets are numbered."""
    spark, pairs = pairs.sparkSession, stored(pairs.select("target_id", "ligand_id"))
    targets = stored(numbered_within(pairs.groupBy("target_id").agg(F.count("*").alias("n")), [], ["target_id"], "t"))
    many = targets.count()
    if not many:
        return pairs.select(F.lit(0).cast("long").alias("update"), F.lit(0).alias("pos"), "target_id", "ligand_id")
    plan = spark.range(updates).select(F.col("id").alias("update"), S.hash_number(F.concat_ws("#", F.lit(salt), F.col("id").cast("string")), many).alias("t"))
    drawn = stored(plan.hint("merge").join(targets, "t").select("update", "target_id", "n"))
    rows = drawn.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(batch - 1))))
    rows = rows.withColumn("k", S.hash_number(F.concat_ws("#", F.lit(salt), "update", "pos"), F.col("n")) + 1)
    own = stored(pairs.join(broadcast_small(stored(drawn.select("target_id").distinct()), 1_000_000), "target_id", "left_semi"))
    placed = O.with_places(own, ["target_id"], [F.col("ligand_id")], "k")
    return rows.hint("merge").join(placed, ["target_id", "k"]).select("update", "pos", "target_id", "ligand_id")
