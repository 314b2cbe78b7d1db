"""Order statistics inside keys of any size: places, average ranks, running hits and exact quantiles.

Keys of at most ``LARGE`` rows are ranked by windows, each in one task. The rows of larger keys are dealt by ranges to many tasks: places come from the ranges' counts, equal values get their common rank from one aggregate
that is joined back, whatever range border lies between them, and no task or window holds a key. Both ways give the same values.

Exact quantiles of large keys are selected by narrowing: a histogram between the least and the largest value tells which of its ranges holds the wanted place, and the next one looks into that range only, until few rows or one value are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftrank.operators.numbering import broadcast_small, numbered_within
from siftrank.sources.checkpoints import stored

#: Rows of a key that one task ranks, rows that a narrowed range may hold at the end, and ranges of a histogram.
LARGE, KEEP, RANGES = 1_000_000, 100_000, 4_096
TOP = 1.7976931348623157e308


def by_size(rows: DataFrame, keys: list[str], small, large, sizes: DataFrame | None = None) -> DataFrame:
    """``small`` of the rows of keys with at most ``LARGE`` rows, and ``large`` of the others'; ``rows`` should be stored."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_rows")) if sizes is None else sizes
    big = sizes.where(F.col("_rows") > LARGE).select(*keys)
    big = stored(big)
    if big.isEmpty():
        return small(rows)
    # one row for each LARGE rows at most
    few = broadcast_small(big, 1_000_000)
    return small(rows.join(few, keys, "left_anti").select(*rows.columns)).unionByName(large(stored(rows.join(few, keys, "left_semi").select(*rows.columns))))


def with_places(rows: DataFrame, keys: list[str], order: list[Column], name: str = "rk", sizes: DataFrame | None = None) -> DataFrame:
    """Add each row's place from 1 in the order given; rows that agree in it get any of their places."""

    def small(part: DataFrame) -> DataFrame:
        return part.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))

    def large(part: DataFrame) -> DataFrame:
        named = part.withColumns({f"_o{i}": c for i, c in enumerate(order)})
        return numbered_within(named, keys, [f"_o{i}" for i in range(len(order))], name).select(*part.columns, (F.col(name) + 1).alias(name))

    return by_size(rows, keys, small, large, sizes)


def common_ranks(part: DataFrame, keys: list[str], value: str, place: str, name: str) -> DataFrame:
    """Add the mean of the first and last place of equal values, from places that are there already, by a join that a frequent value can be split in."""
    ranks = stored(part.groupBy(*keys, value).agg(((F.min(place) + F.max(place)) / 2).alias(name)))
    return part.hint("merge").join(ranks, [*keys, value]).select(*part.columns, name)


def with_average_ranks(rows: DataFrame, keys: list[str], sizes: DataFrame | None = None, **columns: Column) -> DataFrame:
    """Add the average rank, ascending, of each expression inside its keys: the mean of the first and the last place of equal values."""
    for name, c in columns.items():

        def small(part: DataFrame, name=name, c=c) -> DataFrame:
            up = Window.partitionBy(*keys[::-1]).orderBy("_v")  # the last key tells most rows apart
            both = F.rank().over(up) + F.count("*").over(up.rangeBetween(Window.unboundedPreceding, 0))
            return part.withColumn("_v", c).withColumn(name, both / 2).drop("_v")

        def large(part: DataFrame, name=name, c=c) -> DataFrame:
            placed = stored(numbered_within(part.withColumn("_v", c), keys, ["_v"], "_k").withColumn("_k", F.col("_k") + 1))
            return common_ranks(placed, keys, "_v", "_k", name).drop("_v", "_k")

        rows = by_size(rows, keys, small, large, sizes)
    return rows


def rank_moments(rows: DataFrame, keys: list[str], x: Column, y: Column, prefix: str = "") -> DataFrame:
    """``keys`` and ``n, sx, sy, sxx, syy, sxy`` of the average ranks of two expressions inside keys of any size. ``rows`` is read more than once and should be stored; no other row is.

    Rows are dealt by ranges of the one expression and then of the other, so that equal values meet. A row carries twice its place in its first range only; how many rows the ranges before hold is known, and added, when places are sums of two
    ranges.
    """

    def placed(part: DataFrame, value: str, name: str) -> DataFrame:
        dealt = part.repartitionByRange(*keys, value).sortWithinPartitions(*keys, value)
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        dealt = dealt.withColumns({f"{name}_part": F.spark_partition_id(), "_at": place})
        equal = Window.partitionBy(*keys, value)  # these meet in one range
        return dealt.withColumn(name, (F.min("_at").over(equal) + F.max("_at").over(equal)).cast("double")).drop("_at", value)

    both = placed(placed(rows.select(*keys, x.alias("_x"), y.alias("_y")), "_x", "_a"), "_y", "_b")
    a, b, n = F.col("_a"), F.col("_b"), F.col("_n")
    sums = {"_n": F.count("*"), "_sa": F.sum(a), "_sb": F.sum(b), "_saa": F.sum(a * a), "_sbb": F.sum(b * b), "_sab": F.sum(a * b)}
    cells = stored(both.groupBy(*keys, "_a_part", "_b_part").agg(*(c.alias(name) for name, c in sums.items())))

    def shifts(name: str) -> DataFrame:
        # equal values share their places, so a range's sum of places tells where it begins
        ranges = cells.groupBy(*keys, f"{name}_part").agg(F.sum("_n").alias("_n"), F.sum(f"_s{name[1]}").alias("_s"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(f"{name}_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return ranges.withColumn(f"{name}_shift", before + 1 - (F.col("_s") / n - (n - 1)) / 2).drop("_n", "_s")

    for name in ("_a", "_b"):
        cells = cells.join(broadcast_small(stored(shifts(name)), 100_000), [*keys, f"{name}_part"])
    sa, sb, da, db = F.col("_sa") / 2, F.col("_sb") / 2, F.col("_a_shift"), F.col("_b_shift")
    moments = {
        "n": n, "sx": sa + n * da, "sy": sb + n * db, "sxx": F.col("_saa") / 4 + 2 * da * sa + n * da * da, "syy": F.col("_sbb") / 4 + 2 * db * sb + n * db * db,
        "sxy": F.col("_sab") / 4 + db * sa + da * sb + n * da * db,
    }
    return cells.groupBy(*keys).agg(*(F.sum(c).alias(prefix + name) for name, c in moments.items()))


def tied_rank_moments(rows: DataFrame, keys: list[str], x: Column, y: Column, prefix: str = "") -> DataFrame:
    """The same as :func:`rank_moments` for keys with at most :data:`LARGE` different pairs of values: rows are counted by their values first, in any task, and only counts are dealt and sorted."""
    cells = rows.groupBy(*keys, x.alias("_x"), y.alias("_y")).agg(F.count("*").alias("_n"))
    for v, name in (("_x", "_a"), ("_y", "_b")):
        up, equal = Window.partitionBy(*keys).orderBy(v).rangeBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys, v)
        cells = cells.withColumn(name, F.sum("_n").over(up) - (F.sum("_n").over(equal) - 1) / 2)
    a, b, n = F.col("_a"), F.col("_b"), F.col("_n")
    moments = {"n": n, "sx": n * a, "sy": n * b, "sxx": n * a * a, "syy": n * b * b, "sxy": n * a * b}
    return cells.groupBy(*keys).agg(*(F.sum(c).alias(prefix + name) for name, c in moments.items()))


def select(rows: DataFrame, keys: list[str], column: str, wanted: DataFrame) -> DataFrame:
    """``keys, pos, value``: the value at each wanted place ``(keys, pos)``, from 0 in ascending order; ``rows`` should be stored and without nulls and NaN."""
    values = rows.select(*keys, F.col(column).cast("double").alias("_v"))
    ends = values.groupBy(*keys).agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.count("*").alias("inside"))
    state = stored(wanted.select(*keys, "pos").hint("merge").join(ends, keys).withColumn("skip", F.lit(0).cast("long")))
    low, high = F.greatest(F.col("low"), F.lit(-TOP)), F.least(F.col("high"), F.lit(TOP))
    # halves, since a difference of two values may be too large; the ends have ranges of their own, so that every turn narrows
    share = (F.col("_v") / 2 - low / 2) / (high / 2 - low / 2)
    middle = F.least(F.lit(RANGES - 3), F.floor(F.when(high / 2 > low / 2, share).otherwise(0.0) * (RANGES - 2)).cast("int")) + 1
    place = F.when(F.col("_v") == F.col("low"), 0).when(F.col("_v") == F.col("high"), RANGES - 1).otherwise(middle)
    while True:
        open_ = state.where((F.col("low") < F.col("high")) & (F.col("inside") > KEEP))
        if open_.isEmpty():
            break
        within = values.join(broadcast_small(open_, 1_000_000), keys).where("_v >= low AND _v <= high")
        counts = within.groupBy(*keys, "pos", "skip", place.alias("range")).agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.count("*").alias("inside"))
        # RANGES rows for each wanted place
        before = F.coalesce(F.sum("inside").over(Window.partitionBy(*keys, "pos").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        narrowed = counts.withColumn("skip", F.col("skip") + before).where((F.col("pos") >= F.col("skip")) & (F.col("pos") < F.col("skip") + F.col("inside")))
        state = stored(narrowed.select(*state.columns).unionByName(state.where((F.col("low") >= F.col("high")) | (F.col("inside") <= KEEP))))
    settled = state.where("low >= high").select(*keys, "pos", F.col("low").alias("value"))
    left = values.join(broadcast_small(state.where("low < high"), 1_000_000), keys).where("_v >= low AND _v <= high")
    rank = F.row_number().over(Window.partitionBy(*keys, "pos").orderBy("_v")) - 1
    return settled.unionByName(left.withColumn("_r", rank).where(F.col("_r") == F.col("pos") - F.col("skip")).select(*keys, "pos", F.col("_v").alias("value")))


def quantiles(rows: DataFrame, keys: list[str], column: str, shares: list[float], sizes: DataFrame | None = None) -> DataFrame:
    """``keys, t``: the exact quantiles of each key, linear between neighbours, as an array; ``rows`` should be stored and without nulls and NaN."""

    def small(part: DataFrame) -> DataFrame:
        return part.groupBy(*keys).agg(F.percentile(column, F.array(*map(F.lit, shares))).alias("t"))

    def large(part: DataFrame) -> DataFrame:
        at = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), (F.col("n") - 1) * F.lit(q)) for i, q in enumerate(shares))))
        places = stored(part.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, at.alias("x")).select(*keys, "x.i", F.col("x.col2").alias("at")))
        ends = places.select(*keys, F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("pos")).distinct()
        found = stored(select(part, keys, column, ends))
        side = lambda f, name: found.select(*keys, F.col("pos").alias(f), F.col("value").alias(name))
        both = places.withColumns({"below": F.floor("at"), "above": F.ceil("at")}).hint("merge").join(side("below", "x"), [*keys, "below"]).hint("merge").join(side("above", "y"), [*keys, "above"])
        value = F.when(F.col("x") == F.col("y"), F.col("x")).otherwise((F.col("above") - F.col("at")) * F.col("x") + (F.col("at") - F.col("below")) * F.col("y"))
        # as many rows for each key as there are shares
        return both.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", value.alias("v")))), lambda e: e["v"]).alias("t"))

    return by_size(rows, keys, small, large, sizes)


def first_places(rows: DataFrame, keys: list[str], value: str, tie: str, most: Column) -> DataFrame:
    """The rows of the first ``most`` places of each key, by descending ``value`` and then ``tie``, with their place ``rk``; ``most`` may use ``n``, the key's number of rows. ``rows`` should be stored.

    Of a large key only rows that reach the value at the last wanted place are sorted. Rows without a value have no place and do not count.
    """
    real = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    counts = stored(real.groupBy(*keys).agg(F.count("*").alias("n")))
    sizes = counts.select(*keys, F.col("n").alias("_rows"), most.cast("long").alias("_most"))

    def small(part: DataFrame) -> DataFrame:
        return part.withColumn("rk", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), tie)).cast("long"))

    def large(part: DataFrame) -> DataFrame:
        last = sizes.where(F.col("_rows") > LARGE).select(*keys, F.greatest(F.col("_rows") - F.col("_most"), F.lit(0)).cast("long").alias("pos"))
        floor = stored(select(part, keys, value, last).select(*keys, F.col("value").alias("_floor")))
        near = part.join(broadcast_small(floor, 1_000_000), keys).where(F.col(value) >= F.col("_floor")).withColumn("_less", -F.col(value))
        return numbered_within(near, keys, ["_less", tie], "rk").select(*part.columns, (F.col("rk") + 1).alias("rk"))

    placed = by_size(real, keys, small, large, sizes)
    return placed.join(broadcast_small(sizes.select(*keys, "_most"), 100_000), keys).where(F.col("rk") <= F.col("_most")).select(*rows.columns, "rk")
