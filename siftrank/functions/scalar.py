"""Scalar expressions: coercion, labels, clipping, encodings, losses and portable pseudo-random numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(text: Column) -> Column:
    """A number, or null where the text is none; NaN becomes null as well, since it would count as the largest value."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x), x)


def finite(x: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def hit(score: Column, tau: Column) -> Column:
    """1 where the score reaches the threshold from below; a missing score is no hit, and its row stays."""
    return F.coalesce((score <= tau).cast("int"), F.lit(0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def clip_probability(p: Column, eps: float = 1e-9) -> Column:
    return clip(p, eps, 1 - eps)


def group_key(scaffold: Column, parent: Column) -> Column:
    """The scaffold where there is one; else a key of its own for each parent, with a shared one for what has none."""
    return F.when(F.coalesce(scaffold, F.lit("")) != "", scaffold).otherwise(F.concat(F.lit("ACYCLIC::"), F.coalesce(parent, F.lit("PARSE_FAIL"))))


def one_hot_other(value: Column, vocabulary: list) -> Column:
    """0/1 for each word of the vocabulary, and a last place for all else."""
    known = F.coalesce(value.isin(vocabulary), F.lit(False))
    return F.array(*(F.coalesce((value == v).cast("int"), F.lit(0)) for v in vocabulary), (~known).cast("int"))


def radial_basis(distance: Column, centers: int = 16, reach: float = 20.0) -> Column:
    """Gaussian bumps at evenly spaced centers from 0 to ``reach``, as wide as ``reach / centers``."""
    gamma = 1 / (2 * (reach / centers) ** 2)
    return F.transform(F.sequence(F.lit(0), F.lit(centers - 1)), lambda k: F.exp(-gamma * F.pow(distance - k * F.lit(reach) / (centers - 1), F.lit(2.0))))


def bce_with_logits(z: Column, y: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def huber(r: Column, delta: float = 1.0) -> Column:
    return F.when(F.abs(r) <= delta, r * r / 2).otherwise(delta * (F.abs(r) - delta / 2))


def hash_number(key: Column, n: int | Column) -> Column:
    """A pseudo-random number from 0 to ``n - 1`` that other SQL engines compute alike."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % n


def top_count(fraction: float, n: Column) -> Column:
    """How many rows a fraction is in a metric: rounded half to even, one at least."""
    return F.greatest(F.lit(1), F.bround(F.lit(fraction) * n, 0)).cast("long")


def top_ceil(fraction: float, n: Column) -> Column:
    """How many rows a fraction is in a selection: rounded up, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.lit(fraction) * n)).cast("long")


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column, constant: float | None) -> Column:
    """A correlation from sums; ``constant`` is the result where a side does not vary or there are fewer than 3 rows."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    fine = (n >= 3) & (vx > 1e-12) & (vy > 1e-12)
    return F.when(fine, F.try_divide(n * sxy - sx * sy, F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0))))).otherwise(F.lit(constant).cast("double"))

