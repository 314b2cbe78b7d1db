"""Connected components over an edge table, by alternating large-star and small-star rounds.

Both rounds only ever hold one minimum per node, so a hub with millions of neighbours is a skewed join
(which adaptive execution splits), never a collected list. Rounds grow with the logarithm of a component's
diameter; each is cut at the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrank.sources.checkpoints import cut, stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One round over undirected edges ``(a, b)`` with ``a > b``."""
    if small:
        seen = edges
    else:
        seen = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = seen.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    # read back, so that the join has plain shuffles on both sides and a hub's edges can be split
    least = stored(least)
    joined = seen.hint("merge").join(least, "a")
    if small:
        moved = joined.select(F.col("b").alias("x"), F.col("least").alias("y")).union(
            least.select(F.col("a").alias("x"), F.col("least").alias("y"))
        )
    else:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("x"), F.col("least").alias("y"))
    return moved.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """Map every node that occurs in ``edges`` to the least node of its component: ``(node, component)``.

    Self loops keep their node as a component of its own. Edges with a null end are no edges. An empty table
    gives an empty result. Raises if ``max_rounds`` rounds do not converge.
    """
    raw = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    raw = cut(raw.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    now = raw.where("a <> b")
    state = _state(now)
    for _ in range(max_rounds):
        now = cut(_star(_star(now, small=False), small=True))
        last, state = state, _state(now)
        if state == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    loops = raw.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return (
        loops.hint("merge").join(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left")
        .select("node", F.coalesce("component", "node").alias("component"))
    )
