"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is a handful of key-partitioned aggregations and joins. Minima are combined before the shuffle. The nodes' minima
are broadcast while there are FEW edges, so the edges of a node that many others are linked to stay where they are; beyond
that the joins are plain equi-joins whose hot keys adaptive execution splits. Nothing but two totals reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import FEW, cut

#: Edges of a partition at least; rounds don't make more edges.
AT_ONCE = 200_000


def _large_star(edges: DataFrame, sent: Callable[[DataFrame], DataFrame]) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(sent(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, sent: Callable[[DataFrame], DataFrame]) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(sent(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that is linked to a smaller one; root is the component's smallest node.

    Edges with a null end and loops count for nothing; repeated edges count once; without edges the result is empty.
    """
    now = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    sign = _sign(now)
    while sign[0]:
        sent = F.broadcast if sign[0] <= FEW else lambda least: least  # two nodes an edge at most
        now = cut(_small_star(_large_star(now, sent), sent).coalesce(max(1, sign[0] // AT_ONCE)))
        after = _sign(now)
        if after == sign:
            break
        sign = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
