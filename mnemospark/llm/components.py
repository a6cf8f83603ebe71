"""Connected components by alternating large and small stars, in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_ROUNDS = 60
#: A node with more neighbours than FEW and than 2 / HUBS of all edges is a hub; there are fewer than HUBS of these.
HUBS, FEW = 10_000, 1_000


def with_least(rows: DataFrame, key: str, value: str, n_rows: int) -> DataFrame:
    """``rows`` with ``m``, the smallest ``value`` of their ``key``, where one key may have most of the ``n_rows`` rows.

    Minima are combined before the shuffle. Those of frequent keys, fewer than HUBS, are broadcast, so their rows stay
    where they are; every other key has at most FEW or one in HUBS of all rows, and is joined.
    """
    per = rows.groupBy(key).agg(F.min(value).alias("m"), F.count("*").alias("_n"))
    frequent = F.col("_n") > max(FEW, n_rows // HUBS)
    hubs = per.filter(frequent).select(key, F.col("m").alias("_m"))
    marked = rows.join(F.broadcast(hubs), key, "left")
    rare = marked.filter(F.col("_m").isNull()).drop("_m").join(per.filter(~frequent).select(key, "m"), key)
    return marked.filter(F.col("_m").isNotNull()).withColumnRenamed("_m", "m").unionByName(rare)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges (a, b)`` of longs; root is the smallest node reachable.

    Each round lets every node point its larger neighbours, then its smaller ones, at its smallest neighbour; the
    number of rounds grows with the logarithm of the graph. Rounds are cut by tables in the shared folder. Minima are
    combined before the shuffle and those of nodes with very many neighbours are broadcast (``with_least``), so no task
    gets all neighbours of one node. Loops and repeated edges do no harm; no edges give no rows.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct()
    now = materialize(now, "components")
    mark = now.agg(F.count("*"), F.sum((F.xxhash64("a", "b") / 65536).cast("long"))).first()
    for _ in range(MAX_ROUNDS):
        both = now.union(now.select("b", "a")).toDF("u", "v")
        found = with_least(both, "u", "v", 2 * mark[0]).filter(F.col("v") > F.col("u"))
        large = found.select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()
        near = with_least(large, "a", "b", mark[0])
        small = near.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = materialize(small.distinct(), "components")
        was, mark = mark, now.agg(F.count("*"), F.sum((F.xxhash64("a", "b") / 65536).cast("long"))).first()
        if was == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
