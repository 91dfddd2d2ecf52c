"""Connected components of a table of links, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill import storage


def _with_least(pairs: DataFrame) -> DataFrame:
    """``u, v, least``: each pair with the smallest of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("w"), F.least("u", "m").alias("least")
    )
    return pairs.join(least, F.col("u") == F.col("w")).select("u", "v", "least")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = _with_least(links)
    return down.select(F.col("v").alias("u"), F.col("least").alias("v")).union(
        down.select("u", F.col("least").alias("v"))
    )


def _oriented(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (smallest reachable node) of every node of *links* (``a, b``).

    Alternates large-star and small-star steps until every node points at the
    smallest of its component.  A step keeps the number of links; the least
    neighbour is aggregated before the exchange and a node with very many links
    is an ordinary skewed join key.
    """
    state = storage.materialize(_oriented(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "links")
    while not state.isEmpty():
        after = _oriented(_small_star(_large_star(state)))
        after = storage.materialize(after, "links")
        same = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        before, now = (t.agg(F.count("*").alias("n"), same.alias("s")).first() for t in (state, after))
        state = after
        if before == now:
            break
    roots = state.select(F.col("v").alias("node")).distinct()
    return (
        state.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .union(roots.select("node", F.col("node").alias("component")))
        .distinct()
    )
