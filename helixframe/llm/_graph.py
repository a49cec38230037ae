"""Connected components by alternating large-star and small-star steps.

Each step is one aggregation with map-side combining and one join. A node's
links are dealt over ``SALTS`` parts by the other end, in both, so the hub of a
star never gathers in one task; the edge list shrinks to a forest of depth one
in a number of rounds logarithmic in the longest path. Links and components
stay distributed; the driver only sees a count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import measured

#: Parts of one node's links: a hub of a third of all links spreads over so many tasks.
SALTS = 64


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m) of each pair: ``m`` is the least of ``u`` and all its ``v``."""
    pairs = pairs.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    parts = pairs.groupBy("u", "s").agg(F.min("v").alias("m"))
    # at most SALTS rows a node from here on
    least = parts.select("u", "s", F.least("u", F.min("m").over(Window.partitionBy("u"))).alias("m"))
    return pairs.join(least, ["u", "s"]).select("u", "v", "m")


def _small(edges: DataFrame) -> DataFrame:
    joined = _with_least(edges)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for each end of an edge; the component is its least node.

    Nodes without an edge are absent; self-links and repeated links do nothing.
    """
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    (e, state), seen = measured(e, total=total), None
    while state["n"] and state != seen:
        seen = state
        e, state = measured(_small(_large(e).filter("u <> v").distinct()).filter("u <> v").distinct(), total=total)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
