"""Piecewise-constant depth of intervals, in any number of weighted channels.

Starts and ends are added up per position first. A running sum over a whole
contig would be one task a contig; here contigs are cut into ranges, the sums
of earlier ranges are carried in, and each range is summed by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGE_BITS = 20


def sweep(events: DataFrame, by: list[str], channels: list[str], pos: str = "pos", range_bits: int = RANGE_BITS) -> DataFrame:
    """(by, st, en, channels) from weighted events (by, pos, channels): each pair of neighbouring positions and the running sums between them."""
    at = events.groupBy(*by, F.col(pos).alias("st")).agg(*[F.sum(c).cast("long").alias(c) for c in channels])
    at = at.withColumn("_range", F.shiftright("st", range_bits))
    totals = at.groupBy(*by, "_range").agg(F.min("st").alias("_first"), *[F.sum(c).alias(f"_{c}") for c in channels])
    w = Window.partitionBy(*by).orderBy("_range")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*by, "_range", F.lead("_first").over(w).alias("_next"), *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in channels])
    local = Window.partitionBy(*by, "_range").orderBy("st")
    run = local.rowsBetween(Window.unboundedPreceding, 0)
    # null-safe, as a group may be null
    keys = [*by, "_range"]
    carry = carry.withColumnsRenamed({c: f"_k_{c}" for c in keys})
    joined = at.join(carry, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys])
    out = joined.select(*by, "st", F.coalesce(F.lead("st").over(local), "_next").alias("en"), *[(F.sum(c).over(run) + F.col(f"_{c}")).cast("long").alias(c) for c in channels])
    return out.filter("en is not null")


def interval_events(df: DataFrame, by: list[str], st: str, en: str, **weights: str) -> DataFrame:
    """+weight at the start and -weight at the end of each interval; weights are SQL expressions by channel."""
    signed = F.array(*[F.struct(F.col(p).cast("long").alias("pos"), *[(s * F.expr(w)).cast("long").alias(c) for c, w in weights.items()]) for p, s in ((st, 1), (en, -1))])
    return df.select(*by, F.explode(signed).alias("e")).select(*by, "e.*")


def depth(df: DataFrame, by: list[str], st: str, en: str, from_zero: bool = False, **weights: str) -> DataFrame:
    """Depth segments of intervals; with ``from_zero`` the gap before the first start is a segment too."""
    weights = weights or {"depth": "1"}
    events = interval_events(df, by, st, en, **weights)
    if from_zero:
        events = events.unionByName(df.select(*by).distinct().select(*by, F.lit(0).cast("long").alias("pos"), *[F.lit(0).cast("long").alias(c) for c in weights]))
    return sweep(events, by, list(weights))


def histogram(segments: DataFrame, channel: str, cap: int = 10) -> DataFrame:
    """(depth, bases): positions at each depth, depths over ``cap`` with it."""
    return segments.groupBy(F.least(F.col(channel), F.lit(cap)).cast("long").alias("depth")).agg(F.sum(F.col("en") - F.col("st")).cast("long").alias("bases"))
