"""Interval algebra: overlap semi and anti joins, lengths, unions, region strings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

BIN = 13


def _overlaps(df: DataFrame, mask: DataFrame, chrom: str, beg: str, end: str, how: str) -> DataFrame:
    """Overlap join without a nested loop: long masks are cut at bins of 8 kb, rows look up the bins they span.

    The equality on (chromosome, bin) is what partitions the work; the exact
    test follows. A semi or anti join needs the row only once: for rows that
    span several bins, their distinct intervals are looked up.
    """
    bins = lambda a, b: F.explode(F.sequence(F.shiftright(a, BIN), F.shiftright(F.greatest(a, b - 1), BIN)))
    m = mask.select(F.col("chrom").alias("_c"), F.col("beg").cast("long").alias("_b"), F.col("end").cast("long").alias("_e")).filter("_e > _b")
    m = m.withColumn("_bin", bins(F.col("_b"), F.col("_e"))).distinct()
    b, e = F.col(beg).cast("long"), F.col(end).cast("long")
    one_bin = F.shiftright(b, BIN) == F.shiftright(F.greatest(b, e - 1), BIN)
    test = (F.col(chrom) == F.col("_c")) & (b < F.col("_e")) & (e > F.col("_b"))
    near = df.filter(one_bin).join(m, test & (F.shiftright(b, BIN) == F.col("_bin")), how)
    # whether a row over several bins hits is a matter of its interval: distinct intervals are looked up, rows of any type stay whole
    far = df.filter(~one_bin)
    key = [F.col(chrom), b, e]
    spans = far.select(*[c.alias(f"_k{k}") for k, c in enumerate(key)]).distinct().withColumn("_rbin", bins(F.col("_k1"), F.col("_k2")))
    met = (F.col("_k0") == F.col("_c")) & (F.col("_k1") < F.col("_e")) & (F.col("_k2") > F.col("_b")) & (F.col("_rbin") == F.col("_bin"))
    hit = spans.join(m, met, "left_semi").select("_k0", "_k1", "_k2").distinct()
    return near.unionByName(far.join(hit, [c == F.col(f"_k{k}") for k, c in enumerate(key)], how))


def overlapping(df: DataFrame, mask: DataFrame, chrom: str = "chrom", beg: str = "beg", end: str = "end") -> DataFrame:
    """Rows whose [beg, end) meets an interval of ``mask`` (chrom, beg, end); repeated rows stay repeated."""
    return _overlaps(df, mask, chrom, beg, end, "left_semi")


def outside(df: DataFrame, mask: DataFrame, chrom: str = "chrom", beg: str = "beg", end: str = "end") -> DataFrame:
    """Rows that meet no interval of ``mask``."""
    return _overlaps(df, mask, chrom, beg, end, "left_anti")


def total_length(mask: DataFrame) -> DataFrame:
    """Sum of interval lengths; overlaps count twice."""
    return mask.agg(F.sum(F.col("end") - F.col("beg")).cast("long").alias("total"))


def union(mask: DataFrame, beg: str = "beg", end: str = "end", *by: str) -> DataFrame:
    """Disjoint intervals that cover the same positions; touching ones are joined."""
    by = by or ("chrom",)
    marked = islands(mask.filter(F.col(end) > F.col(beg)), by, [beg, end], beg, end, touching=True)
    return marked.groupBy(*by, "island").agg(F.min(beg).alias(beg), F.max(end).alias(end)).drop("island")


def islands(df: DataFrame, by: tuple[str, ...] | list[str], order: list[str], beg: str, end: str, touching: bool = False, range_bits: int = 20) -> DataFrame:
    """Number the runs of overlapping intervals: a new one starts where ``beg`` reaches all ends before it.

    A group is cut into ranges of its first ``order`` column. The greatest end
    and the number of runs of all earlier ranges are carried into each, so a
    window spans a range and not a contig.
    """
    by = list(by)
    keys = [*by, "_g"]

    def carried(rows: DataFrame, agg, over) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
        per = rows.groupBy(*keys).agg(agg.alias("_v")).select(*[F.col(c).alias(f"_k_{c}") for c in keys], over(F.col("_v")).over(w).alias("_c"))
        return rows.join(per, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys]).drop(*[f"_k_{c}" for c in keys])

    # rows alike in ``order`` are told apart by the rest, as two windows have to see them in one order
    rest = [f.name for f in df.schema.fields if isinstance(f.dataType, AtomicType) and f.name not in {*order, *by}]
    df = df.withColumn("_g", F.shiftright(F.col(order[0]).cast("long"), range_bits))
    local = Window.partitionBy(*keys).orderBy(*order, *rest)
    df = carried(df, F.max(end), F.max)
    before = F.greatest("_c", F.max(end).over(local.rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("_before", before)
    starts = F.col("_before").isNull() | ((F.col(beg) > F.col("_before")) if touching else (F.col(beg) >= F.col("_before")))
    df = carried(df.withColumn("_new", starts.cast("long")).drop("_c", "_before"), F.sum("_new"), F.sum)
    run = F.sum("_new").over(local.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("island", run + F.coalesce("_c", F.lit(0))).drop("_new", "_c", "_g")


def parse_region(region: str, names: set[str] | None = None) -> tuple[str, int, int]:
    """``chr``, ``chr:beg`` or ``chr:beg-end`` (1-based, inclusive, commas allowed) as 0-based half-open.

    A name that is a contig as a whole, or whose part after the last colon is
    not a range, is taken as a name, as is a range that ends before it begins.
    ``chr:-5`` begins at the first base, as a lone hyphen reads as a sign.
    """
    whole = (region, 0, 1 << 29)
    name, colon, span = region.rpartition(":")
    if not colon or names is not None and region in names:
        return whole
    found = re.fullmatch(r"(-?\d*)(-\d*)?", span.replace(",", ""))
    if span.count("-") > 1 or not found:
        return whole
    number = lambda text: int(text) if text.strip("-") else 0
    beg = max(0, number(found[1]) - 1)
    end = 1 << 29 if found[2] is None and not (found[1] == "-") else number((found[2] or "-")[1:])
    return whole if beg > end else (name, beg, end)


def region_parts(region: Column | str) -> Column:
    """``parse_region`` of a column of region strings, as struct (chrom, beg, en), without knowledge of contigs."""
    r = F.col(region) if isinstance(region, str) else region
    name, span = F.regexp_extract(r, r"(?s)^(.*):[^:]*$", 1), F.regexp_extract(r, r"(?s):([^:]*)$", 1)
    s = F.regexp_replace(span, ",", "")
    number = lambda group: F.coalesce(F.regexp_extract(s, r"^([0-9]*)-?([0-9]*)$", group).try_cast("long"), F.lit(0))
    sound = F.contains(r, F.lit(":")) & s.rlike(r"^-?[0-9]*(-[0-9]*)?$") & (F.length(span) - F.length(F.regexp_replace(span, "-", "")) <= 1)
    beg = F.when(s.startswith("-"), 0).otherwise(F.greatest(F.lit(0).cast("long"), number(1) - 1))
    end = F.when(s == "-", 0).when(s.rlike("^[0-9]+-"), number(2)).otherwise(1 << 29)
    whole = F.struct(r.alias("chrom"), F.lit(0).cast("long").alias("beg"), F.lit(1 << 29).cast("long").alias("en"))
    return F.when(sound & (beg <= end), F.struct(name.alias("chrom"), beg.cast("long").alias("beg"), end.cast("long").alias("en"))).otherwise(whole)


def in_region(region: str, chrom: str = "chrom", beg: str = "beg", end: str = "end") -> Column:
    """Predicate for rows that meet a region; plain comparisons, so Parquet statistics prune with them."""
    name, b, e = parse_region(region)
    return (F.col(chrom) == name) & (F.col(beg) < e) & (F.col(end) > b)
