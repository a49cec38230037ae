"""Barcode-aware duplicate marking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.reads import DUPLICATE, PAIRED, READ1, READ2, SUPPLEMENTARY, has


def first_per_key(df: DataFrame, key: list[str], order: list[str | Column], out: str = "is_dup") -> DataFrame:
    """Flag all but the first row of each key; a null key part equals an empty one.

    One shuffle on the key, and a bounded window state: the rank only.
    """
    w = Window.partitionBy(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w) > 1)


def _sides(reads: DataFrame) -> DataFrame:
    """Adds whether a record is live, part of a primary pair, and the left one of its fragment."""
    end = reads.filter("tid < 0").agg(F.min("seq").alias("_end"))
    df = reads.join(F.broadcast(end), F.lit(True), "left")  # one row
    live = F.coalesce(F.col("seq") < F.col("_end"), F.lit(True))
    primary = live & ~has("flag", SUPPLEMENTARY)
    paired = has("flag", PAIRED) & has("flag", READ1 | READ2)
    here, there = F.struct("tid", "pos"), F.struct(F.col("mtid"), F.col("mpos"))
    left = primary & (~paired | (here < there) | ((here == there) & has("flag", READ1)))
    return df.select("*", live.alias("_live"), (primary & paired).alias("_paired"), F.coalesce(left, F.lit(False)).alias("_left"))


def mark_duplicates(reads: DataFrame) -> DataFrame:
    """Set or clear the duplicate bit of alignments (seq, qname, flag, tid, pos, mtid, mpos, bc).

    Of the leftmost mates with equal contig, position and barcode the first in
    input order stays. A paired duplicate's name marks the first right mate that
    carries it. Supplementary records are never marked. Records from the first
    one without a contig on are copied as they are.
    """
    df = _sides(reads).drop("_end")
    # a left mate is live and primary, so flags tell what both uses of its window need: one shuffle serves both
    lefts = first_per_key(df.filter("_left").select(*reads.columns), ["tid", "pos", "bc"], ["seq"], "_dup")
    lefts = lefts.withColumn("_live", F.lit(True)).withColumn("_paired", has("flag", PAIRED) & has("flag", READ1 | READ2)).withColumn("_left", F.lit(True))
    others = df.filter("not _left")
    marked = lefts.filter("_dup and _paired").groupBy("qname").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("qname").orderBy("seq")
    rights = others.filter("_paired").withColumn("_k", F.row_number().over(w)).join(marked, "qname", "left").withColumn("_dup", F.coalesce(F.col("_k") <= F.col("_n"), F.lit(False)))
    rest = others.filter("not _paired").withColumn("_dup", F.lit(False))
    out = lefts.unionByName(rights.drop("_k", "_n")).unionByName(rest)
    flag = F.col("flag").bitwiseAND(F.lit(~DUPLICATE)).bitwiseOR(F.when(F.col("_dup"), DUPLICATE).otherwise(0))
    return out.withColumn("flag", F.when(F.col("_live"), flag).otherwise(F.col("flag"))).select(*reads.columns)


def duplicate_counts(df: DataFrame, is_dup: str = "is_dup", bc: str = "bc") -> DataFrame:
    """(has_bc, fragments, duplicates)."""
    return df.groupBy(F.col(bc).isNotNull().alias("has_bc")).agg(F.count("*").alias("fragments"), F.count_if(is_dup).alias("duplicates"))


def fragment_counts(marked: DataFrame) -> DataFrame:
    """(has_bc, fragments, duplicates, unpaired) of marked alignments; unpaired are duplicates whose right mate never came."""
    df = _sides(marked)
    dup = has("flag", DUPLICATE)
    lefts, rights = df.filter("_left"), df.filter("not _left and _paired")
    came = rights.filter(dup).groupBy("qname").agg(F.count("*").alias("_m"))
    lost = lefts.filter(dup & F.col("_paired")).groupBy("qname", F.col("bc").isNotNull().alias("has_bc")).agg(F.count("*").alias("_n")).join(came, "qname", "left")
    lost = lost.groupBy("has_bc").agg(F.sum(F.greatest(F.lit(0), F.col("_n") - F.coalesce("_m", F.lit(0)))).alias("unpaired"))
    counts = lefts.groupBy(F.col("bc").isNotNull().alias("has_bc")).agg(F.count("*").alias("fragments"), F.count_if(dup).alias("duplicates"))
    return counts.join(lost, "has_bc", "left").na.fill(0, ["unpaired"])
