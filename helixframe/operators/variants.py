"""Bulk against single cells: substitution calls, allele dropout, clustered-call filters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.reads import mutation_class


@dataclass(frozen=True)
class DiffOptions:
    min_mapq: int = 40
    min_bulk_depth: int = 15
    min_bulk_allele: int = 5
    min_bulk_balance: float = 0.3
    min_alt: int = 5
    min_alt_strand: int = 1
    min_alt_balance: float = 0.2
    max_conflicts: int = 0
    distance: int = 100
    max_bulk_alt: int = 0
    max_haploid_error: int = 1
    haploid: bool = False
    pair: bool = False
    indels: bool = False


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b)


def is_indel() -> Column:
    return ~((F.length("ref") == 1) & (F.length("alt") == 1))


def least_quality(info: Column) -> Column:
    """Smallest AMQ of a site's INFO text, missing values aside; null without the field."""
    parts = F.split(F.regexp_extract(info, r"\bAMQ=([.\d,]+)", 1), ",")
    return F.array_min(F.transform(F.filter(parts, lambda x: x.rlike(r"^\d+$")), lambda x: x.cast("int")))


def _sums(x: str) -> tuple[Column, Column]:
    return F.col(f"{x}_rf") + F.col(f"{x}_rr"), F.col(f"{x}_af") + F.col(f"{x}_ar")


def cell_called(x: str, o: DiffOptions) -> Column:
    ref, alt = _sums(x)
    return (alt >= o.min_alt) & ((ref == 0) if o.haploid else F.coalesce(ratio(alt, ref + alt) >= o.min_alt_balance, F.lit(False)))


def called(o: DiffOptions, cells: int = 1) -> Column:
    """Whether the cell, or both cells, carry the alternative allele.

    Columns per sample s in (b, c, d): s_rf, s_rr, s_af, s_ar (reference and
    alternative depths per strand), s_lt (fragment conflicts).
    """
    if cells == 1:
        return cell_called("c", o) & (F.coalesce("c_lt", F.lit(0)) <= o.max_conflicts) & (F.col("c_af") >= o.min_alt_strand) & (F.col("c_ar") >= o.min_alt_strand)
    clean = (F.coalesce("c_lt", F.lit(0)) <= 0) & (F.coalesce("d_lt", F.lit(0)) <= 0)
    if o.pair and not o.haploid:
        (cr, ca), (dr, da) = _sums("c"), _sums("d")
        return clean & (ca + da >= o.min_alt) & F.coalesce(ratio(ca + da, cr + ca + dr + da) >= o.min_alt_balance, F.lit(False)) & (ca >= 3) & (da >= 3)
    return clean & cell_called("c", o) & cell_called("d", o)


def bulk_het(o: DiffOptions) -> Column:
    """Heterozygous in bulk; in haploid mode homozygous for the alternative."""
    ref, alt = _sums("b")
    strands = (F.col("b_af") > 0) & (F.col("b_ar") > 0)
    if o.haploid:
        return strands & (alt >= o.min_bulk_allele) & (ref <= o.max_haploid_error)
    even = (ratio(ref, ref + alt) >= o.min_bulk_balance) & (ratio(alt, ref + alt) >= o.min_bulk_balance)
    return strands & (F.col("b_rf") > 0) & (F.col("b_rr") > 0) & (ref >= o.min_bulk_allele) & (alt >= o.min_bulk_allele) & F.coalesce(even, F.lit(False))


def sites(df: DataFrame, o: DiffOptions, cells: int = 1) -> DataFrame:
    """Usable sites with flags: het, called, candidate, kind; lost alleles of the first cell."""
    ref, alt = _sums("b")
    df = df.filter(ref + alt >= o.min_bulk_depth)
    if not o.indels:
        df = df.filter(~is_indel())
    if "info" in df.columns:
        df = df.filter(F.coalesce(least_quality(F.col("info")) >= o.min_mapq, F.lit(True)))
    cr, ca = _sums("c")
    kind = F.when(F.length("ref") > F.length("alt"), "DEL").when(F.length("ref") < F.length("alt"), "INS").otherwise(mutation_class("ref", "alt"))
    df = df.select("*", bulk_het(o).alias("het"), called(o, cells).alias("called"), kind.alias("kind"), (cr == 0).alias("no_ref"), (ca == 0).alias("no_alt"))
    return df.withColumn("candidate", (alt <= o.max_bulk_alt) & F.col("called"))


def near(df: DataFrame, by: list[str], pos: str, distance: int, out: str = "flt") -> DataFrame:
    """Flag rows with a neighbour of the same group at most ``distance`` away; neighbours in order are enough."""
    w = Window.partitionBy(*by).orderBy(pos)
    gap = lambda x: F.coalesce(x <= distance, F.lit(False))
    return df.withColumn(out, gap(F.col(pos) - F.lag(pos).over(w)) | gap(F.lead(pos).over(w) - F.col(pos)))


def novel(flagged: DataFrame, o: DiffOptions) -> DataFrame:
    """Candidates without a neighbouring candidate."""
    return near(flagged.filter("candidate"), ["chrom"], "pos", o.distance).filter("not flt")


def rates(flagged: DataFrame) -> DataFrame:
    """One row: bulk heterozygous sites, missed calls and dropped alleles among them, with their shares (null without such sites)."""
    het = flagged.filter("het")
    n = het.agg(
        F.count("*").alias("n_het"), F.count_if(F.expr("not called")).alias("n_fn"), F.count_if("no_ref").alias("n_ado_ref"), F.count_if("no_alt").alias("n_ado_alt"), F.count_if(F.expr("no_ref and no_alt")).alias("n_ado_both")
    )
    share = lambda c: F.round(F.try_divide(F.col(c).cast("double"), F.col("n_het")), 4).alias(c.replace("n_", "r_", 1))
    return n.select("*", *[share(c) for c in ("n_fn", "n_ado_ref", "n_ado_alt", "n_ado_both")])


def tallies(found: DataFrame) -> DataFrame:
    """One row: novel substitutions, those other than C to T, deletions, insertions."""
    return found.agg(
        F.count_if(F.expr("kind not in ('DEL', 'INS')")).alias("n_snv"), F.count_if(F.expr("kind not in ('DEL', 'INS', 'CT')")).alias("n_snv_nonct"), F.count_if(F.expr("kind = 'DEL'")).alias("n_del"), F.count_if(F.expr("kind = 'INS'")).alias("n_ins")
    )
