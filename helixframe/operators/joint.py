"""Joint calling over several bulks and many cells.

Data stay long: a row per site and sample with strand depths (rf, af, rr, ar),
``lt`` (fragment conflicts) and ``alen`` (least distance of an alternative base
to its read's end). Sites are aggregates, neighbours are windows per contig or
per (contig, cell).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .variants import near

SITE = ["chrom", "pos", "ref", "alt"]


@dataclass(frozen=True)
class JointOptions:
    min_alt: int = 5
    min_alt_strand: int = 2
    max_conflicts: int = 1
    min_end_distance: int = 10
    window: int = 100
    min_damage: int = 4
    min_balance: float = 0.2
    min_joint: int = 2
    min_joint_strand: int = 1
    min_bulk_depth: int = 20
    min_bulk_allele: int = 8
    max_bulk_alt: int = 0
    min_amq: int = 50
    bulk_balance: float = 0.3
    haploid_bulk: bool = False

    def __post_init__(self) -> None:
        if 2 * self.min_alt_strand > self.min_alt:
            raise ValueError("the strand minimum must be at most half of the total minimum")


def autosome(chrom: Column) -> Column:
    return chrom.rlike("^(chr)?[0-9]+$")


def merge_replicates(df: DataFrame, replicates: DataFrame) -> DataFrame:
    """Replicates (replicate, canonical) of a cell become one: least depth per strand, any flag, most conflicts.

    The list names samples, so it is broadcast only as far as Spark's own size limit allows.
    """
    named = df.join(replicates.withColumnRenamed("replicate", "sample"), "sample", "left").withColumn("sample", F.coalesce("canonical", "sample"))
    keep = [c for c in df.columns if c not in ("rf", "af", "rr", "ar", "lt", "alen", "flt", "flt_dmg", *SITE, "sample")]
    return named.groupBy(*SITE, "sample").agg(
        *[F.min(c).alias(c) for c in ("rf", "af", "rr", "ar")], F.max("lt").alias("lt"), *[F.max(c).alias(c) for c in ("flt", "flt_dmg") if c in df.columns], *[F.first(c).alias(c) for c in keep]
    )


def cell_flags(df: DataFrame, o: JointOptions) -> DataFrame:
    """Adds flt and flt_dmg to cell rows (with ``ploidy``)."""
    short = F.coalesce(F.col("alen") < o.min_end_distance, F.lit(False))
    mixed = (F.col("ploidy") == 1) & (F.col("af") + F.col("ar") > 0) & (F.col("rf") + F.col("rr") > 0)
    return df.select("*", (mixed | (F.coalesce("lt", F.lit(0)) > o.max_conflicts) | short).alias("flt"), short.alias("flt_dmg"))


def cell_calls(df: DataFrame, o: JointOptions) -> DataFrame:
    """Adds is_alt, is_joint and is_dmg to flagged cell rows."""
    ref, alt = F.col("rf") + F.col("rr"), F.col("af") + F.col("ar")
    ok = ~F.col("flt")
    is_alt = ok & (alt >= o.min_alt) & (F.col("af") >= o.min_alt_strand) & (F.col("ar") >= o.min_alt_strand) & (alt >= (ref + alt) * o.min_balance)
    is_joint = ok & (alt >= o.min_joint) & (F.col("af") >= o.min_joint_strand) & (F.col("ar") >= o.min_joint_strand)
    apart = (F.col("af") * F.col("ar") == 0) & (F.col("rf") * F.col("af") == 0) & (F.col("rr") * F.col("ar") == 0)
    is_dmg = ~F.col("flt_dmg") & (alt >= o.min_damage) & (ref >= o.min_damage) & apart
    return df.select("*", is_alt.alias("is_alt"), is_joint.alias("is_joint"), is_dmg.alias("is_dmg"))


def bulk_sites(bulks: DataFrame, o: JointOptions) -> DataFrame:
    """Per site over its bulks: all het, all hom, all with a good alternative, a depth too low, bulks without the alternative, a difference between bulks."""
    ref, alt = F.col("rf") + F.col("rr"), F.col("af") + F.col("ar")
    dp = ref + alt
    both = (F.col("af") > 0) & (F.col("ar") > 0)
    het = both & (F.col("rf") > 0) & (F.col("rr") > 0) & (ref >= o.min_bulk_allele) & (alt >= o.min_bulk_allele) & (ref >= dp * o.bulk_balance) & (alt >= dp * o.bulk_balance)
    hom = ~het & both & (alt >= o.min_bulk_allele) & (ref <= o.max_bulk_alt)
    strong = (alt >= o.min_alt) & (F.col("af") >= o.min_alt_strand) & (F.col("ar") >= o.min_alt_strand)
    out = bulks.groupBy(*SITE).agg(
        F.count("*").alias("n_bulk"), F.every(het).alias("all_het"), F.every(hom).alias("all_hom"), F.every(alt >= o.min_bulk_allele).alias("all_good_alt"), F.some(dp < o.min_bulk_depth).alias("low"),
        F.count_if(alt <= o.max_bulk_alt).alias("n_ref"), (F.count_if(alt == 0) > 0).alias("_none"), (F.count_if(strong & (alt > 0)) > 0).alias("_some"),
    )
    return out.withColumn("differs", (F.col("n_bulk") > 1) & F.col("_none") & F.col("_some")).drop("_none", "_some")


def joint_sites(bulks: DataFrame, cells: DataFrame, o: JointOptions, known: DataFrame | None = None, quality: DataFrame | None = None) -> DataFrame:
    """One row a site with its flags before the window: flt_bulk, flt_snv, n_joint, usable.

    ``quality`` has (site, amq) with ``amq`` an array of RMS qualities; ``known``
    (chrom, pos) lists sites to flag.
    """
    open_ = ~F.col("flt")
    pooled = cells.groupBy(*SITE).agg(
        *[F.coalesce(F.sum(F.when(open_, F.col(c))), F.lit(0)).alias(c) for c in ("af", "ar")], F.count_if("is_joint").alias("n_joint"), F.count_if("is_dmg").alias("n_dmg")
    )
    df = bulk_sites(bulks, o).join(pooled, SITE)
    snv = (F.length("ref") == 1) & (F.length("alt") == 1)
    poor = F.lit(False)
    if quality is not None:
        df = df.join(quality.withColumnRenamed("amq", "_amq"), SITE, "left")
        poor = F.coalesce(F.exists("_amq", lambda x: x < o.min_amq), F.lit(False))
    flt_bulk = F.col("low") | ~snv | poor
    weak = (F.col("af") < o.min_alt_strand) | (F.col("ar") < o.min_alt_strand) | (F.col("af") + F.col("ar") < o.min_alt)
    df = df.withColumn("flt_bulk", flt_bulk).withColumn("flt_snv", ~snv | poor | (F.col("n_ref") == 0) | weak).withColumn("flt_known", F.lit(False))
    if known is not None:
        mark = known.select("chrom", "pos").distinct().withColumn("_k", F.lit(True))
        df = df.drop("flt_known").join(mark, ["chrom", "pos"], "left").withColumn("flt_known", F.coalesce("_k", F.lit(False))).drop("_k")
    return df.select(*SITE, "all_het", "all_hom", "all_good_alt", "differs", "n_ref", "n_joint", "n_dmg", "flt_bulk", "flt_snv", "flt_known")


def shared_cell_window(sites: DataFrame, cells: DataFrame, o: JointOptions) -> DataFrame:
    """Adds ``flt``: flagged before, or with another usable site nearby that shares a cell with the alternative."""
    usable = sites.filter("not all_good_alt")
    carriers = cells.filter("af + ar > 0").join(usable.select(*SITE), SITE, "left_semi").select(*SITE, "sample")
    close = near(carriers, ["chrom", "sample"], "pos", o.window, "_near").groupBy(*SITE).agg(F.max("_near").alias("_near"))
    out = usable.join(close, SITE, "left")
    return out.withColumn("flt", F.col("flt_snv") | F.col("flt_bulk") | F.col("flt_known") | F.coalesce("_near", F.lit(False))).drop("_near")


def bulk_difference_window(sites: DataFrame, o: JointOptions) -> DataFrame:
    """Sites where bulks differ, without another nearby and not flagged themselves."""
    return near(sites.filter("differs"), ["chrom"], "pos", o.window, "_near").filter(~(F.col("_near") | F.col("flt_bulk") | F.col("flt_known"))).drop("_near")


def call_codes(cells: DataFrame, o: JointOptions) -> DataFrame:
    """Adds ``code``: 1 het, 2 alternative only, 0 reference only; 4 and 3 for haploid cells, 6 and 5 with haploid bulks; '.' where filtered, empty or too weak."""
    ref, alt = F.col("rf") + F.col("rr"), F.col("af") + F.col("ar")
    none = F.col("flt") | (ref + alt == 0) | ((alt > 0) & (alt < o.min_joint))
    only = lambda bulk, cell, both: F.lit(bulk) if o.haploid_bulk else F.when(F.col("ploidy") == 1, cell).otherwise(both)
    return cells.withColumn("code", F.when(none, ".").when((alt > 0) & (ref > 0), "1").when(alt > 0, only("6", "4", "2")).otherwise(only("5", "3", "0")))


def damage_sites(sites: DataFrame) -> DataFrame:
    """Sites where damage counts: good bulks, one of them without the alternative, a biallelic substitution."""
    return sites.filter("not all_good_alt and n_ref > 0 and not flt_bulk and length(ref) = 1 and length(alt) = 1")


def cell_strings(cells: DataFrame, sites: DataFrame) -> DataFrame:
    """(sample, codes): each cell's codes over the given sites in order, in pieces a contig so that no row holds a genome."""
    held = cells.join(sites.select(*SITE), SITE, "left_semi")
    return held.groupBy("sample", "chrom").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ref", "alt", "code"))), lambda x: x["code"]), "").alias("codes"))


def cell_rates(sites: DataFrame, cells: DataFrame, calls: DataFrame, o: JointOptions) -> DataFrame:
    """Per cell: dropout, missed calls and damage on bulk-het sites (on homozygous ones with haploid bulks), calls, and counts corrected for misses.

    A haploid cell sees one of two alleles, so its rates are 2 x / n - 1.
    """
    ref, alt = F.col("rf") + F.col("rr"), F.col("af") + F.col("ar")
    het = sites.filter(f"{'all_hom' if o.haploid_bulk else 'all_het'} and not flt_bulk").select(*SITE, F.lit(True).alias("_het"))
    called = calls.select(*SITE, F.lit(True).alias("_called"))
    damaged = damage_sites(sites).select(*SITE, F.lit(True).alias("_open"))
    # one pass over the cells' rows
    rows = cells.join(het, SITE, "left").join(called, SITE, "left").join(damaged, SITE, "left")
    on = lambda c: F.coalesce(F.col("_het"), F.lit(False)) & c
    weak = lambda a, b: ~(~F.col("flt_dmg") & (F.col(a) >= o.min_damage) & (F.col(b) >= o.min_damage))
    out = rows.groupBy("sample").agg(
        F.count_if("_het").alias("n_het"), F.count_if(on(F.col("flt") | (ref < o.min_joint))).alias("ado_ref"), F.count_if(on(F.col("flt") | (alt < o.min_joint))).alias("ado_alt"), F.count_if(on(~F.col("is_alt"))).alias("fn"),
        F.count_if(on(weak("rf", "rr"))).alias("dmg_fn_ref"), F.count_if(on(weak("af", "ar"))).alias("dmg_fn_alt"), F.count_if(on((F.col("ploidy") > 1) & F.col("is_dmg"))).alias("dmg_fp"),
        F.count_if(F.coalesce("_called", F.lit(False)) & F.col("is_alt")).alias("snv"), F.count_if(F.coalesce("_open", F.lit(False)) & F.col("is_dmg")).alias("dmg"), F.max("ploidy").alias("_ploidy"),
    )
    share = lambda c: F.try_divide(F.col(c).cast("double"), F.col("n_het"))
    one = lambda c: share(c) if o.haploid_bulk else F.when(F.col("_ploidy") == 1, 2 * share(c) - 1).otherwise(share(c))
    corrected = F.try_divide(F.col("snv").cast("double"), 1 - one("fn"))
    damage = F.try_divide(F.col("dmg") - corrected * share("dmg_fp"), 1 - one("fn"))
    return out.select(
        "*", F.round(one("fn"), 4).alias("fn_rate"), F.round(corrected, 4).alias("snv_corrected"), F.round(damage, 4).alias("dmg_corrected"),
        one("ado_alt").alias("ado"), one("fn").alias("fnr"), corrected.alias("snv_exact"), share("dmg_fp").alias("dmg_fpr"), one("dmg_fn_alt").alias("dmg_fnr"), damage.alias("dmg_exact"),
    ).drop("_ploidy")
