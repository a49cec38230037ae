"""Tagged text records of the callers: bulk against cells, and joint calls.

Every record is a row (part, chrom, pos, value); ``part`` puts what belongs
together in order: sites first, then totals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import joint, variants

SHAPE = "part int, chrom string, pos int, value string"


def _line(*cells: Column | str) -> Column:
    return F.concat_ws("\t", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(".")) for c in cells])


def _sites(df: DataFrame, part: int, tag: str, *cells: Column | str) -> DataFrame:
    return df.select(F.lit(part).alias("part"), "chrom", F.col("pos").cast("int").alias("pos"), _line(F.lit(tag), "chrom", "pos", "ref", "alt", *cells).alias("value"))


def _total(df: DataFrame, part: int, *cells: Column | str) -> DataFrame:
    return df.select(F.lit(part).alias("part"), F.lit("").alias("chrom"), F.lit(0).alias("pos"), _line(*cells).alias("value"))


def _texts(spark: SparkSession, part: int, texts: list[str]) -> DataFrame:
    return spark.createDataFrame([(part, "", k, t) for k, t in enumerate(texts)], SHAPE)


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def fixed(x: Column, places: int) -> Column:
    """A number with so many decimals; NaN without one, as for a ratio without a denominator."""
    return F.when(x.isNull(), "NaN").otherwise(F.format_string(f"%.{places}f", x))


def diff_records(flagged: DataFrame, o: variants.DiffOptions, cells: int = 1, true_positives: bool = False) -> DataFrame:
    """NV of novel variants, TP of bulk-heterozygous sites that are called if asked for, then NE, VN, RO, AO, BO and NN."""
    pooled = lambda c: F.col(f"c_{c}") + (F.col(f"d_{c}") if cells > 1 else 0)
    conflicts = F.coalesce("c_lt", F.lit(0)) + (F.coalesce("d_lt", F.lit(0)) if cells > 1 else F.lit(0))
    info = F.col("info") if "info" in flagged.columns else F.lit(".")
    found = variants.novel(flagged, o)
    parts = [_sites(found, 0, "NV", "kind", pooled("rf") + pooled("rr"), pooled("af") + pooled("ar"), conflicts, info)]
    if true_positives and not o.haploid:
        parts.append(_sites(flagged.filter("het and called"), 0, "TP", "kind", F.col("b_rf") + F.col("b_rr"), F.col("b_af") + F.col("b_ar")))
    n = variants.rates(flagged)
    share = lambda c: fixed(F.try_divide(F.col(c).cast("double"), F.col("n_het")), 4)
    parts += [_total(n, 1, F.lit("NE"), "n_het"), _total(n, 2, F.lit("VN"), "n_fn", share("n_fn")), _total(n, 4, F.lit("AO"), "n_ado_alt", share("n_ado_alt"))]
    if not o.haploid:
        parts += [_total(n, 3, F.lit("RO"), "n_ado_ref", share("n_ado_ref")), _total(n, 5, F.lit("BO"), "n_ado_both", share("n_ado_both"))]
    return _all([*parts, _total(variants.tallies(found), 6, F.lit("NN"), "n_snv", "n_snv_nonct", "n_del", "n_ins")])


# What the tags of joint records stand for.
LEGEND = [
    "CC\tSM  sample name (each sample)", "CC\tNV  somatic SNVs", "CC\tNN  number of called somatic SNVs (each)", "CC\tNR  false negative rate (each)",
    "CC\tNC  number of somatic SNVs after FNR correction (each)", "CC\tNA  alignment somatic SNVs", "CC\tDV  DNA damages or amplification errors",
    "CC\tDN  number of called damages/errors (each)", "CC\tDR  false negative rate of damages/errors (each)", "CC\tDC  number of damages/errors after FNR correction (each)", "CC",
]


def _hits(df: DataFrame, names: list[str], keep: Column, text: Column, out: str) -> DataFrame:
    """(site, out): texts of the rows of each site that ``keep`` holds for, samples in order of ``names``; a site has a row a sample."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col("sample"))
    rows = F.sort_array(F.collect_list(F.when(keep, F.struct(place.alias("k"), text.alias("t")))))
    return df.groupBy(*joint.SITE).agg(F.transform(rows, lambda x: x["t"]).alias(out))


def joint_records(bulks: DataFrame, cells: DataFrame, o: joint.JointOptions, names: list[str], bulk_names: list[str], quality: DataFrame | None = None, known: DataFrame | None = None, command: str = "joint", version: str = "1") -> DataFrame:
    """CL, VN, CC and SM, then by site BV, DV, NV and JV, then NN, NR, NC, DN, DP, DR, DC with a value a cell, and NA of each cell.

    ``bulks`` and ``cells`` are rows a site and sample (cells flagged and
    called); ``names`` and ``bulk_names`` give the order of samples.
    """
    spark = cells.sparkSession
    sites = joint.joint_sites(bulks, cells, o, known, quality)
    win = joint.shared_cell_window(sites, cells, o)
    bulk_ref, bulk_alt = F.col("rf") + F.col("rr"), F.col("af") + F.col("ar")
    total = bulks.groupBy(*joint.SITE).agg(F.sum(bulk_ref).alias("b0"), F.sum(bulk_alt).alias("b1"))
    each = _hits(bulks, bulk_names, F.lit(True), bulk_alt.cast("string"), "alts")
    strands = lambda a, b: F.concat_ws(":", F.col(a).cast("string"), F.col(b).cast("string"))
    named = lambda *x: F.concat_ws(":", "sample", *x)
    shown = F.when(F.col("b1") == 0, "0").otherwise(F.array_join("alts", ":"))
    open_ = win.filter("not flt").select(*joint.SITE, "n_joint")
    at_open = cells.join(open_, joint.SITE).withColumn("alt_depth", bulk_alt)
    text = named(F.col("af").cast("string"), F.col("ar").cast("string"))
    novel = _hits(at_open, names, F.col("is_alt") & ~F.col("flt"), text, "hits").filter("size(hits) > 0")
    shared = _hits(at_open.filter("n_joint >= 2"), names, F.col("alt_depth") >= o.min_joint, text, "hits").filter("size(hits) > 0")
    with_bulks = lambda df: df.join(total, joint.SITE).join(each, joint.SITE)
    parts = [
        _texts(spark, 0, [f"CL\t{command}", f"VN\t{version}", *LEGEND, "\t".join(["SM", *names])]),
        _sites(with_bulks(novel), 1, "NV", "b0", shown, F.size("hits"), F.array_join("hits", "\t")),
        _sites(with_bulks(shared), 1, "JV", "b0", shown, F.size("hits"), F.array_join("hits", "\t")),
    ]
    if len(bulk_names) > 1 and not o.haploid_bulk:
        apart = joint.bulk_difference_window(sites, o).select(*joint.SITE)
        parts.append(_sites(_hits(bulks.join(apart, joint.SITE, "left_semi"), bulk_names, F.lit(True), strands("af", "ar"), "ads"), 1, "BV", F.array_join("ads", "\t")))
    damaged = joint.damage_sites(sites).filter("not flt_known").select(*joint.SITE)
    depths = F.concat_ws(":", F.concat_ws(",", "rf", "af"), F.concat_ws(",", "rr", "ar"))
    hits = _hits(cells.join(damaged, joint.SITE, "left_semi"), names, F.col("is_dmg"), named(depths), "hits").filter("size(hits) > 0")
    parts.append(_sites(hits.join(_hits(bulks, bulk_names, F.lit(True), depths, "each"), joint.SITE), 1, "DV", F.array_join("each", ";"), F.size("hits"), F.array_join("hits", "\t")))

    stats = joint.cell_rates(sites, cells, win.filter("not flt"), o)
    place = F.array_position(F.array(*map(F.lit, names)), F.col("sample"))

    def row(part: int, tag: str, value: Column) -> DataFrame:  # a value a cell: a bounded list of samples
        one = stats.agg(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("k"), value.cast("string").alias("v")))), lambda x: x["v"]).alias("v"))
        return _total(one, part, F.lit(tag), F.array_join("v", "\t"))

    parts += [row(2, "NN", F.col("snv")), row(3, "NR", fixed(F.col("fnr"), 4)), row(4, "NC", fixed(F.col("snv_exact"), 2)), row(5, "DN", F.col("dmg"))]
    if not o.haploid_bulk:
        parts += [row(6, "DP", fixed(F.col("dmg_fpr"), 4)), row(7, "DR", fixed(F.col("dmg_fnr"), 4)), row(8, "DC", fixed(F.col("dmg_exact"), 2))]
    strings = joint.cell_strings(joint.call_codes(cells, o), win.filter("not flt and n_joint >= 2"))
    whole = strings.groupBy("sample").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chrom", "codes"))), lambda x: x["codes"]), "").alias("codes"))
    na = stats.join(whole, "sample", "left").select(F.lit(9).alias("part"), F.lit("").alias("chrom"), place.cast("int").alias("pos"), _line(F.lit("NA"), "sample", fixed(F.col("ado"), 4), F.coalesce("codes", F.lit(""))).alias("value"))
    return _all([*parts, na])



def in_order(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Records with the columns that order them: by part and site, a site's tags as listed here."""
    return df.withColumn("k", F.instr(F.lit("BV DV NV TP JV"), F.substring("value", 1, 2))), ["part", "chrom", "pos", "k"]
