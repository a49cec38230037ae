"""Pileup: reads to alleles per site and sample, votes, counts, genotypes, consensus.

Long form throughout: one row per observation, then per (site, sample, allele).
Samples are rows with a sample id, so a join of sorted inputs is a union and a
group; matrices of alleles by sample appear only when a site is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.reads import PILEUP_MASK, PROPER, REVERSE, base_code, code_base, has, rms

SITE = ["tid", "pos"]
ALLELE = ["is_alt", "base", "ins", "del_len"]


def usable(reads: DataFrame, min_mapq: int | Column = 0, mask: int = PILEUP_MASK) -> DataFrame:
    return reads.filter(~has("flag", mask) & (F.col("tid") >= 0) & (F.col("mapq") >= min_mapq))


def passing(
    reads: DataFrame, min_mapq: int | Column = 0, min_length: int = 0, min_supplementary: int = 0, max_clip: int | None = None, divergence: float = 1.0, mask: DataFrame | None = None, contigs: DataFrame | None = None
) -> DataFrame:
    """Usable alignments (with ``ops`` and ``nm``) that also pass the filters by aligned length, clips, divergence and a mask (chrom, beg, end).

    A ``divergence`` below one lowers the mapping quality of reads that differ
    more than it from the reference; the quality is tested before and after.
    """
    from helixframe.functions.reads import SUPPLEMENTARY, aligned_query_length, clip_length, poisson_mapq, reference_span

    from .intervals import overlapping

    df, length = usable(reads, min_mapq), aligned_query_length("ops")
    if min_length:
        df = df.filter(length >= min_length)
    if min_supplementary:
        df = df.filter(~has("flag", SUPPLEMENTARY) | (length >= min_supplementary))
    if max_clip is not None:
        df = df.filter(clip_length("ops") <= max_clip)
    if divergence < 1:
        df = df.withColumn("mapq", poisson_mapq("mapq", "nm", "ops", divergence)).filter(F.col("mapq") >= min_mapq)
    if mask is not None:
        ids = F.broadcast(contigs.select("tid", F.col("name").alias("_chrom")))  # a contig dictionary is bounded
        spans = df.join(ids, "tid").withColumn("_end", F.col("pos") + reference_span("ops"))
        keys = spans.select("seq", "sample", "_chrom", "pos", "_end") if "sample" in df.columns else spans.select("seq", "_chrom", "pos", "_end")
        hit = overlapping(keys, mask, "_chrom", "pos", "_end").select(*[c for c in ("seq", "sample") if c in keys.columns]).distinct()
        df = df.join(hit, hit.columns, "left_semi")
    return df


def by_depth(df: DataFrame, most: int, key: list[str]) -> DataFrame:
    """At most ``most`` reads that start at one position of a sample, the first in input order."""
    w = Window.partitionBy(*key, "tid", "pos").orderBy("seq")
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def exploded(reads: DataFrame) -> DataFrame:
    """One row per read and reference position of (seq, sample, flag, tid, pos, mapq, ops, bases, quals, frag).

    Carries base and quality, whether the position is deleted or skipped, the
    indel that follows it, and the distance to the nearer end of the aligned
    query. A column ``_strand`` stands for the strand of the flag. Counts alone
    need no row a base: see ``tiles``.
    """
    from helixframe.functions.reads import aligned_blocks

    df = reads.withColumn("_blocks", aligned_blocks("pos", "ops")).withColumn("_qlen", F.length("bases"))
    df = df.select("*", F.posexplode("_blocks").alias("_k", "_b")).filter(F.col("_b.op").isin("M", "=", "X", "D", "N"))
    after = F.try_element_at("_blocks", (F.col("_k") + 2).cast("int"))
    df = df.withColumn("_after", after).select("*", F.explode(F.sequence(F.lit(0), F.col("_b.len") - 1)).alias("_i"))
    gap, last = F.col("_b.op").isin("D", "N"), F.col("_i") == F.col("_b.len") - 1
    q = F.col("_b.query") + F.when(gap, 0).otherwise(F.col("_i"))
    ins = F.when(last & (F.col("_after.op") == "I"), F.substring(F.col("bases"), F.col("_after.query") + 1, F.col("_after.len")))
    deleted = F.when(last & (F.col("_after.op") == "D"), F.col("_after.len"))
    ends = F.aggregate(F.filter("_blocks", lambda x: x["op"] == "S"), F.lit(0), lambda t, x: t + F.when(x["query"] == 0, x["len"]).otherwise(0))
    tail = F.aggregate(F.filter("_blocks", lambda x: x["op"] == "S"), F.lit(0), lambda t, x: t + F.when(x["query"] > 0, x["len"]).otherwise(0))
    rev = F.col("_strand") if "_strand" in df.columns else has("flag", REVERSE)
    return df.select(
        "seq", "sample", "tid", (F.col("_b.ref") + F.col("_i")).alias("pos"), rev.alias("is_rev"), "mapq", "frag",
        F.when(~gap, F.upper(F.substring(F.col("bases"), q + 1, F.lit(1)))).alias("base"), F.when(~gap, F.try_element_at("quals", (q + 1).cast("int"))).alias("q"),
        gap.alias("is_del"), F.coalesce(ins, F.lit("")).alias("ins"), F.coalesce(deleted, F.lit(0)).alias("del_len"),
        F.greatest(F.lit(0), F.least(q - ends, F.col("_qlen") - tail - 1 - q)).alias("alen"), F.least(q, F.col("_qlen") - q).alias("from_end"),
    )


def kept(obs: DataFrame, min_q: int = 0, trim: int = 0) -> DataFrame:
    """Observations that are bases of enough quality, not within ``trim`` of an end of the read."""
    return obs.filter(~F.col("is_del") & (F.col("q") >= min_q) & (F.col("from_end") >= trim))


def strand(flag: Column, is_cell: Column) -> Column:
    """Strand in stranded mode: a second mate takes its mate's; null (dropped) for a cell's read outside a proper pair."""
    from helixframe.functions.reads import MATE_REVERSE, READ2

    of_pair = F.when(has(flag, READ2), has(flag, MATE_REVERSE)).otherwise(has(flag, REVERSE))
    return F.when(~is_cell, has(flag, REVERSE)).when(has(flag, PROPER), of_pair)


def vote(obs: DataFrame, allele: list[str] | None = None, frag: str = "frag", site: list[str] | None = None) -> DataFrame:
    """Adds ``dropped``: in a fragment with one allele strictly ahead, the reads of the others. Reads without a fragment stay.

    Counts per allele first, then ranks over the few alleles of a fragment, so a
    fragment's reads never meet in one task.
    """
    allele, site = allele or ["base"], site or [*SITE, "sample"]
    key = [*site, frag]
    counts = obs.filter(F.col(frag).isNotNull()).groupBy(*key, *allele).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*key)
    top = counts.withColumn("_max", F.max("_n").over(w)).withColumn("_ties", F.count_if(F.col("_n") == F.col("_max")).over(w))
    lost = top.filter((F.col("_ties") == 1) & (F.col("_n") < F.col("_max"))).select(*key, *allele).withColumn("_lost", F.lit(True))
    lost = lost.withColumnsRenamed({c: f"_k_{c}" for c in [*key, *allele]})
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*site, *allele]] + [F.col(frag) == F.col(f"_k_{frag}")]
    return obs.join(lost, on, "left").select(*obs.columns, F.coalesce("_lost", F.lit(False)).alias("dropped"))


def dropped_reads(voted: DataFrame, site: list[str] | None = None) -> DataFrame:
    """(site, dropped): reads that votes removed, over all samples of a site."""
    return voted.groupBy(*(site or SITE)).agg(F.count_if("dropped").alias("dropped")).filter("dropped > 0")


def allele_counts(obs: DataFrame, allele: list[str] | None = None, site: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(site, sample, allele, n, fwd, rev, raw, sum_mq2), and ``sum_alen`` if observations have ``alen``.

    Depths are reads, or the sums of the column ``weight``; ``raw`` counts reads.
    """
    q = F.least(F.col("mapq"), F.lit(60)).cast("long")
    one = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    extra = [F.sum("alen").cast("long").alias("sum_alen")] if "alen" in obs.columns else []
    return obs.groupBy(*(site or SITE), "sample", *(allele or ["base"])).agg(
        F.sum(one).alias("n"), F.sum(F.when(F.col("is_rev"), 0).otherwise(one)).alias("fwd"), F.sum(F.when(F.col("is_rev"), one).otherwise(0)).alias("rev"), F.count("*").alias("raw"), F.sum(q * q).alias("sum_mq2"), *extra
    )


def supported(counts: DataFrame, min_support: int, both_strands: int = 0, allele: list[str] | None = None, site: list[str] | None = None) -> DataFrame:
    """Counts of the alleles with enough support over all samples."""
    key = [*(site or SITE), *(allele or ["base"])]
    enough = (F.sum("n") >= min_support) & (F.sum("fwd") >= both_strands) & (F.sum("rev") >= both_strands)
    good = counts.groupBy(*key).agg(enough.alias("_ok")).filter("_ok").drop("_ok")
    return counts.join(good, key, "left_semi")


def variants_only(counts: DataFrame, site: list[str] | None = None) -> DataFrame:
    """Drop sites whose only allele is the reference (counts carry ``is_alt``)."""
    site = site or SITE
    return counts.join(counts.filter("is_alt").select(*site).distinct(), site, "left_semi")


def site_quality(counts: DataFrame, site: list[str] | None = None, allele: list[str] | None = None) -> DataFrame:
    """(site, qual): the greatest support over all samples of an alternative allele."""
    site = site or SITE
    total = counts.groupBy(*site, "is_alt", *[a for a in (allele or ["base"]) if a != "is_alt"]).agg(F.sum("n").alias("n"))
    return total.groupBy(*site).agg(F.coalesce(F.max(F.when(F.col("is_alt"), F.col("n"))), F.lit(0)).cast("long").alias("qual"))


def allele_mapq(counts: DataFrame, allele: list[str] | None = None, site: list[str] | None = None) -> DataFrame:
    """(site, allele, amq): root mean square mapping quality over samples."""
    agg = counts.groupBy(*(site or SITE), *(allele or ["base"])).agg(F.sum("sum_mq2").alias("s"), F.sum("raw").alias("n"))
    return agg.select(*(site or SITE), *(allele or ["base"]), rms("s", "n").alias("amq"))


def genotypes(counts: DataFrame, min_support: int, site: list[str] | None = None) -> DataFrame:
    """(site, sample, gt) from counts with an allele number ``a``: the two best supported alleles, best first, the smaller of equals.

    One supported allele is homozygous; a site without one is missing.
    """
    w = Window.partitionBy(*(site or SITE), "sample").orderBy(F.desc("n"), "a")
    top = counts.withColumn("_r", F.row_number().over(w)).filter("_r <= 2")
    pick = lambda r: F.max(F.when((F.col("_r") == r) & (F.col("n") >= min_support), F.col("a")))
    two = top.groupBy(*(site or SITE), "sample").agg(pick(1).alias("x"), pick(2).alias("y"))
    return two.select(*(site or SITE), "sample", F.when(F.col("x").isNull(), "./.").otherwise(F.concat_ws("/", "x", F.coalesce("y", "x"))).alias("gt"))


def consensus_base(counts: DataFrame, site: list[str] | None = None) -> DataFrame:
    """(site, base): the IUPAC code of all alleles of a site."""
    return counts.groupBy(*(site or SITE)).agg(code_base(F.bit_or(base_code("base").cast("int"))).alias("base"))


def majority_base(counts: DataFrame, site: list[str] | None = None) -> DataFrame:
    """(site, base): the best supported allele over samples, the first letter of equals."""
    total = counts.groupBy(*(site or SITE), "base").agg(F.sum("n").alias("n"))
    return total.groupBy(*(site or SITE)).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("base").alias("b"))).alias("x")).select(*(site or SITE), F.col("x.b").alias("base"))


def random_base(obs: DataFrame, seed: int = 11, site: list[str] | None = None) -> DataFrame:
    """(site, base) of one observation a site, chosen by a seeded hash of the read."""
    return obs.groupBy(*(site or SITE)).agg(F.min_by("base", F.xxhash64("seq", F.lit(seed))).alias("base"))


def softmask_cap(depths: DataFrame, factor: float = 3.0) -> DataFrame:
    """(tid, cap): greatest depth that is written in upper case, from (tid, pos, depth); no cap at 255 or over."""
    mean = depths.groupBy("tid").agg(F.avg("depth").alias("m"))
    cap = F.floor(F.col("m") + factor * F.sqrt("m") + 0.499).cast("long")
    return mean.select("tid", F.when(cap < 255, cap).alias("cap"))


def consensus(obs: DataFrame, counts: DataFrame, deleted: DataFrame, min_support: int = 1, factor: float = 3.0, same: str = "X", pick: str = "code", seed: int = 11, weight: str | None = None) -> DataFrame:
    """(tid, pos, base) of a consensus over supported ``counts`` by ``ALLELE`` of one sample, from its kept observations ``obs`` with ``ref``.

    ``pick`` is "code" (the IUPAC code of all alleles), "majority" or "random"
    (one read, by a seeded hash). A base equal to the reference is written as
    ``same``. Lower case is ambiguous (deletions (tid, pos, n) with enough
    support, more than two alleles or other letters) or deeper than the
    contig's mean and ``factor`` times its root.
    """
    one = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    alleles = counts.groupBy(*SITE).agg(F.count("*").alias("_k"), F.max("n").alias("_max"))
    depth = obs.join(counts.select(*SITE, *ALLELE), [*SITE, *ALLELE], "left_semi")
    at = depth.groupBy(*SITE).agg(F.sum(one).alias("depth"), F.first("ref").alias("ref"))
    chosen = {"code": consensus_base, "majority": majority_base}.get(pick)
    bases = chosen(counts) if chosen else random_base(depth, seed)
    df = at.join(bases, SITE).join(alleles, SITE).join(deleted.withColumnRenamed("n", "_del"), SITE, "left").na.fill(0, ["_del"])
    clear = F.col("base").isin("A", "C", "G", "T")
    base = F.col("base") if pick == "code" else F.when(clear, F.col("base")).otherwise("N")
    unsure = {"code": (F.col("_del") >= min_support) | (F.col("_k") > 2), "majority": (F.col("_del") > F.col("_max")) | ~clear}.get(pick, ~clear)
    df = df.join(F.broadcast(softmask_cap(df.select("tid", "pos", "depth"), factor)), "tid")
    letter = F.when(F.col("ref").isin("A", "C", "G", "T") & (base == F.col("ref")), same).otherwise(base)
    low = unsure | F.coalesce(F.col("depth") > F.col("cap"), F.lit(False))
    return df.select("tid", "pos", F.when(low, F.lower(letter)).otherwise(letter).alias("base"))


def consensus_fasta(bases: DataFrame, contigs: DataFrame, width: int = 60, chunk: int = 60_000) -> DataFrame:
    """(tid, chunk, lines) of FASTA text for contigs with bases: ``n`` in gaps, ``N`` behind the last base, chunks of whole lines so that a contig is never one row."""
    last = bases.groupBy("tid").agg(F.max("pos").alias("_last"))
    starts = contigs.join(last, "tid").select("tid", "len", "_last", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("len") - 1).cast("long"), F.lit(chunk).cast("long"))).alias("beg"))
    held = bases.select("tid", (F.col("pos") - F.col("pos") % chunk).cast("long").alias("beg"), "pos", "base").groupBy("tid", "beg").agg(F.map_from_entries(F.collect_set(F.struct((F.col("pos") % chunk).cast("int"), "base"))).alias("m"))
    span = F.least(F.lit(chunk), F.col("len") - F.col("beg")).cast("int")
    letters = F.transform(F.sequence(F.lit(0), span - 1), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.when(F.col("beg") + i > F.col("_last"), "N").otherwise("n")))
    text = F.array_join(letters, "")
    lines = F.regexp_replace(text, f"(.{{{width}}})(?=.)", "$1\n")
    return starts.join(held, ["tid", "beg"], "left").select("tid", (F.col("beg") / chunk).cast("long").alias("chunk"), lines.alias("lines"))


def placed(reads: DataFrame) -> DataFrame:
    """A row per read and position; reads with a barcode know their fragment."""
    return exploded(reads.withColumn("frag", fragment_of()))


def fragment_of() -> Column:
    """The fragment of an alignment with a barcode."""
    from helixframe.functions.reads import fragment_id, reference_span

    return F.when(F.coalesce("bc", "bf").isNotNull(), fragment_id("flag", "pos", reference_span("ops"), "isize"))


def deletions(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """(tid, pos, n): reads, or their ``weight``, that delete a position."""
    one = F.lit(1).cast("long") if weight is None else F.coalesce(F.col(weight), F.lit(0)).cast("long")
    return rows.filter("is_del").groupBy(*SITE).agg(F.sum(one).alias("n"))


def against(obs: DataFrame, ref: DataFrame, contigs: DataFrame) -> DataFrame:
    """Adds ``ref`` and ``is_alt`` to observations, by the reference line that holds their position."""
    lines = ref.join(F.broadcast(contigs.select("name", "tid")), "name").select("tid", F.col("start").alias("_s"), "bases")
    width = lines.groupBy("tid").agg(F.max(F.length("bases")).cast("long").alias("_w"))  # lines of a sequence have one length
    obs = obs.join(F.broadcast(width), "tid").withColumn("_s", (F.col("pos") - F.col("pos") % F.col("_w")).cast("long"))
    obs = obs.join(lines, ["tid", "_s"]).withColumn("ref", F.upper(F.substring(F.col("bases"), (F.col("pos") - F.col("_s") + 1).cast("int"), F.lit(1))))
    differs = (F.col("base") != F.col("ref")) | (F.col("ins") != "") | (F.col("del_len") > 0)
    return obs.withColumn("is_alt", differs).drop("_s", "_w", "bases")


def vcf_sites(counts: DataFrame, ref: DataFrame, contigs: DataFrame, samples: list[str], min_support: int = 1, dropped: DataFrame | None = None, cells: list[str] | None = None) -> DataFrame:
    """Sites (chrom, pos, ref, alt, qual, amq, samples) from counts by (site, sample, ALLELE): alleles in order of base, insertion and deletion, REF first, its depths zero where it is absent.

    A sample has gt, adf, adr and ad, and, if ``cells`` names some, ltdrop (reads
    that votes removed at the site, from (site, dropped)) and alen (mean distance
    to the read's end of each allele that the site has), both null for the others.
    """
    from helixframe.sources.text import fetch

    key = [*SITE, *ALLELE]
    alleles = counts.groupBy(*key).agg(F.sum("raw").alias("n"), F.sum("sum_mq2").alias("s"))
    span = alleles.groupBy(*SITE).agg((F.max("del_len") + 1).alias("_len"))
    names = F.broadcast(contigs.select("tid", "name"))
    wanted = span.join(names, "tid").select("tid", "pos", "name", F.col("pos").cast("long").alias("beg"), (F.col("pos") + F.col("_len")).cast("long").alias("end"))
    text = wanted.join(fetch(ref, wanted.select("name", "beg", "end").distinct()), ["name", "beg", "end"]).select("tid", "pos", "name", F.upper("bases").alias("ref"))
    w = Window.partitionBy(*SITE).orderBy("base", F.length("ins"), "ins", "del_len")
    alts = alleles.filter("is_alt").withColumn("a", F.row_number().over(w))
    numbered = alts.unionByName(alleles.filter("not is_alt").withColumn("a", F.lit(0)))
    held = counts.join(numbered.select(*key, "a"), key)
    gt = genotypes(held, min_support)
    by_allele = lambda c: F.map_from_entries(F.collect_list(F.struct("a", c)))
    mean = F.try_divide(F.col("sum_alen").cast("double"), F.col("n")) if "sum_alen" in counts.columns else F.lit(None).cast("double")
    depth = held.groupBy(*SITE, "sample").agg(by_allele("fwd").alias("f"), by_allele("rev").alias("r"), by_allele("n").alias("d"), by_allele(mean.alias("x")).alias("l"))
    shown = F.concat("base", "ins", F.expr("substring(ref, 2 + del_len)"))
    site = numbered.join(text, SITE).groupBy(*SITE, "name", "ref").agg(
        F.max("a").alias("last"), F.min("a").alias("least"), F.transform(F.sort_array(F.collect_list(F.when(F.col("a") > 0, F.struct("a", shown.alias("x"))))), lambda e: e["x"]).alias("alt"),
        F.map_from_entries(F.collect_list(F.struct("a", rms("s", "n").alias("q")))).alias("amq"),
    )
    numbers = F.sequence(F.lit(0), F.col("last"))
    own = F.sequence(F.col("least"), F.col("last"))
    fill = lambda m: F.transform(numbers, lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0)).cast("int"))
    zeros = F.transform(numbers, lambda i: F.lit(0))
    is_cell = F.col("sample").isin(*(cells or []))
    rows = depth.join(gt, [*SITE, "sample"]).join(site.select(*SITE, "last", "least"), SITE)
    alen = F.when(is_cell, F.transform(own, lambda i: F.try_element_at(F.col("l"), i)))
    rows = rows.select(*SITE, "sample", F.struct("gt", fill(F.col("f")).alias("adf"), fill(F.col("r")).alias("adr"), fill(F.col("d")).alias("ad"), alen.alias("alen")).alias("cell"))
    cells_of = rows.groupBy(*SITE).agg(F.map_from_entries(F.collect_list(F.struct("sample", "cell"))).alias("cells"))
    out = site.join(cells_of, SITE).join(site_quality(counts, SITE, ALLELE), SITE)
    lost = dropped if dropped is not None else out.select(*SITE).limit(0).withColumn("dropped", F.lit(0))
    out = out.join(lost, SITE, "left")

    def of(s: str) -> Column:
        cell = bool(cells) and s in cells
        empty = F.transform(own, lambda i: F.lit(None).cast("double")) if cell else F.lit(None).cast("array<double>")
        found = F.try_element_at("cells", F.lit(s))
        one = lambda f, other: F.coalesce(found[f], other).alias(f)
        return F.struct(one("gt", F.lit("./.")), one("adf", zeros), one("adr", zeros), one("ad", zeros), (F.coalesce("dropped", F.lit(0)) if cell else F.lit(None)).cast("int").alias("ltdrop"), one("alen", empty))

    amq = F.transform(numbers, lambda i: F.try_element_at(F.col("amq"), i))
    return out.select(F.col("name").alias("chrom"), "pos", "ref", "alt", "qual", amq.alias("amq"), F.array(*map(of, samples)).alias("samples"))


def summary_lines(counts: DataFrame, ref: DataFrame, contigs: DataFrame, samples: list[str], min_support: int = 1, both_strands: bool = False) -> DataFrame:
    """(chrom, pos, value): the site, its reference base, its alleles (``A``, ``A+2AC``, ``A-1T``) and each sample's genotype and depths."""
    from helixframe.sources.text import fetch

    key = [*SITE, *ALLELE]
    alleles = counts.select(*key).distinct()
    longest = alleles.groupBy(*SITE).agg((F.max("del_len") + 1).alias("_len"))
    names = F.broadcast(contigs.select("tid", "name"))
    wanted = longest.join(names, "tid").select("tid", "pos", "name", F.col("pos").cast("long").alias("beg"), (F.col("pos") + F.col("_len")).cast("long").alias("end"))
    text = wanted.join(fetch(ref, wanted.select("name", "beg", "end").distinct()), ["name", "beg", "end"]).select("tid", "pos", "name", F.upper("bases").alias("_ref"))
    w = Window.partitionBy(*SITE).orderBy("is_alt", "base", F.length("ins"), "ins", "del_len")
    shown = F.concat(F.col("base"), F.when(F.col("ins") != "", F.concat(F.lit("+"), F.length("ins"), F.col("ins"))).when(F.col("del_len") > 0, F.concat(F.lit("-"), F.col("del_len"), F.expr("substring(_ref, 2, del_len)"))).otherwise(""))
    numbered = alleles.withColumn("a", F.row_number().over(w) - 1).join(text, SITE).withColumn("shown", shown)
    held = counts.join(numbered.select(*key, "a"), key)
    gt = genotypes(held, min_support)
    by_allele = lambda c: F.map_from_entries(F.collect_list(F.struct("a", c)))
    cells = held.groupBy(*SITE, "sample").agg(by_allele("n").alias("n"), by_allele("fwd").alias("f"), by_allele("rev").alias("r")).join(gt, [*SITE, "sample"])
    cells = cells.groupBy(*SITE).agg(F.map_from_entries(F.collect_list(F.struct("sample", F.struct("gt", "n", "f", "r")))).alias("cells"))
    site = numbered.groupBy(*SITE, "name", "_ref").agg(F.max("a").alias("last"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a", "shown"))), lambda x: x["shown"]), ",").alias("shown")).join(cells, SITE)
    depths = lambda m: F.array_join(F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0)).cast("string")), ",")

    def of(s: str) -> Column:
        c = F.try_element_at("cells", F.lit(s))
        counted = [depths(c["f"]), depths(c["r"])] if both_strands else [depths(c["n"])]
        return F.concat_ws(":", F.coalesce(c["gt"], F.lit("./.")), *counted)

    value = F.concat_ws("\t", "name", (F.col("pos") + 1).cast("string"), F.substring("_ref", 1, 1), "shown", *map(of, samples))
    return site.select(F.col("name").alias("chrom"), "pos", value.alias("value"))
