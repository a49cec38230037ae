"""Command line: ``python -m helixframe COMMAND ... -o OUT`` reads the usual files and writes text parts to a folder."""

from __future__ import annotations

import argparse
import shutil
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import reads as R
from helixframe.operators import cnv, coverage, dedup, fragments, intervals, joint, pileup, sv, sweep, tiles, trim, variants
from helixframe.operators.stages import checkpoint_folder, settled
from helixframe.sources import bam, ranges, text

from . import records


def alignments(spark: SparkSession, path: str, index: str | None = None, region: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(reads, contigs) of a BAM or SAM file; of a BAM file with an index only the chunks of the region, if one is given."""
    if path.endswith(".sam"):
        contigs = text.sam_contigs(spark, path)
        return text.read_sam(spark, path, contigs), contigs
    reads = bam.read_bam(spark, path, *((index, region) if index and region else ())).withColumn("ops", R.cigar_ops(F.coalesce("cigar", F.lit(""))))
    return reads.withColumn("rlen", R.reference_span("ops")).withColumn("qual", F.array_join(F.transform("quals", lambda q: F.char(q + 33)), "")), bam.bam_contigs(spark, path)


def depth_of(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """(chrom, st, en, depth) of usable reads."""
    rows = pileup.usable(reads).join(F.broadcast(contigs.select("tid", F.col("name").alias("chrom"))), "tid")
    return sweep.depth(rows.withColumn("en", F.col("pos") + F.col("rlen")), ["chrom"], "pos", "en")


def run(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, list[str]]:
    """The lines of a command, with the columns that order them."""
    return COMMANDS[a.command](spark, a)


def run_trim(spark, a):
    o = trim.TrimOptions(barcode=a.barcode, min_length=a.length)
    done = trim.trim(text.read_pairs(spark, a.input), o)
    if a.table:
        return text_of(done.select("pair_id", F.concat_ws("\t", "name", F.col("type").cast("string")).alias("value")), "pair_id")
    return text_of(trim.fastq_lines(done), "pair_id", "mate")


def run_dedup(spark, a):
    reads, contigs = alignments(spark, a.input)
    marked = settled(dedup.mark_duplicates(reads))
    counts = dedup.fragment_counts(marked).collect()  # a row with and one without barcodes
    for r in counts:
        print(f"{'with' if r['has_bc'] else 'without'} barcode: {r['fragments']} fragments, {r['duplicates']} duplicates, {r['unpaired']} unpaired", file=sys.stderr)
    return text_of(text.sam_header(contigs).unionByName(text.sam_lines(marked, contigs)), "seq")


def run_group(spark, a):
    reads, contigs = alignments(spark, a.input)
    o = {"fuzz": a.fuzz, "fuzz_st": a.fuzz_start, "fuzz_len": a.fuzz_length, "tn5": a.shared}
    found = fragments.fragments(fragments.grouped(fragments.read_ends(reads)), a.min_frag)
    return tabbed(fragments.fragment_bed(fragments.merged(found, not a.no_merge, **o), contigs), "chrom", "st", "en")


def run_count(spark, a):
    frags = text.read_fragments(spark, a.input).withColumnRenamed("chrom", "tid")
    frags = frags.withColumn("mq", F.coalesce("mq", F.lit(0)))
    ids = frags.select("tid").distinct().select("tid", F.xxhash64("tid").alias("k"))
    n1, _, n2 = a.n1.partition(",")
    out = fragments.count_depth(frags.join(ids, "tid").drop("tid").withColumnRenamed("k", "tid"), int(n1), int(n2) if n2 else 2 * int(n1), a.min_mq, not a.no_merge)
    out = settled(out)
    for r in sweep.histogram(out, "d0").orderBy("depth").collect():  # eleven rows at most
        print(f"H\t{r['depth']}\t{r['bases']}", file=sys.stderr)
    return tabbed(out.join(ids.withColumnsRenamed({"tid": "chrom", "k": "tid"}), "tid").select("chrom", "st", "en", "d0", "d1", "d2"), "chrom", "st")


def run_cnv(spark, a):
    gaps = text.read_bed(spark, a.bed) if a.bed else None
    segments = settled(cnv.split_long(text.read_depth(spark, a.input, gaps), a.split))
    return text_of(cnv.record_lines(segments, *cnv.call(segments, a.penalty, a.ploidy, a.p_value), evidence=a.evidence, ploidy=a.ploidy), "part", "kind", "chrom", "st", "k")


def run_sv(spark, a):
    reads, contigs = alignments(spark, a.input)
    b = settled(sv.breakpoints(sv.split_sides(reads, contigs, a.min_mapq, a.max_nm), contigs))
    if a.breakpoints:
        return tabbed(b, "mid")
    return text_of(sv.record_lines(*sv.calls(b, contigs, a.gap, a.min_count), contigs), "cluster", "sub", "k", "seq")


def _pair(given: str) -> tuple[int, int]:
    """``bulk`` or ``bulk,cell`` thresholds."""
    one, _, two = given.partition(",")
    return int(one), int(two or one)


def run_pileup(spark, a):
    o = vars(a)
    if a.preset_y:
        o |= {"min_q": "20,30", "min_mapq": "20,30", "min_support": 5, "both_strands": True}
    if a.preset_u:
        o |= {"min_q": "3", "min_mapq": "20", "quality_depth": True, "min_supplementary": 300, "min_support": 5, "divergence": 0.01}
    a.fasta = a.fasta or a.majority or a.random
    if a.fasta and a.calls:
        raise SystemExit("-F does not go with -c")
    if a.majority and a.random:
        raise SystemExit("-M does not go with -R")
    if a.calls and not a.reference:
        raise SystemExit("-c needs a reference")
    inputs = a.inputs[:1] if a.fasta else a.inputs
    names = [str(k) for k in range(len(inputs))]
    cells = names[len(names) - min(a.cells, len(names)) :] if a.cells else []
    is_cell = F.col("sample").isin(cells) if cells else F.lit(False)
    by_class = lambda given: (lambda b, c: F.when(is_cell, c).otherwise(b))(*_pair(given))

    parts = [alignments(spark, p, a.index, a.region) for p in inputs]
    contigs = parts[0][1]
    reads = parts[0][0].withColumn("sample", F.lit("0"))
    for k, (r, _) in enumerate(parts[1:], 1):
        reads = reads.unionByName(r.withColumn("sample", F.lit(str(k))), allowMissingColumns=True)
    mask = text.read_bed(spark, a.bed) if a.bed else None
    reads = pileup.passing(reads, by_class(a.min_mapq), a.min_length, a.min_supplementary, a.max_clip, a.divergence, mask, contigs)
    if a.max_depth:
        reads = pileup.by_depth(reads, a.max_depth, ["sample"])
    if a.stranded:
        reads = reads.withColumn("_rev", pileup.strand(F.col("flag"), is_cell & F.coalesce("bc", "bf").isNotNull() & R.has("flag", R.PAIRED))).filter("_rev is not null").withColumn("_strand", F.col("_rev")).drop("_rev")
    ref = settled(text.read_fasta(spark, a.reference)) if a.reference else no_reference(contigs)

    def inside(rows: DataFrame) -> DataFrame:
        """Rows with (tid, pos) in the region and the mask, if any."""
        if a.region:
            name, beg, end = intervals.parse_region(a.region)
            rows = rows.join(F.broadcast(contigs.filter(F.col("name") == name).select("tid")), "tid").filter(F.col("pos").between(beg, end - 1))
        if mask is not None:
            at = rows.join(F.broadcast(contigs.select("tid", F.col("name").alias("_c"))), "tid").withColumn("_e", F.col("pos") + 1)
            rows = intervals.overlapping(at, mask, "_c", "pos", "_e").drop("_c", "_e")
        return rows

    weight, dropped = "q" if a.quality_depth else None, None
    support = lambda found: settled(pileup.supported(found, max(1, a.min_support), 0, pileup.ALLELE))
    if a.fasta:  # a consensus also picks reads and deletions
        placed = settled(inside(pileup.placed(reads)))
        obs = pileup.against(pileup.kept(placed, by_class(a.min_q), a.trim), ref, contigs)
        if cells:
            obs = settled(pileup.vote(obs.withColumn("frag", F.when(is_cell, F.col("frag"))), pileup.ALLELE)).filter("not dropped").drop("dropped")
        counts = support(pileup.allele_counts(obs, pileup.ALLELE, weight=weight))
    else:
        found, lost = tiles.counted(reads, by_class(a.min_q), a.trim, F.when(is_cell, pileup.fragment_of()), weight)
        dropped = inside(lost) if cells else None
        counts = support(pileup.against(inside(found), ref, contigs).drop("ref"))
    if a.fasta:
        pick = "majority" if a.majority else "random" if a.random else "code"
        bases = pileup.consensus(obs, counts, pileup.deletions(placed, weight), a.min_support, a.deviation, a.same.upper()[:1], pick, weight=weight)
        body = pileup.consensus_fasta(settled(bases), contigs).select("tid", "chunk", F.col("lines").alias("value"))
        head = body.select("tid").distinct().join(F.broadcast(contigs.select("tid", "name")), "tid").select("tid", F.lit(-1).cast("long").alias("chunk"), F.concat(F.lit(">"), "name").alias("value"))
        return text_of(head.unionByName(body), "tid", "chunk")
    if a.variants or a.calls:
        counts = pileup.variants_only(counts)
    ids = F.broadcast(contigs.select(F.col("name").alias("chrom"), "tid"))
    if not a.calls:
        return text_of(pileup.summary_lines(counts, ref, contigs, names, a.min_support, a.both_strands).join(ids, "chrom"), "tid", "pos")
    sites = pileup.vcf_sites(counts, ref, contigs, names, a.min_support, dropped, cells)
    size = [(r["name"], r["len"]) for r in contigs.orderBy("tid").collect()]  # a contig dictionary is bounded
    head = text.vcf_header(inputs, size, a.reference, a.both_strands, bool(cells))
    top = spark.createDataFrame([(-1, k, line) for k, line in enumerate(head)], "tid long, pos int, value string")
    return text_of(top.unionByName(text.vcf_lines(sites, a.both_strands, bool(cells)).join(ids, "chrom").select(F.col("tid").cast("long").alias("tid"), "pos", "value")), "tid", "pos")


def no_reference(contigs: DataFrame) -> DataFrame:
    """A reference of N for contigs, in lines of 1000."""
    at = contigs.select("name", "len", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("len") - 1).cast("long"), F.lit(1000).cast("long"))).alias("start"))
    return at.select("name", "start", F.repeat(F.lit("N"), F.least(F.lit(1000), F.col("len") - F.col("start")).cast("int")).alias("bases"))


def _mask(spark, a):
    if not a.bed:
        raise SystemExit("a BED file of the positions that count is needed (-b)")
    return intervals.union(text.read_bed(spark, a.bed))


def run_lorenz(spark, a):
    hist = coverage.coverage_histogram(depth_of(*alignments(spark, a.input)), _mask(spark, a))
    points = coverage.lorenz(hist, a.step).select(*[F.format_string("%.6f", c).alias(c) for c in ("genome", "bases")])
    return tabbed(points, "genome", "bases")


def run_cv(spark, a):
    segments = text.read_depth_column(spark, a.input) if a.depth else depth_of(*alignments(spark, a.input))
    cv = coverage.bin_variation(coverage.mask_runs(segments, _mask(spark, a)))
    return text_of(cv.select("width", F.concat_ws("\t", F.col("width").cast("string"), records.fixed(F.col("cv"), 6)).alias("value")), "width")


def run_diff(spark, a):
    vcf = text.read_vcf(spark, a.input)
    names = a.samples.split(",") if a.samples else text.vcf_samples(spark, a.input)[:3]
    names = names[:2] if a.first else names[:3]
    o = variants.DiffOptions(
        min_mapq=a.min_mapq, min_bulk_depth=a.bulk_depth, min_bulk_allele=a.bulk_allele, min_bulk_balance=a.bulk_balance, min_alt=a.min_alt, min_alt_strand=a.alt_strand, min_alt_balance=a.alt_balance,
        max_conflicts=a.conflicts, distance=a.distance, max_bulk_alt=a.bulk_alt, max_haploid_error=a.haploid_error, haploid=a.haploid, pair=a.pair, indels=a.indels,
    )
    flagged = settled(variants.sites(_by_sample(vcf, names), o, len(names) - 1))
    return records.in_order(records.diff_records(flagged, o, len(names) - 1, a.true_positives))


def _by_sample(vcf: DataFrame, names: list[str]) -> DataFrame:
    """A row a site with the depths of the bulk (b) and one or two cells (c, d); one pass, no joins."""
    part = lambda c, k: F.coalesce(F.try_element_at(c, F.lit(k)), F.lit(0))
    values = {"rf": part("adf", 1), "rr": part("adr", 1), "af": part("adf", 2), "ar": part("adr", 2), "lt": F.col("ltdrop")}
    columns = [F.max(F.when(F.col("sample") == name, v)).alias(f"{p}_{c}") for name, p in zip(names, "bcd", strict=False) for c, v in values.items()]
    return vcf.filter(F.col("sample").isin(names)).groupBy("chrom", "pos", "ref", "alt", "info").agg(*columns)


def run_joint(spark, a):
    o = joint.JointOptions(
        min_alt=a.min_alt, min_alt_strand=a.alt_strand, max_conflicts=a.conflicts, min_end_distance=a.end_distance, window=a.window, min_damage=a.damage, min_balance=a.balance, min_joint=a.min_joint,
        min_joint_strand=a.joint_strand, min_bulk_depth=a.bulk_depth, min_bulk_allele=a.bulk_allele, max_bulk_alt=a.bulk_alt, haploid_bulk=a.haploid_bulks,
    )
    bare = lambda x: x.removesuffix(".bam")
    listed = lambda path: {bare(r["name"]) for r in text.read_names(spark, path).collect()} if path else set()  # noqa: E731  (lists of samples)
    names = [bare(x) for x in text.vcf_samples(spark, a.input)]
    bulks = [bare(x) for x in a.bulks.split(",")] if a.bulks else names[: a.n_bulks]
    merged = {bare(r["replicate"]): bare(r["canonical"]) for r in text.read_replicates(spark, a.replicates).collect()} if a.replicates else {}
    excluded, haploid = listed(a.exclude), listed(a.haploid_list)
    cells = [n for n in names if n not in bulks and n not in excluded and merged.get(n, n) == n]
    vcf = text.read_vcf(spark, a.input).withColumn("sample", F.regexp_replace("sample", r"\.bam$", ""))
    if a.autosomes:
        vcf = vcf.filter(joint.autosome(F.col("chrom")))
    part = lambda c, k: F.coalesce(F.try_element_at(c, F.lit(k)), F.lit(0))
    rows = vcf.select(*joint.SITE, "sample", part("adf", 1).alias("rf"), part("adf", 2).alias("af"), part("adr", 1).alias("rr"), part("adr", 2).alias("ar"), F.col("ltdrop").alias("lt"), F.array_min(F.slice("alen", 2, 1 << 20)).alias("alen"), "info")
    # a list without a missing value only, as the filter reads it
    amq = F.transform(F.split(F.regexp_extract("info", r"AMQ=([\d,]+)", 1), ","), lambda x: x.try_cast("int"))
    quality = rows.groupBy(*joint.SITE).agg(F.first(amq).alias("amq"))
    known = {r: c for r, c in merged.items() if c in cells and r not in excluded}
    canonical = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.col("sample")), F.col("sample")) if known else F.col("sample")
    ploidy = F.lit(1) if a.haploid_cells or a.haploid_bulks else F.when(canonical.isin(*haploid), 1).otherwise(2) if haploid else F.lit(2)
    flagged = joint.cell_flags(rows.filter(~F.col("sample").isin(*bulks)).withColumn("ploidy", ploidy).drop("info"), o)
    if known:
        names_df = spark.createDataFrame([(c, r) for r, c in known.items()], "canonical string, replicate string")
        flagged = joint.merge_replicates(flagged, names_df)
    called = settled(joint.cell_calls(flagged.filter(F.col("sample").isin(*cells)), o))
    sites = text.read_sites(spark, a.sites) if a.sites else None
    given = settled(rows.filter(F.col("sample").isin(*bulks)).drop("info"))
    return records.in_order(records.joint_records(given, called, o, cells, bulks, quality, sites, f"joint {a.input}"))


def run_faidx(spark, a):
    if not a.regions:
        return tabbed(text.fasta_index(spark, a.input), "name")
    return text_of(text.fetched_lines(spark, a.input, a.regions), "k")


def text_of(df: DataFrame, *order: str) -> tuple[DataFrame, list[str]]:
    return df.select(*order, "value"), list(order)


def tabbed(df: DataFrame, *order: str) -> tuple[DataFrame, list[str]]:
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in df.columns]
    return df.select(*order, F.concat_ws("\t", *shown).alias("value")), list(order)


COMMANDS = {f.__name__[4:]: f for f in (run_trim, run_dedup, run_group, run_count, run_cnv, run_sv, run_pileup, run_lorenz, run_cv, run_diff, run_joint, run_faidx)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="helixframe", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple, many: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name, add_help=False)
        c.add_argument("--help", action="help")
        c.add_argument("inputs" if many else "input", help="- for standard input", **({"nargs": "+"} if many else {}))
        c.add_argument("-o", "--out", required=True, help="folder, or - for standard output")
        for flags, kind, default in options:
            more = {"action": "store_true"} if kind is bool else {"type": kind, "default": default}
            c.add_argument(*flags.split(), **more)
        return c

    command("trim", ("-b --barcode", int, 8), ("-l --length", int, 40), ("-T --table", bool, None))
    command("dedup")
    command("group", ("-n --min-frag", int, 3), ("-M --no-merge", bool, None), ("--shared", int, 9), ("--fuzz", int, 2), ("-s --fuzz-start", int, 2), ("-m --fuzz-length", int, 10))
    command("count", ("-n --n1", str, "5"), ("-q --min-mq", int, 40), ("-M --no-merge", bool, None))
    command("cnv", ("-b --bed", str, None), ("-c --penalty", float, 4), ("-p --ploidy", int, 2), ("-P --p-value", float, 1e-4), ("-s --split", int, 1000), ("-e --evidence", bool, None))
    command("sv", ("-q --min-mapq", int, 50), ("-m --max-nm", int, 3), ("-g --gap", int, 50), ("-n --min-count", int, 3), ("-p --breakpoints", bool, None))
    command(
        "pileup", ("-f --reference", str, None), ("-r --region", str, None), ("-b --bed", str, None), ("-Q --min-q", str, "0"), ("-q --min-mapq", str, "0"), ("-l --min-length", int, 0), ("-S --min-supplementary", int, 0),
        ("-P --max-clip", int, None), ("-V --divergence", float, 1.0), ("-T --trim", int, 0), ("-d --quality-depth", bool, None), ("-n --stranded", bool, None), ("-s --min-support", int, 1), ("-L --cells", int, 0),
        ("-N --max-depth", int, 0), ("-i --index", str, None), ("-v --variants", bool, None), ("-c --calls", bool, None), ("-C --both-strands", bool, None), ("-F --fasta", bool, None), ("-M --majority", bool, None), ("-R --random", bool, None),
        ("-x --same", str, "X"), ("-D --deviation", float, 3.0), ("-u --preset-u", bool, None), ("-y --preset-y", bool, None), many=True,
    )
    command("lorenz", ("-b --bed", str, None), ("-s --step", int, 1000))
    command("cv", ("-b --bed", str, None), ("-c --depth", bool, None))
    command(
        "diff", ("-q --min-mapq", int, 40), ("-b --bulk-depth", int, 15), ("-m --bulk-allele", int, 5), ("-A --bulk-balance", float, 0.3), ("-n --min-alt", int, 5), ("-s --alt-strand", int, 1), ("-a --alt-balance", float, 0.2),
        ("-f --conflicts", int, 0), ("-d --distance", int, 100), ("-c --bulk-alt", int, 0), ("-e --haploid-error", int, 1), ("-h --haploid", bool, None), ("-P --true-positives", bool, None), ("-1 --first", bool, None),
        ("-p --pair", bool, None), ("-g --indels", bool, None), ("--samples", str, None),
    )
    command(
        "joint", ("-b --n-bulks", int, 1), ("-h --haploid-list", str, None), ("-H --haploid-cells", bool, None), ("-e --exclude", str, None), ("-v --sites", str, None), ("-r --replicates", str, None), ("-F --show-filtered", bool, None),
        ("-u --autosomes", bool, None), ("-a --min-alt", int, 5), ("-s --alt-strand", int, 2), ("-l --conflicts", int, 1), ("-L --end-distance", int, 10), ("-w --window", int, 100), ("-S --damage", int, 4), ("-B --balance", float, 0.2),
        ("-j --min-joint", int, 2), ("-J --joint-strand", int, 1), ("-D --bulk-depth", int, 20), ("-A --bulk-allele", int, 8), ("-m --bulk-alt", int, 0), ("-P --haploid-bulks", bool, None), ("--bulks", str, None),
    )
    command("index")
    c = command("faidx")
    c.add_argument("regions", nargs="*")
    return p


def from_standard_input(spark: SparkSession) -> str:
    """A file in the shared checkpoint folder with what standard input holds, copied by the piece."""
    folder = checkpoint_folder(spark)
    data = sys.stdin.buffer
    head = data.peek(18)[:18]
    path = f"{folder}/input-{uuid.uuid4().hex}.{'bam' if bam.is_bgzf(head) else 'sam' if head[:1] == b'@' and head[3:4] == b'\t' else 'txt'}"
    with ranges.create_at(path) as f:
        shutil.copyfileobj(data, f, 1 << 20)
    return path


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName(f"helixframe {a.command}").getOrCreate()
    given = lambda path: from_standard_input(spark) if path == "-" else path
    if hasattr(a, "inputs"):
        a.inputs = [given(p) for p in a.inputs]
    else:
        a.input = given(a.input)
    if a.command == "index":
        bam.write_index(spark, a.input, a.out)
        return
    lines, order = run(spark, a)
    if a.out == "-":
        for r in lines.orderBy(*order).select("value").toLocalIterator():
            print(r["value"])
    else:
        text.write_lines(lines, a.out, order)
