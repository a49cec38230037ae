"""Readers and writers of line formats: FASTQ, FASTA, SAM, BED, fragments, depth, VCF, lists.

All read through Spark's own text scan, so any file system and any splittable
layout works. Where order matters a line gets its number in its file from
per-split counts, never from a pass over the whole file in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions.reads import cigar_ops, query_length, reference_span


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): each line with its 0-based number in its file."""
    raw = spark.read.text(path).select(
        F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")
    )
    splits = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return raw.join(splits, ["file", "block"]).select("file", (F.col("start") + F.col("id") - F.col("first")).alias("line"), "value")


def _number(df: DataFrame, by: list[str], order: str, flag: Column, out: str) -> DataFrame:
    """Running count of ``flag`` along ``order``: counts of ranges of ``RANGE`` lines are carried in, so no window spans a file."""
    df = df.withColumn("_f", flag.cast("long")).withColumn("_g", F.shiftright(order, 18))
    w = Window.partitionBy(*by).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    before = df.groupBy(*by, "_g").agg(F.sum("_f").alias("_n")).select(*by, "_g", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    local = Window.partitionBy(*by, "_g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(before, [*by, "_g"]).withColumn(out, F.sum("_f").over(local) + F.col("_before")).drop("_f", "_g", "_before")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, pair_id, mate, name, seq, qual) of FASTQ; mates follow each other.

    Sequence and quality may go over many lines; a quality line may start with
    any letter. Records whose quality has another length than their sequence,
    FASTA records included, are an error.
    """
    at = lines(spark, path).filter("value <> ''")
    strict = at.agg(F.coalesce(F.every(F.when(F.col("line") % 4 == 0, F.col("value").startswith("@")).when(F.col("line") % 4 == 2, F.col("value").startswith("+")).otherwise(True)), F.lit(True)).alias("s")).first()["s"]
    if strict:
        rec = at.groupBy("file", F.expr("line div 4").alias("record")).agg(*[F.max(F.when(F.col("line") % 4 == k, F.col("value"))).alias(c) for k, c in ((0, "head"), (1, "seq"), (3, "qual"))])
    else:
        rec = _long_records(at)
    sound = F.col("head").startswith("@") & (F.length("seq") == F.length("qual"))
    name = F.regexp_extract("head", r"^@(\S+)", 1)
    checked = F.when(F.coalesce(sound, F.lit(False)), name).otherwise(F.raise_error(F.concat(F.lit("not a FASTQ record: "), F.coalesce("head", F.lit("")))))
    return rec.select("file", "record", F.expr("record div 2").alias("pair_id"), (F.col("record") % 2).cast("int").alias("mate"), checked.alias("name"), "seq", "qual")


def _long_records(at: DataFrame) -> DataFrame:
    """(file, record, head, seq, qual) of records over many lines.

    Only a walk from the top tells a header from a quality line that starts
    alike, so lines go through a file in order, one task a file.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, head, seq, qual, part = [], None, [], [], 0
        for value in pdf.sort_values("line")["value"]:
            if part == 2 and sum(map(len, qual)) < sum(map(len, seq)):
                qual.append(value)
            elif value[0] in "@>":
                rows.append((head, seq, qual))
                head, seq, qual, part = value, [], [], 1
            elif part == 1 and value[0] == "+":
                part = 2
            elif part == 1:
                seq.append(value)
            else:
                qual.append(value)  # too long: an error in the record
        rows.append((head, seq, qual))
        rows = [(pdf["file"].iloc[0], k, h, "".join(s), "".join(q)) for k, (h, s, q) in enumerate(rows[1:] if rows[0][0] is None and not rows[0][2] else rows)]
        return pd.DataFrame(rows, columns=["file", "record", "head", "seq", "qual"])

    return at.groupBy("file").applyInPandas(run, "file string, record long, head string, seq string, qual string")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(file, pair_id, name, seq1, qual1, seq2, qual2) of interleaved FASTQ; an odd record is an error."""
    pick = lambda c, m: F.max(F.when(F.col("mate") == m, F.col(c)))
    both = read_fastq(spark, path).groupBy("file", "pair_id").agg(pick("name", 0).alias("name"), *[pick(c, m).alias(f"{c}{m + 1}") for m in (0, 1) for c in ("seq", "qual")])
    name = F.when(F.col("seq2").isNotNull(), F.regexp_replace("name", "/[12]$", "")).otherwise(F.raise_error(F.lit("a read without a mate")))
    return both.withColumn("name", name)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, start, bases): one row a sequence line, with its offset; lines of one sequence have one length, the last may be shorter."""
    at = _number(lines(spark, path).filter("value <> ''"), ["file"], "line", F.col("value").startswith(">"), "h")
    heads = at.filter("value like '>%'").select("file", "h", F.col("line").alias("top"), F.regexp_extract("value", r"^>(\S+)", 1).alias("name"))
    body = at.filter("value not like '>%'")
    rows = body.join(heads, ["file", "h"]).select("name", (F.col("line") - F.col("top") - 1).alias("k"), "value")
    size = rows.groupBy("name").agg(F.max(F.length("value")).cast("long").alias("width"), F.max("k").alias("last"))
    joined = rows.join(size, "name")
    ragged = (F.col("k") < F.col("last")) & (F.length("value") != F.col("width"))
    return joined.select("name", (F.col("k") * F.col("width")).alias("start"), F.when(ragged, F.raise_error(F.concat(F.lit("lines of different lengths in "), "name"))).otherwise(F.col("value")).alias("bases"))


def fasta_index(spark: SparkSession, path: str) -> DataFrame:
    """(name, len, width): what an index file of a FASTA holds, less the byte offsets."""
    return read_fasta(spark, path).groupBy("name").agg(F.max(F.col("start") + F.length("bases")).alias("len"), F.max(F.length("bases")).cast("long").alias("width"))


def fetched_lines(spark: SparkSession, path: str, regions: list[str], width: int = 60) -> DataFrame:
    """(k, value): FASTA text of regions in their order; a region outside all sequences is a header alone."""
    from helixframe.operators.intervals import parse_region

    fasta = read_fasta(spark, path)
    asked = spark.createDataFrame([(k, r, *parse_region(r)) for k, r in enumerate(regions)], "k int, region string, name string, beg long, end long")
    found = asked.join(fetch(fasta, asked.select("name", "beg", "end").distinct()), ["name", "beg", "end"], "left")
    body = F.regexp_replace(F.coalesce("bases", F.lit("")), f"(.{{{width}}})(?=.)", "$1\n")
    return found.select("k", F.concat_ws("\n", F.concat(F.lit(">"), "region"), F.when(body != "", body)).alias("value"))


def sequence_lengths(fasta: DataFrame) -> DataFrame:
    """(name, len) of each sequence."""
    return fasta.groupBy("name").agg(F.max(F.col("start") + F.length("bases")).alias("len"))


def fetch(fasta: DataFrame, regions: DataFrame) -> DataFrame:
    """(name, beg, end, bases) of regions (name, beg, end), 0-based half-open, clipped to the sequence.

    Lines and regions meet on (name, bin of 1 kb), so a region reads the lines around it and not its sequence.
    """
    bins = lambda a, b: F.explode(F.sequence(F.shiftright(a, 10), F.shiftright(F.greatest(a, b - 1), 10)))
    size = fasta.groupBy("name").agg(F.max(F.col("start") + F.length("bases")).alias("_len"))
    clipped = regions.join(size, "name").withColumn("_stop", F.least("end", "_len")).filter("_stop > beg")
    wanted = clipped.withColumn("_bin", bins(F.col("beg").cast("long"), F.col("_stop").cast("long")))
    lines_ = fasta.withColumn("_bin", bins(F.col("start"), F.col("start") + F.length("bases")))
    inside = (F.col("start") < F.col("end")) & (F.col("start") + F.length("bases") > F.col("beg"))
    hit = lines_.join(wanted, ["name", "_bin"]).filter(inside)
    skip = F.greatest(F.lit(0), F.col("beg") - F.col("start"))
    part = F.substring(F.col("bases"), (skip + 1).cast("int"), (F.least(F.length("bases"), F.col("end") - F.col("start")) - skip).cast("int"))
    out = hit.groupBy("name", "beg", "end").agg(F.sort_array(F.collect_set(F.struct("start", part.alias("b")))).alias("x"))
    return out.select("name", "beg", "end", F.array_join(F.transform("x", lambda p: p["b"]), "").alias("bases"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, beg, end); a single number n is the position [n - 1, n); empty and malformed lines are dropped."""
    f = F.split(F.trim("value"), r"\s+")
    number = lambda k: F.try_element_at(f, F.lit(k)).try_cast("long")
    one = number(3).isNull()
    rows = spark.read.text(path).select(F.get(f, F.lit(0)).alias("chrom"), F.when(one, number(2) - 1).otherwise(number(2)).alias("beg"), F.when(one, number(2)).otherwise(number(3)).alias("end"))
    return rows.filter("chrom <> '' and beg >= 0 and end > beg")


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, st, en, n_seg, n_frag, lo, ro, strand, mq) of a fragment file."""
    f = F.split("value", "\t")
    part = lambda k: F.regexp_extract(F.get(f, F.lit(3)), r"^(\d+):(\d+):(.)(.)$", k)
    rows = spark.read.text(path).filter("value <> ''")
    return rows.select(
        F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).cast("long").alias("st"), F.get(f, F.lit(2)).cast("long").alias("en"), part(1).cast("long").alias("n_seg"), part(2).cast("long").alias("n_frag"), (part(3) == "<").alias("lo"), (part(4) == ">").alias("ro"),
        F.try_element_at(f, F.lit(5)).alias("strand"), F.try_element_at(f, F.lit(7)).try_cast("long").alias("mq"),
    )


def read_depth(spark: SparkSession, path: str, gaps: DataFrame | None = None) -> DataFrame:
    """(chrom, st, en, d0, d1, d2, flt) of a depth file; depths saturate at 255; flt marks overlap with ``gaps``."""
    from helixframe.operators.intervals import overlapping

    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(F.size(f) >= 6)
    rows = rows.select(F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).cast("long").alias("st"), F.get(f, F.lit(2)).cast("long").alias("en"), *[F.least(F.get(f, F.lit(3 + k)).cast("long"), F.lit(255)).alias(f"d{k}") for k in range(3)])
    if gaps is None:
        return rows.withColumn("flt", F.lit(False))
    hit = overlapping(rows, gaps, "chrom", "st", "en").select("chrom", "st", "en").distinct().withColumn("flt", F.lit(True))
    return rows.join(hit, ["chrom", "st", "en"], "left").na.fill(False, ["flt"]).select(*rows.columns, "flt")


def read_depth_column(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, st, en, depth) from the first four columns of a depth file; lines with fewer are dropped."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(F.size(f) >= 4)
    return rows.select(F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).cast("long").alias("st"), F.get(f, F.lit(2)).cast("long").alias("en"), F.get(f, F.lit(3)).cast("long").alias("depth"))


def read_list(spark: SparkSession, given: str) -> DataFrame:
    """(name): the lines of a file, or the parts of an inline list ``:a,b,c``."""
    if given.startswith(":"):
        return spark.createDataFrame([(x,) for x in given[1:].split(",") if x], "name string")
    return spark.read.text(given).select(F.col("value").alias("name")).filter("name <> ''")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(name): first column of a list."""
    return spark.read.text(path).select(F.get(F.split(F.trim("value"), r"\s+"), F.lit(0)).alias("name")).filter("name <> ''").distinct()


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos): first two columns, or chrom:pos."""
    f = F.split(F.trim("value"), r"[\s:]+")
    return spark.read.text(path).select(F.get(f, F.lit(0)).alias("chrom"), F.try_element_at(f, F.lit(2)).try_cast("int").alias("pos")).filter("pos is not null").distinct()


def read_replicates(spark: SparkSession, path: str) -> DataFrame:
    """(canonical, replicate): each line lists the names of one sample, the first being canonical."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter("trim(value) <> ''").select(F.get(f, F.lit(0)).alias("canonical"), F.explode(f).alias("replicate")).distinct()


# ---------------------------------------------------------------- SAM


def sam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(tid, name, len, off) from the header; a name that comes twice is an error."""
    at = lines(spark, path).filter("value like '@SQ\\t%'").select("line", F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("name"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("len"))
    w = Window.orderBy("line")  # a row a contig
    again = F.count("*").over(Window.partitionBy("name")) > 1
    at = at.withColumn("name", F.when(again, F.raise_error(F.concat(F.lit("a contig comes twice: "), "name"))).otherwise(F.col("name")))
    return at.select((F.row_number().over(w) - 1).cast("long").alias("tid"), "name", "len", F.coalesce(F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))


def _missing(c: Column, mark: str = "*") -> Column:
    return F.when(c != mark, c)


def read_sam(spark: SparkSession, path: str, contigs: DataFrame | None = None) -> DataFrame:
    """Alignments with their order ``seq``; missing values are null, positions 0-based.

    ``tags`` maps a tag to its (type, value). A sequence or CIGAR whose length
    differs from the other's is an error; a record without a known contig or
    position is unmapped.
    """
    contigs = contigs if contigs is not None else sam_contigs(spark, path)
    f = F.split("value", "\t")
    at = lines(spark, path).filter("value not like '@%' and value <> ''").select(F.col("line").alias("seq"), f.alias("f"))
    f = F.col("f")
    tags = F.map_from_entries(F.transform(F.slice("f", 12, 1 << 20), lambda t: F.struct(F.substring(t, 1, 2), F.struct(F.substring(t, 4, 1).alias("type"), F.substring(t, 6, 1 << 20).alias("value")))))
    rows = at.select(
        "seq", F.get(f, F.lit(0)).alias("qname"), F.get(f, F.lit(1)).cast("int").alias("flag"), F.get(f, F.lit(2)).alias("rname"), (F.get(f, F.lit(3)).cast("int") - 1).alias("pos"), F.get(f, F.lit(4)).cast("int").alias("mapq"), _missing(F.get(f, F.lit(5))).alias("cigar"),
        F.when(F.get(f, F.lit(6)) == "=", F.get(f, F.lit(2))).otherwise(F.get(f, F.lit(6))).alias("mname"), (F.get(f, F.lit(7)).cast("int") - 1).alias("mpos"), F.get(f, F.lit(8)).cast("int").alias("isize"), _missing(F.get(f, F.lit(9))).alias("bases"), _missing(F.get(f, F.lit(10))).alias("qual"), tags.alias("tags"),
    )
    ids = F.broadcast(contigs.select(F.col("name"), F.col("tid")))
    rows = rows.join(ids.withColumnsRenamed({"name": "rname", "tid": "tid"}), "rname", "left").join(ids.withColumnsRenamed({"name": "mname", "tid": "mtid"}), "mname", "left")
    ops = cigar_ops(F.coalesce("cigar", F.lit("")))
    fits = F.col("cigar").isNull() | F.col("bases").isNull() | (query_length(ops) == F.length("bases"))
    even = F.col("qual").isNull() | (F.length("qual") == F.length("bases"))
    lost = F.col("tid").isNull() | (F.col("pos") < 0)
    return rows.select(
        "seq", F.when(fits & even, F.col("qname")).otherwise(F.raise_error(F.concat(F.lit("lengths differ in read "), "qname"))).alias("qname"),
        F.when(lost, F.col("flag").bitwiseOR(F.lit(4))).otherwise(F.col("flag")).alias("flag"), F.when(lost, -1).otherwise(F.col("tid")).alias("tid"), "pos", "mapq", "cigar", ops.alias("ops"),
        F.coalesce("mtid", F.lit(-1)).alias("mtid"), "mpos", "isize", "bases", F.transform(F.split("qual", ""), lambda q: F.ascii(q) - 33).alias("quals"), reference_span(ops).alias("rlen"),
        *[F.col("tags")[t]["value"].cast(kind).alias(t.lower()) for t, kind in (("BC", "string"), ("BF", "string"), ("SA", "string"), ("NM", "int"))], "tags", "qual",
    )


def sam_lines(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """(seq, value): SAM text of alignments, each tag with its type."""
    ids = F.broadcast(contigs.select("tid", "name"))
    rows = reads.join(ids.withColumnRenamed("name", "rname"), "tid", "left").join(ids.withColumnsRenamed({"tid": "mtid", "name": "mname"}), "mtid", "left")
    star = lambda c: F.coalesce(c, F.lit("*"))
    mate = F.when(F.col("mname").isNull(), "*").when(F.col("mtid") == F.col("tid"), "=").otherwise(F.col("mname"))
    tag = F.transform(F.coalesce(F.map_entries("tags"), F.array()), lambda e: F.concat_ws(":", e["key"], e["value"]["type"], e["value"]["value"]))
    number = lambda c: F.coalesce(F.col(c) + 1, F.lit(0)).cast("string")
    cells = [F.col("qname"), F.col("flag").cast("string"), star(F.col("rname")), number("pos"), F.col("mapq").cast("string"), star(F.col("cigar")), mate, number("mpos"), F.coalesce("isize", F.lit(0)).cast("string"), star(F.col("bases")), star(F.col("qual"))]
    return rows.select("seq", F.concat_ws("\t", *cells, tag).alias("value"))


def sam_header(contigs: DataFrame) -> DataFrame:
    """(seq, value): the header line of each contig, numbered to stand before all records."""
    return contigs.select((F.col("tid") - (1 << 40)).cast("long").alias("seq"), F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), F.col("len").cast("string")).alias("value"))


# ---------------------------------------------------------------- VCF


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    """Sample names of the header, if there is one."""
    head = spark.read.text(path).filter("value like '#CHROM%'").limit(1).collect()
    return head[0]["value"].split("\t")[9:] if head else []


def read_vcf(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """(chrom, pos, ref, alt, qual, info, amq, sample, gt, adf, adr, ltdrop, alen): a row a site and sample, fields by FORMAT.

    Sample names come from the header, or are numbers from 0. Lines with fewer
    than ten columns are dropped; depths are required.
    """
    text = spark.read.text(path)
    if names is None:
        names = vcf_samples(spark, path)
    f = F.split("value", "\t")
    rows = text.filter(~F.col("value").startswith("#") & (F.size(f) >= 10)).select(f.alias("f"))
    ints = lambda c: F.transform(F.split(c, ","), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    cells = rows.select("f", F.posexplode(F.slice("f", 10, 1 << 20)).alias("k", "cell"))
    cells = cells.withColumn("m", F.map_from_entries(F.arrays_zip(F.split(F.get("f", F.lit(8)), ":"), F.slice(F.concat(F.split("cell", ":"), F.array_repeat(F.lit(None).cast("string"), 32)), F.lit(1), F.size(F.split(F.get("f", F.lit(8)), ":"))))))
    name = F.coalesce(F.try_element_at(F.array(*map(F.lit, names)).cast("array<string>"), (F.col("k") + 1).cast("int")), F.col("k").cast("string"))
    m, g = F.col("m"), F.col("f")
    amq = F.transform(F.split(F.regexp_extract(F.get(g, F.lit(7)), r"\bAMQ=([.\d,]+)", 1), ","), lambda x: x.try_cast("int"))
    depths = m["ADF"].isNotNull() & m["ADR"].isNotNull()
    return cells.select(
        F.get(g, F.lit(0)).alias("chrom"), F.get(g, F.lit(1)).cast("int").alias("pos"), F.upper(F.get(g, F.lit(3))).alias("ref"), F.get(g, F.lit(4)).alias("alt"), F.get(g, F.lit(5)).try_cast("double").alias("qual"), F.get(g, F.lit(7)).alias("info"), amq.alias("amq"), name.alias("sample"), m["GT"].alias("gt"),
        F.when(depths, ints(m["ADF"])).otherwise(F.raise_error(F.lit("ADF and ADR are required"))).alias("adf"), ints(m["ADR"]).alias("adr"), m["LTDROP"].try_cast("int").alias("ltdrop"),
        F.transform(F.split(m["ALEN"], ","), lambda x: x.try_cast("double")).alias("alen"),
    )


def vcf_header(samples: list[str], contigs: list[tuple[str, int]] | None = None, reference: str | None = None, both_strands: bool = True, cells: bool = False) -> list[str]:
    """Header lines; ``contigs`` are names and lengths."""
    depths = [("ADF", "R", "Integer", "Forward depth per allele"), ("ADR", "R", "Integer", "Reverse depth per allele")] if both_strands else [("AD", "R", "Integer", "Depth per allele")]
    of_cells = [("LTDROP", "1", "Integer", "Reads removed by fragment votes"), ("ALEN", "R", "Float", "Mean distance to read ends per allele")] if cells else []
    described = [("GT", "1", "String", "Genotype"), *depths, *of_cells]
    return [
        "##fileformat=VCFv4.1",
        *([f"##reference={reference}"] if reference else []),
        *(f"##contig=<ID={name},length={size}>" for name, size in contigs or []),
        '##INFO=<ID=AMQ,Number=R,Type=Integer,Description="RMS mapping quality per allele">',
        *(f'##FORMAT=<ID={i},Number={n},Type={t},Description="{d}">' for i, n, t, d in described),
        "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples]),
    ]


def vcf_lines(sites: DataFrame, both_strands: bool = True, cells: bool = False) -> DataFrame:
    """(chrom, pos, value) of sites (chrom, pos 0-based, ref, alt array, qual, amq array, samples array<struct<gt,adf,adr[,ad,ltdrop,alen]>>)."""
    amq = F.array_join(F.transform("amq", lambda x: F.coalesce(x.cast("string"), F.lit("."))), ",")
    numbers = lambda c: F.array_join(c.cast("array<string>"), ",")
    ends = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(F.format_string("%.1f", x), F.lit("."))), ",")

    def cell(s: Column) -> Column:
        depths = [numbers(s["adf"]), numbers(s["adr"])] if both_strands else [numbers(s["ad"])]
        more = [F.coalesce(s["ltdrop"].cast("string"), F.lit(".")), F.coalesce(ends(s["alen"]), F.lit("."))] if cells else []
        return F.concat_ws(":", s["gt"], *depths, *more)

    fields = "GT:" + ("ADF:ADR" if both_strands else "AD") + (":LTDROP:ALEN" if cells else "")
    alt = F.when(F.size("alt") == 0, ".").otherwise(F.array_join("alt", ","))
    value = F.concat_ws("\t", "chrom", (F.col("pos") + 1).cast("string"), F.lit("."), "ref", alt, F.col("qual").cast("string"), F.lit("."), F.concat(F.lit("AMQ="), amq), F.lit(fields), F.transform("samples", cell))
    return sites.select("chrom", "pos", value.alias("value"))


def write_lines(df: DataFrame, path: str, order: list[str], value: str = "value") -> None:
    """Write a text column in a global order, as sorted part files."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(value).alias("value")).write.text(path)


def tabbed(df: DataFrame) -> DataFrame:
    """(value): all columns joined by tabs, nulls as '.'."""
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in df.columns]).alias("value"))
