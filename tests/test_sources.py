"""Round trips through the file formats."""

import gzip
import random

import pytest

from helixframe.sources import bam, text


def test_bgzf_blocks():
    data = random.Random(1).randbytes(200_000)
    packed = bam.compressed(data)
    assert b"".join(b for _, b in bam.blocks(packed)) == data == gzip.decompress(packed)
    with pytest.raises(ValueError):
        list(bam.blocks(packed[:-40]))


def test_fastq_over_many_splits(spark, tmp_path):
    reads = [(f"r{i // 2}/{i % 2 + 1}", "ACGTN"[i % 5] * (i % 30 + 1)) for i in range(400)]
    (tmp_path / "a.fq").write_text("".join(f"@{n} x\n{s}\n+\n{'I' * len(s)}\n" for n, s in reads))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = text.read_fastq(spark, str(tmp_path / "a.fq")).orderBy("record").collect()
        assert [(r.name, r.seq) for r in rows] == reads
        pairs = text.read_pairs(spark, str(tmp_path / "a.fq")).orderBy("pair_id").collect()
        assert len(pairs) == 200 and pairs[3].name == "r3" and pairs[3].seq2 == reads[7][1]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "b.fq").write_text("@x\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="not a FASTQ record"):
        text.read_fastq(spark, str(tmp_path / "b.fq")).collect()


def test_fasta(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">a one\nACGTACGT\nACG\n>b\nTTTT\n")
    fa = text.read_fasta(spark, str(tmp_path / "r.fa"))
    assert sorted((r.name, r.len) for r in text.sequence_lengths(fa).collect()) == [("a", 11), ("b", 4)]
    regions = spark.createDataFrame([("a", 6, 10), ("b", 1, 99)], "name string, beg long, end long")
    assert sorted((r.name, r.bases) for r in text.fetch(fa, regions).collect()) == [("a", "GTAC"), ("b", "TTT")]


SAM = """@SQ\tSN:chr1\tLN:1000
@SQ\tSN:chr2\tLN:500
q1\t99\tchr1\t101\t60\t5M\t=\t201\t105\tACGTA\tIIIII\tBC:Z:AAA\tNM:i:1
q1\t147\tchr1\t201\t60\t2S3M\t=\t101\t-105\tACGTA\t*\tBC:Z:AAA
q2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII
"""


def test_sam_and_bam(spark, tmp_path):
    (tmp_path / "x.sam").write_text(SAM)
    contigs = text.sam_contigs(spark, str(tmp_path / "x.sam"))
    assert [(r.tid, r.name, r.off) for r in contigs.orderBy("tid").collect()] == [(0, "chr1", 0), (1, "chr2", 1000)]
    reads = text.read_sam(spark, str(tmp_path / "x.sam"))
    back = [r.value for r in text.sam_lines(reads, contigs).orderBy("seq").collect()]
    assert back == SAM.splitlines()[2:]
    spark.dataSource.register(bam.Bam)
    fields = [c.split()[0] for c in bam.ALIGNMENT.split(", ")]
    whole = reads.select(*fields).na.fill(-1, ["pos", "mpos"]).na.fill(0, ["isize"]).orderBy("seq").coalesce(1)
    whole.write.format("bam").option("contigs", "chr1:1000,chr2:500").mode("append").save(str(tmp_path / "out"))
    again = bam.read_bam(spark, str(tmp_path / "out"))
    keep = [f for f in fields if f != "seq"]
    assert again.orderBy("seq").select(*keep).collect() == whole.orderBy("seq").select(*keep).collect()
    assert [(r.name, r.len) for r in bam.bam_contigs(spark, str(tmp_path / "out")).collect()] == [("chr1", 1000), ("chr2", 500)]


def test_beds_and_lists(spark, tmp_path):
    p = tmp_path / "f"
    p.write_text("chr1 10 20\nchr1\t5\n\nchr1 9 9\nchr2\t3\t8\tx\n")
    assert sorted(map(tuple, text.read_bed(spark, str(p)).collect())) == [("chr1", 4, 5), ("chr1", 10, 20), ("chr2", 3, 8)]
    p.write_text("chr1\t100\t300\t2:12:|>\t+\t12\t60\n")
    r = text.read_fragments(spark, str(p)).first()
    assert (r.n_seg, r.n_frag, r.lo, r.ro, r.mq) == (2, 12, False, True, 60)
    p.write_text("chr1\t0\t10\t1\t2\t300\nchr1\t10\t40\t0\t0\t1\nshort\t1\n")
    gaps = spark.createDataFrame([("chr1", 15, 20)], "chrom string, beg int, end int")
    assert sorted((r.st, r.d2, r.flt) for r in text.read_depth(spark, str(p), gaps).collect()) == [(0, 255, False), (10, 1, True)]
    p.write_text("a b c\nd\n")
    assert sorted(map(tuple, text.read_replicates(spark, str(p)).collect())) == [("a", "a"), ("a", "b"), ("a", "c"), ("d", "d")]
    p.write_text("chr1:7\nchr2 9\n")
    assert sorted(map(tuple, text.read_sites(spark, str(p)).collect())) == [("chr1", 7), ("chr2", 9)]


def test_vcf(spark, tmp_path):
    sites = spark.createDataFrame([("chr1", 9, "A", ["C"], 7, [60, None], [("0/1", [4, 3], [5, 4]), ("./.", [0, 0], [1, 0])])], "chrom string, pos int, ref string, alt array<string>, qual int, amq array<int>, samples array<struct<gt:string,adf:array<int>,adr:array<int>>>")
    line = text.vcf_lines(sites).first()["value"]
    p = tmp_path / "v.vcf"
    p.write_text("\n".join(text.vcf_header(["bulk", "cell"])) + "\n" + line + "\n")
    got = text.read_vcf(spark, str(p)).orderBy("sample").collect()
    assert [(r.pos, r.sample, r.gt, r.adf, r.adr, r.amq) for r in got] == [(10, "bulk", "0/1", [4, 3], [5, 4], [60, None]), (10, "cell", "./.", [0, 0], [1, 0], [60, None])]


def test_tags_keep_their_types(spark, tmp_path):
    tags = ["BC:Z:007", "XA:A:7", "XF:f:1.5", "XI:i:-3", "XU:i:4000000000", "XB:B:s,1,-2", "XH:H:1AE3"]
    (tmp_path / "t.sam").write_text("@SQ\tSN:chr1\tLN:1000\nq\t0\tchr1\t1\t60\t2M\t*\t0\t0\tAC\tII\t" + "\t".join(tags) + "\n")
    reads, contigs = text.read_sam(spark, str(tmp_path / "t.sam")), text.sam_contigs(spark, str(tmp_path / "t.sam"))
    assert sorted(text.sam_lines(reads, contigs).first()["value"].split("\t")[11:]) == sorted(tags)
    spark.dataSource.register(bam.Bam)
    fields = [c.split()[0] for c in bam.ALIGNMENT.replace("struct<type:string,value:string>", "s").split(", ")]
    reads.select(*fields).na.fill(-1, ["mpos"]).coalesce(1).write.format("bam").option("contigs", "chr1:1000").mode("append").save(str(tmp_path / "out"))
    found = bam.read_bam(spark, str(tmp_path / "out")).first()
    assert sorted(f"{k}:{v['type']}:{v['value']}" for k, v in found.tags.items()) == sorted(tags) and found.bc == "007"


def test_files_that_are_cut_off(spark, tmp_path):
    data = bam.compressed(b"x" * 100_000)
    assert bam.has_end(data) and not bam.has_end(data[: -len(bam.EOF)])
    with pytest.raises(ValueError, match="cut off"):
        bam.whole(data[: -len(bam.EOF)])
    (tmp_path / "d.sam").write_text("@SQ\tSN:a\tLN:9\n@SQ\tSN:a\tLN:9\n")
    with pytest.raises(Exception, match="comes twice"):
        text.sam_contigs(spark, str(tmp_path / "d.sam")).collect()


def test_virtual_offsets_and_ranges():
    rows = [f"line {i} " + "y" * (i % 700) for i in range(2000)]
    data = bam.compressed(("\n".join(rows) + "\n").encode())
    found = list(bam.text_lines(data))
    assert [line for _, line in found] == rows
    for at in (0, 7, 500, 1999):
        assert next(bam.text_lines(data, found[at][0]))[1] == rows[at]
        assert b"".join(bam.contents_from(data, found[at][0])).decode().startswith(rows[at])
    cuts = bam.block_ranges(data, 3000)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:], strict=False)) and len(cuts) > 2
    assert b"".join(part for a, b in cuts for _, part in bam.blocks(data[a:b])) == ("\n".join(rows) + "\n").encode()


def test_records_in_pieces():
    from types import SimpleNamespace

    head = b"BAM\1" + bytes(4) + b"\1\0\0\0" + b"\5\0\0\0chr1\0" + b"\xe8\3\0\0"
    row = lambda i: SimpleNamespace(qname=f"q{i}", cigar="4M", bases="ACGT", quals=[30] * 4, tags={}, tid=0, pos=i, mapq=60, flag=0, mtid=-1, mpos=-1, isize=0)
    data = head + b"".join(bam.encoded(row(i)) for i in range(100))
    got = [r for first, part in bam.pieces(data, 300) for r in bam.records(part, 0, first)]
    assert len(list(bam.pieces(data, 300))) > 5 and [(r[0], r[1], r[4]) for r in got] == [(i, f"q{i}", i) for i in range(100)]
    with pytest.raises(ValueError, match="cut off"):
        list(bam.pieces(data[:-3]))


def test_fastq_over_many_lines(spark, tmp_path):
    (tmp_path / "m.fq").write_text("@a one\nACGT\nAC\n+\nIIII\n@I\n@b\nGG\n+b\n+I\n")
    got = [(r.name, r.seq, r.qual) for r in text.read_fastq(spark, str(tmp_path / "m.fq")).orderBy("record").collect()]
    assert got == [("a", "ACGTAC", "IIII@I"), ("b", "GG", "+I")]
    (tmp_path / "s.fq").write_text("@a\nACGT\nAC\n+\nIIII\n")
    with pytest.raises(Exception, match="not a FASTQ record"):
        text.read_fastq(spark, str(tmp_path / "s.fq")).collect()


def test_regions():
    from helixframe.operators.intervals import parse_region

    whole = 1 << 29
    given = ["chr1:2000-1000", "chr1:-5", "chr1:5-", "chr1:1,000", "chr1:a-5", "chr1:1-2-3", "a:b:7-9", "chr1:"]
    assert [parse_region(g) for g in given] == [
        ("chr1:2000-1000", 0, whole), ("chr1", 0, whole), ("chr1:5-", 0, whole), ("chr1", 999, whole), ("chr1:a-5", 0, whole), ("chr1:1-2-3", 0, whole), ("a:b", 6, 9), ("chr1", 0, whole),
    ]


def test_region_scan_of_long_reads(spark, tmp_path):
    from helixframe.sources import store

    store.write_sorted(spark.createDataFrame([(0, 100, 3_000_000), (0, 2_000_000, 10), (1, 5, 10)], "tid long, pos int, rlen int"), str(tmp_path / "s"))
    assert store.scan_region(spark, str(tmp_path / "s"), "chr1:2,500,001-2,500,100", {"chr1": 0, "chr2": 1}).count() == 1


def test_lists_given_in_line(spark, tmp_path):
    (tmp_path / "l").write_text("x\ny z\n")
    assert [r.name for r in text.read_list(spark, ":a,b,,c").collect()] == ["a", "b", "c"]
    assert sorted(r.name for r in text.read_list(spark, str(tmp_path / "l")).collect()) == ["x", "y z"]


def test_region_strings_of_a_column(spark):
    from helixframe.operators.intervals import parse_region, region_parts

    rnd = random.Random(5)
    given = ["chr1:2000-1000", "chr1:-5", "chr1:5-", "chr1:1,000", "chr1:a-5", "chr1:1-2-3", "a:b:7-9", "chr1:", "chr1:-", "chr1", "", ":", "a:,", "x:5-9,", "x:99999999999999999999"]
    given += ["".join(rnd.choice("a:1207,-") for _ in range(rnd.randint(0, 9))) for _ in range(400)]
    got = spark.createDataFrame([(k, g) for k, g in enumerate(given)], "k int, g string").select("k", region_parts("g").alias("x")).collect()
    assert all(tuple(r.x) == parse_region(given[r.k]) for r in got if "9" * 20 not in given[r.k])


def test_intervals_with_columns_of_any_type(spark):
    from helixframe.operators import intervals

    rows = [("c", 5, 9, {"a": "b"}), ("c", 8000, 30_000, {"a": "b"}), ("c", 8000, 30_000, {"c": "d"}), ("c", 8000, 30_000, {"c": "d"}), (None, 1, 20_000, None), ("d", 100_000, 200_000, {})]
    df = spark.createDataFrame(rows, "chrom string, beg int, end int, tags map<string,string>")
    mask = spark.createDataFrame([("c", 20_000, 20_001), ("d", 0, 100_000)], "chrom string, beg int, end int")
    shown = lambda df: sorted(((r.beg, str(r.tags)) for r in df.collect()), key=str)
    assert shown(intervals.overlapping(df, mask)) == sorted([(8000, "{'a': 'b'}")] + [(8000, "{'c': 'd'}")] * 2, key=str)
    assert shown(intervals.outside(df, mask)) == sorted([(1, "None"), (5, "{'a': 'b'}"), (100_000, "{}")], key=str)
