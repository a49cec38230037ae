"""The command line on small files."""

import random

from helixframe.plans import commands
from helixframe.sources import store, text


def lines(spark, tmp_path, *args):
    import shutil

    out = str(tmp_path / "out")
    shutil.rmtree(out, ignore_errors=True)
    commands.main([*args, "-o", out])
    return [r.value for r in spark.read.text(out).collect()]


def sam(tmp_path, name, reads):
    head = "@SQ\tSN:chr1\tLN:200\n"
    p = tmp_path / name
    p.write_text(head + "".join(f"{q}\t{f}\tchr1\t{pos}\t60\t{c}\t*\t0\t0\t{s}\t{'I' * len(s)}\tBC:Z:{b}\n" for q, f, pos, c, s, b in reads))
    return str(p)


def test_chain(spark, tmp_path):
    ref = "".join(random.Random(1).choice("ACGT") for _ in range(200))
    (tmp_path / "ref.fa").write_text(">chr1\n" + "\n".join(ref[i : i + 60] for i in range(0, 200, 60)) + "\n")
    alt = {"A": "C", "C": "G", "G": "T", "T": "A"}[ref[29]]
    seq = ref[20:29] + alt + ref[30:50]
    gap = ref[60:70] + ref[73:90]
    reads = [(f"r{i}", 0 if i % 2 else 16, 21, "30M", seq, "AA") for i in range(4)] + [("s", 0, 21, "30M", ref[20:50], "CC")] + [(f"d{i}", 0, 61, "10M3D17M", gap, "GG") for i in range(2)]
    path = sam(tmp_path, "a.sam", reads)
    marked = lines(spark, tmp_path, "dedup", path)
    assert marked[0] == "@SQ\tSN:chr1\tLN:200"
    assert sum(int(x.split("\t")[1]) & 1024 > 0 for x in marked[1:]) == 4
    vcf = lines(spark, tmp_path, "pileup", path, "-f", str(tmp_path / "ref.fa"), "-c", "-C", "-s", "2")
    assert vcf[0] == "##fileformat=VCFv4.1" and "##contig=<ID=chr1,length=200>" in vcf
    cells = [v.split("\t") for v in vcf if v[0] != "#"]
    assert [(c[1], c[3], c[4], c[9]) for c in cells] == [("30", ref[29], alt, "1/1:0,2:0,2"), ("70", ref[69:73], ref[69], "1/1:0,2:0,0")]
    frags = lines(spark, tmp_path, "group", path, "-n", "2")
    assert frags == ["chr1\t20\t50\t1:5:||\t+\t5\t60", "chr1\t60\t90\t1:2:|>\t+\t2\t60"]
    (tmp_path / "f.bed").write_text("\n".join(frags) + "\n")
    depth = lines(spark, tmp_path, "count", str(tmp_path / "f.bed"), "-n", "1")
    assert depth[0] == "chr1\t0\t20\t0\t0\t0"
    told = lines(spark, tmp_path, "pileup", path, "-f", str(tmp_path / "ref.fa"), "-v", "-s", "2")
    assert told == [f"chr1\t30\t{ref[29]}\t{ref[29]},{alt}\t1/1:1,4".replace(f"{ref[29]},{alt}\t1/1:1,4", f"{alt}\t0/0:4"), f"chr1\t70\t{ref[69]}\t{ref[69]}-3{ref[70:73]}\t0/0:2"]
    fasta = lines(spark, tmp_path, "pileup", path, "-f", str(tmp_path / "ref.fa"), "-F", "-s", "2")
    body = "".join(fasta[1:])
    assert fasta[0] == ">chr1" and len(body) == 200 and body[29] == alt and body[20] == "X" and body[:20] == "n" * 20 and body[-1] == "N"
    (tmp_path / "m.bed").write_text("chr1\t0\t100\n")
    curve = lines(spark, tmp_path, "lorenz", path, "-b", str(tmp_path / "m.bed"))
    assert curve[0] == "0.000000\t0.000000" and curve[-1] == "1.000000\t1.000000"
    assert lines(spark, tmp_path, "faidx", str(tmp_path / "ref.fa"), "chr1:61-130", "chr1:5-4") == [">chr1:61-130", ref[60:120], ref[120:130], ">chr1:5-4"]
    (tmp_path / "d.bed").write_text("chr1\t0\t50\t3\nchr1\t50\t90\t1\n")
    assert lines(spark, tmp_path, "cv", str(tmp_path / "d.bed"), "-c", "-b", str(tmp_path / "m.bed"))[0].startswith("1\t0.4")
    assert len(lines(spark, tmp_path, "cv", path, "-b", str(tmp_path / "m.bed"))) == 73
    kept = text.read_sam(spark, path)
    store.write_sorted(kept.drop("ops", "tags"), str(tmp_path / "sorted"))
    assert store.scan_region(spark, str(tmp_path / "sorted"), "chr1:88-100", {"chr1": 0}).count() == 2


def test_callers(spark, tmp_path):
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tbulk\tcell\n"
    row = lambda pos, bulk, cell: f"1\t{pos}\t.\tA\tG\t9\t.\tAMQ=60,60\tGT:ADF:ADR\t./.:{bulk}\t./.:{cell}\n"
    (tmp_path / "v.vcf").write_text(head + row(100, "15,0:15,0", "3,6:3,6") + row(5000, "15,0:15,0", "9,0:9,0") + row(9000, "9,9:9,9", "3,6:3,6"))
    got = lines(spark, tmp_path, "diff", str(tmp_path / "v.vcf"), "-P")
    assert got == [
        "NV\t1\t100\tA\tG\tAG\t6\t12\t0\tAMQ=60,60", "TP\t1\t9000\tA\tG\tAG\t18\t18", "NE\t1", "VN\t0\t0.0000", "RO\t0\t0.0000", "AO\t0\t0.0000", "BO\t0\t0.0000", "NN\t1\t1\t0\t0",
    ]
    got = lines(spark, tmp_path, "joint", str(tmp_path / "v.vcf"))
    assert [x for x in got if x[:2] not in ("CL", "CC")] == [
        "VN\t1", "SM\tcell", "NV\t1\t100\tA\tG\t30\t0\t1\tcell:6:6", "NN\t1", "NR\t0.0000", "NC\t1.00", "DN\t0", "DP\t0.0000", "DR\t0.0000", "DC\t0.00", "NA\tcell\t0.0000\t",
    ]


def test_from_alignments_to_calls(spark, tmp_path):
    """pileup writes what both callers read."""
    ref = "".join(random.Random(2).choice("ACGT") for _ in range(200))
    (tmp_path / "ref.fa").write_text(">chr1\n" + ref + "\n")
    alt = {"A": "C", "C": "G", "G": "T", "T": "A"}[ref[39]]
    plain, changed = ref[20:60], ref[20:39] + alt + ref[40:60]
    bulk = sam(tmp_path, "bulk.sam", [(f"b{i}", 16 * (i % 2), 21, "40M", plain, "") for i in range(30)])
    cells = []
    for c in ("one", "two"):
        reads = [(f"{c}{i}", 16 * (i % 2), 21, "40M", changed if i % 4 < 2 else plain, f"B{i}") for i in range(28)]
        cells.append(sam(tmp_path, f"{c}.sam", reads))
    vcf = lines(spark, tmp_path, "pileup", bulk, *cells, "-f", str(tmp_path / "ref.fa"), "-c", "-C", "-s", "2", "-L", "2", "-q", "30")
    (tmp_path / "v.vcf").write_text("\n".join(vcf) + "\n")
    row = [x.split("\t") for x in vcf if x[0] != "#"]
    assert [(r[1], r[3], r[4], r[8]) for r in row] == [("40", ref[39], alt, "GT:ADF:ADR:LTDROP:ALEN")]
    assert row[0][9] == "0/0:15,0:15,0:.:." and row[0][10].startswith("0/1:7,7:7,7:") or row[0][10].split(":")[3] != "."
    got = lines(spark, tmp_path, "diff", str(tmp_path / "v.vcf"), "-f", "20", "-1")
    assert got[0].split("\t")[:5] == ["NV", "chr1", "40", ref[39], alt]
    got = lines(spark, tmp_path, "joint", str(tmp_path / "v.vcf"), "-l", "20")
    assert [x.split("\t")[0] for x in got if x[:2] in ("NV", "JV", "NA")] == ["NV", "JV", "NA", "NA"]


def test_standard_input_and_an_index(spark, tmp_path, monkeypatch):
    import io
    import sys

    from helixframe.sources import bam

    reads = [(f"r{i}", 16 * (i % 2), 1 + 5 * i, "10M", "ACGTACGTAC", "AA") for i in range(30)]
    path = sam(tmp_path, "a.sam", reads)

    def piped(data, *args):
        monkeypatch.setattr(sys, "stdin", type("Pipe", (), {"buffer": io.BufferedReader(io.BytesIO(data))})())
        return lines(spark, tmp_path, *args)

    want = lines(spark, tmp_path, "pileup", path)
    assert len(want) > 100 and piped(open(path, "rb").read(), "pileup", "-") == want
    spark.dataSource.register(bam.Bam)
    rows = text.read_sam(spark, path).select(*[c.split()[0] for c in bam.ALIGNMENT.replace("struct<type:string,value:string>", "s").split(", ")]).na.fill(-1, ["mpos"]).orderBy("seq").coalesce(1)
    rows.write.format("bam").option("contigs", "chr1:200").mode("append").save(str(tmp_path / "bam"))
    packed = str(next((tmp_path / "bam").glob("*.bam")))
    assert piped(open(packed, "rb").read(), "pileup", "-") == want
    commands.main(["index", packed, "-o", str(tmp_path / "index")])
    some = lines(spark, tmp_path, "pileup", path, "-r", "chr1:50-60")
    assert len(some) == 11 and lines(spark, tmp_path, "pileup", packed, "-r", "chr1:50-60", "-i", str(tmp_path / "index")) == some


def test_stranded_mode_counts_by_the_fragments_strand(spark, tmp_path):
    pairs = []
    for k in range(4):  # second mates lie on the other strand than their fragment
        pairs += [(f"r{k}", 99, 11, "10M", "ACGTACGTAC", "AA"), (f"r{k}", 147, 11, "10M", "ACGTACGTAC", "AA")]
    cell = sam(tmp_path, "cell.sam", pairs)
    bulk = sam(tmp_path, "bulk.sam", [(f"b{k}", 0, 11, "10M", "ACGTACGTAC", "") for k in range(2)])
    got = lines(spark, tmp_path, "pileup", bulk, cell, "-C", "-n", "-L", "1")
    plain = lines(spark, tmp_path, "pileup", bulk, cell, "-C", "-L", "1")
    assert got[0].split("\t")[-1].split(":")[1:] == ["8", "0"] and plain[0].split("\t")[-1].split(":")[1:] == ["4", "4"]
