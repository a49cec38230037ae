"""BAM by byte ranges and by its index, against the sequential decoding."""

import os
import random
import struct
from types import SimpleNamespace

import pytest

from helixframe.sources import bam, ranges

CONTIGS = [("chr1", 900_000), ("chr2", 300_000), ("tiny", 500)]


def head(contigs=CONTIGS):
    return b"BAM\1" + struct.pack("<i", 5) + b"@CO\tx" + struct.pack("<i", len(contigs)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", s) for n, s in contigs)


def alignments(n, seed, longest=400, big=False):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        tid = rnd.choice([0, 0, 0, 1, 1, 2, -1])
        size = rnd.randint(0, longest) if not (big and rnd.random() < 0.02) else 150_000
        pos = rnd.randrange(CONTIGS[tid][1]) if tid >= 0 else -1
        left = size // 3
        skip = rnd.choice([0, 0, 10, 40_000])
        cigar = f"{left}M{skip}N{size - left}M" if left and skip else f"{size}M" if size else None
        tags = {"XB": {"type": "B", "value": ",".join(["i", *(str(rnd.randrange(1 << 30)) for _ in range(rnd.randint(0, 9)))])}, "BC": {"type": "Z", "value": f"b{k}"}}
        out.append(SimpleNamespace(qname=f"read{k}" + "x" * rnd.randint(0, 30), cigar=cigar if tid >= 0 else None, bases="".join(rnd.choices("ACGTN", k=size)), quals=[rnd.randrange(60) for _ in range(size)], tags=tags, tid=tid, pos=pos, mapq=rnd.randrange(61), flag=rnd.randrange(4096), mtid=-1, mpos=-1, isize=0))
    return out


def stream(rows):
    return head() + b"".join(map(bam.encoded, rows))


def packed(data, seed):
    """Blocks of uneven sizes, some empty, that records cross."""
    rnd, out, at = random.Random(seed), [], 0
    while at < len(data):
        n = rnd.choice([0, 1, 30, 500, 5000, 0xFF00])
        out.append(bam.block(data[at : at + n]))
        at += n
    return b"".join(out) + bam.EOF


def by_ranges(path, step):
    reader = bam.BamReader({"path": path, "rangebytes": str(step)})
    parts = reader.partitions()
    return len(parts), [r for p in parts for b in reader.read(p) for r in b.to_pylist()]


@pytest.mark.parametrize("seed,big", [(1, False), (2, True)])
def test_any_range_size_gives_the_sequential_records(tmp_path, seed, big):
    rows = alignments(400, seed, big=big)
    data = packed(stream(rows), seed)
    (tmp_path / "a.bam").write_bytes(data)
    plain = stream(rows)
    want = [r[1:] for r in bam.records(plain, bam.header(plain)[2])]
    for step in (1_000_000_000, 50_000, 3_000, 200, 29):
        parts, got = by_ranges(str(tmp_path / "a.bam"), step)
        assert [tuple(dict(v) if k == "tags" else v for k, v in r.items())[1:] for r in got] == want, step
        order = [r["seq"] for r in got]
        assert order == sorted(set(order)) and (parts > 5) == (step < 50_000 or parts > 5)


def test_a_file_spreads_over_tasks_and_is_no_binary_row(spark, tmp_path):
    rows = alignments(3000, 3)
    (tmp_path / "a.bam").write_bytes(bam.compressed(stream(rows)))
    (tmp_path / "b.bam").write_bytes(bam.compressed(stream(rows[:10])))
    spark.dataSource.register(bam.Bam)
    df = spark.read.format("bam").option("rangeBytes", "40000").load(str(tmp_path))
    assert df.rdd.getNumPartitions() > 8 and "binaryFile" not in df._jdf.queryExecution().toString()
    assert sorted(r.qname for r in df.select("qname").collect()) == sorted(r.qname for r in rows + rows[:10])
    assert [r.qname for r in bam.read_bam(spark, str(tmp_path / "a.bam")).orderBy("seq").collect()] == [r.qname for r in rows]


def test_a_file_beyond_two_gigabytes(tmp_path):
    """Sparse blocks: the same block over and over, only two ranges of which are read."""
    rows = alignments(200, 5)
    body = bam.block(b"".join(map(bam.encoded, rows))[:0] + b"".join(bam.encoded(r) for r in rows[:20]))
    times = (1 << 31) // len(body) + 10
    path = tmp_path / "huge.bam"
    with open(path, "wb") as f:
        f.write(bam.block(head()))
        start = f.tell()
        f.write(body * 50)
        f.truncate(start + times * len(body))
        f.seek(start + (times - 50) * len(body))
        f.write(body * 50 + bam.EOF)
    size = os.path.getsize(path)
    assert size > 1 << 31
    reader = bam.BamReader({"path": str(path), "rangebytes": str(20 * len(body))})
    parts = reader.partitions()
    last = [p for p in parts if p.beg >> 16 > size - 40 * len(body)]
    got = [r["qname"] for p in last for b in reader.read(p) for r in b.to_pylist()]
    assert len(parts) > 1000 and got and len(got) % 20 == 0 and set(got) == {r.qname for r in rows[:20]}
    os.remove(path)


def test_cut_off_and_damaged_files(spark, tmp_path):
    data = bam.compressed(stream(alignments(50, 6)))
    (tmp_path / "a.bam").write_bytes(data[: -len(bam.EOF)])
    with pytest.raises(ValueError, match="cut off"):
        bam.read_header(str(tmp_path / "a.bam"))
    (tmp_path / "b.bam").write_bytes(bam.compressed(stream(alignments(50, 6))[:-7]))
    with pytest.raises(ValueError, match="cut off"):
        by_ranges(str(tmp_path / "b.bam"), 1 << 30)
    hurt = bytearray(data)
    hurt[len(data) // 2] ^= 0xFF
    (tmp_path / "c.bam").write_bytes(bytes(hurt))
    with pytest.raises(Exception):  # noqa: B017 - of zlib or of the check sum
        by_ranges(str(tmp_path / "c.bam"), 1 << 30)
    (tmp_path / "d.bam").write_bytes(bam.compressed(head()))
    assert by_ranges(str(tmp_path / "d.bam"), 100) == (1, []) and bam.read_bam(spark, str(tmp_path / "d.bam")).count() == 0


@pytest.mark.parametrize("longest,levels", [(1 << 29, 5), ((1 << 29) + 1, 6), (1 << 33, 7)])
def test_bins(longest, levels):
    assert ranges.levels_for(longest) == levels
    rnd = random.Random(levels)
    for _ in range(300):
        beg = rnd.randrange(longest - 1)
        end = min(longest, beg + 1 + int(rnd.expovariate(1e-5)))
        b = ranges.bin_of(beg, end, levels)
        assert any(x <= b <= y for x, y in ranges.bin_ranges(beg, end, levels))
        far = (end, min(longest, end + 100)) if end < longest else (0, 1)
        held = [(x, y) for x, y in ranges.bin_ranges(*far, levels)]
        if b and not any(x <= b <= y for x, y in held):
            assert ranges.bin_of(*far, levels) != b


@pytest.fixture(scope="module")
def sorted_file(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sorted")
    rows = sorted(alignments(12_000, 7), key=lambda r: (r.tid < 0, r.tid, r.pos))
    (folder / "a.bam").write_bytes(bam.compressed(stream(rows)))
    spark.dataSource.register(bam.Bam)
    bam.write_index(spark, str(folder / "a.bam"), str(folder / "a.index"))
    return rows, str(folder / "a.bam"), str(folder / "a.index")


REGIONS = ["chr1", "chr1:1-1", "chr1:100,000-120,000", "chr1:899,990-900,000", "chr2:150,000-150,100", "tiny", "tiny:100-101", "chr1:5,000,000-6,000,000"]


@pytest.mark.parametrize("region", REGIONS)
def test_regions_equal_a_full_scan(spark, sorted_file, region):
    from helixframe.operators.intervals import parse_region

    rows, path, index = sorted_file
    name, beg, end = parse_region(region, {"chr1", "chr2", "tiny"})
    tid = [n for n, _ in CONTIGS].index(name)
    span = lambda r: max(1, sum(int(n) for n in __import__("re").findall(r"(\d+)[MDN]", r.cigar or "")))
    want = [r.qname for r in rows if r.tid == tid and r.pos < end and r.pos + span(r) > beg]
    got = bam.read_bam(spark, path, index, region).orderBy("seq").collect()
    assert [r.qname for r in got] == want
    assert [r.qname for r in bam.read_bam(spark, path, None, region).orderBy("seq").collect()] == want


def test_a_region_reads_its_chunks_only(sorted_file, monkeypatch):
    _, path, index = sorted_file
    monkeypatch.setattr(ranges, "READ", 1 << 16)
    read = {}
    for region in ("chr1:400,000-400,500", "chr1"):
        reader = bam.BamReader({"path": path, "index": index, "region": region})
        read[region] = 0
        for p in reader.partitions():
            size = os.path.getsize(path)
            with open(path, "rb") as f:
                blocks = ranges.Blocks(f, size)
                list(reader.records(blocks, p, [n for _, n in CONTIGS]))
                read[region] += blocks.read
    size = os.path.getsize(path)
    assert size > 3_000_000 and read["chr1:400,000-400,500"] < 0.4 * size and read["chr1"] < 0.95 * size


def test_filters_are_pushed_into_the_index(spark, sorted_file):
    rows, path, index = sorted_file
    reader = bam.PushingBamReader({"path": path, "index": index})
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    given = [EqualTo(("tid",), 1), GreaterThanOrEqual(("pos",), 1000), LessThan(("pos",), 9000)]
    assert reader.pushFilters(given) == given and reader.wanted == (1, 1000, 9000)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = bam.read_bam(spark, path, index).filter("tid = 1 and pos >= 1000 and pos < 9000")
        assert sorted(r.qname for r in got.collect()) == sorted(r.qname for r in rows if r.tid == 1 and 1000 <= r.pos < 9000)
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_an_index_of_unsorted_files(spark, tmp_path):
    rows = alignments(800, 9)
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.bam").write_bytes(bam.compressed(stream(rows[k::2])))
    bam.write_index(spark, str(tmp_path / "in"), str(tmp_path / "index"))
    got = bam.read_bam(spark, str(tmp_path / "in"), str(tmp_path / "index"), "chr2:1-100,000")
    whole = bam.read_bam(spark, str(tmp_path / "in"), None, "chr2:1-100,000")
    assert sorted(r.qname for r in got.collect()) == sorted(r.qname for r in whole.collect()) != []
