"""Small cases worked by hand from the operators' rules."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from slow_trim import reverse_complement

from helixframe.functions import reads as R
from helixframe.operators import cnv, coverage, dedup, fragments, intervals, joint, pileup, sv, sweep, trim, variants


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_duplicates(spark):
    data = [
        (0, "a", 99, 0, 100, 0, 300, "AAA"), (1, "b", 99, 0, 100, 0, 350, "AAA"), (2, "c", 99, 0, 100, 0, 300, "CCC"), (3, "d", 0, 0, 100, -1, -1, None), (4, "e", 0, 0, 100, -1, -1, None),
        (5, "a", 147, 0, 300, 0, 100, "AAA"), (6, "c", 147, 0, 300, 0, 100, "CCC"), (7, "b", 147, 0, 350, 0, 100, "AAA"), (8, "u", 4 | 1024, -1, -1, -1, -1, None),
    ]
    df = spark.createDataFrame(data, "seq long, qname string, flag int, tid int, pos int, mtid int, mpos int, bc string")
    out = {r.seq: bool(r.flag & 1024) for r in dedup.mark_duplicates(df).collect()}
    assert out == {0: False, 1: True, 2: False, 3: False, 4: True, 5: False, 6: False, 7: True, 8: True}
    again = dedup.mark_duplicates(dedup.mark_duplicates(df))
    assert {r.seq: bool(r.flag & 1024) for r in again.collect()} == out


def test_depth_tiers_and_histogram(spark):
    df = spark.createDataFrame([(0, 10, 20, 6, 50, False, False), (0, 15, 30, 12, 50, False, False), (0, 40, 50, 6, 30, False, False)], "tid long, st long, en long, n_frag long, mq long, lo boolean, ro boolean")
    out = fragments.count_depth(df.withColumn("n_seg", F.lit(1).cast("long")))
    assert rows(out, "st", "en", "d0", "d1", "d2") == [(0, 10, 0, 0, 0), (10, 15, 1, 0, 1), (15, 20, 2, 1, 2), (20, 30, 1, 1, 1), (30, 40, 0, 0, 0), (40, 50, 0, 0, 1)]
    assert rows(sweep.histogram(out, "d0"), "depth", "bases") == [(0, 30), (1, 15), (2, 5)]


def test_count_merge_second_tier(spark):
    df = spark.createDataFrame([(0, 10, 30, 6, 1, 50, False, True), (0, 20, 25, 6, 1, 50, False, False), (0, 28, 50, 6, 1, 50, True, False)], "tid long, st long, en long, n_frag long, n_seg long, mq long, lo boolean, ro boolean")
    out = rows(fragments.count_depth(df), "st", "en", "d0", "d1", "d2")
    assert out == [(0, 10, 0, 0, 0), (10, 20, 1, 0, 1), (20, 25, 2, 1, 2), (25, 50, 1, 1, 1)]


def _sweep_brute(items):
    points = sorted({p for s, e in items for p in (s, e)})
    return [(a, b, sum(s <= a and b <= e for s, e in items)) for a, b in zip(points, points[1:], strict=False)]


@pytest.mark.parametrize("bits", [3, 20])
def test_sweep_equals_brute_force_for_any_range(spark, bits):
    rnd = random.Random(3)
    items = [(s, s + rnd.randint(1, 40)) for s in (rnd.randint(0, 300) for _ in range(120))]
    df = spark.createDataFrame([(0, s, e) for s, e in items], "tid long, st long, en long")
    out = sweep.sweep(sweep.interval_events(df, ["tid"], "st", "en", depth="1"), ["tid"], ["depth"], range_bits=bits)
    assert rows(out, "st", "en", "depth") == _sweep_brute(items)


def test_length_rule(spark):
    df = spark.createDataFrame([(0, 0, n, False, 60) for n in (100, 100, 120, 150, 150)], "tid long, st long, en long, is_rev boolean, mapq int")
    out = fragments.fragments(fragments.grouped(df), 3).collect()
    assert [(r.st, r.en, r.n) for r in out] == [(0, 120, 5)]


def test_greedy_merge(spark):
    df = spark.createDataFrame(
        [(0, 100, 200, 100, False, 4, False, True, 14400), (0, 105, 205, 105, True, 3, True, False, 10800), (0, 196, 300, 196, False, 5, False, True, 18000)],
        "tid long, st long, en long, far_st long, is_rev boolean, n long, l_open boolean, r_open boolean, sum_mq2 long",
    )
    out = fragments.merged(df).collect()
    assert [(r.st, r.en, r.n_seg, r.n_frag, r.l_open, r.r_open) for r in out] == [(100, 300, 2, 12, False, True)]
    line = fragments.fragment_bed(fragments.merged(df), spark.createDataFrame([(0, "chr1")], "tid long, name string")).first()
    assert (line["info"], line["strand"], line["mq"]) == ("2:12:|>", "+", 60)


def test_lorenz(spark):
    hist = spark.createDataFrame([(0, 5), (1, 3), (2, 2)], "depth long, bases long")
    out = sorted((round(r.genome, 4), round(r.bases, 4)) for r in coverage.lorenz(hist).collect())
    assert out == [(0.0, 0.0), (0.5, 0.0), (0.8, 0.4286), (1.0, 1.0)]


def test_bin_variation(spark):
    depths = [2, 2, 0, 4, 1]
    runs = spark.createDataFrame([(i, i + 1, d) for i, d in enumerate(depths)], "n0 long, n1 long, depth long")
    out = {r.width: r.cv for r in coverage.bin_variation(runs, [1, 2, 5, 6]).collect()}
    assert out[1] == pytest.approx(0.737028, abs=1e-6) and out[2] == 0 and out[5] == 0 and out[6] is None


def test_bin_variation_against_loop(spark):
    rnd = random.Random(5)
    runs, n, flat = [], 0, []
    for _ in range(40):
        k, d = rnd.randint(1, 60), rnd.randint(0, 9)
        runs.append((n, n + k, d))
        n += k
        flat += [d] * k
    out = {r.width: r.cv for r in coverage.bin_variation(spark.createDataFrame(runs, "n0 long, n1 long, depth long"), [1, 3, 7, 20, 90]).collect()}
    for b, cv in out.items():
        x = np.array([sum(flat[i * b : (i + 1) * b]) for i in range(n // b)], float)
        assert cv == pytest.approx(x.std() / x.mean(), abs=1e-9)


def test_windows(spark):
    df = spark.createDataFrame([("1", p) for p in (100, 150, 400, 501)], "chrom string, pos int")
    assert rows(variants.near(df, ["chrom"], "pos", 100).filter("flt"), "pos") == [(100,), (150,)]
    base = {"chrom": "1", "ref": "A", "alt": "C"}
    sites = spark.createDataFrame([Row(**base, pos=p, all_good_alt=False, flt_snv=False, flt_bulk=False, flt_known=False) for p in (100, 150, 180)])
    cells = spark.createDataFrame([Row(**base, pos=p, sample=s, af=1, ar=1) for p, s in ((100, "c1"), (180, "c1"), (150, "c2"))])
    out = joint.shared_cell_window(sites, cells, joint.JointOptions())
    assert rows(out, "pos", "flt") == [(100, True), (150, False), (180, True)]


def test_vote(spark):
    data = [("x", 1, b) for b in "AAAC"] + [("y", 1, b) for b in "AACC"] + [("z", None, b) for b in "AAC"]
    df = spark.createDataFrame([Row(tid=0, pos=ord(s), sample=0, frag=f, base=b) for s, f, b in data], "tid int, pos int, sample int, frag int, base string")
    assert rows(pileup.vote(df).filter("dropped"), "pos", "base") == [(ord("x"), "C")]


def test_genotypes(spark):
    counts = {"p": [7, 5, 2], "q": [9, 0], "r": [3, 2]}
    df = spark.createDataFrame([Row(tid=0, pos=ord(s), sample=0, a=a, n=n) for s, v in counts.items() for a, n in enumerate(v) if n])
    only_alt = spark.createDataFrame([Row(tid=0, pos=0, sample=0, a=1, n=6)])
    out = dict(rows(pileup.genotypes(df.unionByName(only_alt), 5), "pos", "gt"))
    assert out == {ord("p"): "0/1", ord("q"): "0/0", ord("r"): "./.", 0: "1/1"}


def test_pileup_positions(spark):
    df = spark.createDataFrame([(0, "s", 0, 0, 10, 60, "2S3M1I2M2D2M", "TTACGTACGA", list(range(30, 40)), None)], "seq long, sample string, flag int, tid int, pos int, mapq int, cigar string, bases string, quals array<int>, frag long")
    out = pileup.exploded(df.withColumn("ops", R.cigar_ops("cigar")))
    got = [(r.pos, r.base, r.ins, r.del_len, r.is_del) for r in out.orderBy("pos").collect()]
    assert got == [
        (10, "A", "", 0, False), (11, "C", "", 0, False), (12, "G", "T", 0, False), (13, "A", "", 0, False), (14, "C", "", 2, False),
        (15, None, "", 0, True), (16, None, "", 0, True), (17, "G", "", 0, False), (18, "A", "", 0, False),
    ]


def one_pair(one, two, o):
    """(class, mate 1, mate 2, barcode, both bound) of a single pair of good quality."""
    import pyarrow as pa

    row = [[0], ["r"], [one], ["I" * len(one)], [two], ["I" * len(two)]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in row], ["pair_id", "name", "seq1", "qual1", "seq2", "qual2"])
    r = next(trim.trimmed_batch(batch, o)).to_pylist()[0]
    return r["type"], r["seq1"], r["seq2"], r["bc"], r["both_bound"]


def test_merge_base():

    def merged(f, fq, r, rq):
        s, q = trim.merge_bases(*(np.array([x], np.uint8) for x in (ord(f), 33 + fq, ord(r), 33 + rq)))
        return chr(s[0]), int(q[0]) - 33

    assert merged("A", 40, "A", 30) == ("A", 50)
    assert merged("A", 20, "C", 30) == ("C", 10)
    assert merged("A", 20, "C", 20) == ("C", 0)


def test_trim_classes():
    rnd, o = random.Random(1), trim.TrimOptions()
    insert = "".join(rnd.choice("ACGT") for _ in range(150))
    head = "TTGACCAA" + trim.BIND + insert[:90]
    for back, length in ((insert[20:110], 110), (insert[60:150], 150)):
        kind, a, b, bc, _ = one_pair(head, reverse_complement(back), o)
        assert (kind, bc, len(a), len(b)) == (trim.MERGED, "TTGACCAA", length, 0) and insert.startswith(a)
    assert one_pair(insert[:30], insert, o)[0] == trim.SHORT
    assert one_pair(insert[:80], insert[70:], o)[0] == trim.NO_BINDING
    assert one_pair(head, trim.BIND + insert[90:], o)[0] == trim.CHIMERA
    other = "".join(rnd.choice("ACGT") for _ in range(90))
    assert one_pair(head, other, o)[0] == trim.NOT_MERGED
    assert one_pair(head + trim.PROMOTER, other, o)[0] == trim.POST_PROMOTER


def test_structural_variant(spark):
    contigs = spark.createDataFrame([(0, "chr1", 10_000, 0)], "tid long, name string, len long, off long")
    read = lambda i: (i, 0, 0, 100, 60, "50M50S", 0, "chr1,1001,+,50S50M,60,0;")
    schema = "seq long, flag int, tid int, pos int, mapq int, cigar string, nm int, sa string"
    for n, expected in ((3, [("G", 150, 1000, -850, 3)]), (2, [])):
        b = sv.breakpoints(sv.split_sides(spark.createDataFrame([read(i) for i in range(n)], schema), contigs), contigs)
        assert rows(sv.calls(b, contigs)[0], "kind", "pos0", "pos1", "size_change", "n") == expected


def test_sv_clusters_cross_ranges(spark):
    rnd = random.Random(2)
    mids = sorted(rnd.sample(range(4000), 300))
    starts, expected = mids[0], {}
    for a, b in zip([mids[0], *mids], mids, strict=False):
        starts = b if b - a > 10 else starts
        expected[b] = starts
    df = spark.createDataFrame([(m,) for m in mids], "mid long")
    assert dict(rows(sv.clusters(df, 10, range_bits=6), "mid", "cluster")) == expected


def test_mutation_class(spark):
    df = spark.createDataFrame([(a[0], a[2]) for a in ("C>A", "G>A", "T>A", "G>C", "T>C", "T>G", "A>G")], "ref string, alt string")
    assert [r.k for r in df.select(R.mutation_class("ref", "alt").alias("k")).collect()] == ["GT", "CT", "AT", "CG", "AG", "AC", "AG"]


def _maximal_brute(s):
    """Recursive definition: take the best segment, then go on left and right of it."""
    out = []

    def go(a, b):
        best = max(((sum(s[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if best is None or best[0] <= 0:
            return
        *_, i, j = best
        out.append((i, j, best[0]))
        go(a, i)
        go(j, b)

    go(0, len(s))
    return sorted(out)


def test_maximal_segments():
    rnd = random.Random(7)
    for _ in range(200):
        s = [rnd.randint(-9, 9) + rnd.random() for _ in range(rnd.randint(0, 14))]
        got = cnv.maximal_segments(np.array(s))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in _maximal_brute(s)]
        assert cnv.best_segment(np.array(s)) == pytest.approx(max([0, *(x for *_, x in got)]))


def test_gumbel_fit():
    x = np.random.default_rng(1).gumbel(50, 7, 20000)
    mu, beta = cnv.gumbel_fit(x)
    assert mu == pytest.approx(50, abs=0.5) and beta == pytest.approx(7, abs=0.3)
    assert cnv.gumbel_cdf(cnv.gumbel_quantile(0.99, mu, beta), mu, beta) == pytest.approx(0.99)
    assert cnv.gumbel_ccdf(mu + 40 * beta, mu, beta) == pytest.approx(math.exp(-40), rel=1e-6)


def test_interval_joins(spark):
    rnd = random.Random(11)
    mask = [(rnd.randint(0, 1), s, s + rnd.randint(0, 30_000)) for s in (rnd.randint(0, 100_000) for _ in range(12))]
    items = [(i, rnd.randint(0, 1), s, s + rnd.randint(1, 20_000)) for i, s in enumerate(rnd.randint(0, 120_000) for _ in range(200))]
    m = spark.createDataFrame(mask, "chrom int, beg int, end int")
    df = spark.createDataFrame([*items, items[0]], "id int, chrom int, beg int, end int")
    hit = [i for i in [*items, items[0]] if any(c == i[1] and i[2] < e and i[3] > b and b < e for c, b, e in mask)]
    assert rows(intervals.overlapping(df, m), "id") == sorted((i[0],) for i in hit)
    assert intervals.outside(df, m).count() == len(items) + 1 - len(hit)
    covered = {(c, p) for c, b, e in mask for p in range(b, e)}
    assert sum(r.end - r.beg for r in intervals.union(m).collect()) == len(covered)


def test_poisson_mapq(spark):
    df = spark.createDataFrame([(60, 9, "100M"), (60, 0, "100M"), (60, None, "100M"), (60, 1, "50M2I50M")], "q int, nm int, cigar string").withColumn("ops", R.cigar_ops("cigar"))
    lam = 2.0
    p = 1 - math.exp(-lam) * sum(lam**k / math.factorial(k) for k in range(9))
    expected = max(0, 60 - int(-4.343 * math.log(p) + 0.499))
    assert [r.x for r in df.select(R.poisson_mapq("q", "nm", "ops", 0.02).alias("x")).collect()] == [expected, 60, 60, 60]


def test_replicates_and_options(spark):
    with pytest.raises(ValueError):
        joint.JointOptions(min_alt=3, min_alt_strand=2)
    row = lambda s, af: Row(chrom="1", pos=1, ref="A", alt="C", sample=s, rf=5, af=af, rr=4, ar=2, lt=0, alen=20, flt=False, flt_dmg=False)
    names = spark.createDataFrame([("x", "x"), ("x", "y")], "canonical string, replicate string")
    out = joint.merge_replicates(spark.createDataFrame([row("x", 3), row("y", 1), row("z", 9)]), names)
    assert rows(out, "sample", "af") == [("x", 1), ("z", 9)]
