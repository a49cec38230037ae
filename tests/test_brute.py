"""Greedy and random operators against slow, independent versions on random data."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slow_trim import reverse_complement

from helixframe.operators import cnv, fragments, intervals, trim

COUNTED = "tid long, st long, en long, n_frag long, n_seg long, mq long, lo boolean, ro boolean"


def slow_count(frags, n1, n2, min_mq):
    """One contig, fragment by fragment: merge, threshold, write out what lies before the next start."""
    queue, out, at, begun = [], [], 0, False

    def write_to(stop):
        nonlocal at
        while True:
            ends = [g["en"] for g in queue if g["en"] > at]
            edge = min([*ends, stop]) if stop is not None else min(ends, default=None)
            if edge is None or edge <= at:
                return
            live = [g for g in queue if g["st"] <= at < g["en"]]
            good = [g for g in live if g["mq"] >= min_mq]
            out.append((at, edge, len(good), sum(g["n_frag"] >= n2 for g in good), len(live)))
            at = edge

    for f in sorted(frags, key=lambda r: (r["st"], r["en"], r["n_frag"], r["mq"])):
        f = dict(f)
        fits = [g for g in queue if f["lo"] and g["ro"] and f["st"] < g["en"] <= f["en"]]
        if fits:
            g = max(fits, key=lambda g: g["en"])
            g["en"], g["ro"], g["n_frag"], g["n_seg"] = f["en"], f["ro"], g["n_frag"] + f["n_frag"], g["n_seg"] + 1
        elif f["n_frag"] >= n1:
            write_to(f["st"])
            queue.append(f)
            begun = True
    if begun:
        write_to(None)
    return out


@pytest.mark.parametrize("bits", [3, 20])
def test_count_equals_the_sequential_pass(spark, bits):
    rnd = random.Random(5)
    cases = {}
    for tid in range(150):
        rows = []
        for _ in range(rnd.randint(1, 25)):
            st = rnd.randint(0, 90)
            rows.append({"st": st, "en": st + rnd.randint(1, 40), "n_frag": rnd.randint(1, 14), "n_seg": 1, "mq": rnd.choice([20, 40, 60]), "lo": rnd.random() < 0.4, "ro": rnd.random() < 0.4})
        cases[tid] = rows
    df = spark.createDataFrame([(t, r["st"], r["en"], r["n_frag"], 1, r["mq"], r["lo"], r["ro"]) for t, rows in cases.items() for r in rows], COUNTED)
    got = {}
    for r in fragments.count_depth(df, 5, 10, 40, range_bits=bits).collect():
        got.setdefault(r.tid, []).append((r.st, r.en, r.d0, r.d1, r.d2))
    for tid, rows in cases.items():
        # boundaries of equal depth may be cut at more places by either: compare per position
        flat = lambda segs: {p: d for st, en, *d in segs for p in range(st, en)}
        assert flat(sorted(got.get(tid, []))) == flat(slow_count(rows, 5, 10, 40)), tid


FRAGS = "tid long, st long, en long, far_st long, is_rev boolean, n long, l_open boolean, r_open boolean, sum_mq2 long"


def slow_merge(rows):
    """One contig: cut into islands, then three passes over each island's list."""
    rows = sorted(rows, key=lambda r: (r["far_st"], r["en"], r["is_rev"], r["n"]))
    islands, reach = [], None
    for r in rows:
        if reach is None or r["far_st"] >= reach:
            islands.append([])
        islands[-1].append(dict(r, n_frag=r["n"], n_seg=1))
        reach = max(reach or 0, r["en"])

    def sweep_over(items, test, join):
        i = 0
        while i < len(items):
            p, j = items[i], i + 1
            while j < len(items):
                q = items[j]
                if q["st"] >= p["en"]:
                    break
                if test(p, q):
                    join(p, q)
                    p["n_frag"] += q["n_frag"]
                    p["sum_mq2"] += q["sum_mq2"]
                    del items[j]
                else:
                    j += 1
            i += 1

    out = []
    for items in islands:
        items.sort(key=lambda r: (r["st"], r["is_rev"], r["en"], r["n"]))
        sweep_over(items, lambda p, q: p["is_rev"] == q["is_rev"] and (abs(q["en"] - p["en"]) if p["is_rev"] else q["st"] - p["st"]) <= 2, lambda p, q: p.update(en=max(p["en"], q["en"])))
        sweep_over(items, lambda p, q: p["r_open"] and q["l_open"] and q["en"] >= p["en"] and q["st"] - p["st"] <= 10, lambda p, q: p.update(en=q["en"], r_open=False))
        sweep_over(items, lambda p, q: 7 <= p["en"] - q["st"] <= 11, lambda p, q: p.update(en=q["en"], r_open=q["r_open"], n_seg=p["n_seg"] + 1))
        out += [(r["st"], r["en"], r["n_seg"], r["n_frag"], r["l_open"], r["r_open"], r["is_rev"], r["sum_mq2"]) for r in items]
    return sorted(out)


@pytest.mark.parametrize("bits", [3, 20])
def test_merge_equals_the_sequential_passes(spark, bits):
    rnd = random.Random(8)
    cases = {}
    for tid in range(150):
        rows = []
        for _ in range(rnd.randint(1, 20)):
            rev, st = rnd.random() < 0.5, rnd.randint(0, 120)
            en = st + rnd.randint(5, 40)
            rows.append({"st": st, "en": en, "far_st": st - rnd.randint(0, 4) * rev, "is_rev": rev, "n": rnd.randint(1, 9), "l_open": rev, "r_open": not rev, "sum_mq2": rnd.randint(0, 900)})
        cases[tid] = list({(r["st"], r["is_rev"], r["en"], r["n"]): r for r in rows}.values())
    df = spark.createDataFrame([(t, *(r[c] for c in "st en far_st is_rev n l_open r_open sum_mq2".split())) for t, rows in cases.items() for r in rows], FRAGS)
    got = {}
    for r in fragments.merged(df, range_bits=bits).collect():
        got.setdefault(r.tid, []).append((r.st, r.en, r.n_seg, r.n_frag, r.l_open, r.r_open, r.is_rev, r.sum_mq2))
    for tid, rows in cases.items():
        assert sorted(got[tid]) == slow_merge(rows), tid


def test_a_dense_contig_is_folded_in_ranges(spark):
    """20,000 overlapping fragments, which no gap cuts: the rows of one range and the open fragments are all that a task holds."""
    rnd = random.Random(11)
    rows = []
    for k in range(20_000):
        st, rev = 5 * k + rnd.randint(0, 4), rnd.random() < 0.5
        rows.append((0, st, st + rnd.randint(200, 900), st - rnd.randint(0, 4) * rev, rev, rnd.randint(1, 9), rev, not rev, rnd.randint(0, 900)))
    df = spark.createDataFrame(rows, FRAGS)
    shown = lambda bits: sorted(map(tuple, fragments.merged(df, range_bits=bits).collect()))
    whole, cut = shown(20), shown(13)
    assert whole == cut and len(whole) < 20_000


def test_trimming_finds_the_template(spark):
    rnd = random.Random(4)
    pairs, truth = [], {}
    for i in range(300):
        template, barcode = ("".join(rnd.choice("ACGT") for _ in range(n)) for n in (rnd.randint(50, 150), 8))
        whole = barcode + trim.BIND + template
        one, two = whole[:120], reverse_complement(whole)[:100]
        if i % 3 == 0:  # a wrong base of low quality in the second mate
            at = rnd.randrange(len(two))
            two = two[:at] + rnd.choice("ACGT".replace(two[at], "")) + two[at + 1 :]
            qual2 = "I" * at + "#" + "I" * (len(two) - at - 1)
        else:
            qual2 = "I" * len(two)
        pairs.append((i, f"r{i}", one, "I" * len(one), two, qual2))
        truth[i] = (template, barcode, len(one) + len(two) - len(whole))
    df = spark.createDataFrame(pairs, "pair_id long, name string, seq1 string, qual1 string, seq2 string, qual2 string")
    merged = 0
    for r in trim.trim(df).collect():
        template, barcode, shared = truth[r.pair_id]
        assert r.bc == barcode
        if shared >= 12:
            merged += r.type == trim.MERGED
            if r.type == trim.MERGED and r.pair_id % 3:
                cut = template[len(r.seq1) :]  # an end that reads like the head of an oligonucleotide goes
                assert template == r.seq1 + cut and (not cut or any(o.startswith(cut[:3]) for o in (trim.OLIGO_FORWARD, trim.BIND_REVERSE)))
        elif shared < 4:
            assert r.type in (trim.NOT_MERGED, trim.MERGED, trim.AMBIGUOUS_MERGE, trim.SHORT_PAIR)
    assert merged >= 0.8 * sum(s >= 12 for *_, s in truth.values())


@pytest.mark.parametrize("chunk", [3, 50, 10_000])
def test_permutations_by_counts_are_permutations(chunk):
    values, counts = np.array([5.0, -2.0, -0.5, 1.5]), np.array([20, 60, 15, 30])
    scores = np.repeat(values, counts)
    drawn = [cnv.permuted_best(values, counts, np.random.default_rng(i), chunk) for i in range(600)]
    plain = [cnv.best_segment(np.random.default_rng(9000 + i).permutation(scores)) for i in range(600)]
    assert abs(np.mean(drawn) - np.mean(plain)) < 4 * np.hypot(np.std(drawn), np.std(plain)) / np.sqrt(600)
    assert abs(np.quantile(drawn, 0.9) - np.quantile(plain, 0.9)) < 0.25 * np.std(plain) + 1.5


@pytest.mark.parametrize("touching", [False, True])
def test_islands_do_not_depend_on_ranges(spark, touching):
    rnd = random.Random(12)
    rows = sorted({(rnd.choice([None, 1, 2]), st, st + rnd.randint(1, 25)) for st in (rnd.randint(0, 900) for _ in range(160))}, key=str)
    df = spark.createDataFrame(rows, "tid long, st long, en long")
    expected = {}
    for tid in {t for t, *_ in rows}:
        reach, n = None, 0
        for st, en in sorted((s, e) for t, s, e in rows if t == tid):
            n += reach is None or (st > reach if touching else st >= reach)
            reach = max(reach or 0, en)
            expected[tid, st, en] = n
    for bits in (2, 5, 20):
        got = {(r.tid, r.st, r.en): r.island for r in intervals.islands(df, ["tid"], ["st", "en"], "st", "en", touching, bits).collect()}
        assert got == expected


def maximal_by_definition(scores):
    """Segments whose every proper start and end part has a positive sum, of those the ones inside no other."""
    run = [0]
    for x in scores:
        run.append(run[-1] + x)
    good = [(a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1) if all(run[a] < run[k] for k in range(a + 1, b + 1)) and all(run[k] < run[b] for k in range(a, b))]
    return sorted((a, b, float(run[b] - run[a])) for a, b in good if not any((c, d) != (a, b) and c <= a and b <= d for c, d in good))


def test_maximal_segments_by_their_definition():
    rnd = random.Random(3)
    for _ in range(200):
        scores = [rnd.randint(-5, 5) for _ in range(rnd.randint(0, 18))]
        assert cnv.maximal_segments(np.array(scores, float)) == maximal_by_definition(scores)


def test_segments_compose_for_any_cut():
    rnd = random.Random(7)
    for turn in range(1500):
        n = rnd.randint(1, 40)
        lean = rnd.choice([-1, 0, 1])
        scores = [float(rnd.randint(-6 + lean, 6 + lean)) for _ in range(n)]
        want = cnv.maximal_segments(np.array(scores))
        parts, a, gone = [], 0, []
        while a < n:
            b = min(n, a + rnd.randint(1, 9))
            parts.append(cnv.candidates(range(a, b), range(a + 1, b + 1), scores[a:b]))
            a = b
        assert [(a, b, hi - lo) for a, b, lo, hi in cnv.joined(parts)[1]] == want
        # a tree of uneven groups, in which settled candidates stay behind
        def open_of(total, held):
            done = cnv.settled_inside(total, held)
            gone.extend(h for h, d in zip(held, done) if d)
            return total, [h for h, d in zip(held, done) if not d]

        parts = [open_of(*p) for p in parts]
        while len(parts) > 1:
            k = rnd.randint(2, 4)
            parts = [open_of(*cnv.joined(parts[i : i + k])) for i in range(0, len(parts), k)]
        every = [(a, b) for a, b, *_ in [*gone, *parts[0][1]]]
        top = sorted((a, b) for a, b in set(every) if not any((c, d) != (a, b) and c <= a and b <= d for c, d in every))
        assert top == [(a, b) for a, b, _ in want], (turn, scores)


@pytest.mark.parametrize("bits,together", [(3, 2), (5, 3), (20, 16)])
def test_segments_do_not_depend_on_ranges(spark, bits, together):
    rnd = random.Random(bits)
    rows, want = [], []
    for kind in ("gain", "loss1"):
        for chrom in ("1", "2", "3"):
            n = rnd.randint(1, 120)
            scores = [float(rnd.randint(-6, 6)) for _ in range(n)]
            rows += [(kind, chrom, k, k + 1, s) for k, s in enumerate(scores)]
            want += [(kind, chrom, a, b, s) for a, b, s in cnv.maximal_segments(np.array(scores))]
    df = spark.createDataFrame(rows, "kind string, chrom string, st long, en long, score double")
    assert sorted(map(tuple, cnv.segments_by_ranges(df, bits, together).collect())) == sorted(want)


def test_planted_copy_numbers_are_called(spark):
    rnd = random.Random(21)
    rows, planted = [], {("gain", "c1", 600_000, 800_000), ("loss1", "c1", 1_400_000, 1_500_000), ("loss2", "c2", 300_000, 360_000)}
    inside = lambda kind, c, at: any(k == kind and c == ch and a <= at < b for k, ch, a, b in planted)
    for c in ("c1", "c2"):
        for k in range(2000):
            at = 1000 * k
            gain, one, two = (inside(kind, c, at) for kind in cnv.KINDS)
            noise = rnd.random() < 0.02
            d1 = 3 if gain or noise else 2
            d0 = 0 if two else d1 + 1 if gain else 2
            rows.append((c, at, at + 1000, d0, d1, 0 if two else 1 if one else 3, False))
    calls, fit = cnv.call(spark.createDataFrame(rows, "chrom string, st long, en long, d0 int, d1 int, d2 int, flt boolean"))
    got = [(r.kind, r.chrom, r.st, r.en) for r in calls.collect()]
    assert {g for g in got if g[0] == "gain"} == {p for p in planted if p[0] == "gain"}
    assert {g for g in got if g[0] == "loss2"} == {p for p in planted if p[0] == "loss2"}
    assert {p for p in planted if p[0] == "loss1"} <= set(got)
    assert all(r.p < 1e-3 for r in calls.collect()) and {r.kind for r in fit.collect()} == set(cnv.KINDS)


def test_permutations_are_dealt_over_tasks_with_the_orders_of_one_pass(spark, monkeypatch):
    monkeypatch.setattr(cnv, "BLOCK", 7)
    values, counts = np.array([0.3, -0.7, 1.1]), np.array([40, 50, 20])
    for seed in range(20):
        rng, run = np.random.default_rng(seed), [0.0]
        for x in rng.permutation(np.repeat(values, counts)):
            run.append(run[-1] + x)
        run = np.array(run)
        assert cnv.permuted_best(values, counts, np.random.default_rng(seed)) == float((run - np.minimum.accumulate(run)).max())
    rows = spark.createDataFrame([(kind, s) for kind in cnv.KINDS for s in (1.0, -1.0, -1.0)], "kind string, score double")
    tasks = cnv.permuted_maxima(rows, 48, 3).withColumn("task", F.spark_partition_id())
    assert {(r.kind, r.n) for r in tasks.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {(k, 48) for k in cnv.KINDS}
    assert tasks.select("task").distinct().count() == 48
