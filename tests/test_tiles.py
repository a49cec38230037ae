"""Counts by tiles against a row a base, on random reads with indels, clips and skips."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import reads as R
from helixframe.operators import pileup, tiles

READS = "seq long, sample string, flag int, tid long, pos int, mapq int, cigar string, bases string, quals array<int>, frag long"


def random_reads(spark, n, seed, width=300):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        ops = [(rnd.randint(1, 6), "S")] if rnd.random() < 0.3 else []
        if rnd.random() < 0.1:
            ops = [(4, "H"), *ops]
        for _ in range(rnd.randint(1, 4)):
            ops += [(rnd.randint(1, 30), rnd.choice("MMM=X")), rnd.choice([(rnd.randint(1, 3), "I"), (rnd.randint(1, 4), "D"), (rnd.randint(5, 60), "N"), (1, "P")])]
        ops = ops[:-1] if rnd.random() < 0.8 else ops
        ops += [(rnd.randint(1, 5), "S")] if rnd.random() < 0.3 else []
        size = sum(x for x, o in ops if o in "MIS=X")
        bases = "".join(rnd.choice("ACGTacgtN") for _ in range(size))
        quals = [rnd.randint(2, 40) for _ in range(size)]
        bases, quals = rnd.choice([(bases, quals)] * 12 + [(bases, None), (None, None), (bases, quals[:-2]), (bases[:-2], quals)])
        rows.append((k, rnd.choice("ab"), rnd.choice([0, 16, 99, 147]), rnd.randrange(2), rnd.randrange(width), rnd.randrange(70), "".join(f"{x}{o}" for x, o in ops), bases, quals, rnd.choice([None, 1, 2, 3])))
    return spark.createDataFrame(rows, READS).withColumn("ops", R.cigar_ops("cigar"))


@pytest.mark.parametrize("bits,bases,few,weight", [(12, 4_000_000, 100_000, None), (5, 200, 100_000, "q"), (6, 200, 0, None)])
def test_counts_equal_exploded_bases(spark, monkeypatch, bits, bases, few, weight):
    monkeypatch.setattr(tiles, "TILE_BITS", bits)
    monkeypatch.setattr(tiles, "TILE_BASES", bases)
    monkeypatch.setattr(tiles, "BROADCAST_TILES", few)
    reads = random_reads(spark, 250, bits + bases)
    least = F.when(F.col("sample") == "a", 10).otherwise(20)
    allele = ["base", "ins", "del_len"]
    voted = pileup.vote(pileup.kept(pileup.exploded(reads).withColumn("frag", F.when(F.col("sample") == "b", F.col("frag"))), least, 2), allele)
    want = pileup.allele_counts(voted.filter("not dropped"), allele, weight=weight)
    lost = pileup.dropped_reads(voted)
    got, dropped = tiles.counted(reads, least, 2, F.when(F.col("sample") == "b", F.col("frag")), weight)
    names = ["tid", "pos", "sample", *allele, "n", "fwd", "rev", "raw", "sum_mq2", "sum_alen"]
    shown = lambda df, cols: sorted(map(tuple, df.select(*cols).collect()))
    assert shown(got, names) == shown(want, names) != []
    assert shown(dropped, ["tid", "pos", "dropped"]) == shown(lost, ["tid", "pos", "dropped"]) != []


def test_strand_and_no_reads(spark):
    reads = random_reads(spark, 40, 3).withColumn("_strand", F.lit(True))
    got, _ = tiles.counted(reads)
    assert {r.fwd for r in got.collect()} == {0}
    assert {r.is_rev for r in pileup.exploded(reads).collect()} == {True}
    none, dropped = tiles.counted(reads.limit(0))
    assert none.count() == dropped.count() == 0


def test_combinations_are_numbered_by_a_table(monkeypatch):
    rng = np.random.default_rng(2)
    columns = [rng.integers(-5, 60, 500), rng.choice([65, 67, 71, 84, 1 << 40], 500), rng.integers(0, 3, 500)]
    _, want = np.unique(np.array(columns).T, axis=0, return_inverse=True)
    for table in (1, 40, 1000, 1 << 22):
        monkeypatch.setattr(tiles, "TABLE", table)
        got = tiles._dense(*columns)
        assert (got == want.ravel()).all() and (tiles._first(got) == np.unique(want, return_index=True)[1]).all()
    # of small keys, as a tile's are, none is sorted
    monkeypatch.setattr(np, "unique", None)
    assert (tiles._dense(*[c % 50 for c in columns]) >= 0).all() and len(tiles._dense(np.zeros(0, np.int64))) == 0
