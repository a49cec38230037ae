"""Trimming in batches against the slow form, on random pairs of all classes."""

import random

import numpy as np
import pyarrow as pa
import pytest
import slow_trim as slow

from helixframe.operators import trim


def rest(rnd, n):
    return "".join(rnd.choice("ACGT") for _ in range(n))


def spoiled(rnd, s, rate):
    return "".join(rnd.choice("ACGTNacgt") if rnd.random() < rate else c for c in s)


def pair(rnd):
    """A pair of one of the shapes that the protocol gives, spoiled a little."""
    insert = rest(rnd, rnd.choice([5, 20, 38, 45, 60, 90, 140]))
    motif, promoter, bc = trim.BIND, trim.PROMOTER, rest(rnd, rnd.randint(0, 10))
    shape = rnd.randrange(9)
    front = rnd.choice([bc, promoter, promoter[-rnd.randint(3, 20) :], bc + promoter])
    one = front + motif + insert
    if shape == 1:
        one = insert
    elif shape == 2:
        one = front + motif + rest(rnd, 12) + motif + rest(rnd, 5) + motif + insert
    elif shape == 3:
        one = one + promoter
    elif shape == 4:
        one = one + rnd.choice([trim.OLIGO_FORWARD, trim.BIND_REVERSE, trim.ADAPTER1])[: rnd.randint(2, 20)]
    two = slow.reverse_complement(one)
    if shape == 5:
        two = rest(rnd, rnd.choice([30, 50, 100]))
    elif shape == 6:
        two = rnd.choice([promoter, bc, promoter[-10:]]) + motif + rest(rnd, rnd.choice([20, 60]))
    elif shape == 7:
        two = slow.reverse_complement(insert[rnd.randint(0, 10) :] + rest(rnd, 20))
    elif shape == 8:
        one, two = two, one
    one, two = one[: rnd.choice([60, 100, 400])], two[: rnd.choice([50, 100, 400])]
    if rnd.random() < 0.3:
        one, two = "N" * rnd.randint(0, 4) + one, two + "N" * rnd.randint(0, 4)
    if rnd.random() < 0.2:
        two = trim.BIND[-rnd.randint(3, 12) :] + two
    if rnd.random() < 0.2:
        one, two = one + trim.ADAPTER1[: rnd.randint(0, 30)], two + trim.ADAPTER2[: rnd.randint(0, 30)]
    rate = rnd.choice([0, 0, 0.01, 0.05])
    one, two = spoiled(rnd, one, rate), spoiled(rnd, two, rate)
    qual = lambda s: "".join(rnd.choice("#+5?I" if rate else "II?") for _ in s)
    return one, qual(one), two, qual(two)


@pytest.mark.parametrize("cells", [2_000_000, 3_000])
@pytest.mark.parametrize("options", [trim.TrimOptions(), trim.TrimOptions(barcode=3, min_length=20, overlap=(6, 1), adapter=(4, 2), promoter=(8, 3))])
def test_batches_equal_the_slow_form(monkeypatch, cells, options):
    monkeypatch.setattr(trim, "CELLS", cells)
    rnd = random.Random(cells)
    rows = [pair(rnd) for _ in range(2500)] + [("", "", "", ""), ("NNN", "III", "N", "I"), ("A" * 50, "I" * 50, "", "")]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array([f"r{k}" for k in range(len(rows))]), *(pa.array(c) for c in zip(*rows))], ["pair_id", "name", "seq1", "qual1", "seq2", "qual2"])
    got = {r["pair_id"]: tuple(r.values())[1:] for part in trim.trimmed_batch(batch, options) for r in part.to_pylist()}
    seen = set()
    for k, (s1, q1, s2, q2) in enumerate(rows):
        kind, a, b, bc, both = slow.process(slow.Read(s1, q1), slow.Read(s2, q2), options)
        seen.add(kind)
        assert got[k] == (f"r{k}", kind, a.seq, a.qual, b.seq, b.qual, bc, both), (k, rows[k])
    assert len(got) == len(rows) and seen == {1, 2, 3, 4, 5, 6, 11, 12, 21, 22, 23}


def test_consensus_equals_the_slow_form():
    rnd = random.Random(3)
    cells = [(rnd.choice("ACGTacgtN"), chr(33 + rnd.randint(0, 60)), rnd.choice("ACGTacgtN"), chr(33 + rnd.randint(0, 60))) for _ in range(500)]
    at = [np.frombuffer("".join(c).encode(), np.uint8) for c in zip(*cells)]
    s, q = trim.merge_bases(*at)
    assert [(chr(a), chr(b)) for a, b in zip(s, q)] == [slow.merge_base(*c) for c in cells]


def test_null_reads_and_no_rows(spark):
    shape = "pair_id long, name string, seq1 string, qual1 string, seq2 string, qual2 string"
    got = trim.trim(spark.createDataFrame([(1, "a", None, None, "ACGT", "IIII")], shape)).first()
    assert (got.type, got.seq1, got.seq2) == (trim.SHORT, "", "ACGT")
    assert trim.trim(spark.createDataFrame([], shape)).count() == 0
