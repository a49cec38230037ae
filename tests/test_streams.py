"""Streaming passes over files that come one after another, against the batch forms."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from helixframe.functions import reads as R
from helixframe.operators import cnv, fragments, sweep, trim, variants
from helixframe.plans import catalogue
from helixframe.sources import ranges
from helixframe.streaming import passes


def fed(spark, tmp_path, rows, schema, parts):
    """A stream of rows in order, a file a batch."""
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_marks_reach_the_mate_that_comes_later(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(k, f"q{k // 2}", bool(k % 2 == 0 and rnd.random() < 0.5)) for k in range(60)] + [(100, "lone", True)]
    order = sorted(rows, key=lambda r: (r[0] % 2, r[0]))  # all first mates, then all second ones
    got = passes.drained(passes.flag_mates(fed(spark, tmp_path, order, "k long, name string, dup boolean", 3), "name", "dup", {"k": "long", "name": "string"}), str(tmp_path / "s"))
    first = {name: dup for k, name, dup in rows if k % 2 == 0}
    assert {r.k: r.is_dup for r in got.collect()} == {k: first[name] or dup for k, name, dup in rows}


def test_rows_alone_equal_the_batch_filter(spark, tmp_path):
    rnd = random.Random(4)
    rows = sorted({(rnd.choice("ab"), rnd.randrange(3000)) for _ in range(150)}, key=lambda r: r[1]) + [("a", passes.END), ("b", passes.END)]
    stream = fed(spark, tmp_path, rows, "chrom string, pos long", 3)
    got = passes.drained(passes.alone(stream, 10), str(tmp_path / "s"))
    batch = spark.createDataFrame(rows[:-2], "chrom string, pos long")
    want = variants.near(batch, ["chrom"], "pos", 10).filter("not flt")
    assert sorted(map(tuple, got.collect())) == sorted((r.chrom, r.pos) for r in want.collect())


def test_trimming_a_stream_equals_the_batch(spark, tmp_path):
    rnd = random.Random(5)
    rest = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    rows = [(k, f"r{k}", one := rest(8) + trim.BIND + rest(60), "I" * len(one), two := rest(70), "I" * len(two)) for k in range(30)]
    shape = "pair_id long, name string, seq1 string, qual1 string, seq2 string, qual2 string"
    got = passes.drained(passes.trimmed(fed(spark, tmp_path, rows, shape, 2)), str(tmp_path / "s"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, trim.trim(spark.createDataFrame(rows, shape)).collect()))


def test_starts_and_bins_of_columns(spark):
    ends = spark.createDataFrame([("a", 10), ("a", 25), ("b", 7)], "chrom string, en long")
    assert sorted(map(tuple, cnv.implicit_starts(ends).select("chrom", "st", "en").collect())) == [("a", 0, 10), ("a", 10, 25), ("b", 0, 7)]
    rnd = random.Random(6)
    spans = [(beg, beg + 1 + int(rnd.expovariate(1e-5))) for beg in (rnd.randrange(1 << 28) for _ in range(200))]
    got = spark.createDataFrame(spans, "beg long, end long").select("beg", "end", R.bin_of(F.col("beg"), F.col("end")).alias("b")).collect()
    assert all(r.b == ranges.bin_of(r.beg, r.end) for r in got)


def _reads(seed):
    rnd = random.Random(seed)
    rows = [(t, st, st + rnd.choice([0, 1, 30, 60]), rnd.random() < 0.5, rnd.randrange(70)) for t in (0, 1) for st in (rnd.randrange(900) * (t + 1) for _ in range(120))]
    return sorted(rows, key=lambda r: (r[1], r[0])), [(t, passes.END, passes.END, None, None) for t in (0, 1)]


READS = "tid long, st long, en long, is_rev boolean, mapq int"


def test_groups_and_depth_over_batches_equal_the_batch_forms(spark, tmp_path):
    rows, last = _reads(7)
    batch = spark.createDataFrame(rows, READS)
    got = passes.grouped(fed(spark, tmp_path / "g", rows + last, READS, 5), str(tmp_path / "gs"))
    want = fragments.grouped(batch).select("tid", "is_rev", "anchor", "n", "sum_mq2", "longest")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    got = passes.depth(fed(spark, tmp_path / "d", rows + last, READS, 5).select("tid", "st", "en"), str(tmp_path / "ds"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sweep.depth(batch, ["tid"], "st", "en").collect()))


def test_a_contig_of_a_stream_is_no_one_python_task(spark, tmp_path, monkeypatch):
    rows, last = _reads(8)
    monkeypatch.setattr(passes, "_in_order", None)
    for k, run in enumerate((passes.grouped, passes.depth)):
        plans = []
        seen = passes.folded
        monkeypatch.setattr(passes, "folded", lambda stream, step, shape, folder, seen=seen: seen(stream, lambda *x: plans.append(out := step(*x)) or out, shape, folder))
        run(fed(spark, tmp_path / f"in{k}", rows + last, READS, 2), str(tmp_path / f"s{k}"))
        assert len(plans) == 2 and not any("Python" in p or "Pandas" in p for p in (x._jdf.queryExecution().optimizedPlan().toString() for x in plans))
        monkeypatch.setattr(passes, "folded", seen)


EVENTS = "id long, user long, kind string"


def flagged(spark, tmp_path, rows, parts, keep=None):
    stream = fed(spark, tmp_path, rows, EVENTS, parts)
    return passes.flag_duplicates(stream, ["user", "kind"], "id", {"id": "long", "kind": "string"}, str(tmp_path / "s"), keep)


def test_duplicates_over_batches_are_flagged_by_plans_without_a_task_a_key(spark, tmp_path, monkeypatch):
    rnd = random.Random(9)
    rows = [(k, rnd.choice([None, *[7] * 20, *range(40)]), rnd.choice(["a", "b", None])) for k in range(398)] + [(None, 7, "a"), (None, 99, "a")]
    rnd.shuffle(rows)
    plans, seen = [], passes.folded
    monkeypatch.setattr(passes, "folded", lambda stream, step, *x, **y: seen(stream, lambda *z: plans.append(out := step(*z)) or out, *x, **y))
    got = flagged(spark, tmp_path, rows, 4)
    known, want = set(), []
    for k in range(4):
        for r in sorted(rows[k * 100 : k * 100 + 100], key=lambda r: (r[0] is None, r[0])):
            want.append((r[0], r[2], r[1:] in known))
            known.add(r[1:])
    assert got.columns == ["id", "kind", "is_dup"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    texts = [x._jdf.queryExecution().optimizedPlan().toString() for x in plans]
    windows = [line for t in texts for line in t.splitlines() if "Window [" in line]
    assert len(texts) == 4 and not any("Python" in t or "Pandas" in t for t in texts)
    assert len(windows) == 4 and all("[_key0#" in w and "_order#" in w.split("[_key0#")[1].split("]")[0] for w in windows)  # rows meet by key and order


def test_a_key_goes_once_it_has_been_silent(spark, tmp_path, monkeypatch):
    clock = iter([1000, 1010, 1020, 1040])
    monkeypatch.setattr(passes, "time", SimpleNamespace(time=lambda: next(clock)))
    rows = [(0, 1, "a"), (1, 2, "a"), (2, 1, "a"), (3, 3, "a"), (4, 1, "a"), (5, 2, "a"), (6, 1, "a"), (7, 1, "a")]
    got = {r.id: r.is_dup for r in flagged(spark, tmp_path, rows, 4, "12 seconds").collect()}
    # user 1 comes at 0, 10 and 20, and is silent until 40; user 2 from 0 to 20
    assert got == {0: False, 1: False, 2: True, 3: False, 4: True, 5: False, 6: False, 7: True}


@pytest.mark.parametrize("name, total", [("stream_dedup", "count(*)"), ("stream_depth", "sum(n)")])
def test_events_may_be_a_folder_of_files(spark, tmp_path, name, total):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    assert catalogue.QUERIES[name](spark, str(tmp_path)).selectExpr(total).first()[0] == rows.count()
