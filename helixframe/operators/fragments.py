"""From reads to original fragments: grouping, the length rule, greedy merges."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.reads import DUPLICATE, PROPER, READ1, REVERSE, SUPPLEMENTARY, UNMAPPED, has, rms

from .stages import settled
from .sweep import sweep

MAX_SEGMENT = 10_000


def read_ends(reads: DataFrame, max_segment: int = MAX_SEGMENT) -> DataFrame:
    """(tid, st, en, is_rev, mapq, seq) of the reads that can be grouped: mapped, primary, with a barcode, sane pairs."""
    ok = ~has("flag", UNMAPPED | DUPLICATE | SUPPLEMENTARY) & F.col("sa").isNull() & F.col("bc").isNotNull()
    proper = has("flag", PROPER)
    sane = ~proper | ((F.col("tid") == F.col("mtid")) & F.col("isize").between(0, max_segment))
    df = reads.filter(ok & sane)
    return df.select(
        "tid",
        F.col("pos").alias("st"),
        (F.col("pos") + F.when(proper, F.col("isize")).otherwise(F.col("rlen"))).alias("en"),
        F.when(proper, ~has("flag", READ1)).otherwise(has("flag", REVERSE)).alias("is_rev"),
        "mapq",
        "seq",
    )


def grouped(reads: DataFrame) -> DataFrame:
    """(tid, is_rev, anchor, n, sum_mq2, lengths) per 5' end; ``lengths`` maps a length to its count, so a group stays small however many reads it has."""
    anchor = F.when(F.col("is_rev"), F.col("en")).otherwise(F.col("st"))
    q = F.least(F.col("mapq"), F.lit(60)).cast("long")
    by_length = reads.groupBy("tid", "is_rev", anchor.cast("long").alias("anchor"), (F.col("en") - F.col("st")).cast("long").alias("len")).agg(F.count("*").alias("c"), F.sum(q * q).alias("s"))
    return by_length.groupBy("tid", "is_rev", "anchor").agg(
        F.sum("c").alias("n"), F.sum("s").alias("sum_mq2"), F.max("len").alias("longest"), F.sort_array(F.collect_list(F.struct(F.col("len"), F.col("c")))).alias("lengths")
    )


def fragment_length(lengths: str, k: int):
    """The greater of the k-th largest and the most frequent length (the smallest of equals)."""
    col = F.col(lengths)
    top = F.aggregate(
        F.reverse(col),
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at")),
        lambda t, x: F.struct((t["seen"] + x["c"]).alias("seen"), F.when(t["at"].isNull() & (t["seen"] + x["c"] >= k), x["len"]).otherwise(t["at"]).alias("at")),
    )["at"]
    mode = F.aggregate(
        col, F.struct(F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("len")), lambda t, x: F.when(x["c"] > t["c"], F.struct(x["c"].alias("c"), x["len"].alias("len"))).otherwise(t)
    )["len"]
    return F.greatest(top, mode)


def fragments(groups: DataFrame, min_frag: int = 3) -> DataFrame:
    """(tid, st, en, far_st, is_rev, n, l_open, r_open, sum_mq2) of the groups with at least ``min_frag`` reads."""
    long = groups.filter(F.col("n") >= min_frag).withColumn("L", fragment_length("lengths", min_frag))
    a = F.col("anchor")
    return long.select(
        "tid",
        F.when(F.col("is_rev"), a - F.col("L")).otherwise(a).alias("st"),
        F.when(F.col("is_rev"), a).otherwise(a + F.col("L")).alias("en"),
        F.when(F.col("is_rev"), a - F.col("longest")).otherwise(a).alias("far_st"),
        "is_rev",
        F.col("n").cast("long").alias("n"),
        F.col("is_rev").alias("l_open"),
        (~F.col("is_rev")).alias("r_open"),
        "sum_mq2",
    )


#: Bits of a range's width in bases.
RANGE_BITS = 20


def carried(rows: DataFrame, order: list[str], fold, schema: str, range_bits: int) -> DataFrame:
    """Fold the rows of each ``tid`` in ``order`` (the first a position), range by range, with what is open at a border carried on.

    ``fold(rows, state)`` takes tuples of a range in order and the state left of
    it, a JSON value or None, and gives (rows out, state); without rows it gives
    what the last state still holds. All ranges are folded at once, first as if
    nothing were open left of them; a range whose neighbour hands on another
    state than it assumed is folded again, until none is. As a fold forgets its
    past within some fragment lengths, that takes two rounds as a rule, and one a
    range at worst. States are a row a range.
    """
    names = rows.columns
    out_names = [c.split()[0] for c in schema.split(", ")]
    kinds = dict(c.split() for c in schema.split(", "))
    arrow = {"long": pa.int64(), "boolean": pa.bool_()}
    full = f"{schema}, rng long, state string"

    def told(tid: int, rng: int, out: list[tuple], state: str) -> pa.Table:
        columns = list(zip(*out, strict=True)) if out else [()] * (len(out_names) - 1)
        cells = {"tid": pa.array([tid] * (len(out) + 1), pa.int64())}
        cells |= {c: pa.array([*values, None], arrow[kinds[c]]) for c, values in zip(out_names[1:], columns, strict=True)}
        return pa.table(cells | {"rng": pa.array([rng] * (len(out) + 1), pa.int64()), "state": pa.array([None] * len(out) + [state], pa.string())})

    def folded(group: pa.Table, state: str | None) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in order])
        out, left = fold(list(zip(*(group[c].to_pylist() for c in names), strict=True)), None if state is None else json.loads(state))
        return told(group["tid"][0].as_py(), group["rng"][0].as_py(), out, json.dumps(left))

    def again(group: pa.Table, given: pa.Table) -> pa.Table:
        return folded(group.select([*names, "rng"]), given["given"][0].as_py())

    def alone(group: pa.Table) -> pa.Table:
        return folded(group, None)

    def rest(group: pa.Table) -> pa.Table:
        out, left = fold([], json.loads(group["state"][0].as_py()))
        return told(group["tid"][0].as_py(), -1, out, json.dumps(left))

    keys = ["tid", "rng"]
    cut = settled(rows.withColumn("rng", F.shiftright(F.col(order[0]).cast("long"), range_bits)))
    done = settled(cut.groupBy(*keys).applyInArrow(alone, full))
    rounds, turn = [done], 0
    states = settled(done.filter("state is not null").select(*keys, "state", F.lit(None).cast("string").alias("given"), F.lit(0).alias("turn")))
    while True:
        w = Window.partitionBy("tid").orderBy("rng")
        told_next = states.withColumn("_in", F.lag("state").over(w))
        wrong = settled(told_next.filter(~F.col("_in").eqNullSafe(F.col("given"))).select(*keys, F.col("_in").alias("given")))
        if wrong.isEmpty():
            break
        turn += 1
        some = cut.join(wrong.select(*keys), keys, "left_semi")
        done = settled(some.groupBy(*keys).cogroup(wrong.groupBy(*keys)).applyInArrow(again, full))
        rounds.append(done)
        new = done.filter("state is not null").select(*keys, "state").join(wrong, keys).select(*keys, "state", "given", F.lit(turn).alias("turn"))
        states = settled(states.join(wrong.select(*keys), keys, "left_anti").unionByName(new))
    last = states.groupBy("tid").agg(F.max_by("state", "rng").alias("state"))
    out = last.groupBy("tid").applyInArrow(rest, full).filter("state is null").select(*out_names)
    for k, one in enumerate(rounds):
        mine = one.filter("state is null").join(states.filter(F.col("turn") == k).select(*keys), keys, "left_semi")
        out = out.unionByName(mine.select(*out_names))
    return out


MERGED = "tid long, st long, en long, n_seg long, n_frag long, l_open boolean, r_open boolean, is_rev boolean, sum_mq2 long"
ST, EN, SEG, N, LEFT, RIGHT, REV, MQ = range(8)  # places in an open fragment


def _merge(segments: bool, tn5: int, fuzz: int, fuzz_st: int, fuzz_len: int):
    """Three greedy passes over the fragments of a contig, in order of start and strand.

    A pass hands a fragment on once nothing that starts later can change it, in
    order, so the three run behind one another over the few that are open. In each
    a fragment goes to the first open one that takes it.
    """

    def same_end(q: list, p: list) -> bool:
        near = abs(p[EN] - q[EN]) if q[REV] else p[ST] - q[ST]
        return q[REV] == p[REV] and near <= fuzz_st

    def both_sides(q: list, p: list) -> bool:
        return q[RIGHT] and p[LEFT] and p[EN] >= q[EN] and p[ST] - q[ST] <= fuzz_len

    def shared(q: list, p: list) -> bool:
        return abs(q[EN] - p[ST] - tn5) <= fuzz

    def joined_ends(q: list, p: list) -> None:
        q[EN] = max(q[EN], p[EN])

    def closed_right(q: list, p: list) -> None:
        q[EN], q[RIGHT] = p[EN], False

    def chained(q: list, p: list) -> None:
        q[EN], q[RIGHT], q[SEG] = p[EN], p[RIGHT], q[SEG] + 1

    # of each pass: whether it merges, how, and whether a fragment is settled once one starts at ``at``
    passes = [
        (same_end, joined_ends, lambda q, at: at >= q[EN] or not q[REV] and at - q[ST] > fuzz_st),
        (both_sides, closed_right, lambda q, at: at >= q[EN] or not q[RIGHT] or at - q[ST] > fuzz_len),
        *([(shared, chained, lambda q, at: at >= q[EN])] if segments else []),
    ]

    def fold(rows: list[tuple], state: list | None) -> tuple[list[tuple], list]:
        open_, out = state or [[] for _ in passes], []

        def take(k: int, p: list) -> None:
            if k == len(passes):
                out.append(tuple(p))
                return
            test, absorb, settled_at = passes[k]
            release(k, p[ST])
            for q in open_[k]:
                if p[ST] < q[EN] and test(q, p):
                    absorb(q, p)
                    q[N] += p[N]
                    q[MQ] += p[MQ]
                    return
            open_[k].append(p)

        def release(k: int, at: float) -> None:
            settled_at, held, n = passes[k][2], open_[k], 0
            while n < len(held) and settled_at(held[n], at):
                n += 1
            gone, open_[k] = held[:n], held[n:]
            for q in gone:
                take(k + 1, q)

        for _, st, en, is_rev, n, l_open, r_open, mq in rows:
            take(0, [st, en, 1, n, l_open, r_open, is_rev, mq])
        if not rows:
            for k in range(len(passes)):
                release(k, float("inf"))
        return out, open_

    return fold


def merged(frags: DataFrame, segments: bool = True, tn5: int = 9, fuzz: int = 2, fuzz_st: int = 2, fuzz_len: int = 10, range_bits: int = RANGE_BITS) -> DataFrame:
    """Greedy merges of overlapping fragments in order of start, strand, end and size."""
    rows = frags.select("tid", "st", "en", "is_rev", "n", "l_open", "r_open", "sum_mq2")
    return carried(rows, ["st", "is_rev", "en", "n", "sum_mq2"], _merge(segments, tn5, fuzz, fuzz_st, fuzz_len), MERGED, range_bits)


def fragment_bed(frags: DataFrame, contigs: DataFrame) -> DataFrame:
    """The seven columns of the fragment file."""
    sides = F.concat(F.when(F.col("l_open"), "<").otherwise("|"), F.when(F.col("r_open"), ">").otherwise("|"))
    named = frags.join(F.broadcast(contigs.select("tid", "name")), "tid")  # a contig dictionary is bounded
    strand = F.when(F.col("is_rev"), "-").otherwise("+")
    return named.select(F.col("name").alias("chrom"), "st", "en", F.concat_ws(":", "n_seg", "n_frag", sides).alias("info"), strand.alias("strand"), F.col("n_frag").alias("score"), rms("sum_mq2", "n_frag").alias("mq"))


COUNTED = "tid long, st long, en long, n_frag long, n_seg long, mq long, lo boolean, ro boolean, d2_from long"


def _chain(n1: int, n2: int, merge: bool):
    """Fragments in start order: a left-open one extends the open one that overlaps it most; ``d2_from`` is where the second threshold counts from."""

    def fold(rows: list[tuple], state: list | None) -> tuple[list[tuple], list]:
        held, last = state or [[], None]
        out = []
        for _, st, en, n_frag, n_seg, mq, lo, ro in rows:
            ended = [g for g in held if g[1] <= st or not g[6]]
            if ended:
                out += map(tuple, ended)
                held = [g for g in held if g[1] > st and g[6]]
            best = max((g for g in held if g[1] <= en), key=lambda g: g[1], default=None) if merge and lo else None  # the first of equals
            if best is not None:
                best[1], best[6], best[2], best[3] = en, ro, best[2] + n_frag, best[3] + 1
                if best[7] is None and best[2] >= n2:
                    best[7] = last
            elif n_frag >= n1:
                last = st
                held.append([st, en, n_frag, n_seg, mq, lo, ro, st if n_frag >= n2 else None])
        if not rows:
            out, held = [tuple(g) for g in held], []
        return out, [held, last if held else None]

    return fold


def counted(frags: DataFrame, n1: int = 5, n2: int = 10, merge: bool = True, range_bits: int = RANGE_BITS) -> DataFrame:
    """Fragments (tid, st, en, n_frag, n_seg, mq, lo, ro) after merging and the first threshold."""
    rows = frags.select("tid", *[F.col(c).cast("long").alias(c) for c in ("st", "en", "n_frag", "n_seg", "mq")], "lo", "ro")
    return carried(rows, ["st", "en", "n_frag", "mq", "lo", "ro"], _chain(n1, n2, merge), COUNTED, range_bits)


def count_depth(frags: DataFrame, n1: int = 5, n2: int = 10, min_mq: int = 40, merge: bool = True, range_bits: int = RANGE_BITS) -> DataFrame:
    """(tid, st, en, d0, d1, d2): depth by mapping quality, by quality and size, and of all."""
    kept = counted(frags, n1, n2, merge, range_bits)
    good, neg = (F.col("mq") >= min_mq).cast("long"), F.when(F.col("d2_from").isNotNull(), -(F.col("mq") >= min_mq).cast("long")).otherwise(0)
    zero = F.lit(0).cast("long")

    def event(pos, d0, d1, d2):
        return F.struct(pos.alias("pos"), d0.alias("d0"), d1.alias("d1"), d2.alias("d2"))

    one = F.lit(1).cast("long")
    events = F.array(event(F.col("st"), good, zero, one), event(F.col("en"), -good, neg, -one), event(F.col("d2_from"), zero, good, zero), event(zero, zero, zero, zero))
    rows = kept.select("tid", F.explode(events).alias("e")).select("tid", "e.*").filter("pos is not null")
    return sweep(rows, ["tid"], ["d0", "d1", "d2"])
