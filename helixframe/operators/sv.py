"""Structural variants from split reads: breakpoints, clusters, calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.reads import DUPLICATE, QC_FAIL, REVERSE, SECONDARY, SUPPLEMENTARY, UNMAPPED, bound, cigar_ops, consumed, has, truncated


def split_sides(reads: DataFrame, contigs: DataFrame, min_mapq: int = 50, max_nm: int = 3) -> DataFrame:
    """Reads (seq, flag, tid, pos, mapq, cigar, nm, sa) with exactly one other alignment, as two oriented sides s0, s1 in query order."""
    skip = UNMAPPED | SUPPLEMENTARY | QC_FAIL | SECONDARY | DUPLICATE
    df = reads.filter(~has("flag", skip) & (F.col("tid") >= 0) & (F.length(F.regexp_replace("sa", "[^;]", "")) == 1))
    part = F.split(F.regexp_replace("sa", ";.*$", ""), ",")
    df = df.withColumn("_sa", part).withColumn("_name", part[0])
    df = df.join(F.broadcast(contigs.select(F.col("name").alias("_name"), F.col("tid").alias("_tid"))), "_name")  # a contig dictionary is bounded

    def side(tid, pos, rev, cigar, mapq, nm):
        return bound(cigar_ops(cigar), lambda ops: placed(tid, pos, rev, ops, mapq, nm))

    def placed(tid, pos, rev, ops, mapq, nm):
        clip = lambda x: F.when(x["op"].isin("S", "H"), x["len"]).otherwise(0)
        head, tail = clip(F.element_at(ops, 1)), F.when(F.size(ops) > 1, clip(F.element_at(ops, -1))).otherwise(0)
        span, ql = consumed(ops, "MDN"), consumed(ops, "MI")
        qs = F.when(rev, tail).otherwise(head)
        return F.struct(
            qs.alias("qs"), (qs + ql).alias("qe"), tid.alias("tid"), F.when(rev, pos + span).otherwise(pos).cast("long").alias("rs"), F.when(rev, pos).otherwise(pos + span).cast("long").alias("re"),
            rev.alias("rev"), mapq.alias("mapq"), F.coalesce(nm, F.lit(-1)).alias("nm"), ((head > 0) | (tail > 0)).alias("clipped"),
        )

    a = side(F.col("tid"), F.col("pos"), has("flag", REVERSE), F.col("cigar"), F.col("mapq"), F.col("nm"))
    b = side(F.col("_tid"), F.get("_sa", F.lit(1)).cast("int") - 1, F.get("_sa", F.lit(2)) != "+", F.get("_sa", F.lit(3)), F.get("_sa", F.lit(4)).cast("int"), F.get("_sa", F.lit(5)).cast("int"))
    # one expression a row, exploded, so that no later step computes a side again
    sound = lambda s: (s["mapq"] >= min_mapq) & (s["nm"] <= max_nm) & s["clipped"]
    ordered = lambda p: F.when(p["a"]["qs"] > p["b"]["qs"], F.struct(p["b"].alias("s0"), p["a"].alias("s1"))).otherwise(F.struct(p["a"].alias("s0"), p["b"].alias("s1")))
    pair = F.transform(F.filter(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda p: sound(p["a"]) & sound(p["b"])), ordered)
    return df.select("seq", F.explode(pair).alias("p")).select("seq", "p.s0", "p.s1")


def breakpoints(sides: DataFrame, contigs: DataFrame) -> DataFrame:
    """(seq, mid, tid0, pos0, tid1, pos1, qgap, rev0, rev1, rdrev) with position 0 not after position 1.

    ``mid`` is the middle on the concatenated contigs, moved past their end
    where order contradicts strand, and negative where strands differ.
    """
    off = F.broadcast(contigs.select(F.col("tid").alias("_t"), F.col("off").alias("_o")))
    total = F.broadcast(contigs.agg(F.max(F.col("off") + F.col("len")).alias("_total")))
    df = sides.join(off.withColumnsRenamed({"_t": "_t0", "_o": "_o0"}), F.col("s0.tid") == F.col("_t0")).join(off.withColumnsRenamed({"_t": "_t1", "_o": "_o1"}), F.col("s1.tid") == F.col("_t1")).join(total, F.lit(True))
    mid = F.shiftright(F.col("_o0") + F.col("s0.re") + F.col("_o1") + F.col("s1.rs"), 1)
    g0, g1, rev = F.col("s0.rs") + F.col("_o0"), F.col("s1.rs") + F.col("_o1"), F.col("s0.rev")
    mid = F.when((~rev & (g0 < g1)) | (rev & (g0 > g1)), mid).otherwise(mid + F.col("_total"))
    mid = F.when(F.col("s0.rev") != F.col("s1.rev"), -mid).otherwise(mid)
    p0, p1 = F.struct("s0.tid", F.col("s0.re").alias("pos")), F.struct("s1.tid", F.col("s1.rs").alias("pos"))
    df = df.select("seq", mid.alias("mid"), p0.alias("p"), p1.alias("q"), (F.col("s1.qs") - F.col("s0.qe")).cast("long").alias("qgap"), F.col("s0.rev").alias("r0"), F.col("s1.rev").alias("r1"), (p0 > p1).alias("rdrev"))
    pick = lambda a, b: F.when(F.col("rdrev"), b).otherwise(a)
    return df.select(
        "seq", "mid", pick(F.col("p.tid"), F.col("q.tid")).alias("tid0"), pick(F.col("p.pos"), F.col("q.pos")).alias("pos0"), pick(F.col("q.tid"), F.col("p.tid")).alias("tid1"), pick(F.col("q.pos"), F.col("p.pos")).alias("pos1"),
        "qgap", pick(F.col("r0"), ~F.col("r1")).alias("rev0"), pick(F.col("r1"), ~F.col("r0")).alias("rev1"), "rdrev",
    )


def clusters(breaks: DataFrame, max_gap: int = 50, range_bits: int = 24) -> DataFrame:
    """Adds ``cluster``, the first ``mid`` of each run whose neighbours are at most ``max_gap`` apart.

    Runs are found per range of positions; a range whose first breakpoint
    continues the run before it takes over that run's start, so no window spans
    the genome.
    """
    points = breaks.select("mid", F.shiftright("mid", range_bits).alias("_r")).distinct()
    w = Window.partitionBy("_r").orderBy("mid")
    local = points.withColumn("_new", F.when((F.col("mid") - F.lag("mid").over(w)) <= max_gap, None).otherwise(F.col("mid")))
    local = local.withColumn("_start", F.last("_new", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = local.groupBy("_r").agg(F.min("mid").alias("lo"), F.max("mid").alias("hi"), F.max("_start").alias("last"))
    order = Window.orderBy("_r")  # one row a range
    ranges = ranges.withColumn("own", ~F.coalesce(F.col("lo") - F.lag("hi").over(order) <= max_gap, F.lit(False)))
    # the run that is open at the end of each range, carried over ranges that are one run as a whole
    opens = F.when((F.col("last") != F.col("lo")) | F.col("own"), F.col("last"))
    ranges = ranges.withColumn("_open", F.last(opens, True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = ranges.select("_r", "lo", F.when(~F.col("own"), F.lag("_open").over(order)).alias("_carry"))
    named = local.join(ranges, "_r").select("mid", F.when(F.col("_start") == F.col("lo"), F.coalesce("_carry", "_start")).otherwise(F.col("_start")).alias("cluster"))
    return breaks.join(named, "mid")


def calls(breaks: DataFrame, contigs: DataFrame, max_gap: int = 50, min_count: int = 3, subcluster_gap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(calls, evidence): clusters of at least ``min_count`` breakpoints, cut where a contig changes in order of position."""
    total = contigs.agg(F.max(F.col("off") + F.col("len")).alias("_total"))
    df = clusters(breaks, max_gap)
    large = df.groupBy("cluster").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_count).select("cluster")
    df = df.join(large, "cluster", "left_semi")
    w = Window.partitionBy("cluster").orderBy("tid0", "pos0", "mid", "tid1", "pos1", "seq")
    cut = (F.col("tid0") != F.lag("tid0").over(w)) | (F.col("tid1") != F.lag("tid1").over(w))
    if subcluster_gap is not None:
        cut |= F.col("pos0") - F.lag("pos0").over(w) > subcluster_gap
    df = df.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("int")).withColumn("sub", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")
    first = F.min(F.struct("tid0", "pos0", "mid", "tid1", "pos1", "seq", "rev0", "rev1"))
    agg = df.groupBy("cluster", "sub").agg(first.alias("f"), *[truncated(F.sum(c) / F.count("*")).alias(c) for c in ("pos0", "pos1", "qgap")], F.count("*").alias("n")).join(F.broadcast(total), F.lit(True))
    same = F.col("f.tid0") == F.col("f.tid1")
    kind = F.when(same & F.col("f.mid").between(0, F.col("_total") - 1), "G").when(same, "S").otherwise("T")
    out = agg.select(
        "cluster", "sub", F.col("f.tid0").alias("tid0"), "pos0", F.col("f.rev0").alias("rev0"), F.col("f.tid1").alias("tid1"), "pos1", F.col("f.rev1").alias("rev1"), kind.alias("kind"),
        F.when(kind == "G", F.col("qgap") - (F.col("pos1") - F.col("pos0"))).alias("size_change"), "n",
    )
    return out, df


def record_lines(calls: DataFrame, evidence: DataFrame, contigs: DataFrame) -> DataFrame:
    """(cluster, sub, k, seq, value): each call as SV, its reads as RD, and a closing line."""
    name = lambda df: df.join(F.broadcast(contigs.select(F.col("tid").alias("tid0"), F.col("name").alias("_n0"))), "tid0").join(F.broadcast(contigs.select(F.col("tid").alias("tid1"), F.col("name").alias("_n1"))), "tid1")
    sign = lambda c: F.when(F.col(c), "-").otherwise("+")
    line = lambda *c: F.concat_ws("\t", *[F.coalesce(x.cast("string"), F.lit(".")) for x in c])
    zero = F.lit(0).cast("long").alias("seq")
    call = name(calls).select("cluster", "sub", F.lit(0).alias("k"), zero, line(F.lit("SV"), F.col("_n0"), F.col("pos0"), sign("rev0"), F.col("_n1"), F.col("pos1"), sign("rev1"), F.col("kind"), F.col("size_change"), F.col("n")).alias("value"))
    read = name(evidence).select("cluster", "sub", F.lit(1).alias("k"), F.col("seq").cast("long").alias("seq"), line(F.lit("RD"), F.col("_n0"), F.col("pos0"), sign("rev0"), F.col("_n1"), F.col("pos1"), sign("rev1"), F.col("qgap"), sign("rdrev")).alias("value"))
    return call.unionByName(read).unionByName(calls.select("cluster", "sub", F.lit(2).alias("k"), zero, F.lit("//").alias("value")))
