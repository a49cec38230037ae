"""Evenness of coverage: Lorenz curve and coefficient of variation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stages import settled

DEPTH_CAP = 10_000


def clipped(segments: DataFrame, mask: DataFrame, by: str = "chrom", depth: str = "depth") -> DataFrame:
    """Depth segments cut to a disjoint mask (chrom, beg, end), by 8 kb bins."""
    from .intervals import BIN

    bins = lambda a, b: F.explode(F.sequence(F.shiftright(a, BIN), F.shiftright(b - 1, BIN)))
    s = segments.select(F.col(by).alias("chrom"), "st", "en", F.col(depth).alias("depth"), bins(F.col("st"), F.col("en")).alias("bin"))
    m = mask.select("chrom", F.col("beg").cast("long").alias("beg"), F.col("end").cast("long").alias("end"), bins(F.col("beg").cast("long"), F.col("end").cast("long")).alias("bin"))
    st, en = F.greatest("st", "beg", F.shiftleft("bin", BIN)), F.least("en", "end", F.shiftleft(F.col("bin") + 1, BIN))
    return s.join(m, ["chrom", "bin"]).select("chrom", st.alias("st"), en.alias("en"), "depth").filter("st < en")


def coverage_histogram(segments: DataFrame, mask: DataFrame, by: str = "chrom", depth: str = "depth") -> DataFrame:
    """(depth, bases) over the mask; uncovered bases at depth 0; overlapping mask intervals count twice."""
    if mask is None:
        raise ValueError("a mask of positions is needed")
    total = mask.agg(F.sum(F.col("end") - F.col("beg")).cast("long").alias("total"))
    found = clipped(segments.filter(F.col(depth) > 0), mask, by, depth)
    hist = found.groupBy(F.least(F.col("depth"), F.lit(DEPTH_CAP)).cast("long").alias("depth")).agg(F.sum(F.col("en") - F.col("st")).cast("long").alias("bases"))
    covered = hist.agg(F.coalesce(F.sum("bases"), F.lit(0)).cast("long").alias("covered"))
    zero = total.join(covered, F.lit(True)).select(F.lit(0).cast("long").alias("depth"), (F.col("total") - F.col("covered")).alias("bases"))
    return zero.unionByName(hist)


def lorenz(hist: DataFrame, step: int = 1000, dense: bool = False) -> DataFrame:
    """(genome, bases): cumulative shares by depth, at most ``step`` positions apart; starts at (0, 0).

    A histogram has ``DEPTH_CAP`` rows at most, whatever the data's size.
    """
    if dense:
        spark = hist.sparkSession
        hist = spark.range(DEPTH_CAP + 1).select(F.col("id").alias("depth")).join(hist, "depth", "left").select("depth", F.coalesce("bases", F.lit(0)).alias("bases"))
    w = Window.orderBy("depth")
    before, every = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = hist.select(
        "depth", "bases",
        F.coalesce(F.sum("bases").over(before), F.lit(0)).alias("g0"), F.coalesce(F.sum(F.col("bases") * F.col("depth")).over(before), F.lit(0)).alias("b0"),
        F.sum("bases").over(every).alias("g"), F.sum(F.col("bases") * F.col("depth")).over(every).alias("b"),
    )
    cuts = F.array_distinct(F.concat(F.when(F.col("bases") >= step, F.sequence(F.lit(step).cast("long"), F.col("bases"), F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>")), F.array(F.col("bases"))))
    points = run.withColumn("k", F.explode(cuts))
    points = points.select(F.try_divide(F.col("g0") + F.col("k"), F.col("g")).alias("genome"), F.try_divide(F.col("b0") + F.col("k") * F.col("depth"), F.col("b")).alias("bases"))
    return points.unionByName(hist.sparkSession.range(1).select(F.lit(0.0).alias("genome"), F.lit(0.0).alias("bases")))


def widths(levels: int = 8) -> list[int]:
    """1 to 9 times each power of ten below 10**levels, and 10**levels."""
    return [d * 10**k for k in range(levels) for d in range(1, 10)] + [10**levels]


def bin_variation(runs: DataFrame, sizes: list[int] | None = None) -> DataFrame:
    """(width, cv) from consecutive depth runs (n0, n1, depth) over positions n0 < n <= n1.

    Whole bins inside a run enter in closed form; only the two ends of a run
    are added up by bin. Bins cut off by the end of the data don't count. The
    coefficient is null without a complete bin or without coverage.
    """
    sizes, runs = sizes or widths(), settled(runs)  # read by each of the sums below
    total = runs.agg(F.max("n1").alias("N"))
    b = F.explode(F.array(*[F.lit(x).cast("long") for x in sizes])).alias("b")
    r = runs.select(F.col("n0").cast("long").alias("n0"), F.col("n1").cast("long").alias("n1"), F.col("depth").cast("long").alias("d"), b)
    r = r.withColumn("k0", F.expr("n0 div b")).withColumn("k1", F.expr("(n1 - 1) div b"))
    single = F.col("k0") == F.col("k1")
    ends = F.when(single, F.array(F.struct(F.col("k0").alias("k"), ((F.col("n1") - F.col("n0")) * F.col("d")).alias("x")))).otherwise(
        F.array(F.struct(F.col("k0").alias("k"), ((F.col("b") * (F.col("k0") + 1) - F.col("n0")) * F.col("d")).alias("x")), F.struct(F.col("k1").alias("k"), ((F.col("n1") - F.col("b") * F.col("k1")) * F.col("d")).alias("x")))
    )
    partial = r.select("b", F.explode(ends).alias("e")).groupBy("b", F.col("e.k").alias("k")).agg(F.sum("e.x").alias("x"))
    partial = partial.join(F.broadcast(total)).filter("k < N div b").groupBy("b").agg(F.sum("x").cast("double").alias("s1"), F.sum(F.col("x").cast("double") * F.col("x")).alias("s2"))
    inner = r.filter("k1 - k0 > 1").select("b", (F.col("k1") - F.col("k0") - 1).cast("double").alias("c"), (F.col("b") * F.col("d")).cast("double").alias("y"))
    inner = inner.groupBy("b").agg(F.sum(F.col("c") * F.col("y")).alias("t1"), F.sum(F.col("c") * F.col("y") * F.col("y")).alias("t2"))
    all_b = runs.sparkSession.createDataFrame([(x,) for x in sizes], "b long")
    out = all_b.join(partial, "b", "left").join(inner, "b", "left").join(F.broadcast(total)).withColumn("n", F.expr("N div b").cast("double"))
    mean = F.try_divide(F.coalesce("s1", F.lit(0.0)) + F.coalesce("t1", F.lit(0.0)), F.col("n"))
    square = F.try_divide(F.coalesce("s2", F.lit(0.0)) + F.coalesce("t2", F.lit(0.0)), F.col("n"))
    return out.select(F.col("b").alias("width"), F.try_divide(F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)), mean).alias("cv"))


def mask_runs(segments: DataFrame, mask: DataFrame, by: str = "chrom", depth: str = "depth") -> DataFrame:
    """Depth runs numbered along the disjoint mask from its first position to the last covered one."""
    m = mask.select("chrom", F.col("beg").cast("long").alias("beg"), F.col("end").cast("long").alias("end"))
    per = m.groupBy("chrom").agg(F.sum(F.col("end") - F.col("beg")).alias("len"))
    first = per.select("chrom", F.coalesce(F.sum("len").over(Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # a row a contig
    w = Window.partitionBy("chrom").orderBy("beg").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("before", F.coalesce(F.sum(F.col("end") - F.col("beg")).over(w), F.lit(0))).join(F.broadcast(first), "chrom").withColumn("off", F.col("start") + F.col("before"))
    cut = settled(clipped(segments.filter(F.col(depth) > 0), mask, by, depth).withColumnRenamed("depth", "d"))
    at = m.select("chrom", F.col("beg").alias("st"), "off", "beg").unionByName(cut.select("chrom", "st", F.lit(None).cast("long").alias("off"), F.lit(None).cast("long").alias("beg")))
    w = Window.partitionBy("chrom").orderBy("st", F.col("off").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    number = at.withColumn("o", F.last("off", True).over(w) - F.last("beg", True).over(w)).filter("off is null").select("chrom", "st", "o").distinct()
    covered = cut.join(number, ["chrom", "st"]).select("chrom", (F.col("st") + F.col("o")).alias("n0"), (F.col("en") + F.col("o")).alias("n1"), F.col("d").alias("depth"))
    # gaps between covered runs have depth 0; each contig starts where the mask's earlier contigs end
    w = Window.partitionBy("chrom").orderBy("n0")
    starts = covered.join(F.broadcast(first), "chrom")
    gap = starts.select("chrom", F.coalesce(F.lag("n1").over(w), F.col("start")).alias("a"), F.col("n0").alias("z")).filter("a < z").select(F.col("a").alias("n0"), F.col("z").alias("n1"), F.lit(0).cast("long").alias("depth"))
    ends = covered.groupBy("chrom").agg(F.max("n1").alias("n1"))
    order = Window.orderBy("start")
    tails = first.join(ends, "chrom", "left").withColumn("next", F.lead("start").over(order)).withColumn("later", F.max(F.when(F.col("n1").isNotNull(), F.col("start"))).over(Window.orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, -1)))
    tails = tails.filter("next is not null and later is not null").select(F.coalesce("n1", "start").alias("n0"), F.col("next").alias("n1"), F.lit(0).cast("long").alias("depth")).filter("n0 < n1")
    return covered.select("n0", "n1", F.col("depth").cast("long").alias("depth")).unionByName(gap).unionByName(tails)
