"""The registered queries on the driver's tables, each with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import reads as R
from helixframe.operators import cnv, coverage, dedup, fragments, intervals, joint, pileup, sv, sweep, tiles, trim, variants
from helixframe.operators.stages import checkpoint_folder, settled

from . import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def reads(spark: SparkSession, sf: str) -> DataFrame:
    return X.project(spark, sf, "lineitem", X.READS)


def mask(spark: SparkSession, sf: str) -> DataFrame:
    return X.project(spark, sf, "orders", X.MASK, keep=False)


def obs(spark: SparkSession, sf: str) -> DataFrame:
    return X.project(spark, sf, "lineitem", X.OBS)


ROW = ", ".join(X.LINEITEM)
_READS = f"reads AS ({X.sql(X.READS, 'lineitem')})"
_MASK = f"mask AS ({X.sql(X.MASK, 'orders', '')})"
_OBS = f"obs AS ({X.sql(X.OBS, 'lineitem')})"

# ---------------------------------------------------------------- depth


def _sweep(source: str, weights: dict[str, str], st: str, en: str, zero: bool) -> str:
    w = ", ".join(f"{e} AS {c}" for c, e in weights.items())
    neg = ", ".join(f"-({e}) AS {c}" for c, e in weights.items())
    start = f" UNION ALL SELECT DISTINCT tid, 0, {', '.join('0' for _ in weights)} FROM {source}" if zero else ""
    sums = ", ".join(f"sum({c}) AS {c}" for c in weights)
    run = ", ".join(f"(sum({c}) OVER (PARTITION BY tid ORDER BY p))::BIGINT AS {c}" for c in weights)
    return f"""e AS (SELECT tid, {st} AS p, {w} FROM {source} UNION ALL SELECT tid, {en}, {neg} FROM {source}{start}),
a AS (SELECT tid, p, {sums} FROM e GROUP BY tid, p),
seg AS (SELECT tid, p::BIGINT AS st, (lead(p) OVER (PARTITION BY tid ORDER BY p))::BIGINT AS en, {run} FROM a),
depth AS (SELECT * FROM seg WHERE en IS NOT NULL)"""


_DEPTH = f"{_READS}, {_sweep('reads', {'depth': '1'}, 'pos', 'pos + rlen', False)}"
_TIERS = {"d0": "CASE WHEN mapq >= 40 THEN 1 ELSE 0 END", "d1": "CASE WHEN mapq >= 40 AND rlen >= 10 THEN 1 ELSE 0 END", "d2": "1"}
_TIERED = f"{_READS}, big AS (SELECT * FROM reads WHERE rlen >= 5), {_sweep('big', _TIERS, 'pos', 'pos + rlen', True)}"


def depth(spark: SparkSession, sf: str) -> DataFrame:
    return sweep.depth(reads(spark, sf).withColumn("en", F.col("pos") + F.col("rlen")), ["tid"], "pos", "en")


@query(f"WITH {_DEPTH} SELECT * FROM depth")
def depth_sweep(spark, sf):
    return depth(spark, sf)


def tiers(spark: SparkSession, sf: str) -> DataFrame:
    big = reads(spark, sf).filter("rlen >= 5").withColumn("en", F.col("pos") + F.col("rlen"))
    return sweep.depth(big, ["tid"], "pos", "en", from_zero=True, **_TIERS)


@query(f"WITH {_TIERED} SELECT * FROM depth")
def depth_sweep_tiers(spark, sf):
    return tiers(spark, sf)


@query(f"WITH {_DEPTH} SELECT least(depth, 10)::BIGINT AS depth, sum(en - st)::BIGINT AS bases FROM depth GROUP BY ALL")
def depth_hist(spark, sf):
    return sweep.histogram(depth(spark, sf), "depth")


# ---------------------------------------------------------------- duplicates

_FLAGGED = f"{_READS}, f AS (SELECT *, row_number() OVER (PARTITION BY tid, pos, coalesce(bc, '') ORDER BY {ROW}) > 1 AS is_dup FROM reads)"


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.first_per_key(reads(spark, sf), ["tid", "pos", "bc"], list(X.LINEITEM))


@query(f"WITH {_FLAGGED} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_discount, tid, pos, bc, is_dup FROM f")
def dup_flags(spark, sf):
    return flagged(spark, sf).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "tid", "pos", "bc", "is_dup")


@query(f"WITH {_FLAGGED} SELECT bc IS NOT NULL AS has_bc, count(*) AS fragments, count(*) FILTER (is_dup) AS duplicates FROM f GROUP BY ALL")
def dup_counts(spark, sf):
    return dedup.duplicate_counts(flagged(spark, sf))


_PAIRED = {"tid": "CAST(l_suppkey % 5 AS INT)", "left_pos": "CAST((l_orderkey * 13 + l_partkey * 7) % 2000 * 10 AS INT)", "right_pos": "CAST((l_orderkey * 13 + l_partkey * 7) % 2000 * 10 + 100 + l_linenumber AS INT)",
    "bc": X.READS["bc"], "qname": "concat(l_orderkey, ':', l_partkey, ':', l_suppkey, ':', l_linenumber, ':', l_extendedprice)", "seq": "CAST(l_orderkey * 100000000 + l_partkey * 100 + l_linenumber AS BIGINT)"}


@query(
    f"""WITH p AS ({X.sql(_PAIRED, "lineitem")}),
f AS (SELECT *, row_number() OVER (PARTITION BY tid, left_pos, coalesce(bc, '') ORDER BY {ROW}) > 1 AS d FROM p)
SELECT qname, 1 AS mate, d AS is_dup FROM f UNION ALL SELECT qname, 2, row_number() OVER (PARTITION BY qname ORDER BY {ROW}) <= count(*) FILTER (d) OVER (PARTITION BY qname) FROM f"""
)
def dup_mate_propagation(spark, sf):
    # in the order of the rows, which are unique as a whole
    p = X.project(spark, sf, "lineitem", _PAIRED).withColumn("seq", F.struct(*X.LINEITEM))
    first, second = (F.struct("seq", F.lit(m).alias("mate")) for m in (1, 2))
    mates = F.array(
        F.struct(first.alias("seq"), F.lit(99).alias("flag"), F.col("left_pos").alias("pos"), F.col("right_pos").alias("mpos")),
        F.struct(second.alias("seq"), F.lit(147).alias("flag"), F.col("right_pos").alias("pos"), F.col("left_pos").alias("mpos")),
    )
    rows = p.select("qname", "tid", F.col("tid").alias("mtid"), "bc", F.explode(mates).alias("m")).select("qname", "tid", "mtid", "bc", "m.*")
    done = dedup.mark_duplicates(rows)
    return done.select("qname", F.when(R.has("flag", R.READ1), 1).otherwise(2).alias("mate"), R.has("flag", R.DUPLICATE).alias("is_dup"))


# ---------------------------------------------------------------- fragments

_ENDS = "en AS (SELECT tid, is_rev, mapq, rlen AS len, CASE WHEN is_rev THEN pos + rlen ELSE pos END AS anchor FROM reads)"
_GROUPS = f"{_READS}, {_ENDS}, g AS (SELECT tid, is_rev, anchor, count(*) AS n, sum(least(mapq, 60) * least(mapq, 60))::BIGINT AS s, max(len)::BIGINT AS longest, list(len ORDER BY len DESC) AS lens FROM en GROUP BY tid, is_rev, anchor)"
_MODE = "m AS (SELECT tid, is_rev, anchor, len, row_number() OVER (PARTITION BY tid, is_rev, anchor ORDER BY count(*) DESC, len) AS r FROM en GROUP BY tid, is_rev, anchor, len)"
_RULE = f"{_GROUPS}, {_MODE}, x AS (SELECT g.*, greatest(lens[3], m.len)::BIGINT AS L FROM g JOIN m USING (tid, is_rev, anchor) WHERE r = 1 AND n >= 3)"
_FRAGS = f"{_RULE}, frag AS (SELECT tid, CASE WHEN is_rev THEN anchor - L ELSE anchor END AS st, CASE WHEN is_rev THEN anchor ELSE anchor + L END AS en, CASE WHEN is_rev THEN anchor - longest ELSE anchor END AS far_st, is_rev, n FROM x)"


def groups(spark: SparkSession, sf: str) -> DataFrame:
    return fragments.grouped(reads(spark, sf).select("tid", F.col("pos").alias("st"), (F.col("pos") + F.col("rlen")).alias("en"), "is_rev", "mapq"))


@query(f"WITH {_GROUPS} SELECT tid, is_rev, anchor, n, s AS sum_mq2, longest FROM g")
def frag_groups(spark, sf):
    return groups(spark, sf).select("tid", "is_rev", "anchor", "n", "sum_mq2", "longest")


@query(f"WITH {_FRAGS} SELECT tid, st, en, is_rev, n FROM frag")
def frag_length_rule(spark, sf):
    return fragments.fragments(groups(spark, sf)).select("tid", "st", "en", "is_rev", "n")


@query(f"WITH {_GROUPS} SELECT tid, is_rev, anchor, floor(sqrt(s / n) + 0.499)::INT AS rms FROM g WHERE n >= 3")
def frag_rms(spark, sf):
    return groups(spark, sf).filter("n >= 3").select("tid", "is_rev", "anchor", R.rms("sum_mq2", "n").alias("rms"))


@query(
    f"""WITH {_FRAGS}, o AS (SELECT *, max(en) OVER (PARTITION BY tid ORDER BY far_st, en, is_rev, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM frag),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR far_st >= b THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY far_st, en, is_rev, n ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT tid, min(st)::BIGINT AS st, max(en)::BIGINT AS en, count(*) AS fragments, sum(n)::BIGINT AS n FROM i GROUP BY tid, island"""
)
def frag_islands(spark, sf):
    marked = intervals.islands(fragments.fragments(groups(spark, sf)), ["tid"], ["far_st", "en", "is_rev", "n"], "far_st", "en")
    return marked.groupBy("tid", "island").agg(F.min("st").alias("st"), F.max("en").alias("en"), F.count("*").alias("fragments"), F.sum("n").alias("n")).drop("island")


@query()
def frag_merge(spark, sf):
    return fragments.merged(fragments.fragments(groups(spark, sf)))


def counted_input(spark: SparkSession, sf: str) -> DataFrame:
    merged = fragments.merged(fragments.fragments(groups(spark, sf), 2))
    return merged.select("tid", "st", "en", "n_frag", "n_seg", R.rms("sum_mq2", "n_frag").cast("long").alias("mq"), F.col("l_open").alias("lo"), F.col("r_open").alias("ro"))


@query()
def count_merge(spark, sf):
    return fragments.count_depth(counted_input(spark, sf), 3, 6, 20)


# ---------------------------------------------------------------- intervals

_HIT = "EXISTS (SELECT 1 FROM mask m WHERE m.chrom = r.tid AND r.pos < m.\"end\" AND r.pos + r.rlen > m.beg AND m.\"end\" > m.beg)"
_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "tid", "pos", "rlen"]


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    return reads(spark, sf).select(*_KEYS, (F.col("pos") + F.col("rlen")).alias("en"))


@query(f"WITH {_READS}, {_MASK} SELECT {', '.join(_KEYS)} FROM reads r WHERE {_HIT}")
def mask_reads(spark, sf):
    return intervals.overlapping(_spans(spark, sf), mask(spark, sf), "tid", "pos", "en").drop("en")


@query(f"WITH {_READS}, {_MASK}, p AS (SELECT DISTINCT tid, pos, 1 AS rlen FROM reads) SELECT tid, pos FROM p r WHERE {_HIT}")
def mask_positions(spark, sf):
    at = reads(spark, sf).select("tid", "pos").distinct().withColumn("en", F.col("pos") + 1)
    return intervals.overlapping(at, mask(spark, sf), "tid", "pos", "en").drop("en")


@query(f"WITH {_READS}, {_MASK} SELECT {', '.join(_KEYS)} FROM reads r WHERE NOT {_HIT}")
def mask_exclude(spark, sf):
    return intervals.outside(_spans(spark, sf), mask(spark, sf), "tid", "pos", "en").drop("en")


@query(f'WITH {_MASK} SELECT sum("end" - beg)::BIGINT AS total FROM mask')
def mask_length(spark, sf):
    return intervals.total_length(mask(spark, sf))


_UNION = f"""{_MASK}, mo AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY beg, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM mask),
mi AS (SELECT *, sum(CASE WHEN b IS NULL OR beg > b THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY beg, "end" ROWS UNBOUNDED PRECEDING) AS island FROM mo),
mu AS (SELECT chrom, min(beg)::BIGINT AS beg, max("end")::BIGINT AS "end" FROM mi GROUP BY chrom, island)"""


@query(f"WITH {_UNION} SELECT * FROM mu")
def mask_union(spark, sf):
    return intervals.union(mask(spark, sf))


@query(f"WITH {_READS} SELECT {', '.join(_KEYS)} FROM reads WHERE tid = 3 AND pos < 120000 AND pos + rlen > 49999")
def region_scan(spark, sf):
    return _spans(spark, sf).filter(intervals.in_region("3:50,000-120,000", "tid", "pos", "en")).drop("en")


_AT = "o_orderkey * 29 % 20000 * 10"
_REGION = {
    "region": f"CASE CAST(o_orderkey % 8 AS INT) WHEN 0 THEN concat('chr', o_custkey % 5) WHEN 1 THEN concat('chr', o_custkey % 5, ':', {_AT} + 1, '-', {_AT} + 500) WHEN 2 THEN concat('chr', o_custkey % 5, ':1,', o_custkey % 9, '00-2,000')"
    f" WHEN 3 THEN concat('chr', o_custkey % 5, ':', {_AT} + 1) WHEN 4 THEN concat('HLA:DRB', o_custkey % 5) WHEN 5 THEN concat('HLA:DRB:7-', 10 + o_custkey % 5) WHEN 6 THEN concat('chr1:', {_AT} + 600, '-', {_AT}) ELSE concat('chr1:1-', o_custkey % 5, '-3') END",
}


@query(
    f"""WITH r AS ({X.sql(_REGION, 'orders', 'o_orderkey, o_custkey')}), k AS (SELECT o_orderkey, region, o_orderkey % 8 AS k, o_custkey AS c, {_AT} AS a FROM r)
SELECT o_orderkey, region, CASE k WHEN 1 THEN concat('chr', c % 5) WHEN 2 THEN concat('chr', c % 5) WHEN 3 THEN concat('chr', c % 5) WHEN 5 THEN 'HLA:DRB' ELSE region END AS chrom,
CASE k WHEN 1 THEN a WHEN 2 THEN 999 + c % 9 * 100 WHEN 3 THEN a WHEN 5 THEN 6 ELSE 0 END::BIGINT AS beg, CASE k WHEN 1 THEN a + 500 WHEN 2 THEN 2000 WHEN 5 THEN 10 + c % 5 ELSE 536870912 END::BIGINT AS en FROM k"""
)
def region_parse(spark, sf):
    rows = X.project(spark, sf, "orders", _REGION)
    return rows.select("o_orderkey", "region", intervals.region_parts("region").alias("x")).select("o_orderkey", "region", "x.*")


# ---------------------------------------------------------------- coverage

_CLIP = f"{_DEPTH}, {_UNION}, cut AS (SELECT chrom, greatest(st, beg) AS s, least(en, \"end\") AS e, depth FROM depth JOIN mu ON tid = chrom AND st < \"end\" AND en > beg AND depth > 0)"
_HIST = f"""{_CLIP}, h AS (SELECT depth, sum(e - s)::BIGINT AS bases FROM cut GROUP BY depth),
hist AS (SELECT 0::BIGINT AS depth, (SELECT sum("end" - beg) FROM mu)::BIGINT - (SELECT coalesce(sum(bases), 0) FROM h)::BIGINT AS bases UNION ALL SELECT * FROM h)"""


def coverage_hist(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.coverage_histogram(depth(spark, sf), intervals.union(mask(spark, sf)), by="tid")


@query(f"WITH {_HIST} SELECT depth, bases FROM hist")
def lorenz_hist(spark, sf):
    return coverage_hist(spark, sf)


@query(
    f"""WITH {_HIST}, c AS (SELECT depth, bases, sum(bases) OVER w - bases AS g0, sum(bases * depth) OVER w - bases * depth AS b0, sum(bases) OVER () AS g, sum(bases * depth) OVER () AS b FROM hist WINDOW w AS (ORDER BY depth)),
k AS (SELECT *, unnest(list_distinct(list_concat(range(1000, bases + 1, 1000), [bases]))) AS k FROM c)
SELECT (g0 + k)::DOUBLE / g::DOUBLE AS genome, (b0 + k * depth)::DOUBLE / b::DOUBLE AS bases FROM k UNION ALL SELECT 0.0, 0.0"""
)
def lorenz_curve(spark, sf):
    return coverage.lorenz(coverage_hist(spark, sf))


@query(
    f"""WITH {_CLIP}, pos AS (SELECT chrom, unnest(range(beg, "end")) AS p FROM mu), d AS (SELECT chrom, unnest(range(s, e)) AS p, depth FROM cut),
n AS (SELECT row_number() OVER (ORDER BY pos.chrom, pos.p) - 1 AS i, coalesce(depth, 0) AS depth, depth IS NOT NULL AS hit FROM pos LEFT JOIN d USING (chrom, p)),
t AS (SELECT max(i) + 1 AS N FROM n WHERE hit), w AS (SELECT unnest([1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000, 100000000]) AS b),
s AS (SELECT b, i // b AS k, sum(depth)::DOUBLE AS x FROM n, w, t WHERE i // b < N // b AND i < N GROUP BY b, i // b),
v AS (SELECT b, sqrt(greatest(0, avg(x * x) - avg(x) * avg(x))) / nullif(avg(x), 0) AS cv FROM s GROUP BY b)
SELECT w.b::BIGINT AS width, round(cv, 6) AS cv FROM w LEFT JOIN v USING (b)"""
)
def cv_bins(spark, sf):
    runs = coverage.mask_runs(depth(spark, sf), intervals.union(mask(spark, sf)), by="tid")
    return coverage.bin_variation(runs, [1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000, 100000000]).select("width", F.round("cv", 6).alias("cv"))


# ---------------------------------------------------------------- read filters


@query(f"WITH {_READS} SELECT {', '.join(_KEYS)}, flag FROM reads WHERE (flag & 1796) = 0 AND tid >= 0")
def flag_filter(spark, sf):
    return pileup.usable(reads(spark, sf)).select(*_KEYS, "flag")


@query(f"WITH {_READS} SELECT {', '.join(_KEYS)}, mapq FROM reads WHERE (flag & 1796) = 0 AND mapq >= 30")
def mapq_filter(spark, sf):
    return pileup.usable(reads(spark, sf), 30).select(*_KEYS, "mapq")


_CIG = f"c AS ({X.sql(X.CIGARS, 'lineitem', 'l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice')})"
_CKEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]


def cigars(spark: SparkSession, sf: str) -> DataFrame:
    return X.project(spark, sf, "lineitem", X.CIGARS).withColumn("ops", R.cigar_ops("cigar"))


@query(f"WITH {_CIG} SELECT {', '.join(_CKEYS)}, cigar FROM c WHERE l_linenumber <= 4")
def clip_filter(spark, sf):
    return cigars(spark, sf).filter(R.clip_length("ops") <= 4).select(*_CKEYS, "cigar")


@query(f"WITH {_CIG} SELECT {', '.join(_CKEYS)}, l_linenumber + {X.LEN} + 2 + l_linenumber + 3 + 5 AS qlen, {X.LEN} + 2 + l_linenumber + 3 + 5 AS alen, {X.LEN} + l_linenumber + 3 + 1 + 5 AS rlen FROM c")
def cigar_lengths(spark, sf):
    return cigars(spark, sf).select(*_CKEYS, R.query_length("ops").alias("qlen"), R.aligned_query_length("ops").alias("alen"), R.reference_span("ops").alias("rlen"))


@query(
    f"""WITH {_CIG}, m AS (SELECT pos, unnest(list_concat(range(pos, pos + {X.LEN} + l_linenumber + 3), range(pos + {X.LEN} + l_linenumber + 4, pos + {X.LEN} + l_linenumber + 9))) AS p FROM c)
SELECT p::BIGINT AS pos, count(*) AS n FROM m GROUP BY p"""
)
def cigar_explode(spark, sf):
    df = cigars(spark, sf).select(F.explode(R.aligned_blocks("pos", "ops")).alias("b")).filter("b.op = 'M'")
    at = df.select(F.explode(F.sequence(F.col("b.ref"), F.col("b.ref") + F.col("b.len") - 1)).alias("pos"))
    return at.groupBy(F.col("pos").cast("long").alias("pos")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {_CIG}, v AS (SELECT *, nm - 1 AS x, ({X.LEN} + l_linenumber + 11) * 0.05::DOUBLE AS lam FROM c),
p AS (SELECT *, CASE WHEN nm >= 3 AND x >= lam THEN 1 - exp(-lam) * list_sum(list_transform(range(0, x), lambda k: pow(lam, k) / factorial(k::INT)::DOUBLE)) END AS p FROM v)
SELECT {', '.join(_CKEYS)}, CASE WHEN p IS NULL THEN mapq ELSE greatest(0, mapq - floor(CASE WHEN p > 1e-6 THEN -4.343::DOUBLE * ln(p) ELSE 60 END + 0.499::DOUBLE)::INT) END AS mapq FROM p"""
)
def poisson_mapq(spark, sf):
    return cigars(spark, sf).select(*_CKEYS, R.poisson_mapq("mapq", "nm", "ops", 0.05).alias("mapq"))


_BASES = {"tid": "CAST(l_suppkey % 5 AS BIGINT)", "sample": "CAST(l_linenumber % 2 AS VARCHAR(1))", "bases": f"substring(repeat('ACGTTGCA', 20), CAST(1 + l_partkey % 8 AS INT), 2 * l_linenumber + {X.LEN} + 10)"}


@query(
    f"""WITH r AS ({X.sql(X.CIGARS | _BASES, 'lineitem', f'l_suppkey, l_linenumber AS ln, l_returnflag, {X.LEN} AS len')}),
b AS (SELECT *, unnest([{{'k': 1, 'q0': ln, 'r0': pos, 'n': len}}, {{'k': 2, 'q0': ln + len + 2, 'r0': pos + len, 'n': ln + 3}}, {{'k': 3, 'q0': 2 * ln + len + 5, 'r0': pos + len + ln + 4, 'n': 5}}]) AS x FROM r),
p AS (SELECT tid, sample, mapq, l_suppkey, l_returnflag = 'R' AS rev, bases, len, ln, x.k AS k, x.r0 + i AS pos, x.q0 + i AS q, i = x.n - 1 AS last FROM (SELECT *, unnest(range(x.n)) AS i FROM b)),
o AS (SELECT *, substring(bases, q + 1, 1) AS base, CASE WHEN last AND k = 1 THEN substring(bases, q + 2, 2) ELSE '' END AS ins, (last AND k = 2)::INT AS del_len, greatest(0, least(q - ln, 2 * ln + len + 9 - q)) AS far FROM p WHERE 10 + (q * 7 + l_suppkey) % 30 >= 15)
SELECT tid, pos::BIGINT AS pos, sample, base, ins, del_len, count(*) AS n, count(*) FILTER (NOT rev) AS fwd, count(*) FILTER (rev) AS rev, count(*) AS raw, sum(least(mapq, 60) * least(mapq, 60))::BIGINT AS sum_mq2, sum(far)::BIGINT AS sum_alen
FROM o GROUP BY ALL"""
)
def pileup_counts(spark, sf):
    rows = X.project(spark, sf, "lineitem", X.CIGARS | _BASES)
    quals = F.transform(F.sequence(F.lit(0), F.length("bases") - 1), lambda i: (10 + (i * 7 + F.col("l_suppkey")) % 30).cast("int"))
    flag = F.when(F.col("l_returnflag") == "R", 16).otherwise(0)
    reads = rows.select("sample", flag.alias("flag"), "tid", "pos", "mapq", R.cigar_ops("cigar").alias("ops"), "bases", quals.alias("quals"), F.xxhash64(*X.LINEITEM).alias("seq"))
    return tiles.counted(reads, 15)[0]


# ---------------------------------------------------------------- alleles

_COUNTS = f"{_OBS}, n AS (SELECT tid, pos, ref, sample, base, base <> ref AS is_alt, count(*) AS n, count(*) FILTER (NOT is_rev) AS fwd, count(*) FILTER (is_rev) AS rev, sum(mapq * mapq)::BIGINT AS s FROM obs WHERE q >= 20 GROUP BY ALL)"
_A = ["ref", "base", "is_alt"]


def counts(spark: SparkSession, sf: str) -> DataFrame:
    return pileup.allele_counts(obs(spark, sf).filter("q >= 20").withColumn("is_alt", F.expr("base <> ref")), _A)


@query(f"WITH {_COUNTS} SELECT tid, pos, sample, base, n FROM n")
def allele_counts(spark, sf):
    return counts(spark, sf).select("tid", "pos", "sample", "base", "n")


@query(f"WITH {_COUNTS} SELECT tid, pos, sample, base, fwd, rev FROM n")
def allele_strand_counts(spark, sf):
    return counts(spark, sf).select("tid", "pos", "sample", "base", "fwd", "rev")


@query(f"WITH {_COUNTS}, k AS (SELECT *, sum(n) OVER w >= 4 AND sum(fwd) OVER w >= 1 AND sum(rev) OVER w >= 1 AS ok FROM n WINDOW w AS (PARTITION BY tid, pos, ref, base)) SELECT tid, pos, sample, base, n FROM k WHERE ok")
def allele_support_filter(spark, sf):
    return pileup.supported(counts(spark, sf), 4, 1, _A).select("tid", "pos", "sample", "base", "n")


_VOTE = f"""{_OBS}, v AS (SELECT tid, pos, sample, frag, base, count(*) AS n FROM obs GROUP BY ALL),
t AS (SELECT *, max(n) OVER w AS m FROM v WINDOW w AS (PARTITION BY tid, pos, sample, frag)), u AS (SELECT *, count(*) FILTER (n = m) OVER (PARTITION BY tid, pos, sample, frag) AS ties FROM t),
voted AS (SELECT *, ties = 1 AND n < m AS dropped FROM u)"""


@query(f"WITH {_VOTE} SELECT tid, pos, sample, frag, base, n, dropped FROM voted")
def fragment_vote(spark, sf):
    return pileup.vote(obs(spark, sf)).groupBy("tid", "pos", "sample", "frag", "base", "dropped").agg(F.count("*").alias("n"))


@query(f"WITH {_VOTE} SELECT tid, pos, sum(n)::BIGINT AS dropped FROM voted WHERE dropped GROUP BY tid, pos")
def dropped_reads(spark, sf):
    return pileup.dropped_reads(pileup.vote(obs(spark, sf)))


_NUMBERED = "x AS (SELECT *, CASE WHEN is_alt THEN instr('ACGT', base) ELSE 0 END AS a FROM n)"


@query(
    f"""WITH {_COUNTS}, {_NUMBERED}, r AS (SELECT *, row_number() OVER (PARTITION BY tid, pos, sample ORDER BY n DESC, a) AS r FROM x),
g AS (SELECT tid, pos, sample, max(a) FILTER (r = 1 AND n >= 2) AS x, max(a) FILTER (r = 2 AND n >= 2) AS y FROM r GROUP BY ALL)
SELECT tid, pos, sample, CASE WHEN x IS NULL THEN './.' ELSE concat(x, '/', coalesce(y, x)) END AS gt FROM g"""
)
def genotype_top2(spark, sf):
    numbered = counts(spark, sf).withColumn("a", F.when(F.col("is_alt"), F.instr(F.lit("ACGT"), F.col("base"))).otherwise(0))
    return pileup.genotypes(numbered, 2)


@query(f"WITH {_COUNTS}, t AS (SELECT tid, pos, base, is_alt, sum(n) AS n FROM n GROUP BY ALL) SELECT tid, pos, coalesce(max(n) FILTER (is_alt), 0)::BIGINT AS qual FROM t GROUP BY tid, pos")
def site_qual(spark, sf):
    return pileup.site_quality(counts(spark, sf))


@query(f"WITH {_COUNTS} SELECT tid, pos, base, floor(sqrt(sum(s) / sum(n)) + 0.499)::INT AS amq FROM n GROUP BY ALL")
def allele_amq(spark, sf):
    return pileup.allele_mapq(counts(spark, sf))


@query(f"WITH {_COUNTS} SELECT tid, pos, substr('=ACMGRSVTWYHKDBN', bit_or(CASE base WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 ELSE 8 END)::INT + 1, 1) AS base FROM n WHERE n >= 2 GROUP BY tid, pos")
def consensus_base(spark, sf):
    return pileup.consensus_base(counts(spark, sf).filter("n >= 2"))


@query(f"WITH {_COUNTS}, m AS (SELECT tid, pos, base, sum(n) AS n FROM n GROUP BY ALL) SELECT tid, pos, base FROM m QUALIFY row_number() OVER (PARTITION BY tid, pos ORDER BY n DESC, base) = 1")
def majority_allele(spark, sf):
    return pileup.majority_base(counts(spark, sf))


@query(f"WITH {_OBS}, d AS (SELECT tid, pos, count(*) AS depth FROM obs GROUP BY ALL), m AS (SELECT tid, avg(depth) AS m FROM d GROUP BY tid) SELECT tid, CASE WHEN floor(m + 3 * sqrt(m) + 0.499) < 255 THEN floor(m + 3 * sqrt(m) + 0.499)::BIGINT END AS cap FROM m")
def softmask_cap(spark, sf):
    return pileup.softmask_cap(obs(spark, sf).groupBy("tid", "pos").agg(F.count("*").alias("depth")))


# ---------------------------------------------------------------- structural variants

_BREAKS = f"b0 AS ({X.sql(X.BREAKS, 'lineitem', '')}), breaks AS (SELECT *, (tid0 * {X.CONTIG} + pos0 + tid1 * {X.CONTIG} + pos1) // 2 AS mid FROM b0)"
_CLUSTERS = f"""{_BREAKS}, l AS (SELECT *, CASE WHEN mid - lag(mid) OVER (ORDER BY mid) <= 50 THEN NULL ELSE mid END AS s FROM (SELECT DISTINCT mid FROM breaks)),
k AS (SELECT mid, last_value(s IGNORE NULLS) OVER (ORDER BY mid ROWS UNBOUNDED PRECEDING) AS cluster FROM l), cl AS (SELECT b.*, cluster FROM breaks b JOIN k USING (mid))"""


def contigs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, f"chr{i}", X.CONTIG, i * X.CONTIG) for i in range(5)], "tid long, name string, len long, off long")


def breaks(spark: SparkSession, sf: str) -> DataFrame:
    mid = f"(tid0 * {X.CONTIG} + pos0 + tid1 * {X.CONTIG} + pos1) div 2"
    return X.project(spark, sf, "lineitem", X.BREAKS, keep=False).selectExpr("*", f"{mid} AS mid", "false AS rev0", "false AS rev1")


@query(f"WITH {_CLUSTERS} SELECT cluster, count(*) AS n, min(mid) AS lo, max(mid) AS hi FROM cl GROUP BY cluster")
def sv_clusters(spark, sf):
    return sv.clusters(breaks(spark, sf)).groupBy("cluster").agg(F.count("*").alias("n"), F.min("mid").alias("lo"), F.max("mid").alias("hi"))


@query(
    f"""WITH {_CLUSTERS}, big AS (SELECT * FROM cl QUALIFY count(*) OVER (PARTITION BY cluster) >= 3),
c AS (SELECT *, CASE WHEN tid0 <> lag(tid0) OVER w OR tid1 <> lag(tid1) OVER w THEN 1 ELSE 0 END AS cut FROM big WINDOW w AS (PARTITION BY cluster ORDER BY tid0, pos0, mid, tid1, pos1, seq)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY cluster ORDER BY tid0, pos0, mid, tid1, pos1, seq ROWS UNBOUNDED PRECEDING) AS sub FROM c),
a AS (SELECT cluster, sub, min(tid0) AS tid0, min(tid1) AS tid1, floor(avg(pos0) + 0.499)::BIGINT AS p0, floor(avg(pos1) + 0.499)::BIGINT AS p1, sum(qgap)::DOUBLE / count(*) + 0.499 AS q, count(*) AS n FROM s GROUP BY cluster, sub)
SELECT cluster, tid0, p0 AS pos0, tid1, p1 AS pos1, CASE WHEN tid0 = tid1 THEN 'G' ELSE 'T' END AS kind, CASE WHEN tid0 = tid1 THEN trunc(q)::BIGINT - (p1 - p0) END AS size_change, n FROM a"""
)
def sv_calls(spark, sf):
    return sv.calls(breaks(spark, sf), contigs(spark))[0].select("cluster", "tid0", "pos0", "tid1", "pos1", "kind", "size_change", "n")


_SPLIT = {"tid": "l_suppkey % 5", "pos": "CAST(l_orderkey % 900 * 200 AS INT)", "mapq": "60", "cigar": f"concat({X.LEN} + 10, 'M50S')", "nm": "0", "flag": "0",
    "sa": f"concat('chr', l_suppkey % 5, ',', l_orderkey % 900 * 200 + 1000, ',+,', {X.LEN} + 10 + l_linenumber, 'S', 50 - l_linenumber, 'M,60,1;')", "seq": X.BREAKS["seq"]}


@query(
    f"""WITH a AS ({X.sql(_SPLIT, "lineitem", "l_linenumber, l_quantity")}) SELECT seq, (2 * tid * {X.CONTIG} + pos + {X.LEN} + 10 + substr(sa, instr(sa, ',') + 1, instr(substr(sa, instr(sa, ',') + 1), ',') - 1)::BIGINT - 1) // 2 AS mid, tid AS tid0, (pos + {X.LEN} + 10)::BIGINT AS pos0, tid AS tid1,
substr(sa, instr(sa, ',') + 1, instr(substr(sa, instr(sa, ',') + 1), ',') - 1)::BIGINT - 1 AS pos1, l_linenumber::BIGINT AS qgap FROM a"""
)
def split_breakpoints(spark, sf):
    split = X.project(spark, sf, "lineitem", _SPLIT, keep=False)
    return sv.breakpoints(sv.split_sides(split, contigs(spark)), contigs(spark)).select("seq", "mid", "tid0", "pos0", "tid1", "pos1", "qgap")


# ---------------------------------------------------------------- copy number

_CNV = f"{_TIERED}, seg5 AS (SELECT concat('chr', tid) AS chrom, st, en, d0, d1, d2, (st // 1000) % 7 = 0 AS flt FROM depth)"
_W = "CASE WHEN flt THEN 0 WHEN d1 > 2 THEN 1 WHEN d0 <= 2 THEN -1 ELSE 0 END AS w_gain, CASE WHEN flt THEN 0 WHEN d2 < 2 THEN 1 ELSE -1 END AS w_loss1, CASE WHEN flt THEN 0 WHEN d2 = 0 THEN 1 WHEN d0 > 0 THEN -4 ELSE -8 END AS w_loss2"


def depth_bed(spark: SparkSession, sf: str) -> DataFrame:
    return tiers(spark, sf).selectExpr("concat('chr', tid) AS chrom", "st", "en", "d0", "d1", "d2", "(st div 1000) % 7 = 0 AS flt")


@query(f"WITH {_CNV} SELECT chrom, st, en, {_W} FROM seg5")
def cnv_classify(spark, sf):
    return cnv.classified(depth_bed(spark, sf)).select("chrom", "st", "en", "w_gain", "w_loss1", "w_loss2")


@query(
    f"""WITH {_CNV}, w AS (SELECT en - st AS len, {_W} FROM seg5 WHERE NOT flt), k AS (SELECT 'gain' AS kind, len, w_gain AS w FROM w UNION ALL SELECT 'loss1', len, w_loss1 FROM w UNION ALL SELECT 'loss2', len, w_loss2 FROM w)
SELECT kind, coalesce(sum(len) FILTER (w = 1), 0)::BIGINT AS signal, coalesce(sum(len) FILTER (w < 0), 0)::BIGINT AS other, round(4.0::DOUBLE * coalesce(sum(len) FILTER (w = 1), 0) / nullif(sum(len) FILTER (w < 0), 0), 6) AS penalty FROM k GROUP BY kind"""
)
def cnv_penalty(spark, sf):
    return cnv.penalties(cnv.classified(depth_bed(spark, sf))).withColumn("penalty", F.round("penalty", 6))


@query(
    f"""WITH {_CNV}, n AS (SELECT *, CASE WHEN NOT flt AND en - st > 30 THEN ceil((en - st - 30) / 20.0)::BIGINT + 1 ELSE 1 END AS n FROM seg5), k AS (SELECT *, unnest(range(0, n)) AS k FROM n)
SELECT chrom, (st + k * 20)::BIGINT AS st, CASE WHEN k = n - 1 THEN en ELSE st + (k + 1) * 20 END::BIGINT AS en, d0, d1, d2, flt FROM k"""
)
def cnv_split(spark, sf):
    return cnv.split_long(depth_bed(spark, sf), 20)


@query()
def cnv_segments(spark, sf):
    return cnv.call(depth_bed(spark, sf))[0]


_PLANTED = {"gain": (200, 320), "loss1": (500, 600), "loss2": (800, 830)}


def _planted_sql() -> str:
    at = "SELECT *, o_orderkey % 1000 AS k, concat('chr', o_orderkey // 5000) AS chrom, o_orderkey % 5000 * 1000 AS st FROM orders"
    hits = {k: " OR ".join(f"k BETWEEN {a} AND {b - 1}" for a, b in blocks) for k, blocks in {"gain": [_PLANTED["gain"]], "loss1": [_PLANTED["loss1"], _PLANTED["loss2"]], "loss2": [_PLANTED["loss2"]]}.items()}
    return " UNION ALL ".join(f"SELECT '{kind}' AS kind, chrom, min(st)::BIGINT AS st, (max(st) + 1000)::BIGINT AS en, count(*) * 1000::DOUBLE AS score FROM ({at}) WHERE {hit} GROUP BY chrom, o_orderkey // 1000, k < 700" for kind, hit in hits.items())


@query(_planted_sql())
def cnv_planted(spark, sf):
    """Depth with known gains and losses in every thousand segments: the calls are exactly these."""
    within = lambda kind: F.expr("o_orderkey % 1000").between(_PLANTED[kind][0], _PLANTED[kind][1] - 1)
    lost = lambda depth: F.when(within("loss2"), 0).otherwise(depth)
    rows = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("*", "concat('chr', o_orderkey div 5000) AS chrom", "o_orderkey % 5000 * 1000 AS st", "o_orderkey % 5000 * 1000 + 1000 AS en", "false AS flt")
    gained = F.when(within("gain"), 3).otherwise(2)
    segments = rows.select("chrom", "st", "en", lost(gained).alias("d0"), lost(gained).alias("d1"), lost(F.when(within("loss1"), 1).otherwise(3)).alias("d2"), "flt")
    return cnv.call(segments)[0].drop("p")


@query()
def cnv_gumbel(spark, sf):
    return cnv.call(depth_bed(spark, sf))[1]


# ---------------------------------------------------------------- bulk and cells


def _depths(prefix: str, k: int) -> dict[str, str]:
    size = f"(l_partkey * {k} + l_orderkey + l_linenumber * 3)"
    return {f"{prefix}_rf": f"CAST({size} % 17 AS INT)", f"{prefix}_rr": f"CAST({size} % 13 AS INT)", f"{prefix}_af": f"CAST(CASE WHEN l_orderkey % {k + 2} = 0 THEN {size} % 11 ELSE 0 END AS INT)", f"{prefix}_ar": f"CAST(CASE WHEN l_orderkey % {k + 2} = 0 THEN {size} % 9 ELSE 0 END AS INT)"}


_PAIR = {"chrom": X.SITES["chrom"], "pos": "CAST(l_orderkey * 37 % 1000000 AS INT)", "ref": X.SITES["ref"], "alt": X.SITES["alt"], **_depths("b", 3), **_depths("c", 1), "c_lt": "CAST(l_orderkey % 29 % 2 AS INT)", "seq": "l_orderkey * 1000 + l_linenumber * 100 + l_partkey % 100"}
_DEPTHS = [f"{s}_{d}" for s in "bc" for d in ("rf", "rr", "af", "ar")]
_SUMMED = f"SELECT chrom, pos, ref, alt, {', '.join(f'sum({d})::INT AS {d}' for d in _DEPTHS)}, max(c_lt)::INT AS c_lt FROM p0 GROUP BY chrom, pos, ref, alt"
_DIFF = f"""p0 AS ({X.sql(_PAIR, "lineitem", "")}), p AS ({_SUMMED}),
s AS (SELECT *, b_rf + b_rr AS br, b_af + b_ar AS ba, c_rf + c_rr AS cr, c_af + c_ar AS ca FROM p WHERE b_rf + b_rr + b_af + b_ar >= 15),
f AS (SELECT *, least(b_rf, b_rr, b_af, b_ar) > 0 AND br >= 5 AND ba >= 5 AND br / (br + ba) >= 0.3 AND ba / (br + ba) >= 0.3 AS het,
  ca >= 5 AND coalesce(ca / nullif(cr + ca, 0) >= 0.2, false) AND c_lt <= 0 AND c_af >= 1 AND c_ar >= 1 AS called, CASE WHEN ref > alt THEN translate(concat(ref, alt), 'ACGT', 'TGCA') ELSE concat(ref, alt) END AS kind FROM s),
c AS (SELECT *, ba <= 0 AND called AS candidate FROM f),
w AS (SELECT *, coalesce(pos - lag(pos) OVER q <= 100, false) OR coalesce(lead(pos) OVER q - pos <= 100, false) AS flt FROM c WHERE candidate WINDOW q AS (PARTITION BY chrom ORDER BY pos))"""


def diff_sites(spark: SparkSession, sf: str, columns: dict[str, str] = _PAIR, o: variants.DiffOptions | None = None) -> DataFrame:
    """Sites of all rows: the depths of one position and allele pair are summed."""
    p = X.project(spark, sf, "lineitem", columns, keep=False)
    return variants.sites(p.groupBy(*joint.SITE).agg(*[F.sum(d).cast("int").alias(d) for d in _DEPTHS], F.max("c_lt").alias("c_lt")), o or variants.DiffOptions())


@query(f"WITH {_DIFF} SELECT chrom, pos, ref, alt, het, called, candidate FROM c")
def snv_calls(spark, sf):
    return diff_sites(spark, sf).select("chrom", "pos", "ref", "alt", "het", "called", "candidate")


@query(f"WITH {_DIFF} SELECT chrom, pos, kind FROM w WHERE NOT flt")
def snv_window(spark, sf):
    return variants.novel(diff_sites(spark, sf), variants.DiffOptions()).select("chrom", "pos", "kind")


@query(
    f"""WITH {_DIFF}, a AS (SELECT count(*) AS n_het, count(*) FILTER (NOT called) AS n_fn, count(*) FILTER (cr = 0) AS n_ado_ref, count(*) FILTER (ca = 0) AS n_ado_alt, count(*) FILTER (cr = 0 AND ca = 0) AS n_ado_both FROM c WHERE het)
SELECT *, round(n_fn / nullif(n_het, 0), 4) AS r_fn, round(n_ado_ref / nullif(n_het, 0), 4) AS r_ado_ref, round(n_ado_alt / nullif(n_het, 0), 4) AS r_ado_alt, round(n_ado_both / nullif(n_het, 0), 4) AS r_ado_both FROM a"""
)
def ado_stats(spark, sf):
    return variants.rates(diff_sites(spark, sf))


@query(f"WITH {_DIFF} SELECT count(*) AS n_snv, count(*) FILTER (kind <> 'CT') AS n_snv_nonct, 0::BIGINT AS n_del, 0::BIGINT AS n_ins FROM w WHERE NOT flt")
def snv_tallies(spark, sf):
    return variants.tallies(variants.novel(diff_sites(spark, sf), variants.DiffOptions()))


# transitions either way round, deletions and insertions
_MIXED = _PAIR | {k: f"CASE CAST(l_partkey % 5 AS INT) WHEN 0 THEN '{a}' WHEN 1 THEN '{b}' WHEN 2 THEN '{c}' WHEN 3 THEN '{d}' ELSE '{e}' END" for k, (a, b, c, d, e) in {"ref": ("C", "G", "AC", "A", "T"), "alt": ("T", "A", "A", "AGG", "C")}.items()}


@query(
    f"""WITH {_DIFF.replace(X.sql(_PAIR, "lineitem", ""), X.sql(_MIXED, "lineitem", ""))}, k AS (SELECT CASE WHEN length(ref) > length(alt) THEN 'DEL' WHEN length(ref) < length(alt) THEN 'INS' ELSE kind END AS kind FROM w WHERE NOT flt)
SELECT count(*) FILTER (kind NOT IN ('DEL', 'INS')) AS n_snv, count(*) FILTER (kind NOT IN ('DEL', 'INS', 'CT')) AS n_snv_nonct, count(*) FILTER (kind = 'DEL') AS n_del, count(*) FILTER (kind = 'INS') AS n_ins FROM k"""
)
def snv_tallies_indels(spark, sf):
    o = variants.DiffOptions(indels=True)
    return variants.tallies(variants.novel(diff_sites(spark, sf, _MIXED, o), o))


@query(f"WITH p AS ({X.sql(_PAIR, 'lineitem', '')}) SELECT ref, alt, CASE WHEN ref > alt THEN translate(concat(ref, alt), 'ACGT', 'TGCA') ELSE concat(ref, alt) END AS kind, count(*) AS n FROM p GROUP BY ALL")
def mutation_class(spark, sf):
    return X.project(spark, sf, "lineitem", _PAIR, keep=False).groupBy("ref", "alt", R.mutation_class("ref", "alt").alias("kind")).agg(F.count("*").alias("n"))


_LONG = {"chrom": X.SITES["chrom"], "pos": "CAST(l_partkey * 37 % 100000 AS INT)", "ref": X.SITES["ref"], "alt": X.SITES["alt"], "sample": X.SITES["sample"], "d": "CAST(floor(l_quantity) AS INT)", "k": "CAST(l_orderkey % 4 AS INT)", "lt0": "CAST(l_orderkey % 3 AS INT)", "end0": "CAST(l_orderkey % 40 AS INT)"}
_SAMPLES = f"""l AS ({X.sql(_LONG, "lineitem", "")}),
m AS (SELECT chrom, pos, ref, alt, sample, sum(CASE WHEN k = 0 THEN d ELSE 0 END)::INT AS rf, sum(CASE WHEN k = 1 THEN d ELSE 0 END)::INT AS rr, sum(CASE WHEN k = 2 THEN d // 4 ELSE 0 END)::INT AS af, sum(CASE WHEN k = 3 THEN d // 4 ELSE 0 END)::INT AS ar, max(lt0)::INT AS lt, min(end0)::INT AS alen FROM l GROUP BY ALL),
bulk AS (SELECT *, rf + rr AS r, af + ar AS a FROM m WHERE sample LIKE 'b%'),
cell0 AS (SELECT *, rf + rr AS r, af + ar AS a, CASE WHEN sample = 'c3' THEN 1 ELSE 2 END AS ploidy FROM m WHERE sample LIKE 'c%'),
cell1 AS (SELECT *, (ploidy = 1 AND a > 0 AND r > 0) OR lt > 1 OR alen < 10 AS flt, alen < 10 AS flt_dmg FROM cell0),
cell AS (SELECT *, NOT flt AND a >= 5 AND af >= 2 AND ar >= 2 AND a >= 0.2 * (r + a) AS is_alt, NOT flt AND a >= 2 AND af >= 1 AND ar >= 1 AS is_joint, NOT flt_dmg AND a >= 4 AND r >= 4 AND af * ar = 0 AND rf * af = 0 AND rr * ar = 0 AS is_dmg FROM cell1),
bs AS (SELECT chrom, pos, ref, alt, bool_and(rf > 0 AND rr > 0 AND af > 0 AND ar > 0 AND r >= 8 AND a >= 8 AND r >= 0.3 * (r + a) AND a >= 0.3 * (r + a)) AS all_het, bool_and(a >= 8) AS all_good_alt, bool_or(r + a < 20) AS low, count(*) FILTER (a <= 0) AS n_ref, count(*) > 1 AND count(*) FILTER (a = 0) > 0 AND count(*) FILTER (a >= 5 AND af >= 2 AND ar >= 2) > 0 AS differs FROM bulk GROUP BY ALL),
cs AS (SELECT chrom, pos, ref, alt, coalesce(sum(af) FILTER (NOT flt), 0) AS af, coalesce(sum(ar) FILTER (NOT flt), 0) AS ar, count(*) FILTER (is_joint) AS n_joint, count(*) FILTER (is_dmg) AS n_dmg FROM cell GROUP BY ALL),
site AS (SELECT chrom, pos, ref, alt, all_het, all_good_alt, differs, n_ref, n_joint, n_dmg, low AS flt_bulk, n_ref = 0 OR af < 2 OR ar < 2 OR af + ar < 5 AS flt_snv FROM bs JOIN cs USING (chrom, pos, ref, alt)),
carry AS (SELECT chrom, pos, ref, alt, sample, coalesce(pos - lag(pos) OVER q <= 100, false) OR coalesce(lead(pos) OVER q - pos <= 100, false) AS near FROM cell JOIN (SELECT chrom, pos, ref, alt FROM site WHERE NOT all_good_alt) USING (chrom, pos, ref, alt) WHERE a > 0 WINDOW q AS (PARTITION BY chrom, sample ORDER BY pos)),
close AS (SELECT chrom, pos, ref, alt, bool_or(near) AS near FROM carry GROUP BY ALL),
win AS (SELECT site.*, flt_snv OR flt_bulk OR coalesce(near, false) AS flt FROM site LEFT JOIN close USING (chrom, pos, ref, alt) WHERE NOT all_good_alt)"""
_OPT = joint.JointOptions()


def samples(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = X.project(spark, sf, "lineitem", _LONG, keep=False)
    part = lambda k, div: F.sum(F.when(F.col("k") == k, F.expr(f"d div {div}")).otherwise(0)).cast("int")
    m = rows.groupBy(*joint.SITE, "sample").agg(part(0, 1).alias("rf"), part(1, 1).alias("rr"), part(2, 4).alias("af"), part(3, 4).alias("ar"), F.max("lt0").alias("lt"), F.min("end0").alias("alen"))
    m = settled(m)  # bulks, cells and what is made of them all read it
    cells = m.filter("sample like 'c%'").withColumn("ploidy", F.when(F.col("sample") == "c3", 1).otherwise(2))
    return m.filter("sample like 'b%'"), joint.cell_calls(joint.cell_flags(cells, _OPT), _OPT)


def windowed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    bulks, cells = samples(spark, sf)
    sites = joint.joint_sites(bulks, cells, _OPT)
    return sites, cells, joint.shared_cell_window(sites, cells, _OPT)


@query(f"WITH {_SAMPLES} SELECT chrom, pos, ref, alt, all_het, all_good_alt, n_ref, n_joint, n_dmg, flt_bulk, flt_snv FROM site")
def joint_flags(spark, sf):
    return windowed(spark, sf)[0].select(*joint.SITE, "all_het", "all_good_alt", "n_ref", "n_joint", "n_dmg", "flt_bulk", "flt_snv")


@query(f"WITH {_SAMPLES} SELECT chrom, pos, ref, alt, flt FROM win")
def joint_window(spark, sf):
    return windowed(spark, sf)[2].select(*joint.SITE, "flt")


@query(
    f"""WITH {_SAMPLES} SELECT chrom, pos, ref, alt, sample, CASE WHEN cell.flt OR r + a = 0 OR (a > 0 AND a < 2) THEN '.' WHEN ploidy = 1 THEN CASE WHEN a > 0 THEN '4' ELSE '3' END WHEN a > 0 AND r > 0 THEN '1' WHEN a > 0 THEN '2' ELSE '0' END AS code
FROM cell JOIN (SELECT chrom, pos, ref, alt FROM win WHERE NOT flt_bulk) USING (chrom, pos, ref, alt)"""
)
def joint_calls(spark, sf):
    _, cells, win = windowed(spark, sf)
    return joint.call_codes(cells, _OPT).join(win.filter("not flt_bulk").select(*joint.SITE), joint.SITE, "left_semi").select(*joint.SITE, "sample", "code")


@query(
    f"""WITH {_SAMPLES}, h AS (SELECT chrom, pos, ref, alt FROM site WHERE all_het AND NOT flt_bulk),
e AS (SELECT sample, count(*) AS n_het, count(*) FILTER (flt OR r < 2) AS ado_ref, count(*) FILTER (flt OR a < 2) AS ado_alt, count(*) FILTER (NOT is_alt) AS fn FROM cell JOIN h USING (chrom, pos, ref, alt) GROUP BY sample),
v AS (SELECT sample, count(*) AS snv FROM cell JOIN (SELECT chrom, pos, ref, alt FROM win WHERE NOT flt) USING (chrom, pos, ref, alt) WHERE is_alt GROUP BY sample)
SELECT sample, coalesce(n_het, 0) AS n_het, coalesce(ado_ref, 0) AS ado_ref, coalesce(ado_alt, 0) AS ado_alt, coalesce(fn, 0) AS fn, coalesce(snv, 0) AS snv, round(CASE WHEN sample = 'c3' THEN 2.0::DOUBLE * fn / nullif(n_het, 0) - 1 ELSE fn / nullif(n_het, 0) END, 4) AS fn_rate FROM (SELECT DISTINCT sample FROM cell) LEFT JOIN e USING (sample) LEFT JOIN v USING (sample)"""
)
def joint_stats(spark, sf):
    sites, cells, win = windowed(spark, sf)
    return joint.cell_rates(sites, cells, win.filter("not flt"), _OPT).select("sample", "n_het", "ado_ref", "ado_alt", "fn", "snv", "fn_rate")


@query(
    f"""WITH {_SAMPLES}, r AS (SELECT *, CASE WHEN sample IN ('c1', 'c2') THEN 'merged' ELSE sample END AS name FROM cell1)
SELECT chrom, pos, ref, alt, name AS sample, min(rf) AS rf, min(af) AS af, min(rr) AS rr, min(ar) AS ar, max(lt) AS lt, bool_or(flt) AS flt FROM r GROUP BY ALL"""
)
def replicate_min(spark, sf):
    names = spark.createDataFrame([("merged", "c1"), ("merged", "c2")], "canonical string, replicate string")
    return joint.merge_replicates(samples(spark, sf)[1], names).select(*joint.SITE, "sample", "rf", "af", "rr", "ar", "lt", "flt")


@query(
    f"""WITH {_SAMPLES}, d AS (SELECT *, coalesce(pos - lag(pos) OVER q <= 100, false) OR coalesce(lead(pos) OVER q - pos <= 100, false) AS near FROM site WHERE differs WINDOW q AS (PARTITION BY chrom ORDER BY pos))
SELECT chrom, pos, ref, alt FROM d WHERE NOT near AND NOT flt_bulk"""
)
def bulk_diff_window(spark, sf):
    return joint.bulk_difference_window(windowed(spark, sf)[0], _OPT).select(*joint.SITE)


# ---------------------------------------------------------------- sequences


def seqs(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", F.regexp_replace(F.upper(F.regexp_replace("text", "[^ -~]", "")), "[^ACGTN]", "").alias("seq"))


_SEQS = "s AS (SELECT doc_id, regexp_replace(upper(regexp_replace(text, '[^ -~]', '', 'g')), '[^ACGTN]', '', 'g') AS seq FROM documents)"


@query(f"WITH {_SEQS} SELECT doc_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq FROM s")
def seq_revcomp(spark, sf):
    return seqs(spark, sf).select("doc_id", R.reverse_complement("seq").alias("seq"))


@query(f"WITH {_SEQS} SELECT doc_id, regexp_replace(regexp_replace(seq, '^N+', ''), 'N+$', '') AS seq FROM s")
def seq_nstrip(spark, sf):
    return seqs(spark, sf).select("doc_id", R.strip_n("seq").alias("seq"))


@query(f"WITH {_SEQS}, w AS (SELECT doc_id, unnest(range(0, length(seq) - 4)) AS i, seq FROM s) SELECT doc_id, i::BIGINT AS pos, substr(seq, i + 1, 5) AS word FROM w WHERE hamming(substr(seq, i + 1, 5), 'TTATA') <= 1 AND NOT contains(substr(seq, i + 1, 5), 'N')")
def seq_motif_hits(spark, sf):
    return trim.motif_positions(seqs(spark, sf), "seq", "TTATA").select("doc_id", "pos", "word")


#: Letters of a template; and bits of a pair's id that number the windows of its document.
TEMPLATE, WINDOW_BITS = 100, 24


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Read pairs cut from all of the documents' letters in consecutive windows: a template behind the binding motif, read from both ends.

    The last window holds what is left; a document without letters has one pair of an empty template.
    """
    s = seqs(spark, sf).withColumn("seq", F.replace("seq", F.lit("N")))
    s = s.select("doc_id", F.posexplode_outer(F.regexp_extract_all("seq", F.lit(f"(.{{1,{TEMPLATE}}})"), F.lit(1))).alias("k", "insert"))
    s = s.select("doc_id", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("insert", F.lit("")).alias("insert"))
    one = F.concat(F.substring("insert", 60, 8), F.lit(trim.BIND), F.substring("insert", 1, 80))
    two = R.reverse_complement(F.when(F.col("doc_id") % 3 == 0, F.col("insert")).otherwise(F.substring("insert", 21, 80)))
    pair_id = F.shiftleft("doc_id", WINDOW_BITS).bitwiseOR(F.col("k").cast("long"))
    return s.select(pair_id.alias("pair_id"), F.concat_ws("", F.lit("r"), "doc_id", F.lit("."), "k").alias("name"), one.alias("seq1"), F.repeat(F.lit("I"), F.length(one)).alias("qual1"), two.alias("seq2"), F.repeat(F.lit("I"), F.length(two)).alias("qual2"))


@query()
def trim_pairs(spark, sf):
    return trim.trim(pairs(spark, sf))


@query()
def merge_pairs(spark, sf):
    return trim.fastq_lines(trim.trim(pairs(spark, sf)).filter(F.col("type") == trim.MERGED))


# ---------------------------------------------------------------- streaming


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """The table as a stream of its files: a pattern, as streams take no path of one file, and a table may be that or a folder."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")


def _folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    import uuid

    return f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"


@query("SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 AS is_dup FROM events")
def stream_dedup(spark, sf):
    from helixframe.streaming import passes

    columns = {"event_id": "long", "user_id": "long", "event_type": "string"}
    return passes.flag_duplicates(_events(spark, sf).select(*columns), ["user_id", "event_type"], "event_id", columns, _folder(spark))


@query("SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_depth(spark, sf):
    from helixframe.streaming import passes

    done = passes.drained(passes.windowed_depth(_events(spark, sf), "ts", ["event_type"]), _folder(spark), "complete")
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"WITH {_GROUPS} SELECT tid, is_rev, anchor, n, s AS sum_mq2, longest FROM g")
def stream_groups(spark, sf):
    from helixframe.streaming import passes

    ends = reads(spark, sf).select(F.col("tid").cast("long").alias("tid"), F.col("pos").alias("st"), (F.col("pos") + F.col("rlen")).alias("en"), "is_rev", "mapq")
    return passes.grouped(_streamed(spark, ends, "st", "en"), _folder(spark))


@query(f"WITH {_DEPTH} SELECT tid::BIGINT AS tid, st, en, depth FROM depth")
def stream_sweep(spark, sf):
    from helixframe.streaming import passes

    spans = reads(spark, sf).select(F.col("tid").cast("long").alias("tid"), F.col("pos").alias("st"), (F.col("pos") + F.col("rlen")).alias("en"))
    return passes.depth(_streamed(spark, spans, "st", "en"), _folder(spark))


def _streamed(spark: SparkSession, df: DataFrame, *at: str) -> DataFrame:
    """Rows of contigs as a stream of files, a sentinel row a contig at the end."""
    from helixframe.streaming import passes

    last = df.select("tid").distinct()
    for c in df.columns:
        if c != "tid":
            last = last.withColumn(c, F.lit(passes.END if c in at else None).cast(df.schema[c].dataType))
    folder = f"{_folder(spark)}/in"
    df.unionByName(last.select(*df.columns)).write.parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)
