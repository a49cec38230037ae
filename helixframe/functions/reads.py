"""Column functions on reads: CIGAR strings, sequences, flags and quality averages. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# SAM flag bits.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE = 1, 2, 4, 8, 16, 32
READ1, READ2, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 64, 128, 256, 512, 1024, 2048
PILEUP_MASK = UNMAPPED | SECONDARY | QC_FAIL | DUPLICATE
# Operations that consume the query, or the reference.
QUERY_OPS, REFERENCE_OPS = "MIS=X", "MDN=X"
# IUPAC codes and their complements; bases as bits of a 4-bit code.
IUPAC, COMPLEMENT = "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn", "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn"
CODES = "=ACMGRSVTWYHKDBN"


def _i(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has(flag: Column | str, bits: int) -> Column:
    return _i(flag).bitwiseAND(F.lit(bits)) != 0


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cigar_ops(cigar: Column | str) -> Column:
    """``array<struct<op,len>>`` of a CIGAR string."""
    parts = F.regexp_extract_all(_i(cigar), F.lit(r"\d+[MIDNSHP=XB]"), F.lit(0))
    return F.transform(parts, lambda x: F.struct(F.right(x, F.lit(1)).alias("op"), F.left(x, F.length(x) - 1).cast("int").alias("len")))


def consumed(ops: Column | str, kinds: str) -> Column:
    """Sum of lengths of operations among ``kinds``."""
    return F.aggregate(_i(ops), F.lit(0), lambda t, x: t + F.when(F.instr(F.lit(kinds), x["op"]) > 0, x["len"]).otherwise(0))


def query_length(ops: Column | str) -> Column:
    return consumed(ops, QUERY_OPS)


def aligned_query_length(ops: Column | str) -> Column:
    return consumed(ops, QUERY_OPS.replace("S", ""))


def reference_span(ops: Column | str) -> Column:
    return consumed(ops, REFERENCE_OPS)


def clip_length(ops: Column | str) -> Column:
    """Clipped bases at both ends; a single operation counts none."""
    ops = _i(ops)
    end = lambda x: F.when(x["op"].isin("S", "H"), x["len"]).otherwise(0)
    return F.when(F.size(ops) > 1, end(F.element_at(ops, 1)) + end(F.element_at(ops, -1))).otherwise(0)


def aligned_blocks(pos: Column | str, ops: Column | str) -> Column:
    """``array<struct<op,ref,query,len>>``: where each operation starts on reference and query."""
    start = F.struct(_i(pos).cast("int").alias("ref"), F.lit(0).alias("query"), F.array().cast("array<struct<op:string,ref:int,query:int,len:int>>").alias("out"))

    def step(t: Column, x: Column) -> Column:
        moves = lambda kinds: F.when(F.instr(F.lit(kinds), x["op"]) > 0, x["len"]).otherwise(0)
        here = F.struct(x["op"].alias("op"), t["ref"].alias("ref"), t["query"].alias("query"), x["len"].alias("len"))
        return F.struct((t["ref"] + moves(REFERENCE_OPS)).alias("ref"), (t["query"] + moves(QUERY_OPS)).alias("query"), F.array_append(t["out"], here).alias("out"))

    return F.aggregate(_i(ops), start, step)["out"]


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(_i(seq), IUPAC, COMPLEMENT))


def base_code(base: Column | str) -> Column:
    """4-bit code of an IUPAC base; 15 for anything else."""
    at = F.instr(F.lit(CODES), F.upper(_i(base)))
    return F.when(at > 0, at - 1).otherwise(15)


def code_base(code: Column | str) -> Column:
    return F.substring(F.lit(CODES), _i(code).cast("int") + 1, F.lit(1))


def strip_n(seq: Column | str) -> Column:
    return F.regexp_replace(_i(seq), "^N+|N+$", "")


def rms(sum_of_squares: Column | str, n: Column | str) -> Column:
    """Root mean square, rounded as floor(x + 0.499)."""
    return F.floor(F.sqrt(_i(sum_of_squares) / F.nullif(_i(n), F.lit(0))) + 0.499).cast("int")


def truncated(x: Column) -> Column:
    """Rounding of a possibly negative mean: add 0.499, drop the fraction."""
    y = x + 0.499
    return F.when(y < 0, F.ceil(y)).otherwise(F.floor(y)).cast("long")


def fragment_id(flag: Column | str, pos: Column | str, span: Column | str, isize: Column | str) -> Column:
    """5' end and strand of the fragment, shifted together; null for other than primary reads of a proper pair or single reads."""
    rev = F.when(has(flag, REVERSE), 1).otherwise(0)
    mate_rev = F.when(has(flag, MATE_REVERSE), 1).otherwise(0)
    five = _i(pos) + F.when(has(flag, REVERSE), _i(span) - 1).otherwise(0)
    first = ~has(flag, PAIRED) | has(flag, READ1)
    second = has(flag, READ2) & has(flag, PROPER)
    out = F.when(first, F.shiftleft(five.cast("long"), 1) + rev).when(second, F.shiftleft((five + _i(isize)).cast("long"), 1) + mate_rev)
    return F.when(~has(flag, SECONDARY | SUPPLEMENTARY), out)


def bin_of(beg: Column | str, end: Column | str, shift: int = 14, levels: int = 5) -> Column:
    """Smallest bin of the hierarchical index that holds [beg, end)."""
    beg, last = _i(beg).cast("long"), _i(end).cast("long") - 1
    out = None
    for k in range(levels, 0, -1):
        s = shift + 3 * (levels - k)
        same = F.shiftright(beg, s) == F.shiftright(last, s)
        value = F.lit(((1 << 3 * k) - 1) // 7) + F.shiftright(beg, s)
        out = F.when(same, value) if out is None else out.when(same, value)
    return out.otherwise(F.lit(0)).cast("long")


def mutation_class(ref: Column | str, alt: Column | str) -> Column:
    """Two-letter class of a substitution, complemented so that the reference base is A or C ordered below its partner."""
    pair = F.concat(_i(ref), _i(alt))
    return F.when(_i(ref) > _i(alt), F.translate(pair, "ACGT", "TGCA")).otherwise(pair)


def poisson_mapq(mapq: Column | str, nm: Column | str, ops: Column | str, coef: float) -> Column:
    """Mapping quality less the phred-scaled chance of so many differences (a bounded sum inside the expression)."""
    ops, nm, mapq = _i(ops), _i(nm), _i(mapq)
    among = lambda x, kinds: F.when(x["op"].isin(*kinds), x["len"]).otherwise(0)
    tally = lambda t, x: F.struct((t["match"] + among(x, "M=X")).alias("match"), (t["gaps"] + among(x, "ID")).alias("gaps"), (t["opens"] + F.when(x["op"].isin("I", "D"), 1).otherwise(0)).alias("opens"))
    none = F.struct(F.lit(0).alias("match"), F.lit(0).alias("gaps"), F.lit(0).alias("opens"))

    def lowered(v: Column) -> Column:
        step = lambda t, k: F.struct((t["term"] * v["lam"] / k).alias("term"), (t["sum"] + t["term"] * v["lam"] / k).alias("sum"))
        start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
        below = F.aggregate(F.when(v["x"] > 1, F.sequence(F.lit(1), v["x"] - 1)).otherwise(F.array().cast("array<int>")), start, step)["sum"]
        phred = bound(1 - F.exp(-v["lam"]) * below, lambda p: F.when(p > 1e-6, -4.343 * F.log(p)).otherwise(60.0))
        return F.greatest(F.lit(0), mapq - F.floor(phred + 0.499).cast("int"))

    def of(t: Column) -> Column:
        values = F.struct((nm - t["gaps"] + t["opens"]).alias("x"), ((t["match"] + t["gaps"]).cast("double") * coef).alias("lam"), t["gaps"].alias("gaps"))
        return bound(values, lambda v: F.when(nm.isNull() | (nm == 0) | (v["gaps"] > nm) | (v["x"] < v["lam"]), mapq).otherwise(lowered(v)))

    return bound(F.aggregate(ops, none, tally), of)
