"""Copy-number segments from depth: signals, penalties, maximal scoring segments, Gumbel P-values."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("gain", "loss1", "loss2")


def split_long(segments: DataFrame, length: int = 1000) -> DataFrame:
    """Cut unflagged segments longer than 1.5 times ``length`` into pieces of it; the last takes what is left."""
    span = F.col("en") - F.col("st")
    n = F.when(~F.col("flt") & (span > length * 1.5), F.ceil((span - length * 1.5) / length) + 1).otherwise(F.lit(1)).cast("long")
    rest = [c for c in segments.columns if c not in ("st", "en")]
    out = segments.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    st = F.col("st") + F.col("_k") * length
    return out.select(*rest, st.alias("_st"), F.when(F.col("_k") == F.col("_n") - 1, F.col("en")).otherwise(st + length).alias("_en")).withColumnsRenamed({"_st": "st", "_en": "en"}).select(*segments.columns)


def signal_weight(kind: str, ploidy: int = 2) -> Column:
    """1 where a segment (d0, d1, d2) shows the signal, a negative weight where it clearly doesn't, 0 in between."""
    d0, d1, d2 = F.col("d0"), F.col("d1"), F.col("d2")
    if kind == "gain":
        return F.when(d1 > ploidy, 1).when(d0 <= ploidy, -1).otherwise(0)
    if kind == "loss1":
        return F.when(d2 < ploidy, 1).otherwise(-1)
    return F.when(d2 == 0, 1).when(d0 > 0, -4).otherwise(-8)


def classified(segments: DataFrame, ploidy: int = 2) -> DataFrame:
    """Adds the weight of each kind of signal; flagged segments have weight 0."""
    return segments.select("*", *[F.when(F.col("flt"), 0).otherwise(signal_weight(k, ploidy)).cast("int").alias(f"w_{k}") for k in KINDS])


def penalties(weighed: DataFrame, c: float = 4.0) -> DataFrame:
    """(kind, signal, other, penalty): lengths with and without the signal, penalty = c * signal / other."""
    span = (F.col("en") - F.col("st")).cast("long")
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"w_{k}").alias("w")) for k in KINDS])
    rows = weighed.filter("not flt").select(span.alias("len"), F.explode(cells).alias("x"))
    sums = rows.groupBy(F.col("x.kind").alias("kind")).agg(F.sum(F.when(F.col("x.w") == 1, F.col("len")).otherwise(0)).cast("long").alias("signal"), F.sum(F.when(F.col("x.w") < 0, F.col("len")).otherwise(0)).cast("long").alias("other"))
    return sums.select("*", F.try_divide(F.lit(c) * F.col("signal"), F.col("other")).alias("penalty"))


def push(out: list[list], new: list) -> None:
    """Add a candidate (start, end, sum before, sum through) to those left of it; both stay what a pass over all scores would hold (Ruzzo and Tompa)."""
    while True:
        j = len(out) - 1
        while j >= 0 and out[j][2] >= new[2]:
            j -= 1
        if j < 0 or out[j][3] >= new[3]:
            out.append(new)
            return
        new = [out[j][0], new[1], out[j][2], new[3]]
        del out[j:]


def candidates(starts: list, ends: list, scores: list[float]) -> tuple[float, list[list]]:
    """(sum of all scores, maximal scoring segments) of consecutive pieces."""
    out: list[list] = []
    total = 0.0
    for a, b, s in zip(starts, ends, scores, strict=True):
        before, total = total, total + s
        if s > 0:
            push(out, [a, b, before, total])
    return total, out


def maximal_segments(scores: np.ndarray, least: float = 0.0) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) with their score, in order (linear time)."""
    _, out = candidates(range(len(scores)), range(1, len(scores) + 1), scores.tolist())
    return [(a, b, through - before) for a, b, before, through in out if through - before >= least]


def joined(parts: list[tuple[float, list[list]]]) -> tuple[float, list[list]]:
    """(sum, candidates) of neighbouring ranges as of one: the candidates of each are pushed behind those before it."""
    total, out = 0.0, []
    for part, held in parts:
        for a, b, before, through in held:
            push(out, [a, b, total + before, total + through])
        total += part
    return total, out


def settled_inside(total: float, held: list[list]) -> list[bool]:
    """Which candidates of a range no range to its left or right can change, unless one segment covers the whole range.

    A segment from the left ends at a candidate only if its sum is above all
    sums before it in the range, and one to the right starts at a candidate only
    if its sum is below all sums behind it.
    """
    peak, peaks = 0.0, []
    for _, _, _, through in held:
        peaks.append(peak)
        peak = max(peak, through)
    trough, out = total, [False] * len(held)
    for k in range(len(held) - 1, -1, -1):
        out[k] = peaks[k] >= held[k][3] and trough <= held[k][2]
        trough = min(trough, held[k][2])
    return out


#: Bits of a range's width in bases, and ranges that one step joins.
RANGE_BITS, JOINED = 20, 16
_HELD = "kind string, chrom string, rng long, st long, en long, lo double, hi double, total double, done boolean"


def _rows_of(kind: str, chrom: str, rng: int, total: float, held: list[list]) -> pa.Table:
    n = len(held)
    st, en, lo, hi = map(list, zip(*held, strict=True)) if n else ([], [], [], [])
    columns = [[kind] * (n + 1), [chrom] * (n + 1), [rng] * (n + 1), [*st, None], [*en, None], [*lo, None], [*hi, None], [None] * n + [total], [*settled_inside(total, held), False]]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in _HELD.split(", ")])


def segments_by_ranges(rows: DataFrame, range_bits: int | None = None, together: int | None = None) -> DataFrame:
    """(kind, chrom, st, en, score): the maximal scoring segments of (kind, chrom, st, en, score).

    Each range of a contig is solved by itself and hands on its sum and the
    candidates that other ranges may still change, which are few; ranges are then
    joined in a tree, ``together`` at a time, so no task holds a contig. A
    candidate that was settled early and turns out to lie in a larger segment
    goes at the end.
    """
    from .intervals import islands
    from .stages import settled

    range_bits, together = range_bits or RANGE_BITS, together or JOINED

    def alone(rows: pa.Table) -> pa.Table:
        st, en, score = zip(*sorted(zip(*(rows[c].to_pylist() for c in ("st", "en", "score")), strict=True), key=lambda r: r[:2]), strict=True)
        total, held = candidates(st, en, score)
        return _rows_of(rows["kind"][0].as_py(), rows["chrom"][0].as_py(), rows["rng"][0].as_py(), total, held)

    def several(rows: pa.Table) -> pa.Table:
        parts: dict[int, list] = {}
        for rng, total, *cell in sorted(zip(*(rows[c].to_pylist() for c in ("rng", "total", "st", "en", "lo", "hi")), strict=True), key=lambda r: (r[0], r[2] is None, r[2] or 0)):
            part = parts.setdefault(rng, [0.0, []])
            if total is None:
                part[1].append(cell)
            else:
                part[0] = total
        return _rows_of(rows["kind"][0].as_py(), rows["chrom"][0].as_py(), rows["rng"][0].as_py() // together, *joined(list(parts.values())))

    # ranges are short, and many: tasks by their number, not by their bytes
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def grouped(df: DataFrame, key: str, run: Callable[[pa.Table], pa.Table]) -> DataFrame:
        return settled(df.repartition(tasks, "kind", "chrom", key).groupBy("kind", "chrom", key).applyInArrow(run, _HELD))

    cut = rows.select("kind", "chrom", F.col("st").cast("long").alias("st"), F.col("en").cast("long").alias("en"), F.col("score").cast("double").alias("score")).withColumn("rng", F.shiftright("st", range_bits))
    level = grouped(cut, "rng", alone)
    found = level.filter("done")
    most = level.agg(F.max("rng")).first()[0] or 0
    while most:
        level = grouped(level.filter("not done").withColumn("_g", F.floor(F.col("rng") / together)), "_g", several)
        found, most = found.unionByName(level.filter("done")), most // together
    found = found.unionByName(level.filter("not done and st is not null"))
    # candidates are apart or one inside another: the largest of each island stands
    marked = islands(found.select("kind", "chrom", "st", "en", (F.col("hi") - F.col("lo")).alias("score")), ["kind", "chrom"], ["st", "en"], "st", "en")
    top = marked.groupBy("kind", "chrom", "island").agg(F.max_by(F.struct("st", "en", "score"), F.col("en") - F.col("st")).alias("x"))
    return top.select("kind", "chrom", "x.*")


def best_segment(scores: np.ndarray) -> float:
    """Score of the best single segment, 0 at least."""
    run = np.concatenate([[0.0], np.cumsum(scores)])
    return float((run - np.minimum.accumulate(run)).max())


def gumbel_fit(maxima: np.ndarray) -> tuple[float, float]:
    """Location and scale of a Gumbel distribution by maximum likelihood, the scale by bisection."""
    x = np.asarray(maxima, float)
    mean, spread = x.mean(), x.std()
    if not spread:
        return mean, 1e-9

    def gap(b: float) -> float:
        w = np.exp(-(x - x.min()) / b)
        return mean - (x * w).sum() / w.sum() - b

    lo, hi = spread * 1e-3, spread * 10
    while gap(hi) > 0:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gap(mid) > 0 else (lo, mid)
    return x.min() - hi * math.log(np.exp(-(x - x.min()) / hi).mean()), hi


def gumbel_cdf(x: float, mu: float, beta: float) -> float:
    return math.exp(-math.exp(-(x - mu) / beta))


def gumbel_ccdf(x: float, mu: float, beta: float) -> float:
    """Upper tail, exact where it is tiny."""
    return -math.expm1(-math.exp(-(x - mu) / beta))


def gumbel_quantile(p: float, mu: float, beta: float) -> float:
    return mu - beta * math.log(-math.log(p))


def scored(weighed: DataFrame, penalty: dict[str, float], missing: float = 0.1) -> DataFrame:
    """(kind, chrom, st, en, score): +length with the signal, weight * penalty * length without, a small penalty where flagged."""
    span = (F.col("en") - F.col("st")).cast("double")
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), F.when(F.col("flt"), -missing * p * span).when(F.col(f"w_{k}") == 1, span).when(F.col(f"w_{k}") == 0, -missing * p * span).otherwise(F.col(f"w_{k}") * p * span).alias("score")) for k, p in penalty.items()])
    return weighed.select("chrom", "st", "en", F.explode(cells).alias("x")).select("x.kind", "chrom", "st", "en", "x.score")


#: Scores that a task holds at a time.
CHUNK = 1 << 22
#: Scores whose running sums it holds at a time.
BLOCK = 1 << 14


def permuted_best(values: np.ndarray, counts: np.ndarray, rng: np.random.Generator, chunk: int = CHUNK) -> float:
    """Score of the best segment of one random order of ``values``, each as often as ``counts`` says.

    The order is drawn in chunks: how often each value falls into the next one
    is multivariate hypergeometric, and inside a chunk all orders are alike.
    """
    left, tail, best = counts.astype(np.int64), 0.0, 0.0
    codes = np.arange(len(values), dtype=np.min_scalar_type(len(values)))  # small ones are shuffled in the cache
    while n := int(left.sum()):
        take = rng.multivariate_hypergeometric(left, chunk, method="marginals") if chunk < n else left
        order = rng.permutation(np.repeat(codes, take))
        last = low = top = rise = 0.0
        for k in range(0, len(order), BLOCK):  # running sums in pieces that stay in the cache
            run = values[order[k : k + BLOCK]]
            run[0] += last
            run = np.cumsum(run)
            below = np.minimum.accumulate(run)
            rise = max(rise, float((run - np.minimum(below, low)).max()))
            low, top, last = min(low, float(below[-1])), max(top, float(run.max())), float(run[-1])
        best = max(best, rise, tail + top)
        tail = max(last - low, tail + last)
        left = left - take
    return best


def permuted_maxima(rows: DataFrame, permutations: int, seed: int) -> DataFrame:
    """(kind, top): the best segment's score in each permutation of all scores of a kind.

    Tasks receive how often each score occurs and seeds, never the scores
    themselves: these are a length times one of a few weights, and so few.
    Seeds are dealt over tasks, and the few rows of counts go to each.
    """
    times = rows.groupBy("kind", "score").agg(F.count("*").alias("n")).groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("score", "n"))).alias("x"))
    seeds = rows.sparkSession.range(0, permutations, 1, min(permutations, 64))
    runs = seeds.join(F.broadcast(times.select("kind", F.col("x.score").alias("values"), F.col("x.n").alias("counts"))), F.lit(True))

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            top = [permuted_best(np.asarray(v, float), np.asarray(c), np.random.default_rng([seed, int(k), KINDS.index(kind)])) for kind, v, c, k in zip(pdf["kind"], pdf["values"], pdf["counts"], pdf["id"], strict=True)]
            yield pd.DataFrame({"kind": pdf["kind"], "top": top})

    return runs.mapInPandas(drawn, "kind string, top double")


def call(segments: DataFrame, c: float = 4.0, ploidy: int = 2, p_value: float = 1e-4, permutations: int = 200, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(calls, fit): maximal segments beyond the Gumbel quantile of permuted scores, and the fitted parameters.

    Permutations run over the scores of all contigs; only their maxima return.
    """
    spark = segments.sparkSession
    weighed = classified(segments, ploidy)
    penalty = {r["kind"]: r["penalty"] for r in penalties(weighed, c).collect() if r["penalty"]}
    rows = scored(weighed, penalty)
    maxima: dict[str, list[float]] = {}
    for r in permuted_maxima(rows, permutations, seed).collect():  # permutations * kinds rows
        maxima.setdefault(r["kind"], []).append(r["top"])
    fit = {k: gumbel_fit(np.sort(v)) for k, v in maxima.items()}
    least = {k: math.floor(gumbel_quantile(1 - p_value, *v)) for k, v in fit.items()}

    bound = spark.createDataFrame([(k, float(least[k]), *map(float, fit[k])) for k in fit], "kind string, _least double, _mu double, _beta double")
    tail = -F.expm1(-F.exp(-(F.col("score") - F.col("_mu")) / F.col("_beta")))  # exact where it is tiny
    calls = segments_by_ranges(rows).join(F.broadcast(bound), "kind").filter("score >= _least").select("kind", "chrom", "st", "en", "score", tail.alias("p"))
    params = [(k, float(penalty[k]), float(m), float(b), float(least[k]), float(gumbel_quantile(1 - p_value, m, b))) for k, (m, b) in fit.items()]
    return calls, spark.createDataFrame(params, "kind string, penalty double, mu double, beta double, threshold double, quantile double")


def record_lines(segments: DataFrame, calls: DataFrame, fit: DataFrame, evidence: bool = False, ploidy: int = 2) -> DataFrame:
    """(part, kind, chrom, st, k, value): signal and null parameters of each kind, then its calls, each with its segments if asked for."""
    letter = F.when(F.col("kind") == "gain", "G").when(F.col("kind") == "loss1", "L").otherwise("A")
    tagged = lambda tag: F.concat(letter, F.lit(tag) if isinstance(tag, str) else tag)
    number = lambda c, places: F.format_string(f"%.{places}f", c)
    sums = penalties(classified(segments, ploidy)).select("kind", "signal", "other").join(fit, "kind")
    none, zero = F.lit("").alias("chrom"), F.lit(0).cast("long").alias("st")
    signal = sums.select(F.lit(0).alias("part"), "kind", none, zero, F.lit(0).alias("k"), F.concat_ws("\t", tagged("S"), "signal", "other", number("penalty", 3)).alias("value"))
    null = sums.select(F.lit(0).alias("part"), "kind", none, zero, F.lit(1).alias("k"), F.concat_ws("\t", tagged("P"), number("mu", 3), number("beta", 3), number("quantile", 3)).alias("value"))
    found = calls.select(F.lit(1).alias("part"), "kind", "chrom", "st", F.lit(0).alias("k"), F.concat_ws("\t", tagged(letter), "chrom", "st", "en", number("score", 2), F.format_string("%.3g", "p")).alias("value"))
    out = signal.unionByName(null).unionByName(found)
    if evidence:
        named = calls.select("kind", "chrom", F.col("st").alias("_b"), F.col("en").alias("_e"))
        inside = segments.join(named, "chrom").filter("st >= _b and en <= _e")
        out = out.unionByName(inside.select(F.lit(1).alias("part"), "kind", "chrom", "st", F.lit(1).alias("k"), F.concat_ws("\t", tagged("E"), "en", "d0", "d1", "d2").alias("value")))
    return out


def implicit_starts(ends: DataFrame) -> DataFrame:
    """Start of each depth segment as the end of the one before, 0 at first."""
    return ends.withColumn("st", F.lag("en", 1, 0).over(Window.partitionBy("chrom").orderBy("en")))
