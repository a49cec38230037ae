"""Data selection by importance resampling.

Two bags of hashed words and word pairs, one of target texts and one of all
texts, give each document the logarithm of its importance weight: the sum over
its n-grams of log target share less log raw share. Adding Gumbel noise and
taking the top k samples k documents without replacement in proportion to
their weights.

The sample's size is a budget: a number ``k`` or a ``rate``, a share of the documents
with a word. A filter that has to keep what the target is like can name a
``recall`` instead, the share of the target documents that the sample retains.

Counts cover all documents, in one Arrow pass without a shuffle of texts; k and
the threshold that belongs to it are exact, found by counting keys in intervals
that narrow down. Noise is a hash of the id, so a task that runs again draws
the same. ``divergence`` tells how far texts are from the target, before and after.

Defined cases: a null or blank text has weight null and is never selected; with
no target text all weights are 0 and the noise alone decides; repeated rows get
equal results, and rows without an id equal noise; documents with one key at the
threshold are all selected; an empty table gives an empty result; a document is
target if any of its label rows says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import checkpointed
from ._text import U64, mix, slices, utf8, word_hashes

BUCKETS = 10_000
#: Label ids up to this many are broadcast (some 50 bytes each once hashed); more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
GOOD = "quality = 1 and coalesce(toxic, 0) = 0"


def _features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of the words and neighbouring word pairs of all rows."""
    w, at = word_hashes(buf, off, lower=False)
    row = np.repeat(np.arange(len(off) - 1), np.diff(at))
    pair = mix(w[:-1] * U64(3) + w[1:])
    inside = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
    feats = np.concatenate([w, pair[inside]]) % U64(BUCKETS)
    return feats.astype(np.int64), np.concatenate([row, row[1:][inside]])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        buf, off = utf8(batch.column("text"))
        target = batch.column("target").fill_null(False).to_numpy(zero_copy_only=False)
        for a, b in slices(off, 2_000_000):
            f, r = _features(buf[off[a] : off[b]], off[a : b + 1] - off[a])
            total[0] += np.bincount(f, minlength=BUCKETS)
            total[1] += np.bincount(f[target[a:b][r]], minlength=BUCKETS)
    hit = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[0][hit]), pa.array(total[1][hit])], ["bucket", "raw", "target"])


def bucket_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """n-grams a bucket in all texts of (text, target), and in those that are target; ``BUCKETS`` rows come to the driver at most."""
    counts = rows.select("text", "target").mapInArrow(_counted, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, wanted = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.collect():
        raw[r["bucket"]], wanted[r["bucket"]] = r["raw"], r["target"]
    return raw, wanted


def _marked(df: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, target): whether a row's id is among ``ids``."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.join(ids.select("id", F.lit(True).alias("target")), "id", "left").select("text", "target")


def targets(labels: DataFrame, target: str | Column = GOOD, id_col: str = "doc_id") -> DataFrame:
    """Distinct (id) of the label rows that ``target`` holds for, for broadcast if they are few."""
    chosen = labels.filter(target).select(F.col(id_col).cast("long").alias("id")).filter("id is not null").distinct()
    return F.broadcast(chosen) if labels.count() <= BROADCAST_ROWS else chosen


def fit(df: DataFrame, labels: DataFrame, target: str | Column = GOOD, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, DataFrame]:
    """(log ratio of each bucket, ids of target rows); ``labels`` has ``id_col`` and what ``target`` reads."""
    chosen = targets(labels, target, id_col)
    raw, wanted = bucket_counts(_marked(df, chosen, id_col, text_col))
    if not wanted.sum():
        return np.zeros(BUCKETS), chosen
    raw, wanted = raw + 1, wanted + 1
    return np.log(wanted / wanted.sum()) - np.log(raw / raw.sum()), chosen


def divergence(df: DataFrame, ids: DataFrame, labels: DataFrame, target: str | Column = GOOD, id_col: str = "doc_id", text_col: str = "text") -> tuple[float, float]:
    """Kullback-Leibler divergence of the target's n-grams from those of all of ``df``, and from those of its rows in ``ids`` (id)."""
    raw, wanted = bucket_counts(_marked(df, targets(labels, target, id_col), id_col, text_col))
    _, sample = bucket_counts(_marked(df, ids, id_col, text_col))
    share = lambda c: (c + 1) / (c + 1).sum()
    return tuple(float((share(wanted) * np.log(share(wanted) / share(c))).sum()) for c in (raw, sample))


def weigh(df: DataFrame, ratio: np.ndarray, text_col: str = "text", out: str = "log_weight") -> DataFrame:
    """All columns of ``df``, then the log importance weight (a column of this name is replaced)."""
    df = df.drop(out)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = utf8(batch.column(names.index(text_col)))
            w, some = np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            for a, b in slices(off, 2_000_000):
                f, r = _features(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                w[a:b] = np.bincount(r, weights=ratio[f], minlength=b - a)
                some[a:b] = np.bincount(r, minlength=b - a) > 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(w, mask=~some)], [*names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


def gumbel_key(weight: str | Column, id_col: str, seed: int) -> Column:
    """Log weight plus Gumbel noise that is a function of the id and the seed."""
    u = (F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("long"), F.lit(seed)), 11).cast("double") + 0.5) / float(2**53)
    return (F.col(weight) if isinstance(weight, str) else weight) - F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The exact k-th largest value (1 for the largest); null values don't count. None if there are fewer."""
    rows = df.select(F.col(column).alias("x")).filter("x is not null")
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).first()
    lo, hi, n, above = ends["lo"], ends["hi"], ends["n"], 0
    if not 1 <= k <= n:
        return None
    while n > 4096 and lo < hi:
        part = F.least(F.floor((F.col("x") - lo) / (hi - lo) * 1024), F.lit(1023))
        parts = rows.filter(F.col("x").between(lo, hi)).groupBy(part.alias("p")).agg(F.count("*").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        for r in sorted(parts, key=lambda r: -r["lo"]):
            if above + r["c"] >= k:
                lo, hi, n = r["lo"], r["hi"], r["c"]
                break
            above += r["c"]
    if lo == hi:
        return lo
    return sorted((r["x"] for r in rows.filter(F.col("x").between(lo, hi)).collect()), reverse=True)[k - above - 1]


def threshold(scored: DataFrame, key: str, chosen: DataFrame, id_col: str, recall: float) -> float:
    """The key of the last document of the smallest sample that holds ``recall`` of the target documents."""
    wanted = scored.join(chosen.select(F.col("id").alias(id_col)), id_col, "left_semi")
    n = wanted.filter(F.col(key).isNotNull()).count()
    if not n:
        return float("-inf")
    return kth_largest(wanted, key, min(n, int(np.ceil(recall * n))))


def resample(
    df: DataFrame,
    labels: DataFrame,
    k: int | None = None,
    rate: float | None = None,
    recall: float | None = None,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, log_weight, gumbel_key, kept) per row: Gumbel top-k by importance weight.

    One of ``k``, ``rate`` and ``recall`` sets the sample's size; ``recall`` is
    that of the smallest sample that retains this share of the target documents.
    """
    if sum(x is not None for x in (k, rate, recall)) != 1:
        raise ValueError("give one of k, rate and recall")
    ratio, chosen = fit(df, labels, id_col=id_col, text_col=text_col)
    rows = weigh(df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")), ratio).select(id_col, "log_weight")
    scored = checkpointed(rows.withColumn("gumbel_key", gumbel_key("log_weight", id_col, seed)))
    if recall is not None:
        least = threshold(scored, "gumbel_key", chosen, id_col, recall)
    else:
        n = scored.filter("gumbel_key is not null").count()
        k = int(np.ceil(rate * n)) if k is None else min(k, n)
        least = kth_largest(scored, "gumbel_key", k) if k else float("inf")
    return scored.withColumn("kept", F.coalesce(F.col("gumbel_key") >= F.lit(least), F.lit(False)))
