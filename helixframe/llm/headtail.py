"""Importance resampling towards a target, with a head-tail vocabulary.

Features are the runs of one and two consecutive words of a text; a feature's
bucket is the CRC-32 of its bytes modulo ``BUCKETS``. The bucket totals of all
raw and of all target texts give each bucket a gain, a document's weight is the
mean gain of its features, and Gumbel noise from its id makes the highest scores
a sample.

1. One pass finds the head: the most frequent words and word pairs of all texts,
   counted in each task's own table and then summed. Their number is bounded
   (``WORDS``, ``PAIRS``), so that the CRC states of the words and the buckets of
   the pairs are broadcast.
2. A second pass sums the bucket totals. A word of the head takes its state from
   the table, and a pair of the head its bucket; any other feature, the tail, is
   run through the CRC itself, a pair from the state that its first word left.
3. A third pass looks up the gains.

A word is found in the head by its bytes, not by a hash of them, so which
features are in the head changes no result, only the time. Texts are never
shuffled; a task hands on at most ``BUCKETS`` totals. Ranks come from one range
sort of (score, id) and the row counts of its partitions.

Defined cases: a null or empty text, or one without a word, has no features and
weight 0; words of any length count; a null id takes noise as an empty id would,
and comes last among equal scores; repeated rows have equal scores, and are
drawn one by one; without a target text all target totals are 0; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, shuffles_deleted
from ._text import U64, mix, slices, utf8
from .quality import kth_largest

BUCKETS = 10_000
#: Words and pairs of the head; a word of it has at most ``REACH`` bytes.
WORDS, PAIRS, REACH = 16_384, 32_768, 16
#: Features that a task's table of counts holds before the rare half of it goes.
TABLE = 8 * (WORDS + PAIRS)
#: Bytes of text handled at once.
SLICE = 4 << 20
#: A word above this size is run through the CRC by itself, not in step with others.
LONG = 64
_FULL = np.uint32(0xFFFFFFFF)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, x >> 1 ^ np.uint32(0xEDB88320), x >> 1)
    return x


_CRC = _crc_table()


def crc_from(state: np.ndarray, buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of each text whose CRC so far is ``state``, after ``size`` more bytes from ``at`` on."""
    order = np.argsort(-size, kind="stable")
    at, size, out = at[order], size[order], state[order]
    long = int(np.searchsorted(-size, -LONG, "left"))
    for k in range(long):
        out[k] = zlib.crc32(buf[at[k] : at[k] + size[k]], int(out[k]))
    reg = out[long:] ^ _FULL
    live = np.searchsorted(-size[long:], -np.arange(LONG), "left")
    for k, n in enumerate(live.tolist()):
        if not n:
            break
        r = reg[:n]
        reg[:n] = _CRC[(r ^ buf[at[long : long + n] + k]) & 255] ^ r >> 8
    out[long:] = reg ^ _FULL
    back = np.empty_like(out)
    back[order] = out
    return back


@dataclass
class Words:
    """The words of some rows: lower-cased bytes, each word's place, size and row, and its bytes as two numbers (0, 0 if too long)."""

    buf: np.ndarray
    at: np.ndarray
    size: np.ndarray
    row: np.ndarray
    head: np.ndarray
    rest: np.ndarray

    def pairs(self) -> np.ndarray:
        """The places of words that have another one behind them in their row."""
        return np.flatnonzero(self.row[1:] == self.row[:-1])

    def bytes_at(self, k: int) -> bytes:
        return self.buf[self.at[k] : self.at[k] + self.size[k]].tobytes()


def words(raw: np.ndarray, off: np.ndarray) -> Words:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of rows in UTF-8, A-Z lower-cased."""
    n = len(raw)
    buf = np.zeros(n + 2 * REACH, np.uint8)  # room to read past the last word
    np.take(_LOWER, raw, out=buf[:n])
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _WORD[buf[:n]]
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = inside[cut + 1]
    last[cut - 1] = inside[cut]
    at, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = end - at
    eight = np.ndarray((n + REACH,), "<u8", buf.data, strides=(1,))  # the eight bytes from every place on
    keep = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    fits = size <= REACH
    head = np.where(fits, eight[at] & keep[np.minimum(size, 8)], U64(0))
    rest = np.where(fits, eight[at + 8] & keep[np.clip(size - 8, 0, 8)], U64(0))
    return Words(buf, at, size, np.searchsorted(off, at, "right") - 1, head, rest)


def _mixed(head: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return mix(head + mix(rest + U64(0x51ED270B)))


def _numbers(word: bytes) -> tuple[int, int]:
    return int.from_bytes(word[:8], "little"), int.from_bytes(word[8:], "little")


class Head:
    """CRC states of frequent words and buckets of frequent pairs of them, in sorted arrays."""

    def __init__(self, frequent: list[bytes], pairs: list[tuple[bytes, bytes]]):
        packed = np.array([_numbers(w) for w in frequent], np.uint64).reshape(-1, 2)
        key, first = np.unique(_mixed(packed[:, 0], packed[:, 1]), return_index=True)  # of two words with one key, one stays in the tail
        self.key, self.head, self.rest = key, packed[first, 0], packed[first, 1]
        self.state = np.array([zlib.crc32(frequent[k]) for k in first], np.uint32)
        number = {frequent[k]: n for n, k in enumerate(first.tolist())}
        known = {number[a] << 32 | number[b]: zlib.crc32(a + b" " + b) % BUCKETS for a, b in pairs if a in number and b in number}
        self.pair = np.array(sorted(known), np.int64)
        self.bucket = np.array([known[p] for p in self.pair.tolist()], np.int64)

    def number(self, w: Words) -> np.ndarray:
        """Each word's number in the head, or -1."""
        if not len(self.key):
            return np.full(len(w.at), -1)
        k = np.minimum(np.searchsorted(self.key, _mixed(w.head, w.rest)), len(self.key) - 1)
        return np.where((self.head[k] == w.head) & (self.rest[k] == w.rest) & (w.head != 0), k, -1)

    def buckets(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, row) of all features of some rows."""
        number = self.number(w)
        state = np.zeros(len(w.at), np.uint32)
        known = number >= 0
        state[known] = self.state[number[known]]
        tail = np.flatnonzero(~known)
        state[tail] = crc_from(state[tail], w.buf, w.at[tail], w.size[tail])
        first = w.pairs()
        two = np.full(len(first), -1, np.int64)
        if len(self.pair):
            both = np.flatnonzero(known[first] & known[first + 1])
            p = number[first[both]] << 32 | number[first[both] + 1]
            k = np.minimum(np.searchsorted(self.pair, p), len(self.pair) - 1)
            hit = self.pair[k] == p
            two[both[hit]] = self.bucket[k[hit]]
        tail = np.flatnonzero(two < 0)
        a = first[tail]
        spaced = state[a] ^ _FULL
        spaced = (_CRC[(spaced ^ np.uint32(32)) & 255] ^ spaced >> 8) ^ _FULL
        two[tail] = crc_from(spaced, w.buf, w.at[a + 1], w.size[a + 1]) % BUCKETS
        return np.concatenate([state.astype(np.int64) % BUCKETS, two]), np.concatenate([w.row, w.row[first]])


class _Counts:
    """A task's counts of features; beyond ``TABLE`` of them those with few counts go."""

    def __init__(self, room: int):
        self.room = room
        self.key, self.n, self.text = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)

    def add(self, key: np.ndarray, text) -> None:
        """Count ``key``; ``text`` gives the feature at a place. What occurs once in a slice is no candidate."""
        found, first, n = np.unique(key, return_index=True, return_counts=True)
        some = n > 1
        texts = np.empty(int(some.sum()), object)
        texts[:] = [text(k) for k in first[some].tolist()]
        both = np.concatenate([self.key, found[some]])
        self.key, at, back = np.unique(both, return_index=True, return_inverse=True)
        self.n = np.bincount(back, weights=np.concatenate([self.n, n[some]]), minlength=len(at)).astype(np.int64)
        self.text = np.concatenate([self.text, texts])[at]
        if len(self.key) > 4 * self.room:
            self.cut(2 * self.room)

    def cut(self, room: int) -> None:
        if len(self.key) > room:
            top = np.sort(np.argpartition(-self.n, room)[:room])
            self.key, self.n, self.text = self.key[top], self.n[top], self.text[top]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one, two = _Counts(WORDS), _Counts(PAIRS)
    for batch in batches:
        raw, off = utf8(batch.column(0))
        for a, b in slices(off, SLICE):
            w = words(raw[off[a] : off[b]], off[a : b + 1] - off[a])
            short = np.flatnonzero(w.head != 0)
            key = _mixed(w.head, w.rest)
            one.add(key[short], lambda k, w=w, at=short: w.bytes_at(at[k]))
            first = w.pairs()
            first = first[(w.head[first] != 0) & (w.head[first + 1] != 0)]
            two.add(mix(key[first] * U64(3) + key[first + 1]), lambda k, w=w, at=first: w.bytes_at(at[k]) + b" " + w.bytes_at(at[k] + 1))
    for counts, room in ((one, WORDS), (two, PAIRS)):
        counts.cut(room)
        pair = pa.array(np.full(len(counts.n), counts is two))
        yield pa.RecordBatch.from_arrays([pair, pa.array(counts.text.tolist(), pa.binary()), pa.array(counts.n)], ["pair", "feature", "n"])


def find_head(texts: DataFrame) -> Head:
    """The head of a table of one text column; at most ``WORDS + PAIRS`` features come to the driver."""
    counted = texts.mapInArrow(_candidates, "pair boolean, feature binary, n long").groupBy("pair", "feature").agg(F.sum("n").alias("n"))
    counted = checkpointed(counted)

    def most(pair: bool, room: int) -> list[bytes]:
        """Features that occur more often than the one after the last that fits; those that tie with it are left to the tail."""
        rows = counted.filter(F.col("pair") == F.lit(pair))
        least = kth_largest(rows, "n", room + 1)
        return [bytes(r["feature"]) for r in (rows if least is None else rows.filter(F.col("n") > least)).collect()]

    return Head(most(False, WORDS), [tuple(p.split(b" ")) for p in most(True, PAIRS)])


def bucket_totals(texts: DataFrame, head) -> np.ndarray:
    """How many features of all texts each bucket has; ``head`` is a broadcast ``Head``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            raw, off = utf8(batch.column(0))
            for a, b in slices(off, SLICE):
                bucket, _ = head.value.buckets(words(raw[off[a] : off[b]], off[a : b + 1] - off[a]))
                total += np.bincount(bucket, minlength=BUCKETS)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of target share over raw share, floored, of each bucket."""
    s, t = float(raw.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log(float(b + 1) * s / (float(a + 1) * t))) for a, b in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(rows: DataFrame, head, gain) -> DataFrame:
    """(id, n_words, n_features, weight) of (id, text); ``head`` and ``gain`` are broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch.column(1))
            out = np.zeros((3, batch.num_rows), np.int64)
            for a, b in slices(off, SLICE):
                w = words(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                bucket, row = head.value.buckets(w)
                n = np.bincount(row, minlength=b - a)
                total = np.bincount(row, weights=gain.value[bucket], minlength=b - a).astype(np.int64)
                out[:, a:b] = np.bincount(w.row, minlength=b - a), n, np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], ["id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "id long, n_words long, n_features long, weight long")


def ranked(scored: DataFrame, chosen: str, *order) -> DataFrame:
    """All rows with ``place``, from 1 in ``order`` among those that ``chosen`` holds for, which come first.

    Equal rows are dealt over tasks by their number in ``scored``, which must be a checkpoint.
    """
    keys = [F.expr(chosen).desc(), *order, F.xxhash64(F.monotonically_increasing_id())]
    spread = scored.select("*", keys[-1].alias("_deal")).repartitionByRange(*keys[:-1], "_deal").sortWithinPartitions(*keys[:-1], "_deal")
    number = F.monotonically_increasing_id()
    spread = checkpointed(spread.drop("_deal").withColumn("_part", F.shiftright(number, 33)).withColumn("_place", number.bitwiseAND((1 << 33) - 1)))
    before, starts = 0, []
    for r in spread.groupBy("_part").count().orderBy("_part").collect():  # a row a partition
        starts.append((r["_part"], before))
        before += r["count"]
    starts = scored.sparkSession.createDataFrame(starts, "_part long, _before long")
    return spread.join(F.broadcast(starts), "_part").withColumn("place", F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


def resample(
    df: DataFrame,
    target: DataFrame,
    rate: tuple[int, int] = (25, 100),
    least_words: int = 20,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row; ``rank`` is null for those not drawn.

    ``rate`` is the share drawn of the rows with ``least_words`` words or more, as
    a fraction; the number drawn is rounded down.
    """
    spark = df.sparkSession
    texts, wanted = df.select(F.col(text_col).alias("text")), target.select(F.col(target_col).alias("text"))
    with shuffles_deleted(spark):
        head = spark.sparkContext.broadcast(find_head(texts))
        gain = spark.sparkContext.broadcast(gains(bucket_totals(texts, head), bucket_totals(wanted, head)).astype(np.float64))
        weighed = weigh(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), head, gain)
        noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
        score = F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
        scored = checkpointed(weighed.withColumn("score", score))
        drawn = rate[0] * scored.filter(F.col("n_words") >= least_words).count() // rate[1]
        out = ranked(scored, f"n_words >= {least_words}", F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features"))
    rank = F.when((F.col("n_words") >= least_words) & (F.col("place") <= drawn), F.col("place"))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.alias("rank"))
