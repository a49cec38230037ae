"""Pileup by tiles: allele counts of reads without a row a base.

Reads are dealt to the tiles of the reference that they meet, one that crosses a
border to both; a task lays a tile's reads out as flat arrays of bases and hands
on a row for each (site, sample, allele). What is shuffled is reads, then
counts. A tile with more than ``TILE_BASES`` aligned bases is dealt over several
tasks by fragment, so a deep one is no hot key and the reads of a fragment still
vote together; their counts are summed at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.reads import REVERSE, has, reference_span

#: Bits of a tile's width, and the aligned bases of a tile that one task lays out.
TILE_BITS, TILE_BASES = 12, 4_000_000
#: Tiles of more than one part that are broadcast; more are joined by shuffle.
BROADCAST_TILES = 100_000
OPS = ["M", "I", "D", "N", "S", "H", "P", "=", "X"]

PARTIAL = "tid long, pos long, sample string, base string, ins string, del_len int, n long, fwd long, rev long, raw long, sum_mq2 long, sum_alen long, lost long"


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(offsets, values) of a list or text column; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        return off, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(size)]), column.flatten()


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, end to end."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


def _within(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum before each value inside its list."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[:-1] - np.repeat(total[off[:-1]], np.diff(off))


#: Keys up to which combinations are numbered by a table and not by sorting.
TABLE = 1 << 22


def _dense(*columns: np.ndarray) -> np.ndarray:
    """One number for each distinct combination, in their order."""
    key, top = np.zeros(len(columns[0]), np.int64), 1
    for c in columns:
        if not len(c):
            break
        c = c - c.min()
        wide = int(c.max()) + 1
        if wide > TABLE:
            _, c = np.unique(c, return_inverse=True)
            wide = int(c.max()) + 1
        if top * wide > TABLE:
            key, top = _numbered(key, top)
        key, top = key * wide + c, top * wide
    return _numbered(key, top)[0]


def _numbered(key: np.ndarray, top: int) -> tuple[np.ndarray, int]:
    """(dense number of each key, how many there are); keys below ``top``."""
    if top > TABLE:
        kinds, key = np.unique(key, return_inverse=True)
        return key, len(kinds)
    number = np.zeros(top, np.int64)
    number[key] = 1
    number = np.cumsum(number) - 1
    return number[key], int(number[-1]) + 1 if len(number) else 0


def _first(dense: np.ndarray) -> np.ndarray:
    """Where each of the numbers 0, 1, ... comes first."""
    first = np.zeros(int(dense.max(initial=-1)) + 1, np.int64)
    first[dense[::-1]] = np.arange(len(dense))[::-1]
    return first


def _layout(reads: pa.Table, trim: int, bits: int) -> dict[str, np.ndarray]:
    """The bases of a tile's reads that count, end to end, with their read, position, allele and distance to the read's end."""
    ops_off, ops = _flat(reads["ops"])
    op = pc.index_in(ops.field("op"), pa.array(OPS)).to_numpy(zero_copy_only=False) if len(ops) else np.zeros(0, np.int64)
    size = ops.field("len").to_numpy(zero_copy_only=False).astype(np.int64) if len(ops) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(reads.num_rows), np.diff(ops_off))
    on_query, on_ref = np.isin(op, [0, 1, 4, 7, 8]), np.isin(op, [0, 2, 3, 7, 8])
    q0, r0 = _within(size * on_query, ops_off), _within(size * on_ref, ops_off)
    clip = size * (op == 4)
    lead, tail = (np.bincount(owner, weights=clip * x, minlength=reads.num_rows).astype(np.int64) for x in (q0 == 0, q0 > 0))
    base_off, base = _flat(reads["bases"])
    qual_off, qual = _flat(reads["quals"])
    qual = qual.to_numpy(zero_copy_only=False).astype(np.int64) if len(qual) else np.zeros(0, np.int64)
    length, quals = np.diff(base_off), np.diff(qual_off)

    block = np.flatnonzero(np.isin(op, [0, 7, 8]))
    which = np.repeat(block, size[block])
    read, step = owner[which], _runs(np.zeros(len(block), np.int64), size[block])
    q, pos = q0[which] + step, reads["pos"].to_numpy().astype(np.int64)[read] + r0[which] + step
    tile = reads["tile"][0].as_py()
    ok = (pos >> bits == tile) & (q < length[read]) & (q < quals[read]) & (np.minimum(q, length[read] - q) >= trim)
    which, read, step, q, pos = which[ok], read[ok], step[ok], q[ok], pos[ok]
    value = qual[qual_off[read] + q]
    ok = value >= reads["least_q"].to_numpy(zero_copy_only=False)[read]
    which, read, step, q, pos, value = which[ok], read[ok], step[ok], q[ok], pos[ok], value[ok]
    letter = base[base_off[read] + q]
    letter = np.where((letter >= 97) & (letter <= 122), letter - 32, letter)

    # an indel behind the last base of a block belongs to that base
    after = np.where(which + 1 < ops_off[read + 1], which + 1, 0)
    last = (step == size[which] - 1) & (which + 1 < ops_off[read + 1])
    gap = np.where(last & (op[after] == 2), size[after], 0)
    text = np.full(len(which), 0, np.int64)
    names = {"": 0}
    for k in np.flatnonzero(last & (op[after] == 1)).tolist():
        a = base_off[read[k]] + q0[after[k]]
        ins = base[a : min(a + size[after[k]], base_off[read[k] + 1])].tobytes().decode()
        text[k] = names.setdefault(ins, len(names))
    end = np.maximum(0, np.minimum(q - lead[read], length[read] - tail[read] - 1 - q))
    return {"read": read, "pos": pos, "letter": letter.astype(np.int64), "ins": text, "gap": gap, "q": value, "end": end, "names": list(names)}


def _counted(trim: int, weight: str | None, bits: int):
    def run(reads: pa.Table) -> pa.Table:
        x = _layout(reads, trim, bits)
        read = x["read"]
        sample = reads["sample"].combine_chunks().dictionary_encode()
        of, known = sample.indices.to_numpy(zero_copy_only=False)[read], sample.dictionary.to_pylist()
        frag = reads["frag"].combine_chunks()
        voter, frag = frag.is_valid().to_numpy(zero_copy_only=False)[read], frag.fill_null(0).to_numpy()[read]
        site = _dense(x["pos"], of)
        allele = _dense(site, x["letter"], x["ins"], x["gap"])
        lost = np.zeros(len(read), bool)
        if voter.any():
            v = np.flatnonzero(voter)
            side = _dense(site[v], frag[v])
            one, first, back, n = np.unique(_dense(side, allele[v]), return_index=True, return_inverse=True, return_counts=True)
            top, ties = np.zeros(side.max() + 1, np.int64), np.zeros(side.max() + 1, np.int64)
            np.maximum.at(top, side[first], n)
            np.add.at(ties, side[first], n == top[side[first]])
            lost[v] = ((ties[side[first]] == 1) & (n < top[side[first]]))[back]
        first = _first(allele)
        kinds = len(first)
        rev = reads["rev"].to_numpy(zero_copy_only=False)[read]
        mq = np.minimum(reads["mapq"].to_numpy(zero_copy_only=False)[read].astype(np.int64), 60) ** 2
        one = x["q"] if weight else np.ones(len(read), np.int64)
        total = lambda w: np.bincount(allele, weights=w * ~lost, minlength=kinds).astype(np.int64)
        return pa.table(
            {
                "tid": pa.array(np.full(kinds, reads["tid"][0].as_py()), pa.int64()),
                "pos": x["pos"][first],
                "sample": pa.array([known[k] for k in of[first]], pa.string()),
                "base": pa.array([chr(c) for c in x["letter"][first]], pa.string()),
                "ins": pa.array([x["names"][k] for k in x["ins"][first]], pa.string()),
                "del_len": pa.array(x["gap"][first], pa.int32()),
                "n": total(one),
                "fwd": total(one * ~rev),
                "rev": total(one * rev),
                "raw": total(np.ones(len(read), np.int64)),
                "sum_mq2": total(mq),
                "sum_alen": total(x["end"]),
                "lost": np.bincount(allele, weights=lost, minlength=kinds).astype(np.int64),
            }
        )

    return run


def counted(reads: DataFrame, min_q: int | Column = 0, trim: int = 0, frag: str | Column | None = None, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(counts, dropped) of alignments (seq, sample, flag, tid, pos, mapq, ops, bases, quals).

    ``counts`` are by (tid, pos, sample, base, ins, del_len): n, fwd, rev, raw,
    sum_mq2 and sum_alen, of bases with a quality of at least ``min_q`` that are
    not within ``trim`` of the read's end. Reads with a ``frag`` vote: at each
    site those that differ from the one allele ahead in their fragment do not
    count, and ``dropped`` (tid, pos, dropped) tells how many. A column
    ``_strand`` stands for the strand of the flag. Depths are reads, or the sums
    of base qualities with ``weight="q"``.
    """
    rev = F.col("_strand") if "_strand" in reads.columns else has("flag", REVERSE)
    frag = F.lit(None) if frag is None else F.col(frag) if isinstance(frag, str) else frag
    span = F.greatest(F.lit(1), reference_span("ops"))
    last = F.shiftright(F.col("pos") + span - 1, TILE_BITS)
    rows = reads.select(
        F.col("tid").cast("long").alias("tid"), F.col("sample").cast("string").alias("sample"), F.col("pos").cast("long").alias("pos"), F.col("mapq").cast("int").alias("mapq"), rev.alias("rev"), "ops", "bases", "quals", frag.cast("long").alias("frag"),
        (F.lit(min_q) if isinstance(min_q, int) else min_q).cast("int").alias("least_q"), span.cast("long").alias("span"),
        F.xxhash64(F.col("sample").cast("string"), F.coalesce(frag.cast("long"), F.xxhash64("seq"))).alias("deal"), F.explode(F.sequence(F.shiftright("pos", TILE_BITS).cast("long"), last.cast("long"))).alias("tile"),
    )
    deep = rows.groupBy("tid", "tile").agg(F.sum("span").alias("b")).filter(F.col("b") > TILE_BASES).select("tid", "tile", F.ceil(F.col("b") / TILE_BASES).cast("long").alias("parts"))
    from .stages import settled

    deep = settled(deep)
    deep = F.broadcast(deep) if deep.count() <= BROADCAST_TILES else deep
    rows = rows.join(deep, ["tid", "tile"], "left").withColumn("part", F.pmod("deal", F.coalesce("parts", F.lit(1)))).drop("parts", "deal", "span")
    partial = rows.groupBy("tid", "tile", "part").applyInArrow(_counted(trim, weight, TILE_BITS), PARTIAL)
    sums = ["n", "fwd", "rev", "raw", "sum_mq2", "sum_alen", "lost"]
    found = settled(partial.groupBy("tid", "pos", "sample", "base", "ins", "del_len").agg(*[F.sum(c).alias(c) for c in sums]))
    dropped = found.groupBy("tid", "pos").agg(F.sum("lost").alias("dropped")).filter("dropped > 0")
    return found.filter("raw > 0").drop("lost"), dropped
