"""Sum-of-squares packing of tokenised documents into sequences of fixed length.

Documents are tokenised once, in an Arrow pass that also cuts those longer than
a sequence: whole sequences from the end, so that the first piece is the one
that may be shorter. Pieces are dealt by a hash of their document into groups
of about ``GROUP`` documents. Within a group pieces are placed in the order of
falling length; each goes where the sum of the squared counts of open bins per
residual gap becomes smallest, a new bin included. A group's few bins that stay
open are packed once more across groups, bins as items.

A group holds lengths and ids only, never texts, so its memory is bounded, and
all orders are total: a task that is run again gives the same bins.

Defined cases: null and empty texts are documents of the separator alone;
repeated rows are packed once each; ids may repeat; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed

GROUP = 50_000
# Fixed value: the pre-tokeniser of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_RUN = r"\S{4000}|\s{4000}"
PROBE = "It's  a\tprobe:\n\n \x1c\u3000x1.5\u00a0\u00e9\u4e00\U0001f600 'll  "


class Ids:
    """The ids that a byte-level BPE file gives.

    Its vocabulary is in merge order, so the ids are the ranks that a rank-based
    encoder needs; that one is several times as fast. The file's own tokenizer
    takes the texts that hold a special token or a very long run, and all texts
    if the two differ on the probe.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([*map(re.escape, special), LONG_RUN]))
        # byte-level vocabularies write the bytes that don't print as code points from 256 on
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        code = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in printed)}
        ranks = {bytes(code[c] for c in piece): i for piece, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if piece not in special}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        if self._slow(PROBE) != self._quick(PROBE):
            self.odd = re.compile("")

    def _slow(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _quick(self, text: str) -> bytes:
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """All ids of a text as little-endian uint32."""
        text = text or ""
        return self._slow(text) if self.odd.search(text) else self._quick(text)


@lru_cache(maxsize=2)
def ids_of(file: str) -> Ids:
    """One encoder for all tasks that a Python worker runs."""
    return Ids(file)


PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def pieces(df: DataFrame, tokenizer_file: str, size: int, separator: int) -> DataFrame:
    """``PIECES`` of each row of (id, text): its ids and the separator, cut into at most ``size`` each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, end = ids_of(tokenizer_file), np.array([separator], "<u4").tobytes()
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                rows = []
                for key, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = table.encode(text) + end
                    n = len(ids) // 4
                    cuts = [0, *range(n % size or size, n + 1, size)]
                    for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        rows.append((key, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["id", "piece", "start", "length", "ids_crc32"])

    return df.mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place items in the order given: (bin, offset) of each, and each bin's fill.

    ``open_[g]`` counts the open bins with gap ``g``. Moving a bin from gap
    ``g`` to ``g - s`` changes the sum of squares by ``2 (open_[g - s] - open_[g] + 1)``;
    a bin that fills up, or a new one, only leaves or enters the sum. Of equal
    changes the smallest gap wins, and an open bin wins over a new one.
    """
    open_ = np.zeros(size + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    for i, s in enumerate(lengths.tolist()):
        old, new = open_[s:size], open_[: size - s]
        change = 2 * (new - old + 1)
        gap = 0
        if size > s:
            change[0] = 1 - 2 * old[0]
            change[old == 0] = np.iinfo(np.int64).max
            k = int(change.argmin())
            if old[k] and change[k] <= 2 * open_[size - s] + 1:
                gap = s + k
        if gap:
            b = stacks[gap].pop()
            open_[gap] -= 1
        else:
            b, gap = len(fill), size
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += s
        if gap > s:
            stacks[gap - s].append(b)
            open_[gap - s] += 1
    return bins, offsets, np.array(fill, np.int64)


def _placed(size: int, keys: list[str], names: list[str]):
    """Pack one group; ``keys`` after falling length make its order total. Adds bin, offset and the bin's fill as ``names``."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), *((k, "ascending") for k in keys)])
        bins, offsets, fill = sum_of_squares(group["length"].to_numpy(), size)
        for name, values in zip(names, (bins, offsets, fill[bins]), strict=True):
            group = group.append_column(name, pa.array(values))
        return group

    return run


def pack(
    df: DataFrame, tokenizer_file: str, size: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) per piece."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    cut = checkpointed(pieces(rows, tokenizer_file, size, separator))
    groups = max(1, -(-cut.count() // group))
    keyed = cut.withColumn("g", F.pmod(F.xxhash64("id", "piece"), F.lit(groups)))
    place = _placed(size, ["id", "piece", "start", "ids_crc32"], ["bin", "offset", "fill"])
    first = checkpointed(keyed.groupBy("g").applyInArrow(place, f"{PIECES}, g long, bin long, offset long, fill long"))
    # bins that stayed open, one row each, are packed once more as items
    spare = first.filter(F.col("fill") < size).groupBy("g", "bin").agg(F.max("fill").alias("length"))
    again = max(1, -(-spare.count() // group))
    spare = spare.withColumn("h", F.pmod(F.xxhash64("g", "bin"), F.lit(again)))
    place = _placed(size, ["g", "bin"], ["bin2", "offset2", "fill2"])
    spare = spare.groupBy("h").applyInArrow(place, "g long, bin long, length long, h long, bin2 long, offset2 long, fill2 long")
    spare = spare.select("g", "bin", "h", "bin2", "offset2")
    full = first.filter(F.col("fill") == size).select("*", (F.col("bin") * groups + F.col("g")).alias("sequence_id"))
    rest = first.filter(F.col("fill") < size).join(spare, ["g", "bin"])
    rest = rest.select(*first.columns[:-2], (F.col("offset") + F.col("offset2")).alias("offset"), "fill", (-1 - (F.col("bin2") * again + F.col("h"))).alias("sequence_id"))
    out = full.unionByName(rest)
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
