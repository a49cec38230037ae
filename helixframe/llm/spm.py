"""SentencePiece encoding and decoding by a table of distinct chunks.

In a model without pieces that cross white-space markers, a text's ids are the
ids of its marked words end to end, so a distinct word needs to be segmented
once and ids are joined back by position:

1. one pass counts the distinct words of all texts, with map-side combining;
2. the most frequent ones, up to ``SHARED`` words and ``SHARED_BYTES`` bytes, are
   segmented once each, in parallel, and their table is broadcast;
3. a second pass looks up each word of a text in order and puts the ids end to
   end. A word that is too rare for the shared table is segmented where it
   stands and kept in the worker's own table, which is emptied at ``TABLE`` words.

Texts are never shuffled; a shuffled join by position would move several times
their bytes. With ``c`` the least count in the shared table, a word that occurs
``c`` times or more is segmented once in all, and a rarer one less than ``c`` times.

Defined cases: null and empty texts have no ids and decode to an empty text;
runs of spaces, control characters, bytes outside the vocabulary and texts of
any length give what the library gives; repeated rows give repeated results;
an empty table an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed

MARK = "▁"
TABLE = 500_000
SHARED, SHARED_BYTES = 300_000, 16 << 20
#: Distinct words that a counting task holds at once.
COUNTED = 300_000
LONG_WORD = 64
_CHUNK = re.compile(" +[^ ]*")


class Codec(dict):
    """Marked word (less its first marker) -> ids as little-endian int32 bytes."""

    def __init__(self, model_file: str):
        super().__init__()
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.shared: dict[str, bytes] = {}
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece of this model crosses a white-space marker")
        if self.sp.normalize(f"a {MARK}Ａ́  b") != f"{MARK}a{MARK}{MARK}Ａ́{MARK}{MARK}b":
            raise ValueError("this model changes texts before it segments them")
        self.marker = np.array([self.sp.piece_to_id(MARK)], "<i4").tobytes()
        self.surface = [p.replace(MARK, " ") for p in pieces]
        self.plain = np.ones(len(pieces), bool)
        for i, p in enumerate(pieces):
            if self.sp.is_byte(i) and (code := int(p[3:5], 16)) < 128:
                self.surface[i] = chr(code)
            elif self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i):
                self.plain[i] = False

    def __missing__(self, word: str) -> bytes:
        ids = self.shared.get(word) or (np.array(self.sp.encode(word), "<i4").tobytes() if word else self.marker)
        if len(word) <= LONG_WORD:
            self[word] = ids
        return ids

    @staticmethod
    def words(text: str | None) -> list[str]:
        """The marked words of a text, each less its first marker."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " ":
            return [m[1:] for m in _CHUNK.findall(f" {text}")]
        return text.split(" ")

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """All ids of each text; words that the table lacks are segmented in one call."""
        if len(self) > TABLE:
            self.clear()
        split = [self.words(t) for t in texts]
        new = [w for w in {w for words in split for w in words}.difference(self) if w and len(w) <= LONG_WORD and w not in self.shared]
        for w, ids in zip(new, self.sp.encode(new, num_threads=1), strict=True):
            self[w] = np.array(ids, "<i4").tobytes()
        return [np.frombuffer(b"".join(map(self.__getitem__, words)), "<i4") for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, as the library's ``decode``."""
        if not len(ids):
            return ""
        if not self.plain[ids].all():
            return self.sp.decode(ids.tolist())
        text = "".join(map(self.surface.__getitem__, ids.tolist()))
        return text[1:] if text[0] == " " else text


@lru_cache(maxsize=2)
def codec(model_file: str) -> Codec:
    """One table for all tasks that a Python worker runs."""
    return Codec(model_file)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the words that a table may hold, in parts of a task's texts."""
    held: Counter[str] = Counter()

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            for text in batch.column("text").slice(a, 256).to_pylist():
                held.update(Codec.words(text))
            if len(held) > COUNTED:
                yield emit()
                held.clear()
    yield emit()


def shared_words(texts: DataFrame) -> DataFrame:
    """(word) of the most frequent words of (text), as many as the shared table holds."""
    counts = texts.mapInArrow(_counted, "word string, n long").filter(f"word <> '' and char_length(word) <= {LONG_WORD}")
    counts = counts.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")
    # counts over 1000 in steps of a sixteenth of an octave, so that the histogram is small
    step = F.when(F.col("n") <= 1000, F.col("n")).otherwise(1000 + F.floor(F.log2(F.col("n") / 1000) * 16)).cast("long")
    counts = checkpointed(counts.select("word", step.alias("step")))
    sizes = counts.groupBy("step").agg(F.count("*").alias("c"), F.sum(F.octet_length("word") + 24).alias("b")).orderBy(F.desc("step")).collect()
    least, words, used = None, 0, 0
    for r in sizes:
        words, used = words + r["c"], used + r["b"]
        if words > SHARED or used > SHARED_BYTES:
            break
        least = r["step"]
    return counts.filter(F.lit(False) if least is None else F.col("step") >= least).select("word")


def shared_table(texts: DataFrame, model_file: str) -> dict[str, bytes]:
    """Ids of the most frequent words, each segmented once; bounded by ``SHARED`` and ``SHARED_BYTES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codec(model_file)
        for batch in batches:
            words = batch.column("word").to_pylist()
            ids = [np.array(x, "<i4").tobytes() for x in table.sp.encode(words, num_threads=1)] if words else []
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(ids, pa.binary())], ["word", "ids"])

    return {r["word"]: bytes(r["ids"]) for r in shared_words(texts).mapInArrow(run, "word string, ids binary").collect()}


def _list(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts) if parts else np.zeros(0, "<i4")))


def encode_decode(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) per row."""

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sent = df.sparkSession.sparkContext.broadcast(shared_table(rows.select("text"), model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codec(model_file)
        table.shared = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids = table.encode_all(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), _list(ids), pa.array([table.decode(x) for x in ids], pa.string())], ["id", "ids", "decoded"])

    return rows.mapInArrow(run, "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)
