"""BAM and the blocked gzip under it.

The data source ``bam`` reads files by byte ranges: a task seeks to its range,
finds the first record that starts in it and decodes the blocks from there, so a
file of any size spreads over tasks and is never held whole. With an index
(``write_index``) a region, given as an option or pushed down as filters on
``tid`` and ``pos``, opens the chunks that may meet it and nothing else.

Where only Spark reaches a path (a scheme that ``ranges`` does not open), a file
is one binary row, of 2 GB at most, unpacked in one task. Output is written by
the same data source, one complete file a partition, block by block.

A tag keeps its type: ``tags`` maps it to (type, value), where all integer types
are ``i`` as in SAM text, and an array is its element type and values.
"""

from __future__ import annotations

import contextlib
import os
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from . import ranges
from .ranges import EOF

# Limits and codes of the formats.
PAYLOAD = 0xFF00
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BASES = "=ACMGRSVTWYHKDBN"
OPS = "MIDNSHP=XB"
_NUMBER = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}

ALIGNMENT = (
    "seq long, qname string, flag int, tid long, pos int, mapq int, cigar string, mtid long, mpos int, isize int, bases string, quals array<int>, tags map<string,struct<type:string,value:string>>, bc string, bf string, sa string, nm int"
)
_FIELDS = [c.split()[0] for c in ALIGNMENT.split(", ")]


#: Bytes of records in a piece that is decoded by one task at a time.
PIECE = 4 << 20


def is_bgzf(data: bytes) -> bool:
    return len(data) >= 18 and data[:4] == b"\x1f\x8b\x08\x04" and data[12:16] == b"BC\x02\x00"


def has_end(data: bytes) -> bool:
    """Whether the file ends with the empty block that marks its end."""
    return data.endswith(EOF)


def blocks(data: bytes, start: int = 0) -> Iterator[tuple[int, bytes]]:
    """(offset in the file, contents) of each block from the one at byte ``start``."""
    at = start
    while at < len(data):
        if not is_bgzf(data[at : at + 18]):
            raise ValueError(f"no block header at byte {at}")
        size = struct.unpack_from("<H", data, at + 16)[0] + 1
        if at + size > len(data):
            raise ValueError("the last block is cut off")
        yield at, zlib.decompress(data[at + 18 : at + size - 8], -15)
        at += size


def whole(data: bytes) -> bytes:
    """Contents of a complete file; one that lacks its end is an error."""
    if not has_end(data):
        raise ValueError("the file lacks its last block: it is cut off")
    return b"".join(b for _, b in blocks(data))


def block_ranges(data: bytes, size: int) -> list[tuple[int, int]]:
    """Byte ranges of about ``size`` bytes that start and end at blocks, by the headers alone."""
    out, start, at = [], 0, 0
    while at < len(data):
        if not is_bgzf(data[at : at + 18]):
            raise ValueError(f"no block header at byte {at}")
        at += struct.unpack_from("<H", data, at + 16)[0] + 1
        if at - start >= size or at >= len(data):
            out.append((start, at))
            start = at
    return out


def contents_from(data: bytes, virtual: int) -> Iterator[bytes]:
    """Contents from a virtual offset on: the block's byte in the upper 48 bits, the place in it in the lower 16."""
    skip = virtual & 0xFFFF
    for _, part in blocks(data, virtual >> 16):
        yield part[skip:]
        skip = 0


def text_lines(data: bytes, virtual: int = 0) -> Iterator[tuple[int, str]]:
    """(virtual offset, line) of blocked text from a virtual offset on."""
    start, held, skip = virtual, b"", virtual & 0xFFFF
    for at, part in blocks(data, virtual >> 16):
        done = skip
        while (end := part.find(b"\n", done)) >= 0:
            yield start, (held + part[done:end]).decode()
            held, done = b"", end + 1
            start = at << 16 | done
        held, skip = held + part[done:], 0
        if not held:  # the next line starts in the next block
            size = struct.unpack_from("<H", data, at + 16)[0] + 1
            start = (at + size) << 16
    if held:
        yield start, held.decode()


def block(part: bytes, level: int = 6) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(part) + deflate.flush()
    return struct.pack("<4BI2BH2BHH", 0x1F, 0x8B, 8, 4, 0, 0, 0xFF, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))


def compressed(data: bytes, level: int = 6) -> bytes:
    """Blocks of at most ``PAYLOAD`` bytes each, and the empty last one."""
    return b"".join(block(data[a : a + PAYLOAD], level) for a in range(0, len(data), PAYLOAD)) + EOF


class BlockFile:
    """Writes items to an open file block by block; an item begins a new block if it would cross a border."""

    def __init__(self, file, level: int = 6):
        self.file, self.level, self.held = file, level, bytearray()

    def write(self, item: bytes) -> None:
        if self.held and len(self.held) + len(item) > PAYLOAD:
            self.flush()
        self.held += item
        while len(self.held) > PAYLOAD:
            self.file.write(block(bytes(self.held[:PAYLOAD]), self.level))
            del self.held[:PAYLOAD]

    def flush(self) -> None:
        if self.held:
            self.file.write(block(bytes(self.held), self.level))
            self.held.clear()

    def close(self) -> None:
        self.flush()
        self.file.write(EOF)


def header(data: bytes) -> tuple[str, list[tuple[str, int]], int]:
    """(text, contigs, where records start) of uncompressed contents."""
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    n = struct.unpack_from("<i", data, 4)[0]
    text, at = data[8 : 8 + n].rstrip(b"\0").decode(), 8 + n
    (count,), at = struct.unpack_from("<i", data, at), at + 4
    contigs = []
    for _ in range(count):
        (k,) = struct.unpack_from("<i", data, at)
        contigs.append((data[at + 4 : at + 3 + k].decode(), struct.unpack_from("<i", data, at + 4 + k)[0]))
        at += 8 + k
    return text, contigs, at


def _tags(data: bytes) -> dict[str, dict[str, str]]:
    out, at = {}, 0
    while at < len(data):
        key, kind, at = data[at : at + 2].decode(), chr(data[at + 2]), at + 3
        if kind in "ZH":
            end = data.index(0, at)
            value, at = data[at:end].decode(), end + 1
        elif kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{_NUMBER[sub]}", data, at + 5)
            value, at = ",".join([sub, *(map(_short, values) if sub == "f" else map(str, values))]), at + 5 + n * struct.calcsize(_NUMBER[sub])
        else:
            code = "d" if kind == "d" else _NUMBER[kind]
            found, at = struct.unpack_from(f"<{code}", data, at)[0], at + struct.calcsize(code)
            value, kind = (_short(found), kind) if kind in "fd" else (str(found), "i")
        out[key] = {"type": kind, "value": value}
    return out


def _short(x: float) -> str:
    return f"{x:.9g}"


def records(data: bytes, at: int, seq: int = 0) -> Iterator[tuple]:
    """Rows of ``ALIGNMENT``, the first numbered ``seq``; a record that is cut off is an error."""
    while at < len(data):
        (size,) = struct.unpack_from("<i", data, at)
        end = at + 4 + size
        if size < 32 or end > len(data):
            raise ValueError("a record is cut off")
        yield _row(data, at, end, seq)
        seq, at = seq + 1, end


def _row(data: bytes, at: int, end: int, seq: int) -> tuple:
    """The row of ``ALIGNMENT`` of one record."""
    tid, pos, l_name, mapq, _, n_ops, flag, l_seq, mtid, mpos, isize = struct.unpack_from("<iiBBHHHiiii", data, at + 4)
    p = at + 36
    name, p = data[p : p + l_name - 1].decode(), p + l_name
    cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in struct.unpack_from(f"<{n_ops}I", data, p)) or None
    p += 4 * n_ops
    packed, p = data[p : p + (l_seq + 1) // 2], p + (l_seq + 1) // 2
    bases = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:l_seq] or None
    quals = None if l_seq == 0 or data[p] == 0xFF else list(data[p : p + l_seq])
    tags = _tags(data[p + l_seq : end])
    text = {k: v["value"] for k, v in tags.items()}
    nm = int(text["NM"]) if "NM" in text else None
    return seq, name, flag, tid, pos, mapq, cigar, mtid, mpos, isize, bases, quals, tags, text.get("BC"), text.get("BF"), text.get("SA"), nm


def pieces(data: bytes, size: int = PIECE) -> Iterator[tuple[int, bytes]]:
    """(number of the first record, records) of unpacked contents, cut at record borders."""
    at = start = header(data)[2]
    seq = first = 0
    while at < len(data):
        if len(data) - at < 4 or (step := struct.unpack_from("<i", data, at)[0]) < 32 or at + 4 + step > len(data):
            raise ValueError("a record is cut off")
        at, seq = at + 4 + step, seq + 1
        if at - start >= size:
            yield first, data[start:at]
            start, first = at, seq
    if at > start:
        yield first, data[start:at]


def read_bam(spark: SparkSession, path: str, index: str | None = None, region: str | None = None) -> DataFrame:
    """Alignments of one file, a folder or a pattern; ``seq`` is a record's virtual offset, so the order in its file.

    ``region`` is read through ``index``, a folder that ``write_index`` wrote. A
    file without its end marker is an error.
    """
    if ranges.scheme(path) not in ranges.OPENED:
        return _read_whole(spark, path)
    spark.dataSource.register(Bam)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    given = {k: v for k, v in (("index", index), ("region", region), ("push", push)) if v is not None}
    return spark.read.format("bam").options(**given).load(path)


def write_index(spark: SparkSession, path: str, index: str) -> None:
    """Write the region index of files in coordinate order, or any other: chunks are then more and smaller."""
    spark.dataSource.register(Bam)
    rows = spark.read.format("bam").option("rows", "index").load(path)
    # ranges of one file see a window each: the least offset is the window's
    lines = rows.groupBy("kind", "file", "tid", "at", F.when(F.col("kind") == "bin", F.col("beg")).alias("_b")).agg(F.min("beg").alias("beg"), F.max("end").alias("end")).drop("_b")
    lines.sort("kind", "file", "tid", "at", "beg").write.parquet(index)


def _read_whole(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of files that only Spark reaches; ``seq`` numbers the records of a file."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                for first, part in pieces(whole(content)):
                    yield pd.DataFrame({"first": [first], "part": [part]})

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, part in zip(pdf["first"], pdf["part"], strict=True):
                rows = []
                for row in records(part, 0, int(first)):
                    rows.append(row)
                    if len(rows) == 5000:
                        yield pd.DataFrame(rows, columns=_FIELDS)
                        rows = []
                yield pd.DataFrame(rows, columns=_FIELDS)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(cut, "first long, part binary").repartition(spark.sparkContext.defaultParallelism).mapInPandas(decode, ALIGNMENT)


def read_header(path: str) -> tuple[str, list[tuple[str, int]], int, int]:
    """(text, contigs, virtual offset of the first record, size) of one file, which must be complete."""
    size = ranges.size_of(path)
    with ranges.open_at(path) as f:
        if not ranges.has_end(f, size):
            raise ValueError(f"the file lacks its last block, it is cut off: {path}")
        blocks, at, data = ranges.Blocks(f, size), 0, b""
        while at < size:
            part, after = blocks.contents(at)
            data += part
            with contextlib.suppress(struct.error):  # it goes on in the next block
                text, contigs, end = header(data) if len(data) >= 8 else header(b"BAM\1")
                inside = end - (len(data) - len(part))
                return text, contigs, at << 16 | inside if inside < len(part) else after << 16, size
            at = after
    raise ValueError(f"not a BAM file: {path}")


def bam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(tid, name, len, off) of the first file's header."""
    if ranges.scheme(path) in ranges.OPENED:
        found = read_header(ranges.files_of(path)[0])[1]
        off, rows = 0, []
        for tid, (name, size) in enumerate(found):
            rows.append((tid, name, size, off))
            off += size
        return spark.createDataFrame(rows, "tid long, name string, len long, off long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                data = b""
                for _, part in blocks(content):
                    data += part
                    try:
                        found = header(data)[1]
                        break
                    except struct.error:
                        continue
                off, rows = 0, []
                for tid, (name, size) in enumerate(found):
                    rows.append((tid, name, size, off))
                    off += size
                yield pd.DataFrame(rows, columns=["tid", "name", "len", "off"])

    one = spark.read.format("binaryFile").load(path).select("content").limit(1)
    return one.mapInPandas(run, "tid long, name string, len long, off long")


def _packed_tag(key: str, kind: str, value: str) -> bytes:
    head = key.encode()
    if kind == "i":
        n = int(value)
        return head + (b"i" + struct.pack("<i", n) if -(1 << 31) <= n < 1 << 31 else b"I" + struct.pack("<I", n))
    if kind in "fd":
        return head + kind.encode() + struct.pack(f"<{kind}", float(value))
    if kind == "A":
        return head + b"A" + value.encode()[:1]
    if kind == "B":
        sub, *values = value.split(",")
        number = float if sub == "f" else int
        return head + b"B" + sub.encode() + struct.pack(f"<i{len(values)}{_NUMBER[sub]}", len(values), *map(number, values))
    return head + kind.encode() + value.encode() + b"\0"


def encoded(row) -> bytes:
    """One record of a row of ``ALIGNMENT``."""
    import re

    ops = [(int(n), OPS.index(o)) for n, o in re.findall(rf"(\d+)([{OPS}])", row.cigar or "")]
    bases = row.bases or ""
    codes = [BASES.index(b) if b in BASES else 15 for b in bases.upper()] + [0] * (len(bases) % 2)
    span = sum(n for n, o in ops if OPS[o] in "MDN=X") or 1
    body = (row.qname or "*").encode() + b"\0" + struct.pack(f"<{len(ops)}I", *(n << 4 | o for n, o in ops)) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    body += bytes(row.quals) if row.quals else b"\xff" * len(bases)
    body += b"".join(_packed_tag(k, v["type"], v["value"]) for k, v in sorted((row.tags or {}).items()))
    core = struct.pack("<iiBBHHHiiii", row.tid, row.pos, len((row.qname or "*").encode()) + 1, row.mapq, _bin(row.pos, row.pos + span), len(ops), row.flag, len(bases), row.mtid, row.mpos, row.isize)
    return struct.pack("<i", len(core) + len(body)) + core + body


def _bin(beg: int, end: int) -> int:
    for k in range(5, 0, -1):
        shift = 14 + 3 * (5 - k)
        if beg >> shift == (end - 1) >> shift:
            return ((1 << 3 * k) - 1) // 7 + (beg >> shift)
    return 0


class _Range(InputPartition):
    """Records of a file that start in [beg, end), virtual offsets; ``known`` if a record starts at ``beg``."""

    def __init__(self, file: str, beg: int, end: int, known: bool):
        self.file, self.beg, self.end, self.known = file, beg, end, known


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.index, self.rows = options["path"], options.get("index"), options.get("rows", "alignments")
        self.step = int(options.get("rangebytes", options.get("rangeBytes", 16 << 20)))
        self.wanted: tuple[int, int, int] | None = None  # tid, beg, end
        self.heads: dict[str, tuple] = {}
        if region := options.get("region"):
            from helixframe.operators.intervals import parse_region

            names = {name: tid for tid, (name, _) in enumerate(self._head(self._files()[0])[1])}
            name, beg, end = parse_region(region, set(names))
            self.wanted = (names.get(name, len(names)), beg, end)

    def _files(self) -> list[str]:
        return ranges.files_of(self.path)

    def _head(self, file: str) -> tuple:
        if file not in self.heads:
            self.heads[file] = read_header(file)
        return self.heads[file]

    def partitions(self) -> list[_Range]:
        out = []
        for file in self._files():
            _, contigs, first, size = self._head(file)
            chunks, levels = [(first, size << 16)], self._levels(contigs)
            if self.wanted and self.index:
                tid, beg, end = self.wanted
                end = min(end, contigs[tid][1]) if tid < len(contigs) else 0
                chunks = ranges.chunks_of(self.index, tid, beg, end, levels).get(file, []) if beg < end else []
            for beg, end in chunks:
                cuts = range((beg >> 16) + self.step, (end - 1 >> 16) + 1, self.step)
                edges = [beg, *(c << 16 for c in cuts), end]
                out += [_Range(file, a, b, k == 0) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
        return out or [_Range("", 0, 0, True)]

    @staticmethod
    def _levels(contigs: list[tuple[str, int]]) -> int:
        return ranges.levels_for(max((n for _, n in contigs), default=0))

    def read(self, partition: _Range):
        if not partition.file:
            return
        _, contigs, _, size = self._head(partition.file)
        with ranges.open_at(partition.file) as f:
            found = self.records(ranges.Blocks(f, size), partition, [n for _, n in contigs])
            if self.rows == "index":
                yield from ranges.index_rows(partition.file, found, self._levels(contigs))
                return
            held = []
            for beg, _, record in found:
                if not self.wanted or self._meets(record):
                    held.append(_row(record, 0, len(record), beg))
                if len(held) == 2000:
                    yield arrow_rows(held)
                    held = []
            if held:
                yield arrow_rows(held)

    @staticmethod
    def records(blocks: ranges.Blocks, part: _Range, lengths: list[int]) -> Iterator[tuple[int, int, bytes]]:
        beg = part.beg
        if not part.known:
            at = blocks.first_from(beg >> 16)
            beg = None if at is None or at << 16 >= part.end else ranges.first_record(blocks, at, (part.end - 1 >> 16) + 1, lengths)
        return iter(()) if beg is None else ranges.records_between(blocks, beg, part.end)

    def _meets(self, record: bytes) -> bool:
        (tid, pos), (wanted, beg, end) = struct.unpack_from("<ii", record, 4), self.wanted
        return tid == wanted and pos < end and pos + max(1, ranges.span(record)) > beg


class PushingBamReader(BamReader):
    """Used where ``spark.sql.python.filterPushdown.enabled`` is on, as Spark rejects it elsewhere."""

    def pushFilters(self, filters: list[Filter]):
        """Equality on ``tid`` and bounds on ``pos`` choose chunks of the index; Spark tests all filters again."""
        tid, beg, end = None, 0, 1 << 40
        for f in filters:
            match f:
                case EqualTo(("tid",), value):
                    tid = value
                case EqualTo(("pos",), value):
                    beg, end = max(beg, value), min(end, value + 1)
                case GreaterThan(("pos",), value):
                    beg = max(beg, value + 1)
                case GreaterThanOrEqual(("pos",), value):
                    beg = max(beg, value)
                case LessThan(("pos",), value):
                    end = min(end, value)
                case LessThanOrEqual(("pos",), value):
                    end = min(end, value + 1)
        if tid is not None and tid >= 0 and self.wanted is None and self.index:
            self.wanted = (tid, beg, max(end, beg + 1))
        return filters


def arrow_rows(rows: list[tuple]):
    """Rows of ``ALIGNMENT`` as one batch."""
    import pyarrow as pa

    tag = pa.struct([("type", pa.string()), ("value", pa.string())])
    kinds = {"seq": pa.int64(), "quals": pa.list_(pa.int32()), "tags": pa.map_(pa.string(), tag)} | dict.fromkeys(("flag", "pos", "mapq", "mpos", "isize", "nm"), pa.int32()) | dict.fromkeys(("tid", "mtid"), pa.int64())
    columns = dict(zip(_FIELDS, map(list, zip(*rows, strict=True)), strict=True))
    columns["tags"] = [list(t.items()) for t in columns["tags"]]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds.get(c, pa.string())) for c in _FIELDS], _FIELDS)


class _Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.contigs = options["path"], [c.rsplit(":", 1) for c in options.get("contigs", "").split(",") if c]

    def write(self, iterator):
        import uuid

        text = "".join(f"@SQ\tSN:{n}\tLN:{s}\n" for n, s in self.contigs).encode()
        head = [b"BAM\1", struct.pack("<i", len(text)), text, struct.pack("<i", len(self.contigs))]
        head += [struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", int(s)) for n, s in self.contigs]
        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f".part-{uuid.uuid4().hex}")
        with open(name, "wb") as f:
            out = BlockFile(f)
            out.write(b"".join(head))
            out.flush()
            for row in iterator:
                out.write(encoded(row))
            out.close()
        return _Written(name)

    def commit(self, messages):
        for k, m in enumerate(m for m in messages if m):
            os.rename(m.path, os.path.join(self.path, f"part-{k:05d}.bam"))

    def abort(self, messages):
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


class Bam(DataSource):
    """Tags as in ``ALIGNMENT``. ``df.write.format("bam").option("contigs", "chr1:1000,...").mode("append").save(path)``: a file a partition, in a folder all executors share; names appear on commit."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return ranges.INDEX if self.options.get("rows") == "index" else ALIGNMENT

    def reader(self, schema) -> BamReader:
        return (PushingBamReader if self.options.get("push") == "true" else BamReader)(dict(self.options))

    def writer(self, schema, overwrite):
        return _Writer(self.options)
