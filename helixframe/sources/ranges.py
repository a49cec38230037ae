"""Blocked gzip by byte ranges: files that can be sought, block and record borders, and the region index.

A virtual offset is a block's byte in the upper bits and the place in its
contents in the lower 16. A byte range owns the blocks that start in it, and a
record belongs to the range that owns the block it starts in. A range that does
not start at a known record looks for one: from its first block on, the first
place from which ``CHAIN`` records in a row are sound (known contigs, positions
inside them, a name that ends where its length says, sizes that add up).

The index is a Parquet table: ``bin`` rows map a hierarchical bin of a contig to
chunks of virtual offsets, ``line`` rows a window of 16 kb to the least offset of
any alignment that meets it.
"""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections.abc import Iterator

EOF = bytes.fromhex("1f8b0804" "00000000" "00ff" "0600" "4243" "0200" "1b00" "0300" "00000000" "00000000")
#: Bytes read at a time, and the records in a row that make a border.
READ, CHAIN = 1 << 20, 8
#: Finest bins are 2 ** FINE bases wide, and each level above is eight times as wide.
FINE, LEVELS = 14, 5
INDEX = "kind string, file string, tid int, at long, beg long, end long"
#: Schemes that workers open themselves; files elsewhere are read through Spark, each as one row.
OPENED = ("", "file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss")


def scheme(path: str) -> str:
    head, colon, rest = path.partition(":")
    return head if colon and rest.startswith("/") else ""


def _fs(path: str):
    """(file system, path in it) of a path that is not local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _local(path: str) -> str | None:
    kind = scheme(path)
    if kind == "file":
        return "/" + path[5:].lstrip("/")
    return None if kind else path


def open_at(path: str):
    """A binary file that can be sought."""
    local = _local(path)
    if local is not None:
        return open(local, "rb")
    system, name = _fs(path)
    return system.open_input_file(name)


def create_at(path: str):
    """A new binary file, open for writing."""
    local = _local(path)
    if local is not None:
        return open(local, "xb")
    system, name = _fs(path)
    return system.open_output_stream(name)


def size_of(path: str) -> int:
    local = _local(path)
    if local is not None:
        return os.path.getsize(local)
    system, name = _fs(path)
    return system.get_file_info(name).size


def files_of(path: str) -> list[str]:
    """A file, the visible files of a folder, or those that a pattern matches, by name."""
    shown = lambda name: not os.path.basename(name).startswith((".", "_"))
    local = _local(path)
    if local is not None:
        found = [os.path.join(local, f) for f in os.listdir(local)] if os.path.isdir(local) else glob.glob(local)
        return sorted(f for f in found if shown(f) and os.path.isfile(f))
    from pyarrow import fs

    system, name = _fs(path)
    if system.get_file_info(name).type == fs.FileType.Directory:
        root = path.rstrip("/")
        return sorted(f"{root}/{f.base_name}" for f in system.get_file_info(fs.FileSelector(name)) if f.is_file and shown(f.path))
    return [path]


class Blocks:
    """The blocks of an open file, by their first byte."""

    def __init__(self, file, size: int):
        self.file, self.size, self.held, self.base = file, size, b"", 0
        #: bytes taken from the file so far
        self.read = 0

    def bytes_at(self, at: int, n: int) -> bytes:
        if not (self.base <= at and at + n <= self.base + len(self.held)):
            self.file.seek(at)
            self.held, self.base = self.file.read(max(n, READ)), at
            self.read += len(self.held)
        return self.held[at - self.base : at - self.base + n]

    def length(self, at: int) -> int | None:
        """Bytes of the block at ``at``; None if there is no block header."""
        head = self.bytes_at(at, 18)
        if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04" or head[10:16] != b"\x06\0BC\x02\0":
            return None
        return struct.unpack_from("<H", head, 16)[0] + 1

    def contents(self, at: int) -> tuple[bytes, int]:
        """(contents, where the next block starts)."""
        n = self.length(at)
        if n is None:
            raise ValueError(f"no block header at byte {at}")
        data = self.bytes_at(at, n)
        if len(data) < n:
            raise ValueError("the last block is cut off")
        out = zlib.decompress(data[18 : n - 8], -15)
        if zlib.crc32(out) != struct.unpack_from("<I", data, n - 8)[0]:
            raise ValueError(f"the block at byte {at} is damaged")
        return out, at + n

    def first_from(self, at: int) -> int | None:
        """The first block that starts at or after ``at``: its contents are sound, and a block or the end follows."""
        while at < self.size:
            part = self.bytes_at(at, min(READ, self.size - at))
            k = part.find(b"\x1f\x8b\x08\x04")
            if k < 0:
                at += max(1, len(part) - 3)
                continue
            at += k
            n = self.length(at)
            if n is not None and (at + n == self.size or self.length(at + n) is not None):
                try:
                    self.contents(at)
                    return at
                except (ValueError, zlib.error):
                    pass
            at += 1
        return None


def has_end(file, size: int) -> bool:
    """Whether the file ends with the empty block that marks its end."""
    file.seek(max(0, size - len(EOF)))
    return file.read(len(EOF)) == EOF


def _sound(data, at: int, lengths: list[int]) -> int | None:
    """Where the record at ``at`` ends if its fixed part can be one's, whatever follows."""
    size, tid, pos, name, _, _, ops, _, bases, mtid, mpos = struct.unpack_from("<iiiBBHHHiii", data, at)
    if size < 33 or name < 1 or bases < 0 or not -1 <= tid < len(lengths) or not -1 <= mtid < len(lengths):
        return None
    if not -1 <= pos < (lengths[tid] if tid >= 0 else 1 << 31) or not -1 <= mpos < (lengths[mtid] if mtid >= 0 else 1 << 31):
        return None
    return at + 4 + size if 32 + name + 4 * ops + (bases + 1) // 2 + bases <= size else None


def first_record(blocks: Blocks, at: int, stop: int, lengths: list[int]) -> int | None:
    """Virtual offset of the first record that starts in a block from ``at`` on and before ``stop``; None if there is none."""
    data, starts, after = bytearray(), [], at

    def hold(n: int) -> bool:
        nonlocal after
        while len(data) < n and after < blocks.size:
            starts.append((len(data), after))
            part, after = blocks.contents(after)
            data.extend(part)
        return len(data) >= n

    def chain(p: int) -> bool:
        for k in range(CHAIN):
            if not hold(p + 1):
                return k > 0  # the file ends where a record does
            if not hold(p + 36) or (end := _sound(data, p, lengths)) is None or not hold(end):
                return False
            name = data[p + 36 : p + 36 + data[p + 12]]
            ops = struct.unpack_from(f"<{struct.unpack_from('<H', data, p + 16)[0]}I", data, p + 36 + len(name))
            if name[-1] or 0 in name[:-1] or any(x & 15 > 8 for x in ops):
                return False
            p = end
        return True

    o, k = 0, 0
    while hold(o + 1):
        while k + 1 < len(starts) and starts[k + 1][0] <= o:
            k += 1
        if starts[k][1] >= stop:
            return None
        if chain(o):
            return starts[k][1] << 16 | o - starts[k][0]
        o += 1
    return None


def records_between(blocks: Blocks, beg: int, end: int) -> Iterator[tuple[int, int, bytes]]:
    """(virtual offset, that of the next record, record) of those that start from ``beg`` on and before ``end``."""
    at, skip = beg >> 16, beg & 0xFFFF
    carry, since = b"", 0  # a record that goes on in the next block, and where it starts
    while at < blocks.size and (carry or at << 16 < end):
        part, after = blocks.contents(at)
        data, shift, p = carry + part[skip:], skip - len(carry), 0
        while p < len(data):
            start = since if carry and not p else at << 16 | p + shift
            if start >= end:
                return
            size = struct.unpack_from("<i", data, p)[0] if len(data) - p >= 4 else 32
            if size < 32:
                raise ValueError("a record is cut off")
            stop = p + 4 + size
            if stop > len(data):
                break
            yield start, at << 16 | stop + shift if stop < len(data) else after << 16, data[p:stop]
            p = stop
        if p < len(data):
            since = start
        carry, at, skip = data[p:], after, 0
    if carry:
        raise ValueError("a record is cut off")


def levels_for(longest: int) -> int:
    """Levels of bins that hold positions up to ``longest``."""
    n = LEVELS
    while 1 << FINE + 3 * n < longest:
        n += 1
    return n


def bin_of(beg: int, end: int, levels: int = LEVELS) -> int:
    """Smallest bin that holds [beg, end)."""
    for k in range(levels, 0, -1):
        shift = FINE + 3 * (levels - k)
        if beg >> shift == end - 1 >> shift:
            return ((1 << 3 * k) - 1) // 7 + (beg >> shift)
    return 0


def bin_ranges(beg: int, end: int, levels: int = LEVELS) -> list[tuple[int, int]]:
    """(first, last) bin of each level that may hold something in [beg, end)."""
    out = []
    for k in range(levels + 1):
        shift, first = FINE + 3 * (levels - k), ((1 << 3 * k) - 1) // 7
        out.append((first + (beg >> shift), first + (end - 1 >> shift)))
    return out


def index_rows(file: str, records: Iterator[tuple[int, int, bytes]], levels: int) -> Iterator[tuple]:
    """Rows of ``INDEX`` of one range; chunks of a bin that touch the same block are one."""
    bins: dict[tuple[int, int], list[list[int]]] = {}
    lines: dict[tuple[int, int], int] = {}
    for beg, end, record in records:
        tid, pos = struct.unpack_from("<ii", record, 4)
        if tid < 0:
            continue
        stop = max(pos, 0) + max(1, span(record))
        chunks = bins.setdefault((tid, bin_of(max(pos, 0), stop, levels)), [])
        if chunks and chunks[-1][1] >> 16 >= beg >> 16:
            chunks[-1][1] = end
        else:
            chunks.append([beg, end])
        for w in range(max(pos, 0) >> FINE, (stop - 1 >> FINE) + 1):
            lines.setdefault((tid, w), beg)
    for (tid, b), chunks in bins.items():
        for beg, end in chunks:
            yield "bin", file, tid, b, beg, end
    for (tid, w), beg in lines.items():
        yield "line", file, tid, w, beg, None


def span(record: bytes) -> int:
    """Reference bases that a packed record's alignment covers."""
    n = struct.unpack_from("<H", record, 16)[0]
    ops = struct.unpack_from(f"<{n}I", record, 36 + record[12])
    return sum(x >> 4 for x in ops if x & 15 in (0, 2, 3, 7, 8))


def chunks_of(index: str, tid: int, beg: int, end: int, levels: int) -> dict[str, list[tuple[int, int]]]:
    """file -> chunks of virtual offsets that hold all alignments of a contig that meet [beg, end)."""
    import pyarrow.compute as pc
    import pyarrow.dataset as ds

    local = _local(index)
    system, name = (None, local) if local is not None else _fs(index)
    at = pc.field("at")
    bins = None
    for a, b in bin_ranges(beg, end, levels):
        one = (at >= a) & (at <= b)
        bins = one if bins is None else bins | one
    near = (at >= beg >> FINE) & (at <= end - 1 >> FINE)
    wanted = (pc.field("tid") == tid) & (((pc.field("kind") == "bin") & bins) | ((pc.field("kind") == "line") & near))
    found = ds.dataset(name, filesystem=system, format="parquet").to_table(filter=wanted).to_pylist()
    floor: dict[str, int] = {}
    for r in found:
        if r["kind"] == "line":
            floor[r["file"]] = min(r["beg"], floor.get(r["file"], r["beg"]))
    out: dict[str, list[tuple[int, int]]] = {}
    for r in sorted((r for r in found if r["kind"] == "bin"), key=lambda r: (r["file"], r["beg"])):
        if r["file"] not in floor or r["end"] <= floor[r["file"]]:
            continue
        mine, a = out.setdefault(r["file"], []), max(r["beg"], floor[r["file"]])
        if mine and a >> 16 <= mine[-1][1] >> 16:
            mine[-1] = (mine[-1][0], max(mine[-1][1], r["end"]))
        else:
            mine.append((a, r["end"]))
    return out
