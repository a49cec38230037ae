"""Read-pair trimming: adapters, binding motif, barcode, overlap of mates.

A pure function of one pair, run in Arrow batches: no shuffle, and a pair is
one row, so mates never part. A batch is a few byte matrices, a row a read; cuts
move a read's ends, and seeds, extensions, overlaps and consensus are computed
for all pairs of a batch at once. Pairs are laid out by size, so a long read
widens the matrix of its like only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - as pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Oligonucleotides of the protocol.
BIND = "GGGAGATGTGTATAAGAGACAG"
PROMOTER = "GAACAGAATTTAATACGACTCACTATA"
ADAPTER1 = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCAC"
ADAPTER2 = "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGTAGATCTCGGTGGTCGCCGTATCATT"
OLIGO_FORWARD = "TTCAGGAAAACCTGA"
OLIGO_REVERSE = "TCAGGTTTTCCTGAA"
BIND_REVERSE = "CTGTCTCTTATACACATCT"
# Classes of pairs.
AMBIGUOUS, SHORT, NO_BINDING, MANY_BINDING, POST_PROMOTER, CHIMERA, SHORT_MERGE, SHORT_PAIR, MERGED, NOT_MERGED, AMBIGUOUS_MERGE = 1, 2, 3, 4, 5, 6, 11, 12, 21, 22, 23
WRITTEN = (NO_BINDING, MERGED, NOT_MERGED, AMBIGUOUS_MERGE)

_HIGH = ord("5")  # phred 20
_LOW = 34  # quality of a base that may belong to an adapter
#: Cells of a batch's matrix.
CELLS = 2_000_000

_PAIRING = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"ACGTUMRWSYKVHDBNacgtumrwsykvhdbn", b"TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn", strict=True):
    _PAIRING[_a] = _b
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[97:123] -= 32
_PLAIN = _UPPER.copy()  # upper case, and U as T
_PLAIN[[ord("U"), ord("u")]] = ord("T")
_ACGT = np.isin(np.arange(256), np.frombuffer(b"ACGT", np.uint8))


@dataclass(frozen=True)
class TrimOptions:
    barcode: int = 8
    min_length: int = 40
    max_quality: int = 50
    overlap: tuple[int, int] = (8, 2)  # least length, penalty allowed in it
    adapter: tuple[int, int] = (3, 1)
    promoter: tuple[int, int] = (6, 2)


def motif_positions(df: DataFrame, seq: str, motif: str) -> DataFrame:
    """All columns of ``df``, then pos and word: a row for each window of ACGT of ``seq`` within one mismatch of the motif.

    The windows of a sequence come from one pass of a look-ahead and are tested
    in the row, in the JVM, so only hits are exploded and no row holds a sequence twice.
    """
    k = len(motif)
    windows = F.regexp_extract_all(F.upper(F.col(seq)), F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))
    wrong = lambda w: sum((F.when(F.substring(w, j + 1, 1) != b, 1).otherwise(0) for j, b in enumerate(motif)), F.lit(0))
    numbered = F.transform(windows, lambda w, i: F.struct(i.cast("long").alias("pos"), w.alias("word")))
    hits = F.filter(numbered, lambda x: (wrong(x["word"]) <= 1) & x["word"].rlike("^[ACGT]*$"))
    return df.withColumn("_hit", F.explode(hits)).select(*df.columns, "_hit.pos", "_hit.word")


class Reads:
    """Reads as byte matrices: row k is ``s[k, a[k]:b[k]]`` with qualities ``q``; what lies outside is never read."""

    def __init__(self, s: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray):
        self.s, self.q, self.a, self.b = s, q, a, b

    @classmethod
    def of(cls, seq: pa.Array, qual: pa.Array, rows: np.ndarray) -> Reads:
        (s, length), (q, _) = _cells(seq, rows), _cells(qual, rows)
        width = max(1, int(length.max(initial=0)))
        return cls(_fitted(s, width), _fitted(q, width), np.zeros(len(rows), np.int64), length)

    def __len__(self) -> int:
        return len(self.a)

    @property
    def size(self) -> np.ndarray:
        return np.maximum(0, self.b - self.a)

    def take(self, rows: np.ndarray) -> Reads:
        return Reads(self.s[rows], self.q[rows], self.a[rows], self.b[rows])

    def put(self, rows: np.ndarray, one: Reads) -> None:
        """Replace rows; ``self`` grows to the width of ``one``."""
        width = max(self.s.shape[1], one.s.shape[1])
        self.s, self.q = _fitted(self.s, width), _fitted(self.q, width)
        self.s[rows], self.q[rows] = _fitted(one.s, width), _fitted(one.q, width)
        self.a[rows], self.b[rows] = one.a, one.b

    def reversed(self, complement: bool = False) -> Reads:
        """The reads back to front, or their reverse complement, each from its row's start on."""
        at = self.b[:, None] - 1 - np.arange(self.s.shape[1])
        ok = at >= self.a[:, None]
        at = np.maximum(at, 0)
        s = np.where(ok, np.take_along_axis(self.s, at, 1), 0).astype(np.uint8)
        q = np.where(ok, np.take_along_axis(self.q, at, 1), 0).astype(np.uint8)
        return Reads(_PAIRING[s] if complement else s, q, np.zeros(len(self), np.int64), self.size)

    def window(self, rows: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(bases, qualities) of ``n`` places from ``at`` on, whatever lies there."""
        where = np.clip(at[:, None] + np.arange(n), 0, self.s.shape[1] - 1)
        return self.s[rows[:, None], where], self.q[rows[:, None], where]

    def holds(self, letters: bytes) -> np.ndarray:
        """Whether any letter of ``letters`` is in each read."""
        col = np.arange(self.s.shape[1])
        inside = (col >= self.a[:, None]) & (col < self.b[:, None])
        return (np.isin(self.s, np.frombuffer(letters, np.uint8)) & inside).any(axis=1)

    def texts(self) -> tuple[pa.Array, pa.Array]:
        col = np.arange(self.s.shape[1])
        inside = (col >= self.a[:, None]) & (col < self.b[:, None])
        ends = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        return tuple(pa.LargeStringArray.from_buffers(len(self), pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(m[inside]).tobytes())).cast(pa.string()) for m in (self.s, self.q))


def _cells(column: pa.Array, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of bytes, lengths) of some rows of a text column; null is empty."""
    column = column.take(pa.array(rows)).cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(1, np.uint8)
    length = np.diff(off)
    col = np.arange(max(1, int(length.max(initial=0))))
    inside = col < length[:, None]
    return np.where(inside, buf[np.minimum(off[:-1, None] + col, len(buf) - 1)], 0).astype(np.uint8), length


def _fitted(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, max(0, width - m.shape[1]))))[:, :width]


def _pattern(text: str, n: int) -> Reads:
    """One text for ``n`` reads, of good quality."""
    s = np.broadcast_to(np.frombuffer(text.encode(), np.uint8), (n, len(text)))
    return Reads(s, np.full(s.shape, 255, np.uint8), np.zeros(n, np.int64), np.full(n, len(text)))


def extensions(x: np.ndarray, y: np.ndarray, good: np.ndarray, n: np.ndarray, least: np.ndarray | int, allowed: int) -> np.ndarray:
    """Lengths of the ungapped matches of the starts of rows, ``n`` places at most: mismatches cost 3 between good bases, else 1, up to ``allowed`` in ``least`` bases and in proportion beyond."""
    col = np.arange(x.shape[1])
    wrong = (x != y) & (col < n[:, None])
    spent = np.cumsum(np.where(wrong, np.where(good, 3, 1), 0), axis=1)
    least = np.broadcast_to(np.asarray(least), n.shape)[:, None]
    over = wrong & np.where(col > least, spent * np.maximum(least, 1) > col * allowed, spent > allowed)
    return np.where(over.any(axis=1), over.argmax(axis=1), n) if x.shape[1] else n


def _seeded(r: Reads, s: Reads, length: np.ndarray, seed: int, least: int, allowed: int, grow: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in the matrix) where ``s``, of which ``length`` bases count, may start in ``r``: its first ``least`` bases fit, and no more of the first ``seed`` that do differ than the penalty leaves room for.

    With ``grow`` the penalty allowed in ``least`` bases holds in proportion for more of them.
    """
    width = r.s.shape[1]
    head, _ = s.window(np.arange(len(s)), s.a, seed)
    wrong = np.zeros((len(r), width), np.uint8)
    col = np.arange(width)
    left = r.b[:, None] - col
    reach = np.clip(np.minimum(left, length[:, None]), 0, 255).astype(np.uint8)
    for j in range(min(seed, width)):
        wrong[:, : width - j] += (r.s[:, j:] != head[:, j, None]) & (reach[:, : width - j] > j)
    room = allowed
    if grow:
        by_reach = np.maximum(np.minimum(np.arange(256), seed) - 1, least) * allowed // max(least, 1)
        room = np.minimum(by_reach, 255).astype(np.uint8)[reach]
    return np.nonzero((wrong <= room) & (col >= r.a[:, None]) & (col + np.minimum(least, length)[:, None] <= r.b[:, None]))


def _first(row: np.ndarray, most: int) -> np.ndarray:
    """Which of sorted rows are among the first ``most`` of their number."""
    start = np.searchsorted(row, row, "left")
    return np.arange(len(row)) - start < most


class Hits:
    """Matches of reads: the row, where it starts from the read's start on, and its length; in the order of search, ``most`` a read."""

    def __init__(self, n: int, row: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.row, self.start, self.length = row, start, length
        self.count = np.bincount(row, minlength=n)
        self.head = np.minimum(np.searchsorted(row, np.arange(n), "left"), max(0, len(row) - 1))
        self.tail = np.maximum(np.searchsorted(row, np.arange(n), "right") - 1, 0)


def overlaps_forward(r: Reads, s: Reads, rule: tuple[int, int], most: int) -> Hits:
    """Where a tail of a read matches the head of ``s``, or ``s`` lies inside; shortest tail first."""
    least, allowed = rule
    row, at = _seeded(r, s, s.size, 16, least, allowed, True)
    long = s.size[row] >= least
    row, at = row[long], at[long]
    left = r.b[row] - at
    n = np.minimum(left, s.size[row])
    m = _extended(r, row, at, s, s.a[row], n, least, allowed)
    ok = (m >= least) & ((m == left) | (m == s.size[row]))
    row, at, m = row[ok], at[ok], m[ok]
    order = np.lexsort((-at, row))
    row, at, m = row[order], at[order], m[order]
    keep = _first(row, most)
    return Hits(len(r), row[keep], (at - r.a[row])[keep], m[keep])


def _extended(r: Reads, row: np.ndarray, at: np.ndarray, s: Reads, begin: np.ndarray, n: np.ndarray, least: np.ndarray | int, allowed: int) -> np.ndarray:
    out = np.zeros(len(row), np.int64)
    width = int(n.max(initial=0))
    step = max(1, CELLS // max(1, width))
    for k in range(0, len(row), step):
        part = slice(k, k + step)
        (x, qx), (y, qy) = r.window(row[part], at[part], width), s.window(row[part], begin[part], width)
        out[part] = extensions(x, y, (qx >= _HIGH) & (qy >= _HIGH), n[part], least if np.isscalar(least) else least[part], allowed)
    return out


def overlaps_reverse(r: Reads, s: Reads, rule: tuple[int, int], most: int) -> Hits:
    """Where a head of a read matches the tail of ``s``; starts are the bases of the read after the match; shortest head first."""
    return overlaps_forward(r.reversed(), s.reversed(), rule, most)


def overlaps_within(r: Reads, s: Reads, rule: tuple[int, int], most: int) -> Hits:
    """Where all of a read matches inside ``s``, beyond its first base and before its last; starts are places in ``s``."""
    allowed, n = rule[1], r.size
    row, at = _seeded(s, r, n, 16, 8, allowed, False)
    ok = (at > s.a[row]) & (at - s.a[row] < (s.size - n)[row])
    row, at = row[ok], at[ok]
    # the penalty is bounded as a whole: a read is no longer than its own least length
    m = _extended(r, row, r.a[row], s, at, n[row], n[row], allowed)
    ok = m == n[row]
    row, at = row[ok], at[ok]
    keep = _first(row, most)
    return Hits(len(r), row[keep], (at - s.a[row])[keep], n[row][keep])


def motif_hits(r: Reads, motif: str, most: int) -> Hits:
    """The first ``most`` windows of ACGT within one mismatch of the motif."""
    s, width, k = _PLAIN[r.s], r.s.shape[1], len(motif)
    wrong = np.zeros((len(r), width), np.uint8)
    odd = ~_ACGT[s]
    some = bool(odd.any())
    for j, c in enumerate(motif.encode()[:width]):
        differs = s[:, j:] != c
        wrong[:, : width - j] += differs
        if some:  # another letter than ACGT counts twice
            wrong[:, : width - j] += differs & odd[:, j:]
    col = np.arange(width)
    row, at = np.nonzero((wrong < 2) & (col >= r.a[:, None]) & (col + k <= r.b[:, None]))
    keep = _first(row, most)
    return Hits(len(r), row[keep], (at - r.a[row])[keep], np.full(int(keep.sum()), k))


def cut_adapter(r: Reads, adapter: str, o: TrimOptions, five: bool = False, inside: bool = True) -> None:
    """Cut reads at the longest match of an adapter; one no longer than the least length only loses its quality."""
    hits = (overlaps_reverse if five else overlaps_forward)(r, _pattern(adapter, len(r)), o.adapter, 4)
    if not len(hits.row):
        return
    size = r.size
    hit = hits.count > 0
    if not inside:  # the first or the last match has to reach the read's end
        total = hits.start + hits.length
        hit &= (total[hits.head] == size) | (total[hits.tail] == size)
    n = np.where(hit, size - hits.start[hits.tail], 0)
    far, near = hit & (n > o.adapter[0]), hit & (n <= o.adapter[0])
    col = np.arange(r.s.shape[1])
    first = r.a if five else r.b - n
    r.q[near[:, None] & (col >= first[:, None]) & (col < (first + n)[:, None])] = _LOW
    r.a, r.b = np.where(far & five, r.a + n, r.a), np.where(far & (not five), r.b - n, r.b)


def promoter_length(r: Reads, at: np.ndarray, o: TrimOptions) -> np.ndarray:
    """Length of the promoter's match that ends at ``at`` bases from the read's start."""
    before = Reads(r.s, r.q, r.a, r.a + at).reversed()
    rows, k = np.arange(len(r)), len(PROMOTER)
    x, q = before.window(rows, before.a, k)
    y = np.broadcast_to(np.frombuffer(PROMOTER[::-1].encode(), np.uint8), x.shape)
    return extensions(x, y, q >= _HIGH, np.minimum(at, k), *o.promoter)


def merge_bases(f: np.ndarray, fq: np.ndarray, r: np.ndarray, rq: np.ndarray, most: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Consensus of two reads of a base: agreement adds half of the lower quality, else the better base keeps the difference."""
    a, b = fq.astype(np.int64) - 33, rq.astype(np.int64) - 33
    same = f == r
    quality = np.where(same, np.minimum(most, np.maximum(a, b) + np.minimum(a, b) // 2), np.abs(a - b))
    return _UPPER[np.where(same | (a > b), f, r)], (quality + 33).astype(np.uint8)


def merged_reads(f: Reads, back: Reads, at: np.ndarray, after: np.ndarray, fw: Hits, rv: Hits, within: Hits, o: TrimOptions) -> Reads:
    """The fragments from behind the motif, each with one overlap: ``f`` up to it, its consensus, then the longer read's rest."""
    size, other = f.size, back.size
    pick = lambda h, values: values[h.head] if len(values) else np.zeros(len(f), np.int64)
    forward, backward = fw.count > 0, rv.count > 0
    # a tail of f on a head of back
    start, n = at + pick(fw, fw.start), pick(fw, fw.length)
    skip = np.maximum(0, after - start)
    rest_of_f = n >= other
    sized = lambda x: np.maximum(0, x)
    # a head of f on a tail of back
    end = size - pick(rv, rv.start)
    begin = end - pick(rv, rv.length)
    m = np.where(after < begin, pick(rv, rv.length), end - after)
    # f inside back
    shift = pick(within, within.start) - at
    choose = lambda a, b, c: np.where(forward, a, np.where(backward, b, c))
    n1 = choose(sized(start - after), sized(begin - after), 0)
    n2 = choose(sized(n - skip), sized(m), sized(size - after))
    f2 = choose(start + skip, end - m, after)
    b2 = choose(skip, other - m, after + shift)
    n3 = np.where(forward, np.where(rest_of_f, sized(size - at - n), other - n), 0)
    i3 = np.where(rest_of_f, at + n, n)
    col = np.arange(max(1, int((n1 + n2 + n3).max(initial=0))))
    c1, c2, c3 = n1[:, None], (n1 + n2)[:, None], (n1 + n2 + n3)[:, None]
    in2, in3 = (col >= c1) & (col < c2), (col >= c2) & (col < c3)
    from_f = np.where(col < c1, after[:, None] + col, np.where(in2, f2[:, None] + col - c1, i3[:, None] + col - c2)) + f.a[:, None]
    from_b = np.where(in2, b2[:, None] + col - c1, i3[:, None] + col - c2) + back.a[:, None]
    rows = np.arange(len(f))[:, None]
    wf, wb = np.clip(from_f, 0, f.s.shape[1] - 1), np.clip(from_b, 0, back.s.shape[1] - 1)
    sf, qf, sb, qb = f.s[rows, wf], f.q[rows, wf], back.s[rows, wb], back.q[rows, wb]
    both, quality = merge_bases(sf, qf, sb, qb, o.max_quality)
    of_back = in3 & (forward & ~rest_of_f)[:, None]
    s = np.where(in2, both, np.where(of_back, sb, sf))
    q = np.where(in2, quality, np.where(of_back, qb, qf))
    return Reads(s, q, np.zeros(len(f), np.int64), n1 + n2 + n3)


def process(one: Reads, two: Reads, o: TrimOptions) -> tuple[np.ndarray, Reads, Reads, list[str | None], np.ndarray]:
    """(class, mate 1, mate 2, barcode, both mates bound) of all pairs of a batch."""
    n = len(one)
    kind, both, barcode = np.zeros(n, np.int64), np.zeros(n, bool), np.full(n, None, object)
    for r, adapter in ((one, ADAPTER1), (two, ADAPTER2)):
        col = np.arange(r.s.shape[1])
        known = (r.s != ord("N")) & (col >= r.a[:, None]) & (col < r.b[:, None])
        some = known.any(axis=1)
        r.a, r.b = np.where(some, known.argmax(axis=1), r.a), np.where(some, known.shape[1] - known[:, ::-1].argmax(axis=1), r.a)
        cut_adapter(r, adapter, o)

    def tell(rows: np.ndarray, what: int) -> np.ndarray:
        kind[rows] = what
        return kind == 0

    hits = [motif_hits(r, BIND, 3) for r in (one, two)]
    count = [h.count for h in hits]
    last = [h.start[h.tail] if len(h.start) else np.zeros(n, np.int64) for h in hits]
    left = tell(np.minimum(one.size, two.size) < o.min_length, SHORT)
    free = left & (count[0] == 0) & (count[1] == 0)
    left = tell(free, NO_BINDING)
    if free.any():
        rows = np.flatnonzero(free)
        for r in (one, two):
            part = r.take(rows)
            cut_adapter(part, OLIGO_FORWARD, o, inside=False)
            cut_adapter(part, BIND_REVERSE, o)
            cut_adapter(part, OLIGO_REVERSE, o, five=True, inside=False)
            cut_adapter(part, BIND, o, five=True)
            r.put(rows, part)
    left = tell(left & (np.maximum(*count) == 3), MANY_BINDING)
    twice = left & (count[0] > 0) & (count[1] > 0)
    bound = np.where(count[0] > 0, 0, 1)
    if twice.any():
        rows = np.flatnonzero(twice)
        both[rows] = True
        found = []
        for r, at in zip((one, two), last, strict=True):
            k = promoter_length(r.take(rows), at[rows], o)
            found.append(np.where(((k == at[rows]) | (k == len(PROMOTER))) & (k >= o.promoter[0]), k, 0))
        none = (found[0] == 0) & (found[1] == 0)
        left = tell(rows[none], CHIMERA)
        # the mate with the longer promoter is the one behind it
        worse = (found[1] > found[0]).astype(int)
        for w, r in enumerate((one, two)):
            of = rows[~none & (worse == w)]
            r.a[of] += last[w][of] + len(BIND)
            bound[of] = 1 - w
    rows = np.flatnonzero(left)
    if not len(rows):
        return kind, one, two, barcode.tolist(), both
    swap = bound[rows] == 1
    f, r = one.take(rows), two.take(rows)
    width = max(f.s.shape[1], r.s.shape[1])
    for x in (f, r):
        x.s, x.q = _fitted(x.s, width), _fitted(x.q, width)
    f, r = (Reads(*(np.where(swap[:, None] if p.ndim == 2 else swap, q, p) for p, q in zip((x.s, x.q, x.a, x.b), (y.s, y.q, y.a, y.b), strict=True))) for x, y in ((f, r), (r, f)))
    at = np.where(swap, last[1][rows], last[0][rows])
    after = at + len(BIND)
    marked = promoter_length(f, at, o) >= o.promoter[0]
    keys, _ = Reads(f.s, f.q, f.a + np.maximum(0, at - o.barcode), f.a + at).texts()
    barcode[rows] = np.where(marked, "*", np.array(keys.to_pylist(), object))
    post = motif_hits(Reads(f.s, f.q, f.a + after, f.b), PROMOTER, 1).count > 0
    kind[rows[post]] = POST_PROMOTER
    ok = np.flatnonzero(~post)
    rows, f, r, at, after = rows[ok], f.take(ok), r.take(ok), at[ok], after[ok]

    back = r.reversed(complement=True)
    head = Reads(f.s, f.q, f.a + at, f.b)
    fw, rv, within = overlaps_forward(head, back, o.overlap, 2), overlaps_reverse(head, back, o.overlap, 2), overlaps_within(head, back, o.overlap, 2)
    total = fw.count + rv.count + within.count
    whole = merged_reads(f, back, at, after, fw, rv, within, o)
    none = Reads(r.s[:, :1], r.q[:, :1], np.zeros(len(r), np.int64), np.zeros(len(r), np.int64))

    def give(who: np.ndarray, what: int, mate1: Reads, mate2: Reads) -> None:
        kind[rows[who]] = what
        one.put(rows[who], mate1.take(who))
        two.put(rows[who], mate2.take(who))

    joined = total == 1
    unsure, short = whole.holds(b"Nn"), whole.size < o.min_length
    give(np.flatnonzero(joined & unsure), AMBIGUOUS, whole, none)
    give(np.flatnonzero(joined & ~unsure & short), SHORT_MERGE, whole, none)
    cut_adapter(whole, OLIGO_FORWARD, o, inside=False)
    cut_adapter(whole, BIND_REVERSE, o)
    give(np.flatnonzero(joined & ~unsure & ~short), MERGED, whole, none)

    f = Reads(f.s, f.q, f.a + after, f.b)
    unsure, short = f.holds(b"N") | r.holds(b"N"), np.minimum(f.size, r.size) < o.min_length
    give(np.flatnonzero(~joined & unsure), AMBIGUOUS, f, r)
    give(np.flatnonzero(~joined & ~unsure & short), SHORT_PAIR, f, r)
    cut_adapter(f, OLIGO_FORWARD, o, inside=False)
    cut_adapter(f, BIND_REVERSE, o)
    cut_adapter(r, BIND_REVERSE, o)
    cut_adapter(r, OLIGO_REVERSE, o, five=True, inside=False)
    cut_adapter(r, BIND, o, five=True)
    give(np.flatnonzero(~joined & ~unsure & ~short & (total > 0)), AMBIGUOUS_MERGE, f, r)
    give(np.flatnonzero(~joined & ~unsure & ~short & (total == 0)), NOT_MERGED, f, r)
    return kind, one, two, barcode.tolist(), both


TRIMMED = "pair_id long, name string, type int, seq1 string, qual1 string, seq2 string, qual2 string, bc string, both_bound boolean"
_TRIMMED = [c.split()[0] for c in TRIMMED.split(", ")]


def trimmed_batch(batch: pa.RecordBatch, o: TrimOptions) -> Iterator[pa.RecordBatch]:
    """``TRIMMED`` of a batch, in parts of pairs of like size."""
    size = np.maximum(*(pa.compute.fill_null(pa.compute.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False) for c in ("seq1", "seq2"))) if batch.num_rows else np.zeros(0, np.int64)
    order = np.argsort(size, kind="stable")
    k = 0
    while k < len(order):
        n = 1
        while k + 2 * n <= len(order) and 2 * n * (size[order[k + 2 * n - 1]] + 1) <= CELLS:
            n *= 2
        rows = order[k : k + n]
        k += n
        one, two = (Reads.of(batch.column(f"seq{m}"), batch.column(f"qual{m}"), rows) for m in (1, 2))
        kind, a, b, barcode, both = process(one, two, o)
        at = pa.array(rows)
        columns = [batch.column("pair_id").take(at), batch.column("name").take(at), pa.array(kind, pa.int32()), *a.texts(), *b.texts(), pa.array(barcode, pa.string()), pa.array(both)]
        yield pa.RecordBatch.from_arrays(columns, _TRIMMED)


def trim(pairs: DataFrame, o: TrimOptions | None = None) -> DataFrame:
    """``TRIMMED`` of pairs (pair_id, name, seq1, qual1, seq2, qual2)."""
    o = o or TrimOptions()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from trimmed_batch(batch, o)

    columns = [F.col("pair_id").cast("long"), *map(F.col, ("name", "seq1", "qual1", "seq2", "qual2"))]
    return pairs.select(*columns).mapInArrow(run, TRIMMED)


def fastq_lines(trimmed: DataFrame) -> DataFrame:
    """(pair_id, mate, value): FASTQ records of the written classes."""
    kept = trimmed.filter(F.col("type").isin(*WRITTEN))
    tagged = F.when(F.col("type") != NO_BINDING, F.concat(F.lit("\tBC:Z:"), F.when(F.col("bc") == "", "*").otherwise(F.col("bc")), F.lit("\tYD:i:"), F.col("both_bound").cast("int").cast("string"))).otherwise("")

    def record(mate: int) -> Column:
        name = F.concat(F.lit("@"), F.col("name"), F.when(F.col("type") == MERGED, "").otherwise(f"/{mate}"), F.lit(" YT:i:"), F.col("type").cast("string"), tagged)
        return F.struct(F.lit(mate).alias("mate"), F.col(f"seq{mate}").alias("seq"), F.concat_ws("\n", name, f"seq{mate}", F.lit("+"), f"qual{mate}").alias("value"))

    return kept.select("pair_id", F.explode(F.array(record(1), record(2))).alias("r")).filter(F.length("r.seq") > 0).select("pair_id", "r.mate", "r.value")
