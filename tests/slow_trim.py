"""Trimming pair by pair and letter by letter: the slow form that the batches of the library are held against."""

from __future__ import annotations

from dataclasses import dataclass

from helixframe.operators.trim import (
    ADAPTER1, ADAPTER2, AMBIGUOUS, AMBIGUOUS_MERGE, BIND, BIND_REVERSE, CHIMERA, MANY_BINDING, MERGED, NO_BINDING, NOT_MERGED, OLIGO_FORWARD, OLIGO_REVERSE, POST_PROMOTER, PROMOTER, SHORT, SHORT_MERGE, SHORT_PAIR, TrimOptions,
)

_HIGH = ord("5")  # phred 20
_PAIRING = str.maketrans("ACGTUMRWSYKVHDBNacgtumrwsykvhdbn", "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn")


@dataclass
class Read:
    seq: str
    qual: str

    def __len__(self) -> int:
        return len(self.seq)

    def __getitem__(self, s: slice) -> Read:
        return Read(self.seq[s], self.qual[s])


def reverse_complement(seq: str) -> str:
    return seq.translate(_PAIRING)[::-1]


def _starts(text: str, pattern: str, mistakes: int) -> list[int]:
    """Where a pattern may start with so many mismatches at most: one of ``mistakes + 1`` parts of it occurs unchanged."""
    found, parts = set(), mistakes + 1
    for j in range(parts):
        a, b = len(pattern) * j // parts, len(pattern) * (j + 1) // parts
        at = text.find(pattern[a:b], a)
        while at >= 0:
            found.add(at - a)
            at = text.find(pattern[a:b], at + 1)
    return sorted(x for x in found if x <= len(text) - len(pattern))


def motif_hits(seq: str, motif: str, most: int) -> list[int]:
    """Starts of the first ``most`` windows of ACGT within one mismatch of the motif."""
    up, hits = seq.upper().replace("U", "T"), []
    for i in _starts(up, motif, 1):
        wrong = [a for a, b in zip(up[i : i + len(motif)], motif, strict=True) if a != b]
        if len(wrong) < 2 and all(a in "ACGT" for a in wrong):
            hits.append(i)
    return hits[:most]


def extension(a: str, b: str, qa: str, qb: str | None, least: int, allowed: int) -> int:
    """Length of the ungapped match of two starts: mismatches cost 3 between good bases, else 1, up to ``allowed`` in ``least`` bases and in proportion beyond."""
    spent = 0
    for i, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            good = ord(qa[i]) >= _HIGH and (qb is None or ord(qb[i]) >= _HIGH)
            spent += 3 if good else 1
            if spent * max(least, 1) > max(i, least) * allowed if i > least else spent > allowed:
                return i
    return min(len(a), len(b))


def _mistakes(r: Read, q: str | None, allowed: int) -> int:
    """Mismatches that the penalty allowed leaves room for: good bases cost three."""
    good = bool(r.qual) and min(r.qual) >= "5" and (not q or min(q) >= "5")
    return allowed // 3 if good else allowed


def overlaps_forward(r: Read, s: str, q: str | None, rule: tuple[int, int], most: int) -> list[tuple[int, int]]:
    """(start in ``r``, length) where a tail of ``r`` matches the head of ``s``, or ``s`` lies inside; shortest tail first."""
    out = []
    if len(s) < rule[0]:
        return out
    for at in reversed(_starts(r.seq, s[: rule[0]], _mistakes(r, q, rule[1]))):
        m = extension(r.seq[at:], s, r.qual[at:], q, *rule)
        if m >= rule[0] and m in (len(r) - at, len(s)):
            out.append((at, m))
            if len(out) == most:
                break
    return out


def overlaps_reverse(r: Read, s: str, q: str | None, rule: tuple[int, int], most: int) -> list[tuple[int, int]]:
    """(bases of ``r`` after the match, length) where a head of ``r`` matches the tail of ``s``; shortest head first."""
    back = Read(r.seq[::-1], r.qual[::-1])
    return overlaps_forward(back, s[::-1], q and q[::-1], rule, most)


def overlaps_within(r: Read, s: str, q: str, rule: tuple[int, int], most: int) -> list[int]:
    """Starts in ``s``, beyond its first base, where all of ``r`` matches."""
    out = []
    for at in _starts(s, r.seq, _mistakes(r, q, rule[1])) if len(r) > rule[1] else range(len(s)):
        if 0 < at < len(s) - len(r) and extension(r.seq, s[at:], r.qual, q[at:], len(r), rule[1]) == len(r):
            out.append(at)
            if len(out) == most:
                break
    return out


def cut_adapter(r: Read, adapter: str, o: TrimOptions, five: bool = False, inside: bool = True) -> Read:
    """Cut at the longest match of an adapter; one no longer than the least length only loses its quality."""
    hits = (overlaps_reverse if five else overlaps_forward)(r, adapter, None, o.adapter, 4)
    if not hits or not inside and all(sum(h) != len(r) for h in (hits[0], hits[-1])):
        return r
    n = len(r) - hits[-1][0]
    if n > o.adapter[0]:
        return r[n:] if five else r[: len(r) - n]
    low = chr(34) * n
    return Read(r.seq, low + r.qual[n:] if five else r.qual[: len(r) - n] + low)


def merge_base(f: str, fq: str, r: str, rq: str, most: int = 50) -> tuple[str, str]:
    """Consensus of two reads of a base: agreement adds half of the lower quality, else the better base keeps the difference."""
    a, b = ord(fq) - 33, ord(rq) - 33
    if f == r:
        return f.upper(), chr(33 + min(most, max(a, b) + min(a, b) // 2))
    return (f.upper(), chr(33 + a - b)) if a > b else (r.upper(), chr(33 + b - a))


def _joined(f: Read, r: Read, o: TrimOptions) -> Read:
    bases = [merge_base(*x, o.max_quality) for x in zip(f.seq, f.qual, r.seq, r.qual, strict=True)]
    return Read("".join(b for b, _ in bases), "".join(q for _, q in bases))


def _plus(*parts: Read) -> Read:
    return Read("".join(p.seq for p in parts), "".join(p.qual for p in parts))


def _merged(f: Read, back: Read, at: int, after: int, fw: list, rv: list, inside: list, o: TrimOptions) -> Read:
    """The fragment from behind the motif: ``f`` up to the overlap, the overlap's consensus, then the longer read's rest."""
    if fw:
        start, n = at + fw[0][0], fw[0][1]
        skip = max(0, after - start)
        rest = back[n:] if n < len(back) else f[at + n :]
        return _plus(f[after:start] if after < start else f[:0], _joined(f[start + skip : start + n], back[skip:n], o) if skip < n else f[:0], rest)
    if rv:
        end = len(f) - rv[0][0]
        start = end - rv[0][1]
        n = rv[0][1] if after < start else end - after
        return _plus(f[after:start] if after < start else f[:0], _joined(f[end - n : end], back[len(back) - n :], o) if n > 0 else f[:0])
    shift = inside[0] - at
    return _joined(f[after:], back[after + shift : len(f) + shift], o)


def process(one: Read, two: Read, o: TrimOptions) -> tuple[int, Read, Read, str | None, bool]:
    """(class, mate 1, mate 2, barcode, both mates bound) of one pair."""
    mates = []
    for r, adapter in ((one, ADAPTER1), (two, ADAPTER2)):
        r = r[: len(r.seq.rstrip("N"))]
        mates.append(cut_adapter(r[len(r) - len(r.seq.lstrip("N")) :], adapter, o))
    hits = [motif_hits(r.seq, BIND, 3) for r in mates]
    both = False
    if min(map(len, mates)) < o.min_length:
        return SHORT, *mates, None, both
    if not any(hits):
        for i in (0, 1):
            r = cut_adapter(cut_adapter(mates[i], OLIGO_FORWARD, o, inside=False), BIND_REVERSE, o)
            mates[i] = cut_adapter(cut_adapter(r, OLIGO_REVERSE, o, five=True, inside=False), BIND, o, five=True)
        return NO_BINDING, *mates, None, both
    if max(map(len, hits)) == 3:
        return MANY_BINDING, *mates, None, both

    def promoter(r: Read, at: int) -> int:
        return extension(r.seq[:at][::-1], PROMOTER[::-1], r.qual[:at][::-1], None, *o.promoter)

    if all(hits):
        both, found = True, []
        for r, h in zip(mates, hits, strict=True):
            n = promoter(r, h[-1])
            found.append(n if n in (h[-1], len(PROMOTER)) and n >= o.promoter[0] else 0)
        if not any(found):
            return CHIMERA, *mates, None, both
        w = 1 if found[1] > found[0] else 0
        mates[w] = mates[w][hits[w][-1] + len(BIND) :]
        hits[w] = []
    bound = 0 if hits[0] else 1
    f, r, at = mates[bound], mates[1 - bound], hits[bound][-1]
    after = at + len(BIND)
    barcode = "*" if promoter(f, at) >= o.promoter[0] else f.seq[max(0, at - o.barcode) : at]
    if motif_hits(f.seq[after:], PROMOTER, 1):
        return POST_PROMOTER, *mates, barcode, both
    back = Read(reverse_complement(r.seq), r.qual[::-1])
    head = f[at:]
    fw, rv = (find(head, back.seq, back.qual, o.overlap, 2) for find in (overlaps_forward, overlaps_reverse))
    inside = overlaps_within(head, back.seq, back.qual, o.overlap, 2)
    count = len(fw) + len(rv) + len(inside)
    if count == 1:
        whole = _merged(f, back, at, after, fw, rv, inside, o)
        if "N" in whole.seq.upper():
            return AMBIGUOUS, whole, r[:0], barcode, both
        if len(whole) < o.min_length:
            return SHORT_MERGE, whole, r[:0], barcode, both
        return MERGED, cut_adapter(cut_adapter(whole, OLIGO_FORWARD, o, inside=False), BIND_REVERSE, o), r[:0], barcode, both
    f = f[after:]
    if "N" in f.seq or "N" in r.seq:
        return AMBIGUOUS, f, r, barcode, both
    if min(len(f), len(r)) < o.min_length:
        return SHORT_PAIR, f, r, barcode, both
    f = cut_adapter(cut_adapter(f, OLIGO_FORWARD, o, inside=False), BIND_REVERSE, o)
    r = cut_adapter(cut_adapter(r, BIND_REVERSE, o), OLIGO_REVERSE, o, five=True, inside=False)
    return AMBIGUOUS_MERGE if count else NOT_MERGED, f, cut_adapter(r, BIND, o, five=True), barcode, both
