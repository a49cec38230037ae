"""Hierarchical language identification: family first, then one-versus-one linear SVMs inside it.

Features are hashed byte 3- and 4-grams of the whole lower-cased text, with
everything but letters as spaces, as shares of the text's n-grams. Both stages
are linear in them, so a text is scored by one gather and one segmented sum
over its bytes; no text is cut and no vector is built.

Both decisions are between known languages. Whether a text is in one at all is
told by its evidence, the mean log share of its n-grams in the language's
training texts: ``sure`` holds where it is at least half way from what the most
similar other language reaches to what the language's own texts do, less what
chance takes off a text of so few n-grams. With one known language it always holds.

Training takes a bounded sample: about ``PER_LANG`` labelled rows a language,
drawn by a hash of the id and so the same in each run. It is fitted in one task.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
rows without a language or an id are never learned from; with one language,
that one is predicted; with none, all is ``und``; a text of any length is scored
whole, with some dozens of bytes of memory for each of its own; repeated rows
give repeated results; other columns pass through or are ignored, whatever their
names. One weight vector a family and a pair of languages of one family goes to
the driver, so the number of languages has to be bounded (a few hundred).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import checkpointed
from ._text import U64, slices, utf8

DIM = 1 << 12
PER_LANG = 300
UND = "und"
#: Standard deviations of a text's mean evidence that chance is granted.
SLACK = 6.0

# ISO 639-1 codes by family. Any other code is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "semitic": ["am", "ar", "he", "mt"],
}

_KEEP = np.arange(256, dtype=np.uint8)
_KEEP[:128] = 0x20
for _a, _z in ((65, 91), (97, 123)):
    _KEEP[_a:_z] = np.arange(97, 123)


def _grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of the 3- and 4-grams of all rows, in byte order."""
    b = _KEEP[buf]
    if len(b) > 1:  # capital Latin-1 letters in UTF-8
        second = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        b[1:][second] += 0x20
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    n = len(b)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = b.astype(np.uint64)
    three = (x[:-2] << U64(16)) | (x[1:-1] << U64(8)) | x[2:]
    whole = (row[:-2] == row[2:]) & (three != U64(0x202020))
    four = (three[:-1] << U64(8)) | x[3:]
    whole4 = (row[:-3] == row[3:]) & (four != U64(0x20202020))
    mult, shift = U64(0x9E3779B97F4A7C15), U64(64 - DIM.bit_length() + 1)
    buckets, rows = [], []
    for g, ok, salt in ((three, whole, U64(1) << U64(40)), (four, whole4, U64(1) << U64(41))):
        buckets.append((((g[ok] | salt) * mult) >> shift).astype(np.int64))
        rows.append(row[: len(g)][ok])
    return np.concatenate(buckets), np.concatenate(rows)


def _shares(texts: pa.ChunkedArray) -> np.ndarray:
    buf, off = utf8(texts)
    out = np.zeros((len(off) - 1, DIM), np.float32)
    for a, b in slices(off, 1_000_000):
        g, r = _grams(buf[off[a] : off[b]], off[a : b + 1] - off[a])
        out[a:b] = np.bincount(r * DIM + g, minlength=(b - a) * DIM).reshape(b - a, DIM)
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 80) -> np.ndarray:
    """Squared-hinge linear SVM by accelerated gradient; ``y`` is +1 or -1. Classes weigh alike."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32) * c * 100
    v = np.random.default_rng(0).standard_normal(x.shape[1]).astype(np.float32)
    for _ in range(12):
        v = x.T @ (weight * (x @ v))
        top = float(np.linalg.norm(v))
        v /= top or 1
    rate = 1 / (1 + 2 * top)
    w = z = np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        short = np.maximum(0, 1 - y * (x @ z))
        new = z - rate * (z - 2 * (x.T @ (weight * y * short)))
        w, z = new, new + (k / (k + 3)) * (new - w)
    return w


def _family(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def fit_table(group: pa.Table) -> pa.Table:
    """All stages from a sample of (text, lang): rows (kind, a, b, w); w ends with the bias."""
    lang = np.array(group["lang"].to_pylist(), object)
    langs = sorted(set(lang))
    x = _shares(group["text"])
    scale = 1 / (x.std(axis=0) + 1e-4)
    x = np.hstack([x * scale, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    x[:, :-1] /= np.sqrt(DIM)
    families = {}
    for one in langs:
        families.setdefault(_family(one), []).append(one)
    rows = [("lang", f, one, [0.0]) for f, own in families.items() for one in own]

    def add(kind: str, a: str, b: str, pick: np.ndarray, y: np.ndarray) -> None:
        w = linear_svm(x[pick], y[pick].astype(np.float32)).astype(np.float64)
        rows.append((kind, a, b, [*(w[:-1] * scale / np.sqrt(DIM)).tolist(), float(w[-1])]))

    if len(families) > 1:
        for f, own in families.items():
            add("family", f, "", np.ones(len(x), bool), np.where(np.isin(lang, own), 1, -1))
    for f, own in families.items():
        for a, b in combinations(own, 2):
            add("pair", a, b, np.isin(lang, [a, b]), np.where(lang == a, 1, -1))
    shares = _shares(group["text"])
    logs = {one: np.log((shares[lang == one].sum(axis=0) + 1e-3) / (shares[lang == one].sum() + 1e-3 * DIM)) for one in langs}
    for one, log in logs.items():
        seen = shares @ log
        own, other = seen[lang == one].mean(), max((seen[lang == x].mean() for x in langs if x != one), default=-np.inf)
        spread = np.sqrt(max(0.0, float((shares[lang == one].mean(axis=0) * (log - own) ** 2).sum())))
        rows.append(("evidence", one, "", [*map(float, log), 0.0]))
        rows.append(("limit", one, "", [float((own + other) / 2) if np.isfinite(other) else -1e300, float(spread)]))
    columns = list(zip(*rows, strict=True))
    kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.float64()))
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["kind", "a", "b", "w"])


class Model:
    """The fitted stages, small enough for a closure: one weight vector a family and a pair."""

    def __init__(self, rows: list[tuple[str, str, str, list[float]]]):
        self.families: dict[str, list[str]] = {}
        self.heads: list[tuple[str, str, str]] = []
        weights = []
        self.logs: dict[str, np.ndarray] = {}
        self.limits: dict[str, tuple[float, float]] = {}
        for kind, a, b, w in rows:
            if kind == "lang":
                self.families.setdefault(a, []).append(b)
            elif kind == "evidence":
                self.logs[a] = np.array(w[:-1])
            elif kind == "limit":
                self.limits[a] = (w[0], w[1])
            else:
                self.heads.append((kind, a, b))
                weights.append(w)
        self.w = np.array(weights, np.float64).reshape(len(weights), -1)[:, :-1].astype(np.float32).T.copy() if weights else np.zeros((DIM, 0), np.float32)
        self.bias = np.array([w[-1] for w in weights])

    def margins(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        g, r = _grams(buf, off)
        n = len(off) - 1
        count = np.maximum(np.bincount(r, minlength=n), 1)
        return np.stack([np.bincount(r, weights=self.w[:, k][g], minlength=n) / count + self.bias[k] for k in range(len(self.heads))] or [np.zeros(n)], axis=1)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text."""
        buf, off = utf8(texts)
        n = len(off) - 1
        names, scores = np.full(n, UND, object), np.zeros(n)
        if not self.families:
            return names.tolist(), scores
        parts = [self.margins(buf[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in slices(off, 1_000_000)]
        m = np.concatenate(parts) if parts else np.zeros((0, max(1, len(self.heads))))
        family = list(self.families)
        at = {h: k for k, h in enumerate(self.heads)}
        fm = np.stack([m[:, at["family", f, ""]] for f in family], axis=1) if len(family) > 1 else np.zeros((n, 1))
        best, sure = fm.argmax(axis=1), _softmax(fm)
        for k, f in enumerate(family):
            rows, own = np.flatnonzero(best == k), self.families[f]
            votes, total = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
            for i, j in combinations(range(len(own)), 2):
                pair = m[rows, at["pair", own[i], own[j]]]
                for one, side in ((i, pair), (j, -pair)):
                    votes[:, one] += side > 0
                    total[:, one] += side / max(1, len(own) - 1)
            pick = (votes + 1e-3 * np.tanh(total)).argmax(axis=1)
            names[rows] = np.array(own, object)[pick]
            scores[rows] = sure[rows, k] * _softmax(total)[np.arange(len(rows)), pick]
        lacks = np.array([t is None or not any(c.isalpha() for c in t) for t in texts.to_pylist()], bool)
        names[lacks], scores[lacks] = UND, 0.0
        return names.tolist(), scores


    def sure(self, texts: pa.Array, names: list[str]) -> np.ndarray:
        """Whether the evidence of each text for the language predicted is enough; false without one."""
        buf, off = utf8(texts)
        langs = list(self.logs)
        at = np.array([langs.index(x) if x in self.logs else -1 for x in names], np.int64)
        logs = np.stack([self.logs[x] for x in langs] or [np.zeros(DIM)])
        limit, spread = np.array([self.limits[x] for x in langs] or [(0.0, 0.0)]).T
        out = np.zeros(len(names), bool)
        for a, b in slices(off, 1_000_000):
            g, r = _grams(buf[off[a] : off[b]], off[a : b + 1] - off[a])
            own = at[a:b]
            n = np.maximum(1, np.bincount(r, minlength=b - a))
            seen = np.bincount(r, weights=logs[own[r], g], minlength=b - a) / n
            out[a:b] = (own >= 0) & ((seen >= limit[own] - SLACK * spread[own] / np.sqrt(n)) | (np.bincount(r, minlength=b - a) == 0))
        return out


def _softmax(m: np.ndarray, heat: float = 4.0) -> np.ndarray:
    e = np.exp(heat * (m - m.max(axis=1, keepdims=True))) if m.size else m
    return e / e.sum(axis=1, keepdims=True) if m.size else e


def held_out(id_col: str | Column) -> Column:
    """Rows never learned from: crc32 of the id's decimal text, modulo 5, is 0. False for a null id, whose row is not learned from either."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Model:
    """Learn from about ``per_lang`` rows a language that are not held out."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    rows = rows.filter(F.col("id").isNotNull() & ~held_out("id"))
    counts = {r["lang"]: r["c"] for r in rows.groupBy("lang").agg(F.count("*").alias("c")).collect()}
    if not counts:
        return Model([])
    share = F.element_at(F.create_map(*[F.lit(v) for lang, c in counts.items() for v in (lang, min(1.0, per_lang / c))]), F.col("lang"))
    drawn = F.pmod(F.xxhash64(F.col("id"), F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30)
    sample = rows.filter(drawn).select("text", "lang")
    fitted = checkpointed(sample.groupBy(F.lit(1).alias("one")).applyInArrow(_fit_sorted, "kind string, a string, b string, w array<double>"))
    return Model([tuple(r) for r in fitted.collect()])


def _fit_sorted(group: pa.Table) -> pa.Table:
    # rows arrive in any order: floating sums must not depend on it
    return fit_table(group.select(["text", "lang"]).sort_by([("lang", "ascending"), ("text", "ascending")]))


def identify(df: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", sure_out: str | None = None) -> DataFrame:
    """All columns of ``df``, then the predicted language, its score and, if named, whether the text is in it at all (columns of these names are replaced)."""
    more = [lang_out, score_out, *([sure_out] if sure_out else [])]
    df = df.drop(*more)
    names = df.columns
    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, kind) for c, kind in zip(more, kinds, strict=False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                texts = part.column(names.index(text_col))
                lang, score = model.predict(texts)
                found = [pa.array(lang, pa.string()), pa.array(score), *([pa.array(model.sure(texts, lang))] if sure_out else [])]
                yield pa.RecordBatch.from_arrays([*part.columns, *found], [*names, *more])

    return df.mapInArrow(run, schema)
