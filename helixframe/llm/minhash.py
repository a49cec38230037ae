"""Near-duplicate texts: SuperMinHash signatures, banding, verification, components.

Plan, for any number of documents:

1. one Arrow pass per document: distinct word shingles, their SuperMinHash
   signature, and a 64-bit hash of each band of it;
2. documents with equal shingle sets fold into one class (map-side combine),
   so a group of copies costs one row from here on; a class has a number of its
   own, and its text is that of the row with its least id;
3. per (band, hash) bucket the least and the greatest class become its leaders,
   by aggregation, and each member is paired with these two only;
4. pairs are verified on the full shingle sets, verified links are unioned;
5. a bucket whose members now lie in one component is done. In the others the
   pairs across components are still open: those of small components whose
   sizes and signature sketches allow a link are verified, as pairs in a bucket
   of up to ``CROWDED`` members, and in blocks that return only links in a larger
   one, each pair in the first bucket that it shares; and whoever shares a
   bucket with a large component is compared with all its members, in blocks too.

Nothing is capped or sampled, and no bucket needs a second one. A pair at a
similarity of 0.8 shares none of 32 bands of 5 rows with a probability of 3e-6;
the sketch adds 4e-12 to that.

Defined cases: null, empty or blank text has no shingle, and is linked with
nothing; a text shorter than a shingle has its whole word sequence as the one
shingle; repeated rows give repeated results; an id may repeat with other texts:
its rows are judged each by its own text, and all rows with the least id of their
group are kept; a row without an id links like any other, and is kept, with a
null component, only if no row of its group has an id; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, measured, shuffles_deleted
from ._graph import components
from ._text import U64, mix, shingle_sets, slices, utf8

_ROUND = U64(0xA0761D6478BD642F)
_BAND = mix(np.arange(1, 257, dtype=np.uint64)) | U64(1)
#: What tells rows apart as far as it matters: the id and 128 bits of a hash of the text.
ROW = ["doc", "t1", "t2"]
#: Members of a bucket whose pairs are made by a join.
CROWDED = 128
#: Rows of a block without texts, and shingles of a block with texts.
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 1_000_000
#: Components from this size are asked as a whole.
LARGE = 16
#: Open pairs agree in at least this share of their 4-bit sketch cells. At a
#: similarity of 0.8 the expected share is 0.81, 6.8 standard deviations above.
AGREE = 0.6


def superminhash(elements: np.ndarray, offsets: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures (Ertl 2017), one row of ``m`` values per set.

    In round ``j`` each element draws a fraction and the ``j``-th place of its
    own random permutation; the value ``j + fraction`` competes for that place.
    As values of later rounds are larger, a set is finished once each place is
    taken: large sets stop after a few rounds. Values are (j << 32 | fraction).
    ``m`` is at most 256; an empty set keeps the largest value in each place.
    """
    n = len(offsets) - 1
    sig = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    x, perm = elements, None
    for j in range(m):
        if not len(x):
            break
        z = mix(x + U64(int(_ROUND) * (j + 1) % 2**64))
        draw = z & U64(0xFFFFFFFF)
        k = j + (((z >> U64(32)) * U64(m - j)) >> U64(32)).astype(np.int64)
        if perm is None:
            place = k
        else:
            rows = np.arange(len(x))
            place = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
        np.minimum.at(sig, doc * m + place, (U64(j) << U64(32)) | draw)
        done = sig.reshape(n, m).max(axis=1) < (U64(j + 1) << U64(32))
        left = ~done[doc]
        if not left.any():
            break
        if perm is None:
            first = k[left]
            perm = np.tile(np.arange(m, dtype=np.uint8), (len(first), 1))
            perm[np.arange(len(first)), first] = 0
            x, doc = x[left], doc[left]
        elif left.sum() < 0.8 * len(x):
            x, doc, perm = x[left], doc[left], perm[left]
    return sig.reshape(n, m)


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit hash for each band of consecutive signature places."""
    cells = sig.reshape(len(sig), bands, rows)
    return mix((cells * _BAND[:rows]).sum(axis=2, dtype=np.uint64)).view(np.int64)


def sketch(sig: np.ndarray) -> np.ndarray:
    """Four bits of each signature value, sixteen to a signed 64-bit word."""
    n, m = sig.shape
    cells = np.zeros((n, -(-m // 16) * 16), np.uint64)
    cells[:, :m] = mix(sig) >> U64(60)
    return (cells.reshape(n, -1, 16) << (np.arange(16, dtype=np.uint64) * U64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)


def _lists(cells: np.ndarray) -> pa.ListArray:
    n, w = cells.shape
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * w, pa.array(cells.reshape(-1)))


def _signed(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = utf8(batch.column("text"))
            for a, b in slices(off, 2_000_000):
                sets, at = shingle_sets(buf[off[a] : off[b]], off[a : b + 1] - off[a], shingle)
                sig = superminhash(sets, at, bands * rows)
                # two independent 64-bit sums over the set stand for the set itself
                sums = []
                for z in (mix(sets ^ _ROUND), mix(sets + _ROUND)):
                    s = np.zeros(len(sets) + 1, np.uint64)
                    np.cumsum(z, out=s[1:])
                    sums.append((s[at[1:]] - s[at[:-1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in ROW), pa.array(np.diff(at)), pa.array(sums[0]), pa.array(sums[1]), _lists(band_hashes(sig, bands, rows)), _lists(sketch(sig))],
                    [*ROW, "n", "f1", "f2", "bands", "sketch"],
                )

    return run


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc, t1, t2, n, f1, f2, bands, sketch) of each row of (doc, text, t1, t2)."""
    return docs.mapInArrow(_signed(shingle, bands, rows), "doc long, t1 long, t2 long, n long, f1 long, f2 long, bands array<long>, sketch array<long>")


def _linked(p: np.ndarray, q: np.ndarray, num: int, den: int) -> bool:
    if den * min(len(p), len(q)) < num * max(len(p), len(q)):
        return False
    both = np.concatenate((p, q))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return den * common >= num * (len(p) + len(q) - common)


class _Postings:
    """Which rows of a block hold a shingle: exact overlaps of one set with all rows at once."""

    def __init__(self, flat: np.ndarray, at: np.ndarray):
        order = np.argsort(flat, kind="stable")
        self.values, self.owner, self.n = flat[order], np.repeat(np.arange(len(at) - 1), np.diff(at))[order], np.diff(at)

    def linked(self, mine: np.ndarray, num: int, den: int) -> np.ndarray:
        """Whether each row is linked with a set."""
        first, last = np.searchsorted(self.values, mine, "left"), np.searchsorted(self.values, mine, "right")
        size = last - first
        held = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        common = np.bincount(self.owner[held], minlength=len(self.n))
        return (den * common >= num * (self.n + len(mine) - common)) & (common > 0)


def _compared(shingle: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ba, oa), (bb, ob) = utf8(batch.column("ta")), utf8(batch.column("tb"))
            ok = np.zeros(batch.num_rows, bool)
            for a, b in slices(oa + ob):
                sa, pa_ = shingle_sets(ba[oa[a] : oa[b]], oa[a : b + 1] - oa[a], shingle)
                sb, pb = shingle_sets(bb[ob[a] : ob[b]], ob[a : b + 1] - ob[a], shingle)
                for r in range(b - a):
                    ok[a + r] = _linked(sa[pa_[r] : pa_[r + 1]], sb[pb[r] : pb[r + 1]], num, den)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    return run


class Texts:
    """The texts of classes: ``docs`` (doc, t1, t2, text) and the row that stands for a class, (id, doc, t1, t2)."""

    def __init__(self, docs: DataFrame, rows: DataFrame):
        self.docs, self.rows = docs, rows

    def of(self, ids: DataFrame) -> DataFrame:
        """(id, text) of the classes asked for; texts of others are not shuffled if these are few."""
        asked, seen = measured(self.rows.join(ids.distinct(), "id").withColumnsRenamed({c: f"{c}_" for c in ROW}))
        asked = F.broadcast(asked) if seen["n"] <= BROADCAST_ROWS else asked
        same = (F.col("t1") == F.col("t1_")) & (F.col("t2") == F.col("t2_")) & F.col("doc").eqNullSafe(F.col("doc_"))
        # rows that repeat in full meet here
        return self.docs.join(asked, same).select("id", "text").dropDuplicates(["id"])


def verified(pairs: DataFrame, texts: Texts, shingle: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) with ``den * |A & B| >= num * |A | B|`` on the full shingle sets."""
    texts = texts.of(pairs.select(F.explode(F.array("a", "b")).alias("id")))
    sided = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    sided = sided.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return sided.mapInArrow(_compared(shingle, num, den), "a long, b long")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)


def _close(words: np.ndarray, one: np.ndarray, cells: int) -> np.ndarray:
    """Which sketches agree with one in the share ``AGREE`` of their cells."""
    z = words ^ one
    z = z | ((z >> 2) & 0x3333333333333333)
    z = z | ((z >> 1) & 0x5555555555555555)
    return np.bitwise_count(z & 0x1111111111111111).sum(axis=1) <= cells * (1 - AGREE)


def _between(cells: int, num: int, den: int, shingle: int | None):
    """One block of askers against one block of a component's members.

    Without texts: (c, id, asks) of those for which sizes and sketches allow a
    link. With texts: a link of each asker that has one, as the members belong
    together already.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids, n, asks, words = group["id"].to_numpy(), group["n"].to_numpy(), group["asks"].to_numpy(zero_copy_only=False), _matrix(group["sketch"])
        one, many = np.flatnonzero(asks), np.flatnonzero(~asks)
        hit, links = np.zeros(len(ids), bool), []
        if shingle is not None:
            flat, at = shingle_sets(*utf8(group["text"]), shingle)
            rows = _Postings(flat, at)
        for i in one:
            if shingle is not None:
                j = many[rows.linked(flat[at[i] : at[i + 1]], num, den)[many]]
                links += [(ids[i], ids[x]) for x in j[:1]]
                continue
            j = many[(den * np.minimum(n[many], n[i]) >= num * np.maximum(n[many], n[i])) & _close(words[many], words[i], cells)]
            hit[i] |= len(j) > 0
            hit[j] = True
        if shingle is None:
            return pa.table({"c": group["c"].filter(hit), "id": ids[hit], "asks": group["asks"].filter(hit)})
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _inside(cells: int, num: int, den: int, shingle: int | None):
    """Open pairs of a crowded bucket, its block ``i`` against its block ``j``; each pair in the first band that it shares.

    Without texts: (key, h, id) of those for which sizes and sketches allow a
    link. With texts: links that hold together what the block's links do.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids, n, own, comp = (group[c].to_numpy() for c in ("id", "n", "own", "comp"))
        words, bands = _matrix(group["sketch"]), _matrix(group["bands"])
        key, i, j = (group[c][0].as_py() for c in ("key", "i", "j"))
        many, hit, links = np.flatnonzero(own == j), np.zeros(len(ids), bool), []
        if shingle is not None:
            flat, at = shingle_sets(*utf8(group["text"]), shingle)
            rows, part = _Postings(flat, at), np.arange(len(ids))
        for x in np.flatnonzero(own == i):
            y = many[many > x] if i == j else many
            if shingle is not None:
                y = y[rows.linked(flat[at[x] : at[x + 1]], num, den)[y] & (part[y] != part[x])]
                for _, k in zip(*np.unique(part[y], return_index=True), strict=True):
                    links.append((ids[x], ids[y[k]]))
                part[np.isin(part, part[y])] = part[x]
                continue
            y = y[(comp[y] != comp[x]) & (den * np.minimum(n[y], n[x]) >= num * np.maximum(n[y], n[x]))]
            y = y[_close(words[y], words[x], cells)]
            y = y[(bands[y] == bands[x]).argmax(axis=1) == key]
            hit[x] |= len(y) > 0
            hit[y] = True
        if shingle is None:
            return group.select(["key", "h", "id"]).filter(hit)
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


#: Rows of some numbers each that are broadcast; a larger table is joined by shuffle.
BROADCAST_ROWS = 100_000


def _sized(rows: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with the sizes of their groups; the rows of one large group meet in a task only where there are too many groups to broadcast."""
    sizes, seen = measured(sizes)
    return rows.join(F.broadcast(sizes) if seen["n"] <= BROADCAST_ROWS else sizes, by)


def _parts(weight: Column, limit: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(weight / limit)).cast("long")


def _in_blocks(rows: DataFrame, weight: Column, limit: int) -> DataFrame:
    """Deal rows of (c, id, asks) into blocks (i of askers, j of members) so that each asker meets each member of its c once."""
    asks = F.col("asks")
    sizes = rows.groupBy("c").agg(F.sum(F.when(asks, weight)).alias("na"), F.sum(F.when(~asks, weight)).alias("nm")).filter("na > 0 and nm > 0")
    rows = _sized(rows, sizes, ["c"]).withColumn("own", F.pmod(F.xxhash64("id"), _parts(F.when(asks, F.col("na")).otherwise(F.col("nm")), limit)))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), _parts(F.when(asks, F.col("nm")).otherwise(F.col("na")), limit) - 1)))
    i, j = F.when(asks, F.col("own")).otherwise(F.col("other")), F.when(asks, F.col("other")).otherwise(F.col("own"))
    return rows.withColumn("i", i).withColumn("j", j).drop("na", "nm", "own", "other")


def _in_triangle(rows: DataFrame, weight: Column, limit: int) -> DataFrame:
    """Deal rows of (key, h, id) into blocks i <= j of their bucket so that all pairs meet once; ``own`` is a row's own block."""
    sizes = rows.groupBy("key", "h").agg(_parts(F.sum(weight), limit).alias("parts"))
    rows = _sized(rows, sizes, ["key", "h"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("parts", "other")


def _differing(x: Column, y: Column) -> Column:
    """Number of 4-bit cells in which two 64-bit words differ."""
    z = x.bitwiseXOR(y)
    z = z.bitwiseOR(F.shiftright(z, 2).bitwiseAND(F.lit(0x3333333333333333)))
    z = z.bitwiseOR(F.shiftright(z, 1).bitwiseAND(F.lit(0x5555555555555555)))
    return F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))


def _open_links(placed: DataFrame, comp: DataFrame, reps: DataFrame, texts: Texts, done: DataFrame, cells: int, shingle: int, num: int, den: int) -> DataFrame:
    """Links across components in buckets (key, h) of (key, h, id, comp); ``done`` pairs were compared before."""
    seen = reps.select("id", "n", "sketch")
    bucket = ["key", "h"]
    spread = placed.groupBy(*bucket).agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 <> c2").select(*bucket)
    large = comp.groupBy("component").agg(F.count("*").alias("members")).filter(F.col("members") >= LARGE).select(F.col("component").alias("comp"), F.lit(True).alias("large"))
    opened = checkpointed(placed.join(spread, bucket).join(large, "comp", "left").withColumn("large", F.coalesce("large", F.lit(False))))

    # small components: pairs whose sizes and sketches allow a link
    small = opened.filter("not large")
    crowd = small.groupBy(*bucket).agg(F.count("*").alias("c")).filter("c > 1")
    small = small.join(crowd, bucket).select(*bucket, "id", "comp", "c")
    left = small.filter(F.col("c") <= CROWDED).drop("c").join(seen, "id")
    right = left.select(*bucket, *[F.col(c).alias(f"{c}_") for c in ("id", "comp", "n", "sketch")])
    differ = F.aggregate(F.zip_with("sketch", "sketch_", _differing), F.lit(0), lambda t, x: t + x)
    near = (F.col("comp") < F.col("comp_")) & (den * F.least("n", "n_") >= num * F.greatest("n", "n_")) & (differ <= F.lit(int(cells * (1 - AGREE))))
    pairs = left.join(right, bucket).filter(near).select(F.least("id", "id_").alias("a"), F.greatest("id", "id_").alias("b")).distinct()
    pairs, some = measured(pairs.join(done, ["a", "b"], "left_anti"))
    found = [checkpointed(verified(pairs, texts, shingle, num, den))] if some["n"] else []

    # crowded buckets of small components, in blocks
    told = small.filter(F.col("c") > CROWDED).drop("c").join(reps.select("id", "n", "sketch", "bands"), "id")
    grouped = [*bucket, "i", "j"]
    hits = _in_triangle(told, F.lit(1), BLOCK_ROWS).groupBy(*grouped).applyInArrow(_inside(cells, num, den, None), "key int, h long, id long").distinct()
    told, some = measured(told.join(hits, [*bucket, "id"], "left_semi"))
    if some["n"]:
        told = _in_triangle(told, F.col("n"), BLOCK_SHINGLES).join(texts.of(told.select("id")), "id")
        found.append(checkpointed(told.groupBy(*grouped).applyInArrow(_inside(cells, num, den, shingle), "a long, b long")))

    # large components: who shares a bucket with one asks all its members, in blocks
    held = opened.filter("large").select(*bucket, F.col("comp").alias("c")).distinct()
    asks = opened.join(held, bucket).filter((F.col("comp") != F.col("c")) & (~F.col("large") | (F.col("comp") < F.col("c")))).select("c", "id", F.lit(True).alias("asks")).distinct()
    asked = asks.select("c").distinct()
    members = comp.join(asked, comp["component"] == asked["c"], "left_semi").select(F.col("component").alias("c"), F.col("node").alias("id"), F.lit(False).alias("asks"))
    meeting = checkpointed(asks.unionByName(members).join(seen, "id"))
    hits = _in_blocks(meeting, F.lit(1), BLOCK_ROWS).groupBy("c", "i", "j").applyInArrow(_between(cells, num, den, None), "c long, id long, asks boolean").distinct()
    meeting, some = measured(hits.join(seen, "id"))
    if some["n"]:
        meeting = _in_blocks(meeting, F.col("n"), BLOCK_SHINGLES).join(texts.of(meeting.select("id")), "id")
        found.append(checkpointed(meeting.groupBy("c", "i", "j").applyInArrow(_between(cells, num, den, shingle), "a long, b long")))
    out = placed.sparkSession.createDataFrame([], "a long, b long")
    for links in found:
        out = out.unionByName(links)
    return out


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100, bands: int = 32, rows: int = 5
) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row; ids are integers.

    ``num / den`` is the least Jaccard similarity of linked word-shingle sets;
    ``component_id`` is the least id that links lead to, ``kept`` whether it is
    the row's own.
    """
    found = grouped(df, id_col, text_col, shingle, num, den, bands, rows)
    kept = F.coalesce(F.col("component_id") == F.col("doc"), F.col("component_id").isNull())
    return found.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def text_hash(text: str | Column) -> dict[str, Column]:
    """The two 64-bit hashes, t1 and t2, that tell texts apart."""
    text = F.col(text) if isinstance(text, str) else text
    return {"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(1), text, F.lit(1))}


def grouped(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100, bands: int = 32, rows: int = 5
) -> DataFrame:
    """(doc, t1, t2, n, component_id, group) of each row; ``group`` numbers near-duplicates, and is null without a shingle."""
    with shuffles_deleted(df.sparkSession):
        return _grouped(df, id_col, text_col, shingle, num, den, bands, rows)


def _grouped(df: DataFrame, id_col: str, text_col: str, shingle: int, num: int, den: int, bands: int, rows: int) -> DataFrame:
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).withColumns(text_hash("text"))
    signed = checkpointed(signatures(docs, shingle, bands, rows))
    shape = ["f1", "f2", "n"]
    # the row with the least id stands for its class, one without an id if there is no other
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), *ROW)).alias("row")
    classes = checkpointed(signed.filter("n > 0").groupBy(*shape).agg(first).select(*shape, "row.doc", "row.t1", "row.t2", F.monotonically_increasing_id().alias("id")))
    texts = Texts(docs, classes.select("id", *ROW))
    mine = classes.withColumnsRenamed({c: f"{c}_" for c in [*shape, *ROW]})
    same = [F.col(c) == F.col(f"{c}_") for c in [*shape, "t1", "t2"]] + [F.col("doc").eqNullSafe(F.col("doc_"))]
    reps = checkpointed(signed.join(mine, same).select("id", "n", "bands", "sketch").dropDuplicates(["id"]))
    slim = reps.select("id", F.posexplode("bands").alias("key", "h"))
    lead = slim.groupBy("key", "h").agg(F.count("*").alias("c"), F.min("id").alias("lo"), F.max("id").alias("hi")).filter("c > 1").drop("c")
    # only rows in company: (key, h, id, lo, hi)
    held = checkpointed(slim.join(lead, ["key", "h"]))
    pairs = held.select("id", F.explode(F.array("lo", "hi")).alias("o"))
    pairs = checkpointed(pairs.select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")).filter("a < b").distinct())
    links = checkpointed(verified(pairs, texts, shingle, num, den).distinct())
    comp = components(links, "a", "b")
    placed = held.join(comp, held["id"] == comp["node"], "left").select("key", "h", "id", F.coalesce("component", "id").alias("comp"))
    more, some = measured(_open_links(placed, comp, reps, texts, pairs, bands * rows, shingle, num, den).distinct())
    comp = components(links.unionByName(more), "a", "b") if some["n"] else comp
    # a component is named by the least id in it, which is that of one of its classes
    whose = comp.join(classes.select(F.col("id").alias("node"), "doc"), "node")
    least = whose.groupBy("component").agg(F.min("doc").alias("least"))
    named = classes.join(comp, classes["id"] == comp["node"], "left").join(least, "component", "left")
    named = named.select(*shape, F.when(F.col("component").isNull(), F.col("doc")).otherwise(F.col("least")).alias("least"), F.coalesce("component", "id").alias("group"))
    out = signed.select(*ROW, *shape).join(named, shape, "left")
    return out.select(*ROW, "n", F.when(F.col("group").isNull(), F.col("doc")).otherwise(F.col("least")).alias("component_id"), "group")
