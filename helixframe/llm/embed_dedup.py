"""Near-duplicate vectors by sorted projection passes.

Each pass gives every vector the signs of random projections as one bit string,
orders all vectors lexicographically by label, bit string and a hash of the id,
and compares each with its next ``WINDOW`` neighbours; verified pairs of all
passes are unioned, each block of rows handing on a forest of its pairs. A pass
costs one range sort and compares a bounded number of pairs a vector, whatever
the number or the sizes of groups. Windows overlap block borders: global ranks
cut the order into blocks, and the last ``WINDOW`` rows of a block also open the
next one.

Vectors of a label that exceeds a window are centred on the mean of its unit
vectors before they are projected, as bits would otherwise tell a common
direction and not the vectors apart. Such a label takes as many passes as hold
the share of lone pairs at the threshold that no pass brings together at
``MISS``, by its size and the length of its mean (``passes_for``); smaller labels
need one pass, which compares all their pairs. Where a label's vectors are so
alike that this asks for more than ``MANY`` passes, and for as many comparisons as
the label has pairs, sorting tells nothing any more: then all its pairs are
compared, in blocks of ``BLOCK`` by ``BLOCK``, so that no label loses a link.

The passes find which vectors belong together. Links are then counted exactly:
inside each component every pair is compared, in blocks of ``BLOCK`` by
``BLOCK``, so no task holds a whole component and only counts are written.
Equal vectors of one label count with their multiplicity.

Defined cases: vectors that are null, empty, zero, hold null or non-finite
components, or differ in length from most, and rows without a label or an id,
link with nothing and are kept; repeated rows link with each other; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, shuffles_deleted
from ._graph import components
from .vptree import doubles, matrix, of_common_length

#: Share of lone pairs at the threshold that no pass brings together, and the passes that a label takes in any case before all its pairs are compared.
MISS, MANY = 1e-3, 64
#: Passes that share one sort; more need fewer jobs and more shuffle space at once.
TOGETHER = 4
WINDOW = 256
BITS = 48
BLOCK, TILE = 4096, 1024
#: Parts of the copies of one vector, and bytes of label means that are broadcast.
SALTS, BROADCAST = 64, 8 << 20
_SLACK = 1e-9


def passes_for(n: int, together: float, least: float, window: int, miss: float = MISS) -> int:
    """Passes for a label of ``n`` vectors whose unit vectors have a mean of squared length ``together``.

    A pair at the threshold has a cosine of ``(least - together) / (1 - together)``
    once centred, and so shares a bit with the probability ``1 - angle / pi``. It is
    compared if it shares the leading bits that leave a window of vectors, and one
    bit to spare. 0 where comparing all pairs costs no more.
    """
    if n <= window:
        return 1
    centred = min(1.0, max(0.0, (least - together) / max(1e-12, 1 - together)))
    meets = (1 - np.arccos(centred) / np.pi) ** (np.log2(n / window) + 1)
    passes = max(1, np.ceil(np.log(miss) / np.log1p(-min(max(meets, 1e-300), 1 - 1e-12))))
    return 0 if passes > MANY and passes * window >= n / 2 else int(passes)


def planes(turn: int, width: int, bits: int = BITS) -> np.ndarray:
    """The random directions of a pass."""
    return np.random.default_rng(1000 + turn).standard_normal((width, bits))


def bit_strings(v: np.ndarray, mean: np.ndarray, turn: int) -> np.ndarray:
    """The signs of a pass as numbers that sort alike."""
    unit = v / np.sqrt((v**2).sum(axis=1))[:, None] - mean
    signs = unit @ planes(turn, v.shape[1]) > 0
    return (signs << np.arange(BITS - 1, -1, -1, dtype=np.int64)).sum(axis=1)


def cosine_links(p: np.ndarray, q: np.ndarray, least: float) -> np.ndarray:
    """Which rows of ``p`` and ``q`` have a cosine of ``least`` or more, in double precision.

    A matrix product decides all but the pairs within rounding of the
    threshold; those are summed component by component.
    """
    np_, nq = np.sqrt((p**2).sum(axis=1)), np.sqrt((q**2).sum(axis=1))
    c = (p @ q.T) / np_[:, None] / nq
    ok = c >= least
    for i, j in zip(*np.nonzero(np.abs(c - least) <= _SLACK), strict=True):
        dot = xx = yy = 0.0
        for a, b in zip(p[i].tolist(), q[j].tolist(), strict=True):
            dot, xx, yy = dot + a * b, xx + a * a, yy + b * b
        ok[i, j] = dot / (np.sqrt(xx) * np.sqrt(yy)) >= least
    return ok


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, n, total) of the unit vectors of a task."""
    held: dict[int, list] = {}

    def emit() -> pa.RecordBatch:
        n, total = zip(*held.values(), strict=True) if held else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(n, pa.int64()), pa.array([t.tolist() for t in total], pa.list_(pa.float64()))], ["label", "n", "total"])

    for batch in batches:
        v, label = matrix(batch.column("v")), batch.column("label").to_numpy()
        if len(v):
            unit = v / np.sqrt((v**2).sum(axis=1))[:, None]
            names, at = np.unique(label, return_inverse=True)
            for k, one in enumerate(names.tolist()):
                rows = unit[at == k]
                n, total = held.get(one, (0, 0.0))
                held[one] = (n + len(rows), total + rows.sum(axis=0))
        if len(held) > 10_000:
            yield emit()
            held.clear()
    yield emit()


def _planned(least: float, window: int):
    """The mean and the passes of one label, from its tasks' sums."""

    def run(group: pa.Table) -> pa.Table:
        n = sum(group["n"].to_pylist())
        mean = np.sort(matrix(group["total"]), axis=0).sum(axis=0) / n
        passes = passes_for(n, float(mean @ mean), least, window)
        return pa.table({"label": group["label"][:1], "n": [n], "mean": pa.array([mean.tolist()], pa.list_(pa.float64())), "passes": [passes]})

    return run


def label_plans(vectors: DataFrame, least: float, window: int) -> DataFrame:
    """(label, n, mean, passes) of the labels of (label, v) that exceed a window."""
    sums = vectors.select("label", "v").mapInArrow(_summed, "label long, n long, total array<double>")
    return sums.groupBy("label").applyInArrow(_planned(least, window), "label long, n long, mean array<double>, passes long").filter(F.col("n") > window)


def _keyed(turns: range):
    """A row for each pass that a vector's label takes, with the pass and its bit string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in turns:
                part = batch.filter(pc.greater(batch.column("passes"), t))
                v = matrix(part.column("v"))
                if not len(v):
                    continue
                key = bit_strings(v, matrix(part.column("mean")), t)
                kept = [part.column(c) for c in ("id", "label", "v")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.full(len(v), t)), pa.array(key)], ["id", "label", "v", "pass", "key"])

    return run


def _windows(least: float, window: int):
    """Compare each row with the next ones of its pass and label; a forest of the links found, at most a link a row."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("rank")
        ids, label, turn, rank = (group[c].to_numpy() for c in ("id", "label", "pass", "rank"))
        v = matrix(group["v"])
        first, second = [], []
        for s in range(0, len(ids), window):
            e = min(len(ids), s + 2 * window)
            ok = cosine_links(v[s : s + window], v[s:e], least)
            ok &= (label[s : s + window, None] == label[s:e]) & (turn[s : s + window, None] == turn[s:e])
            i, j = np.nonzero(ok)
            gap = rank[s + j] - rank[s + i]
            pick = (gap > 0) & (gap <= window)
            first.append(s + i[pick])
            second.append(s + j[pick])
        root = _forest(np.concatenate(first), np.concatenate(second), len(group))
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": ids[moved], "b": ids[root[moved]]})

    return run


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least row of each row's linked set."""
    root = np.arange(n)
    while True:
        least_root = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least_root)
        np.minimum.at(new, j, least_root)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _every_pair(least: float):
    """All pairs of a label's block ``i`` with its block ``j``; a forest of the links found."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids, own, v = group["id"].to_numpy(), group["own"].to_numpy(), matrix(group["v"])
        one, two = (np.flatnonzero(own == group[c][0].as_py()) for c in "ij")
        root = np.arange(len(ids))
        for a in range(0, len(one), TILE):
            for b in range(0, len(two), TILE):
                x, y = np.nonzero(cosine_links(v[one[a : a + TILE]], v[two[b : b + TILE]], least))
                # links of what the tiles before have joined add nothing
                x, y = one[a + x], two[b + y]
                new = root[x] != root[y]
                root = root[_forest(root[x[new]], root[y[new]], len(ids))[root]] if new.any() else root
        root = _forest(np.arange(len(ids)), root, len(ids))
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": ids[moved], "b": ids[root[moved]]})

    return run


def whole_labels(vectors: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that connect what all pairs of the labels of (id, label, v, n) do."""
    parts = F.ceil(F.col("n") / BLOCK).cast("long")
    rows = vectors.select("id", "label", "v", F.pmod(F.xxhash64("id"), parts).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other"))
    rows = rows.select("id", "label", "v", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return rows.groupBy("label", "i", "j").applyInArrow(_every_pair(least), "a long, b long")


def sorted_passes(vectors: DataFrame, turns: range, least: float, window: int) -> DataFrame:
    """Links (a, b) that connect what the passes ``turns`` find over (id, label, v, mean, passes); they share one sort."""
    width = 32 * window
    keyed = vectors.filter(F.col("passes") > turns.start).mapInArrow(_keyed(turns), "id long, label long, v array<double>, pass long, key long")
    keyed = keyed.withColumn("tie", F.xxhash64("id", "pass"))
    parts = max(1, keyed.sparkSession.sparkContext.defaultParallelism)
    order = ["pass", "label", "key", "tie", "id"]
    ranked = checkpointed(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["p"], r["c"]) for r in ranked.groupBy(part.alias("p")).agg(F.count("*").alias("c")).collect())  # one row a partition
    before, total = {}, 0
    for p, c in counts:
        before[p], total = total, total + c
    if not total:
        return vectors.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    start = F.element_at(F.create_map(*[F.lit(x) for p, t in before.items() for x in (p, t)]), part)
    rows = ranked.select("id", "label", "v", "pass", (start + place).alias("rank"))
    block = F.floor(F.col("rank") / width).cast("long")
    borrowed = F.when(F.col("rank") % width >= width - window, F.array(block, block + 1)).otherwise(F.array(block))
    return rows.withColumn("block", F.explode(borrowed)).groupBy("block").applyInArrow(_windows(least, window), "a long, b long")


def _counted(least: float):
    """Links that each member of one block has in another block of its component."""

    def run(group: pa.Table) -> pa.Table:
        left, right = group.filter(group["side"]), group.filter(pc.invert(group["side"]))
        p, q = matrix(left["v"]), matrix(right["v"])
        ids, n = left["id"].to_numpy(), np.zeros(left.num_rows, np.int64)
        label, other, label2, copies = left["label"].to_numpy(), right["id"].to_numpy(), right["label"].to_numpy(), right["copies"].to_numpy()
        for a in range(0, len(p), TILE):
            for b in range(0, len(q), TILE):
                x, y = slice(a, a + TILE), slice(b, b + TILE)
                ok = cosine_links(p[x], q[y], least) & (label[x, None] == label2[y]) & (ids[x, None] != other[y])
                n[x] += ok @ copies[y]
        return pa.table({"id": ids, "n": n})

    return run


def near_duplicates(
    df: DataFrame, least: float = 0.98, window: int = WINDOW, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(id, n_links, component_id, kept) per row; labels and ids are integers."""
    with shuffles_deleted(df.sparkSession):
        return _near_duplicates(df, least, window, id_col, vec_col, label_col)


def _near_duplicates(df: DataFrame, least: float, window: int, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    label = F.when(F.col(id_col).isNotNull(), F.col(label_col).cast("long"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), doubles(vec_col).alias("v"))
    ready = of_common_length(rows.filter("label is not null and v is not null"))
    # the copies of one vector are dealt over parts, then folded: (label, k1, k2) stands for label and vector
    shape = ["label", "k1", "k2"]
    keyed = lambda x: x.select("id", "label", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(7), "v").alias("k2"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("s"))
    parts = checkpointed(keyed(ready).groupBy(*shape, "s").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.any_value("v").alias("v")))
    classes = checkpointed(parts.groupBy(*shape).agg(F.min("rep").alias("id"), F.sum("copies").alias("copies"), F.any_value("v").alias("v")))

    plans = checkpointed(label_plans(classes, least, window))
    about = plans.agg(F.max("passes").alias("most"), F.sum(8 * F.size("mean")).alias("bytes"), F.count_if(F.col("passes") == 0).alias("whole")).first()
    plans = F.broadcast(plans) if (about["bytes"] or 0) <= BROADCAST else plans
    vectors = classes.select("id", "label", "v").join(plans.select("label", "mean", "passes", "n"), "label", "left")
    mean = F.coalesce("mean", F.array_repeat(F.lit(0.0), F.size("v"))).alias("mean")
    vectors = checkpointed(vectors.select("id", "label", "v", mean, F.coalesce("passes", F.lit(1)).alias("passes"), "n"))
    links = whole_labels(vectors.filter("passes = 0"), least) if about["whole"] else None
    for t in range(0, about["most"] or 1, TOGETHER):
        found = sorted_passes(vectors, range(t, t + TOGETHER), least, window)
        links = found if links is None else links.unionByName(found)
    comp = components(checkpointed(links.distinct()), "a", "b")

    placed = classes.select("id", "label", "v", "copies").join(comp, classes["id"] == comp["node"]).drop("node")
    sizes = comp.groupBy("component").agg(F.count("*").alias("members"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("long")
    placed = checkpointed(placed.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("id"), blocks)).withColumn("blocks", blocks))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    own = ["id", "label", "v", "copies", "component"]
    left = placed.select(*own, F.col("block").alias("i"), every.alias("j"), F.lit(True).alias("side"))
    right = placed.select(*own, every.alias("i"), F.col("block").alias("j"), F.lit(False).alias("side"))
    counts = left.unionByName(right).groupBy("component", "i", "j").applyInArrow(_counted(least), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    named = classes.select("id", *shape, "copies").join(comp.withColumnRenamed("node", "id"), "id", "left").join(counts, "id", "left")
    named = named.select(*shape, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    named = parts.select(*shape, "s").join(named, shape)
    # rows out of the comparison have no class, and so no match
    out = keyed(rows).drop("v").join(named, [*shape, "s"], "left")
    comp_id = F.coalesce("component_id", "id")
    kept = F.coalesce(comp_id == F.col("id"), F.lit(True))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), kept.alias("kept"))
