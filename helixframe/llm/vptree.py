"""Nearest neighbours by vantage-point trees, one a shard, with relaxed or exact pruning.

Largest inner product becomes nearest Euclidean neighbour by one more
component: with ``m`` the greatest norm, a vector ``x`` is stored as
``(x, sqrt(m**2 - |x|**2))`` and a query as ``(q, 0)``. A tree node splits its
points at the median distance from a vantage point; a query skips a half when
the triangle inequality shows that nothing there can be nearer than its
current k-th: ``factor * gap > tau`` with the gap between the query's distance
to the vantage point and the half's range of distances. A factor of one is
exact; a larger one prunes more. Unless a factor is given, the largest of
``FACTORS`` is taken that keeps a recall of ``RECALL`` on a bounded sample: up to
``SAMPLE`` vectors of one shard, searched in that shard.

Vectors are dealt to shards by a hash of their id, each shard is indexed once,
and the stated queries meet every shard in blocks, so that one task holds one
tree and one block of queries and returns k rows a query. Shards and blocks
grow in number, not in size.

Defined cases: vectors that are null, empty, zero, hold null or non-finite
components, differ in length from most, or have no id, take no part; fewer
candidates than k give as many ranks; ties go to the smaller id, however many
there are; repeated ids count as rows of their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import checkpointed

SHARD = 4096
BLOCK = 2048
LEAF = 64
FACTORS = [16.0, 12.0, 10.0, 8.0, 7.0, 6.0, 5.0, 4.0, 3.0, 2.0, 1.5]
RECALL, SAMPLE = 0.95, 128
_SLACK = 1e-9


def doubles(vec_col: str) -> Column:
    """The vector in double precision; null unless it takes part (whole, finite, not zero)."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.when(F.coalesce(fine, F.lit(False)), v)


def common_length(rows: DataFrame) -> int:
    """The number of components that most vectors ``v`` have; the smallest of equally frequent ones, 0 without vectors."""
    return rows.agg(F.mode(F.size("v"), True).alias("n")).first()["n"] or 0


def of_common_length(rows: DataFrame) -> DataFrame:
    """The rows whose vector ``v`` has as many components as most have."""
    return rows.filter(F.size("v") == common_length(rows))


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that take part, whatever their length."""
    return df.select(F.col(id_col).cast("long").alias("id"), doubles(vec_col).alias("v")).filter("id is not null and v is not null")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) and len(column.flatten()) != len(column) * len(column[0]):
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Tree:
    """Vantage-point tree over the rows of ``x``; nodes in lists, leaves as slices of ``order``."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, seed: int = 5):
        self.x, self.rng = x, np.random.default_rng(seed)
        self.order = np.arange(len(x))
        self.nodes: list[tuple] = []
        self.leaf = leaf
        #: pairs of a query and a point that searches have compared so far
        self.compared = 0
        self.root = self._grow(0, len(x)) if len(x) else -1
        self.points = x[self.order]
        del self.rng, self.x

    def _grow(self, a: int, b: int) -> int:
        at = len(self.nodes)
        if b - a <= self.leaf:
            self.nodes.append((a, b))
            return at
        self.nodes.append(())
        v = self.x[self.order[self.rng.integers(a, b)]]
        d = np.sqrt(((self.x[self.order[a:b]] - v) ** 2).sum(axis=1))
        mid = (b - a) // 2
        self.order[a:b] = self.order[a:b][np.argpartition(d, mid)]
        d = np.sqrt(((self.x[self.order[a:b]] - v) ** 2).sum(axis=1))
        near, far = (d[:mid].min(), d[:mid].max()), (d[mid:].min(), d[mid:].max())
        left = self._grow(a, a + mid)
        right = self._grow(a + mid, b)
        self.nodes[at] = (v, near, far, left, right)
        return at

    def search(self, q: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of the ``k`` nearest of each query, or of all rows if fewer."""
        k = min(k, len(self.points))
        rows, dist = np.full((len(q), k), -1), np.full((len(q), k), np.inf)
        stack = [(self.root, np.arange(len(q)), np.zeros(len(q)))] if self.root >= 0 and k else []
        while stack:
            node, who, least = stack.pop()
            who = who[factor * least <= dist[who, -1] + _SLACK]
            if not len(who):
                continue
            entry = self.nodes[node]
            if len(entry) == 2:
                a, b = entry
                p = self.points[a:b]
                self.compared += len(who) * (b - a)
                d = np.sqrt(np.maximum(0, (q[who] ** 2).sum(axis=1)[:, None] + (p**2).sum(axis=1) - 2 * q[who] @ p.T))
                all_d = np.hstack([dist[who], d])
                all_r = np.hstack([rows[who], np.broadcast_to(self.order[a:b], d.shape)])
                pick = np.argsort(all_d, axis=1, kind="stable")[:, :k]
                dist[who] = np.take_along_axis(all_d, pick, axis=1)
                rows[who] = np.take_along_axis(all_r, pick, axis=1)
                continue
            v, near, far, left, right = entry
            d = np.sqrt(((q[who] - v) ** 2).sum(axis=1))
            gap_l = np.maximum(0, np.maximum(near[0] - d, d - near[1]))
            gap_r = np.maximum(0, np.maximum(far[0] - d, d - far[1]))
            if (gap_l <= gap_r).mean() >= 0.5:
                stack += [(right, who, gap_r), (left, who, gap_l)]
            else:
                stack += [(left, who, gap_l), (right, who, gap_r)]
        return rows, dist


def _lifted(v: np.ndarray, greatest: float) -> np.ndarray:
    return np.hstack([v, np.sqrt(np.maximum(0, greatest - (v**2).sum(axis=1)))[:, None]])


def _indexed(greatest: float):
    """One shard's tree over its distinct vectors, and the sorted ids of each."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids, v = group["id"].to_numpy(), matrix(group["v"])
        distinct, of = np.unique(v, axis=0, return_inverse=True)
        by = np.argsort(of.reshape(-1), kind="stable")
        members = np.split(ids[by], np.flatnonzero(np.diff(of.reshape(-1)[by])) + 1)
        tree = Tree(_lifted(distinct, greatest))
        return pa.table({"shard": group["shard"][:1], "tree": pa.array([pickle.dumps((tree, distinct, members))], pa.binary())})

    return run


def _blocked(group: pa.Table) -> pa.Table:
    group = group.sort_by("id")
    return pa.table({"queries": pa.array([pickle.dumps((group["id"].to_numpy(), matrix(group["v"])))], pa.binary())})


def _with_ties(tree: Tree, q: np.ndarray, k: int, factor: float) -> list[np.ndarray]:
    """The nearest rows of each query: more than ``k``, and all whose distance is the k-th's within rounding."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
    left, want = np.arange(len(q)), k + 8
    while len(left):
        rows, dist = tree.search(q[left], want, factor)
        more = (dist[:, -1] <= dist[:, k] + _SLACK) if dist.shape[1] == want and want < len(tree.points) else np.zeros(len(left), bool)
        for x, found in zip(left[~more], rows[~more], strict=True):
            out[x] = found[found >= 0]
        left, want = left[more], 4 * want
    return out


def _searched(k: int, factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, asked in zip(batch.column("tree"), batch.column("queries"), strict=True):
                (tree, distinct, members), (ids, q) = pickle.loads(packed.as_py()), pickle.loads(asked.as_py())
                out_q, out_v, out_s = [], [], []
                for i, rows in enumerate(_with_ties(tree, np.hstack([q, np.zeros((len(q), 1))]), k, factor)):
                    score = np.zeros(len(rows))
                    for c in range(q.shape[1]):  # in order, as a plain loop adds
                        score += q[i, c] * distinct[rows, c]
                    own = [members[r][: k + 1] for r in rows]
                    found, scores = np.concatenate([np.zeros(0, np.int64), *own]), np.repeat(score, [len(x) for x in own])
                    found, scores = found[found != ids[i]], scores[found != ids[i]]
                    best = np.lexsort((found, -scores))[:k]
                    out_q.append(np.full(len(best), ids[i]))
                    out_v.append(found[best])
                    out_s.append(scores[best])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_v, out_s)], ["query_id", "vec_id", "score"])

    return run


def recall_and_share(tree: Tree, q: np.ndarray, k: int, factor: float) -> tuple[float, float]:
    """The share of the exact ``k`` nearest that a factor finds, and the share of pairs that it compares."""
    k = min(k, len(tree.points))
    exact, tree.compared = tree.search(q, k)[0], 0
    found = tree.search(q, k, factor)[0]
    hits = sum(len(np.intersect1d(a, b)) for a, b in zip(exact, found, strict=True))
    return hits / max(1, exact.size), tree.compared / max(1, len(q) * len(tree.points))


def _tuned(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("tree"):
                tree, distinct, _ = pickle.loads(packed.as_py())
                q = distinct[:: max(1, len(distinct) // SAMPLE)][:SAMPLE]
                q = np.hstack([q, np.zeros((len(q), 1))])
                factor = next((f for f in FACTORS if recall_and_share(tree, q, k + 1, f)[0] >= RECALL), 1.0)
                yield pa.RecordBatch.from_arrays([pa.array([factor])], ["factor"])

    return run


def index(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = SHARD) -> tuple[DataFrame, int, int]:
    """((shard, tree) of all vectors, number of shards, length of a vector)."""
    rows = usable(df, id_col, vec_col)
    width = common_length(rows)
    rows = rows.filter(F.size("v") == width)
    norm = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
    size = rows.agg(F.count("*").alias("n"), F.max(norm).alias("top")).first()
    shards = max(1, -(-size["n"] // shard))
    trees = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    return checkpointed(trees.groupBy("shard").applyInArrow(_indexed(size["top"] or 0.0), "shard long, tree binary")), shards, width


def tuned_factor(trees: DataFrame, k: int) -> float:
    """The largest factor that keeps ``RECALL`` on a sample of the first shard."""
    found = trees.orderBy("shard").limit(1).select("tree").mapInArrow(_tuned(k), "factor double").first()
    return found["factor"] if found else 1.0


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, factor: float | None = None, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``df`` with the largest inner product for each row of ``queries``, its own id aside.

    ``factor`` relaxes the pruning; 1 is exact, and None the tuned one.
    """
    trees, shards, width = index(df, id_col, vec_col, shard)
    factor = tuned_factor(trees, k) if factor is None else factor
    asked = usable(queries, id_col, vec_col).filter(F.size("v") == width)
    blocks = max(1, -(-asked.count() // block))
    asked = asked.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).applyInArrow(_blocked, "queries binary")
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")))
    found = asked.join(trees, "shard").select("queries", "tree").mapInArrow(_searched(k, factor), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
