"""Centroid clustering over blocks of vectors in Hilbert order, with zone maps.

Vectors become integers, ``floor(scale * x)``, are put in the order of a Hilbert
curve through a grid of ``2 ** BITS`` cells a dimension, and are cut into blocks of
at most ``BLOCK`` rows that carry the least and the greatest value of each
dimension. In a round, a block's box gives every centroid a least and a greatest
distance from any vector of the block. A centroid whose least distance exceeds
another one's greatest can be nearest to none of them; the rest are the block's
candidates, and are compared with all its vectors at once, in exact integers.

Blocks are written once. A round reads them, and a task hands on one row of
exact sums a cluster, so the driver sees as many rows as there are centroids.
Equal vectors are dealt over tasks by a hash, so a vector that is a third of all
rows is no hot key.

Defined cases: vectors that are null, of another length than ``dims``, or hold
null or non-finite components, or one whose integer is ``REACH`` or more (its
squared distances fit no long), and rows without an id, take no part and are not
returned; repeated rows count each, and among equal ids the lesser vector is the
earlier start; with fewer vectors than centroids each is one; ties go to the
smaller number; an empty centroid stays; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, shuffles_deleted

BLOCK = 256
#: Bits of a dimension on the curve.
BITS = 2
#: Components of this size or more have squared distances beyond a long.
REACH = 1 << 27
#: Up to this size sums of squares are exact in double precision, and distances are matrix products.
PRODUCT = 1 << 21


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Each row's place on the Hilbert curve, as bytes that sort alike; ``cells`` is (rows, dims) below ``2 ** bits``.

    Skilling's transposed form: undo the rotations and reflections of the
    subcubes from the highest bit down, then Gray-decode over the dimensions.
    """
    x = cells.astype(np.uint32).T.copy()
    if not x.size:
        return np.zeros((cells.shape[0], 0), np.uint8)
    for b in range(bits - 1, 0, -1):
        low = np.uint32((1 << b) - 1)
        for d in range(len(x)):
            flip = (x[d] >> np.uint32(b) & 1).astype(bool)
            swap = np.where(flip, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(flip, low, swap).astype(np.uint32)
            if d:
                x[d] ^= swap.astype(np.uint32)
    for d in range(1, len(x)):
        x[d] ^= x[d - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> np.uint32(b) & 1, np.uint32((1 << b) - 1), np.uint32(0))
    x ^= turn
    planes = [x >> np.uint32(b) & 1 for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def integer_vectors(df: DataFrame, dims: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) with ``floor(scale * x)`` of the vectors that take part."""
    v = F.col(vec_col)
    scaled = F.transform(v, lambda x: x.cast("double") * scale)
    fit = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(REACH)))
    rows = df.select(F.col(id_col).cast("long").alias("id"), scaled.alias("scaled"), (F.coalesce(F.size(v) == dims, F.lit(False)) & F.coalesce(fit, F.lit(False))).alias("fit"))
    return rows.filter("fit and id is not null").select("id", F.transform("scaled", lambda x: F.floor(x).cast("int")).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def blocks(vectors: DataFrame, dims: int, size: int = BLOCK) -> DataFrame:
    """(ids, vectors, least, greatest), each little-endian bytes: vectors in Hilbert order in blocks of at most ``size`` rows."""
    spread = vectors.agg(*[f(F.col("v")[k]) for f in (F.avg, F.stddev_pop) for k in range(dims)]).first()
    mean, deviation = np.array([x or 0.0 for x in spread], np.float64).reshape(2, dims)
    # cells of equal width over three deviations, the outer ones open
    least, step = mean - 1.5 * deviation, np.maximum(1.0, 3 * deviation / (1 << BITS))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), dims)
            key = hilbert_keys(np.clip((v - least) // step, 0, (1 << BITS) - 1).astype(np.uint32))
            data = np.ascontiguousarray(v, "<i4")
            yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in key], pa.binary()), batch.column(0), pa.array([r.tobytes() for r in data], pa.binary())], ["key", "id", "v"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                ids = part.column(0).to_numpy().astype("<i8")
                v = np.frombuffer(b"".join(part.column(1).to_pylist()), "<i4").reshape(-1, dims)
                row = [ids.tobytes(), v.tobytes(), v.min(axis=0).tobytes(), v.max(axis=0).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], ["ids", "vectors", "least", "greatest"])

    keys = vectors.mapInArrow(keyed, "key binary, id long, v binary")
    # equal vectors have equal keys: the hash deals them over ranges
    keys = checkpointed(keys.withColumn("deal", F.xxhash64("id", F.monotonically_increasing_id())))
    ordered = keys.repartitionByRange("key", "deal").sortWithinPartitions("key", "deal").select("id", "v")
    return checkpointed(ordered.mapInArrow(cut, "ids binary, vectors binary, least binary, greatest binary"))


def candidates(least: np.ndarray, greatest: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a vector inside the box."""
    below, above = np.maximum(least - centroids, 0), np.maximum(centroids - greatest, 0)
    near = ((below + above) ** 2).sum(axis=1)
    far = (np.maximum(np.abs(centroids - least), np.abs(centroids - greatest)) ** 2).sum(axis=1)
    return np.flatnonzero(near <= far.min())


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) < PRODUCT and v.shape[1] <= 1 << 7:
        x, y = v.astype(np.float64), c.astype(np.float64)
        return ((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * (x @ y.T)).astype(np.int64)
    return np.stack([((v - one) ** 2).sum(axis=1) for one in c], axis=1)


def nearest(block: dict[str, bytes], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(vectors, cluster, distance, candidates compared) of a block's rows."""
    dims = centroids.shape[1]
    box = [np.frombuffer(block[k], "<i4").astype(np.int64) for k in ("least", "greatest")]
    v = np.frombuffer(block["vectors"], "<i4").reshape(-1, dims).astype(np.int64)
    maybe = candidates(*box, centroids)
    d = distances(v, centroids[maybe])
    at = d.argmin(axis=1)  # the first, so the smaller number
    return v, maybe[at], d[np.arange(len(v)), at], len(maybe)


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, bytes]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(name)[k].as_py() for name in batch.schema.names}


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the least SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [r["v"] for r in vectors.select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def one_round(cut: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, dict[str, int]]:
    """(new centroids, pairs of a vector and a centroid compared and in all)."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, seen = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), 0
        for block in _blocks_of(batches):
            v, cluster, _, tried = nearest(block, centroids)
            n += np.bincount(cluster, minlength=k)
            for one in np.unique(cluster):
                total[one] += v[cluster == one].sum(axis=0)
            seen += tried * len(v)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64())), pa.array([seen if j == 0 else 0 for j in range(len(some))], pa.int64())], ["cluster", "n", "total", "seen"])

    parts = cut.mapInArrow(run, "cluster long, n long, total array<long>, seen long")
    sums = [F.sum(F.col("total")[d].cast("decimal(38,0)")).alias(f"t{d}") for d in range(dims)]
    new, work = centroids.copy(), {"compared": 0, "pairs": 0}
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"), *sums).collect():  # a row a centroid at most
        new[r["cluster"]] = [int(r[f"t{d}"]) // r["n"] for d in range(dims)]
        work["compared"] += r["seen"]
        work["pairs"] += r["n"] * k
    return new, work


def assign(cut: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks_of(batches):
            _, cluster, distance, _ = nearest(block, centroids)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(block["ids"], "<i8")), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    return cut.mapInArrow(run, "id long, cluster int, distance long")


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    spark = df.sparkSession
    names = "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    vectors = integer_vectors(df, dims, scale, id_col, vec_col)
    with shuffles_deleted(spark):
        start = first_centroids(vectors, k, seed)
        if not start:
            return spark.createDataFrame([], names).withColumnRenamed("id", id_col)
        centroids, cut = np.array(start, np.int64), blocks(vectors, dims)
        for _ in range(rounds):
            centroids, _ = one_round(cut, centroids)
        told = checkpointed(assign(cut, centroids))
        of = {r["cluster"]: int(r["s"]) for r in told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    sha = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    facts = spark.createDataFrame([(c, s, sum(of.values()), sha(centroids[c])) for c, s in of.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return told.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
