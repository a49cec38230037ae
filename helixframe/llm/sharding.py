"""Sharding by extendible hashing.

A row's address is 60 bits of the hash of its key, then 60 bits of the hash of
its id, as two numbers. The directory starts with one bucket; a bucket over the
byte limit splits on the next address bit, alone, until each fits. As id bits
follow key bits, a key that is too large for one shard goes on splitting by row.

Splits need no pass of their own each: sizes are added up by address prefix,
``STEP`` bits at a time with map-side combining, which decides up to ``STEP``
splits at once; only buckets that are still too large go on. Rows hold an
address and a size, never a text, and the directory stays a table: it is
broadcast to the rows only up to ``BROADCAST`` entries.

Defined cases: a null text counts 0 bytes, a null key or id hashes as an empty one; a
row larger than the limit ends in a shard of its own; rows that repeat an id
have one address and stay together, so their bucket alone may exceed the limit
for good; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, unused

LIMIT = 64 << 20
STEP = 8
BITS = 60
#: Directory entries of one round that are broadcast, at some 40 bytes each.
BROADCAST = 200_000


def _bits(text: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _address(id_col: str, key_col: str | None) -> tuple[Column, Column]:
    by_id = _bits(F.col(id_col).cast("string"))
    return (by_id, F.lit(0).cast("long")) if key_col is None else (_bits(F.col(key_col).cast("string")), by_id)


def addressed(df: DataFrame, id_col: str, text_col: str, key_col: str | None) -> DataFrame:
    """(id, a1, a2, n_bytes) per row: the address in two numbers of 60 bits."""
    a1, a2 = _address(id_col, key_col)
    return df.select(F.col(id_col).alias("id"), a1.alias("a1"), a2.alias("a2"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))


def _prefix(d: str) -> list[Column]:
    """The first ``d`` bits of an address, as the shifted numbers (p1, p2)."""
    return [F.expr(f"shiftright(a1, {BITS} - least({d}, {BITS}))").alias("p1"), F.expr(f"if({d} > {BITS}, shiftright(a2, 2 * {BITS} - greatest({d}, {BITS})), 0L)").alias("p2")]


def _text(d: str) -> Column:
    """A prefix of ``d`` bits in binary digits."""
    first = F.expr(f"lpad(conv(p1, 10, 2), least({d}, {BITS}), '0')")
    return F.when(F.col(d) == 0, "").when(F.col(d) <= BITS, first).otherwise(F.concat(first, F.expr(f"lpad(conv(p2, 10, 2), {d} - {BITS}, '0')")))


def assign(df: DataFrame, limit: int = LIMIT, key_col: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, shard, depth, n_bytes) per row; ``shard`` is the bucket's address prefix of ``depth`` bits, empty for a single shard."""
    return _assigned(addressed(df, id_col, text_col, key_col), limit, key_col).select(F.col("id").alias(id_col), "shard", "depth", "n_bytes")


def _assigned(rows: DataFrame, limit: int, key_col: str | None) -> DataFrame:
    """(id, a1, a2, shard, depth, n_bytes) of addressed rows."""
    last = BITS if key_col is None else 2 * BITS
    left, base, parts = checkpointed(rows), 0, []
    while True:
        top = min(base + STEP, BITS if base < BITS else last)
        cells = left.select(*_prefix(str(top)), "n_bytes").groupBy("p1", "p2").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("c"))
        # a cell is the address of the rows in it, cut at ``top`` bits
        cells = cells.selectExpr(f"shiftleft(p1, {BITS - min(top, BITS)}) AS a1", f"shiftleft(p2, {2 * BITS - max(top, BITS)}) AS a2", "b", "c")
        levels = cells.withColumn("d", F.explode(F.sequence(F.lit(base), F.lit(top))))
        levels = levels.select("a1", "a2", "b", "c", "d", *_prefix("d"))
        sums = levels.groupBy("d", "p1", "p2").agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
        fits = (F.col("b") <= limit) | (F.col("c") <= 1) | (F.col("d") == last)
        # the shallowest prefix of a cell that fits is its bucket
        chosen = levels.select("a1", "a2", "d", "p1", "p2").join(sums.filter(fits).select("d", "p1", "p2"), ["d", "p1", "p2"])
        chosen = checkpointed(chosen.groupBy("a1", "a2").agg(F.min("d").alias("d")))
        cell = chosen.select(*[c.alias(f"cell{k}") for k, c in enumerate(_prefix(str(top)))], "d")
        cell = F.broadcast(cell) if cell.count() <= BROADCAST else cell
        placed = left.select("*", *_prefix(str(top)))
        here = (placed["p1"] == cell["cell0"]) & (placed["p2"] == cell["cell1"])
        parts.append(placed.join(cell, here).drop("p1", "p2").select("id", "a1", "a2", "d", "n_bytes", *_prefix("d")).select("id", "a1", "a2", _text("d").alias("shard"), F.col("d").alias("depth"), "n_bytes"))
        rest = checkpointed(placed.join(cell, here, "left_anti").drop("p1", "p2"))
        if top == last or rest.isEmpty():
            break
        left, base = rest, top
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write(df: DataFrame, path: str, limit: int = LIMIT, key_col: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all rows of ``df`` as Parquet, one folder a shard; with a column ``shard`` of its own the folders are named ``shard_``.

    A row finds its shard by its address, so rows with null or repeated ids and
    keys go where ``assign`` puts them, each once.
    """
    one, two, name = (unused(c, df.columns) for c in ("address1", "address2", "shard"))
    a1, a2 = _address(id_col, key_col)
    shards = _assigned(addressed(df, id_col, text_col, key_col), limit, key_col).select(F.col("a1").alias(one), F.col("a2").alias(two), F.concat(F.lit("s"), "shard").alias(name)).distinct()
    placed = df.withColumns({one: a1, two: a2}).join(shards, [one, two]).drop(one, two)
    placed.repartition(name).write.partitionBy(name).parquet(path)
