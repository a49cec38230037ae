"""Streaming forms of the single-pass operators: duplicate flags, groups, depth, trimming, the window filter, windowed sums.

Each pass keeps a bounded state a key and emits what can no longer change.
Input is in order along ``pos`` within a contig, as the batch forms read it
sorted; where state ends with the input, one sentinel row a contig (``pos`` at
``END``) flushes it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

#: Position of a sentinel row: beyond every contig.
END = 1 << 40


def flag_duplicates(stream: DataFrame, key: list[str], order: str, columns: dict[str, str], folder: str, keep: str | None = None) -> DataFrame:
    """``columns`` (name: type) of each row, and whether its key was seen before.

    Held is a row a key; with ``keep`` (a duration) it goes once a key has
    been silent for so long, and a later row counts as the first again. Rows of
    a key in one batch are put in ``order``, nulls last; a row that comes in a
    later batch counts as later.

    A key's first is a minimum, and meets its row by key and order: no key is one task.
    """
    wait = int(pd.Timedelta(keep).total_seconds() * 1000) if keep else None
    keys = [f"_key{i}" for i in range(len(key))]
    own = [F.col(k).alias(n) for k, n in zip(key, keys, strict=True)]

    def step(rows: DataFrame, held: DataFrame) -> DataFrame:
        now = int(time.time() * 1000)
        seen = held.filter(F.col("_at") > now - wait) if wait else held
        come = rows.select(*own, F.col(order).alias("_order"), F.lit(True).alias("_new"))
        heads = come.unionByName(seen.select(*keys, F.lit(False).alias("_new")), allowMissingColumns=True)
        heads = heads.groupBy(*keys).agg(F.min("_order").alias("_order"), F.bool_and("_new").alias("_new"), F.bool_or("_new").alias("_come"))
        heads = heads.filter("_come" if wait else "_new").drop("_come").withColumn("held", F.lit(True)).withColumn("_at", F.lit(now))
        out = rows.select(*(F.col(n).cast(t).alias(n) for n, t in columns.items()), *own, F.col(order).alias("_order"), F.lit(False).alias("held"))
        w = Window.partitionBy(*keys, "_order").orderBy(F.desc("held"))
        out = out.unionByName(heads, allowMissingColumns=True).withColumn("is_dup", ~F.coalesce(F.lag("_new").over(w), F.lit(False)))
        return out.drop("_order", "_new")

    shape = stream.select(*(F.lit(None).cast(t).alias(n) for n, t in columns.items()), F.lit(None).cast("boolean").alias("is_dup"), *own, F.lit(None).cast("long").alias("_at")).schema
    return folded(stream, step, shape, folder, every=True).select(*columns, "is_dup")


def flag_mates(marked: DataFrame, name: str, flag: str, columns: dict[str, str], keep: str | None = None) -> DataFrame:
    """``columns`` of each row of a pair, and whether it or the mate before it is marked, as ``is_dup``.

    The mate that comes first goes out with its own mark, and its name is held
    until the other comes, as a pass over sorted alignments does; ``keep`` (a
    duration) drops the names of mates that never come. Rows of a name in one
    batch are put in the order of the columns.
    """
    names = list(columns)
    wait = int(pd.Timedelta(keep).total_seconds() * 1000) if keep else None

    def run(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches), ignore_index=True).sort_values(names, ignore_index=True)
        held, out = (bool(state.get[0]) if state.exists else None), []
        for own in rows[flag].astype(bool):
            out.append(bool(own or held))
            held = bool(own) if held is None else None
        if held is None:
            if state.exists:
                state.remove()
        else:
            state.update((held,))
            if wait:
                state.setTimeoutDuration(wait)
        yield rows[names].assign(is_dup=out)

    schema = ", ".join([*(f"{n} {t}" for n, t in columns.items()), "is_dup boolean"])
    timeout = GroupStateTimeout.ProcessingTimeTimeout if keep else GroupStateTimeout.NoTimeout
    return marked.groupBy(name).applyInPandasWithState(run, schema, "marked boolean", "append", timeout)


def trimmed(stream: DataFrame, o=None) -> DataFrame:
    """Read pairs trimmed as they come; there is no state."""
    from helixframe.operators import trim

    return trim.trim(stream, o)


def _in_order(batches: Iterator[pd.DataFrame], order: list[str]) -> list[dict]:
    rows = pd.concat(list(batches), ignore_index=True).sort_values(order)
    return rows.to_dict("records")


def folded(stream: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], shape: str | StructType, folder: str, every: bool = False) -> DataFrame:
    """Rows that go out of ``step(rows, held)`` batch by batch, of what is there now.

    A step returns rows of ``shape`` and whether each is ``held``: these come to
    the next batch (to ``every`` later one), the others go out. Every batch is a plan over the executors,
    so a contig is no one task. A batch that runs again reads what the one
    before it held and replaces its own.
    """
    spark = stream.sparkSession
    part = lambda k, held: f"{folder}/rows/batch={k}/held={held}"

    def run(rows: DataFrame, k: int) -> None:
        session, before = rows.sparkSession, spark.createDataFrame([], shape)
        if k:
            before = session.read.schema(shape).parquet(*(part(j, "true") for j in range(0 if every else k - 1, k)))
        done = step(rows, before)
        done.write.mode("overwrite").partitionBy("held").parquet(f"{folder}/rows/batch={k}")
        for held in ("true", "false"):  # a part without rows is still a table
            session.createDataFrame([], shape).coalesce(1).write.mode("append").parquet(part(k, held))

    spark.createDataFrame([], shape).write.mode("overwrite").parquet(part(-1, "false"))
    q = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(run).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.read.schema(shape).parquet(f"{folder}/rows/batch=*/held=false")


def _fronts(*starts: DataFrame) -> DataFrame:
    """(_tid, _front): the last start of each contig, a row a contig."""
    return F.broadcast(reduce(DataFrame.unionByName, starts).groupBy(F.col("tid").alias("_tid")).agg(F.max("st").alias("_front")))


GROUPS = "tid long, is_rev boolean, anchor long, n long, sum_mq2 long, longest long"


def grouped(stream: DataFrame, folder: str) -> DataFrame:
    """``GROUPS`` of read ends (tid, st, en, is_rev, mapq): a group goes out once reads start behind it.

    Held are the open groups: those whose ends the last start has not passed.
    """

    def step(rows: DataFrame, held: DataFrame) -> DataFrame:
        q = F.least(F.col("mapq"), F.lit(60)).cast("long")
        length = (F.col("en") - F.col("st")).cast("long")
        anchor = F.when(F.col("is_rev"), F.col("en")).otherwise(F.col("st")).cast("long")
        one = rows.filter(F.col("st") < END).select("tid", "is_rev", anchor.alias("anchor"), F.lit(1).cast("long").alias("n"), (q * q).alias("sum_mq2"), length.alias("longest"), F.col("en").cast("long").alias("far"))
        sums = one.unionByName(held).groupBy("tid", "is_rev", "anchor").agg(F.sum("n").alias("n"), F.sum("sum_mq2").alias("sum_mq2"), F.max("longest").alias("longest"), F.max("far").alias("far"))
        passed = (F.col("far") <= F.col("_front")) & (F.col("anchor") < F.col("_front"))
        return sums.join(_fronts(rows.select("tid", "st")), F.col("tid").eqNullSafe(F.col("_tid")), "left").withColumn("held", ~F.coalesce(passed, F.lit(False))).drop("_tid", "_front")

    return folded(stream, step, f"{GROUPS}, far long", folder).drop("far")


SEGMENTS = "tid long, st long, en long, depth long"


def depth(stream: DataFrame, folder: str) -> DataFrame:
    """``SEGMENTS`` of fragments (tid, st, en): depth between neighbouring starts and ends, as far as no later start can change it.

    Held are the segments behind the last start of a contig, and that start as an empty segment.
    """
    from helixframe.operators import sweep

    def step(rows: DataFrame, held: DataFrame) -> DataFrame:
        spans = rows.filter(F.col("st") < END).select("tid", "st", "en", F.lit(1).cast("long").alias("depth"))
        segments = sweep.depth(spans.unionByName(held), ["tid"], "st", "en", depth="depth")
        fronts = _fronts(rows.select("tid", "st"), held.filter("st = en").select("tid", "st"))
        marks = fronts.select(F.col("_tid").alias("tid"), F.col("_front").alias("st"), F.col("_front").alias("en"), F.lit(0).cast("long").alias("depth"), F.lit(True).alias("held"))
        return segments.join(fronts, F.col("tid").eqNullSafe(F.col("_tid"))).select("tid", "st", "en", "depth", (F.col("st") >= F.col("_front")).alias("held")).unionByName(marks)

    return folded(stream, step, SEGMENTS, folder)


def alone(stream: DataFrame, distance: int) -> DataFrame:
    """(chrom, pos) of the rows without another at most ``distance`` away: a row goes out once the next is far enough, and a contig's last with its sentinel.

    State of a contig is its last position and whether that one is alone so far.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, free = state.get if state.exists else (None, False)
        out = []
        for r in _in_order(batches, ["pos"]):
            near = last is not None and r["pos"] - last <= distance
            if last is not None and free and not near:
                out.append((key[0], int(last)))
            last, free = int(r["pos"]), not near
        state.update((last, bool(free)))
        yield pd.DataFrame(out, columns=["chrom", "pos"])

    return stream.groupBy("chrom").applyInPandasWithState(run, "chrom string, pos long", "last long, free boolean", "append", GroupStateTimeout.NoTimeout)


def windowed_depth(stream: DataFrame, time: str, by: list[str], every: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(window start, by, n, total) of an event stream; in append mode a window goes out, and leaves the state, once the watermark passes it."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    agg = timed.groupBy(F.window("_t", every), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return agg.select(F.col("window.start").alias("start"), *by, "n", "total")


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into Parquet files of a shared folder, and read these.

    In complete mode each batch replaces the result.
    """
    spark = stream.sparkSession
    out = f"{folder}/out"
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(out)
    write = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        q = write.format("parquet").option("path", f"{folder}/rows").start()
        out = f"{folder}/rows"
    else:
        q = write.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(out)
