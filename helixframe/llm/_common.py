"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine gets a temporary folder; on a
    cluster it is an error, as other hosts would not see such a folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
    return sc.getCheckpointDir()


#: Spark's setting that has the shuffle files of a job deleted at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Inside, every job's shuffle files go with its end: what outlives a job here is a checkpoint."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder.

    Its files outlive a lost executor, and Spark's cleaner removes them with
    the plan that reads them when ``cleanCheckpoints`` is on. The shuffle files
    of the job that writes them are of no more use, and deleted at its end.
    """
    checkpoint_folder(df.sparkSession)
    with shuffles_deleted(df.sparkSession):
        return df.checkpoint(eager=True)


def measured(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """A checkpoint of ``df`` and aggregates of its rows (``n`` is their number), from the one job that writes it."""
    seen = Observation()
    names = {"n": F.count(F.lit(1))} | measures
    out = checkpointed(df.observe(seen, *[c.alias(name) for name, c in names.items()]))
    return out, seen.get


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores behind it until it clashes with none of ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
