"""Sorted Parquet as the index of alignments: region scans prune by its statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.operators.intervals import parse_region


def write_sorted(reads: DataFrame, path: str) -> None:
    """Alignments in coordinate order over files, with narrow (tid, pos) ranges a row group; ``rlen`` is the span on the reference."""
    reads.repartitionByRange("tid", "pos").sortWithinPartitions("tid", "pos").write.parquet(path)


def scan_region(spark: SparkSession, path: str, region: str, contigs: dict[str, int], longest: int | None = None) -> DataFrame:
    """Alignments that meet a region; ``longest`` bounds a read's span, so that both ends of the range reach the file statistics.

    Without a bound it is the longest span that the store holds, from a pass over that one column.
    """
    name, beg, end = parse_region(region, set(contigs))
    df = spark.read.parquet(path)
    if longest is None:
        longest = df.filter(df["tid"] == contigs[name]).agg({"rlen": "max"}).first()[0] or 0
    return df.filter((df["tid"] == contigs[name]) & (df["pos"] < end) & (df["pos"] > beg - longest) & (df["pos"] + df["rlen"] > beg))
