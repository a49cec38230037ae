"""Projections of the driver's tables onto reads, masks, observations and breakpoints.

Columns are SQL expressions that Spark and DuckDB read alike; all are integers,
text or flags. Ties are broken by all columns of the source row, which is
unique as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LINEITEM = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
LEN = "CAST(floor(l_quantity) AS INT)"

READS = {
    "tid": "CAST(l_suppkey % 5 AS INT)",
    "pos": "(l_orderkey * 13 + l_partkey * 7) % 20000 * 10",
    "rlen": LEN,
    "mapq": "CAST(l_linenumber * 9 AS INT)",
    "is_rev": "l_returnflag = 'R'",
    "bc": "CASE WHEN l_linestatus = 'F' THEN concat('B', l_partkey % 8) END",
    "flag": "CAST(CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END + CASE WHEN l_orderkey % 11 = 0 THEN 4 ELSE 0 END + CASE WHEN l_orderkey % 13 = 0 THEN 256 ELSE 0 END + CASE WHEN l_orderkey % 17 = 0 THEN 1024 ELSE 0 END AS INT)",
}
MASK = {"chrom": "CAST(o_custkey % 5 AS INT)", "beg": "(o_orderkey * 29 % 20000) * 10", "end": "(o_orderkey * 29 % 20000) * 10 + 5 + o_orderkey % 60"}
OBS = {
    "tid": "CAST(l_suppkey % 5 AS INT)",
    "pos": "l_partkey % 500",
    "sample": "CAST(l_linenumber % 3 AS INT)",
    "base": "substring('ACGT', CAST((l_orderkey * 7 + l_partkey) % 4 + 1 AS INT), 1)",
    "ref": "substring('ACGT', CAST(l_partkey % 4 + 1 AS INT), 1)",
    "is_rev": "l_returnflag = 'R'",
    "q": f"10 + {LEN}",
    "frag": "l_orderkey % 6",
    "mapq": "CAST(least(60, l_linenumber * 9) AS INT)",
}
CIGARS = {"pos": "l_orderkey % 1000", "cigar": f"concat(l_linenumber, 'S', {LEN}, 'M2I', l_linenumber + 3, 'M1D5M')", "nm": "CAST(l_partkey % 12 AS INT)", "mapq": "CAST(l_linenumber * 9 AS INT)"}
BREAKS = {
    "tid0": "l_suppkey % 5",
    "tid1": "(l_suppkey + CASE WHEN l_partkey % 10 = 0 THEN 1 ELSE 0 END) % 5",
    "pos0": "(l_orderkey % 400) * 200 + l_linenumber",
    "pos1": "(l_orderkey % 400) * 200 + 500 + l_linenumber % 4",
    "qgap": "CAST(l_linenumber - 4 AS BIGINT)",
    "seq": "l_orderkey * 7 + l_partkey * 100003 + l_linenumber",
}
CONTIG = 200_000
SITES = {
    "chrom": "concat('chr', l_suppkey % 5)",
    "pos": "CAST(l_partkey * 37 % 100000 AS INT)",
    "ref": "substring('ACGT', CAST(l_partkey % 4 + 1 AS INT), 1)",
    "alt": "substring('CGTA', CAST(l_partkey % 4 + 1 AS INT), 1)",
    "sample": "CASE WHEN l_linenumber <= 2 THEN concat('b', l_linenumber) ELSE concat('c', l_linenumber % 4) END",
}


def sql(columns: dict[str, str], source: str, keep: str = "*", where: str = "true") -> str:
    """The projection as a SELECT."""
    body = ", ".join(f'{e} AS "{c}"' for c, e in columns.items())
    return f"SELECT {keep + ', ' if keep else ''}{body} FROM {source} WHERE {where}"


def project(spark: SparkSession, sf_dir: str, source: str, columns: dict[str, str], keep: bool = True, where: str = "true") -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{source}.parquet").where(where)
    return df.selectExpr(*(df.columns if keep else []), *[f"{e} AS `{c}`" for c, e in columns.items()])
