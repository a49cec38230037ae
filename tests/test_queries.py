"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from helixframe.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = ["depth_sweep", "dup_flags", "dup_mate_propagation", "frag_length_rule", "frag_islands", "mask_reads", "mask_exclude", "lorenz_curve", "cv_bins", "fragment_vote", "genotype_top2", "sv_calls", "cnv_split", "snv_window", "joint_window", "replicate_min", "seq_revcomp", "seq_motif_hits", "poisson_mapq", "site_qual", "allele_support_filter", "joint_stats", "stream_dedup", "stream_depth", "stream_groups", "stream_sweep"]


def plain(v):
    return round(v, 8) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    rel = con.sql(catalogue.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    assert mine == sorted(repr(tuple(map(plain, r))) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall())


def test_partitions_do_not_matter(spark):
    out = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(sorted(map(tuple, catalogue.QUERIES["frag_merge"](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0] == out[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
