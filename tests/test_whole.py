"""Queries over whole tables: no row may be left out."""

import duckdb
import pytest
from test_queries import SF, TABLES, plain

from helixframe.plans import catalogue

DIFF = ["snv_calls", "snv_window", "ado_stats", "snv_tallies"]

UNCUT = [f"{n}" for n in "dup_mate_propagation cigar_explode mask_reads mask_positions mask_exclude mask_length mask_union lorenz_hist lorenz_curve cv_bins".split()]


def equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    rel = con.sql(catalogue.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    assert mine == sorted(repr(tuple(map(plain, r))) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall())


@pytest.mark.parametrize("name", DIFF)
def test_sites_of_all_rows_equal_sql(spark, name):
    equals_sql(spark, name)


def test_sites_hold_the_depth_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(catalogue.variants, "sites", lambda df, o: df)
    rows = catalogue.X.project(spark, SF, "lineitem", catalogue._PAIR, keep=False)
    total = [f"sum({d})" for d in catalogue._DEPTHS]
    sums = lambda df: df.selectExpr(*total).first()
    assert sums(catalogue.diff_sites(spark, SF)) == sums(rows)


@pytest.mark.parametrize("name", UNCUT)
def test_uncut_tables_equal_sql(spark, name):
    equals_sql(spark, name)


def test_both_mates_of_every_row_are_marked(spark):
    out = catalogue.QUERIES["dup_mate_propagation"](spark, SF)
    assert out.count() == 2 * spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert not [c for n in UNCUT for c in ("l_partkey % 3 = 0", "l_partkey % 5 = 0", "o_orderkey % 10 = 0") if c in catalogue.ORACLE_SQL[n]]


@pytest.mark.parametrize("name", ["cnv_segments", "cnv_gumbel"])
def test_copy_number_permutes_as_often_as_the_operator(spark, monkeypatch, name):
    fitted, fit = [], catalogue.cnv.gumbel_fit
    monkeypatch.setattr(catalogue.cnv, "gumbel_fit", lambda x: fitted.append(len(x)) or fit(x))
    catalogue.QUERIES[name](spark, SF)
    assert fitted and set(fitted) == {200}


def test_pairs_hold_all_letters_of_all_documents(spark, tmp_path):
    texts = {1: "ACGT" * 90 + "A", 2: "acn\ngt", 3: "ACGTTGCAAC" * 20, 4: "", 5: None, 6: "GATTACA" * 17}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    rows = catalogue.pairs(spark, str(tmp_path)).collect()
    for r in sorted(rows, key=lambda r: r.pair_id):
        head = r.seq1[r.seq1.index(catalogue.trim.BIND) + len(catalogue.trim.BIND) :]
        tail = r.seq2.translate(str.maketrans("ACGT", "TGCA"))[::-1]
        doc = r.pair_id >> catalogue.WINDOW_BITS
        got[doc] = got.get(doc, "") + head[:80] + (tail[80:] if doc % 3 == 0 else tail[60:])
    assert got == {k: (t or "").upper().replace("N", "").replace("\n", "") for k, t in texts.items()}
    assert len({r.pair_id for r in rows}) == len({r.name for r in rows}) == len(rows) == 4 + 1 + 2 + 1 + 1 + 2
    assert catalogue.trim.trim(catalogue.pairs(spark, str(tmp_path))).count() == len(rows)
