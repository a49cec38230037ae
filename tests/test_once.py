"""Costly expressions are computed once a row."""

import pytest

from helixframe.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, most", [("poisson_mapq", 1), ("split_breakpoints", 2)])
def test_a_cigar_is_taken_apart_once(spark, name, most):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("regexp_extract_all(") <= most


def test_left_mates_are_shuffled_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = catalogue.QUERIES["dup_mate_propagation"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "ReusedExchange" in plan
