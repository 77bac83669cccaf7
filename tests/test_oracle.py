"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import pytest
from oracle import differences

from leafline.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert differences(catalogue.QUERIES[name](spark, SF), catalogue.ORACLE_SQL[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_filters_reach_the_scan(spark):
    plan = catalogue.QUERIES["q6_semi_join"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(toxic), EqualTo(toxic,1)" in plan
    assert "text" not in plan.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("name", ["q1_fk_joins", "q9_answered_later", "q17_iou_pairs", "q50_owing_arms"])
def test_no_cartesian_product(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
