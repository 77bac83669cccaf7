"""The operators that SQL can express give the rows that DuckDB gives on the same tables."""

import pytest
from oracle import differences

from leafline.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_operator_matches_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF) == ""
