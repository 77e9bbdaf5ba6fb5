"""Every registered query of the search-corpus operators against DuckDB on the smallest data."""

import pytest
from compare import same_as_sql

from lodestone.plans.oracles import ORACLE_SQL
from lodestone.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLE_SQL)))
def test_same_as_sql(spark, duck, small, name):
    same_as_sql(QUERIES[name](spark, small), duck, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["source", "word", "score", "tf", "df", "rank"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_pushdown(spark, small):
    plan = QUERIES["results_scan"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "props" not in plan
