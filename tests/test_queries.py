"""Every registered query against DuckDB on the given tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import differences, duck

FOLDER = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def catalogue(spark):
    return entry.queries(), entry.oracle_sql(), duck(FOLDER)


def test_every_sql_belongs_to_a_query(catalogue):
    queries, sql, _ = catalogue
    assert set(sql) <= set(queries) and len(queries) > 120


@pytest.mark.parametrize("family", ["stage1", "features", "labels", "evaluation", "reports", "selection", "tables"])
def test_queries_match_sql(spark, catalogue, family):
    queries, sql, con = catalogue
    problems = {}
    for name, run in queries.items():
        if run.family == family and name in sql:
            problem = differences(run(spark, FOLDER), con, sql[name])
            if problem:
                problems[name] = problem
    assert not problems


def test_training_queries_give_rows(spark, catalogue):
    queries, sql, con = catalogue
    for name in ("ML2_random_forest", "T6_feature_importance"):
        assert queries[name](spark, FOLDER).count() > 0, name


def test_entry(spark):
    assert entry.entry(spark).count() > 0
