"""Every query against its SQL, and what its plan must not hold."""

import pytest

import __spark_entry__ as entry
from conftest import SMALL
from logloom.plans import catalog, oracles
from oracle import compare, connect

QUERIES = catalog.QUERIES
ORACLES = oracles.ORACLES
#: Labels of clusters come out of an iterative method.
WITHOUT_ORACLE = {"error_clusters", "error_cluster_sizes"}


@pytest.fixture(scope="module")
def db():
    return connect(SMALL)


def test_entry_has_them():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_only_clusters_have_no_oracle():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_ORACLE
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WITHOUT_ORACLE))
def test_query(spark, db, name):
    assert compare(spark, db, name, QUERIES[name], ORACLES[name], SMALL) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WITHOUT_ORACLE))
def test_plan(spark, name):
    """No Python per row, no cross join, and only read what is needed."""
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for word in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan
    if "events.parquet" in plan:
        assert ",value#" not in plan.split("FileScan")[-1]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 720 and "spike" in df.columns
