"""Every registered query against its SQL; queries without SQL must return rows."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from workload.compare import compare, connect
from workload.registry import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


# All work stays in the JVM, and no join lacks a key.
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "InPandas", "InArrow")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    plans = []

    def run(session, folder):
        df = queries()[name](session, folder)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    assert compare(spark, duck, run, oracle_sql().get(name), sf_dir) is None
    assert not [node for node in UNWANTED if node in plans[0]]


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 70
