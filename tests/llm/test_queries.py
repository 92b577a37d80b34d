"""Every registered corpus query against its SQL, and the pipeline's contract."""

import pytest

from __spark_entry__ import oracle_sql, queries
from wattframe.llm.registry import ORACLES, QUERIES
from workload.compare import compare, connect

NATIVE = ("op4_", "op5_", "op8_", "op9_", "op10_")
PYTHON = ("BatchEvalPython", "ArrowEvalPython", "InPandas", "InArrow")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    run, plans = QUERIES[name], []

    def planned(session, folder):
        df = run(session, folder)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    assert compare(spark, connect(sf_dir), planned, ORACLES.get(name), sf_dir) is None
    assert "CartesianProduct" not in plans[0] and "BroadcastNestedLoopJoin" not in plans[0]
    if name.startswith(NATIVE):
        assert not [node for node in PYTHON if node in plans[0]]


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert set(ORACLES) <= set(oracle_sql())
