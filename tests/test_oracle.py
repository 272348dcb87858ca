"""Every registered query beside its SQL text, whole results, at sf0.01; no plan pairs all rows with all rows."""

import pytest

from lodework.plans import PLANS
from tests.harness import DATA, compare, connect

SF_DIR = f"{DATA}/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(PLANS))
def test_query_equals_sql(spark, con, name):
    registered = PLANS[name]
    assert registered.oracle, f"{name} has no SQL text"
    df = registered.run(spark, SF_DIR)
    problem, rows = compare(name, df, con, registered.oracle)
    assert problem is None, problem
    assert rows > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry_gives_rows(spark):
    import __spark_entry__ as contract

    df = contract.entry(spark)
    assert df.columns == ["n_name", "revenue", "lines"]
    assert df.count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
