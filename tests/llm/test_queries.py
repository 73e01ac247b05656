import pandas as pd
import pytest

import __spark_entry__ as contract
from cairn.llm.checks import CHECKS
from cairn.llm.queries import QUERIES
from tests.conftest import DATA
from tools.compare import connect, normal


def test_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 11)) and "pipeline" in contract.queries()
    assert set(CHECKS) <= set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_agrees_with_its_sql(spark, name):
    frame = QUERIES[name](spark, DATA)
    mine = pd.DataFrame([tuple(r) for r in frame.collect()], columns=frame.columns, dtype=object)
    result = connect(DATA).execute(CHECKS[name])
    other = pd.DataFrame(result.fetchall(), columns=[c[0] for c in result.description], dtype=object)
    assert sorted(mine.columns) == sorted(other.columns)
    assert normal(mine) == normal(other)


@pytest.mark.parametrize("name", ["op5_adaptive_rules", "op9_bottom_k"])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))
