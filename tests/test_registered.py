import pytest
from conftest import SF

import __spark_entry__ as entry
from newsloom.checks.compare import connect, difference
from newsloom.checks.oracle import ORACLE
from newsloom.checks.queries import REGISTERED


@pytest.fixture(scope="module")
def db():
    return connect(SF)


def test_every_query_has_a_sql_twin():
    assert set(REGISTERED) == set(ORACLE) <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", REGISTERED)
def test_query_equals_its_sql_twin_and_multiplies_no_rows_out(spark, db, name):
    frame = REGISTERED[name](spark, SF)
    assert difference(frame, db, ORACLE[name]) is None
    plan = plan_of(frame)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_prune_and_cut_early(spark):
    best = plan_of(REGISTERED["top_stories"](spark, SF))
    assert "BroadcastHashJoin" in best and "Sort" not in best
    assert plan_of(REGISTERED["daily_publication"](spark, SF)).count("WindowGroupLimit") == 2
    assert plan_of(REGISTERED["translation_per_language"](spark, SF)).count("WindowGroupLimit") == 2
    assert "text" not in plan_of(REGISTERED["articles_by_source"](spark, SF)).split("ReadSchema")[1]
