"""Driver contract and plan-shape guard for every registered query (sf0.001)."""

import __spark_entry__ as E

from conftest import SF_SMALL


def test_entry_and_oracle_coverage(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "rank" in df.columns
    assert set(E.QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


def test_no_cartesian_or_nested_loop_plans(spark):
    bad = {}
    for name in E.QUERIES:
        fn = E.queries()[name]
        plan = fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        flags = [k for k in ("CartesianProduct", "BroadcastNestedLoopJoin") if k in plan]
        if flags:
            bad[name] = flags
    assert bad == {}
