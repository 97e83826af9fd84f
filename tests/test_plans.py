"""Plans: what is read, pushed down and joined, at the smallest scale."""

import os
import sys

import pytest

from loomdex.plans import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
#: Queries that iterate or write on the way; their plan is only the last step.
SKIP = {"log_groups_stream", "windowed_counts_stream"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - SKIP))
def test_no_query_crosses_tables(spark, name, monkeypatch):
    from loomdex.operators import graph
    from loomdex.plans import session

    plans = []  # of every round that is written on the way

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    cut = session.cut
    for module in (session, graph, *(m for n, m in sys.modules.items() if n.startswith("loomdex.") and hasattr(m, "cut"))):
        if hasattr(module, "cut"):
            monkeypatch.setattr(module, "cut", watched)
    plan = registry.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString() + "".join(plans)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = registry.QUERIES["header_comments"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(kind,script)" in plan and "ReadSchema: struct<doc_id:bigint,text:string,kind:string>" in plan
    plan = registry.QUERIES["bytes_by_type"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "relpath" not in plan and "sha256" not in plan
