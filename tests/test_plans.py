"""Plan shape of the registered queries: no pair products, pruned scans, bounded windows."""

import re

import pytest

from __spark_entry__ import queries
from mixedframe.plans import registered

PAIR_PRODUCTS = ("CartesianProduct", "BroadcastNestedLoopJoin")

def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    """The plan with untruncated scan details."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", sorted(registered()))
def test_no_pair_product(spark, data_dir, name):
    text = plan(queries()[name](spark, data_dir))
    assert not [p for p in PAIR_PRODUCTS if p in text]


def test_filters_and_columns_reach_the_scan(spark, data_dir):
    text = formatted(queries()["filter_compound"](spark, data_dir))
    pushed = re.search(r"PushedFilters: \[(.*)\]", text).group(1)
    assert "Not(EqualTo(l_returnflag,R))" in pushed and "In(l_linestatus, [F,O])" in pushed
    read = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "l_extendedprice" not in read and "l_shipdate" not in read


def test_quantiles_scan_two_columns(spark, data_dir):
    text = formatted(queries()["grouped_multi_agg"](spark, data_dir))
    assert {r for r in re.findall(r"ReadSchema: struct<([^>]*)>", text)} <= {
        "event_type:string,value:double", "event_type:string", "value:double",
    }


def test_group_limit_runs_before_the_shuffle(spark, data_dir):
    text = plan(queries()["top_k_per_group"](spark, data_dir))
    assert re.search(r"WindowGroupLimit.*Partial", text) and re.search(r"WindowGroupLimit.*Final", text)
