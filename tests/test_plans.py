"""Scale guards on the physical plans of the registered queries."""

import re

import pytest

from shopstream.plans import all_queries  # noqa: F401
from shopstream.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {n: plan(f(spark, SF)) for n, f in QUERIES.items()}


def test_no_cartesian_products(plans):
    for n, p in plans.items():
        assert "CartesianProduct" not in p, n


def test_nested_loop_joins_only_against_bounded_sides(plans):
    # allowed: one-row scalars (max start time for the split, counts, the generic pool size)
    # and the back-off fill list (k rows)
    allowed = {"time_split", "rolling_window", "recommend", "recommend_eval", "recommend_enriched",
               "eval_metrics", "eval_popularity", "eval_coverage", "transitions", "transitions_merge",
               "item_prior", "dataset_profile", "image_assign", "category_cover", "trial_metrics", "negative_samples"}
    for n, p in plans.items():
        if "BroadcastNestedLoopJoin" in p:
            assert n in allowed, n


def test_top_k_limits_run_before_the_shuffle(plans):
    for n in ["sessions", "vocab", "recent_views", "home_rows", "related_products", "recommend", "recommend_eval"]:
        p = plans[n]
        assert ("WindowGroupLimit" in p and "Partial" in p) or "TakeOrderedAndProject" in p, n


def test_session_cap_is_partial_window_group_limit(plans):
    p = plans["sessions"]
    assert re.search(r"WindowGroupLimit .*Partial", p)


def test_filters_reach_the_scan(plans):
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plans["export_window"]


def test_pruned_scans(plans):
    # the click adapter reads four event columns, not the whole table
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,props:string>" in plans["sessions_raw"]


def test_no_python_udfs_outside_knn(plans):
    for n, p in plans.items():
        if n != "knn_items":
            assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "InPandas" not in p, n


def test_events_never_shuffled_by_user_alone(plans):
    # the gap sessioniser shuffles events by (user, day); only one-row-per-bucket summaries go by user
    p = plans["sessions_raw"].splitlines()
    for i, line in enumerate(p):
        if re.search(r"Exchange hashpartitioning\(user_id#\d+L?, \d+\)", line):
            assert "HashAggregate" in p[i + 1], p[i + 1]
