"""What the physical plans must and must not contain. Nothing is executed but small size checks."""

from __future__ import annotations

import os
import re
from datetime import date

import pytest

from tradewind.queries import all_queries
from tradewind.sources.driver import Shop

SF = "/root/testdata/sf0.001"
PYTHON = {"forecast_fit", "walk_forward", "walk_forward_summary"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")


# Loads, streams and fitted models run jobs while they are built: their results are stored ones.
EAGER = re.compile("metric_prepared|brand_itemsets|etl_(line_store|full|load|boot|reconcile_stored|jsonl)|stream_|forecast_(runs|files|metrics)|churn_(score|gradient)")
DATED_ORDERS = """
kpi_summary revenue_by_day top_products slow_movers revenue_by_channel repeat_purchase_rate aov_by_device aov_median
gross_margin_by_category stockouts_at_risk funnel_last_30d sq_daily_revenue sq_top_skus sq_margin_category sq_aov_device
kpi_period_delta repeat_rate_delta channel_share product_concentration slow_capital best_aov_channel funnel_drops
funnel_point_value kpi_mtd category_vs_prior velocity_heatmap top25_skus mart_product_velocity mart_stockout_risk
tied_capital_slow forecast_history forecast_series forecast_fit forecast_baseline walk_forward walk_forward_summary
walk_forward_baseline forecast_totals forecast_7d forecast_overlay forecast_cover residual_hist forecast_errors forecast_alert
cold_start etl_incremental_window etl_incremental_items
""".split()
DATED_LINES = """
top_products slow_movers gross_margin_by_category stockouts_at_risk sq_top_skus sq_margin_category product_concentration
slow_capital category_vs_prior velocity_heatmap top25_skus mart_product_velocity mart_stockout_risk tied_capital_slow
forecast_history forecast_series forecast_fit forecast_baseline walk_forward walk_forward_summary walk_forward_baseline
forecast_totals forecast_7d forecast_overlay forecast_cover residual_hist forecast_errors forecast_alert cold_start
etl_incremental_window etl_incremental_items
""".split()
DATED_EVENTS = "funnel_last_30d funnel_drops funnel_point_value cart_abandonment sq_abandonment etl_incremental_window".split()


@pytest.fixture(scope="module")
def plans(spark):
    Shop(spark, SF).line_store()  # stored once, by a job of its own
    Shop(spark, SF).dated(date(2001, 7, 1), date(2001, 8, 1)).order_items()
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.maxMetadataStringLength": "4000"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)  # as if every table were large
    spark.sparkContext.setJobGroup("plans", "building")
    try:
        return {
            name: q(spark, SF)._jdf.queryExecution().executedPlan().toString()
            for name, q in all_queries().items()
            if not EAGER.match(name)
        }
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)


def test_building_runs_no_job(spark, plans):
    assert len(plans) > 100 and spark.sparkContext.statusTracker().getJobIdsForGroup("plans") == []


def _scans(plan: str, column: str) -> list[str]:
    """What is pushed into each scan that reads the column."""
    return [m[2] for m in re.finditer(r"FileScan parquet \[([^\]]*)\].*?PushedFilters: \[(.*?)\], ReadSchema", plan) if column in m[1]]


def test_date_windows_reach_the_scans(plans):
    for names, column in ((DATED_ORDERS, "o_orderdate"), (DATED_EVENTS, "ts#")):
        for name in names:
            scans = _scans(plans[name], column)
            assert scans and all("GreaterThanOrEqual" in s and "LessThan" in s for s in scans), (name, scans)


def test_date_windows_open_only_their_partitions_of_the_lines(plans):
    for name in DATED_LINES:
        scans = re.findall(r"FileScan parquet \[[^\]]*l_orderkey[^\]]*\].*?PartitionFilters: \[(.*?)\], PushedFilters", plans[name])
        assert scans and all(re.search(r"dt#\d+ >= .*dt#\d+ <= ", s) for s in scans), (name, scans)


def test_lines_are_read_once(plans):
    assert len(_scans(plans["promo_incremental_margin"], "l_partkey")) == 1
    assert len(_scans(plans["dq_checks"], "l_partkey")) == 1
    assert len(_scans(plans["mart_fulfillment_sla"], "o_orderkey")) <= 2


def test_no_cross_joins(plans):
    bad = [n for n, p in plans.items() if "CartesianProduct" in p or "NestedLoopJoin" in p]
    assert bad == []


def test_broadcasts_are_left_to_the_size_limit(plans):
    assert [n for n, p in plans.items() if "BroadcastHashJoin" in p] == []


def test_python_only_where_a_model_is_fitted(plans):
    python = {n for n, p in plans.items() if re.search(r"InPandas|EvalPython|MapInArrow", p)}
    assert python == PYTHON


def test_only_needed_columns_are_read(plans):
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plans["mart_daily_revenue"])
    read = {c.split("#")[0] for s in scans for c in s.split(",")}
    assert read == {"o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"}
    assert "l_tax" not in plans["mart_category_pnl"]


def test_ranked_groups_are_cut_before_the_shuffle(plans):
    for name in ("stg_dedupe", "order_history"):
        assert re.search(r"WindowGroupLimit .*Partial", plans[name]), name


def test_top_lists_do_not_sort_everything(plans):
    for name in ("top_products", "slow_movers", "stockouts_at_risk", "sq_top_skus", "top25_skus"):
        assert "TakeOrderedAndProject" in plans[name], name


def test_shuffles_carry_sums_not_rows(plans):
    """Facts are summed where they are read, before the first exchange of the aggregation."""
    for name in ("mart_daily_revenue", "mart_channel_perf", "kpi_summary", "rollup_daily", "stock_running", "sessionize"):
        assert "partial_" in plans[name], name
