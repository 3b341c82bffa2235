"""Time the headline queries: one warm-up run, then the median of the timed runs, results fully produced.

BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS set the data, the cores and the timed runs;
names on the command line replace the headline list, `all` runs every query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tradewind.queries import all_queries
from tradewind.session import local_session

HEADLINE = """
mart_daily_revenue daily_revenue_dense executive_daily mart_product_velocity mart_category_pnl mart_channel_perf
mart_cohort_retention mart_customer_lifecycle mart_funnel mart_stockout_risk mart_inventory_aging mart_promo_lift
promo_incremental_margin mart_fulfillment_sla mart_attribution churn_features mart_product_affinity ltv_cac
kpi_summary top_products slow_movers repeat_purchase_rate cohort_retention aov_median gross_margin_by_category
stockouts_at_risk funnel_last_30d metric_orders metric_items rollup_daily sq_top_skus kpi_period_delta
channel_share velocity_heatmap wow_same_weekday fct_order_items dim_product stg_dedupe scd2_product
etl_reconcile forecast_history forecast_baseline forecast_fit walk_forward sessionize stock_running order_pricing
cart_totals order_history order_audit dq_checks
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    queries = all_queries()
    names = sys.argv[1:] or HEADLINE
    names = list(queries) if names == ["all"] else names
    spark = local_session(cpus, app="tradewind-bench")

    def once(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    # The first queries of a fresh JVM measure its compiler, so they run before the clock starts.
    for name in ("mart_daily_revenue", "mart_category_pnl", "mart_product_velocity"):
        for _ in range(2):
            once(name)

    seconds = {}
    for name in names:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 4)
        print(f"{seconds[name]:8.3f} {name}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": total,
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": cpus,
        "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
