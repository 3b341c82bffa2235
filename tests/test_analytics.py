from __future__ import annotations

from datetime import date, datetime

import pytest
from helpers import MONEY, frame, rows
from test_marts import AS_OF, tiny_categories, tiny_customers, tiny_items, tiny_orders, tiny_products

from pyspark.sql import functions as F
from tradewind.functions.quantiles import group_quantiles
from tradewind.plans import analytics as an
from tradewind.plans import metrics as mt
from tradewind.plans import reports as rp

EMPTY = datetime(2030, 1, 1)


def stock(spark):
    inventory = frame(spark, "variant_id bigint, warehouse_code string, on_hand bigint, reserved bigint, reorder_point bigint",
                      [(11, "MAIN", 5, 0, 10), (11, "EAST", 4, 1, 10), (21, "MAIN", 30, 0, 10), (31, "MAIN", 2, 0, 5),
                       (51, "MAIN", 9, 2, 5)])
    variants = frame(spark, "id bigint, product_id bigint, size string, color string",
                     [(11, 1, "S", "red"), (21, 2, "S", "red"), (31, 3, "S", "red"), (41, 4, "S", "red"), (51, 5, "S", "red")])
    return inventory, variants


def test_kpi_and_empty_window(spark):
    o = tiny_orders(spark)
    assert rows(an.kpi_summary(o, AS_OF, 30)) == [(6, 270.0, 45.0, 2)]
    assert rows(an.kpi_summary(o, EMPTY, 30)) == [(0, 0.0, 0.0, 0)]
    with pytest.raises(ValueError):
        an.kpi_summary(o, AS_OF, 366)


def test_channel_revenue_adds_up(spark):
    o = tiny_orders(spark)
    by = an.revenue_by_channel(o, AS_OF, 30).collect()
    assert [r.channel for r in by] == ["email", "organic", "direct"]
    device = an.aov_by_device(o, AS_OF, 30).collect()
    assert sum(float(r.revenue) for r in by) == sum(float(r.revenue) for r in device) == 400.0


def test_median(spark):
    got = {(r.device_type, r.channel): (r.orders, r.aov, r.median_aov)
           for r in an.aov_median(tiny_orders(spark), AS_OF, 30).collect()}
    assert got["desktop", "email"] == (3, pytest.approx(110 / 3), 20.0)
    assert got["tablet", "organic"] == (2, 65.0, 65.0)


def test_group_quantiles_against_sorting(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    data = [("hot", int(v)) for v in rng.integers(0, 50_000, 900)] + [("cold", int(v)) for v in rng.integers(0, 90, 60)]
    data += [(None, 5), (None, 8), ("one", 3), ("void", None)]
    df = frame(spark, "k string, v bigint", data)
    got = {r.k: r for r in group_quantiles(df, ["k"], "v", {"a": 0.0, "b": 0.37, "c": 0.9, "d": 1.0}, 1000).collect()}
    assert set(got) == {"hot", "cold", None, "one"}
    for k, r in got.items():
        values = [v for kk, v in data if kk == k and v is not None]
        assert r.n == len(values)
        for name, q in {"a": 0.0, "b": 0.37, "c": 0.9, "d": 1.0}.items():
            assert r[name] == pytest.approx(float(np.quantile(values, q)))


def test_slow_movers_against_the_published_form(spark):
    inventory, variants = stock(spark)
    o, i, p = tiny_orders(spark), tiny_items(spark), tiny_products(spark)
    fixed = {r.sku: (r.units_sold, r.on_hand) for r in an.slow_movers(p, i, o, inventory, variants, AS_OF, 30, 8).collect()}
    assert fixed == {"A": (8, 9), "B": (4, 30), "C": (7, 2), "D": (2, 0), "E": (0, 9)}
    literal = {r.sku: r.units_sold for r in an.slow_movers_literal(p, i, inventory, variants, 104).collect()}
    assert literal == {"A": 58, "B": 104, "C": 7, "D": 2, "E": 0}  # cancelled and refunded lines count


def test_stockout_rounds_half_to_even(spark):
    inventory = frame(spark, "variant_id bigint, warehouse_code string, on_hand bigint, reorder_point bigint",
                      [(v, "MAIN", h, 1) for v, h in ((1, 13), (2, 27), (3, 28), (4, 1), (5, 9))])
    variants = frame(spark, "id bigint, product_id bigint, size string, color string", [(v, 1, "S", "r") for v in range(1, 6)])
    products = frame(spark, "id bigint, sku string, name string", [(1, "A", "Alpha")])
    orders = frame(spark, "id bigint, status string, placed_at timestamp_ntz", [(1, "paid", "2024-03-01 00:00:00")])
    lines = frame(spark, "order_id bigint, variant_id bigint, quantity bigint", [(1, v, 56) for v in range(1, 5)])
    got = an.stockouts_at_risk(lines, orders, inventory, variants, products, AS_OF, 28).collect()
    assert [(r.on_hand, r.days_of_cover) for r in got] == [(1, 0), (13, 6), (27, 14)]  # 0.5, 6.5, 13.5; 14.0 is out


def test_abandonment_and_repeat(spark):
    carts = frame(spark, "status string, created_at timestamp_ntz",
                  [("abandoned", "2024-03-01"), ("converted", "2024-03-01"), ("active", "2024-03-01"), ("abandoned", "2023-01-01")])
    assert rows(an.cart_abandonment(carts, AS_OF)) == [(1, 1, 3, 0.3333)]
    assert rows(an.cart_abandonment(carts, EMPTY)) == [(0, 0, 0, 0.0)]
    o = tiny_orders(spark)
    assert rows(an.repeat_purchase_rate(o, AS_OF, 90)) == [(3, 3, 1.0)]
    assert rows(an.repeat_purchase_rate(o, EMPTY, 90)) == [(0, 0, 0.0)]


def test_margin_drops_uncategorised(spark):
    got = an.gross_margin_by_category(
        tiny_items(spark), tiny_orders(spark), tiny_products(spark), tiny_categories(spark), AS_OF, 30)
    assert [(r.category, float(r.revenue), r.margin_pct) for r in got.collect()] == [
        ("Shoes", 270.0, pytest.approx(151 / 270)), ("Hats", 0.0, None)]


def test_funnel_counts(spark):
    events = frame(spark, "event_type string, occurred_at timestamp_ntz",
                   [("view", "2024-03-01"), ("view", "2024-03-02"), ("add_to_cart", "2024-03-02"), ("wishlist", "2024-03-02")])
    carts = frame(spark, "status string, created_at timestamp_ntz", [("active", "2024-03-01"), ("converted", "2024-03-01")])
    o = tiny_orders(spark)
    assert rows(an.funnel_last_30d(events, carts, o, AS_OF)) == [(2, 1, 1, 8)]
    assert rows(an.funnel_last_30d(events, carts, o, EMPTY)) == [(0, 0, 0, 0)]
    drops = rp.funnel_drops(events, carts, o, AS_OF).orderBy("position").collect()
    assert [(r.share_pct, r.drop_pct, r.is_worst) for r in drops] == [
        (100.0, None, False), (50.0, 50.0, True), (400.0, -700.0, False)]


def test_period_delta(spark):
    got = {r.metric: r for r in rp.kpi_period_delta(tiny_orders(spark), AS_OF, 15).collect()}
    assert (got["orders"].current, got["orders"].prior) == (2.0, 4.0)
    assert (got["orders"].delta_pct, got["orders"].direction) == (50.0, "down")
    empty = {r.metric: (r.current, r.prior, r.delta_pct, r.direction)
             for r in rp.kpi_period_delta(tiny_orders(spark), EMPTY, 15).collect()}
    assert empty["revenue"] == (0.0, 0.0, 0.0, "up")
    rate = rp.repeat_rate_delta(tiny_orders(spark), AS_OF, 20).first()
    assert (rate.repeat_rate, rate.prior_rate) == (0.6667, 0.5)


def test_shares_and_best_channel(spark):
    o = tiny_orders(spark)
    share = {r.channel: (r.share, r.rank, r.top3_share) for r in rp.channel_share(o, AS_OF, 30).collect()}
    assert share["email"] == (50.0, 1, 100.0)
    best = rp.best_aov_channel(o, AS_OF, 30).first()
    assert (best.channel, best.aov, best.book_aov, best.uplift_per_100) == ("organic", 65.0, 45.0, 2000.0)
    assert rp.best_aov_channel(o, EMPTY, 30).first().channel is None


def test_same_weekday(spark):
    fct = frame(spark, f"order_id bigint, customer_id bigint, order_date date, grand_total {MONEY}, is_revenue_recognized boolean",
                [(1, 1, "2024-01-01", "100.00", True), (2, 1, "2024-01-08", "84.00", True), (3, 1, "2024-01-15", "84.00", True)])
    got = {r.date: r for r in rp.wow_same_weekday(fct).collect()}
    assert (got[date(2024, 1, 8)].wow_pct, got[date(2024, 1, 8)].is_alert) == (-16.0, True)
    assert got[date(2024, 1, 15)].is_alert is False
    assert got[date(2024, 1, 5)].wow_pct is None


# ---- metric layer -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(spark):
    carts = frame(spark, "id bigint, status string, created_at timestamp_ntz", [(1, "active", "2024-03-01")])
    makers = {"orders": tiny_orders, "order_items": tiny_items, "products": tiny_products,
              "categories": tiny_categories, "customers": tiny_customers}
    tables = {name: (lambda make=make: make(spark)) for name, make in makers.items()}
    return mt.shop_model({**tables, "carts": lambda: carts}, AS_OF)


def test_metric_equals_analytics(spark, model):
    got = {r.channel: float(r.revenue) for r in mt.metric_query(
        model, ["Orders.revenue"], ["Orders.channel"], time_dimension="Orders.placed_at",
        dates=(date(2024, 2, 10), date(2024, 3, 10))).collect()}
    assert got == {"email": 175.0, "direct": 70.0, "organic": 130.0}


def test_items_filter_only_through_orders(model):
    assert mt.metric_query(model, ["OrderItems.units"]).first().units == 171
    joined = mt.metric_query(model, ["OrderItems.units"], ["Orders.status"]).collect()
    got = {r.status: r.units for r in joined}
    assert got[None] == 100  # the cancelled order is not in Orders
    assert got["refunded"] == 50


def test_has_many_join_does_not_fan_out(model):
    whole = mt.metric_query(model, ["Orders.revenue", "Orders.count"]).first()
    by_product = mt.metric_query(model, ["Orders.revenue", "Orders.count"], ["Products.category_name"])
    got = {r.category_name: (float(r.revenue), r["count"]) for r in by_product.collect()}
    # order 9 holds lines of both categories: counted once in each, not once per line
    assert got["Shoes"] == (10 + 20 + 30 + 40 + 60 + 80 + 90, 7)
    assert got["Hats"] == (90.0, 1)
    assert float(whole.revenue) == 412.0


def test_measures_of_two_cubes(model):
    got = mt.metric_query(model, ["Customers.count", "Orders.count"], ["Customers.signup_channel"])
    assert set(got.columns) == {"signup_channel", "customers_count", "orders_count"}
    assert {r.signup_channel: (r.customers_count, r.orders_count) for r in got.collect()} == {
        "email": (2, 5), "direct": (1, 3), "organic": (1, 2)}
    no_dims = mt.metric_query(model, ["Customers.count", "Orders.count"]).first()
    assert (no_dims.customers_count, no_dims.orders_count) == (4, 10)


def test_segment_and_repeat(spark, model):
    got = mt.metric_query(model, ["Customers.count"], segments=["Customers.opted_in_to_marketing"]).first()
    assert got["count"] == 2
    assert rows(mt.metric_repeat(tiny_orders(spark))) == [(3, 3, 1.0)]


def test_date_range_text():
    day = date(2024, 3, 10)
    assert mt.date_range(day, "last 30 days") == (date(2024, 2, 9), date(2024, 3, 9))
    assert mt.date_range(day, "2024-01-01 to 2024-01-31") == (date(2024, 1, 1), date(2024, 1, 31))
    assert mt.date_range(day, "today") == (day, day)
    with pytest.raises(ValueError):
        mt.date_range(day, "soon")


def test_unknown_join_is_refused(model):
    with pytest.raises(ValueError):
        mt.metric_query(model, ["Carts.count"], ["Orders.channel"])


def test_rollup_adds_up(spark):
    rollup = mt.daily_rollup(tiny_orders(spark))
    levels = {(r.level, r.channel, r.device_type): (r["count"], float(r.revenue)) for r in mt.rollup_levels(rollup).collect()}
    assert levels[3, None, None] == (10, 412.0)
    assert levels[1, "email", None] == (5, 205.0)
    approx = {r.channel: r.unique_customers_approx for r in mt.rollup_unique_approx(rollup).collect()}
    assert approx == {"email": 1, "direct": 1, "organic": 1}
    assert rollup.agg(F.sum("count")).first()[0] == 10


def test_stored_rollup_is_refreshed_by_day(spark, tmp_path):
    path = str(tmp_path / "rollup")
    orders = tiny_orders(spark)
    mt.refresh_rollup(orders, path, date(2000, 1, 1))
    want = rows(mt.daily_rollup(orders).select("day", "channel", "device_type", "count", "revenue"))
    stored = lambda: rows(mt.read_rollup(spark, path).select("day", "channel", "device_type", "count", "revenue"))
    assert stored() == want
    # The only order of March 3 is cancelled; earlier days change too but lie before the refresh.
    changed = orders.withColumn("status", F.when(F.col("id").isin(8, 1), "cancelled").otherwise(F.col("status")))
    mt.refresh_rollup(changed, path, date(2024, 3, 1))
    assert stored() == [r for r in want if r[0] != date(2024, 3, 3)]
