from __future__ import annotations

from datetime import date, datetime

import pytest
from helpers import MONEY, frame, rows

from pyspark.sql import functions as F
from tradewind.functions.exprs import in_ts_window, sunday_week_number
from tradewind.plans import analytics as an
from tradewind.plans import dims_facts as d
from tradewind.plans import marts as m

ORDERS = (
    f"id bigint, customer_id bigint, status string, grand_total {MONEY}, channel string, device_type string,"
    " placed_at timestamp_ntz, delivered_at timestamp_ntz"
)
AS_OF = datetime(2024, 3, 10, 12, 0, 0)


def tiny_orders(spark):
    o = frame(spark, ORDERS, [
        (1, 1, "paid", "10.00", "email", "desktop", "2024-02-09 12:00:00", None),
        (2, 1, "fulfilled", "20.00", "email", "desktop", "2024-02-09 23:59:59", None),
        (3, 2, "shipped", "30.00", "direct", "mobile", "2024-02-10 00:00:00", None),
        (4, 2, "delivered", "40.00", "direct", "mobile", "2024-02-20 10:30:00", "2024-02-21 11:29:59"),
        (5, 2, "cancelled", "50.00", "direct", "mobile", "2024-02-20 11:00:00", None),
        (6, 3, "refunded", "60.00", "organic", "tablet", "2024-03-01 00:00:00", None),
        (7, 3, "pending", "70.00", "organic", "tablet", "2024-03-02 00:00:00", None),
        (8, 1, "paid", "80.00", "email", "desktop", "2024-03-03 00:00:00", None),
        (9, 1, "delivered", "90.00", "email", "mobile", "2024-03-10 12:00:00", "2024-03-10 12:59:59"),
        (10, 1, "delivered", "5.00", "email", "mobile", "2024-03-10 12:00:01", "2024-03-10 13:00:01"),
        (11, 2, "paid", "7.00", "direct", "mobile", "2023-12-31 23:00:00", None),
        (12, 1, "cancelled", "9.00", "email", "mobile", "2024-03-04 00:00:00", None),
    ])
    filler = {c: F.lit(None).cast("string") for c in ("order_number", "utm_source", "utm_campaign")}
    filler |= {c: F.lit(None).cast("timestamp_ntz") for c in ("paid_at", "fulfilled_at", "cancelled_at")}
    filler |= {c: F.lit(0).cast("decimal(12,2)") for c in ("subtotal", "discount_total", "shipping_total", "tax_total")}
    return o.withColumns(filler)


CUSTOMERS = [
    (1, "email", True, "2023-12-01 00:00:00"),
    (2, "direct", False, "2024-01-15 10:00:00"),
    (3, "organic", True, "2024-02-01 00:00:00"),
    (4, "email", False, "2024-02-01 00:00:00"),
]


def tiny_customers(spark):
    c = frame(spark, "id bigint, signup_channel string, marketing_opt_in boolean, created_at timestamp_ntz", CUSTOMERS)
    return c.withColumns({x: F.lit("x") for x in ("email", "first_name", "last_name", "signup_country")})


ITEMS = f"order_id bigint, product_id bigint, variant_id bigint, quantity bigint, unit_price {MONEY}, unit_cost {MONEY}"


def tiny_items(spark):
    return frame(spark, ITEMS, [
        (1, 1, 11, 2, "5.00", "2.00"),
        (2, 1, 11, 1, "20.00", "8.00"),
        (3, 2, 21, 3, "10.00", "4.00"),
        (4, 2, None, 1, "40.00", "30.00"),
        (5, 2, 21, 100, "0.50", "0.10"),
        (6, 1, 12, 50, "1.20", "0.50"),
        (7, 3, 31, 7, "10.00", "2.00"),
        (8, 1, 11, 4, "20.00", "5.00"),
        (9, 4, 41, 2, "0.00", "1.00"),
        (9, 1, 12, 1, "90.00", "45.00"),
    ]).withColumn("line_discount", F.lit(0).cast("decimal(12,2)"))


def tiny_products(spark):
    p = frame(spark, f"id bigint, sku string, name string, brand string, category_id bigint, price {MONEY},"
              f" cost {MONEY}, is_active boolean", [
        (1, "A", "Alpha", "X", 1, "20.00", "8.00", True),
        (2, "B", "Beta", "X", 1, "10.00", "4.00", True),
        (3, "C", "Gamma", "Y", None, "10.00", "2.00", True),
        (4, "D", "Delta", "Y", 2, "0.00", "1.00", True),
        (5, "E", "Unsold", "Y", 2, "9.00", "3.00", True),
        (6, "F", "Gone", "Y", 2, "9.00", "3.00", False),
    ])
    return p.withColumn("launched_at", F.lit("2020-01-01").cast("timestamp_ntz"))


def tiny_categories(spark):
    return frame(spark, "id bigint, slug string, name string", [(1, "shoes", "Shoes"), (2, "hats", "Hats")])


@pytest.fixture(scope="module")
def shop(spark):
    return {
        "orders": tiny_orders(spark).cache(),
        "customers": tiny_customers(spark).cache(),
        "items": tiny_items(spark).cache(),
        "products": tiny_products(spark).cache(),
        "categories": tiny_categories(spark).cache(),
    }


@pytest.fixture(scope="module")
def fct(shop):
    return d.fct_orders(shop["orders"])


@pytest.fixture(scope="module")
def lines(shop):
    return d.fct_order_items(shop["items"], shop["orders"])


@pytest.fixture(scope="module")
def dim(shop):
    return d.dim_product(shop["products"], shop["categories"])


def test_whole_hours_truncate(fct):
    got = {r.order_id: r.hours_to_deliver for r in fct.filter("delivered_at is not null").collect()}
    assert got == {4: 24, 9: 0, 10: 1}
    assert fct.filter("order_id = 1").first().hours_to_deliver is None


def test_three_revenue_definitions(shop, fct, lines):
    assert sorted(r.order_id for r in m.recognized_orders(fct).collect()) == [1, 2, 3, 4, 8, 9, 10, 11]
    kept = an.revenue_by_day(shop["orders"], AS_OF, days=365).agg(F.sum("orders")).first()[0]
    assert kept == 9  # all but the two cancelled and the one after the window
    assert sorted({r.order_id for r in lines.collect()}) == [1, 2, 3, 4, 7, 8, 9]


def test_window_ends_are_included(spark):
    t = frame(spark, "t timestamp_ntz", [("2024-02-09 12:00:00",), ("2024-02-09 11:59:59",), ("2024-03-10 12:00:00",),
                                         ("2024-03-10 12:00:01",)])
    assert t.filter(in_ts_window("t", AS_OF, 30)).count() == 2


def test_daily_revenue_rows_and_calendar(fct):
    daily = {r.date: r for r in m.mart_daily_revenue(fct).collect()}
    assert list(sorted(daily)) == [date(2023, 12, 31), date(2024, 2, 9), date(2024, 2, 10), date(2024, 2, 20),
                                   date(2024, 3, 3), date(2024, 3, 10)]
    feb9 = daily[date(2024, 2, 9)]
    assert (float(feb9.revenue), feb9.orders, feb9.unique_customers, feb9.aov) == (30.0, 2, 1, 15.0)
    assert daily[date(2024, 2, 10)].revenue_7d_avg == pytest.approx((7 + 30 + 30) / 3)
    dense = {r.date: r for r in m.daily_revenue_dense(fct).collect()}
    assert len(dense) == 71
    assert float(dense[date(2024, 2, 11)].revenue) == 0
    assert dense[date(2024, 2, 11)].revenue_7day_avg == pytest.approx(60 / 7)


def test_executive_prior_needs_exact_date(fct):
    got = {r.date: r for r in m.executive_daily(m.mart_daily_revenue(fct)).collect()}
    assert float(got[date(2024, 3, 10)].revenue_prior) == 30.0  # dated 2024-02-09
    assert got[date(2024, 3, 10)].revenue_yoy_30d == pytest.approx((95 - 30) / 30)
    assert got[date(2024, 3, 3)].revenue_prior is None


def test_category_and_margin(lines, dim):
    got = {(r.category_name, r.order_date): r for r in m.mart_category_pnl(lines, dim).collect()}
    assert float(got["Shoes", date(2024, 2, 9)].gross_margin) == 18.0
    assert got["Hats", date(2024, 3, 10)].margin_pct is None  # zero revenue
    assert (None, date(2024, 3, 2)) in got  # uncategorised product stays
    assert dim.filter("product_id = 4").first().list_margin_pct is None


def test_velocity_buckets(lines, dim):
    got = {r.product_id: r for r in m.mart_product_velocity(lines, dim, date(2024, 3, 10)).collect()}
    assert 6 not in got
    assert (got[1].units_28d, got[1].velocity_bucket, got[1].units_84d) == (5, "slow", 8)
    assert got[1].units_per_day == pytest.approx(5 / 28)
    assert (got[3].units_28d, got[3].velocity_bucket) == (7, "steady")
    assert (got[5].units_28d, got[5].velocity_bucket, got[5].units_per_day) == (0, "dead", None)


def test_velocity_window_spans_29_dates(spark, dim):
    base = "order_date date, product_id bigint, quantity bigint, revenue_cents bigint"
    fact = frame(spark, base, [("2024-02-11", 1, 1, 100), ("2024-02-10", 1, 1, 100), ("2024-03-10", 1, 1, 100)])
    got = m.mart_product_velocity(fact, dim, date(2024, 3, 10)).filter("product_id = 1").first()
    assert (got.units_28d, got.units_84d) == (2, 3)


def test_stockout_edges(spark):
    fact = frame(spark, "order_date date, variant_id bigint, quantity bigint",
                 [("2024-03-01", v, 28) for v in (1, 2, 3, 4)])  # one unit a day
    stock = frame(spark, "variant_id bigint, on_hand bigint",
                  [(1, 6), (2, 3), (2, 4), (3, 13), (4, 14), (5, 100)])
    variants = frame(spark, "id bigint, product_id bigint, size string, color string",
                     [(v, 1, "M", "red") for v in range(1, 7)])
    products = frame(spark, "id bigint, sku string, name string", [(1, "A", "Alpha")])
    got = {r.variant_id: (r.days_of_cover, r.stock_status)
           for r in m.mart_stockout_risk(fact, stock, variants, products, date(2024, 3, 10)).collect()}
    assert got == {1: (6.0, "urgent"), 2: (7.0, "reorder_soon"), 3: (13.0, "reorder_soon"), 4: (14.0, "healthy"),
                   5: (None, "healthy"), 6: (None, "healthy")}


def test_lifecycle_and_ltv(shop, fct):
    life = m.mart_customer_lifecycle(d.dim_customer(shop["customers"], date(2024, 3, 11)), fct, date(2024, 3, 11))
    got = {r.customer_id: (r.lifetime_orders, r.days_since_last_order, r.lifecycle_stage) for r in life.collect()}
    assert got == {1: (5, 1, "active"), 2: (3, 20, "active"), 3: (None, None, "never_purchased"),
                   4: (None, None, "never_purchased")}
    ltv = {r.signup_channel: (r.customers, r.payers, r.ltv) for r in m.ltv_by_segment(life).collect()}
    assert ltv["email"] == (2, 1, 102.5)
    assert ltv["organic"] == (1, 0, 0.0)
    later = m.mart_customer_lifecycle(d.dim_customer(shop["customers"], date(2024, 6, 8)), fct, date(2024, 6, 8))
    assert {r.customer_id: r.lifecycle_stage for r in later.collect()}[1] == "lapsing"  # 90 days


def test_cohort_over_a_year_boundary(fct):
    got = rows(m.mart_cohort_retention(fct), "cohort_month", "active_month")
    assert got == [
        (date(2023, 12, 1), date(2023, 12, 1), 0, 1),
        (date(2023, 12, 1), date(2024, 2, 1), 2, 1),
        (date(2024, 2, 1), date(2024, 2, 1), 0, 1),
        (date(2024, 2, 1), date(2024, 3, 1), 1, 1),
    ]
    pct = m.cohort_retention_pct(m.mart_cohort_retention(fct))
    assert {r.retention_pct for r in pct.filter("months_since_signup = 0").collect()} == {100.0}
    wide = m.cohort_triangle(pct, months=2).orderBy("cohort_month").collect()
    assert [r["2"] for r in wide] == [100.0, None]


def test_funnel_dates_from_each_source(spark):
    events = frame(spark, "event_date date, event_type string",
                   [("2024-01-01", "view"), ("2024-01-01", "wishlist"), ("2024-01-04", "wishlist")])
    carts = frame(spark, "created_date date, status string",
                  [("2024-01-02", "abandoned"), ("2024-01-02", "active"), ("2024-01-01", "converted")])
    fct = frame(spark, "order_date date, is_revenue_recognized boolean", [("2024-01-03", True), ("2024-01-03", False)])
    assert rows(m.mart_funnel(events, carts, fct), "event_date") == [
        (date(2024, 1, 1), 1, None, 1, None),
        (date(2024, 1, 2), None, None, 1, None),
        (date(2024, 1, 3), None, None, None, 1),
        (date(2024, 1, 4), None, None, None, None),
    ]


def test_promo_fan_out(spark):
    redemptions = frame(spark, f"promotion_id bigint, order_id bigint, customer_id bigint, amount_off {MONEY},"
                        " redeemed_at timestamp_ntz",
                        [(1, 1, 1, "1.00", "2024-01-05"), (1, 2, 1, "2.00", "2024-01-06"), (1, 3, 2, "3.00", "2024-01-07"),
                         (1, 9, 2, "9.00", "2024-01-08")])  # order 9 is cancelled: it has no sellable lines
    fct = frame(spark, f"order_id bigint, grand_total {MONEY}", [(1, "10.00"), (2, "20.00"), (3, "30.00"), (9, "90.00")])
    lines = frame(spark, "order_id bigint, customer_id bigint, revenue_cents bigint, cost_cents bigint",
                  [(1, 1, 150, 50), (2, 1, 100, 0), (2, 1, 300, 100), (3, 2, 100, 0), (3, 2, 100, 0), (3, 2, 100, 0),
                   (4, 1, 300, 0), (5, 1, 900, 400)])
    literal = m.mart_promo_lift_literal(redemptions, fct, lines).first()
    assert (literal.redemptions, float(literal.discount_given), float(literal.gross_revenue)) == (6, 14.0, 140.0)
    fixed = m.mart_promo_lift(redemptions, fct, lines).first()
    assert (fixed.redemptions, float(fixed.discount_given), float(fixed.gross_revenue)) == (3, 6.0, 60.0)
    assert float(literal.gross_margin) == float(fixed.gross_margin) == 7.0
    inc = m.promo_incremental_margin(redemptions, lines).first()
    # customer 1: plain orders 3 and 5 → baseline 4; customer 2 has no plain order
    assert (inc.orders, float(inc.net_margin), inc.baseline_margin, inc.incremental_margin) == (2, 1.0, 8.0, -7.0)


def test_attribution_credits_all_revenue_once(shop, fct):
    got = {r.channel: r for r in m.mart_attribution(shop["customers"], fct).collect()}
    total = 10 + 20 + 30 + 40 + 80 + 90 + 5 + 7
    for way in ("first_touch", "last_touch", "linear"):
        assert float(sum(float(r[way]) for r in got.values())) == pytest.approx(total)
    assert float(got["email"].first_touch) == 205.0


def test_ltv_counts_first_six_months(spark):
    fct = frame(spark, f"customer_id bigint, order_date date, grand_total {MONEY}, is_revenue_recognized boolean",
                [(1, "2024-01-31", "10.00", True), (1, "2024-07-30", "20.00", True), (1, "2024-07-31", "40.00", True)])
    cac = frame(spark, f"channel string, cac {MONEY}", [("email", "5.00")])
    got = {r.channel: r for r in m.ltv_cac(tiny_customers(spark), fct, cac).collect()}
    assert (got["email"].customers, got["email"].ltv_6m, got["email"].ltv_to_cac) == (2, 15.0, 3.0)
    assert got["organic"].ltv_to_cac is None


def test_sla_keeps_open_orders(spark):
    ship = frame(spark, "order_id bigint, carrier string, delivered_at timestamp_ntz",
                 [(1, "UPS", "2024-01-02 00:00:00"), (2, "UPS", "2024-01-03 00:00:00"), (3, "UPS", None), (4, "DHL", None)])
    fct = frame(spark, "order_id bigint, placed_at timestamp_ntz", [(i, "2024-01-01 00:00:00") for i in range(1, 5)])
    got = {r.carrier: r for r in m.mart_fulfillment_sla(ship, fct).collect()}
    ups = got["UPS"]
    assert (ups.shipments, ups.delivered, ups.open_orders, ups.mean_hours, ups.p50_hours) == (3, 2, 1, 36.0, 36.0)
    assert ups.p90_hours == pytest.approx(24 + 0.9 * 24)
    assert (got["DHL"].open_orders, got["DHL"].p50_hours) == (1, None)


def test_forecast_overlay_is_latest_run(spark):
    f = frame(spark, "forecast_date date, category_name string, yhat double, yhat_lower double, yhat_upper double,"
              " model_run_at timestamp_ntz",
              [("2024-01-01", "a", 1, 0, 2, "2024-01-01"), ("2024-01-01", "a", 5, 0, 9, "2024-01-02")])
    assert [r.yhat for r in m.forecast_overlay(f).collect()] == [5.0]


def test_week_number_starts_on_sunday(spark):
    t = frame(spark, "d date", [("2023-01-01",), ("2022-01-01",), ("2022-01-02",), ("2024-12-31",)])
    got = {r.d: r.w for r in t.select("d", sunday_week_number("d").alias("w")).collect()}
    assert all(got[x] == int(x.strftime("%U")) for x in got)


def test_calendar_has_no_gaps(spark):
    span = frame(spark, "first date, last date", [("2023-01-01", "2027-12-31")])
    got = d.dim_date(span)
    assert got.count() == 1826
    row = got.filter("date = date'2023-11-05'").first()
    assert (row.day_name, row.day_of_week, row.is_weekend, row.is_holiday_season) == ("Sunday", 1, True, True)
