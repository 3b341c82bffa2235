"""Dashboard and board-report numbers, built on the marts and the in-app analytics.

Windows without a partition run only over results already reduced to channels, steps or days.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.exprs import (
    date_lit,
    dbl,
    in_date_window,
    in_ts_window,
    pct,
    ratio,
    sum_if,
    week_of,
    zero_if_null,
)
from tradewind.functions.money import cents, money, sum_money
from tradewind.functions.predicates import not_cancelled, recognized
from tradewind.functions.sizing import sums_by_attribute
from tradewind.plans.analytics import (
    funnel_last_30d,
    kpi_summary,
    product_sales,
    revenue_by_channel,
    top_products,
)
from tradewind.plans.dims_facts import calendar
from tradewind.plans.marts import mart_daily_revenue, mart_promo_lift, recognized_orders

DROP_ALERT_PCT = -15.0  # fixed value: escalate a week-over-week drop beyond this


def _delta(df: DataFrame) -> DataFrame:
    """Adds the size and direction of the change from `prior` to `current`, 0 where prior is 0."""
    change = pct(F.col("current") - F.col("prior"), "prior")
    return df.withColumns({
        "delta_pct": F.abs(change),
        "direction": F.when(change >= 0, "up").otherwise("down"),
    })


def kpi_period_delta(orders: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """This window against the one before it, from one scan of both."""
    now, before = in_ts_window("placed_at", as_of, days), in_ts_window("placed_at", as_of, days, days)
    per_customer = (
        orders.filter(recognized() & in_ts_window("placed_at", as_of, 2 * days))
        .groupBy("customer_id")
        .agg(
            F.count_if(now).alias("n1"),
            F.count_if(before).alias("n0"),
            money(sum_if(now, cents("grand_total"))).alias("r1"),
            money(sum_if(before, cents("grand_total"))).alias("r0"),
        )
    )
    known = F.col("customer_id").isNotNull()
    one = per_customer.agg(
        *[F.coalesce(dbl(F.sum(c)), F.lit(0.0)).alias(c) for c in ("n1", "n0", "r1", "r0")],
        dbl(F.count_if(known & (F.col("n1") > 0))).alias("u1"),
        dbl(F.count_if(known & (F.col("n0") > 0))).alias("u0"),
    ).withColumns({
        "a1": F.coalesce(ratio("r1", "n1"), F.lit(0.0)),
        "a0": F.coalesce(ratio("r0", "n0"), F.lit(0.0)),
    })
    rows = one.selectExpr(
        "stack(4, 'revenue', r1, r0, 'orders', n1, n0, 'aov', a1, a0, 'unique_customers', u1, u0)"
        " as (metric, current, prior)"
    )
    return _delta(rows)


def repeat_rate_delta(orders: DataFrame, as_of: datetime, days: int = 90) -> DataFrame:
    now, before = in_ts_window("placed_at", as_of, days), in_ts_window("placed_at", as_of, days, days)
    buyers = (
        orders.filter(not_cancelled() & in_ts_window("placed_at", as_of, 2 * days))
        .groupBy("customer_id")
        .agg(F.count_if(now).alias("n1"), F.count_if(before).alias("n0"))
    )

    def rate(n: str) -> Column:
        r = ratio(F.count_if(F.col(n) > 1), F.count_if(F.col(n) > 0))
        return F.coalesce(F.round(r, 4), F.lit(0.0))

    one = buyers.agg(rate("n1").alias("current"), rate("n0").alias("prior"))
    return _delta(one).select(
        F.col("current").alias("repeat_rate"), F.col("prior").alias("prior_rate"), "delta_pct", "direction"
    )


def channel_share(orders: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    channels = revenue_by_channel(orders, as_of, days).select("channel", "revenue")
    ranked = channels.select(
        "channel",
        "revenue",
        pct("revenue", F.sum("revenue").over(Window.partitionBy())).alias("share"),
        F.row_number().over(Window.orderBy(F.desc("revenue"), "channel")).cast("long").alias("rank"),
    )
    top3 = F.sum(F.when(F.col("rank") <= 3, F.col("share"))).over(Window.partitionBy())
    return ranked.withColumn("top3_share", F.round(top3, 1))


def product_concentration(
    order_items: DataFrame, orders: DataFrame, products: DataFrame, as_of: datetime, days: int = 30, n: int = 10
) -> DataFrame:
    """Line revenue of the best sellers over recognized order revenue: two definitions, as published."""
    top = top_products(order_items, orders, products, as_of, days, n).agg(
        F.coalesce(F.sum("revenue"), F.lit(0)).alias("top_revenue")
    )
    total = kpi_summary(orders, as_of, days).select("revenue").scalar()
    return top.withColumn("total_revenue", total).withColumn(
        "share_pct", pct("top_revenue", "total_revenue")
    )


def slow_capital(slow: DataFrame) -> DataFrame:
    return slow.agg(
        F.count("*").alias("slow_count"),
        F.coalesce(F.sum(F.col("on_hand") * F.col("cost")), F.lit(0)).alias("slow_capital"),
    )


def best_aov_channel(orders: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """The channel with the largest average order, and what 100 orders moved there would add."""
    best = F.max(F.struct("aov", "revenue", "channel"))
    top = revenue_by_channel(orders, as_of, days).agg(best.alias("b"))
    book = kpi_summary(orders, as_of, days).select("aov").scalar()
    return (
        top.select(F.col("b.channel").alias("channel"), F.col("b.aov").alias("aov"))
        .withColumn("book_aov", book)
        .withColumn("uplift_per_100", (F.col("aov") - F.col("book_aov")) * 100)
    )


def funnel_drops(events: DataFrame, carts: DataFrame, orders: DataFrame, as_of: datetime) -> DataFrame:
    """View → cart → purchase; the checkout step is left out, as published."""
    funnel = funnel_last_30d(events, carts, orders, as_of)
    steps = funnel.selectExpr(
        "stack(3, 1L, 'views', views, 2L, 'add_to_cart', add_to_cart, 3L, 'purchased', purchased)"
        " as (position, step, n)"
    )
    along = Window.orderBy("position")
    prior = F.lag("n").over(along)
    base = F.first("n").over(along)
    out = steps.select(
        "position",
        "step",
        "n",
        pct("n", base).alias("share_pct"),
        F.when(prior.isNotNull(), pct(prior - F.col("n"), prior)).alias("drop_pct"),
    )
    worst = F.max(F.when(F.col("drop_pct").isNotNull(), F.struct("drop_pct", -F.col("position")))).over(
        Window.partitionBy()
    )
    is_worst = F.coalesce(-worst["col2"] == F.col("position"), F.lit(False))
    return out.withColumn("is_worst", is_worst)


def funnel_point_value(
    events: DataFrame, carts: DataFrame, orders: DataFrame, as_of: datetime, days: int = 30
) -> DataFrame:
    """What one more percent of viewers reaching the cart is worth."""
    aov = kpi_summary(orders, as_of, days).select("aov").scalar()
    f = funnel_last_30d(events, carts, orders, as_of).withColumn("aov", aov)
    rate = F.coalesce(ratio("purchased", "add_to_cart"), F.lit(0.0))
    return f.select((dbl("views") * 0.01 * rate * F.col("aov")).alias("point_value"))


def forecast_totals(forecast: DataFrame) -> DataFrame:
    """Totals of one series: the top line."""
    return forecast.agg(
        F.count("*").alias("days"),
        F.round(F.sum("yhat"), 2).alias("total"),
        F.round(F.sum("yhat_lower"), 2).alias("low"),
        F.round(F.sum("yhat_upper"), 2).alias("high"),
        F.round(F.max("yhat"), 2).alias("peak"),
        F.round(F.min("yhat"), 2).alias("trough"),
    )


def kpi_mtd(fct_orders: DataFrame, as_of: date) -> DataFrame:
    mtd = recognized_orders(fct_orders).filter(
        F.col("order_date").between(date_lit(as_of.replace(day=1)), date_lit(as_of))
    )
    s = sum_money("grand_total")
    return mtd.agg(
        F.coalesce(s, F.lit(0)).alias("revenue"),
        F.count("*").alias("orders"),
        F.coalesce(ratio(s, F.count("*")), F.lit(0.0)).alias("aov"),
    )


def category_vs_prior(fct_items: DataFrame, dim_product: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    """The last `days` dates against the `days` dates before them."""
    d = F.col("order_date")
    now = d > date_lit(as_of - timedelta(days=days))
    recent = fct_items.filter((d > date_lit(as_of - timedelta(days=2 * days))) & (d <= date_lit(as_of)))
    sums = {"c": F.when(now, F.col("revenue_cents")), "p": F.when(~now, F.col("revenue_cents"))}
    return sums_by_attribute(recent, dim_product, "product_id", ["category_name"], sums).select(
        F.col("category_name").alias("category"),
        money(zero_if_null("c")).alias("current"),
        money(zero_if_null("p")).alias("prior"),
    )


def velocity_heatmap(fct_items: DataFrame, dim_product: DataFrame, as_of: date, weeks: int = 12) -> DataFrame:
    """Units per product and week; w1 is the oldest week, the last ends on `as_of`."""
    d = F.col("order_date")
    age = F.floor(F.datediff(date_lit(as_of), d) / 7).cast("int")
    units = (
        fct_items.filter((d > date_lit(as_of - timedelta(days=7 * weeks))) & (d <= date_lit(as_of)))
        .groupBy("product_id")
        .agg(*[
            zero_if_null(sum_if(age == weeks - w, "quantity")).alias(f"w{w}") for w in range(1, weeks + 1)
        ])
    )
    return units.join(dim_product.select("product_id", "sku"), "product_id").select(
        "sku", *[f"w{w}" for w in range(1, weeks + 1)]
    )


def last_months(as_of: date, n: int) -> list[date]:
    first = as_of.replace(day=1)
    out = [first]
    while len(out) < n:
        first = (first - timedelta(days=1)).replace(day=1)
        out.append(first)
    return out[::-1]


def promo_month_pivot(
    redemptions: DataFrame, fct_orders: DataFrame, fct_items: DataFrame, as_of: date, months: int = 6
) -> DataFrame:
    """One row per promotion; discount and lift side by side for each of the last months."""
    lift = mart_promo_lift(redemptions, fct_orders, fct_items)
    out = []
    for m in last_months(as_of, months):
        here = F.col("month") == date_lit(m)
        out.append(F.max(F.when(here, F.col("discount_given"))).alias(f"discount_{m:%Y_%m}"))
        out.append(F.max(F.when(here, F.col("lift_ratio"))).alias(f"lift_{m:%Y_%m}"))
    return lift.groupBy("promotion_id").agg(*out)


def top_skus(
    order_items: DataFrame, orders: DataFrame, products: DataFrame, as_of: datetime, days: int = 30, n: int = 25
) -> DataFrame:
    sales = product_sales(order_items, orders, as_of, days)
    return (
        sales.join(products.select("id", "sku"), F.col("product_id") == F.col("id"))
        .select("sku", "revenue", "units", F.col("gross_margin").alias("margin"))
        .orderBy(F.desc("revenue"), "sku")
        .limit(n)
    )


def forecast_pivot(forecast: DataFrame, start: date, series: list[str], days: int = 7) -> DataFrame:
    """The first days of the forecast, one column for each of the named series. Any other series stops the report."""
    named = F.col("category_name").isin(series)
    stop = F.raise_error(F.concat(F.lit("no column for the series "), F.coalesce("category_name", F.lit("null"))))
    checked = forecast.withColumn("category_name", F.when(named, F.col("category_name")).otherwise(stop.cast("string")))
    first = checked.filter(in_date_window("forecast_date", start + timedelta(days=days - 1), days - 1))
    return first.groupBy("forecast_date").pivot("category_name", series).agg(F.first("yhat"))


def wow_same_weekday(fct_orders: DataFrame) -> DataFrame:
    """Each calendar day against the same weekday one week earlier."""
    daily = mart_daily_revenue(fct_orders).select("date", "revenue")
    days = calendar(daily.agg(F.min("date").alias("first"), F.max("date").alias("last")))
    dense = days.join(daily, "date", "left").select("date", zero_if_null("revenue").alias("revenue"))
    prior = F.lag("revenue", 7).over(Window.orderBy("date"))
    change = F.round(ratio(F.col("revenue") - F.col("same_weekday_prior"), "same_weekday_prior") * 100, 1)
    return (
        dense.withColumn("same_weekday_prior", prior)
        .withColumn("wow_pct", change)
        .withColumn("is_alert", F.coalesce(F.col("wow_pct") < DROP_ALERT_PCT, F.lit(False)))
    )


def session_devices(page_views: DataFrame) -> DataFrame:
    """The device of a session is the one of its first page view."""
    return page_views.groupBy("session_id").agg(
        F.min_by("device_type", F.struct("occurred_at", "id")).alias("device_type")
    )


def abandonment_trend(carts: DataFrame, page_views: DataFrame) -> DataFrame:
    """Abandonment by week and device; carts without a page view are 'unknown'."""
    per_session = carts.groupBy("session_id", week_of("created_at").alias("week")).agg(
        F.count("*").alias("carts"), F.count_if(F.col("status") == "abandoned").alias("abandoned")
    )
    return (
        per_session.join(session_devices(page_views), "session_id", "left")
        .groupBy("week", F.coalesce("device_type", F.lit("unknown")).alias("device_type"))
        .agg(F.sum("carts").alias("carts"), F.sum("abandoned").alias("abandoned"))
        .withColumn("abandonment_rate", F.round(ratio("abandoned", "carts"), 4))
    )
