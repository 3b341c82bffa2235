"""Business marts over the dimensions and facts.

Where a customer, product or day may hold a large share of the rows, plans first collapse the fact
to one row per (key, day) or (key, member) with map-side partial sums, and only then join, rank or
count distinct members.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.exprs import (
    date_lit,
    dbl,
    in_date_window,
    month_of,
    months_apart,
    ratio,
    sum_if,
    zero_if_null,
)
from tradewind.functions.money import cents, exact_share, money, sum_cents, sum_money
from tradewind.functions.predicates import reached_checkout
from tradewind.functions.sizing import by_shuffle, sums_by_attribute
from tradewind.plans.dims_facts import calendar


def _margin() -> Column:
    return sum_cents(F.col("revenue_cents") - F.col("cost_cents"))


def recognized_orders(fct_orders: DataFrame) -> DataFrame:
    return fct_orders.filter("is_revenue_recognized")


def _per_member(df: DataFrame, keys: list[str], member: str, total: str) -> DataFrame:
    """(keys, member) → total and row count; the step before counting distinct members."""
    return df.groupBy(*keys, member).agg(F.sum(cents(total)).alias("_sum"), F.count("*").alias("_n"))


def _orders_by(fct_orders: DataFrame, keys: list[str]) -> DataFrame:
    """Revenue, orders and unique customers per key. Orders are unique on order_id after staging."""
    return (
        _per_member(fct_orders, keys, "customer_id", "grand_total")
        .groupBy(*keys)
        .agg(
            sum_cents("_sum").alias("revenue"),
            F.sum("_n").alias("orders"),
            F.count("customer_id").alias("unique_customers"),
        )
    )


# ---- revenue ---------------------------------------------------------------------------------


def mart_daily_revenue(fct_orders: DataFrame) -> DataFrame:
    """Per day, with the mean over the last seven rows. The window runs over days, not orders."""
    daily = _orders_by(recognized_orders(fct_orders), ["order_date"])
    last7 = Window.orderBy("order_date").rowsBetween(-6, 0)
    return daily.select(
        F.col("order_date").alias("date"),
        "revenue",
        "orders",
        "unique_customers",
        ratio("revenue", "orders").alias("aov"),
        (dbl(F.sum("revenue").over(last7)) / F.count("revenue").over(last7)).alias("revenue_7d_avg"),
    )


def daily_revenue_dense(fct_orders: DataFrame) -> DataFrame:
    """Every calendar day between the first and last sale; days without sales count as zero."""
    daily = mart_daily_revenue(fct_orders)
    days = calendar(daily.agg(F.min("date").alias("first"), F.max("date").alias("last")))
    last7 = Window.orderBy("date").rowsBetween(-6, 0)
    dense = days.join(daily, "date", "left").select(
        "date",
        zero_if_null("revenue").alias("revenue"),
        zero_if_null("orders").alias("orders"),
        zero_if_null("unique_customers").alias("unique_customers"),
        "aov",
        "revenue_7d_avg",
    )
    mean7 = dbl(F.sum("revenue").over(last7)) / F.count("*").over(last7)
    return dense.withColumn("revenue_7day_avg", mean7)


def executive_daily(daily: DataFrame, days: int = 30) -> DataFrame:
    """Each day beside the row dated `days` earlier; no row there leaves nulls."""
    prior = daily.select(
        F.date_add("date", days).alias("date"),
        F.col("revenue").alias("revenue_prior"),
        F.col("orders").alias("orders_prior"),
        F.col("aov").alias("aov_prior"),
        F.col("unique_customers").alias("unique_customers_prior"),
    )
    change = ratio(F.col("revenue") - F.col("revenue_prior"), "revenue_prior")
    return daily.join(prior, "date", "left").withColumn("revenue_yoy_30d", change)


def mart_channel_perf(fct_orders: DataFrame) -> DataFrame:
    keys = ["channel", "order_date", "device_type"]
    return _orders_by(recognized_orders(fct_orders), keys).select(
        *keys, "orders", "revenue", ratio("revenue", "orders").alias("aov"), "unique_customers"
    )


def mart_category_pnl(fct_items: DataFrame, dim_product: DataFrame) -> DataFrame:
    sums = {"revenue": F.col("revenue_cents"), "cost": F.col("cost_cents")}
    pnl = sums_by_attribute(fct_items, dim_product, "product_id", ["category_name"], sums, ["order_date"])
    margin = F.col("revenue") - F.col("cost")
    return pnl.select(
        "category_name",
        "order_date",
        money("revenue").alias("revenue"),
        money("cost").alias("cost"),
        money(margin).alias("gross_margin"),
        ratio(money(margin), money("revenue")).alias("margin_pct"),
    )


# ---- products and stock ----------------------------------------------------------------------


def mart_product_velocity(fct_items: DataFrame, dim_product: DataFrame, as_of: date) -> DataFrame:
    """Units and revenue over 28 and 84 days from one pass. Both windows include both end dates."""
    recent = in_date_window("order_date", as_of, 28)
    sold = (
        fct_items.filter(in_date_window("order_date", as_of, 84))
        .groupBy("product_id")
        .agg(
            sum_if(recent, "quantity").alias("u28"),
            sum_if(recent, "revenue_cents").alias("r28"),
            F.sum("quantity").alias("u84"),
            F.sum("revenue_cents").alias("r84"),
        )
    )
    units = zero_if_null("u28")
    bucket = (
        F.when(units == 0, "dead").when(units <= 5, "slow").when(units <= 25, "steady").otherwise("fast")
    )
    return (
        dim_product.filter("is_active")
        .join(sold, "product_id", "left")
        .select(
            "product_id",
            "sku",
            "name",
            "brand",
            "category_name",
            units.alias("units_28d"),
            money(zero_if_null("r28")).alias("revenue_28d"),
            zero_if_null("u84").alias("units_84d"),
            money(zero_if_null("r84")).alias("revenue_84d"),
            (dbl("u28") / 28.0).alias("units_per_day"),
            bucket.alias("velocity_bucket"),
        )
    )


def mart_stockout_risk(
    fct_items: DataFrame, inventory: DataFrame, variants: DataFrame, products: DataFrame, as_of: date
) -> DataFrame:
    """Days of cover per variant at the 28-day rate. A variant that sold nothing is healthy."""
    rate = (
        fct_items.filter(in_date_window("order_date", as_of, 28))
        .groupBy("variant_id")
        .agg((dbl(F.sum("quantity")) / 28.0).alias("units_per_day"))
    )
    stock = inventory.groupBy("variant_id").agg(F.sum("on_hand").alias("on_hand"))
    v = variants.select(F.col("id").alias("variant_id"), "product_id", "size", "color")
    p = products.select(F.col("id").alias("product_id"), "sku", "name")
    cover = F.col("days_of_cover")
    return (
        v.join(by_shuffle(p), "product_id")
        .join(by_shuffle(rate), "variant_id", "left")
        .join(by_shuffle(stock), "variant_id", "left")
        .withColumn("days_of_cover", ratio("on_hand", "units_per_day"))
        .select(
            "variant_id",
            "sku",
            "name",
            "size",
            "color",
            "on_hand",
            "units_per_day",
            "days_of_cover",
            F.when(cover < 7, "urgent").when(cover < 14, "reorder_soon").otherwise("healthy").alias("stock_status"),
        )
    )


def mart_inventory_aging(inventory: DataFrame, variants: DataFrame, dim_product: DataFrame) -> DataFrame:
    """Stock and capital per product; `available` leaves out what is reserved for orders."""
    per_variant = inventory.groupBy("variant_id").agg(
        F.sum("on_hand").alias("on_hand"),
        F.sum(F.col("on_hand") - F.col("reserved")).alias("available"),
    )
    v = variants.select(F.col("id").alias("variant_id"), "product_id")
    per_product = (
        per_variant.join(by_shuffle(v), "variant_id")
        .groupBy("product_id")
        .agg(F.sum("on_hand").alias("on_hand"), F.sum("available").alias("available"))
    )
    return per_product.join(by_shuffle(dim_product), "product_id").select(
        "category_name",
        "brand",
        "product_id",
        "sku",
        "name",
        "on_hand",
        "available",
        "list_cost",
        (F.col("on_hand") * F.col("list_cost")).alias("tied_capital"),
    )


def tied_capital_slow(aging: DataFrame, velocity: DataFrame) -> DataFrame:
    """Capital in unreserved stock of products that sell slowly or not at all."""
    slow = velocity.filter(F.col("velocity_bucket").isin("dead", "slow")).select(
        "product_id", "units_28d", "velocity_bucket"
    )
    return aging.join(slow, "product_id").select(
        "product_id",
        "sku",
        "category_name",
        "velocity_bucket",
        "units_28d",
        "on_hand",
        "available",
        "tied_capital",
        (F.col("available") * F.col("list_cost")).alias("tied_capital_available"),
    )


# ---- customers -------------------------------------------------------------------------------


def _customer_days(fct_orders: DataFrame) -> DataFrame:
    """Recognized orders as one row per customer and day: no customer outgrows the calendar."""
    return (
        recognized_orders(fct_orders)
        .groupBy("customer_id", "order_date")
        .agg(sum_money("grand_total").alias("revenue"), F.count("*").alias("orders"))
    )


def cohort_activity(orders: DataFrame, day: str) -> DataFrame:
    """(cohort month, active month) → customers. `orders` comes filtered to the wanted statuses."""
    months = (
        orders.filter("customer_id is not null")
        .select("customer_id", month_of(day).alias("active_month"))
        .distinct()
    )
    first = F.min("active_month").over(Window.partitionBy("customer_id"))
    return (
        months.withColumn("cohort_month", first)
        .groupBy("cohort_month", "active_month")
        .agg(F.count("*").alias("customers"))
    )


def mart_cohort_retention(fct_orders: DataFrame) -> DataFrame:
    """The column keeps its published name, though it counts months since the first order."""
    return cohort_activity(recognized_orders(fct_orders), "order_date").select(
        "cohort_month",
        "active_month",
        months_apart("cohort_month", "active_month").alias("months_since_signup"),
        F.col("customers").alias("active_customers"),
    )


def cohort_retention_pct(retention: DataFrame) -> DataFrame:
    """Share of the cohort that is active, month 0 being the whole cohort."""
    size = F.max(F.when(F.col("months_since_signup") == 0, F.col("active_customers"))).over(
        Window.partitionBy("cohort_month")
    )
    return retention.select(
        "cohort_month",
        "months_since_signup",
        "active_customers",
        size.alias("cohort_size"),
        F.round(ratio("active_customers", size) * 100, 2).alias("retention_pct"),
    )


def cohort_triangle(pct: DataFrame, months: int = 12) -> DataFrame:
    """One row per cohort, one column per month since the first order."""
    return (
        pct.filter(F.col("months_since_signup") <= months)
        .groupBy("cohort_month", "cohort_size")
        .pivot("months_since_signup", list(range(months + 1)))
        .agg(F.first("retention_pct"))
    )


def mart_customer_lifecycle(dim_customer: DataFrame, fct_orders: DataFrame, as_of: date) -> DataFrame:
    per_customer = (
        recognized_orders(fct_orders)
        .groupBy("customer_id")
        .agg(
            F.count("*").alias("lifetime_orders"),
            sum_money("grand_total").alias("lifetime_revenue"),
            F.min("order_date").alias("first_order_date"),
            F.max("order_date").alias("last_order_date"),
        )
    )
    idle = F.col("days_since_last_order")
    stage = (
        F.when(idle.isNull(), "never_purchased")
        .when(idle <= 30, "active")
        .when(idle <= 90, "lapsing")
        .when(idle <= 180, "dormant")
        .otherwise("churned")
    )
    return (
        dim_customer.join(per_customer, "customer_id", "left")
        .withColumn("days_since_last_order", F.datediff(date_lit(as_of), "last_order_date").cast("long"))
        .withColumn("lifecycle_stage", stage)
    )


def ltv_by_segment(lifecycle: DataFrame, segment: str = "signup_channel") -> DataFrame:
    """Lifetime value per customer of the segment, customers without orders included."""
    return (
        lifecycle.groupBy(segment)
        .agg(
            F.count("*").alias("customers"),
            F.count("lifetime_orders").alias("payers"),
            F.sum(F.coalesce(F.col("lifetime_revenue"), F.lit(0))).alias("revenue"),
        )
        .withColumn("ltv", ratio("revenue", "customers"))
    )


def ltv_cac(customers: DataFrame, fct_orders: DataFrame, channel_cac: DataFrame, months: int = 6) -> DataFrame:
    """Revenue in the first `months` after the first order, over all signups of the channel."""
    days = _customer_days(fct_orders)
    first = F.min("order_date").over(Window.partitionBy("customer_id"))
    early = (
        days.withColumn("_first", first)
        .filter(F.col("order_date") < F.add_months("_first", months))
        .groupBy("customer_id")
        .agg(F.sum("revenue").alias("revenue"))
    )
    per_channel = (
        customers.select(F.col("id").alias("customer_id"), F.col("signup_channel").alias("channel"))
        .join(early, "customer_id", "left")
        .groupBy("channel")
        .agg(
            F.count("*").alias("customers"),
            F.sum(F.coalesce(F.col("revenue"), F.lit(0))).alias("revenue"),
        )
    )
    return (
        per_channel.join(channel_cac, "channel", "left")
        .withColumn("ltv_6m", ratio("revenue", "customers"))
        .select("channel", "customers", "ltv_6m", dbl("cac").alias("cac"), ratio("ltv_6m", "cac").alias("ltv_to_cac"))
    )


def mart_attribution(customers: DataFrame, fct_orders: DataFrame) -> DataFrame:
    """Recognized revenue credited to the first touch, the last touch, and evenly to all touches.

    A customer's touches are the signup channel, then the channel of each recognized order. Orders
    collapse to (customer, channel) first, so the per-customer step handles one row per channel.
    """
    when = F.struct("placed_at", "order_id")
    on_orders = (
        recognized_orders(fct_orders)
        .filter("customer_id is not null")
        .groupBy("customer_id", "channel")
        .agg(sum_money("grand_total").alias("revenue"), F.count("*").alias("touches"), F.max(when).alias("last_at"))
    )
    none = on_orders.schema["revenue"].dataType
    at_signup = customers.select(
        F.col("id").alias("customer_id"),
        F.col("signup_channel").alias("channel"),
        F.lit(0).cast(none).alias("revenue"),
        F.lit(1).cast("long").alias("touches"),
        F.lit(None).cast(on_orders.schema["last_at"].dataType).alias("last_at"),
        F.lit(True).alias("is_signup"),
    )
    touches = on_orders.withColumn("is_signup", F.lit(False)).unionByName(at_signup)
    whole = Window.partitionBy("customer_id")
    last = F.max(F.when(~F.col("is_signup"), F.struct("last_at", "channel"))).over(whole)
    credited = touches.select(
        "customer_id",
        "channel",
        "is_signup",
        "touches",
        last["last_at"].eqNullSafe(F.col("last_at")).alias("is_last"),
        F.sum("revenue").over(whole).alias("total"),
        F.sum("touches").over(whole).alias("all_touches"),
    ).filter("total > 0")
    linear = exact_share(dbl("total") * F.col("touches") / F.col("all_touches"))
    return credited.groupBy("channel").agg(
        F.coalesce(F.sum(F.when(F.col("is_signup"), F.col("total"))), F.lit(0)).alias("first_touch"),
        F.coalesce(F.sum(F.when(F.col("is_last"), F.col("total"))), F.lit(0)).alias("last_touch"),
        F.round(F.sum(linear), 2).alias("linear"),
    )


# ---- funnel, promotions, fulfilment, forecast ----------------------------------------------------


def mart_funnel(fct_events: DataFrame, fct_carts: DataFrame, fct_orders: DataFrame) -> DataFrame:
    """One row per date seen in any of the three sources; a source without the date leaves null."""
    views = F.col("event_type") == "view"
    adds = F.col("event_type") == "add_to_cart"
    one = F.lit(1)
    events = fct_events.groupBy("event_date").agg(
        sum_if(views, one).alias("views"), sum_if(adds, one).alias("add_to_cart")
    )
    carts = (
        fct_carts.filter(reached_checkout())
        .groupBy(F.col("created_date").alias("event_date"))
        .agg(F.count("*").alias("started_checkout"))
    )
    orders = (
        recognized_orders(fct_orders)
        .groupBy(F.col("order_date").alias("event_date"))
        .agg(F.count("*").alias("purchased"))
    )
    return events.join(carts, "event_date", "full").join(orders, "event_date", "full")


def _redemptions(redemptions: DataFrame) -> DataFrame:
    return redemptions.select(
        "promotion_id", "order_id", "customer_id", "amount_off", month_of("redeemed_at").alias("month")
    )


def mart_promo_lift_literal(redemptions: DataFrame, fct_orders: DataFrame, fct_items: DataFrame) -> DataFrame:
    """Redemption × order × line, as published: order-level amounts repeat once per line.

    The repeat is arithmetic, so it is done on one row per order: amount × number of lines.
    """
    lines = fct_items.groupBy("order_id").agg(F.count("*").alias("n_lines"), _margin().alias("margin"))
    n = F.col("n_lines")
    return (
        _redemptions(redemptions)
        .join(fct_orders.select("order_id", "grand_total"), "order_id")
        .join(lines, "order_id")
        .groupBy("promotion_id", "month")
        .agg(
            F.sum(n).alias("redemptions"),
            F.sum(F.col("amount_off") * n).alias("discount_given"),
            F.sum(F.col("grand_total") * n).alias("gross_revenue"),
            F.sum("margin").alias("gross_margin"),
        )
        .withColumn("lift_ratio", ratio("gross_margin", "discount_given"))
    )


def mart_promo_lift(redemptions: DataFrame, fct_orders: DataFrame, fct_items: DataFrame) -> DataFrame:
    """Every redemption counted once; margin summed per order before it is joined."""
    margin = fct_items.groupBy("order_id").agg(_margin().alias("margin"))
    return (
        _redemptions(redemptions)
        .join(fct_orders.select("order_id", "grand_total"), "order_id")
        .join(margin, "order_id")
        .groupBy("promotion_id", "month")
        .agg(
            F.count("*").alias("redemptions"),
            F.sum("amount_off").alias("discount_given"),
            F.sum("grand_total").alias("gross_revenue"),
            F.sum("margin").alias("gross_margin"),
        )
        .withColumn("lift_ratio", ratio("gross_margin", "discount_given"))
    )


def promo_incremental_margin(redemptions: DataFrame, fct_items: DataFrame) -> DataFrame:
    """Margin per promoted order, less discount, against the same customers' other orders.

    The baseline of a customer is the mean margin of the orders without a redemption; customers
    without such orders have none and are left out of the comparison.
    """
    margin = fct_items.groupBy("order_id", "customer_id").agg(_margin().alias("margin"))
    redeemed = redemptions.groupBy("order_id", "promotion_id").agg(
        F.sum("amount_off").alias("amount_off"), F.lit(True).alias("promoted")
    )
    per_customer = (
        margin.join(redeemed, "order_id", "left")
        .groupBy("customer_id", "promoted", "promotion_id")
        .agg(
            F.count("*").alias("n"),
            F.sum("margin").alias("_m"),
            F.sum(F.col("margin") - F.col("amount_off")).alias("net"),
        )
    )
    # A customer is a row per promotion by now, and one for the orders without any.
    plain = F.when(F.col("promoted").isNull(), exact_share(ratio("_m", "n")))
    baseline = F.max(plain).over(Window.partitionBy("customer_id"))
    return (
        per_customer.withColumn("baseline", baseline)
        .filter("promoted AND baseline IS NOT NULL AND customer_id IS NOT NULL")
        .groupBy("promotion_id")
        .agg(
            F.sum("n").alias("orders"),
            F.sum("net").alias("net_margin"),
            F.round(F.sum(F.col("baseline") * F.col("n")), 2).alias("baseline_margin"),
        )
        .withColumn("incremental_margin", F.col("net_margin") - F.col("baseline_margin"))
    )


def mart_fulfillment_sla(shipments: DataFrame, fct_orders: DataFrame) -> DataFrame:
    """Order-to-delivery hours per carrier. Shipments without a delivery count as open."""
    placed = fct_orders.select("order_id", "placed_at")
    s = shipments.select("order_id", "carrier", F.col("delivered_at").alias("arrived"))
    timed = s.join(placed, "order_id").select(
        "carrier", F.timestamp_diff("HOUR", F.col("placed_at"), F.col("arrived")).alias("hours")
    )
    # Whole hours: a carrier's orders collapse to a few hundred counts, which give everything else.
    hours = timed.groupBy("carrier", "hours").agg(F.count("*").alias("n"))
    return hours.groupBy("carrier").agg(
        F.sum("n").alias("shipments"),
        F.coalesce(F.sum(F.when(F.col("hours").isNotNull(), F.col("n"))), F.lit(0)).alias("delivered"),
        F.coalesce(F.sum(F.when(F.col("hours").isNull(), F.col("n"))), F.lit(0)).alias("open_orders"),
        ratio(F.sum(F.col("hours") * F.col("n")), F.sum(F.when(F.col("hours").isNotNull(), F.col("n")))).alias("mean_hours"),
        F.percentile("hours", F.lit(0.5), F.col("n")).alias("p50_hours"),
        F.percentile("hours", F.lit(0.9), F.col("n")).alias("p90_hours"),
    )


def forecast_overlay(demand_forecast: DataFrame) -> DataFrame:
    """Rows of the latest model run."""
    latest = demand_forecast.agg(F.max("model_run_at")).scalar()
    return demand_forecast.filter(F.col("model_run_at") == latest).select(
        F.col("forecast_date").alias("date"), "category_name", "yhat", "yhat_lower", "yhat_upper", "model_run_at"
    )
