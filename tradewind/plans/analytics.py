"""In-app analytics: windowed summaries straight from the entities.

Windows run from `as_of - offset - days` to `as_of - offset` with both ends included.
Ranked outputs carry an id as last sort key, so ties never move between runs.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions.exprs import (
    check_range,
    dbl,
    half_even_int,
    in_ts_window,
    ratio,
    zero_if_null,
)
from tradewind.functions.money import cents, sum_cents, sum_money
from tradewind.functions.predicates import not_cancelled, reached_checkout, recognized, sellable
from tradewind.functions.quantiles import group_quantiles
from tradewind.functions.sizing import by_shuffle
from tradewind.plans.marts import cohort_activity

TOP_N = 50


def kpi_summary(orders: DataFrame, as_of: datetime, days: int = 30, offset: int = 0) -> DataFrame:
    """Orders, revenue, average order and customers; zeros when the window is empty."""
    check_range("days", days, 1, 365)
    per_customer = (
        orders.filter(recognized() & in_ts_window("placed_at", as_of, days, offset))
        .groupBy("customer_id")
        .agg(F.count("*").alias("n"), F.sum(cents("grand_total")).alias("s"))
    )
    revenue, n = sum_cents("s"), F.sum("n")
    return per_customer.agg(
        zero_if_null(n).alias("orders"),
        F.coalesce(revenue, F.lit(0)).alias("revenue"),
        F.coalesce(ratio(revenue, n), F.lit(0.0)).alias("aov"),
        F.count("customer_id").alias("unique_customers"),
    )


def revenue_by_day(orders: DataFrame, as_of: datetime, days: int = 90) -> DataFrame:
    check_range("days", days, 7, 365)
    return (
        orders.filter(not_cancelled() & in_ts_window("placed_at", as_of, days))
        .groupBy(F.to_date("placed_at").alias("day"))
        .agg(sum_money("grand_total").alias("revenue"), F.count("*").alias("orders"))
        .orderBy("day")
    )


def _orders_by(orders: DataFrame, key: str, as_of: datetime, days: int) -> DataFrame:
    return (
        orders.filter(not_cancelled() & in_ts_window("placed_at", as_of, days))
        .groupBy(key)
        .agg(F.count("*").alias("orders"), sum_money("grand_total").alias("revenue"))
        .withColumn("aov", ratio("revenue", "orders"))
        .orderBy(F.desc("revenue"), key)
    )


def revenue_by_channel(orders: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    return _orders_by(orders, "channel", as_of, days)


def aov_by_device(orders: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    return _orders_by(orders, "device_type", as_of, days)


def aov_median(orders: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Mean and exact median order value by device and channel."""
    kept = orders.filter(not_cancelled() & in_ts_window("placed_at", as_of, days))
    keys = ["device_type", "channel"]
    means = kept.groupBy(*keys).agg(F.count("*").alias("orders"), sum_money("grand_total").alias("s"))
    medians = group_quantiles(
        kept.select(*keys, "grand_total"), keys, "grand_total", {"median_aov": 0.5}, bucket_width=100
    )
    return means.join(medians.drop("n"), keys).select(
        *keys, "orders", ratio("s", "orders").alias("aov"), "median_aov"
    )


def sold_lines(order_items: DataFrame, orders: DataFrame, keep: Column) -> DataFrame:
    """Lines whose order passes `keep`; the orders side is cut to its id before the join."""
    ids = orders.filter(keep).select(F.col("id").alias("_order_id"))
    return order_items.join(ids, F.col("order_id") == F.col("_order_id")).drop("_order_id")


def product_sales(order_items: DataFrame, orders: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Sellable units, revenue, cost and margin per product in the window."""
    qty, price, cost = F.col("quantity"), cents("unit_price"), cents("unit_cost")
    lines = sold_lines(order_items, orders, sellable() & in_ts_window("placed_at", as_of, days))
    return lines.groupBy("product_id").agg(
        F.sum("quantity").alias("units"),
        sum_cents(qty * price).alias("revenue"),
        sum_cents(qty * (price - cost)).alias("gross_margin"),
    )


def top_products(
    order_items: DataFrame,
    orders: DataFrame,
    products: DataFrame,
    as_of: datetime,
    days: int = 30,
    limit: int = 10,
) -> DataFrame:
    """Best sellers by line revenue."""
    check_range("days", days, 7, 365)
    sales = product_sales(order_items, orders, as_of, days)
    names = products.select("id", "sku", "name", "brand")
    return (
        sales.join(names, F.col("product_id") == F.col("id"))
        .select("id", "sku", "name", "brand", "units", "revenue", "gross_margin")
        .orderBy(F.desc("revenue"), "id")
        .limit(limit)
    )


def _product_stock(inventory: DataFrame, variants: DataFrame) -> DataFrame:
    per_variant = inventory.groupBy("variant_id").agg(F.sum("on_hand").alias("on_hand"))
    v = variants.select(F.col("id").alias("variant_id"), "product_id")
    return per_variant.join(by_shuffle(v), "variant_id").groupBy("product_id").agg(F.sum("on_hand").alias("on_hand"))


def _slowest(products: DataFrame, units: DataFrame, stock: DataFrame, max_units: int) -> DataFrame:
    return (
        products.filter("is_active")
        .withColumnRenamed("id", "product_id")
        .join(by_shuffle(units), "product_id", "left")
        .join(by_shuffle(stock), "product_id", "left")
        .withColumn("units_sold", zero_if_null("units"))
        .filter(F.col("units_sold") <= max_units)
        .select("sku", "name", "brand", "units_sold", zero_if_null("on_hand").alias("on_hand"), "price", "cost")
        .orderBy(F.desc_nulls_last("on_hand"), "units_sold", "sku")
        .limit(TOP_N)
    )


def slow_movers(
    products: DataFrame,
    order_items: DataFrame,
    orders: DataFrame,
    inventory: DataFrame,
    variants: DataFrame,
    as_of: datetime,
    days: int = 60,
    max_units: int = 5,
) -> DataFrame:
    """Active products that sold at most `max_units` in the window, most stock first."""
    check_range("days", days, 7, 365)
    check_range("max_units", max_units, 0, 100)
    units = product_sales(order_items, orders, as_of, days).select("product_id", "units")
    return _slowest(products, units, _product_stock(inventory, variants), max_units)


def slow_movers_literal(
    products: DataFrame, order_items: DataFrame, inventory: DataFrame, variants: DataFrame, max_units: int = 5
) -> DataFrame:
    """As published: units count every line ever, since the window never reaches the sum."""
    units = order_items.groupBy("product_id").agg(F.sum("quantity").alias("units"))
    return _slowest(products, units, _product_stock(inventory, variants), max_units)


def cart_abandonment(carts: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Abandoned over all carts of the window, active ones included."""
    return (
        carts.filter(in_ts_window("created_at", as_of, days))
        .agg(
            F.count_if(F.col("status") == "abandoned").alias("abandoned"),
            F.count_if(F.col("status") == "converted").alias("converted"),
            F.count("*").alias("total"),
        )
        .withColumn("abandonment_rate", F.coalesce(F.round(ratio("abandoned", "total"), 4), F.lit(0.0)))
    )


def repeat_purchase_rate(orders: DataFrame, as_of: datetime, days: int = 90, offset: int = 0) -> DataFrame:
    """Share of the window's buyers with more than one order."""
    buyers = (
        orders.filter(not_cancelled() & in_ts_window("placed_at", as_of, days, offset))
        .groupBy("customer_id")
        .agg(F.count("*").alias("n"))
    )
    return buyers.agg(
        F.count_if(F.col("n") > 1).alias("repeat_customers"), F.count("*").alias("total_customers")
    ).withColumn(
        "repeat_rate", F.coalesce(F.round(ratio("repeat_customers", "total_customers"), 4), F.lit(0.0))
    )


def cohort_retention(orders: DataFrame) -> DataFrame:
    """Cohorts over everything but cancelled orders."""
    kept = orders.filter(not_cancelled()).select("customer_id", F.to_date("placed_at").alias("day"))
    return cohort_activity(kept, "day").orderBy("cohort_month", "active_month")


def gross_margin_by_category(
    order_items: DataFrame,
    orders: DataFrame,
    products: DataFrame,
    categories: DataFrame,
    as_of: datetime,
    days: int = 30,
) -> DataFrame:
    """Products without a category drop out."""
    sales = product_sales(order_items, orders, as_of, days)
    p = products.select(F.col("id").alias("product_id"), "category_id")
    c = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return (
        sales.join(p, "product_id")
        .join(c, "category_id")
        .groupBy("category")
        .agg(F.sum("revenue").alias("revenue"), F.sum("gross_margin").alias("gross_margin"))
        .withColumn("margin_pct", ratio("gross_margin", "revenue"))
        .orderBy(F.desc("gross_margin"), "category")
    )


def _at_risk(
    units: DataFrame, inventory: DataFrame, variants: DataFrame, products: DataFrame, days: int
) -> DataFrame:
    rate = units.select("variant_id", (dbl("units") / max(days, 1)).alias("units_per_day")).filter("units_per_day > 0")
    v = variants.select(F.col("id").alias("variant_id"), "product_id", "size", "color")
    p = products.select(F.col("id").alias("product_id"), "sku", "name")
    return (
        inventory.select("variant_id", "warehouse_code", "on_hand", "reorder_point")
        .join(by_shuffle(rate), "variant_id")
        .withColumn("_cover", ratio("on_hand", "units_per_day"))
        .filter("_cover < 14")
        .join(by_shuffle(v), "variant_id")
        .join(by_shuffle(p), "product_id")
        .withColumn("days_of_cover", half_even_int("_cover"))
        .orderBy("days_of_cover", "variant_id", "warehouse_code")
        .limit(TOP_N)
        .select("sku", "name", "size", "color", "on_hand", "reorder_point", "units_per_day", "days_of_cover")
    )


def stockouts_at_risk(
    order_items: DataFrame,
    orders: DataFrame,
    inventory: DataFrame,
    variants: DataFrame,
    products: DataFrame,
    as_of: datetime,
    days: int = 28,
) -> DataFrame:
    """Stock rows that cover less than 14 days at the window's rate; cover rounds half to even."""
    lines = sold_lines(order_items, orders, sellable() & in_ts_window("placed_at", as_of, days))
    units = lines.groupBy("variant_id").agg(F.sum("quantity").alias("units"))
    return _at_risk(units, inventory, variants, products, days)


def stockouts_at_risk_literal(
    order_items: DataFrame, inventory: DataFrame, variants: DataFrame, products: DataFrame, days: int = 28
) -> DataFrame:
    """As published: lifetime units over the window's days."""
    units = order_items.groupBy("variant_id").agg(F.sum("quantity").alias("units"))
    return _at_risk(units, inventory, variants, products, days)


def funnel_last_30d(events: DataFrame, carts: DataFrame, orders: DataFrame, as_of: datetime) -> DataFrame:
    """Four counts in one row, each source scanned once."""
    steps = ("views", "add_to_cart", "started_checkout", "purchased")

    def counted(df: DataFrame, **counts: Column) -> DataFrame:
        zero = F.lit(0).cast("long")
        return df.agg(*[counts.get(s, F.max(zero)).alias(s) for s in steps])

    e = counted(
        events.filter(in_ts_window("occurred_at", as_of, 30)),
        views=F.count_if(F.col("event_type") == "view"),
        add_to_cart=F.count_if(F.col("event_type") == "add_to_cart"),
    )
    c = counted(
        carts.filter(in_ts_window("created_at", as_of, 30) & reached_checkout()), started_checkout=F.count("*")
    )
    o = counted(
        orders.filter(in_ts_window("placed_at", as_of, 30) & not_cancelled()), purchased=F.count("*")
    )
    return e.unionByName(c).unionByName(o).agg(*[F.sum(s).alias(s) for s in steps])
