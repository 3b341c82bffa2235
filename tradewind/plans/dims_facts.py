"""Dimensions and facts over the staged entities."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions.exprs import (
    date_lit,
    dbl,
    ratio,
    sunday_week_number,
    whole_hours,
    whole_minutes,
)
from tradewind.functions.money import cents
from tradewind.functions.predicates import recognized, sellable
from tradewind.functions.sizing import by_shuffle


def calendar(bounds: DataFrame) -> DataFrame:
    """One row per day from `first` to `last` of the one-row frame `bounds`."""
    return bounds.select(F.explode(F.sequence("first", "last", F.expr("INTERVAL 1 DAY"))).alias("date"))


def date_bounds(df: DataFrame, column: str) -> DataFrame:
    d = F.to_date(F.col(column))
    return df.agg(F.min(d).alias("first"), F.max(d).alias("last"))


def dim_date(bounds: DataFrame) -> DataFrame:
    d = F.col("date")
    return calendar(bounds).select(
        d,
        F.year(d).cast("long").alias("year"),
        F.quarter(d).cast("long").alias("quarter"),
        F.month(d).cast("long").alias("month"),
        F.date_format(d, "MMMM").alias("month_name"),
        sunday_week_number(d).alias("week"),
        F.dayofmonth(d).cast("long").alias("day"),
        F.dayofweek(d).cast("long").alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.dayofweek(d).isin(1, 7).alias("is_weekend"),
        F.month(d).isin(11, 12).alias("is_holiday_season"),
    )


def dim_customer(customers: DataFrame, as_of: date) -> DataFrame:
    signup = F.to_date("created_at")
    return customers.select(
        F.col("id").alias("customer_sk"),
        F.col("id").alias("customer_id"),
        "email",
        "first_name",
        "last_name",
        "signup_channel",
        "signup_country",
        "marketing_opt_in",
        signup.alias("signup_date"),
        F.datediff(date_lit(as_of), signup).cast("long").alias("tenure_days"),
    )


def dim_product(products: DataFrame, categories: DataFrame) -> DataFrame:
    c = categories.select(
        F.col("id").alias("category_id"),
        F.col("slug").alias("category_slug"),
        F.col("name").alias("category_name"),
    )
    p = products.alias("p").join(c.alias("c"), F.col("p.category_id") == F.col("c.category_id"), "left")
    return p.select(
        F.col("p.id").alias("product_sk"),
        F.col("p.id").alias("product_id"),
        "p.sku",
        "p.name",
        "p.brand",
        F.col("p.price").alias("list_price"),
        F.col("p.cost").alias("list_cost"),
        ratio(F.col("p.price") - F.col("p.cost"), "p.price").alias("list_margin_pct"),
        "category_slug",
        "category_name",
        "p.is_active",
        F.to_date("p.launched_at").alias("launched_date"),
    )


def fct_orders(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("id").alias("order_sk"),
        F.col("id").alias("order_id"),
        "order_number",
        "customer_id",
        "status",
        "channel",
        "utm_source",
        "utm_campaign",
        "device_type",
        F.to_date("placed_at").alias("order_date"),
        "placed_at",
        "paid_at",
        "fulfilled_at",
        "delivered_at",
        "cancelled_at",
        "subtotal",
        "discount_total",
        "shipping_total",
        "tax_total",
        "grand_total",
        whole_hours("placed_at", "delivered_at").alias("hours_to_deliver"),
        recognized().alias("is_revenue_recognized"),
    )


def fct_order_items(order_items: DataFrame, orders: DataFrame) -> DataFrame:
    """Lines of sellable orders, with the order's date, channel, device and customer."""
    o = orders.filter(sellable()).select(
        F.col("id").alias("_order_id"),
        "customer_id",
        F.to_date("placed_at").alias("order_date"),
        "placed_at",
        "channel",
        "device_type",
    )
    joined = order_items.join(o, F.col("order_id") == F.col("_order_id"))
    qty = F.col("quantity")
    return joined.select(
        "order_id",
        "product_id",
        "variant_id",
        "customer_id",
        "order_date",
        "placed_at",
        "channel",
        "device_type",
        "quantity",
        "unit_price",
        "unit_cost",
        "line_discount",
        (qty * F.col("unit_price")).alias("line_revenue"),
        (qty * F.col("unit_cost")).alias("line_cost"),
        (qty * (F.col("unit_price") - F.col("unit_cost"))).alias("line_margin"),
        # The same amounts as whole cents, which the marts add up.
        (qty * cents("unit_price")).alias("revenue_cents"),
        (qty * cents("unit_cost")).alias("cost_cents"),
    )


def fct_stock_moves(stock_movements: DataFrame, variants: DataFrame) -> DataFrame:
    v = variants.select(F.col("id").alias("_variant_id"), "product_id")
    return stock_movements.join(by_shuffle(v), F.col("variant_id") == F.col("_variant_id")).select(
        "variant_id",
        "product_id",
        "warehouse_code",
        "delta",
        "reason",
        "ref_order_id",
        F.to_date("occurred_at").alias("move_date"),
        "occurred_at",
    )


def fct_product_events(product_events: DataFrame) -> DataFrame:
    return product_events.select(
        F.col("id").alias("event_sk"),
        "session_id",
        "customer_id",
        "product_id",
        "event_type",
        F.to_date("occurred_at").alias("event_date"),
        "occurred_at",
    )


def fct_carts(carts: DataFrame) -> DataFrame:
    return carts.select(
        F.col("id").alias("cart_sk"),
        "customer_id",
        "session_id",
        "status",
        F.to_date("created_at").alias("created_date"),
        "created_at",
        "abandoned_at",
        "converted_at",
        whole_minutes("created_at", "abandoned_at").alias("minutes_to_abandon"),
    )


def dim_channel(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Every channel seen on an order or a signup, with a display name."""
    seen = (
        orders.select("channel")
        .unionByName(customers.select(F.col("signup_channel").alias("channel")))
        .filter("channel is not null")
        .distinct()
    )
    return seen.select("channel", F.initcap(F.replace(F.col("channel"), F.lit("_"), F.lit(" "))).alias("display_name"))


def presentable(df: DataFrame) -> DataFrame:
    """Decimals as doubles and narrow integers as longs, for reports and comparisons."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind == "decimal":
            out.append(dbl(f.name).alias(f.name))
        elif kind in ("integer", "short", "byte"):
            out.append(F.col(f.name).cast("long").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
