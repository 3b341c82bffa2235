"""Entity schemas, accepted values and the fixed business constants."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
TS = T.TimestampType()

# The vocabulary the source shop writes.
ORDER_STATUSES = ("pending", "paid", "fulfilled", "shipped", "delivered", "cancelled", "refunded")
EVENT_TYPES = ("view", "add_to_cart", "remove_from_cart", "wishlist")
CART_STATUSES = ("active", "abandoned", "converted")
RECOGNIZED_STATUSES = ("paid", "fulfilled", "shipped", "delivered")
CHECKOUT_STATUSES = ("abandoned", "converted")
SESSION_ID_MAX = 64

# Checkout pricing.
TAX_RATE = Decimal("0.08")
FREE_SHIPPING_OVER = Decimal("75.00")
SHIPPING_FLAT = Decimal("9.99")

# Forecast rules and targets.
MIN_HISTORY_POINTS = 60
YEARLY_MIN_POINTS = 365
TOTAL_SERIES = "__total__"
MAPE_TARGET_TOTAL = 0.10
MAPE_TARGET_CATEGORY = 0.18


def _struct(ddl: str) -> T.StructType:
    kinds = {
        "long": T.LongType(),
        "string": T.StringType(),
        "money": MONEY,
        "ts": TS,
        "bool": T.BooleanType(),
        "date": T.DateType(),
        "double": T.DoubleType(),
    }
    fields = []
    for part in ddl.split(","):
        name, kind = part.split()
        fields.append(T.StructField(name, kinds[kind], True))
    return T.StructType(fields)


ENTITIES: dict[str, T.StructType] = {
    "customers": _struct(
        "id long, email string, first_name string, last_name string, signup_channel string,"
        " signup_country string, marketing_opt_in bool, created_at ts, updated_at ts"
    ),
    "addresses": _struct(
        "id long, customer_id long, line1 string, line2 string, city string, region string,"
        " postal_code string, country string, is_default bool"
    ),
    "categories": _struct("id long, slug string, name string, parent_id long"),
    "products": _struct(
        "id long, sku string, name string, description string, category_id long, brand string,"
        " price money, cost money, weight_grams long, is_active bool, launched_at ts, created_at ts"
    ),
    "product_variants": _struct(
        "id long, product_id long, sku string, size string, color string, price_override money"
    ),
    "orders": _struct(
        "id long, order_number string, customer_id long, status string, currency string,"
        " subtotal money, discount_total money, shipping_total money, tax_total money,"
        " grand_total money, channel string, utm_source string, utm_campaign string,"
        " device_type string, placed_at ts, paid_at ts, fulfilled_at ts, delivered_at ts,"
        " cancelled_at ts"
    ),
    "order_items": _struct(
        "id long, order_id long, product_id long, variant_id long, quantity long,"
        " unit_price money, unit_cost money, line_discount money"
    ),
    "payments": _struct(
        "id long, order_id long, provider string, method string, status string, amount money,"
        " captured_at ts"
    ),
    "shipments": _struct(
        "id long, order_id long, carrier string, tracking_number string, status string,"
        " picked_at ts, shipped_at ts, delivered_at ts"
    ),
    "inventory_levels": _struct(
        "id long, variant_id long, warehouse_code string, on_hand long, reserved long,"
        " reorder_point long, updated_at ts"
    ),
    "stock_movements": _struct(
        "id long, variant_id long, warehouse_code string, delta long, reason string,"
        " ref_order_id long, occurred_at ts"
    ),
    "carts": _struct(
        "id long, customer_id long, session_id string, status string, created_at ts,"
        " abandoned_at ts, converted_at ts"
    ),
    "cart_items": _struct(
        "id long, cart_id long, product_id long, variant_id long, quantity long, unit_price money"
    ),
    "product_events": _struct(
        "id long, session_id string, customer_id long, product_id long, event_type string,"
        " occurred_at ts"
    ),
    "page_views": _struct(
        "id long, session_id string, customer_id long, path string, referrer string,"
        " device_type string, occurred_at ts"
    ),
    "promotions": _struct(
        "id long, code string, kind string, value money, starts_at ts, ends_at ts, is_active bool"
    ),
    "promotion_redemptions": _struct(
        "id long, promotion_id long, order_id long, customer_id long, amount_off money,"
        " redeemed_at ts"
    ),
    "demand_forecast": _struct(
        "forecast_date date, category_name string, yhat double, yhat_lower double,"
        " yhat_upper double, model_run_at ts"
    ),
}

# Storage layout of the raw tables: (time column that gives the date partition, cluster columns).
LAYOUT: dict[str, tuple[str | None, tuple[str, ...]]] = {
    "customers": ("created_at", ("signup_channel",)),
    "products": ("launched_at", ("brand", "is_active")),
    "orders": ("placed_at", ("status", "channel")),
    "stock_movements": ("occurred_at", ("variant_id",)),
    "carts": ("created_at", ("status",)),
    "product_events": ("occurred_at", ("event_type",)),
    "promotion_redemptions": ("redeemed_at", ("promotion_id",)),
}
