"""Checkout logic restated over all orders and carts at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tradewind.functions.money import cents, sum_cents, sum_money
from tradewind.schemas import (
    CART_STATUSES,
    EVENT_TYPES,
    FREE_SHIPPING_OVER,
    ORDER_STATUSES,
    SHIPPING_FLAT,
    TAX_RATE,
)

AMOUNT = "decimal(18,2)"


def _shipping(subtotal: Column) -> Column:
    """Free strictly above the threshold."""
    flat, none = F.lit(SHIPPING_FLAT).cast(AMOUNT), F.lit(0).cast(AMOUNT)
    return F.when(subtotal > F.lit(FREE_SHIPPING_OVER), none).otherwise(flat)


def _tax(base: Column) -> Column:
    """Rounded half to even, to the cent."""
    return F.bround(base * F.lit(TAX_RATE), 2).cast(AMOUNT)


def _codes(order_promos: DataFrame) -> DataFrame:
    """One row per order with a code: the code, and how many different ones it has."""
    return order_promos.filter("code is not null").groupBy("order_id").agg(
        F.min("code").alias("code"), F.countDistinct("code").alias("n_codes")
    )


def _active(promotions: DataFrame) -> DataFrame:
    """Active promotions by code, and how many share it."""
    return promotions.filter("is_active").groupBy("code").agg(
        F.min(F.struct("kind", "value")).alias("p"), F.count("*").alias("n_promos")
    )


def order_pricing(
    lines: DataFrame, products: DataFrame, order_promos: DataFrame, promotions: DataFrame
) -> DataFrame:
    """Totals of every order that may be placed: all products active, one promotion code at most and that valid.

    `lines`: order_id, product_id, quantity. `order_promos`: order_id, code (orders without a code
    may be absent). A code that several active promotions share is not valid. Lines collapse to order and product before
    they meet the catalog.
    """
    wanted = lines.groupBy("order_id", "product_id").agg(F.sum("quantity").alias("quantity"))
    p = products.select(F.col("id").alias("product_id"), "price", "is_active")
    purchasable = F.coalesce(F.col("is_active"), F.lit(False))
    per_order = (
        wanted.join(p, "product_id", "left")
        .groupBy("order_id")
        .agg(
            sum_cents(cents("price") * F.col("quantity")).cast(AMOUNT).alias("subtotal"),
            F.count_if(~purchasable).alias("rejected"),
        )
        .filter("rejected = 0")
    )
    active = _active(promotions).filter("n_promos = 1").select("code", "p.*")
    priced = (
        per_order.join(_codes(order_promos), "order_id", "left")
        .join(active, "code", "left")
        .filter("code is null or (n_codes = 1 and kind is not null)")
    )
    percent = F.bround(F.col("subtotal") * F.col("value") * F.lit(0.01).cast("decimal(3,2)"), 2)
    discount = (
        F.when(F.col("kind") == "percent", percent)
        .when(F.col("kind").isNotNull(), F.least(F.col("subtotal"), F.col("value")))
        .otherwise(F.lit(0))
        .cast(AMOUNT)
    )
    return (
        priced.withColumn("discount", discount)
        .withColumn("shipping", _shipping(F.col("subtotal")))
        .withColumn("tax", _tax(F.col("subtotal") - F.col("discount")))
        .select(
            "order_id",
            "subtotal",
            "discount",
            "shipping",
            "tax",
            (F.col("subtotal") - F.col("discount") + F.col("shipping") + F.col("tax")).alias("grand_total"),
        )
    )


def order_rejects(
    lines: DataFrame, products: DataFrame, order_promos: DataFrame, promotions: DataFrame
) -> DataFrame:
    """What keeps an order from being placed, one row per order and product or code."""
    wanted = lines.select("order_id", "product_id").distinct()
    p = products.select(F.col("id").alias("product_id"), "is_active")
    bad_lines = (
        wanted.join(p, "product_id", "left")
        .filter(~F.coalesce(F.col("is_active"), F.lit(False)))
        .select(
            "order_id",
            "product_id",
            F.when(F.col("is_active").isNull(), "missing_product").otherwise("inactive_product").alias("reason"),
        )
    )
    why = (
        F.when(F.col("n_codes") > 1, "several_codes")
        .when(F.col("n_promos").isNull(), "invalid_promo")
        .when(F.col("n_promos") > 1, "ambiguous_promo")
    )
    bad_codes = (
        _codes(order_promos)
        .join(_active(promotions), "code", "left")
        .select("order_id", F.lit(None).cast("long").alias("product_id"), why.alias("reason"))
        .filter("reason is not null")
    )
    return bad_lines.unionByName(bad_codes)


def cart_totals(carts: DataFrame, cart_items: DataFrame) -> DataFrame:
    """Totals before any promotion; an empty cart still shows the flat shipping rate."""
    per_cart = cart_items.groupBy("cart_id").agg(
        F.sum("quantity").alias("item_count"), sum_cents(cents("unit_price") * F.col("quantity")).alias("s")
    )
    subtotal = F.coalesce("s", F.lit(0)).cast(AMOUNT)
    return (
        carts.select(F.col("id").alias("cart_id"))
        .join(per_cart, "cart_id", "left")
        .withColumn("subtotal", subtotal)
        .withColumn("shipping", _shipping(F.col("subtotal")))
        .withColumn("tax", _tax(F.col("subtotal")))
        .select(
            "cart_id",
            F.coalesce("item_count", F.lit(0)).alias("item_count"),
            "subtotal",
            "shipping",
            "tax",
            (F.col("subtotal") + F.col("shipping") + F.col("tax")).alias("grand_total"),
        )
    )


def cart_merge(lines: DataFrame, cart: str = "cart_id") -> DataFrame:
    """Repeated adds of a product and variant become one line; no variant matches no variant."""
    return lines.groupBy(cart, "product_id", "variant_id").agg(F.sum("quantity").alias("quantity"))


def identity_stitch(carts: DataFrame, sightings: DataFrame) -> DataFrame:
    """Active guest carts go to the customer last seen in the same session.

    `sightings`: session_id, customer_id, occurred_at, id.
    """
    owner = (
        sightings.filter("customer_id is not null")
        .groupBy("session_id")
        .agg(F.max_by("customer_id", F.struct("occurred_at", "id")).alias("seen"))
    )
    guest = F.col("customer_id").isNull() & (F.col("status") == "active")
    claimed = guest & F.col("seen").isNotNull()
    return carts.join(owner, "session_id", "left").select(
        F.col("id").alias("cart_id"),
        "session_id",
        F.when(claimed, F.col("seen")).otherwise(F.col("customer_id")).alias("customer_id"),
        claimed.alias("was_claimed"),
    )


def stock_moves_from_sales(lines: DataFrame) -> DataFrame:
    """One movement out of stock per line whose variant is known."""
    return lines.filter("variant_id is not null").select(
        "variant_id",
        (-F.col("quantity")).alias("delta"),
        F.lit("sale").alias("reason"),
        F.col("order_id").alias("ref_order_id"),
    )


def catalog_search(
    products: DataFrame, category_id: int | Column | None = None, q: str | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    """Active products by category and part of the name, by id."""
    found = products.filter("is_active")
    if category_id is not None:
        found = found.filter(F.col("category_id") == category_id)
    if q:
        found = found.filter(F.col("name").ilike(f"%{q}%"))
    return found.orderBy("id").offset(offset).limit(limit)


def featured_products(products: DataFrame, n: int = 8) -> DataFrame:
    return products.filter("is_active").orderBy("id").limit(n)


def order_history(orders: DataFrame, order_items: DataFrame, limit: int = 20) -> DataFrame:
    """The newest orders of every customer with their lines, one row per line.

    The rank filter cuts each customer to `limit` orders before the shuffle as well. Lines stay rows
    rather than an array per order, so an order of any length fits.
    """
    newest = Window.partitionBy("customer_id").orderBy(F.desc("placed_at"), F.desc("id"))
    recent = (
        orders.select("customer_id", "id", "placed_at", "status", "grand_total")
        .withColumn("position", F.row_number().over(newest))
        .filter(F.col("position") <= limit)
    )
    lines = order_items.select(F.col("order_id").alias("_order_id"), "product_id", "variant_id", "quantity", "unit_price")
    return recent.join(lines, F.col("id") == F.col("_order_id"), "left").select(
        "customer_id",
        F.col("id").alias("order_id"),
        F.col("position").cast("long").alias("position"),
        F.to_date("placed_at").alias("placed_on"),
        "status",
        "grand_total",
        "product_id",
        "variant_id",
        "quantity",
        "unit_price",
    )


def order_audit(orders: DataFrame, order_items: DataFrame, payments: DataFrame) -> DataFrame:
    """Orders whose stored subtotal or payment differs from what the lines and totals say."""
    recomputed = order_items.groupBy("order_id").agg(
        sum_cents(F.col("quantity") * cents("unit_price")).cast(AMOUNT).alias("s")
    )
    paid = payments.groupBy("order_id").agg(sum_money("amount").alias("paid"))
    o = orders.select(F.col("id").alias("order_id"), F.col("subtotal").alias("stored"), "grand_total")
    amount = F.coalesce("s", F.lit(0)).cast(AMOUNT)
    return (
        o.join(recomputed, "order_id", "left")
        .join(paid, "order_id", "left")
        .select(
            "order_id",
            "stored",
            amount.alias("recomputed"),
            (F.col("stored") - amount).alias("diff"),
            (F.col("paid") - F.col("grand_total")).alias("payment_diff"),
        )
        .filter("diff <> 0 or payment_diff <> 0")
    )


# ---- data checks -----------------------------------------------------------------------------------


# (kind, table, column, parent table or accepted values)
CHECKS: tuple[tuple[str, str, str, object], ...] = (
    ("unique", "orders", "order_number", None),
    ("unique", "products", "sku", None),
    ("unique", "promotions", "code", None),
    ("unique", "payments", "order_id", None),
    ("fk", "orders", "customer_id", "customers"),
    ("fk", "order_items", "order_id", "orders"),
    ("fk", "order_items", "product_id", "products"),
    ("fk", "order_items", "variant_id", "product_variants"),
    ("fk", "product_variants", "product_id", "products"),
    ("fk", "promotion_redemptions", "order_id", "orders"),
    ("accepted", "orders", "status", ORDER_STATUSES),
    ("accepted", "carts", "status", CART_STATUSES),
    ("accepted", "product_events", "event_type", EVENT_TYPES),
)


def dq_checks(t: Mapping[str, DataFrame], checks: Sequence[tuple[str, str, str, object]] = CHECKS) -> DataFrame:
    """Uniqueness (values that occur more than once), references (rows that point at nothing) and accepted values.

    Every table is read once, as child and as parent. A value lives in a space: a parent's ids together with all references to them,
    or one column that should be unique. One aggregation by (space, value) then holds how often each check met the value and
    whether the parent has it, so nothing is joined and a hot key costs one row a task. Whole numbers stay numbers. Rows that
    can be judged alone (accepted values, references that are null) are settled in the scan.
    """
    spark = next(iter(t.values())).sparkSession
    spaces: dict[tuple, int] = {}
    slots: dict[int, tuple[int, int]] = {}  # check -> its space and its place among the space's checks
    for i, (kind, table, column, parent) in enumerate(checks):
        space = spaces.setdefault(("fk", parent) if kind == "fk" else (kind, table, column), len(spaces))
        slots[i] = (space, sum(own == space for own, _ in slots.values()))
    width = 1 + max((slot for _, slot in slots.values()), default=0)

    def whole(table: str, column: str) -> bool:
        return isinstance(t[table].schema[column].dataType, IntegralType)

    as_number = {("fk", p): whole(p, "id") and all(whole(c[1], c[2]) for c in checks if c[0] == "fk" and c[3] == p) for _, _, _, p in checks if isinstance(p, str)}

    def entry(space: int, value: Column, number: bool, slot: int, when: Column | None = None) -> Column:
        row = F.struct(
            F.lit(space).alias("space"),
            (value.cast("long") if number else F.lit(None).cast("long")).alias("number"),
            (F.lit(None).cast("string") if number else value.cast("string")).alias("text"),
            F.lit(slot).alias("slot"),
        )
        return row if when is None else F.when(when, row)

    entries: dict[str, list[Column]] = {}
    for i, (kind, table, column, extra) in enumerate(checks):
        (space, slot), value = slots[i], F.col(column)
        if kind == "fk":
            row = entry(space, value, as_number["fk", extra], slot, value.isNotNull())
        elif kind == "unique":
            row = entry(space, value, whole(table, column), slot)
        else:
            row = entry(space, F.lit(None), False, slot, value.isNull() | ~value.isin(*extra))
        entries.setdefault(table, []).append(row)
    for key, space in spaces.items():
        if key[0] == "fk":
            entries.setdefault(key[1], []).append(entry(space, F.col("id"), as_number[key], -1))
    rows = None
    for table, own in entries.items():
        each = t[table].select(F.explode(F.array(*own)).alias("e")).filter("e is not null").select("e.*")
        rows = each if rows is None else rows.unionByName(each)

    met = [F.count_if(F.col("slot") == k).alias(f"n{k}") for k in range(width)]
    values = rows.groupBy("space", "number", "text").agg(F.max(F.col("slot") == -1).alias("known"), *met)
    repeated = F.count_if(F.col("n0") > 1).alias("repeated")
    unknown = [F.sum(F.when(~F.col("known"), F.col(f"n{k}"))).alias(f"n{k}") for k in range(width)]
    per_space = values.groupBy("space").agg(repeated, *unknown)
    names = spark.createDataFrame(
        [(f"{kind} {column}", table, kind, *slots[i]) for i, (kind, table, column, _) in enumerate(checks)],
        "check string, table string, kind string, space int, slot int",
    )
    by_slot = F.array(*[F.col(f"n{k}") for k in range(width)])[F.col("slot")]
    bad = F.when(F.col("kind") == "unique", F.col("repeated")).otherwise(by_slot)
    return names.join(per_space, "space", "left").select("check", "table", F.coalesce(bad, F.lit(0)).cast("long").alias("n_bad"))
