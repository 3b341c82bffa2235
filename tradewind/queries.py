"""Every batch query by name, over the supplied tables. Each entry reads whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.functions.exprs import dbl, ts_lit
from tradewind.operators import affinity, bulk, churn, etl, forecast, itemsets, timelines
from tradewind.plans import analytics as an
from tradewind.plans import dims_facts as df_
from tradewind.plans import marts as m
from tradewind.plans import metrics as mt
from tradewind.plans import preaggregate as pre
from tradewind.plans import reports as rp
from tradewind.schemas import ENTITIES
from tradewind.session import run_path, tune_tables
from tradewind.sources.driver import Shop
from tradewind.streaming import jobs, timers

AS_OF_TS = datetime(2001, 8, 1, 23, 59, 59)
AS_OF_DATE = date(2001, 8, 1)
LATE_FROM = AS_OF_DATE - timedelta(days=10)  # streams in several pulls: the days before, the days since
SERIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", forecast.TOTAL_SERIES]  # the shop's categories and their sum

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(name: str):
    """Register `fn(shop) -> DataFrame` under `name`."""

    def register(fn: Callable[[Shop], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return df_.presentable(fn(Shop(tune_tables(spark), sf_dir)))

        _QUERIES[name] = run
        return fn

    return register


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


# ---- shared inputs ---------------------------------------------------------------------------------


def orders(s: Shop) -> DataFrame:
    return df_.fct_orders(s.orders())


def items(s: Shop) -> DataFrame:
    return df_.fct_order_items(s.order_items(), s.orders())


def last(s: Shop, days: int) -> Shop:
    """The shop as far as jobs see it that look back `days` from the clock."""
    return s.dated(AS_OF_DATE - timedelta(days=days), AS_OF_DATE)


def products(s: Shop) -> DataFrame:
    return df_.dim_product(s.products(), s.categories())


def series(s: Shop) -> DataFrame:
    return forecast.forecast_series(forecast.forecast_history(items(last(s, 540)), products(s), AS_OF_TS))


def entities(s: Shop) -> dict[str, DataFrame]:
    return {n: getattr(s, n)() for n in ENTITIES if hasattr(s, n)}


def price_snapshots(s: Shop) -> DataFrame:
    """The price and cost a product showed on each day it sold."""
    return items(s).groupBy("product_id", F.col("order_date").alias("snapshot_date")).agg(
        F.max("unit_price").alias("price"), F.max("unit_cost").alias("cost")
    )


def product_stock(s: Shop) -> DataFrame:
    return m.mart_inventory_aging(s.inventory_levels(), s.product_variants(), products(s)).select(
        "product_id", "on_hand"
    )


# ---- loads -----------------------------------------------------------------------------------------


@query("etl_full_refresh")
def _(s: Shop) -> DataFrame:
    stored = etl.full_refresh(s.products(), run_path(s.spark, "products"))
    return stored.select("id", "sku", "name", "category_id", "brand", "price", "cost", "is_active")


@query("etl_full_refresh_all")
def _(s: Shop) -> DataFrame:
    """All four small tables replaced and read back: rows and the sum of their ids."""
    out = None
    for name in etl.FULL_TABLES:
        stored = etl.full_refresh(getattr(s, name)(), run_path(s.spark, name))
        row = stored.agg(F.count("*").alias("n_rows"), F.sum("id").alias("id_sum")).select(F.lit(name).alias("table"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def _order_rows(s: Shop) -> DataFrame:
    """Orders as pulled: some have no time yet."""
    o = s.orders().select("id", "customer_id", "status", "channel", "grand_total", "placed_at")
    return o.withColumn("placed_at", F.when(F.col("id") % 50 != 0, F.col("placed_at")))


def _pulled(df: DataFrame, hour: int) -> DataFrame:
    return df.withColumn("_ingested_at", ts_lit(AS_OF_TS + timedelta(hours=hour)))


def _stored_orders(s: Shop, path: str) -> DataFrame:
    return s.spark.read.parquet(path).select("id", "customer_id", "status", "channel", "grand_total", "placed_at")


@query("etl_load_twice")
def _(s: Shop) -> DataFrame:
    """Two overlapping pulls, the second one loaded twice; every order is stored once, also those without a time."""
    o, path = _order_rows(s), run_path(s.spark, "orders-twice")
    first, second = o.filter("id % 10 < 7"), o.filter("id % 10 >= 4")
    for pull, hour in ((first, 1), (second, 2), (second, 2)):
        etl.load_fact(_pulled(pull, hour), "orders", path, "placed_at", grain="MONTH")
    return _stored_orders(s, path)


def _corrections(s: Shop) -> DataFrame:
    """Orders whose time moved, was lost or became known, with their last status."""
    o = s.orders().select("id", "customer_id", "status", "channel", "grand_total", "placed_at").filter("id % 10 = 0")
    moved = F.when(F.col("id") % 20 == 10, F.col("placed_at") + F.expr("INTERVAL 3 DAYS")).when(
        F.col("id") % 40 != 0, F.col("placed_at")
    )
    return o.withColumn("placed_at", moved).withColumn("status", F.lit("refunded"))


@query("etl_load_corrections")
def _(s: Shop) -> DataFrame:
    """All orders, then corrections that move rows between dates and in and out of the part without a time."""
    path = run_path(s.spark, "orders-corrected")
    etl.load_fact(_pulled(_order_rows(s), 1), "orders", path, "placed_at", grain="MONTH")
    for _again in range(2):
        etl.load_fact(_pulled(_corrections(s), 2), "orders", path, "placed_at", grain="MONTH")
    return _stored_orders(s, path)


@query("etl_load_days")
def _(s: Shop) -> DataFrame:
    """All carts under their days, then a pull that closes the carts of the last 48 hours, loaded twice."""
    path, kind = run_path(s.spark, "carts-days"), ["id", "customer_id", "session_id", "status", "created_at"]
    carts = s.carts().select(*kind)
    etl.load_fact(_pulled(carts, 1), "carts", path, "created_at")
    recent = etl.incremental_window(carts, "created_at", AS_OF_TS, hours=48).withColumn("status", F.lit("closed"))
    for _again in range(2):
        etl.load_fact(_pulled(recent, 2), "carts", path, "created_at")
    return s.spark.read.parquet(path).select(*kind)


@query("etl_reconcile_stored")
def _(s: Shop) -> DataFrame:
    """Orders against the stored table, into which every 97th has not come yet."""
    o, path = _order_rows(s), run_path(s.spark, "orders-late")
    etl.load_fact(_pulled(o.filter("id % 97 <> 0"), 1), "orders", path, "placed_at", grain="MONTH")
    return etl.reconcile(o, s.spark.read.parquet(path), "placed_at")


@query("etl_bootstrap")
def _(s: Shop) -> DataFrame:
    """Every table copied to storage; the counts are those of the stored copies."""
    root = run_path(s.spark, "bootstrap")
    copied = etl.bootstrap(entities(s), root, AS_OF_TS)
    return etl.table_counts({n: s.spark.read.parquet(f"{root}/{n}") for n, rows in copied.items() if rows})


@query("etl_incremental_window")
def _(s: Shop) -> DataFrame:
    """All seven tables of the hourly pull; rows of stock_movements go by their variant, for want of a key."""
    as_of = datetime(2001, 7, 31, 23, 59, 59)
    r = s.dated(as_of.date() - timedelta(days=1), AS_OF_DATE)
    tables = {t: getattr(r, t)() for t in etl.WINDOW_COLUMNS}
    tables["stock_movements"] = tables["stock_movements"].withColumn("id", F.col("variant_id"))
    pulls = {t: etl.incremental_window(df, etl.WINDOW_COLUMNS[t], as_of) for t, df in tables.items()}
    return etl.pull_report(pulls)


@query("etl_incremental_items")
def _(s: Shop) -> DataFrame:
    return etl.incremental_items(last(s, 2).order_items(), last(s, 2).orders(), AS_OF_TS, hours=48)


@query("etl_jsonl_roundtrip")
def _(s: Shop) -> DataFrame:
    kept = s.orders().select("id", "order_number", "customer_id", "status", "grand_total", "placed_at", "delivered_at")
    return etl.jsonl_roundtrip(kept, "orders")


@query("etl_line_store")
def _(s: Shop) -> DataFrame:
    """Lines as they are stored by the date of their order: rows and quantity of each month."""
    path, _ = s.line_store()
    stored = s.spark.read.parquet(path).withColumn("month", F.trunc("dt", "MONTH"))
    return stored.groupBy("month").agg(F.count("*").alias("n_rows"), F.sum(F.col("l_quantity").cast("long")).alias("units"))


@query("stg_dedupe")
def _(s: Shop) -> DataFrame:
    """Two overlapping pulls: the first saw every order as pending, the second its final status."""
    o = s.orders().select("id", "customer_id", "status", "grand_total", "placed_at")
    first = o.withColumn("status", F.lit("pending")).withColumn("_ingested_at", F.col("placed_at") + F.expr("INTERVAL 1 HOUR"))
    second = o.withColumn("_ingested_at", F.col("placed_at") + F.expr("INTERVAL 2 HOURS"))
    return etl.dedupe_latest(first.unionByName(second), ["id"])


@query("etl_bootstrap_counts")
def _(s: Shop) -> DataFrame:
    return etl.table_counts(entities(s))


@query("etl_reconcile")
def _(s: Shop) -> DataFrame:
    """Orders against the payments that arrived for them, by the order's date."""
    paid = s.orders().filter("paid_at is not null")
    return etl.reconcile(s.orders(), paid, "placed_at")


@query("scd2_product")
def _(s: Shop) -> DataFrame:
    return etl.scd2(price_snapshots(s), "product_id", ["price", "cost"])


@query("fct_items_in_force")
def _(s: Shop) -> DataFrame:
    """Every sold line with the price and cost that its product's history had in force that day."""
    lines = items(s).select("order_id", "product_id", "order_date", "quantity")
    history = etl.scd2(price_snapshots(s), "product_id", ["price", "cost"])
    return etl.facts_in_force(lines, history, "product_id", "order_date", ["price", "cost"])


@query("scd2_product_band")
def _(s: Shop) -> DataFrame:
    """Products by price band, seen every month; months that repeat the band before are no new version."""
    month = F.trunc("order_date", "MONTH").alias("snapshot_date")
    seen = items(s).groupBy("product_id", month).agg((F.max("unit_price").cast("long") - F.max("unit_price").cast("long") % 500).alias("band"))
    return etl.scd2(seen, "product_id", ["band"])


@query("scd2_customer")
def _(s: Shop) -> DataFrame:
    """Customers by the device and channel of their last order of a month."""
    newest = F.struct("placed_at", "id")
    seen = s.orders().groupBy("customer_id", F.trunc("placed_at", "MONTH").alias("snapshot_date")).agg(
        F.max_by("channel", newest).alias("channel"), F.max_by("device_type", newest).alias("device_type")
    )
    return etl.scd2(seen, "customer_id", ["channel", "device_type"])


@query("catalog_as_of")
def _(s: Shop) -> DataFrame:
    return etl.as_of(etl.scd2(price_snapshots(s), "product_id", ["price", "cost"]), date(2000, 1, 1))


# ---- dimensions and facts ----------------------------------------------------------------------------


@query("dim_date")
def _(s: Shop) -> DataFrame:
    """The calendar the orders span, whole years."""
    span = df_.date_bounds(s.orders(), "placed_at")
    years = span.select(
        F.trunc("first", "YEAR").alias("first"),
        F.date_sub(F.add_months(F.trunc("last", "YEAR"), 12), 1).alias("last"),
    )
    return df_.dim_date(years)


@query("dim_customer")
def _(s: Shop) -> DataFrame:
    return df_.dim_customer(s.customers(), AS_OF_DATE)


@query("dim_product")
def _(s: Shop) -> DataFrame:
    return products(s)


@query("fct_orders")
def _(s: Shop) -> DataFrame:
    return orders(s)


@query("fct_order_items")
def _(s: Shop) -> DataFrame:
    return items(s).drop("revenue_cents", "cost_cents")


@query("fct_stock_moves")
def _(s: Shop) -> DataFrame:
    return df_.fct_stock_moves(s.stock_movements(), s.product_variants())


@query("fct_product_events")
def _(s: Shop) -> DataFrame:
    return df_.fct_product_events(s.product_events())


@query("fct_carts")
def _(s: Shop) -> DataFrame:
    return df_.fct_carts(s.carts())


@query("dim_channel")
def _(s: Shop) -> DataFrame:
    return df_.dim_channel(s.orders(), s.customers())


# ---- marts -------------------------------------------------------------------------------------------


@query("mart_daily_revenue")
def daily_revenue(s: Shop) -> DataFrame:
    return m.mart_daily_revenue(orders(s))


@query("daily_revenue_dense")
def _(s: Shop) -> DataFrame:
    return m.daily_revenue_dense(orders(s))


def _velocity(s: Shop) -> DataFrame:
    return m.mart_product_velocity(items(last(s, 84)), products(s), AS_OF_DATE)


def _aging(s: Shop) -> DataFrame:
    return m.mart_inventory_aging(s.inventory_levels(), s.product_variants(), products(s))


query("mart_product_velocity")(_velocity)


@query("mart_category_pnl")
def _(s: Shop) -> DataFrame:
    return m.mart_category_pnl(items(s), products(s))


@query("mart_channel_perf")
def _(s: Shop) -> DataFrame:
    return m.mart_channel_perf(orders(s))


@query("mart_cohort_retention")
def _(s: Shop) -> DataFrame:
    return m.mart_cohort_retention(orders(s))


@query("cohort_retention_pct")
def _(s: Shop) -> DataFrame:
    return m.cohort_retention_pct(m.mart_cohort_retention(orders(s)))


def _lifecycle(s: Shop) -> DataFrame:
    return m.mart_customer_lifecycle(df_.dim_customer(s.customers(), AS_OF_DATE), orders(s), AS_OF_DATE)


query("mart_customer_lifecycle")(_lifecycle)


@query("mart_funnel")
def _(s: Shop) -> DataFrame:
    return m.mart_funnel(df_.fct_product_events(s.product_events()), df_.fct_carts(s.carts()), orders(s))


@query("mart_stockout_risk")
def _(s: Shop) -> DataFrame:
    return m.mart_stockout_risk(items(last(s, 28)), s.inventory_levels(), s.product_variants(), s.products(), AS_OF_DATE)


@query("mart_inventory_aging")
def _(s: Shop) -> DataFrame:
    return _aging(s).drop("available")


@query("tied_capital_slow")
def _(s: Shop) -> DataFrame:
    return m.tied_capital_slow(_aging(s), _velocity(s))


@query("mart_promo_lift_literal")
def _(s: Shop) -> DataFrame:
    return m.mart_promo_lift_literal(s.promotion_redemptions(), orders(s), items(s))


@query("mart_promo_lift")
def _(s: Shop) -> DataFrame:
    return m.mart_promo_lift(s.promotion_redemptions(), orders(s), items(s))


@query("promo_incremental_margin")
def _(s: Shop) -> DataFrame:
    return m.promo_incremental_margin(s.promotion_redemptions(), items(s))


@query("executive_daily")
def _(s: Shop) -> DataFrame:
    return m.executive_daily(m.mart_daily_revenue(orders(s)))


@query("forecast_overlay")
def _(s: Shop) -> DataFrame:
    """Two runs of the baseline, a day apart; the overlay shows the later one."""
    def run(days_ago: int) -> DataFrame:
        at = AS_OF_TS - timedelta(days=days_ago)
        known = series(s).filter(F.col("date") <= F.lit(at.date().isoformat()).cast("date"))
        return forecast.forecast_baseline(known).withColumn("model_run_at", ts_lit(at))

    return m.forecast_overlay(run(0).unionByName(run(1)))


@query("mart_fulfillment_sla")
def _(s: Shop) -> DataFrame:
    return m.mart_fulfillment_sla(s.shipments(), orders(s))


@query("mart_attribution")
def _(s: Shop) -> DataFrame:
    return m.mart_attribution(s.customers(), orders(s))


@query("churn_features")
def _(s: Shop) -> DataFrame:
    return churn.churn_features(orders(s), AS_OF_DATE)


@query("churn_score")
def _(s: Shop) -> DataFrame:
    return churn.churn_score(orders(s), AS_OF_DATE)


@query("churn_score_bounds")
def _(s: Shop) -> DataFrame:
    """Buyers scored, and whether every score is a probability."""
    scored = churn.churn_score(orders(s), AS_OF_DATE)
    return scored.agg(
        F.count("*").alias("buyers"), F.sum("frequency").alias("orders"), F.every(F.col("p_churn").between(0, 1)).alias("in_range")
    )


@query("churn_gradient")
def _(s: Shop) -> DataFrame:
    """The churn fit checked from outside: its loss has no slope left at the fitted weights."""
    return churn.churn_gradient(orders(s), AS_OF_DATE).select("feature", "n", F.round("mean", 6).alias("mean"), "is_flat")


@query("mart_product_affinity")
def _(s: Shop) -> DataFrame:
    return affinity.mart_product_affinity(items(s))


@query("brand_itemsets")
def _(s: Shop) -> DataFrame:
    """Up to three brands bought together in at least one percent of the baskets."""
    named = s.products().select(F.col("id").alias("product_id"), "brand")
    sets = itemsets.frequent_itemsets(s.order_items().join(named, "product_id"), "order_id", "brand", 0.01)
    return sets.select(F.array_join("items", "+").alias("brands"), "size", "n", "support")


@query("ltv_cac")
def _(s: Shop) -> DataFrame:
    return m.ltv_cac(s.customers(), orders(s), s.channel_cac())


@query("ltv_by_segment")
def _(s: Shop) -> DataFrame:
    return m.ltv_by_segment(_lifecycle(s))


# ---- in-app analytics --------------------------------------------------------------------------------


@query("kpi_summary")
def _(s: Shop) -> DataFrame:
    return an.kpi_summary(last(s, 30).orders(), AS_OF_TS)


@query("revenue_by_day")
def _(s: Shop) -> DataFrame:
    return an.revenue_by_day(last(s, 90).orders(), AS_OF_TS)


@query("top_products")
def _(s: Shop) -> DataFrame:
    return an.top_products(last(s, 30).order_items(), last(s, 30).orders(), s.products(), AS_OF_TS)


def _slow(s: Shop) -> DataFrame:
    return an.slow_movers(
        s.products(), last(s, 60).order_items(), last(s, 60).orders(), s.inventory_levels(), s.product_variants(), AS_OF_TS
    )


query("slow_movers")(_slow)


@query("slow_movers_literal")
def _(s: Shop) -> DataFrame:
    return an.slow_movers_literal(
        s.products(), s.order_items(), s.inventory_levels(), s.product_variants(), max_units=600
    )


@query("revenue_by_channel")
def _(s: Shop) -> DataFrame:
    return an.revenue_by_channel(last(s, 30).orders(), AS_OF_TS)


@query("cart_abandonment")
def _(s: Shop) -> DataFrame:
    return an.cart_abandonment(last(s, 30).carts(), AS_OF_TS)


@query("repeat_purchase_rate")
def _(s: Shop) -> DataFrame:
    return an.repeat_purchase_rate(last(s, 90).orders(), AS_OF_TS)


@query("cohort_retention")
def _(s: Shop) -> DataFrame:
    return an.cohort_retention(s.orders())


@query("aov_by_device")
def _(s: Shop) -> DataFrame:
    return an.aov_by_device(last(s, 30).orders(), AS_OF_TS)


@query("aov_median")
def _(s: Shop) -> DataFrame:
    return an.aov_median(last(s, 30).orders(), AS_OF_TS)


@query("gross_margin_by_category")
def _(s: Shop) -> DataFrame:
    return an.gross_margin_by_category(last(s, 30).order_items(), last(s, 30).orders(), s.products(), s.categories(), AS_OF_TS)


@query("stockouts_at_risk")
def _(s: Shop) -> DataFrame:
    return an.stockouts_at_risk(
        last(s, 28).order_items(), last(s, 28).orders(), s.inventory_levels(), s.product_variants(), s.products(), AS_OF_TS
    )


@query("stockouts_at_risk_literal")
def _(s: Shop) -> DataFrame:
    return an.stockouts_at_risk_literal(s.order_items(), s.inventory_levels(), s.product_variants(), s.products())


@query("funnel_last_30d")
def _(s: Shop) -> DataFrame:
    r = last(s, 30)
    return an.funnel_last_30d(r.product_events(), r.carts(), r.orders(), AS_OF_TS)


# ---- metric layer ------------------------------------------------------------------------------------


def _model(s: Shop) -> mt.Model:
    names = ("orders", "order_items", "products", "categories", "customers", "carts")
    return mt.shop_model({n: getattr(s, n) for n in names}, AS_OF_TS)


def _last(days: int) -> tuple[date, date]:
    return mt.date_range(AS_OF_DATE, f"last {days} days")


@query("metric_orders")
def _(s: Shop) -> DataFrame:
    measures = ["count", "revenue", "aov", "discount", "unique_customers"]
    return mt.metric_query(
        _model(s), [f"Orders.{x}" for x in measures], ["Orders.channel", "Orders.status", "Orders.utm_source"]
    )


@query("metric_repeat")
def _(s: Shop) -> DataFrame:
    return mt.metric_repeat(s.orders())


@query("metric_items")
def _(s: Shop) -> DataFrame:
    measures = ["units", "revenue", "cost", "gross_margin", "margin_pct"]
    return mt.metric_query(_model(s), [f"OrderItems.{x}" for x in measures], ["Products.brand"])


@query("metric_items_by_country")
def _(s: Shop) -> DataFrame:
    """Measures of lines by a dimension two joins away: lines to orders to customers."""
    return mt.metric_query(_model(s), ["OrderItems.units", "OrderItems.revenue"], ["Customers.signup_country", "Orders.device_type"])


@query("metric_date_ranges")
def _(s: Shop) -> DataFrame:
    """Orders of three periods, each named by its text."""
    out = None
    for text in ("last 7 days", "today", "2001-01-01 to 2001-03-31"):
        period = mt.date_range(AS_OF_DATE, text)
        told = mt.metric_query(_model(s.dated(*period)), ["Orders.count"], time_dimension="Orders.placed_at", granularity="day", dates=period)
        part = told.select(F.lit(text).alias("period"), "day", "count")
        out = part if out is None else out.unionByName(part)
    return out


@query("metric_products")
def _(s: Shop) -> DataFrame:
    out = mt.metric_query(
        _model(s),
        ["Products.count", "Products.active_count", "Products.list_margin_pct_avg"],
        ["Products.category_name"],
    )
    return out.withColumn("list_margin_pct_avg", F.round("list_margin_pct_avg", 6))


@query("metric_customers")
def _(s: Shop) -> DataFrame:
    return mt.metric_query(
        _model(s),
        ["Customers.count", "Customers.lifetime_revenue"],
        ["Customers.signup_channel", "Customers.signup_country"],
    )


@query("metric_customers_optin")
def _(s: Shop) -> DataFrame:
    return mt.metric_query(
        _model(s),
        ["Customers.count", "Customers.lifetime_revenue"],
        ["Customers.signup_channel"],
        segments=["Customers.opted_in_to_marketing"],
    )


@query("metric_customers_by_order_channel")
def _(s: Shop) -> DataFrame:
    """Customer measures by a dimension of their orders: each customer counts once per channel."""
    return mt.metric_query(_model(s), ["Customers.count", "Customers.lifetime_revenue"], ["Orders.channel"])


@query("metric_orders_and_items")
def _(s: Shop) -> DataFrame:
    """Measures of two tables side by side, each at its own grain."""
    return mt.metric_query(
        _model(s), ["Orders.revenue", "OrderItems.units", "OrderItems.revenue"], ["Orders.device_type"]
    )


@query("metric_carts")
def _(s: Shop) -> DataFrame:
    measures = ["count", "abandoned", "converted", "abandonment_rate"]
    return mt.metric_query(
        _model(s), [f"Carts.{x}" for x in measures], time_dimension="Carts.created_at", granularity="day"
    )


@query("rollup_daily")
def _(s: Shop) -> DataFrame:
    return mt.daily_rollup(s.orders()).drop("customer_sketch")


@query("rollup_unique_approx")
def _(s: Shop) -> DataFrame:
    return mt.rollup_unique_approx(mt.daily_rollup(s.orders()))


@query("rollup_unique_bounds")
def _(s: Shop) -> DataFrame:
    """Per channel, exact unique customers and whether the merged sketches come within five percent of them."""
    rollup = mt.rollup_unique_approx(mt.daily_rollup(s.orders()))
    exact = s.orders().filter("status <> 'cancelled'").groupBy("channel").agg(F.countDistinct("customer_id").alias("unique_customers"))
    near = F.abs(F.col("unique_customers_approx") - F.col("unique_customers")) <= F.col("unique_customers") * 0.05 + 1
    return exact.join(rollup, "channel").select("channel", "unique_customers", near.alias("within_bound"))


@query("rollup_daily_cube")
def _(s: Shop) -> DataFrame:
    return mt.rollup_levels(mt.daily_rollup(s.orders()))


def _prepared(s: Shop) -> DataFrame:
    path = run_path(s.spark, "prepared")
    pre.refresh(s.orders(), path, date(1990, 1, 1))
    return pre.read(s.spark, path)


@query("metric_prepared")
def _(s: Shop) -> DataFrame:
    """Orders by channel and month, answered from the stored days."""
    return pre.answer(
        _model(s), _prepared(s), [f"Orders.{x}" for x in pre.EXACT], ["Orders.channel"], "Orders.placed_at", "month"
    )


@query("metric_prepared_window")
def _(s: Shop) -> DataFrame:
    """Orders of the last 90 days by device and week, answered from the stored days of these months."""
    return pre.answer(
        _model(s), _prepared(s), ["Orders.revenue", "Orders.aov"], ["Orders.device_type"], "Orders.placed_at", "week", _last(90)
    )


@query("metric_prepared_sketches")
def _(s: Shop) -> DataFrame:
    """Per channel, whether merged sketches put the median total within 2 % of its rank and the customers within 5 %."""
    told = pre.answer(_model(s), _prepared(s), ["Orders.median_total", "Orders.unique_customers"], ["Orders.channel"], approximate=True)
    live = s.orders().filter("status <> 'cancelled'").join(told, "channel")
    below = F.avg((F.col("grand_total") < F.col("median_total")).cast("double"))
    upto = F.avg((F.col("grand_total") <= F.col("median_total")).cast("double"))
    exact = F.countDistinct("customer_id")
    return live.groupBy("channel").agg(
        F.count("*").alias("count"),
        ((below <= 0.52) & (upto >= 0.48)).alias("median_in_bound"),
        (F.abs(F.first("unique_customers") - exact) <= exact * 0.05 + 1).alias("customers_in_bound"),
    )


@query("sq_daily_revenue")
def _(s: Shop) -> DataFrame:
    return mt.metric_query(
        _model(last(s, 90)), ["Orders.revenue", "Orders.count"],
        time_dimension="Orders.placed_at", granularity="day", dates=_last(90),
    )


@query("sq_top_skus")
def _(s: Shop) -> DataFrame:
    return mt.metric_query(
        _model(last(s, 30)),
        ["OrderItems.revenue", "OrderItems.units", "OrderItems.gross_margin"],
        ["Products.sku", "Products.name", "Products.brand"],
        time_dimension="Orders.placed_at",
        dates=_last(30),
        order=[("OrderItems.revenue", "desc"), ("Products.sku", "asc")],
        limit=10,
    )


@query("sq_margin_category")
def _(s: Shop) -> DataFrame:
    return mt.metric_query(
        _model(last(s, 30)),
        ["OrderItems.revenue", "OrderItems.gross_margin", "OrderItems.margin_pct"],
        ["Products.category_name"],
        time_dimension="Orders.placed_at",
        dates=_last(30),
        order=[("OrderItems.gross_margin", "desc")],
    )


@query("sq_aov_device")
def _(s: Shop) -> DataFrame:
    return mt.metric_query(
        _model(last(s, 30)), ["Orders.aov", "Orders.count"], ["Orders.device_type"],
        time_dimension="Orders.placed_at", dates=_last(30),
    )


@query("sq_abandonment")
def _(s: Shop) -> DataFrame:
    return mt.metric_query(
        _model(last(s, 30)), ["Carts.abandonment_rate", "Carts.abandoned", "Carts.count"],
        time_dimension="Carts.created_at", dates=_last(30),
    )


# ---- reports -----------------------------------------------------------------------------------------


@query("kpi_period_delta")
def _(s: Shop) -> DataFrame:
    return rp.kpi_period_delta(last(s, 60).orders(), AS_OF_TS)


@query("repeat_rate_delta")
def _(s: Shop) -> DataFrame:
    return rp.repeat_rate_delta(last(s, 180).orders(), AS_OF_TS)


@query("channel_share")
def _(s: Shop) -> DataFrame:
    return rp.channel_share(last(s, 30).orders(), AS_OF_TS)


@query("product_concentration")
def _(s: Shop) -> DataFrame:
    return rp.product_concentration(last(s, 30).order_items(), last(s, 30).orders(), s.products(), AS_OF_TS)


@query("slow_capital")
def _(s: Shop) -> DataFrame:
    return rp.slow_capital(_slow(s))


@query("best_aov_channel")
def _(s: Shop) -> DataFrame:
    return rp.best_aov_channel(last(s, 30).orders(), AS_OF_TS)


@query("funnel_drops")
def _(s: Shop) -> DataFrame:
    r = last(s, 30)
    return rp.funnel_drops(r.product_events(), r.carts(), r.orders(), AS_OF_TS)


@query("funnel_point_value")
def _(s: Shop) -> DataFrame:
    r = last(s, 30)
    return rp.funnel_point_value(r.product_events(), r.carts(), r.orders(), AS_OF_TS)


@query("forecast_totals")
def _(s: Shop) -> DataFrame:
    f = forecast.forecast_baseline(series(s)).filter(F.col("category_name") == forecast.TOTAL_SERIES)
    return rp.forecast_totals(f)


@query("kpi_mtd")
def _(s: Shop) -> DataFrame:
    return rp.kpi_mtd(orders(last(s, 31)), AS_OF_DATE)


@query("category_vs_prior")
def _(s: Shop) -> DataFrame:
    return rp.category_vs_prior(items(last(s, 60)), products(s), AS_OF_DATE)


@query("velocity_heatmap")
def _(s: Shop) -> DataFrame:
    return rp.velocity_heatmap(items(last(s, 84)), products(s), AS_OF_DATE)


@query("promo_month_pivot")
def _(s: Shop) -> DataFrame:
    return rp.promo_month_pivot(s.promotion_redemptions(), orders(s), items(s), AS_OF_DATE)


@query("top25_skus")
def _(s: Shop) -> DataFrame:
    return rp.top_skus(last(s, 30).order_items(), last(s, 30).orders(), s.products(), AS_OF_TS)


@query("forecast_7d")
def _(s: Shop) -> DataFrame:
    return rp.forecast_pivot(forecast.forecast_baseline(series(s)), AS_OF_DATE + timedelta(days=1), SERIES)


@query("wow_same_weekday")
def _(s: Shop) -> DataFrame:
    return rp.wow_same_weekday(orders(s))


@query("abandonment_trend")
def _(s: Shop) -> DataFrame:
    return rp.abandonment_trend(s.carts(), s.page_views())


# ---- forecasts ---------------------------------------------------------------------------------------


@query("forecast_history")
def _(s: Shop) -> DataFrame:
    return forecast.forecast_history(items(last(s, 540)), products(s), AS_OF_TS)


@query("forecast_series")
def _(s: Shop) -> DataFrame:
    return series(s)


@query("forecast_fit")
def _(s: Shop) -> DataFrame:
    return forecast.forecast_all(series(s))


@query("forecast_baseline")
def _(s: Shop) -> DataFrame:
    return forecast.forecast_baseline(series(s))


@query("forecast_sums")
def _(s: Shop) -> DataFrame:
    """All that the fit of a series is made of: sums of its design columns, of the revenue and of their products, per weekday."""
    daily = series(s).select("category_name", "date", dbl("revenue").alias("y"))
    return forecast.listed_sums(forecast.fit_sums(daily, ["category_name"]), ["category_name"])


@query("walk_forward")
def _(s: Shop) -> DataFrame:
    return forecast.walk_forward(series(s))


def _week_before_errors(s: Shop) -> DataFrame:
    known = series(s)
    ahead = known.select(
        "category_name",
        F.date_add("date", 7).alias("forecast_date"),
        dbl("revenue").alias("yhat"),
        (dbl("revenue") * 0.5).alias("yhat_lower"),
        (dbl("revenue") * 1.5).alias("yhat_upper"),
    )
    return forecast.forecast_errors(known, ahead, ["category_name"])


@query("forecast_errors")
def _(s: Shop) -> DataFrame:
    """Scores of a given forecast (the value a week before, with a fixed band) against what was sold."""
    return _week_before_errors(s)


@query("forecast_metrics_file")
def _(s: Shop) -> DataFrame:
    """Those scores by way of the metrics file."""
    metrics, at = _week_before_errors(s), run_path(s.spark, "forecast-metrics")
    etl.write_metrics_json(metrics, at)
    return etl.read_metrics_json(metrics, at)


@query("forecast_alert")
def _(s: Shop) -> DataFrame:
    """Monthly errors of that forecast, and the series over their target twice in a row."""
    known = series(s)
    ahead = known.select("category_name", F.date_add("date", 7).alias("date"), dbl("revenue").alias("yhat"))
    y = dbl("revenue")
    months = known.join(ahead, ["category_name", "date"]).groupBy("category_name", F.trunc("date", "MONTH").alias("model_run_at")).agg(
        F.round(F.avg(F.abs(y - F.col("yhat")) / F.when(y != 0, y)), 4).alias("mape")
    )
    return forecast.forecast_alert(months)


@query("cold_start")
def _(s: Shop) -> DataFrame:
    """Series cut to their last 20 days: too short to fit, so their mean is carried on."""
    short = series(s).filter(F.col("date") > F.lit((AS_OF_DATE - timedelta(days=20)).isoformat()).cast("date"))
    cold = forecast.cold_start(short)
    return cold.withColumns({c: F.round(c, 2) for c in ("yhat", "yhat_lower", "yhat_upper")})


@query("forecast_runs")
def _(s: Shop) -> DataFrame:
    """Two runs appended, the first written again: each is stored once."""
    path, known = run_path(s.spark, "forecast-runs"), forecast.forecast_baseline(series(s))
    for days_ago in (1, 0, 1):
        forecast.write_forecast(known, path, AS_OF_TS - timedelta(days=days_ago))
    stored = s.spark.read.parquet(path)
    return stored.select("category_name", "forecast_date", "yhat", "yhat_lower", "yhat_upper", F.col("model_run").cast("string").alias("model_run"))


@query("forecast_files")
def _(s: Shop) -> DataFrame:
    """The baseline forecast by the result files: one series as JSON, all as CSV by category."""
    at, known = run_path(s.spark, "forecast-files"), forecast.forecast_baseline(series(s))
    etl.write_forecast_json(known.filter(F.col("category_name") == forecast.TOTAL_SERIES), f"{at}/json")
    etl.write_category_csv(known, f"{at}/csv")
    kind = "category_name string, forecast_date date, yhat double, yhat_lower double, yhat_upper double"
    total = s.spark.read.schema(kind).json(f"{at}/json").withColumn("file", F.lit("json"))
    rows = s.spark.read.option("header", "true").csv(f"{at}/csv")
    rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in total.drop("file").schema]).withColumn("file", F.lit("csv"))
    return total.unionByName(rows)


@query("walk_forward_baseline")
def _(s: Shop) -> DataFrame:
    return forecast.walk_forward_baseline(series(s))


@query("walk_forward_summary")
def _(s: Shop) -> DataFrame:
    return forecast.walk_forward_summary(series(s))


@query("forecast_cover")
def _(s: Shop) -> DataFrame:
    f = forecast.forecast_baseline(series(s)).filter(F.col("category_name") != forecast.TOTAL_SERIES)
    return forecast.forecast_cover(f, items(last(s, 84)), products(s), product_stock(s), AS_OF_DATE)


@query("residual_hist")
def _(s: Shop) -> DataFrame:
    return forecast.residual_hist(forecast.baseline_residuals(series(s)))


# ---- timelines and bulk jobs -------------------------------------------------------------------------


@query("events_hourly")
def _(s: Shop) -> DataFrame:
    return timelines.events_by_hour(s.product_events())


@query("sessionize")
def _(s: Shop) -> DataFrame:
    return timelines.sessionize(s.shop_events(), gap=timedelta(hours=6))


@query("stock_running")
def _(s: Shop) -> DataFrame:
    return timelines.stock_running(s.stock_movements())


def _order_codes(s: Shop) -> DataFrame:
    codes = s.promotions().select(F.col("id").alias("promotion_id"), "code")
    return s.promotion_redemptions().join(codes, "promotion_id").select("order_id", "code")


@query("order_pricing")
def _(s: Shop) -> DataFrame:
    return bulk.order_pricing(s.order_items(), s.products(), _order_codes(s), s.promotions())


@query("order_rejects")
def _(s: Shop) -> DataFrame:
    return bulk.order_rejects(s.order_items(), s.products(), _order_codes(s), s.promotions())


@query("cart_totals")
def _(s: Shop) -> DataFrame:
    return bulk.cart_totals(s.carts(), s.cart_items())


@query("cart_merge")
def _(s: Shop) -> DataFrame:
    """The adds of a session, merged as one cart."""
    carts = s.carts().select(F.col("id").alias("cart_id"), "session_id")
    return bulk.cart_merge(s.cart_items().join(carts, "cart_id"), cart="session_id")


@query("identity_stitch")
def _(s: Shop) -> DataFrame:
    return bulk.identity_stitch(s.carts(), s.product_events())


@query("stock_moves_from_sales")
def _(s: Shop) -> DataFrame:
    return bulk.stock_moves_from_sales(s.order_items())


@query("catalog_search")
def _(s: Shop) -> DataFrame:
    found = bulk.catalog_search(s.products(), q="RING", limit=50, offset=10)
    return found.select("id", "sku", "name", "brand", dbl("price").alias("price"))


@query("catalog_by_category")
def _(s: Shop) -> DataFrame:
    """The first active products of the category that comes first by name."""
    first = s.categories().agg(F.min_by("id", "name")).scalar()
    found = bulk.catalog_search(s.products(), category_id=first, limit=20)
    return found.select("id", "sku", "name", "brand", dbl("price").alias("price"))


@query("featured_products")
def _(s: Shop) -> DataFrame:
    return bulk.featured_products(s.products()).select("id", "sku", "name", "brand", dbl("price").alias("price"))


def _odd_codes(s: Shop) -> tuple[DataFrame, DataFrame]:
    """Codes where some orders carry two or an unknown one, and promotions where one code is given twice."""
    codes = _order_codes(s)
    second = codes.filter("order_id % 150 = 0").withColumn("code", F.lit("SECOND"))
    unknown = codes.withColumn("code", F.when(F.col("order_id") % 150 == 1, F.lit("NOPE")).otherwise(F.col("code")))
    again = s.promotions().filter("code = 'BFCM30'").withColumn("value", F.lit(5).cast("decimal(12,2)"))
    return unknown.unionByName(second), s.promotions().unionByName(again)


@query("order_pricing_codes")
def _(s: Shop) -> DataFrame:
    codes, promotions = _odd_codes(s)
    return bulk.order_pricing(s.order_items(), s.products(), codes, promotions)


@query("order_rejects_codes")
def _(s: Shop) -> DataFrame:
    codes, promotions = _odd_codes(s)
    return bulk.order_rejects(s.order_items(), s.products(), codes, promotions).filter("product_id is null").drop("product_id")


@query("order_history")
def _(s: Shop) -> DataFrame:
    return bulk.order_history(s.orders(), s.order_items(), limit=5)


@query("order_audit")
def _(s: Shop) -> DataFrame:
    return bulk.order_audit(s.orders(), s.order_items(), s.payments())


@query("dq_checks")
def _(s: Shop) -> DataFrame:
    return bulk.dq_checks(entities(s))


# ---- streams: the same jobs over files that arrive, run until nothing is left -------------------------


def _timed(df: DataFrame, *columns: str) -> DataFrame:
    """Event times as the TIMESTAMP a watermark needs."""
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})


def _drained(s: Shop, name: str, stream: DataFrame, mode: str = "append") -> DataFrame:
    return jobs.run_available(stream, run_path(s.spark, name), run_path(s.spark, f"{name}-progress"), mode)


def _event_stream(s: Shop) -> DataFrame:
    return _timed(s.streaming("events").shop_events(), "occurred_at")


@query("stream_ingest")
def _(s: Shop) -> DataFrame:
    """All events offered to the ingest: purchases are not a click type and land in quarantine."""
    good, bad, progress = (run_path(s.spark, f"ingest-{x}") for x in ("good", "bad", "progress"))
    jobs.ingest_events(_event_stream(s), good, bad, progress).start().awaitTermination()
    kept = s.spark.read.parquet(good).withColumn("reason", F.lit("accepted"))
    refused = s.spark.read.parquet(bad)
    both = kept.select("reason", "event_type").unionByName(refused.select("reason", "event_type"))
    return both.groupBy("reason", "event_type").agg(F.count("*").alias("n"))


@query("stream_dedupe")
def _(s: Shop) -> DataFrame:
    """Two overlapping pulls of the same events, each event passed on once."""
    pulls = _event_stream(s).unionByName(_event_stream(s))
    return _drained(s, "dedupe", jobs.dedupe_stream(pulls).select("id", "event_type", "session_id"))


@query("stream_events_hourly")
def _(s: Shop) -> DataFrame:
    """Hours the watermark has closed."""
    counts = jobs.event_counts(_event_stream(s))
    return _drained(s, "hourly", counts).select(F.col("start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("stream_sessions")
def _(s: Shop) -> DataFrame:
    """Sessions the watermark has closed."""
    closed = _drained(s, "sessions", jobs.cart_sessions(_event_stream(s), gap="6 hours"))
    return closed.select(
        "session_id",
        F.col("session_start").cast("timestamp_ntz").alias("session_start"),
        F.col("session_end").cast("timestamp_ntz").alias("session_end"),
        "n_events",
        "status",
    )


@query("stream_sessions_by_timer")
def _(s: Shop) -> DataFrame:
    """Sessions per user closed by event-time timers, over two pulls: the second starts from the checkpoint of the first."""
    events = _timed(s.shop_events().select("user_id", "event_type", "occurred_at"), "occurred_at")
    arrived, sink, progress = (run_path(s.spark, f"timers-{x}") for x in ("in", "closed", "progress"))
    early = F.col("occurred_at") < F.lit(LATE_FROM.isoformat()).cast("timestamp")
    for pull in (events.filter(early), events.filter(~early)):
        pull.write.mode("append").parquet(arrived)
        stream = s.spark.readStream.schema(events.schema).parquet(arrived)
        closed = timers.run_with_rocksdb(timers.closed_sessions(stream, timedelta(hours=6), jobs.DELAY), sink, progress)
    ntz = {c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")}
    return closed.withColumns(ntz)


@query("stream_cart_to_order")
def _(s: Shop) -> DataFrame:
    live = s.streaming("events", "orders")
    joined = jobs.cart_to_order(_timed(live.carts(), "created_at"), _timed(live.orders(), "placed_at"))
    return _drained(s, "conversion", joined)


@query("stream_stock_totals")
def _(s: Shop) -> DataFrame:
    """Opening stock and the sales out of it, arriving pull by pull, merged by key batch by batch."""
    opening = s.inventory_levels().select("variant_id", "warehouse_code", F.col("on_hand").alias("delta"))
    sold = bulk.stock_moves_from_sales(s.order_items()).select("variant_id", F.lit("MAIN").alias("warehouse_code"), "delta")
    arrived, sink, progress = (run_path(s.spark, f"stock-{x}") for x in ("in", "totals", "progress"))
    for part in (opening, sold.filter("variant_id % 3 > 0"), sold.filter("variant_id % 3 = 0")):
        part.write.mode("append").parquet(arrived)
        moves = s.spark.readStream.schema(opening.schema).parquet(arrived)
        totals = jobs.run_available(jobs.stock_totals(moves), sink, progress, "update", ["variant_id", "warehouse_code"])
    return totals


@query("stream_sliding_revenue")
def _(s: Shop) -> DataFrame:
    """Seven-day windows that the watermark has closed."""
    live = _timed(s.streaming("orders").orders().select("status", "grand_total", "placed_at"), "placed_at")
    closed = _drained(s, "sliding", jobs.sliding_revenue(live))
    return closed.select(
        F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "revenue", "orders"
    )


@query("stream_daily_revenue")
def _(s: Shop) -> DataFrame:
    """Days kept current by a stream of orders that ends in corrections: first all orders, then the moved ones."""
    kind = ["id", "customer_id", "status", "channel", "grand_total", "placed_at", "_ingested_at"]
    arrived, stored, out, progress = (run_path(s.spark, f"orders-{x}") for x in ("in", "stored", "days", "progress"))
    for pull, hour in ((_order_rows(s), 1), (_corrections(s), 2)):
        rows = _timed(_pulled(pull, hour).select(*kind), "placed_at", "_ingested_at")
        rows.write.mode("append").parquet(arrived)
        stream = s.spark.readStream.schema(rows.schema).parquet(arrived)
        jobs.daily_revenue_stream(stream, stored, out, progress, grain="MONTH").start().awaitTermination()
    return s.spark.read.parquet(out).filter("orders > 0").select("date", "revenue", "orders")


def _counted_late(s: Shop) -> tuple[DataFrame, DataFrame]:
    """Events, and their daily counts by a stream that lost every 13th."""
    events = s.product_events()
    streamed = events.filter("id % 13 <> 0").groupBy(F.to_date("occurred_at").alias("date")).agg(F.count("*").alias("n"))
    return events, streamed


@query("late_report")
def _(s: Shop) -> DataFrame:
    events, streamed = _counted_late(s)
    return jobs.late_report(streamed, events)


@query("late_repair")
def _(s: Shop) -> DataFrame:
    events, streamed = _counted_late(s)
    return jobs.repair_days(events, jobs.late_report(streamed, events))


def _disordered(s: Shop, dropped: list[int]) -> DataFrame:
    """Click events taken by a stream in three pulls, and what each pull lost: the days before LATE_FROM, the days since, and
    then every 13th event of all days, most of them far behind the watermark by now."""
    events = _timed(s.product_events(), "occurred_at")
    held_back, early = F.col("id") % 13 == 0, F.col("occurred_at") < F.lit(LATE_FROM.isoformat()).cast("timestamp")
    arrived, sink, progress = (run_path(s.spark, f"late-{x}") for x in ("in", "taken", "progress"))
    for pull in (events.filter(~held_back & early), events.filter(~held_back & ~early), events.filter(held_back)):
        pull.write.mode("append").parquet(arrived)
        dropped.append(jobs.deduped_pull(s.spark.readStream.schema(events.schema).parquet(arrived), sink, progress))
    return s.spark.read.schema(events.schema).parquet(sink)


@query("stream_late_rows")
def _(s: Shop) -> DataFrame:
    """Rows that each pull lost to the watermark, as the stream itself counted them."""
    dropped: list[int] = []
    _disordered(s, dropped)
    return s.spark.createDataFrame([(i, n) for i, n in enumerate(dropped, 1)], "pull long, dropped long")


@query("stream_late_repair")
def _(s: Shop) -> DataFrame:
    """The nightly repair after those pulls: days on which the stream lost rows, counted again from all events."""
    events = s.product_events()
    streamed = _disordered(s, []).groupBy(F.to_date("occurred_at").alias("date")).agg(F.count("*").alias("n"))
    return jobs.repair_days(events, jobs.late_report(streamed, events))
