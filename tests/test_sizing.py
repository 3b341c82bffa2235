from __future__ import annotations

from datetime import date, datetime

from helpers import frame, rows

from pyspark.sql import functions as F
from tradewind import queries
from tradewind.functions.money import cents, money, sum_money
from tradewind.functions.sizing import sums_by_attribute
from tradewind.plans import analytics, dims_facts, marts


def test_sums_by_attribute(spark):
    fact = frame(spark, "k bigint, day date, v bigint",
                 [(i % 5, f"2024-01-0{1 + i % 3}", i) for i in range(60)] + [(9, "2024-01-01", 5), (None, "2024-01-01", 7)])
    dim = frame(spark, "k bigint, name string", [(0, "a"), (1, "a"), (2, "b"), (3, None), (4, "b"), (8, "c")])
    got = rows(sums_by_attribute(fact, dim, "k", ["name"], {"v": F.col("v")}, ["day"]))
    assert len(got) == 9 and sum(r[-1] for r in got) == sum(range(60))
    plan = sums_by_attribute(fact, dim, "k", ["name"], {"v": F.col("v")})
    assert "broadcast)" not in plan._jdf.queryExecution().logical().toString().lower()


def test_cents_are_exact(spark):
    df = frame(spark, "m decimal(12|2)", [("0.01",), ("9999999999.99",), ("-5.55",), (None,)])
    assert [r[0] for r in df.select(cents("m").alias("c")).collect()] == [1, 999999999999, -555, None]
    assert str(df.agg(sum_money("m").alias("s")).first().s) == "9999999994.45"
    assert str(df.select(money(F.lit(7)).alias("s")).first().s) == "0.07"


def test_sides_as_long_as_the_catalog_are_not_broadcast(spark):
    """Exploded variants and stock look small by their files; sent whole, they would fill the driver."""
    products = spark.range(3).selectExpr("id", "concat('S', id) as sku", "concat('N', id) as name")
    variants = products.selectExpr("id as product_id", "explode(sequence(0, 3)) as k").selectExpr(
        "product_id * 4 + k as id", "product_id", "'S' as size", "'red' as color")
    inventory = variants.selectExpr("id as variant_id", "explode(array('MAIN', 'EAST')) as warehouse_code", "id + 1 as on_hand",
                                    "cast(0 as bigint) as reserved", "cast(1 as bigint) as reorder_point")
    lines = variants.selectExpr("cast(1 as bigint) as order_id", "id as variant_id", "product_id", "cast(56 as bigint) as quantity",
                                "date'2024-03-01' as order_date")
    orders = frame(spark, "id bigint, status string, placed_at timestamp_ntz", [(1, "paid", "2024-03-01 00:00:00")])
    dim = products.selectExpr("id as product_id", "sku", "name", "'c' as category_name", "'b' as brand", "cast(1 as decimal(12,2)) as list_cost")
    moves = inventory.selectExpr("variant_id", "warehouse_code", "on_hand as delta", "'sale' as reason",
                                 "cast(1 as bigint) as ref_order_id", "timestamp_ntz'2024-03-01 00:00:00' as occurred_at")
    plans = {
        "mart_stockout_risk": (marts.mart_stockout_risk(lines, inventory, variants, products, date(2024, 3, 10)), 12),
        "mart_inventory_aging": (marts.mart_inventory_aging(inventory, variants, dim), 3),
        "stockouts_at_risk": (analytics.stockouts_at_risk(lines, orders, inventory, variants, products, datetime(2024, 3, 10)), 24),
        "stockouts_at_risk_literal": (analytics.stockouts_at_risk_literal(lines, inventory, variants, products), 24),
        "fct_stock_moves": (dims_facts.fct_stock_moves(moves, variants), 24),
    }
    for name, (df, n) in plans.items():
        sizes = df._jdf.queryExecution().executedPlan().toString()
        # The orders of a window may still be broadcast, the catalog may not.
        assert sizes.count("BroadcastHashJoin") <= (name == "stockouts_at_risk"), name
        assert df.count() == n, name


def test_tasks_stay_small_whatever_the_number_of_shuffle_partitions(spark):
    """Four shuffle partitions, as in these tests, would hand a quarter of any table to one task."""
    keys = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        queries.all_queries()["dim_channel"](spark, "/root/testdata/sf0.001")  # any query tunes its session
        per_key = spark.range(2_500_000).selectExpr("xxhash64(id) as k", "uuid() as u").groupBy("k").agg(F.max("u").alias("u"))
        assert per_key.rdd.getNumPartitions() > 4
        assert int(spark.conf.get(keys[1])) >= 400
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
