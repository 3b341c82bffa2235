from __future__ import annotations

from datetime import date, datetime

import pytest
from helpers import MONEY, frame, rows

from pyspark.sql import functions as F
from tradewind.plans import metrics as mt
from tradewind.plans import preaggregate as pre

ORDERS = (
    f"id bigint, order_number string, customer_id bigint, status string, channel string, device_type string, utm_source string,"
    f" grand_total {MONEY}, discount_total {MONEY}, placed_at timestamp_ntz, delivered_at timestamp_ntz"
)
QUESTIONS = [
    dict(measures=["Orders.count", "Orders.revenue", "Orders.aov", "Orders.discount"]),
    dict(measures=["Orders.revenue", "Orders.aov"], dimensions=["Orders.channel"]),
    dict(measures=["Orders.count"], dimensions=["Orders.channel", "Orders.device_type"], time_dimension="Orders.placed_at", granularity="week"),
    dict(measures=["Orders.aov"], time_dimension="Orders.placed_at", granularity="month", dates=(date(2024, 1, 31), date(2024, 2, 1))),
    dict(measures=["Orders.count"], time_dimension="Orders.placed_at", dates=(date(2030, 1, 1), date(2030, 1, 2))),
    dict(measures=["Orders.revenue"], dimensions=["Orders.device_type"], order=[("Orders.revenue", "desc")], limit=1),
]


def orders(spark):
    data = []
    for i in range(120):
        day = f"2024-{1 + i % 3:02d}-{1 + i * 7 % 28:02d} {i % 24:02d}:30:00"
        total = None if i % 17 == 0 else f"{i}.{i % 100:02d}"
        data.append((i, f"n{i}", i % 11, "cancelled" if i % 5 == 0 else "paid", ["a", "b", None][i % 3], ["m", "d"][i % 2], None,
                     total, "0.50", None if i % 29 == 0 else day, None))
    return frame(spark, ORDERS, data)


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pre") / "stored")
    pre.refresh(orders(spark), path, date(2000, 1, 1))
    nothing = lambda: spark.range(0)
    tables = {n: nothing for n in ("order_items", "products", "categories", "customers", "carts")}
    return mt.shop_model(tables | {"orders": lambda: orders(spark)}, datetime(2024, 4, 1)), pre.read(spark, path), path


@pytest.mark.parametrize("question", QUESTIONS)
def test_same_rows_either_way_and_only_stored_rows_are_read(shop, question):
    model, stored, path = shop
    told = pre.answer(model, stored, **question)
    asked = mt.metric_query(model, **question)
    assert told.columns == asked.columns and rows(told) == rows(asked)
    assert told.inputFiles() and all(path in f for f in told.inputFiles())
    assert "LocalTableScan" not in told._jdf.queryExecution().executedPlan().toString()


def test_periods_open_their_months_only(shop):
    model, stored, _ = shop
    told = pre.answer(model, stored, ["Orders.count"], [], "Orders.placed_at", "day", (date(2024, 2, 3), date(2024, 2, 9)))
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


@pytest.mark.parametrize(
    ("why", "question"),
    [
        ("added up", dict(measures=["Orders.unique_customers"])),
        ("added up", dict(measures=["Orders.count", "Orders.median_total"])),
        ("not kept", dict(measures=["Orders.count"], dimensions=["Orders.status"])),
        ("another table", dict(measures=["Orders.count", "Carts.count"])),
        ("another table", dict(measures=["Orders.count"], dimensions=["Customers.signup_channel"])),
        ("finer", dict(measures=["Orders.count"], time_dimension="Orders.placed_at", granularity="hour")),
        ("not kept", dict(measures=["Orders.count"], time_dimension="Orders.delivered_at", granularity="day")),
        ("another table", dict(measures=["Orders.count"], segments=["Customers.opted_in_to_marketing"])),
    ],
)
def test_other_questions_are_refused(why, question):
    assert why in pre.uncovered(**question)


def test_uncovered_questions_go_to_the_orders(shop):
    model, stored, path = shop
    told = pre.answer(model, stored, ["Orders.count", "Orders.unique_customers"], ["Orders.status"])
    assert rows(told) == rows(mt.metric_query(model, ["Orders.count", "Orders.unique_customers"], ["Orders.status"]))
    assert not any(path in f for f in told.inputFiles())


def test_sketches_are_merged_upwards(shop):
    model, stored, _ = shop
    told = pre.answer(model, stored, ["Orders.unique_customers", "Orders.median_total"], approximate=True).first()
    live = orders(model["Orders"].frame.sparkSession).filter("status <> 'cancelled'")
    exact = live.agg(F.countDistinct("customer_id").alias("u"), F.expr("percentile(grand_total, 0.5)").alias("m")).first()
    assert told.unique_customers == exact.u and abs(told.median_total - float(exact.m)) < 3


def test_refresh_replaces_months_from_a_date_on(spark, tmp_path):
    path = str(tmp_path / "stored")
    pre.refresh(orders(spark), path, date(2000, 1, 1))
    count = lambda: dict(rows(pre.read(spark, path).groupBy(F.month("day").alias("m")).agg(F.sum("orders")), "m"))
    before = count()
    gone = orders(spark).withColumn("status", F.when(F.month("placed_at") >= 2, "cancelled").otherwise("paid"))
    pre.refresh(gone, path, date(2024, 3, 15))
    after = count()
    assert after[1] == before[1] and after[2] == before[2] and 3 not in after
    assert after[None] == rows(gone.filter("placed_at is null").agg(F.count("*")))[0][0]
