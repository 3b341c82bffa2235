from __future__ import annotations

import os
from datetime import date, timedelta

import pytest

from tradewind.session import run_path
from tradewind.sources import line_store
from tradewind.sources.driver import Shop

SF = "/root/testdata/sf0.001"
LINES = "order_id long, n int"
ORDERS = "id long, at timestamp_ntz"


def frames(spark):
    orders = spark.sql(
        """select cast(id as bigint) as id, cast(at as timestamp_ntz) as at from values
           (1, '2001-01-31 23:59:59'), (2, '2001-02-01 00:00:00'), (3, '2001-03-15 12:00:00'),
           (4, null), (5, '2001-02-02 00:00:00'), (5, '2001-03-02 00:00:00'), (null, '2001-02-01 00:00:00') as t(id, at)"""
    )
    lines = spark.createDataFrame([(k, n) for k in (1, 2, 3, 4, 5, 6, None) for n in range(3)], LINES)
    return lines, orders


@pytest.mark.parametrize(
    ("grain", "first", "last", "dated"),
    [
        ("DAY", date(2001, 2, 1), date(2001, 2, 1), {2}),
        ("DAY", date(2001, 1, 31), date(2001, 3, 14), {1, 2}),
        ("MONTH", date(2001, 2, 20), date(2001, 3, 1), {2, 3}),
        ("YEAR", date(2001, 12, 1), date(2002, 1, 1), {1, 2, 3}),
        ("DAY", date(2005, 1, 1), date(2005, 1, 2), set()),
    ],
)
def test_windows_see_their_lines(spark, grain, first, last, dated):
    """Lines of unknown or several dates are seen by every window; every line is stored once."""
    lines, orders = frames(spark)
    path = run_path(spark, "test-lines")
    line_store.build(lines, orders, "order_id", "id", "at", path, grain)
    assert spark.read.parquet(path).count() == lines.count()
    seen = line_store.read(spark, path, LINES, first, last, grain)
    assert seen.columns == lines.columns
    assert sorted(map(tuple, seen.collect()), key=repr) == sorted(((k, n) for k in dated | {4, 5, 6, None} for n in range(3)), key=repr)


def test_empty_tables(spark):
    lines, orders = frames(spark)
    for a, b in ((lines.limit(0), orders), (lines, orders.limit(0))):
        path = run_path(spark, "test-lines-empty")
        line_store.build(a, b, "order_id", "id", "at", path, "DAY")
        assert line_store.read(spark, path, LINES, date(2001, 1, 1), date(2001, 1, 2), "DAY").count() == a.count()


def test_grain_follows_the_size():
    days = 7 * 365
    assert line_store.choose_grain(10 << 40, days) == "DAY"
    assert line_store.choose_grain(6 << 30, days) == "MONTH"
    assert line_store.choose_grain(1 << 20, days) == "MONTH"  # few months in all
    assert line_store.choose_grain(1 << 20, 100 * 365) == "YEAR"
    assert line_store.choose_grain(0, 1) == "DAY"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")
def test_store_is_built_once_and_again_after_a_change(spark, tmp_path):
    for name in ("lineitem", "orders"):
        Shop(spark, SF).table(name).limit(200).write.parquet(f"{tmp_path}/{name}.parquet")
    shop = Shop(spark, str(tmp_path))
    path = shop.line_store()[0]
    assert Shop(spark, f"{tmp_path}/").line_store()[0] == path
    Shop(spark, SF).table("lineitem").limit(10).write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    again = shop.line_store()[0]
    assert again != path and spark.read.parquet(again).count() == 210


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")
def test_windowed_lines_are_all_lines_of_the_window(spark):
    first, last = date(2001, 6, 1), date(2001, 7, 1)
    shop = Shop(spark, SF)
    raw = shop.table("orders").filter(f"o_orderdate >= '{first}' AND o_orderdate < '{last + timedelta(days=1)}'")
    lines = shop.order_items()
    want = lines.join(raw, raw.o_orderkey == lines.order_id, "left_semi")
    windowed = shop.dated(first, last).order_items()
    got = windowed.join(raw, raw.o_orderkey == windowed.order_id, "left_semi")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert 0 < windowed.count() < lines.count() / 10


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")
def test_store_holds_what_entities_read(spark):
    """Columns that no entity reads would be shuffled twice and written for nothing."""
    shop = Shop(spark, SF)
    stored = spark.read.parquet(shop.line_store()[0])
    kept = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    assert stored.columns == [*kept, "dt"] and shop.dated(date(2001, 6, 1), date(2001, 7, 1)).table("lineitem").columns == kept
    assert stored.count() == shop.table("lineitem").count()


def test_dates_of_orders_are_not_broadcast_to_lines(spark):
    lines = spark.range(9).selectExpr("id as order_id", "cast(id as int) as n")
    orders = spark.range(5).selectExpr("id", "timestamp_ntz'2001-02-01 00:00:00' as at")
    plan = line_store.with_dates(lines, orders, "order_id", "id", "at", "DAY")
    assert "BroadcastHashJoin" not in plan._jdf.queryExecution().executedPlan().toString()
    assert plan.filter("dt is null").count() == 4
