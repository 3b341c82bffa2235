from __future__ import annotations

from datetime import date, datetime

import pytest
from helpers import MONEY, frame, rows

from pyspark.sql import Observation
from pyspark.sql import functions as F
from tradewind.operators import etl
from tradewind.operators.key_index import BLOCK, KeyIndex
from tradewind.schemas import ENTITIES
from tradewind.session import shared_dir
from tradewind.sources.tables import read_entity, read_jsonl, write_entity, write_jsonl

RAW = f"id bigint, status string, grand_total {MONEY}, placed_at timestamp, _ingested_at timestamp"


def raw(spark, data):
    return frame(spark, RAW, data)


def test_dedupe_keeps_newest_and_settles_ties(spark):
    df = raw(spark, [
        (1, "pending", "1.00", "2024-01-01", "2024-01-01 01:00:00"),
        (1, "paid", "1.00", "2024-01-01", "2024-01-01 02:00:00"),
        (2, "a", "1.00", "2024-01-01", "2024-01-01 01:00:00"),
        (2, "b", "1.00", "2024-01-01", "2024-01-01 01:00:00"),
        (3, "x", "1.00", "2024-01-01", None),
    ])
    first = rows(etl.dedupe_latest(df, ["id"]).select("id", "status"), "id")
    again = rows(etl.dedupe_latest(df.orderBy(F.desc("status")), ["id"]).select("id", "status"), "id")
    assert first == again
    assert first[0] == (1, "paid") and len(first) == 3


def test_load_twice_gives_the_same_table(spark, tmp_path):
    path = str(tmp_path / "orders")
    first = raw(spark, [
        (1, "pending", "1.00", "2024-01-01 10:00:00", "2024-01-01 11:00:00"),
        (2, "pending", "2.00", "2024-01-01 12:00:00", "2024-01-01 13:00:00"),
        (3, "paid", "3.00", "2024-01-02 09:00:00", "2024-01-02 10:00:00"),
    ]).withColumn("channel", F.lit("email"))
    second = raw(spark, [
        (2, "paid", "2.00", "2024-01-01 12:00:00", "2024-01-01 14:00:00"),
        (4, "paid", "4.00", "2024-01-03 09:00:00", "2024-01-03 10:00:00"),
    ]).withColumn("channel", F.lit("email"))
    want = [(1, "pending", "2024-01-01"), (2, "paid", "2024-01-01"), (3, "paid", "2024-01-02"), (4, "paid", "2024-01-03")]
    for pull in (first, second, second, first, second):
        etl.load_fact(pull, "orders", path, "placed_at")
    got = spark.read.parquet(path).select("id", "status", F.col("dt").cast("string"))
    assert rows(got, "id") == want


def test_full_refresh_replaces(spark, tmp_path):
    path = str(tmp_path / "dim")
    etl.full_refresh(frame(spark, "id bigint", [(1,), (2,)]), path)
    assert rows(etl.full_refresh(frame(spark, "id bigint", [(3,)]), path)) == [(3,)]


def test_layout_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "orders")
    df = raw(spark, [(i, "paid", "1.00", f"2024-01-{i:02d}", None) for i in range(1, 11)]).withColumn("channel", F.lit("x"))
    write_entity(df, "orders", path)
    one = spark.read.parquet(path).filter("dt = date'2024-01-05'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan
    assert rows(one.select("id")) == [(5,)]


def test_jsonl_keeps_types(spark, tmp_path):
    df = frame(spark, f"id bigint, m {MONEY}, t timestamp, d date, b boolean, s string",
               [(1, "12.30", "2024-01-01 10:00:00.123456", "2024-01-01", True, 'quote " and \\'), (2, None, None, None, None, None)])
    write_jsonl(df, str(tmp_path / "j"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "j")).collect())
    assert '"m":"12.30"' in text and "2024-01-01T10:00:00.123456" in text
    assert rows(read_jsonl(spark, str(tmp_path / "j"), df.schema)) == rows(df)


def test_readers_use_the_declared_schema(spark, tmp_path):
    path = str(tmp_path / "c")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.csv").write_text("id,slug,name,parent_id\n1,shoes,Shoes,\n")
    got = read_entity(spark, "categories", path, fmt="csv")
    assert got.schema == ENTITIES["categories"]
    assert rows(got) == [(1, "shoes", "Shoes", None)]


def test_bootstrap_counts_and_skips_empty(spark, tmp_path):
    tables = {"a": frame(spark, "id bigint", [(1,), (2,)]), "b": frame(spark, "id bigint", [])}
    assert etl.bootstrap(tables, str(tmp_path), datetime(2024, 1, 1)) == {"a": 2, "b": 0}
    assert not (tmp_path / "b").exists()
    assert "_ingested_at" in spark.read.parquet(str(tmp_path / "a")).columns


def test_reconcile_sees_both_sides(spark):
    s = frame(spark, "t timestamp", [("2024-01-01",), ("2024-01-01",), ("2024-01-02",)])
    t = frame(spark, "t timestamp", [("2024-01-01",), ("2024-01-03",)])
    assert rows(etl.reconcile(s, t, "t"), "date") == [
        (date(2024, 1, 1), 2, 1, 1, True), (date(2024, 1, 2), 1, 0, 1, True), (date(2024, 1, 3), 0, 1, -1, True)]


def test_incremental_window_is_closed(spark):
    df = frame(spark, "id bigint, placed_at timestamp_ntz", [(1, "2024-01-01 10:00:00"), (2, "2024-01-01 09:59:59")])
    at = datetime(2024, 1, 1, 12)
    assert rows(etl.incremental_window(df, "placed_at", at).select("id")) == [(1,)]
    lines = frame(spark, "order_id bigint, quantity bigint", [(1, 5), (1, 6), (2, 7)])
    assert rows(etl.incremental_items(lines, df, at)) == [(1, 5), (1, 6)]


SNAPSHOTS = [
    ("2024-01-01", 1, "10"), ("2024-01-01", 2, "20"), ("2024-01-01", 3, None),
    ("2024-01-02", 1, "10"), ("2024-01-02", 2, "25"), ("2024-01-02", 3, None),
    ("2024-01-03", 1, "10"), ("2024-01-03", 3, "1"),
    ("2024-01-04", 1, "10"), ("2024-01-04", 2, "25"), ("2024-01-04", 3, "1"),
]


def test_scd2_changes_deletes_and_returns(spark):
    snaps = frame(spark, "snapshot_date date, id bigint, price bigint", SNAPSHOTS)
    got = rows(etl.scd2(snaps, "id", ["price"], complete=True), "id", "valid_from")
    d = lambda n: date(2024, 1, n)
    assert got == [
        (1, 10, d(1), None),
        (2, 20, d(1), d(2)), (2, 25, d(2), d(3)), (2, 25, d(4), None),
        (3, None, d(1), d(3)), (3, 1, d(3), None),
    ]
    open_ended = rows(etl.scd2(snaps, "id", ["price"]), "id", "valid_from")
    assert open_ended[1:3] == [(2, 20, d(1), d(2)), (2, 25, d(2), None)]
    history = etl.scd2(snaps, "id", ["price"], complete=True)
    assert rows(etl.as_of(history, d(3)).select("id", "price"), "id") == [(1, 10), (3, 1)]
    asked = frame(spark, "id bigint, day date", [(2, "2024-01-01"), (2, "2024-01-02"), (2, "2024-01-03"), (2, "2024-01-09"),
                                                 (1, "2023-12-31"), (9, "2024-01-01")])
    assert rows(etl.version_on(asked, history, "id", "day", ["price"]), "id", "day") == [
        (1, date(2023, 12, 31), None), (2, d(1), 20), (2, d(2), 25), (2, d(3), None), (2, d(9), 25), (9, d(1), None)]


def test_shared_folder_comes_from_the_session(spark):
    if spark.conf.get("spark.checkpoint.dir", None):
        pytest.skip("the session names one")
    assert shared_dir(spark).endswith("tradewind-shared")


def test_small_result_files(spark, tmp_path):
    f = frame(spark, "category_name string, forecast_date date, yhat double",
              [("a", "2024-01-02", 2), ("a", "2024-01-01", 1), ("b", "2024-01-01", 3)])
    etl.write_forecast_json(f.filter("category_name = 'a'"), str(tmp_path / "j"))
    assert [r.value for r in spark.read.text(str(tmp_path / "j")).collect()] == [
        '{"category_name":"a","forecast_date":"2024-01-01","yhat":1.0}',
        '{"category_name":"a","forecast_date":"2024-01-02","yhat":2.0}']
    etl.write_category_csv(f, str(tmp_path / "c"))
    assert sorted(p.name for p in (tmp_path / "c").glob("category_name=*")) == ["category_name=a", "category_name=b"]
    etl.write_metrics_json(frame(spark, "category_name string, mape double", [("a", 0.1)]), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().mape == 0.1


def test_load_refuses_a_table_that_lost_a_column(spark, tmp_path):
    path = str(tmp_path / "orders")
    first = raw(spark, [(1, "paid", "1.00", "2024-01-01", "2024-01-01")]).withColumn("channel", F.lit("x"))
    etl.load_fact(first, "orders", path, "placed_at")
    with pytest.raises(Exception, match="extra"):
        etl.load_fact(first.withColumn("extra", F.lit(1)), "orders", path, "placed_at")
    assert spark.read.parquet(path).count() == 1


def test_load_keeps_rows_without_a_time_and_follows_moved_ones(spark, tmp_path):
    path = str(tmp_path / "orders")

    def load(*data):
        etl.load_fact(raw(spark, list(data)).withColumn("channel", F.lit("x")), "orders", path, "placed_at")
        return rows(spark.read.parquet(path).select("id", "status", F.col("dt").cast("string")), "id")

    first = (1, "a", "1.00", None, "2024-01-01 10:00:00"), (5, "a", "1.00", "2024-01-01", "2024-01-01 10:00:00")
    assert load(*first) == [(1, "a", None), (5, "a", "2024-01-01")]
    second = (2, "b", "1.00", None, "2024-01-01 11:00:00"), (3, "b", "1.00", None, "2024-01-01 11:00:00")
    both = [(1, "a", None), (2, "b", None), (3, "b", None), (5, "a", "2024-01-01")]
    assert load(*second) == both and load(*second) == both
    # Order 5 moves to another date and leaves none behind; 1 gets a time; 3 loses nothing.
    third = (5, "c", "1.00", "2024-01-05", "2024-01-02 10:00:00"), (1, "c", "1.00", "2024-01-05 09:00:00", "2024-01-02 10:00:00")
    moved = [(1, "c", "2024-01-05"), (2, "b", None), (3, "b", None), (5, "c", "2024-01-05")]
    assert load(*third) == moved and load(*third) == moved
    # An older version does not win, wherever it would go.
    assert load(*first) == moved
    # Back to no time, and the last row of the unknown date leaves it.
    assert load((5, "d", "1.00", None, "2024-01-03")) == [(1, "c", "2024-01-05"), (2, "b", None), (3, "b", None), (5, "d", None)]
    got = load(*((i, "e", "1.00", "2024-01-06", "2024-01-04") for i in (2, 3, 5)))
    assert got == [(1, "c", "2024-01-05"), (2, "e", "2024-01-06"), (3, "e", "2024-01-06"), (5, "e", "2024-01-06")]


def test_months_as_partitions(spark, tmp_path):
    path = str(tmp_path / "orders")
    for pull in ([(1, "a", "1.00", "2024-01-31", "2024-02-01")], [(1, "b", "1.00", "2024-02-02", "2024-02-03"), (2, "b", "1.00", "2024-02-01", "2024-02-03")]):
        etl.load_fact(raw(spark, pull).withColumn("channel", F.lit("x")), "orders", path, "placed_at", grain="MONTH")
    assert rows(spark.read.parquet(path).select("id", F.col("dt").cast("string")), "id") == [(1, "2024-02-01"), (2, "2024-02-01")]


def test_reconcile_counts_rows_without_a_date(spark):
    s = frame(spark, "t timestamp", [(None,), (None,), ("2024-01-02",)])
    t = frame(spark, "t timestamp", [(None,), ("2024-01-02",)])
    assert rows(etl.reconcile(s, t, "t"), "date") == [(None, 2, 1, 1, True), (date(2024, 1, 2), 1, 1, 0, False)]


def test_small_pull_reads_only_partitions_that_hold_its_keys(spark, tmp_path):
    """1,000 keys on 50 dates; a pull of three keys, one moved, opens the dates of these keys and no others."""
    path = str(tmp_path / "orders")
    big = raw(spark, [(i, "a", "1.00", f"2024-{1 + i % 50 // 25:02d}-{1 + i % 25:02d}", "2024-03-01") for i in range(1000)])
    etl.load_fact(big.withColumn("channel", F.lit("x")), "orders", path, "placed_at")
    pull = raw(spark, [(3, "b", "2.00", "2024-01-04", "2024-03-02"), (53, "b", "2.00", "2024-01-04", "2024-03-02"), (7, "b", "2.00", "2024-02-20", "2024-03-02")])
    seen = Observation()
    days = etl.load_fact(pull.withColumn("channel", F.lit("x")), "orders", path, "placed_at", reads=seen)
    assert seen.get["rows_read"] == 3 * 20  # the dates 01-04, 01-08 (which 7 leaves) and 02-20
    assert sorted(r[0].isoformat() for r in days.collect()) == ["2024-01-04", "2024-01-08", "2024-02-20"]
    stored = spark.read.parquet(path)
    assert stored.count() == 1000 and stored.filter("status = 'b'").count() == 3
    again = Observation()
    etl.load_fact(pull.withColumn("channel", F.lit("x")), "orders", path, "placed_at", reads=again)
    assert again.get["rows_read"] == 60  # 7 may still be looked for under its old date
    assert spark.read.parquet(path).count() == 1000


def test_index_opens_only_buckets_of_its_keys(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "t"), ["id"])
    kind = "id bigint, dt date"
    index.add(frame(spark, kind, [(i * BLOCK, "2024-01-01") for i in range(40)]))
    near = index.near(frame(spark, kind, [(5 * BLOCK, "2024-01-02"), (5 * BLOCK + 9, "2024-01-02"), (10**15, "2024-01-02")]))
    assert len({f.parent.name for f in (tmp_path / "t-keys").rglob("*.parquet")}) > 30  # blocks lie in buckets of their own
    assert "PartitionFilters: [bucket#" in near._jdf.queryExecution().executedPlan().toString()
    assert rows(near.select("id")) == [(5 * BLOCK,)]


def test_index_of_text_and_composite_keys_with_nulls(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "t"), ["code", "n"])
    kind = "code string, n bigint, dt date"
    data = [("a", 1, "2024-01-01"), ("a", None, "2024-01-02"), (None, 1, None), ("a", 1, "2024-01-05")]
    index.add(frame(spark, kind, data))
    files = len(list((tmp_path / "t-keys").rglob("*.parquet")))
    index.add(frame(spark, kind, data))
    assert len(list((tmp_path / "t-keys").rglob("*.parquet"))) == files  # nothing new, nothing written
    near = index.near(frame(spark, kind, [("a", None, None), (None, 1, None), ("b", 1, None)]))
    assert rows(near.select("code", "n", F.col("dt").cast("string"))) == [("a", None, "2024-01-02"), (None, 1, None)]
    index.rebuild(frame(spark, kind, data[:1]))
    assert rows(index.near(frame(spark, kind, data)).select("code")) == [("a",)]


def test_load_builds_the_index_of_a_table_without_one(spark, tmp_path):
    path = str(tmp_path / "orders")
    first = raw(spark, [(i, "a", "1.00", f"2024-01-0{i}", "2024-03-01") for i in range(1, 6)]).withColumn("channel", F.lit("x"))
    write_entity(first, "orders", path)
    etl.load_fact(raw(spark, [(2, "b", "1.00", "2024-01-05", "2024-03-02")]).withColumn("channel", F.lit("x")), "orders", path, "placed_at")
    got = rows(spark.read.parquet(path).select("id", "status", F.col("dt").cast("string")), "id")
    assert got == [(1, "a", "2024-01-01"), (2, "b", "2024-01-05"), (3, "a", "2024-01-03"), (4, "a", "2024-01-04"), (5, "a", "2024-01-05")]
