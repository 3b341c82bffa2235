from __future__ import annotations

import random
import shutil

from helpers import frame, rows

from tradewind.streaming.keyed_sink import KeyedSink

KIND = "k bigint, w string, v bigint"


def parts(path, kind):
    return sorted(p.name for p in (path / kind).glob("*=*")) if (path / kind).exists() else []


def table(sink, spark):
    return {(r.k, r.w): r.v for r in sink.read(frame(spark, KIND, []).schema).collect()}


def test_last_row_of_each_key_over_many_batches(spark, tmp_path):
    r, want = random.Random(1), {}
    sink = KeyedSink(spark, str(tmp_path / "t"), ["k", "w"])
    for batch_id in range(12):
        data = {(r.choice([None, *range(20)]), r.choice(["a", None])): r.randrange(1000) for _ in range(r.choice([1, 4, 25]))}
        want |= data
        sink.write(frame(spark, KIND, [(*k, v) for k, v in data.items()]), batch_id)
        got = sink.read(frame(spark, KIND, []).schema)
        assert got.count() == len(want) and {(x.k, x.w): x.v for x in got.collect()} == want
    assert len(parts(tmp_path / "t", "base")) <= 2


def test_small_batches_write_their_own_rows_only(spark, tmp_path):
    """A batch of a few keys leaves the base alone until the updates have grown to their share of it."""
    sink = KeyedSink(spark, str(tmp_path / "t"), ["k"])
    sink.write(spark.range(200_000).selectExpr("id as k", "'x' as w", "id as v"), 0)
    assert parts(tmp_path / "t", "base") == ["upto=0"]
    for batch_id in range(1, 6):
        sink.write(frame(spark, KIND, [(batch_id, "y", -batch_id), (10**6 + batch_id, "y", 0)]), batch_id)
        assert spark.read.parquet(str(tmp_path / "t" / "updates" / f"_batch={batch_id}")).count() == 2
    assert parts(tmp_path / "t", "base") == ["upto=0"]
    got = sink.read(frame(spark, KIND, []).schema)
    assert got.count() == 200_005 and got.filter("w = 'y'").count() == 10
    sink.write(spark.range(100_000).selectExpr("id as k", "'z' as w", "-id as v"), 6)
    assert parts(tmp_path / "t", "base") == ["upto=0", "upto=6"]
    got = sink.read(frame(spark, KIND, []).schema)
    assert got.count() == 200_005 and got.filter("w = 'z'").count() == 100_000
    sink.write(spark.range(100_000).selectExpr("id as k", "'q' as w", "id as v"), 7)
    assert parts(tmp_path / "t", "base") == ["upto=6", "upto=7"]  # what the fold before replaced is gone
    assert "_batch=1" not in parts(tmp_path / "t", "updates")


def test_batches_that_run_again_change_nothing(spark, tmp_path):
    sink = KeyedSink(spark, str(tmp_path / "t"), ["k"], fold_share=100.0)
    first, second = frame(spark, KIND, [(1, "a", 1), (2, "a", 2)]), frame(spark, KIND, [(2, "a", 3)])
    sink.write(first, 0)
    sink.write(second, 1)
    sink.write(second, 1)
    assert table(sink, spark) == {(1, "a"): 1, (2, "a"): 3}
    sink.fold(first.schema)
    sink.write(first, 0)  # folded already
    sink.write(second, 1)
    assert table(sink, spark) == {(1, "a"): 1, (2, "a"): 3}


def test_unfinished_folds_and_batches_do_not_count(spark, tmp_path):
    path = tmp_path / "t"
    sink = KeyedSink(spark, str(path), ["k"], fold_share=100.0)
    sink.write(frame(spark, KIND, [(1, "a", 1), (2, "a", 2)]), 0)
    sink.write(frame(spark, KIND, [(1, "a", 5)]), 1)
    for folder in ("base/upto=1", "updates/_batch=2"):
        shutil.copytree(path / "updates" / "_batch=0", path / folder)
        (path / folder / "_SUCCESS").unlink()
    assert table(sink, spark) == {(1, "a"): 5, (2, "a"): 2}
    sink.fold(frame(spark, KIND, []).schema)
    assert table(sink, spark) == {(1, "a"): 5, (2, "a"): 2}


def test_empty_batches_and_an_empty_table(spark, tmp_path):
    sink = KeyedSink(spark, str(tmp_path / "t"), ["k"])
    empty = frame(spark, KIND, [])
    assert rows(sink.read(empty.schema)) == []
    sink.write(empty, 0)
    assert rows(sink.read(empty.schema)) == []
    sink.write(frame(spark, KIND, [(1, "a", 1)]), 1)
    sink.write(empty, 2)
    assert rows(sink.read(empty.schema)) == [(1, "a", 1)]
