from __future__ import annotations

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from helpers import frame, rows

from pyspark.sql import functions as F
from tradewind.operators import churn
from tradewind.operators import forecast as fc

START = date(2023, 1, 2)


def series(spark, name_lengths, value=lambda name, i, d: 100 + i + 10 * (d.weekday() == 5)):
    data = []
    for name, n in name_lengths.items():
        for i in range(n):
            d = START + timedelta(days=i)
            data.append((name, str(d), f"{value(name, i, d):.2f}"))
    return frame(spark, "category_name string, date date, revenue decimal(18|2)", data)


def test_short_series_are_skipped_and_fall_back(spark):
    s = series(spark, {"s59": 59, "s60": 60, "s364": 364, "s365": 365})
    fitted = {r.category_name: r.n for r in fc.forecast_fit(s).groupBy("category_name").agg(F.count("*").alias("n")).collect()}
    assert fitted == {"s60": 30, "s364": 30, "s365": 30}
    cold = fc.cold_start(s).orderBy("forecast_date").collect()
    assert [r.category_name for r in cold] == ["s59"] * 30
    assert cold[0].forecast_date == START + timedelta(days=59)
    plain = float(np.std([100 + i + 10 * ((START + timedelta(days=i)).weekday() == 5) for i in range(59)]))
    assert cold[0].yhat_upper - cold[0].yhat == pytest.approx(2 * fc.Z80 * plain)
    assert fc.forecast_all(s).select("category_name").distinct().count() == 4


def direct(days, y, ask, yearly=None):
    """The same model fitted from the rows themselves, with numpy."""
    yearly = len(y) >= 365 if yearly is None else yearly

    def design(day):
        columns = [np.ones((len(day), 1)), ((day - days[0]) / 400)[:, None], np.eye(7)[day % 7][:, 1:]]
        angle = 2 * np.pi * np.outer(day, np.arange(1, fc.YEARLY_TERMS + 1)) / 365.25
        return np.hstack([*columns, np.sin(angle), np.cos(angle)] if yearly else columns)

    x = design(days)
    penalty = np.full(x.shape[1], fc.RIDGE)
    penalty[:2] = 0
    beta = np.linalg.solve(x.T @ x + np.diag(penalty), x.T @ y)
    return design(ask) @ beta, float(np.std(y - x @ beta))


def noisy(n, seed, gaps=False):
    rng = np.random.default_rng(seed)
    days = (START - date(1970, 1, 1)).days + np.arange(n)
    y = (1e6 + 900.0 * np.arange(n) + 5e4 * np.sin(days / 50) + 1e5 * (days % 7 == 2) + rng.normal(0, 3e4, n)).round(2)
    kept = np.sort(rng.choice(n, n * 4 // 5, replace=False)) if gaps else np.arange(n)
    return days[kept], y[kept]


def as_series(spark, data):
    rows_ = [(k, str(date(1970, 1, 1) + timedelta(days=int(d))), f"{v:.2f}") for k, (days, y) in data.items() for d, v in zip(days, y, strict=True)]
    return frame(spark, "category_name string, date date, revenue decimal(18|2)", rows_)


def test_fit_from_sums_equals_a_direct_fit(spark):
    """Also where yearly waves switch on at 365 rows, and for series with days missing."""
    data = {"s60": noisy(60, 1), "s364": noisy(364, 2), "s365": noisy(365, 3), "gaps": noisy(540, 4, gaps=True)}
    got = {(r.category_name, r.forecast_date): r for r in fc.forecast_fit(as_series(spark, data)).collect()}
    assert len(got) == 4 * 30
    for name, (days, y) in data.items():
        ask = days[-1] + 1 + np.arange(30)
        want, spread = direct(days, y, ask)
        for d, yhat in zip(ask, want, strict=True):
            r = got[name, date(1970, 1, 1) + timedelta(days=int(d))]
            assert r.yhat == pytest.approx(yhat, rel=1e-9) and r.yhat_upper - r.yhat == pytest.approx(fc.Z80 * spread, rel=1e-6)


def test_walk_forward_from_sums_equals_direct_fits(spark):
    data = {"long": noisy(500, 5), "gaps": noisy(450, 6, gaps=True), "mid": noisy(130, 7)}
    s = as_series(spark, data)
    want, total = {}, {}
    for name, (days, y) in data.items():
        for split in range(1, 5):
            cut = len(y) - 30 * split
            asked, real = days[cut : cut + 30], y[cut : cut + 30]
            if cut >= 60:
                reach = asked <= days[cut - 1] + 30
                yhat, spread = direct(days[:cut], y[:cut], asked[reach])
                inside = np.abs(real[reach] - yhat) <= fc.Z80 * spread
                want[name, split] = (cut, 30, float(np.mean(np.abs(real[reach] - yhat) / real[reach])), float(np.mean(inside)))
            if split <= 3 and len(y) >= 120:
                yhat, spread = direct(days[:cut], y[:cut], asked, yearly=True)
                total.setdefault(name, []).append(float(np.mean(np.abs(real - yhat) / real)))
    got = {(r.category_name, r.split): (r.n_train, r.n_test, r.mape, r.coverage_80) for r in fc.walk_forward(s).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-6), k
    summary = {r.category_name: r.mape_mean for r in fc.walk_forward_summary(s).collect()}
    assert summary == pytest.approx({k: float(np.mean(v)) for k, v in total.items()}, rel=1e-5)


def test_fit_follows_trend_and_weekday(spark):
    s = series(spark, {"a": 200})
    got = {r.forecast_date: r.yhat for r in fc.forecast_fit(s, horizon=14).collect()}
    for d, yhat in got.items():
        i = (d - START).days
        assert yhat == pytest.approx(100 + i + 10 * (d.weekday() == 5), abs=3)


def test_baseline_is_exact_on_a_line(spark):
    s = series(spark, {"a": 140}, value=lambda n, i, d: 50 + 2 * i)
    for r in fc.forecast_baseline(s).collect():
        assert r.yhat == pytest.approx(50 + 2 * (r.forecast_date - START).days, abs=0.02)
        assert r.yhat_upper - r.yhat_lower == pytest.approx(0, abs=0.02)


def test_baseline_against_numpy(spark):
    rng = np.random.default_rng(1)
    noise = rng.normal(0, 20, 200).round(2)
    s = series(spark, {"a": 200}, value=lambda n, i, d: 500 + 3 * i + noise[i])
    t = np.arange(200)
    y = np.round(500 + 3 * t + noise, 2)
    slope, intercept = np.polyfit(t, y, 1)
    weekday = np.array([(START + timedelta(days=int(i))).weekday() for i in t])
    level = {w: (y - intercept - slope * t)[weekday == w].mean() for w in range(7)}
    for r in fc.forecast_baseline(s).collect():
        i = (r.forecast_date - START).days
        assert r.yhat == pytest.approx(intercept + slope * i + level[r.forecast_date.weekday()], abs=0.01)


def test_walk_forward_rules(spark):
    s = series(spark, {"long": 200, "mid": 100, "short": 80}, value=lambda n, i, d: 0 if i % 10 == 0 else 100 + i)
    got = fc.walk_forward(s).collect()
    assert sorted((r.category_name, r.split, r.n_train, r.n_test) for r in got) == [
        ("long", 1, 170, 30), ("long", 2, 140, 30), ("long", 3, 110, 30), ("long", 4, 80, 30), ("mid", 1, 70, 30)]
    assert all(np.isfinite(r.mape) for r in got)  # zero days are left out, not divided by
    assert {r.split_end for r in got if r.split == 1 and r.category_name == "long"} == {START + timedelta(days=199)}
    summary = {r.category_name: r for r in fc.walk_forward_summary(s).collect()}
    assert summary["short"].mape_mean is None and summary["short"].n_splits is None  # 80 < 30 × 4
    assert summary["long"].n_splits == 3
    base = {(r.category_name, r.split): r.n_test for r in fc.walk_forward_baseline(s).collect()}
    assert base == {("long", k): 30 for k in (1, 2, 3, 4)} | {("mid", 1): 30}


def test_errors_skip_zero_days(spark):
    actual = frame(spark, "k string, date date, revenue decimal(18|2)", [("a", "2024-01-01", "0"), ("a", "2024-01-02", "100")])
    f = frame(spark, "k string, forecast_date date, yhat double, yhat_lower double, yhat_upper double",
              [("a", "2024-01-01", 5, -1, 6), ("a", "2024-01-02", 80, 70, 90)])
    assert rows(fc.forecast_errors(actual, f, ["k"])) == [("a", 2, 0.2, 0.5)]


def test_history_and_total(spark):
    lines = frame(spark, "product_id bigint, order_date date, placed_at timestamp_ntz, revenue_cents bigint",
                  [(1, "2024-01-02", "2024-01-02 00:00:00", 500), (2, "2024-01-02", "2024-01-02 09:00:00", 600),
                   (3, "2024-01-02", "2024-01-02 09:00:00", 700), (1, "2023-12-01", "2023-12-01 00:00:00", 800)])
    dim = frame(spark, "product_id bigint, category_name string", [(1, "a"), (2, "b"), (3, None)])
    history = fc.forecast_history(lines, dim, datetime(2024, 1, 3), history_days=1)
    got = {(r.category_name, r.date): float(r.revenue) for r in fc.forecast_series(history).collect()}
    assert got == {("a", date(2024, 1, 2)): 5.0, ("b", date(2024, 1, 2)): 6.0, ("__total__", date(2024, 1, 2)): 11.0}


def test_runs_are_kept_and_repeatable(spark, tmp_path):
    s = series(spark, {"a": 70})
    f = fc.forecast_baseline(s, horizon=3)
    path = str(tmp_path / "f")
    for run in (datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(2024, 1, 2)):
        fc.write_forecast(f, path, run)
    got = spark.read.parquet(path).groupBy("model_run").count().orderBy("model_run").collect()
    assert [r["count"] for r in got] == [3, 3]


def test_alert_needs_two_runs_over_target(spark):
    runs = frame(spark, "category_name string, model_run_at timestamp, mape double", [
        ("__total__", "2024-01-01", 0.11), ("__total__", "2024-01-02", 0.12), ("__total__", "2024-01-03", 0.09),
        ("a", "2024-01-01", 0.17), ("a", "2024-01-02", 0.19), ("a", "2024-01-03", 0.2)])
    got = {(r.category_name, r.model_run_at.day): r.is_alert for r in fc.forecast_alert(runs).collect()}
    assert [k for k, v in got.items() if v] == [("__total__", 2), ("a", 3)]


def test_cover_counts_whole_days(spark):
    f = frame(spark, "category_name string, forecast_date date, yhat double",
              [("a", f"2024-01-{d:02d}", 10) for d in range(1, 6)])
    lines = frame(spark, "product_id bigint, order_date date, quantity bigint, revenue_cents bigint",
                  [(1, "2023-12-30", 5, 5000), (2, "2023-12-30", 5, 5000)])
    dim = frame(spark, "product_id bigint, sku string, category_name string", [(1, "A", "a"), (2, "B", "a")])
    stock = frame(spark, "product_id bigint, on_hand bigint", [(1, 1), (2, 100)])
    got = {r.sku: (r.days_of_cover, r.lasts_horizon) for r in fc.forecast_cover(f, lines, dim, stock, date(2023, 12, 31)).collect()}
    # 100 of category revenue is 5 units of A: half a unit a day, so one unit lasts two days
    assert got == {"A": (2, False), "B": (5, True)}
    # A forecast below zero sells nothing, and gives no stock back.
    dips = f.withColumn("yhat", F.when(F.dayofmonth("forecast_date") == 3, -500.0).otherwise(F.col("yhat")))
    got = {r.sku: r.days_of_cover for r in fc.forecast_cover(dips, lines, dim, stock, date(2023, 12, 31)).collect()}
    assert got == {"A": 3, "B": 5}


def test_histogram_keeps_every_residual(spark):
    r = frame(spark, "category_name string, resid double", [("__total__", x) for x in range(0, 81)] + [("a", 5)])
    got = {x.bin: x.n for x in fc.residual_hist(r, bins=40).collect()}
    assert sum(got.values()) == 81 and got[39] == 3 and got[0] == 2
    same = frame(spark, "category_name string, resid double", [("__total__", 1), ("__total__", 1)])
    assert rows(fc.residual_hist(same)) == [(0, 2)]


def test_churn_label_stays_after_the_cut(spark):
    fct = frame(spark, "customer_id bigint, order_date date, grand_total decimal(12|2), is_revenue_recognized boolean", [
        (1, "2024-01-01", "10.00", True), (1, "2024-05-01", "10.00", True), (2, "2024-01-10", "20.00", True),
        (3, "2024-05-01", "5.00", True), (2, "2024-05-01", "9.00", False), (1, "2024-09-01", "9.00", True)])
    got = rows(churn.churn_features(fct, date(2024, 6, 1)), "customer_id")  # cut 2024-03-03
    assert got == [(1, 62, 1, 10.0, 0), (2, 53, 1, 20.0, 1)]


def test_churn_scores_rank_the_idle_higher(spark):
    data = []
    for c in range(1, 61):  # even customers buy weekly, odd ones stopped early
        days = range(0, 300, 7) if c % 2 == 0 else range(0, 60, 20)
        data += [(c, str(date(2024, 1, 1) + timedelta(days=x)), "10.00", True) for x in days]
    fct = frame(spark, "customer_id bigint, order_date date, grand_total decimal(12|2), is_revenue_recognized boolean", data)
    scored = {r.customer_id: r.p_churn for r in churn.churn_score(fct, date(2024, 10, 26)).collect()}
    assert len(scored) == 60
    assert min(v for k, v in scored.items() if k % 2) > max(v for k, v in scored.items() if k % 2 == 0)


def test_model_runs_where_the_package_is_missing():
    """Executors get the fitting functions by value, not by the name of a module they may lack."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    code = "import sys, pickle; print(pickle.loads(sys.stdin.buffer.read()).__name__)"
    done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(fc.solve_ridge), cwd="/", capture_output=True)
    assert done.stdout.strip() == b"solve_ridge", done.stderr
