"""Demand forecasts: one small model per series, all series in parallel.

A model needs sums over its series, not the series: products of its columns are added up like any other aggregate, and Python
only solves one small system per series or fold. A linear baseline needs no Python at all.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.cloudpickle.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.exprs import dbl, in_date_window, ratio, ts_lit
from tradewind.functions.money import cents, money, sum_cents
from tradewind.functions.sizing import sums_by_attribute
from tradewind.schemas import (
    MAPE_TARGET_CATEGORY,
    MAPE_TARGET_TOTAL,
    MIN_HISTORY_POINTS,
    TOTAL_SERIES,
    YEARLY_MIN_POINTS,
)

# The fitting functions travel to the executors themselves, so nothing has to be installed there.
register_pickle_by_value(sys.modules[__name__])

HORIZON = 30
Z80 = 1.2815515655446004  # fixed value: half-width of the central 80% of a normal, in standard deviations
COLD_START_WIDENING = 2.0
RIDGE = 1.0
YEARLY_TERMS = 4
EPOCH = "2000-01-01"


# ---- series ---------------------------------------------------------------------------------------


def forecast_history(
    fct_items: DataFrame, dim_product: DataFrame, as_of: datetime, history_days: int = 540
) -> DataFrame:
    """Category × day line revenue of the last `history_days`; products without a category drop out."""
    recent = fct_items.filter(F.col("placed_at") >= ts_lit(as_of - timedelta(days=history_days)))
    named = dim_product.filter("category_name is not null")
    sums = {"revenue": F.col("revenue_cents")}
    daily = sums_by_attribute(recent, named, "product_id", ["category_name"], sums, ["order_date"])
    return daily.select(F.col("order_date").alias("date"), "category_name", money("revenue").alias("revenue"))


def forecast_series(history: DataFrame) -> DataFrame:
    """The categories plus the top line; one row per series and day, from one reading of the history."""
    both = F.explode(F.array("category_name", F.lit(TOTAL_SERIES)))
    return (
        history.select(both.alias("category_name"), "date", cents("revenue").alias("c"))
        .groupBy("category_name", "date")
        .agg(sum_cents("c").alias("revenue"))
    )


# ---- the model ------------------------------------------------------------------------------------


def _design(day: Column) -> list[Column]:
    """Level, trend in years, weekday contrasts and yearly waves of a date, as the columns of the model."""
    number = F.unix_date(day)
    weekday = F.pmod(number, F.lit(7))
    angle = [2 * math.pi * k * number / 365.25 for k in range(1, YEARLY_TERMS + 1)]
    return [
        F.lit(1.0),
        dbl(F.datediff(day, F.lit(EPOCH).cast("date"))) / 365.25,
        *[(weekday == k).cast("double") for k in range(1, 7)],
        *[F.sin(x) for x in angle],
        *[F.cos(x) for x in angle],
    ]


PLAIN_TERMS = 8  # level, trend and weekdays; the yearly waves follow
TERMS = PLAIN_TERMS + 2 * YEARLY_TERMS
WAVES = range(1, YEARLY_TERMS + 1)


def _summands(t: Column, number: Column, y: Column) -> dict[str, Column]:
    """What is added up per weekday. Products of two waves are sums of waves of their sum and difference, so single waves up to
    twice the order are enough."""
    angle = {k: 2 * math.pi * k * number / 365.25 for k in range(1, 2 * YEARLY_TERMS + 1)}
    out = {"t": t, "tt": t * t, "y": y, "ty": t * y, "yy": y * y}
    for k, x in angle.items():
        out |= {f"s{k}": F.sin(x), f"c{k}": F.cos(x)}
    for k in WAVES:
        out |= {f"ts{k}": t * F.sin(angle[k]), f"tc{k}": t * F.cos(angle[k])}
        out |= {f"ys{k}": y * F.sin(angle[k]), f"yc{k}": y * F.cos(angle[k])}
    return out


SUMMANDS = (
    ["t", "tt", "y", "ty", "yy"]
    + [f"{f}{k}" for k in range(1, 2 * YEARLY_TERMS + 1) for f in "sc"]
    + [f"{v}{f}{k}" for k in WAVES for v in "ty" for f in "sc"]
)


def fit_sums(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Everything a fit needs of its rows (date, y), added up where the rows are: no series is ever gathered.

    Per key and weekday: n, the last date, and the sums of SUMMANDS.
    """
    number = F.unix_date("date")
    t = dbl(F.datediff("date", F.lit(EPOCH).cast("date"))) / 365.25
    wide = rows.select(*keys, "date", F.pmod(number, F.lit(7)).alias("weekday"), number.alias("_d"), t.alias("_t"), F.col("y").alias("_y"))
    parts = _summands(F.col("_t"), F.col("_d"), F.col("_y"))
    return wide.groupBy(*keys, "weekday").agg(
        F.count("*").alias("n"), F.max("date").alias("last"), *[F.sum(parts[name]).alias(name) for name in SUMMANDS]
    )


def _products(n: int, sums: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Products of level, trend and waves with each other, and with y, of one weekday."""
    s = lambda k: float(np.sign(k)) * sums[f"s{abs(k)}"] if k else 0.0
    c = lambda k: sums[f"c{abs(k)}"] if k else float(n)
    names = ["1", "t", *[f"s{k}" for k in WAVES], *[f"c{k}" for k in WAVES]]
    out = np.zeros((len(names), len(names)))
    for i, a in enumerate(names):
        for j, b in enumerate(names[: i + 1]):
            if b == "1":
                value = float(n) if a == "1" else sums[a]
            elif b == "t":
                value = sums["t" + a]
            else:
                k, m = int(a[1:]), int(b[1:])
                if a[0] == b[0]:
                    value = (c(k - m) + (1 if a[0] == "c" else -1) * c(k + m)) / 2
                else:  # the cosine is always listed later
                    value = (s(m + k) + s(m - k)) / 2
            out[i, j] = out[j, i] = value
    return out, np.array([sums["y" if a == "1" else "ty" if a == "t" else "y" + a] for a in names])


def solve_ridge(parts: Sequence, yearly: bool | None) -> tuple[int, np.ndarray, float]:
    """Rows, weights of all terms (zero for the waves of a series too short for them) and the residual spread, from the
    (weekday, n, sums) of one series."""
    products, xy, yy, total = np.zeros((TERMS, TERMS)), np.zeros(TERMS), 0.0, 0
    smooth = [0, 1, *range(PLAIN_TERMS, TERMS)]
    for weekday, n, values in parts:
        sums = dict(zip(SUMMANDS, values, strict=True))
        own, own_y = _products(n, sums)
        products[np.ix_(smooth, smooth)] += own
        xy[smooth] += own_y
        if weekday:
            at = weekday + 1
            products[at, smooth] = products[smooth, at] = own[0]
            products[at, at], xy[at] = n, own_y[0]
        yy, total = yy + sums["yy"], total + n
    terms = TERMS if (total >= YEARLY_MIN_POINTS if yearly is None else yearly) else PLAIN_TERMS
    products, xy = products[:terms, :terms], xy[:terms]
    penalty = np.full(terms, RIDGE)
    penalty[:2] = 0.0  # level and trend are not shrunk, so the trend may be measured from its mean, which keeps digits
    shift = np.eye(terms)
    shift[1, 0] = -products[0, 1] / products[0, 0]
    beta = shift.T @ np.linalg.solve(shift @ products @ shift.T + np.diag(penalty), shift @ xy)
    square = yy - 2 * beta @ xy + beta @ products @ beta
    return total, np.concatenate([beta, np.zeros(TERMS - terms)]), float(np.sqrt(max(square, 0.0) / total))


def fitted(rows: DataFrame, keys: Sequence[str], yearly: bool | None = None) -> DataFrame:
    """One row per key: n, last, beta, spread. `yearly` decides on the waves; by default the length of the history does."""
    part = F.struct("weekday", "n", F.array(*SUMMANDS).alias("sums"))
    weeks = fit_sums(rows, keys).groupBy(*keys).agg(F.max("last").alias("last"), F.collect_list(part).alias("parts"))  # seven at most
    kept = [*keys, "last"]

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            solved = [solve_ridge([(p["weekday"], p["n"], p["sums"]) for p in parts], yearly) for parts in pdf["parts"]]
            yield pdf[kept].assign(n=[n for n, _, _ in solved], beta=[b for _, b, _ in solved], spread=[s for _, _, s in solved])

    schema = ", ".join(f"{c} {weeks.schema[c].dataType.simpleString()}" for c in kept)
    return weeks.mapInPandas(solve, f"{schema}, n long, beta array<double>, spread double")


def listed_sums(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sums of a fit as rows: every summand per key and weekday; the square of y, which has too many digits, is left out."""
    totals = [F.struct(F.lit(x).alias("term"), F.round(x, 2 if "y" in x else 6).alias("total")) for x in SUMMANDS if x != "yy"]
    return sums.select(*keys, F.col("weekday").cast("long").alias("weekday"), "n", F.inline(F.array(*totals)))


def _predicted(day: Column) -> Column:
    """The model's value on a date, from the column `beta`."""
    terms = [F.col("beta")[i] * x for i, x in enumerate(_design(day))]
    return sum(terms[1:], terms[0])


def forecast_fit(series: DataFrame, horizon: int = HORIZON, min_points: int = MIN_HISTORY_POINTS) -> DataFrame:
    """The next `horizon` days of every series with enough history; shorter series are skipped."""
    daily = series.select("category_name", "date", dbl("revenue").alias("y"))
    fits = fitted(daily, ["category_name"]).filter(F.col("n") >= min_points)
    days = F.sequence(F.date_add("last", 1), F.date_add("last", horizon))
    ahead = fits.withColumn("forecast_date", F.explode(days)).withColumn("yhat", _predicted(F.col("forecast_date")))
    half = Z80 * F.col("spread")
    return ahead.select(
        "category_name", "forecast_date", "yhat", (F.col("yhat") - half).alias("yhat_lower"), (F.col("yhat") + half).alias("yhat_upper")
    )


def cold_start(series: DataFrame, horizon: int = HORIZON, min_points: int = MIN_HISTORY_POINTS) -> DataFrame:
    """Series too short to fit: their daily mean, with a wider band."""
    y = dbl("revenue")
    short = (
        series.groupBy("category_name")
        .agg(
            F.count("*").alias("n"),
            F.avg(y).alias("mean"),
            F.coalesce(F.stddev_pop(y), F.lit(0.0)).alias("spread"),
            F.max("date").alias("last"),
        )
        .filter(F.col("n") < min_points)
    )
    half = F.col("spread") * (Z80 * COLD_START_WIDENING)
    return short.select(
        "category_name",
        F.explode(F.sequence(F.date_add("last", 1), F.date_add("last", horizon))).alias("forecast_date"),
        F.col("mean").alias("yhat"),
        (F.col("mean") - half).alias("yhat_lower"),
        (F.col("mean") + half).alias("yhat_upper"),
    )


def forecast_all(series: DataFrame, horizon: int = HORIZON) -> DataFrame:
    return forecast_fit(series, horizon).unionByName(cold_start(series, horizon))


# ---- the baseline without Python --------------------------------------------------------------------

def _weekday_sums(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact sums per series and weekday: at most seven rows per series."""
    t = F.datediff(F.col("date"), F.lit(EPOCH).cast("date")).cast("long")
    y = F.col("revenue").cast("decimal(18,2)")
    return (
        series.withColumns({"t": t, "y": y, "dow": F.dayofweek("date")})
        .groupBy(*keys, "dow")
        .agg(
            F.count("*").alias("n"),
            F.sum("t").alias("st"),
            F.sum(F.col("t") * F.col("t")).alias("stt"),
            F.sum("y").alias("sy"),
            F.sum(F.col("t") * F.col("y")).alias("sty"),
            F.sum(F.col("y") * F.col("y")).alias("syy"),
            F.max("date").alias("last"),
        )
    )


def _trend(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per series: least-squares line, each weekday's mean distance from it, and the residual spread.

    Everything follows in closed form from the weekday sums, so the series is read once.
    """
    c = F.col
    whole = Window.partitionBy(*keys)
    sums = _weekday_sums(series, keys).select(
        *keys,
        "dow",
        *[dbl(x).alias(f"{x}_d") for x in ("n", "st", "stt", "sy", "sty", "syy")],
        *[dbl(F.sum(x).over(whole)).alias(x) for x in ("n", "st", "stt", "sy", "sty")],
        F.max("last").over(whole).alias("last"),
    )
    slope = ratio(c("n") * c("sty") - c("st") * c("sy"), c("n") * c("stt") - c("st") * c("st"))
    # Within a weekday the spread is that of y - slope × t around its own mean.
    mean = (c("sy_d") - c("slope") * c("st_d")) / c("n_d")
    square = c("syy_d") - 2 * c("slope") * c("sty_d") + c("slope") * c("slope") * c("stt_d") - c("n_d") * mean * mean
    return (
        sums.withColumn("slope", F.coalesce(slope, F.lit(0.0)))
        .withColumn("intercept", (c("sy") - c("slope") * c("st")) / c("n"))
        .withColumn("weekday", c("sy_d") / c("n_d") - c("intercept") - c("slope") * c("st_d") / c("n_d"))
        .withColumn("square", F.greatest(square, F.lit(0.0)))
        .groupBy(*keys, "last", "n", "slope", "intercept")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("dow", "weekday"))).alias("weekdays"),
            F.sqrt(F.sum("square") / c("n")).alias("spread"),
        )
    )


def _level(day: Column) -> Column:
    """Line plus weekday level; a weekday never seen stays on the line."""
    t = dbl(F.datediff(day, F.lit(EPOCH).cast("date")))
    weekday = F.coalesce(F.try_element_at(F.col("weekdays"), F.dayofweek(day)), F.lit(0.0))
    return F.col("intercept") + F.col("slope") * t + weekday


def baseline_residuals(series: DataFrame, keys: Sequence[str] = ("category_name",)) -> DataFrame:
    fit = _trend(series, keys)
    return series.join(fit, list(keys)).select(
        *keys, "date", "revenue", F.round(dbl("revenue") - _level(F.col("date")), 4).alias("resid")
    )


def forecast_baseline(
    series: DataFrame, horizon: int = HORIZON, keys: Sequence[str] = ("category_name",)
) -> DataFrame:
    """Linear trend plus weekday level, with an 80% band from the residual spread."""
    days = F.sequence(F.date_add("last", 1), F.date_add("last", horizon))
    ahead = _trend(series, keys).withColumn("forecast_date", F.explode(days))
    yhat = _level(F.col("forecast_date"))
    return ahead.select(
        *keys,
        "forecast_date",
        F.round(yhat, 2).alias("yhat"),
        F.round(yhat - F.lit(Z80) * F.col("spread"), 2).alias("yhat_lower"),
        F.round(yhat + F.lit(Z80) * F.col("spread"), 2).alias("yhat_upper"),
    )


def residual_hist(residuals: DataFrame, bins: int = 40) -> DataFrame:
    """Residual counts of the top line in equal bins; the last bin includes its upper end."""
    top = residuals.filter(F.col("category_name") == TOTAL_SERIES).select("resid")
    ends = top.agg(F.struct(F.min("resid").alias("lo"), F.max("resid").alias("hi"))).scalar()
    placed = top.withColumn("e", ends)
    lo, hi = F.col("e.lo"), F.col("e.hi")
    position = F.floor(F.try_divide((F.col("resid") - lo) * bins, hi - lo))
    return (
        placed.select(F.least(F.coalesce(position, F.lit(0)), F.lit(bins - 1)).cast("long").alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )


# ---- evaluation -------------------------------------------------------------------------------------


def forecast_errors(actual: DataFrame, forecast: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean absolute percentage error (days with zero sales left out) and band coverage per key."""
    y = dbl("revenue")
    ape = F.abs(y - F.col("yhat")) / F.when(y != 0, y)
    inside = (y >= F.col("yhat_lower")) & (y <= F.col("yhat_upper"))
    f = forecast.withColumnRenamed("forecast_date", "date")
    return actual.join(f, [*keys, "date"]).groupBy(*keys).agg(
        F.count("*").alias("n_test"),
        F.round(F.avg(ape), 4).alias("mape"),
        F.round(F.avg(inside.cast("double")), 4).alias("coverage_80"),
    )


def _splits(series: DataFrame, horizon: int, n_splits: int) -> DataFrame:
    """Each series once per split, rows numbered, with the row count before the split's test window."""
    along = Window.partitionBy("category_name").orderBy("date")
    numbered = series.select(
        "category_name",
        "date",
        "revenue",
        F.row_number().over(along).alias("i"),
        F.count("*").over(Window.partitionBy("category_name")).alias("len"),
    )
    return numbered.withColumn("split", F.explode(F.sequence(F.lit(1), F.lit(n_splits)))).withColumn(
        "cut", F.col("len") - F.col("split") * horizon
    )


def walk_forward_baseline(
    series: DataFrame, horizon: int = HORIZON, n_splits: int = 4, min_points: int = MIN_HISTORY_POINTS
) -> DataFrame:
    """Walk-forward scores of the baseline; splits with too short a past are skipped."""
    keys = ["category_name", "split"]
    rows = _splits(series, horizon, n_splits).filter(F.col("cut") >= min_points)
    train = rows.filter(F.col("i") <= F.col("cut")).select(*keys, "date", "revenue")
    test = rows.filter((F.col("i") > F.col("cut")) & (F.col("i") <= F.col("cut") + horizon))
    return forecast_errors(test.select(*keys, "date", "revenue"), forecast_baseline(train, horizon, keys), keys)


def _scored(rows: DataFrame, horizon: int, reach: bool, yearly: bool | None) -> DataFrame:
    """Scores per series and split: all folds are fitted from their sums at once, and test days meet their fold's weights.

    With `reach`, only days that a forecast of `horizon` days gets to are compared.
    """
    keys = ["category_name", "split"]
    train, test = F.col("i") <= F.col("cut"), (F.col("i") > F.col("cut")) & (F.col("i") <= F.col("cut") + horizon)
    fits = fitted(rows.filter(train).select(*keys, "date", "y"), keys, yearly)
    days = rows.filter(test).select(*keys, "date", "y").join(fits, keys)
    counted = F.col("date") <= F.date_add("last", horizon) if reach else F.lit(True)
    y, yhat, half = F.col("y"), F.col("yhat"), Z80 * F.col("spread")
    inside = (y >= yhat - half) & (y <= yhat + half)
    return (
        days.withColumn("yhat", _predicted(F.col("date")))
        .groupBy(*keys)
        .agg(
            F.max("date").alias("split_end"),
            F.max("n").cast("int").alias("n_train"),
            F.count("*").cast("int").alias("n_test"),
            F.avg(F.when(counted, F.abs(y - yhat) / F.when(y != 0, y))).alias("mape"),
            F.avg(F.when(counted, inside.cast("double"))).alias("coverage_80"),
        )
    )


def walk_forward(
    series: DataFrame, horizon: int = HORIZON, n_splits: int = 4, min_points: int = MIN_HISTORY_POINTS
) -> DataFrame:
    """One row per series and split with enough history before it."""
    rows = _splits(series.withColumn("revenue", dbl("revenue")), horizon, n_splits).withColumnRenamed("revenue", "y")
    return _scored(rows.filter(F.col("cut") >= min_points), horizon, reach=True, yearly=None)


def walk_forward_summary(series: DataFrame, horizon: int = HORIZON, n_splits: int = 3) -> DataFrame:
    """Mean scores per series over the splits; null for series shorter than the splits need.

    Here the yearly waves are always on, and test days are predicted wherever they fall.
    """
    rows = _splits(series.withColumn("revenue", dbl("revenue")), horizon, n_splits).withColumnRenamed("revenue", "y")
    enough = rows.filter(F.col("len") >= horizon * (n_splits + 1))
    scored = (
        _scored(enough, horizon, reach=False, yearly=True)
        .groupBy("category_name")
        .agg(
            F.avg("mape").alias("mape_mean"),
            F.avg("coverage_80").alias("coverage_80_mean"),
            F.count("*").cast("int").alias("n_splits"),
        )
    )
    names = series.select("category_name").distinct()
    return names.join(scored, "category_name", "left").withColumn("horizon_days", F.lit(horizon))


def forecast_alert(runs: DataFrame) -> DataFrame:
    """Series over their error target in this run and the one before.

    `runs`: category_name, model_run_at, mape.
    """
    target = F.when(F.col("category_name") == TOTAL_SERIES, MAPE_TARGET_TOTAL).otherwise(MAPE_TARGET_CATEGORY)
    over = F.col("mape") > target
    along = Window.partitionBy("category_name").orderBy("model_run_at")
    return (
        runs.withColumns({"target": target, "is_over": over})
        .withColumn("is_alert", F.col("is_over") & F.coalesce(F.lag("is_over").over(along), F.lit(False)))
        .select("category_name", "model_run_at", "mape", "target", "is_over", "is_alert")
    )


# ---- use --------------------------------------------------------------------------------------------


def write_forecast(forecast: DataFrame, path: str, run_at: datetime) -> None:
    """Add a run. Older runs stay; writing the same run again replaces only itself."""
    (
        forecast.withColumn("model_run_at", F.lit(run_at.isoformat(sep=" ")).cast("timestamp"))
        .withColumn("model_run", F.lit(run_at.strftime("%Y%m%dT%H%M%S")))
        .hint("rebalance", "model_run")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model_run")
        .parquet(path)
    )


def forecast_cover(
    forecast: DataFrame, fct_items: DataFrame, dim_product: DataFrame, stock: DataFrame, as_of: date, days: int = 84
) -> DataFrame:
    """Days each product's stock lasts if its category sells as forecast.

    A product's share is its units per unit of category revenue over the last `days`. The running
    category forecast is one short array per category; each product looks up where it runs out.
    `stock`: product_id, on_hand.
    """
    sold = (
        fct_items.filter(in_date_window("order_date", as_of, days))
        .groupBy("product_id")
        .agg(F.sum("quantity").alias("units"), sum_cents("revenue_cents").alias("revenue"))
    )
    named = sold.join(
        dim_product.filter("category_name is not null").select("product_id", "sku", "category_name"), "product_id"
    )
    category = named.groupBy("category_name").agg(F.sum("revenue").alias("category_revenue"))
    # A forecast below zero sells nothing; so totals never fall, and the first day past the stock is the last covered.
    running = F.sum(F.greatest(F.col("yhat"), F.lit(0.0)).cast("decimal(18,2)")).over(
        Window.partitionBy("category_name").orderBy("forecast_date")
    )
    ahead = (
        forecast.select("category_name", "forecast_date", running.alias("cum"))
        .groupBy("category_name")
        .agg(F.sort_array(F.collect_list(dbl("cum"))).alias("running"))
    )
    runs_out_at = dbl("on_hand") * dbl("category_revenue") / dbl("units")
    covered = F.size(F.filter("running", lambda x: x <= F.col("runs_out_at"))).cast("long")
    return (
        named.join(category, "category_name")
        .join(ahead, "category_name")
        .join(stock, "product_id")
        .withColumn("runs_out_at", runs_out_at)
        .select(
            "product_id",
            "sku",
            "category_name",
            "on_hand",
            ratio("units", "category_revenue").alias("units_per_revenue"),
            covered.alias("days_of_cover"),
            (covered == F.size("running")).alias("lasts_horizon"),
        )
    )
