"""Churn: no recognized purchase in the 90 days after a cut-off, scored by logistic regression."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions.exprs import date_lit, dbl, sum_if
from tradewind.functions.money import cents, money
from tradewind.plans.marts import recognized_orders

CHURN_DAYS = 90
FEATURES = ("recency_days", "frequency", "monetary")
RIDGE = 0.01
MAX_STEPS = 50
TOLERANCE = 1e-7
FLAT = 1e-4


def rfm(fct_orders: DataFrame, cut: date) -> DataFrame:
    """Recency, frequency and monetary value from orders up to and on `cut`, and what came after."""
    before = F.col("order_date") <= date_lit(cut)
    last = F.max(F.when(before, F.col("order_date")))
    return (
        recognized_orders(fct_orders)
        .groupBy("customer_id")
        .agg(
            F.datediff(date_lit(cut), last).cast("long").alias("recency_days"),
            F.count_if(before).alias("frequency"),
            money(sum_if(before, cents("grand_total"))).alias("monetary"),
            F.count_if(~before).alias("later_orders"),
        )
        .filter("frequency > 0 and customer_id is not null")
    )


def churn_features(fct_orders: DataFrame, as_of: date, days: int = CHURN_DAYS) -> DataFrame:
    """Features before the cut-off, label after it: nothing of the label leaks into the features."""
    cut = as_of - timedelta(days=days)
    seen = fct_orders.filter(F.col("order_date") <= date_lit(as_of))
    return rfm(seen, cut).select(
        "customer_id", *FEATURES, F.when(F.col("later_orders") == 0, 1).otherwise(0).cast("long").alias("churned")
    )


def _numeric(features: DataFrame) -> DataFrame:
    """Skewed amounts on a log scale, as the model sees them."""
    return features.withColumns({f"x_{c}": F.log1p(dbl(c)) for c in FEATURES})


def _fit(training: DataFrame) -> tuple[list[float], float]:
    """Weights of the features and the intercept, fitted across the cluster."""
    inputs = [f"x_{c}" for c in FEATURES]
    vectors = VectorAssembler(inputCols=inputs, outputCol="features").transform(training)
    model = LogisticRegression(labelCol="churned", maxIter=MAX_STEPS, regParam=RIDGE, tol=TOLERANCE).fit(vectors)
    return [float(w) for w in model.coefficients], float(model.intercept)


def _probability(weights: list[float], intercept: float) -> Column:
    margin = F.lit(intercept)
    for name, weight in zip(FEATURES, weights, strict=True):
        margin = margin + F.col(f"x_{name}") * F.lit(weight)
    return 1 / (1 + F.exp(-margin))


def churn_score(fct_orders: DataFrame, as_of: date, days: int = CHURN_DAYS) -> DataFrame:
    """Fit on the past window, then score every buyer as of `as_of`.

    The fit is distributed; what comes back are one weight per feature and the intercept, and the
    score is a plain expression of them.
    """
    fitted = _fit(_numeric(churn_features(fct_orders, as_of, days)))
    now = _numeric(rfm(fct_orders.filter(F.col("order_date") <= date_lit(as_of)), as_of))
    return now.select("customer_id", *FEATURES, F.round(_probability(*fitted), 6).alias("p_churn"))


def churn_gradient(fct_orders: DataFrame, as_of: date, days: int = CHURN_DAYS) -> DataFrame:
    """How far the fit is from the minimum of its loss: per feature (and the intercept, as `bias`) the training rows, the mean
    of the input, the gradient of the penalised loss at the fitted weights, and whether it is zero within FLAT standard deviations.

    The loss is the mean log loss plus RIDGE / 2 times the squared weights of the standardised features. It is convex, so a zero
    gradient means the fit is the one solution.
    """
    training = _numeric(churn_features(fct_orders, as_of, days))
    weights, intercept = _fit(training)
    error = _probability(weights, intercept) - F.col("churned")
    inputs = [("bias", F.lit(1.0), 0.0), *((c, F.col(f"x_{c}"), w) for c, w in zip(FEATURES, weights, strict=True))]
    rows = [F.struct(F.lit(c).alias("feature"), x.alias("x"), F.lit(w).alias("w")) for c, x, w in inputs]
    each = training.select(error.alias("error"), F.explode(F.array(*rows)).alias("r")).select("error", "r.*")
    spread = F.coalesce(F.stddev_samp("x"), F.lit(0.0))
    gradient = F.avg(F.col("error") * F.col("x")) + RIDGE * F.max("w") * spread * spread
    sums = each.groupBy("feature").agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), gradient.alias("gradient"), spread.alias("spread")
    )
    scale = F.when(F.col("spread") > 0, F.col("spread")).otherwise(1.0)
    return sums.select("feature", "n", "mean", "gradient", (F.abs("gradient") / scale <= FLAT).alias("is_flat"))
