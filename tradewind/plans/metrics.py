"""The metric layer: named measures, dimensions, segments and joins, answered as one DataFrame.

A measure is aggregated at the grain of the table that owns it. Dimensions of other tables are
reached over many-to-one joins, which never repeat an owner row. A dimension reached over a
one-to-many join is first reduced to distinct (owner key, dimension) pairs, so sums cannot fan out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.functions.exprs import date_lit, ratio, zero_if_null
from tradewind.functions.money import cents, sum_cents, sum_money
from tradewind.functions.predicates import not_cancelled

BELONGS_TO = "belongsTo"
HAS_MANY = "hasMany"


@dataclass(frozen=True)
class Edge:
    """`left.on_left = right.on_right`; belongsTo means at most one right row per left row."""

    right: str
    on_left: str
    on_right: str
    relationship: str


@dataclass(frozen=True)
class Cube:
    """`rows` builds the table when a query first asks for it; unused cubes cost nothing."""

    rows: Callable[[], DataFrame]
    key: str
    measures: Mapping[str, Column]
    dimensions: Mapping[str, Column]
    segments: Mapping[str, Column] = field(default_factory=dict)
    joins: Sequence[Edge] = ()


    @cached_property
    def frame(self) -> DataFrame:
        return self.rows()


Model = Mapping[str, Cube]
Entities = Mapping[str, Callable[[], DataFrame]]


def date_range(as_of: date, text: str) -> tuple[date, date]:
    """'last N days' → the N days before `as_of`; 'today'; 'YYYY-MM-DD to YYYY-MM-DD'."""
    text = text.strip().lower()
    if text == "today":
        return as_of, as_of
    relative = re.fullmatch(r"last (\d+) days?", text)
    if relative:
        return as_of - timedelta(days=int(relative[1])), as_of - timedelta(days=1)
    fixed = re.fullmatch(r"(\d{4}-\d{2}-\d{2}) to (\d{4}-\d{2}-\d{2})", text)
    if fixed:
        return date.fromisoformat(fixed[1]), date.fromisoformat(fixed[2])
    raise ValueError(f"unknown date range: {text}")


def _split(member: str) -> tuple[str, str]:
    cube, _, name = member.partition(".")
    if not name:
        raise ValueError(f"expected Cube.member, got {member!r}")
    return cube, name


def _path(model: Model, start: str, goal: str) -> list[tuple[str, Edge]]:
    """Shortest chain of declared joins from `start` to `goal`."""
    frontier: list[tuple[str, list[tuple[str, Edge]]]] = [(start, [])]
    seen = {start}
    while frontier:
        here, path = frontier.pop(0)
        if here == goal:
            return path
        for edge in model[here].joins:
            if edge.right not in seen:
                seen.add(edge.right)
                frontier.append((edge.right, [*path, (here, edge)]))
    raise ValueError(f"no join from {start} to {goal}")


def _labels(members: Sequence[str]) -> dict[str, str]:
    """Output names: the member's own name, with the cube in front only where two would clash."""
    names = [_split(m)[1] for m in members]
    return {
        m: n if names.count(n) == 1 else f"{_split(m)[0].lower()}_{n}"
        for m, n in zip(members, names, strict=True)
    }


def _with_dimensions(model: Model, owner: str, wanted: Mapping[str, tuple[str, Column]]) -> tuple[DataFrame, bool]:
    """Owner rows plus the wanted columns, and whether a one-to-many join was crossed.

    `wanted` maps an output column to (cube, expression over that cube's columns).
    """
    own = {out: c for out, (cube, c) in wanted.items() if cube == owner}
    frame = model[owner].frame.select("*", *[c.alias(out) for out, c in own.items()])
    fans_out = False
    joined = {owner}
    steps: list[tuple[str, Edge]] = []
    for cube, _ in wanted.values():
        for step in _path(model, owner, cube):
            if step[1].right not in joined:
                joined.add(step[1].right)
                steps.append(step)
    for left, edge in steps:
        fans_out = fans_out or edge.relationship == HAS_MANY
        target = model[edge.right]
        # Only the join keys and the wanted columns of the other table travel.
        onward = {e.on_left for lf, e in steps if lf == edge.right}
        keep = [F.col(edge.on_right).alias(f"_{edge.right}_key")]
        keep += [F.col(c).alias(f"_{edge.right}_{c}") for c in sorted(onward)]
        keep += [c.alias(out) for out, (cube, c) in wanted.items() if cube == edge.right]
        left_key = edge.on_left if left == owner else f"_{left}_{edge.on_left}"
        side = target.frame.select(*keep)
        if edge.relationship == HAS_MANY:
            side = side.distinct()
        frame = frame.join(side, F.col(left_key) == F.col(f"_{edge.right}_key"), "left")
    return frame, fans_out


def metric_query(
    model: Model,
    measures: Sequence[str],
    dimensions: Sequence[str] = (),
    time_dimension: str | None = None,
    granularity: str | None = None,
    dates: tuple[date, date] | None = None,
    segments: Sequence[str] = (),
    order: Sequence[tuple[str, str]] = (),
    limit: int | None = None,
) -> DataFrame:
    """Measures by dimensions. `dates` is inclusive; `granularity` adds the truncated time dimension."""
    labels = _labels([*measures, *dimensions])
    # Wanted columns travel under names of their own, so they never meet a table's own column.
    dims = {
        f"_dim_{labels[d]}": (_split(d)[0], model[_split(d)[0]].dimensions[_split(d)[1]]) for d in dimensions
    }
    keep: list[str] = []
    if time_dimension:
        cube, name = _split(time_dimension)
        at = model[cube].dimensions[name]
        if granularity:
            dims[f"_dim_{granularity}"] = (cube, F.date_trunc(granularity, at).cast("date"))
        if dates:
            dims["_in_range"] = (cube, F.to_date(at).between(date_lit(dates[0]), date_lit(dates[1])))
            keep.append("_in_range")
    for i, s in enumerate(segments):
        cube, name = _split(s)
        dims[f"_segment_{i}"] = (cube, model[cube].segments[name])
        keep.append(f"_segment_{i}")
    group = [d for d in dims if d not in keep]

    by_owner: dict[str, list[str]] = {}
    for m in measures:
        by_owner.setdefault(_split(m)[0], []).append(m)

    parts: list[DataFrame] = []
    for owner, owned in by_owner.items():
        frame, fans_out = _with_dimensions(model, owner, dims)
        for column in keep:
            frame = frame.filter(F.col(column))
        if fans_out:
            pairs = frame.select(F.col(model[owner].key).alias("_owner"), *group).distinct()
            base = model[owner].frame
            frame = pairs.join(base, F.col("_owner") == base[model[owner].key])
        aggs = [model[owner].measures[_split(m)[1]].alias(labels[m]) for m in owned]
        parts.append(frame.groupBy(*group).agg(*aggs) if group else frame.agg(*aggs))

    result = parts[0]
    for other in parts[1:]:
        if group:
            renamed = other.select([F.col(c).alias(f"_r_{c}") if c in group else F.col(c) for c in other.columns])
            same = F.lit(True)
            for c in group:
                same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
            merged = result.join(renamed, same, "full")
            for c in group:
                merged = merged.withColumn(c, F.coalesce(c, f"_r_{c}")).drop(f"_r_{c}")
            result = merged
        else:
            result = result.withColumns({c: other.select(c).scalar() for c in other.columns})
    result = result.select(
        *[F.col(g).alias(g.removeprefix("_dim_")) for g in group], *[labels[m] for m in measures]
    )
    if order:
        keys = [F.desc(labels.get(m, m)) if way == "desc" else F.asc(labels.get(m, m)) for m, way in order]
        result = result.orderBy(*keys)
    return result.limit(limit) if limit is not None else result


def _named_products(products: DataFrame, categories: DataFrame) -> DataFrame:
    named = categories.select(
        F.col("id").alias("_cid"), F.col("name").alias("category_name"), F.col("slug").alias("category_slug")
    )
    return products.join(named, F.col("category_id") == F.col("_cid"), "left").drop("_cid")


def _customers_with_revenue(customers: DataFrame, orders: DataFrame) -> DataFrame:
    lifetime = orders.groupBy(F.col("customer_id").alias("_customer")).agg(sum_money("grand_total").alias("_lifetime"))
    return customers.join(lifetime, F.col("id") == F.col("_customer"), "left").drop("_customer")


def shop_model(tables: Entities, as_of: datetime) -> Model:
    """The five cubes of the shop. Orders leave out cancelled ones; lines filter only through Orders."""
    qty, price, cost = F.col("quantity"), cents("unit_price"), cents("unit_cost")
    return {
        "Orders": Cube(
            rows=lambda: tables["orders"]().filter(not_cancelled()),
            key="id",
            measures={
                "count": F.count("*"),
                "revenue": sum_money("grand_total"),
                "aov": ratio(sum_money("grand_total"), F.count("grand_total")),
                "discount": sum_money("discount_total"),
                "unique_customers": F.countDistinct("customer_id"),
            },
            dimensions={
                "id": F.col("id"),
                "order_number": F.col("order_number"),
                "status": F.col("status"),
                "channel": F.col("channel"),
                "device_type": F.col("device_type"),
                "utm_source": F.col("utm_source"),
                "placed_at": F.col("placed_at"),
                "delivered_at": F.col("delivered_at"),
            },
            joins=(
                Edge("Customers", "customer_id", "id", BELONGS_TO),
                Edge("OrderItems", "id", "order_id", HAS_MANY),
            ),
        ),
        "OrderItems": Cube(
            rows=tables["order_items"],
            key="id",
            measures={
                "units": F.sum("quantity"),
                "revenue": sum_cents(qty * price),
                "cost": sum_cents(qty * cost),
                "gross_margin": sum_cents(qty * (price - cost)),
                "margin_pct": ratio(sum_cents(qty * (price - cost)), sum_cents(qty * price)),
            },
            dimensions={"order_id": F.col("order_id"), "product_id": F.col("product_id")},
            joins=(
                Edge("Orders", "order_id", "id", BELONGS_TO),
                Edge("Products", "product_id", "id", BELONGS_TO),
            ),
        ),
        "Products": Cube(
            rows=lambda: _named_products(tables["products"](), tables["categories"]()),
            key="id",
            measures={
                "count": F.count("*"),
                "active_count": F.count_if(F.col("is_active")),
                "list_margin_pct_avg": F.avg(ratio(F.col("price") - F.col("cost"), "price")),
            },
            dimensions={
                "id": F.col("id"),
                "sku": F.col("sku"),
                "name": F.col("name"),
                "brand": F.col("brand"),
                "category_name": F.col("category_name"),
                "is_active": F.col("is_active"),
                "launched_at": F.col("launched_at"),
                "list_price": F.col("price"),
            },
            joins=(Edge("OrderItems", "id", "product_id", HAS_MANY),),
        ),
        "Customers": Cube(
            rows=lambda: _customers_with_revenue(tables["customers"](), tables["orders"]()),
            key="id",
            measures={"count": F.count("*"), "lifetime_revenue": F.sum(zero_if_null("_lifetime"))},
            dimensions={
                "id": F.col("id"),
                "email": F.col("email"),
                "signup_channel": F.col("signup_channel"),
                "signup_country": F.col("signup_country"),
                "signup_at": F.col("created_at"),
                "tenure_days": F.datediff(date_lit(as_of.date()), F.to_date("created_at")).cast("long"),
            },
            segments={"opted_in_to_marketing": F.col("marketing_opt_in")},
            joins=(Edge("Orders", "id", "customer_id", HAS_MANY),),
        ),
        "Carts": Cube(
            rows=tables["carts"],
            key="id",
            measures={
                "count": F.count("*"),
                "abandoned": F.count_if(F.col("status") == "abandoned"),
                "converted": F.count_if(F.col("status") == "converted"),
                "abandonment_rate": ratio(F.count_if(F.col("status") == "abandoned"), F.count("*")),
            },
            dimensions={"id": F.col("id"), "status": F.col("status"), "created_at": F.col("created_at")},
        ),
    }


def metric_repeat(orders: DataFrame) -> DataFrame:
    """Customers with more than one order as a count, and as the rate it is published as."""
    buyers = orders.filter(not_cancelled()).groupBy("customer_id").agg(F.count("*").alias("n"))
    return buyers.agg(
        (F.count("customer_id") - F.count_if(F.col("n") == 1)).alias("repeat_customers"),
        F.count("customer_id").alias("unique_customers"),
    ).withColumn("repeat_rate", ratio("repeat_customers", "unique_customers"))


# ---- the daily pre-aggregation ----------------------------------------------------------------


ROLLUP_KEYS = ["day", "channel", "device_type"]


def _rollup(orders: DataFrame) -> DataFrame:
    """Day × channel × device over the orders that are not cancelled; other rows only keep their key."""
    live = not_cancelled()
    per_customer = orders.groupBy(F.to_date("placed_at").alias("day"), "channel", "device_type", "customer_id").agg(
        F.count_if(live).alias("n"), F.sum(F.when(live, cents("grand_total"))).alias("s")
    )
    buyer = F.when(F.col("n") > 0, F.col("customer_id"))
    return (
        per_customer.groupBy(*ROLLUP_KEYS)
        .agg(
            F.sum("n").alias("count"),
            sum_cents("s").alias("revenue"),
            F.count(buyer).alias("unique_customers"),
            F.hll_sketch_agg(buyer).alias("customer_sketch"),
        )
        .withColumn("aov", ratio("revenue", "count"))
    )


def daily_rollup(orders: DataFrame) -> DataFrame:
    """Day × channel × device. Sum and count are kept beside the average; unique customers beside a
    mergeable sketch, since neither average nor distinct count can be added up again."""
    return _rollup(orders.filter(not_cancelled()))


def refresh_rollup(orders: DataFrame, path: str, since: date) -> None:
    """Recompute the stored rollup from `since` on and replace those days only.

    Cancelled orders keep their day in the write, so a day whose orders were all cancelled is replaced too.
    """
    recent = orders.filter(F.to_date("placed_at") >= date_lit(since))
    (
        _rollup(recent)
        .repartition("day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).filter("count > 0")


def rollup_unique_approx(rollup: DataFrame, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """Approximate unique customers at a coarser level, merged from the stored sketches."""
    return rollup.groupBy(*keys).agg(
        F.hll_sketch_estimate(F.hll_union_agg("customer_sketch")).alias("unique_customers_approx")
    )


def rollup_levels(rollup: DataFrame) -> DataFrame:
    """Totals of the stored rollup by channel and device, by channel, and overall."""
    return (
        rollup.rollup("channel", "device_type")
        .agg(
            F.grouping_id().cast("long").alias("level"),
            F.sum("count").alias("count"),
            F.sum("revenue").alias("revenue"),
        )
        .select("level", "channel", "device_type", "count", "revenue", ratio("revenue", "count").alias("aov"))
    )
