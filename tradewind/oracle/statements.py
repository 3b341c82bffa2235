"""One DuckDB statement per query, written against the entity definitions in `entities`."""

from __future__ import annotations

from tradewind.operators.forecast import COLD_START_WIDENING
from tradewind.oracle.entities import with_entities
from tradewind.schemas import ENTITIES

_RAW: dict[str, str] = {}

TS = "TIMESTAMP '2001-08-01 23:59:59'"
DAY = "DATE '2001-08-01'"


def _win(column: str, days: int, offset: int = 0) -> str:
    end = f"{TS} - to_days({offset})"
    return f"{column} BETWEEN {end} - to_days({days}) AND {end}"


def _d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def _b(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def _ratio(a: str, b: str) -> str:
    return f"{_d(a)} / NULLIF({_d(b)}, 0)"


def _pct(a: str, b: str) -> str:
    return f"coalesce(round({_ratio(a, b)} * 100, 1), 0.0)"


# ---- loads -------------------------------------------------------------------------------------

_RAW["etl_full_refresh"] = f"""
SELECT id, sku, name, category_id, brand, {_d('price')} AS price, {_d('cost')} AS cost, is_active FROM e_products"""

_RAW["etl_incremental_window"] = """
SELECT * FROM (
  SELECT 'customers' AS "table", id AS row_id, created_at AS changed_at FROM e_customers
  UNION ALL SELECT 'orders', id, placed_at FROM e_orders
  UNION ALL SELECT 'carts', id, created_at FROM e_carts
  UNION ALL SELECT 'product_events', id, occurred_at FROM e_product_events
  UNION ALL SELECT 'inventory_levels', id, updated_at FROM e_inventory_levels
  UNION ALL SELECT 'promotion_redemptions', id, redeemed_at FROM e_promotion_redemptions
  UNION ALL SELECT 'stock_movements', variant_id, occurred_at FROM e_stock_movements)
WHERE changed_at >= TIMESTAMP '2001-07-31 21:59:59'"""

_RAW["etl_incremental_items"] = f"""
SELECT i.order_id, i.product_id, i.variant_id, i.quantity, {_d('i.unit_price')} AS unit_price,
       {_d('i.unit_cost')} AS unit_cost, {_d('i.line_discount')} AS line_discount
FROM e_order_items i JOIN e_orders o ON o.id = i.order_id WHERE o.placed_at >= {TS} - to_hours(48)"""

_RAW["etl_jsonl_roundtrip"] = f"""
SELECT id, order_number, customer_id, status, {_d('grand_total')} AS grand_total, placed_at, delivered_at FROM e_orders"""

_RAW["etl_line_store"] = f"""
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, {_b('count(*)')} AS n_rows, {_b('sum(l_quantity)')} AS units
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1"""

_RAW["stg_dedupe"] = f"""
SELECT id, customer_id, status, {_d('grand_total')} AS grand_total, placed_at,
       placed_at + to_hours(2) AS _ingested_at FROM e_orders"""

_TABLES = [n for n in ENTITIES if n not in ("addresses", "demand_forecast")]
_RAW["etl_bootstrap_counts"] = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", {_b('count(*)')} AS n_rows FROM e_{t}" for t in _TABLES
)
_RAW["etl_bootstrap"] = f"SELECT * FROM ({_RAW['etl_bootstrap_counts']}) WHERE n_rows > 0"

_RAW["etl_full_refresh_all"] = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", {_b('count(*)')} AS n_rows, {_b('sum(id)')} AS id_sum FROM e_{t}"
    for t in ("categories", "products", "product_variants", "promotions")
)

_PULL = f"""SELECT id, customer_id, status, channel, {_d('grand_total')} AS grand_total,
       CASE WHEN id % 50 <> 0 THEN placed_at END AS placed_at FROM e_orders"""
_RAW["etl_load_twice"] = _PULL

_RAW["etl_load_days"] = f"""
SELECT id, customer_id, session_id, CASE WHEN created_at >= {TS} - to_hours(48) THEN 'closed' ELSE status END AS status, created_at
FROM e_carts"""

_FIXED = f"""{_PULL} WHERE id % 10 <> 0
UNION ALL SELECT id, customer_id, 'refunded', channel, {_d('grand_total')},
       CASE WHEN id % 20 = 10 THEN placed_at + INTERVAL 3 DAY WHEN id % 40 <> 0 THEN placed_at END
FROM e_orders WHERE id % 10 = 0"""
_RAW["etl_load_corrections"] = _FIXED

_RAW["etl_reconcile_stored"] = f"""
SELECT CAST(placed_at AS DATE) AS date, {_b('count(*)')} AS n_source, {_b('count(*) FILTER (id % 97 <> 0)')} AS n_target,
       {_b('count(*) FILTER (id % 97 = 0)')} AS drift, count(*) FILTER (id % 97 = 0) > 0 AS is_drift
FROM ({_PULL}) GROUP BY 1"""

_RAW["etl_reconcile"] = f"""
SELECT CAST(placed_at AS DATE) AS date, {_b('count(*)')} AS n_source, {_b('count(paid_at)')} AS n_target,
       {_b('count(*) - count(paid_at)')} AS drift, count(*) <> count(paid_at) AS is_drift
FROM e_orders GROUP BY 1"""

_SCD2 = """
snap AS (SELECT product_id, order_date AS d, max(unit_price) AS price, max(unit_cost) AS cost
         FROM e_fct_items GROUP BY 1, 2),
flagged AS (SELECT *, lag(price) OVER w AS p0, lag(cost) OVER w AS c0, row_number() OVER w AS rn FROM snap
            WINDOW w AS (PARTITION BY product_id ORDER BY d)),
starts AS (SELECT * FROM flagged WHERE rn = 1 OR price IS DISTINCT FROM p0 OR cost IS DISTINCT FROM c0),
versions AS (SELECT product_id, CAST(price AS DOUBLE) AS price, CAST(cost AS DOUBLE) AS cost, d AS valid_from,
                    lead(d) OVER (PARTITION BY product_id ORDER BY d) AS valid_to FROM starts)"""

_RAW["scd2_product"] = f"WITH {_SCD2} SELECT * FROM versions"

_RAW["fct_items_in_force"] = f"""WITH {_SCD2}
SELECT order_id, i.product_id, order_date, quantity, v.price, v.cost
FROM e_fct_items i LEFT JOIN versions v
  ON v.product_id = i.product_id AND v.valid_from <= i.order_date AND (v.valid_to IS NULL OR i.order_date < v.valid_to)"""


def _versions(snapshots: str, key: str, tracked: tuple[str, ...]) -> str:
    before = ", ".join(f"lag({c}) OVER w AS old_{c}" for c in tracked)
    changed = " OR ".join(f"{c} IS DISTINCT FROM old_{c}" for c in tracked)
    return f"""
WITH snap AS ({snapshots}),
flagged AS (SELECT *, {before}, row_number() OVER w AS rn FROM snap WINDOW w AS (PARTITION BY {key} ORDER BY d)),
starts AS (SELECT * FROM flagged WHERE rn = 1 OR {changed})
SELECT {key}, {', '.join(tracked)}, d AS valid_from, lead(d) OVER (PARTITION BY {key} ORDER BY d) AS valid_to FROM starts"""


_RAW["scd2_product_band"] = _versions(
    f"""SELECT product_id, CAST(date_trunc('month', order_date) AS DATE) AS d,
               CAST(trunc(max(unit_price)) AS BIGINT) // 500 * 500 AS band FROM e_fct_items GROUP BY 1, 2""",
    "product_id",
    ("band",),
)
_RAW["scd2_customer"] = _versions(
    """SELECT customer_id, CAST(date_trunc('month', placed_at) AS DATE) AS d, arg_max(channel, (placed_at, id)) AS channel,
              arg_max(device_type, (placed_at, id)) AS device_type FROM e_orders GROUP BY 1, 2""",
    "customer_id",
    ("channel", "device_type"),
)

_RAW["catalog_as_of"] = f"""WITH {_SCD2}
SELECT * FROM versions
WHERE valid_from <= DATE '2000-01-01' AND (valid_to IS NULL OR valid_to > DATE '2000-01-01')"""

# ---- dimensions and facts ------------------------------------------------------------------------

_RAW["dim_date"] = """
WITH span AS (SELECT date_trunc('year', min(placed_at)) AS a,
                     date_trunc('year', max(placed_at)) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS b FROM e_orders),
days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM span)
SELECT date, CAST(year(date) AS BIGINT) AS year, CAST(quarter(date) AS BIGINT) AS quarter,
       CAST(month(date) AS BIGINT) AS month, monthname(date) AS month_name,
       CAST(strftime(date, '%U') AS BIGINT) AS week, CAST(day(date) AS BIGINT) AS day,
       CAST(dayofweek(date) + 1 AS BIGINT) AS day_of_week, dayname(date) AS day_name,
       dayofweek(date) IN (0, 6) AS is_weekend, month(date) IN (11, 12) AS is_holiday_season
FROM days"""

_RAW["dim_customer"] = f"""
SELECT id AS customer_sk, id AS customer_id, email, first_name, last_name, signup_channel, signup_country,
       marketing_opt_in, CAST(created_at AS DATE) AS signup_date,
       {_b(f"date_diff('day', CAST(created_at AS DATE), {DAY})")} AS tenure_days
FROM e_customers"""

_RAW["dim_product"] = f"""
SELECT product_id AS product_sk, product_id, sku, name, brand, {_d('list_price')} AS list_price,
       {_d('list_cost')} AS list_cost, {_ratio('list_price - list_cost', 'list_price')} AS list_margin_pct,
       category_slug, category_name, is_active, CAST(launched_at AS DATE) AS launched_date
FROM e_dim_product"""

_RAW["fct_orders"] = f"""
SELECT id AS order_sk, id AS order_id, order_number, customer_id, status, channel, utm_source, utm_campaign,
       device_type, order_date, placed_at, paid_at, fulfilled_at, delivered_at, cancelled_at,
       {_d('subtotal')} AS subtotal, {_d('discount_total')} AS discount_total,
       {_d('shipping_total')} AS shipping_total, {_d('tax_total')} AS tax_total, {_d('grand_total')} AS grand_total,
       {_b("date_sub('hour', placed_at, delivered_at)")} AS hours_to_deliver, rec AS is_revenue_recognized
FROM e_fct_orders"""

_RAW["fct_order_items"] = f"""
SELECT order_id, product_id, variant_id, customer_id, order_date, placed_at, channel, device_type, quantity,
       {_d('unit_price')} AS unit_price, {_d('unit_cost')} AS unit_cost, {_d('line_discount')} AS line_discount,
       {_d('line_revenue')} AS line_revenue, {_d('line_cost')} AS line_cost, {_d('line_margin')} AS line_margin
FROM e_fct_items"""

_RAW["fct_stock_moves"] = """
SELECT m.variant_id, v.product_id, m.warehouse_code, m.delta, m.reason, m.ref_order_id,
       CAST(m.occurred_at AS DATE) AS move_date, m.occurred_at
FROM e_stock_movements m JOIN e_product_variants v ON v.id = m.variant_id"""

_RAW["fct_product_events"] = """
SELECT id AS event_sk, session_id, customer_id, product_id, event_type, CAST(occurred_at AS DATE) AS event_date,
       occurred_at FROM e_product_events"""

_RAW["fct_carts"] = f"""
SELECT id AS cart_sk, customer_id, session_id, status, CAST(created_at AS DATE) AS created_date, created_at,
       abandoned_at, converted_at, {_b("date_sub('minute', created_at, abandoned_at)")} AS minutes_to_abandon
FROM e_carts"""

_RAW["dim_channel"] = """
SELECT channel, array_to_string(list_transform(string_split(channel, '_'),
                lambda w: upper(w[1]) || w[2:]), ' ') AS display_name
FROM (SELECT channel FROM e_orders UNION SELECT signup_channel FROM e_customers)"""

# ---- marts ---------------------------------------------------------------------------------------

_DAILY = f"""
SELECT date, {_d('rev')} AS revenue, orders, unique_customers, {_ratio('rev', 'orders')} AS aov,
       {_d('sum(rev) OVER (ORDER BY date ROWS 6 PRECEDING)')} / count(*) OVER (ORDER BY date ROWS 6 PRECEDING)
         AS revenue_7d_avg
FROM e_daily_revenue"""
_RAW["mart_daily_revenue"] = _DAILY

_RAW["daily_revenue_dense"] = f"""
WITH daily AS ({_DAILY}),
days AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM daily),
dense AS (SELECT days.date, coalesce(r.rev, 0) AS rev, coalesce(daily.orders, 0) AS orders,
                 coalesce(daily.unique_customers, 0) AS unique_customers, aov, revenue_7d_avg
          FROM days LEFT JOIN daily ON daily.date = days.date LEFT JOIN e_daily_revenue r ON r.date = days.date)
SELECT date, {_d('rev')} AS revenue, orders, unique_customers, aov, revenue_7d_avg,
       {_d('sum(rev) OVER w')} / count(*) OVER w AS revenue_7day_avg
FROM dense WINDOW w AS (ORDER BY date ROWS 6 PRECEDING)"""

_VELOCITY = f"""
velocity AS (
  SELECT p.product_id, p.sku, p.name, p.brand, p.category_name, coalesce(u28, 0) AS units_28d,
         coalesce(r28, 0) AS revenue_28d, coalesce(u84, 0) AS units_84d, coalesce(r84, 0) AS revenue_84d,
         u28 / 28.0 AS units_per_day,
         CASE WHEN coalesce(u28, 0) = 0 THEN 'dead' WHEN u28 <= 5 THEN 'slow' WHEN u28 <= 25 THEN 'steady'
              ELSE 'fast' END AS velocity_bucket
  FROM e_dim_product p
  LEFT JOIN (SELECT product_id, sum(quantity) AS u28, sum(line_revenue) AS r28 FROM e_fct_items
             WHERE order_date BETWEEN {DAY} - 28 AND {DAY} GROUP BY 1) a USING (product_id)
  LEFT JOIN (SELECT product_id, sum(quantity) AS u84, sum(line_revenue) AS r84 FROM e_fct_items
             WHERE order_date BETWEEN {DAY} - 84 AND {DAY} GROUP BY 1) b USING (product_id)
  WHERE p.is_active)"""

_RAW["mart_product_velocity"] = f"""WITH {_VELOCITY}
SELECT product_id, sku, name, brand, category_name, {_b('units_28d')} AS units_28d, {_d('revenue_28d')} AS revenue_28d,
       {_b('units_84d')} AS units_84d, {_d('revenue_84d')} AS revenue_84d, {_d('units_per_day')} AS units_per_day,
       velocity_bucket FROM velocity"""

_RAW["mart_category_pnl"] = f"""
SELECT p.category_name, i.order_date, {_d('sum(line_revenue)')} AS revenue, {_d('sum(line_cost)')} AS cost,
       {_d('sum(line_margin)')} AS gross_margin, {_ratio('sum(line_margin)', 'sum(line_revenue)')} AS margin_pct
FROM e_fct_items i JOIN e_dim_product p USING (product_id) GROUP BY 1, 2"""

_RAW["mart_channel_perf"] = f"""
SELECT channel, order_date, device_type, {_b('count(*)')} AS orders, {_d('sum(grand_total)')} AS revenue,
       {_ratio('sum(grand_total)', 'count(*)')} AS aov, {_b('count(DISTINCT customer_id)')} AS unique_customers
FROM e_fct_orders WHERE rec GROUP BY 1, 2, 3"""


def _cohort(where: str) -> str:
    return f"""
    f AS (SELECT customer_id, CAST(date_trunc('month', min(placed_at)) AS DATE) AS cohort_month
          FROM e_orders WHERE {where} GROUP BY 1),
    r AS (SELECT cohort_month, CAST(date_trunc('month', placed_at) AS DATE) AS active_month,
                 CAST(count(DISTINCT customer_id) AS BIGINT) AS customers
          FROM e_orders JOIN f USING (customer_id) WHERE {where} GROUP BY 1, 2)"""


_REC = "status IN ('paid','fulfilled','shipped','delivered')"

_RAW["mart_cohort_retention"] = f"""WITH {_cohort(_REC)}
SELECT cohort_month, active_month, {_b("date_diff('month', cohort_month, active_month)")} AS months_since_signup,
       customers AS active_customers FROM r"""

_RAW["cohort_retention_pct"] = f"""WITH {_cohort(_REC)}
SELECT r.cohort_month, {_b("date_diff('month', r.cohort_month, r.active_month)")} AS months_since_signup,
       r.customers AS active_customers, z.customers AS cohort_size,
       round({_ratio('r.customers', 'z.customers')} * 100, 2) AS retention_pct
FROM r JOIN r z ON z.cohort_month = r.cohort_month AND z.active_month = r.cohort_month"""

_RAW["cohort_retention"] = f"""WITH {_cohort("status <> 'cancelled'")} SELECT * FROM r"""

_LIFECYCLE = f"""
per AS (SELECT customer_id, {_b('count(*)')} AS lifetime_orders, sum(grand_total) AS lifetime_revenue,
               min(order_date) AS first_order_date, max(order_date) AS last_order_date
        FROM e_fct_orders WHERE rec GROUP BY 1),
life AS (SELECT c.id AS customer_sk, c.id AS customer_id, email, first_name, last_name, signup_channel,
                signup_country, marketing_opt_in, CAST(created_at AS DATE) AS signup_date,
                {_b(f"{DAY} - CAST(created_at AS DATE)")} AS tenure_days, lifetime_orders, lifetime_revenue,
                first_order_date, last_order_date, {_b(f'{DAY} - last_order_date')} AS days_since_last_order
         FROM e_customers c LEFT JOIN per ON per.customer_id = c.id)"""

_RAW["mart_customer_lifecycle"] = f"""WITH {_LIFECYCLE}
SELECT * REPLACE ({_d('lifetime_revenue')} AS lifetime_revenue),
       CASE WHEN last_order_date IS NULL THEN 'never_purchased' WHEN days_since_last_order <= 30 THEN 'active'
            WHEN days_since_last_order <= 90 THEN 'lapsing' WHEN days_since_last_order <= 180 THEN 'dormant'
            ELSE 'churned' END AS lifecycle_stage
FROM life"""

_RAW["ltv_by_segment"] = f"""WITH {_LIFECYCLE}
SELECT signup_channel, {_b('count(*)')} AS customers, {_b('count(lifetime_orders)')} AS payers,
       {_d('sum(coalesce(lifetime_revenue, 0))')} AS revenue,
       {_ratio('sum(coalesce(lifetime_revenue, 0))', 'count(*)')} AS ltv
FROM life GROUP BY 1"""

_RAW["ltv_cac"] = f"""
WITH o AS (SELECT *, min(order_date) OVER (PARTITION BY customer_id) AS f FROM e_fct_orders WHERE rec),
early AS (SELECT customer_id, sum(grand_total) AS rev FROM o WHERE order_date < f + INTERVAL 6 MONTH GROUP BY 1),
c AS (SELECT signup_channel AS channel, {_b('count(*)')} AS customers,
             {_ratio('sum(coalesce(rev, 0))', 'count(*)')} AS ltv_6m
      FROM e_customers LEFT JOIN early ON early.customer_id = id GROUP BY 1)
SELECT channel, customers, ltv_6m, {_d('cac')} AS cac, {_ratio('ltv_6m', 'cac')} AS ltv_to_cac
FROM c LEFT JOIN e_channel_cac USING (channel)"""

_RAW["mart_attribution"] = f"""
WITH o AS (SELECT customer_id, channel, grand_total, placed_at, id FROM e_fct_orders
           WHERE rec AND customer_id IS NOT NULL),
tot AS (SELECT customer_id, sum(grand_total) AS total, arg_max(channel, (placed_at, id)) AS last_channel,
               count(*) AS n FROM o GROUP BY 1),
joined AS (SELECT tot.*, c.signup_channel FROM tot JOIN e_customers c ON c.id = tot.customer_id),
touch AS (SELECT customer_id, channel FROM o UNION ALL SELECT id, signup_channel FROM e_customers),
tc AS (SELECT customer_id, channel, count(*) AS k FROM touch GROUP BY 1, 2),
lin AS (SELECT tc.channel, CAST(round(sum(CAST({_d('total')} * k / (n + 1) AS DECIMAL(24,6))), 2) AS DOUBLE) AS linear
        FROM tc JOIN joined USING (customer_id) GROUP BY 1),
f AS (SELECT signup_channel AS channel, sum(total) AS first_touch FROM joined GROUP BY 1),
l AS (SELECT last_channel AS channel, sum(total) AS last_touch FROM joined GROUP BY 1)
SELECT lin.channel, {_d('coalesce(first_touch, 0)')} AS first_touch, {_d('coalesce(last_touch, 0)')} AS last_touch, linear
FROM lin LEFT JOIN f USING (channel) LEFT JOIN l USING (channel)"""

_RAW["mart_funnel"] = f"""
WITH ev AS (SELECT CAST(occurred_at AS DATE) AS d, sum(CASE WHEN event_type = 'view' THEN 1 END) AS views,
                   sum(CASE WHEN event_type = 'add_to_cart' THEN 1 END) AS adds FROM e_product_events GROUP BY 1),
ca AS (SELECT CAST(created_at AS DATE) AS d, count(*) AS n FROM e_carts
       WHERE status IN ('abandoned','converted') GROUP BY 1),
od AS (SELECT order_date AS d, count(*) AS n FROM e_fct_orders WHERE rec GROUP BY 1)
SELECT coalesce(ev.d, ca.d, od.d) AS event_date, {_b('views')} AS views, {_b('adds')} AS add_to_cart,
       {_b('ca.n')} AS started_checkout, {_b('od.n')} AS purchased
FROM ev FULL JOIN ca ON ca.d = ev.d FULL JOIN od ON od.d = coalesce(ev.d, ca.d)"""

_RAW["mart_stockout_risk"] = f"""
WITH v AS (SELECT variant_id, {_d('sum(quantity)')} / 28.0 AS units_per_day FROM e_fct_items
           WHERE order_date BETWEEN {DAY} - 28 AND {DAY} GROUP BY 1),
h AS (SELECT variant_id, sum(on_hand) AS on_hand FROM e_inventory_levels GROUP BY 1),
j AS (SELECT pv.id AS variant_id, p.sku, p.name, pv.size, pv.color, {_b('on_hand')} AS on_hand, units_per_day,
             {_d('on_hand')} / NULLIF(units_per_day, 0) AS days_of_cover
      FROM e_product_variants pv JOIN e_products p ON p.id = pv.product_id
      LEFT JOIN v ON v.variant_id = pv.id LEFT JOIN h ON h.variant_id = pv.id)
SELECT *, CASE WHEN days_of_cover < 7 THEN 'urgent' WHEN days_of_cover < 14 THEN 'reorder_soon'
               ELSE 'healthy' END AS stock_status FROM j"""

_AGING = """
aging AS (SELECT p.category_name, p.brand, p.product_id, p.sku, p.name, sum(on_hand) AS on_hand,
                 sum(on_hand - reserved) AS available, p.list_cost
          FROM e_inventory_levels il JOIN e_product_variants pv ON pv.id = il.variant_id
          JOIN e_dim_product p ON p.product_id = pv.product_id GROUP BY ALL)"""

_RAW["mart_inventory_aging"] = f"""WITH {_AGING}
SELECT category_name, brand, product_id, sku, name, {_b('on_hand')} AS on_hand, {_d('list_cost')} AS list_cost,
       {_d('on_hand * list_cost')} AS tied_capital FROM aging"""

_RAW["tied_capital_slow"] = f"""WITH {_AGING}, {_VELOCITY}
SELECT a.product_id, a.sku, a.category_name, velocity_bucket, {_b('units_28d')} AS units_28d,
       {_b('on_hand')} AS on_hand, {_b('available')} AS available, {_d('on_hand * list_cost')} AS tied_capital,
       {_d('available * list_cost')} AS tied_capital_available
FROM aging a JOIN velocity v USING (product_id) WHERE velocity_bucket IN ('dead', 'slow')"""

_RAW["mart_promo_lift_literal"] = f"""
SELECT promotion_id, CAST(date_trunc('month', redeemed_at) AS DATE) AS month, {_b('count(*)')} AS redemptions,
       {_d('sum(amount_off)')} AS discount_given, {_d('sum(o.grand_total)')} AS gross_revenue,
       {_d('sum(line_margin)')} AS gross_margin, {_ratio('sum(line_margin)', 'sum(amount_off)')} AS lift_ratio
FROM e_promotion_redemptions r JOIN e_orders o ON o.id = r.order_id JOIN e_fct_items i ON i.order_id = r.order_id
GROUP BY 1, 2"""

_LIFT = f"""
lift AS (SELECT promotion_id, CAST(date_trunc('month', redeemed_at) AS DATE) AS month,
                {_b('count(*)')} AS redemptions, {_d('sum(amount_off)')} AS discount_given,
                {_d('sum(o.grand_total)')} AS gross_revenue, {_d('sum(margin)')} AS gross_margin,
                {_ratio('sum(margin)', 'sum(amount_off)')} AS lift_ratio
         FROM e_promotion_redemptions r JOIN e_orders o ON o.id = r.order_id
         JOIN (SELECT order_id, sum(line_margin) AS margin FROM e_fct_items GROUP BY 1) i ON i.order_id = r.order_id
         GROUP BY 1, 2)"""
_RAW["mart_promo_lift"] = f"WITH {_LIFT} SELECT * FROM lift"

_RAW["promo_month_pivot"] = f"WITH {_LIFT} SELECT promotion_id, " + ", ".join(
    f"max(CASE WHEN month = DATE '2001-{mm}-01' THEN discount_given END) AS discount_2001_{mm},"
    f" max(CASE WHEN month = DATE '2001-{mm}-01' THEN lift_ratio END) AS lift_2001_{mm}"
    for mm in ("03", "04", "05", "06", "07", "08")
) + " FROM lift GROUP BY 1"

_RAW["promo_incremental_margin"] = f"""
WITH mg AS (SELECT order_id, customer_id, sum(line_margin) AS margin FROM e_fct_items GROUP BY 1, 2),
plain AS (SELECT customer_id, CAST({_ratio('sum(margin)', 'count(*)')} AS DECIMAL(24,6)) AS baseline FROM mg
          WHERE order_id NOT IN (SELECT order_id FROM e_promotion_redemptions) GROUP BY 1),
j AS (SELECT r.promotion_id, m.margin - r.amount_off AS net, baseline
      FROM e_promotion_redemptions r JOIN mg m USING (order_id) JOIN plain ON plain.customer_id = m.customer_id)
SELECT promotion_id, {_b('count(*)')} AS orders, {_d('sum(net)')} AS net_margin,
       CAST(round(sum(baseline), 2) AS DOUBLE) AS baseline_margin,
       {_d('sum(net) - round(sum(baseline), 2)')} AS incremental_margin
FROM j GROUP BY 1"""

_RAW["executive_daily"] = f"""
WITH daily AS ({_DAILY})
SELECT t.*, p.revenue AS revenue_prior, p.orders AS orders_prior, p.aov AS aov_prior,
       p.unique_customers AS unique_customers_prior,
       {_d('(rt.rev - rp.rev)')} / NULLIF(p.revenue, 0) AS revenue_yoy_30d
FROM daily t LEFT JOIN daily p ON p.date + 30 = t.date
LEFT JOIN e_daily_revenue rt ON rt.date = t.date LEFT JOIN e_daily_revenue rp ON rp.date = p.date"""

_RAW["mart_fulfillment_sla"] = f"""
WITH t AS (SELECT carrier, date_sub('hour', o.placed_at, s.delivered_at) AS h
           FROM e_shipments s JOIN e_orders o ON o.id = s.order_id)
SELECT carrier, {_b('count(*)')} AS shipments, {_b('count(h)')} AS delivered,
       {_b('count(*) - count(h)')} AS open_orders, {_ratio('sum(h)', 'count(h)')} AS mean_hours,
       quantile_cont({_d('h')}, 0.5) AS p50_hours, quantile_cont({_d('h')}, 0.9) AS p90_hours
FROM t GROUP BY 1"""

_RAW["churn_features"] = f"""
SELECT customer_id, {_b("DATE '2001-05-03' - max(CASE WHEN order_date <= DATE '2001-05-03' THEN order_date END)")}
         AS recency_days,
       {_b("count(*) FILTER (order_date <= DATE '2001-05-03')")} AS frequency,
       {_d("sum(grand_total) FILTER (order_date <= DATE '2001-05-03')")} AS monetary,
       {_b("CASE WHEN count(*) FILTER (order_date > DATE '2001-05-03') = 0 THEN 1 ELSE 0 END")} AS churned
FROM e_fct_orders WHERE rec AND order_date <= {DAY}
GROUP BY 1 HAVING count(*) FILTER (order_date <= DATE '2001-05-03') > 0"""

_RAW["brand_itemsets"] = f"""
WITH b AS (SELECT DISTINCT i.order_id, p.brand FROM e_order_items i JOIN e_products p ON p.id = i.product_id),
t AS (SELECT count(DISTINCT order_id) AS total FROM b),
sets AS (
  SELECT brand AS brands, 1 AS size FROM b
  UNION ALL SELECT x.brand || '+' || y.brand, 2 FROM b x JOIN b y ON x.order_id = y.order_id AND x.brand < y.brand
  UNION ALL SELECT x.brand || '+' || y.brand || '+' || z.brand, 3
  FROM b x JOIN b y ON x.order_id = y.order_id AND x.brand < y.brand JOIN b z ON z.order_id = x.order_id AND y.brand < z.brand)
SELECT brands, CAST(size AS BIGINT) AS size, {_b('count(*)')} AS n, {_ratio('count(*)', 'any_value(total)')} AS support
FROM sets, t GROUP BY 1, 2 HAVING count(*) >= greatest(2, ceil(any_value(total) * 0.01::DOUBLE))"""

_RAW["mart_product_affinity"] = f"""
WITH b AS (SELECT DISTINCT order_id, product_id FROM e_fct_items),
s AS (SELECT product_id, count(*) AS n FROM b GROUP BY 1),
p AS (SELECT x.product_id AS a, y.product_id AS b, count(*) AS n FROM b x JOIN b y
      ON x.order_id = y.order_id AND x.product_id < y.product_id GROUP BY 1, 2
      HAVING count(*) >= greatest(2, ceil((SELECT count(DISTINCT order_id) FROM b) * 0.0001::DOUBLE))),
t AS (SELECT count(DISTINCT order_id) AS n FROM b)
SELECT p.a AS product_a, p.b AS product_b, {_b('p.n')} AS orders_together, {_ratio('p.n', 't.n')} AS support,
       {_ratio('p.n', 'sa.n')} AS confidence_a_to_b, {_ratio('p.n', 'sb.n')} AS confidence_b_to_a,
       {_ratio('p.n * t.n', 'sa.n * sb.n')} AS lift
FROM p JOIN s sa ON sa.product_id = p.a JOIN s sb ON sb.product_id = p.b, t"""

# ---- in-app analytics ------------------------------------------------------------------------------

_KPI = f"""SELECT {_b('count(*)')} AS orders, {_d('coalesce(sum(grand_total), 0)')} AS revenue,
       coalesce({_ratio('sum(grand_total)', 'count(*)')}, 0.0) AS aov,
       {_b('count(DISTINCT customer_id)')} AS unique_customers
FROM e_orders WHERE {_REC} AND {_win('placed_at', 30)}"""
_RAW["kpi_summary"] = _KPI

_RAW["revenue_by_day"] = f"""
SELECT CAST(placed_at AS DATE) AS day, {_d('sum(grand_total)')} AS revenue, {_b('count(*)')} AS orders
FROM e_orders WHERE {_win('placed_at', 90)} AND status <> 'cancelled' GROUP BY 1"""


def _by(key: str) -> str:
    return f"""SELECT {key}, {_b('count(*)')} AS orders, {_d('sum(grand_total)')} AS revenue,
       {_ratio('sum(grand_total)', 'count(*)')} AS aov
FROM e_orders WHERE {_win('placed_at', 30)} AND status <> 'cancelled' GROUP BY 1"""


_RAW["revenue_by_channel"] = _by("channel")
_RAW["aov_by_device"] = _by("device_type")

_RAW["aov_median"] = f"""
SELECT device_type, channel, {_b('count(*)')} AS orders, {_ratio('sum(grand_total)', 'count(*)')} AS aov,
       quantile_cont({_d('grand_total')}, 0.5) AS median_aov
FROM e_orders WHERE {_win('placed_at', 30)} AND status <> 'cancelled' GROUP BY 1, 2"""


def _top(n: int) -> str:
    return f"""SELECT p.id, p.sku, p.name, p.brand, {_b('sum(quantity)')} AS units, sum(line_revenue) AS rev,
       sum(line_margin) AS gm
FROM e_fct_items i JOIN e_products p ON p.id = i.product_id WHERE {_win('i.placed_at', 30)}
GROUP BY ALL ORDER BY rev DESC, p.id LIMIT {n}"""


_RAW["top_products"] = f"""
SELECT id, sku, name, brand, units, {_d('rev')} AS revenue, {_d('gm')} AS gross_margin FROM ({_top(10)})"""
_RAW["top25_skus"] = f"SELECT sku, {_d('rev')} AS revenue, units, {_d('gm')} AS margin FROM ({_top(25)})"


def _slow(units_from: str, max_units: int) -> str:
    return f"""SELECT p.sku, p.name, p.brand, {_b('coalesce(u.n, 0)')} AS units_sold,
       {_b('coalesce(h.n, 0)')} AS on_hand, {_d('p.price')} AS price, {_d('p.cost')} AS cost
FROM e_products p
LEFT JOIN (SELECT product_id, sum(quantity) AS n FROM {units_from} GROUP BY 1) u ON u.product_id = p.id
LEFT JOIN (SELECT product_id, sum(on_hand) AS n FROM e_inventory_levels il
           JOIN e_product_variants v ON v.id = il.variant_id GROUP BY 1) h ON h.product_id = p.id
WHERE p.is_active AND coalesce(u.n, 0) <= {max_units}
ORDER BY on_hand DESC NULLS LAST, units_sold, p.sku LIMIT 50"""


_SLOW60 = _slow(f"e_fct_items WHERE {_win('placed_at', 60)}", 5)
_RAW["slow_movers"] = f"SELECT * FROM ({_SLOW60})"
_RAW["slow_movers_literal"] = f"SELECT * FROM ({_slow('e_order_items', 600)})"
_RAW["slow_capital"] = f"""
SELECT {_b('count(*)')} AS slow_count, {_d('coalesce(sum(on_hand * CAST(cost AS DECIMAL(12,2))), 0)')} AS slow_capital
FROM ({_SLOW60})"""

_RAW["cart_abandonment"] = f"""
SELECT {_b("count(*) FILTER (status = 'abandoned')")} AS abandoned,
       {_b("count(*) FILTER (status = 'converted')")} AS converted, {_b('count(*)')} AS total,
       round({_ratio("count(*) FILTER (status = 'abandoned')", 'count(*)')}, 4) AS abandonment_rate
FROM e_carts WHERE {_win('created_at', 30)}"""

_RAW["repeat_purchase_rate"] = f"""
WITH c AS (SELECT customer_id, count(*) AS n FROM e_orders
           WHERE {_win('placed_at', 90)} AND status <> 'cancelled' GROUP BY 1)
SELECT {_b('count(*) FILTER (n > 1)')} AS repeat_customers, {_b('count(*)')} AS total_customers,
       round({_ratio('count(*) FILTER (n > 1)', 'count(*)')}, 4) AS repeat_rate FROM c"""

_RAW["gross_margin_by_category"] = f"""
SELECT c.name AS category, {_d('sum(line_revenue)')} AS revenue, {_d('sum(line_margin)')} AS gross_margin,
       {_ratio('sum(line_margin)', 'sum(line_revenue)')} AS margin_pct
FROM e_fct_items i JOIN e_products p ON p.id = i.product_id JOIN e_categories c ON c.id = p.category_id
WHERE {_win('i.placed_at', 30)} GROUP BY 1"""


def _at_risk(units_from: str) -> str:
    return f"""
WITH v AS (SELECT variant_id, {_d('sum(quantity)')} / 28 AS r FROM {units_from} GROUP BY 1),
j AS (SELECT p.sku, p.name, pv.size, pv.color, il.on_hand, il.reorder_point, v.r AS units_per_day,
             {_b('round_even(il.on_hand / v.r, 0)')} AS days_of_cover, il.variant_id, il.warehouse_code
      FROM e_inventory_levels il JOIN e_product_variants pv ON pv.id = il.variant_id
      JOIN e_products p ON p.id = pv.product_id JOIN v ON v.variant_id = pv.id
      WHERE v.r > 0 AND il.on_hand / v.r < 14
      ORDER BY days_of_cover, il.variant_id, il.warehouse_code LIMIT 50)
SELECT sku, name, size, color, on_hand, reorder_point, units_per_day, days_of_cover FROM j"""


_RAW["stockouts_at_risk"] = _at_risk(f"e_fct_items WHERE {_win('placed_at', 28)}")
_RAW["stockouts_at_risk_literal"] = _at_risk("e_order_items")

_FUNNEL = f"""
SELECT {_b(f"(SELECT count(*) FROM e_product_events WHERE event_type = 'view' AND {_win('occurred_at', 30)})")} AS views,
       {_b(f"(SELECT count(*) FROM e_product_events WHERE event_type = 'add_to_cart' AND {_win('occurred_at', 30)})")}
         AS add_to_cart,
       {_b(f"(SELECT count(*) FROM e_carts WHERE status IN ('abandoned','converted') AND {_win('created_at', 30)})")}
         AS started_checkout,
       {_b(f"(SELECT count(*) FROM e_orders WHERE status <> 'cancelled' AND {_win('placed_at', 30)})")} AS purchased"""
_RAW["funnel_last_30d"] = _FUNNEL

# ---- metric layer -----------------------------------------------------------------------------------

_RAW["metric_orders"] = f"""
SELECT channel, status, utm_source, {_b('count(*)')} AS count, {_d('sum(grand_total)')} AS revenue,
       {_ratio('sum(grand_total)', 'count(*)')} AS aov, {_d('sum(discount_total)')} AS discount,
       {_b('count(DISTINCT customer_id)')} AS unique_customers
FROM e_orders WHERE status <> 'cancelled' GROUP BY 1, 2, 3"""

_RAW["metric_repeat"] = f"""
WITH c AS (SELECT customer_id, count(*) AS n FROM e_orders WHERE status <> 'cancelled' GROUP BY 1)
SELECT {_b('count(*) - count(*) FILTER (n = 1)')} AS repeat_customers, {_b('count(*)')} AS unique_customers,
       {_ratio('count(*) - count(*) FILTER (n = 1)', 'count(*)')} AS repeat_rate FROM c"""

_ITEM = f"""sum(quantity * unit_price) AS rev, sum(quantity * unit_cost) AS cst,
       sum(quantity * (unit_price - unit_cost)) AS gm, {_b('sum(quantity)')} AS units"""

_RAW["metric_items"] = f"""
SELECT brand, units, {_d('rev')} AS revenue, {_d('cst')} AS cost, {_d('gm')} AS gross_margin,
       {_ratio('gm', 'rev')} AS margin_pct
FROM (SELECT p.brand, {_ITEM} FROM e_order_items i LEFT JOIN e_products p ON p.id = i.product_id GROUP BY 1)"""

_RAW["metric_products"] = f"""
SELECT category_name, {_b('count(*)')} AS count, {_b('count(*) FILTER (is_active)')} AS active_count,
       round(avg({_ratio('list_price - list_cost', 'list_price')}), 6) AS list_margin_pct_avg
FROM e_dim_product GROUP BY 1"""

_LIFETIME = "(SELECT customer_id, sum(grand_total) AS v FROM e_orders GROUP BY 1) l ON l.customer_id = c.id"
_RAW["metric_customers"] = f"""
SELECT signup_channel, signup_country, {_b('count(*)')} AS count, {_d('sum(coalesce(v, 0))')} AS lifetime_revenue
FROM e_customers c LEFT JOIN {_LIFETIME} GROUP BY 1, 2"""
_RAW["metric_customers_optin"] = f"""
SELECT signup_channel, {_b('count(*)')} AS count, {_d('sum(coalesce(v, 0))')} AS lifetime_revenue
FROM e_customers c LEFT JOIN {_LIFETIME} WHERE marketing_opt_in GROUP BY 1"""
_RAW["metric_customers_by_order_channel"] = f"""
WITH pairs AS (SELECT DISTINCT c.id, o.channel FROM e_customers c
               LEFT JOIN e_orders o ON o.customer_id = c.id AND o.status <> 'cancelled')
SELECT pairs.channel, {_b('count(*)')} AS count, {_d('sum(coalesce(v, 0))')} AS lifetime_revenue
FROM pairs JOIN e_customers c ON c.id = pairs.id LEFT JOIN {_LIFETIME} GROUP BY 1"""
_RAW["metric_orders_and_items"] = f"""
WITH o AS (SELECT device_type, {_d('sum(grand_total)')} AS orders_revenue FROM e_orders
           WHERE status <> 'cancelled' GROUP BY 1),
i AS (SELECT o.device_type, {_b('sum(quantity)')} AS units, {_d('sum(quantity * unit_price)')} AS orderitems_revenue
      FROM e_order_items i LEFT JOIN e_orders o ON o.id = i.order_id AND o.status <> 'cancelled' GROUP BY 1)
SELECT coalesce(o.device_type, i.device_type) AS device_type, orders_revenue, units, orderitems_revenue
FROM o FULL JOIN i ON o.device_type IS NOT DISTINCT FROM i.device_type"""

_CARTS = f"""{_b('count(*)')} AS count, {_b("count(*) FILTER (status = 'abandoned')")} AS abandoned"""
_RATE = _ratio("count(*) FILTER (status = 'abandoned')", "count(*)")
_RAW["metric_carts"] = f"""
SELECT CAST(created_at AS DATE) AS day, {_CARTS}, {_b("count(*) FILTER (status = 'converted')")} AS converted,
       {_RATE} AS abandonment_rate FROM e_carts GROUP BY 1"""

_ROLLUP = f"""
SELECT CAST(placed_at AS DATE) AS day, channel, device_type, {_b('count(*)')} AS count,
       {_d('sum(grand_total)')} AS revenue, {_b('count(DISTINCT customer_id)')} AS unique_customers,
       {_ratio('sum(grand_total)', 'count(*)')} AS aov
FROM e_orders WHERE status <> 'cancelled' GROUP BY 1, 2, 3"""
_RAW["rollup_daily"] = _ROLLUP

_RAW["rollup_daily_cube"] = f"""
SELECT {_b('grouping(channel, device_type)')} AS level, channel, device_type, {_b('count(*)')} AS count,
       {_d('sum(grand_total)')} AS revenue, {_ratio('sum(grand_total)', 'count(*)')} AS aov
FROM e_orders WHERE status <> 'cancelled' GROUP BY ROLLUP (channel, device_type)"""

_RAW["metric_items_by_country"] = f"""
SELECT c.signup_country, o.device_type, {_b('sum(i.quantity)')} AS units, {_d('sum(i.quantity * i.unit_price)')} AS revenue
FROM e_order_items i JOIN e_orders o ON o.id = i.order_id AND o.status <> 'cancelled' LEFT JOIN e_customers c ON c.id = o.customer_id
GROUP BY 1, 2
UNION ALL
SELECT NULL, NULL, {_b('sum(i.quantity)')}, {_d('sum(i.quantity * i.unit_price)')}
FROM e_order_items i WHERE i.order_id NOT IN (SELECT id FROM e_orders WHERE status <> 'cancelled') HAVING count(*) > 0"""
_RAW["metric_date_ranges"] = f"""
SELECT period, CAST(placed_at AS DATE) AS day, {_b('count(*)')} AS count
FROM e_orders JOIN (VALUES ('last 7 days', {DAY} - 7, {DAY} - 1), ('today', {DAY}, {DAY}),
                           ('2001-01-01 to 2001-03-31', DATE '2001-01-01', DATE '2001-03-31')) p(period, a, b)
  ON CAST(placed_at AS DATE) BETWEEN a AND b
WHERE status <> 'cancelled' GROUP BY 1, 2"""
_RAW["metric_prepared"] = f"""
SELECT channel, CAST(date_trunc('month', placed_at) AS DATE) AS month, {_b('count(*)')} AS count, {_d('sum(grand_total)')} AS revenue,
       {_d('sum(discount_total)')} AS discount, {_ratio('sum(grand_total)', 'count(grand_total)')} AS aov
FROM e_orders WHERE status <> 'cancelled' GROUP BY 1, 2"""
_RAW["metric_prepared_window"] = f"""
SELECT device_type, CAST(date_trunc('week', placed_at) AS DATE) AS week, {_d('sum(grand_total)')} AS revenue,
       {_ratio('sum(grand_total)', 'count(grand_total)')} AS aov
FROM e_orders WHERE status <> 'cancelled' AND CAST(placed_at AS DATE) BETWEEN {DAY} - 90 AND {DAY} - 1 GROUP BY 1, 2"""
_RAW["metric_prepared_sketches"] = f"""
SELECT channel, {_b('count(*)')} AS count, true AS median_in_bound, true AS customers_in_bound
FROM e_orders WHERE status <> 'cancelled' GROUP BY 1"""

_L30 = "BETWEEN DATE '2001-07-02' AND DATE '2001-07-31'"
_RAW["sq_daily_revenue"] = f"""
SELECT CAST(placed_at AS DATE) AS day, {_d('sum(grand_total)')} AS revenue, {_b('count(*)')} AS count
FROM e_orders WHERE status <> 'cancelled'
  AND CAST(placed_at AS DATE) BETWEEN DATE '2001-05-03' AND DATE '2001-07-31' GROUP BY 1"""

_SOLD30 = f"""e_order_items i JOIN e_orders o ON o.id = i.order_id AND o.status <> 'cancelled'
     AND CAST(o.placed_at AS DATE) {_L30} LEFT JOIN e_dim_product p ON p.product_id = i.product_id"""
_RAW["sq_top_skus"] = f"""
SELECT sku, name, brand, {_d('rev')} AS revenue, units, {_d('gm')} AS gross_margin
FROM (SELECT p.sku, p.name, p.brand, {_ITEM} FROM {_SOLD30} GROUP BY 1, 2, 3) ORDER BY rev DESC, sku LIMIT 10"""
_RAW["sq_margin_category"] = f"""
SELECT category_name, {_d('rev')} AS revenue, {_d('gm')} AS gross_margin, {_ratio('gm', 'rev')} AS margin_pct
FROM (SELECT p.category_name, {_ITEM} FROM {_SOLD30} GROUP BY 1)"""
_RAW["sq_aov_device"] = f"""
SELECT device_type, {_ratio('sum(grand_total)', 'count(*)')} AS aov, {_b('count(*)')} AS count
FROM e_orders WHERE status <> 'cancelled' AND CAST(placed_at AS DATE) {_L30} GROUP BY 1"""
_RAW["sq_abandonment"] = f"""
SELECT {_RATE} AS abandonment_rate, {_CARTS} FROM e_carts WHERE CAST(created_at AS DATE) {_L30}"""

# ---- reports ----------------------------------------------------------------------------------------

_CHANGE = _pct("current - prior", "prior")
_DELTA = f"abs({_CHANGE}) AS delta_pct, CASE WHEN {_CHANGE} >= 0 THEN 'up' ELSE 'down' END AS direction"


def _kpi_rows(offset: int) -> str:
    return f"""SELECT {_d('coalesce(sum(grand_total), 0)')} AS revenue, {_d('count(*)')} AS orders,
       coalesce({_ratio('sum(grand_total)', 'count(*)')}, 0.0) AS aov,
       {_d('count(DISTINCT customer_id)')} AS unique_customers
FROM e_orders WHERE {_REC} AND {_win('placed_at', 30, offset)}"""


_RAW["kpi_period_delta"] = f"""
WITH a AS ({_kpi_rows(0)}), b AS ({_kpi_rows(30)}),
r AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS metric, a.{c} AS current, b.{c} AS prior FROM a, b"
    for c in ("revenue", "orders", "aov", "unique_customers")
) + f") SELECT metric, current, prior, {_DELTA} FROM r"


def _repeat(offset: int) -> str:
    return f"""SELECT round({_ratio('count(*) FILTER (n > 1)', 'count(*)')}, 4) AS r FROM
      (SELECT customer_id, count(*) AS n FROM e_orders
       WHERE {_win('placed_at', 90, offset)} AND status <> 'cancelled' GROUP BY 1)"""


_RAW["repeat_rate_delta"] = f"""
WITH x AS (SELECT ({_repeat(0)}) AS current, ({_repeat(90)}) AS prior)
SELECT current AS repeat_rate, prior AS prior_rate, {_DELTA} FROM x"""

_RAW["channel_share"] = f"""
WITH c AS (SELECT channel, sum(grand_total) AS rev FROM e_orders
           WHERE {_win('placed_at', 30)} AND status <> 'cancelled' GROUP BY 1),
r AS (SELECT channel, {_d('rev')} AS revenue, {_pct('rev', 'sum(rev) OVER ()')} AS share,
             {_b('row_number() OVER (ORDER BY rev DESC, channel)')} AS rank FROM c)
SELECT *, round(sum(share) FILTER (rank <= 3) OVER (), 1) AS top3_share FROM r"""

_RAW["product_concentration"] = f"""
WITH t AS (SELECT sum(rev) AS top_revenue FROM ({_top(10)})), k AS ({_KPI})
SELECT {_d('top_revenue')} AS top_revenue, revenue AS total_revenue, {_pct('top_revenue', 'revenue')} AS share_pct
FROM t, k"""

_RAW["best_aov_channel"] = f"""
WITH c AS ({_by('channel')}), k AS ({_KPI})
SELECT c.channel, c.aov, k.aov AS book_aov, (c.aov - k.aov) * 100 AS uplift_per_100
FROM c, k ORDER BY c.aov DESC, c.revenue DESC LIMIT 1"""

_RAW["funnel_drops"] = f"""
WITH f AS ({_FUNNEL}),
st AS (SELECT 1 AS position, 'views' AS step, views AS n, views AS base, NULL AS prev FROM f
       UNION ALL SELECT 2, 'add_to_cart', add_to_cart, views, views FROM f
       UNION ALL SELECT 3, 'purchased', purchased, views, add_to_cart FROM f),
r AS (SELECT {_b('position')} AS position, step, n, {_pct('n', 'base')} AS share_pct,
             CASE WHEN prev IS NOT NULL THEN {_pct('prev - n', 'prev')} END AS drop_pct FROM st)
SELECT *, position = (SELECT position FROM r WHERE drop_pct IS NOT NULL ORDER BY drop_pct DESC, position LIMIT 1)
          AS is_worst FROM r"""

_RAW["funnel_point_value"] = f"""
WITH f AS ({_FUNNEL}), k AS ({_KPI})
SELECT {_d('views')} * 0.01::DOUBLE * coalesce({_ratio('purchased', 'add_to_cart')}, 0.0) * aov AS point_value FROM f, k"""

_RAW["kpi_mtd"] = f"""
SELECT {_d('coalesce(sum(grand_total), 0)')} AS revenue, {_b('count(*)')} AS orders,
       coalesce({_ratio('sum(grand_total)', 'count(*)')}, 0.0) AS aov
FROM e_fct_orders WHERE rec AND order_date BETWEEN DATE '2001-08-01' AND {DAY}"""

_RAW["category_vs_prior"] = f"""
SELECT category_name AS category, {_d(f"coalesce(sum(line_revenue) FILTER (order_date > {DAY} - 30), 0)")} AS current,
       {_d(f"coalesce(sum(line_revenue) FILTER (order_date <= {DAY} - 30), 0)")} AS prior
FROM e_fct_items JOIN e_dim_product USING (product_id)
WHERE order_date > {DAY} - 60 AND order_date <= {DAY} GROUP BY 1"""

_RAW["velocity_heatmap"] = (
    "SELECT sku, "
    + ", ".join(
        f"CAST(coalesce(sum(quantity) FILTER (order_date > {DAY} - {7 * (13 - w)} AND order_date <= {DAY} - {7 * (12 - w)}), 0)"
        f" AS BIGINT) AS w{w}"
        for w in range(1, 13)
    )
    + f" FROM e_fct_items JOIN e_dim_product USING (product_id) WHERE order_date > {DAY} - 84 AND order_date <= {DAY}"
    " GROUP BY product_id, sku"
)

_RAW["wow_same_weekday"] = f"""
WITH days AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
              FROM e_daily_revenue),
x AS (SELECT days.date, coalesce(rev, 0) AS rev, lag(coalesce(rev, 0), 7) OVER (ORDER BY days.date) AS p
      FROM days LEFT JOIN e_daily_revenue r ON r.date = days.date),
y AS (SELECT date, {_d('rev')} AS revenue, {_d('p')} AS same_weekday_prior,
             round({_ratio('rev - p', 'p')} * 100, 1) AS wow_pct FROM x)
SELECT *, coalesce(wow_pct < -15.0, false) AS is_alert FROM y"""

_RAW["abandonment_trend"] = f"""
WITH dev AS (SELECT session_id, arg_min(device_type, (occurred_at, id)) AS device_type FROM e_page_views GROUP BY 1)
SELECT CAST(date_trunc('week', created_at) AS DATE) AS week, coalesce(device_type, 'unknown') AS device_type,
       {_b('count(*)')} AS carts, {_b("count(*) FILTER (status = 'abandoned')")} AS abandoned,
       round({_RATE}, 4) AS abandonment_rate
FROM e_carts LEFT JOIN dev USING (session_id) GROUP BY 1, 2"""

# ---- forecasts --------------------------------------------------------------------------------------

_SERIES = f"""
hist AS (SELECT i.order_date AS date, p.category_name, sum(line_revenue) AS revenue
         FROM e_fct_items i JOIN e_dim_product p USING (product_id)
         WHERE i.placed_at >= {TS} - to_days(540) AND p.category_name IS NOT NULL GROUP BY 1, 2),
series AS (SELECT category_name, date, revenue FROM hist
           UNION ALL SELECT '__total__', date, sum(revenue) FROM hist GROUP BY date)"""

_WEEKDAY = "date_diff('day', DATE '1970-01-01', date)"
_YEARS = "(date_diff('day', DATE '2000-01-01', date)::DOUBLE / 365.25::DOUBLE)"
_WAVE = {f"{f[0]}{k}": f"{f}(2 * pi() * {k} * {_WEEKDAY} / 365.25::DOUBLE)" for k in range(1, 9) for f in ("sin", "cos")}
_SUMMAND = {"t": _YEARS, "tt": f"{_YEARS} * {_YEARS}", "y": "revenue::DOUBLE", "ty": f"{_YEARS} * revenue::DOUBLE"} | _WAVE
_SUMMAND |= {f"t{n}": f"{_YEARS} * {w}" for n, w in _WAVE.items() if int(n[1:]) <= 4}
_SUMMAND |= {f"y{n}": f"revenue::DOUBLE * {w}" for n, w in _WAVE.items() if int(n[1:]) <= 4}
_RAW["forecast_sums"] = f"""
WITH {_SERIES},
d AS (SELECT category_name, {_WEEKDAY} % 7 AS weekday, unnest([{', '.join(f"'{n}'" for n in _SUMMAND)}]) AS term,
             unnest([{', '.join(_SUMMAND.values())}]) AS x FROM series)
SELECT category_name, {_b('weekday')} AS weekday, {_b('count(*)')} AS n, term,
       round(sum(x), CASE WHEN contains(term, 'y') THEN 2 ELSE 6 END) AS total
FROM d GROUP BY category_name, weekday, term"""

_Z = "1.2815515655446004::DOUBLE"
_T = "date_diff('day', DATE '2000-01-01', {})"


def _baseline(source: str, keys: str, p: str = "") -> str:
    """Fit, residuals and forecast of `source`; names carry the prefix `p`."""
    t = _T.format("date")
    level = "(f.intercept + f.slope * CAST({t} AS DOUBLE) + f.weekday)"
    on_res = " AND ".join(f"s.{k} = f.{k}" for k in keys.split(", "))
    on_fc = " AND ".join(f"f.{k} = a.{k}" for k in keys.split(", "))
    on_sp = " AND ".join(f"sp.{k} = a.{k}" for k in keys.split(", "))
    cols = ", ".join(f"a.{k}" for k in keys.split(", "))
    scols = ", ".join(f"s.{k}" for k in keys.split(", "))
    return f"""
{p}w AS (SELECT {keys}, dayofweek(date) AS dow, count(*) AS n, sum({t}) AS st, sum({t} * {t}) AS stt,
              sum(revenue) AS sy, sum({t} * revenue) AS sty, max(date) AS last FROM {source} GROUP BY {keys}, dow),
{p}a AS (SELECT {keys}, {_d('sum(n)')} AS n, {_d('sum(st)')} AS st, {_d('sum(stt)')} AS stt, {_d('sum(sy)')} AS sy,
              {_d('sum(sty)')} AS sty, max(last) AS last FROM {p}w GROUP BY {keys}),
{p}l AS (SELECT *, coalesce((n * sty - st * sy) / NULLIF(n * stt - st * st, 0), 0.0) AS slope FROM {p}a),
{p}i AS (SELECT *, (sy - slope * st) / n AS intercept FROM {p}l),
{p}f AS (SELECT {', '.join(f'i.{k}' for k in keys.split(', '))}, w.dow, i.last, i.slope, i.intercept,
              {_d('w.sy')} / {_d('w.n')} - i.intercept - i.slope * {_d('w.st')} / {_d('w.n')} AS weekday
       FROM {p}i i JOIN {p}w w USING ({keys})),
{p}res AS (SELECT {scols}, s.date, {_d('s.revenue')} - {level.format(t=_T.format('s.date'))} AS exact,
                round({_d('s.revenue')} - {level.format(t=_T.format('s.date'))}, 4) AS resid
         FROM {source} s JOIN {p}f f ON {on_res} AND f.dow = dayofweek(s.date)),
{p}sp AS (SELECT {keys}, sqrt(sum(exact * exact) / count(*)) AS spread FROM {p}res GROUP BY {keys}),
{p}ahead AS (SELECT {keys}, CAST(last + CAST(h AS INTEGER) AS DATE) AS forecast_date
           FROM {p}a, (SELECT unnest(generate_series(1, 30)) AS h)),
{p}fc AS (SELECT {cols}, a.forecast_date, {level.format(t=_T.format('a.forecast_date'))} AS y, spread
        FROM {p}ahead a JOIN {p}f f ON {on_fc} AND f.dow = dayofweek(a.forecast_date) JOIN {p}sp sp ON {on_sp}),
{p}forecast AS (SELECT {keys}, forecast_date, round(y, 2) AS yhat, round(y - {_Z} * spread, 2) AS yhat_lower,
                     round(y + {_Z} * spread, 2) AS yhat_upper FROM {p}fc)"""


_BASE = f"{_SERIES}, {_baseline('series', 'category_name')}"

_RAW["forecast_history"] = f"WITH {_SERIES} SELECT date, category_name, {_d('revenue')} AS revenue FROM hist"
_RAW["forecast_series"] = f"WITH {_SERIES} SELECT category_name, date, {_d('revenue')} AS revenue FROM series"
_RAW["forecast_baseline"] = f"WITH {_BASE} SELECT * FROM forecast"
_RAW["forecast_totals"] = f"""WITH {_BASE}
SELECT {_b('count(*)')} AS days, round(sum(yhat), 2) AS total, round(sum(yhat_lower), 2) AS low,
       round(sum(yhat_upper), 2) AS high, max(yhat) AS peak, min(yhat) AS trough
FROM forecast WHERE category_name = '__total__'"""
_RAW["forecast_7d"] = f"""WITH {_BASE}
SELECT forecast_date, """ + ", ".join(
    f"max(yhat) FILTER (category_name = '{c}') AS \"{c}\""
    for c in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "__total__")
) + """ FROM forecast WHERE forecast_date BETWEEN DATE '2001-08-02' AND DATE '2001-08-08' GROUP BY 1"""
_RAW["forecast_overlay"] = f"""WITH {_BASE}
SELECT forecast_date AS date, category_name, yhat, yhat_lower, yhat_upper, {TS} AS model_run_at FROM forecast"""
_RAW["residual_hist"] = f"""WITH {_BASE},
top AS (SELECT resid, min(resid) OVER () AS lo, max(resid) OVER () AS hi FROM res WHERE category_name = '__total__')
SELECT {_b("least(coalesce(floor((resid - lo) * 40 / NULLIF(hi - lo, 0)), 0), 39)")} AS bin, {_b('count(*)')} AS n
FROM top GROUP BY 1"""

_RAW["walk_forward_baseline"] = f"""WITH {_SERIES},
num AS (SELECT *, row_number() OVER (PARTITION BY category_name ORDER BY date) AS i,
               count(*) OVER (PARTITION BY category_name) AS len FROM series),
sp4 AS (SELECT num.*, k AS split, len - k * 30 AS cut FROM num, (SELECT unnest([1, 2, 3, 4]) AS k)
        WHERE len - k * 30 >= 60),
train AS (SELECT category_name, split, date, revenue FROM sp4 WHERE i <= cut),
test AS (SELECT category_name, split, date, {_d('revenue')} AS y FROM sp4 WHERE i > cut AND i <= cut + 30),
{_baseline('train', 'category_name, split', 'b_')}
SELECT category_name, CAST(split AS BIGINT) AS split, {_b('count(*)')} AS n_test,
       round(avg(abs(y - yhat) / NULLIF(y, 0)), 4) AS mape,
       round(avg(CASE WHEN y >= yhat_lower AND y <= yhat_upper THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS coverage_80
FROM test JOIN b_forecast USING (category_name, split) WHERE b_forecast.forecast_date = test.date
GROUP BY 1, 2"""

_RAW["forecast_cover"] = f"""WITH {_BASE},
sold AS (SELECT i.product_id, p.sku, p.category_name, sum(quantity) AS units, sum(line_revenue) AS rev
         FROM e_fct_items i JOIN e_dim_product p USING (product_id)
         WHERE order_date BETWEEN {DAY} - 84 AND {DAY} GROUP BY 1, 2, 3),
cat AS (SELECT category_name, sum(rev) AS crev FROM sold GROUP BY 1),
run AS (SELECT category_name, {_d('sum(CAST(greatest(yhat, 0.0::DOUBLE) AS DECIMAL(18,2))) OVER (PARTITION BY category_name ORDER BY forecast_date)')}
          AS cum FROM forecast WHERE category_name <> '__total__'),
stock AS (SELECT v.product_id, sum(on_hand) AS on_hand FROM e_inventory_levels il
          JOIN e_product_variants v ON v.id = il.variant_id GROUP BY 1),
j AS (SELECT s.*, cat.crev, on_hand, {_d('on_hand')} * {_d('crev')} / {_d('units')} AS runs_out
      FROM sold s JOIN cat USING (category_name) JOIN stock USING (product_id))
SELECT j.product_id, j.sku, j.category_name, {_b('on_hand')} AS on_hand, {_ratio('units', 'crev')} AS units_per_revenue,
       {_b('(SELECT count(*) FROM run WHERE run.category_name = j.category_name AND cum <= j.runs_out)')} AS days_of_cover,
       (SELECT count(*) FROM run WHERE run.category_name = j.category_name AND cum <= j.runs_out) = 30 AS lasts_horizon
FROM j"""

# ---- timelines and bulk jobs ------------------------------------------------------------------------

_RAW["events_hourly"] = f"""
SELECT date_trunc('hour', occurred_at) AS hour, event_type, {_b('count(*)')} AS n FROM e_product_events GROUP BY 1, 2"""

_RAW["sessionize"] = f"""
WITH g AS (SELECT *, CASE WHEN occurred_at - lag(occurred_at) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s
           FROM e_shop_events WINDOW w AS (PARTITION BY user_id ORDER BY occurred_at, id)),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY occurred_at, id) AS session FROM g)
SELECT user_id, min(occurred_at) AS session_start, max(occurred_at) AS session_end, {_b('count(*)')} AS n_events,
       CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'converted'
            WHEN count(*) FILTER (event_type = 'add_to_cart') > 0 THEN 'abandoned' ELSE 'browsing' END AS status
FROM n GROUP BY user_id, session"""

_RAW["stock_running"] = f"""
WITH d AS (SELECT variant_id, warehouse_code, occurred_at, sum(delta) AS delta FROM e_stock_movements GROUP BY 1, 2, 3)
SELECT variant_id, warehouse_code, occurred_at, {_b('delta')} AS delta,
       {_b('sum(delta) OVER (PARTITION BY variant_id, warehouse_code ORDER BY occurred_at)')} AS on_hand FROM d"""


def _half_even(n: str, d: int) -> str:
    """n / d as a whole number, ties to even, for n >= 0."""
    return (
        f"(({n}) // {d} + CASE WHEN ({n}) % {d} * 2 > {d} OR (({n}) % {d} * 2 = {d} AND (({n}) // {d}) % 2 = 1)"
        " THEN 1 ELSE 0 END)"
    )


_RAW["order_pricing"] = f"""
WITH bad AS (SELECT DISTINCT i.order_id FROM e_order_items i LEFT JOIN e_products p ON p.id = i.product_id
             WHERE p.is_active IS NULL OR NOT p.is_active),
st AS (SELECT i.order_id, {_b('sum(i.quantity * CAST(p.price * 100 AS BIGINT))')} AS sub FROM e_order_items i
       JOIN e_products p ON p.id = i.product_id
       WHERE i.order_id NOT IN (SELECT order_id FROM bad) GROUP BY 1),
x AS (SELECT st.*, pr.kind, CAST(pr.value * 100 AS BIGINT) AS v FROM st
      LEFT JOIN e_promotion_redemptions r ON r.order_id = st.order_id LEFT JOIN e_promotions pr ON pr.id = r.promotion_id),
y AS (SELECT *, CASE WHEN kind = 'percent' THEN {_half_even('sub * v', 10000)}
                     WHEN kind IS NOT NULL THEN least(sub, v) ELSE 0 END AS disc,
             CASE WHEN sub > 7500 THEN 0 ELSE 999 END AS ship FROM x),
z AS (SELECT *, {_half_even('(sub - disc) * 8', 100)} AS tax FROM y)
SELECT order_id, sub / 100.0::DOUBLE AS subtotal, disc / 100.0::DOUBLE AS discount, ship / 100.0::DOUBLE AS shipping,
       tax / 100.0::DOUBLE AS tax, (sub - disc + ship + tax) / 100.0::DOUBLE AS grand_total FROM z"""

_RAW["order_rejects"] = """
SELECT DISTINCT i.order_id, i.product_id,
       CASE WHEN p.id IS NULL THEN 'missing_product' ELSE 'inactive_product' END AS reason
FROM e_order_items i LEFT JOIN e_products p ON p.id = i.product_id WHERE p.id IS NULL OR NOT p.is_active"""

_RAW["cart_totals"] = f"""
WITH c AS (SELECT k.id AS cart_id, {_b('coalesce(sum(quantity), 0)')} AS item_count,
                  {_b('coalesce(sum(quantity * CAST(unit_price * 100 AS BIGINT)), 0)')} AS sub
           FROM e_carts k LEFT JOIN e_cart_items i ON i.cart_id = k.id GROUP BY 1),
t AS (SELECT *, CASE WHEN sub > 7500 THEN 0 ELSE 999 END AS ship, {_half_even('sub * 8', 100)} AS tax FROM c)
SELECT cart_id, item_count, sub / 100.0::DOUBLE AS subtotal, ship / 100.0::DOUBLE AS shipping,
       tax / 100.0::DOUBLE AS tax, (sub + ship + tax) / 100.0::DOUBLE AS grand_total FROM t"""

_RAW["cart_merge"] = f"""
SELECT session_id, product_id, variant_id, {_b('sum(quantity)')} AS quantity
FROM e_cart_items i JOIN e_carts c ON c.id = i.cart_id GROUP BY 1, 2, 3"""

_RAW["identity_stitch"] = """
WITH own AS (SELECT session_id, arg_max(customer_id, (occurred_at, id)) AS seen FROM e_product_events
             WHERE customer_id IS NOT NULL GROUP BY 1)
SELECT id AS cart_id, session_id,
       CASE WHEN customer_id IS NULL AND status = 'active' THEN seen ELSE customer_id END AS customer_id,
       customer_id IS NULL AND status = 'active' AND seen IS NOT NULL AS was_claimed
FROM e_carts LEFT JOIN own USING (session_id)"""

_RAW["stock_moves_from_sales"] = """
SELECT variant_id, -quantity AS delta, 'sale' AS reason, order_id AS ref_order_id FROM e_order_items
WHERE variant_id IS NOT NULL"""

_RAW["catalog_search"] = f"""
SELECT id, sku, name, brand, {_d('price')} AS price FROM e_products WHERE is_active AND name ILIKE '%RING%'
ORDER BY id LIMIT 50 OFFSET 10"""

_RAW["order_history"] = f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY placed_at DESC, id DESC) AS position FROM e_orders)
SELECT customer_id, r.id AS order_id, {_b('position')} AS position, CAST(placed_at AS DATE) AS placed_on, status,
       {_d('grand_total')} AS grand_total, product_id, variant_id, quantity, {_d('unit_price')} AS unit_price
FROM r LEFT JOIN e_order_items i ON i.order_id = r.id WHERE position <= 5"""

_RAW["order_audit"] = f"""
WITH l AS (SELECT order_id, sum(quantity * unit_price) AS s FROM e_order_items GROUP BY 1),
j AS (SELECT o.id AS order_id, o.subtotal AS stored, coalesce(l.s, 0) AS recomputed,
             o.subtotal - coalesce(l.s, 0) AS diff, p.amount - o.grand_total AS payment_diff
      FROM e_orders o LEFT JOIN l ON l.order_id = o.id LEFT JOIN e_payments p ON p.order_id = o.id)
SELECT order_id, {_d('stored')} AS stored, {_d('recomputed')} AS recomputed, {_d('diff')} AS diff,
       {_d('payment_diff')} AS payment_diff FROM j WHERE diff <> 0 OR payment_diff <> 0"""


def _dup(t: str, c: str) -> str:
    return f"""SELECT 'unique {c}' AS "check", '{t}' AS "table", {_b('count(*)')} AS n_bad
FROM (SELECT {c} FROM e_{t} GROUP BY 1 HAVING count(*) > 1)"""


def _fk(t: str, c: str, parent: str) -> str:
    return f"""SELECT 'fk {c}', '{t}', {_b('count(*)')} FROM e_{t} x
WHERE x.{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e_{parent} y WHERE y.id = x.{c})"""


def _acc(t: str, c: str, values: str) -> str:
    return f"""SELECT 'accepted {c}', '{t}', {_b('count(*)')} FROM e_{t} WHERE {c} IS NULL OR {c} NOT IN ({values})"""


_RAW["dq_checks"] = "\nUNION ALL\n".join([
    _dup("orders", "order_number"),
    _dup("products", "sku"),
    _dup("promotions", "code"),
    _dup("payments", "order_id"),
    _fk("orders", "customer_id", "customers"),
    _fk("order_items", "order_id", "orders"),
    _fk("order_items", "product_id", "products"),
    _fk("order_items", "variant_id", "product_variants"),
    _fk("product_variants", "product_id", "products"),
    _fk("promotion_redemptions", "order_id", "orders"),
    _acc("orders", "status", "'pending','paid','fulfilled','shipped','delivered','cancelled','refunded'"),
    _acc("carts", "status", "'active','abandoned','converted'"),
    _acc("product_events", "event_type", "'view','add_to_cart','remove_from_cart','wishlist'"),
])


_CATALOG = f"SELECT id, sku, name, brand, {_d('price')} AS price FROM e_products WHERE is_active"
_RAW["catalog_by_category"] = f"""{_CATALOG}
 AND category_id = (SELECT id FROM e_categories ORDER BY name LIMIT 1) ORDER BY id LIMIT 20"""
_RAW["featured_products"] = f"{_CATALOG} ORDER BY id LIMIT 8"

_CODES = """
codes AS (SELECT r.order_id, CASE WHEN r.order_id % 150 = 1 THEN 'NOPE' ELSE p.code END AS code
          FROM e_promotion_redemptions r JOIN e_promotions p ON p.id = r.promotion_id
          UNION ALL SELECT order_id, 'SECOND' FROM e_promotion_redemptions WHERE order_id % 150 = 0),
per AS (SELECT order_id, min(code) AS code, count(DISTINCT code) AS n FROM codes GROUP BY 1),
why AS (SELECT order_id, CASE WHEN n > 1 THEN 'several_codes' WHEN code = 'BFCM30' THEN 'ambiguous_promo'
                              WHEN code NOT IN (SELECT code FROM e_promotions) THEN 'invalid_promo' END AS reason FROM per)"""
_RAW["order_rejects_codes"] = f"WITH {_CODES} SELECT order_id, reason FROM why WHERE reason IS NOT NULL"
_RAW["order_pricing_codes"] = f"""WITH {_CODES}
SELECT * FROM ({_RAW['order_pricing']}) WHERE order_id NOT IN (SELECT order_id FROM why WHERE reason IS NOT NULL)"""

# ---- scores and bounds -------------------------------------------------------------------------------

_WEEK = f"""
pairs AS (SELECT s.category_name, s.date, {_d('s.revenue')} AS y, {_d('b.revenue')} AS yhat
          FROM series s JOIN series b ON b.category_name = s.category_name AND s.date = b.date + 7)"""
_RAW["forecast_errors"] = f"""WITH {_SERIES}, {_WEEK}
SELECT category_name, {_b('count(*)')} AS n_test, round(avg(abs(y - yhat) / NULLIF(y, 0)), 4) AS mape,
       round(avg(CASE WHEN y >= yhat * 0.5::DOUBLE AND y <= yhat * 1.5::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS coverage_80
FROM pairs GROUP BY 1"""
_RAW["forecast_alert"] = f"""WITH {_SERIES}, {_WEEK},
months AS (SELECT category_name, CAST(date_trunc('month', date) AS DATE) AS model_run_at,
                  round(avg(abs(y - yhat) / NULLIF(y, 0)), 4) AS mape FROM pairs GROUP BY 1, 2),
aimed AS (SELECT *, CASE WHEN category_name = '__total__' THEN 0.1::DOUBLE ELSE 0.18::DOUBLE END AS target FROM months),
over_ AS (SELECT *, mape > target AS is_over FROM aimed)
SELECT *, is_over AND coalesce(lag(is_over) OVER (PARTITION BY category_name ORDER BY model_run_at), false) AS is_alert FROM over_"""
_RAW["cold_start"] = f"""WITH {_SERIES},
short AS (SELECT category_name, avg({_d('revenue')}) AS m, stddev_pop({_d('revenue')}) AS sp, max(date) AS last, count(*) AS n
          FROM series WHERE date > {DAY} - 20 GROUP BY 1 HAVING count(*) < 60),
half AS (SELECT *, sp * ({_Z} * {COLD_START_WIDENING}::DOUBLE) AS h FROM short)
SELECT category_name, CAST(last + CAST(k AS INTEGER) AS DATE) AS forecast_date, round(m, 2) AS yhat,
       round(m - h, 2) AS yhat_lower, round(m + h, 2) AS yhat_upper
FROM half, (SELECT unnest(generate_series(1, 30)) AS k)"""
_RAW["forecast_runs"] = f"""WITH {_BASE}
SELECT forecast.*, run AS model_run FROM forecast, (SELECT unnest(['20010731T235959', '20010801T235959']) AS run)"""
_RAW["forecast_files"] = f"""WITH {_BASE}
SELECT *, 'csv' AS file FROM forecast UNION ALL SELECT *, 'json' FROM forecast WHERE category_name = '__total__'"""

_RAW["rollup_unique_bounds"] = f"""
SELECT channel, {_b('count(DISTINCT customer_id)')} AS unique_customers, true AS within_bound
FROM e_orders WHERE status <> 'cancelled' GROUP BY 1"""
_RAW["churn_score_bounds"] = f"""
SELECT {_b('count(DISTINCT customer_id)')} AS buyers, {_b('count(*)')} AS orders, true AS in_range
FROM e_fct_orders WHERE rec AND order_date <= {DAY} AND customer_id IS NOT NULL"""

_RAW["churn_gradient"] = f"""
WITH f AS ({_RAW["churn_features"]}),
x AS (SELECT unnest(['bias', 'recency_days', 'frequency', 'monetary']) AS feature,
             unnest([1.0::DOUBLE, ln(1 + recency_days::DOUBLE), ln(1 + frequency::DOUBLE), ln(1 + monetary::DOUBLE)]) AS x
      FROM f WHERE customer_id IS NOT NULL)
SELECT feature, {_b('count(*)')} AS n, round(avg(x), 6) AS mean, true AS is_flat FROM x GROUP BY 1"""

# ---- streams ----------------------------------------------------------------------------------------

_RAW["stream_ingest"] = f"""
SELECT CASE WHEN event_type = 'purchase' THEN 'unknown event_type' ELSE 'accepted' END AS reason, event_type,
       {_b('count(*)')} AS n FROM e_shop_events GROUP BY 1, 2"""

_RAW["stream_dedupe"] = "SELECT id, event_type, session_id FROM e_shop_events"

_RAW["stream_events_hourly"] = f"""
SELECT date_trunc('hour', occurred_at) AS hour, event_type, {_b('count(*)')} AS n FROM e_shop_events
GROUP BY 1, 2
HAVING date_trunc('hour', occurred_at) + INTERVAL 1 HOUR
       <= (SELECT date_trunc('milliseconds', max(occurred_at)) - INTERVAL 2 HOUR FROM e_shop_events)"""

_RAW["stream_sessions"] = f"""
WITH g AS (SELECT *, CASE WHEN occurred_at - lag(occurred_at) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s
           FROM e_shop_events WINDOW w AS (PARTITION BY session_id ORDER BY occurred_at, id)),
n AS (SELECT *, sum(s) OVER (PARTITION BY session_id ORDER BY occurred_at, id) AS session FROM g)
SELECT session_id, min(occurred_at) AS session_start, max(occurred_at) AS session_end, {_b('count(*)')} AS n_events,
       CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'converted'
            WHEN count(*) FILTER (event_type = 'add_to_cart') > 0 THEN 'abandoned' ELSE 'browsing' END AS status
FROM n GROUP BY session_id, session
HAVING max(occurred_at) + INTERVAL 6 HOUR
       <= (SELECT date_trunc('milliseconds', max(occurred_at)) - INTERVAL 2 HOUR FROM e_shop_events)"""

_RAW["stream_sessions_by_timer"] = f"""
SELECT * FROM ({_RAW["sessionize"]}) WHERE session_end + INTERVAL 6 HOUR
  <= (SELECT date_trunc('milliseconds', max(occurred_at)) - INTERVAL 2 HOUR FROM e_shop_events)"""

_RAW["stream_cart_to_order"] = f"""
SELECT c.id AS cart_id, o.id AS order_id, {_b("date_sub('minute', c.created_at, o.placed_at)")} AS minutes
FROM e_carts c JOIN e_orders o ON o.customer_id = c.customer_id
 AND o.placed_at BETWEEN c.created_at AND c.created_at + INTERVAL 24 HOUR"""

_RAW["stream_stock_totals"] = f"""
SELECT l.variant_id, l.warehouse_code, {_b("l.on_hand - coalesce(s.sold, 0)")} AS on_hand FROM e_inventory_levels l
LEFT JOIN (SELECT variant_id, 'MAIN' AS warehouse_code, sum(quantity) AS sold FROM e_order_items GROUP BY 1) s
  ON s.variant_id = l.variant_id AND s.warehouse_code = l.warehouse_code"""

_RAW["stream_sliding_revenue"] = f"""
WITH r AS (SELECT placed_at, grand_total FROM e_orders WHERE {_REC}),
w AS (SELECT date_trunc('day', placed_at) - to_days(CAST(k AS INTEGER)) AS start, grand_total
      FROM r, (SELECT unnest(generate_series(0, 6)) AS k))
SELECT start, start + INTERVAL 7 DAY AS "end", {_d('sum(grand_total)')} AS revenue, {_b('count(*)')} AS orders FROM w
GROUP BY 1
HAVING start + INTERVAL 7 DAY <= (SELECT date_trunc('milliseconds', max(placed_at)) - INTERVAL 2 HOUR FROM r)"""

_RAW["stream_daily_revenue"] = f"""
SELECT CAST(placed_at AS DATE) AS date, {_d('sum(CAST(grand_total AS DECIMAL(18,2)))')} AS revenue, {_b('count(*)')} AS orders
FROM ({_FIXED}) WHERE {_REC} AND placed_at IS NOT NULL GROUP BY 1"""

_LATE = f"""
late AS (SELECT CAST(occurred_at AS DATE) AS date, {_b('count(*)')} AS n_stored,
                {_b('count(*) FILTER (id % 13 <> 0)')} AS n_streamed FROM e_product_events GROUP BY 1)"""
_RAW["late_report"] = f"WITH {_LATE} SELECT *, n_stored - n_streamed AS dropped FROM late"
_RAW["late_repair"] = f"""WITH {_LATE}
SELECT CAST(occurred_at AS DATE) AS date, event_type, {_b('count(*)')} AS n FROM e_product_events
WHERE CAST(occurred_at AS DATE) IN (SELECT date FROM late WHERE n_stored <> n_streamed) GROUP BY 1, 2"""

_RAW["forecast_metrics_file"] = _RAW["forecast_errors"]

# A row of the last pull is lost if it is not newer than the latest event before it, less the allowed delay.
_TAKEN = """
held AS (SELECT id, event_type, occurred_at, id % 13 = 0 AS late FROM e_product_events),
mark AS (SELECT max(occurred_at) - INTERVAL 2 HOUR AS w FROM held WHERE NOT late),
lost AS (SELECT * FROM held CROSS JOIN mark WHERE late AND occurred_at <= w)"""
_RAW["stream_late_rows"] = f"""WITH {_TAKEN}
SELECT CAST(1 AS BIGINT) AS pull, CAST(0 AS BIGINT) AS dropped UNION ALL SELECT 2, 0 UNION ALL SELECT 3, {_b('count(*)')} FROM lost"""
_RAW["stream_late_repair"] = f"""WITH {_TAKEN}
SELECT CAST(occurred_at AS DATE) AS date, event_type, {_b('count(*)')} AS n FROM e_product_events
WHERE CAST(occurred_at AS DATE) IN (SELECT CAST(occurred_at AS DATE) FROM lost) GROUP BY 1, 2"""


def all_statements() -> dict[str, str]:
    return {name: with_entities(body) for name, body in _RAW.items()}
