"""The shop entities as DuckDB common table expressions over the supplied tables."""

from __future__ import annotations

import re

_CH = "['organic','paid_search','paid_social','email','direct','referral','affiliate']"
_DEV = "['desktop','mobile','tablet']"


def _m(cents: str) -> str:
    return f"CAST(CAST({cents} AS DECIMAL(12,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(12,2))"


ENTITIES: dict[str, str] = {
    "customers": f"""
        SELECT c_custkey AS id, lower(c_name) || '@example.com' AS email, 'Customer' AS first_name,
               c_name AS last_name, {_CH}[c_custkey % 7 + 1] AS signup_channel, n_name AS signup_country,
               c_custkey % 100 < 55 AS marketing_opt_in,
               TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 365 AS INTEGER)) AS created_at
        FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "categories": """
        SELECT DISTINCT CAST('0x' || substr(md5(p_type), 1, 8) AS BIGINT) AS id, lower(p_type) AS slug,
               p_type AS name FROM part""",
    "products": f"""
        SELECT p_partkey AS id, 'SKU-' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS sku, p_name AS name,
               CAST('0x' || substr(md5(p_type), 1, 8) AS BIGINT) AS category_id, p_brand AS brand,
               {_m('cents')} AS price, {_m('(cents * (30 + p_partkey % 36)) // 100')} AS cost,
               p_partkey % 20 <> 0 AS is_active,
               TIMESTAMP '1995-01-01' + to_days(CAST(p_partkey % 1000 AS INTEGER)) AS launched_at
        FROM (SELECT *, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part)""",
    "product_variants": """
        SELECT p_partkey * 4 + k AS id, p_partkey AS product_id,
               'SKU-' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '-' || ['XS','S','M','L'][k + 1] AS sku,
               ['XS','S','M','L'][k + 1] AS size,
               ['black','navy','olive','rust'][(p_partkey + k) % 4 + 1] AS color
        FROM part CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k)""",
    "orders_a": f"""
        SELECT o_orderkey AS k, o_custkey,
               CASE WHEN o_orderkey % 100 < 5 THEN 'cancelled' WHEN o_orderkey % 100 < 8 THEN 'refunded'
                    WHEN o_orderkey % 100 < 10 THEN 'pending' WHEN o_orderstatus = 'F' THEN 'delivered'
                    WHEN o_orderstatus = 'O' THEN 'shipped' WHEN o_orderkey % 2 = 0 THEN 'paid'
                    ELSE 'fulfilled' END AS status,
               CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey * 7919 % 86400) AS placed_at,
               CAST(round(o_totalprice * 100) AS BIGINT) AS grand,
               {_CH}[o_orderkey % 7 + 1] AS channel, o_orderkey % 50 < 9 AS promo, o_orderkey % 4 + 1 AS promo_id
        FROM orders""",
    "orders_b": """
        SELECT *, CASE WHEN promo THEN grand * (promo_id * 5) // 100 ELSE 0 END AS discount,
               CASE WHEN grand > 7500 THEN 0 ELSE 999 END AS shipping, grand * 8 // 108 AS tax,
               CASE WHEN status IN ('fulfilled','shipped','delivered')
                    THEN placed_at + to_hours(2 + k % 47) END AS fulfilled_at
        FROM e_orders_a""",
    "orders": f"""
        SELECT k AS id, 'ORD-' || lpad(CAST(k AS VARCHAR), 10, '0') AS order_number, o_custkey AS customer_id,
               status, 'USD' AS currency, {_m('grand - tax - shipping + discount')} AS subtotal,
               {_m('discount')} AS discount_total, {_m('shipping')} AS shipping_total, {_m('tax')} AS tax_total,
               {_m('grand')} AS grand_total, channel,
               CASE WHEN channel LIKE 'paid%' THEN channel END AS utm_source,
               CASE WHEN promo THEN 'campaign-' || promo_id END AS utm_campaign,
               {_DEV}[o_custkey % 3 + 1] AS device_type, placed_at,
               CASE WHEN status NOT IN ('pending','cancelled') THEN placed_at + to_minutes(1 + k % 30) END AS paid_at,
               fulfilled_at,
               CASE WHEN status = 'delivered' THEN fulfilled_at + to_days(CAST(2 + k % 6 AS INTEGER)) END AS delivered_at,
               CASE WHEN status = 'cancelled' THEN placed_at + to_hours(1 + k % 72) END AS cancelled_at
        FROM e_orders_b""",
    "order_items": f"""
        SELECT l_orderkey AS order_id, l_partkey AS product_id, l_partkey * 4 + l_suppkey % 4 AS variant_id,
               quantity, {_m('cents')} AS unit_price, {_m('cents * (30 + l_partkey % 36) // 100')} AS unit_cost,
               CAST(0 AS DECIMAL(12,2)) AS line_discount
        FROM (SELECT *, CAST(l_quantity AS BIGINT) AS quantity,
                     CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT) AS cents
              FROM lineitem)""",
    "payments": """
        SELECT id, id AS order_id, CASE WHEN status = 'refunded' THEN 'refunded' ELSE 'captured' END AS status,
               grand_total AS amount, paid_at AS captured_at
        FROM e_orders WHERE paid_at IS NOT NULL""",
    "shipments": """
        SELECT id, id AS order_id, ['UPS','FedEx','USPS'][id % 3 + 1] AS carrier,
               CASE WHEN status = 'fulfilled' THEN 'packed' ELSE status END AS status,
               fulfilled_at AS picked_at,
               CASE WHEN status <> 'fulfilled' THEN fulfilled_at + to_hours(6) END AS shipped_at, delivered_at
        FROM e_orders WHERE status IN ('fulfilled','shipped','delivered')""",
    "inventory_levels": """
        SELECT variant_id * 2 + w AS id, variant_id, ['MAIN','EAST'][w + 1] AS warehouse_code, on_hand,
               on_hand * (variant_id % 4) // 10 AS reserved,
               CAST([10, 20, 50][variant_id % 3 + 1] AS BIGINT) AS reorder_point,
               TIMESTAMP '2001-07-31 00:30:00' + to_hours(variant_id % 48) AS updated_at
        FROM (SELECT v.id AS variant_id, w, (v.id * 37 + w * 101 + 13) % 501 AS on_hand
              FROM e_product_variants v CROSS JOIN (SELECT unnest([0, 1]) AS w))""",
    "stock_movements": """
        SELECT variant_id, warehouse_code, on_hand AS delta, 'initial_load' AS reason,
               CAST(NULL AS BIGINT) AS ref_order_id, TIMESTAMP '1994-12-31' AS occurred_at
        FROM e_inventory_levels
        UNION ALL
        SELECT i.variant_id, 'MAIN', -i.quantity, 'sale', i.order_id, o.placed_at
        FROM e_order_items i JOIN e_orders o ON o.id = i.order_id""",
    "shop_events": """
        SELECT event_id AS id, user_id,
               CASE event_type WHEN 'click' THEN 'add_to_cart' WHEN 'error' THEN 'remove_from_cart'
                    WHEN 'signup' THEN 'wishlist' ELSE event_type END AS event_type, CAST(ts AS TIMESTAMP) - to_days(8218) AS occurred_at,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id,
               CASE WHEN event_id % 5 >= 2 THEN user_id END AS customer_id,
               user_id || '-' || CAST(CAST(ts AS TIMESTAMP) - to_days(8218) AS DATE) AS session_id
        FROM events""",
    "product_events": """
        SELECT id, session_id, customer_id, product_id, event_type, occurred_at
        FROM e_shop_events WHERE event_type <> 'purchase'""",
    "page_views": f"""
        SELECT id, session_id, customer_id, {_DEV}[user_id % 3 + 1] AS device_type, occurred_at
        FROM e_shop_events WHERE event_type = 'view'""",
    "carts": """
        SELECT id, customer_id, session_id, status, occurred_at AS created_at,
               CASE WHEN status = 'abandoned' THEN occurred_at + to_hours(1 + id % 24) END AS abandoned_at,
               CASE WHEN status = 'converted' THEN occurred_at + to_minutes(5 + id % 50) END AS converted_at
        FROM (SELECT *, CASE WHEN id % 10 < 3 THEN 'abandoned' WHEN id % 10 < 9 THEN 'converted'
                             ELSE 'active' END AS status
              FROM e_shop_events WHERE event_type = 'add_to_cart')""",
    "cart_items": """
        SELECT l.cart_id, l.product_id,
               CASE WHEN l.cart_id % 3 > 0 THEN l.product_id * 4 + l.cart_id % 4 END AS variant_id,
               l.quantity, p.price AS unit_price
        FROM (SELECT id AS cart_id, 1 + id % 3 AS quantity,
                     unnest(CASE WHEN id % 2 = 0 THEN [product_id, (product_id + 7) % 100]
                                 ELSE [product_id] END) AS product_id
              FROM e_shop_events WHERE event_type = 'add_to_cart') l
        JOIN e_products p ON p.id = l.product_id""",
    "promotions": """
        SELECT * FROM (VALUES (1, 'WELCOME10', 'percent', CAST(10.00 AS DECIMAL(12,2))),
                              (2, 'SUMMER20', 'percent', CAST(20.00 AS DECIMAL(12,2))),
                              (3, 'FREESHIP', 'fixed', CAST(9.99 AS DECIMAL(12,2))),
                              (4, 'BFCM30', 'percent', CAST(30.00 AS DECIMAL(12,2)))) t(id, code, kind, value)""",
    "promotion_redemptions": """
        SELECT id, id % 4 + 1 AS promotion_id, id AS order_id, customer_id, discount_total AS amount_off,
               placed_at AS redeemed_at
        FROM e_orders WHERE id % 50 < 9""",
    "channel_cac": """
        SELECT * FROM (VALUES ('organic', 4.00), ('paid_search', 38.00), ('paid_social', 45.50), ('email', 6.25),
                              ('direct', 2.00), ('referral', 12.00), ('affiliate', 21.75)) t(channel, cac)""",
    # facts
    "fct_orders": """
        SELECT *, CAST(placed_at AS DATE) AS order_date,
               status IN ('paid','fulfilled','shipped','delivered') AS rec
        FROM e_orders""",
    "fct_items": """
        SELECT i.*, o.customer_id, CAST(o.placed_at AS DATE) AS order_date, o.placed_at, o.channel, o.device_type,
               i.quantity * i.unit_price AS line_revenue, i.quantity * i.unit_cost AS line_cost,
               i.quantity * (i.unit_price - i.unit_cost) AS line_margin
        FROM e_order_items i JOIN e_orders o ON o.id = i.order_id
        WHERE o.status NOT IN ('cancelled','refunded')""",
    "dim_product": """
        SELECT p.id AS product_id, p.sku, p.name, p.brand, p.price AS list_price, p.cost AS list_cost,
               c.slug AS category_slug, c.name AS category_name, p.is_active, p.launched_at
        FROM e_products p LEFT JOIN e_categories c ON c.id = p.category_id""",
    "daily_revenue": """
        SELECT order_date AS date, sum(grand_total) AS rev, CAST(count(DISTINCT id) AS BIGINT) AS orders,
               CAST(count(DISTINCT customer_id) AS BIGINT) AS unique_customers
        FROM e_fct_orders WHERE rec GROUP BY 1""",
}


def with_entities(body: str) -> str:
    """Prepend the entity definitions `body` names as e_<entity>, in definition order."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        for name in re.findall(r"\be_(\w+)", todo.pop()):
            if name not in needed:
                needed.add(name)
                todo.append(ENTITIES[name])
    ctes = [f"e_{name} AS ({sql})" for name, sql in ENTITIES.items() if name in needed]
    body = body.strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
