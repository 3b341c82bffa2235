from __future__ import annotations

from datetime import datetime, timedelta

from helpers import MONEY, frame, rows

from tradewind.operators import bulk, timelines
from tradewind.operators.affinity import mart_product_affinity

PRODUCTS = f"id bigint, sku string, name string, category_id bigint, price {MONEY}, is_active boolean"


def products(spark):
    return frame(spark, PRODUCTS, [
        (1, "A", "Red Ring", 1, "75.00", True), (2, "B", "ring small", 1, "0.01", True), (3, "C", "Bolt", 2, "5.00", True),
        (4, "D", "Gone ring", 2, "5.00", False), (5, "E", "Odd", 2, "1.0625", True),
    ])


def promotions(spark):
    return frame(spark, f"id bigint, code string, kind string, value {MONEY}, is_active boolean", [
        (1, "P10", "percent", "10.00", True), (2, "FIX", "fixed", "9.99", True), (3, "OLD", "percent", "50.00", False)])


def test_pricing_edges(spark):
    lines = frame(spark, "order_id bigint, product_id bigint, quantity bigint", [
        (1, 1, 1),              # 75.00: not above the threshold, so shipping is charged
        (2, 1, 1), (2, 2, 1),   # 75.01: free shipping
        (3, 3, 1),              # fixed promotion above the subtotal is capped
        (4, 3, 1), (4, 4, 1),   # inactive product
        (5, 3, 1), (5, 9, 1),   # unknown product
        (6, 3, 2),              # unknown code
        (7, 3, 2),              # inactive code
        (8, 2, 25),             # 0.25: 10% is 0.025, half to even 0.02; tax on 0.23 is 0.0184
        (9, 2, 75),             # 0.75: 10% is 0.075, half to even 0.08
        (10, 3, 1), (10, 3, 2),  # repeated line
    ])
    codes = frame(spark, "order_id bigint, code string",
                  [(3, "FIX"), (6, "NOPE"), (7, "OLD"), (8, "P10"), (9, "P10"), (10, None)])
    got = rows(bulk.order_pricing(lines, products(spark), codes, promotions(spark)), "order_id")
    assert got == [
        (1, 75.0, 0.0, 9.99, 6.0, 90.99),
        (2, 75.01, 0.0, 0.0, 6.0, 81.01),
        (3, 5.0, 5.0, 9.99, 0.0, 9.99),
        (8, 0.25, 0.02, 9.99, 0.02, 10.24),
        (9, 0.75, 0.08, 9.99, 0.05, 10.71),
        (10, 15.0, 0.0, 9.99, 1.2, 26.19),
    ]
    rejects = rows(bulk.order_rejects(lines, products(spark), codes, promotions(spark)))
    assert sorted(rejects, key=str) == [
        (4, 4, "inactive_product"), (5, 9, "missing_product"), (6, None, "invalid_promo"), (7, None, "invalid_promo")]


def test_tax_ties_go_to_even(spark):
    # 0.08 × 0.0625-style ties need cents: 3.1250 cannot occur, 0.08 × 18.75 = 1.5000; 0.08 × 0.3125 is not cents
    carts = frame(spark, "id bigint", [(1,), (2,), (3,)])
    items = frame(spark, f"cart_id bigint, quantity bigint, unit_price {MONEY}", [(1, 1, "10.00"), (1, 2, "32.50"), (2, 1, "75.01")])
    assert rows(bulk.cart_totals(carts, items), "cart_id") == [
        (1, 3, 75.0, 9.99, 6.0, 90.99), (2, 1, 75.01, 0.0, 6.0, 81.01), (3, 0, 0.0, 9.99, 0.0, 9.99)]


def test_merge_matches_missing_variants(spark):
    lines = frame(spark, "cart_id bigint, product_id bigint, variant_id bigint, quantity bigint",
                  [(1, 1, None, 2), (1, 1, None, 3), (1, 1, 7, 1), (2, 1, None, 1)])
    assert rows(bulk.cart_merge(lines)) == [(1, 1, 7, 1), (1, 1, None, 5), (2, 1, None, 1)]


def test_identity(spark):
    carts = frame(spark, "id bigint, session_id string, customer_id bigint, status string",
                  [(1, "s1", None, "active"), (2, "s1", 5, "active"), (3, "s2", None, "active"), (4, "s1", None, "converted")])
    seen = frame(spark, "session_id string, customer_id bigint, occurred_at timestamp, id bigint",
                 [("s1", 8, "2024-01-01", 1), ("s1", 9, "2024-01-02", 2), ("s1", None, "2024-01-03", 3)])
    got = {r.cart_id: (r.customer_id, r.was_claimed) for r in bulk.identity_stitch(carts, seen).collect()}
    assert got == {1: (9, True), 2: (5, False), 3: (None, False), 4: (None, False)}


def test_search(spark):
    p = products(spark)
    assert [r.id for r in bulk.catalog_search(p, q="RING").collect()] == [1, 2]
    assert [r.id for r in bulk.catalog_search(p, category_id=2).collect()] == [3, 5]
    assert [r.id for r in bulk.catalog_search(p, limit=1, offset=1).collect()] == [2]
    assert [r.id for r in bulk.featured_products(p, 2).collect()] == [1, 2]


def test_history_newest_first(spark):
    orders = frame(spark, f"id bigint, customer_id bigint, status string, grand_total {MONEY}, placed_at timestamp_ntz",
                   [(i, 1, "paid", "1.00", f"2024-01-{i:02d}") for i in range(1, 6)] + [(9, 2, "paid", "1.00", "2024-01-01")])
    lines = frame(spark, f"order_id bigint, product_id bigint, variant_id bigint, quantity bigint, unit_price {MONEY}",
                  [(5, 1, None, 1, "1.00"), (5, 2, None, 1, "1.00"), (4, 1, None, 1, "1.00"), (1, 1, None, 1, "1.00")])
    got = rows(bulk.order_history(orders, lines, limit=2).select("customer_id", "position", "order_id", "product_id"))
    assert sorted(got, key=str) == [(1, 1, 5, 1), (1, 1, 5, 2), (1, 2, 4, 1), (2, 1, 9, None)]


def test_audit_and_checks(spark):
    orders = frame(spark, f"id bigint, order_number string, customer_id bigint, status string, subtotal {MONEY}, grand_total {MONEY}",
                   [(1, "a", 1, "paid", "10.00", "12.00"), (2, "a", 7, "odd", "10.00", "12.00"), (3, "c", 1, None, "0.00", "1.00")])
    lines = frame(spark, f"order_id bigint, product_id bigint, variant_id bigint, quantity bigint, unit_price {MONEY}",
                  [(1, 1, 1, 2, "5.00"), (2, 1, 1, 1, "9.00"), (8, 2, None, 1, "1.00"), (8, 1, 2, 1, "1.00")])
    payments = frame(spark, f"order_id bigint, amount {MONEY}", [(1, "12.00"), (2, "12.00"), (3, "2.00")])
    assert rows(bulk.order_audit(orders, lines, payments), "order_id") == [(2, 10.0, 9.0, 1.0, 0.0), (3, 0.0, 0.0, 0.0, 1.0)]
    ids = frame(spark, "id bigint, sku string, product_id bigint", [(1, "x", 1)])
    t = {
        "orders": orders, "products": ids, "promotions": frame(spark, "code string", [("p",)]), "payments": payments,
        "customers": ids, "order_items": lines, "product_variants": ids,
        "promotion_redemptions": frame(spark, "order_id bigint", [(77,), (77,)]),
        "carts": frame(spark, "status string", [("active",), ("weird",)]),
        "product_events": frame(spark, "event_type string", [("view",), (None,)]),
    }
    got = {(r.table, r.check): r.n_bad for r in bulk.dq_checks(t).collect()}
    assert got["orders", "unique order_number"] == 1
    assert got["orders", "fk customer_id"] == 1
    assert got["order_items", "fk order_id"] == 2
    assert got["order_items", "fk product_id"] == 1
    assert got["order_items", "fk variant_id"] == 1
    assert got["promotion_redemptions", "fk order_id"] == 2
    assert got["orders", "accepted status"] == 2
    assert got["carts", "accepted status"] == got["product_events", "accepted event_type"] == 1
    assert got["products", "unique sku"] == 0


def test_stock_moves_need_a_variant(spark):
    lines = frame(spark, "order_id bigint, variant_id bigint, quantity bigint", [(1, 7, 3), (2, None, 4)])
    assert rows(bulk.stock_moves_from_sales(lines)) == [(7, -3, "sale", 1)]


# ---- timelines ------------------------------------------------------------------------------------


def test_running_stock_against_a_plain_sum(spark):
    import random

    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    moves = []
    for _ in range(400):  # one hot variant, several moves in the same second
        v = 1 if rng.random() < 0.7 else rng.randint(2, 4)
        at = start + timedelta(seconds=rng.randint(0, 4) if rng.random() < 0.3 else rng.randint(0, 200_000))
        moves.append((v, rng.choice(["MAIN", "EAST"]), str(at), rng.randint(-5, 9)))
    df = frame(spark, "variant_id bigint, warehouse_code string, occurred_at timestamp_ntz, delta bigint", moves)
    got = {(r.variant_id, r.warehouse_code, str(r.occurred_at)): r.on_hand for r in timelines.stock_running(df).collect()}
    want = {(v, w, t): sum(x[3] for x in moves if x[0] == v and x[1] == w and x[2] <= t) for v, w, t, _ in moves}
    assert got == want


def test_sessions_against_a_loop(spark):
    import random

    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    events = []
    for i in range(500):
        u = 1 if rng.random() < 0.5 else rng.randint(2, 6)
        at = start + timedelta(seconds=rng.randint(0, 40) * 1800 + rng.choice([0, 0, 1, 1799]), days=rng.randint(0, 6))
        events.append((i, u, str(at), rng.choice(["view", "view", "view", "add_to_cart", "purchase"])))
    df = frame(spark, "id bigint, user_id bigint, occurred_at timestamp_ntz, event_type string", events)
    for hours in (1, 2, 24):
        gap = timedelta(hours=hours)
        got = {(r.user_id, r.session_start, r.session_end): (r.n_events, r.status)
               for r in timelines.sessionize(df, gap).collect()}
        want = {}
        for u in {e[1] for e in events}:
            mine = sorted((datetime.fromisoformat(e[2]), e[3]) for e in events if e[1] == u)
            group = [mine[0]]
            for e in [*mine[1:], None]:
                if e is not None and e[0] - group[-1][0] <= gap:
                    group.append(e)
                    continue
                kinds = [k for _, k in group]
                status = "converted" if "purchase" in kinds else "abandoned" if "add_to_cart" in kinds else "browsing"
                want[u, group[0][0], group[-1][0]] = (len(group), status)
                group = [e]
        assert got == want


# ---- affinity --------------------------------------------------------------------------------------


def _pairs(lines, least):
    from collections import Counter, defaultdict
    from itertools import combinations

    baskets = defaultdict(set)
    for o, p in lines:
        baskets[o].add(p)
    n = Counter(c for b in baskets.values() for c in combinations(sorted(b), 2))
    single = Counter(p for b in baskets.values() for p in b)
    return {
        (a, b): (k, k / len(baskets), k * len(baskets) / (single[a] * single[b]))
        for (a, b), k in n.items()
        if k >= least
    }


def test_affinity_is_exact_with_huge_baskets(spark):
    import random

    rng = random.Random(11)
    lines = [(o, rng.randint(1, 30)) for o in range(60) for _ in range(rng.randint(1, 5))]
    lines += [(1000, p) for p in range(1, 26)]              # three large baskets, partly overlapping
    lines += [(1001, p) for p in range(20, 45)]
    lines += [(1002, p) for p in list(range(1, 5)) + list(range(40, 60))]
    df = frame(spark, "order_id bigint, product_id bigint", lines)
    n = len({o for o, _ in lines})
    for least in (2, 3):
        got = {(r.product_a, r.product_b): (r.orders_together, r.support, r.lift)
               for r in mart_product_affinity(df, min_support=least / n).collect()}
        assert got == _pairs(lines, least), least
    # A basket larger than a cell is joined in parts, with the same pairs.
    many = frame(spark, "order_id bigint, product_id bigint", [(o, p) for o in (1, 2) for p in range(150)])
    assert mart_product_affinity(many).count() == 150 * 149 // 2


def test_orders_with_several_codes_and_shared_codes_are_refused(spark):
    lines = frame(spark, "order_id bigint, product_id bigint, quantity bigint", [(o, 1, 1) for o in range(1, 6)])
    products = frame(spark, f"id bigint, price {MONEY}, is_active boolean", [(1, "100.00", True)])
    promos = frame(spark, f"code string, kind string, value {MONEY}, is_active boolean",
                   [("A", "fixed", "10", True), ("B", "fixed", "5", True), ("B", "fixed", "6", True), ("C", "fixed", "5", False)])
    codes = frame(spark, "order_id bigint, code string", [(1, "A"), (1, "A"), (2, "A"), (2, "B"), (3, "B"), (4, "C"), (5, None)])
    assert rows(bulk.order_rejects(lines, products, codes, promos).select("order_id", "reason"), "order_id") == [
        (2, "several_codes"), (3, "ambiguous_promo"), (4, "invalid_promo")]
    assert rows(bulk.order_pricing(lines, products, codes, promos).select("order_id", "discount"), "order_id") == [(1, 10.0), (5, 0.0)]
