"""Adapter: the supplied wholesale tables, read as the shop's entities.

Every entity is a projection of one or two of the supplied tables, so its size follows theirs.
Money is exact: cents as whole numbers, then two-digit decimals.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.sources import line_store

# The seven channels, sizes, colours and carriers of the shop.
CHANNELS = ("organic", "paid_search", "paid_social", "email", "direct", "referral", "affiliate")
SIZES = ("XS", "S", "M", "L")
COLORS = ("black", "navy", "olive", "rust")
DEVICES = ("desktop", "mobile", "tablet")
CARRIERS = ("UPS", "FedEx", "USPS")

TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string,"
    " l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}

# Days between the event stream's month and the last month of orders.
EVENT_SHIFT_DAYS = 8218


def _pick(index: str, options: tuple[str, ...]) -> str:
    return f"elt(cast({index} as int) + 1, " + ", ".join(f"'{o}'" for o in options) + ")"


def _money(cents: str) -> str:
    return f"cast(cast({cents} as decimal(12,0)) * cast(0.01 as decimal(3,2)) as decimal(12,2))"


# What the entities read of a line. The store by date holds these columns, so no others are shuffled and written.
LINE_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
LINE_SCHEMA = ", ".join(c for c in TABLES["lineitem"].split(", ") if c.split()[0] in LINE_COLUMNS)


class Shop:
    """The entities, each a lazy DataFrame over the tables in `sf_dir`."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(self.path(name))

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def line_store(self) -> tuple[str, str]:
        """Path and grain of the lines by date of their order; the first call of an application builds it."""
        lines = Shop.table(self, "lineitem").select(*LINE_COLUMNS)
        sources = (self.path("lineitem"), self.path("orders"), lines, Shop.table(self, "orders"))
        return line_store.ensure(self.spark, *sources, "l_orderkey", "o_orderkey", "o_orderdate")

    def dated(self, first: date, last: date) -> Shop:
        """The same shop for jobs that look at these dates only: the scans of orders and events skip the others, and
        lines come from the store by date.

        Times of the entities lie less than a day after the raw date (orders) or a fixed shift before it (events). The
        bounds are a day wider on both sides, so a job's own window decides and these only prune.
        """
        return _DatedShop(self.spark, self.sf_dir, first - timedelta(days=1), last + timedelta(days=1))

    def streaming(self, *tables: str) -> Shop:
        """The same shop with the named tables read as streams of files."""
        return _StreamingShop(self.spark, self.sf_dir, tables)

    def customers(self) -> DataFrame:
        nation = self.table("nation").select("n_nationkey", "n_name")
        joined = self.table("customer").join(nation, nation.n_nationkey == F.col("c_nationkey"), "left")
        return joined.selectExpr(
            "c_custkey as id",
            "concat(lower(c_name), '@example.com') as email",
            "'Customer' as first_name",
            "c_name as last_name",
            f"{_pick('c_custkey % 7', CHANNELS)} as signup_channel",
            "n_name as signup_country",
            "c_custkey % 100 < 55 as marketing_opt_in",
            "timestampadd(DAY, cast(c_custkey % 365 as int), timestamp_ntz'1995-01-01') as created_at",
            "timestampadd(DAY, cast(c_custkey % 365 as int), timestamp_ntz'1995-01-01') as updated_at",
        )

    _CATEGORY_ID = "cast(conv(substr(md5(p_type), 1, 8), 16, 10) as bigint)"

    def categories(self) -> DataFrame:
        return self.table("part").select("p_type").distinct().selectExpr(
            f"{self._CATEGORY_ID} as id", "lower(p_type) as slug", "p_type as name",
            "cast(null as bigint) as parent_id",
        )

    def products(self) -> DataFrame:
        priced = self.table("part").selectExpr("*", "cast(round(p_retailprice * 100) as bigint) as cents")
        return priced.selectExpr(
            "p_partkey as id",
            "concat('SKU-', lpad(cast(p_partkey as string), 6, '0')) as sku",
            "p_name as name",
            f"{self._CATEGORY_ID} as category_id",
            "p_brand as brand",
            f"{_money('cents')} as price",
            f"{_money('cents * (30 + p_partkey % 36) div 100')} as cost",
            "p_partkey % 20 <> 0 as is_active",
            "timestampadd(DAY, cast(p_partkey % 1000 as int), timestamp_ntz'1995-01-01') as launched_at",
        )

    def product_variants(self) -> DataFrame:
        parts = self.table("part").selectExpr("p_partkey", "explode(sequence(0, 3)) as k")
        return parts.selectExpr(
            "p_partkey * 4 + k as id",
            "p_partkey as product_id",
            f"concat('SKU-', lpad(cast(p_partkey as string), 6, '0'), '-', {_pick('k', SIZES)}) as sku",
            f"{_pick('k', SIZES)} as size",
            f"{_pick('(p_partkey + k) % 4', COLORS)} as color",
            "cast(null as decimal(12,2)) as price_override",
        )

    def orders(self) -> DataFrame:
        o = self.table("orders").selectExpr(
            "o_orderkey as k",
            "o_custkey",
            """case when o_orderkey % 100 < 5 then 'cancelled'
                    when o_orderkey % 100 < 8 then 'refunded'
                    when o_orderkey % 100 < 10 then 'pending'
                    when o_orderstatus = 'F' then 'delivered'
                    when o_orderstatus = 'O' then 'shipped'
                    when o_orderkey % 2 = 0 then 'paid'
                    else 'fulfilled' end as status""",
            "timestampadd(SECOND, cast(o_orderkey * 7919 % 86400 as int), o_orderdate) as placed_at",
            "cast(round(o_totalprice * 100) as bigint) as grand",
            f"{_pick('o_orderkey % 7', CHANNELS)} as channel",
            "o_orderkey % 50 < 9 as promo",
            "cast(o_orderkey % 4 + 1 as bigint) as promo_id",
        )
        o = o.selectExpr(
            "*",
            "case when promo then grand * (promo_id * 5) div 100 else 0 end as discount",
            "case when grand > 7500 then 0 else 999 end as shipping",
            "grand * 8 div 108 as tax",
            """case when status in ('fulfilled','shipped','delivered')
                    then timestampadd(HOUR, cast(2 + k % 47 as int), placed_at) end as fulfilled_at""",
        )
        return o.selectExpr(
            "k as id",
            "concat('ORD-', lpad(cast(k as string), 10, '0')) as order_number",
            "o_custkey as customer_id",
            "status",
            "'USD' as currency",
            f"{_money('grand - tax - shipping + discount')} as subtotal",
            f"{_money('discount')} as discount_total",
            f"{_money('shipping')} as shipping_total",
            f"{_money('tax')} as tax_total",
            f"{_money('grand')} as grand_total",
            "channel",
            "case when channel like 'paid%' then channel end as utm_source",
            "case when promo then concat('campaign-', promo_id) end as utm_campaign",
            f"{_pick('o_custkey % 3', DEVICES)} as device_type",
            "placed_at",
            """case when status not in ('pending','cancelled')
                    then timestampadd(MINUTE, cast(1 + k % 30 as int), placed_at) end as paid_at""",
            "fulfilled_at",
            """case when status = 'delivered'
                    then timestampadd(DAY, cast(2 + k % 6 as int), fulfilled_at) end as delivered_at""",
            """case when status = 'cancelled'
                    then timestampadd(HOUR, cast(1 + k % 72 as int), placed_at) end as cancelled_at""",
        )

    def order_items(self) -> DataFrame:
        lines = self.table("lineitem").selectExpr(
            "l_orderkey", "l_partkey", "l_suppkey",
            "cast(l_quantity as bigint) as quantity",
            "cast(round(l_extendedprice * 100) as bigint) div cast(l_quantity as bigint) as cents",
        )
        return lines.selectExpr(
            "l_orderkey as order_id",
            "l_partkey as product_id",
            "l_partkey * 4 + l_suppkey % 4 as variant_id",
            "quantity",
            f"{_money('cents')} as unit_price",
            f"{_money('cents * (30 + l_partkey % 36) div 100')} as unit_cost",
            "cast(0 as decimal(12,2)) as line_discount",
        )

    def payments(self) -> DataFrame:
        return self.orders().filter("paid_at is not null").selectExpr(
            "id", "id as order_id", "'stripe' as provider", "'card' as method",
            "case when status = 'refunded' then 'refunded' else 'captured' end as status",
            "grand_total as amount", "paid_at as captured_at",
        )

    def shipments(self) -> DataFrame:
        return self.orders().filter("status in ('fulfilled','shipped','delivered')").selectExpr(
            "id", "id as order_id", f"{_pick('id % 3', CARRIERS)} as carrier",
            "concat('TRK', id) as tracking_number",
            "case when status = 'fulfilled' then 'packed' else status end as status",
            "fulfilled_at as picked_at",
            "case when status <> 'fulfilled' then timestampadd(HOUR, 6, fulfilled_at) end as shipped_at",
            "delivered_at",
        )

    def inventory_levels(self) -> DataFrame:
        levels = (
            self.product_variants()
            .selectExpr("id as variant_id", "explode(array(0, 1)) as w")
            .selectExpr("*", "(variant_id * 37 + w * 101 + 13) % 501 as on_hand")
        )
        return levels.selectExpr(
            "variant_id * 2 + w as id",
            "variant_id",
            f"{_pick('w', ('MAIN', 'EAST'))} as warehouse_code",
            "on_hand",
            "on_hand * (variant_id % 4) div 10 as reserved",
            "cast(element_at(array(10, 20, 50), cast(variant_id % 3 as int) + 1) as bigint) as reorder_point",
            "timestampadd(HOUR, cast(variant_id % 48 as int), timestamp_ntz'2001-07-31 00:30:00') as updated_at",
        )

    def stock_movements(self) -> DataFrame:
        initial = self.inventory_levels().selectExpr(
            "variant_id", "warehouse_code", "on_hand as delta", "'initial_load' as reason",
            "cast(null as bigint) as ref_order_id", "timestamp_ntz'1994-12-31' as occurred_at",
        )
        placed = self.orders().select("id", "placed_at")
        sales = self.order_items().join(placed, placed.id == F.col("order_id")).selectExpr(
            "variant_id", "'MAIN' as warehouse_code", "-quantity as delta", "'sale' as reason",
            "order_id as ref_order_id", "placed_at as occurred_at",
        )
        return initial.unionByName(sales)

    def shop_events(self) -> DataFrame:
        """All events in shop terms, purchases included."""
        return self.table("events").selectExpr(
            "event_id as id", "user_id",
            """case event_type when 'click' then 'add_to_cart' when 'error' then 'remove_from_cart'
                 when 'signup' then 'wishlist' else event_type end as event_type""",
            f"timestampadd(DAY, -{EVENT_SHIFT_DAYS}, ts) as occurred_at",
            "cast(get_json_object(props, '$.k') as bigint) as product_id",
            "case when event_id % 5 >= 2 then user_id end as customer_id",
            f"concat(user_id, '-', cast(timestampadd(DAY, -{EVENT_SHIFT_DAYS}, ts) as date)) as session_id",
        )

    def product_events(self) -> DataFrame:
        return self.shop_events().filter("event_type <> 'purchase'").selectExpr(
            "id", "session_id", "customer_id", "product_id", "event_type", "occurred_at"
        )

    def page_views(self) -> DataFrame:
        return self.shop_events().filter("event_type = 'view'").selectExpr(
            "id", "session_id", "customer_id", "concat('/product/', product_id) as path",
            "cast(null as string) as referrer", f"{_pick('user_id % 3', DEVICES)} as device_type",
            "occurred_at",
        )

    def carts(self) -> DataFrame:
        clicks = self.shop_events().filter("event_type = 'add_to_cart'").selectExpr(
            "*",
            "case when id % 10 < 3 then 'abandoned' when id % 10 < 9 then 'converted' else 'active' end as status",
        )
        return clicks.selectExpr(
            "id", "customer_id", "session_id", "status", "occurred_at as created_at",
            """case when status = 'abandoned'
                    then timestampadd(HOUR, cast(1 + id % 24 as int), occurred_at) end as abandoned_at""",
            """case when status = 'converted'
                    then timestampadd(MINUTE, cast(5 + id % 50 as int), occurred_at) end as converted_at""",
        )

    def cart_items(self) -> DataFrame:
        lines = (
            self.shop_events()
            .filter("event_type = 'add_to_cart'")
            .selectExpr(
                "id as cart_id", "1 + id % 3 as quantity",
                """explode(case when id % 2 = 0 then array(product_id, (product_id + 7) % 100)
                                else array(product_id) end) as product_id""",
            )
        )
        prices = self.products().selectExpr("id as pid", "price as unit_price")
        return lines.join(prices, prices.pid == lines.product_id).selectExpr(
            "cart_id", "product_id",
            "case when cart_id % 3 > 0 then product_id * 4 + cart_id % 4 end as variant_id",
            "quantity", "unit_price",
        )

    def promotions(self) -> DataFrame:
        return self.spark.sql(
            """select cast(id as bigint) as id, code, kind, cast(v as decimal(12,2)) as value,
                      timestamp_ntz'1995-01-01' as starts_at, cast(null as timestamp_ntz) as ends_at,
                      true as is_active
               from values (1, 'WELCOME10', 'percent', 10.00), (2, 'SUMMER20', 'percent', 20.00),
                           (3, 'FREESHIP', 'fixed', 9.99), (4, 'BFCM30', 'percent', 30.00)
                    as t(id, code, kind, v)"""
        )

    def promotion_redemptions(self) -> DataFrame:
        return self.orders().filter("id % 50 < 9").selectExpr(
            "id", "cast(id % 4 + 1 as bigint) as promotion_id", "id as order_id", "customer_id",
            "discount_total as amount_off", "placed_at as redeemed_at",
        )

    def channel_cac(self) -> DataFrame:
        """Acquisition cost per channel: an outside feed, seven rows."""
        return self.spark.sql(
            """select channel, cast(cac as decimal(12,2)) as cac
               from values ('organic', 4.00), ('paid_search', 38.00), ('paid_social', 45.50), ('email', 6.25),
                           ('direct', 2.00), ('referral', 12.00), ('affiliate', 21.75) as t(channel, cac)"""
        )


class _DatedShop(Shop):
    _TIMES = {"orders": ("o_orderdate", 0), "events": ("ts", EVENT_SHIFT_DAYS)}

    def __init__(self, spark: SparkSession, sf_dir: str, first: date, last: date):
        super().__init__(spark, sf_dir)
        self.first, self.last = first, last

    def table(self, name: str) -> DataFrame:
        if name == "lineitem":
            path, grain = self.line_store()
            return line_store.read(self.spark, path, LINE_SCHEMA, self.first, self.last, grain)
        df = super().table(name)
        if name not in self._TIMES:
            return df
        column, shift = self._TIMES[name]
        low, high = (f"timestamp_ntz'{d + timedelta(days=shift)}'" for d in (self.first, self.last + timedelta(days=1)))
        return df.filter(f"{column} >= {low} AND {column} < {high}")


class _StreamingShop(Shop):
    def __init__(self, spark: SparkSession, sf_dir: str, streamed: tuple[str, ...]):
        super().__init__(spark, sf_dir)
        self.streamed = streamed

    def table(self, name: str) -> DataFrame:
        if name not in self.streamed:
            return super().table(name)
        # A pattern, since a stream may only start from a folder or a pattern; it matches one name.
        return self.spark.readStream.schema(TABLES[name]).parquet(f"{self.sf_dir}/{name}[.]parquet")
