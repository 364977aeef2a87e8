"""Driver tables → the reference's four logical tables.

The driver ships a TPC-H-like star schema plus an ``events`` table.  These
builders re-shape it into the sales ledger, e-commerce orders, products and
campaigns the operators expect.  Each Spark builder joins only the tables the
requested columns need, so a trend query never touches ``part`` or
``customer``; every join is an equi-join that Catalyst/AQE plans (sort-merge
for fact-to-fact, broadcast only when Spark's size estimate allows it).

The same mapping is written as DuckDB SQL (``*_SQL``) for the oracle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.functions.numeric import round_half_even

SALES_COLUMNS = ("date", "amount", "qty", "category", "product", "region", "city",
                 "customer", "customer_tier", "order_id")

# Fixed values of the campaign mapping: channel by k % 5, and a budget factor
# per channel, chosen so that channel ROIs fall in all three budget branches.
CHANNELS = ("Online", "Offline", "Omni", "Social", "Email")
BUDGET_FACTORS = (0.3, 0.45, 0.58, 0.8, 1.2)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sales_ledger(spark: SparkSession, sf_dir: str,
                 columns: Iterable[str] = SALES_COLUMNS) -> DataFrame:
    """Sales ledger with logical column names (use ``ColumnMap.identity()``).

    One row per line item.  date=o_orderdate, amount=l_extendedprice*(1-l_discount),
    qty=l_quantity, category=p_brand, product=p_name, region=r_name, city=n_name,
    customer=o_custkey, customer_tier=c_mktsegment, order_id=o_orderkey.
    """
    cols = list(columns)
    unknown = set(cols) - set(SALES_COLUMNS)
    if unknown:
        raise ValueError(f"unknown ledger columns {sorted(unknown)}")
    need_orders = bool({"date", "order_id", "customer", "region", "city", "customer_tier"} & set(cols))
    need_part = bool({"category", "product"} & set(cols))
    need_cust = bool({"region", "city", "customer_tier"} & set(cols))

    # the amount before the joins: one column of it is shuffled, not its two factors
    df = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", (F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).alias("amount"), "l_quantity")
    if need_part:
        p = _read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
        df = df.join(p, df.l_partkey == p.p_partkey)
    if need_orders:
        o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
        if need_cust:
            # the customer's columns join the orders: for them the line items, of which
            # there are more, aren't shuffled once more
            c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
            n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
            r = _read(spark, sf_dir, "region").select("r_regionkey", "r_name")
            o = (o.join(c, o.o_custkey == c.c_custkey)
                 .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
                 .join(r, F.col("n_regionkey") == F.col("r_regionkey")))
        df = df.join(o, df.l_orderkey == F.col("o_orderkey"))
    expr = {
        "date": F.col("o_orderdate"),
        "amount": F.col("amount"),
        "qty": F.col("l_quantity"),
        "category": F.col("p_brand"),
        "product": F.col("p_name"),
        "region": F.col("r_name"),
        "city": F.col("n_name"),
        "customer": F.col("o_custkey"),
        "customer_tier": F.col("c_mktsegment"),
        "order_id": F.col("o_orderkey"),
    }
    return df.select(*[expr[c].alias(c) for c in cols])


def events_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a second ledger with intraday timestamps."""
    return _read(spark, sf_dir, "events").select(
        F.col("ts").alias("date"), F.col("value").alias("amount"),
        F.col("event_type").alias("category"), F.col("user_id").alias("customer"))


def _cost_factor(partkey):
    return F.lit(0.25) + F.lit(0.12) * (partkey % 6)


ORDER_COLUMNS = ("order_id", "customer_id", "product_id", "category", "quantity", "unit_price",
                 "cost_price", "order_date")


def ecom_orders(spark: SparkSession, sf_dir: str, columns: Iterable[str] = ORDER_COLUMNS) -> DataFrame:
    """E-commerce orders (one row per line item), before ``prepare_orders``.

    ``orders`` is joined for the customer and the date only, ``part`` for the
    category only: every line item has exactly one row in either (the keys match),
    so without those columns the joins neither drop nor repeat a row."""
    cols = list(columns)
    df = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_quantity")
    if {"customer_id", "order_date"} & set(cols):
        o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
        df = df.join(o, df.l_orderkey == o.o_orderkey)
    if "category" in cols:
        p = _read(spark, sf_dir, "part").select("p_partkey", "p_brand")
        df = df.join(p, df.l_partkey == p.p_partkey)
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    expr = {
        "order_id": F.col("l_orderkey"), "customer_id": F.col("o_custkey"), "product_id": F.col("l_partkey"),
        "category": F.col("p_brand"), "quantity": F.col("l_quantity"), "unit_price": round_half_even(unit),
        "cost_price": round_half_even(unit * _cost_factor(F.col("l_partkey"))), "order_date": F.col("o_orderdate"),
    }
    return df.select(*[expr[c].alias(c) for c in cols])


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product catalogue with a stock level and reorder point per product."""
    return _read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("category"),
        F.col("p_retailprice").alias("sell_price"),
        ((F.col("p_partkey") * 37) % 400).alias("stock_quantity"),
        (F.col("p_size") * 4).cast("long").alias("reorder_level"))


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaign table: one campaign per ``k`` in ``events.props``."""
    ev = _read(spark, sf_dir, "events").select(
        F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type", "value", "ts")
    chan = F.element_at(F.array(*[F.lit(c) for c in CHANNELS]), (F.col("k") % 5 + 1).cast("int"))
    factor = F.element_at(F.array(*[F.lit(f) for f in BUDGET_FACTORS]),
                          (F.col("k") % 5 + 1).cast("int"))
    spend = F.when(F.col("event_type").isin("signup", "error"), F.col("value"))
    agg = (ev.where(F.col("k").isNotNull()).groupBy("k").agg(
        F.coalesce(F.sum(spend.cast("decimal(18,2)")).cast("double"), F.lit(0.0)).alias("_spend"),
        F.count(F.when(F.col("event_type") == "purchase", 1)).alias("orders"),
        F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))
                         .cast("decimal(18,2)")).cast("double"), F.lit(0.0)).alias("revenue"),
        F.count(F.lit(1)).alias("impressions"),
        F.count(F.when(F.col("event_type") == "click", 1)).alias("clicks"),
        F.min("ts").alias("_start"), F.max("ts").alias("_end")))
    return agg.select(
        F.concat(F.lit("CMP"), F.lpad(F.col("k").cast("string"), 3, "0")).alias("campaign_id"),
        F.concat(F.lit("Campaign "), F.col("k").cast("string")).alias("campaign_name"),
        F.to_date("_start").alias("start_date"), F.to_date("_end").alias("end_date"),
        chan.alias("channel"),
        round_half_even(F.col("_spend") * factor / F.lit(2.0)).alias("budget"),
        "orders", "revenue", "impressions", "clicks")


# ---------------------------------------------------------------- DuckDB side

def _sql_r(x: str, n: int = 2) -> str:
    return f"(round_even(({x}) * {10 ** n}.0, 0) / {10 ** n}.0)"


SALES_SQL = """v_sales AS (
  SELECT o.o_orderdate AS date, l.l_extendedprice * (1 - l.l_discount) AS amount,
         l.l_quantity AS qty, p.p_brand AS category, p.p_name AS product, r.r_name AS region,
         n.n_name AS city, o.o_custkey AS customer, c.c_mktsegment AS customer_tier,
         o.o_orderkey AS order_id
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)"""

EVENTS_SQL = """v_events AS (
  SELECT ts AS date, value AS amount, event_type AS category, user_id AS customer FROM events)"""

ECOM_SQL = f"""v_ecom_raw AS (
  SELECT l.l_orderkey AS order_id, o.o_custkey AS customer_id, l.l_partkey AS product_id,
         p.p_brand AS category, l.l_quantity AS quantity,
         {_sql_r('l.l_extendedprice / l.l_quantity')} AS unit_price,
         {_sql_r('l.l_extendedprice / l.l_quantity * (CAST(0.25 AS DOUBLE) + CAST(0.12 AS DOUBLE) * (l.l_partkey % 6))')} AS cost_price,
         o.o_orderdate AS order_date
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey),
v_ecom AS (
  SELECT *, quantity * unit_price AS revenue, quantity * cost_price AS cost,
         quantity * unit_price - quantity * cost_price AS profit
  FROM v_ecom_raw)"""

PRODUCTS_SQL = """v_products AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS category,
         p_retailprice AS sell_price, (p_partkey * 37) % 400 AS stock_quantity,
         CAST(p_size * 4 AS BIGINT) AS reorder_level
  FROM part)"""

CAMPAIGNS_SQL = f"""v_camp_raw AS (
  SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type, value, ts
  FROM events),
v_camp_agg AS (
  SELECT k,
    COALESCE(CAST(SUM(CAST(CASE WHEN event_type IN ('signup', 'error') THEN value END
                           AS DECIMAL(18,2))) AS DOUBLE), 0.0) AS spend,
    COUNT(CASE WHEN event_type = 'purchase' THEN 1 END) AS orders,
    COALESCE(CAST(SUM(CAST(CASE WHEN event_type = 'purchase' THEN value END
                           AS DECIMAL(18,2))) AS DOUBLE), 0.0) AS revenue,
    COUNT(*) AS impressions,
    COUNT(CASE WHEN event_type = 'click' THEN 1 END) AS clicks,
    MIN(ts) AS s, MAX(ts) AS e
  FROM v_camp_raw WHERE k IS NOT NULL GROUP BY k),
v_campaigns AS (
  SELECT 'CMP' || lpad(CAST(k AS VARCHAR), 3, '0') AS campaign_id,
         'Campaign ' || CAST(k AS VARCHAR) AS campaign_name,
         CAST(s AS DATE) AS start_date, CAST(e AS DATE) AS end_date,
         ['{"', '".join(CHANNELS)}'][k % 5 + 1] AS channel,
         {_sql_r(f"spend * [{', '.join(f'CAST({f!r} AS DOUBLE)' for f in BUDGET_FACTORS)}][k % 5 + 1] / CAST(2.0 AS DOUBLE)")} AS budget,
         orders, revenue, impressions, clicks
  FROM v_camp_agg)"""


def with_views(sql: str, *views: str) -> str:
    """Prefix ``sql`` (which starts with SELECT or is a CTE body) with views."""
    body = sql.strip()
    m = re.match(r"(?i)WITH\s+RECURSIVE\s", body)
    if m:
        return "WITH RECURSIVE " + ",\n".join(views) + ",\n" + body[m.end():]
    if re.match(r"(?i)WITH\s", body):
        return "WITH " + ",\n".join(views) + ",\n" + body[5:]
    return "WITH " + ",\n".join(views) + "\n" + body


def dirty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with missing values and outliers at fixed positions, for the
    data-quality operators (the driver tables have neither).  Every row is kept."""
    li = _read(spark, sf_dir, "lineitem")
    h = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.when(h % 13 != 0, F.when(h % 101 == 0, F.col("l_quantity") * 50).otherwise(F.col("l_quantity"))).alias("quantity"),
        F.when(h % 97 == 0, F.col("l_extendedprice") * 20).otherwise(F.col("l_extendedprice")).alias("price"),
        F.when(h % 17 != 0, F.when(h % 103 == 0, F.col("l_discount") - 5).otherwise(F.col("l_discount"))).alias("discount"),
        F.when(h % 11 != 0, F.col("l_returnflag")).alias("returnflag"),
        F.col("l_linestatus").alias("linestatus"))


DIRTY_SQL = """v_dirty AS (
  SELECT l_orderkey, l_linenumber,
    CASE WHEN (l_orderkey * 7 + l_linenumber) % 13 <> 0
      THEN CASE WHEN (l_orderkey * 7 + l_linenumber) % 101 = 0 THEN l_quantity * 50 ELSE l_quantity END END AS quantity,
    CASE WHEN (l_orderkey * 7 + l_linenumber) % 97 = 0 THEN l_extendedprice * 20 ELSE l_extendedprice END AS price,
    CASE WHEN (l_orderkey * 7 + l_linenumber) % 17 <> 0
      THEN CASE WHEN (l_orderkey * 7 + l_linenumber) % 103 = 0 THEN l_discount - 5 ELSE l_discount END END AS discount,
    CASE WHEN (l_orderkey * 7 + l_linenumber) % 11 <> 0 THEN l_returnflag END AS returnflag,
    l_linestatus AS linestatus
  FROM lineitem)"""


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty line items, one in 29 of them twice."""
    dirty = dirty_lines(spark, sf_dir)
    return dirty.unionByName(dirty.where((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 29 == 0))


REPEATED_SQL = DIRTY_SQL + """,
v_repeated AS (SELECT * FROM v_dirty UNION ALL SELECT * FROM v_dirty WHERE (l_orderkey * 7 + l_linenumber) % 29 = 0)"""


def nan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty line items with NaN in place of some of their numbers (NaN is
    missing, as NULL is), and the ship date."""
    li = _read(spark, sf_dir, "lineitem")
    h = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    nan = F.lit(float("nan"))
    return li.select(
        "l_orderkey", "l_linenumber",
        F.when(h % 13 == 0, F.lit(None)).when(h % 19 == 0, nan).otherwise(F.col("l_quantity")).cast("double").alias("quantity"),
        F.when(h % 23 == 0, nan).otherwise(F.col("l_extendedprice")).alias("price"),
        F.col("l_linestatus").alias("linestatus"), F.col("l_shipdate").alias("date"))


NAN_SQL = """v_nan AS (
  SELECT l_orderkey, l_linenumber,
    CAST(CASE WHEN (l_orderkey * 7 + l_linenumber) % 13 <> 0 AND (l_orderkey * 7 + l_linenumber) % 19 <> 0
              THEN l_quantity END AS DOUBLE) AS quantity,
    CASE WHEN (l_orderkey * 7 + l_linenumber) % 23 <> 0 THEN l_extendedprice END AS price,
    l_linestatus AS linestatus, l_shipdate AS date
  FROM lineitem)"""
