"""E-commerce order operators: enrichment, overview KPIs, repeat purchase."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiforge.functions.columns import nan_as_null
from kpiforge.functions.numeric import money_sum, round_half_even, safe_div


def prepare_orders(df: DataFrame) -> DataFrame:
    """P1 — add revenue / cost / profit; idempotent, never overwrites a column.

    revenue = quantity * unit_price; cost = quantity * cost_price; profit =
    revenue - cost, or revenue when no cost is known.  ``order_date`` is parsed
    leniently (bad values become NULL, as pandas ``errors='coerce'``); NaN becomes NULL.
    """
    out = df = nan_as_null(df)
    cols = set(df.columns)
    if "order_date" in cols:
        dtype = df.schema["order_date"].dataType
        if not isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            out = out.withColumn("order_date", F.try_to_timestamp(F.col("order_date").cast("string")))
    new = {}
    if "revenue" not in cols:
        new["revenue"] = F.col("quantity") * F.col("unit_price")
    if "cost" not in cols and "cost_price" in cols:
        new["cost"] = F.col("quantity") * F.col("cost_price")
    if "profit" not in cols:
        rev = new.get("revenue", F.col("revenue"))
        if "cost" in cols or "cost" in new:
            new["profit"] = rev - new.get("cost", F.col("cost"))
        else:
            new["profit"] = rev
    return out.withColumns(new) if new else out


def overview_metrics(orders: DataFrame, scale: int | None = None) -> DataFrame:
    """A2 — n_orders, total_revenue, total_profit, profit_margin_pct (0 if no
    revenue), avg_order_value, unique_customers; zeros on empty input."""
    orders = nan_as_null(orders)
    cols = set(orders.columns)
    n = F.count(F.lit(1))
    rev = money_sum(F.col("revenue"), scale)
    prof = money_sum(F.col("profit"), scale) if "profit" in cols else F.lit(0.0)
    cust = (F.count_distinct("customer_id") if "customer_id" in cols
            else F.lit(0)).cast("long")
    g = orders.agg(n.alias("n_orders"), rev.alias("total_revenue"),
                   prof.alias("total_profit"), cust.alias("unique_customers"))
    return g.select(
        "n_orders", "total_revenue", "total_profit",
        F.when(F.col("total_revenue") != 0,
               F.col("total_profit") / F.col("total_revenue") * F.lit(100.0))
        .otherwise(F.lit(0.0)).alias("profit_margin_pct"),
        F.when(F.col("n_orders") > 0, F.col("total_revenue") / F.col("n_orders"))
        .otherwise(F.lit(0.0)).alias("avg_order_value"),
        "unique_customers")


def repeat_purchase(orders: DataFrame) -> DataFrame:
    """A3 — total_customers, repeat_customers (> 1 order row), repeat_rate_pct,
    avg_orders_per_customer (both rounded to 2).  Two-level aggregate: the
    per-customer counts are combined map-side before the single final row."""
    spark = orders.sparkSession
    if "customer_id" not in orders.columns:
        return spark.createDataFrame(
            [(0, 0, 0.0, 0.0)],
            "total_customers long, repeat_customers long, repeat_rate_pct double, "
            "avg_orders_per_customer double")
    per = (orders.where(F.col("customer_id").isNotNull())
           .groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")))
    g = per.agg(F.count(F.lit(1)).alias("total_customers"),
                F.count_if(F.col("n") > 1).alias("repeat_customers"),
                F.sum("n").alias("_rows"))
    return g.select(
        "total_customers", "repeat_customers",
        F.coalesce(round_half_even(safe_div(F.col("repeat_customers"), F.col("total_customers"))
                                   * F.lit(100.0)), F.lit(0.0)).alias("repeat_rate_pct"),
        F.coalesce(round_half_even(safe_div(F.col("_rows"), F.col("total_customers"))),
                   F.lit(0.0)).alias("avg_orders_per_customer"))
