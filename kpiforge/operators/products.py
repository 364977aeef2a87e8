"""Product operators over prepared orders (+ optional product catalogue).

Join keys are compared as strings on both sides, as the reference does, and
``product_id`` is a string in every output.  NaN counts as missing.  ``scale``
declares the decimal places of DOUBLE amounts (see ``functions.numeric``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge.functions.columns import nan_as_null
from kpiforge.functions.numeric import money_sum, round_half_even, safe_div

# The reference's stock-status labels and advice texts.
STATUS_LOW = "低库存"
STATUS_OK = "正常"
STATUS_AMPLE = "充足"
RESTOCK_NOW = "立即补货，建议补货量 "
RESTOCK_SOON_PREFIX = "准备补货，预计 "
RESTOCK_SOON_SUFFIX = " 天后库存不足"
RESTOCK_FINE = "库存充足"
PRICE_NO_DATA = "数据不足"
PRICE_RAISE_PREFIX = "建议提价 "
PRICE_RAISE_SUFFIX = "% 或优化成本"
PRICE_EXCELLENT = "利润率优秀，可考虑促销扩大销量"
PRICE_FINE = "价格策略合理"


def _require(products: DataFrame | None, method: str) -> DataFrame:
    if products is None:
        raise ValueError(f"{method} needs a products table (stock / price columns)")
    return nan_as_null(products)


def _per_product(orders: DataFrame, scale: int | None) -> DataFrame:
    return (nan_as_null(orders).where(F.col("product_id").isNotNull())
            .groupBy(F.col("product_id").cast("string").alias("product_id"))
            .agg(money_sum(F.col("quantity"), scale).alias("quantity"),
                 money_sum(F.col("revenue"), scale).alias("revenue"),
                 money_sum(F.col("profit"), scale).alias("profit")))


def _attributes(products: DataFrame) -> DataFrame:
    keep = [c for c in ("product_name", "category") if c in products.columns]
    return products.select(F.col("product_id").cast("string").alias("product_id"), *keep)


def sales_ranking(orders: DataFrame, products: DataFrame | None = None,
                  top_n: int = 10, scale: int | None = None) -> DataFrame:
    """K1 — best sellers: quantity / revenue / profit per product, revenue desc,
    first ``top_n`` (ties: product_id ascending).

    The top-n is taken *before* the catalogue join (a TakeOrdered over the
    per-product aggregate), so the join has ``top_n`` rows on one side; Spark
    broadcasts that side where its size allows it.  Duplicate catalogue rows fan
    out exactly as a full join followed by head(n) would.
    """
    order = [F.desc("revenue"), F.asc("product_id")]
    top = _per_product(orders, scale).orderBy(*order).limit(top_n)
    if products is None:
        return top
    attrs = _attributes(nan_as_null(products))
    extra = [F.asc_nulls_first(c) for c in attrs.columns if c != "product_id"]
    return top.join(attrs, "product_id", "left").orderBy(*order, *extra).limit(top_n)


def profit_analysis(orders: DataFrame, products: DataFrame | None = None,
                    scale: int | None = None) -> DataFrame:
    """K2 — profit, revenue, quantity and profit_margin (%, 2 dp; NULL when
    revenue is 0) per product, with catalogue attributes, profit desc."""
    per = _per_product(orders, scale).select(
        "product_id", "profit", "revenue", "quantity",
        round_half_even(safe_div(F.col("profit"), F.col("revenue")) * F.lit(100.0))
        .alias("profit_margin"))
    if products is not None:
        per = per.join(_attributes(nan_as_null(products)), "product_id", "left")
    return per.orderBy(F.desc("profit"), F.asc("product_id"))


def category_performance(orders: DataFrame, scale: int | None = None) -> DataFrame:
    """A4 — quantity, revenue, profit, order_count (non-null order ids) and
    avg_order_value per category, revenue desc."""
    g = (nan_as_null(orders).where(F.col("category").isNotNull()).groupBy("category")
         .agg(money_sum(F.col("quantity"), scale).alias("quantity"),
              money_sum(F.col("revenue"), scale).alias("revenue"),
              money_sum(F.col("profit"), scale).alias("profit"),
              F.count("order_id").alias("order_count")))
    return (g.withColumn("avg_order_value",
                         round_half_even(safe_div(F.col("revenue"), F.col("order_count"))))
            .orderBy(F.desc("revenue"), F.asc("category")))


def stock_status(stock: Column, reorder: Column) -> Column:
    """P3 — low if stock <= reorder, ample if stock > 2 * reorder, else normal."""
    return (F.when(stock <= reorder, F.lit(STATUS_LOW))
            .when(stock > reorder * 2, F.lit(STATUS_AMPLE))
            .otherwise(F.lit(STATUS_OK)))


def inventory_status(orders: DataFrame, products: DataFrame | None,
                     scale: int | None = None) -> DataFrame:
    """PR4 — every catalogue row with stock_status, sold_qty (0 if unsold) and
    turnover_rate = sold / stock * 100 (2 dp; NULL at zero stock)."""
    prod = _require(products, "inventory_status")
    sold = (nan_as_null(orders).where(F.col("product_id").isNotNull())
            .groupBy(F.col("product_id").cast("string").alias("product_id"))
            .agg(money_sum(F.col("quantity"), scale).alias("sold_qty")))
    inv = prod.withColumn("stock_status", stock_status(F.col("stock_quantity"),
                                                       F.col("reorder_level")))
    inv = inv.withColumn("product_id", F.col("product_id").cast("string"))
    inv = inv.join(sold, "product_id", "left").withColumn(
        "sold_qty", F.coalesce(F.col("sold_qty"), F.lit(0.0)))
    return inv.withColumn("turnover_rate", round_half_even(
        safe_div(F.col("sold_qty"), F.col("stock_quantity")) * F.lit(100.0)))


def low_stock(orders: DataFrame, products: DataFrame | None, scale: int | None = None) -> DataFrame:
    """P4 — inventory rows whose status is low."""
    return inventory_status(orders, products, scale).where(F.col("stock_status") == STATUS_LOW)


def restock_recommendations(orders: DataFrame, products: DataFrame | None,
                            days_span: int = 25, scale: int | None = None) -> DataFrame:
    """PR5 — daily_sales = sold / max(span, 1) (1 dp); days_remaining = stock /
    daily_sales (1 dp, NULL when no sales); a recommendation text; only rows
    with stock <= 1.5 * reorder level."""
    inv = inventory_status(orders, products, scale)
    span = float(max(int(days_span), 1))
    daily = round_half_even(F.col("sold_qty") / F.lit(span), 1)
    inv = inv.withColumn("daily_sales", daily)
    inv = inv.withColumn("days_remaining", round_half_even(
        safe_div(F.col("stock_quantity"), F.col("daily_sales")), 1))
    reco = (F.when(F.col("stock_quantity") <= F.col("reorder_level"),
                   F.concat(F.lit(RESTOCK_NOW),
                            (F.col("daily_sales") * F.lit(15)).cast("long").cast("string")))
            .when(F.col("days_remaining").isNotNull() & (F.col("days_remaining") < 10),
                  F.concat(F.lit(RESTOCK_SOON_PREFIX),
                           F.col("days_remaining").cast("long").cast("string"),
                           F.lit(RESTOCK_SOON_SUFFIX)))
            .otherwise(F.lit(RESTOCK_FINE)))
    return (inv.withColumn("recommendation", reco)
            .where(F.col("stock_quantity") <= F.col("reorder_level") * F.lit(1.5)))


def price_suggestions(orders: DataFrame, products: DataFrame | None,
                      scale: int | None = None) -> DataFrame:
    """PR6 — pricing advice from each product's profit margin."""
    _require(products, "price_suggestions")
    prof = profit_analysis(orders, products, scale)
    m = F.col("profit_margin")
    sugg = (F.when(m.isNull(), F.lit(PRICE_NO_DATA))
            .when(m < 30, F.concat(F.lit(PRICE_RAISE_PREFIX),
                                   ((F.lit(35.0) - m) / F.lit(10.0) * F.lit(5.0))
                                   .cast("long").cast("string"),
                                   F.lit(PRICE_RAISE_SUFFIX)))
            .when(m > 60, F.lit(PRICE_EXCELLENT))
            .otherwise(F.lit(PRICE_FINE)))
    keep = [c for c in ("product_id", "product_name", "profit_margin") if c in prof.columns]
    return prof.withColumn("price_suggestion", sugg).select(*keep, "price_suggestion")
