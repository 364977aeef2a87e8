"""Synthetic sales ledger (IO7), generated in parallel from ``spark.range``.

One row per day from 2023-01-01; categorical picks and numbers are derived from
``xxhash64(id, salt)``, so the table is deterministic and any partition can be
regenerated independently.  Same distributions as the reference's generator,
not the same random stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.functions.columns import DEFAULT_COLUMNS

# The generator's categories with their products, regions with
# their cities, discount levels and customer tiers with their weights.
CATEGORIES = {
    "电子产品": ["手机", "电脑", "平板", "耳机"],
    "服装": ["T 恤", "裤子", "外套", "鞋子"],
    "食品": ["零食", "饮料", "生鲜", "粮油"],
    "家居": ["家具", "装饰", "厨具", "床品"],
    "图书": ["小说", "教材", "杂志", "漫画"],
}
REGIONS = {
    "华北": ["北京", "天津", "石家庄"],
    "华东": ["上海", "杭州", "南京"],
    "华南": ["广州", "深圳", "厦门"],
    "西南": ["成都", "重庆", "昆明"],
    "西北": ["西安", "兰州", "乌鲁木齐"],
    "东北": ["沈阳", "长春", "哈尔滨"],
}
DISCOUNTS = [(0.0, 0.5), (0.05, 0.2), (0.1, 0.15), (0.15, 0.1), (0.2, 0.05)]
TIERS = [("普通", 0.5), ("白银", 0.3), ("黄金", 0.15), ("钻石", 0.05)]


def _u(salt: int) -> Column:
    """Uniform [0, 1) from the row id and a salt."""
    return (F.abs(F.xxhash64(F.col("id"), F.lit(salt))) % F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)


def _pick(options: list[str], salt: int) -> Column:
    idx = F.floor(_u(salt) * len(options)).cast("int") + 1
    return F.element_at(F.array(*[F.lit(o) for o in options]), idx)


def _weighted(pairs: list[tuple], salt: int) -> Column:
    u = _u(salt)
    expr, acc = None, 0.0
    for value, weight in pairs:
        acc += weight
        expr = (F.when(u < acc, F.lit(value)) if expr is None else expr.when(u < acc, F.lit(value)))
    return expr.otherwise(F.lit(pairs[-1][0]))


def sample_sales(spark: SparkSession, n: int = 1000, seed: int = 42,
                 start: str = "2023-01-01") -> DataFrame:
    """IO7 — ``n`` ledger rows with the reference's Chinese column names."""
    cats = list(CATEGORIES)
    regions = list(REGIONS)
    base = spark.range(n).withColumn("id", F.col("id") * F.lit(1) + F.lit(seed * 1_000_003))
    cat = _pick(cats, 1)
    region = _pick(regions, 3)
    prod_lists = F.create_map(*[x for c in cats for x in (F.lit(c), F.array(*map(F.lit, CATEGORIES[c])))])
    city_lists = F.create_map(*[x for r in regions for x in (F.lit(r), F.array(*map(F.lit, REGIONS[r])))])
    df = base.select(
        "id",
        F.date_add(F.to_date(F.lit(start)), (F.col("id") - F.lit(seed * 1_000_003)).cast("int"))
        .alias("_day"),
        cat.alias("_cat"), region.alias("_reg"),
        (F.floor(_u(5) * 49) + 1).cast("long").alias("_qty"),
        (F.lit(10.0) + _u(6) * F.lit(4990.0)).alias("_price"),
        _weighted(DISCOUNTS, 7).alias("_disc"),
        F.concat(F.lit("C"), (F.floor(_u(8) * 8999) + 1000).cast("long").cast("string")).alias("_cust"),
        _weighted(TIERS, 9).alias("_tier"),
        F.concat(F.lit("ORD"), (F.floor(_u(10) * 899999) + 100000).cast("long").cast("string"))
        .alias("_ord"))
    pick_in = F.floor(_u(2) * F.size(F.element_at(prod_lists, F.col("_cat")))).cast("int") + 1
    city_in = F.floor(_u(4) * F.size(F.element_at(city_lists, F.col("_reg")))).cast("int") + 1
    c = DEFAULT_COLUMNS
    return df.select(
        F.col("_day").cast("timestamp").alias(c["date"]),
        F.col("_ord").alias(c["order_id"]),
        F.col("_cat").alias(c["category"]),
        F.element_at(F.element_at(prod_lists, F.col("_cat")), pick_in).alias(c["product"]),
        F.col("_reg").alias(c["region"]),
        F.element_at(F.element_at(city_lists, F.col("_reg")), city_in).alias(c["city"]),
        F.col("_qty").alias(c["qty"]),
        F.round(F.col("_price"), 2).alias(c["unit_price"]),
        F.col("_disc").alias(c["discount"]),
        F.round(F.col("_qty") * F.col("_price") * (F.lit(1.0) - F.col("_disc")), 2).alias(c["amount"]),
        F.col("_cust").alias(c["customer"]),
        F.col("_tier").alias(c["customer_tier"]))
