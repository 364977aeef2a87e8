"""Sales-ledger operators: KPI summary, trends, anomalies, breakdowns, v1 stats.

All take a ledger DataFrame plus a ``ColumnMap`` (default: the reference's
Chinese column names) and return lazy DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.functions.columns import ColumnMap, as_timestamp, to_logical
from kpiforge.functions.joins import attach_one_row
from kpiforge.functions.numeric import money_sum, partial_total, safe_div, total_value
from kpiforge.functions.periods import (fill_gaps, norm_freq, period_end, period_number, period_start, placed, start_of_number,
                                        sums_by_period)


def _ledger(df: DataFrame, cols, wanted, required=("date", "amount")) -> DataFrame:
    return to_logical(df, cols, list(wanted), list(required))


def _scale(cols) -> int | None:
    return ColumnMap.of(cols).scale


def _top_key(key: str, is_row: Column) -> tuple[Column, Column]:
    """Key with the largest revenue, ties to the smallest key (pandas idxmax
    on a key-sorted groupby), and that revenue.  A scalar aggregate: no sort."""
    order = F.when(is_row & F.col(key).isNotNull(), F.struct(-F.col("_rev"), F.col(key)))
    return (F.min_by(F.col(key), order),
            F.max(F.when(is_row & F.col(key).isNotNull(), F.col("_rev"))))


def summary(df: DataFrame, cols: ColumnMap | dict | None = None, *, strict: bool = False,
            approx_customers: bool = False) -> DataFrame:
    """A1 — one KPI row.

    n_records, date_start, date_end, total_revenue, total_orders (= rows),
    avg_order_value, top_category(+_revenue), top_region(+_revenue), n_customers,
    growth_first_to_last_month (NULL with < 2 months or first month <= 0).

    The ledger is added up once by day, category and region; grouping sets over
    that small table give the totals per category, region and month and the grand
    total, and a scalar aggregate the row.  Distinct customers are counted on the
    customer column alone.  Empty input gives zero rows; ``strict=True`` raises
    like the reference (costs a job).  ``approx_customers=True`` counts customers
    with HyperLogLog++ (5 % rsd error) and no shuffle of a row per customer.
    """
    led = _ledger(df, cols, ["date", "amount", "category", "region", "customer"])
    if strict and led.isEmpty():
        raise ValueError("empty ledger")
    have, scale = set(led.columns), _scale(cols)
    customers = None
    if "customer" in have:
        count = F.approx_count_distinct if approx_customers else F.count_distinct
        customers = led.agg(count("customer").alias("n_customers"))
    return _summary_of(_cube(led, scale), customers, scale)


def _cube(led: DataFrame, scale: int | None) -> DataFrame:
    """The ledger added up by day, category and region (those it has): _u (partial total
    of the amount), _v (amounts), _c (rows), _a and _b (first and last date).

    The filter always holds.  It makes every reader of the cube need all its columns,
    so that Spark finds their shuffles equal and reads the ledger once for all of them."""
    kinds = [k for k in ("category", "region") if k in led.columns]
    led = led.withColumn("date", as_timestamp(F.col("date")))
    cube = (led.groupBy(period_start(F.col("date"), "D").alias("_day"), *kinds)
            .agg(partial_total(F.col("amount"), scale).alias("_u"), F.count("amount").alias("_v"), F.count(F.lit(1)).alias("_c"),
                 F.min("date").alias("_a"), F.max("date").alias("_b")))
    return cube.where((F.col("_v") <= F.col("_c")) & (F.col("_a").isNull() | (F.col("_a") <= F.col("_b"))))


def _sums_of(cube: DataFrame, period: str, scale: int | None) -> DataFrame:
    return (cube.where(F.col("_day").isNotNull()).groupBy(period_start(F.col("_day"), period).alias("period_start"))
           .agg(total_value(F.sum("_u"), scale).alias("revenue"), F.sum("_v").alias("n_orders")))


def _totals_of(cube: DataFrame, key: str, scale: int | None) -> DataFrame:
    if key not in cube.columns:
        return cube.sparkSession.createDataFrame([], f"{key} string, revenue double")
    return (cube.where(F.col(key).isNotNull()).groupBy(key).agg(total_value(F.sum("_u"), scale).alias("revenue"))
            .orderBy(F.desc("revenue"), F.asc(key)))


def report_inputs(df: DataFrame, cols: ColumnMap | dict | None = None, z_threshold: float = 2.0) -> dict[str, DataFrame]:
    """What the written report needs, from one aggregate of the ledger and one pass over
    its customers: summary, trend (monthly), anomalies (daily), category, region."""
    scale = _scale(cols)
    led = _ledger(df, cols, ["date", "amount", "category", "region", "customer"])
    cube = _cube(led, scale)
    customers = led.agg(F.count_distinct("customer").alias("n_customers")) if "customer" in led.columns else None
    return {"summary": _summary_of(cube, customers, scale), "trend": _trend_of(_sums_of(cube, "M", scale), "M", [], "positive_prev"),
            "anomalies": _alerts_of(_sums_of(cube, "D", scale), "D", [], z_threshold),
            "category": _totals_of(cube, "category", scale), "region": _totals_of(cube, "region", scale)}


def _summary_of(cube: DataFrame, customers: DataFrame | None, scale: int | None) -> DataFrame:
    kinds = [k for k in ("category", "region") if k in cube.columns]
    cube = cube.withColumn("_month", period_start(F.col("_day"), "M"))
    keys = [*kinds, "_month"]
    gs = (cube.groupingSets([[F.col(k)] for k in keys] + [[]], *[F.col(k) for k in keys])
          .agg(total_value(F.sum("_u"), scale).alias("_rev"), F.sum("_c").alias("_n"),
               F.min("_a").alias("_d0"), F.max("_b").alias("_d1"), F.grouping_id().alias("_gid")))
    full = (1 << len(keys)) - 1

    def is_set(name: str) -> Column:
        return F.col("_gid") == F.lit(full ^ (1 << (len(keys) - 1 - keys.index(name))))

    is_all = F.col("_gid") == F.lit(full)
    aggs = [F.max(F.when(is_all, F.col("_n"))).alias("n_records"),
            F.max(F.when(is_all, F.col("_rev"))).alias("total_revenue"),
            F.max(F.when(is_all, F.col("_d0"))).alias("_dmin"),
            F.max(F.when(is_all, F.col("_d1"))).alias("_dmax")]
    for k in ("category", "region"):
        if k in keys:
            name, rev = _top_key(k, is_set(k))
            aggs += [name.cast("string").alias(f"top_{k}"),
                     F.coalesce(rev, F.lit(0.0)).alias(f"top_{k}_revenue")]
        else:
            aggs += [F.lit(None).cast("string").alias(f"top_{k}"),
                     F.lit(0.0).alias(f"top_{k}_revenue")]
    m = F.when(is_set("_month") & F.col("_month").isNotNull(), F.col("_month"))
    aggs += [F.min_by(F.col("_rev"), m).alias("_first"), F.max_by(F.col("_rev"), m).alias("_last"),
             F.min(m).alias("_m0"), F.max(m).alias("_m1")]
    growth = F.when((F.col("_m1") > F.col("_m0")) & (F.col("_first") > 0),
                    (F.col("_last") / F.col("_first") - F.lit(1)) * F.lit(100.0))
    out = attach_one_row(gs.agg(*aggs), customers) if customers is not None else gs.agg(*aggs, F.lit(0).alias("n_customers"))
    return out.where(F.col("n_records") > 0).select(
        "n_records",
        F.date_format("_dmin", "yyyy-MM-dd").alias("date_start"),
        F.date_format("_dmax", "yyyy-MM-dd").alias("date_end"),
        "total_revenue",
        F.col("n_records").alias("total_orders"),
        (F.col("total_revenue") / F.col("n_records")).alias("avg_order_value"),
        "top_category", "top_category_revenue", "top_region", "top_region_revenue",
        F.col("n_customers").cast("long").alias("n_customers"),
        growth.alias("growth_first_to_last_month"))


def trend(df: DataFrame, period: str = "M", cols: ColumnMap | dict | None = None, *,
          group_cols: Sequence[str] = (), growth_rule: str = "positive_prev") -> DataFrame:
    """T1 — gap-filled revenue and row count per period with period-on-period growth.

    growth_pct = (revenue / previous - 1) * 100; NULL for the first period and,
    with the default rule, when the previous period is <= 0.  ``growth_rule=
    "pct_change"`` is the v1 rule (any non-zero previous; zero gives NULL where
    pandas gives inf).  Columns: *group_cols, period, revenue, n_orders, growth_pct.
    """
    g = list(group_cols)
    led = _grouped_ledger(df, cols, g)
    led = led.withColumn("date", as_timestamp(F.col("date")))
    return _trend_of(sums_by_period(led, period, group_cols=g, scale=_scale(cols)), period, g, growth_rule)


def _trend_of(agg: DataFrame, period: str, g: list[str], growth_rule: str) -> DataFrame:
    prev = F.col("before")
    if growth_rule == "positive_prev":
        growth = F.when(prev > 0, (F.col("revenue") / prev - F.lit(1)) * F.lit(100.0))
    elif growth_rule == "pct_change":
        growth = (safe_div(F.col("revenue"), prev) - F.lit(1)) * F.lit(100.0)
    else:
        raise ValueError(f"unknown growth_rule {growth_rule!r}")
    return fill_gaps(agg, period, g, with_before=True).select(*g, "period", "revenue", "n_orders", growth.alias("growth_pct"))


def _grouped_ledger(df: DataFrame, cols, group_cols: list[str]) -> DataFrame:
    """Ledger with date/amount mapped and physical group columns kept."""
    return to_logical(df, cols, ["date", "amount"], ["date", "amount"], keep=group_cols)


def anomalies(df: DataFrame, period: str = "D", z_threshold: float = 2.0,
              cols: ColumnMap | dict | None = None, *, window: int = 14, min_periods: int = 3,
              min_history: int = 5, group_cols: Sequence[str] = ()) -> DataFrame:
    """T2 — rolling z-score alerts on the gap-filled series.

    The frame holds ``window`` periods *including* the current one and needs at
    least ``min_periods`` values; sigma < 1e-9 is skipped; |z| >= threshold is
    an alert ("spike" if z > 0 else "drop").  A series with fewer than
    ``min_history`` periods yields nothing.  Because the frame contains the
    point itself, |z| <= (window-1)/sqrt(window) (3.474 for 14): higher
    thresholds never fire.
    """
    g = list(group_cols)
    led = _grouped_ledger(df, cols, g).withColumn("date", as_timestamp(F.col("date")))
    return _alerts_of(sums_by_period(led, period, group_cols=g, scale=_scale(cols)), period, g, z_threshold, window, min_periods, min_history)


#: Periods of a series that one task scores at once.
BLOCK = 4096


def _alerts_of(agg: DataFrame, period: str, g: list[str], z_threshold: float, window: int = 14, min_periods: int = 3,
               min_history: int = 5) -> DataFrame:
    """The alerts of the periods that have rows (``*g, period_start, revenue, n_orders``).

    A frame without data has no spread and no alert, so of an empty stretch only the
    ``window - 1`` periods beside data are made.  A series is scored in blocks; a block
    gets the ``window - 1`` periods before it as well, so no task holds a series.
    """
    halo = window - 1
    rows = placed(agg, period, g)
    near = F.explode(F.sequence(F.greatest(F.lit(0), F.col("t") - halo), F.least(F.col("n") - 1, F.col("t") + halo))).alias("_at")
    rows = rows.where(F.col("n") >= min_history).select(*g, "n", "t", "revenue", (period_number(F.col("period_start"), period) - F.col("t")).alias("_low"), near)
    rows = rows.groupBy(*g, F.col("_at").alias("t"), "_low").agg(
        F.coalesce(F.max(F.when(F.col("t") == F.col("_at"), F.col("revenue"))), F.lit(0.0)).alias("revenue"))
    block = F.floor(F.col("t") / F.lit(BLOCK))
    blocks = F.when(F.pmod("t", F.lit(BLOCK)) >= BLOCK - halo, F.array(block, block + 1)).otherwise(F.array(block)) if halo else F.array(block)
    rows = rows.select("*", F.explode(blocks).alias("_block"))
    w = Window.partitionBy(*g, "_block").orderBy("t").rangeBetween(-halo, 0)
    rows = rows.withColumns({"_mu": F.avg("revenue").over(w), "_sd": F.stddev_samp("revenue").over(w)})
    # the calendar has t + 1 periods up to t, all of them in the frame or empty like it
    scored = rows.where((F.col("_block") == block) & (F.least(F.col("t") + 1, F.lit(window)) >= min_periods) & (F.col("_sd") >= F.lit(1e-9)))
    z = (F.col("revenue") - F.col("_mu")) / F.col("_sd")
    label = period_end(start_of_number(F.col("_low") + F.col("t"), period), period)
    return (scored.select(*g, label.alias("period"), F.col("revenue").alias("actual"),
                          F.col("_mu").alias("expected"), z.alias("z_score"))
            .where(F.abs(F.col("z_score")) >= F.lit(float(z_threshold)))
            .withColumn("direction", F.when(F.col("z_score") > 0, F.lit("spike"))
                        .otherwise(F.lit("drop"))))


def _breakdown(df: DataFrame, key: str, cols) -> DataFrame:
    cmap = ColumnMap.of(cols)
    if not cmap.has(df, key):
        return df.sparkSession.createDataFrame([], f"{key} string, revenue double")
    led = _ledger(df, cols, ["amount", key], required=("amount",))
    return (led.where(F.col(key).isNotNull()).groupBy(key)
            .agg(money_sum(F.col("amount"), _scale(cols)).alias("revenue"))
            .orderBy(F.desc("revenue"), F.asc(key)))


def category_breakdown(df: DataFrame, cols: ColumnMap | dict | None = None) -> DataFrame:
    """A7 — revenue per category, descending; empty if the column is absent."""
    return _breakdown(df, "category", cols)


def region_breakdown(df: DataFrame, cols: ColumnMap | dict | None = None) -> DataFrame:
    """A8 — revenue per region, descending; empty if the column is absent."""
    return _breakdown(df, "region", cols)


def regional_stats(df: DataFrame, cols: ColumnMap | dict | None = None) -> DataFrame:
    """A9 (v1) — sum, mean and non-null count of the amount per region."""
    led = _ledger(df, cols, ["amount", "region"], required=("amount", "region"))
    return (led.where(F.col("region").isNotNull()).groupBy("region")
            .agg(money_sum(F.col("amount"), _scale(cols)).alias("total_revenue"),
                 F.count("amount").alias("n_orders"))
            .select("region", "total_revenue",
                    safe_div(F.col("total_revenue"), F.col("n_orders")).alias("avg_revenue"),
                    "n_orders"))


def product_totals(df: DataFrame, cols: ColumnMap | dict | None = None) -> DataFrame:
    """A10 (v1) — amount and quantity per category and per product, one pass.

    Columns: level ('category' | 'product'), item, revenue, quantity.
    """
    led = _ledger(df, cols, ["amount", "qty", "category", "product"],
                  required=("amount", "qty", "category", "product"))
    gs = (led.groupingSets([[F.col("category")], [F.col("product")]], "category", "product")
          .agg(money_sum(F.col("amount"), _scale(cols)).alias("revenue"),
               money_sum(F.col("qty"), _scale(cols)).alias("quantity"),
               F.grouping_id().alias("_gid")))
    level = F.when(F.col("_gid") == 1, F.lit("category")).otherwise(F.lit("product"))
    item = F.when(F.col("_gid") == 1, F.col("category")).otherwise(F.col("product"))
    return (gs.select(level.alias("level"), item.cast("string").alias("item"), "revenue", "quantity")
            .where(F.col("item").isNotNull()))


def top_products(df: DataFrame, n: int = 10, cols: ColumnMap | dict | None = None) -> DataFrame:
    """K3 (v1) — the ``n`` products with the largest amount (ties: product
    ascending), with their quantity: a TakeOrdered over the per-product totals."""
    led = _ledger(df, cols, ["amount", "qty", "product"], required=("amount", "qty", "product"))
    per = (led.where(F.col("product").isNotNull()).groupBy("product")
           .agg(money_sum(F.col("amount"), _scale(cols)).alias("revenue"),
                money_sum(F.col("qty"), _scale(cols)).alias("quantity")))
    return per.orderBy(F.desc("revenue"), F.asc("product")).limit(int(n))


def summary_statistics(df: DataFrame, cols: ColumnMap | dict | None = None) -> DataFrame:
    """A11 (v1) — one row of statistics; each present only if its column exists."""
    led = _ledger(df, cols, ["date", "amount", "qty", "customer", "order_id"], required=())
    have, scale = set(led.columns), _scale(cols)
    aggs, order = [], []
    if "amount" in have:
        aggs += [money_sum(F.col("amount"), scale).alias("total_revenue"),
                 safe_div(money_sum(F.col("amount"), scale), F.count("amount")).alias("avg_revenue"),
                 F.max("amount").alias("max_revenue"), F.min("amount").alias("min_revenue")]
        order += ["total_revenue", "avg_revenue", "max_revenue", "min_revenue"]
    if "qty" in have:
        aggs += [money_sum(F.col("qty"), scale).alias("total_quantity"),
                 safe_div(money_sum(F.col("qty"), scale), F.count("qty")).alias("avg_quantity")]
        order += ["total_quantity", "avg_quantity"]
    distinct = [(c, n) for c, n in (("customer", "n_customers"), ("order_id", "n_orders")) if c in have]
    order += [n for _, n in distinct]
    if "date" in have:
        d = as_timestamp(F.col("date"))
        aggs.append(F.concat(F.date_format(F.min(d), "yyyy-MM-dd"), F.lit(" 至 "),
                             F.date_format(F.max(d), "yyyy-MM-dd")).alias("date_range"))
        order.append("date_range")
    if not order:
        return led.sparkSession.createDataFrame([], "empty string")
    # a distinct count reads its column alone: two in one aggregate would triple the rows
    out = led.agg(*aggs) if aggs else None
    for c, n in distinct:
        one = led.agg(F.count_distinct(c).alias(n))
        out = one if out is None else attach_one_row(out, one)
    return out.select(*order)


def trend_headline(df: DataFrame, period: str = "M",
                   cols: ColumnMap | dict | None = None) -> DataFrame:
    """A16 — highest / lowest period revenue and growth last vs first period."""
    led = _ledger(df, cols, ["date", "amount"]).withColumn("date", as_timestamp(F.col("date")))
    # the periods with rows; of the empty ones only their number matters, which the calendar gives
    number = period_number(F.col("period_start"), period)
    found = sums_by_period(led, norm_freq(period), scale=_scale(cols)).agg(
        F.max("revenue").alias("_max"), F.min("revenue").alias("_min"), F.count(F.lit(1)).alias("_n"),
        F.min_by("revenue", "period_start").alias("_first"), F.max_by("revenue", "period_start").alias("_last"),
        (F.max(number) - F.min(number) + 1).alias("_all"))
    gaps = F.col("_all") > F.col("_n")
    return found.select(
        F.when(gaps, F.greatest("_max", F.lit(0.0))).otherwise(F.col("_max")).alias("max_revenue"),
        F.when(gaps, F.least("_min", F.lit(0.0))).otherwise(F.col("_min")).alias("min_revenue"),
        F.coalesce("_all", F.lit(0)).cast("bigint").alias("n_periods"),
        F.when(F.col("_all") > 1, safe_div(F.col("_last") - F.col("_first"), F.col("_first")) * F.lit(100.0)).alias("growth_pct"))
