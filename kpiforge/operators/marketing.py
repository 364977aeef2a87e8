"""Campaign operators: ROI, conversion, channel performance, funnel,
efficiency ranking and budget allocation.

Ratios with a zero denominator are NULL (pandas gives inf/NaN, which the
reference's JSON output shows as null).  Rounding is pandas half-even; NaN
counts as missing.  ``scale`` declares the decimal places of DOUBLE amounts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.functions.columns import nan_as_null
from kpiforge.functions.numeric import money_sum, round_half_even, safe_div
from kpiforge.functions.joins import attach_one_row

# The reference's budget advice texts.
BUDGET_UP = "增加预算 - 高 ROI 渠道"
BUDGET_KEEP = "保持预算 - 表现良好"
BUDGET_DOWN = "优化或减少预算 - ROI 偏低"


def _r(c: Column, n: int = 2) -> Column:
    return round_half_even(c, n)


def _pct(a: str, b: str) -> Column:
    return safe_div(F.col(a), F.col(b)) * F.lit(100.0)


def _roi(rev: str = "revenue", budget: str = "budget") -> Column:
    return safe_div(F.col(rev) - F.col(budget), F.col(budget)) * F.lit(100.0)


def campaign_roi(campaigns: DataFrame) -> DataFrame:
    """P5 — roi %, profit, cost_per_order, revenue_per_order (2 dp), roi desc."""
    return (nan_as_null(campaigns).withColumns({
        "roi": _r(_roi()),
        "profit": _r(F.col("revenue") - F.col("budget")),
        "cost_per_order": _r(safe_div(F.col("budget"), F.col("orders"))),
        "revenue_per_order": _r(safe_div(F.col("revenue"), F.col("orders"))),
    }).orderBy(F.desc_nulls_last("roi"), F.asc("campaign_id")))


def _conversion_cols() -> dict[str, Column]:
    return {
        "ctr": _r(_pct("clicks", "impressions")),
        "cvr": _r(_pct("orders", "clicks")),
        "overall_conversion": _r(_pct("orders", "impressions")),
        "cpc": _r(safe_div(F.col("budget"), F.col("clicks"))),
        "cpa": _r(safe_div(F.col("budget"), F.col("orders"))),
    }


def conversion_metrics(campaigns: DataFrame) -> DataFrame:
    """P6 — ctr, cvr, overall_conversion (%), cpc, cpa (2 dp), cvr desc."""
    return (nan_as_null(campaigns).withColumns(_conversion_cols())
            .orderBy(F.desc_nulls_last("cvr"), F.asc("campaign_id")))


def channel_performance(campaigns: DataFrame, scale: int | None = None) -> DataFrame:
    """A5 — sums per channel, then roi/ctr/cvr/cpc/cpa from the sums, revenue desc."""
    return _channel_metrics(campaigns, scale).orderBy(F.desc("revenue"), F.asc("channel"))


def _channel_metrics(campaigns: DataFrame, scale: int | None, keep_null: bool = False) -> DataFrame:
    campaigns = nan_as_null(campaigns)
    base = campaigns if keep_null else campaigns.where(F.col("channel").isNotNull())
    g = (base.groupBy("channel")
         .agg(money_sum(F.col("budget"), scale).alias("budget"),
              F.coalesce(F.sum("orders"), F.lit(0)).cast("long").alias("orders"),
              money_sum(F.col("revenue"), scale).alias("revenue"),
              F.coalesce(F.sum("impressions"), F.lit(0)).cast("long").alias("impressions"),
              F.coalesce(F.sum("clicks"), F.lit(0)).cast("long").alias("clicks")))
    return (g.withColumns({
        "roi": _r(_roi()),
        "ctr": _r(_pct("clicks", "impressions")),
        "cvr": _r(_pct("orders", "clicks")),
        "cpc": _r(safe_div(F.col("budget"), F.col("clicks"))),
        "cpa": _r(safe_div(F.col("budget"), F.col("orders"))),
    }))


def conversion_funnel(campaigns: DataFrame, campaign_id: str | None = None) -> DataFrame:
    """A6 — impressions → clicks → orders with ctr, cvr (2 dp) and
    overall_conversion (4 dp); 0 when a denominator is 0.  With ``campaign_id``
    the first matching row is used (ties broken by the row's values); an
    unknown id gives no rows."""
    base = campaigns
    if campaign_id:
        base = (campaigns.where(F.col("campaign_id") == F.lit(campaign_id))
                .orderBy(*[F.asc_nulls_first(c) for c in campaigns.columns]).limit(1))
        totals = base.select(F.col("impressions").cast("long").alias("impressions"),
                             F.col("clicks").cast("long").alias("clicks"),
                             F.col("orders").cast("long").alias("orders"))
    else:
        totals = base.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
                            for c in ("impressions", "clicks", "orders")])

    def ratio(a, b, n):
        return F.when(F.col(b) != 0, _r(F.col(a) / F.col(b) * F.lit(100.0), n)).otherwise(F.lit(0.0))

    return totals.select("impressions", "clicks", "orders",
                         ratio("clicks", "impressions", 2).alias("ctr"),
                         ratio("orders", "clicks", 2).alias("cvr"),
                         ratio("orders", "impressions", 4).alias("overall_conversion"))


def campaign_efficiency(campaigns: DataFrame) -> DataFrame:
    """K4 — efficiency_score = roi/max·40 + cvr/max·30 + ctr/max·30 on the
    rounded metrics (a component is 0 when its max is <= 0), 2 dp, desc.

    The three maxima are one global aggregate (a single row) attached to the
    rows: no window over the whole table, no single-task sort, nothing cached.
    """
    eff = nan_as_null(campaigns).withColumns({**_conversion_cols(), "roi": _r(_roi())})
    tops = eff.agg(F.max("roi").alias("_mroi"), F.max("cvr").alias("_mcvr"),
                   F.max("ctr").alias("_mctr"))
    eff = attach_one_row(eff, tops)

    def norm(c, top, weight):
        return F.when(F.col(top) > 0, F.col(c) / F.col(top) * F.lit(float(weight))) \
            .otherwise(F.col(c) * F.lit(0.0))

    eff = eff.withColumns({"roi_score": norm("roi", "_mroi", 40),
                           "cvr_score": norm("cvr", "_mcvr", 30),
                           "ctr_score": norm("ctr", "_mctr", 30)})
    eff = eff.withColumn("efficiency_score", _r(F.col("roi_score") + F.col("cvr_score")
                                                + F.col("ctr_score")))
    return eff.drop("_mroi", "_mcvr", "_mctr").orderBy(F.desc_nulls_last("efficiency_score"),
                                                      F.asc("campaign_id"))


def budget_allocation(campaigns: DataFrame, scale: int | None = None) -> DataFrame:
    """M7 — budget advice per channel from the channel ROI.

    roi > 100 → min(40, roi / max_roi * 35) % "increase"; roi > 50 → 25 %
    "keep"; else 15 % "reduce".  Percent rounded to 1 dp; amount = total budget
    · unrounded percent / 100, 2 dp.  A zero-budget channel has NULL roi: with
    positive revenue it is "increase" at 40 % (pandas: inf ROI, min(40, nan) = 40),
    otherwise "reduce".  max_roi is taken over the non-NULL channel ROIs.
    """
    # one pass: the channel aggregate keeps the NULL-channel group so that the
    # total budget covers every campaign; totals and max ROI are windows over
    # the channel rows (one row per channel)
    w = Window.partitionBy()
    ch = _channel_metrics(campaigns, scale, keep_null=True).withColumn(
        "_total", money_sum(F.col("budget"), scale, w)) \
        .where(F.col("channel").isNotNull())
    ch = ch.withColumn("_max_roi", F.max("roi").over(w))
    roi = F.col("roi")
    inf_roi = roi.isNull() & (F.col("budget") == 0) & (F.col("revenue") > 0)
    high = F.when((F.col("_max_roi").isNull()) | (F.col("_max_roi") == 0), F.lit(35.0)) \
        .otherwise(F.least(F.lit(40.0), roi / F.col("_max_roi") * F.lit(35.0)))
    pct = (F.when(inf_roi, F.lit(40.0)).when(roi > 100, high)
           .when(roi > 50, F.lit(25.0)).otherwise(F.lit(15.0)))
    reco = (F.when(inf_roi | (roi > 100), F.lit(BUDGET_UP))
            .when(roi > 50, F.lit(BUDGET_KEEP)).otherwise(F.lit(BUDGET_DOWN)))
    return (ch.withColumn("_pct", pct).select(
        "channel", roi.alias("current_roi"),
        _r(F.col("_pct"), 1).alias("suggested_budget_percent"),
        _r(F.col("_total") * F.col("_pct") / F.lit(100.0)).alias("suggested_budget_amount"),
        reco.alias("recommendation"), "revenue")
        .orderBy(F.desc("revenue"), F.asc("channel")).drop("revenue"))
