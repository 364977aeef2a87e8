"""One function per reference subcommand, returning named lazy DataFrames.

Multi-output subcommands return ``dict[str, DataFrame]``; nothing runs until
the caller acts on (or writes) a frame.  When several frames of one bundle
are materialised together, the shared per-product / per-channel aggregate
can be persisted by the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from kpiforge.functions.columns import ColumnMap
from kpiforge.operators import forecast, marketing, narrative, orders, products, sales, segments


def summary(ledger: DataFrame, cols: ColumnMap | dict | None = None) -> DataFrame:
    return sales.summary(ledger, cols)


def trend(ledger: DataFrame, period: str = "M", cols=None) -> DataFrame:
    return sales.trend(ledger, period, cols)


def anomalies(ledger: DataFrame, period: str = "D", z: float = 2.0, cols=None) -> DataFrame:
    return sales.anomalies(ledger, period, z, cols)


def breakdown(ledger: DataFrame, cols=None) -> dict[str, DataFrame]:
    return {"category": sales.category_breakdown(ledger, cols),
            "region": sales.region_breakdown(ledger, cols)}


def segments_bundle(ledger: DataFrame, by: str | None = None, cols=None) -> dict[str, DataFrame]:
    return {"abc_summary": segments.abc_summary(ledger, by, cols),
            "abc": segments.abc_analysis(ledger, by, cols),
            "segment_counts": segments.segment_counts(ledger, cols),
            "rfm": segments.rfm_segments(ledger, cols)}


def forecast_bundle(ledger: DataFrame, method: str = "trend", periods: int = 7,
                    freq: str = "D", window: int = 7, cols=None) -> DataFrame:
    if method == "trend":
        return forecast.linear_trend(ledger, periods, freq, cols)
    return forecast.moving_average(ledger, periods, window, freq, cols)


def commentary(ledger: DataFrame, cols=None) -> dict[str, DataFrame]:
    made = sales.report_inputs(ledger, cols)
    report = narrative.commentary_report(made["summary"], made["anomalies"])
    return {"report": report, "rows": narrative.report_rows(report),
            "markdown": narrative.markdown(report)}


def overview(order_rows: DataFrame) -> DataFrame:
    return orders.overview_metrics(orders.prepare_orders(order_rows))


def products_bundle(order_rows: DataFrame, catalogue: DataFrame | None = None,
                    top_n: int = 10) -> dict[str, DataFrame]:
    o = orders.prepare_orders(order_rows)
    out = {"category_performance": products.category_performance(o),
           "sales_ranking": products.sales_ranking(o, catalogue, top_n)}
    if catalogue is not None:
        out["low_stock"] = products.low_stock(o, catalogue)
        out["restock"] = products.restock_recommendations(o, catalogue)
    return out


def marketing_bundle(campaigns: DataFrame) -> dict[str, DataFrame]:
    return {"campaign_roi": marketing.campaign_roi(campaigns),
            "conversion": marketing.conversion_metrics(campaigns),
            "channel_performance": marketing.channel_performance(campaigns),
            "funnel": marketing.conversion_funnel(campaigns),
            "budget_allocation": marketing.budget_allocation(campaigns)}


def retention(order_rows: DataFrame) -> DataFrame:
    return orders.repeat_purchase(orders.prepare_orders(order_rows))
