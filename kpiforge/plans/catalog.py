"""The query catalogue: one Spark query per implemented operator.

Each entry is ``f(spark, sf_dir) -> DataFrame`` over the driver tables (via
``sources.testviews``), so its work grows with the tables.  The DuckDB
equivalents live in ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.functions.columns import ColumnMap
from kpiforge.functions.cut import Cut
from kpiforge.operators import sales
from kpiforge.sources import testviews as tv

#: Decimal places of the driver tables' amounts: their sums are exact in any order.
SCALE = 4
IDENT = ColumnMap.identity(scale=SCALE)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def _ledger(spark, sf, *cols):
    return tv.sales_ledger(spark, sf, cols)


def _r6(c):
    return F.rint(F.col(c) * F.lit(1e6)) / F.lit(1e6)


# ------------------------------------------------------------------ sales (A, T)

@query("sales_summary")
def q_sales_summary(spark, sf):
    led = _ledger(spark, sf, "date", "amount", "category", "region", "customer")
    return sales.summary(led, IDENT).withColumn(
        "growth_first_to_last_month", _r6("growth_first_to_last_month"))


for _f, _n in (("D", "d"), ("W", "w"), ("M", "m"), ("Q", "q"), ("Y", "y")):
    def _mk(freq):
        def q(spark, sf):
            from kpiforge.functions.periods import resample
            led = _ledger(spark, sf, "date", "amount")
            return resample(led, freq, scale=SCALE).drop("period_start")
        return q
    QUERIES[f"resample_{_n}"] = _mk(_f)


def _trend_q(freq, source="sales"):
    def q(spark, sf):
        led = (_ledger(spark, sf, "date", "amount") if source == "sales"
               else tv.events_ledger(spark, sf))
        return sales.trend(led, freq, IDENT).withColumn("growth_pct", _r6("growth_pct"))
    return q


QUERIES["trend_monthly"] = _trend_q("M")
QUERIES["trend_weekly"] = _trend_q("W")
QUERIES["trend_quarterly"] = _trend_q("Q")
QUERIES["trend_daily_events"] = _trend_q("D", "events")


def _anom_q(freq, z=2.0, source="sales"):
    def q(spark, sf):
        led = (_ledger(spark, sf, "date", "amount") if source == "sales"
               else tv.events_ledger(spark, sf))
        out = sales.anomalies(led, freq, z, IDENT)
        return out.select("period", "actual", _r6("expected").alias("expected"),
                          _r6("z_score").alias("z_score"), "direction")
    return q


QUERIES["anomalies_daily"] = _anom_q("D")
QUERIES["anomalies_weekly"] = _anom_q("W", 1.5)
QUERIES["anomalies_daily_events"] = _anom_q("D", 1.0, "events")


@query("trend_growth_v1")
def q_trend_growth_v1(spark, sf):
    led = _ledger(spark, sf, "date", "amount")
    return sales.trend(led, "M", IDENT, growth_rule="pct_change").withColumn("growth_pct", _r6("growth_pct"))


@query("trend_by_category")
def q_trend_by_category(spark, sf):
    led = _ledger(spark, sf, "date", "amount", "category")
    return sales.trend(led, "Q", IDENT, group_cols=["category"]).withColumn("growth_pct", _r6("growth_pct"))


@query("anomalies_by_region")
def q_anomalies_by_region(spark, sf):
    out = sales.anomalies(_ledger(spark, sf, "date", "amount", "region"), "W", 1.5, IDENT, group_cols=["region"])
    return out.select("region", "period", "actual", _r6("expected").alias("expected"),
                      _r6("z_score").alias("z_score"), "direction")


@query("trend_nan_by_status")
def q_trend_nan_by_status(spark, sf):
    """A grouped trend over amounts of which some are NaN."""
    led = tv.nan_lines(spark, sf).select("date", F.col("price").alias("amount"), "linestatus")
    return sales.trend(led, "M", IDENT, group_cols=["linestatus"]).withColumn("growth_pct", _r6("growth_pct"))


@query("category_breakdown")
def q_category_breakdown(spark, sf):
    return sales.category_breakdown(_ledger(spark, sf, "amount", "category"), IDENT)


@query("region_breakdown")
def q_region_breakdown(spark, sf):
    return sales.region_breakdown(_ledger(spark, sf, "amount", "region"), IDENT)


@query("regional_stats")
def q_regional_stats(spark, sf):
    return sales.regional_stats(_ledger(spark, sf, "amount", "region"), IDENT)


@query("product_totals")
def q_product_totals(spark, sf):
    return sales.product_totals(_ledger(spark, sf, "amount", "qty", "category", "product"), IDENT)


@query("top_products")
def q_top_products(spark, sf):
    return sales.top_products(_ledger(spark, sf, "amount", "qty", "product"), 10, IDENT)


@query("summary_statistics")
def q_summary_statistics(spark, sf):
    return sales.summary_statistics(
        _ledger(spark, sf, "date", "amount", "qty", "customer", "order_id"), IDENT)


@query("trend_headline")
def q_trend_headline(spark, sf):
    out = sales.trend_headline(_ledger(spark, sf, "date", "amount"), "M", IDENT)
    return out.withColumn("growth_pct", _r6("growth_pct"))


# ------------------------------------------------------- e-commerce orders (P1, A2, A3)

from kpiforge.operators import marketing, orders as ords, products as prods  # noqa: E402


def _orders(spark, sf, *cols):
    return ords.prepare_orders(tv.ecom_orders(spark, sf, cols or tv.ORDER_COLUMNS))


#: What the product operators read of an order: no join is needed for these.
PER_PRODUCT = ("product_id", "quantity", "unit_price", "cost_price")


@query("prepare_orders")
def q_prepare_orders(spark, sf):
    return _orders(spark, sf)


@query("overview_metrics")
def q_overview_metrics(spark, sf):
    return ords.overview_metrics(
        _orders(spark, sf, "customer_id", "quantity", "unit_price", "cost_price"), SCALE).withColumn(
        "profit_margin_pct", _r6("profit_margin_pct")).withColumn(
        "avg_order_value", _r6("avg_order_value"))


@query("repeat_purchase")
def q_repeat_purchase(spark, sf):
    return ords.repeat_purchase(_orders(spark, sf, "customer_id", "quantity", "unit_price", "cost_price"))


# ------------------------------------------------------------ products (K1, K2, A4, PR4-6)

@query("category_performance")
def q_category_performance(spark, sf):
    return prods.category_performance(
        _orders(spark, sf, "order_id", "category", "quantity", "unit_price", "cost_price"), SCALE)


@query("sales_ranking")
def q_sales_ranking(spark, sf):
    return prods.sales_ranking(_orders(spark, sf, *PER_PRODUCT), tv.products(spark, sf), top_n=10, scale=SCALE)


@query("profit_analysis")
def q_profit_analysis(spark, sf):
    return prods.profit_analysis(_orders(spark, sf, *PER_PRODUCT), tv.products(spark, sf), scale=SCALE)


@query("inventory_status")
def q_inventory_status(spark, sf):
    return prods.inventory_status(_orders(spark, sf, *PER_PRODUCT), tv.products(spark, sf), scale=SCALE)


@query("low_stock")
def q_low_stock(spark, sf):
    return prods.low_stock(_orders(spark, sf, *PER_PRODUCT), tv.products(spark, sf), scale=SCALE)


@query("restock_recommendations")
def q_restock(spark, sf):
    return prods.restock_recommendations(_orders(spark, sf, *PER_PRODUCT), tv.products(spark, sf), scale=SCALE)


@query("price_suggestions")
def q_price_suggestions(spark, sf):
    return prods.price_suggestions(_orders(spark, sf, *PER_PRODUCT), tv.products(spark, sf), scale=SCALE)


# ------------------------------------------------------------ marketing (P5, P6, A5, A6, K4, M7)

@query("campaign_roi")
def q_campaign_roi(spark, sf):
    return marketing.campaign_roi(tv.campaigns(spark, sf))


@query("conversion_metrics")
def q_conversion_metrics(spark, sf):
    return marketing.conversion_metrics(tv.campaigns(spark, sf))


@query("channel_performance")
def q_channel_performance(spark, sf):
    return marketing.channel_performance(tv.campaigns(spark, sf), SCALE)


@query("funnel_total")
def q_funnel_total(spark, sf):
    return marketing.conversion_funnel(tv.campaigns(spark, sf))


@query("funnel_by_campaign")
def q_funnel_by_campaign(spark, sf):
    return marketing.conversion_funnel(tv.campaigns(spark, sf), "CMP042")


@query("campaign_efficiency")
def q_campaign_efficiency(spark, sf):
    return marketing.campaign_efficiency(tv.campaigns(spark, sf)).select(
        "campaign_id", "channel", "roi", "ctr", "cvr",
        *[_r6(c).alias(c) for c in ("roi_score", "cvr_score", "ctr_score")], "efficiency_score")


@query("budget_allocation")
def q_budget_allocation(spark, sf):
    return marketing.budget_allocation(tv.campaigns(spark, sf), SCALE)


# ------------------------------------------------------------ segments (G1-3, A13-15, C1)

from kpiforge.operators import segments as seg  # noqa: E402


@query("abc_category")
def q_abc_category(spark, sf):
    return seg.abc_analysis(_ledger(spark, sf, "amount", "category"), cols=IDENT)


@query("abc_product")
def q_abc_product(spark, sf):
    return seg.abc_analysis(_ledger(spark, sf, "amount", "product"), by="product", cols=IDENT)


@query("abc_summary")
def q_abc_summary(spark, sf):
    return seg.abc_summary(_ledger(spark, sf, "amount", "category"), cols=IDENT)


@query("rfm_segments")
def q_rfm_segments(spark, sf):
    return seg.rfm_segments(_ledger(spark, sf, "date", "amount", "customer"), IDENT)


@query("rfm_unreversed")
def q_rfm_unreversed(spark, sf):
    return seg.rfm_segments(_ledger(spark, sf, "date", "amount", "customer", "order_id"), IDENT,
                            reverse_recency=False, frequency_of="order_id")


@query("rfm_events")
def q_rfm_events(spark, sf):
    return seg.rfm_segments(tv.events_ledger(spark, sf), IDENT)


@query("segment_counts")
def q_segment_counts(spark, sf):
    return seg.segment_counts(_ledger(spark, sf, "date", "amount", "customer"), IDENT)


@query("rfmq_features")
def q_rfmq_features(spark, sf):
    out = seg.rfmq_features(_ledger(spark, sf, "date", "amount", "customer", "order_id", "qty"),
                            IDENT)
    return out.withColumn("customer", F.col("customer").cast("string"))


def _kmeans(spark, sf):
    return seg.kmeans_customers(_ledger(spark, sf, "date", "amount", "customer", "order_id", "qty"), IDENT)


@query("kmeans_customers")
def q_kmeans_customers(spark, sf):
    return _kmeans(spark, sf)[0].withColumn("customer", F.col("customer").cast("string"))


@query("kmeans_profile")
def q_kmeans_profile(spark, sf):
    profile = _kmeans(spark, sf)[1]
    return profile.select("cluster", *[_r4(f"avg_{c}").alias(f"avg_{c}") for c in seg.FEATURES], "n_customers")


def _r4(c):
    return F.rint(F.col(c) * F.lit(1e4)) / F.lit(1e4)


# ------------------------------------------------------------ forecasts (F1-F8)

from kpiforge.operators import forecast as fc  # noqa: E402


@query("forecast_ma")
def q_forecast_ma(spark, sf):
    return fc.moving_average(_ledger(spark, sf, "date", "amount"), 7, 7, "D", IDENT).withColumn(
        "value", _r4("value"))


@query("forecast_ma_monthly")
def q_forecast_ma_monthly(spark, sf):
    return fc.moving_average(_ledger(spark, sf, "date", "amount"), 6, 3, "M", IDENT).withColumn(
        "value", _r4("value"))


@query("forecast_ma_by_region")
def q_forecast_ma_by_region(spark, sf):
    led = _ledger(spark, sf, "date", "amount", "region")
    return fc.moving_average(led, 4, 3, "W", IDENT, group_cols=["region"]).withColumn(
        "value", _r4("value"))


@query("forecast_trend")
def q_forecast_trend(spark, sf):
    out = fc.linear_trend(_ledger(spark, sf, "date", "amount"), 7, "D", IDENT)
    return out.select("method", "freq", "history_periods", _r4("slope").alias("slope"), "step",
                      "period", _r4("value").alias("value"))


@query("forecast_trend_monthly")
def q_forecast_trend_monthly(spark, sf):
    out = fc.linear_trend(_ledger(spark, sf, "date", "amount"), 6, "M", IDENT)
    return out.select("method", "freq", "history_periods", _r4("slope").alias("slope"), "step",
                      "period", _r4("value").alias("value"))


@query("trend_fitted")
def q_trend_fitted(spark, sf):
    out = fc.trend_fitted(_ledger(spark, sf, "date", "amount"), 30, "D", IDENT)
    return out.select("kind", "period", "actual", _r4("value").alias("value"))


@query("forecast_ses")
def q_forecast_ses(spark, sf):
    return fc.ses(_ledger(spark, sf, "date", "amount"), 30, 0.3, "D", IDENT).withColumn(
        "value", _r4("value"))


@query("forecast_holt")
def q_forecast_holt(spark, sf):
    return fc.holt(_ledger(spark, sf, "date", "amount"), 30, 0.3, "D", IDENT).withColumn(
        "value", _r4("value"))


@query("forecast_holt_fixed_beta")
def q_forecast_holt_fixed(spark, sf):
    return fc.holt(_ledger(spark, sf, "date", "amount"), 12, 0.3, "M", IDENT, beta=0.1).withColumn(
        "value", _r4("value"))


@query("forecast_trend_by_region")
def q_forecast_trend_by_region(spark, sf):
    led = _ledger(spark, sf, "date", "amount", "region")
    out = fc.linear_trend(led, 4, "M", IDENT, group_cols=["region"])
    return out.select("region", "method", "freq", "history_periods", _r4("slope").alias("slope"), "step",
                      "period", _r4("value").alias("value"))


@query("forecast_holt_by_category")
def q_forecast_holt_by_category(spark, sf):
    led = _ledger(spark, sf, "date", "amount", "category")
    return fc.holt(led, 6, 0.3, "M", IDENT, beta=0.1, group_cols=["category"]).withColumn("value", _r4("value"))


@query("evaluate_by_region")
def q_evaluate_by_region(spark, sf):
    led = _ledger(spark, sf, "date", "amount", "region")
    out = fc.evaluate(led, "trend", 0.8, "W", IDENT, group_cols=["region"])
    return out.select("region", "method", "n_train", "n_test", *[_r4(c).alias(c) for c in ("mae", "rmse", "mape")],
                      "mape_skipped", _r6("r2").alias("r2"))


@query("evaluate_trend")
def q_evaluate_trend(spark, sf):
    out = fc.evaluate(_ledger(spark, sf, "date", "amount"), "trend", 0.8, "D", IDENT)
    return out.select("method", "n_train", "n_test", *[_r4(c).alias(c) for c in ("mae", "rmse", "mape")],
                      "mape_skipped", _r6("r2").alias("r2"))


@query("evaluate_ma")
def q_evaluate_ma(spark, sf):
    out = fc.evaluate(_ledger(spark, sf, "date", "amount"), "ma", 0.8, "D", IDENT)
    return out.select("method", "n_train", "n_test", *[_r4(c).alias(c) for c in ("mae", "rmse", "mape")],
                      "mape_skipped", _r6("r2").alias("r2"))


@query("compare_forecasts")
def q_compare_forecasts(spark, sf):
    return fc.compare(_ledger(spark, sf, "date", "amount"), 30, "D", IDENT).withColumn(
        "value", _r4("value"))


@query("forecast_input_summary")
def q_forecast_input_summary(spark, sf):
    return fc.input_summary(_ledger(spark, sf, "date"), IDENT).withColumn("methods_available", F.array_join("methods_available", ","))


# ------------------------------------------------------------ data quality (Q1-Q6, A12)

from kpiforge.operators import quality as qa  # noqa: E402


@query("clean_drop")
def q_clean_drop(spark, sf):
    return qa.drop_missing(tv.dirty_lines(spark, sf))


@query("clean_fill")
def q_clean_fill(spark, sf):
    return qa.fill_missing(tv.dirty_lines(spark, sf))


@query("clean_dedupe")
def q_clean_dedupe(spark, sf):
    """Every column of the dirty lines, each line twice."""
    dirty = tv.dirty_lines(spark, sf)
    return qa.drop_duplicates(dirty.unionByName(dirty))


@query("clean_few_repeats")
def q_clean_few_repeats(spark, sf):
    """Every column of the dirty lines, one line in 29 twice."""
    return qa.drop_duplicates(tv.repeated_lines(spark, sf))


@query("clean_iqr")
def q_clean_iqr(spark, sf):
    return qa.iqr_filter(tv.dirty_lines(spark, sf))


@query("clean_zscore")
def q_clean_zscore(spark, sf):
    return qa.zscore_filter(tv.dirty_lines(spark, sf))


@query("clean_pipeline")
def q_clean_pipeline(spark, sf):
    return qa.clean(tv.repeated_lines(spark, sf), handle_missing="fill", remove_duplicates=True, outlier_method="iqr")


@query("clean_fill_nan")
def q_clean_fill_nan(spark, sf):
    return qa.fill_missing(tv.nan_lines(spark, sf))


@query("clean_zscore_nan")
def q_clean_zscore_nan(spark, sf):
    return qa.zscore_filter(tv.nan_lines(spark, sf))


@query("data_profile_nan")
def q_data_profile_nan(spark, sf):
    return qa.profile(tv.nan_lines(spark, sf))


@query("data_profile")
def q_data_profile(spark, sf):
    return qa.profile(tv.dirty_lines(spark, sf))


# ------------------------------------------------------------ report (N1-N4, IO6)

from kpiforge.operators import narrative as nar  # noqa: E402
from kpiforge.sources import layout, readers, writers  # noqa: E402


def _report_inputs(spark, sf):
    return sales.report_inputs(_ledger(spark, sf, "date", "amount", "category", "region", "customer"), IDENT)


def _report(spark, sf):
    made = _report_inputs(spark, sf)
    return nar.commentary_report(made["summary"], made["anomalies"])


@query("commentary_rules")
def q_commentary_rules(spark, sf):
    return nar.report_rows(_report(spark, sf))


@query("commentary_markdown")
def q_commentary_markdown(spark, sf):
    return nar.markdown(_report(spark, sf))


def _payload(spark, sf):
    made = _report_inputs(spark, sf)
    return nar.payload(made["summary"], made["trend"], made["anomalies"], made["category"], made["region"])


@query("commentary_payload")
def q_commentary_payload(spark, sf):
    """The payload's JSON read back, field by field."""
    point = "struct<period: date, revenue: double, n_orders: bigint, growth_pct: double>"
    alert = "struct<period: date, actual: double, direction: string>"
    parsed = F.from_json("payload", f"struct<summary: struct<n_records: bigint, date_start: string, total_revenue: double, "
                         f"top_region: string, n_customers: bigint>, trend_last_6: array<{point}>, anomalies_top_3: array<{alert}>, "
                         "category_breakdown_top5: map<string, double>, region_breakdown_top5: map<string, double>>")
    p = _payload(spark, sf).select("payload", parsed.alias("p"))
    cat, reg = F.col("p.category_breakdown_top5"), F.col("p.region_breakdown_top5")
    return p.select(
        "p.summary.n_records", "p.summary.date_start", "p.summary.total_revenue", "p.summary.top_region", "p.summary.n_customers",
        F.col("p.trend_last_6.period").cast("array<string>").alias("trend_periods"), F.col("p.trend_last_6.revenue").alias("trend_revenue"),
        F.col("p.trend_last_6.n_orders").alias("trend_orders"),
        F.col("p.anomalies_top_3.period").cast("array<string>").alias("alert_periods"),
        F.col("p.anomalies_top_3.direction").alias("alert_directions"),
        F.map_keys(cat).alias("categories"), F.map_values(cat).alias("category_revenue"),
        F.map_keys(reg).alias("regions"), F.map_values(reg).alias("region_revenue"),
        F.col("payload").contains('"growth_first_to_last_month":').alias("has_growth"))


@query("parse_commentary")
def q_parse_commentary(spark, sf):
    """Every text of ``conversations`` as a model response (none is JSON, so they
    fall back to the rules), and per nation five responses made from its row: an
    object, a fenced one, a broken one, one with text behind it, one without overview."""
    report = _report(spark, sf)
    base = sf.rstrip("/")
    conv = spark.read.parquet(f"{base}/conversations.parquet")
    texts = conv.select(F.concat_ws("-", "conv_id", "turn").alias("response_id"), "text")
    nation = spark.read.parquet(f"{base}/nation.parquet")
    tail = F.concat(F.lit('"highlights": ["'), F.col("n_name"), F.lit('", "", null, 0, 7, false, true], "risks": [], '
                    '"recommendations": ["r'), F.col("n_nationkey").cast("string"), F.lit('"]}'))
    whole = F.concat(F.lit('{"overview": "'), F.col("n_name"), F.lit('", '), tail)
    forms = {"plain": whole, "fenced": F.concat(F.lit("```json\n"), whole, F.lit("\n```\n")),
             "broken": F.regexp_replace(whole, "\\]\\}$", ""), "trailing": F.concat(whole, F.lit(" as asked")),
             "bare": F.concat(F.lit("{"), tail)}
    made = nation.select("n_nationkey", F.explode(F.array(*[F.struct(F.lit(k).alias("form"), x.alias("text")) for k, x in forms.items()])).alias("r"))
    made = made.select(F.concat_ws("-", F.lit("json"), F.col("n_nationkey").cast("string"), "r.form").alias("response_id"), "r.text")
    return nar.parse_response(texts.unionByName(made), "text", report, backend="stub")


@query("head_sample")
def q_head_sample(spark, sf):
    li = spark.read.parquet(f"{sf.rstrip('/')}/lineitem.parquet")
    return writers.head_sample(li, 10, ["l_orderkey", "l_linenumber"])


@query("report_totals")
def q_report_totals(spark, sf):
    return writers.report_totals(_ledger(spark, sf, "amount", "category", "region"), IDENT)


# ------------------------------------------------------------ round trips through files (IO1-IO6)

def _csv_of(spark, df: DataFrame, label: str) -> str:
    """``df`` as CSV files in the shared folder."""
    path = f"{Cut(spark, label).path}/{label}"
    writers.emit(df, path, "csv")
    return path


def _load_report(table: DataFrame, found: DataFrame, **figures) -> DataFrame:
    """What was loaded and what was rejected: what, n."""
    loaded = table.agg(F.count(F.lit(1)).alias("rows"), *[c.cast("bigint").alias(n) for n, c in figures.items()])
    loaded = loaded.select(F.explode(F.array(*[F.struct(F.lit(n).alias("what"), F.col(n).alias("n")) for n in ("rows", *figures)])).alias("x"))
    bad = found.groupBy(F.concat_ws(" ", "column", "reason").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return loaded.select("x.*").unionByName(bad)


def _cents(c: str):
    return F.sum(F.rint(F.col(c) * 100))


@query("read_ledger")
def q_read_ledger(spark, sf):
    """IO1: the ledger through CSV, with amounts and dates that don't fit."""
    led = _ledger(spark, sf, "date", "amount", "order_id")
    k = F.col("order_id")
    path = _csv_of(spark, led.select("order_id", F.when(k % 37 == 0, "n/a").otherwise(F.col("amount").cast("string")).alias("amount"),
                                     F.when(k % 41 == 0, "soon").otherwise(F.date_format("date", "yyyy-MM-dd")).alias("date")), "ledger")
    types = "order_id long, amount double, date date"
    return _load_report(readers.load_ledger(spark, path, types), readers.rejects(spark, path, types), cents=_cents("amount"),
                        days=F.count_distinct("date"))


@query("read_orders")
def q_read_orders(spark, sf):
    """IO2: orders through CSV, with quantities, prices and dates that don't fit."""
    o = tv.ecom_orders(spark, sf, ["order_id", "product_id", "quantity", "unit_price", "order_date"])
    k = F.col("order_id") * 7 + F.col("product_id")
    path = _csv_of(spark, o.select(
        F.when(k % 53 == 0, "2024-13-45").otherwise(F.date_format("order_date", "yyyy-MM-dd")).alias("order_date"), "order_id", "product_id",
        F.when(k % 43 == 0, "many").otherwise(F.col("quantity").cast("bigint").cast("string")).alias("quantity"),
        F.when(k % 47 == 0, "12,50").otherwise(F.col("unit_price").cast("string")).alias("unit_price")), "orders")
    return _load_report(readers.load_orders(spark, path), readers.rejects(spark, path, *readers.TABLES["orders"]), revenue_cents=_cents("revenue"),
                        units=F.sum("quantity"), days=F.count_distinct("order_date"))


@query("read_products")
def q_read_products(spark, sf):
    """IO3: the catalogue through CSV, with stocks and dates that don't fit."""
    k = F.col("product_id")
    path = _csv_of(spark, tv.products(spark, sf).withColumns({
        "stock_quantity": F.when(k % 11 == 0, "none").otherwise(F.col("stock_quantity").cast("string")),
        "last_restock_date": F.when(k % 13 == 0, "yesterday").when(k % 17 != 0, F.format_string("2024-03-%02d", 1 + k % 28))}), "products")
    return _load_report(readers.load_products(spark, path), readers.rejects(spark, path, *readers.TABLES["products"]), stock=F.sum("stock_quantity"),
                        reorder=F.sum("reorder_level"), price_cents=_cents("sell_price"), restocked=F.count("last_restock_date"))


@query("read_campaigns")
def q_read_campaigns(spark, sf):
    """IO4: campaigns through CSV, with budgets and dates that don't fit."""
    path = _csv_of(spark, tv.campaigns(spark, sf).withColumns({
        "budget": F.when(F.col("impressions") % 3 == 0, "1.5k").otherwise(F.col("budget").cast("string")),
        "start_date": F.when(F.col("clicks") % 2 == 0, "tbd").otherwise(F.col("start_date").cast("string"))}), "campaigns")
    return _load_report(readers.load_campaigns(spark, path), readers.rejects(spark, path, *readers.TABLES["campaigns"]), budget_cents=_cents("budget"),
                        revenue_cents=_cents("revenue"), orders=F.sum("orders"), starts=F.count("start_date"), ends=F.count("end_date"))


@query("emit_replaces_periods")
def q_emit_replaces_periods(spark, sf):
    """IO5: the monthly trend as JSON by year; then 1996 again, twice, with one order more a month."""
    rows = sales.trend(_ledger(spark, sf, "date", "amount"), "M", IDENT).select(
        F.year("period").alias("year"), F.col("period").cast("string").alias("period"), F.rint(F.col("revenue") * 100).cast("bigint").alias("cents"), "n_orders")
    cut = Cut(spark, "emit")
    rows = cut.table(rows)
    path = f"{cut.path}/by_year"
    writers.emit(rows, path, "json", "replace", ["year"])
    for _ in range(2):
        writers.emit(rows.where("year = 1996").withColumn("n_orders", F.col("n_orders") + 1), path, "json", "replace", ["year"])
    return spark.read.schema("period string, cents bigint, n_orders bigint, year int").json(path)


@query("report_replaces_periods")
def q_report_replaces_periods(spark, sf):
    """IO6: the report by year; then 1995 and 1996 again, twice, with doubled amounts."""
    cut = Cut(spark, "report")
    led = cut.table(_ledger(spark, sf, "date", "amount", "category", "region"))  # six writes read it; the joins run once
    path = f"{cut.path}/report"
    writers.export_report(led, path, IDENT, period="Y")
    for _ in range(2):
        some = led.where(F.year("date").isin(1995, 1996)).withColumn("amount", F.col("amount") * 2)
        writers.export_report(some, path, IDENT, period="Y")
    totals = spark.read.schema("key string, revenue double, period string, sheet string").parquet(f"{path}/totals")
    raw = spark.read.parquet(f"{path}/raw").groupBy(F.col("period").cast("string").alias("period")).agg(F.count(F.lit(1)).alias("n"))
    return totals.select("period", "sheet", "key", F.rint(F.col("revenue") * 100).cast("bigint").alias("cents")).unionByName(
        raw.select("period", F.lit("raw").alias("sheet"), F.lit("rows").alias("key"), F.col("n").alias("cents")))


# ------------------------------------------------------------ bucketed layout

@query("rfm_bucketed")
def q_rfm_bucketed(spark, sf):
    """RFM from a ledger bucketed by customer: its rows are not shuffled again."""
    led = layout.bucketed(_ledger(spark, sf, "date", "amount", "customer"), "customer", 16)
    return seg.rfm_segments(led, IDENT)


@query("profit_bucketed")
def q_profit_bucketed(spark, sf):
    """Profit per product from orders bucketed by product (a text, as in the order files)."""
    lines = _orders(spark, sf, *PER_PRODUCT).withColumn("product_id", F.col("product_id").cast("string"))
    return prods.profit_analysis(layout.bucketed(lines, "product_id", 16), tv.products(spark, sf), scale=SCALE)
