"""DuckDB oracle SQL for every catalogue query that SQL can express.

The driver registers the raw tables as views; each statement first derives the
logical tables (``sources.testviews.*_SQL``) and then states the operator.
"""

from __future__ import annotations

from kpiforge.plans import sqlparts as P
from kpiforge.operators import marketing as M, narrative as N, products as PR, segments as S
from kpiforge.sources.testviews import (CAMPAIGNS_SQL, DIRTY_SQL, ECOM_SQL, EVENTS_SQL, NAN_SQL, REPEATED_SQL,
                                        PRODUCTS_SQL, SALES_SQL, with_views)

SQL: dict[str, str] = {}


def _q(text: str) -> str:
    """A fixed label as a SQL string."""
    return "'" + text.replace("'", "''") + "'"


def _sentence(name: str, *figures: str) -> str:
    """``narrative.sentence`` in SQL."""
    parts = N.TEXTS[name].split("{}")
    out = [_q(parts[0])]
    for figure, part in zip(figures, parts[1:], strict=True):
        out += [figure, _q(part)]
    return " || ".join(out)


def r6(x: str) -> str:
    return P.r(x, 6)


_SUMMARY_CTE = f"""g AS (SELECT COUNT(*) AS n, {P.msum('amount')} AS rev, MIN(date) AS d0,
             MAX(date) AS d1, COUNT(DISTINCT customer) AS nc FROM v_sales),
c AS (SELECT category, {P.msum('amount')} AS rev FROM v_sales WHERE category IS NOT NULL
      GROUP BY 1 ORDER BY rev DESC, category LIMIT 1),
r AS (SELECT region, {P.msum('amount')} AS rev FROM v_sales WHERE region IS NOT NULL
      GROUP BY 1 ORDER BY rev DESC, region LIMIT 1),
m AS (SELECT {P.start('M')} AS ps, {P.msum('amount')} AS rev FROM v_sales
      WHERE date IS NOT NULL GROUP BY 1),
mm AS (SELECT arg_min(rev, ps) AS first, arg_max(rev, ps) AS last, MIN(ps) AS m0,
              MAX(ps) AS m1 FROM m),
sm AS (SELECT g.n AS n_records, strftime(g.d0, '%Y-%m-%d') AS date_start,
       strftime(g.d1, '%Y-%m-%d') AS date_end, g.rev AS total_revenue, g.n AS total_orders,
       g.rev / g.n AS avg_order_value, c.category AS top_category,
       COALESCE(c.rev, 0.0) AS top_category_revenue, r.region AS top_region,
       COALESCE(r.rev, 0.0) AS top_region_revenue, g.nc AS n_customers,
       CASE WHEN mm.m1 > mm.m0 AND mm.first > 0 THEN (mm.last / mm.first - 1) * 100.0 END
         AS growth_first_to_last_month
  FROM g LEFT JOIN c ON TRUE LEFT JOIN r ON TRUE, mm WHERE g.n > 0)"""

SQL["sales_summary"] = with_views(f"""WITH {_SUMMARY_CTE}
SELECT n_records, date_start, date_end, total_revenue, total_orders, avg_order_value,
  top_category, top_category_revenue, top_region, top_region_revenue, n_customers,
  {r6('growth_first_to_last_month')} AS growth_first_to_last_month FROM sm""", SALES_SQL)

for _f, _n in (("D", "d"), ("W", "w"), ("M", "m"), ("Q", "q"), ("Y", "y")):
    SQL[f"resample_{_n}"] = with_views(
        "SELECT period, revenue, n_orders FROM s", SALES_SQL, P.resample_ctes("v_sales", _f))


def _trend_sql(freq, src="v_sales", view=SALES_SQL):
    growth = ("CASE WHEN lag(revenue) OVER (ORDER BY ps) > 0 THEN "
              "(revenue / lag(revenue) OVER (ORDER BY ps) - 1) * 100.0 END")
    return with_views(f"SELECT period, revenue, n_orders, {r6(growth)} AS growth_pct FROM s",
                      view, P.resample_ctes(src, freq))


SQL["trend_monthly"] = _trend_sql("M")
SQL["trend_weekly"] = _trend_sql("W")
SQL["trend_quarterly"] = _trend_sql("Q")
SQL["trend_daily_events"] = _trend_sql("D", "v_events", EVENTS_SQL)


def _anom_sql(freq, z, src="v_sales", view=SALES_SQL):
    w = "OVER (ORDER BY ps ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"
    return with_views(f"""WITH
sc AS (SELECT period, revenue,
         CASE WHEN COUNT(revenue) {w} >= 3 THEN AVG(revenue) {w} END AS mu,
         CASE WHEN COUNT(revenue) {w} >= 3 THEN STDDEV_SAMP(revenue) {w} END AS sd,
         COUNT(*) OVER () AS n
       FROM s),
zz AS (SELECT period, revenue AS actual, mu AS expected, (revenue - mu) / sd AS z_score
       FROM sc WHERE n >= 5 AND sd IS NOT NULL AND sd >= 1e-9)
SELECT period, actual, {r6('expected')} AS expected, {r6('z_score')} AS z_score,
       CASE WHEN z_score > 0 THEN 'spike' ELSE 'drop' END AS direction
FROM zz WHERE abs(z_score) >= {z}""", view, P.resample_ctes(src, freq))


SQL["anomalies_daily"] = _anom_sql("D", 2.0)
SQL["anomalies_weekly"] = _anom_sql("W", 1.5)
SQL["anomalies_daily_events"] = _anom_sql("D", 1.0, "v_events", EVENTS_SQL)

SQL["trend_growth_v1"] = with_views(f"""SELECT period, revenue, n_orders,
  {r6("(revenue / NULLIF(lag(revenue) OVER (ORDER BY ps), 0) - 1) * 100.0")} AS growth_pct FROM s""",
                                    SALES_SQL, P.resample_ctes("v_sales", "M"))
_BY = "PARTITION BY {k} ORDER BY ps"


def _grouped_trend_sql(key, freq, src, view, value="amount"):
    w = f"lag(revenue) OVER ({_BY.format(k=key)})"
    return with_views(f"SELECT {key}, period, revenue, n_orders, "
                      f"{r6(f'CASE WHEN {w} > 0 THEN (revenue / {w} - 1) * 100.0 END')} AS growth_pct FROM s",
                      view, P.grouped_ctes(src, freq, key, value))


SQL["trend_by_category"] = _grouped_trend_sql("category", "Q", "v_sales", SALES_SQL)
SQL["trend_nan_by_status"] = _grouped_trend_sql("linestatus", "M", "v_nan", NAN_SQL, "price")
_W14 = f"OVER ({_BY.format(k='region')} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"
SQL["anomalies_by_region"] = with_views(f"""WITH
sc AS (SELECT region, period, revenue,
         CASE WHEN COUNT(revenue) {_W14} >= 3 THEN AVG(revenue) {_W14} END AS mu,
         CASE WHEN COUNT(revenue) {_W14} >= 3 THEN STDDEV_SAMP(revenue) {_W14} END AS sd,
         COUNT(*) OVER (PARTITION BY region) AS n FROM s),
zz AS (SELECT region, period, revenue AS actual, mu AS expected, (revenue - mu) / sd AS z_score
       FROM sc WHERE n >= 5 AND sd IS NOT NULL AND sd >= 1e-9)
SELECT region, period, actual, {r6('expected')} AS expected, {r6('z_score')} AS z_score,
       CASE WHEN z_score > 0 THEN 'spike' ELSE 'drop' END AS direction
FROM zz WHERE abs(z_score) >= 1.5""", SALES_SQL, P.grouped_ctes("v_sales", "W", "region"))

SQL["category_breakdown"] = with_views(f"""SELECT category, {P.msum('amount')} AS revenue
FROM v_sales WHERE category IS NOT NULL GROUP BY 1""", SALES_SQL)
SQL["region_breakdown"] = with_views(f"""SELECT region, {P.msum('amount')} AS revenue
FROM v_sales WHERE region IS NOT NULL GROUP BY 1""", SALES_SQL)
SQL["regional_stats"] = with_views(f"""SELECT region, {P.msum('amount')} AS total_revenue,
  {P.msum('amount')} / COUNT(amount) AS avg_revenue, COUNT(amount) AS n_orders
FROM v_sales WHERE region IS NOT NULL GROUP BY 1""", SALES_SQL)
SQL["product_totals"] = with_views(f"""
SELECT 'category' AS level, CAST(category AS VARCHAR) AS item, {P.msum('amount')} AS revenue,
       {P.msum('qty')} AS quantity FROM v_sales WHERE category IS NOT NULL GROUP BY category
UNION ALL
SELECT 'product' AS level, CAST(product AS VARCHAR) AS item, {P.msum('amount')} AS revenue,
       {P.msum('qty')} AS quantity FROM v_sales WHERE product IS NOT NULL GROUP BY product""",
                                 SALES_SQL)
SQL["top_products"] = with_views(f"""SELECT product, {P.msum('amount')} AS revenue,
  {P.msum('qty')} AS quantity FROM v_sales WHERE product IS NOT NULL GROUP BY product
ORDER BY revenue DESC, product LIMIT 10""", SALES_SQL)
SQL["summary_statistics"] = with_views(f"""SELECT {P.msum('amount')} AS total_revenue,
  {P.msum('amount')} / COUNT(amount) AS avg_revenue, MAX(amount) AS max_revenue,
  MIN(amount) AS min_revenue, {P.msum('qty')} AS total_quantity,
  {P.msum('qty')} / COUNT(qty) AS avg_quantity, COUNT(DISTINCT customer) AS n_customers,
  COUNT(DISTINCT order_id) AS n_orders,
  strftime(MIN(date), '%Y-%m-%d') || ' 至 ' || strftime(MAX(date), '%Y-%m-%d') AS date_range
FROM v_sales""", SALES_SQL)
SQL["trend_headline"] = with_views(f"""SELECT MAX(revenue) AS max_revenue,
  MIN(revenue) AS min_revenue, COUNT(*) AS n_periods,
  {r6("CASE WHEN COUNT(*) > 1 THEN (arg_max(revenue, ps) - arg_min(revenue, ps)) / NULLIF(arg_min(revenue, ps), 0) * 100.0 END")} AS growth_pct
FROM s""", SALES_SQL, P.resample_ctes("v_sales", "M"))

# ------------------------------------------------------- e-commerce orders

SQL["prepare_orders"] = with_views("SELECT * FROM v_ecom", ECOM_SQL)
SQL["overview_metrics"] = with_views(f"""WITH
g AS (SELECT COUNT(*) AS n, {P.msum('revenue')} AS rev, {P.msum('profit')} AS prof,
             COUNT(DISTINCT customer_id) AS nc FROM v_ecom)
SELECT n AS n_orders, rev AS total_revenue, prof AS total_profit,
       {r6('CASE WHEN rev <> 0 THEN prof / rev * 100.0 ELSE 0.0 END')} AS profit_margin_pct,
       {r6('CASE WHEN n > 0 THEN rev / n ELSE 0.0 END')} AS avg_order_value,
       nc AS unique_customers FROM g""", ECOM_SQL)
SQL["repeat_purchase"] = with_views(f"""WITH
per AS (SELECT customer_id, COUNT(*) AS n FROM v_ecom WHERE customer_id IS NOT NULL GROUP BY 1),
g AS (SELECT COUNT(*) AS tc, COUNT(*) FILTER (WHERE n > 1) AS rc, SUM(n) AS rows_ FROM per)
SELECT tc AS total_customers, rc AS repeat_customers,
       COALESCE({P.r(P.div('rc', 'tc') + ' * 100.0')}, 0.0) AS repeat_rate_pct,
       COALESCE({P.r(P.div('rows_', 'tc'))}, 0.0) AS avg_orders_per_customer FROM g""",
                                  ECOM_SQL)

# ------------------------------------------------------------ products

_PER_PRODUCT = f"""per AS (
  SELECT CAST(product_id AS VARCHAR) AS product_id, {P.msum('quantity')} AS quantity,
         {P.msum('revenue')} AS revenue, {P.msum('profit')} AS profit
  FROM v_ecom WHERE product_id IS NOT NULL GROUP BY 1),
attrs AS (SELECT CAST(product_id AS VARCHAR) AS product_id, product_name, category FROM v_products)"""

SQL["category_performance"] = with_views(f"""SELECT category, {P.msum('quantity')} AS quantity,
  {P.msum('revenue')} AS revenue, {P.msum('profit')} AS profit, COUNT(order_id) AS order_count,
  {P.r(P.div(P.msum('revenue'), 'COUNT(order_id)'))} AS avg_order_value
FROM v_ecom WHERE category IS NOT NULL GROUP BY category""", ECOM_SQL)
SQL["sales_ranking"] = with_views(f"""WITH {_PER_PRODUCT}
SELECT per.product_id, per.quantity, per.revenue, per.profit, attrs.product_name, attrs.category
FROM per LEFT JOIN attrs ON per.product_id = attrs.product_id
ORDER BY per.revenue DESC, per.product_id LIMIT 10""", ECOM_SQL, PRODUCTS_SQL)
_PROFIT = f"""prof AS (
  SELECT per.product_id, per.profit, per.revenue, per.quantity,
         {P.r(P.div('per.profit', 'per.revenue') + ' * 100.0')} AS profit_margin,
         attrs.product_name, attrs.category
  FROM per LEFT JOIN attrs ON per.product_id = attrs.product_id)"""
SQL["profit_analysis"] = with_views(f"WITH {_PER_PRODUCT}, {_PROFIT} SELECT * FROM prof",
                                    ECOM_SQL, PRODUCTS_SQL)
_INV = f"""sold AS (
  SELECT CAST(product_id AS VARCHAR) AS product_id, {P.msum('quantity')} AS sold_qty
  FROM v_ecom WHERE product_id IS NOT NULL GROUP BY 1),
inv AS (
  SELECT CAST(p.product_id AS VARCHAR) AS product_id, p.product_name, p.category, p.sell_price,
         p.stock_quantity, p.reorder_level,
         CASE WHEN p.stock_quantity <= p.reorder_level THEN {_q(PR.STATUS_LOW)}
              WHEN p.stock_quantity > p.reorder_level * 2 THEN {_q(PR.STATUS_AMPLE)} ELSE {_q(PR.STATUS_OK)} END
           AS stock_status,
         COALESCE(s.sold_qty, 0.0) AS sold_qty,
         {P.r(P.div('COALESCE(s.sold_qty, 0.0)', 'p.stock_quantity') + ' * 100.0')} AS turnover_rate
  FROM v_products p LEFT JOIN sold s ON CAST(p.product_id AS VARCHAR) = s.product_id)"""
SQL["inventory_status"] = with_views(f"WITH {_INV} SELECT * FROM inv", ECOM_SQL, PRODUCTS_SQL)
SQL["low_stock"] = with_views(f"WITH {_INV} SELECT * FROM inv WHERE stock_status = {_q(PR.STATUS_LOW)}",
                              ECOM_SQL, PRODUCTS_SQL)
SQL["restock_recommendations"] = with_views(f"""WITH {_INV},
d AS (SELECT *, {P.r('sold_qty / 25.0', 1)} AS daily_sales FROM inv),
e AS (SELECT *, {P.r(P.div('stock_quantity', 'daily_sales'), 1)} AS days_remaining FROM d)
SELECT *, CASE
  WHEN stock_quantity <= reorder_level
    THEN {_q(PR.RESTOCK_NOW)} || CAST(CAST(trunc(daily_sales * 15) AS BIGINT) AS VARCHAR)
  WHEN days_remaining IS NOT NULL AND days_remaining < 10
    THEN {_q(PR.RESTOCK_SOON_PREFIX)} || CAST(CAST(trunc(days_remaining) AS BIGINT) AS VARCHAR) || {_q(PR.RESTOCK_SOON_SUFFIX)}
  ELSE {_q(PR.RESTOCK_FINE)} END AS recommendation
FROM e WHERE stock_quantity <= reorder_level * 1.5""", ECOM_SQL, PRODUCTS_SQL)
SQL["price_suggestions"] = with_views(f"""WITH {_PER_PRODUCT}, {_PROFIT}
SELECT product_id, product_name, profit_margin, CASE
  WHEN profit_margin IS NULL THEN {_q(PR.PRICE_NO_DATA)}
  WHEN profit_margin < 30
    THEN {_q(PR.PRICE_RAISE_PREFIX)} || CAST(CAST(trunc((35.0 - profit_margin) / 10.0 * 5.0) AS BIGINT) AS VARCHAR) || {_q(PR.PRICE_RAISE_SUFFIX)}
  WHEN profit_margin > 60 THEN {_q(PR.PRICE_EXCELLENT)}
  ELSE {_q(PR.PRICE_FINE)} END AS price_suggestion
FROM prof""", ECOM_SQL, PRODUCTS_SQL)

# ------------------------------------------------------------ marketing

def _roi_sql(rev="revenue", budget="budget"):
    return P.r(P.div(f"{rev} - {budget}", budget) + " * 100.0")


_CONV = (f"{P.r(P.div('clicks', 'impressions') + ' * 100.0')} AS ctr, "
         f"{P.r(P.div('orders', 'clicks') + ' * 100.0')} AS cvr, "
         f"{P.r(P.div('orders', 'impressions') + ' * 100.0')} AS overall_conversion, "
         f"{P.r(P.div('budget', 'clicks'))} AS cpc, {P.r(P.div('budget', 'orders'))} AS cpa")

SQL["campaign_roi"] = with_views(f"""SELECT *, {_roi_sql()} AS roi,
  {P.r('revenue - budget')} AS profit, {P.r(P.div('budget', 'orders'))} AS cost_per_order,
  {P.r(P.div('revenue', 'orders'))} AS revenue_per_order FROM v_campaigns""", CAMPAIGNS_SQL)
SQL["conversion_metrics"] = with_views(f"SELECT *, {_CONV} FROM v_campaigns", CAMPAIGNS_SQL)
_CHANNEL = f"""ch0 AS (
  SELECT channel, {P.msum('budget')} AS budget, CAST(COALESCE(SUM(orders), 0) AS BIGINT) AS orders,
         {P.msum('revenue')} AS revenue,
         CAST(COALESCE(SUM(impressions), 0) AS BIGINT) AS impressions,
         CAST(COALESCE(SUM(clicks), 0) AS BIGINT) AS clicks
  FROM v_campaigns WHERE channel IS NOT NULL GROUP BY channel),
ch AS (SELECT *, {_roi_sql()} AS roi, {P.r(P.div('clicks', 'impressions') + ' * 100.0')} AS ctr,
         {P.r(P.div('orders', 'clicks') + ' * 100.0')} AS cvr, {P.r(P.div('budget', 'clicks'))} AS cpc,
         {P.r(P.div('budget', 'orders'))} AS cpa FROM ch0)"""
SQL["channel_performance"] = with_views(f"WITH {_CHANNEL} SELECT * FROM ch", CAMPAIGNS_SQL)
_FUNNEL = """SELECT impressions, clicks, orders,
  CASE WHEN impressions <> 0 THEN {r2c} ELSE 0.0 END AS ctr,
  CASE WHEN clicks <> 0 THEN {r2v} ELSE 0.0 END AS cvr,
  CASE WHEN impressions <> 0 THEN {r4o} ELSE 0.0 END AS overall_conversion FROM t""".format(
    r2c=P.r("clicks / impressions * 100.0"), r2v=P.r("orders / clicks * 100.0"),
    r4o=P.r("orders / impressions * 100.0", 4))
SQL["funnel_total"] = with_views(f"""WITH t AS (SELECT
  CAST(COALESCE(SUM(impressions), 0) AS BIGINT) AS impressions,
  CAST(COALESCE(SUM(clicks), 0) AS BIGINT) AS clicks,
  CAST(COALESCE(SUM(orders), 0) AS BIGINT) AS orders FROM v_campaigns) {_FUNNEL}""", CAMPAIGNS_SQL)
SQL["funnel_by_campaign"] = with_views(f"""WITH t AS (SELECT
  CAST(impressions AS BIGINT) AS impressions, CAST(clicks AS BIGINT) AS clicks,
  CAST(orders AS BIGINT) AS orders FROM v_campaigns WHERE campaign_id = 'CMP042' LIMIT 1)
  {_FUNNEL}""", CAMPAIGNS_SQL)


def _norm_sql(c, weight):
    return f"CASE WHEN m_{c} > 0 THEN {c} / m_{c} * {weight}.0 ELSE {c} * 0.0 END"


SQL["campaign_efficiency"] = with_views(f"""WITH
e AS (SELECT campaign_id, channel, {_roi_sql()} AS roi, {_CONV} FROM v_campaigns),
m AS (SELECT MAX(roi) AS m_roi, MAX(cvr) AS m_cvr, MAX(ctr) AS m_ctr FROM e),
s AS (SELECT e.*, {_norm_sql('roi', 40)} AS roi_score, {_norm_sql('cvr', 30)} AS cvr_score,
             {_norm_sql('ctr', 30)} AS ctr_score FROM e, m)
SELECT campaign_id, channel, roi, ctr, cvr, {r6('roi_score')} AS roi_score,
       {r6('cvr_score')} AS cvr_score, {r6('ctr_score')} AS ctr_score,
       {P.r('roi_score + cvr_score + ctr_score')} AS efficiency_score FROM s""", CAMPAIGNS_SQL)
SQL["budget_allocation"] = with_views(f"""WITH {_CHANNEL},
tot AS (SELECT {P.msum('budget')} AS total FROM v_campaigns),
mx AS (SELECT MAX(roi) AS max_roi FROM ch),
p AS (SELECT ch.*, tot.total, CASE
    WHEN roi IS NULL AND budget = 0 AND revenue > 0 THEN 40.0
    WHEN roi > 100 THEN CASE WHEN mx.max_roi IS NULL OR mx.max_roi = 0 THEN 35.0
                             ELSE least(40.0, roi / mx.max_roi * 35.0) END
    WHEN roi > 50 THEN 25.0 ELSE 15.0 END AS pct
  FROM ch, tot, mx)
SELECT channel, roi AS current_roi, {P.r('pct', 1)} AS suggested_budget_percent,
  {P.r('total * pct / 100.0')} AS suggested_budget_amount,
  CASE WHEN (roi IS NULL AND budget = 0 AND revenue > 0) OR roi > 100 THEN {_q(M.BUDGET_UP)}
       WHEN roi > 50 THEN {_q(M.BUDGET_KEEP)} ELSE {_q(M.BUDGET_DOWN)} END AS recommendation
FROM p""", CAMPAIGNS_SQL)

# ------------------------------------------------------------ segments


def _abc_sql(key, src="v_sales"):
    return f"""per AS (SELECT {key} AS k, SUM(CAST(amount AS DECIMAL(18,4))) AS rev
  FROM {src} WHERE {key} IS NOT NULL GROUP BY 1),
tot AS (SELECT SUM(rev) AS total FROM per),
cum AS (SELECT k, rev, SUM(rev) OVER (ORDER BY rev DESC, k
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM per),
abc0 AS (SELECT CAST(k AS VARCHAR) AS item, CAST(rev AS DOUBLE) AS revenue,
  {P.r('CAST(c AS DOUBLE) / CAST(total AS DOUBLE) * 100.0')} AS cum_pct FROM cum, tot
  WHERE total > 0),
abc AS (SELECT *, CASE WHEN cum_pct <= 70 THEN 'A' WHEN cum_pct <= 90 THEN 'B' ELSE 'C' END
  AS abc_class FROM abc0)"""


SQL["abc_category"] = with_views(f"WITH {_abc_sql('category')} SELECT * FROM abc", SALES_SQL)
SQL["abc_product"] = with_views(f"WITH {_abc_sql('product')} SELECT * FROM abc", SALES_SQL)
SQL["abc_summary"] = with_views(f"""WITH {_abc_sql('category')},
per_c AS (SELECT abc_class, COUNT(*) AS n_items, SUM(CAST(revenue AS DECIMAL(38,4))) AS rv
  FROM abc GROUP BY 1),
t AS (SELECT COUNT(*) AS n, SUM(CAST(revenue AS DECIMAL(38,4))) AS tr FROM abc),
cls AS (SELECT * FROM (VALUES ('A'), ('B'), ('C')) v(abc_class))
SELECT cls.abc_class, CAST(COALESCE(per_c.n_items, 0) AS BIGINT) AS n_items,
  {P.r('COALESCE(CAST(per_c.rv AS DOUBLE), 0.0)')} AS revenue,
  COALESCE({P.r(P.div('COALESCE(per_c.n_items, 0)', 't.n') + ' * 100.0')}, 0.0) AS item_pct,
  COALESCE({P.r(P.div('COALESCE(CAST(per_c.rv AS DOUBLE), 0.0)', 'CAST(t.tr AS DOUBLE)') + ' * 100.0')}, 0.0)
    AS revenue_pct
FROM cls LEFT JOIN per_c ON cls.abc_class = per_c.abc_class, t WHERE t.n > 0""", SALES_SQL)


def _rfm_sql(src="v_sales", freq_col="date", reverse=True):
    rs = ("6 - greatest(1, (5 * (rr - 1) + n - 2) // (n - 1))" if reverse
          else "greatest(1, (5 * (rr - 1) + n - 2) // (n - 1))")
    return f"""nw AS (SELECT MAX(date) AS now FROM {src}),
per AS (SELECT customer, MAX(date) AS last, COUNT({freq_col}) AS F,
  CAST(COALESCE(SUM(CAST(amount AS DECIMAL(18,4))), 0) AS DOUBLE) AS M
  FROM {src} WHERE customer IS NOT NULL GROUP BY customer),
r AS (SELECT customer, CAST(floor((epoch_us(CAST(now AS TIMESTAMP)) - epoch_us(CAST(last AS TIMESTAMP)))
  / 86400000000) AS BIGINT) AS R, F, M FROM per, nw),
rk AS (SELECT *, row_number() OVER (ORDER BY R, customer) AS rr,
  row_number() OVER (ORDER BY F, customer) AS rf, row_number() OVER (ORDER BY M, customer) AS rm,
  COUNT(*) OVER () AS n FROM r WHERE R IS NOT NULL),
sc AS (SELECT *, CASE WHEN n = 1 THEN 5 ELSE {rs} END AS rs,
  CASE WHEN n = 1 THEN 1 ELSE greatest(1, (5 * (rf - 1) + n - 2) // (n - 1)) END AS fs,
  CASE WHEN n = 1 THEN 1 ELSE greatest(1, (5 * (rm - 1) + n - 2) // (n - 1)) END AS ms FROM rk),
rfm AS (SELECT CAST(customer AS VARCHAR) AS customer, R, CAST(F AS BIGINT) AS F, M,
  CAST(rs + fs + ms AS BIGINT) AS rfm_score,
  CASE WHEN rs + fs + ms >= 12 THEN {_q(S.SEGMENTS[0])} WHEN rs + fs + ms >= 9 THEN {_q(S.SEGMENTS[1])}
       WHEN rs + fs + ms >= 6 THEN {_q(S.SEGMENTS[2])} ELSE {_q(S.SEGMENTS[3])} END AS segment FROM sc)"""


SQL["rfm_segments"] = with_views(f"WITH {_rfm_sql()} SELECT * FROM rfm", SALES_SQL)
SQL["rfm_unreversed"] = with_views(f"WITH {_rfm_sql(freq_col='order_id', reverse=False)} "
                                   "SELECT * FROM rfm", SALES_SQL)
SQL["rfm_events"] = with_views(f"WITH {_rfm_sql('v_events')} SELECT * FROM rfm", EVENTS_SQL)
SQL["segment_counts"] = with_views(f"WITH {_rfm_sql()} SELECT segment, COUNT(*) AS n_customers "
                                   "FROM rfm GROUP BY 1", SALES_SQL)
SQL["rfmq_features"] = with_views(f"""WITH nw AS (SELECT MAX(date) AS now FROM v_sales),
per AS (SELECT customer, MAX(date) AS last, COUNT(order_id) AS F,
  CAST(COALESCE(SUM(CAST(amount AS DECIMAL(18,4))), 0) AS DOUBLE) AS M,
  CAST(COALESCE(SUM(CAST(qty AS DECIMAL(18,4))), 0) AS DOUBLE) AS Q
  FROM v_sales WHERE customer IS NOT NULL GROUP BY customer)
SELECT CAST(customer AS VARCHAR) AS customer,
  CAST(floor((epoch_us(CAST(now AS TIMESTAMP)) - epoch_us(CAST(last AS TIMESTAMP))) / 86400000000)
    AS BIGINT) AS Recency, F AS Frequency, M AS Monetary, Q AS Quantity FROM per, nw""", SALES_SQL)



# k-means: four starts at evenly spaced ranks, 20 rounds each, the cheapest wins.
_FEAT = list(S.FEATURES)
_Z = ", ".join(f"({c} - AVG({c}) OVER ()) / STDDEV_SAMP({c}) OVER () AS x{i}" for i, c in enumerate(_FEAT))
_X = ", ".join(f"x{i}" for i in range(len(_FEAT)))
_DIST = " + ".join(f"(p.x{i} - rec.x{i}) * (p.x{i} - rec.x{i})" for i in range(len(_FEAT)))
_STARTS = " UNION ALL ".join(
    f"SELECT {i} AS start, row_number() OVER (ORDER BY {c}, customer) AS rk, n, {_X} FROM p0" for i, c in enumerate(_FEAT))
_KMEANS = f"""WITH RECURSIVE feats AS ({{feats}}),
p0 AS (SELECT CAST(customer AS BIGINT) AS customer, {', '.join(_FEAT)}, COUNT(*) OVER () AS n, {_Z} FROM feats),
starts AS ({_STARTS}),
init AS (SELECT start, row_number() OVER (PARTITION BY start ORDER BY rk) - 1 AS c, {_X} FROM starts
  WHERE rk IN (1 + n // 8, 1 + 3 * n // 8, 1 + 5 * n // 8, 1 + 7 * n // 8)),
rec AS (
  SELECT 0 AS it, start, c, {_X} FROM init
  UNION ALL
  SELECT it + 1, start, c, {', '.join(f'AVG(x{i})' for i in range(len(_FEAT)))} FROM (
    SELECT rec.it, rec.start, p.customer, arg_min(rec.c, {_DIST}) AS c, {', '.join(f'any_value(p.x{i}) AS x{i}' for i in range(len(_FEAT)))}
    FROM rec, p0 p WHERE rec.it < 20 GROUP BY rec.it, rec.start, p.customer) a
  GROUP BY it, start, c),
last AS (SELECT rec.start, p.customer, arg_min(rec.c, {_DIST}) AS c, MIN({_DIST}) AS d
  FROM rec, p0 p WHERE rec.it = 20 GROUP BY 1, 2),
best AS (SELECT start FROM (SELECT start, SUM(d) AS cost FROM last GROUP BY 1) ORDER BY round(cost, 6), start LIMIT 1),
num AS (SELECT c, row_number() OVER (ORDER BY x2 DESC, c) - 1 AS cluster FROM rec WHERE it = 20 AND start = (SELECT start FROM best)),
lab AS (SELECT CAST(p0.customer AS VARCHAR) AS customer, {', '.join(_FEAT)}, num.cluster FROM p0 JOIN last ON p0.customer = last.customer
  JOIN num ON last.c = num.c WHERE last.start = (SELECT start FROM best))"""
_KMEANS = _KMEANS.format(feats=SQL["rfmq_features"])
SQL["kmeans_customers"] = _KMEANS + " SELECT * FROM lab"
SQL["kmeans_profile"] = _KMEANS + f""" SELECT cluster, {', '.join(f"{P.r(f'AVG({c})', 4)} AS avg_{c}" for c in _FEAT)},
  COUNT(*) AS n_customers FROM lab GROUP BY cluster"""

# ------------------------------------------------------------ forecasts


def r4(x: str) -> str:
    return P.r(x, 4)


_FUT = {
    "D": "CAST(CAST({last} AS DATE) + CAST({k} AS INTEGER) AS DATE)",
    "W": "CAST(CAST({last} AS DATE) + CAST(7 * {k} + 6 AS INTEGER) AS DATE)",
    "M": "last_day(CAST({last} + to_months(CAST({k} AS INTEGER)) AS DATE))",
    "Q": "last_day(CAST({last} + to_months(CAST(3 * {k} + 2 AS INTEGER)) AS DATE))",
    "Y": "last_day(CAST({last} + to_months(CAST(12 * {k} + 11 AS INTEGER)) AS DATE))",
}


def future_label(freq, last="last", k="k"):
    return _FUT[freq].format(last=last, k=k)


def _series_sql(freq, src="v_sales", view=SALES_SQL):
    return view, P.resample_ctes(src, freq) + """,
ts AS (SELECT ps, period, revenue AS y, row_number() OVER (ORDER BY ps) - 1 AS t,
         COUNT(*) OVER () AS n FROM s)"""


def _ma_sql(freq, periods, window):
    v, s = _series_sql(freq)
    return with_views(f"""WITH st AS (SELECT AVG(y) AS value, MAX(ps) AS last, MAX(n) AS n
  FROM ts WHERE t >= n - {window})
SELECT 'moving_average' AS method, '{freq}' AS freq, CAST(n AS BIGINT) AS history_periods,
  k AS step, {future_label(freq)} AS period, {r4('value')} AS value
FROM st, (SELECT unnest(range(1, {periods} + 1)) AS k)""", v, s)


SQL["forecast_ma"] = _ma_sql("D", 7, 7)
SQL["forecast_ma_monthly"] = _ma_sql("M", 6, 3)
SQL["forecast_ma_by_region"] = with_views(f"""WITH
agg AS (SELECT region, {P.start('W')} AS ps, {P.msum('amount')} AS revenue FROM v_sales
  WHERE date IS NOT NULL AND region IS NOT NULL GROUP BY 1, 2),
b AS (SELECT region, CAST(MIN(ps) AS TIMESTAMP) AS lo, CAST(MAX(ps) AS TIMESTAMP) AS hi FROM agg GROUP BY 1),
sp AS (SELECT region, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS ps FROM b),
ser AS (SELECT sp.region, sp.ps, COALESCE(a.revenue, 0.0) AS y,
  row_number() OVER (PARTITION BY sp.region ORDER BY sp.ps) - 1 AS t,
  COUNT(*) OVER (PARTITION BY sp.region) AS n
  FROM sp LEFT JOIN agg a ON sp.region = a.region AND sp.ps = a.ps),
st AS (SELECT region, AVG(y) AS value, MAX(ps) AS last, MAX(n) AS n FROM ser WHERE t >= n - 3
  GROUP BY region)
SELECT region, 'moving_average' AS method, 'W' AS freq, CAST(n AS BIGINT) AS history_periods,
  k AS step, {future_label('W')} AS period, {r4('value')} AS value
FROM st, (SELECT unnest(range(1, 5)) AS k)""", SALES_SQL)


def _trend_sql_f(freq, periods):
    v, s = _series_sql(freq)
    return with_views(f"""WITH st AS (SELECT regr_slope(y, t) AS slope, regr_intercept(y, t) AS icpt,
  MAX(n) AS n, MAX(ps) AS last FROM ts)
SELECT 'linear_trend' AS method, '{freq}' AS freq, CAST(n AS BIGINT) AS history_periods,
  {r4('slope')} AS slope, k AS step, {future_label(freq)} AS period,
  {r4('greatest(0.0, slope * (n - 1 + k) + icpt)')} AS value
FROM st, (SELECT unnest(range(1, {periods} + 1)) AS k) WHERE n >= 2""", v, s)


SQL["forecast_trend"] = _trend_sql_f("D", 7)
SQL["forecast_trend_monthly"] = _trend_sql_f("M", 6)
_v, _s = _series_sql("D")
SQL["trend_fitted"] = with_views(f"""WITH st AS (SELECT regr_slope(y, t) AS slope,
  regr_intercept(y, t) AS icpt, MAX(n) AS n, MAX(ps) AS last FROM ts)
SELECT 'fitted' AS kind, ts.period, ts.y AS actual, {r4('slope * t + icpt')} AS value
FROM ts, st WHERE st.n >= 2
UNION ALL
SELECT 'forecast' AS kind, {future_label('D')} AS period, CAST(NULL AS DOUBLE) AS actual,
  {r4('slope * (n - 1 + k) + icpt')} AS value
FROM st, (SELECT unnest(range(1, 31)) AS k) WHERE n >= 2""", _v, _s)
SQL["forecast_ses"] = with_views(f"""WITH st AS (SELECT
  SUM(pow(0.7, n - 1 - t) * CASE WHEN t = 0 THEN 1.0 ELSE 0.3 END * y) AS value,
  MAX(ps) AS last, MAX(n) AS n FROM ts)
SELECT 'ses' AS method, 'D' AS freq, CAST(n AS BIGINT) AS history_periods, k AS step,
  {future_label('D')} AS period, {r4('value')} AS value
FROM st, (SELECT unnest(range(1, 31)) AS k)""", _v, _s)
_vm, _sm = _series_sql("M")
SQL["forecast_holt_fixed_beta"] = with_views(f"""WITH RECURSIVE
rec(t, l, b) AS (
  SELECT 1, (SELECT y FROM ts WHERE t = 1), (SELECT y FROM ts WHERE t = 1) - (SELECT y FROM ts WHERE t = 0)
  UNION ALL
  SELECT ts.t, 0.3 * ts.y + 0.7 * (rec.l + rec.b),
         0.1 * ((0.3 * ts.y + 0.7 * (rec.l + rec.b)) - rec.l) + 0.9 * rec.b
  FROM rec JOIN ts ON ts.t = rec.t + 1),
fin AS (SELECT l, b FROM rec ORDER BY t DESC LIMIT 1),
st AS (SELECT MAX(ps) AS last, MAX(n) AS n FROM ts)
SELECT 'holt' AS method, 'M' AS freq, CAST(n AS BIGINT) AS history_periods,
  CAST(0.1 AS DOUBLE) AS beta,
  k AS step, {future_label('M')} AS period, {r4('l + k * b')} AS value
FROM fin, st, (SELECT unnest(range(1, 13)) AS k) WHERE n >= 2""", _vm, _sm)


_TS_BY = """,
ts AS (SELECT {k}, ps, period, revenue AS y, row_number() OVER (PARTITION BY {k} ORDER BY ps) - 1 AS t,
         COUNT(*) OVER (PARTITION BY {k}) AS n FROM s)"""
SQL["forecast_trend_by_region"] = with_views(f"""WITH st AS (SELECT region, regr_slope(y, t) AS slope,
  regr_intercept(y, t) AS icpt, MAX(n) AS n, MAX(ps) AS last FROM ts GROUP BY region)
SELECT region, 'linear_trend' AS method, 'M' AS freq, CAST(n AS BIGINT) AS history_periods,
  {r4('slope')} AS slope, k AS step, {future_label('M')} AS period,
  {r4('greatest(0.0, slope * (n - 1 + k) + icpt)')} AS value
FROM st, (SELECT unnest(range(1, 5)) AS k) WHERE n >= 2""", SALES_SQL, P.grouped_ctes("v_sales", "M", "region") + _TS_BY.format(k="region"))
SQL["forecast_holt_by_category"] = with_views(f"""WITH RECURSIVE
y01 AS (SELECT category, MAX(CASE WHEN t = 0 THEN y END) AS y0, MAX(CASE WHEN t = 1 THEN y END) AS y1,
  MAX(n) AS n, MAX(ps) AS last FROM ts GROUP BY category),
rec(category, t, l, b) AS (
  SELECT category, 1, y1, y1 - y0 FROM y01 WHERE n >= 2
  UNION ALL
  SELECT ts.category, ts.t, 0.3 * ts.y + 0.7 * (rec.l + rec.b),
         0.1 * ((0.3 * ts.y + 0.7 * (rec.l + rec.b)) - rec.l) + 0.9 * rec.b
  FROM rec JOIN ts ON ts.category = rec.category AND ts.t = rec.t + 1)
SELECT y01.category, 'holt' AS method, 'M' AS freq, CAST(n AS BIGINT) AS history_periods,
  CAST(0.1 AS DOUBLE) AS beta, k AS step, {future_label('M')} AS period, {r4('l + k * b')} AS value
FROM rec JOIN y01 ON rec.category = y01.category AND rec.t = n - 1, (SELECT unnest(range(1, 7)) AS k)""",
                                                SALES_SQL, P.grouped_ctes("v_sales", "M", "category") + _TS_BY.format(k="category"))
SQL["evaluate_by_region"] = with_views(f"""WITH sp0 AS (SELECT *, CAST(floor(n * 0.8) AS BIGINT) AS sp FROM ts),
fit AS (SELECT region, COUNT(*) AS n_train, regr_slope(y, t) AS bb, regr_intercept(y, t) AS aa FROM sp0 WHERE t < sp GROUP BY region),
te AS (SELECT sp0.region, y, n_train, bb * t + aa AS p FROM sp0 JOIN fit ON sp0.region = fit.region WHERE t >= sp),
agg AS (SELECT region, MAX(n_train) AS n_train, COUNT(*) AS n_test, AVG(abs(y - p)) AS mae,
  sqrt(AVG((y - p) * (y - p))) AS rmse, AVG(CASE WHEN y <> 0 THEN abs((y - p) / y) END) * 100.0 AS mape,
  COUNT(CASE WHEN y = 0 THEN 1 END) AS mape_skipped, SUM((y - p) * (y - p)) AS ssr,
  var_pop(y) * COUNT(*) AS sst FROM te GROUP BY region)
SELECT region, 'trend' AS method, CAST(n_train AS BIGINT) AS n_train, n_test, {r4('mae')} AS mae, {r4('rmse')} AS rmse,
  {r4('mape')} AS mape, mape_skipped,
  {r6("CASE WHEN sst > 0 THEN 1.0 - ssr / sst WHEN ssr = 0 THEN 1.0 ELSE 0.0 END")} AS r2
FROM agg""", SALES_SQL, P.grouped_ctes("v_sales", "W", "region") + _TS_BY.format(k="region"))


def _eval_sql(method):
    if method == "ma":
        fit = """SELECT AVG(y) AS m, COUNT(*) AS n_train,
    SUM(CASE WHEN t >= sp - 7 THEN y END) AS sw, COUNT(CASE WHEN t >= sp - 7 THEN 1 END) AS cw
    FROM tr"""
        pred = "CASE WHEN t - sp < 7 THEN m ELSE (sw + 7.0 * m) / (cw + 7) END"
    else:
        fit = "SELECT AVG(y) AS m, COUNT(*) AS n_train, regr_slope(y, t) AS bb, regr_intercept(y, t) AS aa FROM tr"
        pred = "bb * t + aa"
    return with_views(f"""WITH sp0 AS (SELECT *, CAST(floor(n * 0.8) AS BIGINT) AS sp FROM ts),
tr AS (SELECT * FROM sp0 WHERE t < sp),
fit AS ({fit}),
te AS (SELECT sp0.*, fit.*, {pred} AS p FROM sp0, fit WHERE t >= sp),
agg AS (SELECT MAX(n_train) AS n_train, COUNT(*) AS n_test, AVG(abs(y - p)) AS mae,
  sqrt(AVG((y - p) * (y - p))) AS rmse,
  AVG(CASE WHEN y <> 0 THEN abs((y - p) / y) END) * 100.0 AS mape,
  COUNT(CASE WHEN y = 0 THEN 1 END) AS mape_skipped, SUM((y - p) * (y - p)) AS ssr,
  var_pop(y) * COUNT(*) AS sst FROM te)
SELECT '{method}' AS method, CAST(n_train AS BIGINT) AS n_train, n_test, {r4('mae')} AS mae,
  {r4('rmse')} AS rmse, {r4('mape')} AS mape, mape_skipped,
  {r6("CASE WHEN sst > 0 THEN 1.0 - ssr / sst WHEN ssr = 0 THEN 1.0 ELSE 0.0 END")} AS r2
FROM agg""", _v, _s)


SQL["evaluate_trend"] = _eval_sql("trend")
SQL["evaluate_ma"] = _eval_sql("ma")
SQL["forecast_input_summary"] = with_views("""SELECT
  strftime(MIN(date), '%Y-%m-%d %H:%M:%S') || ' 至 ' || strftime(MAX(date), '%Y-%m-%d %H:%M:%S')
    AS data_range, COUNT(*) AS total_records, 'ma,ses,holt,trend' AS methods_available FROM v_sales""", SALES_SQL)

# ------------------------------------------------------------ data quality

SQL["clean_drop"] = with_views("""SELECT * FROM v_dirty WHERE l_orderkey IS NOT NULL
  AND l_linenumber IS NOT NULL AND quantity IS NOT NULL AND price IS NOT NULL
  AND discount IS NOT NULL AND returnflag IS NOT NULL AND linestatus IS NOT NULL""", DIRTY_SQL)
SQL["clean_fill"] = with_views("""WITH st AS (SELECT quantile_cont(quantity, 0.5) AS mq,
  quantile_cont(discount, 0.5) AS md,
  (SELECT returnflag FROM v_dirty WHERE returnflag IS NOT NULL GROUP BY 1
   ORDER BY COUNT(*) DESC, returnflag LIMIT 1) AS mr FROM v_dirty)
SELECT l_orderkey, l_linenumber, COALESCE(quantity, mq) AS quantity, price,
  COALESCE(discount, md) AS discount, COALESCE(returnflag, mr) AS returnflag, linestatus
FROM v_dirty, st""", DIRTY_SQL)
SQL["clean_dedupe"] = with_views("SELECT DISTINCT * FROM v_dirty", DIRTY_SQL)
SQL["clean_few_repeats"] = with_views("SELECT DISTINCT * FROM v_repeated", REPEATED_SQL)


def _iqr_step(prev, cur, col):
    return f"""{cur} AS (SELECT {prev}.* FROM {prev}, (SELECT quantile_cont({col}, 0.25) AS q1,
    quantile_cont({col}, 0.75) AS q3 FROM {prev}) b
  WHERE {col} >= q1 - 1.5 * (q3 - q1) AND {col} <= q3 + 1.5 * (q3 - q1))"""


def _z_step(prev, cur, col):
    return f"""{cur} AS (SELECT {prev}.* FROM {prev}, (SELECT AVG({col}) AS m,
    STDDEV_SAMP({col}) AS s FROM {prev}) b
  WHERE s > 0 AND abs(({col} - m) / s) < 3.0)"""


def _steps(first: str, step, cols: list[str]) -> str:
    """CTEs c0 = ``first``, then a filter step per column, in order."""
    return ",\n".join([f"c0 AS ({first})"] + [step(f"c{i}", f"c{i + 1}", c) for i, c in enumerate(cols)])


_NUMBERS = ["l_orderkey", "l_linenumber", "quantity", "price", "discount"]
SQL["clean_iqr"] = with_views(f"WITH {_steps('SELECT * FROM v_dirty', _iqr_step, _NUMBERS)} SELECT * FROM c5", DIRTY_SQL)
SQL["clean_zscore"] = with_views(f"WITH {_steps('SELECT * FROM v_dirty', _z_step, _NUMBERS)} SELECT * FROM c5", DIRTY_SQL)
SQL["clean_zscore_nan"] = with_views(
    f"WITH {_steps('SELECT * FROM v_nan', _z_step, _NUMBERS[:4])} SELECT * FROM c4", NAN_SQL)
_FILLED = """SELECT DISTINCT l_orderkey, l_linenumber, COALESCE(quantity, mq) AS quantity, price,
  COALESCE(discount, md) AS discount, COALESCE(returnflag, mr) AS returnflag, linestatus FROM v_repeated, st"""
SQL["clean_pipeline"] = with_views(f"""WITH st AS (SELECT quantile_cont(quantity, 0.5) AS mq, quantile_cont(discount, 0.5) AS md,
  (SELECT returnflag FROM v_repeated WHERE returnflag IS NOT NULL GROUP BY 1
   ORDER BY COUNT(*) DESC, returnflag LIMIT 1) AS mr FROM v_repeated),
{_steps(_FILLED, _iqr_step, _NUMBERS)} SELECT * FROM c5""", REPEATED_SQL)
SQL["clean_fill_nan"] = with_views("""WITH st AS (SELECT quantile_cont(quantity, 0.5) AS mq, quantile_cont(price, 0.5) AS mp FROM v_nan)
SELECT l_orderkey, l_linenumber, COALESCE(quantity, mq) AS quantity, COALESCE(price, mp) AS price, linestatus, date
FROM v_nan, st""", NAN_SQL)
_PROFILE_COLS = [("l_orderkey", "bigint"), ("l_linenumber", "int"), ("quantity", "double"),
                 ("price", "double"), ("discount", "double"), ("returnflag", "string"),
                 ("linestatus", "string")]


def _profile_sql(view: str, cols) -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS column, '{t}' AS dtype, "
        f"CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_missing, COUNT(*) AS n_rows "
        f"FROM {view}" for i, (c, t) in enumerate(cols))


SQL["data_profile"] = with_views(_profile_sql("v_dirty", _PROFILE_COLS), DIRTY_SQL)
SQL["data_profile_nan"] = with_views(_profile_sql("v_nan", [
    *_PROFILE_COLS[:4], ("linestatus", "string"), ("date", "timestamp_ntz")]), NAN_SQL)

# ------------------------------------------------------------ report

SQL["report_totals"] = with_views(f"""
SELECT 'category' AS sheet, CAST(category AS VARCHAR) AS key, {P.msum('amount')} AS revenue
FROM v_sales WHERE category IS NOT NULL GROUP BY category
UNION ALL
SELECT 'region' AS sheet, CAST(region AS VARCHAR) AS key, {P.msum('amount')} AS revenue
FROM v_sales WHERE region IS NOT NULL GROUP BY region""", SALES_SQL)


def _alerts_cte(freq="D", z=2.0):
    w = "OVER (ORDER BY ps ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"
    return P.resample_ctes("v_sales", freq) + f""",
sc AS (SELECT period, revenue,
         CASE WHEN COUNT(revenue) {w} >= 3 THEN AVG(revenue) {w} END AS mu,
         CASE WHEN COUNT(revenue) {w} >= 3 THEN STDDEV_SAMP(revenue) {w} END AS sd,
         COUNT(*) OVER () AS n FROM s),
alerts AS (SELECT period, revenue AS actual, mu AS expected, (revenue - mu) / sd AS z_score
  FROM sc WHERE n >= 5 AND sd IS NOT NULL AND sd >= 1e-9 AND abs((revenue - mu) / sd) >= {z})"""


_MONEY = "format('{{:,.0f}}', {x})"  # braces halve in str.format
_G = "growth_first_to_last_month"
_DAY = "strftime(period, '%Y-%m-%d')"


def _m(x):
    return _MONEY.format(x=x)


def _signed(x):
    return f"format('{{{{:+.1f}}}}', {x})"


_SPAN = _sentence("span", "date_start", "date_end", "CAST(total_orders AS VARCHAR)", "CAST(n_customers AS VARCHAR)",
                  _m("total_revenue"), _m("avg_order_value"),
                  f"CASE WHEN {_G} IS NOT NULL THEN {_sentence('growth', _signed(_G))} ELSE '' END")
_ITEMS = [
    ("overview", 0, _SPAN, "sm"),
    ("highlights", 1, _sentence("top_category", "top_category", _m("top_category_revenue")), "sm WHERE COALESCE(top_category, '') <> ''"),
    ("highlights", 2, _sentence("top_region", "top_region", _m("top_region_revenue")), "sm WHERE COALESCE(top_region, '') <> ''"),
    ("highlights", 3, _sentence("expanding", _signed(_G)), f"sm WHERE {_G} > 10"),
    ("risks", 1, _sentence("drop", _DAY, _m("actual"), _m("expected"), "format('{{:.2f}}', z_score)"), "fd"),
    ("risks", 2, _sentence("shrinking", f"format('{{{{:.1f}}}}', {_G})"), f"sm WHERE {_G} < -10"),
    ("risks", 3, _sentence("few_orders"), "sm WHERE n_customers > 0 AND total_orders / n_customers < 1.2"),
    ("recommendations", 1, _sentence("push_category", "top_category"), "sm WHERE COALESCE(top_category, '') <> ''"),
    ("recommendations", 2, _sentence("check_drop"), "fd"),
    ("recommendations", 3, _sentence("review_spike", _DAY), "fs"),
]
_ITEM_SQL = "\n  UNION ALL ".join(f"SELECT '{sec}' AS section, {k} AS k, {text} AS text FROM {src}" for sec, k, text, src in _ITEMS)
_ITEM_SQL = _ITEM_SQL.replace("{{", "{").replace("}}", "}")
SQL["commentary_rules"] = with_views(f"""WITH {_SUMMARY_CTE}, {_alerts_cte()},
fd AS (SELECT * FROM alerts WHERE z_score <= 0 ORDER BY period LIMIT 1),
fs AS (SELECT * FROM alerts WHERE z_score > 0 ORDER BY period LIMIT 1),
items AS ({_ITEM_SQL}),
full_ AS (SELECT * FROM items UNION ALL
  SELECT 'recommendations', 4, {_sentence('carry_on')} FROM sm
  WHERE NOT EXISTS (SELECT 1 FROM items WHERE section = 'recommendations')),
rows_ AS (SELECT section, CAST(row_number() OVER (PARTITION BY section ORDER BY k) - 1 AS BIGINT)
  AS pos, text FROM full_)
SELECT section, pos, text FROM rows_""", SALES_SQL)


def _md_section(sec, title, last=False):
    tail = "" if last else " || chr(10)"
    return (f"COALESCE((SELECT chr(10) || '## {title}' || chr(10) || chr(10) || "
            f"string_agg('- ' || text, chr(10) ORDER BY pos){tail} FROM rows_ "
            f"WHERE section = '{sec}' HAVING COUNT(*) > 0), '')")


SQL["commentary_markdown"] = SQL["commentary_rules"].replace(
    "SELECT section, pos, text FROM rows_",
    f"SELECT '## {N.HEADINGS['overview']}' || chr(10) || chr(10) || (SELECT text FROM rows_ WHERE section = 'overview')"
    " || chr(10) || " + _md_section("highlights", N.HEADINGS["highlights"]) + " || " + _md_section("risks", N.HEADINGS["risks"])
    + " || " + _md_section("recommendations", N.HEADINGS["recommendations"], last=True)
    + " AS markdown, 'heuristic' AS backend")



# Holt with beta chosen on a 101-point grid, mirrored operation by operation
# (same start state, same expression order) so the chosen beta is identical.
_D = "CAST({} AS DOUBLE)"
_A, _ONE = _D.format(0.3), _D.format(1.0)
_HOLT_CTES = f"""y01 AS (SELECT MAX(CASE WHEN t = 0 THEN y END) AS y0,
                MAX(CASE WHEN t = 1 THEN y END) AS y1, MAX(n) AS n, MAX(ps) AS last FROM ts),
betas AS (SELECT CAST(i AS DOUBLE) / CAST(100.0 AS DOUBLE) AS beta FROM range(0, 101) r(i)),
rec(beta, t, l, b, sse) AS (
  SELECT beta, 0, y0, y1 - y0, CAST(0.0 AS DOUBLE) FROM betas, y01 WHERE n >= 2
  UNION ALL
  SELECT rec.beta, ts.t,
    {_A} * ts.y + ({_ONE} - {_A}) * (rec.l + rec.b),
    rec.beta * (({_A} * ts.y + ({_ONE} - {_A}) * (rec.l + rec.b)) - rec.l)
      + ({_ONE} - rec.beta) * rec.b,
    rec.sse + (ts.y - (rec.l + rec.b)) * (ts.y - (rec.l + rec.b))
  FROM rec JOIN ts ON ts.t = rec.t + 1),
fin AS (SELECT beta, l, b, sse FROM rec, y01 WHERE rec.t = y01.n - 1),
best AS (SELECT beta, l, b FROM fin ORDER BY sse, beta LIMIT 1)"""

SQL["forecast_holt"] = with_views(f"""WITH RECURSIVE {_HOLT_CTES}
SELECT 'holt' AS method, 'D' AS freq, CAST(n AS BIGINT) AS history_periods, beta, k AS step,
  {future_label('D')} AS period, {r4('l + k * b')} AS value
FROM best, y01, (SELECT unnest(range(1, 31)) AS k)""", _v, _s)

SQL["compare_forecasts"] = with_views(f"""WITH RECURSIVE {_HOLT_CTES},
st AS (SELECT AVG(CASE WHEN t >= n - 7 THEN y END) AS ma, regr_slope(y, t) AS slope,
  regr_intercept(y, t) AS icpt, MAX(n) AS n, MAX(ps) AS last FROM ts),
steps AS (SELECT unnest(range(1, 31)) AS k)
SELECT 'moving_average' AS method, k AS step, {future_label('D')} AS period, {r4('ma')} AS value
FROM st, steps
UNION ALL
SELECT 'holt', k, {future_label('D', 'y01.last')}, {r4('l + k * b')} FROM best, y01, steps
UNION ALL
SELECT 'linear_trend', k, {future_label('D')}, {r4('slope * (n - 1 + k) + icpt')}
FROM st, steps WHERE n >= 2""", _v, _s)


# N2: the payload's fields, as they are read back from its JSON.
def _top_sql(key):
    return f"""top_{key} AS (SELECT CAST({key} AS VARCHAR) AS k, {P.msum('amount')} AS rev FROM v_sales
  WHERE {key} IS NOT NULL GROUP BY {key} ORDER BY rev DESC, k LIMIT 5)"""


SQL["commentary_payload"] = with_views(f"""WITH {_SUMMARY_CTE}, {_alerts_cte()},
{P.resample_ctes('v_sales', 'M', 'mo')},
last6 AS (SELECT * FROM mo ORDER BY period DESC LIMIT 6),
first3 AS (SELECT * FROM alerts ORDER BY period LIMIT 3),
{_top_sql('category')}, {_top_sql('region')}
SELECT n_records, date_start, total_revenue, top_region, n_customers,
  (SELECT list(CAST(period AS VARCHAR) ORDER BY period) FROM last6) AS trend_periods,
  (SELECT list(revenue ORDER BY period) FROM last6) AS trend_revenue,
  (SELECT list(n_orders ORDER BY period) FROM last6) AS trend_orders,
  (SELECT list(CAST(period AS VARCHAR) ORDER BY period) FROM first3) AS alert_periods,
  (SELECT list(CASE WHEN z_score > 0 THEN 'spike' ELSE 'drop' END ORDER BY period) FROM first3) AS alert_directions,
  (SELECT list(k ORDER BY rev DESC, k) FROM top_category) AS categories,
  (SELECT list(rev ORDER BY rev DESC, k) FROM top_category) AS category_revenue,
  (SELECT list(k ORDER BY rev DESC, k) FROM top_region) AS regions,
  (SELECT list(rev ORDER BY rev DESC, k) FROM top_region) AS region_revenue, true AS has_growth
FROM sm""", SALES_SQL)


# N3: what each response must give follows from its form; the texts of
# conversations are none of them JSON objects.
def _list_sql(sec):
    return (f"COALESCE((SELECT list(text ORDER BY pos) FROM rows_ WHERE section = '{sec}'), "
            "CAST([] AS VARCHAR[]))")


SQL["parse_commentary"] = SQL["commentary_rules"].replace("\nSELECT section, pos, text FROM rows_", f""",
rep AS (SELECT (SELECT text FROM rows_ WHERE section = 'overview') AS overview,
  {_list_sql('highlights')} AS highlights, {_list_sql('risks')} AS risks,
  {_list_sql('recommendations')} AS recommendations),
resp AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS response_id, NULL AS name, NULL AS key,
    CASE WHEN json_valid(text) AND json_type(text) = 'OBJECT' THEN 'json' ELSE 'text' END AS form
  FROM conversations
  UNION ALL
  SELECT 'json-' || n_nationkey || '-' || form, n_name, n_nationkey, form
  FROM nation, (VALUES ('plain'), ('fenced'), ('broken'), ('trailing'), ('bare')) f(form)),
o AS (SELECT *, form IN ('plain', 'fenced', 'bare') AS ok FROM resp)
SELECT response_id,
  CASE WHEN form = 'bare' THEN '' WHEN ok THEN name ELSE rep.overview END AS overview,
  CASE WHEN ok THEN [name, '7', 'True'] ELSE rep.highlights END AS highlights,
  CASE WHEN ok THEN CAST([] AS VARCHAR[]) ELSE rep.risks END AS risks,
  CASE WHEN ok THEN ['r' || key] ELSE rep.recommendations END AS recommendations,
  CASE WHEN ok THEN 'llm:stub' ELSE 'heuristic' END AS backend
FROM o, rep""")
SQL["head_sample"] = """SELECT * FROM lineitem
ORDER BY l_orderkey, l_linenumber LIMIT 10"""

# ------------------------------------------------------------ round trips through files


def _load_sql(view: str, figures: dict[str, str], bad: dict[str, str]) -> str:
    rows = [f"SELECT 'rows' AS what, COUNT(*) AS n FROM {view}"]
    rows += [f"SELECT '{k}', CAST({v} AS BIGINT) FROM {view}" for k, v in figures.items()]
    rows += [f"SELECT * FROM (SELECT '{k}' AS what, COUNT(*) AS n FROM {view} WHERE {v}) z WHERE n > 0" for k, v in bad.items()]
    return " UNION ALL ".join(rows)


def _cents(x: str, ok: str = "true") -> str:
    return f"SUM(CASE WHEN {ok} THEN round_even(({x}) * 100, 0) END)"


SQL["read_ledger"] = with_views(_load_sql(
    "v_sales", {"cents": _cents("amount", "order_id % 37 <> 0"), "days": "COUNT(DISTINCT CASE WHEN order_id % 41 <> 0 THEN CAST(date AS DATE) END)"},
    {"amount not a double": "order_id % 37 = 0", "date not a date": "order_id % 41 = 0"}), SALES_SQL)
_K = "(order_id * 7 + product_id)"
SQL["read_orders"] = with_views(_load_sql(
    "v_ecom_raw", {"revenue_cents": _cents("CAST(quantity AS BIGINT) * unit_price", f"{_K} % 43 <> 0 AND {_K} % 47 <> 0"),
                   "units": f"SUM(CASE WHEN {_K} % 43 <> 0 THEN quantity END)",
                   "days": f"COUNT(DISTINCT CASE WHEN {_K} % 53 <> 0 THEN CAST(order_date AS DATE) END)"},
    {"quantity not a bigint": f"{_K} % 43 = 0", "unit_price not a double": f"{_K} % 47 = 0", "order_date not a date": f"{_K} % 53 = 0"}), ECOM_SQL)
SQL["read_products"] = with_views(_load_sql(
    "v_products", {"stock": "SUM(CASE WHEN product_id % 11 <> 0 THEN stock_quantity END)", "reorder": "SUM(reorder_level)", "price_cents": _cents("sell_price"),
                   "restocked": "COUNT(*) FILTER (WHERE product_id % 13 <> 0 AND product_id % 17 <> 0)"},
    {"stock_quantity not a bigint": "product_id % 11 = 0", "last_restock_date not a date": "product_id % 13 = 0"}), PRODUCTS_SQL)
SQL["read_campaigns"] = with_views(_load_sql(
    "v_campaigns", {"budget_cents": _cents("budget", "impressions % 3 <> 0"), "revenue_cents": _cents("revenue"), "orders": "SUM(orders)",
                    "starts": "COUNT(*) FILTER (WHERE clicks % 2 <> 0)", "ends": "COUNT(end_date)"},
    {"budget not a double": "impressions % 3 = 0", "start_date not a date": "clicks % 2 = 0"}), CAMPAIGNS_SQL)
SQL["emit_replaces_periods"] = with_views("""WITH m AS (SELECT date_trunc('month', date) AS m, SUM(CAST(amount AS DECIMAL(18,4))) AS a, COUNT(*) AS n
  FROM v_sales GROUP BY 1),
c AS (SELECT CAST(unnest(generate_series(CAST((SELECT MIN(m) FROM m) AS TIMESTAMP), CAST((SELECT MAX(m) FROM m) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS m)
SELECT CAST(last_day(c.m) AS VARCHAR) AS period, CAST(round_even(CAST(COALESCE(a, 0) AS DOUBLE) * 100, 0) AS BIGINT) AS cents,
  COALESCE(n, 0) + CASE WHEN year(c.m) = 1996 THEN 1 ELSE 0 END AS n_orders, CAST(year(c.m) AS INTEGER) AS year
FROM c LEFT JOIN m ON CAST(m.m AS DATE) = c.m""", SALES_SQL)
SQL["report_replaces_periods"] = with_views("""WITH r AS (SELECT year(date) || '-12-31' AS period, category, region,
  CAST(amount AS DECIMAL(18,4)) * CASE WHEN year(date) IN (1995, 1996) THEN 2 ELSE 1 END AS a FROM v_sales)
SELECT period, 'category' AS sheet, category AS key, CAST(round_even(CAST(SUM(a) AS DOUBLE) * 100, 0) AS BIGINT) AS cents FROM r GROUP BY 1, 2, 3
UNION ALL SELECT period, 'region', region, CAST(round_even(CAST(SUM(a) AS DOUBLE) * 100, 0) AS BIGINT) FROM r GROUP BY 1, 2, 3
UNION ALL SELECT period, 'raw', 'rows', COUNT(*) FROM r GROUP BY 1""", SALES_SQL)

SQL["rfm_bucketed"] = SQL["rfm_segments"]
SQL["profit_bucketed"] = SQL["profit_analysis"]
