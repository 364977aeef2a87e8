import pytest

from conftest import collect
from kpiforge.operators import marketing, orders, products

LINES = "order_id string, product_id string, category string, quantity long, unit_price double, cost_price double, " \
        "order_date string, customer_id string"


@pytest.fixture(scope="module")
def shop_orders(spark):
    """Eleven lines of four products: tea 9 x 4.00 (cost 1.00), pot 2 x 50.00 (cost 40.00),
    cup 5 x 8.00 (cost 4.80), and one tray that nobody priced."""
    lines = [("tea", 4.0, 1.0, [2, 1, 3, 3]), ("pot", 50.0, 40.0, [1, 1]), ("cup", 8.0, 4.8, [1, 2, 1, 1]), ("tray", 0.0, 0.0, [6])]
    rows = [(f"N{p}{i}", p, "drink" if p == "tea" else "ware", q, price, cost, f"2023-06-{10 + i}", f"K{(q + i) % 4}")
            for p, price, cost, counts in lines for i, q in enumerate(counts)]
    return orders.prepare_orders(spark.createDataFrame(rows, LINES))


@pytest.fixture(scope="module")
def shop_products(spark):
    return spark.createDataFrame(
        [("tea", "Green tea", "drink", 12, 20), ("pot", "Tea pot", "ware", 30, 20),
         ("cup", "Tea cup", "ware", 90, 40), ("spoon", "Tea spoon", "ware", 0, 0)],
        "product_id string, product_name string, category string, stock_quantity long, reorder_level long")


def test_prepare_orders_values_and_idempotence(spark):
    df = spark.createDataFrame([(7, 1.5, 0.25), (4, 36.0, 45.0), (0, 12.0, 3.0)],
                               "quantity long, unit_price double, cost_price double")
    p = orders.prepare_orders(df)
    assert collect(p, "revenue", "cost", "profit") == [(10.5, 1.75, 8.75), (144.0, 180.0, -36.0), (0.0, 0.0, 0.0)]
    assert collect(orders.prepare_orders(p)) == collect(p)
    given = orders.prepare_orders(spark.createDataFrame([(6, 2.5, 13.25)], "quantity long, unit_price double, revenue double"))
    assert collect(given, "revenue", "profit") == [(13.25, 13.25)]
    dates = orders.prepare_orders(spark.createDataFrame([(1, 4.0, "31st of May")], "quantity long, unit_price double, order_date string"))
    assert collect(dates, "order_date") == [(None,)]


def test_overview_and_repeat(shop_orders, spark):
    o = collect(orders.overview_metrics(shop_orders))[0]
    assert o["n_orders"] == 11 and o["unique_customers"] == 4
    assert o["total_revenue"] == 36.0 + 100.0 + 40.0 and o["total_profit"] == pytest.approx(27.0 + 20.0 + 16.0)
    e = collect(orders.overview_metrics(shop_orders.limit(0)))[0]
    assert e["n_orders"] == 0 and e["profit_margin_pct"] == 0.0 and e["avg_order_value"] == 0.0
    r = collect(orders.repeat_purchase(spark.createDataFrame([("a",)] * 3 + [("b",), ("c",), ("c",), (None,)], "customer_id string")))[0]
    assert (r["total_customers"], r["repeat_customers"], r["repeat_rate_pct"], r["avg_orders_per_customer"]) == (3, 2, 66.67, 2.0)


def test_category_and_ranking(shop_orders, shop_products):
    cat = collect(products.category_performance(shop_orders), "category", "quantity", "revenue", "order_count", "avg_order_value")
    assert cat == [("ware", 13.0, 140.0, 7, 20.0), ("drink", 9.0, 36.0, 4, 9.0)]
    rank = collect(products.sales_ranking(shop_orders, shop_products, top_n=3), "product_id", "product_name", "revenue")
    assert rank == [("pot", "Tea pot", 100.0), ("cup", "Tea cup", 40.0), ("tea", "Green tea", 36.0)]
    assert collect(products.sales_ranking(shop_orders), "product_id")[-1] == ("tray",)


def test_inventory_low_stock_restock(shop_orders, shop_products):
    inv = {r["product_id"]: r for r in collect(products.inventory_status(shop_orders, shop_products))}
    assert {k: r["stock_status"] for k, r in inv.items()} == {
        "tea": products.STATUS_LOW, "pot": products.STATUS_OK, "cup": products.STATUS_AMPLE, "spoon": products.STATUS_LOW}
    assert inv["tea"]["sold_qty"] == 9.0 and inv["tea"]["turnover_rate"] == 75.0
    assert inv["spoon"]["sold_qty"] == 0.0 and inv["spoon"]["turnover_rate"] is None
    assert sorted(collect(products.low_stock(shop_orders, shop_products), "product_id")) == [("spoon",), ("tea",)]
    rs = {r["product_id"]: r for r in collect(products.restock_recommendations(shop_orders, shop_products, days_span=10))}
    assert set(rs) == {"tea", "pot", "spoon"}
    assert rs["tea"]["daily_sales"] == 0.9 and rs["tea"]["recommendation"] == products.RESTOCK_NOW + "13"
    assert rs["pot"]["days_remaining"] == 150.0 and rs["pot"]["recommendation"] == products.RESTOCK_FINE
    with pytest.raises(ValueError):
        products.inventory_status(shop_orders, None)


def test_profit_and_price(shop_orders, shop_products):
    prof = {r["product_id"]: r["profit_margin"] for r in collect(products.profit_analysis(shop_orders, shop_products))}
    assert prof == {"tea": 75.0, "pot": 20.0, "cup": 40.0, "tray": None}
    sugg = dict(collect(products.price_suggestions(shop_orders, shop_products), "product_id", "price_suggestion"))
    assert sugg == {"tea": products.PRICE_EXCELLENT, "cup": products.PRICE_FINE, "tray": products.PRICE_NO_DATA,
                    "pot": products.PRICE_RAISE_PREFIX + "7" + products.PRICE_RAISE_SUFFIX}


@pytest.fixture(scope="module")
def camps(spark):
    """Mail earns 4 for 1 in two campaigns, radio 1.6 for 1, posters lose."""
    rows = [("m1", "mail", 200.0, 20, 700.0, 4000, 400), ("m2", "mail", 300.0, 30, 1300.0, 6000, 300),
            ("r1", "radio", 500.0, 16, 800.0, 20000, 200), ("p1", "posters", 1000.0, 5, 400.0, 50000, 100)]
    return spark.createDataFrame(rows, "campaign_id string, channel string, budget double, "
                                       "orders long, revenue double, impressions long, clicks long")


def test_roi_conversion_channel(camps):
    roi = collect(marketing.campaign_roi(camps), "campaign_id", "roi", "profit", "cost_per_order", "revenue_per_order")
    assert roi == [("m2", 333.33, 1000.0, 10.0, 43.33), ("m1", 250.0, 500.0, 10.0, 35.0), ("r1", 60.0, 300.0, 31.25, 50.0),
                   ("p1", -60.0, -600.0, 200.0, 80.0)]
    conv = {r["campaign_id"]: r for r in collect(marketing.conversion_metrics(camps))}
    assert (conv["m1"]["ctr"], conv["m1"]["cvr"], conv["m1"]["overall_conversion"], conv["m1"]["cpc"], conv["m1"]["cpa"]) == (10.0, 5.0, 0.5, 0.5, 10.0)
    ch = {r["channel"]: r for r in collect(marketing.channel_performance(camps))}
    assert (ch["mail"]["budget"], ch["mail"]["revenue"], ch["mail"]["roi"], ch["mail"]["ctr"]) == (500.0, 2000.0, 300.0, 7.0)


def test_funnel(camps):
    f = collect(marketing.conversion_funnel(camps))[0]
    assert (f["impressions"], f["clicks"], f["orders"]) == (80000, 1000, 71)
    assert (f["ctr"], f["cvr"], f["overall_conversion"]) == (1.25, 7.1, 0.0888)
    assert collect(marketing.conversion_funnel(camps, "r1"))[0]["ctr"] == 1.0
    assert marketing.conversion_funnel(camps, "none").count() == 0


def test_efficiency_and_budget(camps):
    eff = collect(marketing.campaign_efficiency(camps), "campaign_id", "efficiency_score")
    assert eff[0] == ("m2", 85.0) and [e[0] for e in eff] == ["m2", "m1", "r1", "p1"]
    b = {r["channel"]: (r["current_roi"], r["suggested_budget_percent"], r["suggested_budget_amount"], r["recommendation"])
         for r in collect(marketing.budget_allocation(camps))}
    assert b == {"mail": (300.0, 35.0, 700.0, marketing.BUDGET_UP), "radio": (60.0, 25.0, 500.0, marketing.BUDGET_KEEP),
                 "posters": (-60.0, 15.0, 300.0, marketing.BUDGET_DOWN)}


def test_nan_is_missing(spark, camps):
    from pyspark.sql import functions as F

    rows = [("N1", "tea", "drink", 1, 4.0, float("nan"), "2023-06-01", "K1"), ("N2", "tea", "drink", 2, 4.0, 1.0, "2023-06-01", "K1")]
    o = orders.prepare_orders(spark.createDataFrame(rows, LINES))
    assert collect(orders.overview_metrics(o), "total_revenue", "total_profit") == [(12.0, 6.0)]
    assert collect(products.sales_ranking(o), "revenue", "profit") == [(12.0, 6.0)]
    nan = camps.withColumn("revenue", F.when(F.col("campaign_id") == "m1", float("nan")).otherwise(F.col("revenue")))
    assert {r["channel"]: r["revenue"] for r in collect(marketing.channel_performance(nan))}["mail"] == 1300.0


def test_zero_denominators(spark):
    z = spark.createDataFrame([("X", "Online", 0.0, 0, 10.0, 0, 0)],
                              "campaign_id string, channel string, budget double, orders long, "
                              "revenue double, impressions long, clicks long")
    r = collect(marketing.campaign_roi(z))[0]
    assert r["roi"] is None and r["cost_per_order"] is None
    f = collect(marketing.conversion_funnel(z))[0]
    assert f["ctr"] == 0.0 and f["cvr"] == 0.0
    b = collect(marketing.budget_allocation(z))[0]
    assert b["suggested_budget_percent"] == 40.0 and b["current_roi"] is None
