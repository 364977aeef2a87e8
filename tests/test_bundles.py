from conftest import C, collect
from kpiforge.plans import bundles


def test_bundles_run(spark, spring_ledger):
    for frames in (bundles.breakdown(spring_ledger), bundles.segments_bundle(spring_ledger),
                   bundles.commentary(spring_ledger)):
        for name, df in frames.items():
            df.collect()
    assert bundles.summary(spring_ledger).count() == 1
    assert bundles.trend(spring_ledger, "W").count() > 0
    assert bundles.forecast_bundle(spring_ledger, "ma").count() == 7
    orders = spark.createDataFrame(
        [("O1", "C1", "P1", "Cat", 2, 10.0, 4.0), ("O2", "C1", "P2", "Cat", 1, 5.0, 1.0)],
        "order_id string, customer_id string, product_id string, category string, "
        "quantity long, unit_price double, cost_price double")
    catalogue = spark.createDataFrame([("P1", "a", "Cat", 1, 5)], "product_id string, "
                                      "product_name string, category string, stock_quantity long, "
                                      "reorder_level long")
    p = bundles.products_bundle(orders, catalogue)
    assert set(p) == {"category_performance", "sales_ranking", "low_stock", "restock"}
    assert p["low_stock"].count() == 1
    assert bundles.overview(orders).first()["n_orders"] == 2
    assert bundles.retention(orders).first()["repeat_customers"] == 1
    camps = spark.createDataFrame([("A", "Online", 10.0, 1, 30.0, 100, 10)],
                                  "campaign_id string, channel string, budget double, orders long, "
                                  "revenue double, impressions long, clicks long")
    assert bundles.marketing_bundle(camps)["budget_allocation"].count() == 1


def test_bucketed_facts_are_not_shuffled_again(spark, tilted_ledger):
    from kpiforge.functions.columns import ColumnMap
    from kpiforge.functions.cut import Cut
    from kpiforge.operators import products, segments
    from kpiforge.sources import layout

    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    with Cut(spark, "layout") as cut:
        led = layout.bucketed(tilted_ledger, C["customer"], 4, cut=cut)
        assert led.count() == tilted_ledger.count() and sorted(led.columns) == sorted(tilted_ledger.columns)
        plain, laid = segments.rfm_table(tilted_ledger, ColumnMap(scale=2)), segments.rfm_table(led, ColumnMap(scale=2))
        assert exchanges(plain) and not exchanges(laid)
        assert sorted(map(str, collect(laid))) == sorted(map(str, collect(plain)))
        lines = spark.range(500).selectExpr("concat('n', id % 13) AS product_id", "1L AS quantity", "cast(id AS double) AS revenue", "0.5 AS cost", "1.5 AS profit")
        lines_laid = layout.bucketed(lines, "product_id", 4, cut=cut)
        catalogue = spark.range(13).selectExpr("concat('n', id) AS product_id", "concat('p', id) AS product_name", "'k' AS category")
        plain, laid = (products.profit_analysis(x, catalogue) for x in (lines, lines_laid))
        assert exchanges(plain) and not exchanges(laid)
        assert sorted(map(str, collect(laid))) == sorted(map(str, collect(plain)))
