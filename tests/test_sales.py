import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import C, REGIONS, collect, make_ledger
from kpiforge.functions.columns import ColumnMap
from kpiforge.operators import sales


def test_summary_basic(spring_ledger):
    s = sales.summary(spring_ledger).collect()[0]
    pdf = spring_ledger.toPandas()
    assert s.n_records == len(pdf) == s.total_orders
    assert s.total_revenue == pytest.approx(pdf[C["amount"]].sum())
    assert s.avg_order_value == pytest.approx(s.total_revenue / s.n_records)
    assert s.date_start == "2023-02-10" and s.date_end == "2023-05-20"
    by_cat = pdf.groupby(C["category"])[C["amount"]].sum()
    assert s.top_category == by_cat.idxmax()
    assert s.top_category_revenue == pytest.approx(by_cat.max())
    assert s.n_customers == pdf[C["customer"]].nunique()
    monthly = pdf.set_index(C["date"])[C["amount"]].resample("ME").sum()
    assert s.growth_first_to_last_month == pytest.approx(
        (monthly.iloc[-1] / monthly.iloc[0] - 1) * 100)


def test_summary_missing_columns(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),)], f"`{C['date']}` timestamp")
    with pytest.raises(ValueError):
        sales.summary(df)


def test_summary_empty_and_strict(spark):
    empty = make_ledger(spark, [])
    assert sales.summary(empty).count() == 0
    with pytest.raises(ValueError):
        sales.summary(empty, strict=True)


def test_summary_optional_columns_absent(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), 10.0), (dt.datetime(2024, 1, 2), 5.0)],
                               f"`{C['date']}` timestamp, `{C['amount']}` double")
    s = sales.summary(df).collect()[0]
    assert s.top_category is None and s.top_category_revenue == 0.0
    assert s.n_customers == 0 and s.growth_first_to_last_month is None


def test_summary_tie_takes_smallest_key(spark):
    rows = [(dt.datetime(2024, 1, 1), 10.0, 1, "b", "x", "c1"),
            (dt.datetime(2024, 1, 2), 10.0, 1, "a", "y", "c2")]
    s = sales.summary(make_ledger(spark, rows)).collect()[0]
    assert s.top_category == "a" and s.top_region == "x"


def test_trend_conserves_total(spring_ledger):
    t = sales.trend(spring_ledger, "M").collect()
    total = spring_ledger.agg(F.sum(C["amount"])).first()[0]
    assert sum(r.revenue for r in t) == pytest.approx(total)
    assert [r.period for r in t] == [dt.date(2023, 2, 28), dt.date(2023, 3, 31),
                                     dt.date(2023, 4, 30), dt.date(2023, 5, 31)]
    assert t[0].growth_pct is None
    assert t[1].growth_pct == pytest.approx((t[1].revenue / t[0].revenue - 1) * 100)


def test_trend_fills_gaps_and_week_labels(spark):
    rows = [(dt.datetime(2024, 1, 7, 23, 59), 10.0, 1, "a", "x", "c"),   # Sunday night
            (dt.datetime(2024, 1, 8, 0, 1), 5.0, 1, "a", "x", "c"),      # Monday
            (dt.datetime(2024, 1, 29), 7.0, 1, "a", "x", "c")]
    t = collect(sales.trend(make_ledger(spark, rows), "W"), "period", "revenue", "n_orders",
                "growth_pct")
    assert t == [(dt.date(2024, 1, 7), 10.0, 1, None), (dt.date(2024, 1, 14), 5.0, 1, -50.0),
                 (dt.date(2024, 1, 21), 0.0, 0, -100.0), (dt.date(2024, 1, 28), 0.0, 0, None),
                 (dt.date(2024, 2, 4), 7.0, 1, None)]


def test_trend_quarter_year_labels(spark):
    rows = [(dt.datetime(2023, 11, 5), 1.0, 1, "a", "x", "c"),
            (dt.datetime(2024, 5, 5), 2.0, 1, "a", "x", "c")]
    led = make_ledger(spark, rows)
    q = collect(sales.trend(led, "Q"), "period")
    assert q == [(dt.date(2023, 12, 31),), (dt.date(2024, 3, 31),), (dt.date(2024, 6, 30),)]
    y = collect(sales.trend(led, "Y"), "period", "revenue")
    assert y == [(dt.date(2023, 12, 31), 1.0), (dt.date(2024, 12, 31), 2.0)]


def test_trend_pct_change_rule(spark):
    rows = [(dt.datetime(2024, 1, 1), -10.0, 1, "a", "x", "c"),
            (dt.datetime(2024, 1, 2), 5.0, 1, "a", "x", "c")]
    led = make_ledger(spark, rows)
    assert collect(sales.trend(led, "D"), "growth_pct")[1] == (None,)
    assert collect(sales.trend(led, "D", growth_rule="pct_change"), "growth_pct")[1] == (-150.0,)


def test_trend_column_map(spark, spring_ledger):
    renamed = spring_ledger.select(F.col(C["date"]).alias("date"), F.col(C["amount"]).alias("amount"))
    a = collect(sales.trend(renamed, "M", {"date": "date", "amount": "amount"}))
    b = collect(sales.trend(spring_ledger, "M"))
    assert a == b


def test_anomalies_threshold_monotone(spring_ledger):
    n = [sales.anomalies(spring_ledger, "D", z).count() for z in (1.0, 1.5, 2.0, 2.5)]
    assert n == sorted(n, reverse=True) and n[0] > 0
    assert sales.anomalies(spring_ledger, "D", 3.5).count() == 0   # |z| <= 13/sqrt(14)


def test_anomalies_spike_and_short_series(spark):
    base = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=d), 100.0 + (d % 3), 1, "a", "x", "c")
            for d in range(20)]
    base[15] = (base[15][0], 1000.0, 1, "a", "x", "c")
    a = collect(sales.anomalies(make_ledger(spark, base), "D", 2.0), "period", "direction")
    assert (dt.date(2024, 1, 16), "spike") in a
    short = make_ledger(spark, [(dt.datetime(2024, 1, d), float(100 * d), 1, "a", "x", "c")
                                for d in (1, 2, 3)])
    assert sales.anomalies(short).count() == 0


def test_anomalies_grouped(spring_ledger):
    g = sales.anomalies(spring_ledger.withColumnRenamed(C["region"], "region"), "D", 1.5,
                        group_cols=["region"])
    assert set(r.region for r in g.collect()) <= set(REGIONS)


def test_breakdowns(spring_ledger, spark):
    cat = collect(sales.category_breakdown(spring_ledger), "category", "revenue")
    assert [r[1] for r in cat] == sorted((r[1] for r in cat), reverse=True)
    total = spring_ledger.agg(F.sum(C["amount"])).first()[0]
    assert sum(r[1] for r in cat) == pytest.approx(total)
    no_cat = spring_ledger.drop(C["category"])
    assert sales.category_breakdown(no_cat).count() == 0
    reg = sales.region_breakdown(spring_ledger)
    assert reg.count() == 3


def test_null_keys_dropped(spark):
    rows = [(dt.datetime(2024, 1, 1), 10.0, 1, None, None, None),
            (dt.datetime(2024, 1, 1), 5.0, 1, "a", "x", "c")]
    led = make_ledger(spark, rows)
    assert collect(sales.category_breakdown(led), "category") == [("a",)]
    s = sales.summary(led).collect()[0]
    assert s.n_records == 2 and s.n_customers == 1 and s.total_revenue == 15.0


def test_v1_stats(spring_ledger):
    rs = collect(sales.regional_stats(spring_ledger))
    assert sum(r["n_orders"] for r in rs) == spring_ledger.count()
    pt = collect(sales.product_totals(spring_ledger.withColumn(C["product"], F.col(C["category"]))))
    assert {r["level"] for r in pt} == {"category", "product"}
    st = sales.summary_statistics(spring_ledger).collect()[0]
    assert st.date_range == "2023-02-10 至 2023-05-20"
    h = sales.trend_headline(spring_ledger, "M").collect()[0]
    assert h.n_periods == 4 and h.max_revenue >= h.min_revenue


def test_nan_amount_is_missing(spark):
    rows = [(dt.datetime(2024, 1, 1), float("nan"), 1, "a", "x", "c1"),
            (dt.datetime(2024, 1, 1), 5.0, 1, "a", "x", "c2"),
            (dt.datetime(2024, 1, 2), 7.0, 1, "b", "x", "c2")]
    led = make_ledger(spark, rows)
    t = collect(sales.trend(led, "D"), "period", "revenue", "n_orders")
    assert t == [(dt.date(2024, 1, 1), 5.0, 1), (dt.date(2024, 1, 2), 7.0, 1)]
    s = sales.summary(led).collect()[0]
    assert s.total_revenue == 12.0 and s.n_records == 3


def test_trend_grouped_series_each_gap_filled(spark):
    rows = [(dt.datetime(2024, 1, 5), 1.0, 1, "a", "x", "c"),
            (dt.datetime(2024, 3, 5), 2.0, 1, "a", "x", "c"),
            (dt.datetime(2024, 2, 5), 3.0, 1, "a", "y", "c")]
    led = make_ledger(spark, rows).withColumnRenamed(C["region"], "region")
    t = sorted(collect(sales.trend(led, "M", group_cols=["region"]), "region", "period", "revenue"))
    assert t == [("x", dt.date(2024, 1, 31), 1.0), ("x", dt.date(2024, 2, 29), 0.0),
                 ("x", dt.date(2024, 3, 31), 2.0), ("y", dt.date(2024, 2, 29), 3.0)]


def test_summary_approx_customers(spring_ledger):
    exact = sales.summary(spring_ledger).collect()[0]
    approx = sales.summary(spring_ledger, approx_customers=True).collect()[0]
    assert abs(approx.n_customers - exact.n_customers) <= 0.15 * exact.n_customers  # 3 x rsd
    assert approx.total_revenue == exact.total_revenue


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_declared_scale_sums_exactly(spark, parts):
    day = dt.datetime(2024, 1, 1)
    df = spark.range(2_000_000).select(
        F.lit(day).alias("date"), (F.col("id") % 97 * 1234567.89 + 120_000_000.01).alias("amount")).repartition(parts)
    from decimal import Decimal

    want = sum(Decimal(2_000_000 // 97 + (i < 2_000_000 % 97)) * (i * Decimal("1234567.89") + Decimal("120000000.01")) for i in range(97))
    got = sales.trend(df, "M", ColumnMap.identity(scale=2)).first()
    assert want > 10**14 and got.revenue == float(want)
    assert sales.summary(df, ColumnMap.identity(scale=2)).first().total_revenue == float(want)


def test_undeclared_scale_rounds_nothing(spark):
    df = spark.range(100_000).select(F.lit(dt.datetime(2024, 1, 1)).alias("date"), F.lit(0.00004).alias("amount"))
    assert sales.trend(df, "M", ColumnMap.identity()).first().revenue == pytest.approx(4.0)
    small = df.select("date", F.col("amount").cast("decimal(10,5)").alias("amount"))
    assert sales.trend(small, "M", ColumnMap.identity()).first().revenue == 4.0


def test_nan_is_missing_in_grouped_series(spark):
    rows = [(dt.datetime(2024, 1, 1), v, 1, "a", "x", "c") for v in (float("nan"), 1.0)]
    led = make_ledger(spark, rows).withColumnRenamed(C["region"], "region")
    t = collect(sales.trend(led, "M", group_cols=["region"]), "revenue", "n_orders")
    assert t == [(1.0, 1)] == collect(sales.trend(led, "M"), "revenue", "n_orders")
    with pytest.raises(ValueError):
        sales.trend(led, "M", group_cols=["nowhere"])


@pytest.mark.parametrize("freq", ["D", "W", "M", "Q", "Y"])
def test_period_numbers(spark, freq):
    from kpiforge.functions import periods

    days = spark.range(0, 4_000_000, 977).selectExpr("date_add(date'0001-01-01', int(id)) AS d").where("d < date'9999-12-25'")
    start = days.select(periods.period_start(F.col("d"), freq).alias("s")).distinct()
    number = periods.period_number(F.col("s"), freq)
    after = periods.period_number(periods.offset_start(F.col("s"), freq, 1), freq)
    back = periods.start_of_number(number, freq)
    assert start.count() > 100 and start.where((after != number + 1) | (back != F.col("s"))).count() == 0


def gappy(spark, seed):
    """Days with sales in clusters, days without them alone and in long stretches."""
    rnd, rows, day = random.Random(seed), [], dt.datetime(2020, 1, 1)
    for _ in range(40):
        day += dt.timedelta(days=rnd.choice([1, 1, 1, 2, 5, 12, 13, 14, 26, 27, 28, 60, 200]))
        for _ in range(rnd.randint(1, 25)):
            rows += [(day, rnd.choice([0.0, 10.0, 12.5, 90.0, -4.0]), 1, "a", rnd.choice(["x", "y"]), "c") for _ in range(rnd.randint(0, 2))]
            day += dt.timedelta(days=1)
    return make_ledger(spark, rows), rows


@pytest.mark.parametrize("block", [16, 50, 4096])
def test_alerts_over_gaps_in_blocks(spark, monkeypatch, block):
    import pandas as pd

    monkeypatch.setattr(sales, "BLOCK", block)
    led, rows = gappy(spark, block)
    for window, group in ((14, None), (5, None), (1, None), (14, "region")):
        keys = ["x", "y"] if group else [None]
        got = collect(sales.anomalies(led, "D", 1.0, window=window, group_cols=[C["region"]] if group else []), *([C["region"]] if group else []), "period", "actual",
                      "expected", "z_score", "direction")
        want = []
        for key in keys:
            one = pd.DataFrame([r for r in rows if key is None or r[4] == key])
            y = one.set_index(0)[1].resample("D").sum()
            frames = [y.iloc[max(0, i - window + 1) : i + 1] for i in range(len(y))]
            for d, v, f in zip(y.index, y, frames):
                if len(f) >= 3 and f.std() >= 1e-9 and abs((v - f.mean()) / f.std()) >= 1.0:
                    z = (v - f.mean()) / f.std()
                    want.append((*([key] if key else []), d.date(), v, pytest.approx(f.mean()), pytest.approx(z), "spike" if z > 0 else "drop"))
        assert sorted(got, key=lambda r: r[: 1 + bool(group)]) == sorted(want, key=lambda r: r[: 1 + bool(group)])
        assert len(want) > 20 or window < 3


def test_no_task_scores_a_whole_series(spark):
    led, _ = gappy(spark, 1)
    plan = sales.anomalies(led)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line or "Window(" in line]
    assert windows and all("_block" in line for line in windows)


def test_one_date_far_away(spark):
    rows = [(dt.datetime(2023, 1, 1) + dt.timedelta(days=i), float(50 + i % 9), 1, "a", "x", "c") for i in range(60)] + [
        (dt.datetime(9999, 12, 31), 5.0, 1, "a", "x", "c")]
    led = make_ledger(spark, rows)
    n = (dt.date(9999, 12, 31) - dt.date(2023, 1, 1)).days + 1
    head = collect(sales.trend_headline(led, "D"))[0]
    assert (head["n_periods"], head["max_revenue"], head["min_revenue"], head["growth_pct"]) == (n, 58.0, 0.0, -90.0)
    from kpiforge.operators import forecast as fc

    early = led.withColumn(C["date"], F.col(C["date"]) - F.expr("interval 1 year"))  # leaves room for the forecast
    n = (dt.date(9998, 12, 31) - dt.date(2022, 1, 1)).days + 1
    for df, value in ((fc.moving_average(early, 2), 5 / 7), (fc.ses(early, 2), 1.5), (fc.linear_trend(early, 2, clip=False), None),
                      (fc.holt(early, 2, beta=0.5), None), (fc.compare(early, 2).withColumn("history_periods", F.lit(n)), None)):
        got = collect(df, "history_periods", "value")
        assert len(got) >= 2 and all(r[0] == n for r in got)
        assert value is None or [r[1] for r in got] == [pytest.approx(value)] * 2
    # Holt after a long stretch of zeros: level and trend have died out, the last day alone counts
    level, trend = 0.3 * 5.0, 0.5 * 0.3 * 5.0
    assert collect(fc.holt(early, 2, beta=0.5), "value") == [(pytest.approx(level + h * trend),) for h in (1, 2)]
    alerts = collect(sales.anomalies(led), "period", "actual")
    assert alerts[-1] == (dt.date(9999, 12, 31), 5.0)
