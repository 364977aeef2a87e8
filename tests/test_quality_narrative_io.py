import datetime as dt
import json
import os

import pytest

from conftest import collect
from kpiforge.functions.stats import quantiles, quantiles_of
from kpiforge.operators import narrative, quality, sales
from kpiforge.sources import readers, synthetic, writers


KILN = "clay double, glaze double, shelf string"


def kiln(spark):
    """Nine firings; clay lacks two values, glaze one (and has a NaN), shelf one."""
    rows = [(12.5, 0.75, "top"), (None, 1.25, "low"), (9.0, float("nan"), "low"), (14.0, 2.0, None), (None, 0.5, "top"),
            (11.0, 3.5, "mid"), (10.0, 1.0, "low"), (30.5, None, "top"), (8.0, 6.0, "mid")]
    return spark.createDataFrame(rows, KILN)


def test_drop_and_fill(spark):
    assert [r["clay"] for r in collect(quality.drop_missing(kiln(spark)))] == [12.5, 11.0, 10.0, 8.0]
    filled = collect(quality.fill_missing(kiln(spark)))
    assert [r["clay"] for r in filled] == [12.5, 11.0, 9.0, 14.0, 11.0, 11.0, 10.0, 30.5, 8.0]
    assert [r["glaze"] for r in filled] == [0.75, 1.25, 1.25, 2.0, 0.5, 3.5, 1.0, 1.25, 6.0]
    assert filled[3]["shelf"] == "low"  # three times each: the smaller of low and top


def test_modes_of_several_types(spark):
    days = [dt.date(2021, 5, d) for d in (9, 3, 9, 3, 7)]
    df = spark.createDataFrame([(d, d.day > 5, None, bytes([d.day])) for d in days] + [(None, None, None, None)],
                               "d date, b boolean, s string, y binary")
    assert quality.most_frequent(df, ["d", "b", "s", "y"]) == {"d": dt.date(2021, 5, 3), "b": True, "y": b"\x03"}
    assert quality.most_frequent(df, []) == {}


def test_duplicates_go_once(spark, monkeypatch):
    rows = [(i % 40, None if i % 3 else "x", -0.0 if i % 80 == 0 else float(i % 40 // 4)) for i in range(200)] + [(1, "y", None)] * 3 + [(None, "y", 1.0)]
    df = spark.createDataFrame(rows, "a long, `b.c` string, d double").repartition(6)
    want = sorted(set(rows), key=repr)
    for hashes in (quality.HASHES, 0):
        monkeypatch.setattr(quality, "HASHES", hashes)
        got = quality.drop_duplicates(df)
        assert got.columns == df.columns and sorted({tuple(r) for r in got.collect()}, key=repr) == sorted({tuple(r) for r in want}, key=repr)
        assert got.count() == len(want)
    alone = spark.range(50).selectExpr("id", "cast(null as string) AS s")
    assert quality.drop_duplicates(alone).count() == 50 and quality.drop_duplicates(alone.limit(0)).count() == 0


def test_equal_hashes_lose_no_row(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(F, "xxhash64", lambda *cols: F.pmod(F.length(F.col("s")), F.lit(2)).cast("bigint"))
    df = spark.createDataFrame([("a" * (i % 7),) for i in range(30)], "s string")
    assert sorted(r.s for r in quality.drop_duplicates(df).collect()) == ["a" * i for i in range(7)]


def test_outliers_go(spark):
    # quarters 21.5 and 24.5: what is kept lies in [17, 29]
    df = spark.createDataFrame([(float(x),) for x in (20, 21, 22, 23, 24, 25, -400)], "wind double")
    assert quantiles(df, "wind", [0.25, 0.75]) == [20.5, 23.5]
    assert sorted(r.wind for r in quality.iqr_filter(df).collect()) == [20.0, 21.0, 22.0, 23.0, 24.0, 25.0]
    flat = spark.createDataFrame([(3.0, float(i)) for i in range(6)], "still double, rising double")
    assert quality.zscore_filter(flat).count() == 0
    many = spark.createDataFrame([(float(i % 10),) for i in range(60)] + [(500.0,)], "wind double")
    assert quality.zscore_filter(many).count() == 60


def test_clean_writes_once_and_releases(spark):
    from kpiforge.functions.cut import Cut

    df = spark.createDataFrame([(float(i % 25), "s") for i in range(100)] + [(9000.0, "s"), (None, "s")], "x double, s string")
    with Cut(spark, "test") as cut:
        out = quality.clean(df, "fill", True, "iqr", cut=cut)
        assert sorted(r.x for r in out.collect()) == [float(i) for i in range(25)]
        assert all(cut.path.split(":")[-1] in f for f in out.inputFiles())
    assert not os.path.exists(cut.path.split(":")[-1])
    assert quality.clean(df, "drop", True, "zscore").count() == 25


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quantiles_match_numpy(spark, seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    vals = [rng.integers(0, 50, 3000), np.concatenate([np.full(4000, 7.0), rng.normal(0, 10, 8000).round(3)]),
            np.concatenate([rng.normal(0, 1e-9, 500), rng.normal(0, 1e12, 500), [1.7e308, -1.7e308, 5e-324]])][seed - 1]
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,), (float("nan"),)], "x double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.77, 0.9, 1.0]
    assert quantiles(df, "x", probs) == pytest.approx(list(np.quantile(vals.astype(float), probs)))
    assert quantiles(df.where("x is null"), "x", probs) == [None] * 7


def test_doubles_as_ordered_integers(spark):
    import numpy as np

    from kpiforge.functions.stats import ordered_bits

    rng = np.random.default_rng(8)
    powers = 2.0 ** np.arange(-1074, 1024)
    vals = np.concatenate([rng.integers(-(2**63), 2**63 - 1, 3000).view(np.float64), powers, -powers, np.nextafter(powers, 0),
                           np.nextafter(powers, np.inf), [0.0, -0.0, np.inf, -np.inf, np.finfo(float).max]])
    vals = vals[~np.isnan(vals)]
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    bits = np.abs(vals).view(np.int64)
    assert [r[0] for r in df.select(ordered_bits(df["x"])).collect()] == np.where(vals < 0, -bits, bits).tolist()


def test_quantiles_with_infinite_values(spark):
    import numpy as np

    inf, rng = float("inf"), np.random.default_rng(5)
    plain = rng.normal(100, 30, 7000)
    columns = {"up": np.append(plain, [inf] * 3), "down": np.append(plain, [-inf] * 3), "both": np.append(plain[:-1], [inf, -inf, inf, -inf]),
               "most": np.append(plain[:2003], [inf] * 5000)}
    df = spark.createDataFrame(list(zip(*[c.tolist() for c in columns.values()], strict=True)), ", ".join(f"{c} double" for c in columns))
    probs = [0.25, 0.5, 0.75]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("quantiles", "")
    try:
        got = quantiles_of(df, {c: probs for c in columns})
        assert len(tracker.getJobIdsForGroup("quantiles")) <= 12  # six rounds, a shuffle in each
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for c, x in columns.items():
        want = [np.sort(x)[int(p * (len(x) - 1))] if c == "most" and p > 0.3 else np.quantile(np.where(np.isinf(x), np.sign(x) * 1e9, x), p) for p in probs]
        assert got[c] == pytest.approx(want)
    import pandas as pd

    holes = df.select("up", "both").unionByName(spark.createDataFrame([(None, None)] * 4, "up double, both double"))
    filled = quality.fill_missing(holes).exceptAll(df.select("up", "both")).collect()
    assert [tuple(r) for r in filled] == [tuple(pytest.approx(pd.Series(columns[c]).median()) for c in ("up", "both"))] * 4
    assert quality.iqr_filter(df.select("up", "down", "both")).where("abs(up) = double('inf') or abs(down) = double('inf')").count() == 0


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (None, "a"), (3, "b")], "a long, b string")
    p = collect(quality.profile(df), "column", "dtype", "n_missing", "n_rows")
    assert p == [("a", "bigint", 1, 3), ("b", "string", 1, 3)]


SUMMARY = ("n_records long, date_start string, date_end string, total_revenue double, "
           "total_orders long, avg_order_value double, top_category string, "
           "top_category_revenue double, top_region string, top_region_revenue double, "
           "n_customers long, growth_first_to_last_month double")
ALERTS = "period date, actual double, expected double, z_score double, direction string"


def _summary(spark, growth):
    """A toy shop's half year."""
    return spark.createDataFrame([(736, "2022-07-04", "2022-12-30", 48576.0, 736, 66.0, "积木", 20240.0, "海岛", 17600.0, 412, growth)], SUMMARY)


def test_commentary_rules(spark):
    alerts = spark.createDataFrame([(dt.date(2022, 9, 8), 120.0, 270.0, -2.75, "drop"),
                                    (dt.date(2022, 12, 21), 990.0, 310.0, 4.125, "spike")], ALERTS)
    rep = collect(narrative.commentary_report(_summary(spark, 18.5), alerts))[0]
    assert rep["overview"] == ("2022-07-04 至 2022-12-30 期间，共 736 笔订单、412 名客户，总收入 "
                               "CNY48,576，平均客单 CNY66，环比首月增长 +18.5%。")
    assert rep["highlights"][-1] == "末月较首月增长 +18.5%，业务在扩张"
    assert rep["risks"][0] == "2022-09-08 出现异常下跌（实际 CNY120，预期 CNY270，z=-2.75）"
    assert rep["recommendations"][-1] == "复盘 2022-12-21 异常增长动因，看能否复制"
    empty_alerts = spark.createDataFrame([], ALERTS)
    rep2 = collect(narrative.commentary_report(_summary(spark, -31.5), empty_alerts))[0]
    assert "末月较首月下降 -31.5%，需排查原因" in rep2["risks"]
    rep3 = collect(narrative.commentary_report(_summary(spark, None), empty_alerts))[0]
    assert "环比" not in rep3["overview"]
    md = collect(narrative.markdown(narrative.commentary_report(_summary(spark, None), empty_alerts)))[0]
    assert md["markdown"].startswith("## 整体概览\n\n") and "## 风险" not in md["markdown"]


def test_parse_responses(spark):
    empty_alerts = spark.createDataFrame([], ALERTS)
    fb = narrative.commentary_report(_summary(spark, 20.0), empty_alerts)
    good = json.dumps({"overview": "ok", "highlights": ["a", "", None], "risks": [],
                       "recommendations": ["r"]}, ensure_ascii=False)
    resp = spark.createDataFrame([("1", good), ("2", "not json"), ("3", "```json\n" + good + "\n```")],
                                 "id string, text string")
    out = {r["id"]: r for r in collect(narrative.parse_response(resp, "text", fb))}
    assert out["1"]["backend"] == "llm:llm" and out["1"]["highlights"] == ["a"]
    assert out["2"]["backend"] == "heuristic" and out["2"]["overview"].startswith("2022-07-04")
    assert out["3"]["overview"] == "ok"


def test_readers_and_writers(spark, tmp_path):
    p = tmp_path / "orders.csv"
    p.write_text("order_id,customer_id,customer_name,product_id,product_name,category,quantity,"
                 "unit_price,cost_price,order_date,region,city,payment_method,status\n"
                 "O1,C1,n,P1,p,Cat,2,10.0,4.0,2024-01-05,r,c,card,Completed\n"
                 "O2,C2,n,P2,p,Cat,1,5.0,1.0,bad,r,c,card,Completed\n")
    o = readers.load_orders(spark, str(p))
    rows = collect(o, "revenue", "profit", "order_date")
    assert rows[0][:2] == (20.0, 12.0) and rows[1][2] is None
    out = tmp_path / "out"
    writers.emit(o, str(out), "json")
    lines = [json.loads(x) for f in os.listdir(out) if f.endswith(".json")
             for x in (out / f).read_text().splitlines()]
    assert sorted((x["order_id"], x["order_date"]) for x in lines) == [("O1", "2024-01-05"), ("O2", None)]  # nulls keep their key


def test_columns_are_bound_by_name(spark, tmp_path):
    p = tmp_path / "orders.csv"
    p.write_text("quantity,order_id,note,unit_price,customer_id\n2,O1,hi,5.0,C1\nx,O2,,3.0,C2\n")
    o = readers.load_orders(spark, str(p))
    assert collect(o, "order_id", "customer_id", "quantity", "unit_price", "note", "revenue", "profit") == [
        ("O1", "C1", 2, 5.0, "hi", 10.0, 10.0), ("O2", "C2", None, 3.0, None, None, None)]
    assert "cost_price" not in o.columns and "cost" not in o.columns
    c = tmp_path / "campaigns.csv"
    c.write_text("impressions,campaign_id,budget,start_date\n100,A,7.5,2024-02-30\n")
    assert collect(readers.load_campaigns(spark, str(c)), "campaign_id", "budget", "impressions", "start_date") == [("A", 7.5, 100, None)]
    o.select("order_id", "quantity", "unit_price").write.parquet(str(tmp_path / "plain_folder"))
    assert readers.load_orders(spark, str(tmp_path / "plain_folder"), fmt="parquet").count() == 2


def test_nan_is_missing_in_quality(spark):
    nan = float("nan")
    df = spark.createDataFrame([(float(i), i % 2 * 1.0) for i in range(50)] + [(nan, 1.0)], "a double, b double")
    assert collect(quality.profile(df), "column", "n_missing") == [("a", 1), ("b", 0)]
    assert quality.zscore_filter(df).count() == 50 and quality.iqr_filter(df).count() == 50
    assert collect(quality.fill_missing(df))[-1] == {"a": 24.5, "b": 1.0}
    assert quality.drop_missing(df).count() == 50
    before, seen = quality.count_rows(df, "before")
    quality.drop_missing(before).collect()
    assert seen.get["rows"] == 51


def test_parse_rules(spark):
    fb = narrative.commentary_report(_summary(spark, 20.0), spark.createDataFrame([], ALERTS))
    good = '{"overview": "ok", "highlights": [0, 7, "0", false, true, null, "", 1.5], "risks": null}'
    texts = {"good": good, "trailing": good + " thanks", "two": good + "," + good, "quotes": good.replace('"', "'"), "bare": '{"risks": ["r"]}',
             "list": "[" + good + "]", "broken": good[:-1], "empty": "", "null": None}
    resp = spark.createDataFrame(list(texts.items()), "id string, text string")
    out = {r["id"]: r for r in collect(narrative.parse_response(resp, "text", fb, backend="x"))}
    assert out["good"]["highlights"] == ["7", "0", "True", "1.5"] and out["good"]["backend"] == "llm:x" and out["good"]["risks"] == []
    assert (out["bare"]["overview"], out["bare"]["risks"], out["bare"]["backend"]) == ("", ["r"], "llm:x")
    assert {k for k, r in out.items() if r["backend"] == "heuristic"} == {"trailing", "two", "quotes", "list", "broken", "empty", "null"}
    none = {r["id"]: r for r in collect(narrative.parse_response(resp, "text", fb.limit(0)))}
    assert len(none) == len(texts) and none["good"]["overview"] == "ok" and none["broken"]["overview"] is None


def test_payload_shape(spark):
    days = [dt.date(2024, 1, d) for d in range(1, 9)]
    trend = spark.createDataFrame([(d, float(i), i, None) for i, d in enumerate(days)], "period date, revenue double, n_orders long, growth_pct double")
    alerts = spark.createDataFrame([(d, 1.0, 2.0, -2.5, "drop") for d in days], ALERTS)
    kinds = spark.createDataFrame([(f"k{i}", float(i)) for i in range(7)], "category string, revenue double")
    p = json.loads(narrative.payload(_summary(spark, None), trend, alerts, kinds, kinds.withColumnRenamed("category", "region")).first()[0])
    assert list(p["category_breakdown_top5"].items()) == [(f"k{i}", float(i)) for i in (6, 5, 4, 3, 2)]
    assert [x["period"] for x in p["trend_last_6"]] == [str(d) for d in days[2:]] and p["trend_last_6"][0]["growth_pct"] is None
    assert len(p["anomalies_top_3"]) == 3 and p["summary"]["growth_first_to_last_month"] is None


def test_synthetic_and_report_bundle(spark, tmp_path):
    s = synthetic.sample_sales(spark, 200)
    assert s.count() == 200 and len(s.columns) == 12
    assert collect(s) == collect(synthetic.sample_sales(spark, 200))
    totals = collect(writers.report_totals(s))
    assert {t["sheet"] for t in totals} == {"category", "region"}
    writers.export_report(s, str(tmp_path / "rep"))
    assert sorted(os.listdir(tmp_path / "rep")) == ["raw", "totals"]
    assert {"sheet=category", "sheet=region"} <= set(os.listdir(tmp_path / "rep" / "totals"))
    head = writers.head_sample(s, 3, [s.columns[0]])
    assert head.count() == 3
    summary = sales.summary(s).collect()[0]
    assert summary.n_records == 200


def test_entry_contract(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60


def test_fill_all_null_non_text_column(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, d date")
    out = collect(quality.fill_missing(df))
    assert out == [{"a": 1.0, "d": "Unknown"}, {"a": 1.0, "d": "Unknown"}]


def test_strip_fences_whitespace(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("\n\t```json\n{\"a\": 1}\n```\n ",), ("  plain \n",)], "t string")
    out = [r[0] for r in df.select(narrative.strip_fences(F.col("t"))).collect()]
    assert out == ['{"a": 1}', "plain"]


def test_rejects_name_what_does_not_fit(spark, tmp_path):
    p = tmp_path / "orders.csv"
    p.write_text("quantity,order_id,unit_price,order_date,note\n2,A1,3.5,2022-02-28,\nseven,A2,4.0,2022-02-30,x\n,A3,1e3,,\"a, b\"\n"
                 "1,A4,2.0\n5,A6,1.0,2022-01-01,n,extra\n6,A7,1;5,,\n")
    found = collect(readers.rejects(spark, str(p), *readers.TABLES["orders"]), "file", "column", "value", "reason")
    assert sorted(found, key=repr) == sorted([
        ("orders.csv", "quantity", "seven", "not a bigint"), ("orders.csv", "order_date", "2022-02-30", "not a date"),
        ("orders.csv", None, "1,A4,2.0", "not as many fields as the header"), ("orders.csv", None, "5,A6,1.0,2022-01-01,n,extra", "not as many fields as the header"),
        ("orders.csv", "unit_price", "1;5", "not a double")], key=repr)
    lines = {json.loads(r.line)["order_id"] for r in readers.rejects(spark, str(p), *readers.TABLES["orders"]).collect()}
    assert lines == {"A2", "A4", "A6", "A7"}
    assert readers.load_orders(spark, str(p)).count() == 6
    clean = tmp_path / "clean.csv"
    clean.write_text("campaign_id,budget\nK1,2.5\n")
    assert readers.rejects(spark, str(clean), *readers.TABLES["campaigns"]).count() == 0


def test_runs_replace_their_own_periods(spark, tmp_path):
    from conftest import C

    with pytest.raises(ValueError):
        writers.emit(spark.range(1), str(tmp_path / "x"), mode="replace")
    rows = [(dt.datetime(2022, m, d), 10.0 * m + d, "kite" if d % 2 else "drum", "hill") for m in (1, 2, 3) for d in (4, 9)] + [(None, 1.0, "kite", "hill")]
    led = spark.createDataFrame(rows, f"`{C['date']}` timestamp, `{C['amount']}` double, `{C['category']}` string, `{C['region']}` string")
    path = str(tmp_path / "rep")
    writers.export_report(led, path, period="M")
    march = led.where(f"month(`{C['date']}`) = 3").withColumn(C["amount"], led[C["amount"]] * 10)
    for _ in range(2):
        writers.export_report(march, path, period="M")
    got = {(str(r.period), r.sheet, r.key): r.revenue for r in spark.read.parquet(f"{path}/totals").collect()}
    assert got == {("2022-01-31", "category", "drum"): 14.0, ("2022-01-31", "category", "kite"): 19.0, ("2022-01-31", "region", "hill"): 33.0,
                   ("2022-02-28", "category", "drum"): 24.0, ("2022-02-28", "category", "kite"): 29.0, ("2022-02-28", "region", "hill"): 53.0,
                   ("2022-03-31", "category", "drum"): 340.0, ("2022-03-31", "category", "kite"): 390.0, ("2022-03-31", "region", "hill"): 730.0}
    assert spark.read.parquet(f"{path}/raw").count() == 6
