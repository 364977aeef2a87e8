import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import C, collect, make_ledger
from kpiforge.operators import ranking, segments
from kpiforge.functions.cut import Cut
from kpiforge.functions.joins import attach_one_row
from kpiforge.operators.ranking import global_rank, quintile, quintile_cuts


def test_abc_monotone_to_100(tilted_ledger):
    rows = collect(segments.abc_analysis(tilted_ledger).orderBy("cum_pct", F.desc("revenue")))
    cum = [r["cum_pct"] for r in rows]
    assert cum == sorted(cum) and cum[-1] == 100.0
    assert rows[0]["item"] == "kind0"
    assert all(r["abc_class"] in "ABC" for r in rows)


def test_abc_dominant_first_item_is_not_a(spark):
    rows = [(dt.datetime(2024, 1, 1), 95.0, 1, "big", "x", "c"),
            (dt.datetime(2024, 1, 1), 5.0, 1, "small", "x", "c")]
    out = collect(segments.abc_analysis(make_ledger(spark, rows)).orderBy("cum_pct"), "item",
                  "cum_pct", "abc_class")
    assert out == [("big", 95.0, "C"), ("small", 100.0, "C")]


def test_abc_empty_cases(spark, tilted_ledger):
    assert segments.abc_analysis(tilted_ledger.drop(C["category"])).count() == 0
    neg = make_ledger(spark, [(dt.datetime(2024, 1, 1), -5.0, 1, "a", "x", "c")])
    assert segments.abc_analysis(neg).count() == 0
    assert segments.abc_summary(neg).count() == 0


def test_abc_summary_three_rows(tilted_ledger):
    s = collect(segments.abc_summary(tilted_ledger))
    assert [r["abc_class"] for r in s] == ["A", "B", "C"]
    assert sum(r["n_items"] for r in s) == 6
    assert sum(r["item_pct"] for r in s) == pytest.approx(100.0, abs=0.02)  # rounded shares


def test_rfm_scores_and_counts(tilted_ledger):
    r = collect(segments.rfm_segments(tilted_ledger, with_scores=True))
    n_cust = tilted_ledger.select(C["customer"]).distinct().count()
    assert len(r) == n_cust
    assert all(3 <= x["rfm_score"] <= 15 for x in r)
    assert all(x["rfm_score"] == x["R_score"] + x["F_score"] + x["M_score"] for x in r)
    counts = collect(segments.segment_counts(tilted_ledger))
    assert sum(c["n_customers"] for c in counts) == n_cust


def test_rfm_quintiles_are_qcut_not_ntile(spark):
    # 7 customers with distinct M: qcut bins 1,1,2,3,4,5,5 (ntile would give 1,1,2,2,3,4,5)
    rows = [(dt.datetime(2024, 1, 1), float(10 * (i + 1)), 1, "a", "x", f"c{i}") for i in range(7)]
    r = collect(segments.rfm_segments(make_ledger(spark, rows), with_scores=True),
                "customer", "M_score", "R_score", "F_score")
    r.sort()
    assert [x[1] for x in r] == [1, 1, 2, 3, 4, 5, 5]
    # equal R and F: first-come ranks by customer key; R reversed
    assert [x[2] for x in r] == [5, 5, 4, 3, 2, 1, 1]
    assert [x[3] for x in r] == [1, 1, 2, 3, 4, 5, 5]


def test_rfm_single_customer(spark):
    rows = [(dt.datetime(2024, 1, 1), 10.0, 1, "a", "x", "only")]
    r = collect(segments.rfm_segments(make_ledger(spark, rows), with_scores=True))
    assert (r[0]["R_score"], r[0]["F_score"], r[0]["M_score"]) == (5, 1, 1)


def test_rfm_recency_floor_days(spark):
    rows = [(dt.datetime(2024, 1, 10, 12), 1.0, 1, "a", "x", "c1"),
            (dt.datetime(2024, 1, 8, 13), 1.0, 1, "a", "x", "c2")]
    r = dict(collect(segments.rfm_segments(make_ledger(spark, rows)), "customer", "R"))
    assert r == {"c1": 0, "c2": 1}   # 1 day 23 h -> 1


def test_rfm_missing_columns(spark, tilted_ledger):
    with pytest.raises(ValueError):
        segments.rfm_segments(tilted_ledger.drop(C["customer"]))


@pytest.mark.parametrize("keys", ["text", "long", "date"])
def test_rank_and_running_sum(spark, keys):
    rnd = random.Random(3)
    make = {"text": lambda i: f"customer {i * 7919 % 3000:05d}", "long": lambda i: i * 7919 % 3000 - 1500,
            "date": lambda i: dt.date(1990, 1, 1) + dt.timedelta(days=i * 7919 % 3000)}[keys]
    rows = [(rnd.choice([0.0, 0.0, 0.0, 2.5, -3.0, 1e300, 1e-300, float(i), -float(i)]), make(i), i % 10) for i in range(3000)]
    kind = {"text": "string", "long": "long", "date": "date"}[keys]
    df = spark.createDataFrame(rows, f"v double, k {kind}, amt long").select("v", "k", F.col("amt").cast("decimal(20,0)").alias("amt"))
    for up in (True, False):
        got = sorted(collect(global_rank(df, [("v", up), ("k", True)], sum_col="amt"), "_rank", "k", "_cum"))
        total, want = 0, []
        for i, (v, k, a) in enumerate(sorted(rows, key=lambda r: (r[0] if up else -r[0], r[1]))):
            total += a
            want.append((i + 1, k, total))
        assert got == want


def test_quintiles_with_a_hot_value(spark):
    rnd = random.Random(4)
    rows = [(f"c{rnd.randrange(10**6):06d}x{i}", rnd.choice([1, 1, 1, 2, 7]), rnd.choice([5.0, 5.0, float(rnd.randint(1, 900))])) for i in range(2003)]
    df = spark.createDataFrame(rows, "k string, a long, b double")
    cuts = quintile_cuts(df, ["a", "b"], "k")
    for i, c in enumerate("ab"):
        q = quintile(F.col(c), F.col("k"), F.col(f"cuts_{c}"), F.col("n"))
        got = dict(collect(attach_one_row(df, cuts).select("k", q.alias("q")), "k", "q"))
        order = sorted(rows, key=lambda r: (r[i + 1], r[0]))
        assert [got[r[0]] for r in order] == [max(1, -(-5 * j // (len(rows) - 1))) for j in range(len(rows))]


@pytest.mark.parametrize("key", ["id", "if(id = 77, 1000000000000000, id)", "if(id = 77, 'guest', format_string('C%08d', id))", "if(id = 77, '', format_string('C%08d', id))"])
def test_a_hot_value_is_divided_whatever_its_keys(spark, key, monkeypatch):
    monkeypatch.setattr(ranking, "PARTS", 8)
    monkeypatch.setattr(ranking, "SAMPLE", 1024)
    df = spark.range(20_000).selectExpr("if(id % 3 = 0, 7.0, id) AS v", f"{key} AS k").repartition(5)
    rows = df.withColumn("_own", F.struct("v", "k"))
    sample = ranking._sampled(rows, "k").agg(F.array_sort(F.collect_list("_own")).alias("_sample"))
    size = collect(sample.select(F.size("_sample").alias("n")))[0]["n"]
    assert 900 < size < 1150
    counts = [r["count"] for r in collect(ranking._in_ranges(rows, sample).groupBy("_range").count())]
    assert len(counts) == 64 and sum(counts) == 20_000 and max(counts) < 3 * 20_000 / 64
    ranked = collect(global_rank(df, [("v", True), ("k", True)]), "_rank", "v", "k")
    assert [r[1:] for r in sorted(ranked)] == sorted((r[1], r[2]) for r in ranked)
    assert sorted(r[0] for r in ranked) == list(range(1, 20_001))


def test_rows_at_ranks(spark):
    df = spark.range(1000).selectExpr("id % 7 AS a", "if(id % 2 = 0, 0, id) AS b", "concat('k', lpad(id * 379 % 1000, 4, '0')) AS k")
    rows = collect(df, "a", "b", "k")
    for n in (None, 1000):
        got = collect(ranking.rows_at(df, ["a", "b"], "k", lambda n: F.array(F.lit(1), F.floor(n / 2), n, n + 1), n), "m", "b", "n", "v", "k")
        want = [(m, b + 1, 1000, *[(float(r[m]), r[2]) for r in sorted(rows, key=lambda r: (r[m], r[2]))][rank - 1])
                for m in (0, 1) for b, rank in enumerate((1, 500, 1000))]
        assert sorted(got) == want


def test_building_runs_no_job(spark, tilted_ledger):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    try:
        segments.rfm_segments(tilted_ledger)
        segments.abc_summary(tilted_ledger)
        assert list(tracker.getJobIdsForGroup("building")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_kmeans(spark):
    rows = []
    for i in range(40):
        rows.append((dt.datetime(2024, 1, 1 + i % 20), 100.0 if i < 20 else 5000.0, 1, "a", "x",
                     f"c{i % 10 if i < 20 else 10 + i % 10}"))
    led = make_ledger(spark, rows).withColumn(C["order_id"], F.lit("o"))
    labelled, profile = segments.kmeans_customers(led, n_clusters=2)
    assert labelled.count() == 20
    prof = collect(profile)
    assert sum(p["n_customers"] for p in prof) == 20 and len(prof) == 2
    rich = {r["customer"] for r in collect(labelled) if r["cluster"] == 0}
    assert rich == {f"c{i}" for i in range(10, 20)}
    with Cut(spark, "test") as cut:
        mine, _ = segments.kmeans_customers(led, n_clusters=2, cut=cut)
        assert mine.count() == 20 and os.path.isdir(cut.path.removeprefix("file:"))
    assert not os.path.exists(cut.path.removeprefix("file:"))
    again, _ = segments.kmeans_customers(led, n_clusters=2)
    assert sorted(map(str, collect(again))) == sorted(map(str, collect(labelled)))
    assert segments.kmeans_customers(led.limit(0))[0].count() == 0
    assert segments.kmeans_customers(led.where(F.col(C["customer"]) == "c1"))[1].count() == 1


def test_rfm_v1_single_customer_middle_bin(spark):
    rows = [(dt.datetime(2024, 1, 1), 10.0, 1, "a", "x", "only")]
    led = make_ledger(spark, rows).withColumn(C["order_id"], F.lit("o1"))
    r = collect(segments.rfm_segments(led, reverse_recency=False, frequency_of="order_id",
                                      with_scores=True))
    assert (r[0]["R_score"], r[0]["F_score"], r[0]["M_score"]) == (3, 3, 3)
    assert r[0]["segment"] == "重要发展客户"


def test_rfm_now_includes_rows_without_customer(spark):
    rows = [(dt.datetime(2024, 1, 1), 1.0, 1, "a", "x", "c1"),
            (dt.datetime(2024, 1, 3), 1.0, 1, "a", "x", "c2"),
            (dt.datetime(2024, 1, 10), 1.0, 1, "a", "x", None)]
    r = dict(collect(segments.rfm_segments(make_ledger(spark, rows)), "customer", "R"))
    assert r == {"c1": 9, "c2": 7}


def test_recency_ignores_dst_in_session_zone(spark):
    rows = [(dt.datetime(2024, 3, 1), 1.0, 1, "a", "x", "c1"),
            (dt.datetime(2024, 3, 15), 1.0, 1, "a", "x", "c2")]
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        led = make_ledger(spark, rows)
        r = dict(collect(segments.rfm_segments(led), "customer", "R"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert r == {"c1": 14, "c2": 0}
