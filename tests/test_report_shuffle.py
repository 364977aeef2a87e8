"""The ledger's joins: how often the report runs them, and what they shuffle."""

import datetime as dt
import re

from pyspark.sql import functions as F

from kpiforge.plans import catalog
from kpiforge.sources import testviews

N = 240


def tables(spark, at):
    """Sales tables of N line items over the years 1994 to 1997; some with no order, part or customer."""
    at = str(at)
    day = dt.datetime(1994, 1, 1)
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    write([(i // 3 if i % 20 else None, i % 11, 100.0 + i, 0.25 * (i % 4), 1.0 + i % 5) for i in range(N)],
          "l_orderkey long, l_partkey long, l_extendedprice double, l_discount double, l_quantity double", "lineitem")
    write([(k, k % 7, day + dt.timedelta(days=19 * k)) for k in range(75)], "o_orderkey long, o_custkey long, o_orderdate timestamp", "orders")
    write([(k, f"part {k}", f"Brand#{k % 3}") for k in [*range(10), 4]], "p_partkey long, p_name string, p_brand string", "part")
    write([(k, k % 3, "tier") for k in [*range(6), 2]], "c_custkey long, c_nationkey long, c_mktsegment string", "customer")
    write([(k, f"nation {k}", k % 2) for k in range(3)], "n_nationkey long, n_name string, n_regionkey long", "nation")
    write([(k, f"region {k}") for k in range(2)], "r_regionkey long, r_name string", "region")
    return at


def expected_rows():
    """The ledger of ``tables`` by nested loops."""
    out = []
    for i in (i for i in range(N) if i % 20):
        order, part = i // 3, i % 11
        for _ in range([*range(10), 4].count(part) if order < 75 else 0):
            for c in (c for c in [*range(6), 2] if c == order % 7):
                out.append(((dt.datetime(1994, 1, 1) + dt.timedelta(days=19 * order)), (100.0 + i) * (1 - 0.25 * (i % 4)),
                            1.0 + i % 5, f"Brand#{part % 3}", f"region {c % 3 % 2}"))
    return sorted(out)


def test_ledger_shuffles_line_items_once_per_large_table(spark, tmp_path):
    at = tables(spark, tmp_path)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        led = testviews.sales_ledger(spark, at, ["date", "amount", "qty", "category", "region"])
        plan = led._jdf.queryExecution().executedPlan().toString().split("\n")
        found = sorted(map(tuple, led.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    depth = lambda line: re.search(r"[A-Za-z*(]", line).start()
    keys = []
    for i, line in enumerate(plan):
        if "Exchange hashpartitioning" in line:
            below = []
            for x in plan[i + 1:]:
                if not x.strip() or depth(x) < depth(line) or x[:depth(line)].rstrip().endswith("+-"):
                    break
                below.append(x)
            if any("FileScan" in x and "l_orderkey" in x for x in below):
                keys.append(re.search(r"hashpartitioning\((\w+?)#", line)[1])
    assert sorted(keys) == ["l_orderkey", "l_partkey"]  # once for orders and once for parts; not for customers, nations and regions
    assert found == expected_rows()


def test_report_runs_the_joins_once(spark, tmp_path, monkeypatch):
    at = tables(spark, tmp_path)
    rows = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        rows.add(1)
        return x

    ledger = testviews.sales_ledger
    monkeypatch.setattr(testviews, "sales_ledger", lambda *a: ledger(*a).withColumn("amount", seen("amount")))
    found = {(r.period[:4], r.sheet, r.key): r.cents for r in catalog.QUERIES["report_replaces_periods"](spark, at).collect()}
    want = {}
    for date, amount, _, category, region in expected_rows():
        for sheet, key, n in (("category", category, round(amount * 100) * (2 if date.year in (1995, 1996) else 1)),
                              ("region", region, round(amount * 100) * (2 if date.year in (1995, 1996) else 1)), ("raw", "rows", 1)):
            at_key = (str(date.year), sheet, key)
            want[at_key] = want.get(at_key, 0) + n
    assert found == want
    assert rows.value == len(expected_rows())  # every later step reads the cut
