"""Skew check for the rank and the quantiles.

A table in which one value holds a third of all rows is ranked, with keys that are dense
numbers, dense numbers and one far away, and texts of one shape and one other text; then
quantiles are taken.  Prints the times, whether the ranks are exactly 1..n with the
right running sum, and the most rows of one range and of one task against the mean.
usage: python tools/skew_check.py [rows]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 6_000_000
    from pyspark.sql import functions as F

    from kpiforge.functions.stats import quantiles
    from kpiforge.operators.ranking import global_rank
    from kpiforge.session import get_session
    spark = get_session("local[8]", 8, driver_memory="8g")
    base = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 100_003).alias("v"), "id",
        (F.col("id") % 5).cast("decimal(20,0)").alias("a"))
    one = F.col("id") == n // 2
    keys = {"dense numbers": F.col("id"), "one far number": F.when(one, F.lit(10**15)).otherwise(F.col("id")),
            "texts and one other": F.when(one, F.lit("guest")).otherwise(F.format_string("C%08d", "id"))}
    for kind, key in keys.items():
        df = base.withColumn("k", key)
        t0 = time.perf_counter()
        ranked = global_rank(df, [("v", False), ("k", True)], sum_col="a")
        row = ranked.agg(F.min("_rank").alias("lo"), F.max("_rank").alias("hi"), F.sum("_rank").alias("ranks"),
                         F.max("_cum").alias("cum"), F.sum("a").alias("total")).first()
        dt = time.perf_counter() - t0
        per = ranked.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count").alias("m"), F.count("*").alias("t")).first()
        exact = (row["lo"], row["hi"], row["ranks"]) == (1, n, n * (n + 1) // 2)
        print(f"{kind}: rows={n} hot_value_share=1/3 seconds={dt:.1f} ranks_exact={exact} running_sum_exact="
              f"{row['cum'] == row['total']} most_of_a_task/mean={per['m'] * per['t'] / n:.2f} tasks={per['t']}")
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    t0 = time.perf_counter()
    got = quantiles(base, "v", probs)
    dt = time.perf_counter() - t0
    want = base.agg(F.percentile("v", probs).alias("q")).first()["q"]
    print(f"quantiles seconds={dt:.1f} exact={list(got) == [float(x) for x in want]}")


if __name__ == "__main__":
    main()
