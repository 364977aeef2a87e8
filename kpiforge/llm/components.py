"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import written


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node that has a link; the root is the smallest
    node it reaches.  Nulls and self-links are dropped; repeated links don't matter.

    Each round links every node's larger neighbours, then its smaller ones, to the
    smallest of them.  Minima are combined before they are shuffled, and minima and
    links are written to the shared folder, so that a join reads two plain tables and
    Spark can split a hub's links.  Nothing but two numbers comes to the driver.
    """
    pairs = (links.where(F.col(a) != F.col(b))
             .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    pairs = written(pairs, "links")
    before = None
    while True:
        seen = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        if seen["n"] == 0 or (seen["n"], seen["h"]) == before:
            break
        before = (seen["n"], seen["h"])
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(pairs.select("lo", "hi"))
        least = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = (both.where("v > u").join(least, "u").where("v != m")
                 .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        large = written(large, "large")
        low = written(large.groupBy("hi").agg(F.min("lo").alias("m")), "low")
        small = large.join(low, "hi")
        new = (small.where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
               .union(low.select("hi", F.col("m").alias("lo"))).distinct())
        pairs = written(new, "links")
    roots = pairs.select("lo").distinct()
    return (pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
            .union(roots.select("lo", F.col("lo").alias("root"))))
