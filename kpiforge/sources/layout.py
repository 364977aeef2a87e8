"""Bucketed tables: a fact table laid out once by the key that many reports group or join by.

A ledger bucketed by customer feeds recency, frequency and money, repeat purchase and
customer features without a shuffle of its rows, and so do orders bucketed by product for
rankings, profit and stock; two tables bucketed alike join without one.  One shuffle when
the layout is written takes the place of one per report.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.functions.cut import Cut


def bucketed(df: DataFrame, key: str, buckets: int | None = None, *, cut: Cut | None = None, path: str | None = None) -> DataFrame:
    """``df`` written in ``buckets`` buckets of ``key`` (by default as many as there are shuffle
    partitions), sorted by it within each, and read back.

    The files lie at ``path``, or in ``cut`` (by default one that lives as long as the
    application).  Every bucket is one file, written by the task that holds its rows; a key
    that a large share of the rows has makes a large bucket, and its rows are read by one
    task where they are grouped without a shuffle, as partial sums only.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"bucketed_{uuid.uuid4().hex}"
    path = path or f"{(cut or Cut(spark, 'bucketed')).path}/{name}"
    # the same hash deals rows to tasks and to buckets, so a task writes whole buckets
    rows = df.repartition(n, F.col(f"`{key}`"))
    rows.write.format("parquet").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)
