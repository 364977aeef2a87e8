"""Sinks (IO5, IO6) and the ordered head sample (IO8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiforge.functions.columns import ColumnMap, as_timestamp, to_logical
from kpiforge.functions.numeric import money_sum
from kpiforge.functions.periods import period_label


def for_json(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ``yyyy-MM-dd`` strings, NaN as NULL (the
    reference's JSON records, which keep a key whose value is null)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def emit(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite",
         partition_by: list[str] | None = None) -> None:
    """IO5 — write a result (json | csv | parquet).  Results are written by the
    executors in parallel; nothing is collected to the driver.

    ``mode="replace"`` needs ``partition_by`` and replaces only the partitions that ``df`` has
    rows for (with periods as partitions, a run for some periods leaves the others as they
    are, and a repeated run changes nothing); the other modes are Spark's own, and
    ``overwrite`` replaces the whole folder."""
    if mode == "replace" and not partition_by:
        raise ValueError("mode 'replace' replaces partitions: name them with partition_by")
    out = for_json(df) if fmt in ("json", "csv") else df
    w = out.write.mode("overwrite" if mode == "replace" else mode)
    w = w.option("partitionOverwriteMode", "dynamic" if mode == "replace" else "static")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.option("ignoreNullFields", False).json(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")


def report_totals(df: DataFrame, cols: ColumnMap | dict | None = None, by: list[str] | None = None) -> DataFrame:
    """IO6 data — category and region totals in one grouping-sets pass, for each value of the
    columns ``by`` if given.  Columns: *by, sheet ('category' | 'region'), key, revenue."""
    by = list(by or [])
    led = to_logical(df, cols, ["amount", "category", "region"], ["amount"], keep=by)
    keys = [k for k in ("category", "region") if k in led.columns]
    if not keys:
        return df.sparkSession.createDataFrame([], "sheet string, key string, revenue double")
    group = [F.col(f"`{c}`") for c in by]
    gs = led.groupingSets([[*group, F.col(k)] for k in keys], *group, *keys).agg(
        money_sum(F.col("amount"), ColumnMap.of(cols).scale).alias("revenue"), *[F.grouping(k).alias(f"_{k}") for k in keys])
    sheet, key = F.lit(keys[-1]), F.col(keys[-1]).cast("string")
    if len(keys) == 2:
        is_category = F.col("_category") == 0
        sheet = F.when(is_category, F.lit("category")).otherwise(F.lit("region"))
        key = F.when(is_category, F.col("category").cast("string")).otherwise(key)
    return gs.select(*group, sheet.alias("sheet"), key.alias("key"), "revenue").where(F.col("key").isNotNull())


def export_report(df: DataFrame, base_path: str, cols: ColumnMap | dict | None = None,
                  fmt: str = "parquet", period: str | None = None) -> None:
    """IO6 — raw rows in ``raw`` and the totals in ``totals``, one sub-directory per
    sheet (``sheet=category``, ``sheet=region``).  ``df`` is computed for each of the two:
    hand in a table that is cheap to read (a ``Cut``'s), not a chain of joins.

    With ``period`` (D, W, M, Q or Y) both are kept by period (``period=2024-01-31``, its last
    day; the totals are those of the period), and a run replaces only the periods of the rows
    that it is given: hand it whole periods.  Rows without a date are in no period."""
    base = base_path.rstrip("/")
    if period is None:
        emit(df, f"{base}/raw", fmt)
        emit(report_totals(df, cols), f"{base}/totals", fmt, partition_by=["sheet"])
        return
    date = as_timestamp(F.col(f"`{ColumnMap.of(cols).date}`"))
    rows = df.withColumn("period", F.date_format(period_label(date, period), "yyyy-MM-dd")).where("period is not null")
    emit(rows, f"{base}/raw", fmt, "replace", ["period"])
    emit(report_totals(rows, cols, by=["period"]), f"{base}/totals", fmt, "replace", ["period", "sheet"])


def head_sample(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """IO8 — the first ``n`` rows in an explicit order (a TakeOrdered, not a
    full sort); without an order, the first ``n`` Spark happens to read."""
    return df.orderBy(*order_by).limit(n) if order_by else df.limit(n)
