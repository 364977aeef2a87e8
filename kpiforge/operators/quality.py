"""Data quality: missing values, duplicates, outliers, profile (Q1-Q6, A12).

NaN is missing, like NULL.  The outlier filters are *sequential* as in the
reference: each numeric column's statistics are computed on the rows kept by the
previous columns.  Statistics are actions (they decide later filters) that read
the column and those filtered before it; the returned DataFrame is a chain of
filters with literal bounds over the caller's table, or over a table that
:func:`clean` has written in between, so that no statistic repeats what came before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiforge.functions.columns import nan_as_null
from kpiforge.functions.cut import Cut
from kpiforge.functions.stats import quantiles, quantiles_of

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def drop_missing(df: DataFrame) -> DataFrame:
    """Q1 — drop rows with any NULL (or NaN) value."""
    return nan_as_null(df).na.drop("any")


def fill_missing(df: DataFrame, *, exact: bool = True) -> DataFrame:
    """Q2 — numeric columns: median; others: the most frequent value (smallest
    on ties), or 'Unknown' when the column is entirely NULL.

    One job counts every column's missing values, one finds the modes of all columns that
    need one, and at most six the medians of all that need one (:func:`quantiles_of`).  A
    numeric column that receives a fractional median becomes DOUBLE (pandas makes it float64).
    """
    df = nan_as_null(df)
    fields = df.schema.fields
    nulls_row = df.agg(*[F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"n{i}")
                         for i, f in enumerate(fields)]).first()
    todo = [f for i, f in enumerate(fields) if nulls_row[f"n{i}"] > 0]
    if not todo:
        return df
    modes = most_frequent(df, [f.name for f in todo if not isinstance(f.dataType, NUMERIC)])
    numbers = [f.name for f in todo if isinstance(f.dataType, NUMERIC)]
    if exact:
        medians = {c: q[0] for c, q in quantiles_of(df, {c: [0.5] for c in numbers}).items()}
    else:
        medians = {c: quantiles(df, c, [0.5], exact=False)[0] for c in numbers}
    exprs = {}
    for f in todo:
        c = F.col(f"`{f.name}`")
        if f.name in medians:
            med = medians[f.name]
            exprs[f.name] = c if med is None else F.coalesce(c.cast("double"), F.lit(med))
        else:
            m = modes.get(f.name)
            if m is None and not isinstance(f.dataType, T.StringType):
                # entirely NULL: pandas fills 'Unknown' and the column becomes text
                exprs[f.name] = F.coalesce(c.cast("string"), F.lit("Unknown"))
            else:
                exprs[f.name] = F.coalesce(c, F.lit("Unknown" if m is None else m).cast(f.dataType))
    return df.withColumns(exprs)


def most_frequent(df: DataFrame, columns: list[str]) -> dict:
    """pandas ``mode()[0]`` of each column: the most frequent non-NULL value, smallest on
    ties (absent for a column without values).

    One distributed count of (column, value), combined map-side, so a hot value costs
    nothing extra, and the largest count per column: never a buffer of all distinct
    values as Spark's ``mode`` aggregate would hold."""
    if not columns:
        return {}
    each = F.array(*[F.struct(F.lit(i).alias("i"), *[F.col(f"`{c}`").alias(f"v{k}") if k == i else F.lit(None).cast(df.schema[c].dataType).alias(f"v{k}")
                                                    for k, c in enumerate(columns)]) for i in range(len(columns))])
    names = [f"v{k}" for k in range(len(columns))]
    rows = df.select(F.explode(each).alias("e")).select("e.*").where(F.coalesce(*[F.col(v).cast("string") for v in names]).isNotNull())
    counts = rows.groupBy("i", *names).count()
    top = counts.groupBy("i").agg(F.min(F.struct((-F.col("count")).alias("n"), *names)).alias("t")).collect()
    return {columns[r["i"]]: r["t"][f"v{r['i']}"] for r in top}


#: Hashes of 8 bytes that are sent to every executor at most (16 MB).
HASHES = 1 << 21


def drop_duplicates(df: DataFrame, *, cut: Cut | None = None) -> DataFrame:
    """Q3 — remove full-row duplicates (NULLs compare equal).

    Only a 64-bit hash of each row is shuffled at first, counted with a map-side combine.
    Rows whose hash occurs once are passed on as they are; those whose hash occurs
    again, equal rows or not, are shuffled whole and compared in full.  The hashes
    that occur again are written to ``cut`` and counted; if they are more than
    ``HASHES``, too many to be sent to every executor, all rows are shuffled and compared.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    given = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in columns])  # hashes pass over nulls
    keyed = df.withColumn("_hash", F.xxhash64(given, *columns))
    again = keyed.groupBy("_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_hash")
    again = (cut or Cut(df.sparkSession, "duplicates")).table(again)
    if again.count() > HASHES:
        return df.dropDuplicates()
    once = keyed.join(F.broadcast(again), "_hash", "left_anti")
    more = keyed.join(F.broadcast(again), "_hash", "left_semi").dropDuplicates()
    return once.unionByName(more).select(*columns)


def iqr_filter(df: DataFrame, columns: list[str] | None = None, *, exact: bool = True) -> DataFrame:
    """Q4 — per numeric column, in order, keep [Q1 - 1.5 IQR, Q3 + 1.5 IQR]
    computed on the rows that survived the previous columns; missing values drop."""
    cur = nan_as_null(df)
    for c in columns if columns is not None else numeric_columns(df):
        q1, q3 = quantiles(cur, c, [0.25, 0.75], exact=exact)
        if q1 is None:
            cur = cur.where(F.lit(False))
            continue
        iqr = q3 - q1
        x = F.col(f"`{c}`")
        cur = cur.where((x >= F.lit(q1 - 1.5 * iqr)) & (x <= F.lit(q3 + 1.5 * iqr)))
    return cur


def zscore_filter(df: DataFrame, columns: list[str] | None = None, *, threshold: float = 3.0) -> DataFrame:
    """Q5 — per numeric column, in order, keep |x - mean| / std < 3 (sample std,
    on the surviving rows).  A constant column has std 0 → every row drops,
    as in the reference (NaN < 3 is false); missing values drop."""
    cur = nan_as_null(df)
    for c in columns if columns is not None else numeric_columns(df):
        row = cur.agg(F.avg(F.col(f"`{c}`")).alias("m"),
                      F.stddev_samp(F.col(f"`{c}`")).alias("s")).first()
        m, s = row["m"], row["s"]
        if m is None or s is None or s == 0 or s != s:
            cur = cur.where(F.lit(False))
            continue
        x = F.col(f"`{c}`")
        cur = cur.where(F.abs((x - F.lit(m)) / F.lit(s)) < F.lit(float(threshold)))
    return cur


def clean(df: DataFrame, handle_missing: str = "drop", remove_duplicates: bool = True,
          outlier_method: str | None = None, *, exact: bool = True, cut: Cut | None = None) -> DataFrame:
    """Q6 — missing values ('drop' | 'fill') → duplicates → outliers
    (None | 'iqr' | 'zscore'), in the reference's order.

    What the outlier statistics read is written once to ``cut`` first, so they repeat neither
    the filling nor the search for duplicates.  The result reads it, too: use it before
    ``cut.release()``.  Without a ``cut`` of the caller's it lives as long as the application."""
    cut = cut or Cut(df.sparkSession, "clean")
    out = df
    if handle_missing == "drop":
        out = drop_missing(out)
    elif handle_missing == "fill":
        out = fill_missing(out, exact=exact)
    if remove_duplicates:
        out = drop_duplicates(out, cut=cut)
    if outlier_method in ("iqr", "zscore"):
        out = cut.table(out)
        out = iqr_filter(out, exact=exact) if outlier_method == "iqr" else zscore_filter(out)
    return out


def count_rows(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` with an observer: once an action has run over it (a write, say),
    ``observation.get["rows"]`` is the number of its rows, without another job.
    Wrap the input and the cleaned table to learn how many rows cleaning removed."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def profile(df: DataFrame) -> DataFrame:
    """A12 — one row per column: position, column, dtype, n_missing (NULL or NaN), n_rows.

    One pass: a single aggregate of per-column counts, then ``stack``."""
    df = nan_as_null(df)
    fields = df.schema.fields
    agg = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"_n{i}")
                   for i, f in enumerate(fields)])
    pairs = ", ".join(f"{i}, '{f.name.replace(chr(39), chr(39) * 2)}', "
                      f"'{f.dataType.simpleString()}', _n{i}" for i, f in enumerate(fields))
    return agg.selectExpr(
        f"stack({len(fields)}, {pairs}) AS (position, column, dtype, n_missing)", "_rows"
    ).select(F.col("position").cast("long"), "column", "dtype",
             F.col("n_missing").cast("long"), F.col("_rows").alias("n_rows"))
