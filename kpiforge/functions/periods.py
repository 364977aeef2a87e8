"""Calendar periods: labels, starts, steps and the gap-filled spine (T0).

pandas ``resample`` labels a period by its *end*: a Monday-Sunday week by its
Sunday, a month/quarter/year by its last day, and it emits every period
between the first and the last one that holds data, empty ones included.  We
aggregate on the period *start* (cheap and order-preserving) and convert starts to
end labels at the end.

The aggregate holds the periods with data only.  A period's *number* says where it
stands in the calendar, so an empty stretch is the gap between two numbers, however
long: sums, lines and smoothed values over the whole calendar follow in closed form from
the rows that there are.  Empty periods become rows only where they are a result
(:func:`fill_gaps`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.functions.joins import attach_one_row

# pandas aliases accepted by the reference for the same frequency.
_ALIASES = {"ME": "M", "QE": "Q", "YE": "Y", "A": "Y", "W-SUN": "W"}
FREQS = ("D", "W", "M", "Q", "Y")


def norm_freq(freq: str) -> str:
    f = _ALIASES.get(freq.upper(), freq.upper())
    if f not in FREQS:
        raise ValueError(f"unsupported period {freq!r}; use one of {FREQS}")
    return f


def period_start(ts: Column, freq: str) -> Column:
    f = norm_freq(freq)
    d = F.to_date(ts)
    if f == "D":
        return d
    if f == "W":
        return F.to_date(F.date_trunc("week", d))      # Monday
    unit = {"M": "month", "Q": "quarter", "Y": "year"}[f]
    return F.trunc(d, unit)


def period_end(start: Column, freq: str) -> Column:
    """Label (= last day) of the period that begins at ``start``."""
    f = norm_freq(freq)
    if f == "D":
        return start
    if f == "W":
        return F.date_add(start, 6)                    # Sunday
    months = {"M": 0, "Q": 2, "Y": 11}[f]
    return F.last_day(F.add_months(start, months) if months else start)


def period_label(ts: Column, freq: str) -> Column:
    return period_end(period_start(ts, freq), freq)


def step(freq: str) -> Column:
    f = norm_freq(freq)
    return F.expr({"D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAYS", "M": "INTERVAL 1 MONTH",
                   "Q": "INTERVAL 3 MONTHS", "Y": "INTERVAL 12 MONTHS"}[f])


def offset_start(start: Column, freq: str, k: Column | int) -> Column:
    """Start of the period ``k`` periods after the one starting at ``start``."""
    f = norm_freq(freq)
    k = F.lit(k) if isinstance(k, int) else k
    if f == "D":
        return F.date_add(start, k.cast("int"))
    if f == "W":
        return F.date_add(start, (k * 7).cast("int"))
    months = {"M": 1, "Q": 3, "Y": 12}[f]
    return F.add_months(start, (k * months).cast("int"))


def period_number(start: Column, freq: str) -> Column:
    """Consecutive periods have consecutive numbers (BIGINT)."""
    f = norm_freq(freq)
    if f in "DW":
        day = F.unix_date(start).cast("bigint")
        return day if f == "D" else F.floor((day + 3) / F.lit(7))  # 1969-12-29 was a Monday
    year = F.year(start).cast("bigint")
    return {"M": year * 12 + F.month(start) - 1, "Q": year * 4 + F.quarter(start) - 1, "Y": year}[f]


def start_of_number(number: Column, freq: str) -> Column:
    """The start of the period with a number."""
    f = norm_freq(freq)
    if f in "DW":
        return F.date_from_unix_date((number if f == "D" else number * 7 - 3).cast("int"))
    parts = {"M": 12, "Q": 4, "Y": 1}[f]
    month = F.pmod(number, F.lit(parts)) * F.lit(12 // parts) + 1
    return F.make_date(F.floor(number / F.lit(parts)).cast("int"), month.cast("int"), F.lit(1))


def sums_by_period(ledger: DataFrame, freq: str, value: str = "amount", date: str = "date",
                   group_cols: Sequence[str] = (), scale: int | None = None) -> DataFrame:
    """Sum and non-null count of ``value`` for each period that has rows: ``*group_cols,
    period_start, revenue, n_orders``.  Rows with a NULL date are ignored (pandas drops NaT
    when resampling); NULL group keys are dropped (pandas ``groupby``).
    """
    from kpiforge.functions.numeric import money_sum

    f = norm_freq(freq)
    g = list(group_cols)
    rows = ledger.where(F.col(date).isNotNull())
    for c in g:
        rows = rows.where(F.col(c).isNotNull())
    return (rows.select(*g, period_start(F.col(date), f).alias("period_start"), F.col(value).alias("_v"))
            .groupBy(*g, "period_start")
            .agg(money_sum(F.col("_v"), scale).alias("revenue"), F.count("_v").alias("n_orders")))


def placed(agg: DataFrame, freq: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """The aggregate with ``t``, each period's 0-based place in its series' calendar, and
    ``n``, how many periods that calendar has, empty ones included."""
    g = list(group_cols)
    agg = agg.withColumn("_number", period_number(F.col("period_start"), freq))
    ends = agg.groupBy(*g).agg(F.min("_number").alias("_low"), F.max("_number").alias("_high"))
    rows = agg.join(ends, g) if g else attach_one_row(agg, ends)
    return rows.select(*agg.drop("_number").columns, (F.col("_number") - F.col("_low")).alias("t"),
                       (F.col("_high") - F.col("_low") + 1).alias("n"))


def resample(ledger: DataFrame, freq: str, value: str = "amount", date: str = "date",
             group_cols: Sequence[str] = (), scale: int | None = None) -> DataFrame:
    """Gap-filled sum and non-null count of ``value`` per period (T0).

    Output: ``*group_cols, period_start, period, revenue, n_orders``; a row for every
    period from each series' first to its last.
    """
    return fill_gaps(sums_by_period(ledger, freq, value, date, group_cols, scale), freq, group_cols)


def fill_gaps(agg: DataFrame, freq: str, group_cols: Sequence[str] = (), *, with_before: bool = False) -> DataFrame:
    """The gap-filled series of an aggregate (``*group_cols, period_start, revenue,
    n_orders``, a row per period that has data), as :func:`resample` returns it; with
    ``before``, the revenue of the period before (NULL for the first), if ``with_before``."""
    f, g = norm_freq(freq), list(group_cols)
    # Gap fill without a second pass: each period row also emits the empty
    # periods up to the next non-empty one (``lead`` over the small aggregate,
    # partitioned by series), so the ledger is scanned once and nothing joins.
    w = Window.partitionBy(*g).orderBy("period_start") if g else Window.orderBy("period_start")
    last = F.lag("period_start").over(w)
    before = F.when(last.isNull(), None).when(last == offset_start(F.col("period_start"), f, -1), F.lag("revenue").over(w)).otherwise(0.0)
    agg = agg.withColumns({"_next": F.lead("period_start").over(w)} | ({"_before": before} if with_before else {}))
    nxt = F.col("_next")
    cur = F.col("period_start")
    span = F.when(nxt.isNull(), F.array(cur)).otherwise(
        F.sequence(cur, offset_start(nxt, f, -1), step(f)))
    filled = agg.select(*[c for c in agg.columns if c not in ("period_start", "_next")], F.posexplode(span).alias("_pos", "_ps"))
    first = F.col("_pos") == 0
    out = [*g, F.col("_ps").alias("period_start"),
           period_end(F.col("_ps"), f).alias("period"),
           F.when(first, F.col("revenue")).otherwise(F.lit(0.0)).alias("revenue"),
           F.when(first, F.col("n_orders")).otherwise(F.lit(0)).cast("long").alias("n_orders")]
    if with_before:
        out.append(F.when(first, F.col("_before")).when(F.col("_pos") == 1, F.col("revenue")).otherwise(0.0).alias("before"))
    return filled.select(*out)
