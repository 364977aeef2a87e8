"""Exact ranks, running sums and rank cuts over any number of rows, all lazy.

``Window.orderBy`` without ``partitionBy`` pulls every row into one task.  Here the
order by (value, key) is divided into ``RANGES`` ranges of about equal numbers of rows
first.  The dividing rows are every n-th of a sample that the keys' hashes choose: as
keys are unique, a value held by a third of all rows is divided by its keys like any other
stretch of the order, whatever the keys look like, and the same rows divide it when a
lost task is run again.  The sample is about ``SAMPLE`` rows at every size.

Ranges are counted (and summed) with a map-side combine, and what lies before a range
is a window over at most one row per range.  Within a range the rows are sorted.  The
sample decides only how even the ranges are; ranks and sums are exact.  Nothing runs while a
query is built, nothing is cached, and there is one path for every size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.functions.joins import attach_one_row

#: The order is divided in two steps, each into so many parts.
PARTS = 64
#: Rows that are sampled (about): eight a range.
SAMPLE = 8 * PARTS * PARTS


def _with_count(rows: DataFrame, df: DataFrame, n: int | None) -> DataFrame:
    """``rows`` with ``n``, the number of rows of ``df``, counted unless it is known."""
    return attach_one_row(rows, df.agg(F.count(F.lit(1)).alias("n"))) if n is None else rows.withColumn("n", F.lit(n).cast("bigint"))


def _sampled(rows: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """About ``SAMPLE`` of the rows, chosen by their key's hash."""
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return _with_count(rows, rows, n).where(place * F.col("n") < SAMPLE).drop("n")


def _dividing(sample: Column, low: Column, high: Column, parts: int) -> Column:
    """The ``parts - 1`` elements that divide [low, high) of a sorted array evenly."""
    return F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: F.get(sample, F.least(
        low + F.floor(i * (high - low) / F.lit(parts)), F.size(sample) - 1).cast("int")))


def _part(dividers: Column, own: Column, parts: int) -> Column:
    """How many of the dividers are not behind ``own``, by binary search."""
    steps = F.array(*[F.lit(parts >> k) for k in range(1, parts.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(dividers, at + s - 1) <= own, at + s).otherwise(at))


def _in_ranges(rows: DataFrame, sample: DataFrame) -> DataFrame:
    """``rows`` (their order in ``_own``) with ``_range``.  ``sample`` is one row with the
    sorted array ``_sample``.  A row meets two arrays of ``PARTS - 1`` dividers, first those
    of all rows, then those of its part, so that no large array goes along with it."""
    size = F.size("_sample").cast("bigint")
    edge = lambda p: F.floor(p * size / F.lit(PARTS))
    top = sample.select(_dividing(F.col("_sample"), F.lit(0), size, PARTS).alias("_top"))
    sub = sample.select("_sample", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_p"))
    sub = sub.select("_p", _dividing(F.col("_sample"), edge(F.col("_p")), edge(F.col("_p") + 1), PARTS).alias("_sub"))
    rows = attach_one_row(rows, top).withColumn("_part", _part(F.col("_top"), F.col("_own"), PARTS)).drop("_top")
    rows = rows.join(F.broadcast(sub), F.col("_part") == F.col("_p"))  # PARTS rows
    return rows.withColumn("_range", F.col("_part") * PARTS + _part(F.col("_sub"), F.col("_own"), PARTS)).drop("_part", "_p", "_sub")


def global_rank(df: DataFrame, order: Sequence[tuple[str, bool]], *, rank_col: str = "_rank",
                sum_col: str | None = None, cum_col: str = "_cum") -> DataFrame:
    """Add ``rank_col`` (1..n) in ``order`` and, optionally, the running sum of
    ``sum_col`` in ``cum_col`` (inclusive of the row).

    ``order`` is ``[(numeric value column, ascending), (unique key column, True)]``, both
    without NULLs.  The running sum is exact when ``sum_col`` is DECIMAL.
    """
    (value, ascending), (key, key_up) = order
    if not key_up:
        raise ValueError("ties are broken by the key in ascending order")
    rows = df.withColumn("_own", F.struct((F.col(value) if ascending else -F.col(value)).alias("v"), F.col(key).alias("k")))
    sample = _sampled(rows, key).agg(F.array_sort(F.collect_list("_own")).alias("_sample"))
    rows = _in_ranges(rows, sample)
    sums = {"_n": F.lit(1)} | ({"_s": F.col(sum_col)} if sum_col else {})
    totals = rows.groupBy("_range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    over = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    totals = totals.select(F.col("_range").alias("_r"), *[F.coalesce(F.sum(n).over(over), F.lit(0)).alias(f"_before{n}") for n in sums])
    rows = rows.join(F.broadcast(totals), F.col("_range") == F.col("_r"))
    inside = Window.partitionBy("_range").orderBy("_own")
    out = rows.withColumn(rank_col, (F.col("_before_n") + F.row_number().over(inside)).cast("long"))
    if sum_col:
        run = F.sum(sum_col).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        out = out.withColumn(cum_col, F.col("_before_s") + run)
    return out.drop("_own", "_range", "_r", *[f"_before{n}" for n in sums])


def rows_at(df: DataFrame, measures: Sequence[str], key: str, ranks: Callable[[Column], Column], n: int | None = None) -> DataFrame:
    """The rows at some ranks of each measure in (measure, ``key``) order: m (the measure's
    number), b (the number of the rank, from 1), n (rows), v and k (measure and key).

    ``ranks`` makes an array of 1-based ranks out of the number of rows; one that there
    isn't has no row.  ``n`` saves the count where it is known.  All measures are divided and counted together, and only the rows
    of a range that holds a wanted rank are sorted.
    """
    rows = df.select(F.col(key).alias("k"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(measures)])
    own = [F.struct(F.col(f"v{i}").alias("v"), "k") for i in range(len(measures))]
    sample = _sampled(rows, "k", n).agg(*[F.array_sort(F.collect_list(x)).alias(f"s{i}") for i, x in enumerate(own)])
    parts = 4 * PARTS  # a few ranges are sorted, so fewer will do and be found in one step
    sample = sample.select(*[_dividing(F.col(f"s{i}"), F.lit(0), F.size(f"s{i}").cast("bigint"), parts).alias(f"d{i}") for i in range(len(own))])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), _part(F.col(f"d{i}"), x, parts).alias("_range"), x.alias("_own"))
                               for i, x in enumerate(own)])).alias("_e")
    long = attach_one_row(rows, sample).select(each).select("_e.*")
    to = F.sum("c").over(Window.partitionBy("m").orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranges = long.groupBy("m", "_range").agg(F.count(F.lit(1)).alias("c")).withColumn("to", to)
    wanted = _with_count(ranges, rows, n).select("*", F.posexplode(ranks(F.col("n"))).alias("b", "rank"))
    wanted = wanted.where((F.col("rank") <= F.col("to")) & (F.col("rank") > F.col("to") - F.col("c"))).select(
        F.col("m").alias("_m"), F.col("_range").alias("_r"), (F.col("b") + 1).alias("b"), "n",
        (F.col("rank") - F.col("to") + F.col("c")).alias("rank"))
    near = long.join(F.broadcast(wanted), (F.col("m") == F.col("_m")) & (F.col("_range") == F.col("_r")))  # a row per wanted rank
    at = F.row_number().over(Window.partitionBy("m", "b").orderBy("_own"))
    return near.withColumn("at", at).where(F.col("at") == F.col("rank")).select("m", "b", "n", "_own.v", "_own.k")


def quintile_cuts(df: DataFrame, measures: Sequence[str], key: str) -> DataFrame:
    """One row: ``n`` and, per measure m, ``cuts_m``: the (value, key) pairs of the
    last row of quintiles 1 to 4 in (value, key) order.

    The quintile of rank r is ``max(1, ceil(5 (r-1) / (n-1)))`` (pandas ``qcut`` of a
    first-come rank), so quintile b ends at rank ``1 + floor(b (n-1) / 5)``.
    """
    cuts = rows_at(df, measures, key, lambda n: F.transform(
        F.sequence(F.lit(1), F.lit(4)), lambda b: F.lit(1) + F.floor(b * (n - 1) / F.lit(5))))
    return cuts.agg(F.max("n").alias("n"), *[
        F.array_sort(F.collect_list(F.when(F.col("m") == i, F.struct("b", "v", "k")))).alias(f"cuts_{c}")
        for i, c in enumerate(measures)])


def quintile(value: Column, key: Column, cuts: Column, n: Column, reverse: bool = False) -> Column:
    """Quintile 1..5 (5..1 if ``reverse``) of a row from the cuts of its measure; NULL for n < 2."""
    own = F.struct(value.cast("double").alias("v"), key.alias("k"))
    above = F.lit(1)
    for b in range(4):
        cut = F.get(cuts, F.lit(b))
        above = above + F.when(own > F.struct(cut["v"].alias("v"), cut["k"].alias("k")), 1).otherwise(0)
    score = F.when(n >= 2, above)
    return (F.lit(6) - score) if reverse else score
