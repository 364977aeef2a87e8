"""Baseline forecasts on the gap-filled period series (T0).

Every forecast takes an optional ``group_cols``: many series are forecast in
one job, each series handled by ordinary grouped aggregates or windows
partitioned by the series key.  Ungrouped = the reference's behaviour.

Forecasts are taken from the periods that have rows and their places in the calendar
(:func:`sums`): an empty period adds nothing to a sum, and Holt passes a stretch of
empty blocks at once, so a wrong date far away costs nothing.  The hold-out evaluation
and the fitted line look at every period (:func:`series`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.functions.columns import ColumnMap, as_timestamp, to_logical
from kpiforge.functions.joins import attach_one_row
from kpiforge.functions.periods import norm_freq, offset_start, period_end, placed, resample, sums_by_period


def _dated(df: DataFrame, cmap: ColumnMap, g: list[str]) -> DataFrame:
    led = to_logical(df, cmap, ["date", "amount"], ["date", "amount"], keep=g)
    return led.withColumn("date", as_timestamp(F.col("date")))


def sums(df: DataFrame, freq: str = "D", cols: ColumnMap | dict | None = None, group_cols: Sequence[str] = ()) -> DataFrame:
    """The periods that have rows: *group_cols, period_start, y, t (0-based place in the
    series' calendar, empty periods counted), n (length of that calendar)."""
    g, cmap = list(group_cols), ColumnMap.of(cols)
    rows = placed(sums_by_period(_dated(df, cmap, g), freq, group_cols=g, scale=cmap.scale), freq, g)
    return rows.select(*g, "period_start", F.col("revenue").alias("y"), "t", "n")


def series(df: DataFrame, freq: str = "D", cols: ColumnMap | dict | None = None,
           group_cols: Sequence[str] = ()) -> DataFrame:
    """Gap-filled series with its position ``t`` (0-based) and length ``n``."""
    g = list(group_cols)
    cmap = ColumnMap.of(cols)
    s = resample(_dated(df, cmap, g), freq, group_cols=g, scale=cmap.scale)
    w = Window.partitionBy(*g).orderBy("period_start") if g else Window.orderBy("period_start")
    wn = Window.partitionBy(*g) if g else Window.partitionBy()
    return s.select(*g, "period_start", "period", F.col("revenue").alias("y"),
                    (F.row_number().over(w) - 1).alias("t"), F.count(F.lit(1)).over(wn).alias("n"))


def _future(stats: DataFrame, freq: str, periods: int, g: list[str]) -> DataFrame:
    """``periods`` future period labels after each series' last period."""
    f = norm_freq(freq)
    steps = F.sequence(F.lit(1).cast("long"), F.lit(int(periods)).cast("long"))
    fut = stats.select("*", F.explode(steps).alias("step"))
    return fut.withColumn("period", period_end(offset_start(F.col("_last"), f, F.col("step")), f))


def _tail_mean(window: int):
    """Mean of the last ``min(window, n)`` periods of a series, from those that have rows."""
    return F.sum(F.when(F.col("t") >= F.col("n") - F.lit(int(window)), F.col("y"))) / F.least(F.lit(int(window)), F.max("n"))


def moving_average(df: DataFrame, periods: int = 7, window: int = 7, freq: str = "D",
                   cols: ColumnMap | dict | None = None,
                   group_cols: Sequence[str] = ()) -> DataFrame:
    """F1 — mean of the last ``min(window, n)`` periods, repeated ``periods`` times.

    Columns: *group_cols, method, freq, history_periods, step, period, value.
    No rows for an empty series (the v1 short-series rule, overall mean, is the
    same number since all n < window periods are used).
    """
    g = list(group_cols)
    stats = sums(df, freq, cols, g).groupBy(*g).agg(
        _tail_mean(window).alias("value"), F.max("period_start").alias("_last"),
        F.max("n").alias("history_periods")).where(F.col("history_periods").isNotNull())
    return (_future(stats, freq, periods, g)
            .select(*g, F.lit("moving_average").alias("method"), F.lit(norm_freq(freq)).alias("freq"),
                    F.col("history_periods").cast("long").alias("history_periods"),
                    "step", "period", "value"))


def _ols(n, sum_y, sum_ty):
    """Least-squares slope and intercept on t = 0..n-1 (NULL for n < 2) from n, the sum of y
    and the sum of (t - (n - 1) / 2) y."""
    slope = F.when(n >= 2, sum_ty / (n * (n.cast("double") * n - 1) / 12))
    return slope, sum_y / n - slope * (n - 1) / 2


def _line(s: DataFrame, g: list[str], *more) -> DataFrame:
    """Per series: slope, intercept, history_periods, _last and ``more`` aggregates."""
    moment = (F.col("t") - (F.col("n") - 1) / 2) * F.col("y")
    rows = s.groupBy(*g).agg(F.sum("y").alias("_y"), F.sum(moment).alias("_ty"), F.max("n").alias("history_periods"),
                             F.max("period_start").alias("_last"), *more)
    slope, intercept = _ols(F.col("history_periods"), F.col("_y"), F.col("_ty"))
    return rows.withColumns({"slope": slope, "intercept": intercept}).drop("_y", "_ty")


def linear_trend(df: DataFrame, periods: int = 7, freq: str = "D",
                 cols: ColumnMap | dict | None = None, *, clip: bool = True,
                 group_cols: Sequence[str] = ()) -> DataFrame:
    """F2 — least-squares line on t = 0..n-1 extrapolated ``periods`` steps,
    clipped at 0 (``clip=False``: the v1 rule).  No rows when n < 2.

    Columns: *group_cols, method, freq, history_periods, slope, intercept,
    step, period, value.
    """
    g = list(group_cols)
    stats = _line(sums(df, freq, cols, g), g).where(F.col("history_periods") >= 2)
    fut = _future(stats, freq, periods, g)
    x = F.col("history_periods") - 1 + F.col("step")
    val = F.col("slope") * x + F.col("intercept")
    val = F.greatest(F.lit(0.0), val) if clip else val
    return fut.select(*g, F.lit("linear_trend").alias("method"), F.lit(norm_freq(freq)).alias("freq"),
                      F.col("history_periods").cast("long").alias("history_periods"),
                      "slope", "intercept", "step", "period", val.alias("value"))


def trend_fitted(df: DataFrame, periods: int = 30, freq: str = "D",
                 cols: ColumnMap | dict | None = None,
                 group_cols: Sequence[str] = ()) -> DataFrame:
    """F2b (v1) — unclipped line: fitted values over the history and the
    forecast.  Columns: *group_cols, kind ('fitted' | 'forecast'), period,
    actual (NULL for the forecast), value, slope, intercept.

    One pass over the series: slope and intercept are window aggregates per
    series, and the last period of each series explodes into itself plus the
    ``periods`` future points (no union, no second scan)."""
    g = list(group_cols)
    f = norm_freq(freq)
    s = series(df, freq, cols, g)
    w = Window.partitionBy(*g)
    s = s.withColumns({"slope": F.regr_slope("y", "t").over(w),
                       "intercept": F.regr_intercept("y", "t").over(w)}).where(F.col("n") >= 2)
    k = F.explode(F.when(F.col("t") == F.col("n") - 1, F.sequence(F.lit(0), F.lit(int(periods))))
                  .otherwise(F.array(F.lit(0))))
    s = s.select("*", k.alias("_k"))
    fitted = F.col("_k") == 0
    return s.select(
        *g, F.when(fitted, F.lit("fitted")).otherwise(F.lit("forecast")).alias("kind"),
        F.when(fitted, F.col("period")).otherwise(
            period_end(offset_start(F.col("period_start"), f, F.col("_k")), f)).alias("period"),
        F.when(fitted, F.col("y")).alias("actual"),
        (F.col("slope") * (F.col("t") + F.col("_k")) + F.col("intercept")).alias("value"),
        "slope", "intercept")


def ses(df: DataFrame, periods: int = 30, alpha: float = 0.3, freq: str = "D",
        cols: ColumnMap | dict | None = None, group_cols: Sequence[str] = ()) -> DataFrame:
    """F3 — simple exponential smoothing (s1 = y1, s = a*y + (1-a)*s), flat forecast.

    The final level is a weighted sum, (1-a)^(n-1)*y1 + sum_{i>=2} a(1-a)^(n-i)*y_i,
    so it is one grouped aggregate: no sequential fold, no collected list.
    """
    g = list(group_cols)
    s = sums(df, freq, cols, g)
    a = float(alpha)
    wgt = F.pow(F.lit(1.0 - a), (F.col("n") - 1 - F.col("t")).cast("double")) * \
        F.when(F.col("t") == 0, F.lit(1.0)).otherwise(F.lit(a))
    stats = s.groupBy(*g).agg(F.sum(wgt * F.col("y")).alias("value"),
                              F.max("period_start").alias("_last"),
                              F.max("n").alias("history_periods")) \
        .where(F.col("history_periods").isNotNull())
    return (_future(stats, freq, periods, g)
            .select(*g, F.lit("ses").alias("method"), F.lit(norm_freq(freq)).alias("freq"),
                    F.col("history_periods").cast("long").alias("history_periods"),
                    "step", "period", "value"))


#: Periods that one task folds at once.
BLOCK = 1024


_STATE = ("l", "b", "a11", "a12", "a21", "a22", "s", "g1", "g2", "h11", "h12", "h22")


def _block_map(ys, rl, rb, alpha: float, beta):
    """What the periods ``ys`` do to Holt's state (level l, trend b), as a struct.

    A step is affine in the state and its error is linear in it, so the periods map a state
    that starts at d = (l, b) - (rl, rb) from the reference state to (l, b) + A d, with a
    squared error of s - 2 g.d + d'H d; all of these are folded along the periods.
    """
    a = F.lit(float(alpha))
    zero, one = F.lit(0.0), F.lit(1.0)
    init = F.struct(*[x.alias(n) for n, x in zip(_STATE, (rl, rb, one, zero, zero, one, *[zero] * 6), strict=True)])

    def step(acc, y):
        pred = acc["l"] + acc["b"]
        err = y - pred
        level = a * y + (one - a) * pred
        p1, p2 = acc["a11"] + acc["a21"], acc["a12"] + acc["a22"]  # the prediction moves by p.d
        n11, n12 = (one - a) * p1, (one - a) * p2
        after = (level, beta * (level - acc["l"]) + (one - beta) * acc["b"], n11, n12,
                 beta * (n11 - acc["a11"]) + (one - beta) * acc["a21"], beta * (n12 - acc["a12"]) + (one - beta) * acc["a22"],
                 acc["s"] + err * err, acc["g1"] + err * p1, acc["g2"] + err * p2,
                 acc["h11"] + p1 * p1, acc["h12"] + p1 * p2, acc["h22"] + p2 * p2)
        return F.struct(*[x.alias(n) for n, x in zip(_STATE, after, strict=True)])

    return F.aggregate(ys, init, step, lambda m: F.struct(rl.alias("rl"), rb.alias("rb"), *[m[n].alias(n) for n in _STATE]))


def _moved(acc, m):
    """The state (sse, l, b) after a block."""
    d1, d2 = acc["l"] - m["rl"], acc["b"] - m["rb"]
    sse = m["s"] - 2 * (m["g1"] * d1 + m["g2"] * d2) + m["h11"] * d1 * d1 + 2 * m["h12"] * d1 * d2 + m["h22"] * d2 * d2
    return F.struct((acc["sse"] + F.greatest(sse, F.lit(0.0))).alias("sse"), (m["l"] + m["a11"] * d1 + m["a12"] * d2).alias("l"),
                    (m["b"] + m["a21"] * d1 + m["a22"] * d2).alias("b"))


def _holt_fits(s: DataFrame, g: list[str], alpha: float, beta: float | None, beta_grid: int) -> DataFrame:
    """Best Holt fit of each series (smallest squared error, then smallest beta):
    *g, _h (struct of sse, beta, l, b).

    Blocks of ``BLOCK`` periods are folded for each beta in tasks of their own, from a
    reference state: the true start in the first block, the first value without a trend in
    the others.  Their maps are applied to the start one after another, so no task holds a
    series.  Blocks without data aren't made: one map of an empty block stands for all.
    """
    zero = F.lit(0.0)
    if beta is None:
        betas = F.transform(F.sequence(F.lit(0), F.lit(beta_grid - 1)), lambda i: i.cast("double") / F.lit(float(beta_grid - 1)))
    else:
        betas = F.array(F.lit(float(beta)))
    block = F.greatest(F.lit(0), F.floor((F.col("t") - 1) / F.lit(BLOCK)))  # t = 0 is the start of the first
    blocks = s.where(F.col("n") >= 2).groupBy(*g, block.alias("_block")).agg(
        F.map_from_entries(F.collect_list(F.struct("t", "y"))).alias("_has"), F.max("n").alias("n"))  # BLOCK + 1 values at most
    first = F.col("_block") == 0
    low = F.when(first, 0).otherwise(F.col("_block") * BLOCK + 1)
    all_t = F.sequence(low.cast("bigint"), F.least((F.col("_block") + 1) * BLOCK, F.col("n") - 1))
    blocks = blocks.select(*g, "_block", F.transform(all_t, lambda t: F.coalesce(F.try_element_at("_has", t), zero)).alias("_ys"))
    blocks = blocks.select(*g, "_block", "_ys", F.explode(betas).alias("_beta"))
    y0, y1 = F.get("_ys", F.lit(0)), F.get("_ys", F.lit(1))
    folded = _block_map(F.when(first, F.slice("_ys", 2, F.size("_ys"))).otherwise(F.col("_ys")), y0, F.when(first, y1 - y0).otherwise(0.0),
                        alpha, F.col("_beta"))
    blocks = blocks.select(*g, "_beta", F.col("_block").alias("block"), folded.alias("map"))
    # a row per block: a daily series of ten thousand years has 3,600
    maps = blocks.groupBy(*g, "_beta").agg(F.array_sort(F.collect_list(F.struct("block", "map"))).alias("_maps"))
    gaps = F.element_at("_maps", -1)["block"] >= F.size("_maps")
    empty = F.when(gaps, _block_map(F.array_repeat(zero, BLOCK), zero, zero, alpha, F.col("_beta")))
    maps = maps.withColumn("_empty", empty)
    start = F.get("_maps", F.lit(0))["map"]

    def follow(acc, e):
        passed = F.when(e["block"] > acc["next"], F.aggregate(
            F.sequence(acc["next"], e["block"] - 1), acc["state"], lambda x, _: _moved(x, F.col("_empty")))).otherwise(acc["state"])
        return F.struct((e["block"] + 1).alias("next"), _moved(passed, e["map"]).alias("state"))

    init = F.struct(F.lit(0).cast("bigint").alias("next"), F.struct(zero.alias("sse"), start["rl"].alias("l"), start["rb"].alias("b")).alias("state"))
    end = F.aggregate("_maps", init, follow, lambda acc: acc["state"])
    fit = maps.select(*g, "_beta", end.alias("_e")).select(
        *g, F.struct(F.col("_e.sse").alias("sse"), F.col("_beta").alias("beta"), F.col("_e.l").alias("l"), F.col("_e.b").alias("b")).alias("_h"))
    return fit.groupBy(*g).agg(F.min("_h").alias("_h"))


def _with_fits(stats: DataFrame, fits: DataFrame, g: list[str]) -> DataFrame:
    """The series' figures with their fit; a series without one has NULL."""
    if not g:
        return attach_one_row(stats, fits)
    fits = fits.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(g)], "_h")
    same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(g)]
    return stats.join(fits, same, "left").drop(*[f"_{i}" for i in range(len(g))])


def holt(df: DataFrame, periods: int = 30, alpha: float = 0.3, freq: str = "D",
         cols: ColumnMap | dict | None = None, *, beta: float | None = None,
         beta_grid: int = 101, group_cols: Sequence[str] = ()) -> DataFrame:
    """F4 — Holt's additive-trend smoothing with a fixed level weight ``alpha``.

    Start l1 = y1, b1 = y2 - y1; l = a*y + (1-a)(l+b); b = B(l - l_prev) + (1-B) b.
    ``beta`` fixed, or chosen on an even grid of ``beta_grid`` values in [0, 1]
    by the smallest one-step-ahead squared error (our own fitting rule; the
    reference delegates to a maximum-likelihood library).  Blocks of periods are folded
    apart and put together (:func:`_holt_fits`).  Forecast h: l_n + h*b_n.  Needs n >= 2.
    """
    g = list(group_cols)
    s = sums(df, freq, cols, g)
    stats = s.groupBy(*g).agg(F.max("period_start").alias("_last"), F.max("n").alias("history_periods")).where(F.col("history_periods") >= 2)
    fut = _future(_with_fits(stats, _holt_fits(s, g, alpha, beta, beta_grid), g), freq, periods, g)
    return fut.select(*g, F.lit("holt").alias("method"), F.lit(norm_freq(freq)).alias("freq"),
                      F.col("history_periods").cast("long").alias("history_periods"),
                      F.col("_h")["beta"].alias("beta"), "step", "period",
                      (F.col("_h")["l"] + F.col("step") * F.col("_h")["b"]).alias("value"))


def evaluate(df: DataFrame, method: str = "ma", train_ratio: float = 0.8, freq: str = "D",
             cols: ColumnMap | dict | None = None, *, window: int = 7,
             group_cols: Sequence[str] = ()) -> DataFrame:
    """F6 — hold-out evaluation: train = first int(ratio*n) periods, test = rest.

    ``ma``: prediction = train mean for the first ``window`` test points, then
    (sum of the last ``window`` train values + window*mean) / (c + window) —
    the closed form of the reference's recursive rule (c = min(window, train
    size)).  ``trend``: least squares on the train part.  Other methods: no rows.
    Columns: *group_cols, method, n_train, n_test, mae, rmse, mape (%, over
    non-zero actuals), mape_skipped, r2.
    """
    if method not in ("ma", "trend"):
        return df.sparkSession.createDataFrame(
            [], "method string, n_train long, n_test long, mae double, rmse double, "
                "mape double, mape_skipped long, r2 double")
    g = list(group_cols)
    s = series(df, freq, cols, g).withColumn(
        "_split", F.floor(F.col("n") * F.lit(float(train_ratio))).cast("long"))
    # the training statistics are window aggregates over each (short) series,
    # so the series is computed once and no join is needed
    w = Window.partitionBy(*g)
    is_train = F.col("t") < F.col("_split")
    ty, tt = F.when(is_train, F.col("y")), F.when(is_train, F.col("t"))
    fit = {"_m": F.avg(ty).over(w), "n_train": F.count(ty).over(w)}
    if method == "ma":
        last = is_train & (F.col("t") >= F.col("_split") - window)
        fit["_sw"] = F.sum(F.when(last, F.col("y"))).over(w)
        fit["_cw"] = F.count(F.when(last, 1)).over(w)
    else:
        fit["_b"] = F.regr_slope(ty, tt).over(w)
        fit["_a"] = F.regr_intercept(ty, tt).over(w)
    test = s.withColumns(fit).where(~is_train)
    if method == "ma":
        i = F.col("t") - F.col("_split")
        pred = F.when(i < window, F.col("_m")).otherwise(
            (F.col("_sw") + F.lit(float(window)) * F.col("_m")) / (F.col("_cw") + F.lit(window)))
    else:
        pred = F.col("_b") * F.col("t") + F.col("_a")
    e = F.col("y") - F.col("_p")
    scored = test.withColumn("_p", pred)
    tot = scored.groupBy(*g).agg(
        F.first("n_train").alias("n_train"), F.count(F.lit(1)).alias("n_test"),
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.when(F.col("y") != 0, F.abs(e / F.col("y")))) * F.lit(100.0)).alias("mape"),
        F.count(F.when(F.col("y") == 0, 1)).alias("mape_skipped"),
        F.sum(e * e).alias("_ssr"), F.var_pop("y").alias("_vy"))
    sst = F.col("_vy") * F.col("n_test")
    r2 = F.when(sst > 0, F.lit(1.0) - F.col("_ssr") / sst).otherwise(
        F.when(F.col("_ssr") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return tot.where(F.col("n_test") > 0).select(
                      *g, F.lit(method).alias("method"), F.col("n_train").cast("long"),
                      "n_test", "mae", "rmse", "mape", "mape_skipped", r2.alias("r2"))


def compare(df: DataFrame, periods: int = 30, freq: str = "D",
            cols: ColumnMap | dict | None = None, group_cols: Sequence[str] = (),
            window: int = 7, alpha: float = 0.3) -> DataFrame:
    """F7 — moving average, Holt and the unclipped trend side by side.

    A grouped aggregate per series yields the tail mean and the least-squares line, the Holt
    fits come from blocks of the series; the future steps are then exploded.
    Columns: *group_cols, method, step, period, value.
    """
    g = list(group_cols)
    s = sums(df, freq, cols, g)
    stats = _line(s, g, _tail_mean(window).alias("_ma")).withColumnsRenamed({"slope": "_slope", "intercept": "_icpt"})
    stats = stats.where(F.col("history_periods").isNotNull())
    stats = _with_fits(stats, _holt_fits(s, g, alpha, None, 101), g)
    fut = _future(stats, freq, periods, g)
    x = F.col("history_periods") - 1 + F.col("step")
    methods = F.array(
        F.struct(F.lit("moving_average").alias("method"), F.col("_ma").alias("value")),
        F.struct(F.lit("holt").alias("method"),
                 (F.col("_h")["l"] + F.col("step") * F.col("_h")["b"]).alias("value")),
        F.struct(F.lit("linear_trend").alias("method"),
                 (F.col("_slope") * x + F.col("_icpt")).alias("value")))
    return (fut.select(*g, "step", "period", F.explode(methods).alias("_m"))
            .where(F.col("_m")["value"].isNotNull())
            .select(*g, F.col("_m")["method"].alias("method"), "step", "period",
                    F.col("_m")["value"].alias("value")))


#: Forecast methods of this module: moving average, exponential smoothing (simple, with trend), line.
METHODS = ("ma", "ses", "holt", "trend")


def input_summary(df: DataFrame, cols: ColumnMap | dict | None = None) -> DataFrame:
    """F8 — the methods there are, date range and record count of the forecast input."""
    led = to_logical(df, cols, ["date"], ["date"])
    d = as_timestamp(F.col("date"))
    fmt = "yyyy-MM-dd HH:mm:ss"
    return led.agg(F.count(F.lit(1)).alias("total_records"),
                   F.min(d).alias("_d0"), F.max(d).alias("_d1")).select(
        F.array(*[F.lit(m) for m in METHODS]).alias("methods_available"),
        F.concat(F.date_format("_d0", fmt), F.lit(" 至 "), F.date_format("_d1", fmt))
        .alias("data_range"), "total_records")
