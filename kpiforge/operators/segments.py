"""Segmentation: ABC / Pareto, RFM scores and segments, k-means customers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kpiforge.functions.columns import ColumnMap, as_timestamp, nan_to_null, to_logical
from kpiforge.functions.cut import Cut
from kpiforge.functions.numeric import (days_between, money_sum, partial_total, round_half_even,
                                        safe_div, total_value)
from kpiforge.functions.joins import attach_one_row
from kpiforge.operators.ranking import global_rank, quintile, quintile_cuts, rows_at

# The reference's customer segment labels, best to worst, and the
# score thresholds (sum of three 1-5 scores) that select them.
SEGMENTS = ("重要价值客户", "重要发展客户", "一般客户", "低价值客户")
SEGMENT_THRESHOLDS = (12, 9, 6)
# ABC class limits on the rounded cumulative revenue share (%).
ABC_LIMITS = (70, 90)


def segment_label(total: Column) -> Column:
    """P7 — segment from the RFM total score."""
    a, b, c = SEGMENT_THRESHOLDS
    return (F.when(total >= a, F.lit(SEGMENTS[0])).when(total >= b, F.lit(SEGMENTS[1]))
            .when(total >= c, F.lit(SEGMENTS[2])).otherwise(F.lit(SEGMENTS[3])))


def abc_label(cum_pct: Column) -> Column:
    """P8 — A up to 70 %, B up to 90 %, else C (on the rounded share)."""
    return (F.when(cum_pct <= ABC_LIMITS[0], F.lit("A"))
            .when(cum_pct <= ABC_LIMITS[1], F.lit("B")).otherwise(F.lit("C")))


def _item_revenue(df: DataFrame, by: str | None, cols) -> tuple[DataFrame, int | None] | None:
    """(_key, _rev) per item: whole units (DECIMAL) with a declared scale, else the
    sum as it is; None when the item or amount column is absent."""
    cmap = ColumnMap.of(cols)
    key = by or cmap.category
    if key not in df.columns or cmap.amount not in df.columns:
        return None
    led = to_logical(df, cmap, ["amount"], ["amount"], keep=[key]).select(F.col(f"`{key}`").alias("_key"), "amount")
    rows = led.where(F.col("_key").isNotNull()).groupBy("_key").agg(partial_total(F.col("amount"), cmap.scale).alias("_rev"))
    return rows.select("_key", F.coalesce("_rev", F.lit(0)).alias("_rev")), cmap.scale


def _abc_rows(df: DataFrame, by: str | None, cols) -> tuple[DataFrame, int | None] | None:
    """_key, _rev, _total, cum_pct, abc_class per item; None without the columns."""
    made = _item_revenue(df, by, cols)
    if made is None:
        return None
    per, scale = made
    ranked = global_rank(per, [("_rev", False), ("_key", True)], sum_col="_rev")
    out = attach_one_row(ranked, per.agg(F.sum("_rev").alias("_total"))).where(F.col("_total") > 0)
    cum_pct = round_half_even(total_value(F.col("_cum"), scale) / total_value(F.col("_total"), scale) * F.lit(100.0))
    return out.withColumn("cum_pct", cum_pct).withColumn("abc_class", abc_label(F.col("cum_pct"))), scale


def abc_analysis(df: DataFrame, by: str | None = None,
                 cols: ColumnMap | dict | None = None) -> DataFrame:
    """G1 — Pareto classes: item, revenue, cum_pct (2 dp), abc_class.

    Items are ranked by revenue descending (ties: item ascending); the running
    share is exact where the ledger declares a scale.  Rows are returned unsorted.
    No rows when the ``by`` column is absent or total revenue <= 0.  ``by`` is a
    physical column name (default: the category column).
    """
    made = _abc_rows(df, by, cols)
    if made is None:
        return df.sparkSession.createDataFrame(
            [], "item string, revenue double, cum_pct double, abc_class string")
    rows, scale = made
    # no final global sort: at scale it would cost a second range shuffle of
    # the item table; (revenue desc, item asc) or cum_pct recovers the order
    return rows.select(F.col("_key").cast("string").alias("item"), total_value(F.col("_rev"), scale).alias("revenue"),
                       "cum_pct", "abc_class")


def abc_summary(df: DataFrame, by: str | None = None,
                cols: ColumnMap | dict | None = None) -> DataFrame:
    """A13 — for each of A, B, C: n_items, revenue, item_pct, revenue_pct (2 dp).

    Always three rows when the analysis is non-empty (a class without items has
    zeros); no rows otherwise.  The items are classed once; the totals are windows
    over the three class rows.
    """
    made = _abc_rows(df, by, cols)
    schema = "abc_class string, n_items long, revenue double, item_pct double, revenue_pct double"
    if made is None:
        return df.sparkSession.createDataFrame([], schema)
    rows, scale = made
    per = rows.agg(*[x.alias(f"{n}{c}") for c in "ABC" for n, x in (
        ("n", F.count(F.when(F.col("abc_class") == c, 1))), ("r", F.sum(F.when(F.col("abc_class") == c, F.col("_rev")))))],
        F.count(F.lit(1)).alias("_n"), F.sum("_rev").alias("_t"))
    per = per.where(F.col("_n") > 0).select("_n", "_t", F.explode(F.array(*[
        F.struct(F.lit(c).alias("abc_class"), F.col(f"n{c}").alias("n"), F.col(f"r{c}").alias("r")) for c in "ABC"])).alias("_c"))
    rev = total_value(F.col("_c.r"), scale)
    return per.select(
        "_c.abc_class", F.col("_c.n").cast("long").alias("n_items"), round_half_even(rev).alias("revenue"),
        F.coalesce(round_half_even(safe_div(F.col("_c.n"), F.col("_n")) * F.lit(100.0)), F.lit(0.0)).alias("item_pct"),
        F.coalesce(round_half_even(safe_div(rev, total_value(F.col("_t"), scale)) * F.lit(100.0)), F.lit(0.0))
        .alias("revenue_pct")).orderBy("abc_class")


def rfm_table(df: DataFrame, cols: ColumnMap | dict | None = None, *,
              frequency_of: str = "date", with_qty: bool = False) -> DataFrame:
    """Per-customer R (days since the customer's last purchase, relative to the
    latest date over *all* rows), F (non-NULL ``frequency_of`` values), M (sum).
    """
    wanted = ["date", "amount", "customer"] + (["order_id"] if frequency_of == "order_id" else []) \
        + (["qty"] if with_qty else [])
    led = to_logical(df, cols, wanted, wanted)
    led = led.withColumn("date", as_timestamp(F.col("date")))
    scale = ColumnMap.of(cols).scale
    aggs = [F.max("date").alias("_last"), F.count(frequency_of).alias("F"),
            money_sum(F.col("amount"), scale).alias("M")]
    if with_qty:
        aggs.append(money_sum(F.col("qty"), scale).alias("Q"))
    now = led.agg(F.max("date").alias("_now"))  # a pass over the date column alone
    per = attach_one_row(led.where(F.col("customer").isNotNull()).groupBy("customer").agg(*aggs), now)
    return per.withColumn("R", days_between(F.col("_now"), F.col("_last"))).drop("_now", "_last")


def rfm_segments(df: DataFrame, cols: ColumnMap | dict | None = None, *,
                 reverse_recency: bool = True, frequency_of: str = "date",
                 single_customer_scores: tuple[int, int, int] | None = None,
                 with_scores: bool = False) -> DataFrame:
    """G2 / G3 — RFM quintile scores and segment per customer.

    Each of R, F, M is ranked first-come (ties: customer key ascending, as the
    key-sorted groupby does) and cut into quintiles; R's labels are reversed by
    default (fewer days = better).  Only the four cut points per measure are
    looked up (:func:`quintile_cuts`); the customers are compared with them and
    never ranked.  ``reverse_recency=False, frequency_of="order_id"`` is the v1
    variant.  A single customer gets ``single_customer_scores`` (the reference's
    fallback binning).  Columns: customer, R, F, M, rfm_score, segment.
    """
    per = rfm_table(df, cols, frequency_of=frequency_of).where(F.col("R").isNotNull())
    both = attach_one_row(per, quintile_cuts(per, ["R", "F", "M"], "customer"))
    if single_customer_scores is None:
        single_customer_scores = (5, 1, 1) if reverse_recency else (3, 3, 3)
    scores = {}
    for c, alone in zip("RFM", single_customer_scores, strict=True):
        q = quintile(F.col(c), F.col("customer"), F.col(f"cuts_{c}"), F.col("n"), reverse=reverse_recency and c == "R")
        scores[f"{c}_score"] = F.when(F.col("n") == 1, F.lit(alone)).otherwise(q).cast("int")
    both = both.withColumns(scores)
    total = F.col("R_score") + F.col("F_score") + F.col("M_score")
    return both.select(F.col("customer").cast("string").alias("customer"),
                       F.col("R").cast("long").alias("R"), F.col("F").cast("long").alias("F"),
                       "M", total.cast("long").alias("rfm_score"),
                       segment_label(total).alias("segment"), *(list(scores) if with_scores else []))


def segment_counts(df: DataFrame, cols: ColumnMap | dict | None = None, **kw) -> DataFrame:
    """A14 — customers per segment."""
    return (rfm_segments(df, cols, **kw).groupBy("segment")
            .agg(F.count(F.lit(1)).alias("n_customers")))


def rfmq_features(df: DataFrame, cols: ColumnMap | dict | None = None) -> DataFrame:
    """C1 features — Recency, Frequency (non-NULL order ids), Monetary, Quantity."""
    t = rfm_table(df, cols, frequency_of="order_id", with_qty=True)
    return t.select("customer", F.col("R").alias("Recency"), F.col("F").alias("Frequency"),
                    F.col("M").alias("Monetary"), F.col("Q").alias("Quantity"))


FEATURES = ("Recency", "Frequency", "Monetary", "Quantity")


def _nearest(centres: list[tuple[int, list[float]]], field: str) -> str:
    """SQL for the number ``n`` of the nearest centre (the first of equals) or the squared
    distance ``d`` to it.  The centres are one array, so that rounds share their code."""
    flat = ", ".join(f"{v!r}D" for _, x in centres for v in x)
    each = ", ".join("struct(" + " + ".join(f"pow(_x{i} - _v[{at * len(x) + i}], 2)" for i in range(len(x))) + f" AS d, {n} AS n)"
                     for at, (n, x) in enumerate(centres))
    return f"array_min(array({each})).{field}".replace("_v[", f"array({flat})[")


def _observed(df: DataFrame, figures: dict[str, str]) -> dict:
    """Aggregates (name: SQL) of all rows by one job without a shuffle: tasks hand in their part of
    each figure, and nothing else."""
    seen = Observation()
    df.observe(seen, *[F.expr(c).alias(n) for n, c in figures.items()]).write.format("noop").mode("overwrite").save()
    return seen.get


def kmeans_customers(df: DataFrame, cols: ColumnMap | dict | None = None, *, n_clusters: int = 4,
                     starts: Sequence[str] = FEATURES, max_iter: int = 20, cut: Cut | None = None) -> tuple[DataFrame, DataFrame]:
    """C1 / A15 — k-means on standardised R, F, M, Q per customer.

    Lloyd's iterations from fixed starts instead of random ones: for each feature in
    ``starts`` the customers at evenly spaced ranks of it (ties by customer), all found
    in one selection.  A start ends when its centres stay or after ``max_iter`` rounds; the
    one with the smallest total squared distance wins.  A centre that loses all its
    customers is dropped.  Clusters are numbered by mean Monetary, the largest first.

    The features are written once to ``cut`` (by default one that lives as long as the
    application), so neither the rounds nor the result nor a lost executor repeats the ledger's
    aggregate.  A round is one job for all starts whose tasks hand in sums per centre.
    Returns (per-customer features with ``cluster``, per-cluster profile: mean features and
    customer count).
    """
    seen = Observation()
    figures = [F.count(F.lit(1)).alias("n")] + [f(F.col(c)).alias(f"{f.__name__}_{c}") for c in FEATURES for f in (F.avg, F.stddev_samp)]
    raw = (cut or Cut(df.sparkSession, "features")).table(rfmq_features(df, cols).observe(seen, *figures))
    scale = seen.get
    n, names = scale["n"], [f"_x{i}" for i in range(len(FEATURES))]
    feats = raw.withColumns({
        x: (F.col(c) - F.lit(scale[f"avg_{c}"])) / F.lit(scale[f"stddev_samp_{c}"]) if scale[f"stddev_samp_{c}"] else F.lit(0.0)
        for x, c in zip(names, FEATURES, strict=True)})
    centres: dict[int, list] = {}
    held = feats.persist()
    try:
        if n:
            share = F.transform(F.sequence(F.lit(0), F.lit(n_clusters - 1)), lambda i: 1 + F.floor((2 * i + 1) * F.lit(n) / F.lit(2 * n_clusters)))
            picked = rows_at(held, starts, "customer", lambda n: F.array_distinct(F.filter(share, lambda r: r <= n)), n).select("m", "b", "k")
            rows = held.join(F.broadcast(picked), F.col("customer") == F.col("k")).select("m", "b", *names).collect()
            for r in sorted(rows):  # a row per start and rank
                centres.setdefault(r["m"], []).append((len(centres.get(r["m"], [])), list(r[2:])))
        moving = set(centres)
        for _ in range(max_iter):
            if not moving:
                break
            near = held.selectExpr(*names, *[f"{_nearest(centres[k], 'n')} AS c{k}" for k in sorted(moving)])
            got = _observed(near, {f"n_{k}_{c}": f"count_if(c{k} = {c})" for k in moving for c, _ in centres[k]}
                            | {f"{x}_{k}_{c}": f"sum(CASE WHEN c{k} = {c} THEN {x} END)" for k in moving for c, _ in centres[k] for x in names})
            for k in sorted(moving):
                moved = [(c, [got[f"{x}_{k}_{c}"] / got[f"n_{k}_{c}"] for x in names]) for c, _ in centres[k] if got[f"n_{k}_{c}"]]
                if len(moved) == len(centres[k]) and all(
                        abs(a - b) <= 1e-12 for (_, p), (_, q) in zip(centres[k], moved, strict=True) for a, b in zip(p, q, strict=True)):
                    moving.discard(k)
                centres[k] = moved
        costs = _observed(held, {f"c{k}": f"sum({_nearest(centres[k], 'd')})" for k in centres}) if centres else {}
    finally:
        held.unpersist()
    best = min(((round(costs[f"c{k}"], 6), k) for k in centres), default=None)
    if best is None:
        labelled = raw.withColumn("cluster", F.lit(None).cast("long"))
    else:
        money = FEATURES.index("Monetary")
        order = sorted(centres[best[1]], key=lambda c: (-c[1][money], c[0]))
        near = F.expr(_nearest([(i, c) for i, (_, c) in enumerate(order)], "n"))
        labelled = feats.select("customer", *FEATURES, near.cast("long").alias("cluster"))
    profile = labelled.groupBy("cluster").agg(*[F.avg(c).alias(f"avg_{c}") for c in FEATURES],
                                              F.count(F.lit(1)).alias("n_customers"))
    return labelled, profile
