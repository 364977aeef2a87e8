"""Rule-based written report (N1-N4) as DataFrames.

The report is a set of rows ``(section, pos, text)`` built from the one-row KPI
summary and the first drop / first spike among the anomaly alerts: all
conditional string expressions, no Python loop over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.functions.joins import attach_one_row

# The report's section headings, in order.
SECTIONS = ("overview", "highlights", "risks", "recommendations")
HEADINGS = {"overview": "整体概览", "highlights": "亮点", "risks": "风险",
            "recommendations": "建议"}

# The report's sentences, with {} where a figure goes.
TEXTS = {
    "span": "{} 至 {} 期间，共 {} 笔订单、{} 名客户，总收入 CNY{}，平均客单 CNY{}{}。",
    "growth": "，环比首月增长 {}%",
    "unknown": "未知",
    "top_category": "品类 Top1：{} 贡献 CNY{}",
    "top_region": "区域 Top1：{} 贡献 CNY{}",
    "expanding": "末月较首月增长 {}%，业务在扩张",
    "drop": "{} 出现异常下跌（实际 CNY{}，预期 CNY{}，z={}）",
    "shrinking": "末月较首月下降 {}%，需排查原因",
    "few_orders": "人均订单数低，复购率有提升空间",
    "push_category": "加大 {} 类目库存 / 营销投放",
    "check_drop": "排查异常下跌时段的因素（促销 / 库存 / 渠道）",
    "review_spike": "复盘 {} 异常增长动因，看能否复制",
    "carry_on": "继续维持现有运营节奏，关注下期数据",
}


def sentence(name: str, *figures: Column) -> Column:
    """The sentence ``name`` with its figures filled in; NULL if one of them is."""
    parts = TEXTS[name].split("{}")
    out = [F.lit(parts[0])]
    for figure, part in zip(figures, parts[1:], strict=True):
        out += [figure, F.lit(part)]
    return F.concat(*out)


def money0(x: Column) -> Column:
    """Python ``f'{x:,.0f}'`` (half-even, thousands separators)."""
    return F.format_number(x, 0)


def signed1(x: Column) -> Column:
    """Python ``f'{x:+.1f}'``; Java rounds half-up, so round half-even first."""
    return F.format_string("%+.1f", F.rint(x * F.lit(10.0)) / F.lit(10.0))


def fixed(x: Column, n: int) -> Column:
    scale = float(10 ** n)
    return F.format_string(f"%.{n}f", F.rint(x * F.lit(scale)) / F.lit(scale))


def _first_alerts(alerts: DataFrame) -> DataFrame:
    """First drop and first spike (by period) in one aggregate: ``_d``, ``_s``."""
    alert = F.struct("period", "actual", "expected", "z_score")
    first = {}
    for name, direction in (("_d", "drop"), ("_s", "spike")):
        first[name] = F.min_by(alert, F.when(F.col("direction") == direction, F.col("period")))
    return alerts.agg(*[c.alias(n) for n, c in first.items()])


def commentary_report(summary: DataFrame, alerts: DataFrame) -> DataFrame:
    """N1 — one row: overview (string) and highlights / risks / recommendations
    (arrays), following the reference's rules."""
    s = attach_one_row(summary, _first_alerts(alerts))
    g = F.col("growth_first_to_last_month")
    n_orders, n_cust = F.col("total_orders"), F.col("n_customers")
    growth_str = F.when(g.isNotNull(), sentence("growth", signed1(g))).otherwise(F.lit(""))
    unknown = F.lit(TEXTS["unknown"])
    overview = sentence(
        "span", F.coalesce(F.col("date_start"), unknown), F.coalesce(F.col("date_end"), unknown), n_orders.cast("string"),
        n_cust.cast("string"), money0(F.col("total_revenue")), money0(F.col("avg_order_value")), growth_str)
    top_cat, top_reg = F.col("top_category"), F.col("top_region")
    has_cat = top_cat.isNotNull() & (top_cat != "")
    has_reg = top_reg.isNotNull() & (top_reg != "")
    d, sp = F.col("_d"), F.col("_s")

    def day(x):
        return F.date_format(x["period"], "yyyy-MM-dd")

    highlights = [
        F.when(has_cat, sentence("top_category", top_cat, money0(F.col("top_category_revenue")))),
        F.when(has_reg, sentence("top_region", top_reg, money0(F.col("top_region_revenue")))),
        F.when(g > 10, sentence("expanding", signed1(g))),
    ]
    risks = [
        F.when(d.isNotNull(), sentence("drop", day(d), money0(d["actual"]), money0(d["expected"]), fixed(d["z_score"], 2))),
        F.when(g < -10, sentence("shrinking", fixed(g, 1))),
        F.when((n_cust > 0) & (n_orders / n_cust < 1.2), sentence("few_orders")),
    ]
    recs = [
        F.when(has_cat, sentence("push_category", top_cat)),
        F.when(d.isNotNull(), sentence("check_drop")),
        F.when(sp.isNotNull(), sentence("review_spike", day(sp))),
    ]

    def compact(items):
        return F.filter(F.array(*items), lambda x: x.isNotNull())

    rec_arr = compact(recs)
    rec_arr = F.when(F.size(rec_arr) == 0, F.array(sentence("carry_on"))) \
        .otherwise(rec_arr)
    return s.select(overview.alias("overview"), compact(highlights).alias("highlights"),
                    compact(risks).alias("risks"), rec_arr.alias("recommendations"),
                    F.lit("heuristic").alias("backend"))


def report_rows(report: DataFrame) -> DataFrame:
    """N1 as rows: (section, pos, text), pos counted from 0 within a section.
    One projection and one explode — the report is computed once."""
    def entries(sec):
        return F.transform(F.col(sec), lambda x, i: F.struct(
            F.lit(sec).alias("section"), i.cast("long").alias("pos"), x.alias("text")))
    first = F.array(F.struct(F.lit("overview").alias("section"), F.lit(0).cast("long").alias("pos"),
                             F.col("overview").alias("text")))
    allrows = F.concat(first, *[entries(sec) for sec in SECTIONS[1:]])
    return report.select(F.explode(allrows).alias("_r")).select("_r.section", "_r.pos", "_r.text")


def markdown(report: DataFrame) -> DataFrame:
    """N4 — the report as one Markdown string; empty sections are omitted."""
    def block(sec):
        items = F.transform(F.col(sec), lambda x: F.concat(F.lit("- "), x))
        return F.when(F.size(sec) > 0, F.concat(
            F.array(F.lit(f"## {HEADINGS[sec]}"), F.lit("")), items,
            F.array(F.lit("")) if sec != "recommendations" else F.array()))\
            .otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.array(F.lit(f"## {HEADINGS['overview']}"), F.lit(""), F.col("overview"),
                             F.lit("")),
                     block("highlights"), block("risks"), block("recommendations"))
    return report.select(F.array_join(lines, "\n").alias("markdown"), "backend")


def _top_list(df: DataFrame, key: str, k: int, desc: bool, name: str) -> DataFrame:
    """First ``k`` rows by ``key`` (ties: the other columns) as one array column.

    A TakeOrdered of k rows (bounded per task), then a sort of those k."""
    other = [c for c in df.columns if c != key]
    order = ([F.desc(key)] if desc else [F.asc(key)]) + [F.asc(c) for c in other]
    top = df.orderBy(*order).limit(k)
    place = F.row_number().over(Window.orderBy(*order))  # k rows
    return top.select(F.struct(place.alias("_at"), F.struct(*df.columns).alias("row")).alias("_s")).agg(
        F.transform(F.array_sort(F.collect_list("_s")), lambda x: x["row"]).alias(name))


def payload(summary: DataFrame, trend: DataFrame, alerts: DataFrame,
            category: DataFrame, region: DataFrame) -> DataFrame:
    """N2 — the request payload as one JSON string: the summary, the last 6
    trend points, the first 3 alerts, and the top-5 categories and regions as
    ``{name: revenue}`` objects in descending order.  Null fields stay.
    Every list is a bounded top-k, never a full collect."""
    last6 = _top_list(trend, "period", 6, True, "trend_last_6").select(
        F.reverse("trend_last_6").alias("trend_last_6"))
    first3 = _top_list(alerts, "period", 3, False, "anomalies_top_3")

    def totals(df: DataFrame, key: str) -> DataFrame:
        name = f"{key}_breakdown_top5"
        top = _top_list(df.select("revenue", F.col(key).cast("string").alias(key)), "revenue", 5, True, name)
        return top.select(F.map_from_entries(F.transform(name, lambda x: F.struct(x[key], x["revenue"]))).alias(name))

    j = summary.select(F.struct(*summary.columns).alias("summary"))
    for part in (last6, first3, totals(category, "category"), totals(region, "region")):  # each a one-row aggregate
        j = attach_one_row(j, part)
    return j.select(F.to_json(F.struct(
        "summary", "trend_last_6", "anomalies_top_3",
        "category_breakdown_top5", "region_breakdown_top5"), {"ignoreNullFields": "false"}).alias("payload"))


def _strip(text: Column) -> Column:
    """Python ``str.strip()``: all (Unicode) whitespace, not only spaces."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_fences(text: Column) -> Column:
    """Remove a leading ```(json) line and a trailing ``` fence, then strip."""
    t = _strip(text)
    stripped = F.regexp_replace(F.regexp_replace(t, r"^```(?:json)?\s*\n", ""), r"\n?```\s*$", "")
    return _strip(F.when(t.startswith("```"), stripped).otherwise(t))


def _items(entries: Column) -> Column:
    """List items as text, without those that are false in Python (null, "", 0, false)."""

    def kind(x):
        return F.schema_of_variant(x)

    def text(x):
        return F.variant_get(x, "$", "string")

    kept = F.filter(F.coalesce(entries, F.array().cast("array<variant>")), lambda x: x.isNotNull() & ~F.is_variant_null(x)
                    & F.when(kind(x) == "STRING", text(x) != "").when(kind(x) == "BOOLEAN", text(x) == "true")
                    .when(kind(x).isin("BIGINT", "DOUBLE") | kind(x).startswith("DECIMAL"), F.variant_get(x, "$", "double") != 0)
                    .otherwise(True))
    return F.transform(kept, lambda x: F.when(kind(x) == "BOOLEAN", F.lit("True")).otherwise(text(x)))


def parse_response(responses: DataFrame, text_col: str, fallback: DataFrame, backend: str = "llm") -> DataFrame:
    """N3 — parse model responses (JSON, maybe fenced) into report fields.

    A text that is one JSON object, and nothing else, gives its fields: no overview
    is an empty text, list items that are false are dropped, and the backend is
    ``llm:<backend>``.  Any other text falls back to the rule report ``fallback``,
    the output of :func:`commentary_report`; its fields are NULL where that has no row
    (an empty ledger).
    """
    body = strip_fences(F.col(text_col))
    # as the one element of an array: text before or after the object is an error
    fields = "array<struct<overview: string, highlights: array<variant>, risks: array<variant>, recommendations: array<variant>>>"
    whole = F.from_json(F.concat(F.lit("["), body, F.lit("]")), fields, {"allowSingleQuotes": "false"})
    parsed = F.when(body.startswith("{") & body.endswith("}") & (F.size(whole) == 1), F.get(whole, F.lit(0)))
    r = attach_one_row(responses.withColumn("_p", parsed),
                       fallback.select(*[F.col(c).alias(f"_fb_{c}") for c in SECTIONS]), may_be_empty=True)
    ok = F.col("_p").isNotNull()
    keep = [c for c in responses.columns if c != text_col]
    return r.select(*keep,
                    F.when(ok, F.coalesce(F.col("_p")["overview"], F.lit(""))).otherwise(F.col("_fb_overview")).alias("overview"),
                    *[F.when(ok, _items(F.col("_p")[c])).otherwise(F.col(f"_fb_{c}")).alias(c) for c in SECTIONS[1:]],
                    F.when(ok, F.lit(f"llm:{backend}")).otherwise(F.lit("heuristic")).alias("backend"))
