"""DuckDB SQL fragments shared by the oracle queries (period maths, rounding)."""

from __future__ import annotations

_START = {
    "D": "CAST({d} AS DATE)",
    "W": "CAST(date_trunc('week', {d}) AS DATE)",
    "M": "CAST(date_trunc('month', {d}) AS DATE)",
    "Q": "CAST(date_trunc('quarter', {d}) AS DATE)",
    "Y": "CAST(date_trunc('year', {d}) AS DATE)",
}
_END = {
    "D": "{s}",
    "W": "CAST({s} + INTERVAL 6 DAY AS DATE)",
    "M": "last_day({s})",
    "Q": "last_day(CAST({s} + INTERVAL 2 MONTH AS DATE))",
    "Y": "last_day(CAST({s} + INTERVAL 11 MONTH AS DATE))",
}
_STEP = {"D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAY", "M": "INTERVAL 1 MONTH",
         "Q": "INTERVAL 3 MONTH", "Y": "INTERVAL 12 MONTH"}


def start(freq: str, d: str = "date") -> str:
    return _START[freq].format(d=d)


def end(freq: str, s: str = "ps") -> str:
    return _END[freq].format(s=s)


def step(freq: str) -> str:
    return _STEP[freq]


def msum(x: str, scale: int = 4) -> str:
    """Exact money sum as DOUBLE (0.0 when empty), as ``money_sum`` in Spark."""
    return f"COALESCE(CAST(SUM(CAST({x} AS DECIMAL(18,{scale}))) AS DOUBLE), 0.0)"


def r(x: str, n: int = 2) -> str:
    """pandas ``round(n)``: half-even on x*10^n."""
    return f"(round_even(({x}) * {10 ** n}.0, 0) / {10 ** n}.0)"


def div(a: str, b: str) -> str:
    return f"(({a}) / NULLIF(({b}), 0))"


def resample_ctes(src: str, freq: str, prefix: str = "s", value: str = "amount") -> str:
    """CTEs ``{prefix}_agg``, ``{prefix}_spine``, ``{prefix}`` (ps, period, revenue, n_orders)."""
    return f"""{prefix}_agg AS (
  SELECT {start(freq)} AS ps, {msum(value)} AS revenue, COUNT({value}) AS n_orders
  FROM {src} WHERE date IS NOT NULL GROUP BY 1),
{prefix}_spine AS (
  SELECT CAST(unnest(generate_series(lo, hi, {step(freq)})) AS DATE) AS ps
  FROM (SELECT CAST(MIN(ps) AS TIMESTAMP) AS lo, CAST(MAX(ps) AS TIMESTAMP) AS hi FROM {prefix}_agg)),
{prefix} AS (
  SELECT sp.ps, {end(freq, 'sp.ps')} AS period, COALESCE(a.revenue, 0.0) AS revenue,
         CAST(COALESCE(a.n_orders, 0) AS BIGINT) AS n_orders
  FROM {prefix}_spine sp LEFT JOIN {prefix}_agg a ON sp.ps = a.ps)"""


def grouped_ctes(src: str, freq: str, key: str, value: str = "amount") -> str:
    """``s`` (key, ps, period, revenue, n_orders): a gap-filled series per ``key``."""
    return f"""s_agg AS (
  SELECT {key}, {start(freq)} AS ps, {msum(value)} AS revenue, COUNT({value}) AS n_orders
  FROM {src} WHERE date IS NOT NULL AND {key} IS NOT NULL GROUP BY 1, 2),
s_spine AS (
  SELECT {key}, CAST(unnest(generate_series(lo, hi, {step(freq)})) AS DATE) AS ps
  FROM (SELECT {key}, CAST(MIN(ps) AS TIMESTAMP) AS lo, CAST(MAX(ps) AS TIMESTAMP) AS hi FROM s_agg GROUP BY 1)),
s AS (
  SELECT sp.{key}, sp.ps, {end(freq, 'sp.ps')} AS period, COALESCE(a.revenue, 0.0) AS revenue,
         CAST(COALESCE(a.n_orders, 0) AS BIGINT) AS n_orders
  FROM s_spine sp LEFT JOIN s_agg a ON sp.{key} = a.{key} AND sp.ps = a.ps)"""
