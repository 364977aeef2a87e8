import datetime as dt
import math
import random

import numpy as np
import pytest

from conftest import C, collect, make_ledger
from kpiforge.operators import forecast as fc


def series_ledger(spark, values, start=dt.datetime(2024, 1, 1), skip=()):
    rows = [(start + dt.timedelta(days=i), float(v), 1, "a", "x", "c")
            for i, v in enumerate(values) if i not in skip]
    return make_ledger(spark, rows)


@pytest.fixture(scope="module")
def linear60(spark):
    rnd = random.Random(1)
    vals = [1000 + 2000 * i / 59 + rnd.gauss(0, 50) for i in range(60)]
    return series_ledger(spark, vals), vals


def test_moving_average_flat(linear60):
    led, vals = linear60
    out = collect(fc.moving_average(led, periods=5, window=7), "step", "period", "value",
                  "history_periods")
    assert len(out) == 5
    assert all(v == pytest.approx(np.mean(vals[-7:])) for _, _, v, _ in out)
    assert out[0][1] == dt.date(2024, 3, 1) and out[-1][1] == dt.date(2024, 3, 5)
    assert out[0][3] == 60


def test_moving_average_short_series_uses_all(spark):
    led = series_ledger(spark, [1, 2, 3])
    out = collect(fc.moving_average(led, periods=2, window=7), "value")
    assert out == [(2.0,), (2.0,)]


def test_monthly_future_labels(spark):
    led = series_ledger(spark, [5] * 40, start=dt.datetime(2024, 1, 15))
    out = collect(fc.moving_average(led, periods=3, window=2, freq="M"), "period")
    assert out == [(dt.date(2024, 3, 31),), (dt.date(2024, 4, 30),), (dt.date(2024, 5, 31),)]


def test_trend_matches_polyfit_and_clips(linear60, spark):
    led, vals = linear60
    out = collect(fc.linear_trend(led, periods=7))
    slope, icpt = np.polyfit(np.arange(60), vals, 1)
    assert out[0]["slope"] == pytest.approx(slope)
    assert out[0]["value"] == pytest.approx(slope * 60 + icpt)
    down = series_ledger(spark, [100 - 10 * i for i in range(10)])
    assert all(r["value"] >= 0 for r in collect(fc.linear_trend(down, periods=20)))
    assert any(r["value"] < 0 for r in collect(fc.linear_trend(down, 20, clip=False)))


def test_trend_too_short(spark):
    assert fc.linear_trend(series_ledger(spark, [5.0])).count() == 0
    assert fc.moving_average(series_ledger(spark, [])).count() == 0


def test_gaps_are_zero_filled(spark):
    led = series_ledger(spark, list(range(1, 51)), skip={10, 20, 30})
    s = collect(fc.series(led, "D"), "t", "y")
    assert len(s) == 50 and dict(s)[10] == 0.0 and dict(s)[11] == 12.0


def test_ses_closed_form_equals_loop(spark):
    rnd = random.Random(5)
    vals = [round(100 + rnd.random() * 10, 2) for _ in range(30)]
    s = vals[0]
    for y in vals[1:]:
        s = 0.3 * y + 0.7 * s
    out = collect(fc.ses(series_ledger(spark, vals), periods=3, alpha=0.3), "value")
    assert all(v == pytest.approx(s) for (v,) in out)


def test_holt_continues_a_line(spark):
    led = series_ledger(spark, [10 + 3 * i for i in range(30)])
    out = collect(fc.holt(led, periods=4, alpha=0.3), "step", "value")
    for step, v in out:
        assert v == pytest.approx(10 + 3 * (29 + step), rel=1e-9)


def test_holt_fixed_beta_recursion(spark):
    vals = [5, 7, 6, 9, 12, 11, 15]
    lvl, b = vals[1], vals[1] - vals[0]
    lvl, b = float(vals[0]), float(vals[1] - vals[0])
    for y in vals[1:]:
        new = 0.3 * y + 0.7 * (lvl + b)
        b = 0.2 * (new - lvl) + 0.8 * b
        lvl = new
    out = collect(fc.holt(series_ledger(spark, vals), periods=2, alpha=0.3, beta=0.2), "value")
    assert out[0][0] == pytest.approx(lvl + b) and out[1][0] == pytest.approx(lvl + 2 * b)


def plain_holt(ys, alpha, betas):
    best = None
    for beta in betas:
        level, trend, sse = ys[0], ys[1] - ys[0], 0.0
        for y in ys[1:]:
            pred = level + trend
            new = alpha * y + (1 - alpha) * pred
            trend = beta * (new - level) + (1 - beta) * trend
            level, sse = new, sse + (y - pred) ** 2
        best = min(best or (math.inf,), (sse, beta, level, trend))
    return best


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_holt_from_blocks_equals_the_loop(spark, monkeypatch, block):
    monkeypatch.setattr(fc, "BLOCK", block)
    shapes = {"wave": [100 + 40 * math.sin(i / 5) + i % 7 for i in range(100)], "steps": [float(i // 9 * 50 + i * i % 13) for i in range(61)],
              "two": [5.0, 8.0], "one": [3.0], "flat": [6.5] * 40, "line": [2.0 + 3 * i for i in range(30)]}
    rows = [(dt.datetime(2023, 1, 1) + dt.timedelta(days=i), y, 1, "a", name, "c") for name, ys in shapes.items() for i, y in enumerate(ys)]
    led = make_ledger(spark, rows)
    for beta in (None, 0.35):
        got = collect(fc.holt(led, periods=3, alpha=0.4, beta=beta, beta_grid=21, group_cols=[C["region"]]), C["region"], "beta", "step", "value")
        want = []
        for name, ys in shapes.items():
            if len(ys) > 1:
                _, b, level, trend = plain_holt(ys, 0.4, [i / 20 for i in range(21)] if beta is None else [beta])
                # every trend weight fits a straight line, and rounding decides between them
                want += [(name, pytest.approx(b) if name != "line" or beta else got_beta(got, name), h, pytest.approx(level + h * trend)) for h in (1, 2, 3)]
        assert sorted(got) == sorted(want, key=lambda r: (r[0], r[2]))


def got_beta(got, name):
    return next(r[1] for r in got if r[0] == name)


def test_evaluate_ma_closed_form(spark):
    rnd = random.Random(9)
    vals = [round(100 + rnd.random() * 20, 2) for _ in range(100)]
    train, test = vals[:80], vals[80:]
    preds = []
    for i in range(len(test)):
        preds.append(np.mean(train) if i < 7 else np.mean(list(train[-7:]) + preds[:i]))
    mae = np.mean(np.abs(np.array(test) - preds))
    r = collect(fc.evaluate(series_ledger(spark, vals), "ma"))[0]
    assert r["mae"] == pytest.approx(mae) and r["n_train"] == 80 and r["n_test"] == 20
    ss_res = np.sum((np.array(test) - preds) ** 2)
    ss_tot = np.sum((np.array(test) - np.mean(test)) ** 2)
    assert r["r2"] == pytest.approx(1 - ss_res / ss_tot)
    assert fc.evaluate(series_ledger(spark, vals), "arima").count() == 0


def test_evaluate_trend(spark):
    vals = [2.0 * i + 1 for i in range(50)]
    r = collect(fc.evaluate(series_ledger(spark, vals), "trend"))[0]
    assert r["mae"] == pytest.approx(0.0, abs=1e-9) and r["r2"] == pytest.approx(1.0)


def test_compare_and_summary(linear60):
    led, _ = linear60
    out = collect(fc.compare(led, periods=5), "method")
    assert sorted(set(out)) == [("holt",), ("linear_trend",), ("moving_average",)]
    s = collect(fc.input_summary(led))[0]
    assert s["total_records"] == 60 and s["data_range"].startswith("2024-01-01 00:00:00 至 ")
    assert s["methods_available"] == list(fc.METHODS)


def test_empty_series_give_no_rows(spark):
    empty = series_ledger(spark, [])
    assert fc.ses(empty).count() == 0
    assert fc.evaluate(empty, "ma").count() == 0
    assert fc.holt(empty).count() == 0
