"""Indicator formulas, gaps, validation and signals on small fixtures."""

from __future__ import annotations

import datetime as dt
import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwell.functions.config import FetchError, IndicatorConfig, InvalidHistoryError
from tarnwell.operators import signals, timeseries
from tarnwell.sources import bars


def days(n, end=dt.date(2026, 10, 7)):
    out, d = [], end
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d -= dt.timedelta(days=1)
    return out[::-1]


SCHEMA = "series string, d date, open double, high double, low double, close double, volume double"


def history(spark, close, opens=None):
    ds = days(len(close))
    rows = []
    for i, c in enumerate(close):
        o = c if opens is None else opens[i]
        rows.append(("s", ds[i], o, None if c is None else c + 2, None if c is None else c - 2, c, 1000.0))
    return spark.createDataFrame(rows, SCHEMA)


def column(df, name):
    return [r[name] for r in df.orderBy("d").select("d", name).collect()]


LINEAR = [100 + 150 * i / 599 for i in range(600)]


def test_warm_up_and_sma(spark):
    x = timeseries.with_indicators(bars.validated(history(spark, LINEAR))).cache()
    sma = column(x, "SMA_50")
    assert sma[:49] == [None] * 49 and sma[49] == pytest.approx(np.mean(LINEAR[:50]))
    long_ = column(x, "SMA_200")
    assert long_[198] is None and long_[199] == pytest.approx(np.mean(LINEAR[:200]))
    macd, signal = column(x, "MACD"), column(x, "MACD_signal")
    assert macd[24] is None and macd[25] is not None and signal[32] is None and signal[33] is not None
    band = column(x, "BB_upper")
    assert band[19] == pytest.approx(np.mean(LINEAR[:20]) + 2 * np.std(LINEAR[:20]))


@pytest.mark.parametrize(("step", "want"), [(1, 100.0), (-1, 0.0), (0, 50.0)])
def test_rsi_edges(spark, step, want):
    got = column(timeseries.with_recursions(history(spark, [100.0 + step * i for i in range(60)])), "RSI")
    assert got[:14] == [None] * 14 and all(v == pytest.approx(want) for v in got[14:])


def test_rsi_recursion(spark):
    got = column(timeseries.with_recursions(history(spark, [float(x) for x in (100, 102, 101, 104, 102, 106, 105)]), IndicatorConfig(rsi_period=3)), "RSI")
    gain, loss = 5 / 3, 1 / 3
    assert got[3] == pytest.approx(100 - 100 / (1 + gain / loss))
    gain, loss = gain * 2 / 3, loss * 2 / 3 + 2 / 3
    assert got[4] == pytest.approx(100 - 100 / (1 + gain / loss))


def plain_recursions(closes, cfg):
    """EMA_fast, EMA_slow, MACD, MACD_signal and RSI of one series, day by day."""
    out, n = [], 0
    for x in closes:
        if x is None:
            n = 0
            out.append((None,) * 5)
            continue
        n += 1
        if n == 1:
            fast, slow, signal, moves = x, x, 0.0, []
        else:
            fast, slow = fast + 2 / (cfg.macd_fast + 1) * (x - fast), slow + 2 / (cfg.macd_slow + 1) * (x - slow)
            moves.append((max(x - last, 0.0), max(last - x, 0.0)))
        last, macd, p, rsi = x, fast - slow, cfg.rsi_period, None
        if n >= cfg.macd_slow:
            signal = macd if n == cfg.macd_slow else signal + 2 / (cfg.macd_signal + 1) * (macd - signal)
        if n > p:
            if n == p + 1:
                gain, loss = (sum(m[i] for m in moves) / p for i in (0, 1))
            else:
                gain, loss = gain + (moves[-1][0] - gain) / p, loss + (moves[-1][1] - loss) / p
            rsi = (100.0 if gain > 0 else 50.0) if loss == 0 else 100 - 100 / (1 + gain / loss)
        late = n >= cfg.macd_slow
        out.append((fast if n >= cfg.macd_fast else None, slow if late else None, macd if late else None, signal if n >= cfg.macd_slow + cfg.macd_signal - 1 else None, rsi))
    return out


@pytest.mark.parametrize(("cfg", "block_days"), [
    (IndicatorConfig(macd_fast=2, macd_slow=4, macd_signal=3, rsi_period=3), 7), (IndicatorConfig(macd_fast=2, macd_slow=4, macd_signal=3, rsi_period=9), 20), (IndicatorConfig(), 5), (IndicatorConfig(), 64), (IndicatorConfig(), 256),
])
def test_blocks_give_what_one_pass_gives(spark, cfg, block_days):
    """Series with and without gaps, days that are far apart, a null key, a column of a type without order."""
    rng, rows, want = random.Random(block_days), [], {}
    for series in ("whole", "few gaps", None, "flat"):
        day, x, days, closes = date(1969, 1, 1), 100.0, [], []
        for _ in range(300):
            day += timedelta(days=rng.choice([1, 1, 1, 3, 3, 40 if rng.random() < 0.05 else 1]))
            x *= math.exp(rng.gauss(0, 0.02))
            gone = series != "whole" and rng.random() < (0.01 if series == "few gaps" else 0.1)
            days.append(day)
            closes.append(None if gone else 100.0 if series == "flat" else x)
            rows.append((series, day, closes[-1], {"k": len(rows)}))
        want |= {(series, d): v for d, v in zip(days, plain_recursions(closes, cfg), strict=True)}
    rng.shuffle(rows)
    got = timeseries.with_recursions(spark.createDataFrame(rows, "series string, d date, close double, more map<string,int>"), cfg, block_days).collect()
    assert sorted(r["more"]["k"] for r in got) == list(range(len(rows)))
    for r in got:
        assert [r[c] for c in timeseries.RECURSIVE] == [v if v is None else pytest.approx(v, rel=1e-9, abs=1e-9) for v in want[r["series"], r["d"]]]


def test_one_long_series_is_many_tasks(spark):
    """300,000 days of one series without a gap: blocks are spread, nothing runs in Python, and the end is that of one pass."""
    days = spark.range(300_000).select(F.lit("one").alias("series"), F.date_add(F.lit("1500-01-01").cast("date"), F.col("id").cast("int")).alias("d"), (100 + F.sin("id") * 10 + F.pmod(F.xxhash64("id"), F.lit(7))).alias("close"))
    x = timeseries.with_recursions(days)
    plan = x._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Window" not in plan
    last = x.orderBy(F.col("d").desc()).first()
    closes = [r["close"] for r in days.orderBy("d").collect()[-3000:]]
    assert [last[c] for c in timeseries.RECURSIVE] == pytest.approx(plain_recursions(closes, IndicatorConfig())[-1], rel=1e-9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [len(p) for p in timeseries.with_recursions(days).select("RSI").rdd.glom().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 0.5 * sum(sizes) == 150_000


def test_indicators_of_no_rows(spark):
    none = timeseries.with_indicators(bars.validated(history(spark, LINEAR).limit(0)))
    assert none.count() == 0 and {*timeseries.RECURSIVE, "MACD_histogram"} <= set(none.columns)


def test_a_missing_close_restarts_everything(spark):
    close = list(LINEAR)
    close[250] = None
    x = timeseries.with_indicators(bars.validated(history(spark, close))).cache()
    missing = lambda name, a, b: column(x, name)[a:b] == [None] * (b - a)
    assert missing("RSI", 250, 265) and column(x, "RSI")[265] is not None
    assert missing("MACD", 250, 276) and column(x, "MACD")[276] is not None
    assert missing("SMA_50", 250, 300) and column(x, "SMA_50")[300] is not None
    seg = timeseries.gap_segments(bars.validated(history(spark, close))).orderBy("d").collect()
    assert [seg[i]["run_id"] for i in (0, 249, 250, 251)] == [1, 1, 2, 3] and [seg[i]["gap_id"] for i in (249, 250, 599)] == [0, 1, 1]


def test_a_bad_row_keeps_its_date_only(spark):
    opens = list(LINEAR)
    opens[10] = None
    x = bars.validated(history(spark, LINEAR, opens)).orderBy("d").collect()
    assert len(x) == 600 and not x[10]["valid"] and x[10]["close"] is None and x[9]["valid"]


def test_keep_last_of_a_date(spark):
    df = history(spark, LINEAR).withColumn("seq", F.lit(0))
    again = df.orderBy(F.col("d").desc()).limit(1).withColumns({"seq": F.lit(1), "close": F.lit(1.0)})
    got = bars.keep_last(df.union(again))
    assert got.count() == 600 and got.orderBy(F.col("d").desc()).first()["close"] == 1.0


def test_unusable_histories(spark):
    good = history(spark, LINEAR)
    with pytest.raises(FetchError):
        bars.checked(good.limit(0))
    with pytest.raises(InvalidHistoryError):
        bars.checked(good.drop("volume"))
    with pytest.raises(InvalidHistoryError):
        bars.checked(good.withColumn("d", F.lit("x")))
    for bad in (LINEAR[:199], [*LINEAR[:-1], None]):
        with pytest.raises(InvalidHistoryError):
            bars.require_history(bars.validated(history(spark, bad)))
    assert bars.require_history(bars.validated(good)).count() == 600


def test_volatility_needs_all_returns(spark):
    close = list(100 * np.cumprod([1 + 0.002 + 0.01 * math.sin(i) for i in range(300)]))
    got = timeseries.annualized_volatility(history(spark, [float(c) for c in close]), 30).first()
    r = np.diff(close) / np.array(close[:-1])
    assert got["annualized_volatility"] == pytest.approx(np.std(r[-30:], ddof=1) * math.sqrt(252))
    assert got["sigma_90_day"] == pytest.approx(got["annualized_volatility"] * math.sqrt(90 / 252))
    assert timeseries.annualized_volatility(history(spark, [float(c) for c in close[:20]]), 30).first()["annualized_volatility"] is None


VOTE_COLUMNS = "close double, SMA_50 double, SMA_200 double, RSI double, MACD double, MACD_signal double, BB_middle double"


@pytest.mark.parametrize(
    ("row", "score", "signal"),
    [
        ((3.0, 2.0, 1.0, 60.0, 2.0, 1.0, 2.0), 5, "BULLISH"),
        ((1.0, 2.0, 3.0, 40.0, 1.0, 2.0, 2.0), -5, "BEARISH"),
        ((2.0, 2.0, 2.0, 50.0, 1.0, 1.0, 2.0), 0, "NEUTRAL"),
        ((None,) * 7, 0, "NEUTRAL"),
        ((3.0, 2.0, 1.0, 60.0, 1.0, 1.0, 3.0), 3, "BULLISH"),
        ((3.0, 2.0, 1.0, 50.0, 1.0, 1.0, 3.0), 2, "NEUTRAL"),
    ],
)
def test_votes(spark, row, score, signal):
    got = signals.with_momentum(spark.createDataFrame([row], VOTE_COLUMNS)).first()
    assert (got["score"], got["momentum"]) == (score, signal) and len(got["reasons"]) == 5
    if row[0] is None:
        assert got["reasons"][0] == "close vs SMA_50: unavailable (0)"
    elif score == 5:
        assert got["reasons"][0] == "close above SMA_50 (+1)"


def test_facts_of_missing_and_present_values(spark):
    cols = "close double, SMA_50 double, SMA_200 double, RSI double, MACD double, MACD_signal double, MACD_histogram double, BB_lower double, BB_middle double, BB_upper double, momentum string"
    rows = [(110.0, 100.0, 90.0, 70.0, 2.0, 1.0, 1.0, 95.0, 105.0, 115.0, "BULLISH"), (None,) * 11, (90.0, 100.0, 110.0, 30.0, 1.0, 2.0, -1.0, 115.0, 105.0, 95.0, "x")]
    a, b, c = spark.createDataFrame(rows, cols).select(*[v.alias(k) for k, v in signals.facts().items()]).collect()
    assert a["price_vs_sma50_pct"] == pytest.approx(10) and (a["trend"], a["rsi_regime"], a["band_location"], a["histogram_sign"]) == ("bullish", "overbought", "upper_half", "positive")
    assert all(v is None for v in b)
    assert (c["trend"], c["rsi_regime"], c["band_location"], c["momentum_fact"], c["macd_vs_signal"]) == ("bearish", "oversold", None, None, "below")


def test_year_to_date(spark):
    rows = [("s", dt.date(2025, 12, 31), 100.0, 100.0, 100.0, 100.0, 1.0), ("s", dt.date(2026, 3, 2), 120.0, 125.0, 110.0, 120.0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = signals.price_summary(df, dt.date(2026, 3, 2)).first()
    assert got["ytd_return_pct"] == pytest.approx(20) and (got["high_52w"], got["low_52w"], got["current_price"]) == (125.0, 100.0, 120.0)
    assert signals.price_summary(df.where("d >= '2026-01-01'"), dt.date(2026, 3, 2)).first()["ytd_return_pct"] is None


def test_parameters_are_checked():
    for bad in ({"macd_fast": 26}, {"sma_short": 0}, {"band_width": 0}, {"rsi_period": 1.5}):
        with pytest.raises(ValueError):
            IndicatorConfig(**bad)
