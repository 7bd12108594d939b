"""Indicators over daily bars, in built-in functions: windows for means, a parallel scan over blocks of days for recursions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.config import HORIZON_DAYS, TRADING_DAYS, IndicatorConfig


def by_date():
    return Window.partitionBy("series").orderBy("d")


def full_window(value: Column, n: int, what) -> Column:
    """what(value) over the last n rows, null unless all n are there."""
    w = by_date().rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(w) == n, what(value).over(w))


def with_sma(df: DataFrame, cfg: IndicatorConfig = IndicatorConfig()) -> DataFrame:
    c = F.col("close")
    return df.withColumns({"SMA_50": full_window(c, cfg.sma_short, F.avg), "SMA_200": full_window(c, cfg.sma_long, F.avg)})


def with_bands(df: DataFrame, cfg: IndicatorConfig = IndicatorConfig()) -> DataFrame:
    c = F.col("close")
    middle, width = full_window(c, cfg.band_window, F.avg), full_window(c, cfg.band_window, F.stddev_pop) * cfg.band_width
    return df.withColumns({"BB_middle": middle, "BB_upper": middle + width, "BB_lower": middle - width})


def gap_segments(df: DataFrame) -> DataFrame:
    """run_id counts changes between present and missing closes; gap_id counts missing closes so far."""
    missing = F.col("close").isNull()
    change = F.when(missing == F.lag(missing).over(by_date()), 0).otherwise(1)
    x = df.withColumn("__change", change)
    w = by_date().rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumns({"run_id": F.sum("__change").over(w), "gap_id": F.sum(missing.cast("int")).over(w)}).drop("__change")


RECURSIVE = ("EMA_fast", "EMA_slow", "MACD", "MACD_signal", "RSI")
BLOCK_DAYS = 256
# What a recursion knows after a day: closes since the last missing one, the last close, the means of MACD, and of gains and losses.
STATE = ("n", "c", "fast", "slow", "signal", "gain", "loss")
EMPTY = "named_struct('n', 0L, 'c', 0D, 'fast', 0D, 'slow', 0D, 'signal', 0D, 'gain', 0D, 'loss', 0D)"


def _struct(values: dict[str, str]) -> str:
    return f"named_struct({', '.join(f"'{k}', {v}" for k, v in values.items())})"


def _rates(cfg: IndicatorConfig) -> tuple[float, float, float]:
    return tuple(2.0 / (span + 1.0) for span in (cfg.macd_fast, cfg.macd_slow, cfg.macd_signal))


def _step(s: str, x: str, cfg: IndicatorConfig) -> str:
    """SQL of the state after one more day with the close ``x``; a missing one empties it."""
    fast_rate, slow_rate, signal_rate = _rates(cfg)
    n, p = f"({s}.n + 1)", cfg.rsi_period
    towards = lambda mean, value, rate: f"{mean} + {rate!r}D * ({value} - {mean})"
    fast, slow = (f"IF({s}.n = 0, {x}, {towards(f'{s}.{k}', x, r)})" for k, r in (("fast", fast_rate), ("slow", slow_rate)))
    macd = "(m.fast - m.slow)"
    signal = f"CASE WHEN {n} < {cfg.macd_slow} THEN 0D WHEN {n} = {cfg.macd_slow} THEN {macd} ELSE {towards(f'{s}.signal', macd, signal_rate)} END"

    def wilder(mean: str, move: str) -> str:  # a sum up to the seed, then a mean
        move = f"greatest({move}, 0D)"
        return f"CASE WHEN {s}.n = 0 THEN 0D WHEN {n} <= {p} THEN {mean} + {move} WHEN {n} = {p + 1} THEN ({mean} + {move}) / {p}D ELSE {mean} + ({move} - {mean}) / {p}D END"

    done = _struct({"n": n, "c": x, "fast": "m.fast", "slow": "m.slow", "signal": signal, "gain": wilder(f"{s}.gain", f"{x} - {s}.c"), "loss": wilder(f"{s}.loss", f"{s}.c - {x}")})
    return f"IF({x} IS NULL, {EMPTY}, transform(array({_struct({'fast': fast, 'slow': slow})}), m -> {done})[0])"


def _map_of(closes: str, before: str, cfg: IndicatorConfig) -> str:
    """SQL of the affine map of days behind settled ones, folded from the maps of the days. before: the close before the first.

    The ends are fast = ff * fast + f, slow = ss * slow + s, signal = gg * signal + gf * fast + gs * slow + g, gain = w * gain + u, loss = w * loss + v.
    """
    a, b, e = _rates(cfg)
    p = cfg.rsi_period
    means = _struct({"ff": f"o.ff * {1 - a!r}D", "f": f"o.f + {a!r}D * (x - o.f)", "ss": f"o.ss * {1 - b!r}D", "s": f"o.s + {b!r}D * (x - o.s)"})
    rest = {
        "c": "x", "ff": "m.ff", "f": "m.f", "ss": "m.ss", "s": "m.s", "gg": f"o.gg * {1 - e!r}D", "gf": f"o.gf + {e!r}D * (m.ff - o.gf)", "gs": f"o.gs + {e!r}D * (-m.ss - o.gs)", "g": f"o.g + {e!r}D * (m.f - m.s - o.g)",
        "w": f"o.w * {1 - 1 / p!r}D", "u": f"o.u + (greatest(x - o.c, 0D) - o.u) / {p}D", "v": f"o.v + (greatest(o.c - x, 0D) - o.v) / {p}D",
    }
    ones = {k: "1D" if k in ("ff", "ss", "gg", "w") else "0D" for k in rest} | {"c": before}
    return f"aggregate({closes}, {_struct(ones)}, (o, x) -> transform(array({means}), m -> {_struct(rest)})[0])"


def _moved(s: str, m: str, days: str) -> str:
    """SQL of the state behind ``days`` days of the map ``m``."""
    return _struct({
        "n": f"{s}.n + {days}", "c": f"{m}.c", "fast": f"{m}.ff * {s}.fast + {m}.f", "slow": f"{m}.ss * {s}.slow + {m}.s",
        "signal": f"{m}.gg * {s}.signal + {m}.gf * {s}.fast + {m}.gs * {s}.slow + {m}.g", "gain": f"{m}.w * {s}.gain + {m}.u", "loss": f"{m}.w * {s}.loss + {m}.v",
    })


def _shown(s: str, cfg: IndicatorConfig) -> dict[str, str]:
    """SQL of the indicators of a day's state, each null until it has seen enough days."""
    late, rsi = f"{s}.n >= {cfg.macd_slow}", f"CASE WHEN {s}.loss = 0 THEN IF({s}.gain > 0, 100D, 50D) ELSE 100D - 100D / (1D + {s}.gain / {s}.loss) END"
    signal = f"IF({s}.n >= {cfg.macd_slow + cfg.macd_signal - 1}, {s}.signal, NULL)"
    values = (f"IF({s}.n >= {cfg.macd_fast}, {s}.fast, NULL)", f"IF({late}, {s}.slow, NULL)", f"IF({late}, {s}.fast - {s}.slow, NULL)", signal, f"IF({s}.n > {cfg.rsi_period}, {rsi}, NULL)")
    return dict(zip(RECURSIVE, values, strict=True)) | {"MACD_histogram": f"IF({late}, {s}.fast - {s}.slow, NULL) - {signal}"}


def with_recursions(df: DataFrame, cfg: IndicatorConfig = IndicatorConfig(), block_days: int = BLOCK_DAYS) -> DataFrame:
    """EMA_fast, EMA_slow, MACD, MACD_signal, MACD_histogram and RSI; every recursion restarts at a missing close.

    A parallel scan, in built-in functions. The days of a series fall into blocks of ``block_days`` calendar days, which many tasks work on. A block without a
    gap moves the state by its first days, up to when the recursions are settled (from then on a day is one affine map of the state), and by one map composed of all
    others; one with a gap ends in a state of its own, whatever was before. One row per block and series, no more than some thousand, is folded to the state before each
    block, and each block is filled in from there. Columns of any type pass.
    """
    settled = max(cfg.macd_slow, cfg.rsi_period + 1)
    earlier = "(x, y) -> CASE WHEN x.d <=> y.d THEN 0 WHEN x.d IS NULL OR x.d < y.d THEN -1 ELSE 1 END"
    row = ", ".join(f"`{c}`" for c in df.columns)
    block = f"coalesce(floor(datediff(d, DATE '1970-01-01') / {block_days}), -1L << 40)"
    day = f"struct(d, IF(isnan(cast(close AS double)), NULL, cast(close AS double)) AS close, struct({row}) AS row)"
    # As a struct, a null series equals itself, so that all steps share one partitioning.
    blocks = df.groupBy(F.struct("series").alias("key"), F.expr(block).alias("block")).agg(F.expr(f"array_sort(collect_list({day}), {earlier})").alias("days"))
    behind = f"greatest(size(closes) - {settled}, 0)"
    ends = blocks.selectExpr("key", "block", "transform(days, x -> x.close) AS closes").selectExpr(
        "key", "block", f"IF(exists(closes, x -> x IS NULL), aggregate(closes, {EMPTY}, (s, x) -> {_step('s', 'x', cfg)}), NULL) AS end", f"slice(closes, 1, {settled}) AS first", f"cast({behind} AS long) AS n",
        f"IF(size(closes) > {settled} AND NOT exists(closes, x -> x IS NULL), {_map_of(f'slice(closes, {settled + 1}, {behind})', f'element_at(closes, {settled})', cfg)}, NULL) AS map",
    )
    warm = f"aggregate(b.first, acc.state, (s, x) -> {_step('s', 'x', cfg)})"
    state = f"CASE WHEN b.end IS NOT NULL THEN b.end ELSE transform(array({warm}), w -> IF(b.map IS NULL, w, {_moved('w', 'b.map', 'b.n')}))[0] END"
    fields = ", ".join(f"{k}: {'bigint' if k == 'n' else 'double'}" for k in STATE)
    none = f"cast(array() AS array<struct<block: bigint, state: struct<{fields}>>>)"
    heads = f"aggregate(all, named_struct('state', {EMPTY}, 'heads', {none}), (acc, b) -> named_struct('state', {state}, 'heads', concat(acc.heads, array(named_struct('block', b.block, 'state', acc.state))))).heads"
    own = ends.groupBy("key").agg(F.expr("sort_array(collect_list(struct(block, end, first, map, n)))").alias("all"))
    own = own.selectExpr("key", f"inline({heads}) AS (block, state)")
    x = blocks.join(own.hint("shuffle_hash"), ["key", "block"])  # blocks stay where they are spread
    states = f"aggregate(days, array(state), (acc, x) -> concat(acc, transform(array(element_at(acc, -1)), s -> {_step('s', 'x.close', cfg)})))"
    pairs = x.selectExpr(f"inline(arrays_zip(days, slice({states}, 2, size(days)))) AS (day, now)")
    return pairs.selectExpr("day.row.*", *[f"{v} AS {k}" for k, v in _shown("now", cfg).items()])


def with_indicators(df: DataFrame, cfg: IndicatorConfig = IndicatorConfig()) -> DataFrame:
    """All indicator columns; one row per series and day is needed."""
    return with_recursions(with_bands(with_sma(df, cfg), cfg), cfg)


def with_returns(df: DataFrame) -> DataFrame:
    c, before = F.col("close"), F.lag("close").over(by_date())
    return df.withColumns({"change": c - before, "simple_return": F.try_divide(c, before) - 1})


def annualized_volatility(df: DataFrame, window: int) -> DataFrame:
    """Per series: sample deviation of the last ``window`` simple returns times the root of 252; null unless all are there."""
    w = Window.partitionBy("series").orderBy(F.col("d").desc())
    last = with_returns(df).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= window)
    vol = F.when(F.count("simple_return") == window, F.stddev_samp("simple_return") * F.sqrt(F.lit(float(TRADING_DAYS))))
    got = last.groupBy("series").agg(F.count("simple_return").alias("n_returns"), vol.alias("annualized_volatility"))
    return got.withColumn("sigma_90_day", F.col("annualized_volatility") * F.sqrt(F.lit(HORIZON_DAYS / TRADING_DAYS)))
