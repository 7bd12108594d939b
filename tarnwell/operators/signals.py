"""Momentum votes, technical facts and price summaries: row-wise expressions and one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import finite

#: The five equal votes: left side, right side.
VOTES = (("close", "SMA_50"), ("SMA_50", "SMA_200"), ("RSI", "50"), ("MACD", "MACD_signal"), ("close", "BB_middle"))
INDICATORS = ("SMA_50", "SMA_200", "RSI", "MACD", "MACD_signal", "MACD_histogram", "BB_middle", "BB_upper", "BB_lower")


def _side(name: str) -> Column:
    return F.lit(50.0) if name == "50" else F.col(name)


def vote(a: str, b: str) -> Column:
    """Sign of a - b; 0 when equal or missing."""
    return F.coalesce(F.signum(_side(a) - _side(b)), F.lit(0.0)).cast("int")


def reason(a: str, b: str) -> Column:
    word = F.when(_side(a) > _side(b), "above").when(_side(a) < _side(b), "below").otherwise("equals")
    said = F.format_string("%s %s %s (%+d)", F.lit(a), word, F.lit(b), vote(a, b))
    return F.when(_side(a).isNull() | _side(b).isNull(), F.lit(f"{a} vs {b}: unavailable (0)")).otherwise(said)


def with_momentum(df: DataFrame) -> DataFrame:
    score = sum((vote(a, b) for a, b in VOTES[1:]), vote(*VOTES[0]))
    x = df.withColumns({"score": score.cast("int"), "reasons": F.array(*[reason(a, b) for a, b in VOTES])})
    return x.withColumn("momentum", F.when(F.col("score") >= 3, "BULLISH").when(F.col("score") <= -3, "BEARISH").otherwise("NEUTRAL"))


def relation(a: Column, b: Column) -> Column:
    return F.when(a > b, "above").when(a < b, "below").when(a == b, "equal")


def facts(row: str = "") -> dict[str, Column]:
    """The nine technical facts from the columns of a row with indicators and momentum."""
    get = lambda n, positive=False: finite(F.col(row + n), positive)
    price, short, long_ = get("close", True), get("SMA_50", True), get("SMA_200", True)
    low, middle, high = get("BB_lower"), get("BB_middle"), get("BB_upper")
    rsi, histogram = get("RSI"), get("MACD_histogram")
    ordered = (low <= middle) & (middle <= high)
    known = price.isNotNull() & short.isNotNull() & long_.isNotNull()
    return {
        "price_vs_sma50_pct": (price / short - 1) * 100,
        "price_vs_sma200_pct": (price / long_ - 1) * 100,
        "sma50_vs_sma200": relation(short, long_),
        "trend": F.when(known, F.when((price > short) & (short > long_), "bullish").when((price < short) & (short < long_), "bearish").otherwise("neutral")),
        "rsi_regime": F.when((rsi < 0) | (rsi > 100), None).when(rsi <= 30, "oversold").when(rsi < 45, "weak").when(rsi <= 55, "neutral").when(rsi < 70, "strong").when(rsi <= 100, "overbought"),
        "macd_vs_signal": relation(get("MACD"), get("MACD_signal")),
        "histogram_sign": F.when(histogram > 0, "positive").when(histogram < 0, "negative").when(histogram == 0, "zero"),
        "band_location": F.when(
            ordered & price.isNotNull(),
            F.when(price < low, "below_lower").when(price > high, "above_upper").when(price == middle, "middle").when(price < middle, "lower_half").otherwise("upper_half"),
        ),
        "momentum_fact": F.when(F.col(row + "momentum").isin("BULLISH", "BEARISH", "NEUTRAL"), F.col(row + "momentum")),
    }


def latest(df: DataFrame) -> DataFrame:
    """Last row of each series by date, without a sort: the row travels as one struct."""
    own = [c for c in df.columns if c != "series"]
    return df.groupBy("series").agg(F.max_by(F.struct(*own), "d").alias("r")).select("series", "r.*")


def price_summary(df: DataFrame, as_of=None) -> DataFrame:
    """52-week range, latest price and year-to-date return of each series in one aggregate.

    ``as_of`` (date) defaults to the latest date of all bars. Rows after it or without a close don't count.
    """
    if as_of is None:
        as_of = df.agg(F.max("d")).first()[0]
    at, d, close = F.lit(as_of).cast("date"), F.col("d"), F.col("close")
    x = df.where((d <= at) & close.isNotNull())
    year, start = F.trunc(at, "year"), F.date_sub(at, 364)
    got = x.groupBy("series").agg(
        F.max_by(close, d).alias("current_price"),
        F.max(F.when(d >= start, F.col("high"))).alias("high_52w"),
        F.min(F.when(d >= start, F.col("low"))).alias("low_52w"),
        F.max_by(close, F.when(d < year, d)).alias("base"),
        F.max_by(close, F.when(d >= year, d)).alias("this_year"),
    )
    ytd = F.when(finite(F.col("base"), True).isNotNull(), (F.col("this_year") / F.col("base") - 1) * 100)
    return got.withColumn("ytd_return_pct", ytd).drop("base", "this_year")


def with_metadata(summary: DataFrame, ratios: DataFrame) -> DataFrame:
    """Summaries with pe_ratio from ratios (series, pe_ratio); null where there is none."""
    return summary.join(ratios, "series", "left")
