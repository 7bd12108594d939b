"""Evidence checks: sentiment aggregates, permissions, citations, metric grounding, report claims, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import HORIZON_DAYS, TRADING_DAYS
from ..functions.scalar import redacted

# The tools each role may call.
ROLE_TOOLS = {
    "researcher": ("get_price_data", "get_news", "calculate_volatility", "llm_sentiment", "web_search"),
    "analyst": ("get_price_data", "calculate_volatility", "llm_sentiment"),
    "writer": ("get_news", "web_search"),
}
QUANTITATIVE = ("get_price_data", "calculate_volatility", "llm_sentiment")
QUALITATIVE = ("get_news", "web_search")

# Where a metric stands in a tool's output.
METRIC_PATHS = {
    "current_price": "summary.current_price",
    "pe_ratio": "summary.pe_ratio",
    "ytd_return_pct": "summary.ytd_return_pct",
    "annualized_volatility": "annualized_volatility",
    "sentiment_score": "aggregate.overall_score",
    "SMA_50": "latest_indicators.SMA_50",
    "SMA_200": "latest_indicators.SMA_200",
    "RSI": "latest_indicators.RSI",
    "MACD": "latest_indicators.MACD",
    "MACD_signal": "latest_indicators.MACD_signal",
    "MACD_histogram": "latest_indicators.MACD_histogram",
    "BB_upper": "latest_indicators.BB_upper",
    "BB_middle": "latest_indicators.BB_middle",
    "BB_lower": "latest_indicators.BB_lower",
}


def sentiment_aggregate(df: DataFrame, *keys: str) -> DataFrame:
    """df: sentiment, confidence (null sentiment: the analysis failed). Neutral rows count in the mean's denominator."""
    s = F.col("sentiment")
    direction = F.when(s == "positive", F.col("confidence")).when(s == "negative", -F.col("confidence")).when(s == "neutral", 0.0)
    n = lambda c: F.count_if(c).alias
    got = df.groupBy(*keys).agg(
        F.round(F.avg(direction), 12).alias("overall_score"),
        n(s.isNotNull())("successful_count"), n(s.isNull())("failed_count"),
        n(s == "positive")("positive_count"), n(s == "negative")("negative_count"), n(s == "neutral")("neutral_count"),
    )
    score = F.col("overall_score")
    label = F.when(score.isNull(), "unavailable").when(score >= 0.2, "positive").when(score <= -0.2, "negative").otherwise("neutral")
    return got.withColumn("overall_label", label)


def batch_results(titles: DataFrame, results: DataFrame) -> DataFrame:
    """titles: pos, title. A title with exactly one result is valid; others failed. Order of titles is kept in pos."""
    one = results.groupBy("title").agg(F.count("*").alias("n"), F.first("sentiment").alias("sentiment"), F.first("confidence").alias("confidence")).where("n = 1").drop("n")
    return titles.join(one, "title", "left").select("pos", "title", "sentiment", "confidence")


def role_tools(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, t) for r, tools in ROLE_TOOLS.items() for t in tools], "role string, tool string")


def permitted(calls: DataFrame) -> DataFrame:
    """Calls (role, tool, ...) that the role may make; the dimension has a fixed size."""
    return calls.join(F.broadcast(role_tools(calls.sparkSession)), ["role", "tool"], "left_semi")


def coverage(observations: DataFrame, *keys: str) -> DataFrame:
    """observations: tool, success. Is there any successful quantitative and qualitative evidence."""
    ok = F.col("success")
    return observations.groupBy(*keys).agg(
        F.coalesce(F.bool_or(ok & F.col("tool").isin(*QUANTITATIVE)), F.lit(False)).alias("quantitative"),
        F.coalesce(F.bool_or(ok & F.col("tool").isin(*QUALITATIVE)), F.lit(False)).alias("qualitative"),
    )


def citation_check(cited: Column, allowed: Column, quantitative: Column | None = None) -> dict[str, Column]:
    """Arrays of ids: citations outside the allowed ones, and whether any is quantitative."""
    out = {"unknown": F.array_except(cited, allowed), "within": F.size(F.array_except(cited, allowed)) == 0}
    if quantitative is not None:
        out["has_quantitative"] = F.arrays_overlap(cited, quantitative)
    return out


def close_to(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))


def metric_values(output: Column, name: Column) -> Column:
    """Value of a named metric in a JSON output; null where the path is missing or not a number."""
    found = F.lit(None).cast("double")
    for metric, path in METRIC_PATHS.items():
        found = F.when(name == metric, F.get_json_object(output, f"$.{path}").try_cast("double")).otherwise(found)
    return found


def grounded_metrics(metrics: DataFrame, observations: DataFrame) -> DataFrame:
    """metrics: evidence_id, name, value; observations: evidence_id, output (JSON). ``grounded`` if the value stands there."""
    x = metrics.join(observations.select("evidence_id", "output"), "evidence_id", "left")
    x = x.withColumn("observed", metric_values(F.col("output"), F.col("name")))
    both = F.when(F.col("value").isNull(), F.col("observed").isNull()).otherwise(F.coalesce(close_to(F.col("value"), F.col("observed")), F.lit(False)))
    return x.withColumn("grounded", both).drop("output")


def trusted_titles(asked: DataFrame, registry: DataFrame) -> DataFrame:
    """asked: request, pos, title; registry: title. Distinct titles in order of first position, and whether the request may be served: all are known."""
    first = asked.groupBy("request", "title").agg(F.min("pos").alias("pos"))
    known = first.join(registry.select("title").distinct().withColumn("known", F.lit(True)), "title", "left")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "title"))), lambda x: x["title"])
    return known.groupBy("request").agg(listed.alias("titles"), F.bool_and(F.coalesce("known", F.lit(False))).alias("trusted"))


def call_key(tool: Column, arguments: Column) -> Column:
    """A call's tool and arguments as JSON with ordered keys; arguments: map<string, string>."""
    return F.concat_ws("|", tool, F.to_json(F.map_from_entries(F.sort_array(F.map_entries(arguments)))))


def not_failed_before(calls: DataFrame) -> DataFrame:
    """calls: run, turn, tool, arguments, success. Calls whose like (same key) has not failed in an earlier turn of the run."""
    keyed = calls.withColumn("key", call_key(F.col("tool"), F.col("arguments")))
    failed = keyed.where(~F.col("success")).groupBy("run", "key").agg(F.min("turn").alias("failed_at"))
    return keyed.join(failed, ["run", "key"], "left").where(F.col("failed_at").isNull() | (F.col("turn") <= F.col("failed_at"))).drop("failed_at")


def sentiment_facts(aggregates: DataFrame) -> DataFrame:
    """Aggregates with their total: failures count as headlines, not as analyses."""
    return aggregates.withColumn("total_headline_count", F.col("successful_count") + F.col("failed_count"))


def grounding_facts(observations: DataFrame) -> DataFrame:
    """observations: run, tool, success, volatility. Values of a run that differ by more than 1e-9 of themselves, with their 90-day scale."""
    ok = observations.where(F.col("success") & (F.col("tool") == "calculate_volatility") & F.col("volatility").isNotNull())
    values = F.sort_array(F.collect_list("volatility"))
    apart = lambda acc, v: F.when(F.exists(acc, lambda o: F.abs(o - v) <= F.lit(1e-9) * F.greatest(F.abs(o), F.abs(v))), acc).otherwise(F.concat(acc, F.array(v)))
    x = ok.groupBy("run").agg(values.alias("all")).withColumn("one", F.explode(F.aggregate("all", F.array().cast("array<double>"), apart)))
    return x.select("run", F.col("one").alias("annualized_volatility"), (F.col("one") * 100 * F.sqrt(F.lit(HORIZON_DAYS / TRADING_DAYS))).alias("sigma_90_pct"))


def trace_rows(df: DataFrame, most: int = 200) -> DataFrame:
    """Trace rows with secrets removed, then cut: redaction comes before the cut."""
    return df.withColumn("output", F.substring(redacted(F.col("output")), 1, most))


def trace_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("tool").agg(F.count("*").alias("calls"), F.count_if("success").alias("succeeded"), F.count_if("cache_hit").alias("cached"), F.max(F.length("output")).alias("longest_output"))
