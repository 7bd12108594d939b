"""Record constraints as boolean columns. A rule set is name -> column; ``broken`` lists the names that don't hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .config import HORIZON_DAYS

SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Za-z])"


def broken(rules: dict[str, Column]) -> Column:
    """Names of the rules that are false or unknown, in order; values never appear."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())


def only_keys(json_text: Column, allowed: tuple[str, ...]) -> Column:
    """A JSON object without other keys."""
    return F.size(F.array_except(F.json_object_keys(json_text), F.array(*map(F.lit, allowed)))) == 0


def headline_sentiment() -> dict[str, Column]:
    return {
        "headline": F.length(F.trim("headline")) > 0,
        "sentiment": F.col("sentiment").isin("positive", "negative", "neutral"),
        "confidence": F.col("confidence").between(0.0, 1.0) & ~F.isnan("confidence"),
        "brief_reason": F.length(F.trim("brief_reason")).between(1, 500),
    }


def sentences(text: Column) -> Column:
    return F.split(F.trim(text), SENTENCE_BREAK)


def recommendation() -> dict[str, Column]:
    """A known signal and three to five sentences in 1 to 900 characters, each closed."""
    s = sentences(F.col("reasoning"))
    return {
        "signal": F.col("signal").isin("BUY", "HOLD", "SELL"),
        "length": F.length(F.trim("reasoning")).between(1, 900),
        "sentences": F.size(s).between(3, 5),
        "closed": F.forall(s, lambda x: x.rlike(r"[.!?]\z")),
    }


def agent_action() -> dict[str, Column]:
    tool, finish = F.col("kind") == "tool", F.col("kind") == "finish"
    return {
        "kind": F.col("kind").isin("tool", "finish"),
        "tool": ~tool | (F.col("tool_name").isNotNull() & F.col("output").isNull()),
        "finish": ~finish | (F.col("output").isNotNull() & F.col("tool_name").isNull()),
    }


def tool_arguments() -> dict[str, Column]:
    """window, n, headlines and query of a call; absent ones are fine."""
    def within(c: str, low: int, high: int, measure=lambda x: x):
        return F.col(c).isNull() | measure(F.col(c)).between(low, high)

    return {"window": within("window", 2, 252), "n": within("n", 1, 10), "headlines": within("headlines", 1, 10, F.size), "query": within("query", 1, 500, F.length)}


def research_report() -> dict[str, Column]:
    return {
        "risks": F.size("risks") == 3,
        "evidence": F.forall("risks", lambda r: F.size(r["evidence_ids"]) >= 1),
        "horizon": F.col("horizon_days") == HORIZON_DAYS,
    }


def indicator_sanity() -> dict[str, Column]:
    """Where defined, RSI lies in 0 to 100 and the bands are ordered."""
    return {
        "rsi": F.col("RSI").isNull() | F.col("RSI").between(0, 100),
        "bands": F.col("BB_middle").isNull() | ((F.col("BB_lower") <= F.col("BB_middle")) & (F.col("BB_middle") <= F.col("BB_upper"))),
    }


def recommendation_payload(indicators: tuple[str, ...], facts: dict[str, Column], aggregate: Column) -> Column:
    """JSON of a latest row's indicators, its facts and the sentiment aggregate; missing values stay as nulls."""
    return F.to_json(F.struct(F.struct(*indicators).alias("indicators"), F.struct(*[v.alias(k) for k, v in facts.items()]).alias("facts"), aggregate.alias("sentiment")), {"ignoreNullFields": "false"})
