"""Constraints of JSON records by type: nothing is coerced, keys that a record doesn't have are refused at every level.

A record is one JSON text, read as VARIANT (make it a column of its own first, so that it is parsed once). A rule set is name -> boolean column, as in ``rules``; a text that is no JSON breaks all of its
rules. Texts are measured in characters without the white space around them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.dataset import RISKS, TOPICS
from .config import HORIZON_DAYS

Rules = dict[str, Column]


def parsed(text: Column) -> Column:
    return F.try_parse_json(text)


def at(v: Column, path: str) -> Column:
    """What stands at a path, as VARIANT; null where nothing does."""
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    """text, number, whole, boolean, list, object or nothing."""
    s = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    number = F.when(s.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number").when(s == "BIGINT", "whole")
    return F.coalesce(number, F.when(s == "STRING", "text").when(s == "BOOLEAN", "boolean").when(s.startswith("ARRAY"), "list").when(s.startswith("OBJECT"), "object").otherwise("nothing"))


def text_of(v: Column, path: str) -> Column:
    """The trimmed text at a path, null where anything else stands there."""
    return F.when(kind(at(v, path)) == "text", F.trim(F.regexp_replace(F.try_variant_get(v, path, "string"), r"^\s+|\s+$", "")))


def text(v: Column, path: str, least: int, most: int = 1 << 31) -> Column:
    return F.length(text_of(v, path)).between(least, most)


def one_of(v: Column, path: str, values: tuple[str, ...]) -> Column:
    return text_of(v, path).isin(*values)


def number(v: Column, path: str, low: float, high: float, whole: bool = False) -> Column:
    kinds = ("whole",) if whole else ("whole", "number")
    return F.when(kind(at(v, path)).isin(*kinds), F.try_variant_get(v, path, "double")).between(low, high)


def optional(v: Column, path: str, rule: Column) -> Column:
    return (kind(at(v, path)) == "nothing") | rule


def items(v: Column, path: str) -> Column:
    """The elements of a list, null where there is none."""
    return F.when(kind(at(v, path)) == "list", F.try_variant_get(v, path, "array<variant>"))


def texts(v: Column, path: str, least: int) -> Column:
    """A list of at least so many elements, all of them texts."""
    x = items(v, path)
    return (F.size(x) >= least) & F.forall(x, lambda e: kind(e) == "text")


def only(v: Column, *keys: str) -> Column:
    """An object without other keys."""
    names = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    return F.when(kind(v) == "object", F.size(F.array_except(names, F.array(*map(F.lit, keys)))) == 0)


def headline_sentiment(v: Column) -> Rules:
    return {
        "keys": only(v, "headline", "sentiment", "confidence", "brief_reason"),
        "headline": text(v, "$.headline", 1),
        "sentiment": one_of(v, "$.sentiment", ("positive", "negative", "neutral")),
        "confidence": number(v, "$.confidence", 0.0, 1.0),
        "brief_reason": text(v, "$.brief_reason", 1, 500),
    }


# Lengths of a policy example's texts.
EXAMPLE_TEXTS = {"topic": (1, 80), "policy_excerpt": (30, 1600), "scenario": (20, 2000), "category": (1, 80), "recommended_action": (5, 400), "rationale": (15, 1000)}


def policy_example(v: Column) -> Rules:
    """Texts within their lengths, a known risk, and the category that the taxonomy has for the topic."""
    category = F.create_map(*[F.lit(x) for pair in TOPICS for x in pair])
    return {
        "keys": only(v, "id", "risk_level", *EXAMPLE_TEXTS),
        "id": text_of(v, "$.id").rlike(r"^[A-Za-z0-9_-]{1,80}\z"),
        **{name: text(v, f"$.{name}", low, high) for name, (low, high) in EXAMPLE_TEXTS.items()},
        "risk_level": one_of(v, "$.risk_level", RISKS),
        "taxonomy": F.try_element_at(category, text_of(v, "$.topic")) == text_of(v, "$.category"),
    }


ARGUMENTS = {"get_price_data": ("ticker", "period"), "get_news": ("ticker", "n"), "calculate_volatility": ("ticker", "window"), "llm_sentiment": ("headlines",), "web_search": ("query",)}


def tool_arguments(v: Column, tool: Column) -> Rules:
    """Arguments of a call of ``tool``: only its own, the needed ones there, each of its type and range."""
    headlines = items(v, "$.headlines")
    rules = {
        "ticker": kind(at(v, "$.ticker")) == "text",
        "period": optional(v, "$.period", kind(at(v, "$.period")) == "text"),
        "n": optional(v, "$.n", number(v, "$.n", 1, 10, whole=True)),
        "window": optional(v, "$.window", number(v, "$.window", 2, 252, whole=True)),
        "headlines": F.size(headlines).between(1, 10) & F.forall(headlines, lambda e: kind(e) == "object"),
        "query": F.length(F.when(kind(at(v, "$.query")) == "text", F.try_variant_get(v, "$.query", "string"))).between(1, 500),
    }
    own, keys = {}, F.lit(None).cast("boolean")
    for name, names in ARGUMENTS.items():
        keys = F.when(tool == name, only(v, *names)).otherwise(keys)
    for name, rule in rules.items():
        own[name] = F.when(tool.isin(*[t for t, names in ARGUMENTS.items() if name in names]), rule).otherwise(F.lit(True))
    return {"tool": tool.isin(*ARGUMENTS), "keys": keys, **own}


# Caps of a report's texts, in characters.
REPORT_TEXTS = {"financial_health_summary": 800, "market_sentiment_summary": 600}
RISK_TEXTS, HEDGE_TEXTS = {"title": 100, "supporting_evidence": 400}, {"strategy": 300, "data_driven_rationale": 500, "limitations": 400}


def _part(v: Column, caps: dict[str, int]) -> Column:
    ok = only(v, *caps, "evidence_ids") & texts(v, "$.evidence_ids", 1)
    for name, most in caps.items():
        ok = ok & text(v, f"$.{name}", 1, most)
    return F.coalesce(ok, F.lit(False))


def research_report(v: Column, writer: bool = False) -> Rules:
    """A report of exactly three risks and one hedge strategy, each with evidence. ``writer``: the clarification it used must be there."""
    risks, used = items(v, "$.top_three_risks"), text(v, "$.clarification_used", 1, 500)
    return {
        "keys": only(v, "ticker", "as_of", "horizon_days", "top_three_risks", "hedge_strategy_recommendation", "limitations", "clarification_used", *REPORT_TEXTS),
        "ticker": kind(at(v, "$.ticker")) == "text",
        "as_of": F.try_to_date(text_of(v, "$.as_of"), "yyyy-MM-dd").isNotNull(),
        "horizon_days": number(v, "$.horizon_days", HORIZON_DAYS, HORIZON_DAYS, whole=True),
        **{name: text(v, f"$.{name}", 1, most) for name, most in REPORT_TEXTS.items()},
        "top_three_risks": (F.size(risks) == 3) & F.forall(risks, lambda r: _part(r, RISK_TEXTS)),
        "hedge_strategy_recommendation": _part(at(v, "$.hedge_strategy_recommendation"), HEDGE_TEXTS),
        "limitations": texts(v, "$.limitations", 1),
        "clarification_used": used if writer else optional(v, "$.clarification_used", kind(at(v, "$.clarification_used")) == "text"),
    }
