"""Claims in report texts that the evidence at hand does not carry, as column expressions over whole tables of reports.

A pattern's mentions in a text are an array of (before, said, value, after). Word rules look at the mentions in each
sentence, number rules compare the value of each mention with what was observed. A report field breaks a rule if
any mention does; the names of broken rules come in the order of ``RULES``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import HORIZON_DAYS, MOVE_TOLERANCE_PCT, TRADING_DAYS

# Patterns of sentences, claims and denials, without regard to case.
SENTENCE_END = r"(?<!\d)[.!?;]\s+|(?<=\d)[.!?;](?!\d)\s+"
DENIED_BEFORE = r"(?:cannot|can't|does not|do not|not|no|insufficient|unavailable)\b[^.;]*$"
DENIED_AFTER = r"(?:\s+health|\s+strength)?\s+(?:is |are )?(?:not assessed|unavailable|unknown|cannot be assessed|not established)\b"
FUNDAMENTALS = r"balance[- ]sheet|solven(?:cy|t)|cash[- ]flow|earnings[- ]quality"
ASSERTED = r"\b(?:is|are|has|shows|remains|solid|strong|healthy|good|robust|sound|stable|weak|poor|high|low|improving|deteriorating|insolvent|solvent)\b"
OPTIMAL = r"\boptimal\b"
OPTION = r"put|strike|premium|cost"
OPTION_VALUE = r"\b(?:implied volatility\s+(?:is\s+)?(?:cheap|expensive)|(?:option\s+)?premium\s+(?:is\s+)?attractive)\b"
COMPARED = r"\b(?:higher|lower|above|below|premium|discount|expensive|cheap)\b"
YARDSTICK = r"histor(?:y|ical)|sector"
RATIO = r"\bP/?E\b|valuation|valued|ratio|expensive|cheap"
SIZING = r"\b(?:offset|hedge|protect|cover|reduce|cut|sell|allocate)\s+(?:(?:about|approximately|around|roughly|up to)\s+)?[~≈]?\s*\d+(?:\.\d+)?\s*%|\b\d+(?:\.\d+)?\s*%\s+(?:of\s+(?:the\s+)?(?:equity\s+)?(?:exposure|position|portfolio)|hedge|stop[- ]loss)|\b(?:stop[- ]loss|hedge ratio)\b[^.;]{0,30}\d+(?:\.\d+)?\s*%|\b(?:strike|premium|option price)\b\s+(?:is|at|of)\s*\$?\s*\d+(?:\.\d+)?|\b(?:strike|premium|option price)\b[^.;]{0,20}\$\s*\d+(?:\.\d+)?"
SIGMA_OTHER_SCALE = r"(?:annualized|daily)\s+(?:historical\s+)?$"
SIGMA = (
    r"90(?:[- ]trading)?[- ]day\s+(?:historical\s+)?(?:one[- ]standard[- ]deviation\s+|expected\s+|1[- ]sigma\s+)?(?:return scale|move|volatility)(?:\s+(?:is|of|estimate|approximately|about|equals))*\s*[:=≈~]?\s*(\d+(?:\.\d+)?)\s*%",
    r"(\d+(?:\.\d+)?)\s*%\s+(?:as\s+)?(?:a\s+)?(?:historical\s+)?(?:90(?:[- ]trading)?[- ]day\s+)?(?:one[- ]sigma|1[- ]sigma|one[- ]standard[- ]deviation)(?:\s+(?:move|return scale))?",
    r"(?:one[- ]sigma|1[- ]sigma|one[- ]standard[- ]deviation)\s+(?:return scale|move)(?:\s+(?:is|of|approximately|about))*\s*[:=≈~]?\s*(\d+(?:\.\d+)?)\s*%",
    r"(\d+(?:\.\d+)?)\s*%\s+(?:as\s+)?(?:a\s+)?90[- ]day\s+(?:expected\s+)?move",
)
DENOMINATOR = r"\d+\s+of\s+$"
COUNTS = {
    "successful_count": (
        r"\b(\d+)\s+of\s+\d+\s+(?:recent\s+)?headlines\s+(?:were\s+)?(?:successfully\s+)?analy[sz]ed",
        r"\b(?:analysis|analy[sz]ed)\s+(?:of\s+)?(\d+)\s+(?:recent\s+)?headlines",
        r"\b(\d+)\s+(?:recent\s+)?headlines\s+(?:were\s+)?(?:successfully\s+)?analy[sz]ed",
    ),
    "failed_count": (r"\b(\d+)\s+(?:headline\s+)?(?:analyses\s+)?failed\b",),
    "positive_count": (r"\b(\d+)\s+positive\b",),
    "negative_count": (r"\b(\d+)\s+negative\b",),
    "neutral_count": (r"\b(\d+)\s+neutral\b",),
    "total_headline_count": (r"\b\d+\s+of\s+(\d+)\s+(?:recent\s+)?headlines",),
}
SIGMA_LOOK_BACK = 35
HEDGE_FIELD = "hedge_strategy_recommendation"

RULES = ("fundamentals", "optimal_option", "option_valuation", "benchmark_valuation", "hedge_sizing", *COUNTS, "sigma_scale")


def _any_case(pattern: str) -> Column:
    return F.lit(f"(?iU){pattern}")


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?iU){pattern}")


def mentions(text: Column, pattern: Column, group: int = 0) -> Column:
    """array<struct<before, said, value, after>>: the matches in order, ``value`` being the given group of each."""
    said, value, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(group)), F.split(text, pattern, -1)

    def placed(x: Column, i: Column) -> Column:
        upto = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda s, p: s + F.length(p))
        start = upto(between, i + 1) + upto(said, i)
        return F.struct(F.substring(text, F.lit(1), start).alias("before"), x.alias("said"), F.get(value, i).alias("value"), F.substring(text, start + F.length(x) + 1, F.length(text)).alias("after"))

    return F.transform(said, placed)


def _denied(m: Column) -> Column:
    """Is a mention denied: by words before it in its clause, or by what follows at once."""
    return _has(m["before"], DENIED_BEFORE) | _has(m["after"], f"^(?:{DENIED_AFTER})")


def _stands(found: Column) -> Column:
    """There is a mention, and the first is not denied."""
    return (F.size(found) > 0) & ~F.coalesce(_denied(F.get(found, F.lit(0))), F.lit(False))


def word_rules(field: Column, sentence: Column, ticker: Column) -> dict[str, Column]:
    """Of one sentence: does it claim what cannot be known."""
    said = lambda p: mentions(sentence, _any_case(p))
    futures = F.concat(F.lit(r"(?iU)\b\Q"), ticker, F.lit(r"\E\s+futures\b"))
    sized, traded = said(SIZING), mentions(sentence, futures)
    return {
        "fundamentals": _has(sentence, ASSERTED) & F.exists(said(FUNDAMENTALS), lambda m: ~_denied(m)),
        "optimal_option": _has(sentence, OPTION) & _stands(said(OPTIMAL)),
        "option_valuation": _stands(said(OPTION_VALUE)),
        "benchmark_valuation": _has(sentence, YARDSTICK) & _has(sentence, RATIO) & _stands(said(COMPARED)),
        "hedge_sizing": (field == HEDGE_FIELD) & F.when(F.size(sized) > 0, _stands(sized)).otherwise(_stands(traded)),
    }


def _miscounted(sentence: Column, key: str, counts: Column) -> Column:
    """A count is claimed that no aggregate has."""
    part_of = (lambda m: _has(m["before"], DENOMINATOR)) if key == "successful_count" else (lambda m: F.lit(False))  # the b of "a of b"
    known = lambda m: F.exists(counts, lambda c: F.coalesce(c[key] == m["value"].cast("long"), F.lit(False)))
    wrong = lambda m: ~part_of(m) & ~F.coalesce(known(m), F.lit(False))
    return reduce(lambda a, b: a | b, [F.exists(mentions(sentence, _any_case(p), 1), wrong) for p in COUNTS[key]])


def horizon_pct(annualized: Column) -> Column:
    return annualized * F.lit(100 * (HORIZON_DAYS / TRADING_DAYS) ** 0.5)


def _misscaled(text: Column, volatility: Column) -> Column:
    """A move over the horizon is claimed that follows from no volatility; what is said to be annualized or daily is left alone."""
    fits = lambda m: F.exists(volatility, lambda v: F.abs(m["value"].cast("double") - horizon_pct(v)) <= MOVE_TOLERANCE_PCT)
    other = lambda m: _has(F.right(m["before"], F.lit(SIGMA_LOOK_BACK)), SIGMA_OTHER_SCALE)
    return reduce(lambda a, b: a | b, [F.exists(mentions(text, _any_case(p), 1), lambda m: ~other(m) & ~F.coalesce(fits(m), F.lit(False))) for p in SIGMA])


def broken(field: Column, text: Column, ticker: Column, volatility: Column, counts: Column) -> Column:
    """Names of the rules that a report field breaks. volatility: array<double>, counts: array<map<string, bigint>>."""
    sentences = F.split(text, SENTENCE_END, -1)

    def somewhere(name: str) -> Column:
        return F.exists(sentences, lambda s: _miscounted(s, name, counts) if name in COUNTS else word_rules(field, s, ticker)[name])

    found = {name: somewhere(name) for name in RULES if name != "sigma_scale"}
    found["sigma_scale"] = _misscaled(text, volatility)
    return F.array_compact(F.array(*[F.when(found[name], F.lit(name)) for name in RULES]))


def check_reports(df: DataFrame) -> DataFrame:
    """df: report_id, field, text, ticker, volatility array<double>, counts array<map<string,bigint>>; adds ``broken``."""
    return df.withColumn("broken", broken(*map(F.col, ("field", "text", "ticker", "volatility", "counts"))))


def broken_fields(texts: dict[str, str], ticker: str, volatility: list[float], counts: list[dict]) -> dict[str, list[str]]:
    """The same for the fields of one report at hand; only fields that break a rule."""
    spark = SparkSession.builder.getOrCreate()
    own = [{k: int(c[k]) for k in COUNTS if c.get(k) is not None} for c in counts]
    rows = [(f, t, ticker, [float(v) for v in volatility], own) for f, t in texts.items()]
    df = spark.createDataFrame(rows, "field string, text string, ticker string, volatility array<double>, counts array<map<string,bigint>>")
    return {r["field"]: r["broken"] for r in check_reports(df).select("field", "broken").collect() if r["broken"]}
