"""Dispatcher, retries and research loops with a scripted provider."""

from __future__ import annotations

import datetime as dt
import json
import math

import pytest

from tarnwell.functions.config import ProviderError
from tarnwell.operators import evidence
from tarnwell.plans import research
from tarnwell.sources import bars
from tests.test_timeseries import history


@pytest.fixture(scope="module")
def tools(spark):
    close, c = [], 100.0
    for i in range(300):
        c *= 1 + 0.002 + 0.01 * math.sin(i)
        close.append(c)
    news = spark.createDataFrame([(0, "Chip demand grows", "P", "https://a"), (1, "Rivals catch up", "Q", "https://b")], "pos long, title string, publisher string, url string")

    def answer(system, payload):
        return json.dumps({"results": [{"headline": h["title"], "sentiment": "positive", "confidence": 0.5, "brief_reason": "x"} for h in json.loads(payload)["headlines"][:1]]})

    return research.MarketTools("s", bars.validated(history(spark, close)), news, None, answer)


def test_waits():
    assert [research.wait_before(n) for n in range(3)] == [1, 2, 4] and research.wait_before(0, "7") == 7
    assert research.wait_before(0, "Wed, 07 Oct 2026 10:00:30 GMT", dt.datetime(2026, 10, 7, 10, 0, tzinfo=dt.UTC)) == 30


def test_retries_are_bounded():
    waits, calls = [], []

    def fails(system, payload):
        calls.append(1)
        raise ProviderError("x", "rate_limit")

    with pytest.raises(ProviderError):
        research.with_retries(fails, sleep=waits.append)("a", "b")
    assert waits == [1, 2, 4] and len(calls) == 4

    def late(system, payload):
        raise ProviderError("x", "rate_limit", 100)

    with pytest.raises(ProviderError):
        research.with_retries(late, sleep=waits.append)("a", "b")
    assert len(waits) == 3


def test_parsing():
    assert research.parsed('```json\n{"a": 1}\n```') == {"a": 1}
    for bad in ("[1]", '{"a": NaN}', 'x {"a": 1}'):
        with pytest.raises(ValueError):
            research.parsed(bad)


def test_dispatcher_order(tools):
    d = research.Dispatcher(tools)
    d.start(dt.date(2026, 10, 7))
    tools.ticker = "S"
    try:
        assert not d.call("writer", "get_price_data", {"ticker": "S"}).success
        assert not d.call("researcher", "get_news", {"ticker": "S", "n": 11}).success
        assert not d.call("researcher", "get_news", {"ticker": "T"}).success
        assert not d.call("researcher", "web_search", {"query": "x"}).success
        a = d.call("researcher", "get_news", {"ticker": " s "})
        b = d.call("researcher", "get_news", {"n": 10, "ticker": "S"})
        assert a.success and b.cache_hit and [t["success"] for t in d.trace] == [False] * 4 + [True] * 2
        s = d.call("researcher", "llm_sentiment", {"headlines": [{"title": "Chip demand grows"}, {"title": "Rivals catch up"}]})
        assert s.output["aggregate"]["successful_count"] == 1 and s.output["aggregate"]["failed_count"] == 1
        assert not d.call("researcher", "llm_sentiment", {"headlines": [{"title": "made up"}]}).success
        assert all(len(t["output"]) <= 200 for t in d.trace)
        assert "url" not in json.dumps(research.view(a))
        d.start(dt.date(2026, 10, 8))
        assert not d.cache
    finally:
        tools.ticker = "s"


def report(sigma, ids):
    risk = {"title": "Supply", "supporting_evidence": "Prices moved.", "evidence_ids": ids}
    return {
        "financial_health_summary": "Balance sheet not assessed.", "market_sentiment_summary": f"The 90-day move is {sigma:.2f}%.", "top_three_risks": [risk] * 3, "horizon_days": 90,
        "hedge_strategy_recommendation": {"strategy": "Protective concept.", "data_driven_rationale": "Volatility.", "limitations": "No option chain.", "evidence_ids": ids}, "limitations": ["Short history."],
    }


def scripted(tools):
    """Brief, review, clarification and report; the first report scales sigma wrongly and is sent back."""
    seen = []

    def complete(stage, payload):
        p = json.loads(payload)
        seen.append(stage)
        used = {o["tool"]: o for o in p.get("observations", []) if o["success"]}
        call = lambda tool, **a: json.dumps({"kind": "tool", "tool": tool, "arguments": a})
        finish = lambda out: json.dumps({"kind": "finish", "output": out})
        if stage == "analyst_brief":
            if "calculate_volatility" not in used:
                return call("calculate_volatility", ticker=tools.ticker)
            o = used["calculate_volatility"]
            return finish({"metrics": [{"name": "annualized_volatility", "value": o["output"]["annualized_volatility"], "evidence_id": o["evidence_id"]}]})
        if stage == "writer_review":
            return finish({"question": "?"}) if p["feedback"] is None and not used else call("get_news", ticker=tools.ticker) if "get_news" not in used else finish({"question": "why"})
        if stage == "analyst_clarify":
            return finish({"answer": "so"})
        v = used["calculate_volatility"]["output"]["annualized_volatility"]
        right = 100 * v * math.sqrt(90 / 252)
        return finish(report(right if p["feedback"] else 100 * v, [used["calculate_volatility"]["evidence_id"]]))

    return complete, seen


def test_two_agents_end_with_a_grounded_report(tools):
    tools.ticker = "S"
    try:
        complete, seen = scripted(tools)
        done = research.two_agents(research.Dispatcher(tools), complete, "q", dt.date(2026, 10, 7))
        assert done["report"].output is not None, [(k, s.error, s.events) for k, s in done.items()]
        assert seen.count("writer_report") == 2 and ("rejected" in [e for e, _ in done["report"].events])
        answer = research.follow_up(done["report"], "?", lambda s, p: json.dumps({"answer": "a", "evidence_ids": ["final_report"]}))
        assert answer["answer"] == "a"
        assert research.follow_up(done["report"], "?", lambda s, p: json.dumps({"answer": "a", "evidence_ids": ["obs-99"]})) is None
    finally:
        tools.ticker = "s"


def test_a_failed_call_is_not_repeated(tools):
    calls = []

    def complete(stage, payload):
        calls.append(json.loads(payload))
        return json.dumps({"kind": "tool", "tool": "web_search", "arguments": {"query": "x"}})

    d = research.Dispatcher(tools)
    s = research.run_stage(d, complete, "researcher", "report", "q", lambda o, _: o, budget=4)
    assert s.error and d.calls == 1 and [e for e, _ in s.events].count("blocked") == 3


def test_transport_failures_end_a_stage(tools):
    def complete(stage, payload):
        raise ProviderError("down")

    assert research.run_stage(research.Dispatcher(tools), complete, "researcher", "report", "q", lambda o, _: o).error == "the provider failed twice"


def test_completion_column(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, payload string")

    def upper(system, payload):
        if payload == "b":
            raise ProviderError("x")
        return payload.upper()

    assert {r["id"]: r["answer"] for r in research.completed(df, upper, "s").collect()} == {1: "A", 2: None}


def test_every_tool_has_argument_rules():
    assert set(research.ARGUMENTS) == set(evidence.ROLE_TOOLS["researcher"])
