"""Payloads, budgets, the paced teacher, synthesis with one repair, fault injection, files of records."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tarnwell.functions.config import FetchError, GroundingError, IndicatorConfig, ProviderError
from tarnwell.functions import scalar
from tarnwell.operators import dataset, evidence
from tarnwell.plans import generation, research
from tarnwell.sources import records, sinks


def test_payloads_show_the_last_five_scenarios():
    got = json.loads(generation.batch_payload([{"id": "a"}], [f"s{i}" for i in range(8)]))
    assert got == {"assignments": [{"id": "a"}], "avoid_similar_scenarios": ["s3", "s4", "s5", "s6", "s7"]}


def test_schemas_lose_presentation_but_not_names():
    schema = {"title": "T", "properties": {"title": {"title": "x", "type": "string", "default": ""}, "n": {"anyOf": [{"type": "null", "description": "d"}]}}}
    assert generation.compacted(schema) == {"properties": {"title": {"type": "string"}, "n": {"anyOf": [{"type": "null"}]}}}


def test_budgets():
    b = generation.TokenBudgets()
    assert (b.of("analyst_brief"), b.of("sentiment"), b.of("odd"), b.of(None)) == (1200, 384, 1800, 1800)
    for bad in (0, 4097, True, 1.0):
        with pytest.raises(ValueError, match="brief"):
            generation.TokenBudgets(brief=bad)


def scripted(*said):
    """A provider that says one thing after another, and the modes it was asked in."""
    modes, left = [], list(said)

    def ask(system, payload, json_mode):
        modes.append(json_mode)
        x = left.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    return ask, modes


def test_teacher_falls_back_to_text_once_and_stops_after_three():
    waits = []
    ask, modes = scripted(ProviderError("x", "json_rejected"), ProviderError("x", "server"), "{}")
    assert generation.Teacher(ask, sleep=waits.append, clock=lambda: 0.0)("s", "p") == "{}" and modes == [True, False, False] and waits == [1, 2]
    ask, modes = scripted(ProviderError("x", "json_rejected"), ProviderError("x", "json_rejected"))
    with pytest.raises(ProviderError):
        generation.Teacher(ask, sleep=waits.append, clock=lambda: 0.0)("s", "p")
    ask, _ = scripted(*[ProviderError("x", "timeout")] * 4)
    with pytest.raises(ProviderError):
        generation.Teacher(ask, sleep=waits.append, clock=lambda: 0.0)("s", "p")
    ask, _ = scripted(" ")
    with pytest.raises(ProviderError, match="empty"):
        generation.Teacher(ask, sleep=waits.append, clock=lambda: 0.0)("s", "p")


def test_teacher_paces_and_shares_its_cooldown():
    now, waits = [100.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    ask, modes = scripted("a", "b", ProviderError("x", "rate_limit", 300), "c")
    t = generation.Teacher(ask, interval=60, sleep=sleep, clock=lambda: now[0])
    assert t("s", "p") == "a" and t("s", "p") == "b" and waits == [60]
    with pytest.raises(ProviderError):
        t("s", "p")
    with pytest.raises(ProviderError, match="quota"):
        t("s", "p")
    assert len(modes) == 3
    now[0] += 250
    assert t("s", "p") == "c" and waits[-1] == 50


def test_synthesis_repairs_once():
    o = research.Observation("obs-1", "researcher", "get_news", {}, {"ticker": "S", "headlines": []}, True)

    def check(output, observations):
        if output["n"] != 1:
            raise GroundingError("n is wrong")
        return output

    asked = []

    def provider(*answers):
        left = list(answers)

        def complete(system, payload):
            asked.append(json.loads(payload)["feedback"])
            return left.pop(0)

        return complete

    assert generation.synthesised(provider('{"n": 2}', '{"kind": "finish", "output": {"n": 1}}'), "q", [o], check).output == {"n": 1} and asked == [None, "n is wrong"]
    got = generation.synthesised(provider('{"m": 2}', "{"), "q", [o], check)
    assert got.output is None and "schema" in got.error and [e[1]["reason"] for e in got.events] == ["schema: n is missing", "schema"]
    assert generation.synthesised(provider('{"n": 1}'), "q", [o], check, draft={"n": 3}).output == {"n": 1}
    assert generation.synthesised(provider(), "q", [o], check, draft={"n": 3}, repaired=True).output is None

    def broken(system, payload):
        raise ProviderError("x", "timeout")

    assert "timeout" in generation.synthesised(broken, "q", [o], check).error


def test_a_tool_fails_once():
    class Tools:
        def get_news(self, n):
            return n

    t = generation.FailingOnce(Tools(), "get_news", FetchError("x"))
    with pytest.raises(FetchError):
        t.get_news(1)
    assert t.get_news(2) == 2


def test_secrets_of_the_environment_are_removed(spark, monkeypatch, tmp_path):
    monkeypatch.setenv("SOME_TOKEN", "hush-hush")
    assert research.redacted({"a": ["say hush-hush"], "api_key": "x"}) == {"a": ["say [REDACTED]"], "api_key": "[REDACTED]"}
    e = spark.createDataFrame([("t", "writer", "web_search", {"q": "hush-hush", "password": "p"}, "hush-hush " + "x" * 300, 1.0, True, False)], records.TRACE_SCHEMA)
    sinks.append_trace(e, str(tmp_path / "trace"))
    sinks.append_trace(e, str(tmp_path / "trace"))
    got = records.read_trace(spark, str(tmp_path / "trace")).collect()
    assert len(got) == 2 and all(r["output"].startswith("[REDACTED] x") and len(r["output"]) == 200 and r["input_arguments"] == {"q": "[REDACTED]", "password": "[REDACTED]"} for r in got)


def test_cache_misses_and_failing_stores(spark, tmp_path):
    path = tmp_path / "c"
    row = spark.createDataFrame([("A", "2026-01-01", "one", 1, "x")], "ticker string, as_of string, workflow string, version int, payload string")
    sinks.save_cache(row, str(path))
    (path / "ticker=A" / "as_of=2026-01-01" / "workflow=two").mkdir()
    (path / "ticker=A" / "as_of=2026-01-01" / "workflow=two" / "part-0.json").write_text("{broken")
    assert [r["workflow"] for r in records.read_cache(spark, str(path), "A", "2026-01-01", 1).collect()] == ["one"]
    with pytest.raises(Exception, match="nowhere"):
        records.read_cache(spark, "nowhere://x/y", "A", "2026-01-01", 1)


def test_clean_records_and_run_summary(spark, tmp_path):
    row = spark.createDataFrame([("a", "KYC", "KYC", "p", "s", "low", "r", "act")], "id string, topic string, category string, policy_excerpt string, scenario string, risk_level string, reason string, action string")
    sinks.write_jsonl(row, str(tmp_path / "clean"))
    assert records.read_examples(spark, str(tmp_path / "clean")).collect() == row.collect()
    (tmp_path / "clean" / "part-x.json").write_text("{broken\n")
    with pytest.raises(Exception):
        records.read_examples(spark, str(tmp_path / "clean")).collect()
    assert json.loads(sinks.run_summary({"seed": 42}, row.groupBy().count())) == {"configuration": {"seed": 42}, "validation": {"count": 1}}


def test_manifest_blocks(spark):
    """Many small blocks give one hash that does not depend on the order or the partitions of rows."""
    df = spark.range(300).select("id", F.lit("KYC").alias("topic"), F.lit("train").alias("split"))
    one, two = (sinks.manifest(x, 42, "topic", block_rows=16).first() for x in (df, df.repartition(7).orderBy(F.desc("id"))))
    assert one == two and one["n"] == 300 and len(one["sha256"]) == 64
    assert sinks.manifest(df.where("id <> 5"), 42, "topic", block_rows=16).first()["sha256"] != one["sha256"]


def test_split_needs_unique_scenarios(spark):
    df = spark.createDataFrame([(i, f"t{i % 5}", dataset.RISKS[i % 3], str(max(i, 1))) for i in range(160)], "id long, topic string, risk string, scenario_key string")
    with pytest.raises(ValueError, match="scenario_key"):
        dataset.stratified_split(df)


def test_indicator_parameters():
    assert IndicatorConfig(sma_short=200, sma_long=50).sma_short == 200
    for bad in ({"sma_short": True}, {"rsi_period": 0}, {"band_width": 0.0}, {"band_width": float("nan")}, {"macd_fast": 26}, {"rsi_period": 2.5}):
        with pytest.raises(ValueError):
            IndicatorConfig(**bad)


def test_titles_and_calls(spark):
    asked = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "b"), (2, 0, "x")], "request int, pos int, title string")
    got = {r["request"]: (r["titles"], r["trusted"]) for r in evidence.trusted_titles(asked, spark.createDataFrame([("a",), ("b",)], "title string")).collect()}
    assert got == {1: (["b", "a"], True), 2: (["x"], False)}
    assert spark.range(1).select(scalar.redacted_values(F.create_map(F.lit("k"), F.lit("sk-123456789")), ()).alias("m")).first()["m"] == {"k": "[REDACTED]"}
