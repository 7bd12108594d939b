"""Typed records, nested secrets, commits, resumed journals, file digests and views."""

from __future__ import annotations

import hashlib
import json
import threading
from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from tarnwell.functions import rules, scalar, typed
from tarnwell.functions.config import JournalError, ProviderError
from tarnwell.operators import dataset
from tarnwell.sources import bars, commits, ledger, provider, records, sinks


def broken(spark, rule_set, *values):
    rows = [(v if v is None or isinstance(v, str) else json.dumps(v),) for v in values]
    x = spark.createDataFrame(rows, "j string").coalesce(1).select(typed.parsed(F.col("j")).alias("v"))
    return [r["b"] for r in x.select(rules.broken(rule_set(F.col("v"))).alias("b")).collect()]


HEADLINE = {"headline": "h", "sentiment": "positive", "confidence": 0.5, "brief_reason": "r"}


def test_headlines_are_not_coerced(spark):
    h = HEADLINE
    all_ = ["keys", "headline", "sentiment", "confidence", "brief_reason"]
    got = broken(
        spark, typed.headline_sentiment, h, h | {"confidence": 1}, h | {"confidence": "0.5"}, h | {"confidence": True}, h | {"confidence": 1.01}, h | {"confidence": None}, h | {"more": None}, h | {"sentiment": "POSITIVE"},
        h | {"headline": " \n"}, h | {"brief_reason": "x" * 501}, h | {"brief_reason": f"  {'x' * 500}\n"}, {}, [h], "no json", None, '{"confidence": NaN}',
    )
    assert got == [[], [], *[["confidence"]] * 4, ["keys"], ["sentiment"], ["headline"], ["brief_reason"], [], all_[1:], all_, all_, all_, all_]


def test_examples_keep_to_the_taxonomy(spark):
    e = {"id": "triage_0001", "topic": "sanctions", "policy_excerpt": "p" * 30, "scenario": "s" * 20, "category": "Sanctions", "risk_level": "low", "recommended_action": "a" * 5, "rationale": "r" * 15}
    got = broken(spark, typed.policy_example, e, e | {"category": "KYC"}, e | {"topic": "unheard", "category": "Sanctions"}, e | {"id": "a b"}, e | {"id": "x" * 81}, e | {"id": 5}, e | {"risk_level": "LOW"}, e | {"scenario": "s" * 2001}, e | {"rationale": "r" * 14}, e | {"x": 1})
    assert got == [[], ["taxonomy"], ["taxonomy"], ["id"], ["id"], ["id"], ["risk_level"], ["scenario"], ["rationale"], ["keys"]]


@pytest.mark.parametrize(("tool", "args", "want"), [
    ("get_news", {"ticker": "N"}, []), ("get_news", {"ticker": "N", "n": 11}, ["n"]), ("get_news", {"ticker": "N", "n": 2.5}, ["n"]), ("get_news", {"n": 2}, ["ticker"]), ("get_news", {"ticker": "N", "window": 5}, ["keys"]),
    ("calculate_volatility", {"ticker": "N", "window": 252}, []), ("calculate_volatility", {"ticker": "N", "window": True}, ["window"]), ("web_search", {"query": ""}, ["query"]), ("web_search", {"query": "q" * 500}, []), ("web_search", {}, ["query"]),
    ("llm_sentiment", {"headlines": []}, ["headlines"]), ("llm_sentiment", {"headlines": [{}] * 10}, []), ("llm_sentiment", {"headlines": ["t"]}, ["headlines"]), ("get_price_data", {"ticker": "N", "period": 2}, ["period"]), ("sell", {}, ["tool", "keys"]),
])
def test_arguments_of_each_tool(spark, tool, args, want):
    assert broken(spark, lambda v: typed.tool_arguments(v, F.lit(tool)), args) == [want]


def test_reports_are_checked_to_the_last_level(spark):
    risk = {"title": "t", "supporting_evidence": "e", "evidence_ids": ["a"]}
    hedge = {"strategy": "s", "data_driven_rationale": "d", "evidence_ids": ["a"], "limitations": "l"}
    r = {"ticker": "N", "as_of": "2026-01-02", "horizon_days": 90, "financial_health_summary": "f", "market_sentiment_summary": "m", "top_three_risks": [risk] * 3, "hedge_strategy_recommendation": hedge, "limitations": ["x"]}
    part = lambda **k: r | {"top_three_risks": [risk, risk, risk | k]}
    bad = [["top_three_risks"]] * 6
    got = broken(
        spark, typed.research_report, r, r | {"top_three_risks": [risk] * 2}, part(extra=1), part(evidence_ids=[]), part(evidence_ids=["a", 5]), part(title="t" * 101), part(supporting_evidence=None), r | {"horizon_days": 90.5}, r | {"horizon_days": "90"},
        r | {"financial_health_summary": "f" * 801}, r | {"as_of": "2026-02-30"}, r | {"limitations": []}, r | {"hedge_strategy_recommendation": hedge | {"limitations": ["l"]}}, r | {"hedge_strategy_recommendation": None}, r | {"clarification_used": 5},
    )
    hedged = ["hedge_strategy_recommendation"]
    assert got == [[], *bad, ["horizon_days"], ["horizon_days"], ["financial_health_summary"], ["as_of"], ["limitations"], hedged, hedged, ["clarification_used"]]
    assert broken(spark, lambda v: typed.research_report(v, writer=True), r, r | {"clarification_used": "c"}) == [["clarification_used"], []]


def plain_redact(v):
    import re

    if isinstance(v, dict):
        return {k: "[REDACTED]" if re.search("key|token|secret|password|authorization", k, re.I) else plain_redact(x) for k, x in v.items()}
    if isinstance(v, list):
        return [plain_redact(x) for x in v]
    if isinstance(v, str):
        v = v.replace("hush", "[REDACTED]")
        return re.sub(r"(?i)Bearer\s+[A-Za-z0-9._-]+", "Bearer [REDACTED]", re.sub(r"(?:gsk_|sk-|hf_)[A-Za-z0-9_-]{8,}", "[REDACTED]", v))
    return v


def test_nested_values_lose_their_secrets(spark):
    values = [
        {"a": {"api_key": 5, "b": ["x sk-0123456789 y", {"Password": {"z": 1}, "q": [1, 2.5, None, True, "é \"q\" \\ \n"]}]}}, [1, [2, [3, ["bearer abc.def, hush"]]]], "hf_abcdefgh12", {}, [], 17, None, {"authorization": ["a"], "x": {"TokenList": {}}}, [[[[[{"k": "sk-0123456789"}]]]]],
    ]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, j string")
    got = df.select("i", scalar.redacted_json(F.col("j"), ("hush",)).alias("r")).orderBy("i").collect()
    assert [json.loads(r["r"]) for r in got] == [plain_redact(v) for v in values]
    odd = spark.createDataFrame([("not json sk-0123456789",), (None,)], "j string").select(scalar.redacted_json(F.col("j")).alias("r")).collect()
    assert [r["r"] for r in odd] == ['"not json [REDACTED]"', None]


def test_what_lies_too_deep_goes_whole(spark):
    value = json.dumps({"a": {"b": {"c": "sk-0123456789", "d": [1]}, "e": "kept"}})
    got = spark.createDataFrame([(value,)], "j string").select(scalar.redacted_json(F.col("j"), depth=2).alias("r")).first()["r"]
    assert json.loads(got) == {"a": {"b": "[REDACTED]", "e": "kept"}}


# Commits


def test_a_batch_is_published_once_and_whole(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    commits.publish(spark.range(5), path, "one")
    before = {p: p.read_bytes() for p in (tmp_path / "log").rglob("part*")}
    with pytest.raises(JournalError):
        commits.publish(spark.range(7), path, "one")
    with pytest.raises(ValueError):
        commits.publish(spark.range(7), path, "../one")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        commits.publish(spark.range(9).select((F.lit(1) / (F.col("id") - 8)).alias("id")), path, "two")
    commits.publish(spark.range(5, 8), path)
    assert all(p.read_bytes() == b for p, b in before.items()) and not list((tmp_path / "log" / "_attempts").iterdir())
    (tmp_path / "log" / "_attempts" / "killed").mkdir()
    (tmp_path / "log" / "_attempts" / "killed" / "part-0.json").write_text('{"id": 99}\n')
    assert sorted(r["id"] for r in spark.read.schema("id long").option("recursiveFileLookup", "true").json(path).collect()) == list(range(8))


def test_of_two_writers_of_a_batch_one_succeeds(spark, tmp_path):
    path, done, refused = f"file://{tmp_path}/log", [], []

    def write(n, key):
        try:
            commits.publish(spark.range(n * 10, n * 10 + 10), path, key)
            done.append(n)
        except JournalError:
            refused.append(n)

    threads = [threading.Thread(target=write, args=(n, "same" if n < 4 else f"own-{n}")) for n in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(done) == 3 and len(refused) == 3 and {4, 5} <= set(done)
    got = sorted(r["id"] for r in spark.read.schema("id long").option("recursiveFileLookup", "true").json(path).collect())
    assert got == sorted(x for n in done for x in range(n * 10, n * 10 + 10))


def test_a_resumed_journal(spark, tmp_path):
    """Two runs fill the plan; foreign and mutated journals are refused before a byte is written."""
    path, plan = f"file://{tmp_path}/journal", spark.createDataFrame([(f"t{i:02}", "KYC") for i in range(12)], "id string, topic string")
    calls = []

    def produce(todo, first, fail=()):
        calls.append(sorted(r["id"] for r in todo.collect()))
        each = todo.groupBy("batch_id").agg(F.collect_list(F.create_map(F.lit("id"), F.col("id"), F.lit("topic"), F.col("topic"))).alias("assignments"))
        return each.select("batch_id", F.lit("m").alias("teacher_model"), F.lit(1).cast("long").alias("seed"), F.lit("sha").alias("system_prompt_sha256"), "assignments", F.when(~F.col("batch_id").isin(*fail or (-1,)), "{}").alias("response"), F.when(F.col("batch_id").isin(*fail or (-1,)), "timeout").alias("error_category"))

    def accepted(journal):
        return journal.where("error_category is null").select(F.explode("assignments").alias("a")).select(F.col("a")["id"].alias("id"))

    run = lambda p=produce, **k: records.resume(spark, path, plan, accepted, p, **({"seed": 1, "prompt_sha": "sha", "model": "m", "size": 5} | k))
    assert run(lambda todo, first: produce(todo, first, fail=(2,))) == 12
    assert run() == 5 and run() == 0 and [len(c) for c in calls] == [12, 5]
    journal = records.read_journal(spark, path, 1, "sha", "m")
    assert sorted(r["batch_id"] for r in journal.collect()) == [1, 2, 3, 4] and accepted(journal).distinct().count() == 12
    files = sorted((tmp_path / "journal").rglob("part*"))
    for wrong in ({"seed": 2}, {"prompt_sha": "other"}, {"model": "n"}):
        with pytest.raises(JournalError):
            run(**wrong)
    with pytest.raises(JournalError, match="plan"):
        records.resume(spark, path, plan.withColumn("topic", F.lit("AML")), accepted, produce, 1, "sha", "m")
    with pytest.raises(JournalError, match="another run"):
        records.resume(spark, path, plan.unionByName(spark.createDataFrame([("t99", "KYC")], plan.schema)), accepted, lambda t, b: produce(t, b).withColumn("seed", F.lit(9).cast("long")), 1, "sha", "m")
    assert sorted((tmp_path / "journal").rglob("part*")) == files


def test_file_digests_are_those_of_the_bytes(spark, tmp_path):
    df = spark.range(500).select("id", F.lit("t").alias("topic"), F.lit("low").alias("risk")).repartition(3)
    sinks.save_splits(dataset.stratified_split(df), f"{tmp_path}/s")
    want = {(p.parent.name.removeprefix("split="), p.name): (len(p.read_bytes()), hashlib.sha256(p.read_bytes()).hexdigest()) for p in (tmp_path / "s" / "splits").rglob("part-*.json")}
    got = {(r["split"], r["file"]): (r["bytes"], r["sha256"]) for r in spark.read.json(f"{tmp_path}/s/files").collect()}
    assert got == want and len(want) >= 3
    for r in spark.read.json(f"{tmp_path}/s/manifest").collect():
        own = sorted((f, sha) for (s, f), (_, sha) in want.items() if s == r["split"])
        assert r["files_sha256"] == hashlib.sha256("\n".join(f"{f} {sha}" for f, sha in own).encode()).hexdigest()
        assert (r["ratio"], r["n"], r["files"]) == ({"train": 0.8}.get(r["split"], 0.1), {"train": 400}.get(r["split"], 50), len(own))


# Views and scans


def test_views_of_failed_and_empty_outputs(spark):
    obs = spark.createDataFrame([("a", '{"ticker":"N","row_count":7,"as_of":"2026-01-02","rows":[{"date":"2025-01-01"}]}', '{"headline_count":4}'), ("b", '{"rows":[]}', '{"headlines":[{},{}]}'), ("c", "no json", None), ("d", None, "{}")], "evidence_id string, output string, arguments string")
    prices = {r["evidence_id"]: (r["ticker"], r["row_count"], r["as_of"]) for r in records.price_views(obs).collect()}
    assert prices == {"a": ("N", 7, "2026-01-02"), "b": (None, 0, None), "c": (None, 0, None), "d": (None, 0, None)}
    assert {r["evidence_id"]: r["headline_count"] for r in records.sentiment_views(obs).collect()} == {"a": 4, "b": 2, "c": 0, "d": 0}
    assert [r["headlines"] for r in records.news_views(obs).collect()] == [None] * 4


def test_feed_addresses(spark):
    got = spark.createDataFrame([("BRK-B ~*",)], "t string").select(records.rss_address(F.col("t"))).first()[0]
    assert got == "https://news.google.com/rss/search?q=%22BRK-B+~%2A%22+stock+when%3A7d&hl=en-US&gl=US&ceid=US%3Aen"


def test_a_prompt_is_read_whole(spark, tmp_path):
    (tmp_path / "prompt.txt").write_text("one\n\ntwo é\n")
    assert records.read_prompt(spark, f"{tmp_path}/prompt.txt") == "one\n\ntwo é\n"


def test_a_period_reaches_the_scan(spark, tmp_path):
    days = spark.range(2000).select(F.lit("s").alias("series"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("d"), F.lit(1.0).alias("close"))
    days.write.parquet(f"{tmp_path}/h")
    got = bars.scan_history(spark, f"{tmp_path}/h", "2024-06-01", "2y")
    assert (got.agg(F.min("d").cast("string"), F.max("d").cast("string")).first()[:]) == ("2022-06-01", "2024-06-01")
    assert "PushedFilters: [IsNotNull(d), GreaterThanOrEqual(d,2022-06-01)" in got._jdf.queryExecution().toString()


# Providers


def test_a_request_is_asked_once(spark, tmp_path):
    """Rows that repeat, runs that follow, a run that was killed after some answers, and a failed request."""
    asked, path = tmp_path / "asked", f"file://{tmp_path}/ledger"
    asked.mkdir()

    def complete(system, payload):
        import uuid as u

        (asked / u.uuid4().hex).write_text(payload)
        if payload == "down":
            raise ProviderError("down")
        return payload.upper()

    calls = lambda: sorted(p.read_text() for p in asked.iterdir())
    df = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "b", "a", None, "down", "b"])], "i int, payload string")
    got = lambda x: {r["i"]: r["answer"] for r in ledger.completed(x, complete, "s", path).collect()}
    want = {0: "A", 1: "B", 2: "A", 3: None, 4: None, 5: "B"}
    assert got(df) == want and calls() == ["a", "b", "down"]
    assert got(df) == want and calls() == ["a", "b", "down", "down"]
    notes = tmp_path / "ledger" / "_notes" / "killed"
    notes.mkdir(parents=True)
    keys = {r["payload"]: r["k"] for r in spark.createDataFrame([("c",), ("d",)], "payload string").select("payload", ledger.request_key("s", F.col("payload")).alias("k")).collect()}
    (notes / "0-x.jsonl").write_text(json.dumps({"request": keys["c"], "answer": "C!"}) + '\n{"request": "' + keys["d"][:9])
    assert got(spark.createDataFrame([(0, "c"), (1, "d")], df.schema)) == {0: "C!", 1: "D"} and calls() == ["a", "b", "d", "down", "down"]
    assert not list((tmp_path / "ledger" / "_notes").iterdir())
    assert ledger.completed(df, lambda s, p: p, "other system", path).where("i = 0").first()["answer"] == "a"


def test_a_task_that_is_tried_again_goes_on(tmp_path):
    """The second attempt of a task asks only for what the first has not noted."""
    folder, asked = f"file://{tmp_path}/notes", []

    def complete(system, payload):
        asked.append(payload)
        if payload == "p3" and asked.count("p3") == 1:
            raise RuntimeError("executor lost")
        return payload.upper()

    rows = pd.DataFrame({"request": [f"k{i}" for i in range(6)], "payload": [f"p{i}" for i in range(6)]})
    run = ledger.asker(complete, "s", folder, partition=lambda: 4)
    with pytest.raises(RuntimeError):
        list(run(iter([rows])))
    got = pd.concat(list(run(iter([rows]))))
    assert got["answer"].tolist() == [f"P{i}" for i in range(6)]
    assert asked == ["p0", "p1", "p2", "p3", "p3", "p4", "p5"]


def test_filters_narrow_what_a_provider_is_asked(spark, tmp_path):
    days = spark.range(1000).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("d"), *[F.lit(1.0).alias(c) for c in ("open", "high", "low", "close", "volume")])
    for s in ("a", "b"):
        days.select(F.lit(s).alias("series"), "*").coalesce(1).write.parquet(f"{tmp_path}/{s}.parquet")
    provider.register(spark)
    load = lambda series: spark.read.format("price_history").options(folder=f"file://{tmp_path}", series=series, start="2020-01-01", end="2022-12-31", days="100").load()
    x = load("a,b").where((F.col("series") == "a") & (F.col("d") >= F.lit("2020-03-01").cast("date")) & (F.col("d") < F.lit("2020-08-01").cast("date")) & (F.col("close") > 0))
    assert x.count() == 153 and x.rdd.getNumPartitions() == 2
    assert load("a,b").count() == 2000 and load("a").where("d > '2030-01-01'").count() == 0
    with pytest.raises(Exception, match="no history of c"):
        load("c").count()
    reader = provider.HistoryReader({"folder": "f", "series": "a,b,c", "start": "2020-01-01", "end": "2020-12-31"})
    left = list(reader.pushFilters([In(("series",), ("a", "c", "z")), GreaterThan(("d",), date(2020, 5, 1)), EqualTo(("close",), 1.0)]))
    assert left == [EqualTo(("close",), 1.0)] and [(s.series, s.start, s.end) for s in reader.partitions()] == [(s, date(2020, 5, 2), date(2020, 12, 31)) for s in "ac"]
