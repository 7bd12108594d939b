"""Text, dataset, evidence, sources, sinks and the registry."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import random
from collections import Counter
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tarnwell.functions import scalar
from tarnwell.functions.config import FetchError, GenerationConfig, JournalError
from tarnwell.operators import claims, dataset, evidence, text
from tarnwell.plans.catalogue import ORACLE_SQL, QUERIES, written
from tarnwell.sources import bars, records, sinks
from tarnwell.streaming import event_stream, run_once, sessions, windowed_bars

DIR = "/root/testdata/sf0.001"


def plain_pass(rows, threshold=0.88):
    """One ordered pass over (id, text)."""
    ids, kept, out = set(), [], []
    for i, t in rows:
        n = text.normalize(t)
        if i in ids:
            out.append((i, "duplicate_id", i))
            continue
        ids.add(i)
        same = next((k for k, m in kept if m == n), None)
        near = next((k for k, m in kept if SequenceMatcher(None, n.split(), m.split(), autojunk=False).ratio() >= threshold), None)
        if same is not None:
            out.append((i, "exact_duplicate", same))
        elif near is not None:
            out.append((i, "near_duplicate", near))
        else:
            kept.append((i, n))
            out.append((i, "kept", None))
    return out


def noisy_copies(seed, n):
    rng, rows = random.Random(seed), []
    for i in range(n):
        if rows and rng.random() < 0.7:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice("abcdefgh") * 2
            t = " ".join(w)
        else:
            t = " ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(rng.randrange(0, 14)))
        rows.append((f"id{rng.randrange(n - n // 12)}", t))
    return rows


def plain_stats(rows, threshold=0.88):
    """Comparisons and highest similarity of one ordered pass."""
    ids, kept, made, most = set(), [], 0, 0.0
    for i, t in rows:
        n = text.normalize(t)
        if i in ids or n in kept:
            ids.add(i)
            continue
        ids.add(i)
        for m in kept:
            made += 1
            score = SequenceMatcher(None, n.split(), m.split(), autojunk=False).ratio()
            most = max(most, score)
            if score >= threshold:
                break
        else:
            kept.append(n)
    return made, most


@pytest.mark.parametrize(("seed", "limits"), [(11, {}), (12, {"pairs_a_row": 4}), (13, {"judged_a_row": 0, "least_judged": 6})])
def test_dedup_equals_one_pass(spark, monkeypatch, seed, limits):
    """In one batch, and in several as elements or pairs to judge are too many; elements in cells of three texts."""
    if limits:
        monkeypatch.setattr(text, "CELL", 3)
    rows = noisy_copies(seed, 120)
    df = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(rows)], "rank long, id string, text string")
    result = written(text.deduplicated(df, written, **limits))
    got = [(r["id"], r["status"], r["duplicate_of"]) for r in result.orderBy("rank").collect()]
    assert got == plain_pass(rows)
    stats = text.similarity_stats(df, result, written).first()
    assert (stats["comparisons"], stats["maximum_similarity"]) == (plain_stats(rows)[0], pytest.approx(plain_stats(rows)[1]))


def test_similarity_without_near_rows(spark):
    """The highest similarity lies far below the threshold, or no two texts share a word, or there is one text."""
    for rows in ([("a", "u v w x y z"), ("b", "u b c d e f"), ("c", "p q r x y s")], [("a", "one two"), ("b", "three four"), ("c", "")], [("a", "one")]):
        df = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(rows)], "rank long, id string, text string")
        stats = text.similarity_stats(df, written(text.deduplicated(df, written)), written).first()
        assert (stats["comparisons"], stats["maximum_similarity"]) == (plain_stats(rows)[0], pytest.approx(plain_stats(rows)[1]))


def test_a_large_cluster_meets_its_leader_only(spark, monkeypatch):
    """20,000 near copies of one text: the pairs that are judged are in proportion to the rows."""
    judged = []
    ratios = text._ratios

    def counted(pairs, texts, threshold):
        judged.append(pairs.count())
        return ratios(pairs, texts, threshold)

    monkeypatch.setattr(text, "_ratios", counted)
    base = [f"w{i}" for i in range(30)]
    at = F.array(*[F.when(F.pmod("rank", F.lit(30)) == i, F.concat(F.lit("own"), F.col("rank").cast("string"))).otherwise(F.lit(w)) for i, w in enumerate(base)])
    df = spark.range(20_000).withColumnRenamed("id", "rank").select("rank", F.col("rank").cast("string").alias("id"), F.array_join(at, " ").alias("text"))
    got = text.deduplicated(df, written, least_judged=2_000)
    assert {(r["status"], r["of"]): r["count"] for r in got.groupBy("status", "of").count().collect()} == {("kept", None): 1, ("near_duplicate", 0): 19_999}
    assert sum(judged) < 3 * 20_000


def test_few_keys_are_told_of_and_few_texts_shuffled(spark):
    """Texts of one small vocabulary, where every element is in many: no near pair is lost, few others meet, and texts without a near one are left out of the joins of texts."""
    rng, rows = random.Random(8), []
    for i in range(400):
        w = rng.choice(rows)[1].split() if i % 10 == 9 else [f"w{min(int(rng.paretovariate(0.5)), 600)}" for _ in range(rng.randrange(2, 260))]
        for _ in range(rng.randrange(1 + len(w) // 12) if i % 10 == 9 else 0):
            w[rng.randrange(len(w))] = f"w{rng.randrange(400)}"
        rows.append((i, " ".join(w + [f"w{rng.randrange(400)}" for _ in range(len(w) // 9)] if i % 20 == 19 else w)))
    bags = [Counter(t.split()) for _, t in rows]
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if 2 * (bags[i] & bags[j]).total() >= 0.88 * (bags[i].total() + bags[j].total()) - 1e-9}
    df = spark.createDataFrame(rows, "id long, norm string")
    own = written(text.profiles(df))
    told = [{tuple(sorted(r)) for r in text._met(own, own, 0.88, True, t).collect()} for t in range(text.PASSES)]
    assert want <= set().union(*told) and sum(map(len, told)) < 79_800 // 4  # of all pairs
    got = {(r["a"], r["b"]) for r in text.overlap_candidates(df, written).collect()}
    assert got == want and len(want) > 15
    near = df.sparkSession.createDataFrame(sorted(want), "a long, b long")
    kept = {r["id"] for r in text._marked(df, near).select("id").collect()}
    assert {i for p in want for i in p} <= kept and len(kept) < 200


@pytest.mark.parametrize("threshold", [0.88, 0.5])
def test_few_texts_are_copied_for_pairs(spark, monkeypatch, threshold):
    """Texts of common words: all pairs whose words suffice are found, and few others get so far that texts are joined, which is what filled disks."""
    judged, paired = [], text._paired

    def counted(pairs, texts):
        judged.append(pairs.count())
        return paired(pairs, texts)

    monkeypatch.setattr(text, "_paired", counted)
    rng, rows = random.Random(5), []
    for i in range(240):
        w = rng.choice(rows)[1].split() if i % 3 == 2 else [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(rng.randrange(1, 160))]
        for _ in range(rng.randrange(1 + len(w) // 5)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(400)}"
        rows.append((i, " ".join(w)))
    bags = [Counter(t.split()) for _, t in rows]
    want = {}
    for b, y in enumerate(bags):
        for a, x in enumerate(bags[:b]):
            o, n = (x & y).total(), x.total() + y.total()
            if rows[a][1] != rows[b][1] and 2 * o >= threshold * n - 1e-9:
                want[a, b] = o
    df = written(spark.createDataFrame(rows, "id long, norm string"))
    got = text.overlap_candidates(df, written, threshold, text.one_per_text(df)).collect()
    first = {i for i, (_, t) in enumerate(rows) if t not in [u for _, u in rows[:i]]}
    assert {(r["a"], r["b"]): r["overlap"] for r in got} == {k: o for k, o in want.items() if set(k) <= first}
    assert judged[0] < 3 * len(got) + 100


def test_places_without_one_sorted_task(spark):
    df = spark.range(0, 5000, 7).withColumnRenamed("id", "x").repartition(6)
    got = text.places(df, "x", written).orderBy("x").collect()
    assert [r["place"] for r in got] == list(range(1, len(got) + 1))


def test_normalisation():
    assert text.normalize("Ｆｕｌｌ  Straße, It's") == "full strasse it s"


def test_headlines_are_deduplicated_before_the_cut(spark):
    rows = [(0, " A  b"), (1, "a B"), (2, ""), (3, "c"), (4, "d")]
    df = spark.createDataFrame(rows, "pos long, title string")
    assert [r["pos"] for r in text.headlines(df, 2).orderBy("pos").collect()] == [0, 3]
    more = spark.createDataFrame([(0, "C"), (1, "e")], "pos long, title string")
    assert [r["title"] for r in text.headline_union(df, more, 9).orderBy("source_rank", "pos").collect()] == [" A  b", "c", "d", "e"]


def test_news_records(spark):
    raw = [
        (0, json.dumps({"content": {"title": " T1 ", "provider": {"displayName": "P"}, "publisher": "Q", "canonicalUrl": {"url": "https://u"}, "pubDate": "2026-01-02T03:04:05Z"}})),
        (1, json.dumps({"title": "t1", "publisher": "Q"})),
        (2, json.dumps({"title": "T2", "publisher": "Q", "link": "https://l", "providerPublishTime": 0})),
        (3, json.dumps({"title": "  "})),
        (4, "not json"),
    ]
    got = {r["title"]: r for r in records.news_rows(spark.createDataFrame(raw, "pos long, value string")).collect()}
    assert set(got) == {"T1", "T2"} and got["T1"]["publisher"] == "P" and got["T1"]["url"] == "https://u"
    assert got["T1"]["published"] == dt.datetime(2026, 1, 2, 3, 4, 5) and got["T2"]["published"] == dt.datetime(1970, 1, 1)


def test_rss(spark):
    item = "<item><title>{}</title><link>{}</link><pubDate>{}</pubDate><source>Pub</source></item>"
    feed = "<rss><channel>" + "".join([
        item.format("News - Pub", "https://a", "Tue, 06 Oct 2026 10:00:00 GMT"), item.format("news", "https://b", "Wed, 07 Oct 2026 10:00:00 GMT"),
        item.format("Old", "https://c", "Tue, 01 Sep 2026 10:00:00 GMT"), item.format("Plain", "http://d", "Wed, 07 Oct 2026 10:00:00 GMT"), item.format("Undated", "https://e", "soon"),
    ]) + "</channel></rss>"
    df = spark.createDataFrame([(feed,), ("<!DOCTYPE x>" + feed.replace("News", "Bad"),)], "payload string")
    got = records.rss_items(df, "2026-10-08 00:00:00").collect()
    assert [(r["title"], r["url"]) for r in got] == [("news", "https://b")]


def test_search_rows(spark):
    rows = [(0, "a", "https://x", "s" * 2000), (1, " ", "https://x", ""), (2, "b", "ftp://x", "")]
    got = records.search_rows(spark.createDataFrame(rows, "pos long, title string, url string, snippet string")).collect()
    assert [(r["title"], len(r["snippet"])) for r in got] == [("a", 1500)]


def test_journal_round_trip_and_refusal(spark, tmp_path):
    path = str(tmp_path / "journal")
    line = lambda b, seed=1: (b, "m", seed, "sha", [{"id": "a"}], json.dumps({"examples": [{"id": "a", "topic": "KYC"}, {"id": "b", "topic": 5}]}), None)
    df = spark.createDataFrame([line(1)], records.JOURNAL_SCHEMA)
    sinks.append_journal(df, path)
    before = {p: p.read_bytes() for p in (tmp_path / "journal").rglob("part*")}
    assert before
    sinks.append_journal(spark.createDataFrame([line(2)], records.JOURNAL_SCHEMA), path)
    assert all(p.read_bytes() == b for p, b in before.items())
    got = records.read_journal(spark, path, 1, "sha", "m")
    assert got.count() == 2 and dataset.next_batch(got).first()[0] == 3
    assert records.batch_candidates(got, "id:string,topic:string").where("batch_id = 1").count() == 2
    with pytest.raises(JournalError):
        records.read_journal(spark, path, seed=7)
    sinks.append_journal(df, path)
    with pytest.raises(JournalError):
        records.read_journal(spark, path)


def test_plan_is_balanced_and_the_same_again(spark):
    plan = dataset.assignment_plan(spark).cache()
    for c in ("topic", "target_risk"):
        n = [r["count"] for r in plan.groupBy(c).count().collect()]
        assert max(n) - min(n) <= 1
    assert plan.exceptAll(dataset.assignment_plan(spark)).isEmpty() and plan.count() == 160
    batch = dataset.batches(plan)
    assert batch.groupBy("batch_id").count().where("count <> 5").isEmpty() and batch.agg(F.max("batch_id")).first()[0] == 32


def test_all_headlines_of_both_sources(spark):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    got = sorted(tuple(r) for r in QUERIES["headlines_fallback"](spark, "/root/testdata/sf0.01").collect())
    assert got == sorted(con.execute(ORACLE_SQL["headlines_fallback"]).fetchall()) and len(got) > 500
    assert {r[2] for r in got} == {0, 1}


def equal_over_table(spark, name):
    """The query's rows over sf0.01, equal to its SQL."""
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    got = QUERIES[name](spark, "/root/testdata/sf0.01")
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(con.execute(f"select {', '.join(got.columns)} from ({ORACLE_SQL[name]})").fetchall(), key=str)
    return rows


def test_an_assignment_for_each_document(spark):
    assert len(equal_over_table(spark, "assignment_plan")) == 1000


def test_pending_assignments_of_all_documents(spark):
    assert len(equal_over_table(spark, "pending_assignments")) == 1000 - 5 * (200 // 3)


def test_error_categories_of_all_events(spark):
    rows = equal_over_table(spark, "error_categories")
    assert len(rows) == 10_000 and len({r[1] for r in rows}) == 501


def test_policy_excerpts_of_all_documents(spark):
    rows = equal_over_table(spark, "policy_excerpts")
    assert len(rows) == 1000 and {r[2] for r in rows} == {0, 1}


def test_acceptance_reasons(spark):
    ask = spark.createDataFrame([(1, "a", "KYC", "KYC", "p" * 40, "low"), (1, "b", "KYC", "KYC", "p" * 40, "low"), (2, "c", "KYC", "KYC", "p" * 40, "low")], "batch_id long, id string, topic string, category string, policy_excerpt string, target_risk string")
    rows = [
        (1, 0, "a", "KYC", "KYC", "p" * 40, "wrong", "s" * 30), (1, 1, "a", "KYC", "KYC", "p" * 40, "low", "s" * 30), (1, 2, "a", "KYC", "KYC", "p" * 40, "low", "s" * 30),
        (1, 3, "z", "KYC", "KYC", "p" * 40, "low", "s" * 30), (1, 4, "b", "AML", "KYC", "p" * 40, "low", "s" * 30), (2, 0, "c", "KYC", "KYC", "p" * 40, "high", "s" * 30), (2, 1, "c", "KYC", "KYC", "p" * 40, "low", "s"),
    ]
    df = spark.createDataFrame(rows, "batch_id long, pos long, id string, topic string, category string, policy_excerpt string, risk_level string, scenario string")
    got = [r["reason"] for r in dataset.accept(df, ask).orderBy("batch_id", "pos").collect()]
    assert got == ["schema_validation", "accepted", "duplicate_id", "unrequested_id", "assignment_mismatch", "assigned_risk_mismatch", "schema_validation"]


def test_split_sizes_and_levels(spark):
    rows = [(i, f"t{i % 5}", dataset.RISKS[i % 3]) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, topic string, risk string")
    got = dataset.stratified_split(df).cache()
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 128, "validation": 16, "test": 16}
    assert got.exceptAll(dataset.stratified_split(df)).isEmpty() and dataset.leakage(got, ("id",)).isEmpty()
    assert dataset.split_sizes(120) == {"train": 96, "validation": 12, "test": 12} and sum(dataset.split_sizes(137).values()) == 137
    with pytest.raises(ValueError):
        dataset.stratified_split(df.limit(100))
    with pytest.raises(ValueError):
        dataset.stratified_split(df.union(df))


def plain_split(rows, key, seed, level):
    """Ranks in Python: rows of a stratum in hashed order, quotas by largest remainder."""
    strata, total = {}, len(rows)
    for r in rows:
        strata.setdefault("|".join(str(r[c]) for c in level) or "all", []).append(r[key])
    sizes, quota = dataset.split_sizes(total), {}
    for name in ("test", "validation"):
        share = {s: len(v) * sizes[name] / total for s, v in strata.items()}
        quota[name] = {s: int(x) for s, x in share.items()}
        rest = sizes[name] - sum(quota[name].values())
        for s in sorted(strata, key=lambda s: (int(share[s]) - share[s], s))[:rest]:
            quota[name][s] += 1
    out = {}
    for s, ids in strata.items():
        t, v = quota["test"][s], quota["validation"][s]
        for n, i in enumerate(sorted(ids, key=lambda i: (hashlib.md5(f"{i}|{seed}|split".encode()).hexdigest(), i))):
            out[i] = "test" if n < t else "validation" if n < t + v else "train"
    return out


@pytest.mark.parametrize(("n", "strata", "bucket_rows"), [(137, 4, 50_000), (3000, 7, 20), (2500, 1, 3), (1201, 90, 10)])
def test_split_like_plain_ranks(spark, n, strata, bucket_rows):
    """Small buckets, so that quotas end within and between them; a third of the rows in one stratum."""
    rows = [{"id": i, "topic": f"t{0 if i % 3 == 0 else i % strata}", "risk": "low"} for i in range(n)]
    df = spark.createDataFrame(rows, "id long, topic string, risk string")
    level = dataset.stratum_level(df, n)
    got = dataset.stratified_split(df, seed=7, bucket_rows=bucket_rows)
    assert {r["id"]: r["split"] for r in got.collect()} == plain_split(rows, "id", 7, level)


def test_no_stratum_is_one_task(spark):
    """One stratum of 20,000 rows: the sorted part is a bucket, and rows are compared where they are."""
    df = spark.range(20_000).select("id", F.lit("t").alias("topic"), F.lit("low").alias("risk")).repartition(8)
    got = dataset.stratified_split(df, bucket_rows=100)
    assert max(len(p) for p in got.select("id").rdd.glom().collect()) < 10_000
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 16_000, "validation": 2_000, "test": 2_000}


def test_copies_of_a_scenario_are_refused(spark):
    df = spark.range(200).select("id", F.lit("t").alias("topic"), F.lit("low").alias("risk"), (F.col("id") % 199).alias("scenario_key"))
    with pytest.raises(ValueError, match="scenario_key"):
        dataset.stratified_split(df)


@pytest.mark.parametrize("values", [
    [5.0] * 1000, list(range(1001)), [0] * 400 + [1] * 600, [0.0, 1e300, -1e300, 3.0] * 50 + [7.0], [1.0], [1, None, 2, None, 4], [*range(500), *[250] * 500], [2**x for x in range(60)] * 9,
])
def test_quartiles_by_selection(spark, values):
    """At most three values are put in order, so that brackets are narrowed by counts down to the end."""
    rows = [(None if v is None else float(v),) for v in values]
    random.Random(1).shuffle(rows)
    got = dataset.described(spark.createDataFrame(rows, "x double"), "x", most=3).first()
    there = [v for v, in rows if v is not None]
    assert [got["q25"], got["q50"], got["q75"]] == pytest.approx(list(np.quantile(there, [0.25, 0.5, 0.75])))
    assert (got["n"], got["least"], got["most"]) == (len(there), min(there), max(there))


def test_quartiles_of_nothing(spark):
    got = dataset.described(spark.createDataFrame([], "x long"), "x").first()
    assert got["n"] == 0 and got["q50"] is None


def test_saved_splits_are_not_replaced(spark, tmp_path):
    got = dataset.stratified_split(spark.createDataFrame([(i, "t", "low") for i in range(120)], "id long, topic string, risk string"))
    sinks.save_splits(got, str(tmp_path / "s"))
    m = {r["split"]: r for r in spark.read.json(str(tmp_path / "s" / "manifest")).collect()}
    assert {k: v["n"] for k, v in m.items()} == {"train": 96, "validation": 12, "test": 12} and len(m["test"]["sha256"]) == 64
    with pytest.raises(Exception, match="exist"):
        sinks.save_splits(got, str(tmp_path / "s"))


def test_cache_slots(spark, tmp_path):
    path = str(tmp_path / "c")
    assert records.read_cache(spark, path, "A", "2026-01-01", 1).isEmpty()
    row = lambda w, p: spark.createDataFrame([("A", "2026-01-01", w, 1, p)], "ticker string, as_of string, workflow string, version int, payload string")
    sinks.save_cache(row("one", "x"), path)
    sinks.save_cache(row("two", "y"), path)
    sinks.save_cache(row("one", "z"), path)
    assert {r["workflow"]: r["payload"] for r in records.read_cache(spark, path, "A", "2026-01-01", 1).collect()} == {"one": "z", "two": "y"}
    assert records.read_cache(spark, path, "A", "2026-01-01", 2).isEmpty()


def test_strict_json():
    assert sinks.strict_json({"a": float("nan"), "b": [1.5, None, float("inf")], "c": dt.date(2026, 1, 1)}) == '{"a": null, "b": [1.5, null, null], "c": "2026-01-01"}'
    with pytest.raises(TypeError):
        sinks.strict_json({"a": object()})


def test_report_escapes(spark):
    s = spark.createDataFrame([("A<b>", 1.5, None)], "series string, price double, ytd double")
    h = spark.createDataFrame([(i, f"t{i} & <x>") for i in range(5)], "pos long, title string")
    out = sinks.render_report(s, h)
    assert "&amp; &lt;x&gt;" in out["html"] and "t3" not in out["html"] and "ytd: n/a" in out["markdown"]


@pytest.mark.parametrize(
    ("rows", "score", "label"),
    [
        ([("positive", 0.9), ("negative", 0.3), ("neutral", 0.5)], 0.2, "positive"),
        ([("positive", 0.19), (None, None)], 0.19, "neutral"),
        ([("negative", 0.2)], -0.2, "negative"),
        ([(None, None)], None, "unavailable"),
    ],
)
def test_sentiment_boundaries(spark, rows, score, label):
    got = evidence.sentiment_aggregate(spark.createDataFrame(rows, "sentiment string, confidence double")).first()
    assert got["overall_score"] == (None if score is None else pytest.approx(score)) and got["overall_label"] == label


def test_batch_results_need_exactly_one_record(spark):
    t = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "pos long, title string")
    r = spark.createDataFrame([("a", "positive", 0.5), ("b", "neutral", 0.1), ("b", "neutral", 0.1)], "title string, sentiment string, confidence double")
    assert [x["sentiment"] for x in evidence.batch_results(t, r).orderBy("pos").collect()] == ["positive", None, None]


@pytest.mark.parametrize(
    ("field", "said", "broken"),
    [
        ("financial_health_summary", "Cash flow is strong.", ["fundamentals"]),
        ("financial_health_summary", "Cash flow is not assessed.", []),
        ("market_sentiment_summary", "The 90-day move is 22.7%.", []),
        ("market_sentiment_summary", "The 90-day move is 38%.", ["sigma_scale"]),
        ("market_sentiment_summary", "The annualized 90-day volatility is 38%.", []),
        ("market_sentiment_summary", "9 of 10 headlines analyzed; 3 positive.", []),
        ("market_sentiment_summary", "4 positive items.", ["positive_count"]),
        ("hedge_strategy_recommendation", "Hedge about 30% of exposure.", ["hedge_sizing"]),
        ("hedge_strategy_recommendation", "Use NVDA futures.", ["hedge_sizing"]),
        ("hedge_strategy_recommendation", "The optimal strike is near.", ["optimal_option"]),
        ("hedge_strategy_recommendation", "Premium is attractive.", ["option_valuation"]),
        ("financial_health_summary", "PE is above its historical ratio.", ["benchmark_valuation"]),
        ("financial_health_summary", "Cash flow is unknown but the balance-sheet is sound", ["fundamentals"]),
        ("financial_health_summary", "There is no view; solvency remains good. The balance sheet cannot be assessed.", ["fundamentals"]),
        ("financial_health_summary", "An optimal put was not found. No optimal put.", ["optimal_option"]),
        ("hedge_strategy_recommendation", "We do not set a 5% stop-loss. Stop-loss near 7%; it is 4.5% of the position.", ["hedge_sizing"]),
        ("market_sentiment_summary", "Use NVDA futures; hedge 30%.", []),
        ("market_sentiment_summary", "8 of 10 headlines were analyzed, 2 failed, 5 neutral", ["successful_count", "failed_count"]),
        ("market_sentiment_summary", "22.7% as a 90-day expected move, 5% one-sigma move", ["sigma_scale"]),
        ("market_sentiment_summary", "", []),
        ("market_sentiment_summary", None, []),
    ],
)
def test_report_rules(spark, field, said, broken):
    counts = [{"successful_count": 9, "total_headline_count": 10, "positive_count": 3, "negative_count": 1, "neutral_count": 5, "failed_count": 1}]
    assert claims.broken_fields({field: said}, "NVDA", [0.3796], counts).get(field, []) == broken


def test_grounding_of_metrics(spark):
    obs = spark.createDataFrame([("e1", json.dumps({"summary": {"current_price": 10.0}, "latest_indicators": {"RSI": 55.5}}))], "evidence_id string, output string")
    m = spark.createDataFrame([("e1", "current_price", 10.0), ("e1", "RSI", 55.6), ("e1", "MACD", None), ("e2", "RSI", 1.0)], "evidence_id string, name string, value double")
    assert {(r["evidence_id"], r["name"]): r["grounded"] for r in evidence.grounded_metrics(m, obs).collect()} == {("e1", "current_price"): True, ("e1", "RSI"): False, ("e1", "MACD"): True, ("e2", "RSI"): False}


def test_volatility_facts_are_distinct(spark):
    df = spark.createDataFrame([("r", "calculate_volatility", True, 0.3796), ("r", "calculate_volatility", True, 0.3796 * (1 + 1e-12)), ("r", "calculate_volatility", False, 0.5)], "run string, tool string, success boolean, volatility double")
    got = evidence.grounding_facts(df).collect()
    assert len(got) == 1 and got[0]["sigma_90_pct"] == pytest.approx(22.685, abs=0.01)


def test_small_functions(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first()["x"]
    assert one(scalar.ticker(F.lit(" nvda "))) == "NVDA" and one(scalar.ticker(F.lit("a b"))) is None
    assert one(scalar.finite(F.lit(float("nan")))) is None and one(scalar.finite(F.lit(-1.0), True)) is None
    assert one(scalar.unfenced(F.lit("```json\n{}\n```"))) == "{}" and one(scalar.unfenced(F.lit(" x ```"))) == "x ```"
    assert one(scalar.redacted(F.lit("sk-abcdefghij Bearer a.b"))) == "[REDACTED] Bearer [REDACTED]"
    assert one(scalar.host(F.lit("https://a.b/c"))) == "a.b" and one(scalar.error_category(F.lit(429))) == "rate_limit"
    assert one(scalar.truncated(F.lit("abcdef"), 4)) == "abc…"
    with pytest.raises(ValueError):
        GenerationConfig(candidates=10)
    with pytest.raises(FetchError):
        bars.scan_history(spark, "/nowhere")


def test_record_rules(spark):
    from tarnwell.functions import rules

    def names(rows, schema, rule_set):
        return [r["b"] for r in spark.createDataFrame(rows, schema).select(rules.broken(rule_set).alias("b")).collect()]

    good = "One is so. Two is 3.5 now! Three is it?"
    assert names([("SELL", good), ("UP", "One. Two"), (None, None)], "signal string, reasoning string", rules.recommendation()) == [[], ["signal", "sentences", "closed"], ["signal", "length", "sentences", "closed"]]
    assert names([("h", "positive", 1.0, "r"), (" ", "good", float("nan"), "")], "headline string, sentiment string, confidence double, brief_reason string", rules.headline_sentiment()) == [[], ["headline", "sentiment", "confidence", "brief_reason"]]
    assert names([("tool", "x", None), ("tool", None, "o"), ("finish", None, "o"), ("finish", "x", None), ("stop", None, None)], "kind string, tool_name string, output string", rules.agent_action()) == [[], ["tool"], [], ["finish"], ["kind"]]
    assert names([(2, 1, ["a"], "q"), (1, 11, [], "")], "window int, n int, headlines array<string>, query string", rules.tool_arguments()) == [[], ["window", "n", "headlines", "query"]]
    risk = lambda *e: (list(e),)
    assert names([([risk("a")] * 3, 90), ([risk("a"), risk()], 30)], "risks array<struct<evidence_ids:array<string>>>, horizon_days int", rules.research_report()) == [[], ["risks", "evidence", "horizon"]]
    assert spark.range(1).select(rules.only_keys(F.lit('{"a":1,"b":2}'), ("a",)).alias("x")).first()["x"] is False


def test_streamed_bars_equal_batch_bars(spark, tmp_path):
    e = spark.read.parquet(f"{DIR}/events.parquet")
    e.write.parquet(str(tmp_path / "e"))
    s = windowed_bars(event_stream(spark, str(tmp_path / "e")), "event_type", "ts", "value")
    got = run_once(s, "bars_stream", str(tmp_path / "cp"), "update")
    want = e.groupBy("event_type", F.date_trunc("day", "ts").alias("d")).agg(F.count("*").cast("double").alias("volume"))
    assert got.select("series", "d", "volume").exceptAll(want).isEmpty() and want.exceptAll(got.select("series", "d", "volume")).isEmpty()
    t = sessions(event_stream(spark, str(tmp_path / "e")), "event_type", "ts")
    assert t.isStreaming


def test_registry(spark):
    found = __spark_entry__.queries()
    assert set(QUERIES) <= set(found) and set(__spark_entry__.oracle_sql()) <= set(found)
    assert __spark_entry__.entry(spark).count() == 5


@pytest.mark.parametrize("name", ["sma_50_200", "ema_macd", "rsi_14", "technical_facts", "near_dup_overlap", "accept_records"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "documents", "labels", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got = QUERIES[name](spark, DIR)
    cols = sorted(got.columns)
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)[:10] if isinstance(v, (dt.date, dt.datetime)) else str(v)
    ours = sorted(tuple(show(r[c]) for c in cols) for r in got.collect())
    theirs = con.execute(f"select {', '.join(cols)} from ({ORACLE_SQL[name]})").fetchall()
    assert ours == sorted(tuple(show(v) for v in r) for r in theirs)
