"""Named queries over records: news, feeds, searches, journals, caches, answers, rules, traces; each with its SQL.

The test tables hold no such records, so each query first makes some from whole tables by a rule that the SQL repeats.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..functions import rules, scalar
from ..functions.scalar import normalized, r6, word_count
from ..operators import dataset, evidence, signals, text
from ..sources import bars, records, sinks
from .catalogue import _ACC, _AGG, _EX, _FACTS, _FULL, _KEY, _NORM, _SENT, _SUMMARY, _TITLES, BARS, _asked, _bars, _candidates, _docs, _examples, _indicators, _r6, _sentiments, _split, _split_sql, _titles, _values, folder, query, table, written

NOW = "2026-10-08 00:00:00"
EPOCH = int(dt.datetime(2026, 10, 8, tzinfo=dt.UTC).timestamp())


def _path(spark, tag: str) -> str:
    return f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"


def _doc(spark, sf_dir, *columns):
    return table(spark, sf_dir, "documents").select("doc_id", *columns)


# News, feeds, searches


def _news(spark, sf_dir):
    """One JSON record per document: nested, flat, blank, or nested with another address and no date."""
    i, t = F.col("pos"), F.col("title")
    url = lambda kind: F.concat(F.lit(f"https://{kind}/"), i.cast("string"))
    nested = F.struct(F.struct(t.alias("title"), F.struct(F.concat(F.lit(" P"), (i % 7).cast("string"))).alias("provider"), F.struct(url("c").alias("url")).alias("canonicalUrl"), F.lit("2026-01-02T03:04:05Z").alias("pubDate")).alias("content"))
    nested = F.replace(F.to_json(nested), F.lit('"provider":{"col1"'), F.lit('"provider":{"displayName"'))
    flat = F.to_json(F.struct(t.alias("title"), F.lit("Q").alias("publisher"), url("l").alias("link"), (F.lit(1_600_000_000) + i).cast("double").alias("providerPublishTime")))
    blank = F.to_json(F.struct(F.lit("  ").alias("title"), F.lit("Q").alias("publisher")))
    other = F.to_json(F.struct(F.struct(t.alias("title"), F.lit(" R ").alias("publisher"), F.struct(url("t").alias("url")).alias("clickThroughUrl"), F.lit("soon").alias("pubDate")).alias("content")))
    return _titles(spark, sf_dir).select("pos", F.when(i % 4 == 0, nested).when(i % 4 == 1, flat).when(i % 4 == 2, blank).otherwise(other).alias("value"))


@query(f"""WITH {_TITLES}, n AS (SELECT pos, trim(title) AS title, CASE pos % 4 WHEN 0 THEN 'P' || (pos % 7) WHEN 1 THEN 'Q' ELSE 'R' END AS publisher, 'https://' || CASE pos % 4 WHEN 0 THEN 'c' WHEN 1 THEN 'l' ELSE 't' END || '/' || pos AS url,
 CASE pos % 4 WHEN 0 THEN 1767323045 WHEN 1 THEN 1600000000 + pos END AS published FROM titles WHERE pos % 4 <> 2 AND trim(title) <> '')
 SELECT pos, title, publisher, url, CAST(published AS BIGINT) AS published, {_KEY} AS title_key FROM n QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY pos) = 1""")
def news_normalized(spark, sf_dir):
    return records.news_rows(_news(spark, sf_dir)).withColumn("published", F.unix_timestamp("published"))


@query(f"""WITH p AS (SELECT page_id, 'Story ' || (page_id % 300) AS title, CASE WHEN page_id % 5 = 0 THEN 'http' ELSE 'https' END || '://w/' || page_id AS url, {EPOCH} - (page_id % 10) * 86400 - page_id AS published FROM pages WHERE (page_id // 25) % 4 <> 3)
 SELECT title, 'Wire' AS publisher, url, CAST(published AS BIGINT) AS published, lower(title) AS title_key FROM p WHERE url LIKE 'https://%' AND published >= {EPOCH} - 7 * 86400 QUALIFY row_number() OVER (PARTITION BY title ORDER BY published DESC) = 1""")
def rss_filtered(spark, sf_dir):
    """Feeds of 25 items; every fourth declares a document type and is refused."""
    i = F.col("page_id")
    at = F.date_format(F.timestamp_seconds(F.lit(EPOCH) - (i % 10) * 86400 - i), "EEE, d MMM yyyy HH:mm:ss")
    item = F.concat(F.lit("<item><title>Story "), (i % 300).cast("string"), F.lit(" - Wire</title><link>"), F.when(i % 5 == 0, "http").otherwise("https"), F.lit("://w/"), i.cast("string"), F.lit("</link><pubDate>"), at, F.lit(" GMT</pubDate><source>Wire</source></item>"))
    feeds = table(spark, sf_dir, "pages").groupBy(F.floor(i / 25).alias("feed")).agg(F.array_join(F.sort_array(F.collect_list(item)), "").alias("items"))
    head = F.when(F.col("feed") % 4 == 3, "<!DOCTYPE x><rss>").otherwise("<rss>")
    got = records.rss_items(feeds.select(F.concat(head, "items", F.lit("</rss>")).alias("payload")), NOW)
    return got.select("title", "publisher", "url", F.unix_timestamp("published").alias("published"), "title_key")


MOST_RESULTS = 500


def _found(spark, sf_dir):
    i = F.col("page_id")
    title = F.when(i % 4 == 0, " ").otherwise(F.concat(F.lit("Page "), i.cast("string")))
    return table(spark, sf_dir, "pages").select(i.alias("pos"), title.alias("title"), F.when(i % 3 == 0, F.replace("url", F.lit("http"), F.lit("ftp"))).otherwise(F.col("url")).alias("url"), F.col("html").alias("snippet"))


_FOUND = "found AS (SELECT page_id AS pos, CASE WHEN page_id % 4 = 0 THEN ' ' ELSE 'Page ' || page_id END AS title, CASE WHEN page_id % 3 = 0 THEN replace(url, 'http', 'ftp') ELSE url END AS url, html AS snippet FROM pages)"


@query(f"WITH {_FOUND} SELECT pos, title, url, md5(substr(snippet, 1, 1500)) AS snippet_md5 FROM found WHERE trim(title) <> '' AND regexp_matches(url, '^https?://') ORDER BY pos LIMIT {MOST_RESULTS}")
def search_filtered(spark, sf_dir):
    return records.search_rows(_found(spark, sf_dir), MOST_RESULTS).select("pos", "title", "url", F.md5(F.col("snippet").cast("binary")).alias("snippet_md5"))


@query(f"WITH {_FOUND} SELECT 'obs-' || pos AS evidence_id, 'q' AS query, title, md5(substr(snippet, 1, 400)) AS snippet_md5, nullif(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '') AS source FROM found")
def observation_views(spark, sf_dir):
    obs = _found(spark, sf_dir).select(F.concat(F.lit("obs-"), F.col("pos").cast("string")).alias("evidence_id"), F.lit("web_search").alias("tool"), F.to_json(F.struct(F.lit("q").alias("query"), F.array(F.struct("title", "snippet", "url")).alias("results"))).alias("output"))
    x = records.observation_views(obs).select("evidence_id", "query", F.explode("results").alias("r"))
    return x.select("evidence_id", "query", "r.title", F.md5(F.col("r.snippet").cast("binary")).alias("snippet_md5"), "r.source")


@query(f"WITH {_TITLES}, p AS (SELECT pos, title, 1600000000 + (pos * 37) % 1000 AS published FROM titles WHERE trim(title) <> '') SELECT pos, title, CAST(published AS BIGINT) AS published FROM (SELECT *, {_KEY} AS k FROM p QUALIFY row_number() OVER (PARTITION BY k ORDER BY published DESC, pos) = 1) ORDER BY published DESC, pos LIMIT 300")
def latest_headlines(spark, sf_dir):
    """Newest first, equal times in their order; duplicates go before the cut to 300."""
    x = _titles(spark, sf_dir).withColumn("published", F.lit(1_600_000_000) + (F.col("pos") * 37) % 1000)
    x = x.withColumnRenamed("pos", "at").withColumn("pos", F.struct((-F.col("published")).alias("p"), "at"))
    return text.headlines(x, 300).select(F.col("at").alias("pos"), "title", "published")


# Journal, answers, plan


def _answers(spark, sf_dir):
    """Journal lines, one per five documents: every 7th batch failed, every 5th answer is fenced, every 11th has another key."""
    d = _doc(spark, sf_dir).withColumn("batch_id", F.floor(F.col("doc_id") / 5).cast("long") + 1)
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    item = F.struct("doc_id", F.struct(name.alias("id"), F.when(F.col("doc_id") % 17 == 0, "AML").otherwise("KYC").alias("topic")).alias("x"))
    asked = F.struct("doc_id", F.create_map(F.lit("id"), name, F.lit("topic"), F.when(F.col("doc_id") % 23 == 0, "PEP").otherwise("KYC")).alias("x"))
    values = lambda c: F.transform(F.sort_array(F.collect_list(c)), lambda s: s["x"])
    plain = lambda c: F.transform(F.array_sort(F.collect_list(c), lambda a, b: (a["doc_id"] - b["doc_id"]).cast("int")), lambda s: s["x"])
    g = d.groupBy("batch_id").agg(values(item).alias("items"), plain(asked).alias("assignments"))
    b = F.col("batch_id")
    body = F.to_json(F.struct(F.col("items").alias("examples")))
    body = F.when(b % 11 == 0, F.to_json(F.struct(F.col("items").alias("examples"), F.lit(1).alias("more")))).when(b % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return g.select("batch_id", F.lit("m").alias("teacher_model"), F.lit(42).cast("long").alias("seed"), F.lit("sha").alias("system_prompt_sha256"), "assignments", F.when(b % 7 != 0, body).alias("response"), F.when(b % 7 == 0, "timeout").alias("error_category"))


def _journal(spark, sf_dir):
    """The lines appended in two runs and read again."""
    path, lines = _path(spark, "journal"), written(_answers(spark, sf_dir))
    for part in (0, 1):
        sinks.append_journal(lines.where(F.col("batch_id") % 2 == part), path)
    return records.read_journal(spark, path, 42, "sha", "m")


_BATCHES = "b AS (SELECT doc_id, doc_id // 5 + 1 AS batch_id FROM documents)"


@query(f"""WITH {_BATCHES} SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY doc_id) - 1 AS INTEGER) AS pos, 'doc_' || doc_id AS id, CASE WHEN doc_id % 17 = 0 THEN 'AML' ELSE 'KYC' END AS topic FROM b WHERE batch_id % 7 <> 0 AND batch_id % 11 <> 0""")
def journal_candidates(spark, sf_dir):
    return records.batch_candidates(_journal(spark, sf_dir), "id:string,topic:string").select("batch_id", "pos", "record.id", "record.topic")


@query(f"WITH {_BATCHES} SELECT CAST(max(batch_id) + 1 AS BIGINT) AS next_batch_id FROM b")
def journal_next_batch(spark, sf_dir):
    return dataset.next_batch(_journal(spark, sf_dir))


@query(f"WITH {_BATCHES} SELECT CAST(batch_id AS BIGINT) AS batch_id, 'doc_' || doc_id AS id, 'PEP' AS topic FROM b WHERE doc_id % 23 = 0")
def journal_mismatches(spark, sf_dir):
    asked = _journal(spark, sf_dir).select("batch_id", F.explode("assignments").alias("a")).select("batch_id", F.col("a")["id"].alias("id"), F.col("a")["topic"].alias("topic"))
    plan = _doc(spark, sf_dir).select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), F.lit("KYC").alias("topic"))
    return dataset.journal_mismatches(asked, plan)


@query(f"""WITH {_BATCHES}, {_ACC}, ok AS (SELECT DISTINCT id FROM acc WHERE reason = 'accepted'), old AS (SELECT id FROM ok WHERE CAST(substr(id, 5) AS BIGINT) % 3 = 0)
 SELECT (SELECT count(DISTINCT batch_id) FROM b WHERE batch_id % 7 = 0) AS failed_batches, (SELECT count(*) FROM acc) AS returned_count, (SELECT count(*) FROM old) AS existing_valid, (SELECT count(*) FROM ok) - (SELECT count(*) FROM old) AS newly_generated,
 (SELECT count(*) FROM documents) - (SELECT count(*) FROM ok) AS missing_count""")
def generation_counts(spark, sf_dir):
    all_ = written(dataset.accept(_candidates(spark, sf_dir), _asked(spark, sf_dir)))
    ok = all_.where("reason = 'accepted'")
    return dataset.generation_counts(_answers(spark, sf_dir), all_, ok, _asked(spark, sf_dir), ok.where(F.substring("id", 5, 20).cast("long") % 3 == 0))


@query(f"WITH t AS (SELECT doc_id, md5(text) AS a, md5(CASE WHEN doc_id % 9 = 0 THEN text || '!' ELSE text END) AS b FROM documents) SELECT doc_id, a AS text_md5 FROM t WHERE a <> b AND doc_id % 2 = 0")
def prior_mismatches(spark, sf_dir):
    """Earlier records that the recovered ones don't equal in every field."""
    d = _doc(spark, sf_dir, "text")
    row = lambda t: (F.col("doc_id"), F.md5(t.cast("binary")).alias("text_md5"))
    recovered = d.select(*row(F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
    return d.where("doc_id % 2 = 0").select(*row(F.col("text"))).exceptAll(recovered)


@query("""SELECT doc_id AS id, doc_id % 6 < 2 AS valid, CASE WHEN doc_id % 6 < 2 THEN doc_id END AS value FROM documents""")
def parsed_outputs(spark, sf_dir):
    """Plain and fenced objects; NaN, a list, text around a fence and broken JSON are refused."""
    i = F.col("doc_id")
    n = F.concat(F.lit('{"a": '), i.cast("string"), F.lit("}"))
    fence = F.concat(F.lit("```json\n"), n, F.lit("\n```"))
    said = F.when(i % 6 == 0, n).when(i % 6 == 1, fence).when(i % 6 == 2, '{"a": NaN}').when(i % 6 == 3, F.concat(F.lit("["), n, F.lit("]"))).when(i % 6 == 4, F.concat(F.lit("so: "), fence)).otherwise('{"a": ')
    body = scalar.parsed_output(said)
    return _doc(spark, sf_dir).select(i.alias("id"), body.isNotNull().alias("valid"), F.get_json_object(body, "$.a").cast("long").alias("value"))


_RULES = "rules(topic, n, risk, condition, action) AS (VALUES " + _values([(t, n, r, *x) for t, _, rules_ in dataset.POLICIES for n, (r, x) in enumerate(zip(dataset.RISKS, rules_, strict=True))]) + ")"


@query(f"""WITH {_RULES}, {_EX}, e AS (SELECT topic, 0 AS style, string_agg('If ' || condition || ', assign ' || risk || ' risk and ' || action || '.', ' ' ORDER BY n) AS said FROM rules GROUP BY 1
 UNION ALL SELECT topic, 1, string_agg(upper(risk[1]) || risk[2:] || ' risk applies when ' || condition || '; ' || action || '.', ' ' ORDER BY n) FROM rules GROUP BY 1)
 SELECT ex.id, topic, CAST(style AS INTEGER) AS style, 'Internal policy: ' || said AS excerpt FROM ex JOIN e USING (topic) WHERE ex.id % 2 = style""")
def policy_excerpts(spark, sf_dir):
    """The policy that each document's record goes with, in the style of its id."""
    styles = _examples(spark, sf_dir).select("id", "topic", (F.col("id") % 2).cast("int").alias("style")).join(F.broadcast(dataset.policies(spark)), "topic")
    return styles.select("id", "topic", "style", dataset.excerpt(F.col("rules"), F.col("style")).alias("excerpt"))


# Files


@query("SELECT series, d, CASE WHEN value > 50 THEN value END AS value FROM (SELECT event_type AS series, ts AS d, value FROM (SELECT event_type, epoch_us(ts) AS ts, value FROM events))")
def jsonl_round_trip(spark, sf_dir):
    """Events as JSON lines and back; what is no number is null."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.unix_micros(F.col("ts").cast("timestamp")).alias("d"), F.when(F.col("value") > 50, F.col("value")).otherwise(float("nan")).alias("value"))
    path = _path(spark, "lines")
    sinks.write_jsonl(e, path)
    return spark.read.schema(e.schema).json(path)


def _cached(spark, sf_dir, day, payload):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 2 == day)
    return o.groupBy(F.upper(F.substring("o_orderpriority", 3, 4)).alias("ticker"), F.concat(F.lit("2026-01-0"), (F.col("o_orderkey") % 3 + 1).cast("string")).alias("as_of"), F.concat(F.lit("w"), (F.col("o_custkey") % 2).cast("string")).alias("workflow")).agg(
        F.lit(1).alias("version"), F.concat(F.lit(payload), F.count("*").cast("string")).alias("payload")
    )


@query("""WITH o AS (SELECT o_orderkey % 2 AS day, upper(substr(o_orderpriority, 3, 4)) AS ticker, '2026-01-0' || (o_orderkey % 3 + 1) AS as_of, 'w' || (o_custkey % 2) AS workflow, count(*) AS n FROM orders GROUP BY ALL)
 SELECT ticker, as_of, workflow, 1 AS version, CASE day WHEN 1 THEN 'new ' ELSE 'old ' END || n AS payload FROM o WHERE ticker = 'HIGH' AND as_of = '2026-01-02' QUALIFY row_number() OVER (PARTITION BY workflow ORDER BY day DESC) = 1""")
def cache_lookup(spark, sf_dir):
    """Two saves, the later over slots of the first; then the runs of one ticker and day."""
    path = _path(spark, "cache")
    sinks.save_cache(_cached(spark, sf_dir, 0, "old "), path)
    sinks.save_cache(_cached(spark, sf_dir, 1, "new "), path)
    return records.read_cache(spark, path, "HIGH", "2026-01-02", 1).select("ticker", "as_of", "workflow", "version", "payload")


@query(f"""WITH {_split_sql('SELECT * FROM ex')}, l AS (SELECT split, id, '{{"id":' || id || ',"topic":"' || topic || '","risk":"' || risk || '","stratum":"' || stratum || '"}}' AS line FROM split),
 n AS (SELECT split, count(*) AS n, CAST(ceil(count(*) / {sinks.MANIFEST_ROWS}.0) AS BIGINT) AS blocks FROM l GROUP BY 1), b AS (SELECT l.*, n.n, CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 7) AS BIGINT) % n.blocks AS block FROM l JOIN n USING (split)),
 s AS (SELECT split, n, block, sha256(string_agg(line, chr(10) ORDER BY id)) AS sha FROM b GROUP BY ALL)
 SELECT split, n, sha256(string_agg(sha, chr(10) ORDER BY block)) AS sha256, 42 AS seed, 'topic' AS stratified_by FROM s GROUP BY split, n""")
def split_manifest(spark, sf_dir):
    """The manifest that goes with saved splits, in blocks of rows."""
    return sinks.manifest(_split(spark, sf_dir, False).select("id", "topic", "risk", "stratum", "split"), 42, "topic")


@query("SELECT conv_id, turn, substr(output, 1, 200) AS output, CASE WHEN turn % 2 = 0 THEN '[REDACTED]' ELSE 'Bearer [REDACTED] of ' || conv_id END AS argument FROM (SELECT conv_id, turn, 'to [REDACTED] ' || coalesce(text, '') AS output FROM conversations)")
def trace_file(spark, sf_dir):
    """Trace events appended to a file and read again: values of secret-like keys and tokens are gone."""
    i, path = F.col("conv_id").cast("string"), _path(spark, "trace")
    key = F.when(F.col("turn") % 2 == 0, "api_key").otherwise("query")
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", i, F.col("turn").cast("string")).alias("timestamp"), F.lit("writer").alias("role"), F.lit("web_search").alias("tool_name"),
        F.create_map(key, F.concat(F.lit("Bearer abc.def of "), i)).alias("input_arguments"), F.concat(F.lit("to sk-0123456789 "), F.coalesce("text", F.lit(""))).alias("output"), F.lit(1.0).alias("duration_ms"), F.lit(True).alias("success"), F.lit(False).alias("cache_hit"))
    sinks.append_trace(c, path)
    at = F.split("timestamp", "-")
    return records.read_trace(spark, path).select(at[0].cast("long").alias("conv_id"), at[1].cast("long").alias("turn"), "output", F.map_values("input_arguments")[0].alias("argument"))


# Rules of records


@query("""SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 5 = 0 THEN 'headline' END, CASE WHEN doc_id % 4 = 3 THEN 'sentiment' END, CASE WHEN doc_id % 11 - 2 NOT BETWEEN 0 AND 8 THEN 'confidence' END, CASE WHEN length(trim(text)) NOT BETWEEN 1 AND 500 THEN 'brief_reason' END) AS broken FROM documents""")
def headline_rules(spark, sf_dir):
    i = F.col("doc_id")
    at = F.element_at(F.array(*map(F.lit, ("positive", "negative", "neutral", "good"))), (i % 4 + 1).cast("int"))
    x = _doc(spark, sf_dir, F.when(i % 5 == 0, " ").otherwise("h").alias("headline"), at.alias("sentiment"), ((i % 11 - 2) / 8.0).alias("confidence"), F.col("text").alias("brief_reason"))
    return x.select("doc_id", F.array_join(rules.broken(rules.headline_sentiment()), ",").alias("broken"))


@query("""WITH c AS (SELECT conv_id, turn, ['tool', 'finish', 'stop'][turn % 3 + 1] AS kind, conv_id % 2 = 0 AS named, (conv_id + turn) % 3 = 0 AS said FROM conversations)
 SELECT conv_id, turn, concat_ws(',', CASE WHEN kind = 'stop' THEN 'kind' END, CASE WHEN kind = 'tool' AND (NOT named OR said) THEN 'tool' END, CASE WHEN kind = 'finish' AND (named OR NOT said) THEN 'finish' END) AS broken FROM c""")
def agent_action_rules(spark, sf_dir):
    i, t = F.col("conv_id"), F.col("turn")
    kind = F.element_at(F.array(*map(F.lit, ("tool", "finish", "stop"))), (t % 3 + 1).cast("int"))
    c = table(spark, sf_dir, "conversations").select(i, t, kind.alias("kind"), F.when(i % 2 == 0, "get_news").alias("tool_name"), F.when((i + t) % 3 == 0, "x").alias("output"))
    return c.select("conv_id", "turn", F.array_join(rules.broken(rules.agent_action()), ",").alias("broken"))


@query("""WITH c AS (SELECT conv_id, turn, conv_id % 300 AS w, turn % 13 AS n, (conv_id + turn) % 14 AS h, length(text) AS q FROM conversations)
 SELECT conv_id, turn, concat_ws(',', CASE WHEN w NOT BETWEEN 2 AND 252 THEN 'window' END, CASE WHEN n NOT BETWEEN 1 AND 10 THEN 'n' END, CASE WHEN h NOT BETWEEN 1 AND 10 THEN 'headlines' END, CASE WHEN q NOT BETWEEN 1 AND 500 THEN 'query' END,
 CASE WHEN turn % 4 = 3 THEN 'keys' END) AS broken FROM c""")
def tool_argument_rules(spark, sf_dir):
    i, t = F.col("conv_id"), F.col("turn")
    given = F.to_json(F.when(t % 4 == 3, F.create_map(F.lit("window"), F.lit("1"), F.lit("other"), F.lit("2"))).otherwise(F.create_map(F.lit("window"), F.lit("1"))))
    c = table(spark, sf_dir, "conversations").select(i, t, (i % 300).alias("window"), (t % 13).alias("n"), F.array_repeat(F.lit("h"), ((i + t) % 14).cast("int")).alias("headlines"), F.col("text").alias("query"), given.alias("given"))
    own = rules.tool_arguments() | {"keys": rules.only_keys(F.col("given"), ("window", "n", "headlines", "query", "ticker", "period"))}
    return c.select("conv_id", "turn", F.array_join(rules.broken(own), ",").alias("broken"))


@query("""WITH d AS (SELECT doc_id, 2 + doc_id % 3 AS n, doc_id % 7 AS first_ids, CASE WHEN doc_id % 4 = 0 THEN 30 ELSE 90 END AS horizon FROM documents)
 SELECT doc_id, concat_ws(',', CASE WHEN n <> 3 THEN 'risks' END, CASE WHEN first_ids = 0 THEN 'evidence' END, CASE WHEN horizon <> 90 THEN 'horizon' END) AS broken FROM d""")
def report_shape_rules(spark, sf_dir):
    i = F.col("doc_id")
    risk = lambda n: F.struct(F.array_repeat(F.lit("e"), n.cast("int")).alias("evidence_ids"))
    risks = F.concat(F.array(risk(i % 7)), F.array_repeat(risk(F.lit(1)), (1 + i % 3).cast("int")))
    x = _doc(spark, sf_dir, risks.alias("risks"), F.when(i % 4 == 0, 30).otherwise(90).alias("horizon_days"))
    return x.select("doc_id", F.array_join(rules.broken(rules.research_report()), ",").alias("broken"))


@query("""WITH t AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' ' || lower(substr(c_name, 1, 6)) || ' ' WHEN 1 THEN c_name WHEN 2 THEN c_mktsegment || '=f' ELSE repeat('ab.', c_custkey % 12) END AS x FROM customer)
 SELECT c_custkey, CASE WHEN regexp_full_match(upper(trim(x)), '[A-Z0-9.^=_-]{1,24}') THEN upper(trim(x)) END AS ticker FROM t""")
def ticker_symbols(spark, sf_dir):
    i = F.col("c_custkey")
    x = F.when(i % 4 == 0, F.concat(F.lit(" "), F.lower(F.substring("c_name", 1, 6)), F.lit(" "))).when(i % 4 == 1, F.col("c_name")).when(i % 4 == 2, F.concat("c_mktsegment", F.lit("=f"))).otherwise(F.repeat(F.lit("ab."), (i % 12).cast("int")))
    return table(spark, sf_dir, "customer").select("c_custkey", scalar.ticker(x).alias("ticker"))


@query("""WITH s AS (SELECT event_id, CASE WHEN event_id % 501 < 500 THEN 100 + event_id % 501 END AS status FROM events)
 SELECT event_id, status, CASE WHEN status IS NULL THEN 'connection' WHEN status = 429 THEN 'rate_limit' WHEN status IN (408, 409, 498) OR status >= 500 THEN 'connection' ELSE 'invalid_request' END AS research,
 CASE WHEN status IS NULL THEN 'connection' WHEN status = 429 THEN 'rate_limit' WHEN status >= 500 THEN 'server' WHEN status IN (401, 403) THEN 'authentication' ELSE 'invalid_request' END AS generation FROM s""")
def error_categories(spark, sf_dir):
    """Events as requests: statuses 100 to 599, and none where the connection failed."""
    n = F.col("event_id") % 501
    s = table(spark, sf_dir, "events").select("event_id", F.when(n < 500, n + 100).alias("status"))
    return s.select("event_id", "status", scalar.error_category(F.col("status")).alias("research"), scalar.error_category(F.col("status"), "generation").alias("generation"))


@query("""SELECT doc_id, replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS html, CASE WHEN length(t) > 30 THEN substr(t, 1, 29) || '…' ELSE t END AS short, format('{:,.2f}', n_chars / 7.0) AS number
 FROM (SELECT doc_id, n_chars, '<b> "it''s" & ' || split_part(text, chr(10), 1) AS t FROM documents)""")
def shown_texts(spark, sf_dir):
    t = F.concat(F.lit("<b> \"it's\" & "), F.split_part("text", F.lit("\n"), F.lit(1)))
    return _doc(spark, sf_dir, scalar.html_escaped(t).alias("html"), scalar.truncated(t, 30).alias("short"), F.format_number(F.col("n_chars") / 7.0, 2).alias("number"))


@query(f"""SELECT doc_id AS id, CAST(s AS INTEGER) AS scenario_words, CAST(s + 2 + doc_id % 3 AS INTEGER) AS input_words FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(trim(text, ' \t\n\r'), '\\s+'), lambda w : w <> '')) AS s FROM documents)""")
def scenario_words(spark, sf_dir):
    policy = F.concat_ws(" ", F.lit("Internal policy:"), F.array_repeat(F.lit("rule"), (F.col("doc_id") % 3).cast("int")))
    return _doc(spark, sf_dir, "text").select(F.col("doc_id").alias("id"), word_count(F.col("text")).alias("scenario_words"), (word_count(policy) + word_count(F.col("text"))).alias("input_words"))


# Keys and duplicates


@query(f"""SELECT 'id' AS key, count(*) AS n, count(DISTINCT doc_id) AS values, count(*) = count(DISTINCT doc_id) AS unique FROM documents UNION ALL
 SELECT 'scenario', count(*), count(DISTINCT {_NORM}), count(*) = count(DISTINCT {_NORM}) FROM documents""")
def uniqueness(spark, sf_dir):
    x = _docs(spark, sf_dir).select("id", F.md5(normalized(F.col("text")).cast("binary")).alias("scenario"))
    return dataset.uniqueness(x, "id", "scenario")


@query(f"SELECT doc_id AS id, doc_id % 2 = 1 AS prior, md5({_NORM}) AS norm_md5 FROM documents QUALIFY row_number() OVER (PARTITION BY md5({_NORM}) ORDER BY CASE WHEN doc_id % 2 = 1 THEN 0 ELSE 1 END, doc_id) = 1")
def prior_rows_first(spark, sf_dir):
    return dataset.prior_first(_docs(spark, sf_dir).select("id", (F.col("id") % 2 == 1).alias("prior"), F.md5(normalized(F.col("text")).cast("binary")).alias("norm_md5")))


@query("SELECT event_type AS series, CAST(date_trunc('day', ts) AS DATE) AS d, max(event_id) AS seq, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def keep_last_of_day(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.to_date("ts").alias("d"), F.col("event_id").alias("seq"), "value")
    return bars.keep_last(e)


# Evidence

@query(f"""WITH {_TITLES}, q AS (SELECT pos // 4 AS request, pos, CASE WHEN pos % 29 = 0 THEN 'made up' ELSE title END AS title FROM titles), f AS (SELECT request, title, min(pos) AS pos FROM q GROUP BY 1, 2)
 SELECT CAST(request AS BIGINT) AS request, md5(string_agg(title, '|' ORDER BY pos)) AS titles_md5, bool_and(title IN (SELECT title FROM titles)) AS trusted FROM f GROUP BY 1""")
def trusted_titles(spark, sf_dir):
    t = _titles(spark, sf_dir)
    asked = t.select(F.floor(F.col("pos") / 4).cast("long").alias("request"), "pos", F.when(F.col("pos") % 29 == 0, "made up").otherwise(F.col("title")).alias("title"))
    return evidence.trusted_titles(asked, t).select("request", F.md5(F.array_join("titles", "|").cast("binary")).alias("titles_md5"), "trusted")


@query("""WITH c AS (SELECT conv_id, turn, (turn * 7 + conv_id) % 3 AS k, (conv_id + turn) % 4 <> 0 AS success FROM conversations), f AS (SELECT conv_id, k, min(turn) AS failed_at FROM c WHERE NOT success GROUP BY 1, 2)
 SELECT conv_id, turn FROM c LEFT JOIN f USING (conv_id, k) WHERE failed_at IS NULL OR turn <= failed_at""")
def failed_call_filter(spark, sf_dir):
    """Arguments in either order are the same call."""
    i, t = F.col("conv_id"), F.col("turn")
    k, n = ((t * 7 + i) % 3).cast("string"), F.lit("5")
    given = F.when(t % 2 == 0, F.create_map(F.lit("q"), k, F.lit("n"), n)).otherwise(F.create_map(F.lit("n"), n, F.lit("q"), k))
    c = table(spark, sf_dir, "conversations").select(i.alias("run"), t, F.lit("web_search").alias("tool"), given.alias("arguments"), ((i + t) % 4 != 0).alias("success"))
    return evidence.not_failed_before(c).select(F.col("run").alias("conv_id"), "turn")


@query(f"""WITH c AS (SELECT conv_id AS run, (turn % 3 + 1) / 10.0 AS v FROM conversations WHERE (conv_id + turn) % 4 <> 0)
 SELECT run, {_r6('v')} AS annualized_volatility, {_r6('v * 100 * sqrt(90.0 / 252)')} AS sigma_90_pct FROM (SELECT DISTINCT run, v FROM c)""")
def volatility_facts(spark, sf_dir):
    """Values that differ by less than 1e-9 of themselves are one."""
    i, t = F.col("conv_id"), F.col("turn")
    v = (t % 3 + 1) / 10.0 * (1 + t * 1e-13)
    obs = table(spark, sf_dir, "conversations").select(i.alias("run"), F.lit("calculate_volatility").alias("tool"), ((i + t) % 4 != 0).alias("success"), v.alias("volatility"))
    return evidence.grounding_facts(obs).withColumns({c: r6(F.col(c)) for c in ("annualized_volatility", "sigma_90_pct")})


@query(f"WITH {_SENT}, a AS (SELECT source, {_AGG} FROM s GROUP BY 1) SELECT source, successful_count, failed_count, positive_count, negative_count, neutral_count, successful_count + failed_count AS total_headline_count FROM a")
def sentiment_facts(spark, sf_dir):
    return evidence.sentiment_facts(evidence.sentiment_aggregate(_sentiments(spark, sf_dir), "source")).drop("overall_score", "overall_label")


@query(f"""WITH {BARS}, {_SUMMARY} SELECT series, current_price, high_52w, low_52w, {_r6('ytd')} AS ytd_return_pct, CASE ascii(series) % 3 WHEN 0 THEN CAST(10 + ascii(series) AS DOUBLE) END AS pe_ratio FROM summary""")
def metadata_summary(spark, sf_dir):
    """The price summary with the price-earnings ratio of the series' metadata: a number, text, or missing."""
    b = bars.validated(_bars(spark, sf_dir))
    n = F.ascii("series")
    info = F.when(n % 3 == 0, F.concat(F.lit('{"trailingPE": '), (n + 10).cast("string"), F.lit("}"))).when(n % 3 == 1, '{"trailingPE": "Infinity"}').otherwise("{}")
    return signals.with_metadata(signals.price_summary(b), records.pe_ratios(b.select("series").distinct().withColumn("info", info))).withColumn("ytd_return_pct", r6(F.col("ytd_return_pct")))


@query(f"""{_FULL}, f AS (SELECT series, d, momentum, rsi, {_FACTS} FROM signal QUALIFY row_number() OVER (PARTITION BY series ORDER BY d DESC) = 1), {_SENT}, a AS (SELECT {_AGG} FROM s)
 SELECT series, {_r6('rsi')} AS rsi, trend, momentum AS momentum_fact, {_r6('sc')} AS overall_score, successful_count FROM f, a""")
def recommendation_payload(spark, sf_dir):
    """Values as they stand in the JSON that a recommendation is asked with."""
    aggregate = evidence.sentiment_aggregate(_sentiments(spark, sf_dir)).select(F.struct("*").alias("aggregate"))
    last = signals.latest(_indicators(spark, sf_dir)).join(F.broadcast(aggregate))  # one row
    x = last.select("series", rules.recommendation_payload(signals.INDICATORS, signals.facts(), F.col("aggregate")).alias("j"))
    at = lambda p, t="string": F.get_json_object("j", f"$.{p}").cast(t)
    return x.select("series", r6(at("indicators.RSI", "double")).alias("rsi"), at("facts.trend").alias("trend"), at("facts.momentum_fact").alias("momentum_fact"), r6(at("sentiment.overall_score", "double")).alias("overall_score"), at("sentiment.successful_count", "long").alias("successful_count"))
