"""Named queries over JSON records whose types matter, nested secrets, price periods and observation views; each with its SQL.

Records are made from whole tables: every text goes in whole, and each case of a wrong type, an extra key or a missing one comes by id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules, scalar, typed
from ..operators import dataset
from ..sources import bars, ledger, provider, records
from .catalogue import BARS, _bars, folder, query, table

_TRIMMED = "length(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))"


def _quoted(c: Column) -> Column:
    """A text as JSON."""
    return F.to_json(c.cast("variant"))


def _broken(rule_set: typed.Rules) -> Column:
    return F.array_join(rules.broken(rule_set), ",").alias("broken")


@query(f"""SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 8 = 3 THEN 'keys' END, CASE WHEN doc_id % 8 = 4 THEN 'headline' END, CASE WHEN doc_id % 8 = 2 OR doc_id % 5 = 3 THEN 'sentiment' END,
 CASE WHEN doc_id % 8 IN (1, 5, 7) OR doc_id % 11 > 1 THEN 'confidence' END, CASE WHEN doc_id % 8 = 6 OR coalesce({_TRIMMED}, 0) NOT BETWEEN 1 AND 500 THEN 'brief_reason' END) AS broken FROM documents""")
def headline_typed_rules(spark, sf_dir):
    """Numbers as texts, booleans and nulls where numbers belong, lists where texts belong, extra and missing keys."""
    i = F.col("doc_id")
    m = i % 8
    tone = F.element_at(F.array(*map(F.lit, ('"positive"', '"negative"', '"neutral"', '"good"', '"neutral"'))), (i % 5 + 1).cast("int"))
    confidence = F.when(m == 1, '"1"').when(m == 5, "null").when(m == 7, "true").otherwise((i % 11).cast("string"))
    record = F.concat(
        F.lit("{"), F.when(m == 4, "").otherwise('"headline":"h",'), F.when(m == 3, '"more":{"x":1},').otherwise(""), F.lit('"sentiment":'), F.when(m == 2, "5").otherwise(tone),
        F.lit(',"confidence":'), confidence, F.lit(',"brief_reason":'), F.when(m == 6, '["x"]').otherwise(F.coalesce(_quoted(F.col("text")), F.lit("null"))), F.lit("}"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", typed.parsed(record).alias("v")).select("doc_id", _broken(typed.headline_sentiment(F.col("v"))))


@query(f"""SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 7 = 3 THEN 'keys' END, CASE WHEN doc_id % 7 = 1 THEN 'id' END, CASE WHEN coalesce({_TRIMMED}, 0) NOT BETWEEN 20 AND 2000 THEN 'scenario' END,
 CASE WHEN doc_id % 7 = 4 THEN 'rationale' END, CASE WHEN doc_id % 7 = 2 THEN 'risk_level' END, CASE WHEN doc_id % 9 = 0 THEN 'taxonomy' END) AS broken FROM documents""")
def example_typed_rules(spark, sf_dir):
    """Whole texts as scenarios, topics with their own or another category."""
    i = F.col("doc_id")
    m = i % 7
    pick = lambda values, n: F.element_at(F.array(*[F.lit(f'"{v}"') for v in values]), (n + 1).cast("int"))
    topics, categories = zip(*dataset.TOPICS, strict=True)
    record = F.concat(
        F.lit('{"id":'), F.when(m == 1, '"a b"').otherwise(F.concat(F.lit('"doc_'), i.cast("string"), F.lit('"'))), F.lit(',"topic":'), pick(topics, i % 14), F.lit(',"category":'), pick(categories, F.when(i % 9 == 0, (i + 1) % 14).otherwise(i % 14)),
        F.lit(',"policy_excerpt":"Internal policy: identity evidence is complete.","scenario":'), F.coalesce(_quoted(F.col("text")), F.lit("null")), F.lit(',"recommended_action":"continue"'),
        F.lit(',"rationale":'), F.when(m == 4, "17").otherwise('"the evidence is complete"'), F.lit(',"risk_level":'), F.when(m == 2, '"urgent"').otherwise('" low "'), F.when(m == 3, ',"more":[]').otherwise(""), F.lit("}"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", typed.parsed(record).alias("v")).select("doc_id", _broken(typed.policy_example(F.col("v"))))


@query(f"""SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 6 = 5 THEN 'horizon_days' END, CASE WHEN coalesce({_TRIMMED}, 0) NOT BETWEEN 1 AND 800 THEN 'financial_health_summary' END,
 CASE WHEN coalesce({_TRIMMED}, 0) NOT BETWEEN 1 AND 600 THEN 'market_sentiment_summary' END, CASE WHEN doc_id % 5 = 0 OR doc_id % 11 = 0 OR coalesce({_TRIMMED}, 0) NOT BETWEEN 1 AND 400 THEN 'top_three_risks' END,
 CASE WHEN doc_id % 13 = 0 THEN 'hedge_strategy_recommendation' END, CASE WHEN doc_id % 4 = 1 THEN 'limitations' END, CASE WHEN doc_id % 3 = 0 THEN 'clarification_used' END) AS broken FROM documents""")
def report_typed_rules(spark, sf_dir):
    """Reports of a writer whose summaries and last risk hold the whole text: caps of texts, two risks, keys too many in a risk, lists for texts."""
    i, t = F.col("doc_id"), F.coalesce(_quoted(F.col("text")), F.lit("null"))
    risk = '{"title":"t","supporting_evidence":"e","evidence_ids":["a"]}'
    last = F.concat(F.lit('{"title":"t","supporting_evidence":'), t, F.when(i % 11 == 0, ',"more":1').otherwise(""), F.lit(',"evidence_ids":["a","b"]}'))
    risks = F.concat(F.lit(f"[{risk},"), F.when(i % 5 == 0, "").otherwise(f"{risk},"), last, F.lit("]"))
    hedge = F.concat(F.lit('{"strategy":"s","data_driven_rationale":"d","evidence_ids":["a"],"limitations":'), F.when(i % 13 == 0, '["l"]').otherwise('"l"'), F.lit("}"))
    record = F.concat(
        F.lit('{"ticker":"NVDA","as_of":"2026-01-02","horizon_days":'), F.when(i % 6 == 5, '"90"').otherwise("90"), F.lit(',"financial_health_summary":'), t, F.lit(',"market_sentiment_summary":'), t,
        F.lit(',"top_three_risks":'), risks, F.lit(',"hedge_strategy_recommendation":'), hedge, F.lit(',"limitations":'), F.when(i % 4 == 1, "[]").otherwise('["l"]'), F.when(i % 3 == 0, "").otherwise(',"clarification_used":"c"'), F.lit("}"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", typed.parsed(record).alias("v")).select("doc_id", _broken(typed.research_report(F.col("v"), writer=True)))


@query("""WITH c AS (SELECT conv_id, turn, text, (conv_id + turn) % 6 AS m, conv_id % 15 AS n FROM conversations)
 SELECT conv_id, turn, CASE m WHEN 0 THEN CASE WHEN length(text) BETWEEN 1 AND 500 THEN '' ELSE 'query' END WHEN 1 THEN CASE WHEN n BETWEEN 1 AND 10 THEN '' ELSE 'n' END WHEN 2 THEN 'window' WHEN 3 THEN CASE WHEN n BETWEEN 1 AND 10 THEN '' ELSE 'headlines' END
  WHEN 4 THEN CASE WHEN n % 2 = 0 THEN 'keys' ELSE '' END ELSE 'tool,keys' END AS broken FROM c""")
def argument_typed_rules(spark, sf_dir):
    """Arguments of calls: whole texts as queries, counts out of range, a window as text, an argument of another tool, an unknown tool."""
    m, n = (F.col("conv_id") + F.col("turn")) % 6, F.col("conv_id") % 15
    tool = F.element_at(F.array(*map(F.lit, ("web_search", "get_news", "calculate_volatility", "llm_sentiment", "get_price_data", "buy"))), (m + 1).cast("int"))
    items = F.when(n == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), lambda x: F.lit("{}")), ","))
    record = (
        F.when(m == 0, F.concat(F.lit('{"query":'), F.coalesce(_quoted(F.col("text")), F.lit("null")), F.lit("}"))).when(m == 1, F.concat(F.lit('{"ticker":"NVDA","n":'), n.cast("string"), F.lit("}")))
        .when(m == 2, '{"ticker":"NVDA","window":"60"}').when(m == 3, F.concat(F.lit('{"headlines":['), items, F.lit("]}")))
        .when(m == 4, F.when(n % 2 == 0, '{"ticker":"NVDA","period":"2y","n":3}').otherwise('{"ticker":"NVDA"}')).otherwise("{}")
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tool.alias("tool"), typed.parsed(record).alias("v")).select("conv_id", "turn", _broken(typed.tool_arguments(F.col("v"), F.col("tool"))))


@query("""SELECT conv_id, turn, md5('to [REDACTED] ' || coalesce(text, '')) AS first_md5, '[REDACTED]' AS keyed, 'Bearer [REDACTED]!' AS inner_text, conv_id AS number, '[REDACTED]' AS nested_key FROM conversations""")
def redacted_nested(spark, sf_dir):
    """Secrets at several depths of lists and objects; numbers and other texts stay."""
    record = F.concat(
        F.lit('{"call":{"api_key":{"a":[1]},"items":['), _quoted(F.concat(F.lit("to sk-0123456789 "), F.coalesce("text", F.lit("")))), F.lit(',{"more":[["Bearer abc.def!",'), F.col("conv_id").cast("string"), F.lit(',{"Password":true}]]}]}}'),
    )
    at = lambda path, kind: F.try_variant_get("v", path, kind)
    inner = "$.call.items[1].more[0]"
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.parse_json(scalar.redacted_json(record)).alias("v")).select(
        "conv_id", "turn", F.md5(at("$.call.items[0]", "string").cast("binary")).alias("first_md5"), at("$.call.api_key", "string").alias("keyed"), at(f"{inner}[0]", "string").alias("inner_text"),
        at(f"{inner}[1]", "long").alias("number"), at(f"{inner}[2].Password", "string").alias("nested_key"),
    )


@query(f"WITH {BARS} SELECT * FROM bars WHERE d >= DATE '1996-05-17' - INTERVAL 24 MONTH AND d <= DATE '1996-05-17'")
def history_period(spark, sf_dir):
    """Two years of a written price history; the dates reach its scan."""
    path = f"{folder(spark)}/history-{uuid.uuid4().hex}"
    _bars(spark, sf_dir).write.parquet(path)
    return bars.scan_history(spark, path, "1996-05-17", "2y")


@query(f"""WITH {BARS} SELECT series AS evidence_id, series AS ticker, '2y' AS period, count(*) AS row_count, CAST(max(d) AS VARCHAR) AS as_of, CAST(floor(max(close)) AS BIGINT) AS highest FROM bars GROUP BY 1""")
def price_views(spark, sf_dir):
    """What an agent sees of prices: rows are counted and dated, not shown."""
    rows = F.sort_array(F.collect_list(F.struct(F.date_format("d", "yyyy-MM-dd").alias("date"), "close")))
    out = F.to_json(F.struct(F.col("series").alias("ticker"), F.lit("2y").alias("period"), F.lit("adjusted").alias("price_basis"), F.struct(F.max("close").cast("long").alias("highest")).alias("summary"), rows.alias("rows")))
    x = records.price_views(_bars(spark, sf_dir).groupBy(F.col("series").alias("evidence_id")).agg(out.alias("output")))
    return x.select("evidence_id", "ticker", "period", "row_count", "as_of", F.get_json_object("summary", "$.highest").cast("long").alias("highest"))


@query("""SELECT page_id AS evidence_id, 'NVDA' AS ticker, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, 'P' AS publisher, CAST(NULL AS VARCHAR) AS published_at FROM pages""")
def news_views(spark, sf_dir):
    """What an agent sees of news: titles, publishers and dates, no addresses."""
    item = F.struct(F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.lit("P").alias("publisher"), F.col("url").alias("url"))
    out = F.to_json(F.struct(F.lit("NVDA").alias("ticker"), F.array(item).alias("headlines")))
    x = records.news_views(table(spark, sf_dir, "pages").select(F.col("page_id").alias("evidence_id"), out.alias("output")))
    return x.select("evidence_id", "ticker", F.explode("headlines").alias("h")).select("evidence_id", "ticker", "h.title", "h.publisher", "h.published_at")


@query("""SELECT conv_id AS evidence_id, count(*) AS n_turns, CASE WHEN conv_id % 2 = 0 THEN 3 ELSE count(*) END AS headline_count FROM conversations GROUP BY conv_id""")
def sentiment_views(spark, sf_dir):
    """What an agent sees of sentiment: the aggregate and how many headlines were asked for."""
    each = F.collect_list(F.struct(F.lit("t").alias("title")))
    args = F.when(F.col("conv_id") % 2 == 0, F.to_json(F.struct(F.lit(3).alias("headline_count")))).otherwise(F.to_json(F.struct(each.alias("headlines"))))
    out = F.to_json(F.struct(F.struct(F.count("*").alias("successful_count")).alias("aggregate"), each.alias("results")))
    x = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(out.alias("output"), args.alias("arguments")).withColumnRenamed("conv_id", "evidence_id")
    return records.sentiment_views(x).select("evidence_id", F.get_json_object("aggregate", "$.successful_count").cast("long").alias("n_turns"), "headline_count")


@query("""SELECT c_custkey, 'https://news.google.com/rss/search?q=%22' || replace(url_encode(c_name), '%20', '+') || '%22+stock+when%3A7d&hl=en-US&gl=US&ceid=US%3Aen' AS url FROM customer""")
def rss_addresses(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", records.rss_address(F.col("c_name")).alias("url"))


def _measure(system: str, payload: str) -> str:
    """Stands in for a provider: what it is asked, and how long that is."""
    return f"{system}: {len(payload)}"


@query("SELECT doc_id, 'length: ' || length(text) AS answer FROM documents")
def ledger_answers(spark, sf_dir):
    """Every text is asked for once by way of the ledger: half of the rows by a first run, the others by a second one."""
    path = f"{folder(spark)}/ledger-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("payload"))
    ledger.completed(d.where("doc_id % 2 = 0"), _measure, "length", path)
    return ledger.completed(d, _measure, "length", path).select("doc_id", "answer")


@query(f"WITH {BARS} SELECT CASE series WHEN '1-URGENT' THEN 'urgent' ELSE 'low' END AS series, d, open, high, low, close, volume FROM bars WHERE series IN ('1-URGENT', '5-LOW') AND d >= DATE '1994-03-01' AND d < DATE '1996-01-01'")
def provider_history(spark, sf_dir):
    """Bars of two series by the provider source, which is asked for the wanted days only."""
    base = f"{folder(spark)}/provider-{uuid.uuid4().hex}"
    own = _bars(spark, sf_dir)
    names = {"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low"}
    for key, name in names.items():  # a provider's files, one a series
        own.where(F.col("series") == key).withColumn("series", F.lit(name)).coalesce(1).write.parquet(f"{base}/{name}.parquet")
    provider.register(spark)
    x = spark.read.format("price_history").option("folder", base).option("series", ",".join(names.values())).option("start", "1990-01-01").option("end", "2005-12-31").option("days", "365").load()
    return x.where(F.col("series").isin("urgent", "low") & (F.col("d") >= F.lit("1994-03-01").cast("date")) & (F.col("d") < F.lit("1996-01-01").cast("date")))
