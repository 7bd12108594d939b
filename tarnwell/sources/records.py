"""Scans of semi-structured inputs: news records, RSS items, search results, journals, caches, traces, prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import JournalError
from ..functions.scalar import finite, host, title_key
from ..operators import dataset
from . import commits, sinks

NEWS_SCHEMA = (
    "title string, publisher string, link string, pubDate string, providerPublishTime double, provider struct<displayName:string>, canonicalUrl struct<url:string>, clickThroughUrl struct<url:string>, "
    "content struct<title:string,publisher:string,link:string,pubDate:string,providerPublishTime:double,provider:struct<displayName:string>,canonicalUrl:struct<url:string>,clickThroughUrl:struct<url:string>>"
)
TRACE_SCHEMA = "timestamp string, role string, tool_name string, input_arguments map<string,string>, output string, duration_ms double, success boolean, cache_hit boolean"
JOURNAL_SCHEMA = "batch_id long, teacher_model string, seed long, system_prompt_sha256 string, assignments array<map<string,string>>, response string, error_category string"
RSS_LIMIT = 1_000_000


def filled(x: Column) -> Column:
    """Trimmed text, or null where nothing is left."""
    return F.nullif(F.trim(x), F.lit(""))


def news_rows(raw: DataFrame, column: str = "value") -> DataFrame:
    """raw: pos and a JSON record per row. Nested or flat records to title, publisher, url, published; blank titles go, duplicates too."""
    r = F.from_json(column, NEWS_SCHEMA)
    x = raw.select("pos", r.alias("r")).select("pos", F.coalesce("r.content", F.struct(*[F.col(f"r.{c}").alias(c) for c in ("title", "publisher", "link", "pubDate", "providerPublishTime", "provider", "canonicalUrl", "clickThroughUrl")])).alias("c"))
    stamp = F.coalesce(F.try_to_timestamp(F.col("c.pubDate")), F.timestamp_seconds("c.providerPublishTime"))
    x = x.select(
        "pos",
        filled(F.col("c.title")).alias("title"),
        F.coalesce(filled(F.col("c.provider.displayName")), filled(F.col("c.publisher"))).alias("publisher"),
        F.coalesce(filled(F.col("c.link")), filled(F.col("c.canonicalUrl.url")), filled(F.col("c.clickThroughUrl.url"))).alias("url"),
        stamp.alias("published"),
    ).where("title is not null")
    first = x.groupBy(title_key(F.col("title")).alias("title_key")).agg(F.min_by(F.struct(*x.columns), "pos").alias("x"))
    return first.select("x.*", "title_key")


def safe_rss(payload: Column) -> Column:
    """Feeds over a megabyte or with document type or entity declarations are refused."""
    return (F.octet_length(payload) <= RSS_LIMIT) & ~F.upper(payload).rlike("<!DOCTYPE|<!ENTITY")


def rss_items(feeds: DataFrame, now: str, days: int = 7, column: str = "payload") -> DataFrame:
    """Items of RSS payloads: https links with a title, published in the last ``days``; newest first per title."""
    item = "struct<title:string,link:string,pubDate:string,source:string>"
    x = feeds.where(safe_rss(F.col(column))).select(F.posexplode(F.regexp_extract_all(column, F.lit("(?s)(<item>.*?</item>)"), F.lit(1))).alias("pos", "xml"))
    x = x.select("pos", F.from_xml("xml", item.removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")).alias("i"))
    at = F.try_to_timestamp(F.regexp_replace("i.pubDate", r"^\w+,\s*", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    title = filled(F.col("i.title"))
    tail = F.concat(F.lit(" - "), filled(F.col("i.source")))
    title = F.when(F.endswith(title, tail), F.expr("substring(trim(i.title), 1, length(trim(i.title)) - length(trim(i.source)) - 3)")).otherwise(title)
    x = x.select("pos", title.alias("title"), filled(F.col("i.source")).alias("publisher"), filled(F.col("i.link")).alias("url"), at.alias("published"))
    end = F.to_timestamp(F.lit(now))
    x = x.where(F.col("title").isNotNull() & F.startswith("url", F.lit("https://")) & F.col("published").between(end - F.expr(f"interval {days} days"), end))
    first = x.groupBy(title_key(F.col("title")).alias("title_key")).agg(F.max_by(F.struct(*x.columns), F.struct("published", -F.col("pos"))).alias("x"))
    return first.select("x.*", "title_key")


def search_rows(results: DataFrame, most: int = 5, snippet: int = 1500) -> DataFrame:
    """results: pos, title, url, snippet."""
    x = results.where(filled(F.col("title")).isNotNull() & F.col("url").rlike("^https?://"))
    return x.withColumn("snippet", F.substring("snippet", 1, snippet)).orderBy("pos").limit(most)


def read_journal(spark: SparkSession, path: str, seed: int | None = None, prompt_sha: str | None = None, model: str | None = None) -> DataFrame:
    """Journal lines, blank ones skipped. Any unreadable or foreign line, or a repeated batch, is an error before anything is used."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", JOURNAL_SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("j"))
    wrong = F.col("j").isNull() | F.col("j._bad").isNotNull() | F.col("j.batch_id").isNull()
    for name, want in (("seed", seed), ("system_prompt_sha256", prompt_sha), ("teacher_model", model)):
        if want is not None:
            wrong = wrong | ~F.col(f"j.{name}").eqNullSafe(F.lit(want))
    n, bad, ids = parsed.agg(F.count("*"), F.count_if(wrong), F.count_distinct("j.batch_id")).first()
    if bad or n != ids:
        raise JournalError(f"{bad} unreadable or foreign lines, {n - ids} repeated batches")
    return parsed.select("j.*").drop("_bad")


def resume(spark: SparkSession, path: str, plan: DataFrame, accepted: Callable[[DataFrame], DataFrame], produce: Callable[[DataFrame, int], DataFrame], seed: int, prompt_sha: str, model: str, **batching: int) -> int:
    """One run of a generation that goes on where the journal at ``path`` ends. The number of records that were asked for.

    The whole journal is judged first: unreadable or foreign lines, repeated batches, and assignments that the plan doesn't have are errors before anything is written. Then
    ``produce`` gets the assignments that no accepted record has, in batches that count on from the journal's last, and gives their lines, which are
    judged alike and published in one step under the first new batch's name: of two runs at once one is refused and nothing of it is seen.
    """
    found = read_journal(spark, path, seed, prompt_sha, model) if commits.any_batch(spark, path) else spark.createDataFrame([], JOURNAL_SCHEMA)
    asked = lambda lines: lines.select("batch_id", F.explode("assignments").alias("a")).select("batch_id", *[F.col("a")[c].alias(c) for c in plan.columns])
    if not dataset.journal_mismatches(asked(found), plan).isEmpty():
        raise JournalError("the journal has assignments that the plan doesn't have")
    first = dataset.next_batch(found).first()[0]
    todo = dataset.pending(plan, accepted(found))
    n = todo.count()
    if n:
        lines = produce(dataset.batches(todo.withColumn("place", F.col("id")), first=first, **batching).drop("place"), first)
        wrong = (~F.col("seed").eqNullSafe(F.lit(seed))) | (~F.col("system_prompt_sha256").eqNullSafe(F.lit(prompt_sha))) | (~F.col("teacher_model").eqNullSafe(F.lit(model))) | (F.col("batch_id") < first)
        if not lines.where(wrong).isEmpty():
            raise JournalError("the new lines are of another run")
        sinks.append_journal(lines, path, f"from-{first}")
    return n


def batch_candidates(journal: DataFrame, fields: str) -> DataFrame:
    """One row per returned record: batch_id, pos, record; answers that are no object with one array ``examples`` give none."""
    body = F.regexp_replace(F.trim("response"), r"(?is)^```(?:json)?\s*\n?(.*?)\n?```$", "$1")
    fine = F.col("error_category").isNull() & (F.json_object_keys(body) == F.array(F.lit("examples")))
    item = F.from_json(body, f"examples array<struct<{fields}>>", {"allowNonNumericNumbers": "false"})["examples"]
    return journal.where(fine).select("batch_id", F.posexplode(item).alias("pos", "record"))


def read_cache(spark: SparkSession, path: str, ticker: str, as_of: str, version: int) -> DataFrame:
    """Cached runs of a ticker and day; a missing file, broken lines, another version or none are a miss (no rows). A store that fails is an error."""
    schema = "version int, payload string, ticker string, as_of string, workflow string"
    try:
        df = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    fine = (F.col("ticker") == ticker) & (F.col("as_of") == as_of) & (F.col("version") == version) & F.col("_bad").isNull()
    return df.where(fine).drop("_bad")


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Clean records from JSON lines; a broken line is an error."""
    fields = "id string, topic string, category string, policy_excerpt string, scenario string, risk_level string, reason string, action string"
    return spark.read.schema(fields).option("mode", "FAILFAST").json(path)


def pe_ratios(raw: DataFrame, column: str = "info") -> DataFrame:
    """raw: series and a JSON object of a provider's metadata. The trailing price-earnings ratio where it is a finite number."""
    return raw.select("series", finite(F.get_json_object(column, "$.trailingPE").try_cast("double")).alias("pe_ratio"))


def observation_views(observations: DataFrame, most: int = 400) -> DataFrame:
    """observations: evidence_id, tool, output (JSON). What a provider sees of searches: titles, short snippets and hosts, no addresses."""
    item = "struct<title:string,snippet:string,url:string>"
    found = F.from_json(F.col("output"), f"query string, results array<{item}>")
    short = F.transform(found["results"], lambda r: F.struct(r["title"].alias("title"), F.substring(r["snippet"], 1, most).alias("snippet"), host(r["url"]).alias("source")))
    return observations.select("evidence_id", "tool", found["query"].alias("query"), short.alias("results"))


def read_trace(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    df = spark.read.schema(TRACE_SCHEMA).option("recursiveFileLookup", "true").json(path)
    return df if last is None else df.orderBy(F.col("timestamp").desc()).limit(last)


def read_prompt(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def price_views(observations: DataFrame) -> DataFrame:
    """observations: evidence_id and output (JSON) of price calls. All but the rows, which are counted and dated by the last."""
    v = F.try_parse_json("output")
    at = lambda path, kind: F.try_variant_get(v, path, kind)
    rows = at("$.rows", "array<variant>")
    last = F.try_variant_get(F.try_element_at(rows, F.lit(-1)), "$.date", "string")
    kept = [at(f"$.{c}", "string").alias(c) for c in ("ticker", "period", "price_basis")] + [F.to_json(at(f"$.{c}", "variant")).alias(c) for c in ("summary", "latest_indicators")]
    count = F.coalesce(at("$.row_count", "long"), F.size(rows).cast("long"), F.lit(0).cast("long"))
    return observations.select("evidence_id", *kept, count.alias("row_count"), F.coalesce(at("$.as_of", "string"), last).alias("as_of"))


def news_views(observations: DataFrame) -> DataFrame:
    """observations: evidence_id and output (JSON) of news calls. Titles, publishers and dates, no addresses."""
    x = F.from_json("output", "ticker string, headlines array<struct<title:string,publisher:string,published_at:string>>")
    return observations.select("evidence_id", x["ticker"].alias("ticker"), x["headlines"].alias("headlines"))


def sentiment_views(observations: DataFrame) -> DataFrame:
    """observations: evidence_id, arguments and output (JSON) of sentiment calls. The aggregate, and the number of headlines asked for."""
    asked = F.try_parse_json("arguments")
    count = F.coalesce(F.try_variant_get(asked, "$.headline_count", "long"), F.size(F.try_variant_get(asked, "$.headlines", "array<variant>")).cast("long"), F.lit(0).cast("long"))
    return observations.select("evidence_id", F.to_json(F.try_variant_get(F.try_parse_json("output"), "$.aggregate", "variant")).alias("aggregate"), count.alias("headline_count"))


def rss_address(ticker: Column, days: int = 7) -> Column:
    """The address of a search feed for recent news of a ticker, its parts encoded as a form."""
    encoded = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    asked = F.concat(F.lit('"'), ticker, F.lit(f'" stock when:{days}d'))
    return F.concat(F.lit("https://news.google.com/rss/search?q="), encoded(asked), F.lit("&hl=en-US&gl=US&ceid="), encoded(F.lit("US:en")))
