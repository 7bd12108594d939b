"""Named queries over the test tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from ..functions.scalar import normalized, r6, title_key
from ..operators import claims, dataset, evidence, signals, text, timeseries
from ..sources import bars

_LOCAL: list[str] = []
_OWN: set[str] = set()
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def folder(spark: SparkSession) -> str:
    """The application's own folder for tables between steps, in the folder that executors share; it is deleted when the driver ends.

    Only a local master may leave spark.checkpoint.dir unset, and gets one that goes with the process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="tarnwell-plans-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        return f"file://{_LOCAL[0]}"
    own = f"{base.rstrip('/')}/plans-{spark.sparkContext.applicationId}"
    if own not in _OWN:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _OWN.add(own)
    return own


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, which cuts its lineage. Spark drops shuffle files as the driver collects its garbage, which a small driver does rarely, so that is asked for."""
    spark = df.sparkSession
    path = f"{folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    got.isEmpty()  # the scheduler holds on to its last job
    spark._jvm.System.gc()
    return got


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(spark, sf_dir):
    return bars.bars_from_orders(spark, sf_dir)


def _holed(spark, sf_dir):
    """Bars in which some closes are missing, to exercise gaps: the day's number ends on 77 of 97."""
    b = _bars(spark, sf_dir)
    gone = F.pmod(F.datediff(F.col("d"), F.lit("1970-01-01").cast("date")), F.lit(97)) == 77
    return bars.validated(b.withColumn("close", F.when(~gone, F.col("close"))))


BARS = """bars AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS d, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
 min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2)"""
HOLED = BARS + """, raw AS (SELECT * REPLACE (CASE WHEN date_diff('day', DATE '1970-01-01', d) % 97 <> 77 THEN close END AS close) FROM bars),
 holed AS (SELECT series, d, CASE WHEN valid THEN open END AS open, CASE WHEN valid THEN high END AS high, CASE WHEN valid THEN low END AS low, CASE WHEN valid THEN close END AS close,
 CASE WHEN valid THEN volume END AS volume, valid FROM (SELECT *, coalesce(least(open, high, low, close) > 0 AND volume >= 0 AND high >= greatest(open, low, close) AND low <= least(open, high, close)
 AND open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL, false) AS valid FROM raw))"""


def _r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def _sma(n: int, x: str = "close") -> str:
    w = f"OVER (PARTITION BY series ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} = {n} THEN avg({x}) {w} END"


def _pop(n: int) -> str:
    w = f"OVER (PARTITION BY series ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(close) {w} = {n} THEN stddev_pop(close) {w} END"


@query(f"WITH {BARS} SELECT * FROM bars")
def ohlcv_bars(spark, sf_dir):
    return _bars(spark, sf_dir)


@query(f"WITH {HOLED} SELECT * FROM holed")
def validated_bars(spark, sf_dir):
    return _holed(spark, sf_dir)


@query(f"WITH {HOLED} SELECT series, d, {_r6(_sma(50))} AS sma_50, {_r6(_sma(200))} AS sma_200 FROM holed")
def sma_50_200(spark, sf_dir):
    x = timeseries.with_sma(_holed(spark, sf_dir))
    return x.select("series", "d", r6(F.col("SMA_50")).alias("sma_50"), r6(F.col("SMA_200")).alias("sma_200"))


@query(f"""WITH {HOLED}, b AS (SELECT series, d, {_sma(20)} AS m, {_pop(20)} AS s FROM holed)
 SELECT series, d, {_r6('m')} AS bb_middle, {_r6('m + 2.0 * s')} AS bb_upper, {_r6('m - 2.0 * s')} AS bb_lower FROM b""")
def bollinger_20(spark, sf_dir):
    x = timeseries.with_bands(_holed(spark, sf_dir))
    return x.select("series", "d", *[r6(F.col(c)).alias(c.lower()) for c in ("BB_middle", "BB_upper", "BB_lower")])


_SEGMENTS = """numbered AS (SELECT series, d, close, sum(CASE WHEN close IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY d) AS gap FROM {src}),
 seq AS (SELECT series, gap, d, close, row_number() OVER (PARTITION BY series, gap ORDER BY d) AS i FROM numbered WHERE close IS NOT NULL)"""
_REC = """ema AS (SELECT series, gap, i, close AS f, close AS s, CAST(NULL AS DOUBLE) AS g FROM seq WHERE i = 1
 UNION ALL SELECT q.series, q.gap, q.i, e.f + 2.0 / 13 * (q.close - e.f), e.s + 2.0 / 27 * (q.close - e.s),
 CASE WHEN q.i < 26 THEN NULL WHEN e.g IS NULL THEN (e.f + 2.0 / 13 * (q.close - e.f)) - (e.s + 2.0 / 27 * (q.close - e.s))
 ELSE e.g + 0.2 * ((e.f + 2.0 / 13 * (q.close - e.f)) - (e.s + 2.0 / 27 * (q.close - e.s)) - e.g) END
 FROM ema e JOIN seq q ON q.series = e.series AND q.gap = e.gap AND q.i = e.i + 1)"""
_MACD = """macd AS (SELECT series, gap, i, CASE WHEN i >= 12 THEN f END AS ema_fast, CASE WHEN i >= 26 THEN s END AS ema_slow, CASE WHEN i >= 26 THEN f - s END AS macd, CASE WHEN i >= 34 THEN g END AS macd_signal FROM ema)"""
_RSI = """moves AS (SELECT *, greatest(close - lag(close) OVER w, 0) AS up, greatest(lag(close) OVER w - close, 0) AS down FROM seq WINDOW w AS (PARTITION BY series, gap ORDER BY i)),
 wild AS (SELECT series, gap, CAST(15 AS BIGINT) AS i, avg(up) AS g, avg(down) AS l FROM moves WHERE i BETWEEN 2 AND 15 GROUP BY series, gap HAVING count(*) = 14
 UNION ALL SELECT m.series, m.gap, m.i, w.g + (m.up - w.g) / 14, w.l + (m.down - w.l) / 14 FROM wild w JOIN moves m ON m.series = w.series AND m.gap = w.gap AND m.i = w.i + 1),
 rsi AS (SELECT series, gap, i, CASE WHEN l = 0 AND g > 0 THEN 100.0 WHEN l = 0 THEN 50.0 ELSE 100 - 100 / (1 + g / l) END AS rsi FROM wild)"""


def _recursive(src: str = "holed", base: str = HOLED) -> str:
    return f"WITH RECURSIVE {base}, {_SEGMENTS.format(src=src)}, {_REC}, {_MACD}, {_RSI}"


@query(f"""{_recursive()} SELECT n.series, n.d, {_r6('ema_fast')} AS ema_12, {_r6('ema_slow')} AS ema_26, {_r6('macd')} AS macd, {_r6('macd_signal')} AS macd_signal, {_r6('macd - macd_signal')} AS macd_histogram
 FROM numbered n LEFT JOIN seq q ON q.series = n.series AND q.d = n.d LEFT JOIN macd m ON m.series = q.series AND m.gap = q.gap AND m.i = q.i""")
def ema_macd(spark, sf_dir):
    x = timeseries.with_recursions(_holed(spark, sf_dir))
    return x.select("series", "d", r6(F.col("EMA_fast")).alias("ema_12"), r6(F.col("EMA_slow")).alias("ema_26"), *[r6(F.col(c)).alias(c.lower()) for c in ("MACD", "MACD_signal", "MACD_histogram")])


@query(f"""{_recursive()} SELECT n.series, n.d, {_r6('rsi')} AS rsi FROM numbered n LEFT JOIN seq q ON q.series = n.series AND q.d = n.d LEFT JOIN rsi r ON r.series = q.series AND r.gap = q.gap AND r.i = q.i""")
def rsi_14(spark, sf_dir):
    return timeseries.with_recursions(_holed(spark, sf_dir)).select("series", "d", r6(F.col("RSI")).alias("rsi"))


def _indicators(spark, sf_dir):
    return signals.with_momentum(timeseries.with_indicators(bars.validated(_bars(spark, sf_dir))))


_FULL = f"""{_recursive('bars', BARS)}, wide AS (SELECT series, d, close, {_sma(50)} AS sma_50, {_sma(200)} AS sma_200, {_sma(20)} AS bb_middle, {_pop(20)} AS dev FROM bars),
 ind AS (SELECT w.*, bb_middle + 2.0 * dev AS bb_upper, bb_middle - 2.0 * dev AS bb_lower, r.rsi, m.macd, m.macd_signal, m.macd - m.macd_signal AS macd_histogram
 FROM wide w JOIN seq q ON q.series = w.series AND q.d = w.d LEFT JOIN macd m ON m.series = q.series AND m.gap = q.gap AND m.i = q.i LEFT JOIN rsi r ON r.series = q.series AND r.gap = q.gap AND r.i = q.i),
 voted AS (SELECT *, CAST(coalesce(sign(close - sma_50), 0) + coalesce(sign(sma_50 - sma_200), 0) + coalesce(sign(rsi - 50), 0) + coalesce(sign(macd - macd_signal), 0) + coalesce(sign(close - bb_middle), 0) AS INTEGER) AS score FROM ind),
 signal AS (SELECT *, CASE WHEN score >= 3 THEN 'BULLISH' WHEN score <= -3 THEN 'BEARISH' ELSE 'NEUTRAL' END AS momentum FROM voted)"""
_FACTS = """(close / sma_50 - 1) * 100 AS p50, (close / sma_200 - 1) * 100 AS p200, CASE WHEN sma_50 > sma_200 THEN 'above' WHEN sma_50 < sma_200 THEN 'below' WHEN sma_50 = sma_200 THEN 'equal' END AS sma50_vs_sma200,
 CASE WHEN close IS NULL OR sma_50 IS NULL OR sma_200 IS NULL THEN NULL WHEN close > sma_50 AND sma_50 > sma_200 THEN 'bullish' WHEN close < sma_50 AND sma_50 < sma_200 THEN 'bearish' ELSE 'neutral' END AS trend,
 CASE WHEN rsi < 0 OR rsi > 100 THEN NULL WHEN rsi <= 30 THEN 'oversold' WHEN rsi < 45 THEN 'weak' WHEN rsi <= 55 THEN 'neutral' WHEN rsi < 70 THEN 'strong' WHEN rsi <= 100 THEN 'overbought' END AS rsi_regime,
 CASE WHEN macd > macd_signal THEN 'above' WHEN macd < macd_signal THEN 'below' WHEN macd = macd_signal THEN 'equal' END AS macd_vs_signal,
 CASE WHEN macd_histogram > 0 THEN 'positive' WHEN macd_histogram < 0 THEN 'negative' WHEN macd_histogram = 0 THEN 'zero' END AS histogram_sign,
 CASE WHEN bb_lower <= bb_middle AND bb_middle <= bb_upper THEN CASE WHEN close < bb_lower THEN 'below_lower' WHEN close > bb_upper THEN 'above_upper' WHEN close = bb_middle THEN 'middle' WHEN close < bb_middle THEN 'lower_half' ELSE 'upper_half' END END AS band_location"""


def _reason(a: str, b: str) -> str:
    """SQL of one vote's reason; a, b: the names it gives."""
    x, y = a.lower(), "50" if b == "50" else b.lower()
    return f"CASE WHEN {x} IS NULL OR {y} IS NULL THEN '{a} vs {b}: unavailable (0)' WHEN {x} > {y} THEN '{a} above {b} (+1)' WHEN {x} < {y} THEN '{a} below {b} (-1)' ELSE '{a} equals {b} (+0)' END"


@query(f"{_FULL} SELECT series, d, score, momentum, concat_ws('; ', {', '.join(_reason(a, b) for a, b in signals.VOTES)}) AS reasons FROM signal")
def momentum_votes(spark, sf_dir):
    return _indicators(spark, sf_dir).select("series", "d", "score", "momentum", F.array_join("reasons", "; ").alias("reasons"))


@query(f"""{_FULL}, f AS (SELECT series, d, momentum, {_FACTS} FROM signal)
 SELECT series, d, {_r6('p50')} AS price_vs_sma50_pct, {_r6('p200')} AS price_vs_sma200_pct, sma50_vs_sma200, trend, rsi_regime, macd_vs_signal, histogram_sign, band_location, momentum AS momentum_fact FROM f""")
def technical_facts(spark, sf_dir):
    x = _indicators(spark, sf_dir)
    return x.select("series", "d", *[(r6(c) if n.endswith("pct") else c).alias(n) for n, c in signals.facts().items()])


_SUMMARY = """summary AS (SELECT b.series, arg_max(close, d) AS current_price, max(CASE WHEN d >= a - INTERVAL 364 DAY THEN high END) AS high_52w, min(CASE WHEN d >= a - INTERVAL 364 DAY THEN low END) AS low_52w,
 (arg_max(close, d) FILTER (WHERE d >= date_trunc('year', a)) / arg_max(close, d) FILTER (WHERE d < date_trunc('year', a)) - 1) * 100 AS ytd
 FROM bars b, (SELECT max(d) AS a FROM bars) WHERE close IS NOT NULL GROUP BY 1)"""


@query(f"WITH {BARS}, {_SUMMARY} SELECT series, current_price, high_52w, low_52w, {_r6('ytd')} AS ytd_return_pct FROM summary")
def price_summary(spark, sf_dir):
    x = signals.price_summary(bars.validated(_bars(spark, sf_dir)))
    return x.withColumn("ytd_return_pct", r6(F.col("ytd_return_pct")))


@query(f"""{_FULL}, last AS (SELECT * FROM signal QUALIFY row_number() OVER (PARTITION BY series ORDER BY d DESC) = 1), {_SUMMARY}
 SELECT l.series, l.d, l.score, l.momentum, {_r6('l.rsi')} AS rsi, {_r6('l.macd_histogram')} AS macd_histogram, s.current_price, s.high_52w, s.low_52w, {_r6('s.ytd')} AS ytd_return_pct FROM last l JOIN summary s USING (series)""")
def technical_summary(spark, sf_dir):
    x = written(_indicators(spark, sf_dir))
    last = signals.latest(x).select("series", "d", "score", "momentum", r6(F.col("RSI")).alias("rsi"), r6(F.col("MACD_histogram")).alias("macd_histogram"))
    both = last.join(signals.price_summary(x), "series")
    return both.withColumn("ytd_return_pct", r6(F.col("ytd_return_pct")))


@query(f"WITH {HOLED} SELECT series, d, {_r6('close - lag(close) OVER w')} AS change, {_r6('close / lag(close) OVER w - 1')} AS simple_return FROM holed WINDOW w AS (PARTITION BY series ORDER BY d)")
def returns(spark, sf_dir):
    x = timeseries.with_returns(_holed(spark, sf_dir))
    return x.select("series", "d", r6(F.col("change")).alias("change"), r6(F.col("simple_return")).alias("simple_return"))


@query(f"""WITH {BARS}, r AS (SELECT series, d, close / lag(close) OVER (PARTITION BY series ORDER BY d) - 1 AS r, row_number() OVER (PARTITION BY series ORDER BY d DESC) AS n FROM bars)
 SELECT series, count(r) AS n_returns, {_r6('CASE WHEN count(r) = 30 THEN stddev_samp(r) * sqrt(252.0) END')} AS annualized_volatility,
 {_r6('CASE WHEN count(r) = 30 THEN stddev_samp(r) * sqrt(252.0) * sqrt(90.0 / 252) END')} AS sigma_90_day FROM r WHERE n <= 30 GROUP BY 1""")
def annualized_volatility(spark, sf_dir):
    x = timeseries.annualized_volatility(bars.validated(_bars(spark, sf_dir)), 30)
    return x.withColumns({c: r6(F.col(c)) for c in ("annualized_volatility", "sigma_90_day")})


@query(f"""WITH {HOLED}, c AS (SELECT series, d, close IS NULL AS gone, CASE WHEN (close IS NULL) = lag(close IS NULL) OVER w THEN 0 ELSE 1 END AS ch FROM holed WINDOW w AS (PARTITION BY series ORDER BY d))
 SELECT series, d, CAST(sum(ch) OVER w AS BIGINT) AS run_id, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) OVER w AS BIGINT) AS gap_id FROM c WINDOW w AS (PARTITION BY series ORDER BY d)""")
def gap_segments(spark, sf_dir):
    return timeseries.gap_segments(_holed(spark, sf_dir)).select("series", "d", "run_id", "gap_id")


@query(f"""WITH {BARS}, t AS (SELECT series, d, row_number() OVER (PARTITION BY series ORDER BY d DESC) AS n FROM bars)
 SELECT series, count(*) AS n_rows, count(*) >= 200 AS sufficient FROM t WHERE n <= 200 GROUP BY 1""")
def history_sufficiency(spark, sf_dir):
    w = Window.partitionBy("series").orderBy(F.col("d").desc())
    last = bars.validated(_bars(spark, sf_dir)).withColumn("n", F.row_number().over(w)).where(F.col("n") <= 200)
    return last.groupBy("series").agg(F.count("*").alias("n_rows"), ((F.count("*") >= 200) & F.bool_and("valid")).alias("sufficient"))


# Headlines: first line of each document by id, and page titles as the fallback source.
_TITLES = "titles AS (SELECT doc_id AS pos, trim(split_part(text, chr(10), 1)) AS title FROM documents)"
_KEY = "regexp_replace(lower(trim(title)), '\\s+', ' ', 'g')"


def _titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.trim(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"))


@query(f"WITH {_TITLES} SELECT pos, title, {_KEY} AS title_key FROM titles WHERE {_KEY} <> '' QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY pos) = 1")
def headlines_dedup(spark, sf_dir):
    return text.headlines(_titles(spark, sf_dir))


@query(f"""WITH {_TITLES}, pages_ AS (SELECT page_id AS pos, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages),
 both_ AS (SELECT pos, title, 0 AS source_rank FROM titles UNION ALL SELECT pos, title, 1 FROM pages_),
 one AS (SELECT *, {_KEY} AS title_key FROM both_ WHERE {_KEY} <> '' QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY source_rank, pos) = 1)
 SELECT pos, title, source_rank, title_key FROM one""")
def headlines_fallback(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return text.headline_union(_titles(spark, sf_dir), pages)


def _sentiments(spark, sf_dir):
    """A deterministic stand-in for a sentiment provider: toxic rows are negative, good ones positive, every seventh fails."""
    d, l = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), table(spark, sf_dir, "labels")
    s = F.when(F.col("doc_id") % 7 == 0, None).when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return d.join(l, "doc_id").select("doc_id", "source", s.alias("sentiment"), ((F.col("n_chars") % 100) / 100.0).alias("confidence"))


_SENT = """s AS (SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment, (n_chars % 100) / 100.0 AS confidence
 FROM documents JOIN labels USING (doc_id))"""
_AGG = """round(avg(CASE sentiment WHEN 'positive' THEN confidence WHEN 'negative' THEN -confidence WHEN 'neutral' THEN 0 END), 12) AS sc, count(sentiment) AS successful_count, count(*) - count(sentiment) AS failed_count,
 count(*) FILTER (WHERE sentiment = 'positive') AS positive_count, count(*) FILTER (WHERE sentiment = 'negative') AS negative_count, count(*) FILTER (WHERE sentiment = 'neutral') AS neutral_count"""


@query(f"""WITH {_SENT}, a AS (SELECT source, {_AGG} FROM s GROUP BY 1) SELECT source, {_r6('sc')} AS overall_score, successful_count, failed_count, positive_count, negative_count, neutral_count,
 CASE WHEN sc IS NULL THEN 'unavailable' WHEN sc >= 0.2 THEN 'positive' WHEN sc <= -0.2 THEN 'negative' ELSE 'neutral' END AS overall_label FROM a""")
def sentiment_aggregate(spark, sf_dir):
    x = evidence.sentiment_aggregate(_sentiments(spark, sf_dir), "source")
    return x.withColumn("overall_score", r6(F.col("overall_score")))


@query(f"""WITH {_TITLES}, res AS (SELECT t.title, s.sentiment, s.confidence FROM titles t JOIN ({_SENT.removeprefix('s AS (').removesuffix(')')}) s ON s.doc_id = t.pos WHERE s.sentiment IS NOT NULL),
 one AS (SELECT title, min(sentiment) AS sentiment, min(confidence) AS confidence FROM res GROUP BY 1 HAVING count(*) = 1)
 SELECT t.pos, t.title, o.sentiment, CAST(o.confidence AS DOUBLE) AS confidence FROM titles t LEFT JOIN one o USING (title)""")
def batch_sentiment_join(spark, sf_dir):
    t = _titles(spark, sf_dir)
    res = t.join(_sentiments(spark, sf_dir).where("sentiment is not null").withColumnRenamed("doc_id", "pos"), "pos").select("title", "sentiment", "confidence")
    return evidence.batch_results(t, res)


_NORM = "array_to_string(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}_]+'), ' ')"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


@query(f"SELECT doc_id AS id, md5({_NORM}) AS norm_md5, length({_NORM}) AS norm_chars FROM documents")
def normalize_text(spark, sf_dir):
    x = _docs(spark, sf_dir).select("id", normalized(F.col("text")).alias("norm"))
    return x.select("id", F.md5(F.col("norm").cast("binary")).alias("norm_md5"), F.length("norm").cast("long").alias("norm_chars"))


@query(f"SELECT md5(n) AS norm_md5, min(doc_id) AS first_id, count(*) AS copies FROM (SELECT doc_id, {_NORM} AS n FROM documents) GROUP BY n HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return text.exact_groups(_docs(spark, sf_dir)).select(F.md5(F.col("norm").cast("binary")).alias("norm_md5"), "first_id", "copies")


@query("SELECT doc_id AS id, CAST(len(list_filter(regexp_split_to_array(trim(text, ' \t\n\r'), '\\s+'), lambda w : w <> '')) AS INTEGER) AS input_words FROM documents")
def word_counts(spark, sf_dir):
    return text.word_counts(_docs(spark, sf_dir))


@query(f"""WITH n AS (SELECT min(doc_id) AS id, string_split(n, ' ') AS ws FROM (SELECT doc_id, {_NORM} AS n FROM documents) WHERE n <> '' GROUP BY n),
 e AS (SELECT id, w, count(*) AS k, any_value(l) AS l FROM (SELECT id, unnest(ws) AS w, len(ws) AS l FROM n) GROUP BY id, w),
 p AS (SELECT a.id AS a, b.id AS b, a.l AS la, b.l AS lb, sum(least(a.k, b.k)) AS o FROM e a JOIN e b ON a.w = b.w AND a.id < b.id AND 2 * least(a.l, b.l) >= 0.88 * (a.l + b.l) - 1e-9 GROUP BY 1, 2, 3, 4)
 SELECT a, b, CAST(la AS INTEGER) AS la, CAST(lb AS INTEGER) AS lb, CAST(o AS BIGINT) AS overlap FROM p WHERE 2 * o >= 0.88 * (la + lb) - 1e-9""")
def near_dup_overlap(spark, sf_dir):
    """Pairs of first documents of their texts; exact_duplicates tells who else has the text."""
    x = written(_docs(spark, sf_dir).select("id", normalized(F.col("text")).alias("norm")))
    return text.overlap_candidates(x, written, first=text.one_per_text(x))


def _deduped(spark, sf_dir):
    return text.deduplicated(_docs(spark, sf_dir).withColumn("rank", F.col("id")), written)


def _dedup_sql(rounds: int = 12) -> str:
    """The ordered pass in SQL: pairs whose words suffice, matching blocks of each pair by recursion (the longest, then what is left and right of it), and
    rounds that decide rows whose earlier near rows are decided. It holds while chains of near rows are no longer than ``rounds``."""
    state = ["s0 AS (SELECT id, CAST(NULL AS BOOLEAN) AS kept FROM live)"]
    for r in range(rounds):
        state.append(f"""s{r + 1} AS MATERIALIZED (SELECT s.id, coalesce(any_value(s.kept), CASE WHEN bool_or(coalesce(x.kept, false)) THEN false WHEN count(*) FILTER (WHERE x.id IS NOT NULL AND x.kept IS NULL) = 0 THEN true END) AS kept
 FROM s{r} s LEFT JOIN edges e ON e.b = s.id LEFT JOIN s{r} x ON x.id = e.a GROUP BY s.id)""")
    return f"""WITH RECURSIVE docs AS (SELECT doc_id AS id, {_NORM} AS n FROM documents), live AS MATERIALIZED (SELECT min(id) AS id, n, string_split(n, ' ') AS ws FROM docs GROUP BY n),
 el AS (SELECT id, w, count(*) AS k, any_value(l) AS l FROM (SELECT id, unnest(ws) AS w, len(ws) AS l FROM live WHERE n <> '') GROUP BY id, w),
 p AS MATERIALIZED (SELECT a, b, la, lb FROM (SELECT x.id AS a, y.id AS b, x.l AS la, y.l AS lb, sum(least(x.k, y.k)) AS o FROM el x JOIN el y ON x.w = y.w AND x.id < y.id AND 2 * least(x.l, y.l) >= 0.88 * (x.l + y.l) - 1e-9 GROUP BY 1, 2, 3, 4) WHERE 2 * o >= 0.88 * (la + lb) - 1e-9),
 pos AS (SELECT id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM live WHERE id IN (SELECT a FROM p UNION SELECT b FROM p)),
 hit AS (SELECT p.a, p.b, x.i, x.i - y.i AS d FROM p JOIN pos x ON x.id = p.b JOIN pos y ON y.id = p.a AND y.w = x.w),
 run AS MATERIALIZED (SELECT a, b, d, min(i) AS i0, max(i) + 1 AS i1 FROM (SELECT *, i - row_number() OVER (PARTITION BY a, b, d ORDER BY i) AS g FROM hit) GROUP BY a, b, d, g),
 work AS (SELECT a, b, CAST(0 AS BIGINT) AS x0, CAST(lb AS BIGINT) AS x1, CAST(0 AS BIGINT) AS y0, CAST(la AS BIGINT) AS y1, CAST(0 AS BIGINT) AS k FROM p
  UNION ALL
  SELECT a, b, t.x0, t.x1, t.y0, t.y1, t.k FROM (SELECT a, b, unnest([{{'x0': x0, 'x1': -best.s, 'y0': y0, 'y1': -best.s - best.d, 'k': best.k}}, {{'x0': -best.s + best.k, 'x1': x1, 'y0': -best.s - best.d + best.k, 'y1': y1, 'k': 0}}]) AS t
   FROM (SELECT w.a, w.b, x0, x1, y0, y1, max({{'k': least(i1, x1, y1 + d) - greatest(i0, x0, y0 + d), 's': -greatest(i0, x0, y0 + d), 'd': d}}) AS best
    FROM work w JOIN run r ON w.a = r.a AND w.b = r.b AND least(i1, x1, y1 + d) > greatest(i0, x0, y0 + d) WHERE x0 < x1 AND y0 < y1 GROUP BY w.a, w.b, x0, x1, y0, y1))),
 edges AS MATERIALIZED (SELECT a, b, ratio FROM (SELECT a, b, 2.0 * sum(k) / (any_value(la) + any_value(lb)) AS ratio FROM work JOIN p USING (a, b) GROUP BY a, b) WHERE ratio >= 0.88),
 {", ".join(state)},
 near AS (SELECT b AS id, min(a) AS of, arg_min(ratio, a) AS ratio FROM edges JOIN s{rounds} s ON s.id = a AND s.kept GROUP BY b),
 result AS (SELECT docs.id, CASE WHEN NOT s.kept THEN 'near_duplicate' WHEN docs.id = live.id THEN 'kept' ELSE 'exact_duplicate' END AS status, CASE WHEN NOT s.kept THEN near.of WHEN docs.id <> live.id THEN live.id END AS of,
  CASE WHEN NOT s.kept THEN near.ratio WHEN docs.id <> live.id THEN 1.0 END AS similarity FROM docs JOIN live USING (n) JOIN s{rounds} s ON s.id = live.id LEFT JOIN near ON near.id = live.id),
 place AS (SELECT id, row_number() OVER (ORDER BY id) AS place FROM result WHERE status = 'kept')"""


@query(f"{_dedup_sql()} SELECT id, status, of AS duplicate_of, {_r6('CAST(similarity AS DOUBLE)')} AS similarity FROM result WHERE status <> 'kept'")
def near_dup_removed(spark, sf_dir):
    return _deduped(spark, sf_dir).where("status <> 'kept'").select("id", "status", "duplicate_of", r6(F.col("similarity")).alias("similarity"))


@query(f"""{_dedup_sql()} SELECT count(*) AS input_count, count(*) FILTER (WHERE status = 'kept') AS kept_count, CAST(0 AS BIGINT) AS duplicate_ids, count(*) FILTER (WHERE status = 'exact_duplicate') AS exact_duplicates,
 count(*) FILTER (WHERE status = 'near_duplicate') AS near_duplicates FROM result""")
def dedup_stats(spark, sf_dir):
    return text.dedup_stats(_deduped(spark, sf_dir))


@query(f"""{_dedup_sql()} SELECT CAST((SELECT sum(place - 1) FROM place) + (SELECT sum(place) FROM result JOIN place ON place.id = result.of WHERE status = 'near_duplicate') AS BIGINT) AS comparisons,
 {_r6("CAST((SELECT max(similarity) FROM result WHERE status = 'near_duplicate') AS DOUBLE)")} AS maximum_similarity, CAST(0.88 AS DOUBLE) AS near_duplicate_threshold""")
def similarity_stats(spark, sf_dir):
    """Comparisons of the ordered pass over all documents, and the highest similarity among them."""
    got = text.similarity_stats(_docs(spark, sf_dir).withColumn("rank", F.col("id")), written(_deduped(spark, sf_dir)), written)
    return got.withColumn("maximum_similarity", r6(F.col("maximum_similarity")))


def _values(pairs) -> str:
    q = lambda s: "'" + str(s).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else str(x) for x in row) + ")" for row in pairs)


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _pick(values, tag) -> str:
    return f"{_list(values)}[CAST(('0x' || substr(md5(CAST(i AS VARCHAR) || '|42|{tag}'), 1, 6)) AS BIGINT) % {len(values)} + 1]"


_POL = "pol(number, topic, category) AS (VALUES " + _values([(i, t, c) for i, (t, c) in enumerate(dataset.TOPICS)]) + ")"
_PLAN = f"""{_POL}, p AS (SELECT i, number, topic, category, i // 14 AS cycle, {_list(dataset.RISKS)}[(i // 14 + number) % 3 + 1] AS target_risk FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) JOIN pol ON number = i % 14),
 plan AS (SELECT printf('triage_%04d', i + 1) AS id, topic, category, target_risk, {_pick(dataset.CUSTOMER_TYPES, 'customer')} AS customer_type, {_pick(dataset.AMOUNT_BANDS, 'amount')} AS transaction_size,
 {_list(dataset.WORD_RANGES)}[cycle % 3 + 1] AS scenario_word_range, CASE WHEN target_risk = 'low' THEN 'clear evidence' ELSE {_pick(dataset.AMBIGUITIES, 'ambiguity')} END AS ambiguity,
 md5(CAST(i AS VARCHAR) || '|42|order') AS place FROM p)"""


def _plan(spark, sf_dir):
    numbers = text.places(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", written)
    return dataset.assigned(numbers.select((F.col("place") - 1).alias("id")))


@query(f"WITH {_PLAN} SELECT * FROM plan")
def assignment_plan(spark, sf_dir):
    """An assignment for each document, numbered in the order of their ids."""
    return _plan(spark, sf_dir).drop("policy_excerpt")


@query(f"WITH {_PLAN}, b AS (SELECT id, (row_number() OVER (ORDER BY place) - 1) // 5 + 1 AS batch_id FROM plan) SELECT b.id, CAST(batch_id AS BIGINT) AS batch_id FROM b WHERE batch_id % 3 <> 0")
def pending_assignments(spark, sf_dir):
    """Assignments for all documents in batches, of which every third has been accepted."""
    plan = dataset.batches(_plan(spark, sf_dir).select("id", "place"), written=written)
    return dataset.pending(plan, plan.where("batch_id % 3 = 0")).select("id", "batch_id")


def _examples(spark, sf_dir):
    """Records from documents: topic from the source, risk from the id. Some ids repeat, some rows are too short."""
    d = table(spark, sf_dir, "documents")
    topics = F.array(*[F.lit(t) for t, _ in dataset.TOPICS])
    at = F.coalesce(F.regexp_extract("source", r"(\d+)", 1).try_cast("int"), F.lit(0)) % 14
    return d.select(
        F.col("doc_id").alias("id"),
        F.element_at(topics, (at + 1).cast("int")).alias("topic"),
        F.element_at(F.array(*map(F.lit, dataset.RISKS)), (F.col("doc_id") % 3 + 1).cast("int")).alias("risk"),
        F.col("text").alias("scenario"),
        "lang",
    )


_EX = f"ex AS (SELECT doc_id AS id, {_list([t for t, _ in dataset.TOPICS])}[coalesce(TRY_CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER), 0) % 14 + 1] AS topic, {_list(dataset.RISKS)}[doc_id % 3 + 1] AS risk, text AS scenario, lang FROM documents)"


@query(f"WITH {_POL}, {_EX} SELECT e.id, e.topic, p.category, p.category = e.topic AS same_name FROM ex e LEFT JOIN pol p USING (topic)")
def policy_taxonomy_check(spark, sf_dir):
    p = dataset.policies(spark).select("topic", "category")
    return _examples(spark, sf_dir).select("id", "topic").join(F.broadcast(p), "topic", "left").select("id", "topic", "category", (F.col("category") == F.col("topic")).alias("same_name"))


def _candidates(spark, sf_dir):
    """Returned records in batches of five documents: every 11th repeats the id before it, every 13th an unknown id, every 17th another topic, every 19th another risk."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    name = lambda n: F.concat(F.lit("doc_"), n.cast("string"))
    return d.select(
        F.floor(i / 5).cast("long").alias("batch_id"),
        (i % 5).alias("pos"),
        F.when(i % 13 == 0, F.concat(F.lit("other_"), i.cast("string"))).when((i % 11 == 0) & (i % 5 != 0), name(i - 1)).otherwise(name(i)).alias("id"),
        F.when(i % 17 == 0, "AML").otherwise("KYC").alias("topic"),
        F.lit("KYC").alias("category"),
        F.lit("Internal policy: identity evidence is complete.").alias("policy_excerpt"),
        F.when(i % 19 == 0, "high").otherwise("low").alias("risk_level"),
        F.col("text").alias("scenario"),
    )


def _asked(spark, sf_dir):
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.floor(i / 5).cast("long").alias("batch_id"),
        F.concat(F.lit("doc_"), i.cast("string")).alias("id"),
        F.lit("KYC").alias("topic"),
        F.lit("KYC").alias("category"),
        F.lit("Internal policy: identity evidence is complete.").alias("policy_excerpt"),
        F.lit("low").alias("target_risk"),
    )


_ACC = """c AS (SELECT doc_id // 5 AS batch_id, doc_id % 5 AS pos, CASE WHEN doc_id % 13 = 0 THEN 'other_' || doc_id WHEN doc_id % 11 = 0 AND doc_id % 5 <> 0 THEN 'doc_' || (doc_id - 1) ELSE 'doc_' || doc_id END AS id,
 CASE WHEN doc_id % 17 = 0 THEN 'AML' ELSE 'KYC' END AS topic, CASE WHEN doc_id % 19 = 0 THEN 'high' ELSE 'low' END AS risk_level, length(trim(text)) AS n FROM documents),
 a AS (SELECT doc_id // 5 AS batch_id, 'doc_' || doc_id AS id, true AS asked FROM documents),
 o AS (SELECT c.*, CASE WHEN coalesce(n, 0) NOT BETWEEN 20 AND 2000 THEN 'schema_validation' WHEN asked IS NULL THEN 'unrequested_id' WHEN topic <> 'KYC' THEN 'assignment_mismatch' WHEN risk_level <> 'low' THEN 'assigned_risk_mismatch' END AS own
 FROM c LEFT JOIN a USING (batch_id, id)),
 w AS (SELECT *, min(CASE WHEN own IS NULL THEN batch_id * 10 + pos END) OVER (PARTITION BY id) AS win FROM o),
 acc AS (SELECT batch_id, pos, id, CASE WHEN own = 'schema_validation' THEN own WHEN win < batch_id * 10 + pos THEN 'duplicate_id' WHEN own IS NOT NULL THEN own ELSE 'accepted' END AS reason FROM w)"""


@query(f"WITH {_ACC} SELECT CAST(batch_id AS BIGINT) AS batch_id, pos, id, reason FROM acc")
def accept_records(spark, sf_dir):
    return dataset.accept(_candidates(spark, sf_dir), _asked(spark, sf_dir)).select("batch_id", "pos", "id", "reason")


@query(f"WITH {_ACC} SELECT reason, count(*) AS n FROM acc GROUP BY 1")
def rejection_reasons(spark, sf_dir):
    return dataset.accept(_candidates(spark, sf_dir), _asked(spark, sf_dir)).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {_EX} SELECT topic, count(*) AS n FROM ex GROUP BY 1")
def topic_counts(spark, sf_dir):
    return _examples(spark, sf_dir).groupBy("topic").agg(F.count("*").alias("n"))


@query(f"WITH {_EX} SELECT topic, count(*) FILTER (WHERE risk = 'low') AS low, count(*) FILTER (WHERE risk = 'medium') AS medium, count(*) FILTER (WHERE risk = 'high') AS high FROM ex GROUP BY 1")
def topic_risk_crosstab(spark, sf_dir):
    return dataset.crosstab(_examples(spark, sf_dir))


@query(f"SELECT count(n_chars) AS n, {_r6('avg(n_chars)')} AS mean, {_r6('stddev_samp(n_chars)')} AS std, min(n_chars) AS least, {_r6('quantile_cont(n_chars, 0.25)')} AS q25, {_r6('quantile_cont(n_chars, 0.5)')} AS q50, {_r6('quantile_cont(n_chars, 0.75)')} AS q75, max(n_chars) AS most FROM documents")
def length_describe(spark, sf_dir):
    x = dataset.described(table(spark, sf_dir, "documents").select("n_chars"), "n_chars")
    return x.withColumns({c: r6(F.col(c)) for c in ("mean", "std", "q25", "q50", "q75")})


@query("""WITH e AS (SELECT CAST(min(n_chars) AS DOUBLE) AS lo, CAST(max(n_chars) AS DOUBLE) AS hi FROM documents)
 SELECT CAST(least(floor((n_chars - lo) / ((hi - lo) / 15)) + 1, 15) AS INTEGER) AS bin, count(*) AS n FROM documents, e GROUP BY 1""")
def length_histogram(spark, sf_dir):
    return dataset.histogram(table(spark, sf_dir, "documents"), "n_chars")


def _split(spark, sf_dir, distinct: bool):
    """Records by split. distinct: the first record of each normalised text only, so that the scenarios' uniqueness can be asked for."""
    x = _examples(spark, sf_dir).select("id", "topic", "risk", F.md5(normalized(F.col("scenario")).cast("binary")).alias("norm_md5"))
    if distinct:
        x = x.groupBy(F.col("norm_md5").alias("scenario_key")).agg(F.min("id").alias("first"), *[F.min_by(c, "id").alias(c) for c in ("topic", "risk")]).withColumnRenamed("first", "id")
    return dataset.stratified_split(written(x))


def _split_sql(rows: str) -> str:
    rank = lambda c: f"base_{c} + CASE WHEN row_number() OVER (ORDER BY share_{c} - base_{c} DESC, stratum) <= h_{c} - sum(base_{c}) OVER () THEN 1 ELSE 0 END"
    return f"""{_EX}, own AS ({rows}), sz AS (SELECT count(*) AS n, count(*) // 10 + CASE WHEN count(*) % 10 >= 7 THEN 1 ELSE 0 END AS h_t, count(*) // 10 + CASE WHEN count(*) % 10 >= 4 THEN 1 ELSE 0 END AS h_v FROM own),
 st AS (SELECT topic || '|' || risk AS stratum, count(*) AS c FROM own GROUP BY 1), sh AS (SELECT *, c * h_t * 1.0 / n AS share_t, c * h_v * 1.0 / n AS share_v FROM st, sz),
 q AS (SELECT *, CAST(floor(share_t) AS BIGINT) AS base_t, CAST(floor(share_v) AS BIGINT) AS base_v FROM sh), tq AS (SELECT stratum, {rank('t')} AS n_test, {rank('v')} AS n_validation FROM q),
 r AS (SELECT own.*, topic || '|' || risk AS stratum, row_number() OVER (PARTITION BY topic || '|' || risk ORDER BY md5(CAST(id AS VARCHAR) || '|42|split'), id) AS place FROM own),
 split AS (SELECT id, topic, risk, r.stratum, scenario AS text, CASE WHEN place <= n_test THEN 'test' WHEN place <= n_test + n_validation THEN 'validation' ELSE 'train' END AS split FROM r JOIN tq USING (stratum))"""


_FIRST = f"SELECT * FROM ex QUALIFY row_number() OVER (PARTITION BY md5({_NORM.replace('text', 'scenario')}) ORDER BY id) = 1"


@query(f"WITH {_split_sql(_FIRST)} SELECT id, topic, risk, stratum, split FROM split")
def stratified_split(spark, sf_dir):
    return _split(spark, sf_dir, True).select("id", "topic", "risk", "stratum", "split")


@query(f"WITH {_split_sql('SELECT * FROM ex')}, k AS (SELECT 'id' AS key, CAST(id AS VARCHAR) AS value, split FROM split UNION ALL SELECT 'norm_md5', md5({_NORM}), split FROM split) SELECT key, value, count(DISTINCT split) AS splits FROM k GROUP BY 1, 2 HAVING count(DISTINCT split) > 1")
def split_leakage(spark, sf_dir):
    """Records with copies, split without a look at the scenarios: copies end in different splits."""
    return dataset.leakage(_split(spark, sf_dir, False), ("id", "norm_md5"))


@query(f"""WITH {_EX} SELECT id, 'system|user|assistant' AS roles, 'You triage cases.' AS system, md5('Policy:' || chr(10) || 'Internal policy.' || chr(10) || chr(10) || 'Scenario:' || chr(10) || scenario) AS user_md5,
 '{{"risk_level":"' || risk || '","category":"' || topic || '","reason":"because","action":"review the case"}}' AS answer FROM ex""")
def chat_records(spark, sf_dir):
    x = _examples(spark, sf_dir).select("id", F.lit("Internal policy.").alias("policy_excerpt"), "scenario", F.col("risk").alias("risk_level"), F.col("topic").alias("category"), F.lit("because").alias("reason"), F.lit("review the case").alias("action"))
    m = dataset.chat_records(x, "You triage cases.").select("id", F.array_join(F.transform("messages", lambda x: x["role"]), "|").alias("roles"), *[F.col("messages")[i]["content"].alias(f"c{i}") for i in range(3)])
    return m.select("id", "roles", F.col("c0").alias("system"), F.md5(F.col("c1").cast("binary")).alias("user_md5"), F.col("c2").alias("answer"))


# Tool calls: one per turn of a conversation.
_ROLES, _TOOLS = ("researcher", "analyst", "writer"), evidence.ROLE_TOOLS["researcher"]
_CALLS = f"calls AS (SELECT conv_id, turn, {_list(_ROLES)}[turn % 3 + 1] AS role, {_list(_TOOLS)}[(conv_id + turn) % 5 + 1] AS tool, (conv_id + turn) % 4 <> 0 AS success, (conv_id + turn) % 2 = 0 AS cache_hit, text AS output FROM conversations)"
_ALLOWED = "allowed(role, tool) AS (VALUES " + _values([(r, t) for r, ts in evidence.ROLE_TOOLS.items() for t in ts]) + ")"


def _calls(spark, sf_dir):
    at = lambda values, e: F.element_at(F.array(*map(F.lit, values)), (e + 1).cast("int"))
    n = F.col("conv_id") + F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", at(_ROLES, F.col("turn") % 3).alias("role"), at(_TOOLS, n % 5).alias("tool"), (n % 4 != 0).alias("success"), (n % 2 == 0).alias("cache_hit"), F.col("text").alias("output")
    )


@query(f"WITH {_CALLS}, {_ALLOWED} SELECT conv_id, turn, role, tool FROM calls SEMI JOIN allowed USING (role, tool)")
def tool_permissions(spark, sf_dir):
    return evidence.permitted(_calls(spark, sf_dir)).select("conv_id", "turn", "role", "tool")


@query(f"""WITH {_CALLS} SELECT conv_id, coalesce(bool_or(success AND tool IN ('get_price_data', 'calculate_volatility', 'llm_sentiment')), false) AS quantitative,
 coalesce(bool_or(success AND tool IN ('get_news', 'web_search')), false) AS qualitative FROM calls GROUP BY 1""")
def evidence_coverage(spark, sf_dir):
    return evidence.coverage(_calls(spark, sf_dir), "conv_id")


@query(f"""WITH {_CALLS}, g AS (SELECT conv_id, list(turn) FILTER (WHERE success) AS allowed, list(turn) AS cited, list(turn) FILTER (WHERE success AND tool IN ('get_price_data', 'calculate_volatility', 'llm_sentiment')) AS q FROM calls GROUP BY 1)
 SELECT conv_id, CAST(len(list_filter(list_distinct(cited), lambda x : NOT list_contains(coalesce(allowed, []), x))) AS INTEGER) AS n_unknown, len(list_filter(cited, lambda x : NOT list_contains(coalesce(allowed, []), x))) = 0 AS within, len(coalesce(q, [])) > 0 AS has_quantitative FROM g""")
def citation_check(spark, sf_dir):
    quant = F.col("tool").isin(*evidence.QUANTITATIVE)
    x = _calls(spark, sf_dir).groupBy("conv_id").agg(F.collect_list("turn").alias("cited"), F.collect_list(F.when(F.col("success"), F.col("turn"))).alias("allowed"), F.collect_list(F.when(F.col("success") & quant, F.col("turn"))).alias("q"))
    c = evidence.citation_check(F.col("cited"), F.col("allowed"), F.col("q"))
    return x.select("conv_id", F.size(c["unknown"]).alias("n_unknown"), c["within"].alias("within"), c["has_quantitative"].alias("has_quantitative"))


_METRICS = (("current_price", 0), ("ytd_return_pct", 1), ("RSI", 0), ("MACD_histogram", 1e-7), ("SMA_200", 0), ("pe_ratio", 0))


@query(f"""{_FULL}, last AS (SELECT * FROM signal QUALIFY row_number() OVER (PARTITION BY series ORDER BY d DESC) = 1), {_SUMMARY},
 o AS (SELECT l.series, s.current_price, {_r6('s.ytd')} AS ytd_return_pct, {_r6('l.rsi')} AS rsi, {_r6('l.macd_histogram')} AS macd_histogram, {_r6('l.sma_200')} AS sma_200, CAST(NULL AS DOUBLE) AS pe_ratio FROM last l JOIN summary s USING (series)),
 m AS ({' UNION ALL '.join(f"SELECT series AS evidence_id, '{n}' AS name, {n.lower()} + {d} AS value, {n.lower()} AS observed FROM o" for n, d in _METRICS)} UNION ALL SELECT 'nowhere', 'RSI', 50.0, NULL)
 SELECT *, CASE WHEN value IS NULL THEN observed IS NULL ELSE coalesce(abs(value - observed) <= greatest(1e-9 * greatest(abs(value), abs(observed)), 1e-9), false) END AS grounded FROM m""")
def metric_grounding(spark, sf_dir):
    """Values as they stand in the outputs, values that are off by 1 and by 1e-7, missing ones and an unknown observation."""
    x = written(_indicators(spark, sf_dir))
    last = written(signals.latest(x).join(signals.price_summary(x), "series").withColumn("pe_ratio", F.lit(None).cast("double")))
    r = {n: (F.col(n) if n == "current_price" else r6(F.col(n))).alias(n) for n, _ in _METRICS}
    parts = {"summary": ("current_price", "ytd_return_pct", "pe_ratio"), "latest_indicators": ("RSI", "MACD_histogram", "SMA_200")}
    obs = last.select(F.col("series").alias("evidence_id"), F.to_json(F.struct(*[F.struct(*[r[n] for n in names]).alias(part) for part, names in parts.items()])).alias("output"))
    claims_ = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), (r[n] + F.lit(float(d))).alias("value")) for n, d in _METRICS]))
    m = last.select(F.col("series").alias("evidence_id"), claims_.alias("c")).select("evidence_id", "c.name", "c.value")
    return evidence.grounded_metrics(m.unionByName(spark.createDataFrame([("nowhere", "RSI", 50.0)], m.schema)), obs)


# Sentences that keep to or break each rule of report texts; every document makes a report of two of them.
SAID = (
    "Cash flow is strong.", "Cash flow is not assessed.", "Solvency unavailable, earnings-quality is unknown but the balance-sheet is sound.", "There is no view on cash-flow; solvency remains good.",
    "The optimal strike is near.", "No optimal put was found.", "An optimal view.", "Premium is attractive.", "We do not know if implied volatility is cheap.", "PE is above its historical ratio.", "The ratio is not above the sector.", "Valued below the sector, P/E 20.5.",
    "Hedge about 30% of exposure.", "We do not set a 5% stop-loss.", "Use NVDA futures.", "Stop-loss near 7.5%; cover 12 %.", "The strike is at $120.", "The 90-day move is 22.7%.", "The 90-day move is 38%.", "The annualized 90-day volatility is 38%.",
    "22.66% as a 90-day expected move.", "A 5% one-sigma move; one-sigma return scale is 22.71%.", "9 of 10 headlines analyzed; 3 positive.", "8 of 10 headlines were analyzed.", "2 failed, 5 neutral.", "Analysis of 9 recent headlines, 1 negative.", "12 positive items and 1 analyses failed.", "9 of 11 headlines.",
)
VOLATILITY, COUNTED = 0.3796, {"successful_count": 9, "failed_count": 1, "positive_count": 3, "negative_count": 1, "neutral_count": 5, "total_headline_count": 10}


def _reports(spark, sf_dir):
    """A report per document from two of the sentences; every second is a hedge recommendation."""
    i, said = F.col("doc_id"), F.array(*map(F.lit, SAID))
    pick = lambda n: F.element_at(said, (n % len(SAID) + 1).cast("int"))
    counts = F.create_map(*[F.lit(x) for k, v in COUNTED.items() for x in (k, v)]).cast("map<string,bigint>")
    return table(spark, sf_dir, "documents").select(
        i.alias("report_id"), F.when(i % 2 == 0, "hedge_strategy_recommendation").otherwise("market_sentiment_summary").alias("field"), F.concat_ws(" ", pick(i), pick(F.floor(i / 3))).alias("text"),
        F.lit("NVDA").alias("ticker"), F.array(F.lit(VOLATILITY)).alias("volatility"), F.array(counts).alias("counts"),
    )


def _claims_sql() -> str:
    """The rules in SQL. RE2 has no look-around, but the sentence break needs none: a mark, then space. A mention is found by its own text."""
    q = lambda p: "'(?i)" + p.replace("'", "''") + "'"
    c = claims
    before, after = "substr({s}, 1, strpos({s}, {m}) - 1)", "substr({s}, strpos({s}, {m}) + length({m}))"
    denied = lambda s, m: f"(regexp_matches({before.format(s=s, m=m)}, {q(c.DENIED_BEFORE)}) OR regexp_matches({after.format(s=s, m=m)}, {q('^(?:' + c.DENIED_AFTER + ')')}))"
    first = lambda p: f"(regexp_extract(s, {q(p)}) <> '' AND NOT {denied('s', f'regexp_extract(s, {q(p)})')})"
    has = lambda p: f"regexp_matches(s, {q(p)})"
    futures = r"\bNVDA\s+futures\b"
    rules = {
        "fundamentals": f"{has(c.ASSERTED)} AND len(list_filter(regexp_extract_all(s, {q(c.FUNDAMENTALS)}), lambda m : NOT {denied('s', 'm')})) > 0",
        "optimal_option": f"{has(c.OPTION)} AND {first(c.OPTIMAL)}",
        "option_valuation": first(c.OPTION_VALUE),
        "benchmark_valuation": f"{has(c.YARDSTICK)} AND {has(c.RATIO)} AND {first(c.COMPARED)}",
        "hedge_sizing": f"field = 'hedge_strategy_recommendation' AND CASE WHEN {has(c.SIZING)} THEN {first(c.SIZING)} ELSE {first(futures)} END",
    }
    for key, patterns in c.COUNTS.items():
        part_of = f"AND NOT regexp_matches({before.format(s='s', m='m')}, '\\d+\\s+of\\s+$')" if key == "successful_count" else ""
        rules[key] = " OR ".join(f"len(list_filter(regexp_extract_all(s, {q(p)}), lambda m : CAST(regexp_extract(m, {q(p)}, 1) AS BIGINT) <> {COUNTED[key]} {part_of})) > 0" for p in patterns)
    sigma = VOLATILITY * 100 * (90 / 252) ** 0.5
    look = f"substr(t, greatest(1, strpos(t, m) - {c.SIGMA_LOOK_BACK}), strpos(t, m) - greatest(1, strpos(t, m) - {c.SIGMA_LOOK_BACK}))"
    scale = " OR ".join(f"len(list_filter(regexp_extract_all(t, {q(p)}), lambda m : abs(CAST(regexp_extract(m, {q(p)}, 1) AS DOUBLE) - {sigma!r}) > 0.06 AND NOT regexp_matches({look}, {q(c.SIGMA_OTHER_SCALE)}))) > 0" for p in c.SIGMA)
    flags = ", ".join(f"bool_or({e}) AS {n}" for n, e in rules.items())
    names = ", ".join(f"CASE WHEN {n} THEN '{n}' END" for n in c.RULES)
    return f"""WITH r AS (SELECT doc_id AS report_id, CASE WHEN doc_id % 2 = 0 THEN 'hedge_strategy_recommendation' ELSE 'market_sentiment_summary' END AS field,
 {_list(SAID)}[doc_id % {len(SAID)} + 1] || ' ' || {_list(SAID)}[(doc_id // 3) % {len(SAID)} + 1] AS t FROM documents),
 s AS (SELECT report_id, field, unnest(string_split_regex(t, '[.!?;]\\s+')) AS s FROM r), f AS (SELECT report_id, {flags} FROM s GROUP BY 1), g AS (SELECT report_id, {scale} AS sigma_scale FROM r)
 SELECT report_id, coalesce(concat_ws(',', {names}), '') AS broken FROM f JOIN g USING (report_id)"""


@query(_claims_sql())
def report_claims(spark, sf_dir):
    return claims.check_reports(_reports(spark, sf_dir)).select("report_id", F.array_join("broken", ",").alias("broken"))


@query(f"WITH {_CALLS} SELECT conv_id, turn, md5(substr(regexp_replace(regexp_replace('Bearer ' || md5(coalesce(output, '')) || ' sk-' || md5(tool) || ' ' || coalesce(output, ''), '(?:gsk_|sk-|hf_)[A-Za-z0-9_-]{{8,}}', '[REDACTED]', 'g'), '(?i)Bearer\\s+[A-Za-z0-9._-]+', 'Bearer [REDACTED]', 'g'), 1, 200)) AS output_md5 FROM calls")
def redacted_trace(spark, sf_dir):
    out = F.coalesce("output", F.lit(""))
    said = F.concat(F.lit("Bearer "), F.md5(out.cast("binary")), F.lit(" sk-"), F.md5(F.col("tool").cast("binary")), F.lit(" "), out)
    x = evidence.trace_rows(_calls(spark, sf_dir).withColumn("output", said))
    return x.select("conv_id", "turn", F.md5(F.col("output").cast("binary")).alias("output_md5"))


@query(f"WITH {_CALLS} SELECT tool, count(*) AS calls, count(*) FILTER (WHERE success) AS succeeded, count(*) FILTER (WHERE cache_hit) AS cached, CAST(max(length(substr(output, 1, 200))) AS INTEGER) AS longest_output FROM calls GROUP BY 1")
def trace_stats(spark, sf_dir):
    return evidence.trace_stats(evidence.trace_rows(_calls(spark, sf_dir)))


@query("""SELECT event_type AS series, date_trunc('day', ts) AS d, count(*) AS n FROM events GROUP BY 1, 2""")
def event_day_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("series"), F.date_trunc("day", "ts").alias("d")).agg(F.count("*").alias("n"))


@query(f"{_FULL} SELECT series, bool_and(coalesce(rsi BETWEEN 0 AND 100, true)) AS rsi_ok, bool_and(coalesce(bb_lower <= bb_middle AND bb_middle <= bb_upper, true)) AS bands_ok FROM signal GROUP BY 1")
def indicator_sanity(spark, sf_dir):
    ok = rules.indicator_sanity()
    return timeseries.with_indicators(bars.validated(_bars(spark, sf_dir))).groupBy("series").agg(F.bool_and(ok["rsi"]).alias("rsi_ok"), F.bool_and(ok["bands"]).alias("bands_ok"))


# Recommendations: a document as reasoning, a signal by its id. RE2 has no look-around, so the SQL marks breaks first.
_SENTENCES = "string_split(regexp_replace(regexp_replace(trim(r), '([.!?])\\s+([A-Za-z])', '\\1' || chr(1) || '\\2', 'g'), '([.!?])\\s+([A-Za-z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"


@query(f"""WITH d AS (SELECT doc_id, text AS r, CASE WHEN doc_id % 3 = 0 THEN 'BUY' WHEN doc_id % 3 = 1 THEN 'BULLISH' ELSE 'HOLD' END AS signal FROM documents), s AS (SELECT *, {_SENTENCES} AS x FROM d)
 SELECT doc_id, signal IN ('BUY', 'HOLD', 'SELL') AS signal_ok, length(trim(r)) BETWEEN 1 AND 900 AS length_ok, CAST(len(x) AS INTEGER) AS n_sentences, len(x) BETWEEN 3 AND 5 AS sentences_ok,
 len(list_filter(x, lambda y : NOT regexp_matches(y, '[.!?]\\z'))) = 0 AS closed_ok FROM s""")
def recommendation_rules(spark, sf_dir):
    i = F.col("doc_id")
    x = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("reasoning"), F.when(i % 3 == 0, "BUY").when(i % 3 == 1, "BULLISH").otherwise("HOLD").alias("signal"))
    ok = rules.recommendation()
    return x.select("doc_id", ok["signal"].alias("signal_ok"), ok["length"].alias("length_ok"), F.size(rules.sentences(F.col("reasoning"))).alias("n_sentences"), ok["sentences"].alias("sentences_ok"), ok["closed"].alias("closed_ok"))


@query(f"""WITH {_SENT}, a AS (SELECT source, {_AGG} FROM s GROUP BY 1) SELECT source, successful_count + failed_count AS total_count, positive_count + negative_count + neutral_count = successful_count AS adds_up FROM a""")
def sentiment_coverage(spark, sf_dir):
    x = evidence.sentiment_aggregate(_sentiments(spark, sf_dir), "source")
    return x.select("source", (F.col("successful_count") + F.col("failed_count")).alias("total_count"), (F.col("positive_count") + F.col("negative_count") + F.col("neutral_count") == F.col("successful_count")).alias("adds_up"))
