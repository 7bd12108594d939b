"""Indicators over a stream against those of a batch."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tarnwell.functions.config import IndicatorConfig
from tarnwell.operators import timeseries
from tarnwell.streaming import indicators

NAMES = ("EMA_fast", "EMA_slow", "MACD", "MACD_signal", "RSI")


def test_streamed_indicators_equal_batch_ones(spark, tmp_path):
    """Three micro-batches of days with gaps, a restart before the last, and a day that comes again too late."""
    rng, cfg = random.Random(3), IndicatorConfig(macd_fast=3, macd_slow=6, macd_signal=4, rsi_period=5)
    rows = [(s, date(2024, 1, 1) + timedelta(days=i), None if s == "b" and i % 17 == 9 else 100 + rng.random() * 10) for s in ("a", "b") for i in range(60)]
    df = spark.createDataFrame(rows, "series string, d date, close double")
    source, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    indicators.use_rocksdb(spark)
    cuts = (date(2024, 1, 1), date(2024, 1, 12), date(2024, 2, 3), date(2024, 12, 31))
    for k, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = df.where((F.col("d") >= F.lit(low)) & (F.col("d") < F.lit(high)))
        if k == 2:
            part = part.unionByName(df.where(F.col("d") == F.lit(date(2024, 1, 5))).withColumn("close", F.lit(1.0)))
        part.repartition(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        q = indicators.streamed_indicators(stream, cfg).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r["series"], r["d"]): [r[c] for c in NAMES] for r in spark.read.parquet(out).collect()}
    want = {(r["series"], r["d"]): [r[c] for c in NAMES] for r in timeseries.with_recursions(df, cfg).collect()}
    assert got.keys() == want.keys() and len(got) == 120
    for k, values in want.items():
        assert got[k] == [v if v is None else pytest.approx(v, rel=1e-9) for v in values]
