"""EMA, MACD and RSI over a stream of daily bars: the state of each series is kept across micro-batches (an addition).

The values are those of ``operators.timeseries.with_recursions`` over all days so far. Days of a micro-batch are taken in order; a day that is not
later than the last one of its series is passed over, as its state is gone. Needs the RocksDB state store (``use_rocksdb``).
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.config import IndicatorConfig

STATE = "n long, day date, c double, fast double, slow double, signal double, gain double, loss double"
SHOWN = "series string, d date, close double, EMA_fast double, EMA_slow double, MACD double, MACD_signal double, RSI double"
if os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Indicators(StatefulProcessor):
    """One series: what is known after its last day."""

    def __init__(self, cfg: IndicatorConfig):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", STATE)

    def step(self, close: float | None) -> tuple:
        """Take one day in; the indicators after it."""
        cfg, p = self.cfg, self.cfg.rsi_period
        if close is None or close != close:
            self.n = 0
            return (None,) * 5
        if self.n == 0:
            self.fast = self.slow = close
            self.gain = self.loss = self.signal = 0.0
        else:
            self.fast += 2 / (cfg.macd_fast + 1) * (close - self.fast)
            self.slow += 2 / (cfg.macd_slow + 1) * (close - self.slow)
            up, down = max(close - self.c, 0.0), max(self.c - close, 0.0)
            if self.n <= p:  # sums up to the seed
                self.gain, self.loss = self.gain + up, self.loss + down
                if self.n == p:
                    self.gain, self.loss = self.gain / p, self.loss / p
            else:
                self.gain, self.loss = self.gain + (up - self.gain) / p, self.loss + (down - self.loss) / p
        self.n, self.c = self.n + 1, close
        macd, late = self.fast - self.slow, self.n >= cfg.macd_slow
        if late:
            self.signal = macd if self.n == cfg.macd_slow else self.signal + 2 / (cfg.macd_signal + 1) * (macd - self.signal)
        rsi = None if self.n <= p else (100.0 if self.gain > 0 else 50.0) if self.loss == 0 else 100 - 100 / (1 + self.gain / self.loss)
        return self.fast if self.n >= cfg.macd_fast else None, self.slow if late else None, macd if late else None, self.signal if self.n >= cfg.macd_slow + cfg.macd_signal - 1 else None, rsi

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else (0, None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
        self.n, day, self.c, self.fast, self.slow, self.signal, self.gain, self.loss = known
        batch = pd.concat(list(rows)).sort_values("d", kind="stable")
        out = []
        for d, close in zip(batch["d"], batch["close"], strict=True):
            if day is None or d > day:
                close = None if close is None or close != close else float(close)
                out.append((key[0], d, close, *self.step(close)))
                day = d
        if day is not None:
            self.state.update((self.n, day, self.c, self.fast, self.slow, self.signal, self.gain, self.loss))
        names = [f.strip().split(" ")[0] for f in SHOWN.split(",")]
        yield pd.DataFrame(out, columns=names).astype({c: "float64" for c in names[2:]})

    def close(self) -> None:
        pass


def streamed_indicators(bars: DataFrame, cfg: IndicatorConfig = IndicatorConfig()) -> DataFrame:
    """bars: a stream with series, d (date) and close. A row with the indicators for each new day."""
    return bars.select("series", "d", "close").groupBy("series").transformWithStateInPandas(Indicators(cfg), SHOWN, "Append", "None")
