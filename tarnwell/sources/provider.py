"""Price histories of a provider as a Spark source: ``spark.read.format("price_history")``.

A provider answers for one series and a span of days. The source plans one task for each series and each ``days`` days of the span, and asks only for what a query wants: filters of
``series`` and ``d`` are taken over, so that they narrow the series and the span before any request is made. Needs spark.sql.python.filterPushdown.enabled.

Options: ``folder`` and ``series`` (a comma-separated list) of the provider of Parquet files, one ``<series>.parquet`` each, that stands in for a network;
``start`` and ``end``, the span known to the provider; ``days``.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions.config import FetchError
from .ledger import opened

SCHEMA = "series string, d date, open double, high double, low double, close double, volume double"
NAMES = [f.strip().split(" ")[0] for f in SCHEMA.split(",")]
if os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Span(InputPartition):
    series: str
    start: date
    end: date


def fetched(folder: str, series: str, start: date, end: date) -> pa.Table:
    """The provider: bars of one series from ``start`` to ``end``, in order of days. Any failure is a FetchError."""
    try:
        where, path = opened(f"{folder}/{series}.parquet")
        found = pq.read_table(path, filesystem=where, columns=NAMES, filters=[("d", ">=", start), ("d", "<=", end)])
    except (OSError, pa.ArrowException) as e:
        raise FetchError(f"no history of {series}") from e
    return found.sort_by("d")


class HistoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.series = options["folder"], [s for s in options["series"].split(",") if s]
        self.start, self.end = date.fromisoformat(options["start"]), date.fromisoformat(options["end"])
        self.days = int(options.get("days", "3650"))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes over what narrows series and span, and gives back the rest."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("series",) and isinstance(f, (EqualTo, In)):
                self.series = [s for s in self.series if s in ([value] if isinstance(f, EqualTo) else value)]
            elif column == ("d",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and isinstance(value, date):
                one = timedelta(days=1)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.start = max(self.start, value + one * isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.end = min(self.end, value - one * isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> list[Span]:
        spans, at = [], self.start
        while at <= self.end:
            spans.append((at, min(self.end, at + timedelta(days=self.days - 1))))
            at += timedelta(days=self.days)
        return [Span(s, a, b) for s in self.series for a, b in spans]

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # there is one empty task where nothing is wanted
            yield from fetched(self.folder, partition.series, partition.start, partition.end).cast(pa.schema([(n, pa.string() if n == "series" else pa.date32() if n == "d" else pa.float64()) for n in NAMES])).to_batches()


class HistorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "price_history"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HistoryReader:
        return HistoryReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HistorySource)
