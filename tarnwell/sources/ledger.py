"""Answers of a paid or slow provider, asked for once.

A request is known by a hash of its system text and payload. Rows with one request ask once; requests that the ledger answers are not asked at all. Tasks note
each answer in a file of their own as soon as they have it, so a task that is tried again goes on where the last attempt stopped, and a run that finds the notes of a killed
one takes them over first. The answers of a run become visible in the ledger in one step (``commits``). A failed request is null for now and asked again
by the next run. The folder must be shared, and its file system show what was flushed to an open file (local and network disks do).
"""

from __future__ import annotations

import json
import os
import sys
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import ProviderError
from . import commits

SCHEMA = "request string, answer string"
if os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def request_key(system: str, payload: Column) -> Column:
    return F.sha2(F.concat(F.lit(system), F.lit("\0"), payload), 256)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def noted(folder: str, partition: int) -> dict[str, str]:
    """Answers that earlier attempts of a task noted; a line that was cut short is passed over."""
    where, path = opened(folder)
    found: dict[str, str] = {}
    for f in where.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if f.base_name.startswith(f"{partition}-"):
            with where.open_input_stream(f.path) as s:
                for line in s.read().decode("utf-8", "replace").splitlines():
                    try:
                        got = json.loads(line)
                        found[got["request"]] = got["answer"]
                    except (ValueError, KeyError, TypeError):
                        continue
    return found


def asker(complete: Callable[[str, str], str], system: str, folder: str, partition: Callable[[], int] = lambda: TaskContext.get().partitionId()):
    """For mapInPandas over (request, payload): (request, answer), asking only for what no attempt of this task has noted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = partition()
        known = noted(folder, part)
        where, path = opened(folder)
        where.create_dir(path, recursive=True)
        with where.open_output_stream(f"{path}/{part}-{uuid.uuid4().hex}.jsonl") as notes:
            for b in batches:
                got = []
                for request, payload in zip(b["request"], b["payload"], strict=True):
                    if request not in known:
                        try:
                            known[request] = complete(system, payload)
                        except ProviderError:
                            known[request] = None
                            continue
                        notes.write((json.dumps({"request": request, "answer": known[request]}) + "\n").encode())
                        notes.flush()
                    if known[request] is not None:
                        got.append((request, known[request]))
                yield pd.DataFrame(got, columns=["request", "answer"])

    return run


def answers(spark: SparkSession, path: str) -> DataFrame:
    """(request, answer) of the ledger, one row per request."""
    if not commits.any_batch(spark, path):
        return spark.createDataFrame([], SCHEMA)
    df = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").json(path)
    return df.groupBy("request").agg(F.min("answer").alias("answer"))


def recovered(spark: SparkSession, path: str) -> bool:
    """Take over what killed runs noted. Whether there was any."""
    where, base = opened(f"{path}/_notes")
    runs = [f for f in where.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.type == fs.FileType.Directory]
    for run in runs:
        found = spark.read.schema(SCHEMA + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(f"{path}/_notes/{run.base_name}")
        commits.publish(found.where("_bad is null and request is not null").select("request", "answer"), path, f"notes-{run.base_name}")
        where.delete_dir(run.path)
    return bool(runs)


def completed(df: DataFrame, complete: Callable[[str, str], str], system: str, path: str, payload: str = "payload", out: str = "answer", tasks: int | None = None) -> DataFrame:
    """``df`` with a provider's answer per row, by way of the ledger at ``path``; null where the request failed or the payload is null. Other runs at the same time may ask again."""
    spark = df.sparkSession
    recovered(spark, path)
    wanted = df.where(F.col(payload).isNotNull()).select(request_key(system, F.col(payload)).alias("request"), F.col(payload).alias("payload"))
    new = wanted.join(answers(spark, path).select("request"), "request", "left_anti").groupBy("request").agg(F.min("payload").alias("payload"))
    if not new.isEmpty():
        run = uuid.uuid4().hex
        dealt = new.repartition(tasks or spark.sparkContext.defaultParallelism, "request")
        got = dealt.mapInPandas(asker(complete, system, f"{path}/_notes/{run}"), SCHEMA)
        commits.publish(got, path, f"run-{run}")
        where, base = opened(f"{path}/_notes/{run}")
        where.delete_dir(base)
    key = "__request"
    known = answers(spark, path).select(F.col("request").alias(key), F.col("answer").alias(out))
    return df.withColumn(key, request_key(system, F.col(payload))).join(known, key, "left").drop(key)
