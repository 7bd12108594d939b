"""Appends that become visible whole or not at all, and once only.

A batch is written below ``_attempts``, which readers pass over, and then renamed to ``batch=<key>``. The rename is the commit: it is one step
of the file system and refused where the name is taken. So a killed job leaves nothing that is read, two writers of different batches lose nothing, and of two
writers of one batch exactly one succeeds. The file system needs a rename in one step that doesn't replace (HDFS, local disks); object stores
without one need a committer of their own.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..functions.config import JournalError

KEY = re.compile(r"[A-Za-z0-9._-]{1,120}")


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    return jvm, where, where.getFileSystem(conf), conf


def committed(spark: SparkSession, path: str, key: str) -> bool:
    jvm, where, fs, _ = _files(spark, path)
    return fs.exists(jvm.org.apache.hadoop.fs.Path(where, f"batch={key}"))


def any_batch(spark: SparkSession, path: str) -> bool:
    jvm, where, fs, _ = _files(spark, path)
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(where, "batch=*"))
    return found is not None and len(found) > 0


def publish(df: DataFrame, path: str, key: str | None = None, fmt: str = "json", **options: str) -> str:
    """Append ``df`` to ``path`` as the batch ``key`` (None: a new one). A key that is there already is an error before anything is written."""
    spark, key = df.sparkSession, key or uuid.uuid4().hex
    if not KEY.fullmatch(key):
        raise ValueError("a batch key has letters, digits, points, lines and underscores only")
    if committed(spark, path, key):
        raise JournalError(f"batch {key} is there already")
    jvm, where, fs, conf = _files(spark, path)
    paths = jvm.org.apache.hadoop.fs
    attempt, final = paths.Path(where, f"_attempts/{uuid.uuid4().hex}"), paths.Path(where, f"batch={key}")
    try:
        df.write.options(**options).format(fmt).save(attempt.toString())
        none = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
        none[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").NONE
        try:
            paths.FileContext.getFileContext(fs.makeQualified(where).toUri(), conf).rename(fs.makeQualified(attempt), fs.makeQualified(final), none)
        except Py4JJavaError as e:
            if not fs.exists(final):
                raise
            raise JournalError(f"batch {key} was published by another writer") from e
    finally:
        fs.delete(attempt, True)
    return key
