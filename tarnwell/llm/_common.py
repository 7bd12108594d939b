"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def by_value(name: str) -> None:
    """Unless PYTHONPATH, which workers share, has the library: send the functions of module ``name`` by value."""
    if ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        cloudpickle.register_pickle_by_value(sys.modules[name])


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow or mapInPandas; at its end the worker, which later stages reuse, gives its free memory back."""

    def go(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return go


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Only a local master may leave it unset (tests)."""
    if (path := spark.conf.get("spark.checkpoint.dir", None)) is not None:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="tarnwell-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
    return f"file://{_LOCAL['dir']}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut and a lost executor costs only its own tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete tables made by ``written`` that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        base = shared_dir(spark).removeprefix("file:").lstrip("/")
        for file in df.inputFiles():
            if base in file:
                path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
                break


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a column ``name``: a value for each row that is the same in every read, however the files are split.

    It is made of file and place. What is not a table in files, or more than columns and rows picked from one, is written first.
    """
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation" or "_metadata" in {c.lower() for c in docs.columns}:
        docs = written(docs.withColumnRenamed("_metadata", f"{name}_metadata"), "numbered")
    at = docs.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(name))
    return at.withColumnRenamed(f"{name}_metadata", "_metadata")


def unused(docs: DataFrame, name: str) -> str:
    """A name that no column of ``docs`` has."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def others(docs: DataFrame, *taken: str) -> list[str]:
    """Columns of ``docs`` but those in ``taken``: an operator's own columns replace equally named ones."""
    names = {t.lower() for t in taken}
    return [c for c in docs.columns if c.lower() not in names]


def id_fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def spread(df: DataFrame, rows: int, per_task: int) -> DataFrame:
    """Deal ``df`` round robin over tasks of about ``per_task`` rows."""
    return df.repartition(max(1, -(-rows // per_task)))


def joined_back(rows: DataFrame, classes: DataFrame, key: str, n: str, total: int, hot: int = 1024) -> DataFrame:
    """``rows`` with the columns of their class, by ``key``. ``n``: the class's number of rows, of ``total``.

    Classes of more than a 1 / ``hot`` share of all rows, so fewer than ``hot``, are broadcast: no key of the shuffled join is hot.
    """
    frequent = F.col(n) * hot > total
    some = F.broadcast(classes.where(frequent))
    return rows.join(F.broadcast(classes.where(frequent).select(key)), key, "left_anti").join(classes.where(~frequent), key).unionByName(rows.join(some, key))


by_value(__name__)
