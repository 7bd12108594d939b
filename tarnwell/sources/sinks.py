"""Sinks: JSON lines, journals, splits with a manifest, reports, traces, caches."""

from __future__ import annotations

import json
import math
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import html_escaped, redacted, redacted_values, secret_values
from ..operators.dataset import SPLITS
from . import commits


def no_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities as null, so that JSON stays strict."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf")))
    return df.select([F.when(~bad(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", one_file: bool = False) -> None:
    df = no_nan(df)
    (df.coalesce(1) if one_file else df).write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_journal(df: DataFrame, path: str, batch: str | None = None) -> str:
    """New part files, visible together in one step (``commits``); earlier ones stay as they are. A ``batch`` that is there already is an error."""
    return commits.publish(no_nan(df), path, batch, ignoreNullFields="false")


MANIFEST_ROWS = 10_000


def block_of(key: Column, blocks: Column) -> Column:
    """A block's number by the first 28 bits of the key's MD5, which any engine can compute."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 7), 16, 10).cast("long") % blocks


def manifest(split: DataFrame, seed: int, stratified_by: str, block_rows: int = MANIFEST_ROWS) -> DataFrame:
    """Per split: rows and a SHA-256 over the hashes of its blocks, each the SHA-256 of its rows' JSON in the order of ids.

    Rows are dealt to blocks of about ``block_rows`` by a hash of the id, so that no task holds a whole split.
    """
    line = F.to_json(F.struct(*[c for c in split.columns if c != "split"]))
    n = split.groupBy("split").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block_rows))
    dealt = split.select("split", "id", line.alias("line")).join(n, "split").withColumn("block", block_of(F.col("id"), F.col("blocks")))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("id", "line"))), lambda x: x["line"])
    block = dealt.groupBy("split", "n", "block").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("sha"))
    whole = F.transform(F.sort_array(F.collect_list(F.struct("block", "sha"))), lambda x: x["sha"])
    return block.groupBy("split", "n").agg(F.sha2(F.array_join(whole, "\n"), 256).alias("sha256")).select("split", "n", "sha256", F.lit(seed).alias("seed"), F.lit(stratified_by).alias("stratified_by"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(split, file, bytes, sha256) of every written file of the splits below ``path``, read back as bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("split", F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def save_splits(split: DataFrame, path: str, seed: int = 42, stratified_by: str = "topic") -> None:
    """Refuses to replace an existing split or manifest. ``ids`` lists the ids of each split in order, ``files`` the digest of each written file.

    The manifest has a row for each split: its rows and share, seed, stratification, a digest over its rows, and one over its files' names and digests in order.
    """
    split.write.mode("errorifexists").partitionBy("split").option("ignoreNullFields", "false").json(f"{path}/splits")
    split.select("split", "id").repartitionByRange("split", "id").sortWithinPartitions("split", "id").write.mode("errorifexists").json(f"{path}/ids")
    file_digests(split.sparkSession, f"{path}/splits").write.mode("errorifexists").json(f"{path}/files")
    files = split.sparkSession.read.schema("split string, file string, bytes long, sha256 string").json(f"{path}/files")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("file", "sha256"))), lambda x: F.concat(x["file"], F.lit(" "), x["sha256"]))
    own = files.groupBy("split").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sha2(F.array_join(lines, "\n"), 256).alias("files_sha256"))
    ratio = F.element_at(F.create_map(*[F.lit(x) for name, tenths in SPLITS for x in (name, tenths / 10)]), F.col("split"))
    manifest(split, seed, stratified_by).join(own, "split").withColumn("ratio", ratio).coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")


def save_cache(df: DataFrame, path: str) -> None:
    """df: ticker, as_of, workflow and more, as JSON lines. Replaces the slots it has rows for and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy("ticker", "as_of", "workflow").json(path)


def run_summary(config: dict, counters: DataFrame) -> str:
    """JSON of a run's parameters and its one row of counters."""
    return strict_json({"configuration": config, "validation": counters.first().asDict()})


def append_trace(events: DataFrame, path: str, most: int = 200) -> None:
    """New JSON lines of trace events; outputs lose their secrets, then all beyond ``most`` characters."""
    shown = F.substring(redacted(F.col("output"), secret_values()), 1, most)
    clean = events.withColumns({"output": shown, "input_arguments": redacted_values(F.col("input_arguments"), secret_values())})
    commits.publish(no_nan(clean), path, ignoreNullFields="false")


def strict_json(value) -> str:
    """JSON text of plain values; NaN and infinities become null, other types are refused."""

    def plain(v):
        if v is None or isinstance(v, (bool, int, str)):
            return v
        if isinstance(v, float):
            return v if math.isfinite(v) else None
        if isinstance(v, (date, datetime)):
            return v.isoformat()
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        raise TypeError(f"{type(v).__name__} has no JSON form")

    return json.dumps(plain(value), ensure_ascii=False, allow_nan=False)


def markdown_escaped(text: str) -> str:
    return "".join("\\" + c if c in r"\`*_{}[]()#+-.!|<>" else c for c in text)


def render_report(summary: DataFrame, headlines: DataFrame, most: int = 3) -> dict[str, str]:
    """Markdown and HTML of one series' summary row and its first headlines. One row and ``most`` titles reach the driver."""
    row = summary.limit(1).select(*[F.col(c).cast("string").alias(c) for c in summary.columns]).first()
    top = [r["title"] for r in headlines.orderBy("pos").limit(most).collect()]
    safe = [r["t"] for r in headlines.orderBy("pos").limit(most).select(html_escaped(F.col("title")).alias("t")).collect()]
    fields = {k: v if v is not None else "n/a" for k, v in (row.asDict() if row else {}).items()}
    lines = [f"- {k}: {markdown_escaped(v)}" for k, v in fields.items()] + ["", "Headlines", *[f"- {markdown_escaped(t)}" for t in top]]
    cells = "".join(f"<tr><th>{k}</th><td>{v}</td></tr>" for k, v in fields.items())
    return {"markdown": "\n".join(lines), "html": f"<table>{cells}</table><ul>{''.join(f'<li>{t}</li>' for t in safe)}</ul>"}
