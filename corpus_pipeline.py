"""Corpus preparation over ``documents``: toxicity, quality, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), reads all that its predecessor kept and returns a DataFrame that is
written as Parquet and read again as the next stage's docs. All but the last return the columns of
``documents``, and whatever further columns docs has.

1. toxicity: documents that score as toxic go. The lexicon is learnt from the table ``labels``.
2. quality: documents that the weak-label classifier rejects go.
3. near-duplicates: of each class the document with the smallest id stays.
4. mixing: each document is repeated as often as the mix takes it, 0 to 3 times; a source's words come near
   its target.
5. packing: pieces of at most 4096 tokens and their places in sequences.

Null texts count as empty in every stage, except that null texts are not copies of one another. Very long texts are read
whole in each. Null ids, repeated rows, ties and empty tables are allowed, with the results that each operator's module states;
further columns of docs may have any name and pass through to the last stage. A stage's table is deleted once the next one
is written. There is no SQL for the stages; tests hold them against plain versions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm import _common, minhash, mixing, packing, quality, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lexicon = toxicity.learn(docs, _common.table(spark, sf_dir, "labels"))
    score = _common.unused(docs, "score")
    return toxicity.score(docs, lexicon, out=score, with_text=True).where(F.col(score) < toxicity.CUT).select(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.learn(docs)
    score = _common.unused(docs, "quality")
    return quality.score(docs, model, out=score, with_text=True).where(F.col(score) >= quality.CUT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by their place in the files of docs, so that equal rows stay apart."""
    row, times = _common.unused(docs, "row"), _common.unused(docs, "times")
    own = _common.numbered(docs, row)
    taken = mixing.copies(mixing.sized_rows(own, ["doc_id"], row=row), ["doc_id"])
    taken = taken.where("copies > 0").select(F.col("row").alias(row), F.sequence(F.lit(1), F.col("copies")).alias(times))
    return own.join(taken, row).withColumn(times, F.explode(times)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = _common.written(packing.pieces(docs.select("doc_id", "text")), "pieces")
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _common.table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        path = f"{_common.shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:  # never the input
            _common.discard(before)
        before = docs
    return docs
