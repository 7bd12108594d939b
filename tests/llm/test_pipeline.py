"""Each stage on its own input against a plain version or its contract."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tarnwell.llm._common import written

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        got = written(f(spark, docs, DIR), name)
        out.append((name, docs, got))
        docs = got
    return out


def test_columns_and_rows_follow(stages):
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns, name
        known = {r["doc_id"]: r for r in before.collect()}
        assert all(known[r["doc_id"]] == r for r in after.collect()), name


def test_filters_drop_labelled_rows_and_keep_clean_ones(spark):
    """On the tenfold table, as a lexicon needs several toxic rows to learn a word from."""
    big = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{big}/documents.parquet")
    calm = written(corpus_pipeline.drop_toxic(spark, docs, big), "calm")
    left = {r["doc_id"] for r in corpus_pipeline.drop_low_quality(spark, calm, big).select("doc_id").collect()}
    calm = {r["doc_id"] for r in calm.select("doc_id").collect()}
    clean = [i for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    toxic = [i for i, r in labels.items() if r["toxic"] == 1]
    low = [i for i, r in labels.items() if r["quality"] == 0]
    assert len([i for i in clean if i in left]) >= 0.97 * len(clean)
    assert len([i for i in toxic if i in calm]) <= 0.1 * len(toxic) and len([i for i in low if i in left]) <= 0.1 * len(low)


def test_one_row_of_each_class_stays(stages):
    from .test_operators import plain_classes

    _, before, after = stages[2]
    want = plain_classes([(r["doc_id"], r["text"]) for r in before.collect()])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(want.values()))


def test_mixing_repeats_rows(stages):
    _, before, after = stages[3]
    from .test_operators import water_filled, words

    times = Counter(r["doc_id"] for r in after.collect())
    assert max(times.values()) <= 3 and set(times) <= {r["doc_id"] for r in before.collect()}
    sizes, taken = Counter(), Counter()
    for r in before.collect():
        n = len(words(r["text"]))
        sizes[r["source"]] += n
        taken[r["source"]] += n * times[r["doc_id"]]
    for source, target in water_filled(sizes).items():
        assert abs(taken[source] - target) <= 0.02 * target + 100


def test_all_that_is_left_is_packed(stages):
    _, before, after = stages[4]
    pieces = Counter(r["doc_id"] for r in after.where("piece = 0").collect())
    assert pieces == Counter(r["doc_id"] for r in before.collect())
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 4096


def test_stages_on_odd_and_empty_tables(spark):
    from .test_operators import ODD, SCHEMA

    for rows in (ODD, []):
        docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).withColumn("quality", F.lit(1)).withColumn("row", F.lit(2)).withColumn("times", F.lit(3)).withColumn("length", F.lit(4))
        for more in ("__row", "row_number", "node", "class_id", "key", "at", "turn", "size", "label", "n", "bin", "offset", "score_", "_metadata"):
            docs = docs.withColumn(more, F.lit("y"))
        docs = written(docs, "in")
        for name, f in corpus_pipeline.STAGES:
            got = written(f(spark, docs, DIR), "out")
            if name != "packing":
                assert got.columns == docs.columns and got.where("__row <> 'y' or row_number <> 'y' or score <> 'x' or _metadata <> 'y'").isEmpty()
