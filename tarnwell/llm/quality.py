"""Quality classifier from weak labels.

Overlapping heuristic labellers (the votes of ``rules``) see every document; expectation-maximisation over
their vote patterns estimates their accuracies and gives every document a posterior label (see ``rules``).
The posteriors of a bounded sample (``train_rows`` rows by hash of the id) then train a linear scorer on
hashed features: shapes of words (runs of lower case, upper case, digits and each sign) by their share of
the words, and steps of the text statistics. Every whole text is scored with the linear model.

Null and empty texts score by the features they lack; very long texts are read whole, and all features are shares or
logarithms. Null ids pass through and aren't learnt from; of rows of one id the mean posterior counts. Repeated rows score
each. Ties: a quality of exactly 0.5 is kept. Extra columns pass by unread; one named like the score is replaced. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _stats, rules
from . import _text as tx
from ._common import by_value, discard, lean, others, table, written

BITS, TRAIN_ROWS, CUT = 14, 20_000, 0.5
for _m in (__name__, tx.__name__, _stats.__name__):
    by_value(_m)

_KIND = np.arange(256, dtype=np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 2
#: Statistics whose shares are stepped: part, whole.
_STEPS = (("n_signed_words", "n_words"), ("n_repeat_words", "n_words"), ("n_dup_lines", "n_lines"), ("n_upper", "n_letters"), ("n_digits", "word_chars"), ("n_function_words", "n_words"), ("n_ended_lines", "n_lines"), ("n_long_words", "n_words"), ("n_symbols", "word_chars"))


def features(part: np.ndarray, off: np.ndarray, counts: dict[str, np.ndarray], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and values in document order, and how many each document has."""
    n = len(off) - 1
    starts, ends, number = tx.words(part, off)
    kind = _KIND[part]
    keep = np.ones(len(part), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[starts] = True
    keep &= ~tx.SPACE[part]
    place = np.zeros(len(part) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    shapes = tx.span_hash(kind[keep], place[starts], place[ends])
    values, times, sizes = tx.per_doc_unique(shapes, number)
    mask = np.uint64((1 << bits) - 1)
    doc = np.repeat(np.arange(n), sizes)
    share = np.sqrt(times / np.maximum(number[doc], 1))
    steps = [np.minimum(np.floor(20 * counts[a] / np.maximum(counts[b], 1)), 20).astype(np.uint64) + np.uint64(64 * (k + 1)) for k, (a, b) in enumerate(_STEPS)]
    steps.append(np.minimum(np.log2(counts["n_words"] + 1.0), 20).astype(np.uint64))
    stepped = tx.mix(np.stack(steps, axis=1) + tx.BASE) & mask
    docs = np.concatenate([doc, np.repeat(np.arange(n), len(steps))])
    which = np.concatenate([(values & mask).astype(np.int64), stepped.reshape(-1).astype(np.int64)])
    value = np.concatenate([share, np.full(n * len(steps), 0.5)])
    order = np.argsort(docs, kind="stable")
    return which[order], value[order], np.bincount(docs, minlength=n)


def _featurer(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = tx.text_buffer(batch.column(batch.num_columns - 1))
            for i, j in tx.blocks(at):
                part, off = data[at[i] : at[j]], at[i : j + 1] - at[i]
                which, value, sizes = features(part, off, _stats.text_counts(part, off))
                split = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
                cols = [batch.column(k).slice(i, j - i) for k in range(batch.num_columns - 1)]
                lists = [pa.ListArray.from_arrays(split, pa.array(which.astype(np.int32))), pa.ListArray.from_arrays(split, pa.array(value))]
                yield pa.RecordBatch.from_arrays([*cols, *lists], [*names, "which", "value"])

    return lean(run)


def _scorer(names: list[str], taken: int, weights: np.ndarray, bias: float):
    """names: of the columns that stay, the first ``taken`` of a batch, whose last is the text, and of the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = tx.text_buffer(batch.column(batch.num_columns - 1))
            for i, j in tx.blocks(at):
                part, off = data[at[i] : at[j]], at[i : j + 1] - at[i]
                which, value, sizes = features(part, off, _stats.text_counts(part, off))
                logit = np.bincount(np.repeat(np.arange(j - i), sizes), weights[which] * value, minlength=j - i) + bias
                cols = [batch.column(k).slice(i, j - i) for k in range(taken)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(1 / (1 + np.exp(-np.clip(logit, -40, 40))))], names)

    return lean(run)


def fit(which: np.ndarray, value: np.ndarray, doc: np.ndarray, y: np.ndarray, bits: int = BITS, steps: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic weights for soft labels y by gradient descent with per-weight step sizes (Adam)."""
    w, b = np.zeros(1 << bits), 0.0
    m, v, mb, vb = np.zeros(1 << bits), np.zeros(1 << bits), 0.0, 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, w[which] * value, minlength=len(y)) + b, -40, 40)))
        d = (p - y) / max(len(y), 1)
        g, gb = np.bincount(which, d[doc] * value, minlength=1 << bits) + ridge * w, d.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= 0.1 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, float(b)


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Weights and bias. Labellers vote on all of ``docs``; the scorer is fitted on about ``train_rows`` of them."""
    counted = written(_stats.with_counts(docs.select(key, text), text), "quality-counts")
    judged = rules.judged(counted).select(key, "posterior")
    n = counted.count()
    # Ids picked by hash: the share is set so that about train_rows remain; the limit only bounds repeated ids.
    picked = judged.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(1_000_000_007)) < F.lit(1_000_000_007 * min(1.0, train_rows / max(n, 1)))))
    picked = picked.groupBy(key).agg(F.avg("posterior").alias("y")).orderBy(F.xxhash64(key), key).limit(2 * train_rows)
    chosen = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked.withColumnRenamed(key, "id")), "id")
    got = chosen.select("id", "y", "text").mapInArrow(_featurer(["id", "y"]), f"id {dict(docs.dtypes)[key]}, y double, which array<int>, value array<double>").toPandas()
    discard(counted)
    got = got.sort_values("id", kind="stable")
    if not len(got):
        return np.zeros(1 << BITS), 0.0
    doc = np.repeat(np.arange(len(got)), got["which"].map(len))
    return fit(np.concatenate(got["which"].tolist()).astype(np.int64), np.concatenate(got["value"].tolist()), doc, got["y"].to_numpy())


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", out: str = "quality", with_text: bool = False) -> DataFrame:
    """Other columns of ``docs``, the text if wanted, and the quality of each whole text, 0 to 1."""
    keep = [*others(docs, text, out), *[text] * with_text]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + [f"`{out}` double"]
    return docs.select(*others(docs, text, out), text).mapInArrow(_scorer([*keep, out], len(keep), *model), ", ".join(fields))


def op7_weak_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, learn(docs)).withColumn("kept", F.col("quality") >= CUT)
