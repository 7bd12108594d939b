"""Quality rules as weak supervision.

Each rule votes keep (1), drop (0) or abstains (-1). Expectation-maximisation of a two-class model, in
which rules err independently given the class, estimates from the votes alone how often each rule votes
and errs; a document's posterior probability of good quality replaces all-must-pass filtering.

Votes are summed to counts per pattern over all documents before anything reaches the driver; with R
rules there are at most 3**R patterns, whatever the number of documents. A hot pattern is one row.

Null text counts as empty; very long texts are read whole, and all thresholds but that of the length are shares. Repeated
rows vote each; null ids pass through. Ties: a posterior of exactly 0.5 keeps. An empty table gives an empty result. Other
columns pass by unread; one named like a statistic or posterior is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _stats
from ._common import others, table, unused, written

POSTERIOR = 0.5


def _vote(drop: Column, keep: Column) -> Column:
    return F.when(drop, F.lit(0)).when(keep, F.lit(1)).otherwise(F.lit(-1))


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def rules() -> dict[str, Column]:
    """The rule set. Thresholds are shares, so that they hold for texts of any length."""
    n = F.col("n_words")
    some = n >= 1
    size = F.col("word_chars") / F.greatest(n, F.lit(1))
    return {
        "length": _vote(n < 10, n >= 40),
        "repeats": _vote(_share("n_repeat_words", "n_words") > 0.2, some & (_share("n_repeat_words", "n_words") <= 0.1) & (n >= 10)),
        "loops": _vote(_share("n_repeat_words", "n_words") > 0.5, some & (_share("n_repeat_words", "n_words") <= 0.05) & (n >= 10)),
        "signs": _vote(_share("n_signed_words", "n_words") > 0.2, some & (_share("n_signed_words", "n_words") <= 0.02)),
        "symbols": _vote(_share("n_symbols", "word_chars") > 0.03, some & (_share("n_symbols", "word_chars") <= 0.005)),
        "capitals": _vote(_share("n_upper", "n_letters") > 0.4, (F.col("n_letters") > 20) & (_share("n_upper", "n_letters") < 0.15)),
        "lines": _vote((F.col("n_lines") >= 2) & (_share("n_dup_lines", "n_lines") > 0.25), (F.col("n_lines") >= 2) & (F.col("n_dup_lines") == 0)),
        "word_size": _vote(some & ((size < 2.5) | (size > 12)), (size >= 3.5) & (size <= 9)),
        "digits": _vote(_share("n_digits", "word_chars") > 0.3, some & (_share("n_digits", "word_chars") < 0.05)),
        "prose": _vote((n >= 20) & (_share("n_function_words", "n_words") < 0.02), (n >= 20) & (_share("n_function_words", "n_words") > 0.08)),
        "endings": _vote((F.col("n_lines") >= 2) & (_share("n_ended_lines", "n_lines") < 0.1), _share("n_ended_lines", "n_lines") > 0.6),
    }


def estimate(votes: np.ndarray, n: np.ndarray, steps: int = 200, prior: float = 0.01, start: float = 0.8) -> dict:
    """votes: (patterns, rules) of -1, 0, 1; n: documents of each. Class share, drop rates and posteriors.

    An abstention says nothing; ``drop[c, r]`` is the share of drop votes among the votes of rule r on class c
    (0 bad, 1 good). Starts from a share ``start`` of good documents, among which drop votes are a fifth as
    common as overall; ``prior`` smooths the rates.
    """
    good, n = start, n.astype(float)
    down, up = (votes == 0).astype(float), (votes == 1).astype(float)
    overall = (n @ down + prior) / (n @ (down + up) + 2 * prior)
    drop = np.stack([np.minimum(0.95, overall * (1 - 0.2 * start) / (1 - start)), 0.2 * overall])
    post = np.full(len(n), 0.5)
    for _ in range(steps):
        logs = down @ np.log(drop).T + up @ np.log(1 - drop).T + np.log([1 - good, good])
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))
        done = len(n) == 0 or np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
        good = float(np.clip((n @ post) / n.sum(), 1e-6, 1 - 1e-6))
        for c, w in ((0, n * (1 - post)), (1, n * post)):
            drop[c] = (w @ down + prior) / (w @ (down + up) + 2 * prior)
    right = good * (1 - drop[1]) + (1 - good) * drop[0]
    return {"good": good, "drop": drop, "posterior": post, "accuracy": right}


def judged(counted: DataFrame, rule_set: dict[str, Column] | None = None) -> DataFrame:
    """``counted`` (with the columns of _stats.COUNTS, a written table) and the posterior probability of good quality."""
    rule_set = rule_set or rules()
    code = F.lit(0)
    for vote in rule_set.values():
        code = code * 3 + (F.coalesce(vote, F.lit(-1)) + 1)
    name = unused(counted, "pattern")
    voted = counted.select(*others(counted, "posterior"), code.alias(name))
    sums = voted.groupBy(F.col(name).alias("code")).agg(F.count("*").alias("n")).orderBy("code").toPandas()
    codes = sums["code"].to_numpy(np.int64)
    votes = np.stack([codes // 3 ** (len(rule_set) - 1 - r) % 3 - 1 for r in range(len(rule_set))], axis=1)
    got = estimate(votes, sums["n"].to_numpy())
    spark = counted.sparkSession
    near = spark.createDataFrame([(int(c), float(p)) for c, p in zip(codes, got["posterior"], strict=True)], f"`{name}` int, posterior double")
    return voted.join(F.broadcast(near), name, "left").drop(name)  # at most 3**len(rule_set) rows


def op10_weak_rules(spark, sf_dir: str) -> DataFrame:
    counted = written(_stats.with_counts(table(spark, sf_dir, "documents").select("doc_id", "text")), "rule-counts")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged(counted).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("posterior") >= POSTERIOR)).alias("kept"), "posterior"
    )
