"""Toxicity from a weighted lexicon.

Texts are folded first: compatibility forms and accents are reduced, case is dropped, look-alike letters
of other scripts and digits or signs standing for letters become the letters. One Aho-Corasick pass over
the folded text finds all lexicon entries, which are whole words (" word ") or beginnings of words
(" begin"). A word counts once, with its heaviest entry. Exception phrases (entries of negative sign) are
longer patterns in the same automaton: an entry inside one doesn't count. The sum is normalised by the length
of the text and mapped to a probability by a logistic curve.

Learning (``learn``): rates of words and word beginnings in toxic and other training rows give each entry
log(rate in toxic / rate in others). An entry needs ``WEIGHT`` of it and a rate of rows that is higher among toxic ones by
``SURE`` standard errors; its weight is what is left when so many errors are taken off, so that a rare entry counts
little. All that pass are taken, words of any length. Word pairs that hold an entry but occur in clean rows only, in
``PAIR_ROWS`` of them at least, become exception phrases besides the fixed ones. Rows to learn from are a bounded
sample: the ``train_rows`` smallest hashes of labelled ids. Scoring reads every whole text.

Null and empty text: score of no match. Very long texts are read whole; the length normalisation alone sets them apart.
Null ids and labels: not learnt from; of several labels of an id the greatest counts. Repeated rows are scored each.
Ties: of entries that begin at one place the heaviest counts. Extra columns pass by unread; one named like the
score is replaced. With nothing to learn from, all scores are the prior. An empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._common import by_value, discard, id_fold, lean, others, table, written

TRAIN_ROWS, CUT, PAIR_ROWS, WEIGHT, SURE = 20_000, 0.3, 4, 1.2, 2.0
HELD = 100_000  # words that a task remembers
PREFIXES = (4, 5, 6, 7)
for _m in (__name__, tx.__name__):
    by_value(_m)

# Look-alikes of Latin letters (Cyrillic, Greek, others) and signs used for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ո": "n", "ս": "u",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ℓ": "l",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
# Phrases in which a word of abuse is not abuse.
EXCEPTIONS = ("pathetic fallacy", "white trash can", "trash can", "class clown fish", "clown fish", "loser bracket")


class Fold(dict):
    """str.translate table that works out each character once. Letters and signs fold, the rest is a space."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
        out = "".join(LOOKALIKES.get(x, x) for x in base)
        out = "".join(x if x.isalnum() else SIGNS.get(x, " ") for x in out)
        self[code] = out
        return out


_FOLD = Fold()
_DIGITS = str.maketrans({k: v for k, v in SIGNS.items() if k.isdigit()})


def _word(raw: str) -> tuple[str, ...]:
    w = raw.rstrip("!|$@").translate(_FOLD)
    if w.isalpha():
        return (w,)
    return tuple(p if p.isdigit() else p.translate(_DIGITS) for p in w.split())


def fold(text: str, held: dict[str, tuple[str, ...]] | None = None) -> list[str]:
    """Folded words. Signs at the end of a word are punctuation; a word of digits alone stays as it is. held: words folded before."""
    held = {} if held is None else held
    if len(held) > HELD:
        held.clear()
    out: list[str] = []
    for raw in text.split():
        got = held.get(raw)
        if got is None:
            got = _word(raw)
            if len(raw) < 60:
                held[raw] = got
        out += got
    return out


def _entries(word: str) -> Iterator[str]:
    yield f" {word} "
    for n in PREFIXES:
        if len(word) > n:
            yield f" {word[:n]}"


def _sums(counts: dict[tuple[int, str], list[int]], name: str) -> Iterator[pa.RecordBatch]:
    """Batches of label, key and two counts; counts is empty after."""
    keys = list(counts)
    for i in range(0, len(keys), 50_000):
        part = keys[i : i + 50_000]
        cols = [pa.array([k[0] for k in part], pa.int32()), pa.array([k[1] for k in part], pa.string())]
        cols += [pa.array([counts[k][x] for k in part], pa.int64()) for x in (0, 1)]
        yield pa.RecordBatch.from_arrays(cols, ["label", name, "hits", "rows"])
    counts.clear()


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, entry, hits, rows) of this task's training rows, in parts; entry "" has the words and rows in all."""
    counts: dict[tuple[int, str], list[int]] = {}
    held: dict[str, tuple[str, ...]] = {}
    for batch in batches:
        for label, text in zip(batch.column(0), batch.column(1), strict=True):
            label, words = label.as_py(), fold(text.as_py() or "", held)
            own: dict[str, int] = Counter({"": len(words)})
            for w, n in Counter(words).items():
                for e in _entries(w):
                    own[e] += n
            for e, n in own.items():
                c = counts.setdefault((label, e), [0, 0])
                c[0] += n
                c[1] += 1
            if len(counts) > 2 * HELD:
                yield from _sums(counts, "entry")
    yield from _sums(counts, "entry")


class Lexicon:
    """Entries with weights, exception phrases, and the curve from weighted hits to a probability."""

    def __init__(self, entries: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS, half: float = 40.0, curve: tuple[float, float] = (-3.0, 2.0)):
        self.entries, self.half, self.curve = entries, half, curve
        self.exceptions = tuple(" " + " ".join(fold(x)) + " " for x in exceptions)
        self._auto, self._held = None, {}

    def __getstate__(self):
        return {**self.__dict__, "_auto": None, "_held": {}}

    def matcher(self):
        if self._auto is None:
            import ahocorasick

            self._auto = ahocorasick.Automaton()
            for e, w in self.entries.items():
                self._auto.add_word(e, (len(e), w))
            for e in self.exceptions:
                self._auto.add_word(e, (len(e), None))
            if len(self._auto):
                self._auto.make_automaton()
        return self._auto

    def sums(self, text: str) -> tuple[float, int]:
        """Weight of the matched words and the number of words."""
        words = fold(text, self._held)
        auto = self.matcher()
        if not words or not len(auto):
            return 0.0, len(words)
        heaviest: dict[int, float] = {}
        spans = []
        for end, (size, weight) in auto.iter(" " + " ".join(words) + " "):
            at = end - size + 1
            if weight is None:
                spans.append((at, end))
            elif heaviest.get(at, 0.0) < weight:
                heaviest[at] = weight
        total = 0.0
        for at, w in heaviest.items():
            if not any(a <= at < b for a, b in spans):
                total += w
        return total, len(words)

    def level(self, total: float, words: int) -> float:
        """Weighted hits against the hits that a clean text of this length has by chance."""
        return float(np.log1p(total / (1.0 + words / self.half)))

    def score(self, text: str | None) -> float:
        a, b = self.curve
        return float(1.0 / (1.0 + np.exp(-(a + b * self.level(*self.sums(text or ""))))))


def _leveller(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            level = [lexicon.level(*lexicon.sums(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(level, pa.float64())], ["label", "level"])

    return lean(run)


def _pairer(entries: dict[str, float]):
    """(label, pair, hits, rows): rows of this task that hold two neighbouring words of which one matches an entry, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, str], list[int]] = {}
        held: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            for label, text in zip(batch.column(0), batch.column(1), strict=True):
                label, words = label.as_py(), fold(text.as_py() or "", held)
                hit = {w for w in set(words) if any(e in entries for e in _entries(w))}
                for pair, n in Counter(f"{a} {b}" for a, b in zip(words, words[1:]) if a in hit or b in hit).items():
                    c = counts.setdefault((label, pair), [0, 0])
                    c[0] += n
                    c[1] += 1
                if len(counts) > 2 * HELD:
                    yield from _sums(counts, "pair")
        yield from _sums(counts, "pair")

    return lean(run)


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Weighted logistic curve of one variable by Newton's method."""
    a, b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(n * (p - y)).sum() + ridge * a, (n * (p - y) * x).sum() + ridge * b])
        w = n * p * (1 - p)
        h = np.array([[w.sum() + ridge, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + ridge]])
        step = np.linalg.solve(h, g)
        a, b = np.array([a, b]) - np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", train_rows: int = TRAIN_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Lexicon from the labelled rows among ``docs``; at most ``train_rows`` labels."""
    picked = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    picked = picked.orderBy(F.xxhash64(key), key).limit(train_rows)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked.withColumnRenamed(key, "id")), "id").select("label", "text")
    rows = written(rows, "toxic-rows")
    side = lambda c, v: F.sum(F.when(F.col("label") == v, F.col(c)).otherwise(0))
    four = [side("hits", 1).alias("h1"), side("hits", 0).alias("h0"), side("rows", 1).alias("r1"), side("rows", 0).alias("r0")]
    sums = written(rows.mapInArrow(lean(_counter), "label int, entry string, hits long, rows long").groupBy("entry").agg(*four), "toxic-counts")
    all_ = sums.where("entry = ''").first()
    if all_ is None or not all_["r1"]:
        return Lexicon({}, exceptions, curve=(-2.0, 0.0))
    weight = F.log((F.col("h1") + 0.1) / F.lit(max(all_["h1"], 1))) - F.log((F.col("h0") + 0.5) / F.lit(max(all_["h0"], 1)))
    spread = F.log((F.col("r1") + 0.5) / F.lit(all_["r1"] + 1)) - F.log((F.col("r0") + 0.5) / F.lit(all_["r0"] + 1))
    error = F.sqrt(1 / (F.col("r1") + 0.5) + 1 / (F.col("r0") + 0.5))
    good = sums.where("entry <> ''").where((weight > WEIGHT) & (spread > SURE * error)).select("entry", (weight - SURE * error).alias("weight")).where("weight > 0")
    found = {r["entry"]: r["weight"] for r in sorted(good.collect())}  # of the bounded sample only
    # A whole word adds nothing to a beginning of the same weight.
    entries = {e: w for e, w in found.items() if not any(w <= found.get(e[: n + 1], -1.0) + 0.05 for n in PREFIXES if n + 1 < len(e))}
    lexicon = Lexicon(entries, exceptions)
    pairs = rows.mapInArrow(_pairer(entries), "label int, pair string, hits long, rows long").groupBy("pair").agg(side("rows", 1).alias("r1"), side("rows", 0).alias("r0"))
    clean = pairs.where((F.col("r1") == 0) & (F.col("r0") >= PAIR_ROWS)).select("pair").orderBy("pair").collect()
    lexicon.exceptions += tuple(f" {x['pair']} " for x in clean)
    levels = rows.mapInArrow(_leveller(lexicon), "label int, level double").groupBy("label", F.round("level", 2).alias("level")).agg(F.count("*").alias("n")).toPandas()
    if levels["label"].nunique() == 2:
        lexicon.curve = logistic(levels["level"].to_numpy(float), levels["label"].to_numpy(float), levels["n"].to_numpy(float))
    discard(rows, sums)
    return lexicon


def _scorer(lexicon: Lexicon, names: list[str], taken: int):
    """names: the first columns of a batch, whose last is the text, and the score. taken: how many columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [lexicon.score(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:taken], pa.array(got, pa.float64())], names)

    return lean(run)


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "score", with_text: bool = False) -> DataFrame:
    """Other columns of ``docs``, the text if wanted, and the score of each whole text."""
    keep = [*others(docs, text, out), *[text] * with_text]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + [f"`{out}` double"]
    return docs.select(*others(docs, text, out), text).mapInArrow(_scorer(lexicon, [*keep, out], len(keep)), ", ".join(fields))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (id_fold("doc_id", 4) == 2).alias("held_out"), "text")
    lexicon = learn(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels").where(id_fold("doc_id", 4) != 2))
    return score(docs, lexicon).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
