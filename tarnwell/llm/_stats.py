"""Text statistics of whole documents, one vectorised pass, and the votes that quality rules base on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text as tx
from ._common import by_value, lean, others

WINDOW = 5
by_value(__name__)
by_value(tx.__name__)

#: Statistics in their order; all are long.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_ended_lines", "n_function_words", "n_long_words", "n_signed_words")

# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
# Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so"
    " der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über"
    " le la les de des du et en un une est que qui dans pour pas au sur ne se par plus ce avec il sont aux ou mais son"
    " el los las que y en un una del se no por con para es lo su al como más o pero sus le ya este"
).split()

_IS = {}


def _classes() -> dict[str, np.ndarray]:
    if not _IS:
        for name, chars in (("symbol", SYMBOLS), ("end", ".!?:;\"')"), ("digit", "0123456789")):
            _IS[name] = np.isin(np.arange(256), np.frombuffer(chars.encode(), np.uint8))
        _IS["upper"] = np.isin(np.arange(256), np.arange(65, 91))
        _IS["letter"] = _IS["upper"] | np.isin(np.arange(256), np.arange(97, 123)) | (np.arange(256) >= 0xC2)
        _IS["lead"] = (np.arange(256) & 0xC0) != 0x80
        words = np.frombuffer(" ".join(dict.fromkeys(FUNCTION_WORDS)).encode(), np.uint8)
        s, e, _ = tx.words(words, np.array([0, len(words)]))
        _IS["function"] = np.sort(tx.span_hash(words, s, e))
    return _IS


def _sum_by(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[ends] - total[starts]


def _repeated(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: is it found twice or more within its document, and is it there a later copy."""
    order = np.lexsort((np.arange(len(keys)), keys, doc))
    k, d = keys[order], doc[order]
    same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    later, more = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    more[order[1:]] = same
    more[order[:-1]] |= same
    return more, later


def text_counts(part: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each document of a block."""
    n, cls = len(off) - 1, _classes()
    starts, ends, counts = tx.words(part, off)
    doc = np.repeat(np.arange(n), counts)
    by_doc = lambda flags: _sum_by(flags, off[:-1], off[1:])
    lead = cls["lead"][part]
    out = {"n_words": counts, "word_chars": by_doc(lead & ~tx.SPACE[part]), "n_symbols": by_doc(cls["symbol"][part])}
    # Lines: \n-split; those without a word don't count.
    cut = part == 10
    line_start = np.unique(np.concatenate([off[:-1], np.flatnonzero(cut) + 1]))
    line_start = line_start[line_start < len(part)]
    word_line = np.searchsorted(line_start, starts, side="right") - 1
    lines = np.unique(word_line)
    line_at = line_start[lines]
    nxt = np.append(line_start[1:], len(part))[lines]
    line_doc = np.searchsorted(off, line_at, side="right") - 1
    line_end = np.minimum(nxt, off[line_doc + 1])
    line_end = line_end - (cut[line_end - 1] & (line_end > line_at))
    line_key = tx.span_hash(part, line_at, line_end)
    _, again = _repeated(line_key, line_doc)
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=n)
    # Windows of words found twice or more cover their words.
    hashes = tx.span_hash(part, starts, ends)
    keys, number = tx.shingles(hashes, counts, WINDOW)
    whole = np.repeat(counts >= WINDOW, number)
    key_doc = np.repeat(np.arange(n), number)
    first = np.repeat(np.cumsum(counts) - counts - (np.cumsum(number) - number), number) + np.arange(len(keys))
    more, _ = _repeated(keys[whole], key_doc[whole])
    hit = first[whole][more]
    cover = np.zeros(len(starts) + WINDOW + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    covered = np.cumsum(cover)[: len(starts)] > 0
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_upper"], out["n_letters"], out["n_digits"] = by_doc(cls["upper"][part]), by_doc(cls["letter"][part] & lead), by_doc(cls["digit"][part])
    last_word = np.searchsorted(word_line, lines, side="right") - 1
    closed = cls["end"][part[ends[last_word] - 1]] if len(lines) else np.zeros(0, bool)
    out["n_ended_lines"] = np.bincount(line_doc[closed], minlength=n)
    low = tx.LOWER[part]
    bare = ends - (cls["end"][part[ends - 1]] | (part[ends - 1] == 44)) if len(ends) else ends
    known = tx.span_hash(low, starts, np.maximum(bare, starts))
    spot = np.minimum(np.searchsorted(cls["function"], known), len(cls["function"]) - 1)
    out["n_function_words"] = np.bincount(doc[cls["function"][spot] == known], minlength=n)
    chars = _sum_by(lead, starts, ends)
    out["n_long_words"] = np.bincount(doc[chars > 30], minlength=n)
    out["n_signed_words"] = np.bincount(doc[_sum_by(cls["symbol"][part], starts, ends) > 0], minlength=n)
    return out


def _runner(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = tx.text_buffer(batch.column(batch.num_columns - 1))
            for i, j in tx.blocks(at):
                got = text_counts(data[at[i] : at[j]], at[i : j + 1] - at[i])
                cols = [batch.column(k).slice(i, j - i) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], [*names, *COUNTS])

    return lean(run)


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Other columns of ``docs`` and the COUNTS of each whole text; null counts as empty."""
    keep = others(docs, text, *COUNTS)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + [f"{c} long" for c in COUNTS]
    return docs.select(*keep, text).mapInArrow(_runner(keep), ", ".join(fields))
