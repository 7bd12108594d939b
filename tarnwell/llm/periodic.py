"""Periodic runs of words, found with Stoye and Gusfield's suffix tree method, and texts without them.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least
max(6, 4 q), which no neighbouring word extends keeping period q. A word is dropped if any run contains it after that run's
first q words.

The tree is that of all texts of a block together: each stretch of words that can hold a run has symbols of its own, so
stretches are subtrees of their own below the root. Nodes are the intervals of the suffix array with a common prefix, made
binary at nodes of several children. At a node of depth D only the smaller half of its leaves is listed: for a leaf i of it, i + D
or i - D in the other half is a branching tandem repeat, a square of 2 D words that the next word does not go on. Repeats are
rotated to the left as far as they go, which makes them whole runs; those that are a multiple of a shorter period end and begin
at the same words as its run, and are merged into it.

Stretches: of a run, every five words in a row stand at least twice in it, a period apart. So only words are looked at whose
five words in a row are met again within a quarter of the stretch; repeating this shortens most texts to nothing.
No text is cut and no run is missed by that.

Each text is worked on where it was read, nothing is shuffled. Null text: no words, no runs. Null id: like an empty id where one is
asked for (``planted``). Empty text: no runs, and nothing collapsed. Very long texts are blocks of their own, with memory of about
20 arrays of their length. Repeated rows each give their row. Ties of the greatest length go by the smallest start, then period. An empty
table gives an empty result. Other columns pass through ``runs_of`` and are replaced where they are named like a result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import by_value, lean, table, unused
from ._text import BASE, mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPAN, LEAST, TIMES = 5, 6, 4  # words in a row; a run has at least LEAST words and TIMES periods
BLOCK_WORDS = 1 << 17
FIELDS = {c: pa.int64() for c in ("n_runs", "start", "length", "period", "exponent_milli")} | {c: pa.string() for c in ("runs_sha256", "collapsed_sha256")}
by_value(__name__)


def numbers(words: list[str]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    known: dict[str, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def stretches(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the stretches that can hold a run. ids: words of all texts in a row; sizes: words of each text."""
    n = len(ids)
    text = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(text[: n - SPAN + 1] == text[SPAN - 1 :]) if n >= SPAN else np.zeros(0, np.int64)
    key = np.zeros(len(at), np.uint64)
    for k in range(SPAN):
        key = key * BASE + mix(ids[at + k].astype(np.uint64) + np.uint64(k + 1))
    group = text[at]
    while len(at):
        # Stretches: places in a row of one group. The last place still covers SPAN words.
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (group[1:] != group[:-1])
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        room = (at[last] - at[first] + SPAN)[group]
        order = np.lexsort((at, key, group))
        g, k, a = group[order], key[order], at[order]
        same = (g[1:] == g[:-1]) & (k[1:] == k[:-1])
        gap = np.where(same, a[1:] - a[:-1], n + 1)
        near = np.minimum(np.append(gap, n + 1), np.append(n + 1, gap))  # to the next or the previous equal words
        stay = np.zeros(len(at), bool)
        stay[order] = near * TIMES <= room[order]
        stay &= room >= LEAST
        if stay.all():
            return at[first], at[last] + SPAN
        at, key, group = at[stay], key[stay], group[stay]
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


def suffix_tree(s: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of all stretches and the common prefix of each suffix with the one before it.

    s: symbols, no two stretches share one; left: words from each place to the end of its stretch.
    """
    n, k = len(s), 1
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64) + 1
    levels = [rank.astype(np.int32)]
    while True:
        after = np.zeros(n, np.int64)
        there = left > k
        after[there] = rank[np.flatnonzero(there) + k]
        pair = rank * (n + 2) + after
        order = np.argsort(pair, kind="stable")
        new = np.ones(n, np.int64)
        new[1:] = pair[order][1:] != pair[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if new.all():
            break
        levels.append(rank.astype(np.int32))
        k *= 2
    common = np.zeros(n, np.int64)
    if n > 1:
        a, b, c = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
        room = np.minimum(left[a], left[b])
        for level in range(len(levels) - 1, -1, -1):  # of each power of two, whether so many symbols more are equal
            step = 1 << level
            ok = c + step <= room
            ok[ok] = levels[level][a[ok] + c[ok]] == levels[level][b[ok] + c[ok]]
            c[ok] += step
        common[1:] = c
    return order, common


def binary_nodes(common: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interval [low, high) of leaves below the node that joins each place with the one before it, where ``wanted``."""
    n = len(common)
    low, high, open_ = np.zeros(n, np.int64), np.full(n, n, np.int64), []
    depth = common.tolist()
    for i in range(1, n):
        d = depth[i]
        while open_ and depth[open_[-1]] > d:  # equal depths nest to the right
            high[open_.pop()] = i
        low[i] = open_[-1] if open_ else 0
        open_.append(i)
    return low[wanted], high[wanted]


def repeats(s: np.ndarray, left: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Branching tandem repeats: start and half length, of halves of at most a quarter of their stretch. size: of each place's stretch."""
    order, common = suffix_tree(s, left)
    rank = np.empty(len(s), np.int64)
    rank[order] = np.arange(len(s))
    wanted = np.flatnonzero((common > 0) & (common * TIMES <= size[order]))
    low, high = binary_nodes(common, wanted)
    small_left = wanted - low <= high - wanted
    first, last = np.where(small_left, low, wanted), np.where(small_left, wanted, high)
    other_first, other_last = np.where(small_left, wanted, low), np.where(small_left, high, wanted)
    starts, halves = [], []
    count = last - first
    bounds = np.searchsorted(np.cumsum(count), np.arange(0, count.sum() + BLOCK_WORDS, BLOCK_WORDS)[1:], side="left") + 1
    done = 0
    for to in bounds.tolist():  # leaf lists, some nodes at a time
        node = np.arange(done, min(to, len(count)))
        done = min(to, len(count))
        node = np.repeat(node, count[node])
        if not len(node):
            continue
        nth = np.arange(len(node)) - np.searchsorted(node, node)
        leaf, depth = order[first[node] + nth], common[wanted[node]]
        for sign in (1, -1):
            to_place = leaf + sign * depth
            ok = (left[leaf] > depth) if sign == 1 else (size[leaf] - left[leaf] >= depth)
            r = rank[np.where(ok, to_place, 0)]
            ok &= (r >= other_first[node]) & (r < other_last[node])
            starts.append(np.minimum(leaf, to_place)[ok])
            halves.append(depth[ok])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.stack([np.concatenate(halves), np.concatenate(starts)], axis=1), axis=0)
    return both[:, 1], both[:, 0]


def rotated(s: np.ndarray, start: int, half: int, least: int) -> int:
    """Where the run begins that a repeat at ``start`` belongs to: rotation to the left, doubling steps, not before ``least``."""
    step = 16
    while start > least:
        to = max(least, start - step)
        differ = np.flatnonzero(s[to:start] != s[to + half : start + half])
        if len(differ):
            return to + int(differ[-1]) + 1
        start, step = to, step * 2
    return start


def find_runs(ids: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of all texts, in places of ``ids``."""
    begin, end = stretches(ids, sizes)
    if not len(begin):
        return []
    size = end - begin
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    places = np.repeat(begin, size) + within
    stretch = np.repeat(np.arange(len(begin)), size)
    s = np.unique(stretch * (int(ids.max()) + 1) + ids[places], return_inverse=True)[1]
    base, each = np.cumsum(size) - size, np.repeat(size, size)
    left = each - within
    starts, halves = repeats(s, left, each)
    # Room for a run: its first and some further words a period apart must be equal.
    need = np.maximum(LEAST, TIMES * halves)
    first = starts + 2 * halves - need
    ok = first >= base[stretch[starts]]
    for share in (0, 1, 2, 3):
        look = first + (need - 2 * halves) * share // 4
        look = np.where(ok, look, starts)
        ok &= s[look] == s[look + halves]
    found: list[tuple[int, int, int]] = []
    by_end: dict[int, list[tuple[int, int]]] = {}
    for i, q in zip(starts[ok].tolist(), halves[ok].tolist(), strict=True):  # shorter periods first
        e = i + 2 * q
        if any(q % p == 0 and b <= i for b, p in by_end.get(e, ())):
            continue
        b = rotated(s, i, q, int(base[stretch[i]]))
        if e - b >= max(LEAST, TIMES * q):
            by_end.setdefault(e, []).append((b, q))
            found.append((int(places[b]), int(places[e - 1]) + 1, q))
    return found


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """A tenth of the texts, by their ids, with a tail that repeats."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // p + 1))[: n - a]


def _described(words: list[str], runs: list[tuple[int, int, int]]) -> tuple:
    """The columns of FIELDS. runs: (start, end, period) in words of this text."""
    runs = sorted((b, e - b, q) for b, e, q in runs)
    lines = "".join(f"{b},{n},{q}\n" for b, n, q in runs)
    if runs:
        b, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]))
        best = (b, n, q, 1000 * n // q)
        keep = np.ones(len(words), bool)
        for b, n, q in runs:
            keep[b + q : b + n] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    else:
        best = (None,) * 4
    sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
    return len(runs), *best, sha(lines), sha(" ".join(words))


def described(texts: list[list[str]]) -> list[tuple]:
    """The columns of FIELDS of each text, all texts in one tree."""
    ids = [numbers(w) for w in texts]
    sizes = np.array([len(w) for w in texts], np.int64)
    ends = np.cumsum(sizes)
    own: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    # Numbers of different texts may be equal: stretches are told apart later.
    for b, e, q in find_runs(np.concatenate(ids) if ids else np.zeros(0, np.int64), sizes):
        t = int(np.searchsorted(ends, b, side="right"))
        at = int(ends[t] - sizes[t])
        own[t].append((b - at, e - at, q))
    return [_described(w, r) for w, r in zip(texts, own, strict=True)]


def _finder(key: str, text: str, plant: bool):
    def blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[list[str]]]]:
        """Texts of about BLOCK_WORDS words together, as lists of words, and the first one's row."""
        held, total, first = [], 0, 0
        for i in range(batch.num_rows):
            words = WORD.findall(batch.column(text)[i].as_py() or "")
            words = planted(words, batch.column(key)[i].as_py()) if plant else words
            if held and total + len(words) > BLOCK_WORDS:
                yield first, held
                held, total, first = [], 0, i
            held.append(words)
            total += len(words)
        if held:
            yield first, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in blocks(batch):
                kept = batch.slice(first, len(texts))
                names = [c for c in batch.schema.names if c != text]
                made = [pa.array(c, kind) for c, kind in zip(zip(*described(texts), strict=True), FIELDS.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[kept.column(c) for c in names], *made], [*names, *FIELDS])

    return lean(run)


def runs_of(docs: DataFrame, key: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """``docs`` without its text, and the columns of FIELDS. ``plant``: first repeat the tails of a tenth of the texts (``planted``)."""
    own = docs.select(*[c for c in docs.columns if c.lower() not in FIELDS or c in (key, text)])
    words = unused(own, "words_of")
    own = own.withColumnRenamed(text, words)
    shape = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.drop(words).schema]
    made = [f"{n} {'long' if kind == pa.int64() else 'string'}" for n, kind in FIELDS.items()]
    return own.mapInArrow(_finder(key, words, plant), ", ".join(shape + made))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return runs_of(table(spark, sf_dir, "documents").select("doc_id", "text"), plant=True)
