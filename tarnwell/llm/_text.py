"""Vectorised word and shingle hashing over Arrow text buffers.

Words are maximal runs of bytes other than space, tab, newline, vertical tab, form feed and
carriage return. Documents are worked on in blocks of about half a megabyte and some thousand rows, whole documents
each, so that the arrays stay small whatever the batch size; a longer document forms a block alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES, BLOCK_ROWS = 1 << 19, 4096
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Odd multipliers for polynomial hashing modulo 2**64 and the inverse of the first.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS: dict[str, np.ndarray] = {}


def times(constant: np.uint64, n: int) -> np.uint64:
    return np.uint64(int(constant) * n % (1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    held = n <= BLOCK_BYTES + 1  # those of a longer document go with it
    if not held or not _POWERS:
        got = {}
        for name, base in (("up", BASE), ("down", BASE_INV)):
            got[name] = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
            got[name][0] = 1
            np.cumprod(got[name], out=got[name])
        if not held:
            return got["up"], got["down"]
        _POWERS.update(got)
    return _POWERS["up"], _POWERS["down"]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, at


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of at most BLOCK_ROWS documents with at most ``limit`` bytes together, or one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), i + BLOCK_ROWS, n)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word and the number of words per document. offsets: of these documents, from 0."""
    n = len(data)
    solid = ~SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut[:n]))
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, equal for equal spans in any block."""
    up, down = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words within a document, and how many each document has.

    A document with fewer words, but at least one, has a single shingle of all its words.
    """
    total = len(hashes)
    ends = np.cumsum(counts)
    number = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    first = np.repeat(ends - counts - (np.cumsum(number) - number), number) + np.arange(number.sum())
    last = np.repeat(ends, number)
    out = np.zeros(len(first), np.uint64)
    for k in range(width):
        at = first + k
        there = at < last
        term = np.zeros(len(first), np.uint64)
        term[there] = mix(hashes[np.minimum(at, max(total - 1, 0))[there]] + times(BASE, k + 1))
        out = out * BASE + term
    return mix(out), number


def per_doc_unique(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values within each document (document, then value order), their multiplicities and the new counts."""
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(v)))
    return v[at], times, np.bincount(d[at], minlength=len(counts))
