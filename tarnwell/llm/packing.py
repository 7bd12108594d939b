"""Best-fit packing of tokenised documents into fixed-length sequences.

Method: bounded-space online best-fit. ``open_bins`` bins are open at a time; a bitset has a bit for
each amount of free space that some open bin has, so the tightest bin that takes an item is found by a
shift and a lowest-bit test. When an item fits no open bin and all are open, the fullest closes.

Items are dealt round robin over tasks of a bounded number of rows. Bins still open when a task ends
are items of the next level, until one task holds them all, so that the number of part-filled
sequences does not grow with the number of tasks. Only pieces (no texts) are shuffled.

Tokenisation: texts are cut, by byte tables, into parts that this tokenizer never joins: at ASCII spaces, and where
marks follow a letter or digit. The distinct parts of a block of texts are told apart and dealt back by Arrow; only those
not met before (in a bounded memory) are encoded, and those of letters or marks alone without normaliser and pattern.
Null text is empty text (the closing id alone). A document longer than a sequence is cut into full pieces and a rest; no other is cut. Repeated
rows are packed once each. Ties: of bins with equal space the latest takes a piece. Extra columns pass by unread; those named
like the results are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._common import by_value, lean, others, spread, table, written

CAPACITY, CLOSING_ID, OPEN_BINS, ITEMS_PER_TASK = 4096, 1, 256, 40_000
BLOCK_BYTES, PARTS_HELD, LINE, LINES = 1 << 24, 1 << 20, 64, 256
VOCABULARY = "word_bpe_49k.json"
for _m in (__name__, tx.__name__):
    by_value(_m)
_PACKED = ("bin", "offset", "left_open", "own", "up", "base")


def _tokenizer(path: str):
    """The tokenizer of a vocabulary file or, without a folder, of a public one."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if "/" not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    return Tokenizer.from_file(path)


_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[tx.SPACE] = 32
_FOLDED = tx.LOWER[_SPACED]
_LETTER = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))
#: Marks that begin a part after a letter: not those of contractions and special tokens.
_MARK = np.isin(np.arange(256), np.frombuffer(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~", np.uint8))
#: One unit of the tokenizer each, which its normaliser leaves as it is.
_PLAIN = r"^(?:[a-z\x{DF}-\x{F6}\x{F8}-\x{FF}]+|[!-/:-@\[-`{-~]+)$"


def _folded(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The texts with one kind of space and, where the tokenizer can't tell, without case.

    It composes accents before it lowers case, and some compose with small letters only; special tokens are told by case.
    """
    out = _FOLDED[data]
    accented = np.flatnonzero(data[1:] >= 128)
    out[accented] = _SPACED[data[accented]]
    special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    for k in np.unique(np.searchsorted(at, special, side="right") - 1):
        out[at[k] : at[k + 1]] = _SPACED[data[at[k] : at[k + 1]]]
    return out


def _parts(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Parts of the folded texts, each with the spaces before it, and the number of parts before each text and in all."""
    n = len(data)
    space, letter, start = data == 32, _LETTER[data], np.zeros(n, bool)
    second = np.flatnonzero(data[:-1] == 0xC3) + 1  # of the Latin letters from U+00C0 on, without the signs of times and division
    letter[second[(data[second] != 0x97) & (data[second] != 0xB7)]] = True
    start[1:] = ~space[:-1] & space[1:] | letter[:-1] & _MARK[data[1:]]
    start[at[at < n]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts, n)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]), np.searchsorted(starts, at)


class Coder:
    """Ids of whole texts by the tokenizer of a vocabulary; of plain parts by its merges alone."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = _tokenizer(vocabulary)
        self.merges = Tokenizer(self.whole.model)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        known = self.whole.get_vocab()
        self.closes = np.zeros(1 + max(known.values()), bool)  # ids that end a unit
        self.closes[[i for w, i in known.items() if w.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.held, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def _plain(self, parts: list[str]) -> pa.Array | None:
        """Ids of plain parts; None if they can't be told apart by the ids that end a unit."""
        lines = [" ".join(parts[i : i + LINE]) for i in range(0, len(parts), LINE)]
        ids = [np.zeros(0, "<u4")]
        for i in range(0, len(lines), LINES):
            ids += [np.array(e.ids, "<u4") for e in self.merges.encode_batch_fast(lines[i : i + LINES], add_special_tokens=False)]
        ids = np.concatenate(ids)
        cut = np.flatnonzero(self.closes[ids]) + 1
        if len(cut) != len(parts) or len(ids) != (cut[-1] if len(cut) else 0):
            return None
        return pa.Array.from_buffers(pa.large_binary(), len(parts), [None, pa.py_buffer(4 * np.append(0, cut)), pa.py_buffer(ids)])

    def _any(self, parts: list[str]) -> pa.Array:
        """Ids of any parts. They go in lines, which costs half of one by one; a token belongs to the part where it starts."""
        lines = [parts[i : i + LINE] for i in range(0, len(parts), LINE)]
        out: list[bytes] = []
        for i in range(0, len(lines), LINES):
            some = lines[i : i + LINES]
            for line, e in zip(some, self.whole.encode_batch([" ".join(x) for x in some], add_special_tokens=False), strict=True):
                starts = np.cumsum([0, *[len(w) + 1 for w in line]])
                ids = np.array(e.ids, "<u4").tobytes()
                at = np.array([o[0] for o in e.offsets], np.int64)
                cut = (4 * np.searchsorted(at, starts)).tolist()
                out += [ids[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
        return pa.array(out, pa.large_binary())

    def _learn(self, fresh: pa.Array) -> None:
        plain = pc.match_substring_regex(fresh, _PLAIN)
        parts = [fresh.filter(plain), fresh.filter(pc.invert(plain))]
        ids = self._plain(parts[0].to_pylist())
        ids = self._any(parts[0].to_pylist()) if ids is None else ids
        self.held, self.ids = pa.concat_arrays([self.held, *parts]), pa.concat_arrays([self.ids, ids, self._any(parts[1].to_pylist())])

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Little-endian unsigned 32-bit ids of texts, one after the other, and where each begins and the last ends; at: their bytes, from 0."""
        parts, first = _parts(_folded(data, at), at)
        parts = parts.dictionary_encode()
        distinct = pc.ascii_ltrim(parts.dictionary.cast(pa.large_string()), " ")
        if len(self.held) > PARTS_HELD:
            self.forget()
        self._learn(distinct.filter(pc.is_null(pc.index_in(distinct, self.held))).unique())
        ids = self.ids.take(pc.index_in(distinct, self.held).take(parts.indices))
        _, ends, own = ids.buffers()
        ends = np.frombuffer(ends, np.int64)[ids.offset : ids.offset + len(ids) + 1]
        return np.frombuffer(own, "<u4", ends[-1] // 4) if ends[-1] else np.zeros(0, "<u4"), ends[first] // 4


def _cutter(vocabulary: str, capacity: int, closing: int, names: list[str], with_ids: bool):
    tail = np.array([closing], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(vocabulary)  # of this task, so that the worker doesn't keep it
        for batch in batches:
            data, at = tx.text_buffer(batch.column(batch.num_columns - 1))
            for i, j in tx.blocks(at, BLOCK_BYTES):
                of, piece, start, length, crc, ids = [], [], [], [], [], []
                all_ids, ends = coder.encode(data[at[i] : at[j]], at[i : j + 1] - at[i])
                ends = ends.tolist()
                for d in range(j - i):
                    a, z = ends[d], ends[d + 1]
                    for p, b in enumerate(range(a, z + 1, capacity)):  # the closing id stands at z
                        own, end = all_ids[b : min(b + capacity, z)], tail if z < b + capacity else b""
                        of.append(i + d)
                        piece.append(p)
                        start.append(b - a)
                        length.append(len(own) + len(end) // 4)
                        crc.append(zlib.crc32(end, zlib.crc32(own)))
                        if with_ids:
                            ids.append(own.tobytes() + end)
                cols = [batch.column(k).take(pa.array(of, pa.int64())) for k in range(batch.num_columns - 1)]
                cols += [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                more = ["piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols, more = [*cols, pa.array(ids, pa.binary())], [*more, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names + more)

    return lean(run)


def pieces(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY, closing: int = CLOSING_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: the other columns of ``docs``, piece, start, length, ids_crc32 and, if asked for, ids."""
    keep = others(docs, text, "piece", "start", "length", "ids_crc32", "ids", "sequence_id", *_PACKED)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + ["piece int, start long, length long, ids_crc32 long"]
    fields += ["ids binary"] * with_ids
    return docs.select(*keep, text).mapInArrow(_cutter(vocabulary, capacity, closing, keep, with_ids), ", ".join(fields))


class Bins:
    """Open bins by free space. put() gives the bin and the place there; closed bins are in ``closed``."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.bits, self.at, self.open, self.next, self.closed = 0, {}, 0, 0, []

    def put(self, size: int) -> tuple[int, int]:
        fit = self.bits >> size
        if fit:
            free = size + (fit & -fit).bit_length() - 1
            name = self._take(free)
        else:
            if self.open == self.limit:
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
                self.open -= 1
            free, name = self.capacity, self.next
            self.next += 1
            self.open += 1
        left = free - size
        if left:
            self.at.setdefault(left, []).append(name)
            self.bits |= 1 << left
        else:
            self.closed.append(name)
            self.open -= 1
        return name, self.capacity - free

    def _take(self, free: int) -> int:
        names = self.at[free]
        name = names.pop()
        if not names:
            self.bits ^= 1 << free
            del self.at[free]
        return name


def _packer(capacity: int, open_bins: int, size: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        bins = Bins(capacity, open_bins)
        waiting: dict[int, list] = {}  # of each open bin: (batch, row, offset)
        kept: dict[int, pa.RecordBatch] = {}
        serial = 0

        def out(done: list[int], left: bool) -> Iterator[pa.RecordBatch]:
            rows: dict[int, list] = {}
            for name in done:
                for b, r, off in waiting.pop(name):
                    rows.setdefault(b, []).append((r, name, off))
            for b, own in rows.items():
                take = kept[b].take(pa.array([x[0] for x in own], pa.int64()))
                more = [pa.array([base + x[1] for x in own], pa.int64()), pa.array([x[2] for x in own], pa.int64()), pa.array([left] * len(own))]
                yield pa.RecordBatch.from_arrays([*take.columns, *more], [*names, "bin", "offset", "left_open"])

        for batch in batches:
            kept[serial] = batch
            for r, n in enumerate(batch.column(names.index(size)).to_pylist()):
                name, off = bins.put(n)
                waiting.setdefault(name, []).append((serial, r, off))
            serial += 1
            yield from out(bins.closed, False)
            bins.closed = []
            used = {b for rows in waiting.values() for b, _, _ in rows}
            kept = {b: x for b, x in kept.items() if b in used}
        yield from out(list(waiting), True)

    return lean(run)


def pack(items: DataFrame, size: str = "length", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """``items``, a written table, with sequence_id and offset; sizes are 1 to ``capacity``."""
    level, joined, depth = items.select(*others(items, "sequence_id", *_PACKED)), None, 0
    while True:
        count = level.count()
        tasks = max(1, -(-count // per_task))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in level.schema) + ", bin long, offset long, left_open boolean"
        got = written(spread(level, count, per_task).mapInArrow(_packer(capacity, open_bins, size, level.columns), fields), f"pack-{depth}")
        name = F.col("bin") * 64 + depth
        if joined is None:
            joined = got.withColumn("bin", name)
        else:
            up = got.select(F.col("own").alias("bin"), name.alias("up"), F.col("offset").alias("base"))
            joined = (
                joined.join(up, "bin", "left")
                .withColumn("bin", F.coalesce("up", "bin"))
                .withColumn("offset", F.col("offset") + F.coalesce("base", F.lit(0)))
                .drop("up", "base")
            )
        if tasks == 1:
            return joined.withColumnRenamed("bin", "sequence_id").drop("left_open")
        level = got.where("left_open").groupBy(name.alias("own")).agg(F.sum(size).alias(size))
        level = written(level, f"pack-left-{depth}")
        depth += 1


def op3_bestfit_packing(spark, sf_dir: str) -> DataFrame:
    cut = written(pieces(table(spark, sf_dir, "documents").select("doc_id", "text")), "pieces")
    return pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
