"""LM scoring by prediction by partial matching over bytes.

A trie of byte contexts up to ``order`` bytes long is counted over all training documents. A byte is
coded at the longest known context; where the context has not seen it, an escape is coded (method D:
each distinct successor gives half a count to the escape) and the symbols of the failed context are excluded below.
Excluded counts are a property of a trie node, so they are computed once per node and the code length
of a byte depends on its ``order`` preceding bytes alone. That makes scoring a few table look-ups.

A text is coded with its end marker (byte 255, which UTF-8 never holds) after ``order`` start markers
(byte 254). Scores are log10 probabilities of the whole text. The base score is the add-one unigram
model over words and one end token.

Every counted path counts, however rare. The trie is never in one place: a path belongs to the shard that the
last ``LOCAL`` bytes of its context hash to, so a shard holds a context together with its longer and shorter
ones down to ``LOCAL`` bytes. Paths of shorter contexts, at most 256 ** LOCAL whatever the corpus size, are
broadcast. The number of shards grows with the training bytes. Texts are cut into blocks of about ``ASK``
bytes; each block asks the shards for its distinct paths, and the answers come back to the block.

Word counts stay distributed: only words whose share is ``common`` or more (at most 1 / common) are broadcast,
the rest is joined. Rare words are rare by definition, so that join has no hot key.

Null text scores as empty text (end token only). A very long text is a block alone. A null id trains. Repeated rows count each
time. Scores of equal texts are equal. An empty table gives an empty result. Other columns pass by unread, whatever their
names; those named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._common import by_value, discard, id_fold, lean, others, table, written

ORDER = 5
START, END = 254, 255
WORD, GRAM = 0, 1
BLOCK, ASK, SHARD = 1 << 20, 1 << 23, 1 << 24
LOCAL = 3
for _m in (__name__, tx.__name__):
    by_value(_m)


def _codes(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """order+1 byte path ending at each byte and at each end marker, and the document of each path."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(n), sizes)
    stream = np.full(len(data) + n * (order + 1), START, np.uint8)
    stream[np.arange(len(data)) + order + doc * (order + 1)] = data
    ends = np.cumsum(sizes + order + 1) - 1
    stream[ends] = END
    code = np.zeros(len(stream) - order, np.int64) if len(stream) else np.zeros(0, np.int64)
    for k in range(order + 1):
        code <<= 8
        code |= stream[k : k + len(code)]
    own = np.zeros(len(stream), bool)
    own[np.arange(len(data)) + order + doc * (order + 1)] = True
    own[ends] = True
    at = np.flatnonzero(own)
    return code[at - order], np.repeat(np.arange(n), sizes + 1)


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = tx.LOWER[data]
    starts, ends, counts = tx.words(low, offsets)
    return tx.span_hash(low, starts, ends).view(np.int64), counts


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(times, at) if len(at) else times


def _counter(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {WORD: [], GRAM: []}
        size = {WORD: 0, GRAM: 0}

        def flush(kind: int) -> Iterator[pa.RecordBatch]:
            if held[kind]:
                keys, times = _summed(np.concatenate([k for k, _ in held[kind]]), np.concatenate([t for _, t in held[kind]]))
                held[kind], size[kind] = [(keys, times)], len(keys)

        def emit(kind: int) -> Iterator[pa.RecordBatch]:
            for keys, times in held[kind]:
                for i in range(0, len(keys), 1 << 16):
                    k, t = keys[i : i + (1 << 16)], times[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(t)], ["kind", "key", "n"])
            held[kind], size[kind] = [], 0

        for batch in batches:
            data, at = tx.text_buffer(batch.column(0))
            for i, j in tx.blocks(at, BLOCK):
                part, off = data[at[i] : at[j]], at[i : j + 1] - at[i]
                grams, _ = _codes(part, off, order)
                hashes, _ = _word_hashes(part, off)
                for kind, keys in ((GRAM, np.sort(grams)), (WORD, np.sort(hashes))):
                    if len(keys):
                        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                        held[kind].append((keys[first], np.diff(np.append(first, len(keys)))))
                        size[kind] += len(first)
                        if size[kind] > 1_500_000:
                            flush(kind)
                            if size[kind] > 1_000_000:
                                yield from emit(kind)
        for kind in (WORD, GRAM):
            flush(kind)
            yield from emit(kind)

    return lean(run)


def _shard(codes, order: int, shards: int, shift=lambda x, n: x >> n, both=lambda x, y: x & y):
    """Shard of each path, for arrays and, given their operators, for columns."""
    tail = both(shift(codes, 8), (1 << (8 * min(LOCAL, order))) - 1)
    return shift(tail * 2654435761, 16) % shards


def _packed(codes: np.ndarray) -> bytes:
    """Ascending codes as compressed differences."""
    return pa.compress(np.diff(codes, prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, n * 8, "zstd"), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(raw.T).view(np.int64).ravel())


class Trie:
    """Counted byte contexts of a shard; see the module text for the arithmetic."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], order: int):
        """levels[j]: sorted paths of j context bytes and one symbol, and their counts."""
        self.order = order
        self.paths, self.counts = [p for p, _ in levels], [n for _, n in levels]
        self.nodes, self.total, self.kinds, self.out = [], [], [], []
        for j in range(order + 1):
            node = self.paths[j] >> 8
            at = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
            self.nodes.append(node[at])
            self.total.append(np.add.reduceat(self.counts[j], at) if len(at) else self.counts[j])
            self.kinds.append(np.diff(np.append(at, len(node))))
            if j and len(at):  # counts, one order lower, of the symbols this node has seen
                low = self.paths[j] & ((1 << (8 * j)) - 1)
                lower = np.searchsorted(self.paths[j - 1], low)
                lower = np.minimum(lower, max(len(self.paths[j - 1]) - 1, 0))
                self.out.append(np.add.reduceat(self.counts[j - 1][lower], at))
            else:
                self.out.append(np.zeros(len(at), np.int64))

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each path, by escapes from the longest context down."""
        logs = np.zeros(len(codes))
        left = np.arange(len(codes))
        gone_n, gone_k = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)  # excluded counts and symbols
        for j in range(self.order, -1, -1):
            if not len(left) or not len(self.nodes[j]):
                continue
            c = codes[left] & ((1 << (8 * (j + 1))) - 1)
            at = np.minimum(np.searchsorted(self.nodes[j], c >> 8), len(self.nodes[j]) - 1)
            known = self.nodes[j][at] == c >> 8
            path = np.minimum(np.searchsorted(self.paths[j], c), len(self.paths[j]) - 1)
            seen = known & (self.paths[j][path] == c)
            kinds = self.kinds[j][at] - gone_k[left]
            room = (self.total[j][at] - gone_n[left]).astype(float)
            hit, esc = np.flatnonzero(seen), np.flatnonzero(known & ~seen & (kinds > 0))
            logs[left[hit]] += np.log10((self.counts[j][path[hit]] - 0.5) / room[hit])
            logs[left[esc]] += np.log10(0.5 * kinds[esc] / room[esc])
            on = left[known & ~seen]
            gone_n[on], gone_k[on] = self.out[j][at[known & ~seen]], self.kinds[j][at[known & ~seen]]
            left = left[~seen]
        logs[left] -= np.log10(np.maximum(256 - gone_k[left], 1))
        return logs


def train(docs: DataFrame, text: str = "text", order: int = ORDER, common: float = 5e-7) -> dict:
    """Counts over every row of ``docs``; the short contexts and the frequent words are small, "counts" is a table (kind, key, n) of all paths and words."""
    counts = written(
        docs.select(text).mapInArrow(_counter(order), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "ppm-counts"
    )
    sums = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()}
    ends = docs.count()
    tokens = (sums[WORD]["n"] if WORD in sums else 0) + ends
    kinds = (sums[WORD]["kinds"] if WORD in sums else 0) + (ends > 0)
    near, low = min(LOCAL, order), []
    if near:
        key = F.col("key").bitwiseAND(F.lit((1 << (8 * near)) - 1))
        got = counts.where(F.col("kind") == GRAM).groupBy(key.alias("key")).agg(F.sum("n").alias("n")).toArrow()
        low = [_summed(got["key"].to_numpy() & ((1 << (8 * (j + 1))) - 1), got["n"].to_numpy()) for j in range(near)]
    shards = 1 + (sums[GRAM]["n"] if GRAM in sums else 0) // SHARD
    top = counts.where((F.col("kind") == WORD) & (F.col("n") >= F.lit(common * tokens))).select("key", "n").orderBy("key").toArrow()
    top = (top["key"].to_numpy(), top["n"].to_numpy())
    return {"order": order, "low": low, "shards": shards, "counts": counts, "tokens": tokens, "kinds": kinds, "ends": ends, "top": top}


def _asker(order: int, shards: int, names: list[str]):
    """Rows with their number and block, and after each block its distinct paths by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, block = TaskContext.get().partitionId() << 40, TaskContext.get().partitionId() << 32
        held: list[np.ndarray] = []
        size, types = 0, []

        def ask() -> pa.RecordBatch:
            codes = np.unique(np.concatenate(held))
            to = _shard(codes, order, shards)
            turn = np.argsort(to, kind="stable")
            codes, to = codes[turn], to[turn]
            at = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            parts = np.split(codes, at[1:])
            cols = [pa.nulls(len(at), t) for t in types]
            cols += [pa.nulls(len(at), pa.int64()), pa.array(np.full(len(at), block)), pa.array(to[at].astype(np.int32))]
            cols += [pa.array([len(p) for p in parts], pa.int32()), pa.array([_packed(p) for p in parts], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            types = [f.type for f in batch.schema]
            data, at = tx.text_buffer(batch.column(batch.num_columns - 1))
            for i, j in tx.blocks(at, BLOCK):
                n = j - i
                codes, _ = _codes(data[at[i] : at[j]], at[i : j + 1] - at[i], order)
                held.append(np.unique(codes))
                size += len(codes)
                cols = [batch.column(k).slice(i, n) for k in range(batch.num_columns)]
                cols += [pa.array(row + np.arange(n)), pa.array(np.full(n, block)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names)
                row += n
                if size >= ASK:
                    yield ask()
                    held, size, block = [], 0, block + 1
        if held:
            yield ask()

    return lean(run)


_ANSWER = pa.schema([("__block", pa.int64()), ("__m", pa.int32()), ("__codes", pa.binary()), ("__logs", pa.binary())])


def _answerer(model):
    """Answers of one shard, from its paths (key, n), to the blocks that ask."""

    def run(paths, asks):
        if not asks.num_rows:
            return _ANSWER.empty_table()
        m = model.value
        order, keys, n = m["order"], paths["key"].to_numpy(), paths["n"].to_numpy()
        levels = m["low"] + [_summed(keys & ((1 << (8 * (j + 1))) - 1), n) for j in range(len(m["low"]), order + 1)]
        parts = [_unpacked(c, k) for c, k in zip(asks["__codes"].to_pylist(), asks["__m"].to_pylist(), strict=True)]
        codes = np.unique(np.concatenate(parts))
        logs = Trie(levels, order).log10(codes).astype(np.float32)
        said = [pa.compress(logs[np.searchsorted(codes, p)].tobytes(), "zstd", asbytes=True) for p in parts]
        return pa.table([asks["__block"], asks["__m"], asks["__codes"], pa.array(said, pa.binary())], schema=_ANSWER)

    return run


_SCORED = "__row long, __n long, __known long, __base double, __score double, __rare array<long>"


def _scorer(model, meta: list[pa.Field]):
    def run(texts, answers):
        m = model.value
        (top, top_n), room = m["top"], m["tokens"] + m["kinds"] + 1
        end = np.log10((m["ends"] + 1) / room)
        sizes = answers["__m"].to_pylist()
        keys = np.concatenate([_unpacked(c, k) for c, k in zip(answers["__codes"].to_pylist(), sizes, strict=True)])
        logs = np.concatenate([np.frombuffer(pa.decompress(c, k * 4, "zstd"), np.float32) for c, k in zip(answers["__logs"].to_pylist(), sizes, strict=True)])
        turn = np.argsort(keys)
        keys, logs = keys[turn], logs[turn].astype(float)
        data, at = tx.text_buffer(texts.column(texts.num_columns - 1))
        done = []
        for i, j in tx.blocks(at, BLOCK):
            part, off, n = data[at[i] : at[j]], at[i : j + 1] - at[i], j - i
            codes, doc = _codes(part, off, m["order"])
            turn = np.argsort(codes)
            codes = codes[turn]
            first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            each = np.repeat(logs[np.searchsorted(keys, codes[first])], np.diff(np.append(first, len(codes))))
            score = np.bincount(doc[turn], each, minlength=n)
            hashes, counts = _word_hashes(part, off)
            own = np.repeat(np.arange(n), counts)
            spot = np.minimum(np.searchsorted(top, hashes), max(len(top) - 1, 0))
            found = top[spot] == hashes if len(top) else np.zeros(len(hashes), bool)
            words = np.log10((top_n[spot[found]] + 1) / room) if len(top) else np.zeros(0)
            base = np.bincount(own[found], words, minlength=n) + end
            known = np.bincount(own[found], minlength=n) + (m["ends"] > 0)
            rare, split = hashes[~found], np.concatenate([[0], np.cumsum(np.bincount(own[~found], minlength=n))])
            cols = [texts.column(k).slice(i, n) for k in range(len(meta) + 1)]
            cols += [pa.array(counts + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)]
            cols.append(pa.ListArray.from_arrays(pa.array(split.astype(np.int32)), pa.array(rare)))
            done.append(pa.table(cols, [f.name for f in meta] + ["__row", "__n", "__known", "__base", "__score", "__rare"]))
        return pa.concat_tables(done)

    return run


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with n_tokens, n_known, train_tokens, base_score and score in place of the text."""
    spark = docs.sparkSession
    keep = others(docs, text, "n_tokens", "n_known", "train_tokens", "base_score", "score")
    # Within, the columns of docs have names of their own.
    own = [f"c{i}" for i in range(len(keep))]
    spread = docs.select(*[F.col(c).alias(o) for c, o in zip(keep, own, strict=True)], F.col(text).alias("__text"))
    meta = spread.drop("__text").schema
    sent = spark.sparkContext.broadcast({k: v for k, v in model.items() if k != "counts"})
    order, shards = model["order"], model["shards"]
    typed = [f"`{f.name}` {f.dataType.simpleString()}" for f in spread.schema]
    asking = ", ".join([*typed, "__row long, __block long, __shard int, __m int, __codes binary"])
    names = [*spread.columns, "__row", "__block", "__shard", "__m", "__codes"]
    asked = written(spread.mapInArrow(_asker(order, shards, names), asking), "ppm-asked")
    asks = asked.where(F.col("__shard").isNotNull()).select("__shard", "__block", "__m", "__codes")
    to = _shard(F.col("key"), order, shards, F.shiftright, lambda x, y: x.bitwiseAND(F.lit(y)))
    paths = model["counts"].where(F.col("kind") == GRAM).select(to.cast("int").alias("__shard"), "key", "n")
    answers = paths.groupBy("__shard").cogroup(asks.groupBy("__shard")).applyInArrow(_answerer(sent), "__block long, __m int, __codes binary, __logs binary")
    texts = asked.where(F.col("__shard").isNull()).select(*own, "__row", "__block", "__text")
    fields = ", ".join([*typed[:-1], _SCORED])
    scored = written(texts.groupBy("__block").cogroup(answers.groupBy("__block")).applyInArrow(_scorer(sent, list(meta)), fields), "ppm-scored")
    discard(asked)
    room = float(model["tokens"] + model["kinds"] + 1)
    words = scored.select("__row", F.explode("__rare").alias("key")).groupBy("__row", "key").agg(F.count("*").alias("times"))
    seen = model["counts"].where(F.col("kind") == WORD).select("key", "n")
    n = F.coalesce(F.col("n"), F.lit(0))
    sums = words.join(seen, "key", "left").groupBy("__row").agg(
        F.sum(F.col("times") * F.log10((n + 1) / F.lit(room))).alias("__more"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("__more_known")
    )
    return scored.drop("__rare").join(sums, "__row", "left").select(
        *[F.col(o).alias(c) for o, c in zip(own, keep, strict=True)],
        F.col("__n").alias("n_tokens"),
        (F.col("__known") + F.coalesce("__more_known", F.lit(0))).alias("n_known"),
        F.lit(model["tokens"]).cast("long").alias("train_tokens"),
        (F.col("__base") + F.coalesce("__more", F.lit(0.0))).alias("base_score"),
        F.col("__score").alias("score"),
    )


def op9_ppm_lm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (id_fold("doc_id", 7) == 2).alias("held_out"))
    model = train(docs.where(~F.col("held_out")))
    return score(docs.select("doc_id", "held_out", "text"), model)
