"""Near-duplicate classes by DartMinHash.

Every distinct text is a weighted set of hashed five-word shingles, a shingle's weight being its multiplicity.
Darts are thrown into the region of each element (its weight by rank axis): within a unit of weight they are a
Poisson process along the rank axis, drawn from hashes of the element, so that equal elements of different texts
get the same darts. Only darts of rank up to about k ln k / weight can matter; a dart also hashes to one of ``k``
coordinates, and each coordinate keeps its earliest dart. The cost is one hash per unit of weight plus about
k ln k per text. Coordinates agree with probability equal to the weighted Jaccard similarity.

Two texts are linked if the weighted Jaccard similarity of their shingles, or that of their plain sets, is
``threshold`` or more. The two differ only for texts that repeat a shingle; such a text is signed twice, with
its multiplicities and with weights of 1.

Banding: ``bands`` bands of ``rows`` coordinates of either signature; two texts of similarity s meet in some band
with probability 1 - (1 - s**rows)**bands, 0.999997 at the threshold of 0.8. Candidates are confirmed exactly.

Classes are the connected components of all links between texts that meet. Pairs within one class need no
further test, which is what keeps large groups cheap and loses nothing: in each round every bucket that still holds
several classes compares all its members with one pivot text, links merge classes, and buckets that hold one class
stop. The last round compares what is left: in each bucket the members outside its largest class meet all
members of other classes. Pairs are dropped by bounds only that no link can break: sizes, shingles that only one
text has, and parity bits (a bit per hash value, flipped by each shingle; two texts differ in at least as many
shingles as bits). Exact copies are one text from the start. Components are found by label contraction with pointer
jumping over written tables; nothing of document number is collected, and tables are deleted after use.

Null text: a class of its own per row. Text without a word: equal texts are copies, nothing else. A text of
one to four words has a single shingle of all its words. Very long texts are whole shingle sets like others. Null ids
are allowed. Repeated rows are copies. Ties: the smallest id names a class. An empty table gives an empty result.
Other columns pass by unread, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._common import by_value, discard, lean, numbered, table, unused, written

WORDS, THRESHOLD, BANDS, ROWS, PIVOTS = 5, 0.8, 32, 5, 4
for _m in (__name__, tx.__name__):
    by_value(_m)


def shingle_sets(part: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document (document order), multiplicities, and how many each has."""
    low = tx.LOWER[part]
    starts, ends, counts = tx.words(low, off)
    hashes, number = tx.shingles(tx.span_hash(low, starts, ends), counts, width)
    return tx.per_doc_unique(hashes, number)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def dart_signatures(elements: np.ndarray, weights: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """(documents, k) earliest dart of every coordinate; documents without elements get zeros."""
    n = len(sizes)
    out = np.zeros((n, k), np.uint64)
    best = np.full(n * k, np.inf)
    doc = np.repeat(np.arange(n), sizes)
    total = np.bincount(doc, weights, minlength=n)
    # One region per started unit of weight; the last may be a fraction, which darts hit in proportion.
    units = np.ceil(weights).astype(np.int64)
    owner = np.repeat(np.arange(len(elements)), units)
    nth = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
    cell = tx.mix(elements[owner] + nth.astype(np.uint64) * tx.BASE)
    share = np.minimum(weights[owner] - nth, 1.0)
    cell_doc = doc[owner]
    reach = np.where(total > 0, (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300), 0.0)
    todo = total > 0
    flat = out.reshape(-1)
    while todo.any():
        sel = np.flatnonzero(todo[cell_doc])
        rank, serial = np.zeros(len(sel)), 0
        key = cell[sel]
        while len(sel):
            serial += 1
            dart = tx.mix(key + tx.times(tx.MIX1, serial))
            rank = rank - np.log(_uniform(dart))
            live = rank <= reach[cell_doc[sel]]
            sel, rank, key, dart = sel[live], rank[live], key[live], dart[live]
            side = tx.mix(dart ^ tx.BASE)
            inside = _uniform(tx.mix(side)) <= share[sel]
            at = cell_doc[sel[inside]] * k + (side[inside] % np.uint64(k)).astype(np.int64)
            r, d = rank[inside], dart[inside]
            order = np.lexsort((d, -r, at))  # the earliest of each coordinate comes last
            at, r, d = at[order], r[order], d[order]
            last = np.append(at[1:] != at[:-1], True) if len(at) else np.zeros(0, bool)
            at, r, d = at[last], r[last], d[last]
            better = r < best[at]
            best[at[better]], flat[at[better]] = r[better], d[better]
        todo &= np.isinf(best.reshape(n, k)).any(axis=1)
        reach = reach * 2.0
        best[np.repeat(todo, k)] = np.inf
    return out


def _band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands) hashes of the bands of each signature."""
    mixed = tx.mix(sig + np.arange(1, bands * rows + 1, dtype=np.uint64) * tx.BASE)
    return tx.mix(mixed.reshape(len(sig), bands, rows).sum(axis=2, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * tx.MIX2)


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values.view(np.int64)))


def _signer(names: list[str], bands: int, rows: int, width: int):
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = tx.text_buffer(batch.column(batch.num_columns - 1))
            for i, j in tx.blocks(at):
                sets, times, sizes = shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], width)
                own = np.repeat(np.arange(j - i), sizes)
                more = np.bincount(own, times - 1, minlength=j - i).astype(np.int64)
                keys = np.zeros((j - i, 2 * bands), np.uint64)
                keep = np.zeros(keys.shape, bool)
                keys[:, :bands] = _band_keys(dart_signatures(sets, np.ones(len(sets)), sizes, k), bands, rows)
                keep[:, :bands] = (sizes > 0)[:, None]
                twice = np.flatnonzero(more)
                if len(twice):
                    mine = more[own] > 0
                    keys[twice, bands:] = _band_keys(dart_signatures(sets[mine], times[mine].astype(float), sizes[twice], k), bands, rows)
                    keep[twice, bands:] = keys[twice, bands:] != keys[twice, :bands]
                cols = [batch.column(c).slice(i, j - i) for c in range(batch.num_columns - 1)]
                cols += [pa.array(sizes.astype(np.int32)), pa.array(more.astype(np.int32)), _lists(keep.sum(axis=1), keys[keep])]
                yield pa.RecordBatch.from_arrays(cols, [*names, "n", "more", "bands"])

    return lean(run)


def parity(elements: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bits of each document in 64-bit words, at least a bit per element, and the number of words, powers of two."""
    n = len(sizes)
    words = (1 << np.ceil(np.log2(np.maximum(sizes, 64) / 64)).astype(np.int64)) * (sizes > 0)
    first = np.cumsum(words) - words
    doc = np.repeat(np.arange(n), sizes)
    h = tx.mix(elements)
    bit = (first[doc] + ((h >> np.uint64(6)) & (words[doc] - 1).astype(np.uint64)).astype(np.int64)) * 64 + (h & np.uint64(63)).astype(np.int64)
    odd = (np.bincount(bit, minlength=64 * int(words.sum())) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<u8").astype(np.uint64), words


def _setter(width: int):
    """node, its distinct shingles, one value for every further copy of a shingle, and parity bits of the first and of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = tx.text_buffer(batch.column(1))
            for i, j in tx.blocks(at):
                sets, times, sizes = shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], width)
                own = np.repeat(np.arange(j - i), sizes)
                nth = np.arange((times - 1).sum()) - np.repeat(np.cumsum(times - 1) - (times - 1), times - 1)
                extra = tx.mix(np.repeat(sets, times - 1) + (nth + 1).astype(np.uint64) * tx.MIX1)
                extra_doc = np.repeat(own, times - 1)
                extras = np.bincount(extra_doc, minlength=j - i)
                turn = np.argsort(np.concatenate([own, extra_doc]), kind="stable")
                bits, words = parity(sets, sizes)
                both = np.concatenate([sets, extra])[turn]
                all_bits, all_words = parity(both[np.repeat(extras > 0, sizes + extras)], (sizes + extras) * (extras > 0))
                cols = [batch.column(0).slice(i, j - i), _lists(sizes, sets), _lists(extras, extra), _lists(words, bits), _lists(all_words, all_bits)]
                yield pa.RecordBatch.from_arrays(cols, ["node", "set", "extra", "bits", "all_bits"])

    return lean(run)


def _node(text: str) -> Column:
    """Name of a text: 64 bits of hash over its md5."""
    return F.when(F.col(text).isNotNull(), F.xxhash64(F.md5(F.col(text).cast("binary"))))


def contract(links: DataFrame, labels: DataFrame) -> DataFrame:
    """labels (node, label) after merging the labels that links (a, b) of nodes join. Both are written tables; labels goes.

    A label with a smaller neighbour hangs from the smallest; pointer jumping takes it to the root of its tree, in
    rounds of the logarithm of its depth. Roots with a link left are half as many after every round.
    """
    left = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    right = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    edges = links.join(left, "a").join(right, "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
    edges = written(edges, "links")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")).where("p <> a")
        parent = written(parent.select(F.col("a").alias("x"), "p"), "parents")
        while True:
            top = parent.select(F.col("x").alias("p"), F.col("p").alias("pp"))
            jumped = written(parent.join(top, "p", "left").select("x", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), "parents")
            discard(parent)
            parent = jumped.select("x", "p")
            if jumped.where("moved").isEmpty():
                break
        up = lambda df, c: df.join(parent.withColumnRenamed("x", c), c, "left").withColumn(c, F.coalesce("p", c)).drop("p")
        old, labels = labels, written(up(labels, "label").select("node", "label"), "labels")
        last, edges = edges, written(up(up(edges, "a"), "b").where("a <> b").select("a", "b").distinct(), "links")
        discard(old, last, parent)
    discard(edges)
    return labels


def _enough(x: Column, y: Column, both: Column, threshold: float) -> Column:
    """Do ``both`` shared elements of two sets of x and y give the similarity?"""
    return both * F.lit(1 + threshold) >= F.lit(threshold) * (x + y) - F.lit(1e-9)


def _possible(a: str, b: str, threshold: float) -> Column:
    """Sizes, and elements that other texts have too, allow the plain or the weighted similarity."""
    c = lambda side, name: F.col(f"{side}{name}")
    n = [c(s, "n") for s in (a, b)]
    m = [c(s, "n") + c(s, "more") for s in (a, b)]
    kept = [F.least(F.least(*n), F.least(c(a, "common"), c(b, "common"))), F.least(F.least(*m), F.least(c(a, "common") + c(a, "more"), c(b, "common") + c(b, "more")))]
    return _enough(*n, kept[0], threshold) | _enough(*m, kept[1], threshold)


def _parity_allows(a: str, b: str, threshold: float) -> Column:
    """The bits that differ, each a shingle of one text alone at least, allow the plain or the weighted similarity."""

    def allows(x: Column, y: Column, total: Column) -> Column:
        size = F.least(F.size(x), F.size(y))
        fold = lambda v: F.when(F.size(v) == size, v).otherwise(F.zip_with(F.slice(v, F.lit(1), size), F.slice(v, size + 1, size), lambda p, q: p.bitwiseXOR(q)))
        apart = F.aggregate(F.zip_with(fold(x), fold(y), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
        return F.when(F.greatest(F.size(x), F.size(y)) > 2 * size, F.lit(True)).otherwise(apart * F.lit(1 + threshold) <= F.lit(1 - threshold) * total + F.lit(1e-9))

    c = lambda side, name: F.col(f"{side}{name}")
    whole = lambda side: F.when(F.size(c(side, "all_bits")) > 0, c(side, "all_bits")).otherwise(c(side, "bits"))
    plain = allows(c(a, "bits"), c(b, "bits"), c(a, "n") + c(b, "n"))
    return plain | allows(whole(a), whole(b), c(a, "n") + c(a, "more") + c(b, "n") + c(b, "more"))


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that are linked, with their plain and weighted similarity."""
    side = lambda key, *names: sets.select(F.col("node").alias(key), F.col("set").alias(names[0]), F.col("extra").alias(names[1]))
    x = pairs.select("a", "b").join(side("b", "t", "u"), "b").join(side("a", "s", "r"), "a")
    both = F.size(F.array_intersect("s", "t"))
    x = x.select("a", "b", F.size("s").alias("x"), F.size("t").alias("y"), both.alias("c"), F.size("r").alias("xm"), F.size("u").alias("ym"), F.size(F.array_intersect("r", "u")).alias("cm"))
    plain = F.col("c") / (F.col("x") + F.col("y") - F.col("c"))
    c, x_, y_ = F.col("c") + F.col("cm"), F.col("x") + F.col("xm"), F.col("y") + F.col("ym")
    x = x.where(_enough(F.col("x"), F.col("y"), F.col("c"), threshold) | _enough(x_, y_, c, threshold))
    return x.select("a", "b", plain.alias("similarity"), (c / (x_ + y_ - c)).alias("weighted"))


def classes(
    docs: DataFrame, key: str, text: str = "text", threshold: float = THRESHOLD, width: int = WORDS, bands: int = BANDS, rows: int = ROWS, pivots: int = PIVOTS, also: tuple[str, ...] = ()
) -> DataFrame:
    """One row per row of ``docs``: ``key``, node (name of its text; null for null text), the columns ``also`` and class_id, the smallest key of its class.

    No column of ``also`` may be named like another of these.
    """
    own = [key, *also]
    fields = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in own) + ", node long, n int, more int, bands array<long>"
    signed = docs.select(*own, _node(text).alias("node"), text).mapInArrow(_signer([*own, "node"], bands, rows, width), fields)
    signed = written(signed, "signatures")
    texts = signed.where("node is not null and n > 0").groupBy("node").agg(F.min(key).alias("rep"), *[F.first(c).alias(c) for c in ("n", "more", "bands")])
    member = texts.select("node", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
    members = written(member.join(shared, "bucket"), "buckets")
    reps = texts.select("node", "rep").join(members.select("node").distinct(), "node", "left_semi")
    whole = docs.select(F.col(key).alias("rep"), _node(text).alias("node"), F.col(text).alias("text"))
    whole = whole.join(reps.withColumnRenamed("rep", "r"), "node").where(F.col("rep").eqNullSafe(F.col("r"))).select("node", "text")
    sets = whole.mapInArrow(_setter(width), "node long, set array<long>, extra array<long>, bits array<long>, all_bits array<long>")
    sets = written(sets.groupBy("node").agg(*[F.first(c).alias(c) for c in ("set", "extra", "bits", "all_bits")]), "sets")
    # Shingles that a single text has: no link can use them, and a text with too few others has no link.
    single = sets.select("node", F.explode("set").alias("x")).groupBy("x").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
    single = single.groupBy("node").agg(F.count("*").alias("single"))
    linked = sets.select("node", F.size("set").alias("n"), F.size("extra").alias("more")).join(single, "node", "left")
    linked = linked.select("node", "n", "more", (F.col("n") - F.coalesce("single", F.lit(0))).alias("common"))
    t = F.lit(threshold)
    linked = written(linked.where((F.col("common") >= t * F.col("n") - F.lit(1e-9)) | (F.col("common") + F.col("more") >= t * (F.col("n") + F.col("more")) - F.lit(1e-9))), "linked")
    labels = written(linked.select("node", F.col("node").alias("label")), "labels")
    live = members.join(linked, "node")
    for turn in range(pivots + 1):
        now = live.join(labels, "node") if turn else live.withColumn("label", F.col("node"))
        # First the member with the fewest shingles of its own, which is the one nearest to all others; then any.
        alone = F.lit(0.0) if turn else 1 - F.col("common") / F.col("n")
        head = F.min(F.struct(alone.alias("o"), F.xxhash64(F.lit(turn), "node").alias("h"), *[F.col(c).alias(f"p_{c}") for c in ("node", "label", "n", "more", "common")]))
        heads = now.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), head.alias("p")).where("lo <> hi")
        old, kept = live, written(now.join(heads.select("bucket", "p.*"), "bucket"), "live")
        live = kept.select("bucket", "node", "n", "more", "common")
        discard(members if turn == 0 else old)
        if turn < pivots:
            pairs = kept.where((F.col("label") != F.col("p_label")) & _possible("", "p_", threshold))
            pairs = pairs.select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b"))
        else:
            pairs = _left_over(kept.select("bucket", "node", "label", "n", "more", "common"), texts, sets, threshold)
        pairs = written(pairs.distinct(), "pairs")
        if not pairs.isEmpty():
            links = written(confirmed(pairs, sets, threshold).select("a", "b"), "confirmed")
            labels = contract(links, labels)
            discard(links)
        discard(pairs)
    discard(live, sets, linked)
    rows_ = signed.select(*own, "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # A table, so that rows of a large class are dealt by no aggregate and Spark may split them in the join.
    ids = written(rows_.where("label is not null").groupBy("label").agg(F.min(key).alias("class_id")), "class-ids")
    return rows_.join(ids, "label", "left").select(*own, "node", F.coalesce("class_id", key).alias("class_id"))


def _left_over(rest: DataFrame, texts: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different classes within buckets, each in the first bucket that the two share. rest: the members of buckets of several classes.

    The members of a bucket's largest class are on one side only, so that they don't meet each other.
    """
    count = rest.groupBy("bucket", "label").agg(F.count("*").alias("c"))
    most = count.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("m")).select("bucket", F.col("m.label").alias("most"))
    rest = rest.join(most, "bucket").join(texts.select("node", "bands"), "node").join(sets.select("node", "bits", "all_bits"), "node")
    rest = written(rest.withColumn("minor", F.col("label") != F.col("most")).drop("most"), "left-over")
    minor = rest.where("minor").select("bucket", *[F.col(c).alias(f"p_{c}") for c in rest.columns if c not in ("bucket", "minor")])
    meet = (F.col("label") != F.col("p_label")) & (~F.col("minor") | (F.col("node") < F.col("p_node")))
    meet &= _possible("", "p_", threshold) & _parity_allows("", "p_", threshold)
    first = F.array_min(F.array_intersect("bands", "p_bands")) == F.col("bucket")
    pairs = rest.alias("x").join(minor.withColumnRenamed("bucket", "p_bucket"), (F.col("bucket") == F.col("p_bucket")) & meet & first)
    return pairs.select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row per class: the row of the smallest key and, of rows of that key, the first.

    Texts are shuffled once, to drop rows by number.
    """
    row = unused(docs, "row_number")
    own = numbered(docs, row)
    plain = own.select(F.col(key).alias("key"), F.col(row).alias("at"), F.col(text).alias("text"))
    got = classes(plain, "key", also=("at",), **options)
    stay = got.where(F.col("class_id").eqNullSafe(F.col("key"))).groupBy("key", "node", F.when(F.col("node").isNull() & F.col("key").isNull(), F.col("at")).alias("alone")).agg(F.min("at").alias(row))
    return own.join(stay.select(row), row, "left_semi").select(*docs.columns)


def op8_dart_minhash(spark, sf_dir: str) -> DataFrame:
    got = classes(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return got.select("doc_id", "class_id", (F.col("class_id") == F.col("doc_id")).alias("kept"))
