"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Groups of equal texts stay together. Each group is a vector (bytes, tokens, rows), as a share of the totals, and goes,
largest first, to the bin where the dot product with the residual capacity is highest. The shards are the bins of the
last round, which places at most about 3 * ``most`` items in one task. Groups above 1 / ``most`` of the bytes or of the rows, at
most 2 * ``most`` of them, wait for it. While there are more than ``most`` others, these are dealt to blocks of about
``block_items`` by a hash, each block packs its own into small bins of equal capacity by the same rule, and the bins
are the items of the next round. So every group is placed by its own vector, no task holds more than a block, and nothing
but counts reaches the driver.

Groups stay whole wherever shards can be near equal so: a group up to a whole shard fills one, and lighter ones go around it. Split are groups of more than
``split_above`` shards, and of the groups above 1 / ``TRIED`` of a shard those that fit into no shard any more once the heavier ones are placed (a ninth
group of 0.7 shards); their rows are dealt by a hash to parts of about 1 / ``most`` of the bytes. None keeps every group whole, however heavy.

Law: ``bytes`` (shard sizes near equal). Slots count each shard's rows from 0, by prefix sums over cells of a bounded
number of rows; their order is that of a hash of each row's place in the files.

Null text: 0 bytes plus 1, a group of its own kind, crc32 of no bytes (0). Very long texts are groups like others. Repeated rows
count each. Ties in size go by the group's hash, ties between bins to the first. Results depend on rows and their
places in files, not on how files are split. An empty table gives an empty result. Other columns are not read; keys may not be
named size, tokens, text_crc32, group, row, item, shard or slot.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import by_value, discard, numbered, table, written
from .mixing import size_of

SHARDS, MOST, BLOCK_ITEMS, CELL_ROWS, SPLIT_ABOVE, TRIED = 8, 4096, 4096, 50_000, 1.0, 64
LOADS = ["size", "tokens", "rows"]
by_value(__name__)


def place(items: np.ndarray, bins: int, totals: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """items: (n, d) loads, of ``totals``. Bin of each, largest first, to the highest dot product with the residual capacity, and whether it fits there."""
    share = items / np.maximum(items.sum(axis=0) if totals is None else totals, 1)
    residual = np.full((bins, items.shape[1]), 1.0 / bins)
    out, fitted = np.zeros(len(items), np.int64), np.ones(len(items), bool)
    # Bytes decide the order and ties; the first column weighs as much as the others together.
    weight = np.array([items.shape[1] - 1.0] + [1.0] * (items.shape[1] - 1))
    for i in np.argsort(-share[:, 0], kind="stable"):
        fits = residual[:, 0] >= share[i, 0]
        score = (residual * (share[i] * weight)).sum(axis=1)
        # Where it fits nowhere, the emptiest bin takes it, which keeps the law of near equal bytes.
        s = int(np.argmax(np.where(fits, score, -np.inf) if fits.any() else residual[:, 0]))
        out[i], fitted[i] = s, fits.any()
        residual[s] -= share[i]
    return out, fitted


def _placer(bins: int):
    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("item")
        at, _ = place(items[LOADS].to_numpy(float), bins)
        return items[["item", *LOADS]].assign(bin=items["block"].to_numpy(np.int64) * (1 << 20) + at)

    return run


def _packed(items: DataFrame, blocks: int, bins: int, salt: int) -> DataFrame:
    dealt = items.select("item", *LOADS, F.pmod(F.xxhash64("item", F.lit(salt)), F.lit(blocks)).alias("block"))
    return written(dealt.groupBy("block").applyInPandas(_placer(bins), "item long, size long, tokens long, rows long, bin long"), "shard-packed")


def shard(
    docs: DataFrame, keys: list[str], text: str = "text", shards: int = SHARDS, most: int = MOST, block_items: int = BLOCK_ITEMS, cell_rows: int = CELL_ROWS, split_above: float | None = SPLIT_ABOVE
) -> DataFrame:
    """``keys`` with size, tokens, text_crc32, shard and slot for every row of ``docs``."""
    own = numbered(docs.select(*keys, F.col(text).alias("text")), "row")
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = own.select(
        *keys,
        (F.octet_length(t) + F.lit(1)).cast("long").alias("size"),
        size_of("text").alias("tokens"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col("text").isNull(), F.md5(t.cast("binary"))).alias("group"),
        F.xxhash64("row").alias("row"),
    )
    rows = written(rows, "shard-rows")
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    loads = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    # Fewer than TRIED * shards groups are tried, fewer are split; what is lighter leaves shards near equal wherever it goes.
    tried = rows.groupBy("group").agg(*loads).where(F.col("size") * TRIED * shards > total).orderBy("group").toPandas()
    if split_above is None:
        tried = tried.iloc[:0]
    _, fitted = place(tried[LOADS].to_numpy(float), shards, np.array([total, np.inf, np.inf]))
    tried = tried[(tried["size"] > (split_above or 0) * total / shards) | ~fitted]
    parts = [(int(g), -(-int(n) * most // max(total, 1))) for g, n in zip(tried["group"], tried["size"], strict=True)]
    split = docs.sparkSession.createDataFrame(parts, "group long, parts long")
    item = F.when(F.col("parts").isNull(), F.col("group")).otherwise(F.xxhash64("group", F.pmod("row", F.col("parts"))))
    dealt = rows.join(F.broadcast(split), "group", "left").withColumn("item", item).drop("parts", "group")
    items = written(dealt.groupBy("item").agg(*loads), "shard-items")
    heavy = (F.col("size") * most > total) | (F.col("rows") * most > count)
    level, steps = items.where(~heavy), []
    while (n := level.count()) > most:
        blocks = -(-n // block_items)
        steps.append(_packed(level, blocks, max(shards, most // blocks), len(steps)))
        sums = [F.sum(c).alias(c) for c in LOADS]
        level = written(steps[-1].groupBy(F.col("bin").alias("item")).agg(*sums), "shard-bins")
    last = _packed(items.where(heavy).unionByName(level), 1, shards, -1).select("item", F.col("bin").cast("int").alias("shard"))
    light = last
    for step in reversed(steps):  # from the bins of a round back to what it packed
        light = step.select("item", "bin").join(light.withColumnsRenamed({"item": "bin"}), "bin").select("item", "shard")
    # Where heavy items go is at most 2 * most rows; everything is, if there was one round only.
    near = last.join(items.where(heavy).select("item"), "item", "left_semi") if steps else last
    there = dealt.join(F.broadcast(near.withColumnRenamed("shard", "heavy_shard")), "item", "left")
    put = there.where("heavy_shard is not null").withColumnRenamed("heavy_shard", "shard")
    if steps:
        put = put.unionByName(there.where("heavy_shard is null").drop("heavy_shard").join(light, "item"))
    # A cell has at most about cell_rows rows; a hash of the rows deals them.
    cells = max(1, -(-count // (cell_rows * shards)))
    put = written(put.select(*keys, "size", "tokens", "text_crc32", "shard", "row", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(cells)).alias("cell")), "shard-dealt")
    base = put.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    base = base.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before"))
    own_turn = Window.partitionBy("shard", "cell").orderBy("row")
    discard(rows, items, *steps)
    return put.join(base, ["shard", "cell"]).withColumn("slot", F.col("before") + F.row_number().over(own_turn) - 1).select(
        *keys, "size", "tokens", "text_crc32", "shard", F.col("slot").cast("long").alias("slot")
    )


def op6_vector_sharding(spark, sf_dir: str) -> DataFrame:
    got = shard(table(spark, sf_dir, "documents"), ["doc_id"])
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
