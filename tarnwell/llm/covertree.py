"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are dealt to cells around pivots of a bounded sample and each cell into blocks of about ``block_rows`` rows, so
that a cell however hot is many blocks. Every block of data and every chunk of queries sent to it has a cover tree: the
children of a node are a net of its points, farthest point first until half the node's radius is covered, at most
``FAN`` of them, each with the radius that covers its own points; nodes of up to ``leaf`` points, or of equal
points, have none. A search walks both trees together. For a query node (centre a, radius r) and a data node (centre b,
radius s) no inner product exceeds

    a.b + |a| s + |b| r + r s

and the pair is dropped when that is below the worst k-th score among the node's queries; equal scores are kept, as
ties go to the smaller id. The wider node is split first; of a query leaf, each point is held against data nodes by itself
(r = 0). A query leaf meets the data leaves that are left in matrix products, the most promising first, and drops
others as its k-th scores rise. Before all that it meets one near leaf, so that there is a k-th score to begin with.

Two rounds: each query first searches the block that it lies in, which bounds its k-th score; the bounds then choose, by
the same rule on whole cells, which other blocks a query is sent to. Queries travel to blocks in chunks of about
``chunk_rows``; a block's rows are sent once for every chunk. Results of a query are merged at the end. Nothing
approximate remains; pruning changes only time.

Components are floor(256 * x). Vectors null, empty, or with a null or non-finite component take no part,
nor do null ids. Only vectors of equal length meet. A query's candidates are all other rows: a row of equal id or equal
contents is a candidate like any, and a query row that occurs twice is answered twice. Ties go to the smaller id. Scores are
exact below 2**53. An empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import by_value, discard, lean, numbered, table, written

K, BLOCK_ROWS, CHUNK_ROWS, PIVOTS, PIVOT_SAMPLE, LEAF, FAN, MEET = 5, 4096, 8192, 64, 4_000, 32, 16, 512
by_value(__name__)


class CoverTree:
    """Tree over the rows of x (float64 holding integers). A node's points are order[start:end]; its children are numbers first:last."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.order = x, np.arange(len(x))
        square = (x * x).sum(axis=1)
        far = lambda c, points: np.sqrt(np.maximum(square[points] + square[c] - 2 * (x[points] @ x[c]), 0.0))
        nodes = [[0, 0.0, 0, len(x), 0, 0]] if len(x) else []
        for node in nodes:  # grows as it goes
            centre, _, start, end, _, _ = node
            points = self.order[start:end]
            nearest = far(centre, points)
            node[1] = radius = float(nearest.max())
            if len(points) <= leaf or radius == 0.0:
                continue
            owner, centres = np.zeros(len(points), np.int64), [centre]
            while len(centres) < FAN and nearest.max() > radius / 2:
                centres.append(int(points[int(nearest.argmax())]))
                reach = far(centres[-1], points)
                closer = reach < nearest
                nearest[closer], owner[closer] = reach[closer], len(centres) - 1
            turn = np.argsort(owner, kind="stable")
            self.order[start:end] = points[turn]
            cut = start + np.searchsorted(owner[turn], np.arange(len(centres) + 1))
            node[4], node[5] = len(nodes), len(nodes) + len(centres)
            nodes += [[c, 0.0, int(a), int(b), 0, 0] for c, a, b in zip(centres, cut[:-1], cut[1:], strict=True)]
        table_ = np.array(nodes).reshape(-1, 6)
        self.centre, self.start, self.end, self.first, self.last = table_[:, [0, 2, 3, 4, 5]].astype(np.int64).T
        # Rounding must not make a radius too small.
        self.radius = table_[:, 1] * (1 + 1e-9)
        self.at, self.norm = x[self.centre], np.sqrt(square[self.centre]) * (1 + 1e-9)

    def points(self, node: int) -> np.ndarray:
        return self.order[self.start[node] : self.end[node]]


class Counts:
    """Pairs of nodes whose bound was computed and that were dropped, and pairs of points that met."""

    def __init__(self):
        self.pairs = self.dropped = self.met = 0


def search(queries: CoverTree, q_ids: np.ndarray, data: CoverTree, d_ids: np.ndarray, k: int, floor: np.ndarray, same=None, counts: Counts | None = None) -> tuple[np.ndarray, np.ndarray]:
    """k best (score, id) of every query; -inf where there are fewer. floor: known lower bounds of the k-th scores.

    same: values of the query rows and of the data rows that are equal where both are one row; by default the ids.
    """
    q_rows, d_rows = same or (q_ids, d_ids)
    none = np.iinfo(np.int64).max
    best, ids = np.full((len(q_ids), k), -np.inf), np.full((len(q_ids), k), none)
    counts = counts or Counts()
    if not len(q_ids) or not len(d_ids):
        return best, ids

    def low(points: np.ndarray) -> np.ndarray:
        return np.maximum(best[points, k - 1], floor[points])

    def bounds(q: int, nodes: np.ndarray) -> np.ndarray:
        """Of a query node or, for a leaf, of each of its points: a row each, a column for each data node."""
        if leaf(q):
            points = queries.points(q)
            got = queries.x[points] @ data.at[nodes].T + np.sqrt((queries.x[points] ** 2).sum(axis=1))[:, None] * data.radius[nodes]
        else:
            got = (data.at[nodes] @ queries.at[q] + queries.norm[q] * data.radius[nodes] + queries.radius[q] * (data.norm[nodes] + data.radius[nodes]))[None, :]
        return got + 1e-9 * np.abs(got) + 1e-3

    def leaf(q: int) -> bool:
        return queries.first[q] == queries.last[q]

    def hopeful(q: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        most, need = bounds(q, nodes), low(queries.points(q))
        keep = (most >= (need[:, None] if leaf(q) else need.min())).any(axis=0)
        counts.pairs += len(nodes)
        counts.dropped += int((~keep).sum())
        return nodes[keep], most[:, keep]

    def split(nodes: np.ndarray, which: np.ndarray) -> np.ndarray:
        return np.concatenate([nodes[~which], *[np.arange(data.first[n], data.last[n]) for n in nodes[which]]])

    def meet(q: int, nodes: np.ndarray, most: np.ndarray) -> None:
        """A query leaf and data leaves, those of the highest bounds first; most: the bounds of each query."""
        points = queries.points(q)
        while len(nodes):
            turn = np.argsort(-most.max(axis=0), kind="stable")
            now = turn[: max(1, int(np.searchsorted(np.cumsum((data.end - data.start)[nodes[turn]]), MEET, side="right")))]
            own = np.concatenate([data.points(n) for n in nodes[now]])
            score = queries.x[points] @ data.x[own].T
            score[q_rows[points][:, None] == d_rows[own][None, :]] = -np.inf
            counts.met += score.size
            live = score.max(axis=1) >= low(points)
            if live.any():
                p, s = points[live], score[live]
                if len(own) > 4 * k:  # columns that are among the k best of some query, with all ties
                    some = (s >= np.partition(s, len(own) - k, axis=1)[:, [len(own) - k]]).any(axis=0)
                    s, own = s[:, some], own[some]
                name = np.where(np.isneginf(s), none, d_ids[own][None, :])
                s, name = np.concatenate([best[p], s], axis=1), np.concatenate([ids[p], name], axis=1)
                order = np.lexsort((name, -s), axis=1)[:, :k]
                best[p], ids[p] = np.take_along_axis(s, order, 1), np.take_along_axis(name, order, 1)
            left = np.ones(len(nodes), bool)
            left[now] = False
            stay = left & (most >= low(points)[:, None]).any(axis=0)
            counts.dropped += int((left & ~stay).sum())
            nodes, most = nodes[stay], most[:, stay]

    # Each query leaf first meets one data leaf, the way down to which has the highest products of centres.
    first_met: dict[int, int] = {}
    for q in np.flatnonzero(queries.first == queries.last).tolist():
        n = 0
        while data.first[n] < data.last[n]:
            n = data.first[n] + int((data.at[data.first[n] : data.last[n]] @ queries.at[q]).argmax())
        first_met[q] = n
        meet(q, np.array([n]), np.full((queries.end[q] - queries.start[q], 1), np.inf))
    stack = [(0, np.zeros(1, np.int64))]
    while stack:
        q, nodes = stack.pop()
        nodes, most = hopeful(q, nodes)
        # The wider node is split first; a query leaf splits data nodes down to leaves.
        while len(nodes) and (wide := (data.first[nodes] < data.last[nodes]) & (leaf(q) | (data.radius[nodes] >= queries.radius[q]))).any():
            nodes, most = hopeful(q, split(nodes, wide))
        if leaf(q):
            meet(q, nodes[nodes != first_met[q]], most[:, nodes != first_met[q]])
        elif len(nodes):
            stack += [(c, nodes) for c in range(queries.first[q], queries.last[q])]
    return best, ids


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def _searcher(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            left, right = left.sort_values(["id", "row"]), right.sort_values(["id", "row"])
            q, d = CoverTree(_matrix(left["v"])), CoverTree(_matrix(right["v"]))
            rows = left["row"].to_numpy(np.int64), right["row"].to_numpy(np.int64)
            best, ids = search(q, left["id"].to_numpy(np.int64), d, right["id"].to_numpy(np.int64), k, left["floor"].to_numpy(np.float64), rows)
            row, col = np.nonzero(~np.isneginf(best))
            out = {"query": rows[0][row], "query_id": left["id"].to_numpy()[row], "vec_id": ids[row, col], "score": best[row, col].astype(np.int64)}
        return pd.DataFrame(out)

    return run


def _assigner(pivots: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = (pivots * pivots).sum(axis=1)
        for b in batches:
            x = _matrix(b["v"])
            far = half[None, :] - 2 * (x @ pivots.T) if len(x) else np.zeros((0, len(pivots)))
            cell = far.argmin(axis=1)
            gap = np.sqrt(np.maximum(far[np.arange(len(x)), cell] + (x * x).sum(axis=1), 0.0)) if len(x) else np.zeros(0)
            yield b.assign(cell=cell.astype(np.int32), gap=gap)

    return lean(run)


def _router(pivots: np.ndarray, radius: np.ndarray, blocks: np.ndarray):
    """Blocks that may hold a score of a query's k-th bound or more. radius, blocks: of each cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (b.iloc[i : i + 1024] for b in batches for i in range(0, len(b), 1024)):
            x = _matrix(b["v"])
            most = x @ pivots.T + np.sqrt((x * x).sum(axis=1))[:, None] * radius[None, :]
            most += 1e-9 * np.abs(most) + 1e-3
            row, cell = np.nonzero((most >= b["floor"].to_numpy()[:, None]) & (blocks > 0)[None, :])
            times = blocks[cell]
            row, cell = np.repeat(row, times), np.repeat(cell, times)
            block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            got = b.iloc[row].copy()
            got["to_cell"], got["to_block"] = cell.astype(np.int32), block.astype(np.int32)
            own = (got["to_cell"] == got["cell"]) & (got["to_block"] == got["block"])
            yield got.loc[~own.to_numpy(), ["id", "row", "v", "floor", "to_cell", "to_block"]]

    return lean(run)


def top_k(vectors: DataFrame, is_query, k: int = K, key: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` that ``is_query`` selects."""
    spark = vectors.sparkSession
    own = numbered(vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("e"), F.coalesce(is_query, F.lit(False)).alias("q")), "place")
    fine = F.col("e").isNotNull() & (F.size("e") > 0) & F.col("id").isNotNull()
    fine &= F.coalesce(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    ints = own.where(fine).select("id", F.transform("e", lambda x: F.floor(x.cast("double") * 256)).alias("v"), "q", F.xxhash64("place").alias("row"))
    ints = written(ints, "vectors")
    got = None
    for (size,) in ints.select(F.size("v")).distinct().collect():  # vector lengths, not rows
        part = _of_length(spark, ints.where(F.size("v") == size), k, block_rows, chunk_rows, pivots)
        got = part if got is None else got.unionByName(part)
    discard(ints)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long") if got is None else got


def _pivots(ints: DataFrame, most: int) -> np.ndarray:
    """Farthest-first net of a bounded sample by hash."""
    sample = _matrix(ints.orderBy(F.xxhash64("v", "id"), "id").limit(PIVOT_SAMPLE).select("v").toPandas()["v"])
    chosen, near = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < most and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _of_length(spark, ints: DataFrame, k: int, block_rows: int, chunk_rows: int, pivots: int) -> DataFrame:
    at = _pivots(ints, max(1, min(pivots, ints.count() // max(1, block_rows // 8))))
    dealt = written(ints.mapInPandas(_assigner(at), "id long, v array<long>, q boolean, row long, cell int, gap double"), "vectors-dealt")
    cells = {r["cell"]: r for r in dealt.groupBy("cell").agg(F.max("gap").alias("r"), F.count("*").alias("n"), F.count_if("q").alias("nq")).collect()}
    radius = np.array([cells[c]["r"] * (1 + 1e-9) if c in cells else 0.0 for c in range(len(at))])
    blocks = np.array([-(-cells[c]["n"] // block_rows) if c in cells else 0 for c in range(len(at))], np.int64)
    chunks = max(1, -(-sum(c["nq"] for c in cells.values()) // chunk_rows))
    of_cell = F.element_at(F.array(*[F.lit(int(n)) for n in blocks]), F.col("cell") + 1)
    data = dealt.select("id", "row", "v", "q", "cell", F.pmod("row", of_cell).cast("int").alias("block"))
    queries = data.where("q").drop("q")
    fields = "query long, query_id long, vec_id long, score long"
    kth = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")

    # Blocks under names of their own: both sides come from one table.
    mine = data.select("id", "row", "v", F.col("cell").alias("d_cell"), F.col("block").alias("d_block"))
    own = queries.withColumn("floor", F.lit(float("-inf"))).groupBy("cell", "block").cogroup(mine.groupBy("d_cell", "d_block"))
    home = written(own.applyInPandas(_searcher(k), fields), "top-home")
    low = home.withColumn("r", F.row_number().over(kth)).where(F.col("r") == k).select(F.col("query").alias("row"), F.col("score").cast("double").alias("low"))
    bounded = queries.join(low, "row", "left").withColumn("floor", F.coalesce("low", F.lit(float("-inf"))))
    asked = bounded.select("id", "row", "v", "cell", "block", "floor").mapInPandas(_router(at, radius, blocks), "id long, row long, v array<long>, floor double, to_cell int, to_block int")
    asked = written(asked.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int")), "top-asked")
    asks = asked.select("to_cell", "to_block", F.col("chunk").alias("to_chunk")).distinct()
    sent = data.join(asks, (F.col("cell") == F.col("to_cell")) & (F.col("block") == F.col("to_block")))
    sent = sent.select(*[F.col(c).alias(f"d_{c}") for c in ("id", "row", "v", "to_cell", "to_block", "to_chunk")]).withColumnsRenamed({"d_id": "id", "d_row": "row", "d_v": "v"})
    rest = asked.groupBy("to_cell", "to_block", "chunk").cogroup(sent.groupBy("d_to_cell", "d_to_block", "d_to_chunk")).applyInPandas(_searcher(k), fields)
    both = home.unionByName(written(rest, "top-rest"))
    discard(asked, dealt)
    return both.withColumn("rank", F.row_number().over(kth)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_cover_tree_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
