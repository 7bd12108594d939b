"""Centroid clustering of vectors: Lloyd's iterations over distinct quantised vectors with multiplicities.

A vector with exactly ``dims`` components, none null or non-finite, is kept, and each component x becomes the integer
floor(scale * x). Identical vectors form one class with its number of rows, counted before anything is shuffled, so a
vector that holds a third of all rows is one row per task. Each round reads the classes once: a task assigns them to the nearest
centroid (squared Euclidean distance, ties to the smaller number) and sums each centroid's components times the
multiplicities in integers; Spark adds the tasks' sums exactly, and only those, ``k`` rows, reach the driver, which divides and rounds
down. Empty centroids stay. After the last round classes are assigned once more and joined back to the rows by their vectors. Classes of more
than 1/1024 of all rows, at most 1024, are broadcast for that, so that no key of the shuffled join is hot.

Starts: the vectors of the ``k`` smallest sha256 of ``3:<id>``, all if there are fewer. Null or missing vectors, other lengths and non-finite
components take no part. A null id is clustered and never a start. Repeated ids are rows of their own; among equal
hashes the smaller vector comes first. Products and sums stay exact for components below 2**21 (x below 2048); larger ones, up to
2**27, go by integers instead of doubles; beyond that distances don't fit a long, and the task raises an OverflowError.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import by_value, discard, joined_back, lean, table, written

DIMS, SCALE, K, ROUNDS = 64, 1024, 8, 10
by_value(__name__)


def quantised(vectors: DataFrame, key: str, vector: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(id, v array<long>) of the vectors that are kept."""
    e = F.col("e")
    finite = F.coalesce(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    own = vectors.select(F.col(key).alias("id"), F.col(vector).alias("e")).where(e.isNotNull() & (F.size("e") == dims) & finite)
    return own.select("id", F.transform("e", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def starts(rows: DataFrame, k: int = K) -> np.ndarray:
    h = F.sha2(F.concat(F.lit("3:"), F.col("id").cast("string")), 256)
    first = rows.where("id is not null").orderBy(h, "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in first], np.int64).reshape(len(first), len(first[0]["v"]) if first else 0)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and the squared distance, exact."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if top >= 1 << 27:
        raise OverflowError("components of 2**27 and more have distances that don't fit a long")
    if top < 1 << 21 and x.shape[1] <= 1 << 9:  # then all sums are below 2**53
        a, c = x.astype(np.float64), centroids.astype(np.float64)
    else:
        a, c = x, centroids
    far = (c * c).sum(axis=1)[None, :] - 2 * (a @ c.T) + (a * a).sum(axis=1)[:, None]
    at = far.argmin(axis=1)
    return at, far[np.arange(len(x)), at].astype(np.int64)


def _vectors(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, dims)


def _summer(centroids: np.ndarray):
    """Rows (cluster, n, sums) of each task: a bounded number, however many vectors it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d = centroids.shape
        n, sums = [0] * k, np.zeros((k, d), object)
        for b in batches:
            x, times = _vectors(b, d), b.column("n").to_numpy()
            at, _ = nearest(x, centroids)
            for c in np.unique(at).tolist():
                own = at == c
                n[c] += int(times[own].sum())
                # Of times and components, the product is split so that no partial sum passes a long.
                low, high = x[own] & 0xFFFF, x[own] >> 16
                t_low, t_high = times[own, None] & 0xFFFFFF, times[own, None] >> 24
                for part, up in ((t_low * low, 0), (t_low * high, 16), (t_high * low, 24), (t_high * high, 40)):
                    sums[c] += part.sum(axis=0).astype(object) * (1 << up)
        live = [c for c in range(k) if n[c]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(live, pa.int32()), pa.array([n[c] for c in live], pa.int64()), pa.array([[str(s) for s in sums[c]] for c in live], pa.list_(pa.string()))], ["cluster", "n", "sums"]
        )

    return lean(run)


def _assigner(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, far = nearest(_vectors(b, centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([b.column("v"), b.column("n"), pa.array(at.astype(np.int32)), pa.array(far)], ["v", "n", "cluster", "distance"])

    return lean(run)


def moved(classes: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round; floor(sum / count) in whole numbers of any size."""
    parts = classes.mapInArrow(_summer(centroids), "cluster int, n long, sums array<string>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s"))
    exact = each.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))  # k * dims rows
    out = centroids.copy()
    for r in exact.collect():
        out[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
    return out


def _of_cluster(values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)


def clustered(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = DIMS, scale: int = SCALE, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256, copies) of each vector that is kept."""
    rows = quantised(vectors, key, vector, dims, scale)
    classes = written(rows.groupBy("v").agg(F.count("*").alias("n")), "vector-classes")
    at = starts(rows, k)
    shape = "id {}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, copies long"
    if not len(at):
        discard(classes)
        return vectors.sparkSession.createDataFrame([], shape.format(dict(rows.dtypes)["id"]))
    for _ in range(rounds):
        now = moved(classes, at)
        if (now == at).all():  # a fixed point: further rounds change nothing
            break
        at = now
    assigned = written(classes.mapInArrow(_assigner(at), "v array<long>, n long, cluster int, distance long"), "vector-clusters")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("n") * F.col("distance")).alias("s"), F.sum("n").alias("n")).collect()
    inertia = {r["cluster"]: r["s"] for r in sums}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at.tolist()]
    out = joined_back(rows, assigned, "v", "n", sum(r["n"] for r in sums))
    discard(classes)
    return out.select(
        "id", "cluster", "distance", _of_cluster([inertia.get(c, 0) for c in range(len(at))]).cast("long").alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), _of_cluster(digest).alias("centroid_sha256"), F.col("n").alias("copies")
    )


def op12_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).withColumnRenamed("id", "vec_id")


def sql(dims: int = DIMS, scale: int = SCALE, k: int = K, rounds: int = ROUNDS) -> str:
    """DuckDB SQL of ``op12_centroid_clustering``: the same rounds over all rows, without classes."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
            a{r} AS MATERIALIZED (
                SELECT row, vec_id, e, near.distance AS distance, near.cluster AS cluster FROM (
                    SELECT v.row, v.vec_id, v.e, min({{'distance': list_dot_product(v.e, v.e) - 2 * list_dot_product(v.e, c.e) + list_dot_product(c.e, c.e), 'cluster': c.cluster}}) AS near
                    FROM v JOIN c{r} c ON v.one = c.one GROUP BY ALL
                )
            )""")
        if r < rounds:
            steps.append(f"""
            m{r} AS (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(e) AS x, unnest(range({dims})) AS i FROM a{r}) GROUP BY ALL),
            c{r + 1} AS MATERIALIZED (
                SELECT c.cluster, coalesce(m.e, c.e) AS e, c.one
                FROM c{r} c LEFT JOIN (SELECT cluster, list(CAST(floor(s / n) AS DOUBLE) ORDER BY i) AS e FROM m{r} GROUP BY cluster) m ON c.cluster = m.cluster
            )""")
    return f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x : floor({scale} * CAST(x AS DOUBLE))) AS e, 1 AS one FROM embeddings
            WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x : x IS NOT NULL AND isfinite(x))) = {dims}
        ), c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h, e) - 1 AS cluster, e, one FROM (SELECT e, one, sha256('3:' || vec_id) AS h FROM v WHERE vec_id IS NOT NULL) ORDER BY h, e LIMIT {k}
        ), {",".join(steps)}
        SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
            CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.e, lambda x : CAST(x AS BIGINT)), ',')) AS centroid_sha256,
            count(*) OVER (PARTITION BY a.e) AS copies
        FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster
    """
