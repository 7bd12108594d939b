"""Media columns, centroid clustering and periodic runs against plain versions, and on odd inputs."""

from __future__ import annotations

import hashlib
import io
import random
import re
import tarfile
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwell.llm import _common, clusters, media, periodic, queries
from tarnwell.llm._common import written

DIR = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", None, 0), (2, "", "en", "a", 0), (3, "   \n\t", "en", "a", 5), (4, "one", None, "b", 3), (5, "one", "en", "b", 3), (5, "one", "en", "b", 3),
    (None, "a a a a a a a b", "en", "c", 17), (6, LONG, "en", "c", len(LONG)), (7, "x" * 64, "en", "a", 0), (8, "x" * 30_000, "en", "a", 30_000), (9, "naïve ünïcode   text", "fr", "b", 20),
]


@pytest.fixture(scope="module")
def odd(spark):
    return written(spark.createDataFrame(ODD, SCHEMA), "odd")


@pytest.fixture(scope="module")
def empty(spark):
    return written(spark.createDataFrame([], SCHEMA), "empty")


# 11


def plain_media(text):
    data = (text or "").encode()
    payload = data + bytes(-len(data) % 64 if data else 64)
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def test_media_of_all_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()}
    got = media.op11_media_columns(spark, DIR).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(list(texts))
    by_text = {}
    for r in got:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == plain_media(texts[r["doc_id"]])
        assert (r["format"], r["width"], r["height"], r["bit_depth"]) == ("png", 64, r["payload_bytes"] // 64, 8)
        assert by_table_equal(by_text, texts[r["doc_id"]], r.asDict() | {"doc_id": None})


def by_table_equal(seen, text, values):
    return seen.setdefault(text, values) == values


def test_members_are_images_in_tar_files(spark, odd, tmp_path):
    """The shards open with the standard library; each payload is stored once in a task, and ranges are those of the members."""
    docs = odd.coalesce(1)
    rows = media.stored(docs, f"file://{tmp_path}", ["doc_id"], shard_bytes=2_000).collect()
    assert len({r["shard"] for r in rows}) > 1
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ODD)
    found = {}
    for file in tmp_path.glob("*.tar"):
        with tarfile.open(file) as t:
            for m in t.getmembers():
                assert m.name not in found
                found[m.name] = (file.name, m.offset_data, m.size, t.extractfile(m).read())
    assert len(found) == len({r["digest"] for r in rows}) == 8
    for r in rows:
        *at, image = found[f"{r['digest']}.png"]
        assert at == [r["shard"], r["offset"], r["media_bytes"]]
        assert hashlib.sha256(media.samples_of(image)).hexdigest() == r["digest"]


def test_metadata_needs_headers_only(spark, odd, tmp_path):
    """With everything behind the headers destroyed, the header columns are the same, and reading contents fails."""
    folder = f"file://{tmp_path}"
    index = written(media.members(media.stored(odd.coalesce(1), folder, ["doc_id"])), "index")
    before = {r["digest"]: r for r in media.described(index, folder).collect()}
    for file in tmp_path.glob("*.tar"):
        data = bytearray(file.read_bytes())
        own = bytearray(len(data))
        for r in index.where(F.col("shard") == file.name).collect():
            own[r["offset"] : r["offset"] + media.HEADER] = data[r["offset"] : r["offset"] + media.HEADER]
        file.write_bytes(own)
    assert {r["digest"]: r for r in media.described(index, folder).collect()} == before
    with pytest.raises(Exception, match="check sum|decompress"):
        media.contents(index, folder).collect()


def test_shards_of_lost_attempts_are_swept(spark, odd, tmp_path):
    folder = f"file://{tmp_path}"
    (tmp_path / "shard-lost.tar").write_bytes(b"half a member")
    index = written(media.members(media.stored(odd.repartition(3), folder, ["doc_id"])), "index")
    assert media.swept(index, folder) >= 1 and not (tmp_path / "shard-lost.tar").exists()
    assert media.contents(index, folder).where("payload_sha256 <> digest").count() == 0


def test_media_of_odd_rows(spark, odd, empty, tmp_path):
    got = media.with_media(odd.withColumnsRenamed({"n_chars": "digest", "lang": "content"}).repartition(4), f"file://{tmp_path}", ["doc_id", "content"]).collect()
    want = Counter((i, c, *plain_media(t)) for i, t, c, _, _ in ODD)
    assert Counter((r["doc_id"], r["content"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    assert len({(r["shard"], r["offset"]) for r in got}) == len({r["payload_sha256"] for r in got}) == 8
    assert media.with_media(empty, f"file://{tmp_path}/none", ["doc_id"]).count() == 0


def test_a_payload_under_a_wrong_digest_is_an_error(spark, odd, tmp_path, monkeypatch):
    """The digests that the query gives are of what was read back."""
    monkeypatch.setattr(media, "members", lambda rows: rows.groupBy().agg(F.max("digest").alias("digest"), F.min(F.struct("shard", "offset", "media_bytes")).alias("at"), F.count("*").alias("copies")).select("digest", "at.*", "copies"))
    with pytest.raises(Exception, match="another payload is stored as"):
        media.with_media(odd.coalesce(1), f"file://{tmp_path}", ["doc_id"])


@pytest.mark.parametrize("n", [1, 63, 64, 65, 100_000])
def test_images_keep_every_byte(n):
    payload = media.payload_of(random.Random(n).randbytes(n))
    image = media.image_of(payload)
    assert media.samples_of(image) == payload and media.header_of(image[: media.HEADER]) == (64, len(payload) // 64, 8, 0)
    with pytest.raises(ValueError):
        media.samples_of(image[:40] + bytes([image[40] ^ 1]) + image[41:])
    assert io.BytesIO(image).read(8) == media.SIGNATURE


# 12


def plain_lloyd(rows, dims, scale, k, rounds):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, at, strict=True) if c == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at = assign() if centroids else []
    total = Counter()
    for d, c in at:
        total[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, c, d, total[c], sum(total.values()), digest[c]) for (i, _), (d, c) in zip(kept, at, strict=True))


def lloyd_rows(got):
    return Counter((r["id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in got.collect())


@pytest.mark.parametrize("seed", range(3))
def test_clusters_like_plain_lloyd(spark, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, 3)).astype(np.float32).tolist()
    rows = [(i, base[int(rng.integers(40) if rng.random() < 0.6 else 7)]) for i in range(150)]
    got = clusters.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), dims=3, scale=8, k=4, rounds=3)
    assert lloyd_rows(got) == plain_lloyd(rows, 3, 8, 4, 3)


def test_clusters_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, -0.5]), (1, [0.0, -0.5]), (2, [0.0, -0.5]), (None, [3.0, 3.0]), (3, None), (4, []), (5, [1.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, 2.0]), (10, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, cluster string, v int")
    got = clusters.clustered(df, dims=2, scale=4, k=8, rounds=10)
    assert lloyd_rows(got) == plain_lloyd(rows, 2, 4, 8, 10)
    assert {(r["id"], r["copies"]) for r in got.collect()} == {(1, 3), (2, 3), (None, 1), (9, 1)}
    none = clusters.clustered(df.limit(0), dims=2)
    assert none.count() == 0 and none.columns == got.columns and none.dtypes == got.dtypes


def test_clusters_of_large_components(spark):
    rows = [(i, [float(x), float(-x)]) for i, x in enumerate((1 << 22, 1 << 23, (1 << 23) + 1, (1 << 26) - 1, 5, 0))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert lloyd_rows(clusters.clustered(df, dims=2, scale=1, k=2, rounds=4)) == plain_lloyd(rows, 2, 1, 2, 4)
    with pytest.raises(Exception, match="OverflowError"):
        clusters.clustered(df, dims=2, scale=1 << 10, k=2, rounds=1)


def test_hot_classes_are_broadcast(spark):
    """A vector of a third of all rows doesn't stand in the shuffled join."""
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("v"))
    classes = written(rows.groupBy("v").agg(F.count("*").alias("n")), "classes")
    got = _common.joined_back(rows, classes, "v", "n", 3000, hot=100)
    assert got.count() == 3000 and got.where("v = -1 and n = 1000").count() == 1000


def test_clusters_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DIR}/embeddings.parquet'")
    want = con.execute(queries.ORACLE_SQL["op12_centroid_clustering"])
    names = [c[0] for c in want.description]
    got = clusters.op12_centroid_clustering(spark, DIR).select(*names).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall())


# 13


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            b, e = i, j + q
            if e - b >= max(6, 4 * q) and all(any(w[x] != w[x + p] for x in range(b, e - p)) for p in range(1, q)):
                out.append((b, e - b, q))
            i = max(j, i + 1)
    return sorted(out)


def plain_periodic(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    kept = [x for i, x in enumerate(w) if not any(b + q <= i < b + m for b, m, q in runs)]
    best = min(((-m, b, q) for b, m, q in runs), default=None)
    best = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, len(runs), *best, sha("".join(f"{b},{m},{q}\n" for b, m, q in runs)), sha(" ".join(kept))


def test_runs_of_all_documents(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in rows if len(r["text"] or "") < 20_000]
    got = {r["doc_id"]: tuple(r) for r in periodic.op13_periodic_runs(spark, DIR).collect()}
    assert len(got) == len(rows) and sum(r[1] > 0 for r in got.values()) > 10
    for r in short:
        assert got[r["doc_id"]] == plain_periodic(*r)


@pytest.mark.parametrize("seed", range(4))
def test_runs_like_plain_search(seed):
    rng = random.Random(seed)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            k, w = rng.choice([1, 2, 3, 5]), []
            while len(w) < rng.randint(0, 70):
                u = [str(rng.randrange(k)) for _ in range(rng.randint(1, 7))]
                w += u * rng.randint(1, 7) + u[: rng.randint(0, len(u))]
            texts.append(w)
        ids, sizes = [periodic.numbers(w) for w in texts], np.array([len(w) for w in texts])
        at = np.cumsum(sizes) - sizes
        want = sorted((b + int(s), b + m + int(s), q) for w, s in zip(texts, at, strict=True) for b, m, q in plain_runs(w))
        assert sorted(periodic.find_runs(np.concatenate(ids), sizes)) == want


@pytest.mark.parametrize(("words", "want"), [
    (["a"] * 100_000, [(0, 100_000, 1)]), (["a", "b"] * 50_000 + ["a"], [(0, 100_001, 2)]), ([str(i % 30_000) for i in range(120_000)], [(0, 120_000, 30_000)]), ([str(i % 30_001) for i in range(120_000)], []),
])
def test_long_runs(words, want):
    assert periodic.find_runs(periodic.numbers(words), np.array([len(words)])) == want


def test_leaf_lists_in_parts(monkeypatch):
    """Parts of the leaf lists give what one part gives."""
    w = periodic.numbers([random.Random(5).choice("ab") for _ in range(3000)])
    whole = periodic.find_runs(w, np.array([len(w)]))
    monkeypatch.setattr(periodic, "BLOCK_WORDS", 100)
    assert periodic.find_runs(w, np.array([len(w)])) == whole and whole


def test_runs_of_odd_rows(spark, odd, empty):
    clash = odd.withColumnsRenamed({"lang": "n_runs", "source": "words_of"})
    got = Counter(tuple(r[c] for c in ("doc_id", *periodic.FIELDS)) for r in periodic.runs_of(clash, plant=True).collect())
    assert got == Counter(plain_periodic(i, t) if i != 6 else next(g for g in got if g[0] == 6) for i, t, *_ in ODD)
    one = periodic.runs_of(clash).where("doc_id is null").first()
    assert (one["start"], one["length"], one["period"], one["exponent_milli"], one["words_of"]) == (0, 7, 1, 7000, "c")
    assert periodic.runs_of(empty).count() == 0
