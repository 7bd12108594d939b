"""Media columns: content-addressed payloads in tar shards, rows that refer to them, metadata from their headers.

A text's payload is its UTF-8 bytes followed by bytes 0 up to a positive multiple of 64, so 64 of them for an empty text. It is stored
as a greyscale PNG image with 8-bit samples, 64 to a line: lossless, deflated, and with a header of fixed size. Images are
members of tar files, named by the payload's sha256. Every task that reads documents writes shards of its own, a new one after
``SHARD_BYTES``, straight into the shared folder, so no text is shuffled; it stores a payload once, however many of its rows have it.
A row carries digest, shard, offset and length of the stored image. Where several tasks stored one payload, all rows
refer to the first of them by name and place, and the shards that no row refers to are deleted (``swept``).

``described`` fills metadata columns by range reads of the first ``HEADER`` bytes of a member (format, width, height, bit depth);
``contents`` reads whole members back, once for each payload: digests and features of what is really stored. Both are
joined back to the rows by digest; digests of more than 1/1024 of all rows, at most 1024, are broadcast.

Lost executors: an attempt writes shards under names of its own, and rows that refer to them become visible as a Parquet table only
when Spark commits its task. What an attempt left behind is named by no row, and is swept. Shards are deleted neither after the query nor
when the table is dropped: they are the product.

Null text: like an empty one. Very long texts are members like others; a task holds one payload at a time, besides digests of those it has stored.
Repeated rows and equal texts share a member and have equal values. Null ids are kept. An empty table gives no shard. Other columns
of ``docs`` are not read; ``keys`` may not be named like a result. Results don't depend on how files are split, but for shard and offset.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import by_value, discard, joined_back, lean, shared_dir, table, unused, written

UNIT, SHARD_BYTES, READ_BYTES, LEVEL = 64, 1 << 28, 1 << 25, 6
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33  # signature, and the chunk IHDR with its length and check sum
BLOCK = 512  # of tar
by_value(__name__)


def payload_of(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % UNIT if data else UNIT)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def image_of(payload: bytes, level: int = LEVEL) -> bytes:
    """PNG, 64 grey samples of 8 bits a line; each line is stored without a filter."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    raw = np.zeros((len(lines), UNIT + 1), np.uint8)
    raw[:, 1:] = lines
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, len(lines), 8, 0, 0, 0, 0))
    return SIGNATURE + head + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def header_of(data: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from the first HEADER bytes of an image."""
    if len(data) < HEADER or data[:8] != SIGNATURE or data[12:16] != b"IHDR" or struct.unpack(">I", data[29:33])[0] != zlib.crc32(data[12:29]):
        raise ValueError("not the header of a PNG image")
    return struct.unpack(">IIBB", data[16:26])


def samples_of(image: bytes) -> bytes:
    """The payload of an image that ``image_of`` made."""
    width, height, depth, colour = header_of(image)
    if (width, depth, colour) != (UNIT, 8, 0):
        raise ValueError("not an image of 64 grey samples a line")
    at, parts = HEADER, []
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        data = image[at + 8 : at + 8 + n]
        if struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + data):
            raise ValueError("a chunk's check sum is wrong")
        parts += [data] if kind == b"IDAT" else []
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, UNIT + 1)
    if lines[:, 0].any():
        raise ValueError("a line has a filter")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Statistics of the samples in whole numbers: lines, sum, distinct values, largest value, ones among bits, first and last line's check sums."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    total = int((counts * np.arange(256)).sum())
    bits = int(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1) @ counts)
    return f"lines={len(x) // UNIT};sum={total};distinct={int((counts > 0).sum())};max={int(x.max())};bits={bits};first={zlib.crc32(payload[:UNIT])};last={zlib.crc32(payload[-UNIT:])}"


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of an URI as Spark writes it."""
    scheme, _, rest = uri.partition(":")
    if scheme in ("s3a", "s3n"):
        uri = f"s3:{rest}"
    return fs.FileSystem.from_uri(f"file://{uri.removeprefix('file:')}" if scheme == "file" and not rest.startswith("//") else uri)


class TarShard:
    """A tar file that is written from front to end; ``add`` tells where a member's data begins."""

    def __init__(self, uri: str):
        self.uri, self.at = uri, 0
        where, path = _opened(uri)
        self.file = where.open_output_stream(path)

    def add(self, name: str, data: bytes) -> int:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.GNU_FORMAT)
        for part in (head, data, b"\0" * (-len(data) % BLOCK)):
            self.file.write(part)
        offset = self.at + len(head)
        self.at = offset + len(data) + -len(data) % BLOCK
        return offset

    def close(self) -> None:
        self.file.write(b"\0" * (2 * BLOCK))
        self.file.close()


STORED = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "digest": pa.string(), "shard": pa.string(), "offset": pa.int64(), "media_bytes": pa.int64()}


def _writer(folder: str, text: str, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, int, int]] = {}
        names: list[str] = []
        shard = None
        try:
            for b in batches:
                got = []
                for t in b.column(text).to_pylist():
                    data = (t or "").encode("utf-8", "surrogatepass")
                    payload = payload_of(data)
                    key = hashlib.sha256(payload).digest()
                    if key not in known:
                        if shard is None:
                            names.append(f"shard-{uuid.uuid4().hex}.tar")
                            shard = TarShard(f"{folder}/{names[-1]}")
                        image = image_of(payload)
                        known[key] = len(names) - 1, shard.add(f"{key.hex()}.png", image), len(image)
                        if shard.at >= shard_bytes:
                            shard.close()
                            shard = None
                    nth, offset, length = known[key]
                    got.append((len(data), len(payload), key.hex(), names[nth], offset, length))
                if got:
                    kept = [c for c in b.schema.names if c != text]
                    made = [pa.array(c, kind) for c, kind in zip(zip(*got, strict=True), STORED.values(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *made], [*kept, *STORED])
        finally:
            if shard is not None:
                shard.close()

    return lean(run)


def stored(docs: DataFrame, folder: str, keys: list[str], text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write all payloads to shards in ``folder``. A table: ``keys``, n_bytes, payload_bytes, digest, shard, offset, media_bytes of each row."""
    content = unused(docs.select(*keys), "content")
    own = docs.select(*keys, F.col(text).alias(content))
    where, path = _opened(folder)
    where.create_dir(path, recursive=True)
    shape = _shape(own.drop(content), "n_bytes long, payload_bytes long, digest string, shard string, offset long, media_bytes long")
    return written(own.mapInArrow(_writer(folder, content, shard_bytes), shape), "media-rows")


def members(rows: DataFrame) -> DataFrame:
    """(digest, shard, offset, media_bytes, copies): where each payload is stored, the first of its places."""
    place = F.min(F.struct("shard", "offset", "media_bytes")).alias("at")
    return rows.groupBy("digest").agg(place, F.count("*").alias("copies")).select("digest", "at.*", "copies")


def swept(index: DataFrame, folder: str) -> int:
    """Delete shards in ``folder`` that ``index`` doesn't name. One name for each writing task is compared, none of the rows."""
    where, path = _opened(folder)
    used = {r["shard"] for r in index.select("shard").distinct().collect()}
    gone = [f.path for f in where.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".tar") and f.base_name not in used]
    for f in gone:
        where.delete_file(f)
    return len(gone)


def _ranges(folder: str, batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[tuple[pa.RecordBatch, Iterator[bytes]]]:
    """Each batch and the bytes of its rows' members, the first ``most`` of each (None: all). One shard is open at a time."""
    held: list = ["", None]

    def read(shard: str, offset: int, length: int) -> bytes:
        if held[0] != shard:
            if held[1] is not None:
                held[1].close()
            where, path = _opened(f"{folder}/{shard}")
            held[:] = shard, where.open_input_file(path)
        held[1].seek(offset)
        return held[1].read(length if most is None else min(most, length))

    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("shard", "offset", "media_bytes")]
        yield b, (read(*r) for r in zip(*cols, strict=True))
    if held[1] is not None:
        held[1].close()


def _mapped(folder: str, most: int | None, made: list[tuple[str, pa.DataType]], value):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data in _ranges(folder, batches, most):
            if b.num_rows:
                got = zip(*(value(d) for d in data), strict=True)
                new = [pa.array(c, t) for c, (_, t) in zip(got, made, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *[n for n, _ in made]])

    return lean(run)


def _shape(index: DataFrame, more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema] + [more])


def described(index: DataFrame, folder: str) -> DataFrame:
    """``index`` with format, width, height and bit_depth, from range reads of the members' headers."""

    def value(head: bytes) -> tuple:
        width, height, depth, _ = header_of(head)
        return "png", width, height, depth

    made = [("format", pa.string()), ("width", pa.int64()), ("height", pa.int64()), ("bit_depth", pa.int32())]
    return index.mapInArrow(_mapped(folder, HEADER, made, value), _shape(index, "format string, width long, height long, bit_depth int"))


def contents(index: DataFrame, folder: str) -> DataFrame:
    """``index`` with payload_sha256, tail_crc32, media_sha256 and feature of the stored bytes, read back."""

    def value(image: bytes) -> tuple:
        payload = samples_of(image)
        return hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), hashlib.sha256(image).hexdigest(), feature_of(payload)

    made = [("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    return index.mapInArrow(_mapped(folder, None, made, value), _shape(index, "payload_sha256 string, tail_crc32 long, media_sha256 string, feature string"))


def with_media(docs: DataFrame, folder: str, keys: list[str], text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``keys`` of each row with n_bytes, payload_bytes, digest, shard, offset, media_bytes, header columns and contents."""
    rows = stored(docs, folder, keys, text, shard_bytes)
    index = written(members(rows), "media-members")
    swept(index, folder)
    # Members of a shard are read in order, so that a task keeps to few files and about READ_BYTES.
    size = index.agg(F.sum("media_bytes")).first()[0] or 0
    tasks = max(-(-size // READ_BYTES), docs.sparkSession.sparkContext.defaultParallelism)
    at = index.repartitionByRange(tasks, "shard", "offset").sortWithinPartitions("shard", "offset")
    read = contents(described(at, folder), folder)
    # What was read back has the digest that it is stored under, so one of the two goes on.
    same = F.when(F.col("payload_sha256") == F.col("digest"), F.col("payload_sha256")).otherwise(F.raise_error(F.concat(F.lit("another payload is stored as "), "digest")))
    known = written(read.withColumn("digest", same).drop("payload_sha256"), "media-known")
    discard(index)
    own = rows.select(*keys, "n_bytes", "payload_bytes", "digest")
    return joined_back(own, known, "digest", "copies", rows.count()).withColumn("payload_sha256", F.col("digest"))


def op11_media_columns(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    got = with_media(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, ["doc_id"])
    return got.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "format", "width", "height", "bit_depth"
    )
