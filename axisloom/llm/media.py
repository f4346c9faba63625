"""Media columns: content-addressed payloads in tar shards; rows carry digest, offset and length.

A text's payload is its UTF-8 bytes, filled up with zeros to a positive multiple of 64. It is stored losslessly as a grey
PNG image, 64 pixels of 8 bits wide: filter 0 in each row, one IDAT chunk. Each writing task puts the images that
are new to its shard into a tar file of its own in the shared folder, named by the payload's SHA-256, and returns where
they lie. A written table then cuts lineage, so that a lost executor repeats only its own shard, under another name; what a failed
attempt leaves behind is never referred to. Of a payload that several shards hold, the first place counts for all rows.

Metadata come from header-only range reads (33 bytes of an image); features from a range read of the whole image, which checks
its checksums and its digest. Reads are dealt out by stretches of shards, in the order of their offsets.

Null texts are empty texts: one row of zeros. Repeated rows and equal texts have equal values throughout. Long texts are images of
more rows; one image at a time is in memory. Files go to the folder that spark.checkpoint.dir names, through pyarrow.fs.
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

from .common import binary, bounded_batches, lookup, saved, shared_dir

WIDTH = 64
HEADER = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of a tar shard after which a task opens another; stretch of a shard that one group of reads covers.
SHARD_BYTES, STRETCH = 256 << 20, 16 << 20


def payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def picture(data: bytes) -> bytes:
    """A PNG of `data`, a positive multiple of 64 bytes."""
    rows = np.zeros((len(data) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def metadata(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first 33 bytes of a PNG."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not the header of a PNG")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def pixels(image: bytes) -> bytes:
    """The payload of a PNG as `picture` writes it."""
    width, height, _ = metadata(image[:HEADER])
    at, data = 8, []
    while at < len(image):
        (n,), kind = struct.unpack(">I", image[at : at + 4]), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk's checksum is wrong")
        data += [body] * (kind == b"IDAT")
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("a row is filtered")
    return rows[:, 1:].tobytes()


def feature(data: bytes) -> str:
    """Average hash: which of the 64 columns are brighter than the whole, as 16 hex digits."""
    grey = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    columns = grey.sum(0, dtype=np.int64)
    return np.packbits(columns * WIDTH > columns.sum()).tobytes().hex()


class _Shard:
    """A tar file that is being written."""

    def __init__(self, folder: str):
        self.name = f"{uuid.uuid4().hex}.tar"
        where, path = fs.FileSystem.from_uri(folder)
        where.create_dir(path)
        self.file, self.size, self.places = where.open_output_stream(f"{path}/{self.name}"), 0, {}

    def put(self, digest: str, image: bytes) -> tuple[str, int, int]:
        if digest not in self.places:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(image)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            for part in (head, image, bytes(-len(image) % 512)):
                self.file.write(part)
            self.places[digest] = (self.name, self.size + len(head), len(image))
            self.size += len(head) + len(image) + -len(image) % 512
        return self.places[digest]

    def close(self) -> None:
        self.file.write(bytes(1024))
        self.file.close()


def written(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, digest, shard, offset, length) of every row; the shards lie in `folder`."""
    bounded_batches(docs.sparkSession)
    names = ("doc_id", "n_bytes", "payload_bytes", "digest", "shard", "offset", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for b in batches:
            rows = []
            for id_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if shard is None or shard.size > SHARD_BYTES:
                    if shard:
                        shard.close()
                    shard = _Shard(folder)
                data = payload(text)
                digest = hashlib.sha256(data).hexdigest()
                place = shard.places.get(digest) or shard.put(digest, picture(data))
                rows.append((id_, len(text), len(data), digest, *place))
            if rows:
                yield pa.record_batch([pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names=names)
        if shard:
            shard.close()

    return docs.select(F.col("doc_id").cast("long"), binary("text").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, digest string, shard string, offset long, length long")


def places(index: DataFrame) -> DataFrame:
    """(digest, shard, offset, length): one place of each payload, dealt out for reading."""
    first = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.*")
    return first.repartition("shard", (F.col("offset") / STRETCH).cast("long")).sortWithinPartitions("shard", "offset")


class _Reader:
    def __init__(self, folder: str):
        self.where, self.path = fs.FileSystem.from_uri(folder)
        self.name, self.file = None, None

    def range(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            if self.file:
                self.file.close()
            self.name, self.file = shard, self.where.open_input_file(f"{self.path}/{shard}")
        return self.file.read_at(length, offset)


def _read(at: DataFrame, folder: str, of, more: str) -> DataFrame:
    """`at` with what `of(reader, digest, shard, offset, length)` returns."""
    bounded_batches(at.sparkSession)
    names = [x.split()[0] for x in more.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(folder)
        for b in batches:
            found = [of(reader, *x) for x in zip(*(b.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")), strict=True)]
            if found:
                yield pa.record_batch([*b.columns, *(pa.array(c) for c in zip(*found, strict=True))], names=[*b.schema.names, *names])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in at.schema.fields)
    return at.mapInArrow(run, f"{schema}, {more}")


def with_metadata(at: DataFrame, folder: str) -> DataFrame:
    """`at` with width, height and bits, of header-only range reads."""
    return _read(at, folder, lambda r, digest, shard, offset, length: metadata(r.range(shard, offset, HEADER)), "width long, height long, bits long")


def with_features(at: DataFrame, folder: str) -> DataFrame:
    """`at` with what the whole stored images tell."""
    def of(r: _Reader, digest: str, shard: str, offset: int, length: int) -> tuple:
        image = r.range(shard, offset, length)
        data = pixels(image)
        sha = hashlib.sha256(data).hexdigest()
        if sha != digest:
            raise ValueError(f"{shard} has other bytes at {offset} than it should")
        return sha, zlib.crc32(data[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), feature(data)

    return _read(at, folder, of, "payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def payloads(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256) of every row, without storing anything: what the stored payloads must give back."""
    data = binary("text")
    size = F.greatest(F.ceil(F.length(data) / WIDTH) * WIDTH, F.lit(WIDTH)).cast("long")
    padded = F.concat(data, F.unhex(F.repeat(F.lit("00"), (size - F.length(data)).cast("int"))))
    return docs.select(F.col("doc_id").cast("long"), F.length(data).cast("long").alias("n_bytes"), size.alias("payload_bytes"), F.sha2(padded, 256).alias("payload_sha256"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, width, height) of every row."""
    folder = f"{shared_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    index = saved(written(docs, folder))
    known = saved(with_features(with_metadata(places(index), folder), folder).drop("shard", "offset", "length", "bits"))
    return lookup(index.select("doc_id", "n_bytes", "payload_bytes", "digest"), known, "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")
