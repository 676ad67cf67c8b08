"""Media columns: content-addressed PNG payloads in tar shards.

A text becomes UTF-8 bytes, padded with bytes 0 to a positive multiple of 64, and these
bytes become the samples of an 8-bit greyscale PNG, 64 pixels wide, whose name in the
shard is the SHA-256 of the samples. Tasks append to tar shards of their own in the
shared folder and roll over to a new one at ``shard_bytes``. Over all shards a payload is stored once: hashes alone are
shuffled to see which texts repeat; a text that doesn't is stored where it lies, and of the others one copy is moved to the task
that stores it. Rows carry digest, shard, offset and length, so a reader needs one
range read for the header (33 bytes) and one for the payload, never the whole shard.

Recovery: a shard is written under a temporary name and renamed when it is complete,
and its name is unique to the attempt. Addresses are a written table, made from the
attempts that Spark committed; what a lost attempt left behind has no row there.

Nulls and ties: a null text counts as an empty one (64 bytes 0). Repeated rows and equal
texts get equal digests and features; ids may be null or repeated. Very long texts are one payload of any
size, which one task holds. An empty table gives an empty manifest. Columns other than the kept ones are not carried along;
those may have any names but the ones of the result.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_table, map_rows, new_path, open_fs, slices, text_or_empty, with_fields, written

WIDTH = 64
#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(samples: bytes, level: int = 9) -> bytes:
    """samples: a positive multiple of 64 bytes."""
    lines = np.zeros((len(samples) // WIDTH, WIDTH + 1), np.uint8)  # each line begins with its filter, 0
    lines[:, 1:] = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth, colour type."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIBB", head[16:26])


def from_png(stored: bytes) -> bytes:
    """The samples of a PNG that to_png made."""
    width, height, depth, colour = png_header(stored)
    if (width, depth, colour) != (WIDTH, 8, 0):
        raise ValueError("not an 8-bit grey PNG of 64 columns")
    at, packed = 8, []
    while at < len(stored):
        size, kind = struct.unpack(">I4s", stored[at : at + 8])
        if kind == b"IDAT":
            packed.append(stored[at + 8 : at + 8 + size])
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("lines with a filter")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Height, mean sample, and a hash with a bit per column that is brighter than the mean column."""
    pixels = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    columns = pixels.sum(0, dtype=np.int64)
    total = int(columns.sum())
    bits = np.packbits(columns * WIDTH > total).tobytes().hex()
    return f"{WIDTH}x{len(pixels)} mean {total / pixels.size:.6f} columns {bits}"


class _Shards:
    """Tar shards of one task."""

    def __init__(self, root: str, shard_bytes: int):
        self.fs, self.path = open_fs(root)
        self.fs.create_dir(self.path, recursive=True)
        self.limit, self.out = shard_bytes, None

    def put(self, digest: str, body: bytes) -> tuple[str, int, int]:
        """Shard, offset and length of a payload in its stored form."""
        if self.out is not None and self.at >= self.limit:
            self.close()
        if self.out is None:
            self.name, self.at = f"shard-{uuid.uuid4().hex}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.path}/_{self.name}")
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(body)
        block = info.tobuf(tarfile.USTAR_FORMAT) + body + bytes(-len(body) % 512)
        self.out.write(block)
        where = (self.name, self.at + 512, len(body))
        self.at += len(block)
        return where

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.fs.move(f"{self.path}/_{self.name}", f"{self.path}/{self.name}")
            self.out = None


ADDRESS = "digest string, shard string, offset long, length long, n_bytes long"


def _stored(rows: DataFrame, root: str, keep: list[str], shard_bytes: int, once: bool) -> DataFrame:
    """keep and the address of each row's text (column __text); once: a task stores equal texts, which stand together, once."""
    schema = with_fields(rows, keep, ADDRESS)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, shards, last = to_arrow_schema(schema), _Shards(root, shard_bytes), None
        for batch in (part for whole in batches for part in slices(whole)):
            found, left = [], []
            for i, value in enumerate(batch.column("__text")):
                raw = value.as_py().encode()
                samples = padded(raw)
                digest = hashlib.sha256(samples).hexdigest()
                if once and digest == last:
                    continue
                last = digest
                left.append(i)
                found.append((digest, *shards.put(digest, to_png(samples)), len(raw)))
            if found:
                own = batch.take(pa.array(left))
                new = [pa.array(x, type=arrow.field(len(keep) + i).type) for i, x in enumerate(zip(*found, strict=True))]
                yield pa.RecordBatch.from_arrays([*(own.column(k).cast(arrow.field(k).type) for k in keep), *new], schema=arrow)
        shards.close()

    return written(rows.select(*keep, "__text").mapInArrow(run, schema), "media-addresses")


def _first_of_each(rows: DataFrame) -> DataFrame:
    """Leaves out texts (__text, __hash) whose hash the task has had among its last ones."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            keep = []
            for h in batch.column("__hash").to_pylist():
                keep.append(h not in seen)
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(h)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def digest_of(text: Column) -> Column:
    """The digest of a text's padded payload, in the JVM."""
    raw = F.encode(text, "UTF-8")
    missing = F.when(F.octet_length(raw) == 0, WIDTH).otherwise(F.pmod(-F.octet_length(raw), F.lit(WIDTH)))
    return F.sha2(F.concat(raw, F.unhex(F.repeat(F.lit("00"), missing))), 256)


def store(docs: DataFrame, root: str, keep: list[str], text: str = "text", shard_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Writes the payloads below root. Gives (keep and address of rows whose text doesn't repeat; the addresses of
    texts that do; keep and digest of their rows). Two texts with one 64-bit hash only take the way of those that repeat."""
    body = text_or_empty(text)
    rows = docs.select(*keep, body.alias("__text"), F.xxhash64(body).alias("__hash"))
    hashes = docs.select(F.xxhash64(body).alias("__hash")).groupBy("__hash").agg(F.count(F.lit(1)).alias("n"))
    again = written(hashes.where("n > 1").select("__hash", F.lit(True).alias("__again")), "media-again")
    rows = join_table(rows, again, ["__hash"])
    single = _stored(rows.where("__again is null"), root, keep, shard_bytes, False)
    repeated = rows.where("__again")
    one = _first_of_each(repeated.select("__text", "__hash")).withColumn("digest", digest_of(F.col("__text")))
    one = one.repartition("digest").sortWithinPartitions("digest").select("__text")
    shared = _stored(one, root, [], shard_bytes, True)
    return single, shared, repeated.select(*keep, digest_of(F.col("__text")).alias("digest"))


def manifest_of(single: DataFrame, shared: DataFrame, repeated: DataFrame) -> DataFrame:
    """One row per document: what single has, for all rows."""
    return single.unionByName(join_table(repeated, shared, ["digest"], "inner").select(single.columns))


class _Reader:
    """Range reads from shards, one open at a time."""

    def __init__(self, root: str):
        self.fs, self.path = open_fs(root)
        self.name = self.file = None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = shard, self.fs.open_input_file(f"{self.path}/{shard}")
        return self.file.read_at(length, offset)


def with_headers(manifest: DataFrame, root: str) -> DataFrame:
    """Adds width and height, by reads of the first 33 bytes of each payload."""

    def make():
        reader = _Reader(root)

        def step(batch):
            heads = [png_header(reader.read(s, o, HEADER_BYTES)) for s, o in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), strict=True)]
            return {"width": [h[0] for h in heads], "height": [h[1] for h in heads]}

        return step

    return map_rows(manifest, with_fields(manifest, manifest.columns, "width int, height int"), make)


def with_features(manifest: DataFrame, root: str) -> DataFrame:
    """Adds what is computed from the stored bytes: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def make():
        reader = _Reader(root)

        def values(key):
            stored = reader.read(*key)
            samples = from_png(stored)
            return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples)

        def step(batch):
            keys = zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True)
            found = [values(k) for k in keys]
            return dict(zip(("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"), map(list, zip(*found, strict=True)), strict=True))

        return step

    extra = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_rows(manifest, with_fields(manifest, manifest.columns, extra), make)


def media_table(docs: DataFrame, keep: list[str], text: str = "text", root: str | None = None) -> DataFrame:
    """Stores every text and reads it back, each payload once: a manifest with header and feature columns."""
    root = root or new_path(docs.sparkSession, "media")
    single, shared, repeated = store(docs, root, keep, text)
    read = lambda addresses: with_features(with_headers(addresses, root), root)
    return manifest_of(read(single), written(read(shared), "media-shared"), repeated)


def members(shard: bytes) -> dict[str, bytes]:
    """All files of a shard, by name."""
    with tarfile.open(fileobj=io.BytesIO(shard)) as tar:
        return {m.name: tar.extractfile(m).read() for m in tar}
