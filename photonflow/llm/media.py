"""Media columns: payloads as 8-bit grey images in archives, read back by a custom data source.

``write_archives`` stores one image per row in zip archives in the shared folder and returns a
manifest; only archives in the written manifest count, so a retried task leaves no double rows.
``ArchiveSource`` plans byte ranges over the archives; a task reads the archive directory, takes
the members whose header lies in its range, and reads each by its own offset with retries of its
own. Payloads stream as Arrow batches of bounded size.
"""

from __future__ import annotations

import hashlib
import re
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from photonflow.llm.common import cut, new_path

WIDTH = 64
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
#: Ranges that the driver plans at most, besides one for each archive; they grow with the archives.
MAX_RANGES = 100_000
BATCH_BYTES = 4 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + b"\0" * (-len(data) % WIDTH if data else WIDTH)


def to_image(data: bytes) -> bytes:
    """An 8-bit grey image, 64 samples wide, of the padded bytes; a private chunk keeps the unpadded length."""
    rows = np.frombuffer(pad(data), np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with its filter type, 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"nbYt", struct.pack(">Q", len(data))) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_image(image: bytes) -> tuple[bytes, int]:
    """(padded payload, unpadded length); raises on a damaged image."""
    if image[:8] != SIGNATURE:
        raise ValueError("not an image")
    at, packed, length, height = 8, [], None, 0
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            height = struct.unpack_from(">I", data, 4)[0]
        elif kind == b"nbYt":
            (length,) = struct.unpack(">Q", data)
        elif kind == b"IDAT":
            packed.append(data)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, WIDTH + 1)
    if length is None or not height:
        raise ValueError("not one of these images")
    return lines[:, 1:].tobytes(), length


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples and a 64-bit average hash over an 8 x 8 grid."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    mean = float(share @ np.arange(256))
    dev = float(np.sqrt(max(0.0, share @ (np.arange(256) - mean) ** 2)))
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    rows = x.reshape(-1, WIDTH)
    edges = np.linspace(0, len(rows), 9).astype(int)
    columns = np.add.reduceat(rows, np.arange(0, WIDTH, 8), axis=1, dtype=np.int64)
    sums = np.stack([columns[a : max(b, a + 1)].mean(axis=0) if a < len(rows) else np.zeros(8) for a, b in zip(edges[:-1], edges[1:])])
    bits = (sums.reshape(-1) > sums.mean()).astype(int)
    return f"{mean:.4f} {dev:.4f} {entropy:.4f} {int(''.join(map(str, bits)), 2):016x}"


def open_fs(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI or plain path, as Spark names it, and the path within."""
    if "://" not in path:
        path = path.replace("file:", "", 1)
        return pyarrow.fs.LocalFileSystem(), path
    return pyarrow.fs.FileSystem.from_uri(path)


def write_archives(rows: DataFrame, folder: str, manifest: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """``rows(id long, data binary)`` -> committed manifest ``(archive, bytes, members)``; null data is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        name = sink = out = None
        n = size = 0

        def close() -> pa.RecordBatch:
            nonlocal out
            out.close()
            sink.close()
            out = None
            return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "bytes": [fs.get_file_info(f"{base}/{name}").size], "members": [n]})

        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.zip", 0, 0
                    sink = fs.open_output_stream(f"{base}/{name}")
                    out = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
                image = to_image(data.as_py() or b"")
                out.writestr(zipfile.ZipInfo(f"{'null' if key is None else key}/{n}.png"), image)
                n, size = n + 1, size + len(image)
                if size >= archive_bytes:
                    yield close()
        if out is not None:
            yield close()

    return cut(rows.mapInArrow(run, "archive string, bytes long, members long"), "manifest", manifest)


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, stop: int) -> None:
        self.archive, self.start, self.stop = archive, start, stop


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").option("manifest", path).load()``

    Options: ``manifest``, a Parquet table with ``archive`` and ``bytes``; ``rangeBytes``; ``attempts``, reads of
    a member before its error is reported. One row per member; a member that stays unreadable has a null
    payload and an error, and the others are not affected.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, member string, offset long, payload binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.manifest = options["manifest"]
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))
        self.attempts = int(options.get("attempts", 3))

    def partitions(self) -> list[InputPartition]:
        """Byte ranges from names and sizes alone; archive directories are read by the tasks."""
        fs, path = open_fs(self.manifest)
        found = pyarrow.dataset.dataset(path, filesystem=fs, format="parquet", exclude_invalid_files=False).to_table(["archive", "bytes"]).to_pylist()
        size = max(self.range_bytes, -(-sum(x["bytes"] for x in found) // MAX_RANGES))
        return [ByteRange(x["archive"], at, at + size) for x in found for at in range(0, x["bytes"], size)] or [ByteRange("", 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.archive:
            return
        fs, path = open_fs(part.archive)
        names = ["archive", "member", "offset", "payload", "error"]
        rows, held = [], 0
        with fs.open_input_file(path) as f:
            members = [m for m in zipfile.ZipFile(f).infolist() if part.start <= m.header_offset < part.stop]
            for m in members:
                payload, error = self.member(f, m.header_offset, m.compress_size, m.CRC)
                rows.append((part.archive, m.filename, m.header_offset, payload, error))
                held += len(payload or b"")
                if held >= BATCH_BYTES:
                    yield self.batch(rows, names)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows, names)

    @staticmethod
    def batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def member(self, f, offset: int, size: int, crc: int) -> tuple[bytes | None, str | None]:
        """One member by its offset, tried again on its own; (bytes, None) or (None, what went wrong)."""
        error = ""
        for k in range(self.attempts):
            try:
                head = f.read_at(30, offset)
                if head[:4] != b"PK\x03\x04":
                    raise ValueError("no member header")
                data = f.read_at(size, offset + 30 + sum(struct.unpack("<HH", head[26:30])))
                if len(data) != size or zlib.crc32(data) != crc:
                    raise ValueError("damaged member")
                return data, None
            except (OSError, ValueError) as e:
                error = f"{type(e).__name__}: {e}"
                time.sleep(0.05 * k)
        return None, error


def read_archives(spark: SparkSession, manifest: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").option("manifest", manifest).option("rangeBytes", range_bytes).load()


def describe(stored: DataFrame) -> DataFrame:
    """Digests and features of stored images; an unreadable member has nulls and its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for member, image, error in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                key = member.split("/")[0]
                key = int(key) if re.fullmatch(r"-?\d{1,18}", key) else None
                image = image.as_py()
                try:
                    payload, n = (None, None) if image is None else from_image(image)
                except Exception as e:  # whatever a member holds that is no image of ours is its error
                    image, error = None, f"{type(e).__name__}: {e}"
                if image is None:
                    out.append((key, *[None] * 7, error))
                    continue
                out.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload), None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], NAMES)

    return stored.select("member", "payload", "error").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]


def op4(docs: DataFrame) -> DataFrame:
    """Contract columns and ``error``: every text stored as an image, read back and described.

    Null text is empty (64 zero bytes); repeated rows repeat; a null id stays null; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    manifest = new_path(spark, "manifest")
    write_archives(rows, new_path(spark, "archives"), manifest)
    return describe(read_archives(spark, manifest))
