"""WARC archives: writing with payload revisits, and reading back by verified record chains.

Writing uses Spark's text sink: a row is one record, and the line separator is the empty lines that
end a record. Reading plans byte ranges; each task reports every place in its range that looks like
a record header, with the offset where the next record would begin. Whether a candidate is a record
is decided by pointer jumping from the start of each file: only what the chain of successors
reaches is one, so a record that stands inside a payload is never taken for one.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonflow.llm.common import cut, new_path, remove
from photonflow.llm.media import open_fs

MAGIC = b"WARC/1."
END = b"\r\n\r\n"
#: The first line of a header, and the beginning of each other one.
VERSION, VERSION_BYTES = re.compile(rb"WARC/1\.\d\r\n"), 10
FIELD, NAME_BYTES = re.compile(rb"([!#-'*+.0-9A-Z^-z|~-]+)[ \t]*:"), 256
HEADER_BYTES = 64 << 10
RANGE_BYTES = 8 << 20
READ_BYTES = 1 << 20
#: Tasks of a stage at most; each then takes several ranges.
MAX_TASKS = 50_000


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a string's UTF-8 bytes: 5 hex digits make 4 base32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(page_id, digest, n, refers_to)`` of the rows that repeat another's payload; ``n`` is its length.

    Among rows with equal payloads of ``min_bytes`` or more, those of the smallest page_id are
    responses and the others revisit it. Only ids and digests are shuffled, pre-aggregated by digest.
    """
    keyed = pages.select("page_id", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").alias("n")).where(F.col("n") >= min_bytes)
    first = keyed.groupBy("digest", "n").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1").drop("c")
    return keyed.join(first, ["digest", "n"]).where("page_id <> refers_to").select("page_id", "digest", "n", "refers_to").distinct()


def record(kind: str, page_id: Column, url: Column, digest: Column, block: Column, more: list[Column]) -> Column:
    """One record without the separator that follows it."""
    lines = [
        F.lit("WARC/1.1"),
        F.lit(f"WARC-Type: {kind}"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), page_id, F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7f]", "%20")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.lit("Content-Type: application/http; msgtype=response"),
        *more,
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a record per row of ``pages(page_id, url, payload)`` into archives under ``path``.

    The payload stays where it was scanned: only the table of revisits is joined to it, and Spark
    broadcasts that table when its size allows.
    """
    again = cut(revisits(pages, min_bytes), "revisits").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("n").alias("_n"), "refers_to")
    keyed = pages.select("page_id", "url", "payload", base32_sha1(F.col("payload")).alias("digest"))
    joined = keyed.join(again, (F.col("page_id") == F.col("_id")) & (F.col("digest") == F.col("_digest")) & (F.octet_length("payload") == F.col("_n")), "left")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    digest, key = F.col("digest"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    full = record("response", key, F.col("url"), digest, F.concat(http, F.col("payload")), [])
    refer = F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))
    short = record("revisit", key, F.col("url"), digest, http, [F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), refer])
    joined.select(F.when(F.col("refers_to").isNull(), full).otherwise(short).alias("value")).write.option("lineSep", END.decode()).text(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """``(file, size)`` of the archives under ``path``; only names and sizes pass the driver."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
    rows = [(s.getPath().toString(), s.getLen()) for s in found if s.getLen() and s.getPath().getName()[0] not in "._"]
    return spark.createDataFrame(rows, "file string, size long")


class Reader:
    """Random reads of one file through a window, so that nearby reads touch the store once."""

    def __init__(self, file: str, size: int) -> None:
        fs, path = open_fs(file)
        self.f, self.size, self.at, self.data = fs.open_input_file(path), size, 0, b""
        self.run: tuple[int, int, bool, list[tuple[int, bytes]]] = (0, -1, False, [])

    def read(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.data)):
            self.at, self.data = at, self.f.read_at(min(max(n, READ_BYTES), self.size - at), at) if at < self.size else b""
        return self.data[at - self.at : at - self.at + n]

    def find(self, what: bytes, at: int) -> int:
        """Where ``what`` stands from ``at`` on, or -1; looks where the window is, a window at a time."""
        while at < self.size:
            if not self.at <= at < self.at + len(self.data):
                self.read(at, 1)
            if (hit := self.data.find(what, at - self.at)) >= 0:
                return self.at + hit
            at = max(at + 1, self.at + len(self.data) - len(what) + 1)
            if at < self.at + len(self.data):  # the window's last bytes may begin it
                self.at, self.data = self.size, b""
        return -1

    def fields(self, at: int) -> tuple[int, bool, list[tuple[int, bytes]]]:
        """(where the header lines from ``at`` end, whether an empty line ends them, places and values of their lengths).

        The first line that is no ``name: value`` ends them (names have up to ``NAME_BYTES``). Places within the lines that were read last share
        their end, so the bytes of a file are looked at once, whatever stands in payloads.
        """
        start, stop, whole, lengths = self.run
        if not start <= at <= stop:
            start, lengths = at, []
            while True:
                first = self.read(at, min(NAME_BYTES, max(0, self.size - at)))
                name = FIELD.match(first)
                if first.startswith(b"\r\n") or not (name or (at > start and first[:1] in (b" ", b"\t"))) or (end := self.find(b"\r\n", at)) < 0:
                    break
                if name and name[1].lower() == b"content-length":
                    lengths.append((at, self.read(at + name.end(), min(end - at - name.end(), NAME_BYTES)).strip()))
                at = end + 2
            self.run = start, at, first.startswith(b"\r\n"), lengths
        return self.run[1:]

    def span(self, at: int) -> tuple[int, int] | None:
        """(block offset, successor) of a record whose header is at ``at``; None where there cannot be one."""
        line = self.read(at, min(VERSION_BYTES, self.size - at))
        if not VERSION.fullmatch(line) or self.read(at + len(line), 1) in (b" ", b"\t"):
            return None
        stop, whole, lengths = self.fields(at + len(line))
        k = bisect_left(lengths, (at, b""))
        if not whole or k == len(lengths) or not lengths[-1][1].isdigit():
            return None
        block = stop + 2
        after = block + int(lengths[-1][1]) + len(END)
        return (block, after) if after <= self.size and self.read(after - len(END), len(END)) == END else None

    def head(self, at: int) -> tuple[dict[str, str], int, int] | None:
        """(fields, block offset, successor) of a header at ``at``; None where it cannot be one."""
        if (found := self.span(at)) is None:
            return None
        raw = self.read(at, found[0] - len(END) - at).decode("utf-8", "replace")
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.split("\r\n")[1:])}, *found


def candidates(ranges: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(file, size, at, next)``: places that look like a record, each with its successor's offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                reader, source, found = Reader(file, size), Reader(file, size), []
                stop = min(start + range_bytes, size)
                for low in range(start, stop, READ_BYTES):
                    high = min(low + READ_BYTES, stop)
                    window = reader.read(low, min(high + len(MAGIC) - 1, size) - low)
                    hit = window.find(MAGIC)
                    while 0 <= hit < high - low:
                        if got := source.span(low + hit):
                            found.append((low + hit, got[1]))
                        hit = window.find(MAGIC, hit + 1)
                yield pa.RecordBatch.from_pydict({"file": pa.array([file] * len(found), pa.string()), "size": pa.array([size] * len(found), pa.int64()), "at": pa.array([a for a, _ in found], pa.int64()), "next": pa.array([b for _, b in found], pa.int64())})

    return ranges.mapInArrow(run, "file string, size long, at long, next long")


def reachable(links: DataFrame) -> DataFrame:
    """``links(file, at, next)`` -> ``(file, at)`` on the chain from offset 0, by pointer jumping.

    After round k the first 2^k records of each file are marked and ``next`` leads 2^k records on;
    a file is done when that leaves it. A chain that leads to no candidate ends there.
    """
    spark = links.sparkSession
    path = new_path(spark, "chain")
    state = cut(links.select("file", "at", F.col("next"), (F.col("at") == 0).alias("hit")), "chain", path)
    while state.where("at = 0 and next is not null").limit(1).count():
        jump = state.select("file", F.col("at").alias("next"), F.col("next").alias("after"))
        marks = state.where("hit and next is not null").select("file", F.col("next").alias("at"), F.lit(True).alias("mark")).distinct()
        moved = state.join(jump, ["file", "next"], "left").join(marks, ["file", "at"], "left")
        after = new_path(spark, "chain")
        state = cut(moved.select("file", "at", F.col("after").alias("next"), (F.col("hit") | F.col("mark").isNotNull()).alias("hit")), "chain", after)
        remove(spark, path)
        path = after
    return state.where("hit").select("file", "at")


def records(places: DataFrame) -> DataFrame:
    """``places(file, size, at)`` -> parsed records with the length and digest of the payload as stored, and the digest that is stated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, source = None, None
        for batch in batches:
            out = []
            for file, size, at in zip(*(c.to_pylist() for c in batch.columns)):
                if file != last:
                    last, source = file, Reader(file, size)
                fields, block, after = source.head(at)
                stop = after - len(END)
                skip = source.read(block, min(HEADER_BYTES, stop - block)).find(END) + len(END)
                sha, n = hashlib.sha1(), stop - block - skip
                for low in range(block + skip, stop, READ_BYTES):
                    sha.update(source.read(low, min(READ_BYTES, stop - low)))
                out.append((fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), n, base64.b32encode(sha.digest()).decode(), fields.get("warc-payload-digest", "").removeprefix("sha1:")))
            kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["id", "type", "refers", "url", "n", "digest", "stated"])

    return places.mapInArrow(run, "id string, type string, refers string, url string, n long, digest string, stated string")


def read(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, url`` of every record under ``path``.

    Length and digest are of the full payload: a revisit has those of the response that it refers to and whose digest it states.
    A file whose records do not end exactly at its size is an error.
    """
    archives = files(spark, path)
    ranges = archives.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    tasks = min(MAX_TASKS, archives.agg(F.sum(F.ceil(F.col("size") / range_bytes))).first()[0] or 1)  # stated, as the few bytes of a range's name say nothing of its work
    links = cut(candidates(ranges.repartition(tasks, F.col("file"), F.col("start")), range_bytes), "links")
    chain = links.join(reachable(links), ["file", "at"])
    ends = chain.groupBy("file").agg(F.max("next").alias("end"))
    torn = archives.join(ends, "file", "left").where("end is null or end <> size").select("file", "size", "end").limit(10).collect()
    if torn:
        raise ValueError("records do not reach the end of " + ", ".join(f"{r['file']} ({r['end']} of {r['size']} bytes)" for r in torn))
    places = chain.select("file", "size", "at")
    parts = places.repartition(tasks, F.col("file"), (F.col("at") / range_bytes).cast("long")).sortWithinPartitions("file", "at")
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    parsed = cut(records(parts).select(number("id").alias("page_id"), "type", number("refers").alias("refers_to"), "url", "n", "digest", "stated"), "records")
    source = parsed.where("type = 'response'").groupBy(F.col("page_id").alias("refers_to"), F.col("digest").alias("stated")).agg(F.max("n").alias("full_n"))
    joined = parsed.where("type = 'revisit'").join(source, ["refers_to", "stated"], "left").withColumn("full_digest", F.when(F.col("full_n").isNotNull(), F.col("stated")))
    again = joined.select("page_id", F.col("full_n").alias("payload_bytes"), F.col("full_digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to", "url")
    return parsed.where("type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "url").unionAll(again)


def op5(pages: DataFrame) -> DataFrame:
    """Contract columns: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is empty. Rows that repeat a page_id with equal html are of one type; if they differ in html, each stands for
    itself. A null page_id stays null. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("payload")), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS hx, min(page_id) OVER (PARTITION BY h) AS low FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(hx, CAST(5 * (k // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (5 * (3 - k % 4))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> low THEN low END AS refers_to
FROM d
"""
