"""Result tables, and optional side-car files beside or below an output folder."""

from __future__ import annotations

import json
import os
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photonflow.schema import ERRORS, OUTPUT


#: Parts of a table by key, and segments of a part after which a commit merges them.
BUCKETS, SEGMENTS = 16, 8
#: Committed states that stay.
HISTORY = 8


class Store:
    """The tables of an enrichment: one per kind of result, keyed by ``rel_path``, under one folder.

    A commit writes only the rows that change, dealt to buckets by key, as a segment of its number; of the rows of a key the latest counts, and a
    removed one says so. It counts from the moment that the file ``log/<number>`` is whole, which names the live segments of all tables, so
    changes of several tables are seen together or not at all, and a run that dies leaves the state before it. When a bucket has many segments, a
    commit merges one; the merged ones go when the next is merged, so that readers of the state before can end. One run writes at a time: of two, the second fails.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}" if path else self.root)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _state(self) -> tuple[int, dict]:
        """(highest number that was begun, newest whole state)."""
        numbers = sorted((int(n) for n in self._names("log") if n.isdigit()), reverse=True)
        for n in numbers:
            stream = self._fs.open(self._path(f"log/{n:012d}"))
            try:
                return numbers[0], json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except ValueError:  # a run died here
                continue
            finally:
                stream.close()
        return max(numbers, default=0), {"live": {}, "old": [], "buckets": self.buckets}

    def _save(self, number: int, state: dict) -> None:
        """Create the log file ``number``; fails if there is one."""
        stream = self._fs.create(self._path(f"log/{number:012d}"), False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        for old in sorted(n for n in self._names("log") if n.isdigit())[:-HISTORY]:
            self._fs.delete(self._path(f"log/{old}"), False)

    def _write(self, table: str, rows: DataFrame, buckets: int) -> list[list]:
        """Write ``rows`` as a segment; -> [segment, bucket] of its parts."""
        segment = f"{table}/{uuid.uuid4().hex}"
        dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("rel_path"), F.lit(buckets)).cast("int"))
        dealt.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{segment}")
        return [[segment, int(n.split("=")[1])] for n in self._names(segment) if n.startswith("bucket=")]

    def _rows(self, parts: list[list], schema: T.StructType) -> DataFrame:
        """The latest row of each key in these parts, removed ones too."""
        full = T.StructType([*schema.fields, T.StructField("_gone", T.BooleanType()), T.StructField("_number", T.LongType())])
        if not parts:
            return self.spark.createDataFrame([], full)
        rows = self.spark.read.schema(full).option("recursiveFileLookup", "true").parquet(*(f"{self.root}/{segment}/bucket={b}" for segment, b in parts))
        if len({segment for segment, _ in parts}) == 1:
            return rows
        latest = rows.groupBy("rel_path").agg(F.max_by(F.struct(*(c for c in full.fieldNames() if c != "rel_path")), "_number").alias("r"))
        return latest.select("rel_path", "r.*")

    def read(self, table: str, schema: T.StructType = OUTPUT) -> DataFrame:
        return self._rows(self._state()[1]["live"].get(table, []), schema).where("not _gone").select(*schema.fieldNames())

    def commit(self, changes: dict[str, tuple[DataFrame | None, DataFrame | None, T.StructType]]) -> None:
        """For each table (rows that replace or are added, ``rel_path`` of rows that go, schema), all at once. Of rows that repeat a key one counts; a key in both stays."""
        begun, state = self._state()
        number = begun + 1
        for table, (rows, keys, schema) in changes.items():
            names = [c for c in schema.fieldNames() if c != "rel_path"]
            parts = []
            if rows is not None:
                parts.append(rows.select("rel_path", F.struct(F.lit(False).alias("_gone"), *names).alias("r")))
            if keys is not None:
                parts.append(keys.select("rel_path", F.struct(F.lit(True).alias("_gone"), *(F.lit(None).cast(schema[c].dataType).alias(c) for c in names)).alias("r")))
            one = F.min_by("r", F.struct("r._gone", F.xxhash64("r")))
            both = reduce(DataFrame.unionByName, parts).where("rel_path is not null").groupBy("rel_path").agg(one.alias("r"))
            written = self._write(table, both.select("rel_path", *(f"r.{c}" for c in names), "r._gone", F.lit(number).cast("long").alias("_number")), state["buckets"])
            state["live"].setdefault(table, []).extend(written)
        self._save(number, state)
        for table, (_, _, schema) in changes.items():
            sizes = Counter(b for _, b in state["live"][table])
            if sizes and max(sizes.values()) > SEGMENTS:
                self.compact(table, max(sizes, key=sizes.get), schema)

    def compact(self, table: str, bucket: int, schema: T.StructType = OUTPUT) -> None:
        """Merge the segments of one bucket into one without the rows that are gone; the segments that the merge before replaced are deleted."""
        begun, state = self._state()
        parts = [p for p in state["live"].get(table, []) if p[1] == bucket]
        merged = self._write(table, self._rows(parts, schema).where("not _gone"), state["buckets"])
        gone, state["old"] = state["old"], parts
        state["live"][table] = [p for p in state["live"][table] if p[1] != bucket] + merged
        self._save(begun + 1, state)
        for segment, b in gone:
            self._fs.delete(self._path(f"{segment}/bucket={b}"), True)

    def put(self, table: str, rows: DataFrame, schema: T.StructType = OUTPUT) -> None:
        """Replace or add rows by ``rel_path``."""
        self.commit({table: (rows, None, schema)})

    def drop(self, table: str, keys: DataFrame, schema: T.StructType = ERRORS) -> None:
        """Remove rows by ``rel_path``."""
        self.commit({table: (None, keys, schema)})


def write_sidecars(rows: DataFrame, output_dir: str, suffix: str, error_suffix: str) -> DataFrame:
    """Write ``rows(rel_path, text, error)`` as files; -> ``(rel_path, written, problem)``.

    A result replaces its file and removes an older error file; an error is one line in the error file. Files
    appear complete: each is written under another name and renamed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rel, text, error in zip(batch["rel_path"], batch["text"], batch["error"]):
                good, bad = f"{output_dir}/{rel}{suffix}", f"{output_dir}/{rel}{error_suffix}"
                target, body = (bad, f"{error}\n") if error is not None else (good, text or "")
                try:
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    part = f"{target}.{os.getpid()}.part"
                    with open(part, "w", encoding="utf-8", newline="") as f:
                        f.write(body)
                    os.replace(part, target)
                    if error is None and os.path.exists(bad):
                        os.remove(bad)
                    out.append((rel, target, None))
                except OSError as e:
                    out.append((rel, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["rel_path", "written", "problem"])

    return rows.select("rel_path", "text", F.col("error").cast("string").alias("error")).mapInPandas(run, "rel_path string, written string, problem string")


def read_sidecars(images: DataFrame, output_dir: str, suffix: str) -> DataFrame:
    """``(rel_path, text)`` of the side-car files that exist; an unreadable one is as good as none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rel in batch["rel_path"]:
                try:
                    with open(f"{output_dir}/{rel}{suffix}", encoding="utf-8") as f:
                        out.append((rel, f.read()))
                except (OSError, UnicodeDecodeError):
                    continue
            yield pd.DataFrame(out, columns=["rel_path", "text"])

    return images.select("rel_path").mapInPandas(run, OUTPUT)
