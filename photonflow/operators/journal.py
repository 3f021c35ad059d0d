"""Answers of services, kept as they come, so that a run can be followed, stopped and gone on with.

Each partition asks for its rows with one client and writes what is answered to files of a shared folder every few rows or seconds. What is in the folder
counts: a task that is tried again asks only the rest, a run that is stopped keeps its answers, and the run after finds them. The names
of the files tell how many rows were done and failed, which is what the status line is made of.
"""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

#: Rows of a file, and seconds after which one is written anyway.
FILE_ROWS, FILE_SECONDS = 200, 5.0
_NAME = re.compile(r"\d+-[0-9a-f]+-(\d+)d(\d+)f\.parquet")

#: Answers one row, and ends the client. Rows that fail are answers with an error.
Client = tuple[Callable[[dict], tuple], Callable[[], None]]


@dataclass
class Watch:
    """How a run is followed and stopped: ``interval`` seconds between status lines (none without), ``verbose`` names what was last done; setting ``stop`` ends the run, its answers so far are kept."""

    interval: float | None = None
    verbose: bool = False
    say: Callable[[str], None] = print
    stop: threading.Event = field(default_factory=threading.Event)


def counters(done: int, failed: int = 0, rejected: int = 0) -> str:
    """``[nF][nR]nD``, as ``stats_line`` for stages with one output for each item."""
    return "".join(f"{n}{mark}" for n, mark in ((failed, "F"), (rejected, "R")) if n) + f"{done}D"


class Journal:
    """The files of one stage under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path(folder)
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        """Whole files, in the order in which they were written."""
        found = self._fs.listStatus(self._path) if self._fs.exists(self._path) else []
        return [n for _, n in sorted((s.getModificationTime(), s.getPath().getName()) for s in found) if _NAME.fullmatch(n)]

    def read(self, schema: str) -> DataFrame:
        names = self.names()
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{n}" for n in names)) if names else self.spark.createDataFrame([], schema)

    def clear(self) -> None:
        self._fs.delete(self._path, True)


def progress(names: list[str]) -> tuple[int, int]:
    """(done, failed) of files with these names."""
    counts = [tuple(map(int, m.groups())) for m in map(_NAME.fullmatch, names) if m]
    return sum(d for d, _ in counts), sum(f for _, f in counts)


def ask(rows: DataFrame, journal: Journal, schema: pa.Schema, key: list[str], open_client: Callable[[], Client], in_flight: int = 1) -> None:
    """Answer ``rows``, one client for each partition, with up to ``in_flight`` requests open at a time; answers are written in the rows' order.

    ``schema`` is that of the answers; its last field is the error. A row whose ``key`` has an answer in a file of its partition is not asked again.
    """
    folder = journal.folder
    journal._fs.mkdirs(journal._path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        mine = f"{TaskContext.get().partitionId():06d}-"
        files = [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(path)) if f.base_name.startswith(mine)]
        known = {tuple(r.values()) for f in files for r in pq.read_table(f, columns=key, filesystem=fs).to_pylist()}
        call, close = open_client()
        out, began = [], time.monotonic()

        def save() -> None:
            nonlocal out, began
            if out:
                failed = sum(a[-1] is not None for a in out)
                name = f"{mine}{uuid.uuid4().hex}-{len(out) - failed}d{failed}f.parquet"
                table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                pq.write_table(table, f"{path}/_{name}", filesystem=fs)
                fs.move(f"{path}/_{name}", f"{path}/{name}")
            out, began = [], time.monotonic()

        waiting: deque = deque()
        try:
            with ThreadPoolExecutor(in_flight) as pool:
                for batch in batches:
                    for row in batch.to_pylist():
                        if tuple(row[k] for k in key) in known:
                            continue
                        waiting.append(pool.submit(call, row))
                        if len(waiting) >= in_flight:
                            out.append(waiting.popleft().result())
                        if len(out) >= FILE_ROWS or time.monotonic() - began >= FILE_SECONDS:
                            save()
                out += [w.result() for w in waiting]
                save()
        finally:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], ["n"])

    rows.mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


@contextmanager
def followed(spark: SparkSession, name: str, journal: Journal, watch: Watch, shown: Callable[[dict], str]) -> Iterator[None]:
    """Status lines while the jobs inside run. A stop, or an interrupt of the driver, cancels them and goes on after; other errors are raised."""
    tag, over, lock = f"photonflow-{uuid.uuid4().hex}", threading.Event(), threading.Lock()
    sc, seen = spark.sparkContext, set(journal.names())

    def tell() -> None:
        names = journal.names()
        new = [n for n in names if n not in seen]
        seen.update(new)
        line = f"[{datetime.now():%Y-%m-%d %H:%M:%S}] {name}: {counters(*progress(new))} now, {counters(*progress(names))} in all"
        if watch.verbose and new:
            fs, path = pyarrow.fs.FileSystem.from_uri(f"{journal.folder}/{new[-1]}")
            line += "\n  " + shown(pq.read_table(path, filesystem=fs).to_pylist()[-1])
        watch.say(line)

    def look() -> None:
        last = time.monotonic()
        while not over.wait(0.2):
            if watch.stop.is_set():
                sc.cancelJobsWithTag(tag)
            if watch.interval and time.monotonic() - last >= watch.interval:
                with lock:
                    tell()
                last = time.monotonic()

    thread = threading.Thread(target=look, daemon=True)
    sc.addJobTag(tag)
    thread.start()
    try:
        yield
    except KeyboardInterrupt:
        watch.stop.set()
        sc.cancelJobsWithTag(tag)
    except Exception:
        if not watch.stop.is_set():
            raise
    finally:
        over.set()
        thread.join()
        sc.removeJobTag(tag)
        if watch.interval:
            with lock:
                tell()
