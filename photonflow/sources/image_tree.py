"""Recursive directory scan as a Spark data source, for tables and for streams.

Spark's own file listing drops names that begin with ``_`` or ``.`` and matches suffixes by case; this
source keeps every regular file and follows links. The driver lists only the first levels, until there
are enough directories to share out; tasks walk what is below, an entry at a time. Directories are packed into a bounded number of partitions, and a very large
one that the driver has seen is read by several tasks, each taking the names that fall to it.
A root with a scheme (``hdfs://``, ``s3://``, ``file://``) is listed through Arrow, a directory at a time.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote
from zlib import crc32

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FIELDS = ["path", "rel_path", "dir", "name", "base", "ext", "depth", "size", "mtime", "error"]
SCHEMA = "path string, rel_path string, dir string, name string, base string, ext string, depth int, size long, mtime double, error string"
_TYPES = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.float64(), pa.string()]
#: Directories to share out at least; more than tasks, so that uneven trees are spread.
TARGET = 64
#: Partitions at most, and entries of a directory for each task that reads it.
PARTITIONS, FLAT = 1024, 200_000
BATCH = 4096


@dataclass(frozen=True)
class Entry:
    name: str
    folder: bool
    file: bool
    size: int = 0
    mtime: float = 0.0
    #: When it came to be what and where it is.
    changed: float = 0.0
    error: str | None = None


class Local:
    """Directories of a file system that all tasks mount."""

    def __init__(self, root: str) -> None:
        self.root = os.path.abspath(root)

    def path(self, rel: str) -> str:
        return f"{self.root}/{rel}" if rel else self.root

    def real(self, rel: str) -> str:
        return os.path.realpath(self.path(rel))

    def is_folder(self, rel: str) -> bool:
        return os.path.isdir(self.path(rel))

    def entries(self, rel: str, wanted) -> Iterator[Entry]:
        """What a directory holds, links followed; sizes and times only of files whose name is ``wanted``."""
        with os.scandir(self.path(rel)) as found:
            for e in found:
                if e.is_dir():
                    yield Entry(e.name, True, False)
                elif e.is_file() and wanted(e.name):
                    try:
                        info = e.stat()
                        yield Entry(e.name, False, True, info.st_size, info.st_mtime, max(info.st_mtime, info.st_ctime))
                    except OSError as x:  # gone since it was listed
                        yield Entry(e.name, False, True, error=f"{type(x).__name__}: {x}")


class Remote:
    """Directories of a store that Arrow can open."""

    def __init__(self, root: str) -> None:
        self.root = root.rstrip("/")
        self.fs, self.base = pyarrow.fs.FileSystem.from_uri(self.root)

    def path(self, rel: str) -> str:
        return f"{self.root}/{quote(rel)}" if rel else self.root

    def real(self, rel: str) -> str:
        return rel

    def is_folder(self, rel: str) -> bool:
        return self.fs.get_file_info(f"{self.base}/{rel}" if rel else self.base).type == pyarrow.fs.FileType.Directory

    def entries(self, rel: str, wanted) -> Iterator[Entry]:
        for e in self.fs.get_file_info(pyarrow.fs.FileSelector(f"{self.base}/{rel}" if rel else self.base)):
            if e.type == pyarrow.fs.FileType.Directory:
                yield Entry(e.base_name, True, False)
            elif e.type == pyarrow.fs.FileType.File and wanted(e.base_name):
                moment = e.mtime_ns / 1e9 if e.mtime_ns else 0.0
                yield Entry(e.base_name, False, True, e.size or 0, moment, moment)


@dataclass(frozen=True)
class Folder:
    """A directory, read alone or with all below; ``above`` has the real paths on the way from the root to it. Of its files, those whose names fall to ``share`` of ``shares``."""

    rel: str
    deep: bool
    above: tuple[str, ...] = ()
    share: int = 0
    shares: int = 1


class Pack(InputPartition):
    """Directories that one task reads, and the time after which and until which files must have changed."""

    def __init__(self, folders: tuple[Folder, ...], after: float = float("-inf"), until: float = float("inf")) -> None:
        self.folders, self.after, self.until = folders, after, until


class ImageTree(DataSource):
    """``spark.read.format("image_tree").option("path", root).option("extensions", ".jpg,.png").load()``

    One row per file; a directory that cannot be listed, or a root that is none, is one row with ``error``. As a stream, each
    batch has the files that are new, moved or changed since the one before.
    """

    @classmethod
    def name(cls) -> str:
        return "image_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TreeStream(self.options)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.extensions = {e.strip().lower() for e in options.get("extensions", "").split(",") if e.strip()}
        self.target, self.most, self.flat = (int(options.get(k, v)) for k, v in (("target", TARGET), ("partitions", PARTITIONS), ("flat", FLAT)))

    def tree(self) -> Local | Remote:
        return Remote(self.root) if "://" in self.root else Local(self.root)

    def partitions(self) -> list[InputPartition]:
        """Breadth first: a directory that was opened on the way is read alone, one that was not with all below."""
        tree, opened, level = self.tree(), [], [Folder("", True)]
        while level and len(opened) + len(level) < self.target:
            after = []
            for f in level:
                below, n = self.below(tree, f)
                after += below
                shares = -(-n // self.flat) or 1
                opened += [Folder(f.rel, False, f.above, i, shares) for i in range(shares)]
            level = after
        return self.packed(opened + level)

    def packed(self, folders: list[Folder]) -> list[InputPartition]:
        """At most ``most`` partitions; neighbours, which may be alike in size, are dealt to different ones."""
        n = min(len(folders), self.most)
        return [Pack(tuple(folders[i::n])) for i in range(n)]

    def below(self, tree: Local | Remote, folder: Folder) -> tuple[list[Folder], int]:
        """Sub-directories, and how many entries there are; links are followed, but not back to where the way came from."""
        above, out, n = (*folder.above, tree.real(folder.rel)), [], 0
        try:
            for e in tree.entries(folder.rel, lambda name: True):
                n += 1
                rel = f"{folder.rel}/{e.name}" if folder.rel else e.name
                if e.folder and tree.real(rel) not in above:
                    out.append(Folder(rel, True, above))
        except OSError:  # the task that reads it tells
            pass
        return sorted(out, key=lambda f: f.rel), n

    def wanted(self, name: str) -> bool:
        return not self.extensions or os.path.splitext(name)[1].lower() in self.extensions

    def read(self, part: Pack) -> Iterator[pa.RecordBatch]:
        tree, rows = self.tree(), []
        for row in self.rows(tree, part):
            rows.append(row)
            if len(rows) == BATCH:
                yield self.batch(rows)
                rows = []
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], FIELDS)

    def rows(self, tree: Local | Remote, part: Pack) -> Iterator[tuple]:
        todo = list(part.folders)
        while todo:
            folder = todo.pop()
            at = tree.path(folder.rel)
            failed = lambda path, rel, error: (path, rel, *[None] * 7, error)
            if not tree.is_folder(folder.rel):
                yield failed(at, folder.rel or ".", "not a directory")
                continue
            above = (*folder.above, tree.real(folder.rel))
            mine = lambda name: folder.shares == 1 or crc32(name.encode("utf-8", "surrogateescape")) % folder.shares == folder.share  # noqa: B023, E731
            try:
                for e in tree.entries(folder.rel, lambda name: self.wanted(name) and mine(name)):  # noqa: B023
                    rel = f"{folder.rel}/{e.name}" if folder.rel else e.name
                    if e.folder:
                        if folder.deep and tree.real(rel) not in above:
                            todo.append(Folder(rel, True, above))
                    elif e.error:
                        yield failed(tree.path(rel), rel, e.error)
                    elif part.after < e.changed <= part.until:
                        path = tree.path(rel)
                        yield (path, rel, at, e.name, *os.path.splitext(e.name), path.count("/"), e.size, e.mtime, None)
            except OSError as x:
                yield failed(at, folder.rel or ".", f"{type(x).__name__}: {x}")


class TreeStream(DataSourceStreamReader):
    """Offsets are times: a batch has the files that changed after its start and until its end. The end is ``settle`` seconds ago, for clocks that differ."""

    def __init__(self, options: dict) -> None:
        self.reader, self.settle = TreeReader(options), float(options.get("settle", 1.0))

    def initialOffset(self) -> dict:
        return {"until": 0.0}

    def latestOffset(self) -> dict:
        return {"until": round(time.time() - self.settle, 3)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after = start["until"] or float("-inf")
        return [Pack(p.folders, after, end["until"]) for p in self.reader.partitions()]

    def read(self, part: Pack) -> Iterator[pa.RecordBatch]:
        return self.reader.read(part)

    def commit(self, end: dict) -> None:
        pass


def read_tree(spark: SparkSession, root: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    spark.dataSource.register(ImageTree)
    return spark.read.format("image_tree").option("path", root).option("extensions", ",".join(extensions)).load()


def stream_tree(spark: SparkSession, root: str, extensions: tuple[str, ...] = (), settle: float = 1.0) -> DataFrame:
    """The files of a tree as a stream: all that are there, then those that are new, moved or changed."""
    spark.dataSource.register(ImageTree)
    return spark.readStream.format("image_tree").option("path", root).option("extensions", ",".join(extensions)).option("settle", settle).load()


def images_and_errors(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, directories that failed)."""
    return tree.where("error is null").drop("error"), tree.where("error is not null").select("rel_path", "error")
