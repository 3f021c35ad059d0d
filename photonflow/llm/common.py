"""Shared pieces of the training-data operators: the shared folder, lineage cuts and text helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a folder of our own only where unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="photonflow-"))
        base = f"file://{_own_dir[0]}"
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; each call gives another."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (paths := _scratch.get()) is not None:
        paths.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables at paths made inside are deleted at the end; what is to stay is cut inside, to a path made before."""
    token = _scratch.set([])
    try:
        yield
    finally:
        for path in _scratch.get():
            remove(spark, path)
        _scratch.reset(token)


def cut(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later stages do not recompute it, and lost executors cost nothing."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more, on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Rows of a table (a few longs each) that may be broadcast after they were counted.
BROADCAST_ROWS = 250_000


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """A hint to broadcast where ``rows``, counted before, are few; else the join is left to shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame) -> DataFrame:
    """All columns as one struct ``row``, so that what an operator adds cannot clash with a name that the table has."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of ``row``, those in ``changed`` replaced."""
    return df.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns))
