"""Token counts: rollups by source, language and tokenizer version, kept up by signed deltas.

A batch of deltas is summed to one row per group and written once; committing it creates one empty marker
file named by the batch, which fails if it exists. So a batch counts once however often it is sent,
and a run that dies before the marker leaves nothing that counts. Totals are sums over the committed batches;
compaction folds them into a snapshot.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonflow.llm.bpe import VOCABULARY, load_ranks
from photonflow.llm.common import cut, new_path

GROUP = ["source", "lang", "tokenizer"]
VERSION = "byte_bpe_multi_50k/1"
#: Parts into which the copies of one text are split.
PARTS = 32


class Ledger:
    """Committed batches of token deltas under ``path``, on any Hadoop file system with exclusive creation."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        """What is in a folder, without hidden files."""
        path = self._hadoop(f"{self.path}/{folder}")
        return sorted(x for x in (s.getPath().getName() for s in self._fs.listStatus(path)) if x[0] not in "._") if self._fs.exists(path) else []

    def _snapshot(self) -> str | None:
        """The newest complete snapshot: totals of the batches that it names."""
        done = [x for x in self._names("snapshots") if self._fs.exists(self._hadoop(f"{self.path}/snapshots/{x}/done"))]
        return f"{self.path}/snapshots/{done[-1]}" if done else None

    def _folded(self, batches: list[str]) -> set[str]:
        """Those of ``batches`` that are in the newest snapshot."""
        base = self._snapshot()
        return {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{base}/batches").where(F.col("batch").isin(batches)).collect()} if base and batches else set()

    def committed(self) -> dict[str, str]:
        """Batch id -> where its summed deltas are, of the committed batches that no snapshot has yet.

        A marker says only that its batch is committed. A run writes its table before it creates the marker, and all tables of
        a batch say the same, so the first complete one stands for it, wherever the run that created the marker ended.
        """
        out = {}
        marked = self._names("commits")
        for batch in sorted(set(marked) - self._folded(marked)):
            done = [x for x in self._names(f"deltas/{batch}") if self._fs.exists(self._hadoop(f"{self.path}/deltas/{batch}/{x}/_SUCCESS"))]
            out[batch] = f"{self.path}/deltas/{batch}/{done[0]}"
        return out

    def _create(self, path: str) -> bool:
        """Create an empty file; False if there is one."""
        try:
            self._fs.create(self._hadoop(f"{self.path}/{path}"), False).close()
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        return True

    def apply(self, batch: str, deltas: DataFrame) -> bool:
        """Commit ``deltas(source, lang, tokenizer, docs, tokens)``; False and no change if the batch is committed already.

        The rows are pre-aggregated by group before they are shuffled. Nulls in a group column are a
        group; null numbers count as 0. A batch id must stand for the same deltas whenever it is sent.
        """
        if not re.fullmatch(r"[A-Za-z0-9][\w-]*", batch):
            raise ValueError(f"a batch id has letters, digits, _ and - only, and begins with one of the first two: {batch!r}")
        if self._fs.exists(self._hadoop(f"{self.path}/commits/{batch}")) or self._folded([batch]):
            return False
        table = f"{self.path}/deltas/{batch}/{new_path(self.spark, 'x').rsplit('-', 1)[1]}"
        cut(deltas.groupBy(*GROUP).agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")), batch, table)
        return self._create(f"commits/{batch}")

    def compact(self) -> None:
        """Fold all committed batches into one snapshot and remove their markers and tables.

        Batches are committed or compacted by one writer at a time. The snapshot counts from the moment that its last file, ``done``, exists; a run that
        ends before it leaves everything as it was, one that ends after it leaves markers that the snapshot names, which are skipped.
        """
        base, batches = self._snapshot(), sorted(self.committed())
        number = 1 + max((int(x) for x in self._names("snapshots")), default=-1)
        target = f"{self.path}/snapshots/{number:09d}"
        cut(self.totals(), "totals", f"{target}/totals")
        names = self.spark.createDataFrame([(b,) for b in batches], "batch string")
        cut(names.unionAll(self.spark.read.schema("batch string").parquet(f"{base}/batches")) if base else names, "batches", f"{target}/batches")
        self._create(f"snapshots/{number:09d}/done")
        for old in [*(f"commits/{b}" for b in self._names("commits") if b in batches), *(f"deltas/{b}" for b in batches)]:
            self._fs.delete(self._hadoop(f"{self.path}/{old}"), True)

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, docs, tokens)`` over the committed batches; groups that are down to nothing go."""
        base = self._snapshot()
        tables = sorted(self.committed().values()) + ([f"{base}/totals"] if base else [])
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        rows = self.spark.read.schema(schema).parquet(*tables) if tables else self.spark.createDataFrame([], schema)
        return rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")


def signed(rows: DataFrame, sign: int, tokens: Column) -> DataFrame:
    """Deltas that insert (1) or delete (-1) each row with ``tokens``."""
    one = F.lit(sign).cast("long")
    return rows.select("source", "lang", "tokenizer", one.alias("docs"), (one * tokens).cast("long").alias("tokens"))


def revised(rows: DataFrame, before: Column, after: Column) -> DataFrame:
    """Deltas that replace each row's count: the old one is taken back and the new one put in."""
    return signed(rows, -1, before).unionAll(signed(rows, 1, after))


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of ``docs`` and ``n_tokens`` of its text; null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={})
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t.as_py() or "")) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts, pa.int64())], [*keep, "n_tokens"])

    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(run, f"{schema}, n_tokens long")


def op9(docs: DataFrame) -> DataFrame:
    """source, lang, tokenizer, n_docs, n_tokens after three batches, the second sent twice.

    ``load`` inserts every document with an estimate (a quarter of its bytes, rounded up); ``recount``
    replaces estimates by counts of the tokenizer; ``copies`` deletes every row whose text a row with a
    smaller doc_id has (rows that repeat an id count as often as they occur; a null id or text is no copy).
    """
    import public_tokenizers

    estimate = F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / 4).cast("long")
    named = docs.withColumns({"estimate": estimate, "digest": F.md5("text"), "tokenizer": F.lit(VERSION)})
    keep = ["doc_id", "source", "lang", "tokenizer", "estimate", "digest"]
    counted = cut(count_tokens(named, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep), "counted")
    ledger = Ledger(docs.sparkSession, new_path(docs.sparkSession, "ledger"))
    ledger.apply("load", signed(counted, 1, F.col("estimate")))
    recount = revised(counted, F.col("estimate"), F.col("n_tokens"))
    ledger.apply("recount", recount)
    first = counted.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    parts = first.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))  # a text with many copies is met in many tasks
    copies = counted.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")).join(parts, ["digest", "part"]).where("doc_id > first")
    ledger.apply("copies", signed(copies, -1, F.col("n_tokens")))
    ledger.apply("recount", recount)
    return ledger.totals().withColumnsRenamed({"docs": "n_docs", "tokens": "n_tokens"})
