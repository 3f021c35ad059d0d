"""Importance resampling towards a target distribution by hashed word n-grams.

Every feature, a word or two words in a row, has a bucket by its CRC. Each task reads its texts into a trie of words, whose nodes have counts and
the state of their CRC, from which that of the words below goes on. Counts are added up into bucket totals, and Spark sums those of all tasks. What a feature says for the target against the corpus,
its gain, is a number for each bucket. A document's weight is the mean gain along its paths; its score adds Gumbel noise, so that the highest
scores are a draw without replacement.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from photonflow.llm.common import cut

BUCKETS = 10_000
#: What the bytes of a UTF-8 text become: letters and digits of ASCII and everything beyond it stand, A-Z in lower case; the rest parts words.
LOWER = bytes(c if chr(c).isdigit() or chr(c).islower() or c >= 0x80 else c + 32 if chr(c).isupper() else 32 for c in range(256))
#: Distinct words after which a trie is begun anew, words that it reads at once, and bytes after which a text is cut.
NODES, LOT, PIECE = 1_000_000, 500_000, 1 << 20
SEED, PERCENT, LEAST_WORDS = 7, 25, 20


def crc_steps() -> np.ndarray:
    """What a byte that leaves a CRC register does to it."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, steps >> 1 ^ np.uint32(0xEDB88320), steps >> 1).astype(np.uint32)
    return steps


STEPS = crc_steps()


def extended(states: np.ndarray, crcs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRCs of texts with the CRCs ``states``, each followed by one of ``sizes`` bytes with the CRC ``crcs``: the state is moved past as many zeros."""
    out = states.copy()
    for k in range(int(sizes.max(initial=0))):
        more = sizes > k
        out[more] = STEPS[out[more] & 255] ^ out[more] >> 8
    return out ^ crcs


def pieces(text: bytes | None, size: int = PIECE) -> Iterator[tuple[list[bytes], bool]]:
    """The words of a text, of which only A-Z are lower-cased, cut every ``size`` bytes between words. True: begins with the last word of the piece before."""
    low, at, last = (text or b"").translate(LOWER), 0, None
    while at < len(low):
        end = low.find(b" ", at + size)
        found = low[at : end if end >= 0 else len(low)].split()
        if found:
            yield ([last, *found] if last else found), last is not None
            last = found[-1]
        at = end if end >= 0 else len(low)


class Words(dict):
    """Numbers of words, in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Trie:
    """Words, and the words that followed each, as arrays.

    The first level has a node for each word, with its CRC; the second, made for each lot of texts, a node for each word that
    followed another, in the order of both, with its count and its CRC, which goes on from the state of the node above.
    """

    def __init__(self, most: int = NODES) -> None:
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.words, self.crcs, self.states, self.sizes = Words(), np.empty(0, np.uint32), np.empty(0, np.uint32), np.empty(0, np.int64)

    def read(self, lot: list[tuple[list[bytes], bool]]) -> None:
        """Sets ``ids`` (the first-level node of each word of the lot), ``ends`` (where each piece ends), ``own`` (words that do not repeat the piece before),
        ``paired`` (words with one after them), ``place`` (the second-level node of each of those), ``times`` and ``pair_crcs`` (of each such node)."""
        if len(self.words) > self.most:
            self.forget()
        known = len(self.words)
        self.ids = np.fromiter(chain.from_iterable(map(self.words.__getitem__, found) for found, _ in lot), np.int64)
        new = list(islice(self.words, known, None))
        crcs, sizes = np.fromiter(map(crc32, new), np.uint32), np.fromiter(map(len, new), np.int64)
        space = extended(crcs, np.full(len(new), crc32(b" "), np.uint32), np.ones(len(new), np.int64))
        self.crcs, self.states, self.sizes = (np.concatenate(x) for x in ((self.crcs, crcs), (self.states, space), (self.sizes, sizes)))
        self.ends = np.cumsum([len(found) for found, _ in lot])
        self.own = np.ones(len(self.ids), bool)
        self.own[[end - len(found) for end, (found, again) in zip(self.ends, lot) if again]] = False
        self.paired = np.ones(len(self.ids), bool)
        self.paired[self.ends - 1] = False
        at = np.flatnonzero(self.paired)
        nodes, self.place, self.times = np.unique(self.ids[at] << 32 | self.ids[at + 1], return_inverse=True, return_counts=True)
        above, word = nodes >> 32, nodes & 0xFFFFFFFF
        self.pair_crcs = extended(self.states[above], self.crcs[word], self.sizes[word])

    def counts(self, buckets: int) -> np.ndarray:
        """How many features of the lot each bucket has."""
        words = np.bincount(self.crcs[self.ids[self.own]] % buckets, minlength=buckets)
        return words + np.bincount(self.pair_crcs % buckets, self.times, buckets).astype(np.int64)

    def sums(self, gains: np.ndarray) -> np.ndarray:
        """The gains on the paths of each piece, added up."""
        path = np.where(self.own, gains[self.crcs % len(gains)][self.ids], 0)
        path[self.paired] += gains[self.pair_crcs % len(gains)][self.place]
        return np.diff(np.concatenate([[0], np.cumsum(path)])[np.concatenate([[0], self.ends])])


def lots(texts: Iterator[bytes | None], words: int, size: int) -> Iterator[tuple[list[int], list[tuple[list[bytes], bool]]]]:
    """Pieces of the texts, some ``words`` words at a time, and the number of the text that each is of."""
    of, lot, n = [], [], 0
    for k, text in enumerate(texts):
        for piece in pieces(text, size):
            of.append(k)
            lot.append(piece)
            n += len(piece[0])
            if n >= words:
                yield of, lot
                of, lot, n = [], [], 0
    if lot:
        yield of, lot


def bucket_totals(docs: DataFrame, buckets: int = BUCKETS, nodes: int = NODES, lot: int = LOT, piece: int = PIECE) -> DataFrame:
    """``(bucket, n)`` of the features of ``text``; null texts have none. A task sends at most one row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, totals = Trie(nodes), np.zeros(buckets, np.int64)
        for _, some in lots((text.as_py() for batch in batches for text in batch.column(0)), lot, piece):
            trie.read(some)
            totals += trie.counts(buckets)
        (some,) = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(totals[some])], ["bucket", "n"])

    rows = docs.select(F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """A thousand times the log of the target's smoothed share of each bucket over the corpus's, floored."""
    s, t = sum(corpus.values()), sum(target.values())
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * (s + buckets) / ((corpus.get(b, 0) + 1) * (t + buckets)))) for b in range(buckets)]


def noise(doc_id: int, seed: int = SEED) -> int:
    """A thousand times a Gumbel variate that follows from the id, floored."""
    h = int(sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, table: list[int], seed: int = SEED, nodes: int = NODES, lot: int = LOT, piece: int = PIECE) -> DataFrame:
    """doc_id, n_features, weight, score and n_words of every row by the gains in ``table``; a null id has no score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, by_bucket = Trie(nodes), np.array(table, np.int64)
        for batch in batches:
            total, n_words = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for of, some in lots((text.as_py() for text in batch.column(1)), lot, piece):
                trie.read(some)
                np.add.at(total, of, trie.sums(by_bucket))
                np.add.at(n_words, of, [len(found) - again for found, again in some])
            n = np.maximum(0, 2 * n_words - 1)
            weight = total // np.maximum(1, n)
            score = [None if doc_id is None else w + noise(doc_id, seed) for doc_id, w in zip(batch.column(0).to_pylist(), weight.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(weight), pa.array(score, pa.int64()), pa.array(n_words)], ["doc_id", "n_features", "weight", "score", "n_words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_features long, weight long, score long, n_words long")


def drawn(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (written) with ``rank`` of the highest scores, as many as ``percent`` of the rows that have enough words.

    Rows are ranked by ranges of (score, doc_id), of each of which the driver sees a count; ranges that begin beyond the last drawn
    row are not sorted.
    """
    spark = scored.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fit = scored.where((F.col("n_words") >= least_words) & F.col("score").isNotNull())
    wanted = percent * fit.count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc(), F.col("n_features").asc(), F.col("weight").asc()]
    runs = cut(fit.repartitionByRange(parts, *order, F.rand(1)).withColumn("_run", F.spark_partition_id()), "score-runs")
    before, offsets = 0, []
    for r in runs.groupBy("_run").count().orderBy("_run").collect():
        offsets.append((r["_run"], before))
        before += r["count"]
    offsets = [(run, at) for run, at in offsets if at < wanted]
    base = spark.createDataFrame(offsets, "_run int, _before long")
    placed = runs.join(F.broadcast(base), "_run").withColumn("rank", F.col("_before") + F.row_number().over(W.partitionBy("_run").orderBy(*order)))
    same = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where((F.col("n_words") < least_words) | F.col("score").isNull()).withColumn("rank", F.lit(None).cast("long"))
    late = runs.join(F.broadcast(base), "_run", "left_anti").withColumn("rank", F.lit(None).cast("long"))
    top = placed.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")).cast("long"))
    return top.select(*same, "rank").unionAll(late.select(*same, "rank")).unionAll(rest.select(*same, "rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, buckets: int = BUCKETS, seed: int = SEED, **sizes: int) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs(doc_id, text)``; rank is null for rows that are not drawn.

    ``target(text)`` has the distribution that is wanted. Null and empty texts have no features and weight 0; an empty
    target or corpus counts nothing and gains are those of the smoothing alone. Rows that repeat an id are documents of their own with the same noise. A null id
    has no score, is never drawn and does not count among those of which a share is drawn. Other columns have no part.
    """
    corpus, wanted = ({r["bucket"]: r["n"] for r in bucket_totals(d, buckets, **sizes).collect()} for d in (docs, target))  # at most ``buckets`` rows
    return drawn(cut(weighed(docs, gains(corpus, wanted, buckets), seed, **sizes), "scores"), percent)


def op13(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``resample`` of ``documents`` towards the texts of ``benchmark``: a quarter of the documents of at least 20 words."""
    return resample(docs, benchmark)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen(f) + 1), lambda i: ('0x' || substr(x, (2 * i - 1)::int, 2))::bigint)),
  lambda a, b: xor(crcs[(xor(a, b) & 255) + 1], a >> 8)), 4294967295::bigint)"""

ORACLE = rf"""
with crc_table as (select list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end) order by i) as crcs from range(256) t(i)),
texts as (select row_number() over () as k, doc_id, true as doc, {_WORDS} as w from documents union all select null, null, false, {_WORDS} from benchmark),
found as (
  select k, doc, unnest(w) as f from texts
  union all select k, doc, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from texts where len(w) > 1),
counted as (select k, doc, f, count(*) as n from found group by all),
hashed as (select f, {_CRC} % 10000 as bucket from (select distinct f, hex(encode(f)) as x from counted) cross join crc_table),
totals as (select bucket, coalesce(sum(n) filter (doc), 0) as s, coalesce(sum(n) filter (not doc), 0) as t from counted join hashed using (f) group by bucket),
sums as (select sum(s) as s_all, sum(t) as t_all from totals),
gain as (select bucket, floor(1000 * ln(((t + 1) * (s_all + 10000))::double / ((s + 1) * (t_all + 10000))::double))::bigint as gain from totals cross join sums),
sized as (select k, sum(n) as n_features, floor(sum(n * gain)::double / sum(n))::bigint as weight from counted join hashed using (f) join gain using (bucket) where doc group by k),
scored as (
  select k, doc_id, len(w) as words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::bigint + 0.5) / 4294967296)))::bigint as score
  from texts left join sized using (k) where doc),
ranked as (select *, row_number() over (partition by words >= 20 and score is not null order by score desc, doc_id, n_features, weight) as place, count(*) over (partition by words >= 20 and score is not null) as n from scored)
select doc_id, n_features, weight, score, case when words >= 20 and score is not null and place <= 25 * n // 100 then place end as rank from ranked
"""
