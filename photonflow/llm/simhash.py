"""SimHash fingerprints of documents and their near-duplicate groups, by pigeonhole blocks.

Every pair of fingerprints at Hamming distance ``distance`` or less agrees in at least
``blocks - distance`` of ``blocks`` bit blocks, so it meets under one of the block combinations.
More blocks give longer keys: ``plan_blocks`` takes as many as keep chance meetings rare for the
number of fingerprints. Every choice finds every link.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonflow.llm.common import cut, new_path, packed, scratch, unpacked
from photonflow.llm.graph import Judge, Settle, block_components

SEED = 42
SHINGLE = 3
DISTANCE = 3
#: Shingles hashed and counted at once, which bounds memory for very long texts.
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the lower-cased (A-Z) word shingles, repeats included.

    Words are runs of bytes other than ASCII white space. Fewer words than ``shingle``: the whole
    sequence is one shingle. Null, empty or blank text: 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[-n:] - 1).tolist()
    counts, hash64 = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        h = np.fromiter((hash64(joined[i:j], SEED) for i, j in zip(starts[at : at + CHUNK], stops[at : at + CHUNK])), np.uint64)
        counts += _bit_counts(h)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of ``h`` have each bit, lowest first: bytes of eight lanes are summed 255 rows at a time."""
    lanes = np.uint64(0x0101010101010101)
    total = np.zeros((8, 8), np.int64)
    for bit in range(8):
        spread = (h >> np.uint64(bit)) & lanes
        pad = np.zeros(-len(spread) % 255, np.uint64)
        sums = np.concatenate((spread, pad)).reshape(-1, 255).sum(axis=1, dtype=np.uint64)
        total[bit] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return total.T.reshape(64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, fp)`` for each row; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x, shingle) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())], ["id", "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "id long, fp long")


def plan_blocks(n: int, distance: int = DISTANCE) -> int:
    """Blocks for ``n`` fingerprints: the fewest that leave at most about one chance meeting a row."""
    for blocks in range(distance + 2, distance + 6):
        bits = 64 * (blocks - distance) / blocks
        if comb(blocks, distance) * n / 2**bits <= 1:
            break
    return blocks


def block_keys(fp: Column, blocks: int, distance: int = DISTANCE) -> Column:
    """An array of keys, one for each choice of ``blocks - distance`` blocks; equal keys mean equal bits there."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    keys = []
    for j, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(((1 << edges[b + 1]) - 1) ^ ((1 << edges[b]) - 1) for b in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(j), fp.bitwiseAND(F.lit(signed).cast("long"))))
    return F.array(*keys)


def within(distance: int):
    return lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= distance


def near_groups(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``prints(fp)`` -> ``(fp, component)`` for fingerprints that have a link; component: the smallest fp reached."""
    distinct = cut(prints.select("fp").where("fp is not null").distinct(), "fingerprints")
    keys = block_keys(F.col("fp"), plan_blocks(distinct.count(), distance), distance)
    rows = distinct.select(F.explode(keys).alias("k"), F.col("fp").alias("id"))
    return block_components(rows, within(distance)).withColumnRenamed("id", "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``(id, fp, component_id)``: each row with its fingerprint and the smallest id of its group.

    Copies share a fingerprint, so groups are found among distinct fingerprints and no pairs of
    copies arise. Null text is empty; rows with a null id are kept with their group's smallest id
    (null if the group has no other). Repeated rows repeat. An empty table gives no rows.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle), "prints")
    groups = near_groups(prints, distance)
    tops = prints.groupBy("fp").agg(F.min("id").alias("low")).join(groups, "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("g"))
    tops = cut(tops, "tops")
    best = tops.groupBy("g").agg(F.min("low").alias("component_id"))
    named = tops.join(best, "g").select("fp", "component_id")
    return prints.join(named, "fp").select("id", "fp", "component_id")


#: Least share of common five-word shingles.
SIMILARITY, WORDS = 0.8, 5
#: MinHashes of a text's shingles; a pair that agrees in all of one of ``CHOICES`` is a candidate.
MINHASHES = 24
CHOICES = sorted({tuple(sorted(random.Random(i).sample(range(MINHASHES), 4))) for i in range(24)})
#: Smallest shingle hashes kept to estimate similarity, whose standard error is then about .025, and how far below
#: ``SIMILARITY`` an estimate may be for the pair to be compared as a whole.
SKETCH, MARGIN = 256, 0.15
#: Constants to which MinHashes are the nearest.
NEAR = np.array([random.Random(-1 - i).getrandbits(64) for i in range(MINHASHES)], np.uint64)


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of the set of lower-cased word shingles, ascending; fewer words than ``words`` are one shingle, no words none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum([len(w) + 1 for w in parts])
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[-n:] - 1).tolist()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in zip(starts, stops)), np.uint64, n))


def min_hashes(hashes: np.ndarray) -> list[int]:
    """For each of ``NEAR`` the nearest of ``hashes``, ascending, by exclusive or; signed. No hashes: zeros."""
    if not len(hashes):
        return [0] * MINHASHES
    return np.array([hashes[np.argmin(hashes ^ c)] for c in NEAR], np.uint64).view(np.int64).tolist()


def text_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(th, fp, mins, sketch)`` of each row; ``th`` is a 64-bit hash of the text, ``fp`` its SimHash, ``sketch`` its smallest shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            hashes, fps = [shingle_hashes(t) for t in texts], np.array([fingerprint(t) for t in texts], np.uint64)
            columns = [pa.array(fps.view(np.int64)), pa.array([min_hashes(h) for h in hashes], pa.list_(pa.int64())), pa.array([h[:SKETCH].view(np.int64) for h in hashes], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["th", "fp", "mins", "sketch"])

    narrow = docs.select(F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "th long, fp long, mins array<long>, sketch array<long>")


def whole_shingles(texts: DataFrame) -> DataFrame:
    """``texts(th, text)`` -> ``(th, all)`` with every shingle hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.list_(pa.int64()))], ["th", "all"])

    return texts.mapInArrow(run, "th long, all array<long>")


def shingle_similarity(a: str, b: str, size: int | None = None) -> Column:
    """Jaccard similarity of two arrays of shingle hashes; with ``size``, its estimate from the smallest of both. 1 for two empty ones.

    Hashes are taken as unsigned for the estimate, as they were when the sketches were made.
    """
    if size is None:
        common = F.size(F.array_intersect(a, b))
        union = F.size(a) + F.size(b) - common
        return F.when(union == 0, 1.0).otherwise(common / union)
    flip = F.lit(-(1 << 63))
    unsigned = F.sort_array(F.transform(F.array_union(a, b), lambda h: h.bitwiseXOR(flip)))
    union = F.transform(F.slice(unsigned, 1, size), lambda h: h.bitwiseXOR(flip))
    return F.when(F.size(union) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(union, F.col(a)), F.col(b))) / F.size(union))


def similar_groups(features: DataFrame, texts: DataFrame, at_least: float = SIMILARITY) -> DataFrame:
    """``(id, component)`` of text hashes that are linked: SimHashes near each other or MinHashes in common, and ``at_least`` of all shingles.

    The SimHashes meet by the pigeonhole blocks of ``near_groups``, so that none within ``DISTANCE`` bits is lost; MinHashes add pairs that
    are farther apart, and all are held to the same exact check. ``texts(th, text)`` has the text of each; only those of likely pairs are read, and compared as a whole.
    """
    nodes = cut(features.groupBy("th").agg(F.any_value("fp").alias("fp"), F.any_value("mins").alias("mins"), F.max(F.size("sketch")).alias("n")), "nodes")
    keys = F.array(*(F.xxhash64(F.lit(j), *(F.get("mins", F.lit(i)) for i in c)) for j, c in enumerate(CHOICES)))
    keys = F.concat(block_keys(F.col("fp"), plan_blocks(nodes.count())), keys.cast("array<bigint>"))
    rows = nodes.where("n > 0").select(F.explode(keys).alias("k"), F.col("th").alias("id"))
    blank = nodes.where("n = 0").select(F.lit(0).cast("long").alias("k"), F.col("th").alias("id"))

    def both(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
        for end in "ab":
            pairs = pairs.join(of.select(F.col("th").alias(end), F.col(column).alias(f"s{end}")), end)
        return pairs

    def prepare(ids: DataFrame) -> tuple[Judge, Settle, None]:
        wanted = features.select("th", "sketch").join(ids.withColumnRenamed("id", "th"), "th", "left_semi")
        sketches = cut(wanted.dropDuplicates(["th"]), "sketches")  # most texts share no block: their sketches are never shuffled

        def judge(pairs: DataFrame) -> DataFrame:
            score = F.lit(1.0) - shingle_similarity("sa", "sb", SKETCH)
            scored = cut(both(pairs, sketches, "sketch").select(*pairs.columns, score.alias("score")), "scored-pairs")
            return scored.where(F.col("score") <= 1 - at_least + MARGIN)

        def settle(pairs: DataFrame) -> DataFrame:
            ends = pairs.select(F.explode(F.array("a", "b")).alias("th")).distinct()
            whole = cut(whole_shingles(texts.join(ends, "th", "left_semi")).dropDuplicates(["th"]), "whole-shingles")
            return both(pairs, whole, "all").where(shingle_similarity("sa", "sb") >= at_least).select(*pairs.columns)

        return judge, settle, None

    return block_components(rows.unionAll(blank), lambda a, b: F.lit(True), prepare, by_block=True)


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of copies and near copies, that with the smallest id; columns unchanged.

    Exact copies are one node; near copies share ``SIMILARITY`` of their five-word shingles, counted over the whole
    texts, and are found by SimHashes within ``DISTANCE`` bits, as in ``near_duplicates``, and by MinHashes of the shingles. Null text is its own text; null ids come last; repeated rows stay as
    one; an empty table gives no rows.
    """
    path = new_path(docs.sparkSession, "kept")
    with scratch(docs.sparkSession):
        first = cut(_first_of_groups(docs, id_col, text_col), "kept", path)
    keyed = packed(docs).withColumns({"th": F.xxhash64(f"row.{text_col}"), "id": F.col(f"row.{id_col}")})
    kept = keyed.join(first, (F.col("th") == F.col("_th")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    return unpacked(kept.dropDuplicates(["th", "id"]), docs.columns)


def _first_of_groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(_id, _th)``: smallest id, and its text's hash, of each group of copies and near copies."""
    features = cut(text_features(docs, text_col), "features")
    groups = similar_groups(features, docs.select(F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text")))
    keyed = docs.select(F.xxhash64(text_col).alias("th"), F.col(id_col).alias("id")).join(groups.withColumnsRenamed({"id": "th", "component": "c"}), "th", "left").withColumn("c", F.coalesce("c", "th"))
    return keyed.groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "th")).alias("r")).select(F.col("r.id").alias("_id"), F.col("r.th").alias("_th"))


def op6(docs: DataFrame) -> DataFrame:
    """Contract columns: doc_id, fingerprint (16 lowercase hex digits), component_id."""
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
