"""Byte-level BPE over a distinct-word shuffle, and its inverse by the token-byte table.

1. ``split``: each task cuts its texts into pre-tokens, block by block (about ``BLOCK_BYTES`` of
   text). A block keeps every document as numbers of the block's distinct words, in order, in a file
   of the shared folder, and deals those words into buckets by hash.
2. ``encode``: words are shuffled by bucket, so all occurrences of a word meet in one task and each
   distinct word is encoded once there; its ids go back to the blocks.
3. ``join``: the task that gets a block's word ids opens the block's file and puts documents together
   by position; decoding looks up the token-byte table. The positions themselves are never shuffled.

A word comes at most once from a block, so no word is hot, however often it occurs.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonflow.llm.common import cut, new_path
from photonflow.llm.media import open_fs

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BLOCK_BYTES = 24 << 20
#: A cached distinct word costs about 150 bytes; beyond this many the cache starts anew.
CACHE_WORDS = 1_000_000


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id, as listed in a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE of one pre-token: join the neighbours of lowest rank, leftmost first, until none is joinable.

    A heap of candidate pairs over a linked list keeps very long pre-tokens at n log n.
    """
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    if n < 64:
        parts = [word[i : i + 1] for i in range(n)]
        while len(parts) > 1:
            at, best = -1, None
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    at, best = i, r
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]
    import heapq

    start, stop = list(range(n)), list(range(1, n + 1))
    after, before, live = list(range(1, n)) + [-1], [-1, *range(n - 1)], [True] * n

    def rank(i: int):
        j = after[i]
        return None if j < 0 else ranks.get(word[start[i] : stop[j]])

    heap = [(r, i, stop[i], stop[after[i]]) for i in range(n - 1) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, mid, end = heapq.heappop(heap)
        if not live[i] or after[i] < 0 or stop[i] != mid or stop[after[i]] != end:
            continue
        j = after[i]
        stop[i], after[i], live[j] = stop[j], after[j], False
        if after[i] >= 0:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (x := rank(k)) is not None:
                heapq.heappush(heap, (x, k, stop[k], stop[after[k]]))
    out, i = [], 0
    while i >= 0:
        out.append(ranks[word[start[i] : stop[i]]])
        i = after[i]
    return out


def _pack(numbers: np.ndarray, parts: list[bytes]) -> bytes:
    """Increasing numbers and as many byte strings, compressed."""
    lengths = np.fromiter(map(len, parts), np.uint32, len(parts))
    gaps = np.diff(numbers, prepend=np.uint32(0)).astype(np.uint32)
    return zstandard.compress(np.uint32(len(parts)).tobytes() + _planes(gaps) + _planes(lengths) + b"".join(parts))


def _unpack(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    at = 4 + 8 * n
    ends = np.cumsum(_unplanes(raw[4 + 4 * n : at]), dtype=np.int64) + at
    starts = np.concatenate(([at], ends[:-1])) if n else ends
    return np.cumsum(_unplanes(raw[4 : 4 + 4 * n]), dtype=np.int64), [raw[i:j] for i, j in zip(starts.tolist(), ends.tolist())]


def _planes(x: np.ndarray) -> bytes:
    """The numbers' lowest bytes, then the next ones: near-constant high bytes compress to nothing."""
    return x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view(np.uint32).reshape(-1)


def split(docs: DataFrame, folder: str, id_col: str, text_col: str, pattern: str, buckets: int) -> DataFrame:
    """Rows of a block: kind 0, one per bucket: its distinct words and their numbers; kind 1: the block's file.

    The file in ``folder`` holds every document of the block as numbers of words in order. Its name is
    new for each attempt of a task, so only files named in the written table count. ``id`` is the
    block's number of distinct words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, serial = TaskContext.get().partitionId(), 0
        find = regex.compile(pattern).findall
        fs, base = open_fs(folder)
        ids, spots, held, words = [], [], 0, defaultdict(count().__next__)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, spots, held, words, serial
            if not ids:
                return
            block, name = (part << 32) | serial, uuid.uuid4().hex
            with fs.open_output_stream(f"{base}/{name}") as sink, pa.ipc.new_stream(sink, _SPOTS) as out:
                for at in range(0, len(ids), FILE_ROWS):
                    some = spots[at : at + FILE_ROWS]
                    blob = zstandard.compress(_planes(np.concatenate(some)))
                    out.write_batch(pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((ids[at : at + FILE_ROWS], [len(x) for x in some], blob), _SPOTS.types)], schema=_SPOTS))
            raw = [w.encode("utf-8", "surrogatepass") for w in words]
            bucket = np.fromiter((xxhash.xxh64_intdigest(w) % buckets for w in raw), np.int32, len(raw))
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
            for b, lo, hi in zip(range(buckets), edges, edges[1:]):
                if lo < hi:
                    yield _batch([block], [0], [b], [len(raw)], [_pack(order[lo:hi].astype(np.uint32), [raw[k] for k in order[lo:hi].tolist()])])
            yield _batch([block], [1], [-1], [len(raw)], [f"{folder}/{name}".encode()])
            ids, spots, held, words, serial = [], [], 0, defaultdict(count().__next__), serial + 1

        fs.create_dir(base, recursive=True)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                found = find(text)
                spots.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
                ids.append(doc_id)
                held += len(text) + 64
                if held >= BLOCK_BYTES:
                    yield from flush()
        yield from flush()

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, _ROW)


#: Documents that are compressed together in a block's file.
FILE_ROWS = 64
_SPOTS = pa.schema([("ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("data", pa.binary())])
_ROW = "block long, kind int, bucket int, id long, data binary"
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]


def _batch(*columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], ["block", "kind", "bucket", "id", "data"])


def _encode_words(ranks_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, cache = load_ranks(ranks_path), {}
        for batch in batches:
            for block, bucket, n, blob in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), batch.column(4)):
                numbers, words = _unpack(blob.as_py())
                out = []
                for w in words:
                    if (ids := cache.get(w)) is None:
                        if len(cache) >= CACHE_WORDS:
                            cache.clear()
                        ids = cache[w] = np.array(encode_word(w, ranks), np.uint32).tobytes()
                    out.append(ids)
                yield _batch([block], [0], [bucket], [n], [_pack(numbers, out)])

    return run


def _join_blocks(ranks_path: str, whole: bool):
    """Rows sorted by block and kind: a block's words come before its file of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {i: b for b, i in load_ranks(ranks_path).items()}
        at, texts, ids, sizes, decoded = None, [], [], None, []
        for batch in batches:
            for block, kind, _, n, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if block != at:
                    at, texts, ids, sizes, decoded = block, [b""] * n, [[]] * n if whole else [], np.zeros(n, np.int64), [b""] * n
                if not kind:
                    for k, x in zip(*(v if isinstance(v, list) else v.tolist() for v in _unpack(blob))):
                        word = np.frombuffer(x, np.uint32).tolist()
                        sizes[k] = len(word)
                        texts[k] = b",".join([b"%d" % i for i in word])
                        decoded[k] = b"".join([table[i] for i in word])
                        if whole:
                            ids[k] = word
                    continue
                fs, path = open_fs(blob.decode())
                with fs.open_input_stream(path) as f, pa.ipc.open_stream(f) as stream:
                    for group in stream:
                        yield assemble(*(c[0].as_py() for c in group.columns), texts, ids, sizes, decoded)

    def assemble(doc_ids, counts, blob, texts, ids, sizes, decoded) -> pa.RecordBatch:
        spots = _unplanes(zstandard.decompress(blob)) if sum(counts) else np.zeros(0, np.uint32)
        out = [], [], [], [], []
        for where in np.split(spots, np.cumsum(counts)[:-1]):
            some = where.tolist()
            out[0].append(int(sizes[where].sum()) if some else 0)
            out[1].append(hashlib.sha256(b",".join([texts[i] for i in some])).hexdigest())
            plain = b"".join([decoded[i] for i in some])
            out[2].append(hashlib.sha256(plain).hexdigest())
            if whole:
                out[3].append([t for i in some for t in ids[i]])
                out[4].append(plain)
        columns = [pa.array(doc_ids, pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1]), pa.array(out[2])]
        if whole:
            columns += [pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row; ``whole`` adds ``ids`` and ``decoded``.

    Null or empty text has no tokens: the digests are those of the empty string. Repeated rows
    repeat, a null id stays null, an empty table gives no rows. ``ranks_path`` must be readable on
    every executor (it is a parameter of the installation, not data).
    """
    spark: SparkSession = docs.sparkSession
    buckets = 4 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = cut(split(docs, new_path(spark, "blocks"), id_col, text_col, pattern, buckets), "words")
    words = rows.where("kind = 0").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encode_words(ranks_path), _ROW)
    both = words.unionAll(rows.where("kind = 1")).repartition("block").sortWithinPartitions("block", "kind")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * whole
    return both.mapInArrow(_join_blocks(ranks_path, whole), schema)


def op8(docs: DataFrame) -> DataFrame:
    """Contract columns: doc_id, n_tokens, ids_sha256, decoded_sha256, by the multilingual 50k vocabulary."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
