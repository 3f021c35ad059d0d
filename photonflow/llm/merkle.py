"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

The split keeps every character, so equal roots mean equal texts. Where roots differ, only
branches with differing hashes are followed, aligned by their hashes, which locates the edits. The likeness
of two trees is the share of text in branches that the alignment finds equal.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonflow.llm.ordered import with_guards

#: A section ends with an empty line or before a heading line; a paragraph is a line.
SECTION = re.compile(r"(?:\n[ \t\r]*)+\n|\n(?=#{1,6} )")
#: A sentence ends after its mark and the spaces that follow; a leaf is no longer than LEAF characters.
SENTENCE = re.compile(r"[^.!?]*[.!?]+\s*|[^.!?]+")
LEAF = 512
DIGEST = 16


def _hash(kind: bytes, data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST, person=kind).digest()


@dataclass
class Node:
    digest: bytes
    start: int  # characters before the node
    size: int  # characters of the node
    children: list[Node] | None


def _parts(text: str, pattern: re.Pattern) -> list[str]:
    """Cut after each match; together the parts are the text."""
    ends = [m.end() for m in pattern.finditer(text)]
    return [p for p in (text[i:j] for i, j in zip([0, *ends], [*ends, len(text)])) if p]


def _leaves(paragraph: str) -> list[str]:
    out = []
    for m in SENTENCE.finditer(paragraph):
        s = m.group()
        out += [s] if len(s) <= LEAF else [s[i : i + LEAF] for i in range(0, len(s), LEAF)]
    return out


def tree(text: str) -> Node:
    """Root over sections over paragraphs over sentences. The empty text is a root without children."""
    at, sections = 0, []
    for section in _parts(text, SECTION):
        begun, paragraphs = at, []
        for paragraph in section.splitlines(keepends=True):
            first, leaves = at, []
            for leaf in _leaves(paragraph):
                leaves.append(Node(_hash(b"leaf", leaf.encode("utf-8", "surrogatepass")), at, len(leaf), None))
                at += len(leaf)
            paragraphs.append(_node(b"paragraph", first, leaves))
        sections.append(_node(b"section", begun, paragraphs))
    return _node(b"root", 0, sections)


def _node(kind: bytes, start: int, children: list[Node]) -> Node:
    return Node(_hash(kind, b"".join(c.digest for c in children)), start, sum(c.size for c in children), children)


def _anchors(a: list[Node], b: list[Node]) -> Iterator[tuple[int, int]]:
    """Places of equal children in ascending order: common beginnings and ends, and between them the longest ascending run of those that occur once in both."""
    first, ends = 0, min(len(a), len(b))
    while first < ends and a[first].digest == b[first].digest:
        yield first, first
        first += 1
    last = 0
    while last < ends - first and a[-1 - last].digest == b[-1 - last].digest:
        last += 1
    i, j = len(a) - last, len(b) - last
    once = [Counter(x.digest for x in part) for part in (a[first:i], b[first:j])]
    at = {x.digest: k for k, x in enumerate(b[first:j], first) if once[1][x.digest] == 1}
    pairs = [(k, at[x.digest]) for k, x in enumerate(a[first:i], first) if once[0][x.digest] == 1 and x.digest in at]
    tops, rows, before = [], [], []
    for n, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        tops[k : k + 1], rows[k : k + 1] = [y], [n]
        before.append(rows[k - 1] if k else -1)
    n, run = rows[-1] if rows else -1, []
    while n >= 0:
        run.append(pairs[n])
        n = before[n]
    yield from reversed(run)
    yield from zip(range(i, len(a)), range(j, len(b)))


def aligned(a: Node, b: Node) -> Iterator[tuple[Node | None, Node | None, int]]:
    """Lowest branches of both in order, each with its counterpart or None, and where in ``a`` it stands.

    Equal children are counterparts; what stands between two pairs of these is paired in order and compared in the same way.
    """
    if a.digest == b.digest or not a.children or not b.children:
        yield a, b, a.start
        return
    i = j = 0
    for x, y in [*_anchors(a.children, b.children), (len(a.children), len(b.children))]:
        for k in range(max(x - i, y - j)):
            left, right = a.children[i + k] if i + k < x else None, b.children[j + k] if j + k < y else None
            if left and right:
                yield from aligned(left, right)
            else:
                yield left, right, left.start if left else a.children[x].start if x < len(a.children) else a.start + a.size
        if x < len(a.children):
            yield a.children[x], b.children[y], a.children[x].start
        i, j = x + 1, y + 1


def differences(a: Node, b: Node) -> Iterator[tuple[int, int]]:
    """(start, size) in ``a`` of the lowest branches that have no equal counterpart in ``b``; size 0 where ``b`` has more."""
    for x, y, start in aligned(a, b):
        if not (x and y and x.digest == y.digest):
            yield start, x.size if x else 0


def likeness(a: Node, b: Node) -> float:
    """Share of the characters of both texts that are in branches with an equal counterpart: 1 for equal trees, also empty ones."""
    total = a.size + b.size
    return 2 * sum(x.size for x, y, _ in aligned(a, b) if x and y and x.digest == y.digest) / total if total else 1.0


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as many first characters of the following text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_at"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole runs in order; each row is compared with the row after it in its run."""
    last = None  # run, doc_id, text, root; a run's guards after the first say nothing new
    for batch in batches:
        out = []
        for run, guard, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
            text = text.as_py()
            if guard and (last is None or last[0] != run):
                continue
            root = tree(text)
            now = (run, doc_id, text, root)
            if last and last[0] == run:
                other = edited(last[2], text)
                its = tree(other)
                first = next(differences(last[3], its), (None, 0))[0]
                out.append((last[1], len(last[2]), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), last[3].digest.hex(), its.digest.hex(), likeness(last[3], its), likeness(last[3], root), first))
            last = None if guard else now
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_KINDS)], NAMES)


def op7(docs: DataFrame) -> DataFrame:
    """Contract columns and ``edited_at``, the character where the first differing branch begins (null: none).

    Documents follow each other by descending doc_id; null ids come last, and repeated ids follow by text.
    Null text is empty. A single document follows itself. An empty table gives no rows.
    """
    key = F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit((1 << 63) - 1))
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = with_guards(rows, "key", ["text"]).select("_run", "_guard", "doc_id", "text")
    return dealt.mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_at long")
