"""Lempel-Ziv phrase fingerprints: compression-like likeness of documents.

A text's UTF-8 bytes are parsed into dictionary phrases (each phrase is the longest
known one and the byte after it; a trie holds them, so the parse is linear). The set of
phrases is hashed and kept as the minima of ``HASHES`` hash functions, eight
bits of each: ``2 * HASHES`` hex digits. The likeness of two fingerprints is the share
of equal places without the share that chance gives, an estimate of the common share of
their phrase sets: 1 for equal texts, 0 for nothing in common, standard error at most
0.044. A text without a byte has no phrase; its fingerprint is all zeros, like 1 to
another such and 0 to any other.

``fingerprint_report`` compares each document with an edited copy and with its next
document. Documents are range-partitioned by doc_id, content hash and row number (so
that neither a repeated id nor many copies of one row make a large partition) and
sorted; every task streams its rows with one row of lookahead. The last row of a
partition meets the first row of the next one in a join of at most one row a partition.

Null texts count as empty; null ids come first; rows with equal ids stand in the order
of their content hash; equal rows give equal results; a document that is alone
is its own next one; without rows the result is empty. Columns other than doc_id and
text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from assaykit.llm.common import written

#: Hash functions of a signature (documented parameter: the error of a likeness is at most 0.5 / sqrt(HASHES)).
HASHES = 128
#: Phrases whose minima are taken at once.
MIN_CHUNK = 1 << 10
#: Results of one Arrow batch.
OUT_ROWS = 1 << 10

_rng = np.random.default_rng(11)
_MULT = _rng.integers(0, 1 << 31, (HASHES, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _rng.integers(0, 1 << 32, (HASHES, 1), dtype=np.uint32)
_NOTHING = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
_BASE = 0x9E3779B97F4A7C15          # odd, so that it has an inverse modulo 2**64
_UNBASE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


_KEPT = {base: _powers(base, 1 << 16) for base in (_BASE, _UNBASE)}

REPORT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def parse(trie: dict[int, int], data: bytes, node: int = 0, start: int = 0) -> tuple[list[int], int]:
    """Parse ``data`` from ``start`` on, beginning at a trie node; returns the ends of completed phrases and the last node.

    The trie maps (node, byte) to a node; nodes are numbered from 1 in the order of their phrases.
    """
    ends, count, child = [], len(trie) + 1, trie.setdefault
    for i, byte in enumerate(memoryview(data)[start:], start + 1):
        node = child(node << 8 | byte, count)
        if node == count:
            count += 1
            node = 0
            ends.append(i)
    return ends, node


def shrink(trie: dict[int, int], size: int) -> None:
    """Take the phrases after the first ``size`` back (a dict gives its newest key back first)."""
    while len(trie) > size:
        trie.popitem()


def phrase_hashes(data: bytes, begun: int, ends: list[int]) -> np.ndarray:
    """32-bit hashes of the phrases that end at ``ends``, the first of which begins at ``begun``.

    Polynomials modulo 2**64 from prefix sums, mixed; equal phrases have equal hashes wherever they stand.
    """
    if not ends:
        return np.empty(0, np.uint32)
    part = np.frombuffer(data, np.uint8)[begun:ends[-1]].astype(np.uint64) + np.uint64(1)
    up, down = (_KEPT[base] if len(part) <= 1 << 16 else _powers(base, len(part)) for base in (_BASE, _UNBASE))
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(part * up[:len(part)], out=sums[1:])
    at = np.array([begun, *ends], np.int64) - begun
    x = (sums[at[1:]] - sums[at[:-1]]) * down[at[:-1]]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


def minima(hashes: np.ndarray, start: np.ndarray = _NOTHING) -> np.ndarray:
    """The least value of every hash function over the phrase hashes and a signature so far."""
    out = start
    for c in range(0, len(hashes), MIN_CHUNK):
        out = np.minimum(out, (hashes[None, c:c + MIN_CHUNK] * _MULT + _PLUS).min(axis=1))
    return out


def bits_of(signature: np.ndarray) -> bytes:
    """The fingerprint: eight well-mixed bits of every minimum; all zeros without a phrase."""
    if signature is _NOTHING:
        return bytes(HASHES)
    mixed = (signature ^ (signature >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    return (mixed >> np.uint32(24)).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    if a == b:
        return 1.0
    empty = bytes(HASHES)
    if a == empty or b == empty:
        return 0.0
    same = np.count_nonzero(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)) / HASHES
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def fingerprint(text: str) -> bytes:
    data = text.encode()
    return bits_of(minima(phrase_hashes(data, 0, parse({}, data)[0])))


def edited(text: str, following: str) -> tuple[str, str]:
    """(what stays, what replaces the last quarter) of a text."""
    return text[:len(text) - len(text) // 4], following[:len(text) // 4]


def fingerprint_and_edited(text: str, following: str) -> tuple[bytes, bytes, str]:
    """Fingerprints of a text and of its edited copy (parsed together where they are equal), and the copy's SHA-256."""
    data, (head, tail) = text.encode(), (part.encode() for part in edited(text, following))
    copy, trie = head + tail, {}
    ends, node = parse(trie, head)
    common, begun, size = minima(phrase_hashes(head, 0, ends)), ends[-1] if ends else 0, len(trie)
    changed = minima(phrase_hashes(copy, begun, parse(trie, copy, node, len(head))[0]), common)
    shrink(trie, size)
    own = minima(phrase_hashes(data, begun, parse(trie, data, node, len(head))[0]), common)
    return bits_of(own), bits_of(changed), hashlib.sha256(copy).hexdigest()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
           ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_REPORT_ARROW = pa.schema(_FIELDS)
_TASK_ARROW = pa.schema(_FIELDS + [("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())])
_TASK = REPORT + ", part int, edge string, text string"


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of sorted rows but the last; that and the first one as edges with their texts."""
    part = TaskContext.get().partitionId()
    out, before, waiting = [], None, None
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            if before is None:
                out.append((doc_id, *[None] * 6, part, "first", text))
            else:
                own, changed, digest = fingerprint_and_edited(before[1], text)
                if waiting is not None:
                    out.append((*waiting[0], likeness(waiting[1], own), part, None, None))
                waiting = ((before[0], len(before[1]), digest, own.hex(), changed.hex(), likeness(own, changed)), own)
            before = doc_id, text
            if len(out) >= OUT_ROWS:
                yield _batch(out, _TASK_ARROW)
                out = []
    if before is not None:
        if waiting is not None:
            out.append((*waiting[0], likeness(waiting[1], fingerprint(before[1])), part, None, None))
        out.append((before[0], *[None] * 6, part, "last", before[1]))
    yield _batch(out, _TASK_ARROW)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of rows that stand beside their next text."""
    for batch in batches:
        out = []
        for doc_id, text, following in zip(*(c.to_pylist() for c in batch.columns)):
            own, changed, digest = fingerprint_and_edited(text, following)
            out.append((doc_id, len(text), digest, own.hex(), changed.hex(), likeness(own, changed),
                        likeness(own, fingerprint(following))))
        yield _batch(out, _REPORT_ARROW)


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint beside that of its edited copy and that of the next document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "n": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), "h", "n"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    along = written(dealt.mapInArrow(_along, _TASK), "phrase-fingerprints")
    edges = along.filter("edge IS NOT NULL").select("doc_id", "part", "edge", "text")
    last = edges.filter("edge = 'last'").select("doc_id", "text", "part")
    first = edges.filter("edge = 'first'").select("part", F.col("text").alias("following"))
    # one number a partition: the next partition that has rows; after the last one the first
    turn = first.select("part")
    in_order = Window.orderBy("part")
    turn = (turn.select("part", F.lead("part").over(in_order).alias("after"), F.min("part").over(
        in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("least"))
        .select(F.col("part").alias("of"), F.coalesce("after", "least").alias("part")))
    pairs = (last.withColumnRenamed("part", "of").join(turn, "of").join(first, "part")
             .select("doc_id", "text", "following"))
    names = [f[0] for f in _FIELDS]
    return along.filter("edge IS NULL").select(*names).union(pairs.mapInArrow(_meet, REPORT))
