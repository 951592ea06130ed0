"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut at the vocabulary's added tokens (each counts as one token), the
rest into pre-tokens by the vocabulary's split pattern. Each pre-token starts as
one symbol per UTF-8 byte in a linked list; a heap of adjacent pairs by (rank,
position) is popped until no ranked pair is left. The count is the number of
initial symbols minus the number of merges; identifiers are never produced.

Nulls count as empty texts (0 bytes, 0 tokens); repeated rows and null ids are
counted row by row; other columns are ignored. Memory is bounded by one Arrow
batch, the vocabulary and ``CACHE_ENTRIES`` remembered pre-tokens a worker.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Split pattern of the byte-level pre-tokenizer (fixed by the vocabulary format).
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens whose counts a Python worker remembers; the store is emptied when full.
CACHE_ENTRIES = 800_000
#: Longer pre-tokens are counted but not remembered.
CACHE_CHARS = 64


def byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes, by rule."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges(dict):
    """rank * SPAN + symbol made, by left symbol * SPAN + right symbol; symbols 0 to 255 are the bytes."""

    SPAN = 1 << 20

    def __init__(self, pairs: list[tuple[bytes, bytes]]):
        super().__init__()
        symbol = {bytes([b]): b for b in range(256)}
        for left, right in pairs:
            symbol.setdefault(left + right, len(symbol))
        for rank, (left, right) in enumerate(pairs):
            if left in symbol and right in symbol:      # else no text ever holds that pair
                self.setdefault(symbol[left] * self.SPAN + symbol[right], rank * self.SPAN + symbol[left + right])


def merged_count(data: bytes, merges: Merges) -> int:
    """Symbols left of ``data`` after all ranked merges, lowest rank first, leftmost among equals."""
    n, span, get = len(data), Merges.SPAN, merges.get
    if n < 2:
        return n
    symbol = list(data)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(m, i) for i in range(n - 1) if (m := get(symbol[i] * span + symbol[i + 1])) is not None]
    heapify(heap)
    left = n
    while heap:
        found, i = heappop(heap)
        j = after[i]
        if j >= n or symbol[i] < 0 or get(symbol[i] * span + symbol[j]) != found:
            continue                                # an earlier merge changed this pair
        made = symbol[i] = found % span
        symbol[j] = -1
        left -= 1
        k, h = after[j], before[i]
        after[i] = k
        if k < n:
            before[k] = i
            if (m := get(made * span + symbol[k])) is not None:
                heappush(heap, (m, i))
        if h >= 0 and (m := get(symbol[h] * span + made)) is not None:
            heappush(heap, (m, h))
    return left


class PieceCounts(dict):
    """Counts by pre-token, filled on demand and bounded."""

    def __init__(self, merges: Merges, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.merges, self.entries = merges, entries

    def __missing__(self, piece: str) -> int:
        n = merged_count(piece.encode(), self.merges)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= self.entries:
                self.clear()
            self[piece] = n
        return n


class TokenCounter:
    """Counts tokens of texts for one byte-level vocabulary (the JSON of the ``tokenizers`` library)."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("a byte-level BPE vocabulary without normalizer is needed")
        letters = byte_letters()
        back = lambda s: bytes(letters[c] for c in s)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.pieces = PieceCounts(Merges([(back(a), back(b)) for a, b in pairs]))
        self.prefix = bool(pre.get("add_prefix_space"))
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.find = regex.compile(SPLIT_PATTERN).findall

    def count(self, text: str) -> int:
        parts = self.added.split(text) if self.added else [text]
        n, get = len(parts) - 1, self.pieces.__getitem__
        for part in parts:
            if self.prefix and part and not part[0].isspace():
                part = " " + part
            n += sum(map(get, self.find(part)))
        return n


@functools.lru_cache(maxsize=2)
def _counter(vocabulary: bytes) -> TokenCounter:
    return TokenCounter(vocabulary)


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 1024, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    The vocabulary file is read on the driver and broadcast; its size is that of
    the file (about 1.5 MB), whatever the data.
    """
    with open(vocabulary_path, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(vocabulary.value).count
        for batch in batches:
            n = pa.array([count(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], ["row", "n_tokens"])

    rows = docs.select(F.struct(F.col(id_col).cast("long").alias("doc_id"),
                                F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"))
                       .alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return (rows.mapInArrow(run, "row struct<doc_id:bigint,n_bytes:bigint>, n_tokens bigint")
            .select("row.doc_id", "row.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
