"""SentencePiece encoding and decoding for merge-type (BPE) models.

A text gets the model's word mark for each space and one in front. It is cut
only where no piece of the vocabulary can span the cut (before a run of word
marks, around a line feed, between a letter and a stop), so each segment can be
coded by itself. A segment
starts as one symbol per character; an agenda of adjacent pairs ordered by score
(leftmost first among equals) is worked off; symbols outside the vocabulary fall
back to byte pieces. Every segment that a worker meets for the first time is
also given to the ``sentencepiece`` library, all new ones of an Arrow batch at
once; a difference raises an error, so no unchecked code is ever returned.

Null texts are coded as empty (no ids). Repeated rows, null ids and extra
columns change nothing: rows are coded one by one. Memory is bounded by one
Arrow batch, the vocabulary and ``CACHE_ENTRIES`` remembered segments, which a
task forgets at its end, so that an idle worker holds the vocabulary alone.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
LETTER, STOP = "[A-Za-z\u00c0-\u024f\u0370-\u04ff]", "[.,;:!?]"
#: Segments a Python worker remembers; the store is emptied between batches when full.
CACHE_ENTRIES = 400_000
#: Rows of one output batch, so that ids of long texts do not pile up.
OUT_ROWS = 256


class Known(dict):
    """Ids by segment (32-bit, as bytes), filled on demand.

    ``fresh`` lists the segments added since it was last emptied, ``other`` the decoded
    texts of those segments whose ids do not decode to the segment itself.
    """

    def __init__(self, coder: PieceCoder):
        super().__init__()
        self.coder, self.fresh, self.other = coder, [], {}

    def __missing__(self, segment: str) -> bytes:
        ids, spelled = self.coder.encode_segment(segment)
        # pieces alone join to the segment they were cut from; only byte pieces can decode to something else
        if spelled and (decoded := self.coder.decode(ids, False)) != segment.replace(MARK, " "):
            self.other[segment] = decoded
        self[segment] = packed = array("i", ids).tobytes()
        self.fresh.append(segment)
        return packed

    def forget(self) -> None:
        self.clear()
        self.other.clear()
        self.fresh = []


class PieceCoder:
    """Encodes and decodes segments with one merge-type model."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib, n = self.library, self.library.get_piece_size()
        self.text = [lib.id_to_piece(i) for i in range(n)]
        self.special = [lib.is_control(i) or lib.is_unknown(i) for i in range(n)]
        self.byte = {i: int(self.text[i][1:-1], 16) for i in range(n) if lib.is_byte(i)}
        if len(self.byte) != 256 or any(lib.is_unused(i) for i in range(n)):
            raise ValueError("a merge-type model with byte pieces and no unused pieces is needed")
        plain = [i for i in range(n) if not self.special[i] and i not in self.byte]
        if lib.encode("a") == [] or lib.normalize(f"  {MARK}Aé  b ") != f"{MARK * 4}Aé{MARK * 2}b{MARK}":
            raise ValueError("a model with identity normalization and a word mark in front is needed")
        if any(re.search(f"\n|[^{MARK}]{MARK}|{LETTER}{STOP}", self.text[i]) for i in plain):
            raise ValueError("a model whose pieces span no word or line end is needed")
        self.score = {self.text[i]: lib.get_score(i) for i in plain}        # greatest first
        self.id_of = {self.text[i]: i for i in plain}
        self.byte_id = {b: i for i, b in self.byte.items()}
        self.find = re.compile(f"{MARK}*{LETTER}+(?={STOP})|{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+").findall
        self.known = Known(self)

    def segments(self, text: str) -> list[str]:
        return self.find(MARK + text.replace(" ", MARK)) if text else []

    def encode_segment(self, segment: str) -> tuple[list[int], bool]:
        """Ids of one segment by the score-ordered agenda, and whether byte pieces are among them."""
        score, n = self.score.get, len(segment)
        symbol: list[str] = list(segment)
        agenda = [(-s, i, 2) for i, s in enumerate(map(score, map(add, symbol, symbol[1:]))) if s is not None]
        if agenda:
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            heapify(agenda)
        while agenda:
            _, i, size = heappop(agenda)
            left, j = symbol[i], after[i]
            if not left or j >= n or len(left) + len(symbol[j]) != size:
                continue                            # a neighbour has been merged since
            merged = symbol[i] = left + symbol[j]
            symbol[j] = ""
            h, k = before[i], after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (s := score(merged + symbol[k])) is not None:
                    heappush(agenda, (-s, i, size + len(symbol[k])))
            if h >= 0 and (s := score(symbol[h] + merged)) is not None:
                heappush(agenda, (-s, h, size + len(symbol[h])))
        ids = [*map(self.id_of.get, filter(None, symbol))]
        if None not in ids:
            return ids, False
        out: list[int] = []
        for s, i in zip(filter(None, symbol), ids):
            out += [i] if i is not None else [self.byte_id[b] for b in s.encode()]
        return out, True

    def coded(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as 32-bit bytes, decoded text) of each text; new segments are compared with the library in one call."""
        known = self.known
        if len(known) >= CACHE_ENTRIES:
            known.forget()
        get, other, found = known.__getitem__, known.other, []
        for text in texts:
            parts = self.segments(text)
            ids = b"".join(map(get, parts))
            # segments end with whole characters, so their texts join to that of all ids
            if other and not other.keys().isdisjoint(parts):
                text = "".join([other.get(p, p) for p in parts])[1:]
            found.append((ids, text.replace(MARK, " ")))
        fresh, known.fresh = known.fresh, []
        # The library puts a word mark in front: it stands for the segment's own first mark, or else
        # a line feed keeps it apart (both then lead the ids as two pieces).
        theirs = self.library.encode([s[1:] if s[0] == MARK and len(s) > 1 else "\n" + s for s in fresh])
        for s, b in zip(fresh, theirs, strict=True):
            mine = np.frombuffer(get(s), np.int32).tolist()
            if mine != (b if s[0] == MARK and len(s) > 1 else b[2:]):
                raise RuntimeError(f"agenda and library differ on segment {s!r}: {mine} and {b}")
        return found

    def decode(self, ids, at_start: bool = True) -> str:
        """Text of ids: pieces joined, byte pieces as UTF-8, marks as spaces; at a text's start one mark is dropped."""
        out, run = [], bytearray()
        for i in ids:
            b = self.byte.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run, at_start = bytearray(), False
            piece = "" if self.special[i] else self.text[i]
            if at_start and piece:
                piece, at_start = piece[1:] if piece[0] == MARK else piece, False
            out.append(piece)
        out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")


@functools.lru_cache(maxsize=2)
def _coder(model: bytes) -> PieceCoder:
    return PieceCoder(model)


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), decoded (string) for every row of ``docs``.

    The model file is read on the driver and broadcast; its size does not depend
    on the data.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(model.value)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, OUT_ROWS):
                    piece = batch.slice(at, OUT_ROWS)
                    found = coder.coded(piece.column(1).to_pylist())
                    ends = np.cumsum([0, *(len(ids) // 4 for ids, _ in found)], dtype=np.int32)
                    flat = np.frombuffer(b"".join([ids for ids, _ in found]), np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [piece.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())),
                         pa.array([text for _, text in found], pa.string())], ["doc_id", "ids", "decoded"])
        finally:
            coder.known.forget()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def code_digests(coded: DataFrame) -> DataFrame:
    """n_tokens and digests of ids (decimal, comma-joined) and decoded text, in place of the two columns."""
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
