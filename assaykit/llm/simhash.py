"""SimHash near-duplicates by tiled exact comparison.

Every text gets a 64-bit fingerprint over its word shingles. Distinct
fingerprints are dealt to tiles by population count (counts with many
fingerprints into several tiles of about ``TILE_ROWS``); two fingerprints within
``radius`` bits differ by at most ``radius`` in population count, so only tile
pairs that close are compared, each pair of tiles in one group, with numpy
exclusive-or and bit counts. Inside a pair the tiles are cut into sub-tiles
sorted by the population counts of the four 16-bit lanes; sub-tile pairs whose
lane counts differ by more than ``radius`` in sum are skipped too. Both skips are
exact. A group reports its links as stars (member, smallest member), never all
pairs; connected components join them.

The work is the square of the number of *distinct* fingerprints, times the share
of pairs that the skips leave. Null texts and texts without a word have
fingerprint zero and are linked like any other; copies share a fingerprint and are
compared once; a null doc_id is linked but never chosen as the smallest of a group
that has another; without rows the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from assaykit.llm.common import written
from assaykit.llm.components import components

SHINGLE_WORDS, RADIUS, SEED = 4, 4, 42
#: Fingerprints of one tile, about; and rows of a sub-tile.
TILE_ROWS, SUB_ROWS = 1 << 15, 256
#: Shingles hashed before their bits are added up.
HASH_CHUNK = 1 << 16
#: Links of a tile pair that are held before they are reduced to stars.
LINK_CHUNK = 1 << 18


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """64-bit fingerprint (unsigned) of a text: bit set where over half the shingle hashes have it set."""
    parts = text.encode().lower().split()       # bytes: lower() changes A-Z only, split() takes ASCII white space
    if not parts:
        return 0
    joined, sizes = b" ".join(parts), np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes).tolist(), ends.tolist()
    width = min(words, len(parts))
    n, ones, digest = len(parts) - width + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    last = ends[width - 1:]
    for c in range(0, n, HASH_CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[c:c + HASH_CHUNK], last[c:c + HASH_CHUNK])],
                          dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; fp holds the 64 bits as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


class Stars:
    """Union of links into stars, in bounded memory."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        for a, b in zip(left.tolist(), right.tolist()):
            self.join(a, b)

    def edges(self) -> tuple[list[int], list[int]]:
        members = list(self.parent)
        return members, [self.root(x) for x in members]


def _lanes(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps.view("<u2").reshape(-1, 4)).astype(np.int16)


def _sub_tiles(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints sorted by lane counts, and the least and largest lane counts of each sub-tile."""
    lanes = _lanes(fps)
    order = np.lexsort(lanes.T[::-1])
    fps, lanes = fps[order], lanes[order]
    cuts = np.arange(0, len(fps), SUB_ROWS)
    return fps, np.minimum.reduceat(lanes, cuts), np.maximum.reduceat(lanes, cuts)


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[list[int], list[int]]:
    """Stars of all links between two tiles (``right`` None: within one) of distinct fingerprints (int64)."""
    stars, held, count = Stars(), [], 0
    a, a_lo, a_hi = _sub_tiles(left)
    b, b_lo, b_hi = (a, a_lo, a_hi) if right is None else _sub_tiles(right)
    ua, ub = a.view(np.uint64), b.view(np.uint64)
    for i in range(len(a_lo)):
        gap = np.maximum(np.maximum(a_lo[i] - b_hi, b_lo - a_hi[i]), 0).sum(axis=1)
        rows = slice(i * SUB_ROWS, (i + 1) * SUB_ROWS)
        for j in np.flatnonzero(gap <= radius).tolist():
            if right is None and j < i:
                continue
            cols = slice(j * SUB_ROWS, (j + 1) * SUB_ROWS)
            near = np.bitwise_count(ua[rows, None] ^ ub[None, cols]) <= radius
            if right is None and i == j:
                near = np.triu(near, 1)
            if near.any():
                x, y = np.nonzero(near)
                held.append((a[rows][x], b[cols][y]))
                count += len(x)
                if count > LINK_CHUNK:
                    for h in held:
                        stars.add(*h)
                    held, count = [], 0
    for h in held:
        stars.add(*h)
    return stars.edges()


def _tiled(distinct: DataFrame, radius: int) -> DataFrame:
    """(lo, hi, tile, fp): each fingerprint once for each tile pair that its tile is in.

    Only the number of fingerprints of each of the 65 population counts goes to the driver.
    """
    counts = distinct.groupBy(F.bit_count("fp").alias("ones")).count().collect()
    slots = {r["ones"]: -(-r["count"] // TILE_ROWS) for r in counts}
    per = F.array(*[F.lit(slots.get(k, 0)).cast("int") for k in range(65)])
    own = distinct.select("fp", F.bit_count("fp").alias("ones"), per.alias("per"))
    own = own.withColumn("tile", F.shiftleft(F.col("ones").cast("long"), 32)
                         + F.pmod(F.xxhash64("fp"), F.get("per", F.col("ones")).cast("long")))
    other = own.select("fp", "tile", "per", F.explode(F.filter(
        F.sequence(F.greatest(F.col("ones") - radius, F.lit(0)), F.least(F.col("ones") + radius, F.lit(64))),
        lambda k: F.get("per", k) > 0)).alias("k"))
    other = other.select("fp", "tile", F.explode(F.transform(
        F.sequence(F.lit(0), F.get("per", F.col("k")) - 1),
        lambda slot: F.shiftleft(F.col("k").cast("long"), 32) + slot)).alias("with"))
    return other.select(F.least("tile", "with").alias("lo"), F.greatest("tile", "with").alias("hi"), "tile", "fp")


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints (column fp, distinct) linked at ``radius`` bits or fewer."""
    def compare(key, group: pd.DataFrame) -> pd.DataFrame:
        fps, tile = group["fp"].to_numpy(np.int64), group["tile"].to_numpy()
        first = np.sort(fps[tile == key[0]])
        second = None if key[0] == key[1] else np.sort(fps[tile == key[1]])
        if not len(first) or (second is not None and not len(second)):
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        a, b = tile_links(first, second, radius)
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return _tiled(distinct, radius).groupBy("lo", "hi").applyInPandas(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the smallest doc_id linked, directly or through others."""
    prints = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct, radius)).withColumnRenamed("id", "fp")
    rooted = written(distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")),
                     "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """The documents that stand for their group: those with the smallest doc_id (rows equal in doc_id and text: once).

    A null doc_id counts as smaller than any other here, so that such a document can stand for its group. Only the ids
    that go and the (id, text hash) pairs that repeat are joined to the rows; whole rows are shuffled where those are
    too many to broadcast, and rows are sorted only if they repeat.
    """
    known = F.coalesce(F.col("doc_id"), F.lit(-(2 ** 63)))
    ids = docs.select(known.alias("doc_id"), "text")
    gone = written(near_duplicates(ids, words, radius).groupBy(F.col("doc_id").alias("known"))
                   .agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"))
                   .filter("NOT stays").select("known"), "near-duplicates-gone")
    # the row travels as one struct, so no column of it can meet one of ours; a null text is not an empty one
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), known.alias("known"),
                        F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("")).alias("digest"))
    pair = ["known", "digest"]
    again = written(whole.groupBy(*pair).count().filter("count > 1").select(*pair), "repeated-rows")
    left = whole.join(gone, "known", "left_anti")
    repeated = left.join(again, pair, "left_semi").dropDuplicates(pair)
    return left.join(again, pair, "left_anti").unionByName(repeated).select("row.*")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
