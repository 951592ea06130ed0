"""What a stored file may hold: row count, time and id range, facet values and a key filter.

:func:`summaries` reads the few columns it needs of files just written and returns one
row a file (a file that Spark reads in several pieces has one row for each piece; every
use below takes the pieces as alternatives). The key filter is a Bloom filter over 64-bit
hashes of the row's key and id: ``BITS`` bits a hash and ``PROBES`` probes, about two
wrong hits in 100,000, so a lookup of ``k`` new keys opens about ``k / 50,000`` of the
files. :func:`may_hold` asks the filters of all files for a set of hashes in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BITS, PROBES = 24, 10
#: Values of one facet column that a file's summary lists; a file with more may hold any.
FACET_VALUES = 16
#: Hashes of one lookup that are sent to the tasks (8 MB); a larger batch is compared with all files' keys.
LOOKUP_HASHES = 1 << 20

#: What a summary says besides its key filter; a small row.
FACTS = ("path string, n_rows bigint, first_at timestamp_ntz, last_at timestamp_ntz, "
         "facets map<string,array<string>>, low_id string, high_id string")
SUMMARY = f"{FACTS}, key_filter binary"
_ARROW = pa.schema([
    ("path", pa.string()), ("n_rows", pa.int64()), ("first_at", pa.timestamp("us")), ("last_at", pa.timestamp("us")),
    ("facets", pa.map_(pa.string(), pa.list_(pa.string()))), ("low_id", pa.string()), ("high_id", pa.string()),
    ("key_filter", pa.binary())])


def row_key(columns: list[str]) -> Column:
    """A row's key as one text; null parts are kept apart from empty ones, so null keys compare as equal."""
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]), {"ignoreNullFields": "false"})


def key_hash(key: Column) -> Column:
    return F.xxhash64(F.lit("key"), key)


def id_hash(id_: Column) -> Column:
    return F.xxhash64(F.lit("id"), id_.cast("string"))


def _places(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    h = hashes.view(np.uint64)
    step = ((h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)) | np.uint64(1)
    for i in range(PROBES):
        yield (h + np.uint64(i) * step) % np.uint64(bits)


def make_filter(hashes: np.ndarray) -> bytes:
    """A Bloom filter over signed 64-bit hashes."""
    bits = max(64, len(hashes) * BITS // 64 * 64)
    marks = np.zeros(bits, bool)
    for at in _places(hashes, bits):
        marks[at] = True
    return np.packbits(marks, bitorder="little").tobytes()


def passing(key_filter: bytes, hashes: np.ndarray) -> np.ndarray:
    """The hashes that the filter may hold: all that it holds, and few others."""
    words = np.frombuffer(key_filter, np.uint8)
    held = np.ones(len(hashes), bool)
    for at in _places(hashes, 8 * len(words)):
        held &= (words[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return hashes[held]


def summaries(rows: DataFrame, keys: list[str], facets: list[str], time: str | None, id_: str | None) -> DataFrame:
    """Summaries of the files that ``rows`` is read from."""
    path = F.col("_metadata.file_path")
    at = F.col(time).cast("timestamp_ntz") if time else F.lit(None).cast("timestamp_ntz")
    view = rows.select(
        path.alias("path"), at.alias("at"), (F.col(id_).cast("string") if id_ else F.lit(None).cast("string")).alias("id"),
        (key_hash(row_key(keys)) if keys else F.lit(None).cast("bigint")).alias("k"),
        (id_hash(F.col(id_)) if id_ else F.lit(None).cast("bigint")).alias("i"),
        *[F.col(f).cast("string").alias(f"facet_{f}") for f in facets])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            frame = batch.to_pandas()
            for name, part in frame.groupby("path", sort=False):
                held.setdefault(name, []).append(_digest(part, facets))
        out = [(name, *_joined(parts, facets)) for name, parts in held.items()]
        columns = zip(*out) if out else [[]] * len(_ARROW)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    return view.mapInArrow(run, SUMMARY)


def _digest(part, facets: list[str]) -> tuple:
    """Counts, extremes, facet values and hashes of one batch's rows of a file."""
    hashes = np.concatenate([part[c].dropna().to_numpy(np.int64) for c in ("k", "i")])
    values = [set(part[f"facet_{f}"].unique()) for f in facets]
    at, ids = part["at"].dropna(), part["id"].dropna()
    return (len(part), at.min() if len(at) else None, at.max() if len(at) else None, len(at) < len(part), values,
            ids.min() if len(ids) else None, ids.max() if len(ids) else None, hashes)


def _joined(parts: list[tuple], facets: list[str]) -> tuple:
    def least(k, pick):
        known = [p[k] for p in parts if p[k] is not None]
        return pick(known) if known else None

    listed = {}
    for n, facet in enumerate(facets):
        values = set().union(*(p[4][n] for p in parts))
        if len(values) <= FACET_VALUES:
            listed[facet] = [v if isinstance(v, str) else None for v in values]
    hashes = np.concatenate([p[7] for p in parts])
    # rows without a time are never told apart by it
    first, last = (None, None) if any(p[3] for p in parts) else (least(1, min), least(2, max))
    return (sum(p[0] for p in parts), first, last, list(listed.items()), least(5, min), least(6, max),
            make_filter(hashes) if len(hashes) else None)


def may_hold(files: DataFrame, hashes: np.ndarray) -> DataFrame:
    """(path) of the files whose filter passes any of the hashes; files without a filter may hold any."""
    sent = files.sparkSession.sparkContext.broadcast(np.asarray(hashes, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [f is None or len(passing(f, sent.value)) > 0 for f in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_()))], ["path"])

    return files.select("path", "key_filter").mapInArrow(run, "path string").distinct()


def facet_may_be(facet: str, value) -> Column:
    """True of files that may hold a row whose facet column has the value (None: is null)."""
    listed = F.try_element_at("facets", F.lit(facet))
    text = None if value is None else str(value).lower() if isinstance(value, bool) else str(value)
    has = F.exists(listed, lambda v: v.eqNullSafe(F.lit(text)))
    return listed.isNull() | has
