"""Scan of stored rows for plain identifiers.

The identifiers go into automata of about ``SHARD_IDS`` each (dealt by hash; one broadcast and
one automaton stay small); each automaton reads the different cells of every column of a batch once,
those of a batch with hits twice, whatever its number of identifiers. A task holds all automata, about 100 bytes an identifier: beyond
``MOST_IDS`` the scan refuses, and is to be run on parts of the identifiers. A cell leaks when an identifier stands in it with no
letter or digit on either side. Nothing is shuffled but one row of counts a task and column.

Null and empty identifiers are left out; null cells hold none; a table without rows has a count
of 0; without identifiers nothing leaks.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

#: Identifiers of one automaton (about 100 bytes each in a task, 20 MB with ids of 36 characters).
SHARD_IDS = 200_000
#: Identifiers of one scan (about 500 MB in a task).
MOST_IDS = 5_000_000


def _texts(df: DataFrame) -> list[Column]:
    return [(F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, (ArrayType, MapType, StructType, VariantType))
             else F.col(f"`{f.name}`").cast("string")).alias(f"c{k}") for k, f in enumerate(df.schema)]


def _shards(identifiers: DataFrame, col: str) -> list[list[str]]:
    ids = identifiers.select(F.col(col).cast("string").alias("i")).filter("i IS NOT NULL AND i != ''").distinct()
    count = ids.count()
    if count > MOST_IDS:
        raise ValueError(f"{count} identifiers are more than one scan takes ({MOST_IDS}); scan for parts of them")
    n = -(-count // SHARD_IDS)
    return [[r[0] for r in ids.filter(F.pmod(F.xxhash64("i"), F.lit(n)) == k).collect()] for k in range(n)]


def leak_counts(df: DataFrame, identifiers: DataFrame, col: str) -> DataFrame:
    """(column_name, n_rows, n_leaks): rows of ``df`` and, of each column, the cells that hold an identifier.

    All automata read a cell in one pass, so that one that several of them hit counts once; a task makes them one after
    another as it needs them, and keeps them.
    """
    return _counts(df, _sent(identifiers, col))


def _sent(identifiers: DataFrame, col: str) -> list:
    return [identifiers.sparkSession.sparkContext.broadcast(ids) for ids in _shards(identifiers, col)]


def _counts(df: DataFrame, sent: list) -> DataFrame:
    cells, names = df.select(*_texts(df)), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [_automaton(ids.value) for ids in sent if ids.value]
        rows, hits = 0, [0] * len(names)
        for batch in batches:
            rows += batch.num_rows
            for k in range(len(names)):
                hits[k] += _leaks(batch.column(k), automata)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([rows] * len(names), pa.int64()),
                                          pa.array(hits, pa.int64())], ["column_name", "n_rows", "n_leaks"])

    counts = "column_name string, n_rows bigint, n_leaks bigint"
    nothing = df.sparkSession.createDataFrame([(name, 0, 0) for name in names], counts)
    counted = cells.mapInArrow(run, counts).union(nothing)
    return counted.groupBy("column_name").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_leaks").alias("n_leaks"))


def _leaks(cells: pa.Array, automata: list) -> int:
    """The cells that hold an identifier; different ones are read, one by one only if an automaton hits them laid end to
    end (a line feed between two has no letter or digit on either side, so no hit of a single cell is missed)."""
    counted = pc.value_counts(cells.drop_null())
    texts = counted.field("values").to_pylist()
    whole = "\n".join(texts)
    hit = [a for a in automata if _held(a, whole)]
    if not hit:
        return 0
    return sum(n for c, n in zip(texts, counted.field("counts").to_pylist()) if any(_held(a, c) for a in hit))


def _automaton(ids: list[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for i in ids:
        made.add_word(i)
    made.make_automaton()
    return made


def _held(automaton: ahocorasick.Automaton, cell: str) -> bool:
    for end, size in automaton.iter(cell):
        before, after = cell[end - size:end - size + 1] if end >= size else "", cell[end + 1:end + 2]
        if not before.isalnum() and not after.isalnum():
            return True
    return False


def scan_tables(tables: dict[str, DataFrame], identifiers: DataFrame, col: str) -> DataFrame:
    """(table_name, column_name, n_rows, n_leaks) over every column of several tables; the identifiers are read once."""
    sent = _sent(identifiers, col)
    return functools.reduce(DataFrame.unionByName, [
        _counts(df, sent).withColumn("table_name", F.lit(name)) for name, df in tables.items()])
