"""Line dedup by a segment-partition edit join.

Lines are split at line feeds and trimmed of ASCII white space; equal lines are
copies (one class member each). Two different lines of at least ``MIN_CHARS``
characters are linked when their edit distance is at most ``EDITS``. A line is cut
into EDITS + 1 segments; any line within EDITS edits holds one of them unchanged,
shifted by no more than the edits before and behind it allow. So every line
puts its own segments under keys (length, segment number, hash) and probes, for
each length up to EDITS shorter, the few substrings that can match. Keys under
which two different lines meet, one of them with its own segment, are kept; lines
under a kept key are compared by a banded bit-parallel edit distance. A pair that
meets under several keys is decided under the first only.

Only hashes are shuffled to find the keys; texts are fetched for lines under kept
keys alone. Copies inside a batch are dropped before any shuffle, so a line held by
a third of all rows is a few rows a task. A key with many lines is split into blocks
of ``BLOCK_ROWS`` and every pair of blocks is a group of its own. Groups report the
number of links of each line and the links as stars, never all pairs.

Blank lines are no lines. A null text has none; null doc_ids are kept; repeated rows
repeat their lines; extra columns are ignored. Lines below ``MIN_CHARS`` match as
copies only. Lines are identified by their 64-bit hash (a collision among n different
lines has a chance of about n * n / 2 ** 65).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from assaykit.llm.common import SPACES, written
from assaykit.llm.components import components
from assaykit.llm.simhash import Stars

EDITS, MIN_CHARS = 2, 24
#: Lines of a block of a key with many lines; key rows of one output batch.
BLOCK_ROWS, OUT_ROWS = 512, 1 << 16
SEED = 42


def segments(size: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the edits + 1 segments of a line of ``size`` characters, nearly equal, longer ones last."""
    parts = edits + 1
    base, extra = divmod(size, parts)
    out, at = [], 0
    for i in range(parts):
        n = base + (i >= parts - extra)
        out.append((at, n))
        at += n
    return out


def windows(size: int, shorter: int, edits: int) -> list[tuple[int, int, range]]:
    """(segment number, its length, starts to probe) in a line of ``size`` for lines ``shorter`` characters shorter."""
    out = []
    for i, (p, n) in enumerate(segments(size - shorter, edits)):
        low = max(0, p - i, p + shorter - (edits - i))
        high = min(size - n, p + i, p + shorter + (edits - i))
        out.append((i, n, range(low, high + 1)))
    return out


class Keys:
    """Index and probe keys of lines; the substring places of each length are worked out once."""

    def __init__(self, edits: int = EDITS, min_chars: int = MIN_CHARS):
        self.edits, self.min_chars, self.places = edits, min_chars, {}

    def of(self, line: str) -> tuple[list[int], list[int]]:
        """(own keys, keys probed besides), unsigned 64-bit."""
        size = len(line)
        if size not in self.places:
            own = [(p, p + n, size * 8 + i) for i, (p, n) in enumerate(segments(size, self.edits))]
            probes = [(p, p + n, (size - d) * 8 + i) for d in range(self.edits + 1) if size - d >= self.min_chars
                      for i, n, starts in windows(size, d, self.edits) for p in starts]
            self.places[size] = own, [x for x in probes if x not in own]
        digest, (own, probes) = xxhash.xxh64_intdigest, self.places[size]
        return ([digest(line[a:b].encode(), seed) for a, b, seed in own],
                [digest(line[a:b].encode(), seed) for a, b, seed in probes])

    def witness(self, short: str, line: str) -> int | None:
        """Number of the first segment of ``short`` found in ``line`` where it may stand."""
        own = segments(len(short), self.edits)
        for i, n, starts in windows(len(line), len(line) - len(short), self.edits):
            p = own[i][0]
            if any(line.startswith(short[p:p + n], a) for a in starts):
                return i
        return None


def edit_distance(a: str, b: str, most: int) -> int:
    """Edit distance, or ``most`` + 1 if it is larger: bit i of rows[d] says that a[:i] is within d edits of the read part of b.

    Only bits at most ``most`` off the diagonal are kept.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    low, high = 0, min(len(a), len(b))              # common prefix by halving, then common suffix
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[-mid:] == b[-mid:] else (low, mid - 1)
    a, b = a[:len(a) - low], b[:len(b) - low]
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 2 << i
    rows = [(2 << d) - 1 for d in range(most + 1)]
    band = (1 << 2 * most + 1) - 1
    for j, c in enumerate(b, 1):
        mask = band << j - most if j >= most else band >> most - j
        same, old, new = at.get(c, 0), 0, 0
        for d in range(most + 1):
            row = rows[d]
            # match; insertion and substitution after one edit less; deletion after one edit less here
            old, new = row, ((row << 1 & same) | old | old << 1 | new << 1 if d else row << 1 & same) & mask
            rows[d] = new
        if not new:
            return most + 1
    end = 1 << len(a)
    return next((d for d in range(most + 1) if rows[d] & end), most + 1)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _own_lines(texts: pa.Array, min_chars: int) -> Iterator[str]:
    """Different trimmed lines of a batch of texts of at least ``min_chars`` characters."""
    seen: set[str] = set()
    for text in texts:
        for line in text.as_py().split("\n"):
            line = line.strip(SPACES)
            if len(line) >= min_chars and line not in seen:
                seen.add(line)
                yield line


def _key_rows(docs: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """(key, id): the low bit of id says whether the key is one of the line's own segments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Keys(edits, min_chars)
        for batch in batches:
            k, ids = [], []
            for line in _own_lines(batch.column(0), min_chars):
                own, probes = keys.of(line)
                i = xxhash.xxh64_intdigest(line.encode(), SEED) & ~1
                k += own
                k += probes
                ids += [i | 1] * len(own)
                ids += [i] * len(probes)
                if len(k) >= OUT_ROWS:
                    yield pa.RecordBatch.from_arrays([_signed(k), _signed(ids)], ["key", "id"])
                    k, ids = [], []
            yield pa.RecordBatch.from_arrays([_signed(k), _signed(ids)], ["key", "id"])

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "key bigint, id bigint")


def _line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, line) of different lines of each batch; the low bit of id is 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = list(_own_lines(batch.column(0), min_chars))
            ids = [xxhash.xxh64_intdigest(x.encode(), SEED) & ~1 for x in lines]
            for at in range(0, len(lines), OUT_ROWS):
                yield pa.RecordBatch.from_arrays([_signed(ids[at:at + OUT_ROWS]),
                                                  pa.array(lines[at:at + OUT_ROWS], pa.string())], ["id", "line"])

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "id bigint, line string")


def _met(rows: DataFrame) -> DataFrame:
    """(key, id, own, n): lines whose key holds two different lines, at least one by its own segment; n: rows of the key.

    A line that holds a key both as its own segment and by a probe is one row, its own.
    """
    key = Window.partitionBy("key")
    line, own = F.col("id").bitwiseAND(-2), F.col("id").bitwiseAND(1)
    return (rows.withColumns({"least": F.min(line).over(key), "most": F.max(line).over(key),
                              "any": F.max(own).over(key), "n": F.count("*").over(key)})
            .filter("least != most AND any = 1")
            .groupBy("key", line.alias("id"), "n").agg((F.max(own) == 1).alias("own")).select("key", "id", "own", "n"))


def _links(found: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """(a, b, n): stars of links (b not null) and numbers of links (b null) of lines under kept keys, from (key, id, own, n, line)."""
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    dealt = found.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "own", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, stars, counts = Keys(edits, min_chars), Stars(), {}
        group, held = None, []

        def settle() -> None:
            for x, y in group_links(held, group, keys):
                counts[x] = counts.get(x, 0) + 1
                counts[y] = counts.get(y, 0) + 1
                stars.join(x, y)

        def told() -> Iterator[pa.RecordBatch]:
            a, b = stars.edges()
            yield pa.RecordBatch.from_arrays(
                [pa.array([*a, *counts], pa.int64()), pa.array([*b, *[None] * len(counts)], pa.int64()),
                 pa.array([*[0] * len(a), *counts.values()], pa.int64())], ["a", "b", "n"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != group:
                    settle()
                    group, held = row[:3], []
                    if len(counts) >= OUT_ROWS:
                        yield from told()
                        stars, counts = Stars(), {}
                held.append(row[3:])
        settle()
        yield from told()

    parts = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return parts.mapInArrow(run, "a bigint, b bigint, n bigint")


def group_links(rows: list[tuple[int, int, bool, str]], group: tuple[int, int, int] | None, keys: Keys) -> Iterator[tuple[int, int]]:
    """Links among (block, id, own, line) of one key and pair of blocks: the shorter line holds the key by its own segment."""
    if len(rows) < 2:
        return
    key, lo, hi = group
    for block, s, own, short in rows:
        if not own:
            continue
        mine = [x - (x >> 63 << 64) for x in keys.of(short)[0]]
        for other, r, _, line in rows:
            if (lo != hi and block == other) or len(line) - len(short) > keys.edits or (len(short), s) >= (len(line), r):
                continue
            first = keys.witness(short, line)
            if first is not None and mine[first] == key and edit_distance(short, line, keys.edits) <= keys.edits:
                yield s, r


def near_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, class_id, n_links) of the lines that have a link; id and class_id (the smallest id reachable) have a low bit of 0."""
    met = written(_met(_key_rows(docs, edits, min_chars)), "line-keys")
    lines = _line_rows(docs, min_chars).join(met.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    links = written(_links(met.join(lines, "id"), edits, min_chars), "line-links")
    counts = links.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_links")).filter("n_links > 0")
    return components(links.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("root", "class_id").join(counts, "id")


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, id, n_chars) of every line that is not blank; line_no counts from 0 and includes blank lines."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    line = F.btrim("line", F.lit(SPACES))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"),
                        F.xxhash64(line).bitwiseAND(-2).alias("id"), F.length(line).cast("long").alias("n_chars")).filter("n_chars > 0")


def classed(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, line_no, n_chars, line_id, class_id, n_links) of every line: equal line_id for copies, equal class_id for linked lines."""
    near = written(near_lines(docs, edits, min_chars), "line-classes")
    return occurrences(docs).join(near, "id", "left").select(
        "doc_id", "line_no", "n_chars", F.col("id").alias("line_id"), F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def without_repeats(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Documents without the lines of at least ``min_chars`` characters of which a class member stands before.

    The first of a class is that with the smallest doc_id, then line number. Shorter lines stay. A
    document that loses lines and has no word left is dropped; n_chars, where there is such a column,
    follows the text.
    """
    rows = written(classed(docs, edits, min_chars).filter(F.col("n_chars") >= min_chars).select(
        F.struct("doc_id", "line_no").alias("at"), "class_id"), "line-places")
    first = rows.groupBy("class_id").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1")
    repeats = rows.join(first, "class_id").filter("at != first").select("at.*").distinct()
    gone = repeats.groupBy(F.col("doc_id").alias("of")).agg(F.collect_list("line_no").alias("gone"))
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    # the row travels as one struct, so no column of it can meet one of ours
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), "text", F.col("doc_id").alias("known"))
    joined = whole.join(gone, F.col("known").eqNullSafe(F.col("of")), "left").select(
        "row", "text", F.coalesce("gone", F.array().cast("array<bigint>")).alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if gone and text is not None:
                    out = set(gone)
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in out)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()),
                                              pa.compute.list_value_length(batch.column(2))], ["row", "text", "gone"])

    schema = StructType([joined.schema["row"], StructField("text", StringType()), StructField("gone", IntegerType())])
    kept = joined.mapInArrow(run, schema).filter(
        (F.col("gone") == 0) | (F.btrim("text", F.lit(SPACES)) != ""))
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return kept.select(*[own[c].alias(c) if c in own else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
