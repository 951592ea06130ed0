"""Periodic runs of words, found in a Re-Pair grammar.

The words of a text are numbered and Re-Pair replaces the most frequent pair of adjacent
symbols by a new nonterminal until no pair occurs twice. Since a replaced pair keeps the
place of its first word, the places where a rule was applied are all derivation positions
of its nonterminal. The symbols that remain are joined by an implicit balanced tree, each
of whose nodes is a nonterminal with one position. A run lies inside a smallest
nonterminal that holds it and there crosses the boundary between its two sides, so for
every nonterminal the runs across its boundary are computed once, within its expansion,
then moved to all its positions; intervals of one period that share a period are merged.

A run is a maximal stretch with smallest period q and length of at least
``max(MIN_WORDS, REPEATS * q)``. Half of one that crosses a boundary holds at least 12
words and 1.5 periods on one side, so the four words at the boundary come back one period
away, which gives the candidate periods; tables of equal substrings of 2**k words
(doubled while any substring repeats) give the common extensions of all candidates at
once, exactly. Time is O(n log n) but for candidates, which are taken in blocks of
``BLOCK``; memory is O(n log n) for one text, which one task holds.

Words are what ASCII white space separates. Null and blank texts have no word and no run;
a null id is never planted; rows count one by one, equal or not; without rows the result
is empty; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MIN_WORDS, REPEATS = 24, 3
#: 2**CONTEXT_LEVEL words around a boundary must come back one period away (holds up to a sixth of MIN_WORDS).
CONTEXT_LEVEL = 2
#: Candidate periods that are extended at once.
BLOCK = 1 << 18


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, in the order of their first places."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def substring_names(ids: np.ndarray) -> list[np.ndarray]:
    """names[k][i] tells the substring of 2**k words at i from all others; up to the first k where none repeats."""
    names, k = [ids], 0
    while len(names[k]) > 1 << k and (k < CONTEXT_LEVEL or len(names[k]) > names[k].max() + 1):
        now = names[k]
        names.append(np.unique(now[:len(now) - (1 << k)] * len(ids) + now[1 << k:], return_inverse=True)[1])
        k += 1
    return names


def grammar(ids: np.ndarray, repeated: np.ndarray) -> tuple[list[tuple[list[int], int, int]], list[int]]:
    """Re-Pair: rules as (positions, words of the left side, words of both) and the places of the symbols that remain.

    ``repeated`` are the places, in order, whose pair of words occurs more than once. A pair's places are checked when
    it comes up; if some are gone it goes back by the number that is left.
    """
    n = len(ids)
    sym, after, before = [*ids.tolist(), -2], list(range(1, n + 1)), list(range(-1, n))
    fresh, wide = int(ids.max()) + 1, 2 * n + 1
    places: dict[int, list[int]] = {}
    for i in repeated.tolist():
        places.setdefault(sym[i] * wide + sym[i + 1], []).append(i)
    queue = [(-len(at), pair) for pair, at in places.items()]
    heapq.heapify(queue)
    rules = []
    while queue:
        expected, pair = heapq.heappop(queue)
        left, right = divmod(pair, wide)
        at, taken = [], -1
        for i in places.pop(pair):
            if i != taken and sym[i] == left and sym[after[i]] == right:
                at.append(i)
                taken = after[i]
        if len(at) < 2:
            continue
        if len(at) < -expected:
            places[pair] = at
            heapq.heappush(queue, (-len(at), pair))
            continue
        j = after[at[0]]
        rules.append((at, j - at[0], after[j] - at[0]))
        for i in at:
            j = after[i]
            sym[i], sym[j] = fresh, -1
            k = after[i] = after[j]
            before[k] = i
        new: dict[int, list[int]] = {}
        for i in at:
            b, k = before[i], after[i]
            if b >= 0 and sym[b] != fresh:
                new.setdefault(sym[b] * wide + fresh, []).append(b)
            if k < n:
                new.setdefault(fresh * wide + sym[k], []).append(i)
        for pair, found in new.items():
            if len(found) > 1:
                places[pair] = found
                heapq.heappush(queue, (-len(found), pair))
        fresh += 1
    return rules, [i for i in range(n) if sym[i] != -1]


def _common(names: list[np.ndarray], x: np.ndarray, y: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
    """How many words from x and y on (``back``: before them) are equal, at most ``limit``."""
    got = np.zeros(len(x), np.int64)
    for k in range(len(names) - 1, -1, -1):
        width, name = 1 << k, names[k]
        fits = got + width <= limit
        step = -got - width if back else got
        u, v = np.where(fits, x + step, 0), np.where(fits, y + step, 0)
        got += np.where(fits & (name[u] == name[v]), width, 0)
    return got


def _across(names: list[np.ndarray], lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Rows (boundary, start, end, period) of the runs within [lo, hi) that cross the boundary at mid."""
    context, n = names[CONTEXT_LEVEL], len(names[0])
    width = 1 << CONTEXT_LEVEL
    keys = np.sort(context * n + np.arange(len(context)))
    found = []
    for right in (True, False):
        at = mid - 1 if right else mid - width + 1
        reach = (hi - mid if right else mid - lo) * 2 // REPEATS
        use = np.flatnonzero((at >= lo) & (at + width <= hi) & (reach > 0))
        here = context[at[use]] * n
        first, last = ((at[use] + 1, np.minimum(at[use] + reach[use], hi[use] - width)) if right else
                       (np.maximum(at[use] - reach[use], lo[use]), at[use] - 1))
        begin = np.searchsorted(keys, here + first)
        many = np.maximum(np.searchsorted(keys, here + last, "right") - begin, 0)
        ends = np.cumsum(many)
        total = int(ends[-1]) if len(ends) else 0
        for c in range(0, total, BLOCK):
            nth = np.arange(c, min(c + BLOCK, total))
            which = np.searchsorted(ends, nth, "right")
            b = use[which]
            other = keys[begin[which] + nth - (ends[which] - many[which])] - here[which]
            period = np.abs(other - at[b])
            x = mid[b] if right else mid[b] - period
            y = x + period
            start = x - _common(names, x, y, x - lo[b], True)
            end = y + _common(names, x, y, hi[b] - y, False)
            ok = (end - start >= np.maximum(MIN_WORDS, REPEATS * period)) & (start < mid[b]) & (end > mid[b])
            found.append(np.stack([b, start, end, period])[:, ok])
    if not found:
        return np.empty((0, 4), np.int64)
    rows = np.concatenate(found, axis=1)
    rows = rows[:, np.lexsort(rows[::-1])]          # of one interval's periods the smallest comes first
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)
    return rows[:, new].T


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period; ``ids`` are numbers from 0 without gaps."""
    if len(ids) < MIN_WORDS:
        return []
    names = substring_names(ids)
    rules, left = grammar(ids, np.flatnonzero(np.bincount(names[1])[names[1]] > 1))
    long = [rule for rule in rules if rule[2] >= MIN_WORDS]
    of_rules = np.array([(at[0], at[0] + side, at[0] + size) for at, side, size in long], np.int64).reshape(-1, 3).T
    places, j = np.array([*left, len(ids)], np.int64), np.arange(1, len(left))
    low = j & -j                                    # boundary j of the balanced tree stands between 2 * low symbols
    of_tree = np.stack([places[j - low], places[j], places[np.minimum(j + low, len(left))]])
    of_tree = of_tree[:, of_tree[2] - of_tree[0] >= MIN_WORDS]
    met = _across(names, *np.concatenate([of_rules, of_tree], axis=1)).tolist()
    moved = []
    for b, start, end, period in met:
        at = long[b][0] if b < len(long) else [0]
        moved += [(period, start + i - at[0], end + i - at[0]) for i in at]
    merged: list[list[int]] = []
    for period, start, end in sorted(moved):
        if merged and merged[-1][0] == period and merged[-1][2] - start >= period:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([period, start, end])
    return sorted((start, end - start, period) for period, start, end in merged)


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the report's test repetition: of every tenth document (by crc32 of its id) the end becomes periodic."""
    h = zlib.crc32(b"%d" % doc_id) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that are not in a run, or in its first period only."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    inside = np.cumsum(edge)[:-1] > 0
    return [w for w, drop in zip(words, inside.tolist()) if not drop] if found else words


def longest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length over period; ties: smallest start, then period."""
    best = None
    for run in found:                               # by start and period: a tie stays with the earlier
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                    ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()),
                    ("collapsed_sha256", pa.string())])
REPORT = ("doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
          "runs_sha256 string, collapsed_sha256 string")


def report_row(doc_id: int | None, text: str | None, plant: bool = True) -> tuple:
    words = (text or "").encode().split()           # bytes: split() takes ASCII white space only
    if plant:
        words = planted(words, doc_id)
    found = runs(numbered(words))
    best = longest(found)
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{l},{q}\n" for s, l, q in found)
    return (doc_id, len(found), *told, hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(b" ".join(collapse(words, found))).hexdigest())


def run_report(docs: DataFrame, plant: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its runs and the text without repetitions, as digests; ``plant``: see :func:`planted`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [report_row(i, t.as_py(), plant) for i, t in zip(batch.column(0).to_pylist(), batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)]
                                             if rows else [pa.array([], f.type) for f in _ARROW], schema=_ARROW)

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, REPORT))


def document_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, period) of every run of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = runs(numbered((text.as_py() or "").encode().split()))
                if found:
                    s, l, q = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(found), pa.int64()), *(
                        pa.array(c, pa.int64()) for c in (s, l, q))], ["doc_id", "start", "length", "period"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "doc_id bigint, start bigint, length bigint, period bigint"))


def without_repetition(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with the words of each run after its first period taken out of their texts.

    A text without a run stays as it is; the words that stay of any other are joined by one space.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column(column):
                text = text.as_py()
                words = (text or "").encode().split()
                found = runs(numbered(words))
                texts.append(b" ".join(collapse(words, found)).decode() if found else text)
            yield batch.set_column(column, batch.schema.field(column), pa.array(texts, batch.schema.field(column).type))

    column = docs.columns.index(text_col)
    return docs.mapInArrow(run, docs.schema)
