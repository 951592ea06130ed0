"""Benchmark decontamination by latent semantic retrieval.

Benchmark items and documents are lower-cased runs of letters and digits, cut into
passages of ``PASSAGE`` words, a new one every ``STRIDE`` words. The items are worked on
in blocks of about ``BLOCK_PASSAGES`` passages, so what is sent to the tasks is bounded
whatever the benchmark's size; every block is held against all documents.

1. Document frequencies of all words are counted over all documents. A word weighs
   ln((N + 1) / (df + 1)), held between ``FLOOR`` and ln(``RARE``), whether the block has it or not: weights
   follow the share of documents, not their number, and a word that is in every document
   still weighs something, so every item passage is indexed. Words in fewer than one document in ``RARE``
   weigh all the same, so the table of the others has at most RARE times the words of a document.
2. A randomised SVD of the block's TF-IDF passages is computed in Spark: the passages
   are multiplied by a random matrix, the small Gram matrix of the products gives an
   orthonormal basis, and the passages projected on it give the right singular vectors.
   Only matrices of the sketch's size and sketch times block words reach the driver.
3. Each document passage is projected; items with a passage of cosine ``MIN_COSINE`` or
   more are candidates. Passages whose words could not reach that cosine with any item passage, had each word
   the largest weight it has in one, are not projected. Besides, items are candidates of every passage
   where ``GRAM`` of their words stand in a row (all words of items of ``LEAST_GRAM`` to GRAM words),
   whatever the cosine, so copies are found however common an item is. Items of fewer words are found by cosine alone.
4. A candidate is verified on the words around the passage: the longest common
   subsequence with the item as a share of the item's words, and the share of the item's
   answer (its last quarter) that is matched there in order. It is a leak at ``COPY_SHARE`` of
   the item, or at ``LCS_SHARE`` of the item with ``ANSWER_SHARE`` of its answer.

Null and empty texts and items match nothing; repeated rows are searched row by row; a
null doc_id is kept; items equal in text are reported each; no benchmark rows or no
documents give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assaykit.llm.common import written
from assaykit.llm.licenses import Scanner

PASSAGE, STRIDE, BLOCK_PASSAGES, SKETCH = 32, 16, 512, 384
RARE, FLOOR, MIN_COSINE = 1024, 0.1, 0.3
GRAM, LEAST_GRAM = 5, 3
COPY_SHARE, LCS_SHARE, ANSWER_SHARE = 0.9, 0.6, 0.6
#: Words of documents worked on at once; passages projected at once.
BLOCK_WORDS, PROJECT_ROWS = 1 << 18, 1 << 13
#: Words counted by a task before they are handed on.
COUNTED_WORDS = 1 << 18


def words_of(text: str | None) -> list[bytes]:
    return Scanner.split((text or "").encode().lower())


def starts(n: int) -> range:
    """First words of the passages of a text of ``n`` words."""
    return range(0, max(1, n - (PASSAGE - STRIDE)), STRIDE)


def lcs(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, bit-parallel over the words of ``a``."""
    return common_words(a, b)[0]


def common_words(a: list[bytes], b: list[bytes]) -> tuple[int, int]:
    """Length of the longest common subsequence; and of that of the last quarter of ``a`` (at least three words)."""
    at: dict[bytes, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    answer = max(0, len(a) - max(3, len(a) // 4))
    out = []
    for low in (0, answer):
        n = len(a) - low
        full = (1 << n) - 1
        row = full
        for w in b:
            if m := at.get(w, 0) >> low:
                u = row & m
                row = (row + u | row - u) & full
        out.append(n - row.bit_count())
    return out[0], out[1]


@dataclass
class Index:
    """One block of items: words with weights, right singular vectors, and the items' passages in latent space."""
    vocabulary: dict[bytes, int]    # the block's words, then other words that are not rare
    weight: np.ndarray              # by word
    other: float                    # weight of all other words
    vectors: np.ndarray             # words of the block x rank
    passages: np.ndarray            # passages x rank, divided by their TF-IDF norm
    item_of: np.ndarray             # passage -> place in items
    items: list[tuple[int, list[bytes]]]


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(word, n): number of texts that hold each word; counted in the tasks, summed in Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                              ["word", "n"])
        for batch in batches:
            for text in batch.column(0):
                counts.update(set(words_of(text.as_py())))
                if len(counts) >= COUNTED_WORDS:
                    yield told()
                    counts.clear()
        yield told()

    return docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """Element-wise sums of (row, values) over tasks."""
    total = parts.groupBy("row").agg(F.collect_list("values").alias("all")).select("row", F.aggregate(
        F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.get("all", F.lit(0)),
        lambda x, y: F.zip_with(x, y, lambda p, q: p + q)).alias("values"))
    return {r["row"]: np.array(r["values"]) for r in total.collect()}


def randomised_svd(passages: DataFrame, size: int, sketch: int = SKETCH, seed: int = 11) -> np.ndarray:
    """words x rank right singular vectors of a sparse matrix of rows (words array<int>, weights array<double>).

    Each task multiplies its rows; sums over tasks are made in Spark. The rank is the smaller of
    ``sketch`` and the rank of the rows.
    """
    random = np.random.default_rng(seed).standard_normal((size, min(sketch, size)))
    context = passages.sparkSession.sparkContext
    sent = context.broadcast(random)

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for w, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield np.array(w, np.int64), np.array(x, float)

    def matrix(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total))], ["row", "values"])

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((sent.value.shape[1],) * 2)
        for batch in batches:
            for w, x in rows(batch):
                y = x @ sent.value[w]
                total += np.outer(y, y)
        yield matrix(total)

    sums = _summed(passages.mapInArrow(gram, "row bigint, values array<double>"))
    values, basis = np.linalg.eigh(np.array([sums[i] for i in range(len(sums))]))
    good = values > values.max() * 1e-10
    whiten = context.broadcast(random @ (basis[:, good] / np.sqrt(values[good])))     # words -> orthonormal columns

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(whiten.value.shape)                                          # words x rank
        for batch in batches:
            for w, x in rows(batch):
                total[w] += np.outer(x, x @ whiten.value[w])
        yield matrix(total)

    sums = _summed(passages.mapInArrow(project, "row bigint, values array<double>"))
    left, singular, _ = np.linalg.svd(np.array([sums[i] for i in range(size)]), full_matrices=False)
    return left[:, singular > singular.max() * 1e-6]


def build_index(docs: DataFrame, n_docs: int, items: list[tuple[int, str]], frequencies: DataFrame | None = None) -> Index | None:
    """Index of one block of items (so many that they are bounded by the block's size)."""
    split = [(i, words_of(t)) for i, t in items]
    split = [(i, w) for i, w in split if w]
    vocabulary: dict[bytes, int] = {}
    for _, words in split:
        for w in words:
            vocabulary.setdefault(w, len(vocabulary))
    if not vocabulary:
        return None
    spark, size = docs.sparkSession, len(vocabulary)
    frequencies = document_frequencies(docs) if frequencies is None else frequencies
    block = spark.createDataFrame([(bytearray(w),) for w in vocabulary], "word binary")
    found = frequencies.join(F.broadcast(block.withColumn("inside", F.lit(True))), "word", "left").filter(
        F.col("inside") | (F.col("n") * RARE > n_docs)).select("word", "n").toArrow()
    counts = dict(zip(found["word"].to_pylist(), found["n"].to_pylist()))
    for w in counts:
        vocabulary.setdefault(w, len(vocabulary))
    df = np.array([counts.get(w, 0) for w in vocabulary])
    weight = np.clip(np.log((n_docs + 1) / (df + 1)), FLOOR, log(RARE))
    rows, item_of = [], []
    for k, (_, words) in enumerate(split):
        for s in starts(len(words)):
            ids = np.array([vocabulary[w] for w in words[s:s + PASSAGE]])
            norm = float(np.sqrt((weight[ids] ** 2).sum()))
            rows.append((ids.tolist(), (weight[ids] / norm).tolist()))
            item_of.append(k)
    vectors = randomised_svd(spark.createDataFrame(rows, "words array<int>, weights array<double>"), size)
    passages = np.stack([np.array(x) @ vectors[w] for w, x in rows])
    return Index(vocabulary, weight, min(log(n_docs + 1), log(RARE)), vectors.astype(np.float32), passages.astype(np.float32),
                 np.array(item_of), split)


def gram_hashes(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` words from each place on; equal ones of different words only cost a check."""
    out = np.zeros(len(at), np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[at + i].astype(np.uint64) + np.uint64(1)
    return out


class Searcher:
    def __init__(self, index: Index):
        self.index = index
        self.weight = np.append(index.weight, index.other)         # the last for words that the vocabulary has not
        self.square = self.weight ** 2
        self.inside = np.where(np.arange(len(self.square)) < len(index.vectors), self.square, 0.0)
        self.reach = np.zeros(len(self.weight))                    # the most that a word adds to a product with an item passage
        for _, item in index.items:
            for s in starts(len(item)):
                ids = np.array([index.vocabulary[w] for w in item[s:s + PASSAGE]], np.int64)
                words, counts = np.unique(ids, return_counts=True)
                self.reach[words] = np.maximum(self.reach[words], counts * self.weight[words] / np.sqrt(self.square[ids].sum()))
        self.reach *= self.weight
        self.passages_of = np.searchsorted(index.item_of, np.arange(len(index.items) + 1))
        grams: dict[int, dict[int, set[int]]] = {}                 # length -> hash -> items
        for k, (_, item) in enumerate(index.items):
            if len(item) >= LEAST_GRAM:
                n = min(GRAM, len(item))
                ids = np.array([index.vocabulary[w] for w in item], np.int64)
                for h in gram_hashes(ids, np.arange(len(ids) - n + 1), n).tolist():
                    grams.setdefault(n, {}).setdefault(h, set()).add(k)
        self.grams = {n: (np.sort(np.fromiter(found, np.uint64, len(found))), found) for n, found in grams.items()}

    def copies(self, ids: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, place, item) where words of an item stand in a row; begins: first word of each text, and the end."""
        runs = np.append(0, np.cumsum(ids < len(self.index.vectors)))
        for n, (keys, items) in self.grams.items():
            at = np.flatnonzero(runs[n:] - runs[:-n] == n)
            hashes = gram_hashes(ids, at, n)
            hit = keys[np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)] == hashes
            at, hashes = at[hit], hashes[hit]
            text = np.searchsorted(begins, at, "right") - 1
            whole = at + n <= begins[text + 1]
            for t, p, h in zip(text[whole].tolist(), at[whole].tolist(), hashes[whole].tolist()):
                for k in items[h]:
                    yield t, p, k

    def candidates(self, ids: np.ndarray, first: np.ndarray, last: np.ndarray,
                   copied: set[tuple[int, int]] = frozenset()) -> Iterator[tuple[int, int, float]]:
        """(passage, item, cosine) of passages first to last (word places, end excluded): at MIN_COSINE or more, and those ``copied``."""
        index = self.index
        more: dict[int, list[int]] = {}
        for p, k in copied:
            more.setdefault(p, []).append(k)
        whole, part = (np.append(0.0, np.cumsum(x[ids])) for x in (self.square, self.reach))
        norm, own = whole[last] - whole[first], part[last] - part[first]
        wanted = (own > 0) & (own >= MIN_COSINE * np.sqrt(norm) * (1 - 1e-6))
        wanted[list(more)] = True
        near = np.flatnonzero(wanted)
        for at in range(0, len(near), PROJECT_ROWS):
            rows = near[at:at + PROJECT_ROWS]
            sizes = last[rows] - first[rows]
            place = np.repeat(first[rows], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            owner, word = np.repeat(np.arange(len(rows)), sizes), ids[place]
            used = self.inside[word] > 0
            owner, word = owner[used], word[used]
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            latent = np.add.reduceat(index.vectors[word] * self.weight[word, None].astype(np.float32), begin, axis=0)
            cosine = latent @ index.passages.T / np.sqrt(norm[rows])[:, None]
            x, y = np.nonzero(cosine >= MIN_COSINE)
            yield from zip(rows[x].tolist(), index.item_of[y].tolist(), cosine[x, y].tolist())
            for x, p in enumerate(rows.tolist() if more else ()):
                for k in more.get(p, ()):
                    yield p, k, float(cosine[x, self.passages_of[k]:self.passages_of[k + 1]].max())

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, float, float, float, int]]:
        """(text, item_id, cosine, lcs_share, answer_share, first word of the passage): the best verified match of each text and item."""
        get, words = self.index.vocabulary.get, [words_of(t) for t in texts]
        none = len(self.index.vocabulary)
        ids = np.fromiter((i for w in words for i in map(get, w, repeat(none))), np.int64, sum(map(len, words)))
        begins = np.cumsum([0, *map(len, words)])
        parts = [begins[k] + np.array(starts(len(w))) for k, w in enumerate(words)]
        first = np.concatenate(parts)
        text_of = np.repeat(np.arange(len(words)), [len(p) for p in parts])
        last = np.minimum(first + PASSAGE, begins[text_of + 1])
        passage = np.cumsum([0, *map(len, parts)])
        copied = {(int(min(passage[t] + (p - begins[t]) // STRIDE, passage[t + 1] - 1)), k) for t, p, k in self.copies(ids, begins)}
        near: dict[tuple[int, int], float] = {}         # several passages of one item: the best cosine
        for p, k, cosine in self.candidates(ids, first, last, copied):
            near[p, k] = max(cosine, near.get((p, k), 0.0))
        best: dict[tuple[int, int], tuple] = {}
        for (p, k), cosine in near.items():
            t, item = int(text_of[p]), self.index.items[k][1]
            low = int(first[p] - begins[t])
            around = words[t][max(0, low - len(item)):low + PASSAGE + len(item)]
            seen = set(around)
            if sum(w in seen for w in item) < LCS_SHARE * len(item):
                continue
            both, answer = common_words(item, around)
            share, answer_share = both / len(item), answer / min(len(item), max(3, len(item) // 4))
            if share >= COPY_SHARE or (share >= LCS_SHARE and answer_share >= ANSWER_SHARE):
                found = (share, answer_share, cosine, -low)
                if found > best.get((t, k), (0,)):
                    best[t, k] = found
        for (t, k), (share, answer_share, cosine, low) in best.items():
            yield t, self.index.items[k][0], min(1.0, cosine), share, answer_share, -low


def search(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Matches of one block of items against all documents, one row per document row and item."""
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(sent.value)

        def found(rows: list[int], texts: list[str], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            hits = list(searcher.search(texts))
            if hits:
                t, *columns = zip(*hits)
                types = (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([rows[i] for i in t])), *[pa.array(c, k) for c, k in zip(columns, types)]],
                    ["doc_id", "item_id", "cosine", "lcs_share", "answer_share", "first_word"])

        for batch in batches:
            rows, texts, size = [], [], 0
            for i, text in enumerate(batch.column(1)):
                texts.append(text.as_py())
                rows.append(i)
                size += len(texts[-1]) // 6
                if size >= BLOCK_WORDS:
                    yield from found(rows, texts, batch)
                    rows, texts, size = [], [], 0
            if texts:
                yield from found(rows, texts, batch)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL AND text != ''")
    return rows.mapInArrow(run, "doc_id bigint, item_id bigint, cosine double, lcs_share double, answer_share double, first_word bigint")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share, first_word): verified matches of every document with every item."""
    items = benchmark.filter("text IS NOT NULL").select("item_id", "text", (F.ceil(
        F.size(F.split("text", r"\s+")) / STRIDE)).alias("n"))
    n_docs, passages = docs.count(), items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, ceil(passages / BLOCK_PASSAGES))
    frequencies = written(document_frequencies(docs), "document-frequencies")
    out = None
    for k in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text")
        index = build_index(docs, n_docs, [(r["item_id"], r["text"]) for r in block.collect()], frequencies)
        if index:
            found = search(docs, index)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, cosine double, lcs_share double, "
                                                     "answer_share double, first_word bigint")
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a match; a null doc_id goes when any such document matches."""
    found = written(leaks(docs, benchmark).select(F.col("doc_id").alias("of")).distinct(), "leaks")
    # the row travels as one struct, so no column of it can meet one of ours
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("known"))
    return whole.join(found, F.col("known").eqNullSafe(F.col("of")), "left_anti").select("row.*")
