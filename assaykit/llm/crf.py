"""Language identification by a linear-chain conditional random field over words.

Words (runs of letters, lower-cased) carry hashed features: prefixes and suffixes
of one to three letters, letter pairs and triples with word ends, and membership
in a lexicon per language. Emission and transition weights are learned together by
gradient ascent on the likelihood of word labels, on sequences spliced from
documents of different languages so that transitions learn how seldom the
language changes inside a text. Prediction runs forward-backward over all words of
a text; the language is the one with the largest mean posterior, the score is that
mean.

The classifier is fitted on a bounded sample: at most ``SAMPLE_BUCKETS`` documents
of each language, each of at most ``SAMPLE_CHARS`` characters, the one with the
smallest id hash in each of so many id buckets of the whole table. Prediction covers every
word of every text.

A null text or one without a letter gets ``und`` and score 0; so does every text
when nothing is labelled. A null doc_id is never held out; repeated rows are
predicted row by row; equal posteriors go to the label first in order.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from assaykit.llm.common import held_out, written

UNKNOWN = "und"
SAMPLE_BUCKETS, SAMPLE_CHARS = 96, 6_000
#: Hashed feature buckets, gradient steps, weight decay, words of a spliced sequence and of a span in it.
FEATURES, STEPS, DECAY, SEQUENCE, SPAN = 1 << 15, 30, 1e-3, 64, (8, 64)
#: A lexicon word: seen so often in the sample, and with this share in one language.
LEXICON_COUNT, LEXICON_SHARE = 3, 0.9
#: Words predicted at once, words of a chunk in forward-backward, remembered words.
BATCH_WORDS, CHUNK, CACHE_WORDS = 300_000, 128, 400_000

#: Characters that patterns take for word characters though they are no letters: fractions, superscripts, Roman numerals.
_NUMERALS = [c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()]
#: One table look-up a character up to U+FFFF; the others are only looked for in texts that go beyond it.
_NUMERAL = re.compile("[" + "".join(c for c in _NUMERALS if c <= "\uffff") + "]")
_HIGH_NUMERAL = re.compile("[" + "".join(c for c in _NUMERALS if c > "\uffff") + "]")
_letters = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """The runs of letters (Unicode categories L) of a text."""
    if not text.isascii():
        if _NUMERAL.search(text):
            text = _NUMERAL.sub(" ", text)
        if max(text) > "\uffff":
            text = _HIGH_NUMERAL.sub(" ", text)
    return _letters(text)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray            # features x labels
    transition: np.ndarray         # labels x labels, log scores
    start: np.ndarray              # labels, log scores
    lexicon: dict[str, int]        # word -> label index


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Hashed feature buckets of a lower-case word."""
    w = f"^{word}$"
    names = [f"p{w[1:k]}" for k in range(2, min(5, len(w)))] + [f"s{w[-k:-1]}" for k in range(2, min(5, len(w)))]
    names += [w[i:i + 2] for i in range(len(w) - 1)] + [w[i:i + 3] for i in range(len(w) - 2)]
    if word in lexicon:
        names.append(f"lex {lexicon[word]}")
    return [crc32(x.encode()) % FEATURES for x in names]


def feature_rows(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Flat feature buckets of all words and where each word's begin (every word has some)."""
    lists = [features(w, lexicon) for w in words]
    begins = np.cumsum([0, *map(len, lists)])[:-1]
    return np.fromiter((f for x in lists for f in x), np.int64, sum(map(len, lists))), begins


def posteriors(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Forward-backward label posteriors of words of many texts laid end to end.

    ``emission``: words x labels log scores; ``first``: True at the first word of each text. The
    words are cut into chunks; each chunk's transfer matrix is built for all chunks at once, the
    chunks are chained, then forward and backward messages are run inside all chunks at once.
    """
    n, k = emission.shape
    chunks = -(-n // CHUNK)
    pad = chunks * CHUNK - n
    e = np.exp(emission - emission.max(axis=1, keepdims=True))
    e = np.concatenate([e, np.ones((pad, k))]).reshape(chunks, CHUNK, k)
    new = np.concatenate([first, np.ones(pad, bool)]).reshape(chunks, CHUNK)
    a, s = np.exp(transition - transition.max()), np.exp(start - start.max())

    def step(m: np.ndarray, t: int) -> np.ndarray:      # m: chunks x rows x labels, before word t
        out = np.where(new[:, t, None, None], m.sum(axis=2, keepdims=True) * s, m @ a) * e[:, t, None, :]
        return out / np.maximum(out.max(axis=(1, 2), keepdims=True), 1e-300)

    whole = np.broadcast_to(np.eye(k), (chunks, k, k))
    for t in range(CHUNK):
        whole = step(whole, t)
    into, back = np.empty((chunks, 1, k)), np.empty((chunks, k))
    m = np.full(k, 1.0 / k)
    for c in range(chunks):
        into[c, 0] = m
        m = m @ whole[c]
        m = m / m.sum()
    b = np.ones(k)
    for c in range(chunks - 1, -1, -1):
        back[c] = b
        b = whole[c] @ b
        b = b / b.sum()
    alpha, m = np.empty((chunks, CHUNK, k)), into
    for t in range(CHUNK):
        m = step(m, t)
        alpha[:, t] = m[:, 0]
    gamma, b = np.empty((chunks, CHUNK, k)), back
    for t in range(CHUNK - 1, -1, -1):
        gamma[:, t] = alpha[:, t] * b
        v = e[:, t] * b                                   # message to the word before t
        b = np.where(new[:, t, None], (v @ s)[:, None], v @ a.T)
        b = b / np.maximum(b.max(axis=1, keepdims=True), 1e-300)
    gamma = gamma.reshape(-1, k)[:n]
    return gamma / gamma.sum(axis=1, keepdims=True)


def spliced(texts: list[tuple[str, list[str]]], rng: random.Random) -> list[list[tuple[str, str]]]:
    """Sequences of (word, label) of SEQUENCE words: spans of one document each, put together at random."""
    spans = []
    for label, words in texts:
        at = 0
        while at < len(words):
            size = rng.randint(*SPAN)
            spans.append([(w, label) for w in words[at:at + size]])
            at += size
    rng.shuffle(spans)
    flat = [x for s in spans for x in s]
    return [flat[i:i + SEQUENCE] for i in range(0, len(flat), SEQUENCE)]


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Model | None:
    """A model of (label, text) rows; None when no row has a label and a letter."""
    texts = [(label, words_of(text.lower())) for label, text in rows]
    texts = [(label, words) for label, words in texts if words]
    labels = sorted({label for label, _ in texts})
    if not labels:
        return None
    index, k = {x: i for i, x in enumerate(labels)}, len(labels)
    counts = {x: Counter() for x in labels}
    for label, words in texts:
        counts[label].update(words)
    total = sum(counts.values(), Counter())
    lexicon = {w: index[x] for x in labels for w, c in counts[x].items()
               if total[w] >= LEXICON_COUNT and c >= LEXICON_SHARE * total[w]}
    sequences = spliced(texts, random.Random(seed))
    types = {w: i for i, w in enumerate(total)}
    flat, begins = feature_rows(list(types), lexicon)
    owner = np.repeat(np.arange(len(types)), np.diff(np.append(begins, len(flat))))
    word = np.array([types[w] for s in sequences for w, _ in s])
    gold = np.array([index[y] for s in sequences for _, y in s])
    first = np.zeros(len(word), bool)
    first[np.cumsum([0, *map(len, sequences)])[:-1]] = True
    inside = np.flatnonzero(~first)
    size = FEATURES * k
    theta = np.zeros(size + k * k + k)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    gold_pairs = np.bincount(gold[inside - 1] * k + gold[inside], minlength=k * k)
    for t in range(1, STEPS + 1):
        weights, trans, start = theta[:size].reshape(FEATURES, k), theta[size:size + k * k].reshape(k, k), theta[-k:]
        scores = np.add.reduceat(weights[flat], begins, axis=0)[word]
        gamma = posteriors(scores, first, trans, start)
        # pair posteriors, in proportion to gamma of the word before, the transition and the message from behind
        pairs = _pair_counts(scores, first, trans, start, gamma, inside)
        miss = -gamma
        miss[np.arange(len(gold)), gold] += 1
        by_type = np.stack([np.bincount(word, miss[:, y], len(types)) for y in range(k)], axis=1)
        grad = np.concatenate([
            np.stack([np.bincount(flat, by_type[owner, y], FEATURES) for y in range(k)], axis=1).ravel(),
            gold_pairs - pairs.ravel(), miss[first].sum(axis=0)]) / len(word) - DECAY * theta / size
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        theta = theta + 0.3 / t ** 0.3 * (mean / (1 - 0.9 ** t)) / (np.sqrt(square / (1 - 0.99 ** t)) + 1e-8)
    return Model(labels, theta[:size].reshape(FEATURES, k).astype(np.float32), theta[size:size + k * k].reshape(k, k),
                 theta[-k:], lexicon)


def _pair_counts(scores, first, trans, start, gamma, inside) -> np.ndarray:
    """Expected label pairs of neighbouring words of one sequence.

    p(y, z) = p(z) p(y | z): the label before z depends on the words up to it alone, so it needs
    the forward message, which a second call with flattened scores behind gives up to scale.
    """
    k = gamma.shape[1]
    alpha = forward(scores, first, trans, start)
    back = alpha[inside - 1][:, :, None] * np.exp(trans - trans.max())[None]
    back = back / np.maximum(back.sum(axis=1, keepdims=True), 1e-300)
    return (back * gamma[inside][:, None, :]).sum(axis=0).reshape(k, k)


def forward(scores: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Normalised forward messages of sequences laid end to end, all of SEQUENCE words but the last."""
    n, k = scores.shape
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    a, s, out = np.exp(trans - trans.max()), np.exp(start - start.max()), np.empty((n, k))
    heads = np.flatnonzero(first)
    ends = np.append(heads[1:], n)
    m = np.broadcast_to(s, (len(heads), k))
    for t in range(int((ends - heads).max(initial=0))):
        live = np.flatnonzero(heads + t < ends)
        m = (m[live] if t == 0 else m[live] @ a) * e[heads[live] + t]
        m = m / m.sum(axis=1, keepdims=True)
        out[heads[live] + t] = m
        heads, ends = heads[live], ends[live]
    return out


class Tagger:
    """Predicts texts with one model; remembers the emission scores of words it has met, in bounded memory."""

    def __init__(self, model: Model):
        self.model, self.row = model, {}
        self.scores = np.empty((CACHE_WORDS + BATCH_WORDS, len(model.labels)), np.float32)

    def rows_of(self, words: list[str]) -> np.ndarray:
        if len(self.row) >= CACHE_WORDS:
            self.row.clear()
        fresh = [w for w in dict.fromkeys(words) if w not in self.row]
        for at in range(0, len(fresh), 20_000):
            part = fresh[at:at + 20_000]
            flat, begins = feature_rows(part, self.model.lexicon)
            n = len(self.row)
            if n + len(part) > len(self.scores):           # one text of very many different words
                self.scores = np.concatenate([self.scores, np.empty_like(self.scores)])
            self.scores[n:n + len(part)] = np.add.reduceat(self.model.weights[flat], begins, axis=0)
            self.row.update(zip(part, range(n, n + len(part))))
        return np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))

    def tag(self, texts: list[list[str]]) -> tuple[list[np.ndarray], np.ndarray]:
        """Label shares of each non-empty text (mean posteriors), and word labels laid end to end."""
        sizes = np.array([len(t) for t in texts])
        emission = self.scores_of([w for t in texts for w in t])
        begins = np.cumsum(np.append(0, sizes))[:-1]
        first = np.zeros(len(emission), bool)
        first[begins] = True
        gamma = posteriors(emission, first, self.model.transition, self.model.start)
        return list(np.add.reduceat(gamma, begins, axis=0) / sizes[:, None]), gamma.argmax(axis=1)

    def scores_of(self, words: list[str]) -> np.ndarray:
        rows = self.rows_of(words)
        return self.scores[rows].astype(np.float64)


def sample(docs: DataFrame, train: Column) -> list[tuple[str, str]]:
    """(label, text) of the bounded training sample; what goes to the driver is bounded by the two parameters and the labels.

    Rows are chosen by the hash of their id among a label's texts of at most ``SAMPLE_CHARS`` characters; a label that
    has longer ones only is learned from the first ``SAMPLE_CHARS`` characters of those. Predictions read whole texts.
    """
    rows = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", (F.length("text") > SAMPLE_CHARS).alias("long"), F.substring("text", 1, SAMPLE_CHARS).alias("text"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_BUCKETS)).alias("bucket"),
        F.xxhash64(F.lit("sample"), "doc_id").alias("h"))
    rows = rows.join(rows.groupBy("lang").agg(F.min("long").alias("long")), ["lang", "long"])
    chosen = written(rows.groupBy("lang", "bucket").agg(F.min("h").alias("h")), "language-sample")
    found = rows.join(chosen, ["lang", "bucket", "h"]).groupBy("lang", "bucket").agg(F.min("text").alias("text"))
    return sorted((r["lang"], r["text"]) for r in found.select("lang", "text").collect())


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, n_words, n_switches (neighbouring words with different labels) for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = "doc_id bigint, lang_pred string, score double, n_words bigint, n_switches bigint"
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(sent.value) if sent.value else None
        for batch in batches:
            out, held, size = [], [], 0
            for i, text in enumerate(batch.column(1)):
                words = words_of(text.as_py().lower())
                out.append([UNKNOWN, 0.0, len(words), 0])
                if words and tagger:
                    held.append((i, words))
                    size += len(words)
                if size >= BATCH_WORDS:
                    _settle(tagger, held, out)
                    held, size = [], 0
            if held:
                _settle(tagger, held, out)
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.float64(), pa.int64(), pa.int64()))]
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns],
                                                 ["doc_id", "lang_pred", "score", "n_words", "n_switches"])

    return rows.mapInArrow(run, schema)


def _settle(tagger: Tagger, held: list[tuple[int, list[str]]], out: list[list]) -> None:
    shares, labels = tagger.tag([words for _, words in held])
    at = 0
    for (i, words), share in zip(held, shares):
        best = int(share.argmax())
        own = labels[at:at + len(words)]
        at += len(words)
        out[i][:2] = tagger.model.labels[best], float(min(1.0, share[best]))
        out[i][3] = int((own[1:] != own[:-1]).sum())


def language_report(docs: DataFrame, modulus: int = 3) -> DataFrame:
    """Fit on the rows whose id is not held out (crc32 of it mod ``modulus`` is not 1), predict all rows."""
    model = fit(sample(docs, ~held_out(F.col("doc_id"), modulus)))
    return predict(docs, model).withColumn("held_out", held_out(F.col("doc_id"), modulus))
