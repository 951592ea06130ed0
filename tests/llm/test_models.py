"""Language id, license scans and language-model scoring: held-out accuracy, exact parts against plain Python, edge cases."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from assaykit.llm import crf, licenses, maxent
from tests.llm.conftest import PROSE

SYLLABLES = {"aa": ["tha", "wer", "ing", "shu", "ock"], "bb": ["eau", "lle", "oir", "qué", "ez"], "cc": ["sch", "ung", "über", "keit", "ß"]}


def language_rows(n=120):
    rng = random.Random(1)
    word = lambda x: "".join(rng.choices(SYLLABLES[x], k=rng.randint(1, 3)))
    return [(k, " ".join(word(x) for _ in range(rng.randint(5, 60))), x) for k, x in ((k, sorted(SYLLABLES)[k % 3]) for k in range(n))]


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    crf_chunk, crf.CHUNK = crf.CHUNK, 3
    try:
        sizes, k = [5, 1, 4], 3
        emission, trans, start = rng.normal(size=(sum(sizes), k)), rng.normal(size=(k, k)), rng.normal(size=k)
        first = np.zeros(len(emission), bool)
        first[[0, 5, 6]] = True
        got = crf.posteriors(emission, first, trans, start)
        at = 0
        for n in sizes:
            total = np.zeros((n, k))
            for path in product(range(k), repeat=n):
                s = start[path[0]] + sum(emission[at + i, y] for i, y in enumerate(path)) + sum(
                    trans[a, b] for a, b in zip(path, path[1:]))
                for i, y in enumerate(path):
                    total[i, y] += math.exp(s)
            assert np.allclose(got[at:at + n], total / total.sum(axis=1, keepdims=True))
            at += n
    finally:
        crf.CHUNK = crf_chunk


def test_language_accuracy_and_edges(make_docs):
    rows = language_rows()
    odd = [(900, None, "aa"), (901, "12 3.4 !", "bb"), (902, "", None), (None, rows[0][1], None), (903, rows[1][1], None),
           (903, rows[1][1], None), (904, " ".join(r[1] for r in rows) * 3, "bb")]
    docs = make_docs([*rows, *odd])
    got = crf.language_report(docs).collect()
    assert len(got) == len(rows) + len(odd)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [(by[k][0]["lang_pred"], x) for k, _, x in rows if by[k][0]["held_out"]]
    assert len(held) > 20 and sum(a == b for a, b in held) >= 0.95 * len(held)
    assert [by[k][0]["lang_pred"] for k in (900, 901, 902)] == ["und"] * 3
    assert by[None][0]["lang_pred"] == "aa" and [r["lang_pred"] for r in by[903]] == ["bb"] * 2


def test_mixed_text_is_labelled_by_word():
    rows = language_rows()
    model = crf.fit([(x, t) for _, t, x in rows])
    tagger = crf.Tagger(model)
    text = crf.words_of(" ".join(t for _, t, x in rows if x == "aa")[:400].lower())
    other = crf.words_of(" ".join(t for _, t, x in rows if x == "cc")[:400].lower())
    _, labels = tagger.tag([text + other])
    want = np.array([0] * len(text) + [2] * len(other))
    assert (labels == want).mean() > 0.95
    assert model.transition.argmax(axis=1).tolist() == [0, 1, 2]


def test_nothing_labelled_and_empty(make_docs):
    assert crf.fit([]) is None
    assert [r["lang_pred"] for r in crf.predict(make_docs([(1, "abc")]), None).collect()] == ["und"]
    assert crf.language_report(make_docs([])).count() == 0


def test_license_spans(make_docs):
    mit, long = licenses.TEMPLATES["MIT notice"], licenses.TEMPLATES["MIT permission"]
    edited = long.replace("free of charge", "at no cost").replace("any person", "anyone")
    texts = [(1, f"Zoë wrote this. {mit} More"), (2, f"{mit}\n{mit}"), (3, edited.upper()), (4, "Released under the rain"), (5, None),
             (6, ""), (None, mit), (7, f"{PROSE.format(1)} " * 300 + mit), (7, f"{PROSE.format(1)} " * 300 + mit)]
    got = licenses.scan(make_docs(texts)).collect()
    found = Counter((r["doc_id"], r["license"]) for r in got)
    assert found == {(1, "MIT notice"): 1, (2, "MIT notice"): 2, (3, "MIT permission"): 1, (None, "MIT notice"): 1, (7, "MIT notice"): 2}
    for r in got:
        text = dict(texts)[r["doc_id"]]
        if r["license"] == "MIT notice":
            assert text[r["start"]:r["end"]] == mit.rstrip(".") and r["coverage"] == 1
        else:
            assert 0.8 <= r["coverage"] < 1 and r["end"] == len(edited)
    assert licenses.scan(make_docs([])).count() == 0


def test_every_template_is_found_whole():
    scanner = licenses.Scanner()
    for name, text in licenses.TEMPLATES.items():
        assert name in [m[0] for m in scanner.scan(f"before {text} after") if m[1] == m[2]]


def test_neighbouring_licenses_are_told_apart():
    scan = lambda text: {m[0] for m in licenses.Scanner().scan(f"Some words. {text} And more of them.")}
    header = licenses.TEMPLATES["GPL header"]
    for text, want in {
        licenses.TEMPLATES["GPL-3.0 notice"].replace("3", "2"): {"GPL-2.0 notice"},
        licenses.TEMPLATES["GPL-3.0 notice"].replace("version 3", "version 9"): set(),
        header.replace("GNU", "GNU Lesser"): set(), header.replace("GNU", "GNU Affero"): set(),
        f"{header}, either version 2.1 of the License, or any later version.".replace("GNU", "GNU Lesser"): {"LGPL-2.1 header"},
        f"{header}, either version 3 of the License, or any later version.".replace("GNU", "GNU Affero"): {"AGPL-3.0 header"},
        "Licensed under the Apache License, Version 1.1.": set(), "Released under the ISC License.": set(),
        licenses.TEMPLATES["Apache-2.0 header"].replace("2.0", "3.0"): set(),
        "Licensed under CC BY 4.0.": {"CC-BY-4.0 short notice"}, "Licensed under CC BY-NC-SA 4.0.": {"CC-BY-NC-SA-4.0 short notice"},
        "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": {"CC-BY-SA-4.0 long notice"},
        licenses.TEMPLATES["MIT permission"].replace("deal in", "deal with"): {"NCSA permission"},
        licenses.TEMPLATES["MPL-2.0 notice"].replace("2.0", "1.1"): set(),
        licenses.TEMPLATES["ISC permission"].split(", provided")[0]: {"0BSD permission"},
        licenses.TEMPLATES["EPL-1.0 notice"].replace("v1.0", "2.0"): {"EPL-2.0 notice"},
        licenses.TEMPLATES["BSD conditions"].replace("binary forms", "object forms"): set()}.items():
        assert scan(text) == want, text
    for name, text in licenses.TEMPLATES.items():           # the best template alone, with the whole license as its span
        assert scan(text) == {name}, name
    for part, name in (("MIT", "MIT warranty"), ("BSD-3-Clause", "BSD warranty")):      # a later part alone
        words = licenses.TEMPLATES[part].split()
        assert name in scan(" ".join(words[-len(licenses.TEMPLATES[name].split()):]))


def test_shared_words_share_a_fingerprint():
    rng = np.random.default_rng(1)
    for _ in range(200):
        shared = rng.integers(0, 2 ** 63, licenses.GRAM + licenses.WINDOW - 1).astype(np.uint64)
        a, b = (np.concatenate([rng.integers(0, 2 ** 63, rng.integers(0, 9)).astype(np.uint64), shared,
                                rng.integers(0, 2 ** 63, rng.integers(0, 9)).astype(np.uint64)]) for _ in range(2))
        assert set(licenses.winnowed(a)[0]) & set(licenses.winnowed(b)[0])


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w] + [None]


def test_scores(make_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(maxent, "COMMON", 64)               # most words go through the join
    rows = odd_rows + [(100 + k, PROSE.format(k)) for k in range(60)]
    got = maxent.score_report(make_docs(rows)).collect()
    train = Counter(w for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1 for w in tokens(t))
    n, v = sum(train.values()), len(train)
    want = {}
    for i, t in rows:
        x = tokens(t)
        want[i] = (len(x), sum(train[w] > 0 for w in x), sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x))
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    for r in got:
        a, b, c = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (a, b, n)
        assert math.isclose(r["base_score"], c, rel_tol=1e-9, abs_tol=1e-9) and r["score"] < 0
    held = [r for r in got if r["held_out"] and r["doc_id"] and r["doc_id"] >= 100]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)     # the context helps


def test_model_is_a_distribution(spark, make_docs):
    docs = make_docs([(k, "a b c d a b") for k in range(30)] + [(99, "e f")])
    counts = maxent.token_totals(docs)
    model = maxent.trained(docs, maxent.start_model(counts))
    feats = np.random.default_rng(0).integers(0, maxent.BUCKETS, (50, 3))
    assert np.allclose(np.exp(model.class_scores(feats)).sum(axis=1), 1, atol=1e-4)
    label = np.zeros(50, int)
    assert np.allclose(np.exp(model.member_scores(model.member_rows(feats, label), label)).sum(axis=1), 1, atol=1e-4)
    b = maxent.Hashes()
    one = lambda *w: model.log_probabilities(np.array([b[x] for x in w], np.uint64), np.array([0]))[-1]
    assert one(b"a", b"b") > one(b"b", b"b")                # learned: b follows a


def test_no_training_rows(make_docs):
    assert maxent.score_report(make_docs([])).count() == 0
    r = maxent.score(make_docs([(1, "a b")]), F.lit(False)).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0) and r["base_score"] == 0


def test_a_head_word_is_common_however_rare(spark):
    counts = spark.createDataFrame([(5, 2_000_000), (-3, 1), (9, 1)], "w bigint, c bigint")
    words, held = maxent._common(counts, 2_000_002, np.array([5, -3], np.int64).view(np.uint64))
    assert words.view(np.int64).tolist() == [5, -3] and held.tolist() == [2_000_000, 1]
