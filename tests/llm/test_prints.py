"""Phrase fingerprints, source divergence and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from assaykit.llm import divergence, lzprint, repair
from assaykit.llm.oracles import ORACLES
from tests.llm.conftest import DOCS, PROSE


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- phrase fingerprints ------------------------------------------------------
def phrases(data):
    """The phrase set by the definition, without a trie."""
    known, now = set(), b""
    for i in range(len(data)):
        now += data[i:i + 1]
        if now not in known:
            known.add(now)
            now = b""
    return known


def likeness_by_sets(a, b):
    a, b = phrases(a.encode()), phrases(b.encode())
    return len(a & b) / len(a | b) if a | b else 1.0


def test_parse_gives_the_phrase_set(odd_rows):
    for _, text in odd_rows:
        data = (text or "").encode()[:40_000]
        trie = {}
        ends, _ = lzprint.parse(trie, data)
        assert {data[a:b] for a, b in zip([0, *ends], ends)} == phrases(data) and len(trie) == len(ends)
        assert len(set(lzprint.phrase_hashes(data, 0, ends).tolist())) == len(ends)


def test_edited_copy_is_parsed_as_if_alone():
    rnd = random.Random(3)
    for _ in range(60):
        a, b = ("".join(rnd.choice("ab é") for _ in range(rnd.randint(0, 300))) for _ in range(2))
        own, changed, digest = lzprint.fingerprint_and_edited(a, b)
        copy = "".join(lzprint.edited(a, b))
        assert (own, changed, digest) == (lzprint.fingerprint(a), lzprint.fingerprint(copy), sha(copy))


def test_likeness_estimates_the_common_share():
    rnd, errors = random.Random(4), []
    words = [f"w{rnd.randint(0, 10 ** 6)}" for _ in range(400)]
    for share in (0, 1, 2, 3, 4) * 6:
        a = " ".join(rnd.choices(words, k=300))
        b = a[:len(a) * share // 4] + " ".join(rnd.choices(words, k=300))[len(a) * share // 4:]
        errors.append(lzprint.likeness(lzprint.fingerprint(a), lzprint.fingerprint(b)) - likeness_by_sets(a, b))
    assert max(map(abs, errors)) < 0.16 and abs(sum(errors) / len(errors)) < 0.03
    nothing, some = lzprint.fingerprint(""), lzprint.fingerprint("some text")
    assert lzprint.likeness(nothing, nothing) == 1 and lzprint.likeness(nothing, some) == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_fingerprint_report(make_docs, odd_rows, parts):
    rows = odd_rows + [(10 + i, PROSE.format(i)) for i in range(30)] + [(3, "another third")]
    got = lzprint.fingerprint_report(make_docs(rows).repartition(parts)).collect()
    assert len(got) == len(rows)
    whole = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    # rows of one id stand in the order of their content hash: take the order that the report shows
    def expected(order):
        out = []
        for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
            copy = text[:len(text) - len(text) // 4] + following[:len(text) // 4]
            own, changed = lzprint.fingerprint(text), lzprint.fingerprint(copy)
            out.append((i, len(text), sha(copy), own.hex(), changed.hex(), lzprint.likeness(own, changed),
                        lzprint.likeness(own, lzprint.fingerprint(following))))
        return Counter(out)

    third = [k for k, (i, _) in enumerate(whole) if i == 3]
    swapped = list(whole)
    swapped[third[0]], swapped[third[1]] = whole[third[1]], whole[third[0]]
    assert Counter(map(tuple, got)) in (expected(whole), expected(swapped))
    same = [r for r in got if r.doc_id == 4]
    assert same[0].fingerprint == same[1].fingerprint


def test_fingerprint_report_of_one_and_none(spark, make_docs):
    only = lzprint.fingerprint_report(make_docs([(1, "abcdabcd")])).collect()
    assert [(r.near_next, r.edited_sha256) for r in only] == [(1.0, sha("abcdabab"))]
    assert lzprint.fingerprint_report(spark.createDataFrame([], DOCS)).collect() == []


# -- source divergence --------------------------------------------------------
def audit_by_brute_force(rows, min_docs=3, top=200):
    rows = [((t or ""), (la or ""), (s or "")) for _, t, la, s in rows]
    terms = [re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in t)) for t, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        docs, of_lang, of_source = Counter(), Counter(), defaultdict(Counter)
        for (_, la, source), found in zip(rows, terms):
            if la == lang:
                docs.update(set(found))
                of_lang.update(found)
                of_source[source].update(found)
        kept = [t for t in docs if docs[t] >= min_docs]

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10 ** 9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        q = shares(of_lang)
        p = {s: shares(c) for s, c in of_source.items()}
        for s in p:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in p if o != s]
            more = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept
                    if of_source[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(more)[:top])):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def test_divergence_equals_brute_force(make_docs, monkeypatch):
    rnd = random.Random(8)
    words = ["Ärger", "ärger", "数据", "a", "b", "Cat", "cat", "don't", "x1y", "ｅ", "\U0001F600", "zz"] + [
        f"w{chr(97 + i)}" for i in range(20)]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 40))), rnd.choice(["en", "de", "", None]),
             rnd.choice(["s1", "s2", "é", "", None])) for i in range(120)]
    rows += [(200 + i, "copy of Copy copy", "en", f"s{i % 3}") for i in range(50)]     # copies over several sources
    rows += [(300, None, "fr", "s1"), (301, "once only", "fr", "s2"), (302, "", "it", None), (None, "a b", "en", "s1"),
             (303, "word " * 200_000, "en", "s1"), (304, "x" * 300_000, "en", "s2")]
    monkeypatch.setattr(divergence, "HELD", 50)             # counts are passed on several times
    got = sorted(map(tuple, divergence.audit(make_docs(rows).repartition(5)).collect()))
    assert got == audit_by_brute_force(rows)
    few = divergence.audit(make_docs(rows), top=2).filter("part = 'term'")
    assert few.agg({"rank": "max"}).first()[0] == 2


def test_divergence_without_rows(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []


def test_divergence_limits_ranks_before_the_shuffle(make_docs):
    plan = divergence.audit(make_docs([(1, "a", "en", "s")]))._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


# -- periodic runs ------------------------------------------------------------
def runs_by_brute_force(ids):
    found = {}
    for q in range(1, len(ids) // 3 + 1):
        i = 0
        while i + q < len(ids):
            j = i
            while j + q < len(ids) and ids[j] == ids[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def random_words(rnd, kind):
    n = rnd.randint(0, 150)
    if kind == 0:
        return [rnd.randint(0, 1) for _ in range(n)]
    if kind == 1:
        return [0] * n
    if kind == 2:
        return sum(([rnd.randint(0, 3) for _ in range(rnd.randint(1, 9))] * rnd.randint(1, 9) for _ in range(6)), [])
    if kind == 3:
        edge = [rnd.randint(0, 3) for _ in range(rnd.randint(0, 10))]
        return edge + [rnd.randint(0, 5) for _ in range(rnd.randint(1, 40))] * rnd.randint(1, 6) + edge[::-1]
    if kind == 4:
        a, b = [0], [0, 1]
        for _ in range(rnd.randint(1, 9)):
            a, b = b, b + a
        return b * rnd.randint(1, 3)
    return (([rnd.randint(0, 2) for _ in range(rnd.randint(1, 5))] * rnd.randint(6, 12)) + [9]) * rnd.randint(1, 5)


def test_runs_equal_brute_force():
    rnd, total = random.Random(5), 0
    for turn in range(900):
        ids = repair.numbered([b"%d" % w for w in random_words(rnd, turn % 6)])
        want = runs_by_brute_force(ids.tolist())
        assert repair.runs(ids) == want
        total += len(want)
    assert total > 500


def test_grammar_derives_the_text():
    rnd = random.Random(6)
    for turn in range(120):
        ids = repair.numbered([b"%d" % w for w in random_words(rnd, turn % 6)])
        if len(ids) < 4:
            continue
        pairs = Counter(zip(ids.tolist(), ids.tolist()[1:]))
        repeated = np.array([i for i in range(len(ids) - 1) if pairs[ids[i], ids[i + 1]] > 1], np.int64)
        rules, left = repair.grammar(ids, repeated)
        for at, side, size in rules:
            assert len(at) > 1 and 0 < side < size
            assert len({tuple(ids[i:i + size]) for i in at}) == 1
            assert all(b - a >= size for a, b in zip(at, at[1:]))
        assert left[0] == 0 and left == sorted(set(left))


def report_by_brute_force(doc_id, text):
    words = [w for w in re.split("[\x20\x09-\x0D]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g, before = h // 10, list(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [before[a + (i - a) % p] if i >= a else before[i] for i in range(n)]
    found = runs_by_brute_force(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n_ for s, n_, q in found)]
    best = sorted(found, key=lambda r: (-r[1] / r[2], r[0], r[2]))[:1]
    told = [(*b, 1000 * b[1] // b[2]) for b in best] or [(None,) * 4]
    return (doc_id, len(found), *told[0], sha("".join(f"{s},{n_},{q}\n" for s, n_, q in found)), sha(" ".join(kept)))


def test_run_report(make_docs, odd_rows):
    rows = [r for r in odd_rows if r[0] != 6] + [(100 + i, PROSE.format(i) + " la la" * (i % 30)) for i in range(120)]
    rows += [(19, "again and " * 300), (6, "one two three " * 700), (7, " one　two\x1ffour " * 40)]
    got = repair.run_report(make_docs(rows).repartition(3), plant=True).collect()
    assert Counter(map(tuple, got)) == Counter(report_by_brute_force(*r) for r in rows)
    assert sum(r.n_runs > 0 for r in got) > 20


def test_run_report_sql(make_docs, spark):
    rows = [(i, PROSE.format(i) + " la la" * (i % 30)) for i in range(200)] + [(None, "b c " * 40), (7, None), (8, " ")]
    docs = make_docs(rows)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toArrow())
    got = Counter(map(tuple, repair.run_report(docs, plant=True).collect()))
    assert got == Counter(con.execute(ORACLES["op13_periodic_runs"]).fetchall())
    assert repair.run_report(spark.createDataFrame([], DOCS)).collect() == []


def test_runs_and_texts_without_repetition(make_docs):
    docs = make_docs([(1, "x  " + "a b c " * 10 + "end"), (2, "no  run\nhere"), (3, None), (4, "z " * 30), (4, "z " * 30)])
    assert sorted(map(tuple, repair.document_runs(docs).collect())) == [(1, 1, 30, 3), (4, 0, 30, 1), (4, 0, 30, 1)]
    out = repair.without_repetition(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [
        (1, "x a b c end"), (2, "no  run\nhere"), (3, ""), (4, "z"), (4, "z")]


def test_very_long_texts():
    for words in ([b"a"] * 200_000, [b"%d" % (i % 1000) for i in range(100_000)]):
        assert len(repair.runs(repair.numbered(words))) == 1
