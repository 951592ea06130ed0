"""Line dedup, SimHash and decontamination against brute force; the pipeline end to end."""

import random
import re
from collections import Counter

import numpy as np
import xxhash

import corpus_pipeline
from assaykit.llm import components, latent, linejoin, simhash
from assaykit.llm.common import written
from tests.llm.conftest import PROSE


def classes(items, linked):
    parent = {i: i for i in items}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a in items:
        for b in items:
            if a < b and linked(a, b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in items}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        now = [i]
        for j, d in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != d)))
        row = now
    return row[-1]


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        if not out:
            break
        k = rng.randrange(len(out))
        rng.choice([lambda: out.__setitem__(k, rng.choice("abcé")), lambda: out.pop(k), lambda: out.insert(k, rng.choice("abcé"))])()
    return "".join(out)


def test_edit_distance_equals_table():
    rng = random.Random(2)
    for _ in range(4000):
        a = "".join(rng.choices("abé", k=rng.randint(1, 9)))
        b = edited(rng, a + "x", rng.randint(0, 4))
        assert linejoin.edit_distance(a, b, 2) == min(3, distance(a, b))


def test_segment_join_finds_every_pair():
    rng, keys = random.Random(4), linejoin.Keys(2, 6)
    for _ in range(4000):
        a = "".join(rng.choices("ab", k=rng.randint(8, 20)))
        b = edited(rng, a, rng.randint(0, 2))
        short, long = sorted((a, b), key=lambda x: (len(x), x))
        if a == b or len(short) < 6:
            continue
        own, probed = keys.of(short)[0], set(sum(keys.of(long), []))
        assert [i for i, k in enumerate(own) if k in probed][0] == keys.witness(short, long)


def line_docs():
    rng = random.Random(6)
    base = ["".join(rng.choices("abcdefgh ", k=rng.randint(24, 60))).strip() + "zz" for _ in range(25)]
    rows = [(k, "\n".join([rng.choice(base), edited(rng, rng.choice(base), rng.randint(0, 3)), f"own line of document {k * 7919} here", "short"]))
            for k in range(60)]
    same = "a line with one shared head and another tail: "
    rows += [(100 + k, same + format(k * 0x9E3779B1 % 2 ** 32, "032b")) for k in range(40)]           # one hot segment
    return rows + [(200, None), (201, ""), (202, "\n \n\t"), (None, base[0]), (203, base[1]), (203, base[1]), (204, f"  {base[2]}\r\n{base[2]}")]


def test_line_classes_equal_brute_force(make_docs, monkeypatch):
    monkeypatch.setattr(linejoin, "BLOCK_ROWS", 16)         # hot keys are split into pairs of blocks
    rows = line_docs()
    strip = linejoin.SPACES
    lines = sorted({x.strip(strip) for _, t in rows for x in (t or "").split("\n")} - {""})
    near = lambda a, b: min(len(a), len(b)) >= 24 and distance(a, b) <= 2
    root = classes(lines, near)
    links = {a: sum(a != b and near(a, b) for b in lines) for a in lines}
    got = linejoin.classed(make_docs(rows)).collect()
    where = {}
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            if x.strip(strip):
                where[i, k] = x.strip(strip)
    assert Counter((r["doc_id"], r["line_no"]) for r in got) == Counter((i, k) for i, t in rows for k, x in enumerate((t or "").split("\n")) if x.strip(strip))
    groups = {}
    for r in got:
        line = where[r["doc_id"], r["line_no"]]
        assert r["n_links"] == links[line] and r["n_chars"] == len(line)
        groups.setdefault(r["class_id"], set()).add(root[line])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(root.values()))
    assert linejoin.classed(make_docs([])).count() == 0


def test_line_with_a_repeating_middle_counts_a_link_once(make_docs):
    got = linejoin.classed(make_docs([(1, "x" + "-" * 29), (2, "-" * 30), (3, "-" * 29 + "y")])).collect()
    assert [r["n_links"] for r in got] == [2, 2, 2] and len({r["class_id"] for r in got}) == 1


def kept_lines(rows):
    """Brute force of the stage: a line goes when its class stands before in order of (doc_id, line)."""
    strip, order = linejoin.SPACES, lambda i: (i is not None, i or 0)
    lines = sorted({x.strip(strip) for _, t in rows for x in (t or "").split("\n") if len(x.strip(strip)) >= 24})
    root, first = classes(lines, lambda a, b: abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2), {}
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            if (c := root.get(x.strip(strip))) is not None:
                first[c] = min(first.get(c, ((9,), 0)), (order(i), k))
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        left = [x for k, x in enumerate(parts) if (c := root.get(x.strip(strip))) is None or first[c] == (order(i), k)]
        if len(left) == len(parts) or "".join(left).strip(strip):
            out.append((i, t if len(left) == len(parts) else "\n".join(left)))
    return out


def test_repeated_lines_go(make_docs):
    rows = line_docs()
    docs = make_docs(rows)
    left = linejoin.without_repeats(docs)
    assert left.columns == docs.columns
    got = left.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(kept_lines(rows))
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in got)


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i:i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(make_docs, odd_rows):
    rng = random.Random(8)
    rows = odd_rows + [(100 + k, PROSE.format(k % 9)) for k in range(40)]
    for k in range(60):
        words = (PROSE.format(k % 5) + " ").split() * 6
        words[rng.randrange(len(words))] = f"Changed{k}"
        rows.append((200 + k, " ".join(words)))
    prints = [plain_fingerprint(t) for _, t in rows]
    root = classes(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (i, _), f in zip(rows, prints):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    docs = make_docs(rows)
    got = Counter(map(tuple, simhash.fingerprint_report(docs).collect()))
    assert got == Counter((i, format(f, "016x"), least.get(root[f])) for (i, _), f in zip(rows, prints))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {}
    for (i, t), f in zip(rows, prints):
        key = (i is not None, i or 0)
        want[root[f]] = min(want.get(root[f], (key, t or "")), (key, t or ""))
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(k[1] if k[0] else None for k, _ in want.values())
    assert simhash.near_duplicates(make_docs([])).count() == 0


def test_only_rows_that_repeat_are_sorted(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (3, None), (3, ""), (4, "x y z u v w"), (4, "p q r s t")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n long")
    kept = simhash.one_of_each(docs)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(
        [(1, "a b c d e"), (3, None), (3, ""), (4, "x y z u v w"), (4, "p q r s t")])
    plan = kept._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 4    # few ids go, few rows repeat: no row is shuffled


def test_tiles_lose_no_link(monkeypatch):
    monkeypatch.setattr(simhash, "SUB_ROWS", 8)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2 ** 63, 40).astype(np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (3, 40)).astype(np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ f for f in flips), base ^ flips[0] ^ flips[1]])).view(np.int64)
    want = classes([int(x) for x in fps], lambda a, b: ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 4)
    half = len(fps) // 2
    edges = [simhash.tile_links(fps[:half], None, 4), simhash.tile_links(fps[half:], None, 4), simhash.tile_links(fps[:half], fps[half:], 4)]
    pairs = {(x, y) for a, b in edges for x, y in zip(a, b) if x != y}
    assert classes([int(x) for x in fps], lambda a, b: (a, b) in pairs or (b, a) in pairs) == want


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 200 + k) for k in range(50)] + [(5, 5), (300, 300), (7, 8)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{k: 0 for k in range(51)}, 100: 100, **{200 + k: 100 for k in range(50)}}


def leak_rows():
    rng = random.Random(9)
    word = lambda: "".join(rng.choices(["ba", "ko", "ri", "tu", "me", "lo", "sha", "pen"], k=rng.randint(2, 4)))
    filler = lambda n: " ".join(word() for _ in range(n))
    items = [(k, filler(rng.randint(15, 60))) for k in range(60)] + [(90, None), (91, ""), (92, "one")]
    rows, want = [], set()
    for k in range(200):
        text = filler(rng.randint(20, 300))
        if k % 4 == 0:
            item = items[k // 4][1]
            words = item.split()
            if k % 8 == 0:                                  # a paraphrase: every sixth word changed
                words = [word() if i % 6 == 3 else w for i, w in enumerate(words)]
            at = rng.randrange(len(text.split()))
            parts = text.split()
            text = " ".join(parts[:at] + [", ".join(words).upper()] + parts[at:])
            want.add((k, k // 4))
        rows.append((k, text))
    return items, rows + [(500, None), (501, ""), (502, "?!"), (503, rows[4][1]), (503, rows[4][1]), (None, rows[12][1])], want | {(503, 1), (None, 3)}


def test_leaks_are_found_and_clean_documents_left(spark, make_docs):
    items, rows, want = leak_rows()
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make_docs(rows)
    got = latent.leaks(docs, bench).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert found <= want and len(found) >= 0.95 * len(want)
    assert {w for w in want if w[0] is None or w[0] % 8 == 4 or w[0] == 503} <= found       # all plain copies
    assert sum(r["doc_id"] == 503 for r in got) == 2
    left = latent.without_leaks(docs, bench)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {i for i, _ in rows} - {i for i, _ in found}
    assert latent.leaks(make_docs([]), bench).count() == 0 and latent.leaks(docs, bench.limit(0)).count() == 0


def test_items_leaked_into_many_documents_are_found(spark, make_docs):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    filler = lambda n: " ".join(word() for _ in range(n))
    items = [(k, filler(n)) for k, n in enumerate((16, 22, 60, 4))]
    # item 0 in a third, item 1 in all documents, item 2 in a half, item 3 (shorter than a gram) once
    rows = [(k, " ".join([filler(40), items[1][1], filler(40)] + [items[0][1], filler(20)] * (k % 3 == 0)
                         + [items[2][1]] * (k % 2) + [items[3][1], filler(30)] * (k == 7))) for k in range(120)]
    want = {(k, 0) for k in range(0, 120, 3)} | {(k, 1) for k in range(120)} | {(k, 2) for k in range(1, 120, 2)} | {(7, 3)}
    docs, bench = make_docs(rows), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in latent.leaks(docs, bench).collect()} == want
    assert latent.without_leaks(docs, bench).count() == 0


def test_copies_are_found_whatever_the_cosine(spark, make_docs, monkeypatch):
    monkeypatch.setattr(latent, "MIN_COSINE", 0.999)
    items, rows, want = leak_rows()
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in latent.leaks(make_docs(rows), bench).collect()}
    assert {w for w in want if w[0] is None or w[0] % 8 == 4 or w[0] == 503} <= found


def test_latent_candidates_against_brute_force(spark, make_docs):
    items, rows, _ = leak_rows()
    docs = make_docs(rows)
    index = latent.build_index(docs, len(rows), [(i, t) for i, t in items if t])
    searcher = latent.Searcher(index)
    hit = both = 0
    for _, text in rows[:80]:
        words = latent.words_of(text)
        for s in latent.starts(len(words)):
            part = words[s:s + latent.PASSAGE]
            ids = np.array([index.vocabulary.get(w, len(index.vocabulary)) for w in part], np.int64)
            vector = np.zeros(len(index.vocabulary))
            np.add.at(vector, ids[ids < len(vector)], index.weight[ids[ids < len(vector)]])
            norm = np.sqrt(searcher.square[ids].sum())
            near = set()
            for k, (_, item) in enumerate(index.items):
                for b in latent.starts(len(item)):
                    q = np.zeros(len(vector))
                    for w in item[b:b + latent.PASSAGE]:
                        q[index.vocabulary[w]] += index.weight[index.vocabulary[w]]
                    if norm and vector @ q / norm / np.sqrt(sum(index.weight[index.vocabulary[w]] ** 2 for w in item[b:b + latent.PASSAGE])) >= latent.MIN_COSINE:
                        near.add(k)
            got = {k for _, k, _ in searcher.candidates(ids, np.array([0]), np.array([len(ids)]))} if len(ids) else set()
            hit += len(near)
            both += len(near & got)
    assert hit > 30 and both >= 0.9 * hit


def test_randomised_svd_spans_the_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(sorted(rng.choice(60, 8, replace=False).tolist()), rng.random(8).tolist()) for _ in range(20)]
    vectors = latent.randomised_svd(spark.createDataFrame(rows, "words array<int>, weights array<double>"), 60)
    dense = np.zeros((20, 60))
    for i, (w, x) in enumerate(rows):
        dense[i, w] = x
    assert np.allclose(vectors.T @ vectors, np.eye(vectors.shape[1]), atol=1e-6)
    assert np.allclose(dense @ vectors @ vectors.T, dense, atol=1e-6)


def test_lcs_counts():
    assert latent.common_words([b"a", b"b", b"c", b"d"], [b"x", b"a", b"c", b"b", b"d"]) == (3, 2)
    assert latent.common_words([b"a"], []) == (0, 0)


def test_pipeline_equals_its_steps(spark, make_docs, tmp_path):
    own = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    good = [(k, f"{PROSE.format(k)}\n{own(k)} extra tail {k}", "en", f"s{k % 3}") for k in range(30)]
    item = "a benchmark question about copper kettles asks which hidden valve opens first when pressure falls below nine bars"
    rows = good + [(50, good[3][1], "en", "s1"), (51, "too short", "en", "s1"), (52, f"{PROSE.format(77)} {item}", "en", "s2"),
                   (53, None, None, None), (54, "", "en", "s2"), (55, "again and " * 200, "en", "s2"), (56, good[4][1].replace("extra", "Extra"), "en", "s1")]
    docs = make_docs(rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns, now, seen = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, str(tmp_path)), "stage")
        seen[name] = {r["doc_id"] for r in now.select("doc_id").collect()}
        assert name == corpus_pipeline.STAGES[-1][0] or now.columns == columns
    assert seen["quality_rules"] == set(range(30)) | {50, 52, 56}
    assert seen["line_dedup"] == set(range(30)) | {52}
    assert 52 not in seen["benchmark_decontamination"]
    assert seen["benchmark_decontamination"] == seen["simhash_near_dedup"] - {52}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r["doc_id"] for r in whole.collect()} == seen["sentencepiece_coding"] == seen["benchmark_decontamination"]
