"""Stages keep columns whose names the operators use themselves, empty tables pass all stages, and what is a letter."""

import re

import corpus_pipeline
from assaykit.llm import crf
from tests.llm.conftest import DOCS, PROSE

HELPERS = ["_id", "known", "of", "gone", "row", "class_id", "fp", "component_id", "key", "item_id", "_doc", "_host", "kept",
           "n_words", "h", "id", "line_no", "at", "first", "n"]


def test_every_stage_keeps_clashing_columns(spark, tmp_path):
    bench = spark.createDataFrame([(1, " ".join(f"item{i}" for i in range(20)))], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(i, PROSE.format(i) + f"\nline of its own {i} " + " ".join(f"w{i}x{k}" for k in range(40)), "en", f"s{i % 3}", None)
            for i in range(12)] + [(None, PROSE.format(99), "en", "s1", None)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", *[f"'v{k}' AS `{c}`" for k, c in enumerate(HELPERS)], "1 AS `a.b`")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
        for row in kept.collect():
            assert [row[c] for c in HELPERS] == [f"v{k}" for k in range(len(HELPERS))], name
    assert corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).count() == kept.count() > 0


def test_empty_tables_pass_all_stages(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_numerals_are_no_letters():
    assert crf.words_of("½ ² Ⅷ ① 12 _ ٣") == []
    assert crf.words_of("x² naïve数据 a1b Ⅷth") == ["x", "naïve数据", "a", "b", "th"]
    letters = [c for c in map(chr, range(0x20000)) if re.match(r"\w", c) and c.isalpha()]
    assert all(crf.words_of(c) == [c] for c in letters[:200] + letters[::97])


def test_sample_takes_long_documents(spark, make_docs):
    docs = make_docs([(i, "long " * 5_000, "xx", "s") for i in range(4)] + [(9, "short one", "yy", "s"), (10, None, "zz", "s")])
    found = crf.sample(docs, docs["doc_id"] >= 0)
    assert {label for label, _ in found} == {"xx", "yy"} and max(len(t) for _, t in found) == crf.SAMPLE_CHARS
