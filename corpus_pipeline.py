"""The corpus pipeline: five stages from raw documents to coded training text.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept;
its result is written as Parquet in the shared folder and reread. All stages but the
last return the columns of ``documents``. Null, empty and repeated rows and extra
columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from assaykit.llm import hostrules, latent, linejoin, pieces, simhash
from assaykit.llm.common import read_table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose domain is not rejected."""
    return hostrules.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand, equal or within two edits, earlier in the corpus."""
    return linejoin.without_repeats(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return latent.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def sentencepiece_coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text."""
    return pieces.code_digests(pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_near_dedup", simhash_near_dedup),
          ("benchmark_decontamination", benchmark_decontamination), ("sentencepiece_coding", sentencepiece_coding)]

#: The edit join, fingerprints, latent search and piece coding are beyond SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace('_', '-')}")
    return docs
