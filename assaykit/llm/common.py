"""Small helpers that several operators share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assaykit.session import scratch_dir

#: ASCII white space as the contracts define words: space and \x09 to \x0D.
WORD_SPLIT = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a lazy Parquet scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back (cuts the lineage)."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """array<string> of the ASCII-space-separated words of a text (null or blank: empty array)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), lambda w: w != "")


def crc_of(doc_id: Column) -> Column:
    """crc32 of an id written as decimal text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def held_out(doc_id: Column, modulus: int) -> Column:
    """True where crc32(doc_id as text) mod ``modulus`` is 1; a null id is never held out."""
    return F.coalesce(crc_of(doc_id) % modulus == 1, F.lit(False))
