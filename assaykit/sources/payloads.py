"""Payload ingest: files, tables and batch submissions -> ``payloads``.

``payloads(payload_id string, provider string, raw string, received_at timestamp)``
is the engine's input; one row is one submitted document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assaykit.schemas import PAYLOAD_SCHEMA

BATCH_ITEMS = "array<struct<provider:string,data:variant>>"


def read_payloads(spark: SparkSession, path: str, provider: str | None = None,
                  fmt: str = "text") -> DataFrame:
    """Read payloads from storage.

    * ``fmt="text"``: one file per payload (``wholetext``); the provider is
      given, the file path becomes the payload id.
    * ``fmt="parquet"``/``"json"``: rows already shaped like ``PAYLOAD_SCHEMA``.
    """
    if fmt == "text":
        if provider is None:
            raise ValueError("provider is required for raw files")
        df = spark.read.text(path, wholetext=True)
        return df.select(
            F.sha2(F.input_file_name(), 256).alias("payload_id"),
            F.lit(provider).alias("provider"),
            F.col("value").alias("raw"),
            F.current_timestamp().alias("received_at"),
        )
    reader = spark.read.schema(PAYLOAD_SCHEMA)
    return reader.parquet(path) if fmt == "parquet" else reader.json(path)


def explode_batch(submissions: DataFrame, body_col: str = "body",
                  id_col: str = "submission_id") -> DataFrame:
    """A batch body ``[{provider, data}, ...]`` -> one payload row per item.

    ``item_index`` is 0-based; ``raw`` is the item's data re-serialized
    compactly with sorted keys (the bytes that get hashed). Bodies that are
    not such an array yield no items and ``batch_ok = false`` on a marker row.
    """
    parsed = submissions.withColumn("_items", F.from_json(F.col(body_col), BATCH_ITEMS))
    items = parsed.select(
        F.col(id_col).alias("submission_id"), "received_at",
        F.posexplode_outer("_items").alias("item_index", "item"),
        F.col("_items").isNotNull().alias("batch_ok"),
    )
    return items.select(
        "submission_id", "item_index", "batch_ok",
        F.concat_ws(":", "submission_id", F.col("item_index").cast("string")).alias("payload_id"),
        F.col("item.provider").alias("provider"),
        F.to_json(F.col("item.data")).alias("raw"),
        "received_at",
    )
