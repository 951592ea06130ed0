"""Session construction and shared-folder resolution."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC so timestamps mean the same thing in every
# engine, AQE so shuffle partition counts and skewed joins are re-planned at
# run time, and no UI server.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "assaykit", extra: dict | None = None) -> SparkSession:
    """Build (or fetch) a session with the engine's base settings.

    On a cluster the master and partition counts come from spark-submit; the
    arguments here are for local runs and tests.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if master and master.startswith("local"):
        cores = master[master.find("[") + 1:master.find("]")] if "[" in master else "1"
        cores = str(os.cpu_count() or 1) if cores == "*" else cores
        conf["spark.assaykit.gate.partitions"] = cores   # spread single-split local inputs over cores
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    Read from ``spark.checkpoint.dir``; only when a local session has none
    (tests) a fresh scratch folder is created and registered.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        spark.sparkContext.setCheckpointDir(conf_dir)
        return conf_dir.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="assaykit-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint root for a written table."""
    import uuid
    return os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")


CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written_parquet(df: DataFrame, path: str, **options: object) -> None:
    """Write ``df`` as zstd Parquet and let go of the shuffles of the write as soon as it ends.

    Otherwise they stay on the executors' disks until the driver happens to collect its garbage, so a job of many
    writes holds all its shuffles at once.
    """
    conf = df.sparkSession.conf
    was = conf.get(CLEAN_SHUFFLES, None)
    conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.options(compression="zstd", **options).parquet(path)
    finally:
        conf.set(CLEAN_SHUFFLES, was) if was is not None else conf.unset(CLEAN_SHUFFLES)
