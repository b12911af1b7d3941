"""Session settings that the engine relies on."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Texts on their way to Python workers: a few MB at a time, however long they are.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4194304",
}


def build(master: str = "local[*]", **extra: str) -> SparkSession:
    """A session with the engine's settings; dots in names of ``extra`` as ``__``."""
    builder = SparkSession.builder.master(master).appName("docketry")
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in extra.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it.

    On a cluster the package is installed or sent with --py-files, and the
    extra entry on the path does no harm.
    """
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    parts = env.get("PYTHONPATH", "").split(":")
    if root not in parts:
        env["PYTHONPATH"] = ":".join([root, *filter(None, parts)])
    return spark
