"""What the jobs share: their settings, their log and counted writes."""

from __future__ import annotations

import logging
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("docketry.jobs")

#: Where the settings that come with the jobs are.
HERE = Path(__file__).resolve().parent


def load(spark: SparkSession, path: str, known: dict) -> dict:
    """Settings of a JSON file over the ``known`` ones, which name all that there are and their kinds."""
    given = {k: v for k, v in spark.read.option("multiLine", True).json(path).first().asDict().items() if v is not None}
    unknown = sorted(set(given) - set(known))
    if unknown:
        raise ValueError(f"unknown settings in {path}: {', '.join(unknown)}")
    return {k: type(v)(given.get(k, v)) for k, v in known.items()}


def _counted(df: DataFrame, path: str, by: tuple[str, ...], mode: str) -> int:
    seen = Observation(f"rows-{uuid.uuid4().hex}")
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*by).parquet(path)
    rows = seen.get["rows"]
    log.info("wrote %s rows to %s", rows, path)
    return rows


def write_partitions(df: DataFrame, path: str, *by: str) -> int:
    """Write a table by partitions: those that ``df`` has rows of are replaced, all others stay. The number of rows, which is logged."""
    return _counted(df, path, by, "dynamic")


def write_folder(df: DataFrame, path: str, *by: str) -> int:
    """Write a table by partitions in place of all that the folder holds. The number of rows, which is logged."""
    return _counted(df, path, by, "static")


def ready(spark: SparkSession, path: str, schema: str, *by: str) -> None:
    """Make an empty table at ``path`` unless there is one."""
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*by).parquet(path)
