"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bramble.sources.store import drop_dir, dropped, fresh_dir
from bramble.sources.store import stored as materialize

__all__ = ["ascii_lower", "bounded_batches", "drop_dir", "dropped", "fresh_dir", "materialize", "partitions", "table"]
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, _UPPER, _UPPER.lower())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keep Arrow batches small enough for long texts; the setting must still hold when the lazy result is computed."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
