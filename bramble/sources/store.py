"""Tables written to the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex[:12]
_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where it is set; else a local folder, which only a session on one machine may use."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "bramble-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; removed when the driver ends, unless drop_dir was earlier."""
    path = f"{shared_dir(spark)}/bramble-{_RUN}/{name}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_clean, spark)
    _made.add(path)
    return path


def drop_dir(spark: SparkSession, path: str) -> None:
    """Remove a folder made by fresh_dir."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _made.discard(path)


def _clean(spark: SparkSession) -> None:
    for path in list(_made):
        try:
            drop_dir(spark, path)
        except Exception:  # the session may be gone already; the folder is then left to its owner
            return


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and safe when executors are lost."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Removes tables made by stored(), when what was made of them is stored in its turn."""
    for table in tables:
        drop_dir(table.sparkSession, table._stored_at)
