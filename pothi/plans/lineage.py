"""Cutting lineage through storage all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where a session on one machine names none (tests), a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="pothi-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, kind: str = "pothi") -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(clear, spark)
    _written.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table written to the shared folder.

    What is computed from it later starts at the table, whichever executors are
    lost. The table is deleted by ``clear``, at the latest when the driver ends.
    """
    path = new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes what was written so far; for when the results that need it are stored."""
    try:
        jvm = spark.sparkContext._jvm
        for path in _written:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _written.clear()
    except Exception:  # the session has ended
        pass
