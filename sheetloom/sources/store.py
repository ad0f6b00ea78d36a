"""Cutting lineage: tables written to the shared folder and read back."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir` of the session.

    Only where that is unset on a single machine (tests) a temporary folder is taken; on a
    cluster this is an error, as executors wouldn't see each other's files there.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found and sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or _own_folder()).rstrip("/")


@lru_cache(1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="sheetloom-")


def place(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there stays until `release` or the end of the driver."""
    path = f"{folder(spark)}/settled-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def settle(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back.

    Later jobs start from these files, read only the columns they need and know their size. The
    files stay until `release` or the end of the driver.
    """
    spark = df.sparkSession
    path = place(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in time for `release`."""
    return len(_written)


def release(since: int = 0, upto: int | None = None) -> None:
    """Delete the settled tables written between two marks; tables made of them must have been written by then."""
    for spark, path in _written[since:upto]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del _written[since:upto]


@atexit.register
def _last() -> None:
    try:
        release()
    except Exception:  # noqa: BLE001  the session may be gone already
        _written.clear()
