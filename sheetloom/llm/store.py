"""Tables of the corpus, and the library's settled tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.store import mark, release, settle

__all__ = ["mark", "release", "settle", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
