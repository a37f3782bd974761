"""Table sources: parquet, pruned to the wanted columns. How it is cut into tasks is Spark's
business (``spark.sql.files.maxPartitionBytes``): nothing is shuffled after the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..frame import quoted


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*map(quoted, columns)) if columns else df
