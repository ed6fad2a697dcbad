"""Parquet tables as matrices and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(table: DataFrame, *columns: str) -> DataFrame:
    """Columns of a table scan over at least one task per core.

    A table with fewer file splits than cores is redistributed; a large one has
    plenty of splits and is used as it is.  Hashing every column keeps the exchange
    the same for all uses of the table in one query, so Spark runs it once.
    """
    table = table.select(*columns)
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores, *columns) if table.rdd.getNumPartitions() < cores else table
