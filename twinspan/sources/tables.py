"""The project's Parquet tables and their counting rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def counting_rows(df: DataFrame, key: str, rev: str = "rev") -> DataFrame:
    """Of each key the row with the greatest rev (null counts as the least); rows without a key are dropped.

    One shuffle by key; the sort stops at the first row of each key.
    """
    w = Window.partitionBy(key).orderBy(F.col(rev).desc_nulls_last())
    return df.where(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan, dealt to as many tasks as the session has cores where the source has fewer pieces (as one small
    file has); for steps that spend much more time on a row than reading it takes."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
