"""Reading the tables of a data folder."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.plans.shipping import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of the folder; columns and filters are pushed into the scan by Catalyst."""
    ship(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores. A scan with at least as many partitions as the cluster has cores, so any large table, is left
    as it is; only a small one, which would be one task's work, is dealt out."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
