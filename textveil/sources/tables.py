"""Tables of a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Narrow rows of a task, each of which stands for much work.
TASK_ROWS = 10_000


def tasks(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """How many tasks of about so many rows a table makes, at least one a core. Rows are counted in the files' footers."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to as many tasks as there are cores where its files make fewer; larger tables stay as they are read.

    For tables whose rows cost much more to work on than to move. Only the splits of the files are counted, no row is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
