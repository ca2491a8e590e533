"""Shared helpers: reading tables, durable intermediate tables, text columns."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.sources import tables

#: Code point ranges that count as white space in the contracts of the operators.
SPACE = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "documents")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir. Only a session on one machine may do without and gets a
    temporary one; elsewhere no folder of one machine would do, so an unset folder is an error."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        place = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place


#: Intermediate tables written so far, by the application that reads them.
_written: dict[str, list[str]] = {}


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends and lost executors cost nothing twice.

    Results read the table whenever they are asked for, so it stays until release() is called.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Let Spark delete the shuffles of plans that are no more: it does so when the driver's collector finds them gone,
    which a mostly idle driver does too late for the disks of its executors."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession) -> int:
    """Remove the intermediate tables of this application, once no result needs them any more; how many there were."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        place = hadoop.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


def text_of(column: str = "text") -> Column:
    """The column's text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the column written as text, modulo modulus; -1 for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(-1)).cast("int")
