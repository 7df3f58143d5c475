"""Parquet tables of a data directory, with missing numbers normalised."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float columns becomes null: Spark orders NaN above all numbers and averages keep it."""
    return df.select(*[F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`") for f in df.schema])


def file_state(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """(path, bytes, time of change) of the files of a table, on whatever file system: alike as long as nothing was written."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.listStatus(p) or ()
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found))
