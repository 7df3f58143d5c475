"""Incremental ingest of the long record: file stream, late rows, windowed counts, de-duplication, resumable sinks."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def record_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a landing folder as a stream; which files are done stands in the sink's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def distinct_readings(stream: DataFrame, keys: list[str], ts: str, lateness: str = "30 days") -> DataFrame:
    """The first of equal readings; state is kept for ``lateness`` of event time only, and rows later than that are dropped.

    Where rows may come later, ``merge_available`` loses none.
    """
    return stream.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], width: str = "30 days", lateness: str = "60 days") -> DataFrame:
    """Readings, and their mean, per key and tumbling window; rows later than ``lateness`` are dropped by the watermark.

    Where rows may come later, ``window_counts`` over the table that ``merge_available`` writes counts all of them.
    """
    timed = stream.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", lateness)
    out = timed.groupBy(F.window("event_time", width).alias("w"), *keys).agg(F.count("*").alias("n"), F.avg("value_mg_L").alias("mean"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "mean")


def window_counts(table: DataFrame, ts: str, keys: list[str], width: str = "30 days") -> DataFrame:
    """The same counts over a written table, whatever the order in which its rows came."""
    out = table.groupBy(F.window(F.col(ts).cast("timestamp"), width).alias("w"), *keys).agg(F.count("*").alias("n"), F.avg("value_mg_L").alias("mean"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "mean")


def merge_available(stream: DataFrame, out: str, checkpoint: str, keys: list[str]) -> None:
    """Appends to ``out`` the readings of all files that are there whose ``keys`` it does not hold yet, however late they come.

    Null keys form keys. There is no watermark and no state: each batch is compared with the written table, so a batch
    that runs again adds nothing twice.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        path = spark._jvm.org.apache.hadoop.fs.Path(out)
        if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            old = spark.read.schema(batch.schema).parquet(out).select(*[F.col(k).alias(f"__{k}") for k in keys])
            new = new.join(old, reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left_anti")
        new.write.mode("append").parquet(out)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Processes all files that are there and stops; run again, it takes up only new ones."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
