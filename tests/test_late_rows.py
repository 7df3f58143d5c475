"""Rows that come years late in the stream."""

from pyspark.sql import functions as F

from freshet.streaming import ingest


def test_no_late_row_is_lost(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = "station_id string, ion string, t string, value_mg_L double"

    def deliver(*rows):
        df = spark.createDataFrame(list(rows), schema).select("station_id", "ion", F.to_timestamp_ntz("t").alias("ts"), "value_mg_L")
        df.write.mode("append").parquet(src)
        ingest.merge_available(ingest.record_stream(spark, src, df.schema, 1), out, cp, ["station_id", "ion", "ts"])

    deliver(("s1", "cl", "2020-01-05 00:00:00", 2.0), ("s1", "cl", "2020-01-05 00:00:00", 2.0), ("s1", None, "2020-01-05 00:00:00", 2.0))
    deliver(("s1", "cl", "2020-06-05 00:00:00", 3.0))
    deliver(("s1", "cl", "2016-03-01 00:00:00", 4.0), ("s1", "cl", "2020-01-05 00:00:00", 2.0), ("s1", None, "2020-01-05 00:00:00", 2.0))
    table = spark.read.parquet(out)
    assert sorted((r.ion or "", str(r.ts), r.value_mg_L) for r in table.collect()) == [("", "2020-01-05 00:00:00", 2.0), ("cl", "2016-03-01 00:00:00", 4.0), ("cl", "2020-01-05 00:00:00", 2.0), ("cl", "2020-06-05 00:00:00", 3.0)]
    assert sum(r.n for r in ingest.window_counts(table, "ts", ["station_id"]).collect()) == 4
