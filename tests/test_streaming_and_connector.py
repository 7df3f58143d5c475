"""File stream and windowed connector."""

import time

from pyspark.sql import functions as F

from freshet.sources.connector import WindowedReader, WindowedSource, year_windows
from freshet.streaming import ingest

CALLS, ASKED = [], []


def fake_catalogue():
    return ["ny", "on"]


def fake_service(region, first, last, characteristics):
    if region == "flaky" and not CALLS:
        CALLS.append(1)
        raise OSError("try again")
    ASKED.append((region, first, last, characteristics))
    names = characteristics or ("Chloride", "Sodium")
    return [(region, y, f"{region}-1", c, float(y), "mg/L") for y in range(first, last + 1) for c in names]


def test_windows():
    assert year_windows(1990, 2025, 9) == [(1990, 1998), (1999, 2007), (2008, 2016), (2017, 2025)] and year_windows(2000, 2000, 9) == [(2000, 2000)]


def test_windowed_source(spark):
    spark.dataSource.register(WindowedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("windowed").options(fetch="tests.test_streaming_and_connector:fake_service", regions="ny,on,flaky", first=2000, last=2009, width=4, pause=0).load()
    assert df.count() == 60 and df.filter("region = 'ny' and year >= 2005").count() == 10
    assert df.filter("characteristic = 'Sodium' and region in ('ny', 'on') and year = 2003").count() == 2
    listed = spark.read.format("windowed").options(fetch="tests.test_streaming_and_connector:fake_service", catalogue="tests.test_streaming_and_connector:fake_catalogue", characteristics="Chloride,Sodium", first=2000, last=2001).load()
    assert listed.count() == 8 and listed.filter("characteristic = 'Calcium'").count() == 0 and listed.filter("characteristic = 'Sodium'").select("region").distinct().count() == 2


def test_what_is_asked_of_the_service():
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In

    r = WindowedReader({"fetch": "tests.test_streaming_and_connector:fake_service", "regions": "ny,on", "first": "2000", "last": "2009", "width": "5"})
    list(r.pushFilters([EqualTo(("characteristic",), "Sodium"), In(("region",), ("on", "qc")), GreaterThanOrEqual(("year",), 2004)]))
    assert [(p.region, p.first, p.last, p.characteristics) for p in r.partitions()] == [("on", 2004, 2008, ("Sodium",)), ("on", 2009, 2009, ("Sodium",))]
    assert {x[3] for x in r.read(r.partitions()[1])} == {"Sodium"}


def test_stream(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    rows = [("s1", "cl", "2020-01-05 00:00:00", 2.0), ("s1", "cl", "2020-01-06 00:00:00", 4.0), ("s1", "cl", "2020-01-06 00:00:00", 4.0), ("s2", "cl", "2020-01-06 00:00:00", None)]
    df = spark.createDataFrame(rows, "station_id string, ion string, t string, value_mg_L double").select("station_id", "ion", F.to_timestamp_ntz("t").alias("ts"), "value_mg_L")
    df.write.mode("append").parquet(src)
    stream = ingest.distinct_readings(ingest.record_stream(spark, src, df.schema), ["station_id", "ion", "ts"], "ts")
    ingest.run_available(stream, out, cp)
    assert spark.read.parquet(out).count() == 3
    time.sleep(0.1)
    df.withColumn("station_id", F.lit("s3")).write.mode("append").parquet(src)
    ingest.run_available(stream, out, cp)
    assert spark.read.parquet(out).count() == 5
    counts = ingest.windowed_counts(ingest.record_stream(spark, src, df.schema), "ts", ["station_id"])
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.station_id: r.n for r in spark.table("counts").collect()} == {"s1": 3, "s2": 1, "s3": 4}
