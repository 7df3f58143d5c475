"""Timestamps, units, proximity, record parsing and plausibility against brute force and hand-made cases."""

import csv
import io
import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from freshet.operators import plausibility, proximity, stations, timestamps, unit_aliases
from freshet.sources import records

STAMPS = [
    # text, source, zone, expected
    ("2005-03-01T10:00:00Z", "A", "America/Toronto", "2005-03-01T10:00:00Z"),
    ("2005-03-01T10:00:00.987Z", "A", None, "2005-03-01T10:00:00Z"),
    ("2005-03-01T10:00:00-05:00", "A", None, "2005-03-01T15:00:00Z"),
    ("2005-03-01 10:00:00-0530", "A", None, "2005-03-01T15:30:00Z"),
    ("  '2005-03-01 10:00 ", "A", "America/Toronto", "2005-03-01T15:00:00Z"),
    ("2005-07-01", "A", "America/Toronto", "2005-07-01T04:00:00Z"),
    ("2005.07.01 01:02", "A", "America/Regina", "2005-07-01T07:02:00Z"),
    ("20050701 0102", "A", "America/Regina", "2005-07-01T07:02:00Z"),
    ("20050701T0102", "A", "America/Regina", "2005-07-01T07:02:00Z"),
    ("20050701010203", "A", "America/Regina", "2005-07-01T07:02:03Z"),
    ("1119690000", "A", None, "2005-06-25T09:00:00Z"),
    ("876178484366", "A", None, "1997-10-06T22:54:44Z"),
    ("1 mai 2017 9 h 10", "A", "America/Toronto", "2017-05-01T13:10:00Z"),
    ("9 août 2024 16 h 03", "A", "America/Toronto", "2024-08-09T20:03:00Z"),
    ("04-Jul-99 08:48", "A", "America/Vancouver", "1999-07-04T15:48:00Z"),
    ("04-JUL-12 08:48", "A", "America/Vancouver", "2012-07-04T15:48:00Z"),
    ("Sun, 01 May 2005 12:36:00 GMT", "A", None, "2005-05-01T12:36:00Z"),
    ("Apr 10, 2023 12:20 am EDT", "A", None, "2023-04-10T04:20:00Z"),
    ("Apr 10, 2023 12:20 pm EDT", "A", None, "2023-04-10T16:20:00Z"),
    ("2003-11-21 18:32:00 America/Phoenix", "A", "America/Toronto", "2003-11-22T01:32:00Z"),
    ("13/02/2005 10:00", "dmy", "America/Regina", "2005-02-13T16:00:00Z"),
    ("03/02/2005 10:00", "dmy", "America/Regina", "2005-02-03T16:00:00Z"),
    ("02/13/2005 10:00", "mdy", "America/Regina", "2005-02-13T16:00:00Z"),
    ("02/03/2005 10:00 PM", "mdy", "America/Regina", "2005-02-04T04:00:00Z"),
    ("2021-11-07 01:30", "A", "America/New_York", "ambiguous"),
    ("2021-11-07 01:30:00 America/New_York", "A", None, "ambiguous"),
    ("11/07/2021 01:30 EST", "mdy", "America/New_York", "2021-11-07T06:30:00Z"),
    ("2021-03-14 02:30", "A", "America/New_York", "nonexistent"),
    ("2021-03-14 02:30", "A", "America/Phoenix", "2021-03-14T09:30:00Z"),
    ("2021-03-14 03:00", "A", "America/New_York", "2021-03-14T07:00:00Z"),
    ("2021-02-29", "A", "America/New_York", "unreadable"),
    ("2020-02-29", "A", "America/New_York", "2020-02-29T05:00:00Z"),
    ("2015-04-09T27:07:00Z", "A", None, "unreadable"),
    ("2015-04-09 10:71", "A", "America/New_York", "unreadable"),
    ("0000-00-00 00:00", "A", "America/New_York", "unreadable"),
    ("1991-06-", "A", "America/New_York", "unreadable"),
    ("spring 1991", "A", "America/New_York", "unreadable"),
    ("13:00 PM", "A", "America/New_York", "unreadable"),
    ("2015-04-09 13:00 PM", "A", "America/New_York", "unreadable"),
    ("2015-04-09 10:00:00 Nowhere/City", "A", "America/New_York", "unreadable"),
    ("2015-04-09 10:00 XYZ", "A", "America/New_York", "unreadable"),
    ("2015-04-09 10:00", "A", None, "no_zone"),
    ("", "A", "America/New_York", "unreadable"),
    (None, "A", "America/New_York", None),
    ("2015-04-09 10:00", None, "America/New_York", "2015-04-09T14:00:00Z"),
    ("x" * 20000, "A", "America/New_York", "unreadable"),
]


def test_stamps(spark):
    from pyspark.sql import functions as F

    rows = [(i, *x[:3], "other") for i, x in enumerate(STAMPS)]
    df = spark.createDataFrame(rows, "k int, stamp string, source string, zone string, UTC_STATUS string")
    out = timestamps.normalize_timestamps(df, "stamp", "zone", "source")
    out = out.select("k", F.when(F.col("utc_status") == "ok", timestamps.instant_text("utc_seconds")).otherwise(F.col("utc_status")).alias("u"))
    got = {r.k: r.u for r in out.collect()}
    assert [(x[0] and x[0][:60], got[i]) for i, x in enumerate(STAMPS)] == [(x[0] and x[0][:60], x[3]) for x in STAMPS]
    assert timestamps.normalize_timestamps(df.limit(0), "stamp", "zone", "source").count() == 0


def test_local_clock_against_zoneinfo(spark):
    rng = random.Random(5)
    zones = ["America/New_York", "America/Edmonton", "America/Halifax", "America/Phoenix"]
    rows = []
    for i in range(800):
        base = datetime(rng.randint(1990, 2025), rng.choice([3, 4, 10, 11]), 1) + timedelta(minutes=rng.randint(0, 43000))
        rows.append((i, base.strftime("%Y-%m-%d %H:%M:%S"), rng.choice(zones)))
    out = timestamps.normalize_timestamps(spark.createDataFrame(rows, "k int, s string, z string"), "s", "z")
    got = {r.k: (r.utc_status, r.utc_seconds) for r in out.collect()}
    for k, s, z in rows:
        local = datetime.strptime(s, "%Y-%m-%d %H:%M:%S")
        fits = set()
        for fold in (0, 1):
            u = local.replace(tzinfo=ZoneInfo(z), fold=fold).astimezone(timezone.utc)
            if u.astimezone(ZoneInfo(z)).replace(tzinfo=None) == local:
                fits.add(int(u.timestamp()))
        want = ("ok", fits.pop()) if len(fits) == 1 else ("ambiguous" if fits else "nonexistent", None)
        assert got[k] == want, (s, z)


UNITS = {
    "mg/L": ("mg/L", 1000), "MG / l": ("mg/L", 1000), "ppm": ("mg/L", 1000), "milligrams per liter": ("mg/L", 1000), "mg/l CaCO3": ("mg/L", 1000),
    "µg/L": ("mass", 1), "μg/l": ("mass", 1), "ug / L": ("mass", 1), "ppb": ("mass", 1), "mg/m3": ("mass", 1), "ng/mL": ("mass", 1), "mg/dl": ("mass", 1e4), "mg/100 ml": ("mass", 1e4), "G/L": ("mass", 1e6),
    "MEQ/L": ("charge", 1000), "me/L": ("charge", 1000), "µeq/L": ("charge", 1), "microeq/L": ("charge", 1), "milliequivalents per liter": ("charge", 1000),
    "mM": ("molar", 1000), "mmol/l ": ("molar", 1000), "MOL/M3": ("molar", 1000), "mol m-3": ("molar", 1000), "uM": ("molar", 1), "umol/L": ("molar", 1),
    "NTU": ("none", 0), "mg/kg": ("none", 0), "mg": ("none", 0), "% sat": ("none", 0),
}


def test_unit_spellings():
    ix = unit_aliases.UnitIndex()
    assert {u: ix.best(u)[2:] for u in UNITS} == {u: (k, float(f)) for u, (k, f) in UNITS.items()}
    assert ix.best("completely unknown") is None and ix.best("") is None and ix.best("x" * 5000) is None
    assert ix.inside("Chloride, dissolved (ug / L)")[1] == "ug/L" and ix.inside("meq L-1 alkalinity, total")[1] == "meq L-1"
    assert ix.inside("Calcium, total")is None and ix.inside("Sodium, as mg/100 ml")[1] == "mg/100 ml" and ix.inside("MG DISSOLVED")[2] == "none"


@given(st.sampled_from(sorted(UNITS)), st.integers(0, 20))
def test_unit_distance_is_symmetric_and_zero_on_itself(u, k):
    v = sorted(UNITS)[k]
    assert unit_aliases.weighted_distance(u, u) == 0
    assert unit_aliases.weighted_distance(u, v, 99) == pytest.approx(unit_aliases.weighted_distance(v, u, 99))


def test_conversion(spark):
    ions = spark.createDataFrame([("cl", 35.45, 35.45), ("ca", 40.078, 20.039)], "ion string, molar_mass double, equiv_weight double")
    rows = [
        (1, 2.0, "meq/L", "Calcium", "ca"), (2, 2.0, "mM", "x", "cl"), (3, 3.0, None, "Chloride (ug/L)", "cl"), (4, 3.0, None, "Chloride", "cl"), (5, 3.0, "NTU", None, "cl"),
        (6, 3.0, "mg/L", None, "cl"), (7, None, "ug/L", None, "cl"), (8, 3.0, None, None, None), (9, 3.0, "meq/L", None, None), (10, float("nan"), "ug/L", None, "cl"), (3, 3.0, None, "Chloride (ug/L)", "cl"),
    ]
    df = spark.createDataFrame(rows, "rec_id long, value_source double, unit_source string, characteristic_source string, ion string").selectExpr("*", "'z' as basis", "1 as spelling")
    got = sorted(map(tuple, unit_aliases.found(df, ions).collect()))
    assert got == [(1, 40078), (2, 70900), (3, 3), (3, 3), (4, -1), (5, -1), (8, -1), (9, -1)]
    assert unit_aliases.found(df.limit(0), ions).count() == 0


def _pairs_brute(rows, km):
    out = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            h = np.sin(np.radians(b[1] - a[1]) / 2) ** 2 + np.cos(np.radians(a[1])) * np.cos(np.radians(b[1])) * np.sin(np.radians(b[2] - a[2]) / 2) ** 2
            if 2 * 6371.0088 * np.arcsin(min(1, np.sqrt(h))) <= km:
                out.add(tuple(sorted((a[0], b[0]))))
    return out


def test_near_pairs_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{i:03d}", float(45 + rng.normal(0, 0.05)), float(-75 + rng.normal(0, 0.05))) for i in range(300)]
    rows += [("dup1", 45.0, -75.0), ("dup2", 45.0, -75.0), ("pole1", 89.9999, 10.0), ("pole2", 89.9999, -170.0), ("date1", 10.0, 179.999), ("date2", 10.0, -179.999), ("edge1", 44.8, -75.0), ("edge2", 44.8, -74.999)]
    df = spark.createDataFrame(rows, "id string, lat double, lon double")
    got = {(r.id_a, r.id_b) for r in proximity.near_pairs(df, 1.0).collect()}
    assert got == _pairs_brute(rows, 1.0)
    assert proximity.near_pairs(df.limit(0), 1.0).count() == 0


def test_crowded_blocks_lose_nothing(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    pts = spark.createDataFrame([(str(i), float(rng.uniform(0, 1)), float(rng.uniform(0, 1))) for i in range(400)], "point_id string, x double, y double")
    discs = proximity.disc_trapezoids(pts.select(F.col("point_id").alias("region_id"), "x", "y"), 5.0)
    rows = [(r.point_id, r.y, r.x) for r in pts.collect()]
    want = _pairs_brute(rows, 5.0) | {(r[0], r[0]) for r in rows}
    for how in ({}, {"per_task": 7}, {"per_task": 1}, {"per_task": 1, "least_side": 0.09}):
        got = proximity.locate(pts, discs, **how).collect()
        assert len(got) == 2 * (len(want) - 400) + 400 and {tuple(sorted(r[:2])) for r in got} == want


@pytest.mark.parametrize("km", [0.3, 80.0, 900.0])
def test_disc_trapezoids_cover_the_disc(spark, km):
    rng = np.random.default_rng(3)
    lat = np.concatenate((rng.uniform(-84.9, 84.9, 60), [89.9, -89.9, 86.0, 0.0, 10.0, -10.0]))
    lon = np.concatenate((rng.uniform(-180, 180, 60), [0.0, 50.0, 100.0, 180.0, -179.9999, 179.9999]))
    angle, far = rng.uniform(0, 2 * np.pi, (66, 12)), km / 6371.0088 * np.concatenate((np.full((66, 9), 0.999999), rng.uniform(0, 1, (66, 3))), 1)
    a, b = np.radians(lat)[:, None], np.radians(lon)[:, None]
    y = np.arcsin(np.sin(a) * np.cos(far) + np.cos(a) * np.sin(far) * np.cos(angle))
    x = b + np.arctan2(np.sin(angle) * np.sin(far) * np.cos(a), np.cos(far) - np.sin(a) * np.sin(y))
    x = (np.degrees(x) + 180) % 360 - 180
    discs = proximity.disc_trapezoids(spark.createDataFrame([(str(i), float(u), float(v)) for i, (u, v) in enumerate(zip(lon, lat))], "region_id string, x double, y double"), km)
    pts = spark.createDataFrame([(f"{i}/{k}", float(x[i, k]), float(np.degrees(y[i, k]))) for i in range(66) for k in range(12)], "point_id string, x double, y double")
    got = {tuple(r) for r in proximity.locate(pts, discs, 20.0, 20.0).filter("split(point_id, '/')[0] = region_id").select("point_id", "region_id").collect()}
    assert got == {(f"{i}/{k}", str(i)) for i in range(66) for k in range(12)}


def test_many_places_in_one_block_and_on_one_spot(spark):
    from pyspark.sql import functions as F

    n, km = 200_000, 0.05
    rng = np.random.default_rng(5)
    lat, lon = np.sort(rng.uniform(45.0, 45.199, n)), rng.uniform(-75.999, -75.001, n)
    pdf = pd.DataFrame({"id": [f"p{i:06d}" for i in range(n)], "lat": lat, "lon": lon})
    crowd = spark.range(50_000).select(F.format_string("q%05d", "id").alias("id"), F.lit(45.1).alias("lat"), F.lit(-75.5).alias("lon"))
    member = proximity.spots_of(spark.createDataFrame(pdf).unionByName(crowd))
    want, reach = 0, np.degrees(km / 6371.0088)
    lat2, lon2 = np.append(lat, 45.1), np.append(lon, -75.5)
    order = np.argsort(lat2)
    lat2, lon2 = lat2[order], lon2[order]
    end = np.searchsorted(lat2, lat2 + reach * 1.0001, "right")
    for k in range(1, int((end - np.arange(n + 1)).max())):
        i = np.flatnonzero(np.arange(n + 1) + k < end)
        want += int((proximity._km(lon2[i], lat2[i], lon2[i + k], lat2[i + k]) <= km).sum())
    assert proximity.near_spots(member, km).count() == want > 10_000
    labels = stations.proximity_clusters(member.select("id", "lat", "lon"), km)
    assert labels.filter("id like 'q%'").select("cluster_id").distinct().count() == 1 and labels.count() == n + 50_000


def test_pairs_of_a_crowd_at_one_position(spark):
    rows = [(f"s{i:04d}", 10.0, 20.0) for i in range(60)] + [(f"t{i:04d}", 10.001, 20.0) for i in range(30)] + [("far", 11.0, 20.0)]
    df = spark.createDataFrame(rows, "id string, lat double, lon double")
    old, proximity.LOT = proximity.LOT, 7
    try:
        assert {(r.id_a, r.id_b) for r in proximity.near_pairs(df, 1.0).collect()} == _pairs_brute(rows, 1.0)
        assert proximity.near_pairs(df, 1.0).count() == 90 * 89 // 2
    finally:
        proximity.LOT = old


def test_regions_hold_points(spark):
    rings = [("tri", [(0, 0), (4, 0), (0, 4)]), ("concave", [(10, 0), (14, 0), (14, 4), (12, 1), (10, 4)]), ("none", None), ("line", [(0, 0), (1, 1)])]
    regions = spark.createDataFrame([(n, r and [(float(x), float(y)) for x, y in r]) for n, r in rings], "region_id string, ring array<struct<x: double, y: double>>")
    pts = [("in", 1.0, 1.0), ("out", 3.0, 3.0), ("border", 2.0, 2.0), ("notch", 12.0, 3.0), ("arm", 10.5, 2.0), ("corner", 0.0, 0.0), ("null", None, 1.0), ("nan", float("nan"), 1.0)]
    df = spark.createDataFrame(pts, "point_id string, x double, y double")
    got = {tuple(r) for r in proximity.locate(df, proximity.decompose(regions, 0.5), 0.5, 1.0).select("point_id", "region_id").collect()}
    assert got == {("in", "tri"), ("border", "tri"), ("arm", "concave"), ("corner", "tri")}
    holed = spark.createDataFrame([("ring", [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]])], "region_id string, rings array<array<struct<x: double, y: double>>>")
    pts = spark.createDataFrame([("rim", 0.5, 2.0), ("hole", 2.0, 2.0), ("out", 5.0, 2.0), ("top", 2.0, 4.0), ("inner", 1.0, 2.0)], "point_id string, x double, y double")
    assert {r.point_id for r in proximity.locate(pts, proximity.decompose(holed, 0.5), 0.5, 1.0, per_task=1).collect()} == {"rim", "top", "inner"}


def test_usual_position(spark):
    rows = [("a", 1.0, 1.0)] * 2 + [("a", 2.0, 2.0)] * 2 + [("a", None, None)] * 5 + [("b", float("nan"), 1.0), ("b", 95.0, 1.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "station_id string, latitude double, longitude double")
    assert [tuple(r) for r in proximity.usual_positions(df, "station_id").collect()] == [("a", 1.0, 1.0)]


# ---- records -------------------------------------------------------------------------------------------------------


def _reason_brute(raw: str, delimiter: str, n: int, name_at: int, value_at: int) -> str | None:
    """Character by character."""
    fields, i = [], 0
    while True:
        if i < len(raw) and raw[i] == '"':
            i += 1
            text = ""
            while True:
                if i >= len(raw):
                    return "quoting"
                if raw[i] == '"':
                    if raw[i + 1 : i + 2] == '"':
                        text += '"'
                        i += 2
                        continue
                    i += 1
                    break
                text += raw[i]
                i += 1
            if i < len(raw) and raw[i] != delimiter:
                return "quoting"
        else:
            j = i
            while j < len(raw) and raw[j] != delimiter:
                if raw[j] == '"':
                    return "quoting"
                j += 1
            text, i = raw[i:j], j
        fields.append(text)
        if i >= len(raw):
            break
        i += 1
    if len(fields) != n:
        return "column_count"
    import re

    name, value = fields[name_at], fields[value_at]
    bad = not name.strip() or any(ord(c) < 32 or 127 <= ord(c) < 160 or c == "�" for c in name)
    if bad or not re.fullmatch(r"[ \t]*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t]*)?", value):
        return "invalid_value"
    return None


LAYOUT = records.Layout(",", "station_id,characteristic_source,value_mg_L", 3)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet='ab1.,"" \n\t-e�é;', max_size=14), min_size=1, max_size=5))
def test_structure_matches_scanner(raws):
    reasons, _ = records.judge([r.encode() for r in raws], [LAYOUT] * len(raws))
    # A full record is brought to quoting or counting faults by the scanner in the same order of checks.
    for r, got in zip(raws, reasons):
        want = _quoting_first(r)
        assert got == want, (r, got, want)


def _quoting_first(raw):
    return _reason_brute(raw, ",", 3, 1, 2)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet='a,"\n é', min_size=1, max_size=6), st.sampled_from(["1", "", "-2.5e3", "x", ".5"])), min_size=1, max_size=6))
def test_round_trip_of_written_records(rows):
    found = []
    for n, v in rows:
        out = io.StringIO()
        csv.writer(out, lineterminator="", quoting=csv.QUOTE_ALL).writerow(("s", n, v))
        found.append(out.getvalue().encode())
    reasons, s = records.judge(found, [LAYOUT] * len(found))
    for i, (n, v) in enumerate(rows):
        assert s.fields[i] == 3 and s.field(i, 1).decode() == n and s.field(i, 2).decode() == v
        assert reasons[i] == _reason_brute(found[i].decode(), ",", 3, 1, 2)


def test_files_are_loaded_whole_with_reasons(spark, tmp_path):
    layouts = spark.createDataFrame([("a", ",", "station_id,characteristic_source,value_mg_L", 3)], "layout string, delimiter string, header string, n_fields int")
    cells = lambda r: tuple(r.fields[c] for c in ("station_id", "characteristic_source", "value_mg_L"))
    rng, rows = np.random.default_rng(6), []
    for k in range(3000):
        name = rng.choice(["Chloride", "a, b", 'say "x"', "two\nlines", "x\n\n,y", "é"])
        rows.append((f"s{k}", str(name), str(rng.choice(["1", "2.5", ""]))))
    out = io.StringIO()
    csv.writer(out, lineterminator="\r\n").writerows([("station_id", "characteristic_source", "value_mg_L"), *rows])
    (tmp_path / "one.csv").write_text(out.getvalue(), newline="")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1000")
        got = records.load_records(spark, str(tmp_path / "one.csv"), layouts, "a").collect()
        assert len({r.line_no for r in got}) == len(got) == len(rows)
        assert sum(r.reason is None for r in got) == sum("\n" not in n for _, n, _ in rows)  # a line end is a control character in a name
        assert [cells(r) for r in sorted(got, key=lambda r: r.line_no) if r.reason is None] == [r for r in rows if "\n" not in r[1]]
        text = 'station_id,characteristic_source,value_mg_L\ns1,"open,1\ns2,fine,2\n\ns3,"quoted, fine",3\ns4,short\ns5,fine,x\ns6,"a ""b""",6\n'
        (tmp_path / "two.csv").write_text(text)
        got = {r.line_no: (r.reason, r.fields and cells(r)) for r in records.load_records(spark, str(tmp_path / "two.csv"), layouts, "a").collect()}
        want = {2: ("quoting", None), 3: (None, ("s2", "fine", "2")), 5: (None, ("s3", "quoted, fine", "3")), 6: ("column_count", None), 7: ("invalid_value", None), 8: (None, ("s6", 'a "b"', "6"))}
        assert got == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_parse_records(spark):
    layouts = spark.createDataFrame([("a", ",", "station_id,characteristic_source,value_mg_L", 3), ("b", ";", "characteristic_source;value_mg_L", 2)], "layout string, delimiter string, header string, n_fields int")
    rows = [
        (1, "a", 's,"Calcium, total",1.5'), (2, "a", 's,"Calcium, total,1.5'), (3, "a", "s,Calcium"), (4, "a", "s, ,1"), (5, "a", "s,Ca,1,5"), (6, "b", "Ca; 2e1 "), (7, "b", "Ca;NaN"),
        (8, "c", "x"), (9, None, "x"), (10, "b", None), (11, "b", ""), (12, "b", 'C"a;1'), (13, "b", "Ca;"), (14, "b", "C" * 100000 + ";1"), (1, "a", 's,"Calcium, total",1.5'),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "line_id long, layout string, raw string, reason string")
    parsed = records.parse_records(df, layouts)
    got = sorted((r.line_id, r.reason) for r in parsed.collect() if r.reason)
    assert got == [(2, "quoting"), (3, "column_count"), (4, "invalid_value"), (5, "column_count"), (7, "invalid_value"), (8, "no_layout"), (9, "no_layout"), (10, "no_record"), (11, "column_count"), (12, "quoting")]
    typed = {r.line_id: (r.characteristic_source and r.characteristic_source[:20], r.value_mg_L) for r in records.typed_rows(parsed).collect()}
    assert typed == {1: ("Calcium, total", 1.5), 6: ("Ca", 20.0), 13: ("Ca", None), 14: ("C" * 20, 1.0)}
    assert records.parse_records(df.limit(0), layouts).count() == 0


# ---- plausibility --------------------------------------------------------------------------------------------------


def _flags_brute(rows, factor=8, run=6):
    out = set()
    series = {}
    for rid, s, ion, visit, v, below in rows:
        if None not in (s, ion, visit, v) and v == v and below is False:
            series.setdefault((s, ion), []).append((visit, v, rid))
    for pts in series.values():
        m = float(np.median([v for _, v, _ in pts]))
        out |= {rid for _, v, rid in pts if v < 0 or v > factor * m or v < m / factor}
        seq = sorted({(n, v) for n, v, _ in pts})
        i = 0
        while i < len(seq):
            j = i
            while j < len(seq) and seq[j][1] == seq[i][1]:
                j += 1
            if j - i >= run:
                hit = set(seq[i:j])
                out |= {rid for n, v, rid in pts if (n, v) in hit}
            i = j
    return out


def _readings():
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for s in range(6):
        n = 900 if s == 0 else 60
        level = float(np.exp(rng.normal(3, 1)))
        v = np.round(level * np.exp(rng.normal(0, 0.35, n)), 2)
        for start, length in ((10, 6), (25, 5), (40, 9), (95, 7), (190, 6), (398, 12)):
            if start + length < n:
                v[start : start + length] = v[start]
        v[rng.choice(n, 4, replace=False)] *= 20
        v[rng.choice(n, 3, replace=False)] /= 30
        v[rng.choice(n, 1)] = -1.0
        for i, x in enumerate(v):
            k += 1
            rows.append((k, f"s{s}", "cl", i * (7 if s % 2 else 1), float(x), bool(rng.random() < 0.05)))
            if rng.random() < 0.1:
                k += 1
                rows.append((k, *rows[-1][1:]))
    return rows + [(k + 1, "s1", None, 1, 5.0, False), (k + 2, None, "cl", 1, 5.0, False), (k + 3, "s1", "cl", None, 5.0, False), (k + 4, "s1", "cl", 3, None, False), (k + 5, "s1", "cl", 4, float("nan"), False), (k + 6, "s1", "cl", 5, 1e9, None), (k + 7, "one", "cl", 5, 0.0, False)]


@pytest.mark.parametrize("long,block,chunk", [(100_000, 4096, 512), (100_000, 4096, 40), (50, 64, 40)])
def test_flags_against_brute_force(spark, long, block, chunk):
    rows = _readings()
    df = spark.createDataFrame(rows, "rec_id long, station_id string, ion string, visit_no long, value_mg_L double, below_detection boolean").selectExpr("*", "1 as value", "2 as median")
    got = {r.rec_id for r in plausibility.found(df, long=long, block=block, chunk=chunk).collect()}
    assert got == _flags_brute(rows)
    assert plausibility.found(df.limit(0)).count() == 0


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(3)
    e = rng.uniform(0.05, 1, (9, 4))
    post, moves = plausibility.posteriors(e, np.array([0, 5]), np.array([5, 4]))
    assert np.allclose(moves.sum((1, 2)), [4, 3])
    import itertools

    for first, n in ((0, 5), (5, 4)):
        total = np.zeros((n, 4))
        for path in itertools.product(range(4), repeat=n):
            p = plausibility.START[path[0]] * e[first, path[0]]
            for t in range(1, n):
                p *= plausibility.STEP[path[t - 1], path[t]] * e[first + t, path[t]]
            for t in range(n):
                total[t, path[t]] += p
        assert np.allclose(post[first : first + n], total / total.sum(1, keepdims=True))


def _flag_frame(spark, series):
    rows = [(f"s{k}", "cl", i, float(x), False) for k, v in enumerate(series) for i, x in enumerate(v)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "rec_id long, station_id string, ion string, visit_no long, value_mg_L double, below_detection boolean")
    return df.repartition(5)


def test_posteriors_overrule_the_plain_rules(spark):
    rng = np.random.default_rng(8)
    steps = rng.choice([10.0, 11.0], 400)  # two levels only: runs of six are usual here
    noisy = 10 * np.exp(rng.normal(0, 0.9, 400))  # a wide series: a reading four times the median is usual here
    calm = 10 * np.exp(rng.normal(0, 0.05, 400))  # a calm one: twice the median is a spike
    calm[200] *= 2.2
    noisy[200] = 40.0
    calm[300:306] = 10.0
    got = {(r.station_id, r.visit_no): r for r in plausibility.flag_visits(_flag_frame(spark, [steps, noisy, calm]), least_doubt=0.0).collect()}
    runs = [r for r in got.values() if r.station_id == "s0" and r.run_length >= 6]
    assert runs and sum(r.flag == 2 for r in runs) < len(runs) / 2  # runs of six that are not stuck
    assert got["s2", 200].flag == 1 and got["s1", 200].flag == 0 and all(got["s2", k].flag == 2 for k in range(300, 306))
    assert all(got["s0", r.visit_no].doubt > plausibility.CANDIDATE for r in runs)


def test_long_series_are_judged_like_short_ones(spark):
    rng = np.random.default_rng(9)
    v = [np.round(20 * np.exp(rng.normal(0, 0.3, n)), 1) for n in (700, 90, 1500)]
    for x in v:
        x[rng.choice(len(x), 6, replace=False)] *= 9
        x[50:58] = x[50]
    df = _flag_frame(spark, v)
    got = [{(r.station_id, r.visit_no): (r.flag, round(r.doubt, 5)) for r in plausibility.flag_visits(df, long=long, chunk=128, block=100).collect()} for long in (10_000, 80)]
    assert got[0].keys() == got[1].keys() and all(got[0][k][0] == got[1][k][0] and abs(got[0][k][1] - got[1][k][1]) < 1e-4 for k in got[0])
