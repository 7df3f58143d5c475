"""The common base of the measurement queries, read from small tables on disk."""

from datetime import datetime
from zoneinfo import ZoneInfo

import pytest

from freshet.plans import measurement

SCHEMA = (
    "rec_id long, source string, station_id string, latitude double, longitude double, country string, state_prov string, site_type string, datetime string, visit_no long, "
    "ion string, value_source double, unit_source string, below_flag string, detection_limit double, fraction string, characteristic_source string, value_mg_L double"
)


@pytest.fixture
def folder(spark, tmp_path):
    """Writes readings, given as changes to a plain one, with the small tables beside them."""

    def write(*changes):
        plain = {
            "source": "ECCC", "station_id": "s", "latitude": 45.0, "longitude": -75.0, "country": "CA", "state_prov": "ON", "site_type": "river", "datetime": "2020-01-02T03:04:05Z", "ion": "cl",
            "value_source": 2.0, "unit_source": "mg/L", "below_flag": None, "detection_limit": None, "fraction": "total", "characteristic_source": "Chloride", "value_mg_L": 2.0,
        }
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        rows = [{**plain, "rec_id": k, "visit_no": k, **c} for k, c in enumerate(changes)]
        spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/harmonize.parquet")
        spark.createDataFrame([("ON", "America/Toronto"), ("QC", "America/Toronto"), ("BC", "America/Vancouver")], "state_prov string, zone string").write.parquet(f"{tmp_path}/zone_ref.parquet")
        spark.createDataFrame([("cl", 35.45, 1, 35.45), ("ca", 40.078, 2, 20.039)], "ion string, molar_mass double, valence int, equiv_weight double").write.parquet(f"{tmp_path}/ion_ref.parquet")
        return str(tmp_path)

    return write


def test_all_written_forms_reach_the_base(spark, folder):
    local = lambda zone, *t: datetime(*t, tzinfo=ZoneInfo(zone)).astimezone(ZoneInfo("UTC")).replace(tzinfo=None)
    toronto, vancouver = "America/Toronto", "America/Vancouver"
    stamps = [
        ("2020-01-02T03:04:05Z", "ON", datetime(2020, 1, 2, 3, 4, 5)), ("2019-12-31T22:00:00-05:00", "ON", datetime(2020, 1, 1, 3)), ("2020-01-02T03:04:05.6789Z", "ON", datetime(2020, 1, 2, 3, 4, 5)),
        ("2019-12-31 20:00", "BC", local(vancouver, 2019, 12, 31, 20)), ("07/30/1999 02:07 PM", "ON", local(toronto, 1999, 7, 30, 14, 7)), ("19990303", "ON", local(toronto, 1999, 3, 3)),
        ("1262304000", "ON", datetime(2010, 1, 1)), ("3 févr. 2011 14 h 05", "QC", local(toronto, 2011, 2, 3, 14, 5)), ("2015-08-08 23:36:00 UTC", "ON", datetime(2015, 8, 8, 23, 36)),
        ("2020-11-01 01:30:00", "ON", None), ("2020-03-08 02:30:00", "ON", None), ("2020-02-30T00:00:00Z", "ON", None), ("n/a", "ON", None), (None, "ON", None),
    ]
    d = folder(*[{"datetime": t, "state_prov": p} for t, p, _ in stamps])
    want = {k: at for k, (_, _, at) in enumerate(stamps) if at}
    got = measurement.obs(spark, d).collect()
    assert {r.rec_id: r.ts for r in got} == want and {r.rec_id: (r.year, r.month) for r in got} == {k: (at.year, at.month) for k, at in want.items()}
    assert {r.year: r.n_obs_year for r in measurement.QUERIES["annual_means"](spark, d).collect()} == {y: sum(at.year == y for at in want.values()) for y in {at.year for at in want.values()}}


def test_base_does_not_depend_on_the_session_zone(spark, folder):
    d = folder({"datetime": "2020-01-02T03:04:05Z"}, {"datetime": "2020-01-02T03:04:05+00:00"})
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Vancouver")
        assert {r.ts for r in measurement.stamped(spark, d).select("ts").collect()} == {datetime(2020, 1, 2, 3, 4, 5)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_values_not_converted_yet_are_filled(spark, folder):
    new = lambda v, unit, **more: {"value_mg_L": None, "value_source": v, "unit_source": unit, **more}
    cases = [
        (new(3.0, "mg/l"), 3.0), (new(500.0, "µg/L"), 0.5), (new(2.0, "meq/L"), 70.9), (new(1.5, "mmol/L", ion="ca"), 60.117), (new(4.0, "milligrams per litre"), 4.0),
        (new(7.0, None, characteristic_source="Chloride, ug/L"), 0.007), ({"value_mg_L": float("nan"), "value_source": 5.0, "unit_source": "ppm"}, 5.0), ({"value_mg_L": 9.0, "value_source": 1.0}, 9.0),
        (new(1.0, "NTU"), None), (new(1.0, None), None), (new(None, "mg/L"), None), (new(-1.0, "mg/L"), None), (new(1.0, "mmol/L", ion=None), None),
    ]
    got = {r.rec_id: r.value for r in measurement.obs(spark, folder(*[c for c, _ in cases])).collect()}
    assert got == pytest.approx({k: v for k, (_, v) in enumerate(cases) if v is not None})


def test_copies_and_redelivered_readings_count_once(spark, folder):
    usgs = {"source": "USGS_SAMPLES", "visit_no": 1, "datetime": "2020-05-06T14:00:00Z", "value_mg_L": 10.0}
    other = {"datetime": "2020-05-06", "value_source": 40.0, "value_mg_L": 40.0}
    d = folder(
        {**usgs, "source": "EPA_WQP", "datetime": "2020-05-06 10:00", "value_mg_L": None, "value_source": 10.0}, usgs, usgs, {**usgs, "source": "EPA_WQP", "datetime": "2020-05-06"},
        {**usgs, "value_mg_L": 12.0, "fraction": "dissolved"}, {**other, "visit_no": 2}, {**other, "visit_no": 3}, {**other, "visit_no": None}, {**other, "visit_no": None, "datetime": "2020-05-07"},
    )
    assert sorted(r.rec_id for r in measurement.obs(spark, d).collect()) == [1, 4, 5, 6, 7, 8]
    assert [(r.value, r.n_obs_year) for r in measurement.QUERIES["annual_means"](spark, d).collect()] == [(pytest.approx(182 / 6), 6)]


def test_the_base_is_made_again_when_its_files_change(spark, folder, tmp_path):
    d = folder({}, {"station_id": "t"})
    assert measurement.obs(spark, d).count() == 2 and measurement.obs(spark, d) is measurement.obs(spark, d)
    h = spark.read.parquet(f"{d}/harmonize.parquet")
    spark.createDataFrame(h.collect() + [r.__class__(*[99 if c == "rec_id" else "u" if c == "station_id" else v for c, v in zip(h.columns, r)]) for r in h.collect()[:1]], h.schema).write.mode("overwrite").parquet(f"{d}/harmonize.parquet")
    assert {r.station_id for r in measurement.obs(spark, d).collect()} == {"s", "t", "u"}
