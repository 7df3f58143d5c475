"""Operators of the measurement pipeline on hand-made fixtures."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from freshet.functions import scalars as S
from freshet.operators import harmonize, models, series, stations
from freshet.sources import files, standardize


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_ion_and_fraction_names(spark):
    names = ["Alkalinity, total", "Sulphate", "SO4", " CHLORIDE DISSOLVED", "Sodium adsorption ratio", "Sodium", "Calcium carbonate", "Calcium, filtered", "Magnesium", "pH", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in values(df, S.standard_ion("n"))] == ["alk", "so4", "so4", "cl", None, "na", None, "ca", "mg", None, None]
    df = spark.createDataFrame([(n,) for n in ["Dissolved", "Total", "Recoverable", "Unfiltered", "x", None]], "n string")
    assert [r[0] for r in values(df, S.fraction_class("n"))] == ["dissolved", "total", "total", "dissolved", "unknown", "unknown"]
    assert [r[0] for r in values(df, S.fraction_class("n", fix_unfiltered=True))][3] == "total"


def test_units_and_audit(spark):
    rows = [(500.0, "ug/L", "cl"), (10.0, "meq/L", "ca"), (1.0, "mmol/l ", "so4"), (2.0, "MOL/M3", "na"), (3.0, "ppm", "mg"), (1.0, "microgram per liter", "cl"), (4.0, "Milligram per liter", "cl"), (1.0, "mg/l CaCO3", "alk"), (1.0, None, "cl"), (None, "mg/L", "cl")]
    df = spark.createDataFrame(rows, "value_source double, unit_source string, ion string")
    got = [r[0] for r in values(harmonize.harmonize_units(df), "value_mg_L")]
    assert got == pytest.approx([0.5, 200.39, 96.06, 45.98, 3.0, 4.0])
    assert {r.unit: (r.n_unsupported, r.n_no_number) for r in harmonize.unit_audit(df).collect()} == {"microgram per liter": (1, 0), "mg/l CaCO3": (1, 0), "": (1, 0), "mg/L": (0, 1)}


def test_censoring(spark):
    rows = [(3.0, 2.0, "<"), (3.0, None, "<"), (None, 4.0, ""), (5.0, 2.0, " ND "), (5.0, 2.0, "E"), (5.0, 2.0, None)]
    df = spark.createDataFrame(rows, "value_mg_L double, detection_limit double, below_flag string")
    run = lambda s: values(harmonize.handle_below_detection(df, s), "value_mg_L", "below_detection")
    assert run("half_dl") == [(1.0, True), (None, True), (2.0, True), (1.0, True), (5.0, False), (5.0, False)]
    assert [v for v, _ in run("dl")] == [2.0, None, 4.0, 2.0, 5.0, 5.0] and [v for v, _ in run("zero")] == [0.0, 0.0, 0.0, 0.0, 5.0, 5.0] and run("drop") == [(5.0, False)] * 2


def test_numbers(spark):
    df = spark.createDataFrame([(x,) for x in ["1e3", " 2 ", "1,000", "<5", "5d", "NaN", "", None, "-.5"]], "t string")
    assert [r[0] for r in values(df, S.parse_number("t"))] == [1000, 2, None, None, None, None, None, None, -0.5]


def test_scalar_formulas(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    lit = lambda v: F.lit(v).cast("double")
    assert get(S.haversine_km(lit(45), lit(-75), lit(45.005), lit(-75))) == pytest.approx(0.555975, abs=1e-6)
    assert [round(get(S.project_policy(lit(100), lit(0.02), F.lit(2020), f)), 4) for f in (1.0, 0.5, 0.0)] == [182.2119, 141.9068, 110.5171]
    assert get(S.project_policy(lit(100), lit(0.02), F.lit(2026), 1.0)) == pytest.approx(164.8721, abs=1e-4)
    assert get(S.project(lit(10), lit(0.01), F.lit(2020))) == pytest.approx(13.498588, abs=1e-6)
    c = S.shift_climate(lit(5), lit(400), lit(800), lit(2), lit(32))
    assert [get(c[k]) for k in ("temp_c", "pet_mm", "precip_mm")] == [7, 832, 432] and get(c["aridity"]) == pytest.approx(0.519231, abs=1e-6)
    assert get(S.safe_ratio(lit(1), lit(0))) is None and get(S.bounded_ratio(lit(1), lit(0), 0.0, 3.0)) == 3.0 and get(S.bounded_ratio(lit(0), lit(0), 0.0, 3.0)) is None
    assert get(S.block_id(lit(45.3), lit(-75.1))) == "22_-38" and get(S.clip(lit(None), 0.0, 1.0)) is None
    assert get(S.safe_name(F.lit("St. Lawrence / été"))) == "St__Lawrence___été" and get(S.iso_to_month_first(F.lit("2020-03-09"))) == "03-09-2020"


def test_theil_sen_and_kendall(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    data = {"fix": [1, 2, 3, 4, 100], "tie": [5, 5, 5, 5, 5], "down": [9, 7, 5, 3, 1], **{f"r{i}": list(np.round(rng.lognormal(2, 1, 5 + i * 4), 1)) for i in range(9)}}
    for k, v in data.items():
        years = np.sort(rng.choice(np.arange(1950, 2025), len(v), replace=False)) if k[0] == "r" else np.arange(2000, 2000 + len(v))
        rows += [(k, "cl", int(y), float(x)) for y, x in zip(years, v)]
        pairs = [(a, b) for a, b in itertools.combinations(range(len(v)), 2)]
        want[k] = (np.median([(v[b] - v[a]) / (years[b] - years[a]) for a, b in pairs]), sum(int(np.sign(v[b] - v[a])) for a, b in pairs), np.mean([x for y, x in zip(years, v) if y > years[-1] - 5]))
    df = spark.createDataFrame(rows, "station_id string, ion string, year int, value double").repartition(3)
    got = {r.station_id: r for r in series.station_trends(df, min_years=5).collect()}
    assert set(got) == set(data)
    for k, (slope, s, level) in want.items():
        assert got[k].slope_mgL_yr == pytest.approx(slope) and got[k].mk_s == s and got[k].base_level == pytest.approx(level)
        assert got[k].slope_log_lo <= got[k].slope_log_yr <= got[k].slope_log_hi
    assert got["fix"].slope_mgL_yr == 1.0 and got["fix"].mk_p == pytest.approx(2 / 120) and got["tie"].mk_p is None and got["down"].mk_p == pytest.approx(2 / 120)


def test_kendall_p_fixtures():
    p = lambda n, c: series.kendall_p_value(n * (n - 1) / 2 - 2 * c, n, 0, 0)
    assert [round(p(*x), 7) for x in ((10, 12), (33, 200))] == [0.0725502, 0.0485194] and p(10, 5) == pytest.approx(0.000946318, rel=1e-5)
    for n in (4, 5, 6):
        inv = [sum(a > b for a, b in itertools.combinations(q, 2)) for q in itertools.permutations(range(n))]
        for c in range(n * (n - 1) // 4):
            assert p(n, c) == pytest.approx(min(1, 2 * sum(i <= c for i in inv) / math.factorial(n)))
    assert series.kendall_p_value(3, 4, 6, 0) is None


def test_features(spark, monkeypatch):
    rows = [("a", "x", y, math.expm1(v)) for y, v in zip((1, 2, 3, 4), (1, 2, 3, 4))] + [("b", "x", y, math.expm1(v)) for y, v in zip((1, 2, 3, 4), (10, 20, 30, 40))]
    df = spark.createDataFrame(rows, "station_id string, ion string, year int, value double")
    pick = lambda d, s, c: [None if r[0] is None else round(r[0], 6) for r in values(d.filter(F.col("station_id") == s).orderBy("year"), c)]
    f = series.features(df)
    assert pick(f, "b", "lag1") == [None, 10, 20, 30] and pick(f, "a", "years_seen") == [0, 1, 2, 3]
    assert pick(f, "a", "roll3") == [None, 1, 1.5, 2] and pick(f, "b", "roll3") == [None, 10, 15, 20]
    assert pick(series.features(df, compat=True), "b", "roll3") == [2.5, 6.5, 15, 20]
    monkeypatch.setattr(series, "STRETCH", 5)  # stretches that cut through series and means alike
    assert pick(series.features(df, compat=True), "b", "roll3") == [2.5, 6.5, 15, 20]
    df = spark.createDataFrame([("a", "x", 2000 + i, math.expm1(v)) for i, v in enumerate((1, 2, 4, 8))], df.schema)
    assert pick(series.features(df), "a", "trail_slope") == [None, None, None, 1.5]


def test_quality_dedup_first(spark):
    rows = [("s", "cl", y) for y, n in ((2000, 4), (2001, 4), (2002, 3)) for _ in range(n)]
    df = spark.createDataFrame(rows, "station_id string, ion string, year int")
    assert harmonize.quality_filter(df, 2, 4).count() == 11 and harmonize.quality_filter(df, 3, 4).count() == 0
    rows = [(1, "EPA_WQP", "s", 1, "cl", 5.0), (2, "USGS_SAMPLES", "s", 1, "cl", 6.0), (3, "other", "s", 2, "cl", 1.0), (4, "ECCC", None, 2, "cl", 1.0), (5, "ECCC", None, 2, "cl", 1.0)]
    df = spark.createDataFrame(rows, "rec_id int, source string, station_id string, ts int, ion string, value double")
    for part in (1, 3):
        assert sorted(r[0] for r in values(harmonize.dedup_preference(df.repartition(part), ties=("value", "rec_id")), "rec_id")) == [2, 3, 4]
    df = spark.createDataFrame([("k", 1, None, "r"), ("k", 2, "q", None)], "k string, ts int, a string, b string")
    assert values(harmonize.first_non_null(df, "k", ["a", "b"], ["ts"]), "a", "b") == [("q", "r")]


def test_shares_count_missing_as_not_over(spark):
    df = spark.createDataFrame([(100.0,), (240.0,), (None,), (900.0,)], "v double")
    assert values(series.share_over(df, ["v"], [230.0]), "series", "threshold", "share_pct") == [("v", 230.0, 50.0)]


def test_seasons_and_bands(spark):
    ts = [pd.Timestamp(2020, m, 5) for m in (12, 1, 2, 6, 7, 8, 3)]
    df = spark.createDataFrame([("s", t.to_pydatetime(), 2.0 if t.month in (12, 1, 2) else 0.05) for t in ts], "station_id string, ts timestamp_ntz, value double")
    assert [r[0] for r in values(df, S.season("ts"))] == ["winter"] * 3 + ["summer"] * 3 + ["other"]
    r = stations.seasonal_means(df, 3).first()
    assert (r.winter_n, r.summer_n, r.ws_ratio) == (3, 3, 20.0) and stations.seasonal_means(df, 4).count() == 0
    lat = spark.createDataFrame([(25.0, 1.0), (28.0, 2.0), (28.1, 3.0), (61.0, 4.0), (61.5, 5.0)], "lat double, v double")
    b = {r.band: (r.median_value, r.n) for r in stations.latitude_bands(lat, "lat", "v").collect()}
    assert b[1] == (2.0, 1) and b[2] == (3.0, 1) and b[12] == (4.0, 1) and b[5] == (None, 0) and len(b) == 12


def test_clusters(spark):
    rows = [("A", 45.0, -75.0), ("B", 45.005, -75.0), ("C", 45.010, -75.0), ("D", 46.0, -75.0), ("E", None, None)]
    df = spark.createDataFrame(rows, "id string, lat double, lon double")
    assert dict(values(stations.proximity_clusters(df), "id", "cluster_id")) == {"A": "A", "B": "A", "C": "A", "D": "D", "E": None}
    chain = spark.createDataFrame([(f"{99 - i:02d}", 45 + i * 0.008, -75.0) for i in range(60)], "id string, lat double, lon double")
    assert {r[1] for r in values(stations.proximity_clusters(chain), "id", "cluster_id")} == {"40"}


def test_folds(spark):
    df = spark.createDataFrame([(g,) for g, n in zip("abcdefg", (5, 4, 3, 2, 2, 1, 1)) for _ in range(n)], "block string")
    load = {}
    for r in stations.group_folds(df, "block", 3).collect():
        load[r.fold] = load.get(r.fold, 0) + r.n
    assert sorted(load.values()) == [6, 6, 6]


def test_tree_shap_matches_enumeration():
    nodes = [(0, 0.5, 1, 4, 0, 10), (1, 0.3, 2, 3, 0, 6), (-1, 0, -1, -1, 5.0, 4), (-1, 0, -1, -1, 1.0, 2), (1, 0.7, 5, 6, 0, 4), (0, 0.8, 7, 8, 0, 3), (-1, 0, -1, -1, 9.0, 1), (-1, 0, -1, -1, 2.0, 1), (-1, 0, -1, -1, 3.0, 2)]

    def value(k, x, known):
        f, t, a, b, v, n = nodes[k]
        if f < 0:
            return v
        if f in known:
            return value(a if x[f] <= t else b, x, known)
        return (nodes[a][5] * value(a, x, known) + nodes[b][5] * value(b, x, known)) / n

    for x in itertools.product((0.1, 0.6, 0.9), repeat=2):
        phi = models.tree_shap(nodes, np.array([*x, 0.0]))
        for f in (0, 1):
            other = 1 - f
            want = 0.5 * (value(0, x, {f}) - value(0, x, set())) + 0.5 * (value(0, x, {f, other}) - value(0, x, {other}))
            assert phi[f] == pytest.approx(want)
        assert phi[2] == 0 and phi.sum() == pytest.approx(value(0, x, {0, 1}) - value(0, x, set()))


def test_regime_names_are_unique():
    cols = ["log_cl", "log_na", "log_ca", "log_mg", "log_so4", "na_cl", "ca_mg", "slope_cl", "slope_so4"]
    centres = pd.DataFrame(np.random.default_rng(1).normal(size=(6, 9)), columns=cols)
    names = models.name_regimes(centres, cols)
    assert len(set(names.values())) == 6 and sum(v.startswith("Mixed") for v in names.values()) == 1


def test_source_layouts(spark):
    df = spark.createDataFrame([Row(Location_Identifier="L1", Result_Characteristic="Chloride", Activity_StartDateTime="2020-01-02T03:04:05-05:00", Result_Measure="12", Result_MeasureUnit="mg/L", Result_ResultDetectionCondition=None),
                                Row(Location_Identifier="L1", Result_Characteristic="pH", Activity_StartDateTime="2020-01-02", Result_Measure="7", Result_MeasureUnit="", Result_ResultDetectionCondition="Not Detected")])
    r = standardize.wqx(df, "EPA_WQP").collect()
    assert len(r) == 1 and r[0].value_source == 12 and str(r[0].datetime) == "2020-01-02 08:04:05" and r[0].below_flag == "" and r[0].latitude is None
    sites = spark.createDataFrame([("1", "45", "-75"), ("1", "46", "-76")], "SITE_NO string, LATITUDE string, LONGITUDE string")
    res = spark.createDataFrame([("1", "SULPHATE", "2001-02-03 04:05", "3", "<"), ("2", "CHLORIDE", "x", "bad", None)], "SITE_NO string, VARIABLE string, DATE_TIME_HEURE string, VALUE_VALEUR string, FLAG_MARQUEUR string")
    e = {x.station_id: x for x in standardize.eccc(res, sites).collect()}
    assert e["ECCC-1"].latitude == 45 and e["ECCC-1"].ion == "so4" and e["ECCC-2"].latitude is None and e["ECCC-2"].value_source is None and e["ECCC-2"].datetime is None
    st = spark.createDataFrame([("'07", "44", "-79", "Creek")], "STATION string, LATITUDE string, LONGITUDE string, NAME string")
    new = spark.createDataFrame([("'07", "Chloride", "2021-05-06", "07:08", "5", "mg/L", None, "Not detected")], "`Collection Site` string, Analyte string, `Collection Date` string, `Collection Time` string, Result string, Units string, `Value Qualifier` string, `Result Call` string")
    old = spark.createDataFrame([("07", "SODIUM", "19990506", "07:08", "5", "<T")], "STATION string, PARM_DESCRIPTION string, DATE_YYYYMMDD string, `TIME_HH:MM` string, RESULT string, REMARK_CODE string")
    n, o = standardize.ontario(new, st).first(), standardize.ontario(old, st).first()
    assert (n.station_id, str(n.datetime), n.below_flag, n.site_type) == ("ONPWQMN-07", "2021-05-06 07:08:00", "<", "Creek")
    assert (o.station_id, str(o.datetime), o.below_flag, o.ion) == ("ONPWQMN-07", "1999-05-06 07:08:00", "<", "na")
    b = spark.createDataFrame([("E1", "Magnesium Dissolved", "20010203040506", "1.5", "mg/L", ">", "50", "-120")], "EMS_ID string, PARAMETER string, COLLECTION_START string, RESULT string, UNIT string, RESULT_LETTER string, LATITUDE string, LONGITUDE string")
    x = standardize.bc_ems(b).first()
    assert (x.station_id, str(x.datetime), x.below_flag, x.fraction, x.ion) == ("BCEMS-E1", "2001-02-03 04:05:06", "", "dissolved", "mg")
    with pytest.raises(ValueError):
        standardize.wqx(spark.createDataFrame([("x",)], "a string"), "s")
    assert standardize.clean_names(spark.createDataFrame([("x",)], "`﻿ a ` string")).columns == ["a"]


def test_files(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("Név;Wert\nété;1,5\nb;2\nbad\n".encode("cp1252", "replace"))
    assert files.encodings(spark, str(p)).keys() == {"cp1252"} and files.separator_of(p.read_bytes(), "cp1252") == ";"
    df = files.read_text_table(spark, str(p))
    assert len(df.columns) == 2 and df.first()[0] == "été"
    q = tmp_path / "b.csv"
    q.write_bytes("﻿x,y\n1,2\n3\n".encode())
    assert files.read_text_table(spark, str(q)).columns == ["x", "y"] and files.read_text_table(spark, str(q)).count() == 2 and files.header_of(spark, str(q)) == ["x", "y"]
    late = tmp_path / "late.csv"  # the one byte that tells the encoding stands far behind the start of the file
    late.write_bytes(b"place,n\n" + b"plain,1\n" * 12_000 + "Montréal,2\n".encode("cp1252"))
    (tmp_path / "mixed").mkdir()
    (tmp_path / "mixed" / "a.csv").write_bytes(late.read_bytes())
    (tmp_path / "mixed" / "b.csv").write_bytes("place,n\nQuébec,3\n".encode())
    (tmp_path / "mixed" / "c.csv").write_bytes("place,n\nLévis\x81,4\n".encode("latin-1"))
    assert files.read_text_table(spark, str(late)).filter("n = 2").first()[0] == "Montréal"
    assert {r[0] for r in files.read_text_table(spark, str(tmp_path / "mixed")).filter("n > 1").collect()} == {"Montréal", "Québec", "Lévis\x81"}
    files.write_parquet(spark.range(5), str(tmp_path / "p1"))
    files.write_parquet(spark.range(3).withColumn("z", F.lit(1)), str(tmp_path / "p2"))
    u = files.read_parquet_union(spark, str(tmp_path / "p1"), str(tmp_path / "p2"))
    assert u.count() == 8 and u.filter("z is null").count() == 5 and files.row_count_from_footers(spark, str(tmp_path / "p1")) == 5
    unit = str(tmp_path / "unit")
    assert [files.run_unit(spark, unit, lambda: spark.range(2)), files.run_unit(spark, unit, lambda: spark.range(2))] == ["written", "skipped"]
    assert files.run_unit(spark, str(tmp_path / "e"), lambda: spark.range(0), failed=True) == "failed" and files.run_unit(spark, str(tmp_path / "e"), lambda: spark.range(0)) == "empty"
    g = tmp_path / "g.json"
    g.write_text('{"features": [{"properties": {"name": "A"}, "geometry": {"type": "Polygon", "coordinates": [[[0,0],[1,0],[1,1],[0,0]]]}}, {"properties": {"name": "Alaska"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0,0],[1,0],[1,1],[0,0]]]]}}]}')
    r = files.read_geojson(spark, str(g), leave_out=("Alaska",)).collect()
    assert len(r) == 1 and r[0].name == "A" and len(r[0].ring) == 4 and r[0].ring[1].x == 1.0 and len(r[0].rings) == 1
    files.write_csv(spark.range(2), str(tmp_path / "c"))
    files.write_records_json(spark.range(2), str(tmp_path / "j"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    assert dict(values(files.summary_document({"a": spark.range(2), "b": spark.range(0)}), "part", "document")) == {"a": '[{"id":0},{"id":1}]', "b": "[]"}
    assert files.find_data(spark, "a.csv", "/nowhere", str(tmp_path)) == str(p) and files.sample_rows(spark.range(9), ["id"], 2).count() == 2


def test_phases_are_isolated():
    def bad():
        raise OSError("no network")

    got = files.run_phases({"a": lambda: 3, "b": bad, "c": lambda: None, "d": bad}, wanted=("a", "b", "c"))
    assert got == [("a", "done", "3"), ("b", "failed", "OSError: no network"), ("c", "done", ""), ("d", "left out", "")]


def test_windows_projection_and_scales(spark):
    one = spark.range(1)
    got = one.select(S.calendar_windows(F.lit("2001-05-06"), F.lit("2003-02-01")).alias("w")).first().w
    assert [(str(w.start), str(w.end)) for w in got] == [("2001-05-06", "2001-12-31"), ("2002-01-01", "2002-12-31"), ("2003-01-01", "2003-02-01")]
    assert one.select(S.calendar_windows(F.lit("2003-01-01"), F.lit("2001-01-01"))).first()[0] is None
    x, y = S.albers(F.lit(40.0), F.lit(-96.0))
    assert one.select(x, y).first() == pytest.approx((0.0, 0.0), abs=1e-6)
    # Areas are kept: a small cell has the area that it has on the ellipsoid.
    a = one.select(*[c for d in ((0, 0), (0, 0.0005), (0.0005, 0)) for c in S.albers(F.lit(35.0 + d[0]), F.lit(-75.0 + d[1]))]).first()
    area = abs((a[2] - a[0]) * (a[5] - a[1]) - (a[4] - a[0]) * (a[3] - a[1]))
    e2 = 0.00669438002290
    s = math.sin(math.radians(35.00025))
    true = math.radians(0.0005) ** 2 * 6378137.0**2 * (1 - e2) * math.cos(math.radians(35.00025)) / (1 - e2 * s * s) ** 2
    assert area == pytest.approx(true, rel=1e-5)
    assert one.select(S.yearly_precipitation(F.lit(1e-5))).first()[0] == pytest.approx(315.36)
    df = spark.createDataFrame([(100.0, 10.0, 0.5, 3.0)], "temp_c double, pet_mm double, lc_tree double, other double")
    assert tuple(df.select(*S.scaled_covariates(df.columns)).first()) == pytest.approx((10.0, 12.0, 50.0, 3.0))


def test_buffer_means_and_climate_deltas(spark):
    places = spark.createDataFrame([("p", 45.0, -75.0), ("q", 10.0, 10.0)], "id string, lat double, lon double")
    cells = spark.createDataFrame([("a", 45.001, -75.0, 1.0), ("b", 45.0, -75.002, 4.0), ("c", 45.5, -75.0, 100.0), ("d", 45.0, -75.0, None)], "cell_id string, lat double, lon double, v double")
    assert {tuple(r) for r in stations.values_within(places, cells, ["v"], 1.0).collect()} == {("p", 2.5, 3), ("q", None, 0)}
    rows = [(m, s, "c1", y, t + k, f) for k, m in enumerate(("m1", "m2")) for s, y, t, f in (("hist", 2000, 10.0, 1e-5), ("hist", 2001, 12.0, 3e-5), ("ssp245", 2041, 13.0, 4e-5), ("ssp585", 2041, 15.0 + k, 5e-5), ("hist", 1950, 99.0, 9.0))]
    rows += [("m3", "ssp245", "c1", 2041, 50.0, 1.0)]
    d = stations.climate_deltas(spark.createDataFrame(rows, "model string, scenario string, cell string, year int, temp double, precip_flux double"), "hist", {"ssp245": (2040, 2060), "ssp585": (2040, 2060)}, (1995, 2014))
    got = {(r.model, r.scenario): (r.dtemp, round(r.dprecip, 3)) for r in d.collect()}
    assert got == {("m1", "ssp245"): (2.0, 630.72), ("m1", "ssp585"): (4.0, 946.08), ("m2", "ssp245"): (2.0, 630.72), ("m2", "ssp585"): (5.0, 946.08)}
    assert {(r.scenario, r.dtemp, r.n_models) for r in stations.model_mean(d).collect()} == {("ssp245", 2.0, 2), ("ssp585", 4.5, 2)}


def test_nearest_grid_value_far_from_the_lattice(spark):
    grid = spark.createDataFrame([(24.0 + 3 * a, -141.0 + 3 * b, None if (a + b) % 3 else float(a * 10 + b)) for a in range(5) for b in range(5)], "latitude double, longitude double, v double")
    rng = np.random.default_rng(1)
    pts = [(str(i), float(rng.uniform(10, 50)), float(rng.uniform(-170, -110))) for i in range(40)] + [("null", None, 1.0)]
    got = {r.id: r.v for r in stations.grid_interpolate(spark.createDataFrame(pts, "id string, lat double, lon double"), grid, ["v"]).collect()}
    have = [(r.latitude, r.longitude, r.v) for r in grid.collect() if r.v is not None]
    from freshet.operators.proximity import _km

    for i, la, lo in pts[:-1]:
        km = [float(_km(np.array(lo), np.array(la), np.array(b), np.array(a))) for a, b, _ in have]
        assert got[i] == have[int(np.argmin(km))][2]
    assert got["null"] is None


def test_entry_is_complete():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and {"p1_found", "p3_found", "p5_found", "p6_found", "p7_found"} <= set(q)
