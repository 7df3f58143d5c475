"""Queries that chain the stages end to end, and the data behind figures and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions import scalars as S
from freshet.operators import harmonize, stations
from freshet.plans.data_problems import FIELDS_SQL
from freshet.plans.measurement import _BELOW, _H, _HAV, _ION, _NN, _P, _PLACES, _PROJ, _RANK, _RATIOS, _TREND, RECURSIVE, WITH, R, base_sql, obs, places, record, registry, trends
from freshet.session import reliable_checkpoint
from freshet.sources import records, standardize
from freshet.sources.tables import nan_to_null, table

QUERIES, SQL, query = registry()

# ---- the pipeline --------------------------------------------------------------------------------------------------

_FILLED = f"""{base_sql.STAMPS}, {base_sql.UNITS}, {_H},
u AS (SELECT h.*, coalesce(value_mg_L, value_source * (factor / 1000 * {base_sql.SCALE})) AS v FROM h JOIN unit_of USING (rec_id)),
c AS (SELECT * REPLACE (CASE WHEN {_BELOW.replace("value_mg_L", "v")} THEN detection_limit / 2 ELSE v END AS v) FROM u),
f AS (SELECT * FROM c WHERE ion IS NOT NULL AND latitude BETWEEN 24 AND 60 AND ts >= TIMESTAMP '1990-01-01' AND v IS NOT NULL),
d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY station_id, ts, ion ORDER BY {_RANK}, v, rec_id) = 1),
y AS (SELECT station_id, ion, year(ts) AS year FROM d GROUP BY ALL HAVING count(*) >= 4), k AS (SELECT station_id, ion FROM y GROUP BY ALL HAVING count(*) >= 10),
q AS (SELECT d.* FROM d SEMI JOIN k USING (station_id, ion))"""


def master(spark, d) -> DataFrame:
    """The long record through all stages: units, censoring, domain, preferred source, quality (ten years of four readings)."""
    h = harmonize.handle_below_detection(record(spark, d), "half_dl")
    rows = harmonize.dedup_preference(harmonize.domain_filter(h, "ts"), ties=("value_mg_L", "rec_id"))
    return harmonize.quality_filter(rows.withColumn("year", F.year("ts")), 10, 4)


@query(f"WITH {_FILLED} SELECT rec_id, station_id, ion, round(v, 6) AS value_mg_L FROM q")
def master_record(spark, d):
    """The master record of the whole table."""
    return master(spark, d).select("rec_id", "station_id", "ion", R("value_mg_L").alias("value_mg_L"))


@query(f"WITH {_FILLED} SELECT source, ion, count(*) AS n, count(DISTINCT station_id) AS n_stations, min(ts) AS first_ts, max(ts) AS last_ts FROM q GROUP BY GROUPING SETS ((source), (ion), ())")
def pipeline_report(spark, d):
    """Records, stations and span of the master record by source, by ion and overall."""
    m = reliable_checkpoint(master(spark, d).select("source", "ion", "station_id", "ts"))
    parts = []
    for by in (["source"], ["ion"], []):
        a = m.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct("station_id").alias("n_stations"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        parts.append(a.select(*[(F.col(c) if c in by else F.lit(None).cast("string")).alias(c) for c in ("source", "ion")], "n", "n_stations", "first_ts", "last_ts"))
    return harmonize.union_sources(*parts)


@query(f"""{WITH}, why AS (SELECT f.rec_id, CASE WHEN ion IS NULL THEN 'no ion' WHEN station_id IS NULL THEN 'no station' WHEN datetime IS NULL THEN 'no stamp' WHEN ts IS NULL THEN 'stamp ' || ts_status WHEN value IS NULL THEN 'no value' WHEN NOT value > 0 THEN 'value not positive'
  WHEN o.rec_id IS NULL THEN 'copy' ELSE 'kept' END AS outcome FROM filled f LEFT JOIN (SELECT rec_id FROM obs) o ON f.rec_id = o.rec_id) SELECT outcome, count(*) AS n FROM why GROUP BY outcome""")
def base_outcomes(spark, d):
    """What becomes of every record on its way into the common base: kept, or the first reason why not."""
    h = record(spark, d)
    kept = obs(spark, d).select(F.col("rec_id").alias("kept_id"))
    why = F.when(F.col("ion").isNull(), "no ion").when(F.col("station_id").isNull(), "no station").when(F.col("datetime").isNull(), "no stamp").when(F.col("ts").isNull(), F.concat(F.lit("stamp "), "ts_status"))
    why = why.when(F.col("value_mg_L").isNull(), "no value").when(~(F.col("value_mg_L") > 0), "value not positive").when(F.col("kept_id").isNull(), "copy").otherwise("kept")
    return h.join(kept, F.col("rec_id") == F.col("kept_id"), "left").groupBy(why.alias("outcome")).agg(F.count("*").alias("n"))


# ---- source layouts ------------------------------------------------------------------------------------------------

_FRACTION = "CASE WHEN {c} IS NULL THEN 'unknown' WHEN contains(lower({c}), 'dissolved') OR contains(lower({c}), 'filtered') OR contains(lower({c}), 'filterable') THEN 'dissolved' WHEN contains(lower({c}), 'total') OR contains(lower({c}), 'unfiltered') OR contains(lower({c}), 'recoverable') THEN 'total' ELSE 'unknown' END"
_PLAIN = lambda c: f"CASE WHEN regexp_full_match(trim({c}), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN trim({c})::DOUBLE END"


def _by_layout(spark, d) -> dict[str, DataFrame]:
    """The loading records of each layout as the text table that its source delivers."""
    lines = reliable_checkpoint(records.parse_records(table(spark, d, "raw_lines"), table(spark, d, "raw_layouts"), only="valid").select("layout", "fields"))
    cell = lambda c: F.try_element_at("fields", F.lit(c))
    bare = lambda prefix: F.regexp_replace(cell("station_id"), f"^{prefix}", "")
    columns = {
        "wqx": {"Source": "source", "Location_Identifier": "station_id", "Result_Characteristic": "characteristic_source", "Activity_StartDateTime": "datetime", "Result_Measure": "value_source", "Result_MeasureUnit": "unit_source", "Result_SampleFraction": "fraction"},
        "eccc": {"SITE_NO": bare("ECCC-"), "VARIABLE": "characteristic_source", "DATE_TIME_HEURE": "datetime", "VALUE_VALEUR": "value_source", "UNIT_UNITÉ": "unit_source", "FLAG_MARQUEUR": "below_flag"},
        "ontario": {"Collection Site": F.concat(F.lit("'"), bare("ONPWQMN-")), "Analyte": "characteristic_source", "Collection Date": F.substring_index(cell("datetime"), " ", 1), "Collection Time": F.substring_index(cell("datetime"), " ", -1), "Result": "value_mg_L", "Units": "unit_source", "Value Qualifier": "below_flag", "Detection Limit": "detection_limit"},
        "bcems": {"EMS_ID": bare("BCEMS-"), "PARAMETER": "characteristic_source", "COLLECTION_START": F.rpad(F.regexp_replace(cell("datetime"), "[^0-9]", ""), 14, "0"), "RESULT": "value_mg_L", "UNIT": "unit_source", "LATITUDE": "latitude", "LONGITUDE": "longitude"},
    }
    return {k: lines.filter(F.col("layout") == k).select(*[(cell(v) if isinstance(v, str) else v).alias(c) for c, v in cols.items()]) for k, cols in columns.items()}


_ONE = """SELECT {source} AS source, {station} AS station_id, {lat} AS latitude, CASE WHEN contains(f['datetime'], ':') THEN {ts} END AS ts, f['characteristic_source'] AS name, {value} AS value_source, {below} AS below, {fraction} AS fraction FROM good {join} WHERE layout = '{layout}'"""
_TS = "coalesce(try_strptime(f['datetime'], '%Y-%m-%d %H:%M'), try_strptime(f['datetime'], '%Y-%m-%d %H:%M:%S'))"
_MARK = "coalesce(contains(f['below_flag'], '<'), false)"
_SQL_LONG = " UNION ALL ".join(
    _ONE.format(**x)
    for x in (
        {"layout": "wqx", "source": "f['source']", "station": "f['station_id']", "lat": "NULL::DOUBLE", "ts": _TS, "value": _PLAIN("f['value_source']"), "below": "false", "fraction": _FRACTION.format(c="f['fraction']"), "join": ""},
        {"layout": "eccc", "source": "'ECCC'", "station": "'ECCC-' || replace(f['station_id'], 'ECCC-', '')", "lat": "lat", "ts": _TS, "value": _PLAIN("f['value_source']"), "below": "coalesce(f['below_flag'], '') = '<'", "fraction": _FRACTION.format(c="f['characteristic_source']"), "join": "LEFT JOIN places ON id = f['station_id']"},
        {"layout": "ontario", "source": "'ON_PWQMN'", "station": "'ONPWQMN-' || trim(replace(f['station_id'], 'ONPWQMN-', ''))", "lat": "lat", "ts": _TS, "value": _PLAIN("f['value_mg_L']"), "below": _MARK, "fraction": _FRACTION.format(c="f['characteristic_source']"), "join": "LEFT JOIN places ON id = f['station_id']"},
        {"layout": "bcems", "source": "'BC_EMS'", "station": "'BCEMS-' || replace(f['station_id'], 'BCEMS-', '')", "lat": _PLAIN("f['latitude']"), "ts": _TS, "value": _PLAIN("f['value_mg_L']"), "below": "false", "fraction": _FRACTION.format(c="f['characteristic_source']"), "join": ""},
    )
)


@query(f"""WITH {FIELDS_SQL}, {_PLACES}, good AS (SELECT layout, map_from_entries(list_transform(names, lambda x, i: ROW(x, cells[i]))) AS f FROM fields WHERE reason IS NULL), long AS ({_SQL_LONG}),
called AS (SELECT long.*, {_ION.replace('(c, ', '(cc, ').replace('c LIKE', 'cc LIKE').replace('c = ', 'cc = ')} AS ion FROM (SELECT *, lower(trim(name)) AS cc FROM long) long)
SELECT source, ion, fraction, count(*) AS n, count(DISTINCT station_id) AS n_stations, count(latitude) AS n_located, count(ts) AS n_stamped, count(value_source) AS n_values, sum(below::INT)::BIGINT AS n_below, round(sum(value_source), 3) AS total, max(ts) AS last_ts
FROM called WHERE ion IS NOT NULL GROUP BY source, ion, fraction""")
def standardized_sources(spark, d):
    """The raw records of all four layouts, parsed, brought into the long record by their standardisers and put together."""
    raw = _by_layout(spark, d)
    sites = reliable_checkpoint(places(spark, d))
    at = lambda prefix, key: sites.filter(F.col("id").startswith(prefix)).select(F.regexp_replace("id", f"^{prefix}", "").alias(key), F.col("lat").cast("string").alias("LATITUDE"), F.col("lon").cast("string").alias("LONGITUDE"))
    parts = [standardize.wqx(raw["wqx"].filter(F.col("Source") == s), s) for s in ("USGS_SAMPLES", "EPA_WQP")]
    parts += [standardize.eccc(raw["eccc"], at("ECCC-", "SITE_NO")), standardize.ontario(raw["ontario"], at("ONPWQMN-", "STATION")), standardize.bc_ems(raw["bcems"])]
    long = harmonize.union_sources(*parts)
    return long.groupBy("source", "ion", "fraction").agg(
        F.count("*").alias("n"), F.countDistinct("station_id").alias("n_stations"), F.count("latitude").alias("n_located"), F.count("datetime").alias("n_stamped"), F.count("value_source").alias("n_values"),
        F.sum((F.col("below_flag") == "<").cast("int")).alias("n_below"), R(F.sum("value_source"), 3).alias("total"), F.max("datetime").alias("last_ts"),
    )


# ---- figures and tables --------------------------------------------------------------------------------------------

_BOX = "lon BETWEEN -141 AND -52 AND lat BETWEEN 24 AND 62"
_VAL = "(exp(slope_log_yr) - 1) * 100"


def _in_box(df: DataFrame) -> DataFrame:
    return df.filter(F.col("lon").between(-141, -52) & F.col("lat").between(24, 62))


@query(f"""{WITH}, {_PROJ}, {_PLACES}, v AS (SELECT pj.*, {_VAL} AS pct_yr, (value_2050 / nullif(base_level, 0) - 1) * 100 AS pct_2050, lat, lon FROM pj JOIN places ON station_id = id WHERE {_BOX})
SELECT ion, count(*) AS n, greatest(1.0, round(quantile_cont(abs(pct_yr), 0.95), 1)) AS trend_limit, greatest(1.0, round(quantile_cont(abs(pct_2050), 0.95), 1)) AS change_limit FROM v GROUP BY ion""")
def ion_panels(spark, d):
    """Map data: per ion the points in the frame and the colour limits of the trend and of the change to 2050."""
    p = _points(spark, d)
    limit = lambda c: F.greatest(F.lit(1.0), R(F.percentile(F.abs(F.col(c)), 0.95), 1))
    return p.groupBy("ion").agg(F.count("*").alias("n"), limit("pct_yr").alias("trend_limit"), limit("pct_2050").alias("change_limit"))


def _points(spark, d) -> DataFrame:
    p = stations.trend_projection(trends(spark, d)).join(places(spark, d), F.col("station_id") == F.col("id"))
    return _in_box(p).withColumns({"pct_yr": S.percent_per_year("slope_log_yr"), "pct_2050": F.col("pct_change_2050")})


# The map projection in the database's own arithmetic (GRS 80, parallels 20 and 60, origin 40 N 96 W).
_E = "0.0818191910428158"
_Q = lambda s: f"(1 - {_E} * {_E}) * ({s} / (1 - {_E} * {_E} * {s} * {s}) - ln((1 - {_E} * {s}) / (1 + {_E} * {s})) / (2 * {_E}))"
_M2 = lambda deg: f"pow(cos(radians({deg})), 2) / (1 - {_E} * {_E} * pow(sin(radians({deg})), 2))"
_CONE = f"""cone AS (SELECT *, {_M2(20)} + nn * q1 AS cc FROM (SELECT *, ({_M2(20)} - {_M2(60)}) / (q2 - q1) AS nn FROM (SELECT {_Q('sin(radians(20))')} AS q1, {_Q('sin(radians(60))')} AS q2, {_Q('sin(radians(40))')} AS q0)))"""


@query(f"""{WITH}, {_PROJ}, {_PLACES}, {_CONE}, v AS (SELECT station_id, ion, {_VAL} AS pct_yr, (value_2050 / nullif(base_level, 0) - 1) * 100 AS pct_2050, 6378137.0 * sqrt(cc - nn * ({_Q('sin(radians(lat))')})) / nn AS rho, nn * radians(lon + 96) AS theta, 6378137.0 * sqrt(cc - nn * q0) / nn AS rho0 FROM pj JOIN places ON station_id = id, cone WHERE {_BOX})
SELECT station_id, ion, round(pct_yr, 4) AS pct_yr, round(pct_2050, 4) AS pct_2050, round(rho * sin(theta), 1) AS x, round(rho0 - rho * cos(theta), 1) AS y FROM v""")
def ion_panel_points(spark, d):
    """Map data of all six ions: trend and change of every series in the frame, at its place on the equal-area map."""
    x, y = S.albers("lat", "lon")
    return _points(spark, d).select("station_id", "ion", R("pct_yr", 4).alias("pct_yr"), R("pct_2050", 4).alias("pct_2050"), R(x, 1).alias("x"), R(y, 1).alias("y"))


@query(f"{WITH}, {_RATIOS}, {_PLACES} SELECT station_id, lat, lon, round(least(greatest(na_cl, 0.1), 2.0), 6) AS na_cl FROM ra JOIN places ON station_id = id WHERE {_BOX} AND na_cl IS NOT NULL")
def ratio_points(spark, d):
    """Map data: the Na:Cl ratio, clipped, of every station in the frame."""
    r = stations.ion_ratios(stations.ion_wide(trends(spark, d), "base_level")).join(places(spark, d), F.col("station_id") == F.col("id"))
    return _in_box(r).filter(F.col("na_cl").isNotNull()).select("station_id", "lat", "lon", R(S.clip("na_cl", 0.1, 2.0)).alias("na_cl"))


@query(f"""{RECURSIVE}, {_PROJ}, {_P} SELECT p.station_id, round(p.base_level, 6) AS base_level, round(ln(p.value_2050), 5) AS log_value_2050, round(v.mk_p, 6) AS mk_p, coalesce(p.slope_log_yr > 0 AND v.mk_p < 0.05, false) AS rising
FROM (SELECT * FROM pj WHERE ion = 'cl') p LEFT JOIN (SELECT station_id, mk_p FROM pv WHERE ion = 'cl') v ON p.station_id = v.station_id""")
def chloride_with_p(spark, d):
    """Projected chloride of every station beside the significance of its trend."""
    t = reliable_checkpoint(trends(spark, d, True).filter("ion = 'cl'"))
    p = stations.trend_projection(t.drop("mk_p"))
    j = p.join(t.select(F.col("station_id").alias("sid"), "mk_p"), F.col("station_id") == F.col("sid"), "left")
    rising = F.coalesce((F.col("slope_log_yr") > 0) & (F.col("mk_p") < 0.05), F.lit(False))
    return j.select("station_id", R("base_level").alias("base_level"), R(F.log("value_2050"), 5).alias("log_value_2050"), R("mk_p").alias("mk_p"), rising.alias("rising"))


# Guideline of each ion in mg/L.
GUIDELINES = {"cl": 230.0, "na": 200.0, "so4": 250.0}


@query(f"""{WITH}, {_PROJ}, g AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v})" for k, v in GUIDELINES.items())}) AS t(gi, guideline))
SELECT ion, guideline::DOUBLE AS guideline, count(*) AS n, round(100 * avg((base_level > guideline)::INT), 6) AS now_pct, round(100 * avg((value_2050 > guideline)::INT), 6) AS pct_2050 FROM pj JOIN g ON ion = gi GROUP BY ion, guideline""")
def guideline_table(spark, d):
    """Table data: share of stations over the guideline of their ion, now and in 2050."""
    p = stations.trend_projection(trends(spark, d))
    limit = F.coalesce(*[F.when(F.col("ion") == k, F.lit(v)) for k, v in GUIDELINES.items()])
    share = lambda c: R(100 * F.avg((F.col(c) > F.col("guideline")).cast("int")))
    return p.withColumn("guideline", limit).filter("guideline is not null").groupBy("ion", "guideline").agg(F.count("*").alias("n"), share("base_level").alias("now_pct"), share("value_2050").alias("pct_2050"))


@query(f"""{RECURSIVE}, {_TREND}, {_P} SELECT ion, count(*) AS n, round(median(median_mgL), 6) AS median_mgL, round(median({_VAL}), 6) AS median_pct_yr, round(quantile_cont({_VAL}, 0.25), 6) AS p25_pct_yr, round(quantile_cont({_VAL}, 0.75), 6) AS p75_pct_yr,
 round(median(n_year_obs), 6) AS median_years, round(100 * avg(coalesce(mk_p < 0.05, false)::INT), 6) AS significant_pct FROM pv GROUP BY ion""")
def trend_table(spark, d):
    """Table data: level, trend and length of the series by ion."""
    t = trends(spark, d, True).withColumn("pct", S.percent_per_year("slope_log_yr"))
    q = lambda p: R(F.percentile("pct", p))
    return t.groupBy("ion").agg(
        F.count("*").alias("n"), R(F.median("median_mgL")).alias("median_mgL"), R(F.median("pct")).alias("median_pct_yr"), q(0.25).alias("p25_pct_yr"), q(0.75).alias("p75_pct_yr"),
        R(F.median("n_year_obs")).alias("median_years"), R(100 * F.avg(F.coalesce(F.col("mk_p") < 0.05, F.lit(False)).cast("int"))).alias("significant_pct"),
    )


_DELTAS = ("dtemp_ssp245", "dprecip_ssp245")


@query(f"""WITH {_PLACES}, g AS (SELECT grid_id, latitude AS lat, longitude AS lon, {_NN(_DELTAS)} FROM cmip6_grid), m AS (SELECT p.id, g.* EXCLUDE (lat, lon) FROM places p JOIN g ON {_HAV.format(a='p', b='g')} <= 250.0)
SELECT p.id, {', '.join(f'round(avg(m.{c}), 6) AS {c}' for c in _DELTAS)}, count(m.grid_id) AS n_cells FROM places p LEFT JOIN m ON p.id = m.id GROUP BY p.id""")
def buffer_means(spark, d):
    """Mean of the grid values within 250 km of each station."""
    g = nan_to_null(table(spark, d, "cmip6_grid")).select(F.col("grid_id").alias("cell_id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), *_DELTAS)
    return stations.values_within(places(spark, d), g, list(_DELTAS), 250.0).select("id", *[R(c).alias(c) for c in _DELTAS], "n_cells")


@query("""WITH s AS (SELECT station_id, min(ingested_at)::DATE AS a, max(ingested_at)::DATE AS b FROM harmonize WHERE station_id IS NOT NULL AND ingested_at IS NOT NULL GROUP BY station_id),
w AS (SELECT station_id, a, b, unnest(range(year(a), year(b) + 1)) AS y FROM s)
SELECT station_id, strftime(greatest(a, make_date(y::INT, 1, 1)), '%m-%d-%Y') AS first_day, strftime(least(b, make_date(y::INT, 12, 31)), '%m-%d-%Y') AS last_day FROM w""")
def request_windows(spark, d):
    """The calendar-year windows that a new pull of each station's records would ask for."""
    h = table(spark, d, "harmonize").filter(F.col("station_id").isNotNull() & F.col("ingested_at").isNotNull())
    s = h.groupBy("station_id").agg(F.min("ingested_at").cast("date").alias("a"), F.max("ingested_at").cast("date").alias("b"))
    w = s.select("station_id", F.explode(S.calendar_windows("a", "b")).alias("w"))
    return w.select("station_id", S.iso_to_month_first(F.col("w.start")).alias("first_day"), S.iso_to_month_first(F.col("w.end")).alias("last_day"))
