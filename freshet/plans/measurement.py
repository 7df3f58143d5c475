"""Queries of the measurement pipeline over whole tables, each with its SQL counterpart where SQL can say it.

``obs`` is the common base: readings of a target ion with a positive number, reported in mg/L or converted, a station, and a
stamp in any written form that fits one instant, each reading once. The SQL says the same of the same whole tables, from
``base_sql``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.functions import scalars as S
from freshet.operators import frequencies, harmonize, proximity, series, stations, timestamps, unit_aliases
from freshet.plans import base_sql
from freshet.session import reliable_checkpoint
from freshet.sources.tables import file_state, nan_to_null, table


# Means and medians of readings often lie on a rounding tie; a common factor moves them off it alike in both engines.
NUDGE = 1.000000000001


def nudged(sql: str) -> str:
    """``sql`` with each ``round(x, digits)`` after the common base taken of ``x * NUDGE``."""
    at = sql.find(WITH[5:])
    head, body = (sql[: at + len(WITH) - 5], sql[at + len(WITH) - 5 :]) if at >= 0 else ("", sql)
    out, k = "", 0
    while (at := body.find("round(", k)) >= 0:
        depth, comma, end = 0, None, at + 5
        while True:
            depth += {"(": 1, ")": -1}.get(body[end], 0)
            if body[end] == "," and depth == 1:
                comma = end
            if depth == 0:
                break
            end += 1
        if comma is None or (at and (body[at - 1].isalnum() or body[at - 1] == "_")):
            out, k = out + body[k : at + 6], at + 6
        else:
            out, k = out + body[k:at] + f"round(({body[at + 6 : comma]}) * {NUDGE!r}{body[comma : end + 1]}", end + 1
    return head + out + body[k:]


def registry():
    """(queries, SQL, decorator that adds to them) of a module of plans."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    sqls: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = nudged(sql)
            return f

        return add

    return queries, sqls, query


QUERIES, SQL, query = registry()
ISO = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"
# Years of a series; readings in each of them; readings in each season, and years of a season's slope.
MIN_YEARS, MIN_READINGS, SEASON_READINGS, SEASON_YEARS = 10, 4, 8, 10

_NUM = lambda c: f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END"
_RANK = "CASE source WHEN 'USGS_SAMPLES' THEN 0 WHEN 'EPA_WQP' THEN 1 WHEN 'ECCC' THEN 2 WHEN 'ON_PWQMN' THEN 3 WHEN 'BC_EMS' THEN 4 ELSE 9 END"
_H = f"""h AS (SELECT h.* REPLACE ({', '.join(f'{_NUM("h." + c)} AS {c}' for c in ('value_mg_L', 'value_source', 'detection_limit', 'latitude', 'longitude'))}), s.utc AS ts, s.status AS ts_status
  FROM harmonize h LEFT JOIN stamp s ON h.rec_id = s.rec_id)"""
_OBS = f"""filled AS (SELECT h.*, coalesce(value_mg_L, value_source * (factor / 1000 * {base_sql.SCALE})) AS value, value_mg_L IS NULL AS was_null FROM h JOIN unit_of USING (rec_id)),
obs AS (SELECT rec_id, source, station_id, latitude, longitude, country, state_prov, site_type, ts, ion, value, year(ts)::INT AS year, month(ts)::INT AS month
        FROM filled WHERE ion IS NOT NULL AND value > 0 AND ts IS NOT NULL AND station_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY station_id, coalesce(visit_no::VARCHAR, ts::VARCHAR), ion, round(value, 6) ORDER BY {_RANK}, value, rec_id) = 1)"""
WITH = f"""WITH {base_sql.STAMPS}, {base_sql.UNITS}, {_H}, {_OBS},
ann AS (SELECT station_id, ion, year, round(avg(value), 9) AS value, count(*) AS n_obs_year FROM obs GROUP BY ALL)"""


def long_record(spark: SparkSession, d: str) -> DataFrame:
    return nan_to_null(table(spark, d, "harmonize"))


def stamped(spark: SparkSession, d: str, fill: bool = False, status: bool = False) -> DataFrame:
    """The long record, on request with values not converted yet filled by the unit stage, with ``ts``, the UTC instant of its stamp; null where the text fits no instant or two.

    ``status`` adds ``ts_status`` (see ``timestamps.normalize_timestamps``).
    """
    h = long_record(spark, d)
    if fill:
        h = unit_aliases.fill_milligrams(h, table(spark, d, "ion_ref"))
    h = h.withColumn("ts", F.when(F.col("datetime").rlike(ISO), S.parse_datetime("datetime", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    # Plain stamps pass by; the order of day and month needs no other rows, since all-numeric dates are not plain.
    zones = table(spark, d, "zone_ref").select("state_prov", F.col("zone").alias("__home"))
    other = h.filter(F.col("ts").isNull()).drop("ts").join(zones, "state_prov", "left")
    other = timestamps.normalize_timestamps(other, "datetime", "__home", "source").withColumn("ts", timestamps.instant("utc_seconds"))
    also = [F.lit("ok").alias("ts_status")] if status else []
    more = [F.col("utc_status").alias("ts_status")] if status else []
    return h.filter(F.col("ts").isNotNull()).select(*h.columns, *also).unionByName(other.select(*h.columns, *more))


_WRITTEN: dict[tuple, DataFrame] = {}
#: Frames that are kept for later queries of a session.
MOST_WRITTEN = 8


def written(spark: SparkSession, d: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()``, written once per session and state of the files it comes from, as a master record is made once and read by every analysis."""
    key = (name, spark.sparkContext.applicationId, d, spark.conf.get("spark.sql.session.timeZone"), *[x for t in ("harmonize", "zone_ref", "ion_ref") for x in file_state(spark, f"{d}/{t}.parquet")])
    if key not in _WRITTEN:
        while len(_WRITTEN) >= MOST_WRITTEN:
            _WRITTEN.pop(next(iter(_WRITTEN)))
        _WRITTEN[key] = reliable_checkpoint(make())
    return _WRITTEN[key]


def record(spark: SparkSession, d: str) -> DataFrame:
    """The whole long record, converted and stamped, with ``ts_status``; written once (see ``written``)."""
    return written(spark, d, "record", lambda: stamped(spark, d, fill=True, status=True))


def obs(spark: SparkSession, d: str) -> DataFrame:
    """The common base; written once (see ``written``)."""
    return written(spark, d, "obs", lambda: make_obs(spark, d))


def make_obs(spark: SparkSession, d: str) -> DataFrame:
    h = record(spark, d).filter(F.col("ion").isNotNull() & (F.col("value_mg_L") > 0) & F.col("ts").isNotNull() & F.col("station_id").isNotNull())
    # Copies and redelivered readings share visit and value, though not always the instant, which some deliver by date alone; other readings of the visit stay.
    h = h.withColumn("__visit", F.coalesce(F.col("visit_no").cast("string"), F.col("ts").cast("string"))).withColumn("__same", F.round("value_mg_L", 6))
    h = harmonize.dedup_preference(h, ("station_id", "__visit", "ion", "__same"), ("value_mg_L", "rec_id"))
    return h.select(
        "rec_id", "source", "station_id", "latitude", "longitude", "country", "state_prov", "site_type", "ts", "ion",
        F.col("value_mg_L").alias("value"), F.year("ts").alias("year"), F.month("ts").alias("month"),
    )


def annual(spark: SparkSession, d: str) -> DataFrame:
    return series.annual_means(obs(spark, d))


def trends(spark: SparkSession, d: str, with_p: bool = False) -> DataFrame:
    return series.station_trends(annual(spark, d), min_years=MIN_YEARS, with_p=with_p)


def places(spark: SparkSession, d: str) -> DataFrame:
    return proximity.usual_positions(table(spark, d, "harmonize"), "station_id")


_PLACES = """n AS (SELECT station_id, latitude AS lat, longitude AS lon, count(*) AS n FROM harmonize
  WHERE station_id IS NOT NULL AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 GROUP BY ALL),
places AS (SELECT station_id AS id, lat, lon FROM n QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY n DESC, lat, lon) = 1)"""
_COV = "cov AS (SELECT * FROM station_covariates)"
_HAV = "2 * 6371.0088 * asin(least(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)), 1.0))"
R = lambda c, n=6: F.round((F.col(c) if isinstance(c, str) else c) * NUDGE, n)

# ---- scans, counts, scalars ----------------------------------------------------------------------------------------


@query("SELECT source, count(*) AS n, count(DISTINCT station_id) AS n_stations, min(rec_id) AS first_id, max(rec_id) AS last_id FROM harmonize GROUP BY source")
def source_summary(spark, d):
    h = table(spark, d, "harmonize")
    return h.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("station_id").alias("n_stations"), F.min("rec_id").alias("first_id"), F.max("rec_id").alias("last_id"))


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, coalesce(sum(CASE WHEN {c} IS NULL{f' OR isnan({c})' if n else ''} THEN 1 ELSE 0 END), 0)::BIGINT AS n_missing, '{'double' if n else 'string'}' AS kind FROM harmonize"
        for c, n in (("source", 0), ("station_id", 0), ("latitude", 1), ("longitude", 1), ("datetime", 0), ("ion", 0), ("value_source", 1), ("unit_source", 0), ("fraction", 0), ("value_mg_L", 1))
    )
)
def missing_profile(spark, d):
    return harmonize.profile(table(spark, d, "harmonize").select("source", "station_id", "latitude", "longitude", "datetime", "ion", "value_source", "unit_source", "fraction", "value_mg_L"))


@query("SELECT unit_source, count(*) AS n FROM harmonize GROUP BY unit_source ORDER BY n DESC, unit_source LIMIT 10")
def top_units(spark, d):
    return table(spark, d, "harmonize").groupBy("unit_source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("unit_source")).limit(10)


_ION = """CASE WHEN contains(c, 'alkalinity') THEN 'alk' WHEN c LIKE 'sulfate%' OR c LIKE 'sulphate%' OR c = 'so4' THEN 'so4' WHEN c LIKE 'chloride%' OR c = 'cl' THEN 'cl'
 WHEN regexp_matches(c, '^sodium\\b') AND NOT contains(c, 'adsorption') THEN 'na' WHEN regexp_matches(c, '^calcium\\b') AND NOT contains(c, 'carbonate') THEN 'ca' WHEN regexp_matches(c, '^magnesium\\b') THEN 'mg' END"""


@query(f"SELECT name_ion, count(*) AS n, count(ion) AS n_recorded FROM (SELECT {_ION} AS name_ion, ion FROM (SELECT lower(trim(characteristic_source)) AS c, ion FROM harmonize)) GROUP BY name_ion")
def ion_map(spark, d):
    return table(spark, d, "harmonize").groupBy(S.standard_ion("characteristic_source").alias("name_ion")).agg(F.count("*").alias("n"), F.count("ion").alias("n_recorded"))


@query("""SELECT fraction_class, count(*) AS n FROM (SELECT CASE WHEN contains(c, 'dissolved') OR contains(c, 'filtered') OR contains(c, 'filterable') THEN 'dissolved'
 WHEN contains(c, 'total') OR contains(c, 'unfiltered') OR contains(c, 'recoverable') THEN 'total' ELSE 'unknown' END AS fraction_class FROM (SELECT lower(fraction) AS c FROM harmonize)) GROUP BY ALL""")
def fraction_map(spark, d):
    return table(spark, d, "harmonize").groupBy(S.fraction_class("fraction").alias("fraction_class")).agg(F.count("*").alias("n"))


_UNIT = "CASE WHEN unit_source IS NULL THEN '' WHEN lower(trim(unit_source)) IN ('mg/l', 'milligram per liter', 'ppm') THEN 'mg/L' WHEN lower(trim(unit_source)) IN ('ug/l', 'µg/l', 'ppb') THEN 'ug/L' WHEN lower(trim(unit_source)) = 'meq/l' THEN 'meq/L' WHEN lower(trim(unit_source)) = 'mmol/l' THEN 'mmol/L' WHEN lower(trim(unit_source)) IN ('mol/m3', 'mol/m^3') THEN 'mol/m3' ELSE trim(unit_source) END"
_FACTOR = "CASE WHEN r.ion IS NULL THEN NULL WHEN u = 'mg/L' THEN 1.0 WHEN u = 'ug/L' THEN 0.001 WHEN u = 'meq/L' THEN r.equiv_weight WHEN u IN ('mmol/L', 'mol/m3') THEN r.molar_mass END"
_UNITS = f"x AS (SELECT h.*, {_UNIT} AS u FROM h), y AS (SELECT x.*, {_FACTOR} AS f FROM x LEFT JOIN ion_ref r ON x.ion = r.ion)"


@query(f"{WITH}, {_UNITS} SELECT ion, count(*) AS n, round(min(value_source * f), 6) AS least, round(max(value_source * f), 6) AS most FROM y WHERE f IS NOT NULL AND value_source IS NOT NULL GROUP BY ion")
def unit_harmonize(spark, d):
    return harmonize.harmonize_units(long_record(spark, d)).groupBy("ion").agg(F.count("*").alias("n"), R(F.min("value_mg_L")).alias("least"), R(F.max("value_mg_L")).alias("most"))


@query(f"{WITH}, {_UNITS} SELECT u AS unit, sum((f IS NULL)::INT)::BIGINT AS n_unsupported, sum((value_source IS NULL)::INT)::BIGINT AS n_no_number FROM y WHERE f IS NULL OR value_source IS NULL GROUP BY u")
def unit_audit(spark, d):
    return harmonize.unit_audit(long_record(spark, d))


_BELOW = "(coalesce(trim(below_flag), '') IN ('<', 'ND', 'BDL', 'U', '<=') OR (value_mg_L IS NULL AND detection_limit IS NOT NULL))"


def _censor(name: str, new: str):
    keep = f"WHERE NOT {_BELOW}" if name == "drop" else ""

    @query(f"""{WITH}, b AS (SELECT ion, {_BELOW} AS below, CASE WHEN {_BELOW} THEN {new} ELSE value_mg_L END AS v FROM h {keep})
SELECT ion, below, count(*) AS n, count(v) AS n_value, round(sum(v), 4) AS total FROM b GROUP BY ion, below""")
    def censor(spark, d):
        c = harmonize.handle_below_detection(long_record(spark, d), name)
        return c.groupBy("ion", F.col("below_detection").alias("below")).agg(F.count("*").alias("n"), F.count("value_mg_L").alias("n_value"), R(F.sum("value_mg_L"), 4).alias("total"))

    QUERIES[f"censor_{name}"], SQL[f"censor_{name}"] = QUERIES.pop("censor"), SQL.pop("censor")


for _name, _new in (("half_dl", "detection_limit / 2"), ("dl", "detection_limit"), ("zero", "0.0"), ("drop", "value_mg_L")):
    _censor(_name, _new)


@query(f"{WITH} SELECT ion, country, count(*) AS n FROM h WHERE ion IS NOT NULL AND latitude BETWEEN 24 AND 60 AND ts >= TIMESTAMP '1990-01-01' AND value_mg_L IS NOT NULL GROUP BY ALL")
def domain_filters(spark, d):
    return harmonize.domain_filter(stamped(spark, d), "ts").groupBy("ion", "country").agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT rec_id, source, station_id, ion FROM obs QUALIFY row_number() OVER (PARTITION BY station_id, ts, ion ORDER BY {_RANK}, value, rec_id) = 1")
def dedup_preference(spark, d):
    return harmonize.dedup_preference(obs(spark, d), ties=("value", "rec_id")).select("rec_id", "source", "station_id", "ion")


@query(f"{WITH} SELECT 'CA' AS part, source, count(*) AS n, count(state_prov) AS n_state FROM obs WHERE country = 'CA' GROUP BY source UNION ALL SELECT 'US', source, count(*), 0 FROM obs WHERE country = 'US' GROUP BY source")
def union_sources(spark, d):
    o = obs(spark, d)
    both = harmonize.union_sources(o.filter("country = 'CA'").withColumn("part", F.lit("CA")), o.filter("country = 'US'").drop("state_prov").withColumn("part", F.lit("US")))
    return both.groupBy("part", "source").agg(F.count("*").alias("n"), F.count("state_prov").alias("n_state"))


# ---- annual series -------------------------------------------------------------------------------------------------


@query(f"{WITH} SELECT station_id, ion, year, round(value, 6) AS value, n_obs_year FROM ann")
def annual_means(spark, d):
    return annual(spark, d).select("station_id", "ion", "year", R("value").alias("value"), "n_obs_year")


@query(f"""{WITH}, k AS (SELECT station_id, ion FROM (SELECT station_id, ion, year FROM obs GROUP BY ALL HAVING count(*) >= {MIN_READINGS}) GROUP BY ALL HAVING count(*) >= {MIN_YEARS})
SELECT rec_id FROM obs SEMI JOIN k USING (station_id, ion)""")
def quality_filter(spark, d):
    return harmonize.quality_filter(obs(spark, d), MIN_YEARS, MIN_READINGS).select("rec_id")


_FIRST = ", ".join(f"arg_min({c}, (ts, rec_id)) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("latitude", "longitude", "source", "country", "state_prov", "site_type"))


@query(f"{WITH} SELECT station_id, {_FIRST} FROM obs GROUP BY station_id")
def station_static_first(spark, d):
    return harmonize.first_non_null(obs(spark, d), "station_id", ["latitude", "longitude", "source", "country", "state_prov", "site_type"], ["ts", "rec_id"])


_W = "PARTITION BY station_id, ion ORDER BY year"
_FEATURES = f"""l AS (SELECT *, ln(1 + value) AS log_value FROM ann), feat AS (SELECT station_id, ion, year, log_value,
 lag(log_value, 1) OVER w AS lag1, lag(log_value, 2) OVER w AS lag2, lag(log_value, 3) OVER w AS lag3,
 avg(log_value) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS roll3, avg(log_value) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS roll5,
 (row_number() OVER w - 1)::INT AS years_seen,
 CASE WHEN count(*) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 3 THEN regr_slope(log_value, year) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS trail_slope
 FROM l WINDOW w AS ({_W}))"""
_FCOLS = ["log_value", "lag1", "lag2", "lag3", "roll3", "roll5", "trail_slope"]


@query(f"{WITH}, {_FEATURES} SELECT station_id, ion, year, years_seen, {', '.join(f'round({c}, 5) AS {c}' for c in _FCOLS)} FROM feat")
def feature_table(spark, d):
    return series.features(annual(spark, d)).select("station_id", "ion", "year", "years_seen", *[R(c, 5).alias(c) for c in _FCOLS])


@query(f"""{WITH}, {_FEATURES}, s AS (SELECT *, CASE WHEN year <= 2013 THEN 'train' WHEN year <= 2017 THEN 'valid' ELSE 'test' END AS split FROM feat WHERE lag1 IS NOT NULL)
SELECT split, ion, count(*) AS n, round(avg(abs(log_value - lag1)), 6) AS mae, round(sqrt(avg(pow(log_value - lag1, 2))), 6) AS rmse,
 round(1 - sum(pow(log_value - lag1, 2)) / (sum(log_value * log_value) - sum(log_value) * sum(log_value) / count(*)), 4) AS r2,
 round(median(abs(exp(log_value) - exp(lag1))), 6) AS median_abs_native FROM s GROUP BY split, ion""")
def persistence_measures(spark, d):
    s = series.temporal_split(series.features(annual(spark, d)))
    m = series.error_measures(s, "log_value", "lag1", ["split", "ion"])
    return m.select("split", "ion", "n", R("mae").alias("mae"), R("rmse").alias("rmse"), R("r2", 4).alias("r2"), R("median_abs_native").alias("median_abs_native"))


_TREND = f"""k AS (SELECT station_id, ion, count(*) AS n_year_obs, max(year) AS base_year, median(value) AS median_mgL FROM ann GROUP BY ALL HAVING count(*) >= {MIN_YEARS}),
p AS (SELECT a.station_id, a.ion, (b.value - a.value) / (b.year - a.year) AS s, (ln(1 + b.value) - ln(1 + a.value)) / (b.year - a.year) AS sl, sign(b.value - a.value)::INT AS g
      FROM ann a JOIN ann b ON a.station_id = b.station_id AND a.ion = b.ion AND a.year < b.year),
q AS (SELECT station_id, ion, median(s) AS slope_mgL_yr, median(sl) AS slope_log_yr, list_sort(list(sl)) AS sls, sum(g)::INT AS mk_s FROM p GROUP BY ALL),
tie AS (SELECT station_id, ion, sum(t * (t - 1) * (2 * t + 5))::DOUBLE AS y1 FROM (SELECT station_id, ion, value, count(*) AS t FROM ann GROUP BY ALL) GROUP BY ALL),
lev AS (SELECT a.station_id, a.ion, avg(a.value) AS base_level FROM ann a JOIN k USING (station_id, ion) WHERE a.year > k.base_year - 5 GROUP BY ALL),
tr AS (SELECT station_id, ion, n_year_obs::INT AS n_year_obs, base_year, median_mgL, slope_mgL_yr, slope_log_yr, mk_s, base_level, sls, n_year_obs * (n_year_obs - 1) / 2.0 AS nt,
       sqrt((n_year_obs * (n_year_obs - 1) * (2 * n_year_obs + 5) - y1) / 18.0) AS sigma FROM k JOIN q USING (station_id, ion) JOIN tie USING (station_id, ion) JOIN lev USING (station_id, ion))"""
_PROJ = f"{_TREND}, pj AS (SELECT *, base_level * exp(slope_log_yr * (2050 - base_year)) AS value_2050 FROM tr)"


@query(f"{WITH}, {_TREND} SELECT station_id, ion, n_year_obs, base_year, round(median_mgL, 6) AS median_mgL, round(slope_mgL_yr, 6) AS slope_mgL_yr, round(slope_log_yr, 6) AS slope_log_yr, mk_s, round(base_level, 6) AS base_level FROM tr")
def station_trends(spark, d):
    """Theil-Sen slopes, Kendall S, median and recent level of every series."""
    t = trends(spark, d)
    return t.select("station_id", "ion", "n_year_obs", "base_year", *[R(c).alias(c) for c in ("median_mgL", "slope_mgL_yr", "slope_log_yr")], "mk_s", R("base_level").alias("base_level"))


@query(f"""{WITH}, {_TREND} SELECT station_id, ion, round(sls[(greatest(round_even((nt - 1.959963984540054 * sigma) / 2, 0) - 1, 0) + 1)::INT], 6) AS slope_log_lo,
 round(sls[(least(round_even((nt + 1.959963984540054 * sigma) / 2, 0), nt - 1) + 1)::INT], 6) AS slope_log_hi FROM tr""")
def slope_bounds(spark, d):
    return trends(spark, d).select("station_id", "ion", R("slope_log_lo").alias("slope_log_lo"), R("slope_log_hi").alias("slope_log_hi"))


# Inversion counts of permutations by recursion, erfc by its series below 2 and by its continued fraction above.
_ERFC = "CASE WHEN z < 2 THEN 1 - 1.1283791670955126 * list_sum(list_transform(range(0, 60), lambda k: pow(-1, k) * pow(z, 2 * k + 1) / (gamma(k + 1) * (2 * k + 1)))) ELSE exp(-z * z) / 1.7724538509055159 / list_reduce(list_prepend(z, range(80, 0, -1)::DOUBLE[]), lambda acc, k: z + (k / 2.0) / acc) END"
_P = f"""per AS (SELECT 1::BIGINT AS n, [1.0::DOUBLE] AS c UNION ALL SELECT n + 1, list_transform(range(0, n * (n + 1) // 2 + 1), lambda k: list_sum(c[greatest(1, k - n + 1)::BIGINT:(k + 1)::BIGINT])) FROM per WHERE n < 33),
tied AS (SELECT station_id, ion, sum(t * (t - 1) // 2)::BIGINT AS ytie FROM (SELECT station_id, ion, value, count(*) AS t FROM ann GROUP BY ALL) GROUP BY ALL),
ks AS (SELECT tr.*, tr.n_year_obs::BIGINT AS m, ytie, tr.nt::BIGINT AS pairs, (tr.nt::BIGINT - ytie - mk_s) // 2 AS dis, CASE WHEN sigma > 0 THEN abs(mk_s) / sigma / sqrt(2.0) END AS z FROM tr JOIN tied USING (station_id, ion)),
pv AS (SELECT ks.*, CASE WHEN ytie = pairs THEN NULL WHEN ytie = 0 AND 4 * least(dis, pairs - dis) = m * (m - 1) THEN 1.0 WHEN ytie = 0 AND m <= 33 THEN least(1.0, 2 * list_sum(per.c[1:(least(dis, pairs - dis) + 1)::BIGINT]) / gamma(m + 1))
  WHEN ytie = 0 AND least(dis, pairs - dis) = 0 THEN 2.0 / gamma(m + 1) WHEN ytie = 0 AND least(dis, pairs - dis) = 1 THEN 2.0 * m / gamma(m + 1) ELSE {_ERFC} END AS mk_p FROM ks LEFT JOIN per ON per.n = ks.m)"""
RECURSIVE = f"WITH RECURSIVE {WITH[5:]}"


@query(f"{RECURSIVE}, {_TREND}, {_P} SELECT station_id, ion, mk_s, round(mk_p, 6) AS mk_p FROM pv")
def mann_kendall(spark, d):
    """Kendall's S and its two-sided p for each series."""
    return trends(spark, d, True).select("station_id", "ion", "mk_s", R("mk_p").alias("mk_p"))


_SURE = lambda sign: f"round(100 * avg((coalesce(mk_p < 0.05, false) AND slope_log_yr {sign} 0)::INT), 6)"


@query(f"{RECURSIVE}, {_TREND}, {_P} SELECT ion, count(*) AS n, {_SURE('>')} AS rising_pct, {_SURE('<')} AS falling_pct FROM pv GROUP BY ROLLUP (ion)")
def rising_share(spark, d):
    """Share of series that rise and that fall significantly, by ion and overall."""
    t = trends(spark, d, True)
    sure = F.coalesce(F.col("mk_p") < 0.05, F.lit(False))
    share = lambda c: R(100 * F.avg((sure & c).cast("int")))
    return t.rollup("ion").agg(F.count("*").alias("n"), share(F.col("slope_log_yr") > 0).alias("rising_pct"), share(F.col("slope_log_yr") < 0).alias("falling_pct"))


@query(f"{WITH}, {_PROJ} SELECT station_id, ion, base_year, round(base_level, 6) AS base_level, round(ln(value_2050), 5) AS log_value_2050, round((exp(slope_log_yr) - 1) * 100, 4) AS pct_yr FROM pj")
def trend_projection(spark, d):
    """Flagship: from raw readings to the projected level of every series in 2050 (on the log scale, where rounding is meaningful)."""
    p = stations.trend_projection(trends(spark, d))
    return p.select("station_id", "ion", "base_year", R("base_level").alias("base_level"), R(F.log("value_2050"), 5).alias("log_value_2050"), R(S.percent_per_year("slope_log_yr"), 4).alias("pct_yr"))


_LIMITS = "(VALUES (120.0), (230.0), (860.0)) AS t(threshold)"


@query(f"""{WITH}, {_PROJ}, c AS (SELECT * FROM pj WHERE ion = 'cl')
SELECT 'base_level' AS series, threshold::DOUBLE AS threshold, round(100 * avg((base_level > threshold)::INT), 6) AS share_pct FROM c, {_LIMITS} GROUP BY threshold
UNION ALL SELECT 'value_2050', threshold::DOUBLE, round(100 * avg((value_2050 > threshold)::INT), 6) FROM c, {_LIMITS} GROUP BY threshold""")
def exceedance(spark, d):
    p = stations.trend_projection(trends(spark, d)).filter("ion = 'cl'")
    return series.share_over(p, ["base_level", "value_2050"], stations.THRESHOLDS).select("series", "threshold", R("share_pct").alias("share_pct"))


_POLICY = ", ".join(f"base_level * exp(slope_log_yr * (2025 - least(base_year, 2025)) + slope_log_yr * {f} * 25) AS {n}" for n, f in (("v_2050_trend", 1.0), ("v_2050_halved", 0.5), ("v_2050_stabilized", 0.0)))


@query(f"""{WITH}, {_TREND}, c AS (SELECT {_POLICY} FROM tr WHERE ion = 'cl'), u AS (UNPIVOT c ON v_2050_trend, v_2050_halved, v_2050_stabilized INTO NAME series VALUE v)
SELECT series, threshold::DOUBLE AS threshold, round(100 * avg((v > threshold)::INT), 6) AS share_pct FROM u, {_LIMITS} GROUP BY series, threshold""")
def management_scenarios(spark, d):
    m = stations.management_scenarios(trends(spark, d).filter("ion = 'cl'"))
    return series.share_over(m, ["v_2050_trend", "v_2050_halved", "v_2050_stabilized"], stations.THRESHOLDS).select("series", "threshold", R("share_pct").alias("share_pct"))


# ---- stations ------------------------------------------------------------------------------------------------------

_SEASON = f"""sea AS (SELECT station_id, avg(value) FILTER (WHERE month IN (12, 1, 2)) AS winter_mean, count(*) FILTER (WHERE month IN (12, 1, 2)) AS winter_n,
 avg(value) FILTER (WHERE month IN (6, 7, 8)) AS summer_mean, count(*) FILTER (WHERE month IN (6, 7, 8)) AS summer_n FROM obs WHERE ion = 'cl' GROUP BY station_id
 HAVING winter_n >= {SEASON_READINGS} AND summer_n >= {SEASON_READINGS}), ws AS (SELECT *, winter_mean / greatest(summer_mean, 0.1) AS ws_ratio FROM sea)"""


def _ws(spark, d):
    return stations.seasonal_means(obs(spark, d).filter("ion = 'cl'"), SEASON_READINGS)


@query(f"{WITH}, {_SEASON} SELECT station_id, round(winter_mean, 6) AS winter_mean, winter_n, round(summer_mean, 6) AS summer_mean, summer_n, round(ws_ratio, 6) AS ws_ratio FROM ws")
def seasonal_ratio(spark, d):
    return _ws(spark, d).select("station_id", R("winter_mean").alias("winter_mean"), "winter_n", R("summer_mean").alias("summer_mean"), "summer_n", R("ws_ratio").alias("ws_ratio"))


@query(f"""{WITH}, m AS (SELECT station_id, CASE WHEN month IN (12, 1, 2) THEN 'winter' ELSE 'summer' END AS season, year, avg(value) AS v FROM obs WHERE ion = 'cl' AND month IN (12, 1, 2, 6, 7, 8) GROUP BY ALL),
k AS (SELECT station_id, season FROM m GROUP BY ALL HAVING count(*) >= {SEASON_YEARS}),
s AS (SELECT a.station_id, a.season, median((ln(1 + b.v) - ln(1 + a.v)) / (b.year - a.year)) AS slope FROM m a JOIN m b ON a.station_id = b.station_id AND a.season = b.season AND a.year < b.year
      SEMI JOIN k ON a.station_id = k.station_id AND a.season = k.season GROUP BY ALL)
SELECT station_id, round(max(slope) FILTER (WHERE season = 'winter'), 6) AS winter_slope, round(max(slope) FILTER (WHERE season = 'summer'), 6) AS summer_slope FROM s GROUP BY station_id""")
def seasonal_slopes(spark, d):
    return stations.seasonal_slopes(obs(spark, d).filter("ion = 'cl'"), SEASON_YEARS).select("station_id", R("winter_slope").alias("winter_slope"), R("summer_slope").alias("summer_slope"))


@query(f"""{WITH}, {_SEASON}, {_PLACES}, j AS (SELECT ceil((lat - 25) / 3)::INT AS band, ws_ratio FROM ws JOIN places ON station_id = id WHERE lat > 25 AND lat <= 61 AND ws_ratio > 0.2 AND ws_ratio < 6)
SELECT b.band::INT AS band, (25 + (b.band - 1) * 3)::DOUBLE AS lat_above, round(median(ws_ratio), 6) AS median_value, count(ws_ratio) AS n FROM range(1, 13) AS b(band) LEFT JOIN j ON j.band = b.band GROUP BY b.band""")
def latitude_band_median(spark, d):
    w = _ws(spark, d).filter("ws_ratio > 0.2 and ws_ratio < 6").join(places(spark, d), F.col("station_id") == F.col("id"))
    return stations.latitude_bands(w, "lat", "ws_ratio").select("band", F.col("lat_above").cast("double").alias("lat_above"), R("median_value").alias("median_value"), "n")


@query(f"""{WITH}, {_SEASON}, {_PLACES}, {_COV}, j AS (SELECT ws.*, lat, night_lights_5km FROM ws JOIN places ON station_id = id LEFT JOIN cov USING (station_id))
SELECT count(*) AS n, round(median(ws_ratio), 6) AS median_all, round(median(ws_ratio) FILTER (WHERE lat >= 40), 6) AS median_cold, round(median(ws_ratio) FILTER (WHERE lat < 40), 6) AS median_warm,
 round(median(ws_ratio) FILTER (WHERE night_lights_5km > (SELECT median(night_lights_5km) FROM j)), 6) AS median_urban, round(corr(ws_ratio, lat), 6) AS corr_latitude,
 round(corr(ws_ratio, night_lights_5km), 6) AS corr_lights, round(100 * avg((ws_ratio > 1)::INT), 6) AS winter_enriched_pct FROM j""")
def seasonality_summary(spark, d):
    cov = nan_to_null(table(spark, d, "station_covariates")).select(F.col("station_id").alias("cid"), "night_lights_5km")
    j = _ws(spark, d).join(places(spark, d), F.col("station_id") == F.col("id")).join(cov, F.col("station_id") == F.col("cid"), "left")
    mid = j.agg(F.median("night_lights_5km")).scalar()
    j = j.withColumn("mid", mid)
    med = lambda c: R(F.median(F.when(c, F.col("ws_ratio"))))
    return j.agg(
        F.count("*").alias("n"), R(F.median("ws_ratio")).alias("median_all"), med(F.col("lat") >= 40).alias("median_cold"), med(F.col("lat") < 40).alias("median_warm"),
        med(F.col("night_lights_5km") > F.col("mid")).alias("median_urban"), R(F.corr("ws_ratio", "lat")).alias("corr_latitude"), R(F.corr("ws_ratio", "night_lights_5km")).alias("corr_lights"),
        R(100 * F.avg((F.col("ws_ratio") > 1).cast("int"))).alias("winter_enriched_pct"),
    )


_IONS = ("cl", "na", "ca", "mg", "so4", "alk")
_WIDE = f"wide AS (SELECT station_id, {', '.join(f'max(base_level) FILTER (WHERE ion = {k!r}) AS {k}' for k in _IONS)} FROM tr GROUP BY station_id)"
_RATIOS = f"{_TREND}, {_WIDE}, ra AS (SELECT station_id, na / nullif(cl, 0) AS na_cl, ca / nullif(mg, 0) AS ca_mg, cl / nullif(so4, 0) AS cl_so4, cl / nullif(alk, 0) AS cl_alk, cl AS cl_level FROM wide)"


def _ratios(spark, d):
    return stations.ion_ratios(stations.ion_wide(trends(spark, d), "base_level"))


@query(f"{WITH}, {_TREND}, {_WIDE} SELECT station_id, {', '.join(f'round({k}, 6) AS {k}' for k in _IONS)} FROM wide")
def ion_wide(spark, d):
    return stations.ion_wide(trends(spark, d), "base_level").select("station_id", *[R(k).alias(k) for k in _IONS])


@query(f"{WITH}, {_RATIOS} SELECT station_id, round(na_cl, 6) AS na_cl, round(ca_mg, 6) AS ca_mg, round(cl_so4, 6) AS cl_so4, round(cl_alk, 6) AS cl_alk, round(cl_level, 6) AS cl_level FROM ra")
def ion_ratios(spark, d):
    return _ratios(spark, d).select("station_id", *[R(c).alias(c) for c in ("na_cl", "ca_mg", "cl_so4", "cl_alk", "cl_level")])


@query(
    f"{WITH}, {_RATIOS} "
    + " UNION ALL ".join(f"SELECT '{c}' AS ratio, round(quantile_cont({c}, 0.25), 6) AS p25, round(median({c}), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS p75, count({c}) AS n, round(quantile_cont(abs({c}), 0.97), 6) AS colour_limit FROM ra" for c in ("na_cl", "ca_mg", "cl_so4"))
)
def ratio_quantiles(spark, d):
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("ratio"), F.col(c).alias("v")) for c in ("na_cl", "ca_mg", "cl_so4")]))
    q = lambda p, c="v": R(F.percentile(c, p))
    return _ratios(spark, d).select(cells.alias("c")).select("c.*").groupBy("ratio").agg(q(0.25).alias("p25"), q(0.5).alias("median"), q(0.75).alias("p75"), F.count("v").alias("n"), q(0.97, F.abs("v")).alias("colour_limit"))


@query(f"{WITH}, {_RATIOS} SELECT count(*) AS n, round(100 * avg(coalesce(na_cl BETWEEN 0.4 AND 0.9, false)::INT), 6) AS halite_like_pct FROM ra")
def halite_share(spark, d):
    return _ratios(spark, d).agg(F.count("*").alias("n"), R(100 * F.avg(F.coalesce(F.col("na_cl").between(0.4, 0.9), F.lit(False)).cast("int"))).alias("halite_like_pct"))


# ---- climate and covariates ----------------------------------------------------------------------------------------

_NN = lambda cols: ", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}" for c in cols)


@query(f"""WITH c AS (SELECT station_id, {_NN(['temp_c', 'precip_mm', 'pr_tc_mm', 'pet_mm'])} FROM station_covariates), x AS (SELECT station_id, {_NN(['dtemp_ssp245', 'dprecip_ssp245'])} FROM cmip6_deltas),
s AS (SELECT station_id, temp_c + dtemp_ssp245 AS temp_c, precip_mm + dprecip_ssp245 AS precip_mm, pr_tc_mm + dprecip_ssp245 AS pr_tc_mm, pet_mm * (1 + 0.02 * dtemp_ssp245) AS pet_mm FROM c JOIN x USING (station_id))
SELECT station_id, round(temp_c, 6) AS temp_c, round(precip_mm, 6) AS precip_mm, round(pr_tc_mm, 6) AS pr_tc_mm, round(pet_mm, 6) AS pet_mm,
 round(pr_tc_mm / CASE WHEN pet_mm IS NULL THEN NULL ELSE greatest(pet_mm, 1) END, 6) AS aridity FROM s""")
def climate_shift(spark, d):
    s = stations.climate_shift(nan_to_null(table(spark, d, "station_covariates")), nan_to_null(table(spark, d, "cmip6_deltas")), "ssp245")
    return s.select("station_id", *[R(c).alias(c) for c in ("temp_c", "precip_mm", "pr_tc_mm", "pet_mm", "aridity")])


@query("SELECT station_id FROM station_covariates ANTI JOIN cmip6_deltas USING (station_id)")
def anti_join_resume(spark, d):
    return stations.resume_remaining(table(spark, d, "station_covariates").select("station_id"), table(spark, d, "cmip6_deltas"), "station_id")


@query("SELECT coalesce(c.station_id, x.station_id) AS station_id, c.station_id IS NOT NULL AS has_cov, x.station_id IS NOT NULL AS has_delta FROM station_covariates c FULL JOIN cmip6_deltas x ON c.station_id = x.station_id")
def outer_merge(spark, d):
    c = table(spark, d, "station_covariates").select(F.col("station_id").alias("a"))
    x = table(spark, d, "cmip6_deltas").select(F.col("station_id").alias("b"))
    j = c.join(x, F.col("a") == F.col("b"), "full_outer")
    return j.select(F.coalesce("a", "b").alias("station_id"), F.col("a").isNotNull().alias("has_cov"), F.col("b").isNotNull().alias("has_delta"))


_DELTAS = ("dtemp_ssp245", "dprecip_ssp245", "dtemp_ssp585", "dprecip_ssp585")


@query(" UNION ALL ".join(f"SELECT '{c}' AS band, round(avg(v), 6) AS mean, round(min(v), 6) AS least, round(max(v), 6) AS most, count(v) AS n FROM (SELECT CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS v FROM cmip6_grid)" for c in _DELTAS))
def delta_summary(spark, d):
    g = nan_to_null(table(spark, d, "cmip6_grid"))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("band"), F.col(c).alias("v")) for c in _DELTAS]))
    return g.select(cells.alias("c")).select("c.*").groupBy("band").agg(R(F.avg("v")).alias("mean"), R(F.min("v")).alias("least"), R(F.max("v")).alias("most"), F.count("v").alias("n"))


@query(f"""WITH m AS (SELECT station_id, {_NN(_DELTAS)} FROM cmip6_deltas), u AS (SELECT station_id, 'ssp245' AS scenario, dtemp_ssp245 AS v FROM m UNION ALL SELECT station_id, 'ssp585', dtemp_ssp585 FROM m)
SELECT station_id, round(avg(v), 6) AS mean_delta, count(v) AS n_scenarios FROM u GROUP BY station_id""")
def scenario_mean_delta(spark, d):
    """Mean warming over the scenarios of each station."""
    m = nan_to_null(table(spark, d, "cmip6_deltas"))
    u = harmonize.union_sources(*[m.select("station_id", F.col(f"dtemp_{s}").alias("v")) for s in ("ssp245", "ssp585")])
    return u.groupBy("station_id").agg(R(F.avg("v")).alias("mean_delta"), F.count("v").alias("n_scenarios"))


@query(f"{WITH} SELECT ion, round(regr_slope(value, year), 6) AS slope, round(corr(value, year), 6) AS r, count(*) AS n FROM ann GROUP BY ion")
def linear_trend(spark, d):
    return annual(spark, d).groupBy("ion").agg(R(F.regr_slope("value", "year")).alias("slope"), R(F.corr("value", "year")).alias("r"), F.count("*").alias("n"))


# ---- geography -----------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {_PLACES}, e AS (SELECT a.id AS a, b.id AS b FROM places a JOIN places b ON a.id <> b.id AND b.lat BETWEEN a.lat - 0.01 AND a.lat + 0.01 WHERE {_HAV.format(a='a', b='b')} <= 1.0),
r AS (SELECT id, id AS root FROM places UNION SELECT e.b, r.root FROM r JOIN e ON r.id = e.a) SELECT id, min(root) AS cluster_id FROM r GROUP BY id""")
def proximity_clusters(spark, d):
    return stations.proximity_clusters(places(spark, d))


@query(f"WITH {_PLACES} SELECT g.grid_id FROM cmip6_grid g WHERE EXISTS (SELECT 1 FROM places p WHERE abs(p.lat - g.latitude) + abs(p.lon - g.longitude) <= 5.0)")
def grid_near_station(spark, d):
    return stations.grid_near_stations(table(spark, d, "cmip6_grid").select("grid_id", "latitude", "longitude"), places(spark, d)).select("grid_id")


@query(f"""WITH {_PLACES}, l AS (SELECT printf('g%04d', row_number() OVER (ORDER BY la.x, lo.x) - 1) AS grid_id, la.x::DOUBLE AS latitude, lo.x::DOUBLE AS longitude FROM range(24, 61, 3) AS la(x), range(-141, -51, 3) AS lo(x))
SELECT * FROM l WHERE EXISTS (SELECT 1 FROM places p WHERE abs(p.lat - l.latitude) + abs(p.lon - l.longitude) <= 5.0)""")
def lattice(spark, d):
    """The climate lattice of the continent, as far as stations lie near."""
    sites = places(spark, d)
    return stations.grid_near_stations(stations.climate_lattice(sites, 3, (24, 60), (-141, -52)), sites).select("grid_id", "latitude", "longitude")


@query(f"""WITH {_PLACES}, g AS (SELECT latitude, longitude, {_NN(['dtemp_ssp245'])} FROM cmip6_grid), o AS (SELECT min(latitude) AS lat0, min(longitude) AS lon0 FROM g),
i AS (SELECT id, lat, lon, floor((lat - lat0) / 3) AS iy, floor((lon - lon0) / 3) AS ix, (lat - lat0) / 3 - floor((lat - lat0) / 3) AS fy, (lon - lon0) / 3 - floor((lon - lon0) / 3) AS fx, lat0, lon0 FROM places, o),
c AS (SELECT id, CASE WHEN count(dtemp_ssp245) = 4 THEN sum(dtemp_ssp245 * (CASE WHEN dy = 1 THEN fy ELSE 1 - fy END) * (CASE WHEN dx = 1 THEN fx ELSE 1 - fx END)) END AS v
      FROM i, range(0, 2) AS a(dy), range(0, 2) AS b(dx) LEFT JOIN g ON round((g.latitude - lat0) / 3) = iy + dy AND round((g.longitude - lon0) / 3) = ix + dx GROUP BY id),
n AS (SELECT p.id, arg_min(g.dtemp_ssp245, ({_HAV.format(a='p', b='q')}, g.latitude, g.longitude)) AS v FROM places p, (SELECT latitude AS lat, longitude AS lon, * FROM g) q JOIN g ON g.latitude = q.latitude AND g.longitude = q.longitude WHERE g.dtemp_ssp245 IS NOT NULL GROUP BY p.id)
SELECT id, round(coalesce(c.v, n.v), 6) AS dtemp_ssp245 FROM c JOIN n USING (id)""".replace("n AS (SELECT station_id, latitude", "cnt AS (SELECT station_id, latitude").replace("FROM n QUALIFY", "FROM cnt QUALIFY"))
def grid_interpolate(spark, d):
    g = nan_to_null(table(spark, d, "cmip6_grid"))
    out = stations.grid_interpolate(places(spark, d), g, ["dtemp_ssp245"])
    return out.select("id", R("dtemp_ssp245").alias("dtemp_ssp245"))


@query(f"WITH {_PLACES} SELECT concat_ws('_', floor(lat / 2)::BIGINT::VARCHAR, floor(lon / 2)::BIGINT::VARCHAR) AS block, count(*) AS n FROM places GROUP BY block")
def spatial_blocks(spark, d):
    return places(spark, d).groupBy(S.block_id("lat", "lon").alias("block")).agg(F.count("*").alias("n"))


_FOLDS = """sized AS (SELECT block, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, block) AS k FROM blocks GROUP BY block),
fill AS (SELECT 0::BIGINT AS k, NULL::VARCHAR AS block, 0::BIGINT AS n, NULL::INT AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS load
  UNION ALL SELECT s.k, s.block, s.n, list_position(f.load, list_min(f.load)) - 1,
    list_transform(f.load, lambda x, i: CASE WHEN i = list_position(f.load, list_min(f.load)) THEN x + s.n ELSE x END) FROM fill f JOIN sized s ON s.k = f.k + 1)"""


@query(f"""WITH RECURSIVE {_PLACES}, blocks AS (SELECT concat_ws('_', floor(lat / 2)::BIGINT::VARCHAR, floor(lon / 2)::BIGINT::VARCHAR) AS block FROM places), {_FOLDS}
SELECT block, n, fold FROM fill WHERE k > 0""")
def group_folds(spark, d):
    """Spatial blocks in five folds of about equal size."""
    return stations.group_folds(places(spark, d).withColumn("block", S.block_id("lat", "lon")), "block")


@query(f"{WITH}, {_TREND} SELECT station_id, ion, {', '.join(f'(ion = {k!r})::INT AS ion_{k}' for k in _IONS)}, round(base_level, 6) AS base_level FROM tr")
def ion_one_hot(spark, d):
    """Trend rows with the ion as 0/1 columns."""
    return trends(spark, d).select("station_id", "ion", *[(F.col("ion") == k).cast("int").alias(f"ion_{k}") for k in _IONS], R("base_level").alias("base_level"))


@query("SELECT station_id FROM (SELECT station_id, row_number() OVER (ORDER BY station_id) AS k FROM (SELECT DISTINCT station_id FROM cmip6_deltas)) WHERE (k - 1) % 7 = 0")
def stride_sample(spark, d):
    """Every seventh station in order of id (a sampling operator)."""
    return frequencies.numbered(table(spark, d, "cmip6_deltas").select("station_id").distinct(), ["station_id"]).filter("k % 7 = 0").select("station_id")


# ---- report data ---------------------------------------------------------------------------------------------------


@query(f"""{WITH}, {_TREND}, {_PLACES} SELECT station_id, lat, lon, round((exp(slope_log_yr) - 1) * 100, 4) AS pct_yr FROM tr JOIN places ON station_id = id WHERE ion = 'cl' AND lon BETWEEN -141 AND -52 AND lat BETWEEN 24 AND 62""")
def chloride_trend_points(spark, d):
    """Map data: trend of chloride in per cent a year, in drawing order by size."""
    t = trends(spark, d).filter("ion = 'cl'").join(places(spark, d), F.col("station_id") == F.col("id"))
    t = t.filter(F.col("lon").between(-141, -52) & F.col("lat").between(24, 62)).select("station_id", "lat", "lon", R(S.percent_per_year("slope_log_yr"), 4).alias("pct_yr"))
    return t.orderBy(F.abs("pct_yr"), "station_id")


@query(f"""{WITH}, {_PROJ} SELECT ion, count(*) AS n, round(median((value_2050 / nullif(base_level, 0) - 1) * 100), 4) AS median_pct_change, round(100 * avg((slope_log_yr > 0)::INT), 6) AS increasing_pct FROM pj GROUP BY ion""")
def change_by_ion(spark, d):
    """Table data: stations, median change to 2050 and share increasing, by ion."""
    p = stations.trend_projection(trends(spark, d))
    return p.groupBy("ion").agg(F.count("*").alias("n"), R(F.median("pct_change_2050"), 4).alias("median_pct_change"), R(100 * F.avg((F.col("slope_log_yr") > 0).cast("int"))).alias("increasing_pct"))


@query(f"{WITH} SELECT source, country, count(*) AS n, count(DISTINCT station_id) AS n_stations, min(ts) AS first_ts, max(ts) AS last_ts FROM obs GROUP BY source, country")
def record_table(spark, d):
    """Table data: records, stations and span by source."""
    return obs(spark, d).groupBy("source", "country").agg(F.count("*").alias("n"), F.countDistinct("station_id").alias("n_stations"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
