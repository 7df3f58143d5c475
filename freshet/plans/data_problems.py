"""Queries of the general data problems (timestamps, units, proximity, rejects, plausibility), each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.operators import frequencies, plausibility, proximity, timestamps, unit_aliases
from freshet.plans import base_sql
from freshet.sources import records
from freshet.session import reliable_checkpoint
from freshet.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.found(table(spark, d, "harmonize"), table(spark, d, "zone_ref"))


def p1_status_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Records by source and outcome, with the span of the instants."""
    rows = table(spark, d, "harmonize").select("datetime", "source", "state_prov")
    rows = rows.join(table(spark, d, "zone_ref").select("state_prov", F.col("zone").alias("home_zone")), "state_prov", "left")
    done = timestamps.normalize_timestamps(rows, "datetime", "home_zone", "source")
    return done.groupBy("source", F.col("utc_status").alias("status")).agg(F.count("*").alias("n"), F.min("utc_seconds").alias("a"), F.max("utc_seconds").alias("b")).select(
        "source", "status", "n", timestamps.instant_text("a").alias("first_utc"), timestamps.instant_text("b").alias("last_utc")
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return unit_aliases.found(table(spark, d, "harmonize"), table(spark, d, "ion_ref"))


def p3_unit_aliases(spark: SparkSession, d: str) -> DataFrame:
    """The alias dictionary of all distinct unit spellings: basis, and factor to ug/L, ueq/L or umol/L."""
    found = unit_aliases.alias_dictionary(table(spark, d, "harmonize"), "unit_source")
    return found.select("spelling", "basis", F.when(F.col("basis") != "none", F.col("factor")).alias("factor"))


def p3_units_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Records by source and the unit that they state."""
    h = table(spark, d, "harmonize")
    units = unit_aliases.stated_units(h, "rec_id", "unit_source", "characteristic_source", ("source",))
    return units.groupBy("source", "basis", F.when(F.col("basis") != "none", F.col("factor")).alias("factor")).agg(F.count("*").alias("n"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return proximity.found(table(spark, d, "harmonize"))


def p5_stations_in_bands(spark: SparkSession, d: str) -> DataFrame:
    """Stations by the climate-grid cell (3 degrees on a side) that holds them; cells are closed, so a border point has several."""
    h = F.lit(1.5)
    corner = lambda a, b: F.struct((F.col("longitude") + a * h).alias("x"), (F.col("latitude") + b * h).alias("y"))
    grid = table(spark, d, "cmip6_grid").select(F.col("grid_id").alias("region_id"), F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)).alias("ring"))
    places = proximity.usual_positions(table(spark, d, "harmonize"), "station_id").select(F.col("id").alias("point_id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    inside = proximity.locate(places, proximity.decompose(grid))
    return inside.groupBy(F.col("region_id").alias("grid_id")).agg(F.count("*").alias("n_stations"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return records.found(table(spark, d, "raw_lines"), table(spark, d, "raw_layouts"))


def p6_typed_rows(spark: SparkSession, d: str) -> DataFrame:
    return records.typed_rows(records.parse_records(table(spark, d, "raw_lines"), table(spark, d, "raw_layouts"), only="valid"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return plausibility.found(table(spark, d, "harmonize"))


def p7_medians(spark: SparkSession, d: str) -> DataFrame:
    """Exact median of every series that is judged, by cumulative frequencies."""
    state = frequencies.value_counts(plausibility.judged(table(spark, d, "harmonize")), ["station_id", "ion"], F.col("value"))
    return frequencies.medians(reliable_checkpoint(state), ["station_id", "ion"]).select("station_id", "ion", F.round("median", 6).alias("median"), "n")


def p7_flag_counts(spark: SparkSession, d: str) -> DataFrame:
    """Flagged visit values by ion and flag."""
    names = F.when(F.col("flag") == 1, "spike").when(F.col("flag") == 2, "stuck").otherwise("out_of_range")
    return plausibility.flag_visits(table(spark, d, "harmonize")).groupBy("ion", names.alias("flag")).agg(F.count("*").alias("n"))



_ISO = "[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z"


def _fields(delimiter: str) -> str:
    """Records with a delimiter cut by regular expressions: ``whole`` (well quoted), ``cells`` with quotes taken off."""
    d = "\\" + delimiter if delimiter == "|" else delimiter
    quoted, bare = '"(?:[^"]|"")*"', f'[^{d}"]*'
    cell = f"(?:{quoted}|{bare})"
    unquote = """CASE WHEN x[1] = '"' THEN replace(x[2:len(x) - 1], '""', '"') ELSE x END"""
    return f"""SELECT l.line_id, l.layout, string_split(y.header, y.delimiter) AS names, y.n_fields, regexp_full_match(l.raw, '{cell}(?:{d}{cell})*', 's') AS whole,
 list_transform(regexp_extract_all('{delimiter}' || l.raw, '{d}({quoted}|{bare})', 1, 's'), lambda x: {unquote}) AS cells FROM raw_lines l JOIN raw_layouts y ON l.layout = y.layout WHERE y.delimiter = '{delimiter}'"""


#: ``fields``: line_id, layout, names, cells, reason (null where the record loads).
FIELDS_SQL = f"""cut AS ({' UNION ALL '.join(map(_fields, ',;|'))}),
named AS (SELECT *, cells[list_position(names, 'characteristic_source')] AS name, cells[list_position(names, 'value_mg_L')] AS number FROM cut),
fields AS (SELECT line_id, layout, names, cells, CASE WHEN NOT whole THEN 'quoting' WHEN len(cells) <> n_fields THEN 'column_count'
  WHEN regexp_full_match(name, '[\\s\\p{{Z}}]*', 's') OR regexp_matches(name, '[\\x00-\\x1f\\x7f-\\x{{9f}}\\x{{fffd}}]') OR NOT regexp_full_match(number, '[ \\t]*(?:[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?[ \\t]*)?') THEN 'invalid_value' END AS reason FROM named)"""
_CELL = lambda c: f"cells[list_position(names, '{c}')]"
_TYPED = ", ".join(f"{f'try_cast(trim({_CELL(c)}) AS DOUBLE)' if c in records.TYPED else _CELL(c)} AS {c}" for c in records.COLUMNS)

QUERIES = {f.__name__: f for f in (p1_found, p1_status_by_source, p3_found, p3_unit_aliases, p3_units_by_source, p5_found, p5_stations_in_bands, p6_found, p6_typed_rows, p7_found, p7_medians, p7_flag_counts)}

SQL: dict[str, str] = {
    "p1_found": f"""WITH {base_sql.STAMPS} SELECT rec_id, CASE status WHEN 'ok' THEN strftime(utc, '%Y-%m-%dT%H:%M:%SZ') ELSE status END AS utc FROM stamp JOIN harmonize USING (rec_id)
WHERE NOT (regexp_full_match(datetime, '{_ISO}') AND try_strptime(datetime, '%Y-%m-%dT%H:%M:%SZ') IS NOT NULL)""",
    "p1_status_by_source": f"""WITH {base_sql.STAMPS} SELECT source, status, count(*) AS n, strftime(min(utc), '%Y-%m-%dT%H:%M:%SZ') AS first_utc, strftime(max(utc), '%Y-%m-%dT%H:%M:%SZ') AS last_utc FROM harmonize LEFT JOIN stamp USING (rec_id) GROUP BY source, status""",
    "p3_found": f"""WITH {base_sql.UNITS} SELECT rec_id, coalesce(round(value_source * factor * {base_sql.SCALE})::BIGINT, -1) AS value_ug FROM harmonize JOIN unit_of USING (rec_id) WHERE value_source IS NOT NULL AND NOT isnan(value_source) AND basis <> 'mg/L'""",
    "p3_unit_aliases": f"""WITH {base_sql.UNITS} SELECT u.unit_source AS spelling, coalesce(o.basis, 'none') AS basis, o.factor FROM (SELECT DISTINCT unit_source FROM harmonize WHERE unit_source IS NOT NULL) u LEFT JOIN own o USING (unit_source)""",
    "p3_units_by_source": f"""WITH {base_sql.UNITS} SELECT source, basis, factor, count(*) AS n FROM harmonize JOIN unit_of USING (rec_id) GROUP BY source, basis, factor""",
    "p6_found": f"WITH {FIELDS_SQL} SELECT line_id, reason FROM fields WHERE reason IS NOT NULL",
    "p6_typed_rows": f"WITH {FIELDS_SQL} SELECT line_id, layout, {_TYPED} FROM fields WHERE reason IS NULL",
    "p5_found": """
WITH n AS (SELECT station_id, latitude AS lat, longitude AS lon, count(*) AS n FROM harmonize
           WHERE station_id IS NOT NULL AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 GROUP BY ALL),
p AS (SELECT station_id, lat, lon FROM n QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY n DESC, lat, lon) = 1),
c AS (SELECT a.station_id AS station_id_a, b.station_id AS station_id_b,
             pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h
      FROM p a JOIN p b ON a.station_id < b.station_id AND b.lat BETWEEN a.lat - 0.01 AND a.lat + 0.01)
SELECT station_id_a, station_id_b FROM c WHERE 2 * 6371.0088 * asin(least(sqrt(h), 1.0)) <= 1.0""",
    "p5_stations_in_bands": """
WITH n AS (SELECT station_id, latitude AS lat, longitude AS lon, count(*) AS n FROM harmonize
           WHERE station_id IS NOT NULL AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 GROUP BY ALL),
p AS (SELECT station_id, lat, lon FROM n QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY n DESC, lat, lon) = 1)
SELECT g.grid_id, count(*) AS n_stations FROM cmip6_grid g JOIN p
  ON p.lat BETWEEN g.latitude - 1.5 AND g.latitude + 1.5 AND p.lon BETWEEN g.longitude - 1.5 AND g.longitude + 1.5 GROUP BY g.grid_id""",
    "p7_medians": """SELECT station_id, ion, round(median(value_mg_L), 6) AS median, count(*) AS n FROM harmonize
WHERE ion IS NOT NULL AND station_id IS NOT NULL AND visit_no IS NOT NULL AND value_mg_L IS NOT NULL AND NOT isnan(value_mg_L) AND below_detection = false GROUP BY station_id, ion""",
    "p7_found": """
WITH j AS (SELECT rec_id, station_id, ion, visit_no, value_mg_L + 0.0 AS v FROM harmonize
           WHERE ion IS NOT NULL AND station_id IS NOT NULL AND visit_no IS NOT NULL AND value_mg_L IS NOT NULL AND NOT isnan(value_mg_L) AND below_detection = false),
m AS (SELECT station_id, ion, median(v) AS m FROM j GROUP BY ALL),
u AS (SELECT DISTINCT station_id, ion, visit_no, v FROM j),
g AS (SELECT *, row_number() OVER (PARTITION BY station_id, ion ORDER BY visit_no, v) - row_number() OVER (PARTITION BY station_id, ion, v ORDER BY visit_no) AS k FROM u),
c AS (SELECT *, count(*) OVER (PARTITION BY station_id, ion, v, k) AS n FROM g)
SELECT j.rec_id FROM j JOIN m USING (station_id, ion) JOIN c USING (station_id, ion, visit_no, v)
WHERE j.v < 0 OR j.v > 8 * m.m OR j.v < m.m / 8 OR c.n >= 6""",
}
