"""From source records to the harmonized long record: units, censoring, domain filters, union, de-duplication, quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.scalars import is_below, unit_factor, unit_name

# Rank of the sources when two deliver one reading; others come last.
PREFERENCE = {"USGS_SAMPLES": 0, "EPA_WQP": 1, "ECCC": 2, "ON_PWQMN": 3, "BC_EMS": 4}


def harmonize_units(df: DataFrame, value: str = "value_source", unit: str = "unit_source", ion: str = "ion", out: str = "value_mg_L") -> DataFrame:
    """Rows with a supported unit and a number, with the value in mg/L; the rest is dropped and counted by ``unit_audit``."""
    factor = unit_factor(unit, ion)
    rows = df.withColumn(out, F.col(value) * factor)
    return rows.filter(F.col(out).isNotNull() & ~F.isnan(out))


def unit_audit(df: DataFrame, value: str = "value_source", unit: str = "unit_source", ion: str = "ion") -> DataFrame:
    """``unit_source, n`` of the unsupported units and ``n_no_number`` of rows whose value is missing."""
    factor = unit_factor(unit, ion)
    missing = F.col(value).isNull() | F.isnan(value)
    return df.filter(factor.isNull() | missing).groupBy(unit_name(unit).alias("unit")).agg(
        F.sum(F.when(factor.isNull(), 1).otherwise(0)).alias("n_unsupported"), F.sum(F.when(missing, 1).otherwise(0)).alias("n_no_number")
    )


def handle_below_detection(df: DataFrame, strategy: str = "half_dl", value: str = "value_mg_L", limit: str = "detection_limit", flag: str = "below_flag", out_flag: str = "below_detection") -> DataFrame:
    """Censored readings: ``half_dl``, ``dl``, ``zero`` replace the value, ``drop`` removes the row; sets ``below_detection``."""
    rows = df.withColumn("__below", is_below(flag, value, limit))
    new = {"half_dl": F.col(limit) / 2, "dl": F.col(limit), "zero": F.lit(0.0), "drop": F.col(value)}[strategy]
    if strategy == "drop":
        rows = rows.filter(~F.col("__below"))
    return rows.withColumn(value, F.when(F.col("__below"), new).otherwise(F.col(value))).withColumn(out_flag, F.col("__below")).drop("__below")


def domain_filter(df: DataFrame, ts: str, value: str = "value_mg_L", lat: tuple[float, float] = (24.0, 60.0), since: str = "1990-01-01") -> DataFrame:
    """Target ion, latitude within bounds, not before a day, value present."""
    return df.filter(F.col("ion").isNotNull() & F.col("latitude").between(*lat) & (F.col(ts) >= F.lit(since).cast("timestamp_ntz")) & F.col(value).isNotNull() & ~F.isnan(value))


def union_sources(*parts: DataFrame) -> DataFrame:
    """UNION ALL by name; a column that a part lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def preference(source: Column) -> Column:
    """Rank of a source column."""
    out = None
    for name, k in PREFERENCE.items():
        out = F.when(source == name, k) if out is None else out.when(source == name, k)
    return out.otherwise(9)


def dedup_preference(df: DataFrame, keys: tuple[str, ...] = ("station_id", "ts", "ion"), ties: tuple[str, ...] = ("value_mg_L", "fraction", "characteristic_source", "unit_source", "rec_id")) -> DataFrame:
    """One row per key, from the preferred source; the ties give a total order, so row order never matters. Null keys form keys."""
    w = Window.partitionBy(*keys).orderBy(preference(F.col("source")), *ties)
    return df.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") == 1).drop("__k")


def quality_filter(df: DataFrame, min_years: int = 10, min_per_year: int = 4, station: str = "station_id", ion: str = "ion", year: str = "year") -> DataFrame:
    """All rows of the series that have ``min_years`` years with at least ``min_per_year`` rows each."""
    dense = df.groupBy(station, ion, year).count().filter(F.col("count") >= min_per_year)
    keep = dense.groupBy(station, ion).agg(F.count("*").alias("n")).filter(F.col("n") >= min_years).select(station, ion)
    return df.join(keep, [station, ion], "left_semi")


def first_non_null(df: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """Per key the first non-null value of each column in a total order."""
    o = F.struct(*order)
    return df.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), o)).alias(c) for c in columns])


def drop_duplicate_keys(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in a total order; null is a key of its own."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__k = 1").drop("__k")


def profile(df: DataFrame) -> DataFrame:
    """``column_name, n_rows, n_missing, kind`` of every column (missing: null, or NaN in numbers; kind: its type), in one pass."""
    missing = [F.sum(F.when(F.col(f.name).isNull() | (F.isnan(f.name) if f.dataType.typeName() in ("double", "float") else F.lit(False)), 1).otherwise(0)).alias(f.name) for f in df.schema]
    one = df.agg(F.count("*").alias("__n"), *missing)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("__n").alias("n_rows"), F.coalesce(F.col(c), F.lit(0)).alias("n_missing"), F.lit(t).alias("kind")) for c, t in df.dtypes])).alias("x")).select("x.*")
