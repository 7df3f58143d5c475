"""Source layouts mapped to the harmonized long record. All raw columns arrive as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions.scalars import fraction_class, parse_datetime, parse_number, standard_ion
from freshet.operators.harmonize import drop_duplicate_keys

LONG = {
    "source": "string", "station_id": "string", "station_id_source": "string", "latitude": "double", "longitude": "double", "datum": "string",
    "country": "string", "state_prov": "string", "site_type": "string", "datetime": "timestamp_ntz", "ion": "string", "value_source": "double",
    "unit_source": "string", "below_flag": "string", "detection_limit": "double", "fraction": "string", "characteristic_source": "string",
}


def clean_names(df: DataFrame) -> DataFrame:
    """Column names without byte-order marks, quotes and outer blanks."""
    return df.toDF(*[c.replace("﻿", "").replace("ï»¿", "").strip().strip('"').strip() for c in df.columns])


def pick(df: DataFrame, *aliases: str, required: bool = True) -> Column:
    """The first alias that is a column; a null column when none is and it is optional."""
    for a in aliases:
        if a in df.columns:
            return F.col(f"`{a}`")
    if required:
        raise ValueError(f"none of {aliases} is among {df.columns}")
    return F.lit(None).cast("string")


def core_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that are present, in the wanted order."""
    return df.select(*[f"`{c}`" for c in wanted if c in df.columns])


def _long(df: DataFrame, **cols: Column) -> DataFrame:
    out = df.select(*[cols.get(c, F.lit(None)).cast(t).alias(c) for c, t in LONG.items()])
    return out.filter(F.col("ion").isNotNull())


def _utc(text: Column) -> Column:
    """Stamps with Z or an offset as UTC wall clock, without one as they stand; a date alone at midnight."""
    offset = F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    return F.coalesce(F.to_utc_timestamp(F.convert_timezone(F.current_timezone(), F.lit("UTC"), offset.cast("timestamp_ntz")), "UTC").cast("timestamp_ntz"), parse_datetime(text, "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd"))


def wqx(df: DataFrame, source: str) -> DataFrame:
    """WQX 3.0 results. Any detection condition marks the value as below."""
    opt = lambda *a: pick(df, *a, required=False)
    sid = pick(df, "Location_Identifier")
    name = pick(df, "Result_Characteristic")
    return _long(
        df, source=F.lit(source), station_id=sid, station_id_source=sid, latitude=parse_number(opt("Location_Latitude")), longitude=parse_number(opt("Location_Longitude")),
        datum=opt("Location_HorzCoordReferenceSystemDatum"), country=F.lit("US"), state_prov=opt("Location_State"), site_type=opt("Location_Type"),
        datetime=_utc(pick(df, "Activity_StartDateTime", "Activity_StartDate")), ion=standard_ion(name), value_source=parse_number(opt("Result_Measure")),
        unit_source=opt("Result_MeasureUnit"), below_flag=F.when(opt("Result_ResultDetectionCondition").isNotNull(), "<").otherwise(""),
        detection_limit=parse_number(opt("DetectionLimit_MeasureA")), fraction=fraction_class(opt("Result_SampleFraction")), characteristic_source=name,
    )


def eccc(results: DataFrame, sites: DataFrame) -> DataFrame:
    """Federal results with their sites; a site listed twice counts once, by its least row."""
    cols = ["LATITUDE", "LONGITUDE", "DATUM", "PROV_TERR", "SITE_TYPE"]
    look = sites.select("SITE_NO", *[pick(sites, c, required=False).alias(f"s_{c}") for c in cols])
    look = drop_duplicate_keys(look, "SITE_NO", [f"s_{c}" for c in cols]).withColumnRenamed("SITE_NO", "s_SITE_NO")
    j = results.join(look, results["SITE_NO"] == look["s_SITE_NO"], "left")
    name = F.col("VARIABLE")
    return _long(
        j, source=F.lit("ECCC"), station_id=F.concat(F.lit("ECCC-"), F.col("SITE_NO")), station_id_source=F.col("SITE_NO"), latitude=parse_number("s_LATITUDE"), longitude=parse_number("s_LONGITUDE"),
        datum=F.col("s_DATUM"), country=F.lit("CA"), state_prov=F.col("s_PROV_TERR"), site_type=F.col("s_SITE_TYPE"), datetime=parse_datetime("DATE_TIME_HEURE", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd"),
        ion=standard_ion(name), value_source=parse_number("VALUE_VALEUR"), unit_source=pick(results, "UNIT_UNITÉ", "UNIT_UNIT", required=False), below_flag=F.coalesce(pick(results, "FLAG_MARQUEUR", required=False), F.lit("")),
        detection_limit=parse_number(pick(results, "MDL_LDM", required=False)), fraction=fraction_class(name), characteristic_source=name,
    )


def ontario(results: DataFrame, stations: DataFrame) -> DataFrame:
    """Provincial results of either layout; ids may start with an apostrophe; the first station row of an id counts."""
    bare = lambda c: F.trim(F.regexp_replace(c.cast("string"), "^'", ""))
    st = stations.select(bare(pick(stations, "STATION", "Station", "Collection Site")).alias("s_id"), *[pick(stations, c, c.title(), required=False).alias(f"s_{c}") for c in ("LATITUDE", "LONGITUDE", "NAME")])
    st = drop_duplicate_keys(st, "s_id", ["s_NAME", "s_LATITUDE", "s_LONGITUDE"])
    r = results
    day, time = pick(r, "Collection Date", "DATE_YYYYMMDD", "Date"), pick(r, "Collection Time", "TIME_HH:MM", "Time", required=False)
    both = F.trim(F.concat_ws(" ", F.trim(day), F.trim(time)))
    qualifier, call = pick(r, "Value Qualifier", "VALUQUALIFI", required=False), pick(r, "Result Call", "REMARK_CODE", "REMARK_CODE_1", required=False)
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    below = low(call).contains("not detect") | low(call).contains("<") | low(qualifier).contains("<")
    j = r.withColumns({"__id": bare(pick(r, "Collection Site", "STATION", "Station")), "__below": below, "__at": both, "__day": day})
    j = j.join(st, F.col("__id") == F.col("s_id"), "left")
    name = pick(r, "Analyte", "PARM_DESCRIPTION", "Parameter")
    return _long(
        j, source=F.lit("ON_PWQMN"), station_id=F.concat(F.lit("ONPWQMN-"), F.col("__id")), station_id_source=F.col("__id"), latitude=parse_number("s_LATITUDE"), longitude=parse_number("s_LONGITUDE"),
        datum=F.lit("NAD83"), country=F.lit("CA"), state_prov=F.lit("ON"), site_type=F.col("s_NAME"),
        datetime=F.coalesce(parse_datetime("__at", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyyMMdd HH:mm", "yyyy-MM-dd", "yyyyMMdd"), parse_datetime("__day", "yyyyMMdd", "yyyy-MM-dd")),
        ion=standard_ion(name), value_source=parse_number(pick(r, "Result", "RESULT", "Value")), unit_source=pick(r, "Units", "UNITS", required=False), below_flag=F.when(F.col("__below"), "<").otherwise(""),
        detection_limit=parse_number(pick(r, "Detection Limit", "MDL", required=False)), fraction=fraction_class(name), characteristic_source=name,
    )


def bc_ems(df: DataFrame) -> DataFrame:
    """Provincial monitoring results; only the letter < marks below detection."""
    opt = lambda c: pick(df, c, required=False)
    name, sid = pick(df, "PARAMETER"), F.trim(pick(df, "EMS_ID"))
    return _long(
        df, source=F.lit("BC_EMS"), station_id=F.concat(F.lit("BCEMS-"), sid), station_id_source=sid, latitude=parse_number(opt("LATITUDE")), longitude=parse_number(opt("LONGITUDE")),
        country=F.lit("CA"), state_prov=F.lit("BC"), site_type=opt("LOCATION_TYPE"), datetime=parse_datetime(F.trim(pick(df, "COLLECTION_START")), "yyyyMMddHHmmss"), ion=standard_ion(name),
        value_source=parse_number(opt("RESULT")), unit_source=opt("UNIT"), below_flag=F.when(opt("RESULT_LETTER") == "<", "<").otherwise(""), detection_limit=parse_number(opt("METHOD_DETECTION_LIMIT")),
        fraction=fraction_class(name), characteristic_source=name,
    )
