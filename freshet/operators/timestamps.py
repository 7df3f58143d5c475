"""Mixed timestamp formats and zones, normalised to one UTC instant.

Every written form is one branch of a single regular expression with named groups. One ``regexp_replace`` per value
turns the text into a fixed list of components, so the text is scanned once and stays in generated JVM code. Calendar
ranges are then checked and the instant is assembled with integer day arithmetic. The only shuffle is a map-side
combined count per source, which learns the order of day and month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.session import join_dictionary

# Month names in English and French, as written in the data's languages.
MONTHS = {
    1: "jan january janv janvier",
    2: "feb february févr fevr février fevrier fév",
    3: "mar march mars",
    4: "apr april avr avril",
    5: "may mai",
    6: "jun june juin",
    7: "jul july juil juillet",
    8: "aug august août aout",
    9: "sep sept september septembre",
    10: "oct october octobre",
    11: "nov november novembre",
    12: "dec december déc décembre decembre",
}
# Offsets in minutes of the zone abbreviations in use in North America.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240,
    "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

PARTS = ("year", "month", "day", "first", "second", "name", "hour", "minute", "sec", "half", "zone", "epoch")
_MARK = "\u0002"
_ZONE = r"Z|[+-]\d{2}(?::?\d{2})?|[A-Z]{3,4}|[A-Za-z]+(?:/[A-Za-z_]+)+"
_CLOCK = r"(?<hour@>\d{1,2}):(?<minute@>\d{2})(?::(?<sec@>\d{2})(?:[.,]\d+)?)?(?:\s*(?<half@>[AaPp][Mm]\b))?(?:\s*(?<zone@>" + _ZONE + "))?"
# One branch per written form; @ becomes the number of the branch, since group names are unique in a pattern.
BRANCHES = (
    r"(?<year@>\d{4})(?<mark@>[-/.])(?<month@>\d{1,2})\k<mark@>(?<day@>\d{1,2})(?:(?:T|\s+)" + _CLOCK + ")?",
    r"(?<first@>\d{1,2})/(?<second@>\d{1,2})/(?<year@>\d{4})(?:\s+" + _CLOCK + ")?",
    r"(?<day@>\d{1,2})\.(?<month@>\d{1,2})\.(?<year@>\d{4})(?:\s+" + _CLOCK + ")?",
    r"(?<year@>(?:19|20)\d{2})(?<month@>\d{2})(?<day@>\d{2})(?:[T ]?(?<hour@>\d{2}):?(?<minute@>\d{2})(?::?(?<sec@>\d{2}))?(?:\s*(?<zone@>" + _ZONE + "))?)?",
    r"(?<epoch@>\d{9,10}|\d{12,13}|\d{16})",
    r"(?<day@>\d{1,2})-(?<name@>\p{L}{3,9})-(?<year@>\d{4}|\d{2})(?:\s+" + _CLOCK + ")?",
    r"(?:\p{L}{3,9},\s*)?(?<day@>\d{1,2})\s+(?<name@>\p{L}{3,9})\.?\s+(?<year@>\d{4})(?:\s+" + _CLOCK + ")?",
    r"(?<day@>\d{1,2})\s+(?<name@>\p{L}{3,9})\.?\s+(?<year@>\d{4})\s+(?<hour@>\d{1,2})\s*h\s*(?<minute@>\d{2})?",
    r"(?<name@>\p{L}{3,9})\.?\s+(?<day@>\d{1,2})(?:,\s*|\s+)(?<year@>\d{4})(?:\s+" + _CLOCK + ")?",
)


def pattern() -> str:
    """The alternation of all branches, anchored, with an optional text-guard apostrophe and outer blanks."""
    return r"^\s*'?(?:" + "|".join(b.replace("@", chr(97 + i)) for i, b in enumerate(BRANCHES)) + r")\s*$"


def _replacement() -> str:
    have = [{p for p in PARTS if f"?<{p}@>" in b} for b in BRANCHES]
    return _MARK + _MARK.join("".join("${" + p + chr(97 + i) + "}" for i, h in enumerate(have) if p in h) for p in PARTS)


def components(text: Column) -> Column:
    """Array that holds, after an empty first element, the components in the order of PARTS (empty where a form lacks one).

    Where no form matches the first element is the text itself, or the array has another size.
    """
    # The mark, if any, comes first; what does not match keeps its text and splits into fewer parts.
    parts = F.split(F.regexp_replace(text, F.lit(pattern()), F.lit(_replacement())), _MARK, len(PARTS) + 2)
    return parts


def day_month_order(df: DataFrame, text_col: str, source_col: str, default: str = "mdy") -> DataFrame:
    """Order of day and month in all-numeric dates by source: columns ``source_col``, ``__order`` (mdy or dmy).

    Only dates that read one way alone count as evidence; the majority decides. A source without evidence, or with a
    tie, gets ``default``.
    """
    head = F.regexp_extract(F.col(text_col), r"^\s*'?(\d{1,2})/(\d{1,2})/\d{4}", 1)
    tail = F.regexp_extract(F.col(text_col), r"^\s*'?(\d{1,2})/(\d{1,2})/\d{4}", 2)
    seen = df.filter(F.col(text_col).rlike(r"^\s*'?\d{1,2}/\d{1,2}/\d{4}")).select(F.col(source_col), head.cast("int").alias("__p"), tail.cast("int").alias("__q"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    votes = seen.groupBy(source_col).agg(
        count((F.col("__p") > 12) & F.col("__q").between(1, 12)).alias("__dmy"), count((F.col("__q") > 12) & F.col("__p").between(1, 12)).alias("__mdy")
    )
    decided = F.when(F.col("__dmy") > F.col("__mdy"), "dmy").when(F.col("__mdy") > F.col("__dmy"), "mdy").otherwise(F.lit(default))
    return votes.select(source_col, decided.alias("__order"))


def epoch_days(year: str, month: str, day: str) -> str:
    """SQL text for the days since 1970-01-01 of a Gregorian date, in integer arithmetic (months counted from March)."""
    y = f"({year} - if({month} <= 2, 1, 0))"
    return f"(365 * {y} + {y} div 4 - {y} div 100 + {y} div 400 + (153 * (({month} + 9) % 12) + 2) div 5 + {day} - 719469)"


def _month_of(name: Column) -> Column:
    pairs = [x for n, names in MONTHS.items() for s in names.split() for x in (F.lit(s), F.lit(n))]
    return F.try_element_at(F.create_map(*pairs), F.lower(name))


def known_zones(spark: SparkSession) -> list[str]:
    """All zone names the JVM knows; a name outside it counts as no zone instead of failing the job."""
    return sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())


def normalize_timestamps(df: DataFrame, text_col: str, zone_col: str | None = None, source_col: str | None = None, default_order: str = "mdy", out: str = "utc", pivot: int = 70) -> DataFrame:
    """Adds ``<out>_seconds`` (UTC seconds since 1970, fractions cut off) and ``<out>_status``.

    ``zone_col`` holds the IANA zone of stamps that name none; ``source_col`` the source within which the order of day
    and month is constant (learned from the data, see day_month_order). Two-digit years from ``pivot`` on are 19xx.

    Status: ``ok``; ``ambiguous`` or ``nonexistent`` where the local clock showed the reading twice or skipped it;
    ``unreadable`` where the text gives no complete and possible date and time (a date alone is complete, at 00:00);
    ``no_zone`` where neither the text nor ``zone_col`` gives a zone; null for a null text. Seconds are null unless the
    status is ``ok``. Repeated rows give repeated results, an empty table an empty one; columns of the input that bear
    the names of the results are replaced; other columns pass through. Names starting with ``__`` are reserved.
    """
    keep = [c for c in df.columns if c.lower() not in {f"{out}_seconds".lower(), f"{out}_status".lower()}]
    df = df.select(*[F.col(f"`{c}`") for c in keep])
    if source_col:
        orders = day_month_order(df, text_col, source_col, default_order).withColumnRenamed(source_col, "__source")
        df = join_dictionary(df, orders, F.col(source_col).eqNullSafe(F.col("__source")), "left").drop("__source")
    else:
        df = df.withColumn("__order", F.lit(default_order))
    df = df.withColumn("__c", components(F.col(text_col)))
    part = lambda p: F.get("__c", F.lit(PARTS.index(p) + 1))
    num = lambda p: F.when(part(p) != "", part(p).try_cast("int"))
    df = df.withColumn("__dmy", F.coalesce(F.col("__order") == "dmy", F.lit(default_order == "dmy")))
    y = num("year")
    df = df.select(
        *keep,
        F.when(F.length(part("year")) == 2, y + F.when(y >= pivot, 1900).otherwise(2000)).otherwise(y).alias("__y"),
        F.when(part("first") != "", F.when(F.col("__dmy"), num("second")).otherwise(num("first"))).when(part("name") != "", _month_of(part("name"))).otherwise(num("month")).alias("__m"),
        F.when(part("first") != "", F.when(F.col("__dmy"), num("first")).otherwise(num("second"))).otherwise(num("day")).alias("__d"),
        F.coalesce(num("hour"), F.lit(0)).alias("__h"),
        F.coalesce(num("minute"), F.lit(0)).alias("__n"),
        F.coalesce(num("sec"), F.lit(0)).alias("__s"),
        F.lower(part("half")).alias("__half"),
        part("zone").alias("__z"),
        F.when(part("epoch") != "", F.when(F.length(part("epoch")) >= 12, F.expr(f"try_cast(__c[{PARTS.index('epoch') + 1}] as bigint) div if(length(__c[{PARTS.index('epoch') + 1}]) = 16, 1000000, 1000)")).otherwise(part("epoch").try_cast("bigint"))).alias("__epoch"),
        ((F.size("__c") == len(PARTS) + 1) & (F.get("__c", F.lit(0)) == "")).alias("__read"),
    )
    leap = "(__y % 4 = 0 and (__y % 100 <> 0 or __y % 400 = 0))"
    long = f"case when __m in (4, 6, 9, 11) then 30 when __m = 2 then if({leap}, 29, 28) else 31 end"
    clock = "__n between 0 and 59 and __s between 0 and 59 and if(__half = '', __h between 0 and 23, __h between 1 and 12)"
    df = df.withColumn("__ok", F.expr(f"__read and (__epoch is not null or coalesce(__y >= 1 and __m between 1 and 12 and __d between 1 and {long} and {clock}, false))"))
    hour = "if(__half = '', __h, __h % 12 + if(__half = 'pm', 12, 0))"
    df = df.withColumn("__local", F.expr(f"if(__ok and __epoch is null, cast({epoch_days('__y', '__m', '__d')} as bigint) * 86400 + {hour} * 3600 + __n * 60 + __s, null)"))
    abbr = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v * 60))])
    digits = F.regexp_replace("__z", "[:+-]", "")
    offset = F.when(
        F.col("__z").rlike(r"^[+-]"),
        (F.substring(digits, 1, 2).cast("int") * 3600 + F.coalesce(F.when(F.length(digits) == 4, F.substring(digits, 3, 2).cast("int")), F.lit(0)) * 60) * F.when(F.col("__z").startswith("-"), -1).otherwise(1),
    ).when(F.col("__z") != "", F.try_element_at(abbr, F.col("__z")))
    region = F.when(F.col("__z").contains("/"), F.col("__z"))
    if zone_col:
        region = region.when(F.col("__z") == "", F.col(zone_col))
    region = F.when(region.isin(known_zones(df.sparkSession)), region)
    df = df.withColumn("__offset", F.when(F.col("__local").isNotNull(), offset)).withColumn("__region", F.when(F.col("__local").isNotNull(), region))
    shift = lambda at: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(at), F.col("__region"))) - at
    # The offsets a day before and after bracket at most one change; the reading fits those that hold at their own instant.
    df = df.withColumn("__o1", shift(F.col("__local") - 86400)).withColumn("__o2", shift(F.col("__local") + 86400))
    df = df.withColumn("__f1", F.when(F.col("__o1") == F.col("__o2"), True).otherwise(shift(F.col("__local") - F.col("__o1")) == F.col("__o1")))
    df = df.withColumn("__f2", F.when(F.col("__o1") == F.col("__o2"), False).otherwise(shift(F.col("__local") - F.col("__o2")) == F.col("__o2")))
    seconds = (
        F.when(F.col("__epoch").isNotNull(), F.col("__epoch"))
        .when(F.col("__offset").isNotNull(), F.col("__local") - F.col("__offset"))
        .when(F.col("__f1") & ~F.col("__f2"), F.col("__local") - F.col("__o1"))
        .when(F.col("__f2") & ~F.col("__f1"), F.col("__local") - F.col("__o2"))
    )
    status = (
        F.when(F.col(text_col).isNull(), None)
        .when(~F.col("__ok") | ((F.col("__z") != "") & F.col("__offset").isNull() & F.col("__region").isNull() & F.col("__epoch").isNull()), "unreadable")
        .when(F.col("__epoch").isNotNull() | F.col("__offset").isNotNull(), "ok")
        .when(F.col("__region").isNull(), "no_zone")
        .when(F.col("__f1") & F.col("__f2"), "ambiguous")
        .when(~F.col("__f1") & ~F.col("__f2"), "nonexistent")
        .otherwise("ok")
    )
    # A one-element explode keeps later filters on the results from being pushed into, and copied over, the projections above.
    df = df.select(*keep, F.explode(F.array(F.struct(seconds.alias("s"), status.alias("t")))).alias("__r"))
    return df.select(*keep, F.when(F.col("__r.t") == "ok", F.col("__r.s")).alias(f"{out}_seconds"), F.col("__r.t").alias(f"{out}_status"))


def instant(seconds: str) -> Column:
    """Timestamp without zone, in UTC, of a column of UTC seconds, whatever the session's zone."""
    return F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {seconds})")


def instant_text(seconds: str) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ`` of a column of UTC seconds, whatever the session's zone."""
    two = lambda x: f"substr(cast(100 + {x} as string), 2, 2)"
    of_day = f"pmod({seconds}, 86400L)"
    day = f"cast(date_from_unix_date(cast(({seconds} - {of_day}) div 86400 as int)) as string)"
    return F.expr(f"concat({day}, 'T', {two(of_day + ' div 3600')}, ':', {two(of_day + ' div 60 % 60')}, ':', {two(of_day + ' % 60')}, 'Z')")


def found(df: DataFrame, zones: DataFrame, key: str = "rec_id") -> DataFrame:
    """The instants of all non-null stamps that are not yet a real date and time in the form ``YYYY-MM-DDTHH:MM:SSZ``.

    ``zones`` maps ``state_prov`` to an IANA zone. A status other than ok stands in place of the instant.
    """
    # Whether a stamp is a case at all is told by its form and a native cast; the cases alone go through the operator.
    # The order of day and month needs no other rows: all-numeric dates are cases.
    plain = F.col("datetime").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$") & F.col("datetime").try_cast("timestamp").isNotNull()
    rows = df.select(key, "datetime", "source", "state_prov").filter(F.col("datetime").isNotNull() & ~plain)
    rows = rows.join(zones.select("state_prov", F.col("zone").alias("__home")), "state_prov", "left")
    done = normalize_timestamps(rows, "datetime", "__home", "source")
    return done.select(key, F.when(F.col("utc_status") == "ok", instant_text("utc_seconds")).otherwise(F.col("utc_status")).alias("utc"))
